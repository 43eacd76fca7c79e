"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declarative mapping that says where turns, roles and texts
lie, and the record becomes canonical turns. A template writes the turns as one string, with control strings inside
texts escaped reversibly, and the spans of the assistant's texts as a loss mask; ``read_back`` recovers the turns
and the masked text from the output alone.

Cases: a null text is empty; a null role is the empty role; a record without turns gives no text and no turns; a record
of unknown layout, of broken JSON or null has ``layout`` null and no turns and is not dropped; turns with equal numbers
are ordered by role and text; repeated rows of one conversation are turns each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from .rows import map_texts, slices, struct_lists


@dataclass(frozen=True)
class Mapping:
    """A layout. ``many``: path of the list of turns, with ``role``, ``text`` and perhaps ``order`` inside; or ``single``: pairs of
    a role and the paths whose texts, joined by a blank line, are that role's one turn. ``optional`` paths may be missing.
    ``roles`` renames roles."""

    name: str
    many: str | None = None
    role: str | None = None
    text: str | None = None
    order: str | None = None
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        if self.many:
            inner = [p for p in (self.role, self.text, self.order) if p]
            return {f"{self.many}[].{p}" for p in inner} | set(self.optional)
        return {p for _, ps in self.single for p in ps} | set(self.optional)


_PEOPLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "prompter": "user"}

MAPPINGS = (
    Mapping("turn rows", many="rows", role="role", text="text", order="turn"),
    Mapping("messages", many="messages", role="role", text="content", optional=("id",)),
    Mapping("conversations", many="conversations", role="from", text="value", optional=("id", "system"), roles=_PEOPLE),
    Mapping("instruction", single=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input", "id")),
    Mapping("prompt", single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system", "id")),
    Mapping("prompt and response", single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system", "id")),
    Mapping("question", single=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context", "id")),
)


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves; elements of lists share one path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Fingerprints of every layout with each choice of its optional paths, and of a list without turns."""
    known: dict[str, Mapping] = {}
    for mapping in mappings:
        needed = mapping.paths() - set(mapping.optional)
        for k in range(len(mapping.optional) + 1):
            for some in combinations(mapping.optional, k):
                for paths in [needed | set(some)] + ([{f"{mapping.many}[]"} | set(some)] if mapping.many else []):
                    known.setdefault(fingerprint(paths), mapping)
    return known


def schema_paths(kind, at: str = "") -> set[str]:
    """The paths that ``field_paths`` finds in values of a Spark type."""
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else {at}
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def row_mapping(schema: StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The layout of a table whose rows are turns, by the fingerprint of its columns; an unknown one is an error."""
    known: dict[str, Mapping] = {}
    for mapping in mappings:
        if mapping.many:
            known.setdefault(fingerprint({mapping.role, mapping.text}), mapping)
    paths = schema_paths(schema)
    if fingerprint(paths) not in known:
        raise ValueError(f"no layout has turns of {sorted(paths)}")
    return known[fingerprint(paths)]


def canonical_turns(record, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) in order."""

    def text(value) -> str:
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    if mapping.many:
        entries = record.get(mapping.many) or []
        if mapping.order:
            def rank(e):
                n = e.get(mapping.order)
                return (n is not None, n if n is not None else 0, text(e.get(mapping.role)), text(e.get(mapping.text)))

            entries = sorted(entries, key=rank)
        turns = [(text(e.get(mapping.role)), text(e.get(mapping.text))) for e in entries]
        if isinstance(record.get("system"), str) and "system" in mapping.optional:
            turns.insert(0, ("system", record["system"]))
        return [(mapping.roles.get(r, r), t) for r, t in turns]
    turns = []
    for role, paths in mapping.single:
        given = [text(record[p]) for p in paths if p in record]
        if given:
            turns.append((role, "\n\n".join(g for g in given if g)))
    return turns


@dataclass(frozen=True)
class Template:
    """A turn is ``start``, its role, a line end, the text in ``open`` and ``close`` unless it is the assistant's, and ``end``.

    A control string inside a role or text gets a backslash after its first character, and one more where it has some,
    so that no control string stands in a text and the step can be undone.
    """

    start: str = "<s>"
    end: str = "</s>"
    open: str = "[INST] "
    close: str = " [/INST]"
    masked: str = "assistant"

    def controls(self) -> list[str]:
        return sorted({c.strip() for c in (self.start, self.end, self.open, self.close)}, key=len, reverse=True)

    def _pattern(self, least: str) -> re.Pattern:
        return re.compile("|".join(f"({re.escape(c[0])})({least})(?={re.escape(c[1:])})" for c in self.controls()))

    def escape(self, text: str) -> str:
        return self._pattern(r"\\*").sub(lambda m: "".join(g for g in m.groups() if g) + "\\", text)

    def unescape(self, text: str) -> str:
        return self._pattern(r"\\+").sub(lambda m: m[0][:-1], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted string and the spans of the assistant's texts in it, in code points."""
        out, spans, at = [], [], 0
        for role, text in turns:
            name = self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
            plain = role == self.masked
            head = f"{self.start}{name}\n" + self.open * (not plain)
            body = self.escape(text)
            if plain:
                spans.append((at + len(head), at + len(head) + len(body)))
            piece = head + body + self.close * (not plain) + self.end
            out.append(piece)
            at += len(piece)
        return "".join(out), spans

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted string."""
        turns, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.start, at):
                raise ValueError(f"no turn starts at {at}")
            line = formatted.index("\n", at)
            name = self.unescape(formatted[at + len(self.start) : line])
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name)
            stop = formatted.index(self.end, line)
            body = formatted[line + 1 : stop]
            if role != self.masked:
                body = body[len(self.open) : len(body) - len(self.close)]
            turns.append((role, self.unescape(body)))
            at = stop + len(self.end)
        return turns

    def masked_text(self, formatted: str, spans: list[tuple[int, int]]) -> str:
        """All text under the loss mask, unescaped."""
        return "".join(self.unescape(formatted[a:b]) for a, b in spans)


def format_records(records: DataFrame, key: str, record: str, template: Template = Template(), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Per row: ``layout``, ``fingerprint``, ``formatted`` and ``loss_spans`` array of (start, end), from JSON records."""
    fields = "layout string, fingerprint string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"

    def make():
        known = registry(mappings)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def compute(texts):
            out = {"layout": [], "fingerprint": [], "formatted": []}
            masks = []
            for text in texts:
                try:
                    parsed = json.loads(text)
                except ValueError:
                    parsed = None
                mark = fingerprint(field_paths(parsed)) if isinstance(parsed, dict) else None
                mapping = known.get(mark)
                turns = canonical_turns(parsed, mapping) if mapping else []
                formatted, spans = template.render(turns)
                for name, value in (("layout", mapping.name if mapping else None), ("fingerprint", mark), ("formatted", formatted)):
                    out[name].append(value)
                masks.append(spans)
            return out | {"loss_spans": struct_lists(masks, kind)}

        return compute

    return map_texts(records, key, record, fields, make)


def conversation_digests(
    rows: DataFrame, key: str = "conv_id", turn: str = "turn", content: tuple[str, ...] = ("role", "text"), template: Template = Template(), mappings: tuple[Mapping, ...] = MAPPINGS
) -> DataFrame:
    """What ``digests`` gives for each conversation of a table whose rows are turns, ordered by ``turn``.

    The fingerprint of the schema of the columns ``content`` selects the mapping, which says where role and text lie; an
    unknown layout is an error. Other columns are not read. Each turn is formatted and read back alone. The turns of a conversation are sorted in one task, which may spill, and
    go through it one after another: only lengths and digest states are kept, so memory is bounded by a batch of turns.
    """

    def plain(column: str):
        return F.make_valid_utf8(F.coalesce(F.col(column).cast("string"), F.lit("")))

    mapping = row_mapping(rows.select(*content).schema, mappings)
    source = rows.select(F.col(key), F.col(turn).alias("_turn"), plain(mapping.role).alias("_role"), plain(mapping.text).alias("_text"))
    turn_schema = StructType([*source.schema.fields, *StructType.fromDDL("_masked boolean, _chars bigint").fields])
    turn_arrow = to_arrow_schema(turn_schema)
    schema = StructType([source.schema[0], *StructType.fromDDL(DIGESTS).fields])
    arrow = to_arrow_schema(schema)

    def each_turn(batches):
        for batch in batches:
            for part in slices(batch, 3):
                out = {"_role": [], "_text": [], "_masked": [], "_chars": []}
                for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    formatted, spans = template.render(canonical_turns({mapping.many: [{mapping.role: r, mapping.text: t}]}, mapping))
                    [(back, body)] = template.read_back(formatted)
                    for name, value in zip(out, (back, template.masked_text(formatted, spans) if spans else body, bool(spans), len(formatted))):
                        out[name].append(value)
                kept = [part.column(i).cast(turn_arrow.field(i).type) for i in (0, 1)]
                made = [pa.array(values, type=turn_arrow.field(name).type) for name, values in out.items()]
                yield pa.RecordBatch.from_arrays(kept + made, schema=turn_arrow)
        pa.default_memory_pool().release_unused()

    def each_conversation(batches):
        now = None
        done: list[tuple] = []

        def flush():
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for part in slices(batch, 3):
                keys, _, roles, texts, masked, chars = (c.to_pylist() for c in part.columns)
                for k, r, t, m, n in zip(keys, roles, texts, masked, chars):
                    if now is None or now.key != k:
                        if now is not None:
                            done.append(now.row())
                        now = _Running(k)
                    now.add(r, t, m, n)
                if len(done) >= 4096:
                    yield flush()
                    done.clear()
        if now is not None:
            done.append(now.row())
            yield flush()
        pa.default_memory_pool().release_unused()

    turns = source.mapInArrow(each_turn, turn_schema)
    return turns.repartition(key).sortWithinPartitions(key, "_turn", "_role", "_text").mapInArrow(each_conversation, schema)


class _Running:
    """Counts and digest states of one conversation, turn after turn."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, masked: bool, chars: int) -> None:
        self.turns += 1
        self.chars += chars
        self.all.update(f"{role}\n{text}\n".encode())
        if masked:
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame, key: str, template: Template = Template()) -> DataFrame:
    """Per row, read back from ``formatted`` and ``loss_spans``: number and digest of the turns, length and digest of the masked text."""
    packed = formatted.select(key, F.to_json(F.struct("formatted", "loss_spans")).alias("_packed"))

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def make():
        def compute(texts):
            out = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text in texts:
                row = json.loads(text)
                turns = template.read_back(row["formatted"])
                loss = template.masked_text(row["formatted"], [(s["start"], s["end"]) for s in row.get("loss_spans", [])])
                for name, value in zip(out, (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(row["formatted"]))):
                    out[name].append(value)
            return out

        return compute

    return map_texts(packed, key, "_packed", DIGESTS, make)
