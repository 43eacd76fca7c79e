"""Fingerprints, the Merkle manifest and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from brute import AWKWARD
from pyspark.sql import functions as F

from manyvote.llm import merkle, repair, simhash
from manyvote.llm.queries import QUERIES

# --- fingerprints


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    total, bits = 0, [0] * 128
    for term in [" ".join(words[i : i + 2]) for i in range(len(words))]:
        crc, hashed = zlib.crc32(term.encode()), 0
        for factor in simhash.FACTORS:
            hashed = hashed << 32 | (crc * factor >> 16 & 0xFFFFFFFF)
        weight = min(len(term), 63)
        total += weight
        for i in range(128):
            bits[i] += weight * (hashed >> i & 1)
    return sum(1 << i for i in range(128) if 2 * bits[i] > total)


def whole(row, side=""):
    return (row[f"{side}hi"] % 2**64) << 64 | row[f"{side}lo"] % 2**64


def edited(text, following):
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


DOCS = "doc_id bigint, text string, id string, hi bigint, position bigint, k1 string, text_ string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "own", 1, 2, "k", None) for i, t in rows], DOCS).repartition(3)


def test_fingerprints_equal_brute_force(spark):
    random.seed(5)
    texts = AWKWARD + [" ".join(random.choice("ab cde fghi é 你好".split()) for _ in range(n)) for n in (1, 2, 511, 512, 513, 1500, 9000)]
    rows = list(enumerate(texts)) + [(0, "again one id"), (3, texts[3]), (None, "no id"), (None, None)]
    got = simhash.fingerprints(docs(spark, rows)).collect()
    assert sorted((r["id"] is not None, r["id"] or 0, whole(r)) for r in got) == sorted((i is not None, i or 0, fingerprint(t)) for i, t in rows)


def test_edited_texts_take_the_head_of_the_next(spark, workspace):
    texts = [t or "" for t in AWKWARD] + ["four", "a b c d e f g h"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = {r["id"]: r for r in simhash.edit_likeness(docs(spark, rows), workspace=workspace).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        new, r = edited(t, following), got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (whole(r), whole(r, "edited_"), whole(r, "next_")) == (fingerprint(t), fingerprint(new), fingerprint(following))


def test_fingerprints_of_odd_tables(spark, workspace):
    assert simhash.edit_likeness(docs(spark, [])).collect() == []
    assert simhash.fingerprints(docs(spark, [])).collect() == []
    alone = simhash.edit_likeness(docs(spark, [(7, "abcdefgh")]), workspace=workspace).head()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and whole(alone) == whole(alone, "next_")
    twice = simhash.edit_likeness(docs(spark, [(1, "abcd efgh")] * 3 + [(2, "ijkl"), (None, None), (None, "x y z w")]), workspace=workspace).collect()
    assert sorted(str(r["id"]) for r in twice) == ["1", "1", "1", "2", "None", "None"]
    assert {r["edited_sha256"] for r in twice if r["id"] == 1} == {hashlib.sha256(b"abcd efij").hexdigest()}
    assert {whole(r) for r in twice if r["id"] == 1} == {fingerprint("abcd efgh")}


@pytest.mark.parametrize("blocks", [simhash.Blocks(), simhash.Blocks(0, 1), simhash.Blocks(7, 8), simhash.Blocks(2, 6)])
def test_permuted_blocks_find_all_within_the_radius(spark, blocks):
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(128)
        prints += [base, base] + [base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 9))) for _ in range(6)]
    prints += [0, 0, 1, (1 << 128) - 1]
    low = (1 << 64) - 1
    halves = [(simhash._signed(p >> 64), simhash._signed(p & low)) for p in prints]
    table = spark.createDataFrame(halves, "hi bigint, lo bigint").repartition(3)
    got = [(whole(r), whole(r, "near_"), r["distance"]) for r in simhash.within_radius(table, table, blocks).collect()]
    want = {(a, b, (a ^ b).bit_count()) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= blocks.radius}
    assert len(got) == len(set(got)) and set(got) == want
    asked = F.col("hi") % 2 == 0
    counts = {whole(r): r["n_near"] for r in simhash.near_counts(table, asked, blocks).collect()}
    assert counts == {a: sum((a ^ b).bit_count() <= blocks.radius for b in prints) for a in prints if (a >> 64) % 2 == 0}


def test_fingerprints_use_no_python(spark, sf_dir):
    plan = simhash.edit_likeness(docs(spark, [(1, "a b"), (2, "c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edited_texts_are_nearer_than_the_next(spark, sf_dir):
    rows = QUERIES["op11_simhash"](spark, sf_dir).where("n_chars >= 200").collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 0.97 * len(rows)


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    for digests in tree[:-1]:
        run = digests[i // 8 * 8 : i // 8 * 8 + 8]
        yield i % 8, run
        i //= 8


def manifest_rows(rows):
    """What op12 says of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    ordered = [sorted(groups[x], key=lambda r: r[:3]) for x in langs]
    trees = [levels([r[2] for r in members]) for members in ordered]
    top = levels([t[-1][0] for t in trees])
    for number, (members, tree) in enumerate(zip(ordered, trees)):
        for i, (_, _, leaf, row) in enumerate(members):
            steps = [*path(tree, i), *path(top, number)]
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4]:
                changed = (*row[:4], row[4].translate({c: c + 32 for c in range(65, 91)}))
            folded = leaf_of(changed)
            for digit, run in steps:
                folded = sha("".join([*run[:digit], folded, *run[digit + 1 :]]))
            proof = sha("".join("".join(run[:d] + run[d + 1 :]) for d, run in steps))
            yield row[0], leaf, tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]


SIZES = [{"en": 1}, {"en": 8, None: 9}, {"en": 65, "de": 1, "": 64, None: 3}, {"l": 513, **{f"l{i}": 1 + i % 3 for i in range(20)}}, {}]


@pytest.mark.parametrize("sizes", SIZES)
def test_proofs_equal_brute_force(spark, tmp_path, sizes):
    rng, rows = random.Random(2), []
    for lang, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i if i % 17 else None, rng.choice(["A", None, "é"]), lang, rng.choice([None, i]), rng.choice([None, "", "Text É", "low", "X" * 3000])))
    rows += rows[-2:]  # repeated
    table = [(*r, "own", 1, "t", b"r") for r in rows]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, rank int, tree string, digest binary"
    spark.createDataFrame(table, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(manifest_rows(rows), key=key)


def test_some_requests_get_their_proofs_and_others_none(spark, workspace):
    rows = spark.range(100).select("id", F.lit("x").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    manifest = merkle.build(rows, "lang", "id", workspace)
    asked = spark.createDataFrame([(0, 3, "a"), (0, 99, "b"), (0, 3, "c"), (0, 100, "d"), (1, 0, "e")], "tree bigint, rank bigint, name string")
    got = merkle.prove(manifest, asked, workspace).withColumn("folded", merkle.fold(F.col("found"), F.col("segments"))).collect()
    assert sorted(r["name"] for r in got) == ["a", "b", "c"] and all(r["folded"] == r["root"] == r["subroot"] for r in got)
    assert {r["name"]: r["found"] for r in got} == {"a": sha("3"), "b": sha("99"), "c": sha("3")}
    assert manifest.records.count() == 13 + 2 + 1


# --- conversation repair


def fault_of(row, seen):
    solid = re.sub(r"[\x20\x09-\x0D]+", "", row[2])
    return "blank" if not solid else "duplicate" if row[1:] in seen else None if solid[-1] in ".!?" else "truncated"


def all_faults(rows):
    return [fault_of(row, {r[1:] for r in rows[:i]}) for i, row in enumerate(rows)]


def cheapest_repair(rows, faults):
    """(cost, audit, repaired rows) by the shortest path over (rows consumed, last initial)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        made = [(3, "I", i, x, (repair.NAMES[x], "")) for x in after[last] if x != "s"]
        if i < len(rows):
            _, role, text = rows[i]
            made.append((4, "D", i + 1, last, None))
            if faults[i] in (None, "truncated"):
                more = 3 if faults[i] else 0
                made += [(more, "K", i + 1, role[:1], (role, text))] if role and role[0] in after[last] else []
                made += [(3 + more, "R", i + 1, x, (repair.NAMES[x], text)) for x in after[last] if x != "s"]
        for extra, edit, at, x, line in made:
            heapq.heappush(heap, (cost + extra, audit + edit, at, x, (*out, line) if line else out))


def repair_rows(rows):
    """What op13 says of rows (conv_id, turn, role, text)."""
    told = {}
    for conv, turn, role, text in rows:
        kept = told.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, kept in told.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        found = all_faults(kept)
        cost, audit, out = cheapest_repair(kept, found)
        initials = [r[1][:1] for r in kept]
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = sha("\n".join(f"{r}:{t}" for r, t in out))
        yield conv, gaps, *(found.count(f) for f in repair.FAULTS), illegal, cost, audit, digest


def random_turns(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(["a.", "b!", "c? ", "d", "e \n", "", "  \t", None])) for _ in range(n)]


def test_charts_equal_the_shortest_path():
    rng = random.Random(4)
    for _ in range(3000):
        rows = [(t, r or "", x or "") for t, r, x in random_turns(rng, rng.randint(0, 9))]
        found = all_faults(rows)
        cells = [repair.row_cell(r[1][:1], f) for r, f in zip(rows, found)]
        cost, audit = repair.cheapest(repair.chart(cells) if cells else None)
        applied = repair.Repaired(audit)
        for _, role, text in rows:
            applied.row(role, text)
        want = cheapest_repair(rows, found)
        assert (cost, audit, applied.digest()) == (*want[:2], sha("\n".join(f"{r}:{t}" for r, t in want[2])))


def test_any_split_of_a_span_gives_the_same_cell():
    rng = random.Random(6)
    cells = [repair.row_cell(rng.choice("suatx"), rng.choice([None, None, "blank", "truncated"])) for _ in range(40)]
    for cut in range(1, 40):
        assert repair.combine(repair.chart(cells[:cut]), repair.chart(cells[cut:])) == repair.chart(cells)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, cell int, at string, part int"


def conversations(spark, rows, folder):
    spark.createDataFrame([(*r, "own", 1, None, 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, QUERIES["op13_repair"](spark, str(folder)).collect()), key=str)


def test_repairs_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(conv, *turn) for conv in [None, *range(60)] for turn in random_turns(rng, rng.randint(1, 12))]
    rows += rows[:9] + [(90, i, "user" if i % 2 else "assistant", "x" * 200000 + ".") for i in range(6)]
    assert conversations(spark, rows, tmp_path) == sorted(repair_rows(rows), key=str)


def test_long_conversations_are_parsed_in_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 4)
    monkeypatch.setattr(repair, "GATHER", 3)
    rng = random.Random(9)
    rows = [(1, i, *turn[1:]) for i, turn in enumerate(random_turns(rng, 400))] + [(2, i, "user", f"{i}.") for i in range(30)] + [(3, 0, "user", "a.")]
    assert conversations(spark, rows, tmp_path) == sorted(repair_rows(rows), key=str)


def test_conversations_without_rows(spark, tmp_path):
    assert conversations(spark, [], tmp_path / "none") == []
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations(spark, [(gone, 0, "user", "a.")], tmp_path / "one") == [empty]
