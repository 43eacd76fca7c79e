"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard
parser evaluates the tags' expressions.

Cases: null and empty texts have no words, no places, no labels and score 0; every row gives one row,
repeated rows included; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .rows import map_texts, struct_lists
from .words import alnum_spans, utf8, _ALNUM

# Phrases that must be found as consecutive words, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Further notices the method knows; they give labels, not base places.
NOTICE_PHRASES = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How freely text under a licence may be used, by the start of its identifier.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "lgpl": 0.6, "epl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-sa": 0.5,
    "cc-by-nc": 0.1, "cc-by-nd": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.2
EXCEPTION = 0.2
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")


def openness(identifier: str) -> float:
    known = [k for k in OPENNESS if identifier == k or identifier.startswith(k + "-")]
    return OPENNESS[max(known, key=len)] if known else UNKNOWN


def family(identifier: str) -> str:
    """Label of an identifier: the licence's name without version."""
    known = [k for k in OPENNESS if identifier == k or identifier.startswith(k + "-")]
    return max(known, key=len) if known else identifier


def parse(line: str) -> list[str] | None:
    """Licence expression at the start of the line in postfix order (shunting yard); None if malformed.

    Text after a whole expression, such as the end of a comment, ends it.
    """
    output: list[str] = []
    waiting: list[str] = []
    at, operand = 0, True
    while m := _TOKEN.match(line, at):
        token = m[1].lower()
        if operand and token == "(":
            waiting.append(token)
        elif operand and token not in _PRECEDENCE and token != ")":
            output.append(token)
            operand = False
        elif not operand and token == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                output.append(top)
        elif not operand and token in _PRECEDENCE:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand = True
        else:
            break
        at = m.end()
    if operand or "(" in waiting:
        return None
    return output + waiting[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Openness of an expression and its licence labels: or takes the freer side, and the stricter, with
    an exception adds to its licence. The name after ``with`` is no label."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append((openness(token), {family(token)}))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(1.0, a[0] + EXCEPTION), a[1]))
        else:
            stack.append(((max if token == "or" else min)(a[0], b[0]), a[1] | b[1]))
    return stack[0]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in (BASE_PHRASES | NOTICE_PHRASES).items():
        found.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def scan(text: str, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple], list[tuple]]:
    """Number of words; places (start word, phrase, label, base) in order; expressions (offset, text, openness, labels)."""
    words = utf8(text).translate(_ALNUM).split()
    flat = " " + " ".join(map(_latin, words)) + " "
    places, tags, word, done = [], [], 0, 0
    hits = sorted((end - len(hit[0]) - 1, hit) for end, hit in automaton.iter(flat))
    for start, (phrase, label, base) in hits:
        word += flat.count(" ", done, start)
        done = start
        if phrase == TAG:
            tags.append(word + phrase.count(" "))
        else:
            places.append((word, phrase, label, base))
    expressions = []
    if tags:
        spans = alnum_spans(text)
        for last in tags:
            at = spans[last][1]
            if m := re.match(r"[ \t]*:", text[at : at + 64]):
                line = re.compile(r"[^\r\n]*").match(text, at + m.end())[0]
                if postfix := parse(line):
                    value, labels = evaluate(postfix)
                    expressions.append((at + m.end(), line.strip(), value, sorted(labels)))
    return len(words), places, expressions


def _latin(word: bytes) -> str:
    return word.decode("latin-1")


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_words``; ``places`` array of (start_word, phrase, label, base); ``expressions`` array of
    (start, text, openness, labels); ``openness``, the least over all statements found, 0 without any."""
    fields = (
        "n_words bigint, places array<struct<start_word:bigint,phrase:string,label:string,base:boolean>>, "
        "expressions array<struct<start:bigint,text:string,openness:double,labels:array<string>>>, openness double"
    )

    def make():
        import pyarrow as pa

        automaton = _automaton()
        place = pa.list_(pa.struct([("start_word", pa.int64()), ("phrase", pa.string()), ("label", pa.string()), ("base", pa.bool_())]))
        expression = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("openness", pa.float64()), ("labels", pa.list_(pa.string()))]))

        def compute(texts):
            found = [scan(t, automaton) for t in texts]
            return {
                "n_words": [n for n, _, _ in found],
                "places": struct_lists([p for _, p, _ in found], place),
                "expressions": struct_lists([e for _, _, e in found], expression),
                "openness": [min([openness(x[2]) for x in p] + [x[2] for x in e], default=0.0) for _, p, e in found],
            }

        return compute

    return map_texts(docs, key, text, fields, make)
