"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, dotted digits, plus
signs and identifier cues; local parsers expand each anchor to its left and right and validate what they find.

Kinds with fixed definitions: email, ip, card, phone. Kinds the method adds: ``login`` (user and password
in a URL), ``iban`` (valid check digits), ``secret`` (quoted or bare value after a key, token or password
cue), ``account`` (number after an account or passport cue).

Cases: null and empty texts have no spans; kinds may overlap one another, spans of one kind do not; every
row gives one row, repeated rows included; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_texts, struct_lists, text_column

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("login", "iban", "secret", "account")
KINDS = BASE_KINDS + ADDED_KINDS

_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PHONE_TAIL = re.compile(r"[ ().0-9-]*")
_USERINFO = re.compile(r"[^\s/@:<>\"']+:[^\s/@<>\"']+@[A-Za-z0-9.-]+")
_VALUE = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/.=-]{16,})")
_PASSWORD = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}(?:\"([^\"\n]{8,200})\"|'([^'\n]{8,200})'|[\"']?([^\s\"']{8,}))")
_MIXED = re.compile(r"[0-9!@#$%^&*?~]")
_NUMBER = re.compile(r"(?:[ \t]{0,3}(?:number|no|nr|#|is)\b\.?){0,2}[ \t:#=]{1,4}([A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,16})\b", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")

# Cues in lower case; they are searched in the text with A-Z lowered.
PASSWORD_CUES = ("secret", "password", "passwd")
SECRET_CUES = PASSWORD_CUES + ("token", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key")
ACCOUNT_CUES = ("account", "passport", "iban", "ssn")

#: Length of a country's IBAN; those of other countries are tried from the longest to the shortest.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("://", ("login", 3))
    for digit in "0123456789":
        found.add_word("." + digit, ("ip", 2))
        found.add_word("+" + digit, ("phone", 2))
        found.add_word(digit, ("card", 1))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """A-Z in lower case, all other characters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    rest = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in rest)) % 97 == 1


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS`` and then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in automaton.iter(_lowered(text)):
        if last + 1 - length < done[kind]:
            continue
        for got, a, b in _EXPAND[kind](text, last + 1 - length, last + 1, done):
            found[got].append((a, b))
    return [(kind, a, b) for kind in KINDS for a, b in sorted(found[kind])]


def _email(text, start, end, done):
    """Left over the local part, never into the previous address; right over the labels of the domain."""
    domain = _DOMAIN.match(text, end)
    if not domain:
        return ()
    at = start
    while at > done["email"] and text[at - 1].isascii() and (text[at - 1].isalnum() or text[at - 1] in "._%+-"):
        at -= 1
    if at == start:
        return ()
    done["email"] = domain.end()
    return (("email", at, domain.end()),)


def _ip(text, start, end, done):
    """The chain of digit runs around a dot, four runs at a time."""
    at = start
    while at > done["ip"] and text[at - 1] in _DIGITS:
        at -= 1
    if at == start:
        return ()
    chain = _DOTTED.match(text, at)
    runs = [(m.start(), m.end()) for m in re.finditer("[0-9]+", chain[0])]
    usable = len(runs) // 4 * 4
    found = []
    for i in range(0, usable, 4):
        four = runs[i : i + 4]
        if all(_small(chain[0][a:b]) for a, b in four):
            found.append(("ip", at + four[0][0], at + four[3][1]))
    done["ip"] = chain.end()
    return found


def _small(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or "0") <= 255


def _card(text, start, end, done):
    """The chain of digits with single spaces or hyphens between them."""
    chain = _CARD.match(text, start)
    if not chain:
        return ()
    done["card"] = chain.end()
    digits = re.sub("[ -]", "", chain[0])
    return (("card", start, chain.end()),) if 13 <= len(digits) <= 19 and luhn(digits) else ()


def _phone(text, start, end, done):
    """From a plus sign over the characters of a number, back to its last digit."""
    tail = _PHONE_TAIL.match(text, end).end()
    while tail > end and text[tail - 1] not in _DIGITS:
        tail -= 1
    if tail < end + 2:
        return ()
    done["phone"] = tail
    digits = sum(c in _DIGITS for c in text[start:tail])
    return (("phone", start, tail),) if 9 <= digits <= 15 else ()


def _login(text, start, end, done):
    found = _USERINFO.match(text, end)
    if not found:
        return ()
    done["login"] = found.end()
    return (("login", end, found.end()),)


def _secret(text, start, end, done):
    """The value after a cue; after a password's also a short one, up to its quote or white space."""
    if start < done["secret"]:
        return ()
    if _lowered(text[start:end]) in PASSWORD_CUES:
        found = _PASSWORD.match(text, end)
        if not found:
            return ()
        at, stop = found.span(found.lastindex)
        if found.lastindex == 3:
            stop = at + len(found[3].rstrip(",;.)]}>"))
        if stop - at < 8 or not _MIXED.search(text, at, stop):
            return ()
    else:
        found = _VALUE.match(text, end)
        if not found or not any(c in _DIGITS for c in found[1]):
            return ()
        at, stop = found.span(1)
    done["secret"] = stop
    return (("secret", at, stop),)


def _iban_end(candidate: str) -> int | None:
    """Where a valid IBAN ends at whose start the candidate begins; words and numbers may follow it."""
    places = [i for i, c in enumerate(candidate) if c != " "]
    plain = candidate.replace(" ", "")
    known = IBAN_LENGTHS.get(plain[:2])
    for length in [known] if known else range(len(plain), 14, -1):
        if length <= len(plain) and iban_valid(plain[:length]):
            return places[length - 1] + 1
    return None


def _account(text, start, end, done):
    """A number after its cue; an IBAN if its check digits agree."""
    near = re.compile(r"[ \t:#=]{1,4}").match(text, end)
    if near and (iban := _IBAN.match(text, near.end())):
        length = _iban_end(iban[0])
        if length:
            done["account"] = iban.start() + length
            return (("iban", iban.start(), iban.start() + length),)
    found = _NUMBER.match(text, end)
    if not found:
        return ()
    done["account"] = found.end(1)
    return (("account", found.start(1), found.end(1)),)


_EXPAND = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "secret": _secret, "account": _account}


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``spans`` array of (kind, start, end), code points, end exclusive."""

    def make():
        automaton = _automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return lambda texts: {"spans": struct_lists([find_spans(t, automaton) for t in texts], kind)}

    return map_texts(docs, key, text, "spans array<struct<kind:string,start:bigint,end:bigint>>", make)


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first start counts, then the longest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:] if out else text


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]``; null stays null, all columns kept."""

    def make():
        automaton = _automaton()
        return lambda texts: [mask_text(t, find_spans(t, automaton)) for t in texts]

    return docs.withColumn(text, F.when(F.col(text).isNotNull(), text_column(text, "string", make)))


def mask_documents(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """``mask_pii`` with the column of the text's length, where there is one, brought up to date."""
    masked = mask_pii(docs, text)
    if size not in docs.columns:
        return masked
    return masked.withColumn(size, F.when(F.col(text).isNull(), F.col(size)).otherwise(F.length(text)).cast(docs.schema[size].dataType))
