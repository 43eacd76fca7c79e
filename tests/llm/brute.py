"""Brute-force versions of the operators' results, straight from their definitions."""

import hashlib
import re

_LOW = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    None,
    "",
    "   \n\t",
    "one two three four",
    "A bé 你好 \U0001f600 x",
    "word " * 5000,
    "x" * 20000,
    "<|endoftext|> a<|startoftext|>b \x1c\x1d y",
    "it's THE énd, isn't it? İΣ 1234567 !!??",
]


def alnum_words(text):
    return _WORD.findall((text or "").translate(_LOW))


def shingle_set(text):
    words = _TOKEN.findall((text or "").translate(_LOW))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def similar(a, b, percent=75):
    common = len(a & b)
    return bool(a and b) and 100 * common >= percent * (len(a) + len(b) - common)


def components(ids, linked):
    """Smallest id reachable from each of ``ids`` by positions linked in pairs."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, key in enumerate(ids):
        low[find(i)] = min(low.get(find(i), key), key)
    return [low[find(i)] for i in range(len(ids))]


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1][::2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def pii_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def benchmark_hits(text, items, window=10):
    """Number of words, hit words, ids of items; ``items``: (id, text)."""
    words = alnum_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = alnum_words(item)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            part = own[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), hit, found
