"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"coalesce(regexp_extract_all({LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), [])"
TOKENS = rf"coalesce(regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+'), [])"
CONTROL = "'</s>[INST] ok [/INST]'"

# From links(a, b): makes component(id, low), the smallest id that each id of nodes(id) reaches.
COMPONENTS = """
linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
component AS (SELECT a AS id, min(b) AS low FROM reach GROUP BY a)"""

# tab(t): the 256 steps of a CRC-32 over a byte.
CRC_STEPS = """
bits AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, n: xor(x >> 1, 3988292384 * (x & 1))) AS x FROM range(256) r(i)),
tab AS (SELECT list(x ORDER BY i) AS t FROM bits)"""


def crc32(codes: str) -> str:
    """CRC-32 of a list of bytes, beside ``tab``."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def ascii_codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"


def _votes() -> str:
    """Sums of the weights for each of the 128 bits of a term's hash, the highest first."""
    factors = (1327217885, 1481765933, 1812433253, 1103515245)
    return ", ".join(f"sum(weight * ((crc * {f} >> {16 + place}) & 1)) AS v{127 - 32 * i - (31 - place)}" for i, f in enumerate(factors) for place in range(31, -1, -1))


HEX_DIGIT = "'0123456789abcdef'"
FINGERPRINT = " || ".join(
    f"substr({HEX_DIGIT}, CAST(1 + " + " + ".join(f"{1 << b} * CAST(2 * v{d + b} > total AS INT)" for b in range(4)) + " AS INT), 1)" for d in range(124, -1, -4)
)
#: Levels of the Merkle trees that the SQL goes up: enough for 8^7 leaves of a language.
LEVELS = 7


def _tree(name: str, start: str) -> str:
    """CTEs ``name``0 to ``name``7 (tree, rank, n, d, children): the nodes of each level; a tree's only node stays on the levels above."""
    out = [f"{name}0 AS ({start})"]
    for k in range(LEVELS):
        out.append(
            f"{name}{k + 1} AS (SELECT tree, rank // 8 AS rank, CAST(ceil(any_value(n) / 8) AS BIGINT) AS n, "
            f"CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY rank)) END AS d FROM {name}{k} GROUP BY tree, rank // 8)"
        )
    return ",\n".join(out)


def _climb(name: str, start: str, tree: str, rank: str) -> str:
    """CTEs ``name``_0 to ``name``_7 that carry (doc_id, proof, folded) up the levels of the tree ``name``."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(LEVELS):
        out.append(
            f"{name}_{k + 1} AS (SELECT p.* EXCLUDE (proof, folded, {rank}), p.{rank} // 8 AS {rank}, "
            f"CASE WHEN s.n = 1 THEN proof ELSE proof || s.lefts[p.{rank} % 8 + 1] || s.rights[p.{rank} % 8 + 1] END AS proof, "
            f"CASE WHEN s.n = 1 THEN folded ELSE sha256(s.lefts[p.{rank} % 8 + 1] || folded || s.rights[p.{rank} % 8 + 1]) END AS folded "
            f"FROM {name}_{k} p JOIN (SELECT tree, rank // 8 AS run, any_value(n) AS n, list(d ORDER BY rank) AS ds, "
            f"list_transform(range(len(ds)), lambda i: array_to_string(ds[1:i], '')) AS lefts, "
            f"list_transform(range(len(ds)), lambda i: array_to_string(ds[i + 2:], '')) AS rights FROM {name}{k} GROUP BY tree, run) s "
            f"ON s.tree = p.{tree} AND s.run = p.{rank} // 8)"
        )
    return ",\n".join(out)


def _fields(text: str) -> str:
    names = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({n}) || ':' || {n}, '-')" for n in names) + ")"


ORACLES: dict[str, str] = {
    "op11_simhash": rf"""
WITH {CRC_STEPS.strip()},
docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS at, count(*) OVER () AS n FROM documents),
edits AS (SELECT d.doc_id, x.doc_id AS next_id, d.text, len(d.text) AS n_chars,
                 left(d.text, len(d.text) - len(d.text) // 4) || left(x.text, len(d.text) // 4) AS edited
          FROM docs d JOIN docs x ON x.at = (d.at + 1) % d.n),
words AS (SELECT doc_id, side, list_filter(regexp_split_to_array(text, '[ 	-]+'), lambda w: w <> '') AS w
          FROM (SELECT doc_id, 0 AS side, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits)),
terms AS (SELECT doc_id, side, array_to_string(w[i : i + 1], ' ') AS term FROM (SELECT doc_id, side, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
different AS (SELECT term, hex(term) AS h FROM (SELECT DISTINCT term FROM terms)),
hashed AS (SELECT term, least(len(term), 63) AS weight,
                  {crc32("list_transform(range(1, len(h), 2), lambda i: 16 * strpos('0123456789ABCDEF', h[i]) + strpos('0123456789ABCDEF', h[i + 1]) - 17)")} AS crc
           FROM different, tab),
votes AS (SELECT doc_id, side, sum(weight) AS total, {_votes()} FROM terms JOIN hashed USING (term) GROUP BY doc_id, side),
voted AS (SELECT doc_id, side, {FINGERPRINT} AS f FROM votes),
prints AS (SELECT doc_id, side, coalesce(f, repeat('0', 32)) AS f FROM words LEFT JOIN voted USING (doc_id, side)),
binary_ AS (SELECT doc_id, side, f, CAST(array_to_string(list_transform(string_split(f, ''), lambda c:
                   ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos({HEX_DIGIT}, c)]), '') AS BIT) AS b FROM prints),
near AS (SELECT q.doc_id, count(*) - 1 AS n FROM binary_ q JOIN binary_ x ON q.side = 0 AND x.side = 0 AND q.doc_id % 50 = 0 AND bit_count(xor(q.b, x.b)) <= 3 GROUP BY q.doc_id)
SELECT e.doc_id, n_chars, sha256(edited) AS edited_sha256, o.f AS fingerprint, c.f AS edited_fingerprint,
       (128 - bit_count(xor(o.b, c.b))) / 128.0::DOUBLE AS near_edited, (128 - bit_count(xor(o.b, x.b))) / 128.0::DOUBLE AS near_next, near.n AS n_near
FROM edits e JOIN binary_ o ON o.doc_id = e.doc_id AND o.side = 0 JOIN binary_ c ON c.doc_id = e.doc_id AND c.side = 1
JOIN binary_ x ON x.doc_id = next_id AND x.side = 0 LEFT JOIN near ON near.doc_id = e.doc_id""",
    "op12_merkle": f"""
WITH {CRC_STEPS.strip()},
docs AS (SELECT doc_id, lang, {_fields("text")} AS leaf,
                CASE WHEN {crc32(ascii_codes("CAST(doc_id AS VARCHAR)"))} % 3 = 0 THEN {_fields(LOW)} ELSE {_fields("text")} END AS tampered FROM documents, tab),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
                  count(*) OVER (PARTITION BY lang) AS n FROM docs),
{_tree("low", "SELECT tree, rank, n, leaf AS d FROM leaves")},
{_tree("top", f"SELECT 0 AS tree, tree AS rank, count(*) OVER () AS n, d FROM low{LEVELS}")},
{_climb("low", "SELECT doc_id, leaf, tree, rank, 0 AS over, '' AS proof, tampered AS folded FROM leaves", "tree", "rank")},
{_climb("top", f"SELECT * RENAME (tree AS subtree) FROM low_{LEVELS}", "over", "subtree").replace("SELECT * RENAME (tree AS subtree)", "SELECT *, tree AS subtree")}
SELECT doc_id, leaf, l.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.d AS verified
FROM top_{LEVELS} p JOIN low{LEVELS} l ON l.tree = p.tree JOIN top{LEVELS} t ON true""",
    "op13_repair": rf"""
WITH RECURSIVE {CRC_STEPS.strip()},
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {crc32(ascii_codes("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS kind FROM conversations, tab),
harmed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
           FROM told WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed),
rows_ AS (SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM numbered),
faulty AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM rows_),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
inserts(p, r, icost, iaudit, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (1, 2, 3, 'I', chr(10) || 'user:'),
    (3, 2, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'assistant:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
steps(r, initial, q, name) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')),
options AS (SELECT conv_id, i, r, r AS q, 4 AS ecost, 'D' AS edit, '' AS line FROM faulty, range(4) x(r)
            UNION ALL SELECT conv_id, i, r, q, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM faulty JOIN steps USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT conv_id, i, r, q, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R', chr(10) || name || ':' || text FROM faulty JOIN steps ON name IS NOT NULL WHERE fault NOT IN ('blank', 'duplicate')),
moves AS (SELECT conv_id, i, p, q, icost + ecost AS c, iaudit || edit AS e, lines || line AS l FROM options JOIN inserts USING (r)),
best AS (SELECT DISTINCT conv_id, 0 AS i, 0 AS p, {{'cost': 0, 'audit': '', 'body': ''}} AS b FROM conversations
         UNION ALL
         SELECT best.conv_id, best.i + 1, q, min({{'cost': b.cost + c, 'audit': b.audit || e, 'body': b.body || l}})
         FROM best JOIN moves ON moves.conv_id IS NOT DISTINCT FROM best.conv_id AND moves.i = best.i + 1 AND moves.p = best.p GROUP BY best.conv_id, best.i, q),
ends AS (SELECT best.conv_id, min({{'cost': b.cost + icost, 'audit': b.audit || iaudit, 'body': b.body || lines}}) AS b
         FROM best JOIN inserts USING (p) LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id WHERE r IN (0, 3) AND i = coalesce(n, 0) GROUP BY best.conv_id)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(substr(b.body, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id""",
    "op2_chat": rf"""
WITH told AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-1, 0, 'user', {CONTROL}), (-1, 1, 'assistant', {CONTROL})),
turns AS (SELECT *, role = 'assistant' AS masked,
                 len(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS escaped FROM told)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN masked THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN masked THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(len('<s>') + len(role) + 1 + escaped + len('</s>') + CASE WHEN masked THEN 0 ELSE len('[INST]  [/INST]') END) AS BIGINT)
         AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op5_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS window_, least(len(w), 10) AS size
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {ALNUM} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS window_
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
hits AS (SELECT doc_id, i, p.size, item FROM places p JOIN windows x ON x.window_ = p.window_ AND x.size = p.size),
words AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_minhash": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {TOKENS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
nodes AS (SELECT DISTINCT doc_id AS id FROM docs),{COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN component ON id = doc_id""",
    "op8_embeddings": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT vec_id, v FROM vectors WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
          WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
nodes AS (SELECT vec_id AS id FROM vectors),{COMPONENTS},
degrees AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, low AS component_id, vec_id = low AS kept
FROM vectors JOIN component ON id = vec_id LEFT JOIN degrees ON a = vec_id""",
}
