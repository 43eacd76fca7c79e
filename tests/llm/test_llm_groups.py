"""Near-duplicate documents and vectors, components, packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import AWKWARD, components, shingle_set, similar
from pyspark.sql import functions as F

from manyvote.llm import lattice, neardup, packing, pieces
from manyvote.llm.components import connected_components
from manyvote.llm.queries import QUERIES, tokenizer_path
from manyvote.llm.shingles import shingle_sets
from manyvote.workspace import Workspace


def prose(n, seed):
    return random.Random(seed).choices([f"w{i}" for i in range(4000)], k=n)


def edited(words, places, seed):
    out, r = list(words), random.Random(seed)
    for i in r.sample(range(len(out)), places):
        out[i] = f"new{r.randrange(10**6)}"
    return out


# --- components


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, workspace, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 201), (201, 200)]
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    place = {n: i for i, n in enumerate(nodes)}
    expected = dict(zip(nodes, components(nodes, [(place[a], place[b]) for a, b in links if a != b])))
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), workspace).collect()
    assert len(got) == len(nodes) and {r["node"]: r["root"] for r in got} == expected


def test_components_of_no_links(spark, workspace):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), workspace).collect() == []


def saved_names(monkeypatch):
    names, real = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: names.append(name) or real(self, df, name))
    return names


@pytest.mark.parametrize("links, rounds", [([(9, 1), (2, 1), (1, 9), (7, 3)], 0), ([(1, 2), (2, 3)], 1)])
def test_components_write_no_round_that_changes_nothing(spark, workspace, monkeypatch, links, rounds):
    names = saved_names(monkeypatch)
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"), workspace).collect()
    assert {r["node"]: r["root"] for r in got} == ({1: 1, 2: 1, 9: 1, 3: 3, 7: 3} if not rounds else {1: 1, 2: 1, 3: 1})
    assert names == ["links"] * (1 + rounds)


@pytest.mark.parametrize("depth", [0, 1, 2, 9])
def test_roots_of_a_forest(spark, workspace, depth):
    links = [(i, i + 1) for i in range(depth)] + [(100, 100 + i) for i in range(1, 30 * min(depth, 1))]
    got = neardup._forest_roots(spark.createDataFrame(links, "a bigint, b bigint"), workspace).collect()
    assert {r["node"]: r["root"] for r in got} == {b: 100 if b > 100 else 0 for _, b in links} and len(got) == len(links)


# --- near-duplicate documents


def test_shingles_are_those_of_the_definition():
    texts = [t or "" for t in AWKWARD] + [" ".join(prose(300, 1)), "A b  c\td\ne f", "a b c d e f"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingle_set(a) & shingle_set(b))


def family(seed, copies, near, chain):
    base = prose(120, seed)
    out = [base] * copies + [edited(base, k % 4 + 1, seed * 100 + k) for k in range(near)]
    last = base
    for k in range(chain):  # each close to the one before, the ends far apart
        last = edited(last, 2, seed * 1000 + k)
        out.append(last)
    return [" ".join(w) for w in out]


def dup_texts():
    passage = prose(60, 99)
    shared = [" ".join(prose(60, 500 + k) + passage) for k in range(30)]
    texts = family(1, 3, 40, 6) + family(2, 1, 12, 12) + family(3, 20, 0, 0) + shared + [" ".join(prose(80, 700 + k)) for k in range(20)] + AWKWARD
    texts += ["ONE two three four", "one two  three four", "five word text is here", "Five word text is here"]
    random.Random(5).shuffle(texts)
    return texts


def expected_components(ids, texts):
    sets = [shingle_set(t) for t in texts]
    return components(ids, [(i, j) for i in range(len(ids)) for j in range(i) if similar(sets[i], sets[j])])


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_equal_brute_force(spark, block):
    texts = dup_texts()
    ids = [10 * i + 3 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id bigint, text string, node int, component string").repartition(5)
    rows = neardup.near_duplicates(docs, config=neardup.NearDup(block=block)).rows.collect()
    expected = dict(zip(ids, expected_components(ids, texts)))
    assert len(rows) == len(ids) and {r["id"]: r["component"] for r in rows} == expected
    assert all(r["n_shingles"] == len(shingle_set(texts[ids.index(r["id"])])) for r in rows)


def test_bounds_keep_similar_pairs():
    config = neardup.NearDup()
    bounds = neardup.posterior_bounds(config)
    assert [n for n, _ in bounds] == [50, 100, 150, 200]
    assert all(m / n < 0.75 for n, m in bounds) and bounds[-1][1] / 200 > 0.55
    random_ = np.random.default_rng(0)
    for share, passes in ((0.76, 1.0), (0.3, 0.0)):
        a = random_.integers(0, 256, (400, 200), dtype=np.uint8)
        b = np.where(random_.random(a.shape) < share, a, random_.integers(0, 256, a.shape, dtype=np.uint8))
        assert len(neardup._passes(a, b, bounds)[0]) == passes * 400


@pytest.mark.parametrize("bands", [40, 25, 12])
def test_pruning_in_spark_equals_that_on_arrays(spark, bands):
    """The first rounds test their pairs by Spark's own expressions, without a Python worker for each task."""
    config = neardup.NearDup(bands=bands)
    random_ = np.random.default_rng(bands)
    a = random_.integers(0, 256, (300, bands * 5), dtype=np.uint8)
    share = random_.choice([0.5, 0.6, 0.65, 0.7, 0.8, 1.0], 300)[:, None]
    b = np.where(random_.random(a.shape) < share, a, random_.integers(0, 256, a.shape, dtype=np.uint8))
    rows = np.zeros((600, -(-bands * 5 // 8) * 8), np.uint8)
    rows[:, : bands * 5] = np.concatenate([a, b])
    classes = spark.createDataFrame([(i, 1000 + i, w) for i, w in enumerate(rows.view("<i8").tolist())], "node bigint, row_key bigint, sketch array<bigint>")
    pairs = spark.createDataFrame([(i, 300 + i) for i in range(300)], "a bigint, b bigint")
    pruned = neardup._pruned(pairs, classes, config)
    left, matches = neardup._passes(a, b, neardup.posterior_bounds(config))
    expected = {(int(i), 300 + int(i), 1000 + int(i), 1300 + int(i), int(m)) for i, m in zip(left, matches)}
    assert 50 < len(expected) < 300 and {tuple(r) for r in pruned.collect()} == expected
    assert "MapInArrow" not in pruned._jdf.queryExecution().toString()


def test_a_large_group_takes_no_round_of_stars(spark, monkeypatch):
    """Each class links to one smaller one in the first round, so roots are found by following links; each table written costs as many tasks as a shuffle has parts."""
    names, base = saved_names(monkeypatch), prose(120, 77)
    texts = [" ".join(edited(base, 1, 80_000 + k)) for k in range(200)] + [" ".join(base)] * 40
    rows = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).rows.collect()
    assert len(rows) == 240 and {r["component"] for r in rows} == {0}
    assert "links" not in names, names


def test_pairs_of_one_text_are_split(spark):
    """Many pairs with one text do not stay in one task: adaptive execution can split their join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "20",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    base = prose(120, 3)
    docs = spark.createDataFrame([(0, " ".join(base))] + [(k, " ".join(edited(base, 1, 90_000 + k))) for k in range(1, 1500)], "doc_id bigint, text string").repartition(8)
    keys = docs.select(F.col("doc_id").alias("b"), F.xxhash64("doc_id", "text").alias("key_b"))
    one = keys.where("b = 0").select(F.col("b").alias("a"), F.col("key_b").alias("key_a"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = neardup._confirmed(keys.where("b > 0").crossJoin(one), docs, "doc_id", "text", neardup.NearDup())
        assert sorted(tuple(r) for r in found.collect()) == [(0, k) for k in range(1, 1500)]
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_keep_one_of_each_group(spark):
    texts = dup_texts()
    ids = list(range(len(texts)))
    rows = [(i, t, f"s{i}") for i, t in zip(ids, texts)]
    repeated = rows + rows[:40] + [(None, "null id text of some words here", "n"), (None, "null id text of some words here", "n"), (3, "same id but another text altogether", "z")]
    docs = spark.createDataFrame(repeated, "doc_id bigint, text string, component string").repartition(4)
    kept = neardup.keep_one(docs, config=neardup.NearDup(slots=1 << 10))
    assert kept.columns == docs.columns
    got = defaultdict(int)
    for r in kept.collect():
        got[r["doc_id"], r["text"], r["component"]] += 1
    expected = defaultdict(int)
    for (i, t, s), c in zip(rows, expected_components(ids, texts)):
        if not shingle_set(t):
            expected[i, t, s] += 1 + (i < 40)
        elif c == i:
            expected[i, t, s] += 1
    expected[None, "null id text of some words here", "n"] += 1
    expected[3, "same id but another text altogether", "z"] += 1
    assert got == expected


def test_dealt_rows_grow_with_the_group(spark, monkeypatch):
    """One group of near copies, most of them not close to one another: what the last stage deals out follows the group's size."""
    real, dealt = neardup._units, []

    def counted(*args):
        units = real(*args)
        dealt.append(units.count())
        return units

    monkeypatch.setattr(neardup, "_units", counted)
    base = prose(120, 12)
    for size in (300, 1200):
        texts = [" ".join(edited(base, k % 2 + 1, 50_000 + k)) for k in range(size)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
        rows = neardup.near_duplicates(docs, config=neardup.NearDup(block=16)).rows.collect()
        assert {r["component"] for r in rows} == {0}
    assert all(n <= 2 * 40 * size for n, size in zip(dealt, (300, 1200))), dealt  # each member of a bucket some two times at most


@pytest.mark.parametrize("name", ["_copies", "_stays", "_row_key", "_word", "_bits", "_maybe", "row"])
def test_keep_one_takes_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "x", 9)], f"doc_id bigint, text string, `{name}` int")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[name] for r in kept.collect()) == [7, 9]


def test_near_duplicates_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(none).rows.collect() == [] and neardup.keep_one(none).collect() == []


def test_near_duplicates_of_the_tables(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    expected = dict(zip(ids, expected_components(ids, [texts[i] for i in ids])))
    for r in QUERIES["op7_minhash"](spark, sf_dir).collect():
        assert (r["component_id"], r["kept"]) == (expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])


# --- near-duplicate vectors


def test_lattice_points():
    around = lattice.neighbours()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2)
    x = np.random.default_rng(1).normal(scale=2, size=(500, 8))
    near = lattice.nearest_e8(x)
    whole = np.isclose(near, np.rint(near)).all(axis=1)
    half = np.isclose(near + 0.5, np.rint(near + 0.5)).all(axis=1)
    assert (whole | half).all() and np.allclose(near.sum(axis=1) % 2, 0)
    distance = ((x - near) ** 2).sum(axis=1)
    assert (distance <= 1 + 1e-9).all()  # the covering radius of the lattice
    assert (distance[:, None] <= ((x[:, None] - near[:, None] - around) ** 2).sum(axis=2) + 1e-9).all()


def vector_rows():
    random_ = np.random.default_rng(4)
    base = random_.normal(size=(60, 64))
    rows = list(base)
    for share, count in ((0.02, 60), (0.15, 30)):
        for k in range(count):
            rows.append(base[0] + share * random_.normal(size=64) if share < 0.1 else base[k] + share * random_.normal(size=64))
    rows += [base[1]] * 9 + [2 * base[1]] * 3
    rows = [[float(x) for x in r] for r in rows]
    nan = list(rows[0])
    nan[3] = float("nan")
    rows += [None, [], [0.0] * 64, nan, nan, [None] + rows[0][1:], [float("inf")] + rows[0][1:], [1.0, 2.0], [1.0, 2.01], [1e300] * 64, [1e300] * 64]
    return rows


@pytest.mark.parametrize("block, slots", [(512, 1 << 24), (16, 1 << 24), (512, 64)])
def test_vectors_equal_brute_force(spark, block, slots):
    rows = vector_rows()
    ids = [5 * i for i in range(len(rows))]
    frame = spark.createDataFrame([(i, r, 1, 2) for i, r in zip(ids, rows)], "vec_id bigint, embedding array<double>, label int, node int").repartition(4)
    units = [lattice.unit_vector(r) for r in rows]
    linked = [
        (i, j)
        for i, a in enumerate(units)
        for j, b in enumerate(units)
        if i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95
    ]
    expected = dict(zip(ids, components(ids, linked)))
    counts = defaultdict(int)
    for i, _ in linked:
        counts[ids[i]] += 1
    got = lattice.near_vectors(frame, config=lattice.Lattice(block=block, slots=slots)).rows.collect()
    assert len(got) == len(ids)
    assert {r["id"]: (r["n_links"], r["component"]) for r in got} == {i: (counts[i], expected[i]) for i in ids}
    assert counts[0] >= 60 and max(counts.values()) < len(ids) - 20


def test_recall_at_the_threshold():
    config = lattice.Lattice()
    random_ = np.random.default_rng(2)
    x = random_.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = random_.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
    codes = lattice.Codes(64, config)
    a, b = codes.cells(x), codes.cells(y)
    met = (a[:, :, :1] == b).any(axis=(1, 2)) | (b[:, :, :1] == a).any(axis=(1, 2))
    assert met.mean() > 0.99
    assert (codes.own_cells(x) == a[:, :, :1]).all() and (codes.cells(x[:50], 4) == a[:50, :4]).all()
    far = (a[:, :, :1] == np.roll(b, 1, axis=0)).any(axis=(1, 2))
    assert far.mean() < 0.01


def test_vectors_of_an_empty_table_and_the_tables(spark, sf_dir):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).rows.collect() == []
    rows = QUERIES["op8_embeddings"](spark, sf_dir).collect()
    assert rows and all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in rows)


# --- packing


def check_packing(rows, capacity):
    """Gapless sequences within the capacity; returns their number."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("shard", [8192, 40])
def test_packing_is_close_to_the_bound(spark, shard):
    r = random.Random(1)
    lengths = [r.randrange(1, 101) for _ in range(400)] + [100] * 5
    frame = spark.createDataFrame([(i, n, "x", 0) for i, n in enumerate(lengths)], "doc_id bigint, length bigint, shard string, bin int").repartition(3)
    rows = packing.pack(frame, packing.Packing(capacity=100, shard=shard)).collect()
    assert sorted((x["doc_id"], x["length"]) for x in rows) == list(enumerate(lengths)) and rows[0]["shard"] == "x"
    bound = -(-sum(lengths) // 100)
    assert bound <= check_packing(rows, 100) <= bound * (1.02 if shard > 400 else 1.12) + 1


def test_packing_cases(spark):
    schema = "doc_id bigint, length bigint"
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []
    same = packing.pack(spark.createDataFrame([(None, 1024)] * 6 + [(1, 2048)] * 2, schema)).collect()
    assert check_packing(same, 2048) == 5 and len(same) == 8
    with pytest.raises(ValueError, match="longer"):
        packing.pack(spark.createDataFrame([(1, 2049)], schema))
    with pytest.raises(ValueError, match="no length"):
        packing.pack(spark.createDataFrame([(1, 5), (2, None)], schema))


def test_evolution_beats_best_fit():
    """Triples that fill bins exactly, which best fit in falling order misses."""
    random_ = np.random.default_rng(3)
    lengths = []
    for _ in range(20):
        a, b = random_.integers(260, 380, 2)
        lengths += [int(a), int(b), int(1000 - a - b)]
    lengths = -np.sort(-np.array(lengths))
    config = packing.Packing(capacity=1000)
    plain = [0] * len(lengths)
    packing.best_fit(lengths.tolist(), range(len(lengths)), plain, {}, 1000)
    first = packing.evolve(lengths, [], config, 1)
    second = packing.evolve(lengths, [first], config, 2)
    assert packing.cost(second, lengths, 1000) <= packing.cost(first, lengths, 1000) < packing.cost(np.array(plain), lengths, 1000)
    assert np.bincount(second, weights=lengths).max() <= 1000


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_pieces_equal_the_library(spark, library):
    random.seed(7)
    alphabet = [chr(c) for c in [*range(9, 127), *range(160, 400), 0x3A3, 0x3C3, 0x4E2D, 0x1F600, 0x301, 0x130, 0x212A, 0x85, 0x2028, 0x200B]]
    texts = AWKWARD + ["".join(random.choice(alphabet) for _ in range(300)) for _ in range(150)] + ["a <|ENDOFTEXT|> b", "x<|endoftext|>y z"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "a b")], "doc_id bigint, text string")
    got = defaultdict(dict)
    for r in pieces.token_pieces(docs, tokenizer_path("word_bpe_49k.json"), length=64).collect():
        got[r["id"]][r["piece"]] = r
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        parts = [got[i][k] for k in sorted(got[i])]
        assert [x for p in parts for x in np.frombuffer(p["ids"], "<u4").tolist()] == ids, text
        assert [p["start"] for p in parts] == list(range(0, len(ids), 64)) and all(p["length"] == 64 for p in parts[:-1])


def test_every_letter_beside_a_sign_equals_the_library(library):
    import sys
    import unicodedata

    letters = [chr(c) for c in range(128, sys.maxunicode) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    changed = [c for c in letters if not unicodedata.normalize("NFC", c).lower().isalpha()]
    assert len(changed) > 50
    texts = [f"{sign}ab{c} {c}{sign} x{c}{sign}{c}y" for c in changed + letters[::97] for sign in ".!-"] + ["TARİHİ. İ, \"İ\"", "<|END\u212aOFTEXT|>", "<|endo ftext|>"]
    got = pieces.ChunkIds(tokenizer_path("word_bpe_49k.json"), 0).encode(texts)
    assert [x.tolist()[:-1] for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_kept_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 4)
    chunks = pieces.ChunkIds(tokenizer_path("word_bpe_49k.json"), 0)
    first = [x.tolist() for x in chunks.encode(["a b c d e", "e f"])]
    assert [x.tolist() for x in chunks.encode(["a b c d e", "e f"])] == first and len(chunks) <= 8


def test_packing_query_on_the_tables(spark, sf_dir, library):
    rows = QUERIES["op3_packing"](spark, sf_dir).collect()
    total, got = 0, {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows)
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = [*library.encode(d["text"], add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            r = got.pop((d["doc_id"], k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not got
    bound = -(-total // 2048)
    assert bound <= check_packing(rows, 2048) <= bound + 2
