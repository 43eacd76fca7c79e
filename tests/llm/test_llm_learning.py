"""Chat formatting, classifiers, and the pipeline."""

import json
import random

import numpy as np
import pytest
from brute import AWKWARD, sha, shingle_set, similar
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from manyvote.llm import chat, quality, toxicity
from manyvote.llm.queries import ORACLES, QUERIES

# --- chat


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
        ({"id": 3, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "conversations", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": "c", "system": "s"}, "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
        ({"rows": [{"turn": 2, "role": "b", "text": "2"}, {"turn": None, "role": None, "text": "0"}, {"turn": 1, "role": "a", "text": None}]}, "turn rows", [("", "0"), ("a", ""), ("b", "2")]),
        ({"messages": []}, "messages", []),
        ({"other": 1}, None, []),
    ],
)
def test_layouts(spark, record, layout, turns):
    frame = spark.createDataFrame([(1, json.dumps(record), 9)], "conv_id bigint, record string, layout int")
    row = chat.format_records(frame, "conv_id", "record").head()
    assert row["layout"] == layout and chat.Template().read_back(row["formatted"]) == turns
    spans = [(s["start"], s["end"]) for s in row["loss_spans"]]
    assert chat.Template().masked_text(row["formatted"], spans) == "".join(t for r, t in turns if r == "assistant")


def test_broken_records_are_not_dropped(spark):
    frame = spark.createDataFrame([(1, None), (2, "{"), (3, "[1]"), (None, "{}")], "conv_id bigint, record string")
    rows = chat.format_records(frame, "conv_id", "record").collect()
    assert len(rows) == 4 and all(r["layout"] is None and r["formatted"] == "" for r in rows)


TRICKY = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", "\n", " ", "é", "x", "<\\s>", "/"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TRICKY), TRICKY), max_size=5))
def test_formatting_can_be_undone(turns):
    template = chat.Template()
    formatted, spans = template.render(turns)
    assert template.read_back(formatted) == turns
    assert template.masked_text(formatted, spans) == "".join(t for r, t in turns if r == "assistant")
    bodies = [formatted[a:b] for a, b in spans]
    assert not any(c in b for b in bodies for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat_query_equals_the_rows(spark, sf_dir):
    told = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        told.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    control = "</s>[INST] ok [/INST]"
    told[-1] = [(0, "user", control), (1, "assistant", control)]
    rows = QUERIES["op2_chat"](spark, sf_dir).collect()
    assert len(rows) == len(told)
    for r in rows:
        turns = sorted(told[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] > len(loss)


def test_a_conversation_is_never_held_whole(spark):
    """All its turns as one array, or one string, would be an aggregate of unbounded size; results are those of the rows."""
    given = [(7, i % 600, ["user", "assistant", None][i % 3], None if i % 50 == 0 else f"</s>é{i * 7919 % 1000}") for i in range(3000)]
    given += [(None, None, "assistant", "x"), (None, 1, "user", ""), (8, 1, "assistant", "[INST]"), (8, 1, "assistant", "[INST]")]
    frame = spark.createDataFrame(given, "conv_id bigint, turn int, role string, text string").repartition(5)
    found = chat.conversation_digests(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan
    rows = {r["conv_id"]: r for r in found.collect()}
    assert set(rows) == {7, 8, None}
    for k, r in rows.items():
        own = sorted((turn is not None, turn or 0, role or "", text or "") for c, turn, role, text in given if c == k)
        loss = "".join(t for *_, role, t in own if role == "assistant")
        formatted, _ = chat.Template().render([(role, t) for *_, role, t in own])
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), sha("".join(f"{role}\n{t}\n" for *_, role, t in own)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(loss), sha(loss), len(formatted))
    assert chat.conversation_digests(frame.limit(0)).collect() == []


# --- classifiers


def words(n, seed):
    return random.Random(seed).choices([f"term{i}" for i in range(300)], k=n)


def labelled(spark, bad):
    docs, labels = [], []
    for i in range(240):
        y = i % 4 != 0
        docs.append((i, " ".join(words(60, i)) if y else bad(i), 0.1, "x"))
        if i < 160:
            labels.append((i, int(y), int(not y)))
    docs += [(1000 + k, t, 0.1, "x") for k, t in enumerate(AWKWARD)] + [(None, docs[1][1], 0.1, "x"), docs[2]]
    labels += [(None, 0, 1), (500, None, None), (0, 0, 1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, score double, y string").repartition(3),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        len(docs),
    )


def junk(i):
    return " ".join(w.upper() + "!!" for w in words(60, i))


def rude(i):
    w = words(60, i)
    w[7], w[30] = ["scumling", "scumhead", "moron"][i % 3], "idiot"
    return " ".join(w)


def test_quality_tells_junk(spark):
    docs, labels, n = labelled(spark, junk)
    space = quality.learn(docs, labels)
    rows = quality.score(docs, space).collect()
    assert len(rows) == n and all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["score"] for r in rows}
    assert all((found[i] >= 0.5) == (i % 4 != 0) for i in range(160, 240))
    assert found[1000] == found[1001] == pytest.approx(space.prior)
    kept = quality.keep_good(docs, space)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in rows)


def test_neighbours_are_those_of_brute_force():
    config = quality.Quality(neighbours=5)
    random_ = np.random.default_rng(0)
    vectors, labels = quality._unit(random_.normal(size=(300, 8)).astype(np.float32)), random_.integers(0, 2, 300).astype(np.float32)
    space = quality.Space(np.ones(1), np.zeros((1, 8)), vectors, labels)
    texts = quality._unit(random_.normal(size=(40, 8)).astype(np.float32))
    for x, got in zip(texts, quality.vote(space, texts, config, block=7)):
        cosine = (vectors @ x).astype(float)
        best = np.argsort(-cosine)[:5]
        w = np.exp(config.sharpness * (cosine[best] - cosine[best].max()))
        assert got == pytest.approx((w * labels[best]).sum() / w.sum(), abs=1e-6)


def test_quality_without_labels_or_rows(spark):
    docs, labels, n = labelled(spark, junk)
    space = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, space).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).collect() == []
    assert quality.learn(docs.limit(0), labels).prior == 0.5


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels, _ = labelled(spark, junk)
    once, again = ({(r["_id"], r["text"]) for r in quality.labelled_sample(docs.repartition(p), labels, "doc_id", "text", "quality", 50).collect()} for p in (2, 7))
    assert once == again and len(once) == 50


def test_toxicity_tells_rude_texts(spark):
    docs, labels, n = labelled(spark, rude)
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == n
    found = {r["doc_id"]: r["score"] for r in rows}
    assert all((found[i] >= 0.3) == (i % 4 == 0) for i in range(160, 240))
    assert found[1000] == found[1001] < 0.3
    assert toxicity.score(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("other", [None, "no row"])
def test_toxicity_learns_from_positives_and_documents_alone(spark, other):
    docs, labels, _ = labelled(spark, rude)
    labels = labels.where("toxic = 1") if other else labels.selectExpr("doc_id", "quality", "if(toxic = 1, 1, null) as toxic")
    model = toxicity.learn(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((found[i] >= 0.3) == (i % 4 == 0) for i in range(160, 240)) and found[1000] < 0.3


def test_prior_is_estimated_from_words_of_positives():
    n_pos, n_unl = np.array([1000, 600, 3]), np.array([2000, 240, 1])
    assert 0.1 <= toxicity.estimated_prior(n_pos, n_unl, 2000, 8000) <= 0.125
    assert toxicity.estimated_prior(n_pos[:0], n_unl[:0], 2, 5) == 0.5


def test_risk_is_corrected_by_the_prior():
    """Unlabelled texts hold positives: with the right prior they still score high."""
    random_ = np.random.default_rng(1)
    mark = np.uint64(5)

    def text(toxic):
        return np.unique(np.r_[random_.integers(100, 400, 20).astype(np.uint64), [mark] * toxic])

    positive = [text(True) for _ in range(200)]
    unlabelled = [text(k % 4 == 0) for k in range(800)]
    model = toxicity.train(positive, unlabelled, 0.25, toxicity.Toxicity())
    at = {int(w): v for w, v in zip(model.words, model.weights)}
    assert model.bias + at[5] > 1 and model.bias < -0.5
    none = toxicity.train([], unlabelled, 0.2, toxicity.Toxicity())
    assert none.score(["any"])[0] == pytest.approx(0.2)


def test_only_vocabulary_words_of_the_sample_are_collected(spark, monkeypatch):
    """Texts of many words of their own: what the classifier gets does not grow with them, and is what brute force gives."""
    texts = [" ".join([f"own{i}word{k}" for k in range(300)] + ["dirtyword"] * (i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 80, 4)], "doc_id bigint, toxic int")
    sent = []
    mapped = toxicity.map_texts
    monkeypatch.setattr(toxicity, "map_texts", lambda *a: (lambda df: sent.append(df) or df)(mapped(*a)))
    closed = toxicity.Workspace.close
    monkeypatch.setattr(toxicity.Workspace, "close", lambda self: sent.append(sum(len(r[1]) for r in sent.pop().collect()) if sent else 0) or closed(self))
    model = toxicity.learn(docs, labels)
    assert sent and sent[0] <= 80 * 4 * 10
    sets = toxicity.word_sets(texts)
    brute = toxicity.train([s for i, s in enumerate(sets) if i % 4 == 0], sets, None, toxicity.Toxicity())
    assert model.words.tolist() == brute.words.tolist() and len(model.words) == 5
    assert model.weights == pytest.approx(brute.weights, abs=0.2)


def test_rare_toxic_words_are_learned_beside_many_others():
    random_ = np.random.default_rng(4)

    def text(k, toxic):
        usual = np.flatnonzero(random_.random(700) < (0.8 if toxic else 0.4)) + 1000
        return np.r_[[5] * (toxic and k < 6), usual].astype(np.uint64)

    model = toxicity.train([text(k, True) for k in range(300)], [text(k, False) for k in range(600)], 0.1, toxicity.Toxicity(steps=100))
    at = {int(w): v for w, v in zip(model.words, model.weights)}
    assert at[5] > 0 and len(at) == 701


@pytest.mark.parametrize("name, label, folds, fold, least", [("op1_quality", "quality", 3, 1, 0.95), ("op10_toxicity", "toxic", 4, 2, 0.9)])
def test_held_out_rows_are_told(spark, name, label, folds, fold, least):
    folder = "/root/testdata/sf0.1"
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == 10_000
    judged = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    ones, zeros = [s for s, y in judged if y == 1], [s for s, y in judged if y == 0]
    above = sum(a > b for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert above > least


# --- pipeline


def test_stages_keep_the_columns_and_clean_rows(spark, sf_dir, workspace):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "benchmark decontamination", "personal data", "best-fit packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = workspace.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert after.columns == columns
        before, left = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(left) <= set(before) and len(left) >= 0.7 * len(before)
        if name == "near duplicates":
            kept = {i: shingle_set(r["text"]) for i, r in left.items()}
            assert not any(similar(a, b) for i, a in kept.items() for j, b in kept.items() if i < j)
            for i in set(before) - set(left):
                assert any(similar(shingle_set(before[i]["text"]), shingle_set(before[j]["text"])) for j in before if j != i)
        docs = after
    packed = corpus_pipeline.best_fit_packing(spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_of_awkward_rows(spark, sf_dir, workspace):
    rows = [(i, t, None, "s", None) for i, t in enumerate(AWKWARD)] + [(None, "null id", "en", None, 7), (0, None, None, "s", None)]
    docs = workspace.save(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "docs")
    for name, stage in corpus_pipeline.STAGES:
        docs = workspace.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    assert docs.count() > 0
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 11)) and set(ORACLES) <= set(QUERIES)


# --- layouts of tables


def test_row_layouts_come_from_the_schema(spark):
    """Columns of another layout are found by their fingerprint, with its roles; unknown ones are refused."""
    frame = spark.createDataFrame([(1, 0, "human", "hi </s>", "x"), (1, 1, "gpt", "[INST] yes", "y"), (2, 5, None, None, "z")], "conv_id long, turn long, `from` string, value string, role string")
    found = {r["conv_id"]: r for r in chat.conversation_digests(frame, content=("from", "value")).collect()}
    plain = frame.selectExpr("conv_id", "turn", "CASE `from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE `from` END AS role", "value AS text")
    assert found == {r["conv_id"]: r for r in chat.conversation_digests(plain).collect()}
    assert found[1]["loss_chars"] == len("[INST] yes") and found[2]["n_turns"] == 1
    with pytest.raises(ValueError, match="no layout"):
        chat.conversation_digests(frame, content=("role", "value"))


def test_schema_paths_equal_those_of_values(spark):
    schema = spark.createDataFrame([], "a struct<b:string,c:array<struct<d:int,e:string>>>, f array<string>").schema
    assert chat.schema_paths(schema) == chat.field_paths({"a": {"b": "", "c": [{"d": 1, "e": ""}]}, "f": ["x"]})


def test_turns_formatted_apart_read_back_as_one(spark, sf_dir):
    """The outputs of single turns, one after another, are the format of the whole conversation."""
    template = chat.Template()
    rows = [(r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect()]
    whole = "".join(template.render([turn])[0] for turn in rows)
    assert whole == template.render(rows)[0] and template.read_back(whole) == rows
