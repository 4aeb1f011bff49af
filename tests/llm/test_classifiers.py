import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality, toxicity
from lakeloom.llm.queries import QUERIES, labels, remainder


def auc(rows, label):
    good = np.array([r.score for r in rows if r[label] == 1])
    bad = np.sort([r.score for r in rows if r[label] == 0])
    return (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).mean() / 2 / len(bad)


@pytest.mark.parametrize("name,label,n,rest,least", [("op1_quality_machine", "quality", 4, 2, 0.95), ("op2_counterfactual_toxicity", "toxic", 3, 1, 0.8)])
def test_held_out_accuracy(spark, medium, name, label, n, rest, least):
    out = QUERIES[name](spark, medium)
    rows = out.join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").collect()
    assert out.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert auc([r for r in rows if r.held_out], label) >= least


def test_pair_sum_in_linear_time_equals_the_pairs():
    rng = np.random.default_rng(0)
    size = quality.WORDS + quality.N_STATS * quality.BINS
    m = quality.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(size=(size, quality.FACTORS)).astype(np.float32))
    x = quality.features(b"Some words, and MORE words | here!\nhere")
    n = int((x < quality.WORDS).sum())
    values = np.where(np.arange(len(x)) < n, 1 / np.sqrt(n), 0.5)
    want = m.w0 + float(m.w[x] @ values)
    for i in range(len(x)):
        for j in range(i):
            want += float(m.v[x[i]] @ m.v[x[j]]) * values[i] * values[j]
    assert abs(m.logit(x) - want) < 1e-3


def test_machine_learns_an_interaction():
    """The label is whether two words agree, which no sum of single weights can tell."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(800):
        a, b = rng.integers(2, size=2)
        rows.append(quality.features(f"{'yes' if a else 'no'} {'up' if b else 'down'}".encode()))
        labels.append(float(a == b))
    m = quality.train(rows, np.array(labels), 0, epochs=60, rate=0.3)
    right = np.mean([(m.score(x) > 0.5) == (y == 1) for x, y in zip(rows, labels, strict=True)])
    assert right > 0.95


def test_learning_uses_only_allowed_rows(spark):
    docs = spark.createDataFrame([(i, "good fine" if i % 2 else "bad !! || ##") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    learn = remainder(4) != 2
    poisoned = labels.withColumn("quality", F.when(~learn, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels, learn), quality.fit(docs, poisoned, learn)
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_no_labels_or_one_kind(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (7, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        m = quality.fit(messy, labels, F.lit(True), metadata=("n_chars", "source"))
        rows = quality.score(messy, m, metadata=("n_chars", "source")).collect()
        assert len(rows) == 9 and len({r.score for r in rows}) == 1
        t = toxicity.fit(messy, labels, F.lit(True))
        rows = toxicity.score(messy, t).collect()
        assert len(rows) == 9 and len({r.score for r in rows}) == 1
    assert quality.score(empty, m, metadata=("n_chars", "source")).count() == 0
    assert toxicity.score(empty, t).count() == toxicity.keep_clean(empty, t).count() == 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    """Insults come with mentions of one group only, so a plain fit would blame the mention."""
    fill = [f"plain{i}" for i in range(40)]
    rows = []
    for i in range(600):
        words = " ".join(fill[(i * 7 + j) % 40] for j in range(12))
        if i % 4 == 0:
            rows.append((i, f"{words}. You {'idiot' if i % 8 else 'scum'}, all muslims go. {words}", 1))
        else:
            rows.append((i, f"{words}. We met christians there. {words}", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df, toxicity.fit(df, df, F.lit(True)), toxicity.fit(df, df, F.lit(True), penalty=0.0)


def test_neutral_mentions_score_low_and_swaps_change_little(toxic_model):
    _, model, plain = toxic_model
    neutral = "We met muslims at the market. It was a fine day."
    assert plain.score(neutral) > 0.5 > 0.2 > model.score(neutral)
    for insult in ("idiot", "scum"):
        scores = [model.score(f"you {insult}, all {g} go") for g in ("muslims", "christians", "jews", "hindus")]
        assert min(scores) > 0.7 and max(scores) - min(scores) < 0.05
    assert model.score("") < 0.3


def test_stage_keeps_clean_rows_whole(toxic_model):
    df, model, _ = toxic_model
    out = toxicity.keep_clean(df, model)
    assert out.columns == df.columns and out.filter("toxic = 1").count() == 0 and out.count() == df.filter("toxic = 0").count()


def test_sentences_and_marks():
    assert toxicity.words("STUPID$$$ éa!! x_y") == [b"stupid", "éa".encode(), b"x", b"y"]
    assert [len(s) for s in toxicity.sentences("One two. Three\nfour five six!")] == [2, 1, 3, 0]
    assert b"<low" in toxicity.marks(b"loweis") and b"eis>" in toxicity.marks(b"loweis") and toxicity.marks(b"ab") == [b"ab"]


def test_a_bound_on_places_leaves_out_whole_rows(spark):
    docs = spark.createDataFrame([(i, "good fine " * 3 if i % 2 else "bad !! || ## " + " ".join(f"w{k}" for k in range(100))) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    whole, cut, none = (quality.fit(docs, labels, F.lit(True), places=n) for n in (10**6, 1500, 0))
    assert (whole.w != cut.w).any() and cut.w.any() and not none.w.any()


def plain_fm_score(machine, text, n_chars):
    """The query's score by loops: features as the docstring says, and every pair of them."""
    low = text.encode().lower()
    words = [w for w in re.split(rb"[ \t-\r]+", low) if w]
    size, n, lines = len(low), len(words), low.split(b"\n")
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b"|", b".,;:?\"'()-", b"\n", b"{}[]=_/\\@~^+`", bytes(range(128, 256))]
    shares = [sum(c in kind for c in text.encode()) / max(1, size) for kind in kinds]
    shares += [len(set(words)) / max(1, n), sum(a == b for a, b in zip(words, words[1:])) / max(1, n), 1 - len(set(lines)) / len(lines), (size - n) / max(1, n) / 20]
    bins = [sum(s > x for x in quality.SHARES) for s in shares] + [min(15, n.bit_length()), min(15, len(lines).bit_length())]
    bins.append(0 if n_chars is None else 1 + min(14, n_chars.bit_length()))
    hashed = sorted({zlib.crc32(w) & 32767 for w in set(words)})
    x = [(p, 1 / math.sqrt(max(1, len(hashed)))) for p in hashed] + [(32768 + 16 * i + b, 0.5) for i, b in enumerate(bins)]
    y = machine.w0 + sum(float(machine.w[p]) * v for p, v in x)
    for i in range(len(x)):
        for j in range(i):
            y += float(np.dot(machine.v[x[i][0]].astype(float), machine.v[x[j][0]].astype(float))) * x[i][1] * x[j][1]
    return 1 / (1 + math.exp(-y))


def test_quality_query_against_every_pair_of_features(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.fit(docs, labels, remainder(4) != 2, metadata=("n_chars",))
    got = {r.doc_id: r.score for r in QUERIES["op1_quality_machine"](spark, small).collect()}
    some = [r for r in docs.collect() if len(r.text) < 900]
    assert len(some) > 30
    for r in some:
        assert abs(got[r.doc_id] - plain_fm_score(machine, r.text, r.n_chars)) < 1e-4


def plain_toxic_score(model, text):
    """The query's score by loops over sentences, their words and their marks."""
    best = 0.0
    for sentence in re.split(r"[.!?\n]", text.lower()):
        found = set()
        for w in re.findall(r"(?:[a-z]|[^\x00-\x7f])+", sentence):
            w = w.encode()
            found |= {w} | {b"<" + w[:k] for k in (3, 4, 5, 6) if k < len(w)} | {w[-k:] + b">" for k in (3, 4, 5) if k < len(w)}
        best = max(best, sum(model.weights.get(m, 0.0) for m in found))
    return 1 / (1 + math.exp(-(model.bias + best)))


def test_toxicity_query_against_loops(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, remainder(3) != 1)
    got = {r.doc_id: r.score for r in QUERIES["op2_counterfactual_toxicity"](spark, medium).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - plain_toxic_score(model, r.text)) < 1e-9
    assert max(got.values()) > 0.7


@pytest.mark.parametrize("folder, least", [("sf0.01", 0.75), ("sf0.1", 0.85)])
def test_toxic_texts_are_caught_and_clean_ones_left(spark, small, folder, least):
    """Of held-out texts at the threshold of the query; small tables teach few marks."""
    d = small.replace("sf0.001", folder)
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), labels(spark, d)
    model = toxicity.fit(docs, known, remainder(3) != 1)
    held = toxicity.score(docs.filter(remainder(3) == 1), model).join(known, "doc_id").groupBy("toxic").agg({"predicted": "avg"}).collect()
    share = {r.toxic: r["avg(predicted)"] for r in held}
    assert share[1] >= least and share[0] <= 0.01


def test_the_sample_of_toxic_texts_has_a_bound_in_bytes(spark, small):
    docs, known = spark.read.parquet(f"{small}/documents.parquet"), labels(spark, small)
    assert toxicity.fit(docs, known, remainder(3) != 1, most_bytes=0).weights == {}
    assert toxicity.fit(docs, known, remainder(3) != 1, most_bytes=10**9).weights == toxicity.fit(docs, known, remainder(3) != 1).weights
