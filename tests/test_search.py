"""The stored index: pruned top-k, dictionary and deletions against brute force, and how the build is dealt out."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.operators import search
from lakeloom.operators.index import Index, left_over


def corpus(seed, n, words=60):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return {7 * i + 3: r.choices([f"t{j}" for j in range(words)], weights, k=r.choice([0, 1, 5, 20, 80])) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(i, " ".join(w), "en", "s") for i, w in docs.items()], "doc_id long, text string, lang string, source string").repartition(3)


def brute(docs, terms, k):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    out = []
    for i, w in docs.items():
        score = 0.0
        for t in terms:
            if tf := w.count(t):
                df = sum(t in x for x in docs.values())
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(w) / mean))
        if score:
            out.append((i, round(score, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = corpus(1, 600)
    return docs, Index.build(frame(spark, docs), str(tmp_path_factory.mktemp("index") / "i"), block=8, bucket_bytes=2000, slice_bytes=5000)


@pytest.mark.parametrize("terms", [["t0"], ["t0", "t40"], ["t55", "t56", "t57"], ["t0", "t1", "t2", "none"], ["none"], ["t3", "t3"]])
@pytest.mark.parametrize("k", [1, 10, 1000, 0])
def test_pruned_search_equals_scoring_all(built, terms, k):
    docs, index = built
    got = [(r.doc_id, r.score) for r in search.bm25(index, terms, k).collect()]
    assert got == brute(docs, dict.fromkeys(terms), k)


def test_blocks_are_skipped(built):
    docs, index = built
    told = {}
    got = [(r.doc_id, r.score) for r in search.bm25(index, ["t0", "t50"], 3, told).collect()]
    assert got == brute(docs, ["t0", "t50"], 3)
    assert told["blocks"] > 70 and told["read"] < told["blocks"] / 2


def test_many_block_numbers_go_by_a_join(built, monkeypatch):
    docs, index = built
    monkeypatch.setattr(search, "NAMED", 1)
    assert [(r.doc_id, r.score) for r in search.bm25(index, ["t0"], 200).collect()] == brute(docs, ["t0"], 200)


def test_blocks_hold_what_the_texts_have(built):
    docs, index = built
    got = sorted((r.term, r.doc_id, r.place) for r in index.occurrences([f"t{i}" for i in range(60)]).collect())
    assert got == sorted((t, i, p) for i, w in docs.items() for p, t in enumerate(w))
    assert sorted((r.term, r.doc_id, r.tf) for r in index.postings().collect()) == sorted({(t, i, w.count(t)) for i, w in docs.items() for t in w})
    terms = {r.term: (r.df, r.cf) for r in index.terms().collect()}
    assert terms == {t: (sum(t in w for w in docs.values()), sum(w.count(t) for w in docs.values())) for t in {t for w in docs.values() for t in w}}
    assert max(r.n for r in index.blocks(["t0"]).select("n").collect()) < 40


def test_tasks_of_the_build_grow_with_the_input(spark, built, tmp_path):
    def shape(index):
        r = index.totals().first()
        return r.blocks, r.buckets, r.slices

    small = Index.build(frame(spark, corpus(2, 60)), f"{tmp_path}/i", block=8, bucket_bytes=2000, slice_bytes=5000)
    assert all(a < b for a, b in zip(shape(small), shape(built[1]), strict=True))


def test_an_empty_index(spark, tmp_path):
    index = Index.build(frame(spark, {1: ["a"]}).limit(0), f"{tmp_path}/i")
    assert index.terms().count() == index.postings().count() == index.like("a", 1).count() == search.bm25(index, ["a"], 5).count() == 0
    null = Index.build(spark.createDataFrame([(1, None, None, None), (2, "a", None, None)], "doc_id long, text string, lang string, source string"), f"{tmp_path}/j")
    assert [(r.term, r.df) for r in null.terms().collect()] == [("a", 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=2000, deadline=None)
@given(st.text("abc", max_size=12), st.lists(st.tuples(st.sampled_from("dis"), st.integers(0, 12), st.sampled_from("abcd")), max_size=2))
def test_words_within_two_edits_share_a_remainder(word, edits):
    other = word
    for kind, at, letter in edits:
        at = min(at, len(other))
        other = other[:at] + (letter if kind != "d" else "") + other[at + (kind != "i") :]
    assert distance(word, other) <= 2 and left_over(word) & left_over(other)


def test_fuzzy_words_equal_all_distances(spark, tmp_path):
    r = random.Random(5)
    words = {"".join(r.choice("abcé") for _ in range(r.randrange(1, 10))) for _ in range(700)}
    index = Index.build(frame(spark, {1: sorted(words)}), f"{tmp_path}/i", bucket_bytes=500)
    for word in ["", "a", "abcab", "abcabcabc", "ccccccccccc"]:
        for within in (0, 1, 2):
            assert sorted(x.term for x in index.like(word, within).collect()) == sorted(w for w in words if distance(word, w) <= within)
    with pytest.raises(ValueError):
        index.like("a", 3)


@pytest.mark.parametrize("name", ["s6_prefix", "s6_fuzzy", "s9_term_statistics"])
def test_words_are_found_without_postings(spark, small, name):
    plan = search.registry.queries[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "/postings" not in plan and "documents.parquet" not in plan
    assert name != "s6_prefix" or "StringStartsWith(term" in plan
    assert name != "s6_fuzzy" or "PartitionFilters: [bucket" in plan


def test_bounds_are_read_without_postings(spark, small):
    index = search.of_folder(spark, small)
    plan = index.blocks(["the"]).select("term", "block", "most")._jdf.queryExecution().executedPlan().toString()
    assert "doc_ids" not in plan.split("ReadSchema")[1]


def test_a_task_takes_texts_in_bounded_runs_of_words(monkeypatch):
    import pyarrow as pa

    from lakeloom.operators import index

    monkeypatch.setattr(index, "WORDS", 50, raising=False)
    texts = [["a", "b", "a"] * k for k in (3, 0, 40, 1, 1, 1, 20)] * 3 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts, pa.list_(pa.string()))], names=["doc_id", "block", "words"])
    out = list(index._of_documents(iter([batch])))
    assert len(out) > 3 and all(sum(b.column("tf").to_pylist()) <= 120 for b in out)
    got = [(r["doc_id"], r["term"], r["places"], r["length"]) for b in out for r in b.to_pylist()]
    want = [(i, t, [p for p, w in enumerate(words) if w == t], len(words)) for i, words in enumerate(texts) for t in sorted(set(words or []))]
    assert sorted(got) == want


def test_distances_of_words_count_bytes_as_the_sql_does(spark, tmp_path):
    import duckdb

    texts = ["therent thérent thérént", "tħerenŧ theréntt ṫherent herent", "therents thrnt"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'de' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = {r[0] for r in con.execute(search.registry.oracles["s6_fuzzy"]).fetchall()}
    assert "thérent" in want and "thérént" not in want
    assert {r.term for r in search.registry.queries["s6_fuzzy"](spark, str(tmp_path)).collect()} == want
