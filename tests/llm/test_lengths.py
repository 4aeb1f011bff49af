import tiktoken

from lakeloom.llm import lengths
from lakeloom.llm.queries import QUERIES


def brute(values):
    total, out = sum(values), {}
    for limit in sorted(set(values)):
        longer = [v for v in values if v > limit]
        out[limit] = (values.count(limit), len(values), total, len(longer), sum(longer), sum(min(v, limit) for v in values), (len(values) - len(longer)) / len(values))
    return out


def answers(df):
    return {r.n_tokens: (r.n_docs, r.docs_total, r.tokens_total, r.docs_longer, r.tokens_longer, r.tokens_cut, r.share_within) for r in df.collect()}


def test_suffix_sums_equal_brute_force(spark, monkeypatch):
    values = [(i * i * 7) % 500 for i in range(300)] + [0, 0, 10_000]
    df = spark.createDataFrame([(v,) for v in values], "n_tokens long")
    for span in (1, 64, 10**6):
        monkeypatch.setattr(lengths, "SPAN", span)
        hist = lengths.histogram(df)
        assert answers(lengths.limits(hist)) == brute(values)
        assert lengths.quantile(lengths.limits(hist), 0.5).collect()[0].n_tokens == sorted(values)[(len(values) + 1) // 2 - 1]
        assert lengths.at_limit(hist, 123).collect()[0].tokens_cut == sum(min(v, 123) for v in values)


def test_by_group_with_a_null_group(spark):
    rows = [("a", 3), ("a", 5), (None, 4), (None, 4), ("b", 0)]
    df = spark.createDataFrame(rows, "g string, n_tokens long")
    got = {(r.g, r.n_tokens): (r.docs_total, r.tokens_cut) for r in lengths.limits(lengths.histogram(df, ["g"]), ["g"]).collect()}
    assert got == {("a", 3): (2, 6), ("a", 5): (2, 8), (None, 4): (2, 8), ("b", 0): (1, 0)}


def test_query_counts_whole_texts(spark, small):
    e = lengths.encoder()
    assert isinstance(e, tiktoken.Encoding)
    values = [len(e.encode_ordinary(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert answers(QUERIES["op5_length_histogram"](spark, small)) == brute(values)


def test_messy_and_empty(messy, empty):
    got = lengths.token_lengths(messy, by=["source"]).collect()
    assert len(got) == 9 and sum(r.n_tokens == 0 for r in got) == 2
    assert lengths.limits(lengths.histogram(lengths.token_lengths(empty))).count() == 0
    assert lengths.at_limit(lengths.histogram(lengths.token_lengths(empty)), 5).collect()[0].tokens_cut == 0


def test_any_limits_are_answered_by_the_suffix_sums(spark, empty):
    values = [5, 7, 7, 20, 100]
    hist = lengths.histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long"))
    context = [0, 4, 5, 6, 19, 20, 99, 10**6]
    got = {r.n_tokens: (r.docs_longer, r.tokens_longer, r.tokens_cut, r.share_within) for r in lengths.at_limits(lengths.limits(hist), context).collect()}
    for c in context:
        longer = [v for v in values if v > c]
        assert got[c] == (len(longer), sum(longer), sum(min(v, c) for v in values), (5 - len(longer)) / 5)
        assert lengths.at_limit(hist, c).first().tokens_cut == got[c][2]
    assert lengths.at_limits(lengths.limits(lengths.histogram(lengths.token_lengths(empty))), [5]).count() == 0
