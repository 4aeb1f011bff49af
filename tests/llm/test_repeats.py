import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import repeats
from lakeloom.llm.queries import QUERIES


def brute(rows, k=50):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            at = float("inf") if i is None else i
            first[key] = min(first.get(key, float("inf")), at)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (float("inf") if i is None else i):
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, medium):
    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    got = result(QUERIES["op6_super_kmer_repeats"](spark, medium))
    assert got == brute([tuple(r) for r in rows])
    assert any(r[2] for r in got)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 2000}, {"chunk_bytes": 1000, "hot": 0}, {"chunk_bytes": 1000, "hot": 2}, {"k": 8, "m": 3, "hot": 1, "chunk_bytes": 3000}, {"k": 5, "m": 5}])
def test_passages_copies_and_repetitive_texts(spark, options):
    r = random.Random(5)
    word = lambda: r.choice(["a", "b", "c", "dd", "é", "the"])
    passage = " ".join(word() for _ in range(70))
    rows = []
    for i in range(60):
        text = " ".join(word() + str(r.randrange(50)) for _ in range(r.randrange(0, 120)))
        if i % 3 == 0:
            text += "\n" + passage + "  " + text[:50]
        if i % 5 == 0:
            text = "the " * r.randrange(40, 130) + text
        rows.append((i, text))
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)] + [(None, rows[3][1]), (None, rows[3][1]), (3, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(repeats.repeats(df, **options)) == brute(rows, options.get("k", 50))


def test_messy_and_empty(messy, empty):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    out = repeats.repeats(messy, texts=True)
    assert result(out) == brute(rows)
    assert {r.doc_id: r.kept for r in out.collect()}[7] == "one two"
    assert repeats.repeats(empty).count() == 0


def test_super_kmers_cover_every_window_once():
    r = random.Random(1)
    texts = [" ".join(str(r.randrange(9)) for _ in range(n)).encode() for n in (0, 10, 49, 50, 51, 300, 7)]
    w = repeats.windows(texts, 50, 8)
    covered = sorted(i for a, n in zip(w.at, w.n, strict=True) for i in range(a, a + n))
    assert covered == [i for i in range(len(w.valid)) if w.valid[i]]
    assert len(covered) == 1 + 2 + 251


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_words_and_windows_of_one_pattern_stay_apart(spark):
    """Texts whose polynomial hashes modulo a power of two agree, in words, in windows and in super-k-mers."""
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    p, q = (" ".join(thue_morse(1024, f"{a} ", f"{b} ").split()) for a, b in (("a", "b"), ("b", "a")))
    tail = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{p} {tail}"), (4, f"{q} {tail}"), (5, f"{x} {tail}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"hot": 0}):
        assert result(repeats.repeats(df, **options)) == brute(rows)


@pytest.mark.parametrize("direct", [1, 10_000])
def test_relays_give_the_same_rows(spark, small, direct):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(repeats.repeats(docs, chunk_bytes=20_000, direct=direct, hot=4)) == brute(rows)


def test_rows_of_an_exchange_do_not_grow_with_the_square(spark, small):
    import numpy as np

    from lakeloom.llm import packed as px

    docs, sent, kind = spark.read.parquet(f"{small}/documents.parquet"), {}, (px.Kind((np.uint64,)),)
    keys = np.linspace(0, 2**64 - 2**12, 500).astype(np.uint64)
    for n in (36, 144):
        exchange = px.Exchange(n, direct=1)
        first = docs.select(F.pmod("doc_id", F.lit(n)).cast("int").alias("chunk"), F.col("doc_id").alias("id"), "text")
        to = exchange.to_buckets(first, lambda t, n=n: [px.part(px.bucket_of(keys, n), [keys])], kind)
        back = exchange.to_chunks(to, lambda parts: parts, kind, kind)
        sent[n] = to.count()
        assert first.select("chunk").distinct().count() * 500 == sum(len(px._parts(pa.table({"source": [r.source], "target": [r.target], "packed": [bytes(r.packed)]}), kind)[0].peer) for r in back.collect())
    assert sent[144] <= sent[36] * 4**1.5
    assert px.number_of_chunks(8 * 10**13) == 10**7 and px.number_of_chunks(0) == 1
    assert px.stored_size(docs, "text") < 10**8 and px.stored_size(spark.createDataFrame([("ab",)], "text string"), "text") <= 10**4
