import random

import numpy as np
import pytest

from lakeloom.llm import near
from lakeloom.llm.components import components
from lakeloom.llm.queries import QUERIES

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), float("inf")), ids[i])
    return sorted(((rows[i][0], len(sets[i]), None if least[find(i)] == float("inf") else least[find(i)]) for i in range(len(rows))), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def family(r, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"block": 300, "chunk_bytes": 3000}, {"n": 5, "percent": 80, "block": 1000}, {"n": 2, "percent": 50}, {"sets": 3, "chunk_bytes": 3000}, {"sets": 1}, {"n": 2, "percent": 50, "sets": 2}])
def test_families_passages_and_short_texts(spark, options):
    r = random.Random(11)
    new = lambda k: [f"w{r.randrange(3000)}" for _ in range(k)]
    texts = []
    for size in (20, 60, 150):
        texts += family(r, new(size), 25, 8)
    passage = new(40)
    texts += [" ".join(new(30) + passage + new(20)) for _ in range(20)]
    texts += ["A b C", "a B c", "a b", "a", "", None, "a b c d", "A B C D e"] * 2
    texts += [texts[0]] * 10
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, "quite alone here"), (4, texts[30])]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, options.get("n", 4), options.get("percent", 85))
    assert result(near.classes(df, **options)) == want
    assert len({w[2] for w in want}) < len(rows) - 30


def test_query_equals_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op8_adaptive_prefix_join"](spark, small)) == brute(rows)


def test_adaptive_lengths_change_no_result():
    r = random.Random(2)
    base = [r.randrange(2**40) for _ in range(120)]
    sets = []
    for _ in range(80):
        keep = [x for x in base if r.random() < 0.93]
        sets.append(np.unique(np.array(keep + [r.randrange(2**40) for _ in range(r.randrange(12))], dtype=np.uint64)))
    ids = np.array(r.sample(range(1000), 80))
    found = dict(near.join_in_memory(ids, sets, 85))
    want = {}
    root = {int(i): int(i) for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(80):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(int(ids[i])), find(int(ids[j]))))
                root[b] = a
    want = {int(i): find(int(i)) for i in ids if find(int(i)) != i}
    assert found == want and len(want) > 10
    rank = {v: k for k, v in enumerate(sorted({int(x) for s in sets for x in s}))}
    ranks = [np.array(sorted(rank[int(x)] for x in s)) for s in sets]
    frequency = np.bincount(np.concatenate(ranks))
    assert near.adaptive_lengths(ranks, frequency, 85).max() > 1  # costly lists ask for longer prefixes


def test_one_of_each_keeps_rows_and_columns(messy, empty):
    out = near.one_of_each(messy)
    assert out.columns == messy.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7]
    assert out.count() == 8
    assert near.classes(empty).count() == near.one_of_each(empty).count() == 0


def test_one_of_each_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    r = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d + " end"), (3, d + " end"), (9, e), (9, e), (None, e), (None, a), (None, ""), (None, ""), (7, None)]
    out = sorted(((x.doc_id, x.text) for x in near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert out == sorted([(None, a), (None, b), (7, c), (3, d + " end"), (9, e), (None, ""), (None, ""), (7, None)], key=repr)


def test_messy(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert result(near.classes(messy)) == brute(rows)


def test_components_of_paths_stars_and_cycles(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    r.shuffle(edges)
    df = spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in edges], "a long, b long")
    got = {x.node: x.root for x in components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {900: 900, 901: 900, 902: 900}
    assert components(df.limit(0)).count() == 0


def test_large_groups_without_a_common_centre(spark):
    """Chains of ever more edits link neighbours only, so pivots leave much to the pairs of blocks."""
    r = random.Random(4)
    texts = []
    for _ in range(3):
        w = [f"w{r.randrange(400)}" for _ in range(60)]
        for _ in range(60):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(near.classes(df, sets=8)) == brute(rows)


def test_words_of_one_pattern_stay_apart(spark):
    x, y = ("".join((a + b)[bin(i).count("1") % 2] for i in range(1024)) for a, b in ("ab", "ba"))
    rows = [(1, f"{x} {x} {x} {x} {x}"), (2, f"{y} {y} {y} {y} {y}"), (3, x), (4, y), (5, x)]
    assert result(near.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_relays_change_no_class(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(near.classes(docs, chunk_bytes=20_000, direct=1)) == brute(rows)
