"""Near duplicates by MinHash against all pairs, and components of edge tables."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lakeloom.operators import neardup
from lakeloom.operators.graph import components


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    return out


def brute(texts, percent=80):
    sets = sets_of(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def edited(r, words, most):
    out = list(words)
    for _ in range(r.randrange(most)):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return " ".join(out)


def classes(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(tuple(r) for r in neardup.near_classes(df, **options).collect())


def test_families_copies_and_odd_texts(spark):
    r = random.Random(1)
    texts = []
    for size in (30, 80, 200):
        words = [f"w{r.randrange(5000)}" for _ in range(size)]
        texts += [edited(r, words, 1 + size // 25) for _ in range(25)]
    texts += [texts[0]] * 6 + ["", None, " . ", "one two", "One  two!", "one two three four five", "x"]
    r.shuffle(texts)
    want = brute(texts)
    assert classes(spark, texts) == want
    assert len({c for _, _, c in want}) < len(texts) - 40
    assert classes(spark, []) == []


def test_chains_whose_ends_differ(spark):
    """Each text is near its neighbours only, so one pivot of a bucket does not find every link."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words[(7 * i) % 120] = f"e{i}"
        texts.append(" ".join(words))
    r.shuffle(texts)
    assert classes(spark, texts) == brute(texts)


def test_unlinked_members_of_one_bucket_are_all_compared(spark):
    """Pages of one template share bands without being near; some of them are copies with an edit."""
    r = random.Random(3)
    head = [f"h{i}" for i in range(60)]
    texts = [" ".join(head + [f"b{i}x{k}" for k in range(40)]) for i in range(120)]
    texts += [t.replace("x3 ", "y3 ") for t in texts[:30]]
    r.shuffle(texts)
    want = brute(texts)
    assert classes(spark, texts, bands=40, rows=2) == want
    assert len({c for _, _, c in want}) == 120


def test_recall_of_bands_at_the_threshold(spark):
    """Pairs at a similarity just above the threshold: bands bring nearly all together."""
    r = random.Random(4)
    texts, near = [], 0
    for i in range(300):
        words = [f"w{i}x{k}" for k in range(100)]
        other = list(words)
        for k in r.sample(range(0, 100, 9), 2):
            other[k] = "e"
        texts += [" ".join(words), " ".join(other)]
    sets = sets_of(texts)
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    found = {i: c for i, _, c in classes(spark, texts)}
    near = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 100 and near == len(pairs)
    assert all(found[i] == i for i in range(0, len(texts), 2))  # and nothing else


def test_signature_agreement_estimates_similarity(spark):
    r = np.random.default_rng(5)
    shared, own = [int(x) for x in r.integers(-(2**62), 2**62, 80)], [[int(x) for x in r.integers(-(2**62), 2**62, 10)] for _ in range(2)]
    df = spark.createDataFrame([(i, 90, sorted(shared + own[i])) for i in range(2)], "rep long, n_shingles long, shingles array<long>")
    keys = neardup.banded(df, 2000, 1).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert abs(keys.filter("n = 2").count() / 2000 - 0.8) < 0.04


def test_only_sets_that_share_a_band_are_kept(spark, monkeypatch):
    """Texts alone in all their buckets, and copies of one text, leave no set of shingles behind."""
    kept, store = {}, neardup.stored

    def noted(df, name):
        out = store(df, name)
        if "shingles" in out.columns:
            kept[name] = kept.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "stored", noted)
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(50)) for _ in range(40)]
    texts += [texts[0]] * 3 + [texts[1] + " more"]
    assert classes(spark, texts) == brute(texts)
    assert sum(kept.values()) == 2


def test_counts_rule_out_no_near_pair(spark):
    """The bound is never below the similarity, for sets of all sizes; it rules out nearly all pairs that share half."""
    r = random.Random(7)
    sets, pairs = [], []
    for size in [1, 2, 3, 4, 5, 8, 9, 30, 100, 129, 700, 3000]:
        for percent in (40, 50, 79, 80, 81, 95):
            for other in (size, size + size // 5):
                one = [r.randrange(-(2**63), 2**63) for _ in range(size)]
                n = min(size, percent * (size + other) // (100 + percent))
                two = one[:n] + [r.randrange(-(2**63), 2**63) for _ in range(other - n)]
                pairs.append((len(sets), len(sets) + 1))
                sets += [one, two]
    sets += [[256 * i for i in range(2000)]] * 2  # all in one bin
    pairs.append((len(sets) - 2, len(sets) - 1))
    df = neardup.counted(spark.createDataFrame(list(enumerate(map(sorted, sets))), "rep long, shingles array<long>"))
    got = {tuple(x) for x in neardup.likely(spark.createDataFrame(pairs, "a long, b long"), df, 80).collect()}
    share = {(a, b): 100 * len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in pairs}
    assert got >= {p for p in pairs if share[p] >= 80}
    far = [p for p in pairs if share[p] <= 50 and len(sets[p[0]]) >= 100]
    assert len(far) >= 12 and not got & set(far)


def test_components_of_paths_stars_and_cycles(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 30)] + [(900, 901), (901, 902), (902, 900), (7, 7)]
    r.shuffle(edges)
    df = spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in edges], "a long, b long")
    got = {x.node: x.root for x in components(df).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 530)} | {900: 900, 901: 900, 902: 900}
    assert components(df.limit(0)).count() == 0
