"""Toxicity by a counterfactual-regularised classifier over sentences.

A sentence's logit is linear in marks of its words (a word, its beginnings, its ends) that are in
a learned vocabulary; a document's is that of its most toxic sentence. Fitting minimises the logistic loss of labelled documents plus a penalty on
squared changes of a sentence's logit when identity terms in it are swapped for others of their
kind (or, in a sentence that has none, when a neutral mention is put in). So a group's mention
can't carry the score by itself, and neutral mentions stay low.

The vocabulary holds the marks whose share of toxic documents no chance explains: a Chernoff
bound on that share, against the number of marks looked at. Equal texts of the sample count
once. Learning takes at most ``limit`` labelled rows, chosen by a hash of the key.

Defined results: null and empty texts have the score of a text without known marks; repeated
rows get equal scores; without labels of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import in_worker, small_batches, written
from lakeloom.llm.quality import sample_of

#: Words for groups of people, by kind; within a kind they are swapped for each other.
IDENTITY = {
    "gender": "women men woman man girls boys female male femmes hommes femme homme frauen männer frau mann mujeres hombres mujer hombre transgender nonbinary".split(),
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual homosexuel schwul lesbisch".split(),
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists catholic protestant sikh musulmans chrétiens juifs muslime christen juden musulmanes cristianos judíos".split(),
    "origin": "african asian european american arab mexican chinese indian black white latino hispanic immigrant immigrants refugee refugees africains immigrés flüchtlinge ausländer inmigrantes refugiados".split(),
    "ability": "disabled deaf blind autistic elderly old young handicapés behinderte discapacitados".split(),
}
KIND_OF = {w: k for k, words in IDENTITY.items() for w in words}

_letters = bytearray(b" " * 256)
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _letters[_c] = _c
WORD_TABLE = bytes(_letters)
for _c in b".!?\n":
    _letters[_c] = 10
SENTENCE_TABLE = bytes(_letters)


def words(text: str) -> list[bytes]:
    """Lower-case runs of letters."""
    return text.lower().encode().translate(WORD_TABLE).split()


def sentences(text: str) -> list[list[bytes]]:
    """Words of each sentence; sentences end at . ! ? and line ends."""
    return [s.split() for s in text.lower().encode().translate(SENTENCE_TABLE).split(b"\n")]


#: A mark is known if its gain is one that chance gives to less than one in so many times the sample's texts.
CHANCE = 10
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4, 5)


def marks(word: bytes) -> list[bytes]:
    """What a word is known by: itself, its beginnings and its ends (in bytes)."""
    n = len(word)
    return [word, *(b"<" + word[:k] for k in PREFIXES if k < n), *(word[-k:] + b">" for k in SUFFIXES if k < n)]


class Marks:
    """A set of known marks, with a quick test that leaves out most words."""

    def __init__(self, known):
        self.known = frozenset(known)
        self.whole = frozenset(m for m in self.known if m[:1] != b"<" and m[-1:] != b">")
        self.heads = frozenset(m[1:4] for m in self.known if m[:1] == b"<")
        self.tails = frozenset(m[-4:-1] for m in self.known if m[-1:] == b">")

    def suspects(self, text: str) -> set[bytes]:
        """Distinct words of a text that may have a known mark."""
        whole, heads, tails = self.whole, self.heads, self.tails
        return {w for w in set(words(text)) if w[:3] in heads or w[-3:] in tails or w in whole}

    def of(self, sentence, suspects: set[bytes]) -> frozenset[bytes]:
        return frozenset(m for w in suspects.intersection(sentence) for m in marks(w) if m in self.known)


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self):
        self.marks = Marks(self.weights)

    def logit(self, text: str) -> float:
        suspects = self.marks.suspects(text)
        if not suspects:
            return self.bias
        get = self.weights.__getitem__
        return self.bias + max(0.0, *(sum(map(get, self.marks.of(s, suspects))) for s in sentences(text)))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def counterfactuals(sentence: frozenset[bytes], known: Marks) -> list[frozenset[bytes]]:
    """The marks of the sentence with each identity term swapped for others of its kind, or with a mention put in."""
    def own(w: bytes) -> frozenset[bytes]:
        return frozenset(m for m in marks(w) if m in known.known)

    out = []
    found = [w for w in sentence if w.decode("utf-8", "replace") in KIND_OF]
    for w in found:
        others = [x.encode() for x in IDENTITY[KIND_OF[w.decode()]] if x.encode() != w]
        out += [(sentence - own(w)) | own(x) for x in others]
    if not found:
        out += [sentence | own(x.encode()) for x in KIND_OF]
    return out


def train(docs: list[tuple[int, list[frozenset[bytes]]]], vocabulary: list[bytes], penalty: float = 1.0, decay: float = 1e-3, steps: int = 600, rate: float = 0.05) -> Model:
    """Full-batch gradient steps on labelled documents, each given by the known marks of its sentences."""
    names = sorted({*vocabulary, *(w.encode() for w in KIND_OF)})
    known = Marks(names)
    at = {w: i for i, w in enumerate(names)}
    y = np.array([d[0] for d in docs], dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Model(bias)
    # Kind 0 is the sentence without known marks, which every document has.
    kinds: dict[frozenset, int] = {frozenset(): 0}
    member: list[tuple[int, int]] = [(i, 0) for i in range(len(docs))]
    for i, (_, found) in enumerate(docs):
        member += [(i, kinds.setdefault(s, len(kinds))) for s in sorted(set(found), key=sorted)]
    of_doc, of_kind = np.array(member).T
    order = np.argsort(of_doc, kind="stable")
    of_doc, of_kind = of_doc[order], of_kind[order]
    begin = np.flatnonzero(np.diff(of_doc, prepend=-1))
    kind_row = np.array([k for s, k in kinds.items() for _ in s], dtype=np.int64)
    kind_at = np.array([at[m] for s in kinds for m in sorted(s)], dtype=np.int64)
    changes: dict[tuple, float] = {}
    for s in kinds:
        others = counterfactuals(s, known)
        for o in others:
            change = tuple(sorted([(at[m], 1.0) for m in o - s] + [(at[m], -1.0) for m in s - o]))
            changes[change] = changes.get(change, 0.0) + 1 / len(others) / len(kinds)
    swap_row = np.array([k for k, c in enumerate(changes) for _ in c], dtype=np.int64)
    swap_at = np.array([i for c in changes for i, _ in c], dtype=np.int64)
    swap_sign = np.array([sign for c in changes for _, sign in c])
    share_of = np.array(list(changes.values()))
    start = np.array([at[v] for v in vocabulary], dtype=np.int64)
    # The bias is the last parameter. Before any mark has a weight all sentences tie; a small start lets them part.
    w, mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    w[start], w[-1] = 0.01, bias
    for step in range(1, steps + 1):
        z = np.bincount(kind_row, weights=w[kind_at], minlength=len(kinds))[of_kind]
        best = np.maximum.reduceat(z, begin)
        # The first sentence that reaches its document's maximum takes the gradient.
        top = np.flatnonzero(z == best[of_doc])
        top = top[np.unique(of_doc[top], return_index=True)[1]]
        g = (1 / (1 + np.exp(-np.clip(w[-1] + best, -30, 30))) - y) / len(y)
        by_kind = np.bincount(of_kind[top], weights=g, minlength=len(kinds))
        grad = np.bincount(kind_at, weights=by_kind[kind_row], minlength=len(names)) + decay / len(y) * w[:-1]
        moved = np.bincount(swap_row, weights=swap_sign * w[swap_at], minlength=len(changes)) * share_of
        grad += 2 * penalty * np.bincount(swap_at, weights=swap_sign * moved[swap_row], minlength=len(names))
        grad = np.append(grad, g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        w -= rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Model(float(w[-1]), {n: float(v) for n, v in zip(names, w, strict=False) if v})


def fit(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", column: str = "text", label: str = "toxic", limit: int = 12_000, most_marks: int = 1024, penalty: float = 1.0, most_bytes: int = 200_000_000) -> Model:
    """A model from at most ``limit`` labelled documents, and of these from no more than have ``most_bytes`` of text together; the driver sees counts of at most ``most_marks`` marks and the known marks of those documents' sentences."""
    chosen = sample_of(labels, key, label, learn, limit)
    small_batches(docs.sparkSession)
    inner = docs.select(docs[key].alias("k"), F.coalesce(docs[column].cast("string"), F.lit("")).alias("t"))
    inner = inner.join(F.broadcast(chosen), "k").select("t", "y")  # at most ``limit`` rows
    texts = written(inner.groupBy(F.md5("t").alias("h")).agg(F.max("y").alias("y"), F.first("t").alias("t")), "toxic-sample")
    so_far = F.sum(F.octet_length("t").cast("long")).over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    fits = texts.select("h", so_far.alias("bytes")).filter(F.col("bytes") <= most_bytes).select("h")  # of at most ``limit`` rows
    sample = texts.join(F.broadcast(fits), "h")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()

    def each_mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 128):  # bounds the table of counts
                b = batch.slice(at, 128)
                n, a = Counter(), Counter()
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = {m for w in set(words(t)) for m in marks(w)}
                    n.update(own)
                    if y:
                        a.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array([a[m] for m in n], pa.int64())], names=["w", "n", "a"])

    counted = sample.select("t", "y").mapInArrow(each_mark, "w binary, n long, a long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    counted = counted.filter(F.col("a") >= 3)
    prior = (totals.toxic + 1) / (totals.n + 2)
    p = F.col("a") / F.col("n")
    gain = F.col("a") * F.log(p / prior) + F.when(p < 1, (F.col("n") - F.col("a")) * F.log((1 - p) / (1 - prior))).otherwise(0.0)
    needed = float(np.log(max(2, totals.n) * CHANCE))
    best = counted.withColumn("gain", gain).filter((p > prior) & (F.col("gain") > needed)).orderBy(F.desc("gain"), "w").limit(most_marks)
    vocabulary = sorted(bytes(r.w) for r in best.select("w").collect())
    known = Marks({*vocabulary, *(w.encode() for w in KIND_OF)})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("toxicity")
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                suspects = known.suspects(t)
                out.append(b"\n".join(sorted({b" ".join(sorted(known.of(s, suspects))) for s in sentences(t)} - {b""})) if suspects else b"")
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["y", "s"])

    rows = sample.select("t", "y").mapInArrow(found, "y int, s binary").collect()
    rows = sorted((r.y, bytes(r.s)) for r in rows)
    return train([(y, [frozenset(s.split(b" ")) for s in found_in.split(b"\n") if s]) for y, found_in in rows], vocabulary, penalty)


def score(docs: DataFrame, model: Model, key: str = "doc_id", column: str = "text", threshold: float = 0.7) -> DataFrame:
    """key, score double and predicted int for every row; other columns of the input are not read."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("toxicity")
        for b in batches:
            scores = [model.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["k", "score"])

    small_batches(docs.sparkSession)
    out = docs.select(docs[key].alias("k"), docs[column].cast("string").alias("t")).mapInArrow(run, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, column: str = "text", threshold: float = 0.7) -> DataFrame:
    """The input's rows and columns, unchanged, without those that score at least the threshold."""

    schema, place = docs.schema, docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("toxicity")
        for b in batches:
            yield b.filter(pa.array([model.score(t or "") < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
