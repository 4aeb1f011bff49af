"""Document quality by a factorisation machine over hashed words, structure and metadata.

A document is a sparse row: its distinct lower-case words hashed to 2^15 places (each with value
1/sqrt(number of them)), its structure statistics and metadata as one-hot bins. The machine's
score is w0 + sum w x + sum over pairs <v_i, v_j> x_i x_j, where the pair sum is taken in linear
time as half of (sum v x)^2 - sum (v x)^2 for each of the factors.

``fit`` learns from at most ``limit`` labelled rows of at most ``places`` features together, chosen
by a hash of the key; ``score`` runs over every row of a table. Neither looks at the key, language or source of a document.

Defined results: null and empty texts are scored by their structure alone; repeated rows get
equal scores; without labels of both kinds every score is the smoothed share of label 1; null
metadata has a bin of its own; conflicting labels of one key count as their largest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import in_worker, small_batches, utf8, written

WORDS = 1 << 15
BINS = 16
FACTORS = 8
SHARES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.99])


def _byte_classes() -> np.ndarray:
    """Which bytes each structure statistic counts."""
    kinds = [
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b"#*$%&|<>",
        b"!",
        b"|",
        b".,;:?\"'()-",
        b"\n",
        b"{}[]=_/\\@~^+`",
    ]
    out = np.zeros((256, len(kinds) + 1), dtype=np.int64)
    for i, k in enumerate(kinds):
        out[list(k), i] = 1
    out[128:, -1] = 1
    return out


CLASSES = _byte_classes()
N_STATS = CLASSES.shape[1] + 6


def structure(text: bytes, words: list[bytes], distinct: int) -> np.ndarray:
    """Bin of each structure statistic of a text."""
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) @ CLASSES
    lines = text.split(b"\n")
    pairs = sum(map(bytes.__eq__, words, words[1:]))
    shares = [*(counts / max(1, size)), distinct / max(1, n), pairs / max(1, n), 1 - len(set(lines)) / len(lines), (size - n) / max(1, n) / 20]
    out = np.searchsorted(SHARES, shares)
    return np.concatenate([out, [min(BINS - 1, n.bit_length()), min(BINS - 1, len(lines).bit_length())]])


def metadata_bin(value) -> int:
    """Numbers by size, anything else by hash; null is bin 0."""
    if value is None:
        return 0
    if isinstance(value, (int, float)) and value == value and abs(value) < 2**62:
        return 1 + min(BINS - 2, int(abs(value)).bit_length())
    return 1 + zlib.crc32(str(value).encode()) % (BINS - 1)


def features(text: bytes, metadata: tuple = ()) -> np.ndarray:
    """Places of a document's features: hashed words first, then a place for each statistic and metadata column."""
    words = text.lower().split()
    distinct = set(words)
    hashed = np.unique(np.fromiter(map(zlib.crc32, distinct), dtype=np.int64, count=len(distinct)) & (WORDS - 1))
    fields = [*structure(text, words, len(distinct)), *map(metadata_bin, metadata)]
    return np.concatenate([hashed, WORDS + np.arange(len(fields)) * BINS + fields]).astype(np.int32)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, x: np.ndarray) -> float:
        n = int(np.searchsorted(x, WORDS))
        values = np.full(len(x), 0.5, dtype=np.float32)
        values[:n] = 1 / np.sqrt(max(1, n))
        terms = self.v[x] * values[:, None]
        total = terms.sum(axis=0)
        return float(self.w0 + self.w[x] @ values + 0.5 * (total @ total - np.einsum("ij,ij->", terms, terms)))

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, n_metadata: int, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad over batches; the same rows in the same order give the same machine."""
    size = WORDS + (N_STATS + n_metadata) * BINS
    share = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size, dtype=np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32)
    w0 = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        return Machine(w0, w, np.zeros_like(v))
    seen_w, seen_v, seen_0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    values = []
    for x in rows:
        n = int(np.searchsorted(x, WORDS))
        values.append(np.concatenate([np.full(n, 1 / np.sqrt(max(1, n))), np.full(len(x) - n, 0.5)]))
    for epoch in range(epochs):
        step = rate / (1 + 0.15 * epoch)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in pick])
            x, val = np.concatenate([rows[i] for i in pick]), np.concatenate([values[i] for i in pick])
            row, begin = np.repeat(np.arange(len(pick)), lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]])
            terms = v[x] * val[:, None]
            total = np.add.reduceat(terms, begin)
            squares = np.add.reduceat(np.einsum("ij,ij->i", terms, terms), begin)
            y = w0 + np.add.reduceat(w[x] * val, begin) + 0.5 * (np.einsum("ij,ij->i", total, total) - squares)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) / len(pick)
            each = g[row] * val
            gw = np.bincount(x, weights=each, minlength=size) + decay * w
            gv = np.empty((size, FACTORS))
            for f in range(FACTORS):
                gv[:, f] = np.bincount(x, weights=each * (total[row, f] - terms[:, f]), minlength=size)
            gv += decay * v
            seen_w += gw * gw
            seen_v += gv * gv
            seen_0 += float(g.sum()) ** 2
            w -= (step * gw / np.sqrt(seen_w)).astype(np.float32)
            v -= (step * gv / np.sqrt(seen_v)).astype(np.float32)
            w0 -= step * float(g.sum()) / np.sqrt(seen_0)
    return Machine(float(w0), w, v)


def sample_of(labels: DataFrame, key: str, label: str, learn, limit: int) -> DataFrame:
    """At most ``limit`` labelled keys, by a hash of the key; ``learn`` says which rows may be learned from."""
    rows = labels.filter(learn & labels[label].isNotNull() & labels[key].isNotNull())
    rows = rows.select(rows[key].alias("k"), rows[label].cast("int").alias("y")).orderBy(F.xxhash64("k"), "k", "y").limit(limit)
    return rows.groupBy("k").agg(F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, learn, key: str = "doc_id", column: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), limit: int = 10_000, places: int = 20_000_000) -> Machine:
    """A machine from at most ``limit`` labelled documents of at most ``places`` features together, so that
    what reaches the driver is bounded however long texts are (12 bytes for each place)."""
    chosen = sample_of(labels, key, label, learn, limit)
    small_batches(docs.sparkSession)
    inner = docs.select(docs[key].alias("k"), docs[column].cast("string").alias("t"), *(docs[c].alias(f"m{i}") for i, c in enumerate(metadata)))
    inner = inner.join(F.broadcast(chosen), "k")  # at most ``limit`` rows
    kind = inner.schema["k"].dataType.simpleString()
    inner = inner.select("k", "y", "t", *(f"m{i}" for i in range(len(metadata))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("quality")
        for b in batches:
            extra = list(zip(*(c.to_pylist() for c in b.columns[3:]), strict=True)) or [()] * b.num_rows
            places = [features(t, m).tobytes() for t, m in zip(utf8(b.column(2)), extra, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.binary())], names=["k", "y", "x"])

    found = written(inner.mapInArrow(run, f"k {kind}, y int, x binary"), "quality-sample")
    order = Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, 0)  # at most ``limit`` rows of two numbers
    sizes = found.groupBy("k").agg(F.sum(F.octet_length("x") / 4).alias("n")).select("k", F.sum("n").over(order).alias("upto"))
    rows = found.join(F.broadcast(sizes.filter(F.col("upto") <= places).select("k")), "k", "left_semi").collect()
    rows.sort(key=lambda r: (str(r.k), bytes(r.x)))
    return train([np.frombuffer(bytes(r.x), dtype=np.int32) for r in rows], np.array([float(r.y) for r in rows]), len(metadata))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", column: str = "text", metadata: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """key, score double and predicted int for every row."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))  # its size is fixed by WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("quality")
        model = Machine(*sent.value)
        for b in batches:
            extra = list(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)) or [()] * b.num_rows
            scores = [model.score(features(t, m)) for t, m in zip(utf8(b.column(1)), extra, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["k", "score"])

    small_batches(docs.sparkSession)
    inner = docs.select(docs[key].alias("k"), docs[column].cast("string").alias("t"), *(docs[c].alias(f"m{i}") for i, c in enumerate(metadata)))
    out = inner.mapInArrow(run, f"k {kind}, score double")
    return out.select(F.col("k").alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
