"""Exchange of packed arrays between chunks of documents and buckets of keys.

Documents are dealt to chunks by a hash of their id, keys (hashes of windows, shingles) to
buckets by their value. A chunk sends each bucket one packed row of sorted arrays, in which a key
occurs once however many of the chunk's documents have it; a bucket sorts what it gets and sends
each chunk one packed row back. So a key that a third of all documents share costs a bucket one
entry for each chunk, and nothing is kept whole on the driver or in one task.

Chunks and buckets are groups of ``applyInArrow``: one is in memory at a time, and their number
grows with the stored size of the input, so their size does not. As each of n chunks may have
something for each of n buckets, beyond ``DIRECT`` chunks rows go by relays: a chunk sends one row
to each of about sqrt(n) ranges of buckets, and a relay, one for each range of chunks and range of
buckets, sends one row to each bucket of its range. Each hop then has about n ** 1.5 rows instead
of n ** 2, and a relay holds about as much as a chunk.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import in_worker, small_batches, utf8

ROW = "source int, target int, packed binary"
#: Bytes of stored input for each chunk.
CHUNK_BYTES = 8_000_000
#: A small input is dealt to so many chunks, if each then has half a megabyte.
SPREAD, LEAST_BYTES = 12, 500_000
#: Chunks up to which rows go straight to their target, at most a million of them.
DIRECT = 1024
NO_ID = np.iinfo(np.int64).max  # a null id: no document's id is greater
_U32 = np.uint32


@dataclass
class Part:
    """Entries of one kind: for each its peer (where it goes to, or came from), numbers, and bytes if it has any."""

    peer: np.ndarray
    columns: list[np.ndarray]
    sizes: np.ndarray | None = None
    raw: np.ndarray | None = field(default=None, repr=False)

    def range(self, i: int, j: int, at: np.ndarray | None) -> Part:
        out = Part(self.peer[i:j], [c[i:j] for c in self.columns])
        if self.sizes is not None:
            out.sizes, out.raw = self.sizes[i:j], self.raw[at[i] : at[j]]
        return out


def _ends(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def part(peer: np.ndarray, columns: list[np.ndarray], strings: list[bytes] | None = None) -> Part:
    """Entries in the order of their peer, otherwise as they come."""
    peer = np.asarray(peer, dtype=np.int64)
    if len(peer) > 1 and (np.diff(peer) < 0).any():
        order = np.argsort(peer, kind="stable")
        peer, columns = peer[order], [c[order] for c in columns]
        strings = None if strings is None else [strings[i] for i in order]
    if strings is None:
        return Part(peer, columns)
    return Part(peer, columns, np.array([len(x) for x in strings], dtype=_U32), np.frombuffer(b"".join(strings), dtype=np.uint8))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value: byte planes, so that small numbers cost little; 64-bit keys as differences."""
    head = struct.pack("<B", len(arrays))
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += struct.pack("<2sI", a.dtype.str[1:].encode(), len(a))
        if a.dtype == np.uint64 and len(a):
            a = np.diff(a, prepend=np.uint64(0))
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes())
    return zstandard.compress(head + b"".join(body), 1)


def unpack(packed: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(packed)
    n, at = data[0], 1
    kinds = [struct.unpack_from("<2sI", data, at + 6 * i) for i in range(n)]
    at += 6 * n
    out = []
    for kind, size in kinds:
        dtype = np.dtype("<" + kind.decode())
        raw = np.frombuffer(data, dtype=np.uint8, count=size * dtype.itemsize, offset=at)
        at += len(raw)
        a = np.ascontiguousarray(raw.reshape(dtype.itemsize, size).T).view(dtype).ravel() if dtype.itemsize > 1 else raw.view(dtype)
        out.append(np.cumsum(a, dtype=np.uint64) if dtype == np.uint64 else a)
    return out


def _packed(parts: list[Part], with_peer: bool) -> bytes:
    arrays = []
    for p in parts:
        if with_peer:
            arrays.append(p.peer.astype(_U32))
        arrays += p.columns
        if p.sizes is not None:
            arrays += [p.sizes, p.raw]
    return pack([np.array([with_peer], dtype=np.uint8), *arrays])


@dataclass(frozen=True)
class Kind:
    """How many columns a part has, of what types, and whether its entries have bytes."""

    dtypes: tuple
    ragged: bool = False


def _parts(rows: pa.Table, kinds: tuple[Kind, ...]) -> list[Part]:
    """All entries of a group's rows, their peers as packed, or the row's source."""
    found: list[list[list[np.ndarray]]] = [[] for _ in kinds]
    if rows.num_rows:
        for source, packed in zip(rows.column("source").to_pylist(), rows.column("packed").to_pylist(), strict=True):
            flag, *arrays = unpack(packed)
            at = 0
            for f, kind in zip(found, kinds, strict=True):
                width = len(kind.dtypes) + 2 * kind.ragged
                peer = [arrays[at]] if flag[0] else []
                at += len(peer)
                own = arrays[at : at + width]
                at += width
                f.append([peer[0].astype(np.int64) if peer else np.full(len(own[0]), source, dtype=np.int64), *own])
    out = []
    for f, kind in zip(found, kinds, strict=True):
        types = [np.int64, *kind.dtypes, *([_U32, np.uint8] if kind.ragged else [])]
        columns = [np.concatenate([x[i] for x in f]) if f else np.zeros(0, dtype=t) for i, t in enumerate(types)]
        n = 1 + len(kind.dtypes)
        out.append(Part(columns[0], columns[1:n], *columns[n:]))
    return out


def _rows(source: int, parts: list[Part], width: int) -> pa.Table:
    """One row for each target, or for each ``width`` targets; the parts' peers are targets, in order."""
    targets = np.unique(np.concatenate([p.peer // width for p in parts])).tolist()
    places = [(np.searchsorted(p.peer // width, targets), np.searchsorted(p.peer // width, targets, side="right"), None if p.sizes is None else _ends(p.sizes)) for p in parts]
    packed = [_packed([p.range(int(i[t]), int(j[t]), at) for p, (i, j, at) in zip(parts, places, strict=True)], width > 1) for t in range(len(targets))]
    return pa.table({"source": pa.array([source] * len(targets), pa.int32()), "target": pa.array(targets, pa.int32()), "packed": pa.array(packed, pa.binary())})


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of uniform 64-bit keys; monotone, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def stored_size(df: DataFrame, column: str) -> int:
    """Bytes of the files that the rows come from; of other rows, half of their texts' bytes, by one pass."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            return int(df.agg(F.sum(F.octet_length(df[column].cast("string")))).first()[0] or 0) // 2
        size += int(leaf.relation().sizeInBytes())
    return size


def number_of_chunks(size: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks of an input of this stored size: in proportion, so that a chunk's memory doesn't grow."""
    return int(max(1, -(-size // chunk_bytes), min(SPREAD, size // LEAST_BYTES)))


def chunked(df: DataFrame, n: int, key: str, column: str) -> DataFrame:
    """chunk int, id long, text string: what the exchanges need of each document. Ids are whole numbers, or their digits as text."""
    small_batches(df.sparkSession)
    identity = df[key].cast("long")
    return df.select(F.pmod(F.xxhash64(identity), F.lit(n)).cast("int").alias("chunk"), identity.alias("id"), df[column].cast("string").alias("text"))


def of_chunk(table: pa.Table) -> tuple[int, np.ndarray, list[bytes]]:
    """Number, ids (null: NO_ID) and texts of a chunk."""
    in_worker("packed")
    if not table.num_rows:
        return -1, np.zeros(0, dtype=np.int64), []
    ids = np.array([NO_ID if x is None else x for x in table.column("id").to_pylist()], dtype=np.int64)
    return table.column("chunk")[0].as_py(), ids, utf8(table.column("text").combine_chunks())


@dataclass(frozen=True)
class Exchange:
    """Exchanges between n chunks and n buckets, by relays where there are more than ``direct``."""

    n: int
    direct: int = DIRECT

    @property
    def width(self) -> int:
        return 1 if self.n <= self.direct else math.isqrt(self.n - 1) + 1

    def _relayed(self, sent: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
        width = self.width
        if width == 1:
            return sent

        def relay(table: pa.Table) -> pa.Table:
            in_worker("packed")
            first = table.column("source")[0].as_py() // width
            out, rows = [], table.sort_by("source")
            sources = rows.column("source").to_pylist()
            every = [_parts(rows.slice(i, 1), kinds) for i in range(len(sources))]
            for k, kind in enumerate(kinds):
                mine = [e[k] for e in every]
                target = np.concatenate([p.peer for p in mine])
                origin = np.repeat(np.array(sources, dtype=np.int64), [len(p.peer) for p in mine])
                columns = [np.concatenate([p.columns[c] for p in mine]) for c in range(len(kind.dtypes))]
                strings = [s for p in mine for s in split(p)] if kind.ragged else None
                out.append(part(target, [*columns, origin], strings))
            return _rows_of_relay(first, out)

        return sent.groupBy((F.col("source") / width).cast("int").alias("from"), "target").applyInArrow(relay, ROW)

    def to_buckets(self, docs: DataFrame, run: Callable[[pa.Table], list[Part]], kinds: tuple[Kind, ...]) -> DataFrame:
        """What ``run`` makes of each chunk, sent to the parts' buckets."""
        width = self.width

        def go(table: pa.Table) -> pa.Table:
            return _rows(table.column("chunk")[0].as_py(), run(table), width)

        return self._relayed(docs.groupBy("chunk").applyInArrow(go, ROW), kinds)

    def to_buckets_with(self, docs: DataFrame, answers: DataFrame, run: Callable[[pa.Table, list[Part]], list[Part]], got: tuple[Kind, ...], kinds: tuple[Kind, ...]) -> DataFrame:
        """The same for chunks with what buckets have answered them."""
        width = self.width

        def go(table: pa.Table, rows: pa.Table) -> pa.Table:
            chunk = (table.column("chunk") if table.num_rows else rows.column("target"))[0].as_py()
            return _rows(chunk, run(table, _parts(rows, got)), width)

        return self._relayed(docs.groupBy("chunk").cogroup(answers.groupBy("target")).applyInArrow(go, ROW), kinds)

    def to_chunks(self, sent: DataFrame, run: Callable[[list[Part]], list[Part]], got: tuple[Kind, ...], kinds: tuple[Kind, ...]) -> DataFrame:
        """What ``run`` makes of each bucket's entries, whose peers are the chunks they came from, sent to the parts' chunks."""
        width = self.width

        def go(rows: pa.Table) -> pa.Table:
            in_worker("packed")
            return _rows(rows.column("target")[0].as_py(), run(_parts(rows, got)), width)

        return self._relayed(sent.groupBy("target").applyInArrow(go, ROW), kinds)

    def with_answers(self, docs: DataFrame, answers: DataFrame, run: Callable[[pa.Table, list[Part]], pa.Table], got: tuple[Kind, ...], schema: str) -> DataFrame:
        """Each chunk with what buckets have answered it; a chunk without answers still runs."""
        return docs.groupBy("chunk").cogroup(answers.groupBy("target")).applyInArrow(lambda table, rows: run(table, _parts(rows, got)), schema)


def split(p: Part) -> list[bytes]:
    """The bytes of each entry."""
    ends, raw = _ends(p.sizes), p.raw.tobytes()
    return [raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _rows_of_relay(source: int, parts: list[Part]) -> pa.Table:
    """One row for each target; the last column of each part is where its entries came from."""
    targets = np.unique(np.concatenate([p.peer for p in parts])).tolist()
    packed = []
    places = [(np.searchsorted(p.peer, targets), np.searchsorted(p.peer, targets, side="right"), None if p.sizes is None else _ends(p.sizes)) for p in parts]
    for t in range(len(targets)):
        own = [p.range(int(i[t]), int(j[t]), at) for p, (i, j, at) in zip(parts, places, strict=True)]
        for p in own:
            p.peer = p.columns.pop()
        packed.append(_packed(own, True))
    return pa.table({"source": pa.array([source] * len(targets), pa.int32()), "target": pa.array(targets, pa.int32()), "packed": pa.array(packed, pa.binary())})
