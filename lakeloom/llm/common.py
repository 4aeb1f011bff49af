"""What several operators share: words as bytes, vectorised word hashes, folders, Arrow helpers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, that is
``[^\\x20\\x09-\\x0D]+``. ``bytes.split()`` splits at exactly these bytes.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_kept: dict[str, Callable[[], None]] = {}
_user = ""
_tables: dict[int, str] = {}  # folders of the tables that written gave


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Registers how an operator's tables in a worker are dropped."""
    _kept[name] = drop


def in_worker(name: str) -> None:
    """Called where an operator's work in a worker begins. Workers serve one operator after another;
    what the others keep there is dropped and its memory given back, so that it doesn't add up."""
    global _user
    if _user == name:
        return
    for other, drop in _kept.items():
        if other != name:
            drop()
    if _user:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
    _user = name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the memory of an Arrow batch of texts; a smaller bound that the session has is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir.

    Where that is unset, in tests, it is a temporary folder; outside local mode executors would not
    share one, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.gettempdir() + "/lakeloom-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows reread from the shared folder: cuts lineage, survives lost executors.

    The table goes when the application ends, or earlier by ``dropped``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = path
    weakref.finalize(out, _tables.pop, id(out), None)
    return out


def dropped(table: DataFrame) -> None:
    """Removes a table that ``written`` gave and that nothing reads any more."""
    path = _tables.pop(id(table), None)
    if path:
        files, place = _file_system(table.sparkSession, path)
        files.delete(place, True)


def apart(keep: list[str] | tuple[str, ...], added: list[str] | tuple[str, ...]) -> list[str]:
    """Names of kept columns in a result: ``input_`` goes in front of one that an added column, or a column before it, has."""
    out: list[str] = []
    for name in keep:
        while name.lower() in {x.lower() for x in (*added, *out)}:
            name = f"input_{name}"
        out.append(name)
    return out


def text_column(df: DataFrame, column: str = "text"):
    """The text as a non-null string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one newline after each text, and where each text starts (one more entry than texts)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return buf, at


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[0::2], edge[1::2]


#: Bytes from which a word is hashed alone, by a hash of arbitrary long strings.
LONG_WORD = 256
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word's bytes, eight of them mixed in at a time; seeds give independent hashes."""
    size = end - start
    filled = np.zeros(len(buf) + 8, dtype=np.uint8)
    filled[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=filled, strides=(1,))  # from every byte on
    h = mix(size.astype(np.uint64) + _U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    if not len(size):
        return h
    h = mix(h ^ (eight[start] & _HEADS[np.minimum(size, 8)]))
    longer = np.flatnonzero(size > 8)
    done = 8
    while len(longer) and done < LONG_WORD:
        left = size[longer] - done
        h[longer] = mix(h[longer] ^ (eight[start[longer] + done] & _HEADS[np.minimum(left, 8)]))
        longer = longer[left > 8]
        done += 8
    for i in longer.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, salt=b"%d" % seed).digest(), "little")
    return h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two runs from theirs. What depends on the first is no linear function of it, so that
    no arrangement of equal parts cancels out."""
    x = a ^ (a >> _U(29))
    x *= _U(0xC2B2AE3D27D4EB4F)
    x += b
    return mix(x)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (len(h) - k + 1 of them), from runs of doubling length."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    out, have, level, width = None, 0, h, 1
    while True:
        if k & width:
            part = level[have : have + n - k + 1]
            out = part if out is None else _pair(out, part)
            have += width
        if 2 * width > k:
            return mix(out)
        level = _pair(level[:-width], level[width:])
        width *= 2


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes come to about the limit; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)

