"""Captured pages of interfaces as a Spark source and sink: ``spark.read.format("captured")``, ``readStream``, ``write``.

A page is a JSON document with ``items`` and the name of the ``next`` page, as interfaces with cursors give
them. A write puts each row (name, content) into a file of its own, below a folder of the write, and then creates the
write's marker; readers know writes by their markers, so a write that fails leaves nothing that is read, and its
files are removed. A reader follows ``next`` from a first page as far as pages have been captured, and deals them
out to tasks, which read them; a stream goes on where it stopped when pages are added, and its offsets name
the next page, so a restart neither misses nor repeats one. A live connector would fetch where this opens files.

Paths are those that Arrow's file systems open (``file://``, ``s3://``, ``hdfs://`` and others) and must be seen by all
executors. Names are unique; of a name in several writes the last one's page counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lakeloom.plans.registry import Registry
from lakeloom.sources.formats import scratch
from lakeloom.sources.tables import table

registry = Registry()

#: Pages that a task reads.
PAGES = 20


class Store:
    """The folder of captured pages."""

    def __init__(self, path: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self._writes: list[str] | None = None

    def place(self, write: str, name: str, suffix: str = "json") -> str:
        """Files are dealt to at most 256 folders of a write."""
        return f"{self.root}/pages/{write}/{hashlib.sha256(name.encode()).hexdigest()[:2]}/{name}.{suffix}"

    def writes(self) -> list[str]:
        """Finished writes, the last first."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/writes", allow_not_found=True))
        return [x.base_name for x in sorted(found, key=lambda x: (x.mtime_ns or 0, x.base_name), reverse=True)]

    def find(self, name: str) -> str | None:
        """The file of a page, if it has been captured."""
        places = [self.place(w, name) for w in self.writes()]
        return next((x.path for x in self.files.get_file_info(places) if x.type == fs.FileType.File), None)

    def read(self, path: str) -> dict:
        with self.files.open_input_stream(path) as f:
            return json.loads(f.readall().decode())

    def put(self, path: str, content: bytes) -> None:
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(path) as f:
            f.write(content)

    def chain(self, first: str) -> Iterator[tuple[str, str, str | None]]:
        """Name, file and next name of the pages from one on, as far as they have been captured."""
        name: str | None = first
        seen = set()
        while name is not None and (path := self.find(name)):
            if name in seen:
                raise ValueError(f"page {name} comes again")
            seen.add(name)
            after = self.read(path).get("next")
            yield name, path, after
            name = after


class _Pages(InputPartition):
    def __init__(self, pages: list[tuple[str, str]]):
        super().__init__(None)
        self.pages = pages


def _items(store: Store, pages: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    for name, path in pages:
        items = store.read(path).get("items") or []
        yield pa.RecordBatch.from_pydict(
            {"page": pa.array([name] * len(items), pa.string()), "position": pa.array(range(len(items)), pa.int32()), "item": pa.array([json.dumps(x, ensure_ascii=False) for x in items], pa.string())}
        )


def _dealt(pages: list[tuple[str, str]], size: int) -> list[_Pages]:
    return [_Pages(pages[i : i + size]) for i in range(0, len(pages), size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.first, self.size = options["path"], options["first"], _size(options)

    def partitions(self) -> list[InputPartition]:
        return _dealt([(n, p) for n, p, _ in Store(self.path).chain(self.first)], self.size) or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        return _items(Store(self.path), partition.pages)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {"next": the page to read next, or "" after the last, "pages": how many came before}.

    Where the stream stands is known from its checkpoint; where the chain has been followed to is kept here and,
    when a batch is done, in the folder, so that a restart doesn't follow it from the first page.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.first, self.size = options["path"], options["first"], _size(options)
        self.reached: dict | None = None
        self.known: dict[str, tuple[str, str, str | None]] = {}

    def _progress(self, store: Store) -> str:
        return f"{store.root}/progress/{hashlib.sha256(self.first.encode()).hexdigest()[:16]}.json"

    def initialOffset(self) -> dict:
        return {"next": self.first, "pages": 0}

    def latestOffset(self) -> dict:
        store = Store(self.path)
        if self.reached is None:
            kept = store.files.get_file_info(self._progress(store))
            self.reached = store.read(kept.path) if kept.type == fs.FileType.File else self.initialOffset()
        at = dict(self.reached)
        if at["next"]:
            for name, path, after in store.chain(at["next"]):
                self.known[name] = (name, path, after)
                at = {"next": after or "", "pages": at["pages"] + 1}
        self.reached = at
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        count = end["pages"] - start["pages"]
        store, name, pages = Store(self.path), start["next"], []
        while len(pages) < count:
            name_, path, after = self.known.get(name) or next(store.chain(name))
            pages.append((name_, path))
            name = after
        return _dealt(pages, self.size) or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[pa.RecordBatch]:
        return _items(Store(self.path), partition.pages)

    def commit(self, end: dict) -> None:
        store = Store(self.path)
        store.put(self._progress(store), json.dumps(end).encode())
        self.known.clear()


@dataclass
class _Written(WriterCommitMessage):
    pages: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.write_id = options["path"], options.get("suffix", "json"), uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        store, n = Store(self.path), 0
        for row in iterator:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"no name of a page: {row['name']!r}")
            store.put(store.place(self.write_id, row["name"], self.suffix), (row["content"] or "").encode())
            n += 1
        return _Written(n)

    def commit(self, messages: list) -> None:
        store = Store(self.path)
        store.put(f"{store.root}/writes/{self.write_id}", str(sum(m.pages for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        store = Store(self.path)
        if store.files.get_file_info(f"{store.root}/pages/{self.write_id}").type == fs.FileType.Directory:
            store.files.delete_dir(f"{store.root}/pages/{self.write_id}")


def _size(options: dict[str, str]) -> int:
    size = int(options.get("pages", PAGES))
    if size < 1:
        raise ValueError("a task reads one page at least")
    return size


class CapturedSource(DataSource):
    """Options: ``path``; for writing ``suffix``, of the files' names; for reading ``first``, the name of the first page, and ``pages``, how many a task reads."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return "page string, position int, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("captured pages are only added to")
        return _Writer(self.options)


def event_pages(spark: SparkSession, d: str, size: int = 500) -> DataFrame:
    """name and content of the pages of an interface to the events: so many ids each, some of them without an event."""
    events = table(spark, d, "events").select(F.floor(F.col("event_id") / size).alias("number"), F.struct("event_id", "event_type", "user_id").alias("item"))
    lists = events.groupBy("number").agg(F.array_sort(F.collect_list("item")).alias("items"))  # at most one item for each id of a page
    last = events.agg(F.max("number").alias("last")).first().last
    numbers = spark.range(0 if last is None else last + 1).withColumnRenamed("id", "number")
    after = F.when(F.col("number") < (last or 0), F.concat(F.lit("page-"), F.col("number") + 1))
    return numbers.join(lists, "number", "left").select(F.concat(F.lit("page-"), "number").alias("name"), F.to_json(F.struct(after.alias("next"), "items")).alias("content"))


def capture(pages: DataFrame, path: str, suffix: str = "json") -> None:
    """Adds pages (name, content) to a folder, a file for each."""
    pages.sparkSession.dataSource.register(CapturedSource)
    pages.write.format("captured").mode("append").option("path", path).option("suffix", suffix).save()


def items(spark: SparkSession, path: str, first: str, stream: bool = False) -> DataFrame:
    """page, position and item (JSON) of the pages that follow from the first one."""
    spark.dataSource.register(CapturedSource)
    return (spark.readStream if stream else spark.read).format("captured").option("path", path).option("first", first).load()


_SQL = "SELECT event_id, event_type, user_id, 'page-' || (event_id // 500) AS page FROM events"


def _parsed(df: DataFrame) -> DataFrame:
    item = F.from_json("item", "event_id long, event_type string, user_id long")
    return df.select(item.alias("i"), "page").select("i.*", "page")


@registry.query("src_paged", _SQL)
def paged(spark: SparkSession, d: str) -> DataFrame:
    """The events through captured pages, following ``next``."""
    path = scratch(spark, "captured")
    capture(event_pages(spark, d), path)
    return _parsed(items(spark, path, "page-0"))


@registry.query("src_paged_stream", _SQL)
def paged_stream(spark: SparkSession, d: str) -> DataFrame:
    """R3 as a stream that stops and goes on: a first half of the pages, and after a restart from the checkpoint the rest."""
    path, out, checkpoint = (scratch(spark, n) for n in ("captured", "paged", "checkpoint"))
    pages = event_pages(spark, d).withColumn("half", F.substring_index("name", "-", -1).cast("long") >= F.lit(_half(spark, d)))
    schema = "event_id long, event_type string, user_id long, page string"
    for later in (False, True):
        capture(pages.filter(F.col("half") == later).drop("half"), path)
        q = _parsed(items(spark, path, "page-0", stream=True)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return spark.read.schema(schema).parquet(out)


def _half(spark: SparkSession, d: str) -> int:
    return (table(spark, d, "events").agg(F.max("event_id").alias("n")).first().n or 0) // 1000 + 1


def html_folder(spark: SparkSession, d: str) -> str:
    """Captured web pages as files, in a bounded number of folders."""
    path = scratch(spark, "html")
    capture(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("content")), path, "html")
    return f"{path}/pages"


@registry.query("src_html_files", "SELECT CAST(page_id AS BIGINT) AS page_id, CAST(length(html) AS BIGINT) AS chars, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_files(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages as files, each read whole, with its key from its name."""
    pages = spark.read.schema("value string").option("recursiveFileLookup", "true").text(html_folder(spark, d), wholetext=True)
    key = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.html$", 1).cast("long")
    return pages.select(key.alias("page_id"), F.length("value").cast("long").alias("chars"), F.regexp_extract("value", '<html lang="([a-z]+)"', 1).alias("lang"))


@registry.query("io_binary_files", "SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS digest FROM pages")
def binary_files(spark: SparkSession, d: str) -> DataFrame:
    """Files as rows of bytes, as for captured documents: their keys, lengths and digests."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(html_folder(spark, d))
    key = F.regexp_extract("path", r"/(\d+)\.html$", 1).cast("long")
    return found.select(key.alias("page_id"), F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))
