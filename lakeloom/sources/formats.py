"""Sources and sinks: file formats, partitioned folders, binary files, a registry of readers (``captured`` has the Python data source).

Round trips write to the shared folder of the session and read back with a declared schema. Object
stores are paths of the same readers (``s3a://...``) where the cluster has their file system.
"""

from __future__ import annotations

import hashlib
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources import databases
from lakeloom.sources.tables import table

registry = Registry()

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str) -> Callable:
    """Registers how a named source is read; a variant of a deployment is a choice of names."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        READERS[name] = f
        return f

    return add


@reader("web")
def web_pages(spark: SparkSession, d: str) -> DataFrame:
    """Captured pages as raw payloads."""
    return table(spark, d, "pages").select(F.lit("web").alias("source"), F.col("url").alias("key"), F.col("html").alias("payload"))


@reader("api")
def api_records(spark: SparkSession, d: str) -> DataFrame:
    """JSON records as raw payloads."""
    return table(spark, d, "events").select(F.lit("api").alias("source"), F.col("event_id").cast("string").alias("key"), F.col("props").alias("payload"))


@reader("docs")
def plain_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts as raw payloads."""
    return table(spark, d, "documents").select(F.lit("docs").alias("source"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("payload"))


def read_sources(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Named sources in one frame of raw payloads; an unknown name is an error."""
    unknown = [n for n in names if n not in READERS]
    if unknown or not names:
        raise ValueError(f"unknown sources: {unknown}" if unknown else "no sources named")
    out = READERS[names[0]](spark, d)
    for n in names[1:]:
        out = out.unionByName(READERS[n](spark, d), allowMissingColumns=True)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared folder; in a temporary one where none is named, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/lakeloom-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def version(spark: SparkSession, path: str) -> str:
    """A digest of the files below a path: their names, lengths and times of change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()


_stored: dict[int, str] = {}  # folders of the tables that stored gave


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, reread from a table in the shared folder: cuts lineage and survives lost executors.

    The table goes by ``removed``, or when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


def removed(df: DataFrame) -> None:
    """Removes a table that ``stored`` gave and that nothing reads any more."""
    if path := _stored.pop(id(df), None):
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def round_trip(df: DataFrame, kind: str, write: dict | None = None, read: dict | None = None) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.format(kind).options(**(write or {})).save(path)
    return spark.read.format(kind).schema(df.schema).options(**(read or {})).load(path)


def typed(spark: SparkSession, d: str, nested: bool) -> DataFrame:
    """Orders with a date, a time, an exact decimal, a flag, nulls and, where a format has them, a list and a record."""
    price = F.col("o_totalprice").cast("decimal(12,2)")
    nests = {"tags": F.array("note", F.lit("x")), "customer": F.struct(F.col("o_custkey").alias("id"), F.col("status").alias("of"))}
    df = table(spark, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderdate",
        F.when(F.col("o_orderkey") % 7 != 0, price).alias("price"),
        (F.col("o_totalprice") > 200_000).alias("dear"),
        F.concat(F.lit('a "quoted", text; '), "o_orderpriority").alias("note"),
    )
    return (df.withColumns(nests) if nested else df).drop("o_custkey")


_TYPED = """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CAST(o_orderdate AS DATE) AS day, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS price,
  o_totalprice > 200000 AS dear, 'a "quoted", text; ' || o_orderpriority AS note{nested} FROM orders
"""
_NESTED = ", 'a \"quoted\", text; ' || o_orderpriority AS tag_1, o_custkey AS customer_id, nullif(o_orderstatus, 'P') AS customer_of"


def _register(kind: str, write: dict | None = None, read: dict | None = None, nested: bool = True) -> None:
    @registry.query(f"io_{kind}", _TYPED.format(nested=_NESTED if nested else ""))
    def trip(spark: SparkSession, d: str) -> DataFrame:
        out = round_trip(typed(spark, d, nested), kind, write, read)
        return out.withColumns({"tag_1": F.col("tags")[0], "customer_id": F.col("customer.id"), "customer_of": F.col("customer.of")}).drop("tags", "customer") if nested else out


_register("parquet")
_register("orc")
_register("json")
_register("csv", {"header": "true", "escape": '"'}, {"header": "true", "escape": '"'}, nested=False)
_register("xml", {"rowTag": "order"}, {"rowTag": "order"})


#: Options of a database that all executors reach; where there is none, tables go to embedded databases in the shared folder.
JDBC: dict[str, str] = {}


@registry.query("io_jdbc", "SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(12,2)) AS balance FROM customer WHERE c_custkey >= 100")
def database(spark: SparkSession, d: str) -> DataFrame:
    """Written to a database and read back in four parts or more, with the filter pushed down to it."""
    df = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    out = databases.served(df, "c_custkey", JDBC) if JDBC else databases.embedded(df, scratch(spark, "jdbc"))
    return out.filter("c_custkey >= 100")


@registry.query("io_text", "SELECT c_name AS value FROM customer")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "text")
    table(spark, d, "customer").select("c_name").write.text(path)
    return spark.read.text(path)


@registry.query("io_partitioned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def partitioned(spark: SparkSession, d: str) -> DataFrame:
    """Only the folder of the asked status is read."""
    path = scratch(spark, "partitioned")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").parquet(path).filter("o_orderstatus = 'P'")


@registry.query("src_json_pages", "SELECT event_id, event_type, CAST(event_id // 500 AS BIGINT) AS page FROM events")
def json_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of an interface as captured JSON documents: each has its items and the number of the next page."""
    path = scratch(spark, "json-pages")
    page = F.floor(F.col("event_id") / 500).alias("page")
    items = F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("items")  # at most 500 of a page
    pages = table(spark, d, "events").groupBy(page).agg(items).withColumn("next", F.col("page") + 1)
    pages.write.json(path)
    found = spark.read.schema("page long, next long, items array<struct<event_id long, event_type string>>").json(path)
    return found.select("page", F.explode("items").alias("i")).select("i.event_id", "i.event_type", "page")


@registry.query(
    "src_registry",
    """
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(payload)) AS BIGINT) AS chars FROM (
  SELECT 'web' AS source, html AS payload FROM pages UNION ALL SELECT 'api', props FROM events UNION ALL SELECT 'docs', text FROM documents) AS t GROUP BY 1
""",
)
def all_sources(spark: SparkSession, d: str) -> DataFrame:
    df = read_sources(spark, d, ["web", "api", "docs"])
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).cast("long").alias("chars"))
