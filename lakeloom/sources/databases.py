"""Tables in databases: one that a server keeps, or embedded ones, a database for each part of the table.

Spark brings embedded Derby along, and a database of it is open for writing in one process at a time, but readable by any number of
processes once it lies in an archive. So each task fills a database of its own and puts it as an archive into the shared folder;
Spark's JDBC source reads them all, on whichever executor.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an embedded database, and the least number of databases of a table.
ROWS, PARTS = 500_000, 4

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def served(df: DataFrame, key: str, options: dict) -> DataFrame:
    """The same rows by way of a new table of a database that all executors reach, read back in four parts by a whole-number key."""
    spark, name = df.sparkSession, f"lakeloom_{uuid.uuid4().hex}"
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    df.write.format("jdbc").options(**options, dbtable=name).save()
    parts = {"partitionColumn": key, "lowerBound": ends.low or 0, "upperBound": (ends.high or 0) + 1, "numPartitions": PARTS}
    return spark.read.format("jdbc").options(**options, dbtable=name, **parts).load()


def embedded(df: DataFrame, folder: str) -> DataFrame:
    """The same rows by way of embedded databases in a new folder, which goes when the application ends.

    The folder must be a mounted one, as Derby opens files; columns are whole numbers, decimals of up to 31 digits, doubles, flags,
    dates or strings.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = store.makeQualified(place).toUri()
    if uri.getScheme() != "file":
        raise ValueError("spark.checkpoint.dir must be mounted (file://...) for embedded databases; else name a database that all executors reach")
    store.mkdirs(place)
    store.deleteOnExit(place)
    columns = ", ".join(map(_column, df.schema))
    n = max(PARTS, -(-df.count() // ROWS))
    names = [r.name for r in df.repartition(n).mapInArrow(_filled(columns, uri.getPath()), "name string").collect()]
    parts = []
    for name in sorted(names):
        url = f"jdbc:derby:jar:({uri.getPath()}/{name})data"
        # a small cache of pages, as an executor keeps each database open that it has read; the driver asks for the columns and closes it
        options = {"driver": DERBY, "url": url, "dbtable": "part", "derby.storage.pageCacheSize": "40"}
        parts.append(spark.read.format("jdbc").options(**options).load())
        _closed(spark._jvm.java.sql.DriverManager.getConnection, url)
    while len(parts) > 1:  # by halves, so that no plan is deep
        parts = [a.unionAll(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) - len(parts) % 2 :]
    return parts[0] if parts else spark.createDataFrame([], df.schema)


def _column(field: T.StructField) -> str:
    kind = field.dataType.simpleString()
    return '"{}" {}'.format(field.name.replace('"', '""'), "clob" if kind == "string" else kind)


def _filled(columns: str, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts a task's rows into a database, and gives the name of its archive; that of a failed attempt has another name, which nobody reads."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import csv

        with tempfile.TemporaryDirectory() as own:
            own, writer = os.path.realpath(own), None
            for b in batches:
                if b.num_rows:
                    writer = writer or csv.CSVWriter(f"{own}/rows", b.schema, write_options=csv.WriteOptions(include_header=False))
                    writer.write_batch(b)
            if writer is None:
                return
            writer.close()
            with _derby(own) as connect:
                con = connect(f"jdbc:derby:{own}/data;create=true")
                con.createStatement().execute(f"CREATE TABLE part ({columns})")
                load = con.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'PART', ?, NULL, NULL, 'UTF-8', 0)")
                load.setString(1, f"{own}/rows")
                load.execute()
                con.close()
                _closed(connect, f"jdbc:derby:{own}/data")
            name = f"part-{uuid.uuid4().hex}.jar"
            with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_STORED) as out:  # stored, so that a page is found without reading those before it
                for f in sorted(Path(own, "data").rglob("*")):
                    if f.is_file() and f.suffix != ".lck":
                        out.write(f, f.relative_to(own))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return fill


@contextmanager
def _derby(own: str) -> Iterator[Callable]:
    """``DriverManager.getConnection`` of a Java process of the task's own, with Derby out of Spark's jars."""
    import pyspark
    from py4j.java_gateway import GatewayParameters, JavaGateway, launch_gateway

    jars = Path(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    java = ["-Xmx256m", "-XX:+UseSerialGC", "-Dderby.system.durability=test", f"-Dderby.stream.error.file={own}/derby.log"]  # no syncs: a lost database is made anew
    port, token, process = launch_gateway(
        jarpath=str(next(jars.glob("py4j-*.jar"))),
        classpath=os.pathsep.join(map(str, jars.glob("derby*.jar"))),
        javaopts=java,
        java_path=None,
        die_on_exit=True,
        enable_auth=True,
        return_proc=True,
    )
    try:
        gateway = JavaGateway(gateway_parameters=GatewayParameters(port=port, auth_token=token))
        yield gateway.jvm.java.sql.DriverManager.getConnection
        gateway.close()
    finally:
        process.kill()
        process.wait()


def _closed(connect: Callable, url: str) -> None:
    """Closes a database; Derby says by an exception of state 08006 that it is closed."""
    from py4j.protocol import Py4JJavaError

    try:
        connect(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":
            raise
