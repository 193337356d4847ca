"""Sources and sinks: text columns, files, chunk tables."""

from __future__ import annotations

import itertools
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a folder, and characters and files that a task gives back at once.
FOLDER, LARGEST, MANY = 1000, 1 << 22, 256
CHUNKS = "doc_id long, seq long, chunk string, is_last boolean"
TIMED_CHUNKS = f"{CHUNKS}, at timestamp"


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """url and html of each file, decoded from UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html"))


def read_chunks(spark: SparkSession, path: str, streaming: bool = False, timed: bool = False, files_at_once: int | None = None) -> DataFrame:
    """Pieces of documents; timed: with the time of each. files_at_once: how many files a batch of a stream takes."""
    reader = (spark.readStream if streaming else spark.read).schema(TIMED_CHUNKS if timed else CHUNKS)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def write_nodes(nodes: DataFrame, path: str, key: str = "page_id") -> None:
    """Sorted by document and place, so that a document's rows stand together and its key range is in the footers."""
    nodes.sortWithinPartitions(key, "node_id").write.parquet(path)


def save_nodes(nodes: DataFrame, table: str, path: str | None = None, key: str = "page_id", buckets: int = 64) -> DataFrame:
    """The node table as a table of the catalog, dealt to buckets by document and sorted within: what is asked of it by
    document (`bucketed` says how) then shuffles nothing. path: where it lies, instead of the warehouse."""
    writer = nodes.write.bucketBy(buckets, key).sortBy(key, "node_id").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return nodes.sparkSession.table(table)


def bucketed(spark: SparkSession) -> SparkSession:
    """A session of the same application and catalog in which joins by document and node use buckets by document."""
    session = spark.newSession()
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return session


def write_html(df: DataFrame, path: str, column: str = "html", by: str | None = None) -> None:
    """Lines of text; by: in a folder for each value of another column."""
    rows = df.select(F.col(column).cast("string").alias("value"), *([by] if by else []))
    (rows.write.partitionBy(by) if by else rows.write).text(path)


def _qualified(spark: SparkSession, path: str) -> str:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def write_files(df: DataFrame, path: str, by: str, column: str = "html") -> None:
    """A file a row, named by the value of another column (by=value), in folders of FOLDER files. Tasks write them by Arrow's
    file systems: Hadoop's local one starts a process for each file and folder. A task that runs again writes the same names."""
    at, folder = _qualified(df.sparkSession, path), FOLDER
    fs.FileSystem.from_uri(at)[0].create_dir(fs.FileSystem.from_uri(at)[1])

    def write(batches):
        system, root = fs.FileSystem.from_uri(at)
        number, places = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                i = next(places)
                if i % folder == 0:
                    system.create_dir(f"{root}/{number:05d}-{i // folder:05d}")
                name = quote(key, safe="") if key is not None else "__HIVE_DEFAULT_PARTITION__"
                with system.open_output_stream(f"{root}/{number:05d}-{i // folder:05d}/{by}={name}-{i}.txt") as out:
                    out.write((text or "").encode())
        yield pa.RecordBatch.from_arrays([pa.array([next(places)], pa.int64())], ["n"])

    df.select(F.col(by).cast("string"), F.col(column).cast("string")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """url and html of each file of write_files, decoded from UTF-8. The driver lists the folders, tasks what is in them."""
    at, largest, many = _qualified(spark, path), LARGEST, MANY
    system, root = fs.FileSystem.from_uri(at)
    folders = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]

    def read(batches):
        own = fs.FileSystem.from_uri(at)[0]
        given = lambda held: pa.RecordBatch.from_arrays([pa.array([u for u, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())], ["url", "content"])
        held, size = [], 0
        for batch in batches:
            for inside in batch.column(0).to_pylist():
                for file in own.get_file_info(fs.FileSelector(inside)):
                    with own.open_input_stream(file.path) as found:
                        held.append((file.path, found.read()))
                    size += len(held[-1][1])
                    if size >= largest or len(held) >= many:
                        yield given(held)
                        held, size = [], 0
        yield given(held)

    rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(max(1, min(len(folders), 4096)))
    return rows.mapInArrow(read, "url string, content binary").select("url", F.decode("content", "UTF-8").alias("html"))


def drain(df: DataFrame) -> None:
    """Runs everything and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
