"""What is kept between stages, in the folder that all executors share; and one row of each key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most repeated keys that are sent to all tasks (about 40 bytes each); with more of them the rows are shuffled.
MOST_REPEATED = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a temporary one is made, on one machine only: a cluster
    without a shared folder is an error."""
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="newsloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder; removed when the application ends, unless it is to be kept."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not keep:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage, survives lost executors."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df as reliable checkpoint files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_files(df: DataFrame) -> bool:
    """Are the rows of df rows of files that number them, so that each has a place of its own?"""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    return any("row_index" in hidden.apply(i).dataType().simpleString() for i in range(hidden.size()))


def one_of_each(df: DataFrame, key: str, columns: list[str | Column], most: int = MOST_REPEATED) -> DataFrame:
    """One row (key, *columns) for each non-null key; rows of a key are taken to be equal in these columns.

    Only keys and places of rows are shuffled: of a key that comes again the row with the least hash of its place is
    kept, the others are dropped while the files are read. Rows that aren't in files, and keys of which more than `most`
    come again, go through a shuffle. Where the files give fewer tasks than there are cores, the rows are spread.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull())
    names = rows.select(key, *columns).columns
    if not in_files(df):
        return rows.select(key, *columns).dropDuplicates([key])
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    counts = rows.select(F.col(key).alias("_key"), place.alias("_at")).groupBy("_key").agg(F.min("_at").alias("_kept"), F.count("*").alias("_n"))
    repeated = written(counts.where("_n > 1").select("_key", "_kept"), "repeated")
    if repeated.limit(most + 1).count() > most:
        return rows.select(key, *columns).dropDuplicates([key])
    once = rows.select(key, *columns, place.alias("_at")).join(F.broadcast(repeated), F.col(key) == F.col("_key"), "left")
    out = once.where("_key is null or _at = _kept").select(*names)
    cores = spark.sparkContext.defaultParallelism
    if df.select(key)._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        out = out.repartition(cores, key)
    return out


def with_numbers(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """one_of_each with a column number: file << 40 | row, where file counts the sorted paths of df and row the rows of a
    file. The number stays the same however tasks are cut or repeated, and files added later by name leave it as it is.
    Rows that aren't in files are written first."""
    if not in_files(df):
        df = written(df.select(key, *columns), "numbered")
    plain = lambda path: F.regexp_replace(path, r"^([a-z0-9]+):/+", "$1:/")
    files = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(sorted(df.inputFiles()))], "_file string, _ordinal long")
    out = one_of_each(df, key, [*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")])
    found = F.coalesce("_ordinal", F.raise_error(F.concat(F.lit("unknown file "), F.col("_path"))).cast("long"))
    return out.join(F.broadcast(files), plain("_path") == plain("_file"), "left").select(key, *columns, (F.shiftleft(found, 40) + F.col("_row")).alias("number"))
