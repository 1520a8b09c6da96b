"""What operators need from the session: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests on one machine), a temporary folder takes its place and is set; it goes when the driver ends.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = f"file://{tempfile.gettempdir()}/quire-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", got)
        atexit.register(shutil.rmtree, got.removeprefix("file://"), ignore_errors=True)
    return got


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialises df in the shared folder, so that a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager)


class Stored:
    """df written to the shared folder as compressed Parquet, for what is large: checkpoints aren't compressed, and their
    shuffle files stay until the driver collects garbage. Here those of the write go as it ends, the rows by drop()."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = spark._jvm.org.apache.hadoop.fs.Path(uri := f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}")
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.deleteOnExit(self.path)
        before = spark.conf.get(self.CLEANUP, None)
        spark.conf.set(self.CLEANUP, "true")
        try:
            df.select("*").write.option("compression", "zstd").parquet(uri)
        finally:
            spark.conf.set(self.CLEANUP, before) if before is not None else spark.conf.unset(self.CLEANUP)
        self.df = spark.read.schema(df.schema).parquet(uri)

    def drop(self) -> None:
        self.files.delete(self.path, True)


def spread(df: DataFrame, *columns: Column | str) -> DataFrame:
    """df over as many tasks as shuffles have, at least two a core: for few bytes that take much work each."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)


def busy(df: DataFrame) -> DataFrame:
    """df, spread if it comes in fewer partitions than there are cores: for scans of one small file that feed much work."""
    few = df._jdf.rdd().getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return spread(df) if few else df


def largest(df: DataFrame, by: str, most: int) -> DataFrame:
    """The rows of df with the largest values of `by` (a positive count), at most `most` of them; df is read twice, so cut it.

    The threshold comes from a histogram of sixteenths of powers of two (about a thousand bins whatever the data), so the
    driver sees the bins and never a list of rows from each partition. Rows of one bin stay or go together.
    """
    place = F.floor(F.log2(F.col(by).cast("double")) * 16).cast("int")
    bins = sorted(((r[0], r[1]) for r in df.where(F.col(by) > 0).groupBy(place.alias("place")).agg(F.count("*")).collect()), reverse=True)
    total, floor = 0, None
    for at, n in bins:
        total += n
        if total > most:
            break
        floor = at
    return df.where((F.col(by) > 0) & (place >= floor)) if floor is not None else df.where("false")


def micros(column: str):
    """A TIMESTAMP_NTZ as microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def month(column: str):
    """'YYYY-MM' of a TIMESTAMP_NTZ."""
    return F.format_string("%04d-%02d", F.year(column), F.month(column))
