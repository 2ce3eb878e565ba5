"""Written tables that cut lineage: Parquet in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries to give files different numbers of 31 bits.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and the master is local, as in tests, a temporary folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='wayloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def swept(spark: SparkSession) -> None:
    """Executors collect their garbage: heap that a stage has touched stays with an executor's JVM until it does, beside the workers of the next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def settled(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df, written once to the shared folder and read back; the files go when the session's JVM ends.

    Nothing of df is computed again, and an executor that is lost takes
    nothing along.  The collection that follows lets Spark's cleaner drop the
    shuffle files that only df still needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=codec)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    del df
    jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, name: str = "row_key") -> DataFrame:
    """df with a long column of that name that no two rows share.

    A row's file and its place there give the number, so it is the same
    whenever, and over however many cores, df is read.  What is not a plain
    scan of files is written first.
    """
    plain = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    try:
        plain = plain and bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        plain = False
    if not plain:
        df = settled(df)
    number = lambda path, salt: F.shiftrightunsigned(F.xxhash64(path, F.lit(salt)), 33)
    files = df.select(F.col("_metadata.file_path").alias("path")).distinct()
    n, *distinct = files.agg(F.count("*"), *[F.countDistinct(number("path", i)) for i in range(SALTS)]).first()
    salt = distinct.index(n)
    return df.select("*", F.shiftleft(number(F.col("_metadata.file_path"), salt), 32).bitwiseOR(F.col("_metadata.row_index")).alias(name))
