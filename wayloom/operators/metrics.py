"""Counters and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of latency buckets in seconds, and log lines a second.
BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 15.0)
LINES = 20


def histogram(df: DataFrame, by: str, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, bucket, n: cumulative counts of values up to each bound and of all.

    One aggregation with a counter for each bound; what is shuffled is a row a
    group and task.
    """
    counts = df.groupBy(by).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("all"))
    rows = [F.struct(F.lit(f"{round(b * 1000)} ms").alias("bucket"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(by, F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("bucket"), F.col("all").alias("n")))))


def nearest_rank(df: DataFrame, by: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles of each group, with the least and the most.

    Values are counted first, so equal ones are one row; ranks come from
    running counts over ranges of the sorted distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    pick = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p / 100) * F.col("total")), F.lit(1)), F.col(value)))
    return ranked.groupBy(by).agg(*[pick(p).alias(f"p{p}") for p in percents], F.min(value).alias("least"), F.max(value).alias("most"))


def glyph_blocks(df: DataFrame, text: str) -> DataFrame:
    """block, n, glyphs: characters and distinct characters of each block of 256 code points."""
    chars = df.select(F.explode(F.split(text, "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return chars.groupBy(F.floor(F.ascii("c") / 256).alias("block")).agg(F.sum("n").alias("n"), F.count("*").alias("glyphs"))


def capped(df: DataFrame, second: str, order: list[str], exempt: Column, lines: int = LINES) -> DataFrame:
    """df with `kept`: the first lines of each second, and all that are exempt."""
    n = F.row_number().over(Window.partitionBy(second, "_exempt").orderBy(*order))
    return df.withColumn("_exempt", exempt).withColumn("kept", F.col("_exempt") | (n <= lines)).drop("_exempt")
