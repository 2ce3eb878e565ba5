"""Metrics as text, one sample a line: read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SAMPLE = r"^\s*([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)(?:\s+\S+)?\s*$"


def samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with name, labels (map) and value of each sample; comments and lines that are none are left out."""
    c = F.col(line)
    pairs = F.regexp_extract_all(F.regexp_extract(c, _SAMPLE, 2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="([^"]*)"'), F.lit(0))
    entry = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, r'="([^"]*)"', 1).alias("value"))
    number = F.expr(f"try_cast(regexp_extract({line}, '{_SAMPLE.replace(chr(92), chr(92) * 2)}', 3) as double)")
    kept = lines.filter(c.rlike(_SAMPLE) & ~F.ltrim(c).startswith("#"))
    return kept.withColumn("name", F.regexp_extract(c, _SAMPLE, 1)).withColumn("labels", F.map_from_entries(F.transform(pairs, entry))).withColumn("sample", number)


def value_of(found: DataFrame, by: list[str], name: str, labels: dict[str, str] | None = None) -> DataFrame:
    """by, value: the first sample of a name that has all the labels, by `line_no`; 0 where there is none."""
    hit = F.col("name") == name
    for k, v in (labels or {}).items():
        hit = hit & F.coalesce(F.col("labels")[k] == v, F.lit(False))
    return found.groupBy(*by).agg(F.coalesce(F.min(F.when(hit, F.struct("line_no", "sample")))["sample"], F.lit(0.0)).alias("value"))


def exposed(name: str, value: Column, labels: dict[str, Column] | None = None) -> Column:
    """A sample's line."""
    said = [F.concat(F.lit(f'{k}="'), v.cast("string"), F.lit('"')) for k, v in (labels or {}).items()]
    inside = F.concat(F.lit("{"), F.concat_ws(",", *said), F.lit("}")) if said else F.lit("")
    return F.concat(F.lit(name), inside, F.lit(" "), value.cast("string"))
