"""Operator 7, exact dedup: a log-structured merge index of text digests.

Memtables: each read task digests its rows and flushes them as one run, sorted
by digest (a Parquet file in the shared folder, whose row groups carry the
range of their digests).  Compaction merges runs, and levels compacted before,
by digest: how many rows, and the identifier that stays.  The compacted level
answers every row by a join on the digest; digests that more than a
thousandth of all rows have, a thousand at most, are broadcast instead.

Hits are rows whose digest the level holds more than once.  They are verified
byte by byte: a filter over the repeated digests (a bitmap of 16 bits a digest,
at most MAX_FILTER_BITS; beyond that there is none) picks them where texts are
read, equal texts fold before the shuffle, and a digest whose least and
largest bytes differ holds several texts, which are then told apart.  The text
of a row that repeats nothing is never shuffled.

Only DataFrame functions: no Python runs on the executors.

Defined results: null counts as empty; texts are equal when identical after
lower-casing A-Z only; of rows that tie on the doc_id that stays, one stays;
a null doc_id is the least; each row gives a row; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import numbered, settled
from .substring_dedup import NULL_KEY

#: Bits of the filter for each repeated digest; log2 of its size at least (one of Spark's bitmaps) and at most.
BITS_EACH, BITMAP_BITS, MAX_FILTER_BITS = 16, 15, 30
#: A digest of more than this part of all rows is hot.
HOT_PART = 1000
DIGEST_BITS = 64


def normalised(text: Column) -> Column:
    """A-Z in lower case, all else as it is; ASCII texts take the faster function."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest_of(norm: str, bits: int = DIGEST_BITS) -> Column:
    """The upper bits of a 64-bit hash; fewer than 64 only to try collisions."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(norm), DIGEST_BITS - bits), DIGEST_BITS - bits) if bits < DIGEST_BITS else F.xxhash64(norm)


def flush(rows: DataFrame, bits: int = DIGEST_BITS, named: bool = True) -> DataFrame:
    """Memtables of (doc_key, row, text) become runs of (digest, id, sha), each sorted by digest."""
    digested = rows.select(F.struct("doc_key", "row").alias("id"), normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of("norm", bits))
    sha = F.unhex(F.sha2("norm", 256)) if named else F.lit(None).cast("binary")
    return settled(digested.select("digest", "id", sha.alias("sha")).sortWithinPartitions("digest"))


def compact(*runs: DataFrame, keep: str = "largest") -> DataFrame:
    """One level from runs (digest, id) and levels (digest, rows, stays): how many rows a digest has and which of them stays."""
    best = {"largest": F.max, "least": F.min}[keep]
    entry = lambda r: r.select("digest", "rows", "stays") if "stays" in r.columns else r.select("digest", F.lit(1).cast("long").alias("rows"), F.col("id").alias("stays"))
    merged = entry(runs[0])
    for run in runs[1:]:
        merged = merged.union(entry(run))
    return merged.groupBy("digest").agg(F.sum("rows").alias("rows"), best("stays").alias("stays"))


class Filter:
    """A bitmap over digests in pieces of 4 KB, as large as their number asks for."""

    def __init__(self, level: DataFrame) -> None:
        self.bits = max(BITMAP_BITS, math.ceil(math.log2(BITS_EACH * max(1, level.count()))))
        place = self._place()
        pieces = level.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("piece"))
        self.pieces = F.broadcast(pieces) if self.bits <= MAX_FILTER_BITS else None

    def _place(self) -> Column:
        return F.shiftrightunsigned("digest", 64 - self.bits)

    def mark(self, rows: DataFrame) -> DataFrame:
        """rows with a column `hit`: whether the filter may hold their digest; true for all where there is no filter."""
        if self.pieces is None:
            return rows.withColumn("hit", F.lit(True))
        at = F.bitmap_bit_position(self._place())
        octet = F.conv(F.hex(F.substring(F.col("piece"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))
        marked = rows.join(self.pieces, F.bitmap_bucket_number(self._place()) == F.col("bucket"), "left")
        return marked.withColumn("hit", F.coalesce(octet.bitwiseAND(mask) > 0, F.lit(False))).drop("bucket", "piece")


class Index:
    """Runs of all rows, the level they compact to, and what byte verification found.

    rows: doc_key, row (which no two rows share), text.
    """

    def __init__(self, rows: DataFrame, keep: str, bits: int = DIGEST_BITS, named: bool = True) -> None:
        self.rows, self.bits = rows, bits
        self.runs = flush(rows, bits, named)
        self.level = settled(compact(self.runs, keep=keep).filter("rows > 1"))
        self.filter = Filter(self.level)
        self._split(keep)
        hot = F.col("rows") * HOT_PART > self.runs.count()
        self.hot, self.rest = F.broadcast(self.level.filter(hot)), self.level.filter(~hot)

    def digested(self, *columns: str) -> DataFrame:
        """Rows as they are read, with digest, normalised text and `hit`."""
        return self.filter.mark(self.rows.select(*columns, normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of("norm", self.bits)))

    def _split(self, keep: str) -> None:
        """Verifies hits byte by byte; digests of several texts leave the level and get a level of their own, by text."""
        ends = self.digested().filter("hit").groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
        several = settled(ends.filter("a <> b").select("digest"))
        self.several = None
        if several.isEmpty():
            return
        best = {"largest": F.max, "least": F.min}[keep]
        texts = self.digested("doc_key", "row").filter("hit").join(several, "digest").select("digest", "norm", F.struct("doc_key", "row").alias("id"))
        by_text = texts.groupBy("digest", "norm").agg(F.count("*").alias("rows"), best("id").alias("stays"))
        self.several = settled(texts.join(by_text, ["digest", "norm"]).select("id", "rows", "stays"))
        self.level = settled(self.level.join(several, "digest", "left_anti"))

    def answers(self) -> DataFrame:
        """id, sha, rows, stays of every row."""
        entries = self.filter.mark(self.runs)
        alone = entries.filter("not hit").select("id", "sha", F.lit(1).cast("long").alias("rows"), F.col("id").alias("stays"))
        hits = entries.filter("hit").drop("hit")
        if self.several is not None:
            own = hits.join(self.several, "id").select("id", "sha", "rows", "stays")
            alone, hits = alone.union(own), hits.join(self.several.select("id"), "id", "left_anti")
        hot = hits.join(self.hot, "digest").select("id", "sha", "rows", "stays")
        rest = hits.join(self.hot.select("digest"), "digest", "left_anti").join(self.rest, "digest", "left")
        return alone.union(hot).union(rest.select("id", "sha", F.coalesce("rows", F.lit(1).cast("long")).alias("rows"), F.coalesce("stays", "id").alias("stays")))


def exact_dedup(docs: DataFrame, keep: str = "largest", digest_bits: int = DIGEST_BITS) -> DataFrame:
    """Groups of equal texts and the row of each that stays.

    docs: doc_id long, text string.  keep: "largest" or "least" doc_id.
    Returns doc_id, keep_id, group_size, kept, text_sha256 for every row.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_key")
    rows = numbered(docs.select("doc_id", "text") if "row" in docs.columns else docs, "row").select(key, "row", "text")
    real = lambda c: F.nullif(c, F.lit(NULL_KEY))
    return Index(rows, keep, digest_bits).answers().select(
        real(F.col("id.doc_key")).alias("doc_id"),
        real(F.col("stays.doc_key")).alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("stays.row") == F.col("id.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs, all columns as they are, without all but one of each group of equal texts.

    Only rows that the filter may hold are shuffled.
    """
    whole = numbered(docs.select(F.struct("*").alias("carried")) if "row" in docs.columns else docs, "row")
    carried = F.col("carried") if "row" in docs.columns else F.struct(*docs.columns)
    whole = whole.select(carried.alias("carried"), "row")
    whole = whole.select("carried", "row", F.coalesce(F.col("carried.doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_key"), F.col("carried.text").alias("text"))
    index = Index(whole, keep, named=False)
    dropped = settled(index.answers().filter("stays.row <> id.row").select(F.col("id.row").alias("row")))
    rows = index.digested("carried", "row")
    stay = rows.filter("hit").join(dropped, "row", "left_anti")
    return rows.filter("not hit").select("carried.*").union(stay.select("carried.*"))
