"""Place search: a token index and ranked, batched lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .tables import written

# Words by which kinds are found too.
SYNONYMS = {"trail": ("trail", "sentiero"), "hut": ("rifugio", "hutte", "hut", "baita"), "crag": ("falesia", "crag", "klettergarten", "arrampicata")}


def entries(rows: DataFrame) -> DataFrame:
    """rows: id, name, kind, weight.  Adds norm, its halves `alts`, toks and the words an entry is found by."""
    synonyms = F.array().cast("array<string>")
    for k, v in SYNONYMS.items():
        synonyms = F.when(F.col("kind") == k, F.array(*map(F.lit, v))).otherwise(synonyms)
    out = rows.withColumn("norm", text.fold(F.col("name"))).withColumn("toks", text.tokens(F.col("norm")))
    return out.withColumn("alts", text.split_names(F.col("norm"))).withColumn("words", F.array_distinct(F.concat("toks", synonyms)))


def token_index(found: DataFrame) -> DataFrame:
    """tok, id, sorted by token within ranges: prefix lookups read a range."""
    return found.select(F.explode("words").alias("tok"), "id").repartitionByRange("tok").sortWithinPartitions("tok", "id")


def _heads(c: Column) -> Column:
    """The first one, two and three letters: a text begins with up to three letters if it has them as a head."""
    return F.array_distinct(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(c, 1, n)))


def containing(found: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, id: the entries whose norm contains each needle.

    needles: needle, distinct and not empty.  Candidates share the needle's
    rarest run of three letters (an equi-join); the exact test follows.
    """
    pieces = lambda c, last: F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, 3)))
    asked = written(needles.select("needle", F.explode(pieces(F.col("needle"), F.greatest(F.lit(1), F.length("needle") - 2))).alias("run")))
    # Runs at a name's end are shorter: they are there for needles of one or two letters, as are the heads of all runs.
    runs = found.filter("norm <> ''").select("id", F.explode(pieces(F.col("norm"), F.length("norm"))).alias("run"))
    runs = runs.select("id", F.explode(_heads(F.col("run"))).alias("run")).join(asked.select("run").distinct(), "run", "left_semi").distinct()
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    # A run that no name has leaves its needle without entries.
    rarest = asked.join(counts, "run", "left").groupBy("needle").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    return rarest.join(runs, "run").join(found.select("id", "norm"), "id").filter(F.contains("norm", F.col("needle"))).select("needle", "id")


def search(found: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """qid, id, position, rank: the best entries of each query.

    found: entries(); queries: qid, q.  Three tiers: entries with a word that
    begins with the query's rarest word, if they match; where these are fewer
    than `limit`, all whose name contains the query; where there are none at
    all, those whose name contains the rarest word of three letters or more
    that any name contains (of equally rare words the longest, then the
    first).  Order: rank, kind, weight, shorter name, name, id; but a place
    stands before whatever else of those with its rank or a lower one has the
    same name.  Queries that fold alike are searched once.
    """
    asked_by = queries.select("qid", F.trim(text.fold(F.col("q"))).alias("q"))
    q = asked_by.select("q").distinct().withColumn("qtoks", text.tokens(F.col("q"))).filter(F.size("qtoks") > 0)
    q = written(q)
    index = found.select("id", F.explode("words").alias("word"))
    begun = index.groupBy("word").agg(F.count("*").alias("n")).withColumn("head", F.explode(_heads(F.col("word"))))
    asked = q.select("q", F.posexplode("qtoks").alias("at", "tok"))
    words = written(asked.select("tok").distinct().withColumn("head", F.substring("tok", 1, 3)).join(begun, "head").filter(F.col("word").startswith(F.col("tok"))).select("tok", "word", "n"))
    rare = asked.join(words.groupBy("tok").agg(F.sum("n").alias("n")), "tok", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rare.groupBy("q").agg(F.min_by("tok", F.struct("n", "at")).alias("tok"))
    pairs = rarest.join(words.select("tok", "word"), "tok").join(index, "word").select("q", "id").distinct()
    rank = text.match_rank(F.col("norm"), F.col("alts"), F.col("words"), F.col("q"), F.col("qtoks"))
    order = (F.desc("rank"), F.desc(text.kind_rank(F.col("kind"))), F.desc("weight"), F.octet_length("name"), "name", "id")
    best = lambda rows, by: rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("position") <= limit)
    shown = found.select("id", "name", "kind", "weight", "norm", "alts")
    # Written, as the other tiers need it: a query with `limit` of these has all it gets.
    first = written(best(pairs.join(q, "q").join(found, "id").withColumn("rank", rank).filter("rank > 0"), "q").select("q", "id", "rank"))
    few = q.join(first.groupBy("q").count().filter(F.col("count") >= limit), "q", "left_anti")
    inside = containing(found, few.select(F.col("q").alias("needle"))).withColumnRenamed("needle", "q")
    second = inside.join(first, ["q", "id"], "left_anti").withColumn("rank", F.lit(1))
    matched = written(first.unionByName(second))
    none = rare.filter("length(tok) >= 3").join(matched.select("q").distinct(), "q", "left_anti")
    none = written(none.select("q", "tok", "n", "at"))
    if none.isEmpty():
        both = best(matched.join(shown, "id"), "q").select("q", "position", "rank", *shown.columns)
        return asked_by.join(places_first(both), "q").select("qid", "id", "position", "rank")
    held = containing(found, none.select(F.col("tok").alias("needle")).distinct()).withColumnRenamed("needle", "tok")
    chosen = none.join(held.select("tok").distinct(), "tok").groupBy("q").agg(F.min_by("tok", F.struct("n", -F.length("tok"), "at")).alias("tok"))
    # Nothing but the word decides in the last tier: its best entries are the same for all who ask for it.
    third = best(held.withColumn("rank", F.lit(0)).join(shown, "id"), "tok").join(chosen, "tok")
    both = best(matched.join(shown, "id"), "q").select("q", "position", "rank", *shown.columns).unionByName(third.select("q", "position", "rank", *shown.columns))
    return asked_by.join(places_first(both), "q").select("qid", "id", "position", "rank")


def places_first(ranked: DataFrame) -> DataFrame:
    """Rows of a query's short list, q and position: a place stands right before the first other kind that shares a name with it."""
    names = F.concat(F.array("norm"), "alts")
    rows = ranked.withColumn("names", names)
    others = rows.filter("kind <> 'place'").select("q", F.col("position").alias("before"), F.explode("names").alias("name_of")).filter("name_of <> ''")
    places = rows.filter("kind = 'place'").select("q", "id", "position", F.explode("names").alias("name_of"))
    moved = places.join(others, ["q", "name_of"]).filter("before < position").groupBy("q", "id").agg(F.min("before").alias("before"))
    keyed = ranked.join(moved, ["q", "id"], "left").withColumn("at", F.coalesce(F.col("before") - 0.5, F.col("position").cast("double")))
    return keyed.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy("at", "position")))


def street_groups(rows: DataFrame) -> DataFrame:
    """One entry for each street of a locality: place of its longest stretch, name of its first.

    rows: st, name, locality, cls, len, x, y.  Cycleways are grouped by name only.
    """
    keyed = rows.filter("name <> ''").withColumn("key", text.canonical(F.col("name"))).withColumn("place", F.when(F.col("cls") == "cycleway", F.lit("")).otherwise(F.col("locality")))
    longest = F.struct("len", (-F.col("st")).alias("first"))
    return keyed.groupBy("key", "place").agg(
        F.min_by("name", "st").alias("name"), F.max_by("x", longest).alias("x"), F.max_by("y", longest).alias("y"), F.max_by("locality", longest).alias("locality"), F.count("*").alias("stretches")
    )
