"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row draws a key -ln(u) / weight from a hash of its identifier, so that sorting by key is weighted sampling without
replacement, and reruns agree.  A source whose target is e times its size and a rest takes e complete epochs, then the
rows with the lowest keys until their sizes reach the rest.

A source may hold most rows.  Its prefix sums are therefore taken in two levels: the sizes of narrow key ranges are
summed first, and only the range in which the rest ends is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.support import written

#: Times a source can be repeated at most.
MOST_EPOCHS = 3
#: Ranges of keys within a source, at each of the two levels.
RANGES = 4096
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the share of characters that are not marks of markup or tables.  Null and empty texts weigh 1."""
    n = F.length(text)
    marks = F.regexp_count(text, F.lit("[#$%&*|!<>{}]"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), 1 - F.least(F.lit(1.0), 4.0 * marks / n)))


def uniform(identifier: Column, seed: int) -> Column:
    """In (0, 1): 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))).substr(1, 12)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size), a row per source, with target.

    Sources in order of code points, null last, take the weights in turn.  They share share * all sizes by weight; a
    target stops at most * source_size, and the excess goes to the others by weight.  That is the level L with
    sum(min(most * size, L * weight)) = budget: sources are capped in order of most * size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    cap = F.col("source_size") * float(most)
    # A row per source: these windows order sources, not documents.
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))).withColumn("cap", cap)
    w = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("budget", F.sum("source_size").over(every) * float(share))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source, in that order, whose cap is above the level fixes the level of all after it.
    s = s.withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every).getField("level"))
    return s.select("source", "source_size", F.round(F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")), 6).alias("target"))


def mix(docs: DataFrame, *, identifier: Column, source: Column, size: Column, weight: Column, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST_EPOCHS, seed: int = 7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of every row with source, size, source_size, target and taken: the words that the mix takes of it.

    A null source is a source.  Rows of size 0 (null or empty texts) take 0.  Repeated rows draw the same key and stand
    next to each other; each counts.  Ties of keys go by identifier.  An empty table gives no rows.  Columns of docs
    other than keep are read only by the four expressions, so their names can't clash; keep can't hold the new names.
    """
    key = -F.log(uniform(identifier, seed)) / F.greatest(weight, F.lit(1e-9))
    # 1 - exp(-key) spreads the keys over [0, 1) and keeps their order.
    rows = docs.select(*(F.col(k) for k in keep), source.alias("source"), size.alias("size"), identifier.cast("string").alias("__id"), key.alias("__key"))
    rows = written(rows, "mix")
    rows = rows.withColumn("__at", (1 - F.exp(-F.col("__key"))) * RANGES).withColumn("__r1", F.least(F.floor("__at"), F.lit(RANGES - 1)))
    rows = rows.withColumn("__r2", F.least(F.floor((F.col("__at") - F.col("__r1")) * RANGES), F.lit(RANGES - 1)))
    at = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    at = at.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    at = at.withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))

    def ends(groups: DataFrame, level: str, rest: str) -> DataFrame:
        """Of every source, the range of this level in which its rest ends, and what is left of the rest there."""
        w = Window.partitionBy("source").orderBy(level)
        sums = groups.withColumn("__upto", F.sum("size").over(w)).withColumn("__left", F.col(rest) - (F.col("__upto") - F.col("size")))
        return sums.where((F.col("__left") >= 0) & (F.col("__left") < F.col("size"))).select("source", F.col(level).alias(f"{level}_end"), F.col("__left").alias(f"{level}_left"))

    first = rows.groupBy("source", "__r1").agg(F.sum("size").alias("size"))
    joined = lambda a, b, how="left": a.join(b.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")
    # A row per source, each: at most as many as there are sources.
    end1 = ends(joined(first, at.select("source", "__rest")), "__r1", "__rest")
    at = written(joined(at, end1), "mix-targets")
    inside = joined(rows, at.select("source", "__r1_end", "__r1_left"), "inner").where(F.col("__r1") == F.col("__r1_end"))
    second = inside.groupBy("source", "__r2").agg(F.sum("size").alias("size"), F.first("__r1_left").alias("__r1_left"))
    end2 = ends(second, "__r2", "__r1_left")
    at = written(joined(at, end2), "mix-ends")
    all_rows = joined(rows, at)
    r1, r2 = F.col("__r1"), F.col("__r2")
    e1, e2 = F.col("__r1_end"), F.col("__r2_end")
    whole = all_rows.withColumn("__where", F.when(F.col("__rest") <= 0, 1).when(e1.isNull() | (r1 < e1), -1).when(r1 > e1, 1).when(e2.isNull() | (r2 < e2), -1).when(r2 > e2, 1).otherwise(0))
    w = Window.partitionBy("source").orderBy("__key", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # A row is taken if at least half of it lies before the end.
    edge = whole.where(F.col("__where") == 0).withColumn("__upto", F.sum("size").over(w) - F.col("size") / 2.0)
    edge = edge.withColumn("__take", (F.col("__upto") <= F.col("__r2_left")).cast("long")).drop("__upto")
    clear = whole.where(F.col("__where") != 0).withColumn("__take", (F.col("__where") < 0).cast("long"))
    out = clear.unionByName(edge)
    return out.select(*keep, "source", "size", "source_size", "target", (F.col("size") * (F.col("__epochs") + F.col("__take"))).alias("taken"))
