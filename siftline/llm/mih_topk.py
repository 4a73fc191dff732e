"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into four segments of 16 bits.  If a code lies within distance 4 * r + 3 of a query, one of its
segments lies within r of the query's.  So segment radii grow from 0: round r looks up the codes with a segment at
distance exactly r, verifies their whole distances and keeps the best k.  A query is done once k rows lie within 4 * r + 3:
no code that has not been seen can be nearer.

Equal codes are one entry of the index, with the k least identifiers that have it, so a vector that most rows share costs
one lookup.  Entries are dealt out by segment, its first bits and a salt that keeps shares small; a query goes to the
shares whose first bits are within the round's radius of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.support import written

#: Segments of a code, their bits, the first bits that name a share, and entries that a share should hold at most.
SEGMENTS, BITS, FIRST_BITS, SHARE = 4, 16, 6, 200_000
_LOW = BITS - FIRST_BITS


def sign_code(vector: Column) -> Column:
    """A bit for each of a vector's first 64 numbers: 1 if it is above 0.  Null vectors have no code; null numbers count as 0."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    placed = F.zip_with(bits, F.transform(F.sequence(F.lit(0), F.size(bits) - 1), lambda i: i), lambda b, i: F.call_function("shiftleft", b, i))
    return F.when(F.size(bits) > 0, F.aggregate(placed, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _masks(bits: int) -> list[np.ndarray]:
    """Of each weight, all masks of so many bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(bits), w)], np.int64) for w in range(bits + 1)]


def _segment(code: Column, s: Column) -> Column:
    return F.call_function("shiftrightunsigned", code, (s * BITS).cast("int")).bitwiseAND(F.lit((1 << BITS) - 1))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, identifier: str = "vec_id", code: str = "code") -> DataFrame:
    """(query_id, rank, identifier, distance): for every row of queries the k rows nearest in Hamming distance.

    Ties go to the least identifier; a query that is among rows finds itself too.  Rows and queries with a null code or
    identifier take no part; repeated (identifier, code) rows count once.  With fewer than k rows all are returned, and an
    empty table returns none.  Other columns are not read.
    """
    spark = rows.sparkSession
    id_type = rows.schema[identifier].dataType.simpleString()
    index = rows.select(F.col(identifier).alias("id"), F.col(code).alias("code")).where(F.col("id").isNotNull() & F.col("code").isNotNull())
    # The limit of each code's rows is taken before the shuffle as well as after it.
    least = index.distinct().withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    entries = written(least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    wanted = queries.select(F.col(identifier).alias("query_id"), F.col(code).alias("query")).where(F.col("query_id").isNotNull() & F.col("query").isNotNull()).distinct()
    wanted = written(wanted, "queries")
    total = entries.count()
    salts = 1 + total // (SHARE << FIRST_BITS)
    shares = entries.select(F.col("code"), F.element_at("ids", 1).alias("least"), F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("s"))
    shares = shares.withColumn("first", F.shiftright(_segment(F.col("code"), F.col("s")).cast("int"), _LOW)).withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(salts)).cast("int"))
    shares = written(shares, "shares")
    masks = _masks(_LOW)
    first_masks = _masks(FIRST_BITS)
    open_ = written(wanted.select("query").distinct().withColumn("bound", F.lit(64)), "open")
    best = spark.createDataFrame([], f"query long, code long, least {id_type}, distance int")

    for radius in range(BITS + 1):
        reach = [int(m) for w in range(min(radius, FIRST_BITS) + 1) if radius - w <= _LOW for m in first_masks[w]]
        asked = open_.select("query", "bound", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("s"))
        asked = asked.withColumn("own", F.shiftright(_segment(F.col("query"), F.col("s")).cast("int"), _LOW))
        asked = asked.withColumn("mask", F.explode(F.array(*map(F.lit, reach)))).withColumn("first", F.col("own").bitwiseXOR(F.col("mask")))
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("query", "bound", "s", "first", "mask", "salt")

        def look(codes: pa.Table, asks: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, ...]] = []
            if codes.num_rows and asks.num_rows:
                c, ids = codes.column("code").to_numpy(), codes.column("least").to_numpy()
                shift = np.uint64(codes.column("s")[0].as_py() * BITS)
                low = ((c.view(np.uint64) >> shift) & np.uint64((1 << _LOW) - 1)).astype(np.int64)
                order = np.argsort(low, kind="stable")
                c, ids, begin = c[order], ids[order], np.searchsorted(low[order], np.arange((1 << _LOW) + 1))
                q, bound, mask = (asks.column(n).to_numpy() for n in ("query", "bound", "mask"))
                q_low = ((q.view(np.uint64) >> shift) & np.uint64((1 << _LOW) - 1)).astype(np.int64)
                for i in range(len(q)):
                    bins = q_low[i] ^ masks[radius - int(mask[i]).bit_count()]
                    a, n = begin[bins], begin[bins + 1] - begin[bins]
                    at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    d = np.bitwise_count((c[at] ^ q[i]).view(np.uint64)).astype(np.int32)
                    near = np.flatnonzero(d <= bound[i])
                    if len(near):
                        near = near[np.lexsort((ids[at[near]], d[near]))[:k]]
                        out.append((np.full(len(near), q[i]), c[at[near]], ids[at[near]], d[near]))
            columns = [np.concatenate([x[j] for x in out]) if out else [] for j in range(4)]
            return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], codes.schema.field("least").type if codes.num_columns else pa.int64()), pa.array(columns[3], pa.int32())], names=["query", "code", "least", "distance"])

        key = ["s", "first", "salt"]
        found = shares.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(look, best.schema)
        every = best.unionByName(found).groupBy("query", "code").agg(F.min("least").alias("least"), F.min("distance").alias("distance"))
        ranked = every.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "least")))
        best = written(ranked.where(F.col("n") <= k).drop("n"), "best")
        covered = SEGMENTS * radius + SEGMENTS - 1
        # Rows, not codes, count: an entry stands for up to k rows.
        have = best.join(entries.select("code", F.size("ids").alias("rows")), "code").groupBy("query").agg(
            F.sum(F.when(F.col("distance") <= covered, F.col("rows")).otherwise(0)).alias("sure"),
            F.when(F.count("*") >= k, F.max("distance")).otherwise(64).alias("bound"),
        )
        open_ = open_.drop("bound").join(have, "query", "left").where(F.coalesce("sure", F.lit(0)) < k).select("query", F.coalesce("bound", F.lit(64)).alias("bound"))
        open_ = written(open_, "open")
        if covered >= 64 or open_.isEmpty():
            break

    full = best.join(entries, "code").select("query", "distance", F.explode("ids").alias(identifier))
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", identifier))).where(F.col("rank") <= k)
    return wanted.join(ranked, "query").select("query_id", "rank", identifier, "distance")
