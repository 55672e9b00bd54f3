"""Coordinated authors: temporal pairs and clusters (survey J16, A17, W8, R9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 604_800

# Pairs of capabilities that are dangerous together (1 write, 2 network, 4 exec, 8 privilege).
DANGEROUS = ((2, 1), (2, 4), (1, 4), (4, 8), (2, 8))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def temporal_pairs(records: DataFrame, key: str, ts: Column, within: int = WEEK, by: str | None = None) -> DataFrame:
    """Pairs (a < b) at most `within` seconds apart (of the same `by`): an equality join on bins and on the bin after."""
    r = records.select(F.col(key).alias("id"), ts.cast("long").alias("t"), (F.col(by) if by else F.lit(0)).alias("g")).withColumn("bin", F.floor(F.col("t") / within).cast("long"))
    left = r.select("g", F.col("id").alias("x"), F.col("t").alias("tx"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    right = r.select("g", F.col("id").alias("y"), F.col("t").alias("ty"), "bin")
    # Each pair meets once: in the bin of the later record (in the same bin, the smaller key first at equal times).
    j = left.join(right, ["g", "bin"]).where(((F.col("ty") > F.col("tx")) | ((F.col("ty") == F.col("tx")) & (F.col("y") > F.col("x")))) & (F.col("ty") - F.col("tx") <= within))
    return j.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("ty") - F.col("tx")).alias("apart"))


def clusters(records: DataFrame, ts: Column, *by: str, gap: int = WEEK) -> DataFrame:
    """Numbers the clusters of records chained by gaps of at most `gap` seconds, within each `by`; ties share a cluster."""
    t = records.withColumn("_t", ts.cast("long"))
    if not by:
        return _clusters_of_all(t, gap)
    order = Window.partitionBy(*by).orderBy("_t")
    starts = t.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(order) > gap).cast("int"), F.lit(1)))
    return starts.withColumn("cluster", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_new", "_t")


def _clusters_of_all(t: DataFrame, gap: int) -> DataFrame:
    """Clusters without a key, of any number of records: occupied stretches of `gap` seconds first (few), then records by their stretch.

    A cluster that begins within a stretch begins there for all its records, so where
    clusters begin is found from each stretch's own gaps, its first and its last record.
    """
    s = t.withColumn("_bin", F.floor(F.col("_t") / gap))
    # Within a stretch no two records are more than the gap apart, so it holds no beginning but its first record's.
    first = s.groupBy("_bin").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    order = Window.orderBy("_bin")  # one row for each occupied stretch
    starts = first.withColumn("_new", F.coalesce((F.col("lo") - F.lag("hi").over(order) > gap).cast("int"), F.lit(1)))
    numbered = starts.withColumn("cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("_bin", "cluster")
    return s.join(F.broadcast(numbered), "_bin").drop("_bin", "_t")


def dangerous_pair(flags: Column) -> Column:
    """The first dangerous pair that a set of capabilities holds, as a mask; null if none."""
    out = F.lit(None).cast("int")
    for a, b in reversed(DANGEROUS):
        out = F.when(flags.bitwiseAND(F.lit(a | b)) == a | b, F.lit(a | b)).otherwise(out)
    return out


def findings(clustered: DataFrame, *by: str, flags: str = "flags", least: int = 3) -> DataFrame:
    """Clusters of enough records whose capabilities together are dangerous."""
    g = clustered.groupBy(*by, "cluster").agg(F.count("*").alias("size"), F.bit_or(flags).alias("flags"))
    total = clustered.groupBy(*by).agg(F.count("*").alias("total")) if by else None
    g = g.join(total, list(by)) if by else g.crossJoin(clustered.agg(F.count("*").alias("total")))
    return g.where(F.col("size") >= least).withColumn("pair", dangerous_pair(F.col("flags"))).where("pair IS NOT NULL").withColumn("confidence", F.col("size") / F.col("total"))
