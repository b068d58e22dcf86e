"""Mixing of sources to target weights along a time-varying schedule.

Source s has the weight w_s(t) = share_s (1 + tilt_s (2t - 1)) at training time t in [0, 1]; the tilts are balanced
so that the weights sum to 1 at every t. The integral of the schedule is the source's cumulative token demand, and
its inverse gives the position of every record from the tokens of its source that come before it. The mix is the
records range-sorted by position.

The size of the mix is the largest at which every source that has records reaches its share under its cap of
repeats, or the given ``total_tokens``, at which a capped source falls short. Source names are compared without
letter case and outer white space. Defined results: records without tokens (null, empty) and records of
sources without a target are no part of a mix; a target without records has share 0 and the other shares are
scaled to sum to 1; a copy of a record is used if more than half of it lies below its source's demand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.llm.tokens import VOCABULARY, with_count
from bidweave.session import folded, spread, stage, table

#: Pieces of each source's order; the running sum over pieces is small, that within a piece is spread.
PIECES = 4096
#: Difference of the tilts of the last and the first source: large sources come rather early, small ones late.
TILT = 0.8


def counted(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, h, piece) of the records that can be in a mix, written once for the passes over it."""
    names = targets.select(folded(F.col("source")).alias("source"))
    rows = docs.select("doc_id", folded(F.col("source")).alias("source"), "text").join(F.broadcast(names), "source", "left_semi")
    rows = with_count(spread(rows), vocabulary=vocabulary).drop("text").where("n_tokens > 0")
    return stage(rows.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id")).withColumn("piece", F.pmod("h", F.lit(PIECES)).cast("int")))


def plan(records: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: available and demanded tokens, tilt. As small as ``targets``, which does not grow."""
    have = records.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("records"))
    t = targets.select(folded(F.col("source")).alias("source"), "target_share", "max_repeats").join(have, "source", "left").na.fill(0, ["available", "records"])
    everything = Window.partitionBy(F.lit(1))
    share = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0)
    t = t.withColumn("share", F.coalesce(F.try_divide(share, F.sum(share).over(everything)), F.lit(0.0)))
    most = F.min(F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))).over(everything)
    t = t.withColumn("total", F.lit(float(total_tokens)) if total_tokens is not None else most)
    place = F.row_number().over(everything.orderBy(F.desc("share"), "source")) - 1
    t = t.withColumn("raw_tilt", TILT * (place / F.greatest(F.count(F.lit(1)).over(everything) - 1, F.lit(1)) - F.lit(0.5)))
    t = t.withColumn("tilt", F.col("raw_tilt") - F.sum(F.col("share") * F.col("raw_tilt")).over(everything))
    return t.withColumn("demand", F.col("share") * F.col("total")).drop("raw_tilt")


def mix(records: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens), sorted by position: every use of every record in the mix."""
    small = F.broadcast(plan(records, targets, total_tokens).select("source", "available", "max_repeats", "tilt", "demand"))
    pieces = records.groupBy("source", "piece").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # At most PIECES rows for each target.
    offsets = F.broadcast(pieces.select("source", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source", "piece").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = records.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.join(offsets, ["source", "piece"]).join(small, "source").withColumn("start", F.col("offset") + F.col("inside"))
    middle = F.col("start") + F.col("n_tokens") / 2
    uses = F.least(F.col("max_repeats"), F.ceil((F.col("demand") - middle) / F.col("available")).cast("int"))
    rows = rows.withColumn("uses", uses).where("uses > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    u = F.least(F.lit(1.0), ((F.col("copy") - 1) * F.col("available") + F.col("start")) / F.col("demand"))
    g = F.col("tilt")
    t = F.when(F.abs(g) < 1e-9, u).otherwise((g - 1 + F.sqrt((1 - g) * (1 - g) + 4 * g * u)) / (2 * g))
    return rows.select(F.round(t, 12).alias("position"), "doc_id", "source", "copy", "n_tokens").orderBy("position", "source", "doc_id", "copy")


def shares(records: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: target and reached share, tokens, records used and the most uses of one record."""
    used = mix(records, targets, total_tokens).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("records_used"), F.max("copy").alias("most_uses"))
    p = plan(records, targets, total_tokens).select("source", "target_share", "max_repeats", "available", F.col("records").alias("records_there"))
    out = p.join(F.broadcast(used), "source", "left").na.fill(0, ["tokens", "records_used", "most_uses"])
    reached = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    return out.withColumn("reached_share", F.round(F.coalesce(reached, F.lit(0.0)), 6))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix(counted(table(spark, sf_dir, "documents"), targets), targets)


def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return shares(counted(table(spark, sf_dir, "documents"), targets), targets)
