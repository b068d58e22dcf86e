"""History of changing attributes: validity intervals from presence bitmaps.

Each addendum that touches an attribute is a snapshot of it; snapshot 0 holds the value before the first change.
For every attribute and value hash one bit is set per snapshot in which that value holds; a run of consecutive
bits is a period of validity. A value that returns later gives a second run, and addenda that leave the
attribute alone are no snapshots of it, so gaps need no filling.

Defined results: rows whose field or new value is null or blank don't count, nor do rows whose addendum number is
null both in the row and for its file; of several rows with the same number the highest ``ord`` (nulls lowest,
then the highest ``change_id``) holds; values are compared without letter case and outer white space; an
attribute without counted rows gives no version. Repeated rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.session import folded, table

WORD = 62  # bits used of each bitmap word
KEY = ["bid_id", "field"]


def numbered(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Counted rows with ``field`` folded and ``addendum_number`` filled from the row's file."""
    counted = changes.select("change_id", "bid_id", "addendum_number", "ord", folded(F.col("field")).alias("field"), "old_value", "new_value", "file_name")
    counted = counted.where((F.col("field") != "") & (folded(F.col("new_value")) != ""))
    known = files.where("addendum_number is not null").groupBy("bid_id", "file_name").agg(F.min("addendum_number").alias("file_number"))
    # Only rows without a number take part in the join.
    has = F.col("addendum_number").isNotNull()
    filled = counted.where(~has).join(known, ["bid_id", "file_name"]).withColumn("addendum_number", F.col("file_number")).drop("file_number")
    return counted.where(has).unionByName(filled).drop("file_name")


def versions(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(bid_id, field, valid_from, valid_to, value): every version of every attribute; ``valid_to`` is -1 for the last.

    The first shuffle pre-aggregates by (attribute, addendum), so a hot attribute shrinks to its addenda before
    anything is ordered; later steps see at most one row per addendum.
    """
    rows = numbered(changes, files)
    place = F.struct(F.coalesce("ord", F.lit(-(2**31))).alias("o"), F.col("change_id").alias("c"))
    per = rows.groupBy(*KEY, "addendum_number").agg(F.max_by("new_value", place).alias("value"), F.min_by(F.struct("old_value"), place).alias("first"))
    # pos 0 is the state before the first addendum; the lowest addendum gives it and its own snapshot.
    order = Window.partitionBy(*KEY).orderBy("addendum_number")
    per = per.withColumn("pos", F.row_number().over(order))
    here = F.struct(F.col("pos").cast("long").alias("pos"), F.col("addendum_number").alias("number"), F.col("value").alias("value"))
    base = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("number"), F.col("first.old_value").alias("value"))
    snaps = per.select(*KEY, F.explode(F.when(F.col("pos") == 1, F.array(base, here)).otherwise(F.array(here))).alias("s")).select(*KEY, "s.*")
    # A null value has a hash of its own, apart from every text.
    snaps = snaps.withColumn("value_hash", F.coalesce(F.md5(F.concat(F.lit("="), folded(F.col("value")))), F.lit("null"))).withColumn("word", F.expr(f"pos div {WORD}"))
    maps = snaps.groupBy(*KEY, "value_hash", "word").agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pos % {WORD} as int)))").alias("bits"),
        F.collect_list(F.struct((F.col("pos") % WORD).cast("int").alias("bit"), "number", "value")).alias("held"),  # at most one entry per bit
    )
    back = Window.partitionBy(*KEY, "value_hash").orderBy("word")
    before = F.when(F.lag("word").over(back) == F.col("word") - 1, F.lag("bits").over(back))
    maps = maps.withColumn("carry", F.coalesce(F.expr("0L") + F.shiftright(before, WORD - 1), F.lit(0).cast("long")))
    maps = maps.withColumn("starts", F.expr("bits & ~(shiftleft(bits, 1) | carry)"))
    runs = maps.select(*KEY, F.explode(F.expr("filter(held, h -> (shiftright(starts, h.bit) & 1) = 1)")).alias("h"), "word")
    runs = runs.select(*KEY, (F.col("word") * WORD + F.col("h.bit")).alias("pos"), F.col("h.number").alias("valid_from"), F.col("h.value").alias("value"))
    ahead = Window.partitionBy(*KEY).orderBy("pos")
    return runs.select(*KEY, "valid_from", F.coalesce(F.lead("valid_from").over(ahead), F.lit(-1)).cast("int").alias("valid_to"), "value")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: the versions without their values."""
    return versions(table(spark, sf_dir, "addendum_changes"), table(spark, sf_dir, "source_files")).drop("value")


FOUND_SQL = """
with r as (
  select c.bid_id, lower(trim(regexp_replace(c.field, '^\\s+|\\s+$', '', 'g'))) field, coalesce(c.addendum_number, s.addendum_number) n, c.ord, c.change_id, c.old_value, c.new_value
  from addendum_changes c left join (select bid_id, file_name, min(addendum_number) addendum_number from source_files group by 1, 2) s using (bid_id, file_name)
  where trim(regexp_replace(c.field, '^\\s+|\\s+$', '', 'g')) <> '' and trim(regexp_replace(c.new_value, '^\\s+|\\s+$', '', 'g')) <> ''),
k as (select * from r where n is not null),
b as (select bid_id, field, 0 valid_from, old_value v, -1 n from k qualify row_number() over (partition by bid_id, field order by n, ord, change_id) = 1),
h as (select bid_id, field, n valid_from, new_value v, n from k qualify row_number() over (partition by bid_id, field, n order by ord desc, change_id desc) = 1),
u as (select * from b union all select * from h),
f as (select *, lower(trim(regexp_replace(v, '^\\s+|\\s+$', '', 'g'))) x, row_number() over w rn, lag(lower(trim(regexp_replace(v, '^\\s+|\\s+$', '', 'g')))) over w p from u window w as (partition by bid_id, field order by n)),
o as (select * from f where rn = 1 or x is distinct from p)
select bid_id, field, cast(valid_from as integer) valid_from, cast(coalesce(lead(valid_from) over (partition by bid_id, field order by n), -1) as integer) valid_to from o
"""
