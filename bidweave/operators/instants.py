"""Mixed timestamp notations and zones, normalised to one UTC instant.

A text cell is read in three steps, all in JVM expressions: its calendar date, its time of day and what it
says about the zone. The wall time is then joined as of the zone's offset intervals: every zone is a list of
intervals of constant offset, exploded by (zone, year); the intervals that contain the wall time tell its
offset. Two mean an ambiguous time (the first holds), none a skipped one (the offset before the gap holds).

Defined results: a cell that is null, blank, only a date, only a time or an impossible date gives a null
instant; fraction digits finer than micro-seconds are cut off; two-digit years are 20xx; any year from 1 to 9999 counts, years beyond
a zone's table by its last rule; without an offset, label or zone name the default zone holds, and without that, or where it
is no IANA zone, the instant is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import folded, stage, table

#: Years of zones are broadcast up to this number (some 20 MB), beyond it joined by a shuffle.
BROADCAST_YEARS = 100_000

MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
# Marks a date found in the text: «kind|a|b|c».
DATE_RULES = [
    (r"(?<![\d.:])(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)t?", "ymd|$1|$3|$4"),
    (r"(?<![\d.:])(\d{4})(\d{2})(\d{2})(?=t\d|\s+\d{1,2}:)t?", "ymd|$1|$2|$3"),
    (rf"(?<![\d:.])(?:the\s+)?(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+day\s+of)?[-\s./]+{MONTH}[.,]*[-\s/]+(\d{{4}}(?![\d:])|\d{{2}}(?!\d|:|,|st|nd|rd|th))", "dmy|$1|$2|$3"),
    (rf"\b{MONTH}[.,]?[-\s]+(\d{{1,2}})(?:st|nd|rd|th)?[-,\s]+(\d{{4}})(?!\d)", "mdy|$1|$2|$3"),
    (r"(?<![\d.:])(\d{1,2})([-/])(\d{1,2})\2(\d{4}|\d{2})(?!\d)(?!:)", "num|$1|$3|$4"),
    (r"(?<![\d.:])(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)", "num|$1|$2|$3"),
]
HALF = r"(noon|midnight|[ap]\.?\s?m\b\.?)"
CLOCK = rf"(?<![\d:.+])(?<!\d-)(\d{{1,2}})[:.](\d{{2}})(?!\d)(?::(\d{{2}})(?:[.,](\d+))?)?(?:\s*{HALF})?"
HOUR = rf"(?<![\d:.])(\d{{1,2}})\s*{HALF}"
COMPACT = r"(?<![\d:.+-])(\d{2})(\d{2})(\d{2})?(?:\s*(?:hrs|hours|hr|h)\b|(?=\s*(?:z\b|[+-]\d{2}|$)))"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,9}$"), c.cast("int"))


def parse_wall(df: DataFrame, text: str, order: str) -> DataFrame:
    """Adds ``wall_us`` (local micro-seconds, null if no case), ``epoch_us`` (machine counts) and ``zone_text``.

    ``order`` names the column with the order of all-digit dates, ``MDY`` or ``DMY`` (null: ``MDY``).
    """
    s = F.lower(F.regexp_replace(F.regexp_replace(F.col(text), r"(?U)[\s]+", " "), "^ | $", ""))
    df = df.withColumn("__s", s)
    marked = F.col("__s")
    for pattern, mark in DATE_RULES:
        marked = F.when(marked.contains("«"), marked).otherwise(F.regexp_replace(marked, pattern, f" «{mark}» "))
    df = df.withColumn("__m", marked)
    df = df.withColumn("__d", F.split(F.regexp_extract("__m", "«([^»]*)»", 1), r"\|")).withColumn("__r", F.regexp_replace("__m", "«[^»]*»", "~"))
    kind, a, b, c = (F.get("__d", F.lit(i)) for i in range(4))
    month_at = lambda x: F.array_position(F.array(*map(F.lit, MONTHS)), x).cast("int")
    dmy = F.coalesce(F.upper(F.col(order)), F.lit("MDY")) == "DMY"
    year = F.when(kind == "ymd", _int(a)).otherwise(F.when(F.length(c) == 2, _int(c) + 2000).otherwise(_int(c)))
    month = F.when(kind == "ymd", _int(b)).when(kind == "dmy", month_at(b)).when(kind == "mdy", month_at(a)).when(dmy, _int(b)).otherwise(_int(a))
    day = F.when(kind == "ymd", _int(c)).when(kind == "dmy", _int(a)).when(kind == "mdy", _int(b)).when(dmy, _int(a)).otherwise(_int(b))
    df = df.withColumns({"__y": year, "__mo": month, "__da": day})

    which = F.when(F.col("__r").rlike(CLOCK), 1).when(F.col("__r").rlike(HOUR), 2).when(F.col("__r").rlike(COMPACT), 3)
    part = lambda p, n: F.regexp_extract("__r", p, n)
    df = df.withColumn("__w", which)
    half = F.when(F.col("__w") == 1, part(CLOCK, 5)).when(F.col("__w") == 2, part(HOUR, 2)).otherwise("")
    df = df.withColumns(
        {
            "__h": _int(F.when(F.col("__w") == 1, part(CLOCK, 1)).when(F.col("__w") == 2, part(HOUR, 1)).when(F.col("__w") == 3, part(COMPACT, 1))),
            "__mi": F.coalesce(_int(F.when(F.col("__w") == 1, part(CLOCK, 2)).when(F.col("__w") == 3, part(COMPACT, 2))), F.lit(0)),
            "__se": F.coalesce(_int(F.when(F.col("__w") == 1, part(CLOCK, 3)).when(F.col("__w") == 3, part(COMPACT, 3))), F.lit(0)),
            "__fr": _int(F.rpad(F.substring(F.when(F.col("__w") == 1, part(CLOCK, 4)).otherwise(""), 1, 6), 6, "0")),
            "__half": F.when(half.startswith("a") | (half == "midnight"), "a").when(half.startswith("p") | (half == "noon"), "p"),
            "zone_text": F.when(F.col("__w") == 1, part(f"{CLOCK}(.*)$", 6)).when(F.col("__w") == 2, part(f"{HOUR}(.*)$", 3)).when(F.col("__w") == 3, part(f"{COMPACT}(.*)$", 4)),
        }
    )
    hour = F.when(F.col("__half").isNull(), F.col("__h")).when((F.col("__h") < 1) | (F.col("__h") > 12), None).otherwise(F.col("__h") % 12 + F.when(F.col("__half") == "p", 12).otherwise(0))
    days = F.expr("unix_date(cast(try_make_timestamp_ntz(__y, __mo, __da, 0, 0, cast(0 as decimal(16,6))) as date))")
    df = df.withColumn("__hour", hour).withColumn("__days", F.when(F.col("__y").between(1, 9999) & F.col("__mo").between(1, 12) & F.col("__da").between(1, 31), days))
    sound = F.col("__hour").between(0, 23) & (F.col("__mi") < 60) & (F.col("__se") < 60)
    wall = F.when(sound, (((F.col("__days").cast("bigint") * 24 + F.col("__hour")) * 60 + F.col("__mi")) * 60 + F.col("__se")) * 1_000_000 + F.coalesce("__fr", F.lit(0)))
    digits = F.regexp_extract("__s", r"^(\d{9,20})(?:\.(\d+))?$", 1)
    n = F.expr("try_cast(__digits as decimal(20,0))")
    df = df.withColumn("__digits", digits)
    count = (
        F.when(F.length("__digits").between(9, 11), n * 1_000_000 + F.coalesce(_int(F.rpad(F.substring(F.regexp_extract("__s", r"^\d{9,11}\.(\d+)$", 1), 1, 6), 6, "0")), F.lit(0)))
        .when(F.length("__digits").between(12, 14), n * 1000)
        .when(F.length("__digits").between(15, 17), n)
        .when(F.length("__digits").between(18, 20), F.floor(n / 1000))
    )
    return df.withColumns({"wall_us": wall, "epoch_us": count.cast("bigint")}).drop(*[x for x in df.columns if x.startswith("__")])


def _spans(zone, year: int) -> list[tuple[int, int, int]]:
    """(wall from, wall to, offset) in seconds of the intervals of constant offset that touch a year of wall time, and of the one before."""
    epoch, second = datetime(1970, 1, 1, tzinfo=UTC), timedelta(seconds=1)
    first, last = datetime(1, 1, 3, tzinfo=UTC), datetime(9999, 12, 28, tzinfo=UTC)
    # Five weeks before the year hold the interval before any gap at its start.
    at = first if year < 2 else datetime(year, 1, 1, tzinfo=UTC) - timedelta(days=35)
    end = last if year > 9998 else datetime(year + 1, 1, 1, tzinfo=UTC) + timedelta(days=4)
    offset_at = lambda t: t.astimezone(zone).utcoffset()
    sec = lambda t: round((t - epoch).total_seconds())
    cuts = []
    offset = offset_at(at)
    begin = (at, offset)
    while at < end:
        to = min(end, at + timedelta(days=7))
        while (there := offset_at(to)) != offset:
            lo, hi = at, to  # the first change between them
            while hi - lo > second:
                mid = (lo + (hi - lo) / 2).replace(microsecond=0)
                if mid in (lo, hi):
                    break
                lo, hi = (mid, hi) if offset_at(mid) == offset else (lo, mid)
            offset = offset_at(hi)
            cuts.append((hi, offset))
            at = hi
            if offset == there:
                break
        at = to
    out, margin = [], 30 * 86_400
    start, now = sec(begin[0]) - margin, round(begin[1].total_seconds())
    for t, o in cuts:
        out.append((start + now, sec(t) + now, now))
        start, now = sec(t), round(o.total_seconds())
    return [*out, (start + now, sec(end) + margin + now, now)]


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from zoneinfo import ZoneInfo, available_timezones

    names = {z.lower(): z for z in available_timezones()}
    for pdf in batches:
        rows = []
        for key, year in zip(pdf["zone_key"], pdf["wall_year"]):
            if key in names:
                spans = [{"from_us": a * 1_000_000, "to_us": b * 1_000_000, "offset_s": o} for a, b, o in _spans(ZoneInfo(names[key]), int(year))]
                rows.append((key, year, spans))
        yield pd.DataFrame(rows, columns=["zone_key", "wall_year", "spans"])


def zone_intervals(keys: DataFrame) -> DataFrame:
    """(zone_key, wall_year, spans): the offset intervals of the given zones (IANA names in lower case) in the given years."""
    return keys.mapInPandas(_intervals, "zone_key string, wall_year int, spans array<struct<from_us:bigint,to_us:bigint,offset_s:int>>")


def compound_zones(spark: SparkSession) -> DataFrame:
    """(label, zone_id): IANA names such as EST5EDT, which a text can state as it does a label."""
    from zoneinfo import available_timezones

    return spark.createDataFrame([(z, z) for z in sorted(available_timezones()) if re.fullmatch(r"[A-Z]{3}\d[A-Z]{3}", z)], "label string, zone_id string")


def offset_seconds(c: Column) -> Column:
    """Seconds of an offset such as ``-04:00``, ``+0530`` or ``-4``; null for other texts."""
    p = r"^([+-])(\d{1,2}):?(\d{2})?$"
    h, m = F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 3)
    s = F.coalesce(_int(h), F.lit(0)) * 3600 + F.coalesce(_int(m), F.lit(0)) * 60
    return F.when(c.rlike(p), F.when(F.regexp_extract(c, p, 1) == "-", -s).otherwise(s))


def to_instants(cells: DataFrame, labels: DataFrame, text: str = "value", default_zone: str = "tz_name", order: str = "date_order") -> DataFrame:
    """Adds ``utc_us`` and ``wall_kind`` (``offset``, ``unique``, ``ambiguous``, ``skipped``, ``count``) to each row of ``cells``.

    ``labels`` (label, zone_id) is a small table that does not grow. An offset counts before a label or name.
    No row is dropped or repeated. Only the zones and years that occur are built. Columns of ``cells`` with
    the names of the added ones are replaced.
    """
    # The given row travels whole, so that none of its names can clash with those used here.
    row = cells.select(F.struct(*[F.col(f"`{c}`") for c in cells.columns]).alias("given"), F.col(text).alias("text"), F.col(default_zone).alias("default_zone"), F.col(order).alias("order"))
    df = parse_wall(row, "text", "order")
    z = F.regexp_replace(F.coalesce("zone_text", F.lit("")), r"^[\s(\[,]+", "")
    df = df.withColumn("__z", z)
    shift = F.regexp_extract("__z", r"^(?:utc|gmt)?\s?([+-]\d{1,2}(?::?\d{2})?)(?!\d)", 1)
    known = labels.where("label is not null and zone_id is not null").select("label", "zone_id").unionByName(compound_zones(cells.sparkSession))
    listed = known.select(F.struct(F.length("label").alias("n"), F.lower("label").alias("label"), "zone_id").alias("__l"))
    listed = listed.agg(F.sort_array(F.collect_list("__l"), asc=False).alias("__labels"))
    df = df.crossJoin(F.broadcast(listed))
    # The longest label that stands right after the time; else one that stands anywhere as a word.
    first = F.expr("get(filter(__labels, l -> startswith(__z, l.label) and not (substring(__z, l.n + 1, 1) rlike '[a-z0-9/+-]')), 0)")
    words = F.concat(F.lit(" "), F.regexp_replace("__z", r"[^a-z0-9/+-]+", " "), F.lit(" "))
    df = df.withColumn("__words", words)
    later = F.expr("get(filter(__labels, l -> l.n > 1 and contains(__words, concat(' ', l.label, ' '))), 0)")
    name = F.regexp_extract("__z", r"(?:^|[\[\s(])([a-z]+(?:/[a-z0-9_+-]+)+)", 1)
    df = df.withColumns({"__shift": offset_seconds(shift), "__name": name, "__label": F.coalesce(first, later)["zone_id"]})
    zone = F.coalesce(F.when(F.col("__name") != "", F.col("__name")), F.col("__label"), F.col("default_zone"))
    df = df.withColumn("__zone", zone).withColumn("__shift", F.coalesce("__shift", offset_seconds(F.col("__zone"))))
    df = df.withColumns({"zone_key": F.lower("__zone"), "wall_year": F.when(F.col("__shift").isNull(), F.expr("cast(extract(year from date_add(date'1970-01-01', cast(floor(wall_us / 86400000000) as int))) as int)"))})
    # Read once: the first pass over the cells is written and gives the zones and years that occur.
    df = stage(df.select("given", "wall_us", "epoch_us", "__shift", "zone_key", "wall_year"))
    years = stage(zone_intervals(df.select("zone_key", "wall_year").where("zone_key is not null and wall_year is not null").distinct()))
    df = df.join(F.broadcast(years) if years.count() <= BROADCAST_YEARS else years, ["zone_key", "wall_year"], "left")
    hits = F.expr("filter(spans, s -> wall_us >= s.from_us and wall_us < s.to_us)")
    df = df.withColumn("__hits", hits)
    size = F.size("__hits")
    fits = F.when(size > 0, F.expr("get(__hits, 0).offset_s")).otherwise(F.expr("try_element_at(filter(spans, s -> s.to_us <= wall_us), -1).offset_s"))
    offset = F.coalesce("__shift", fits)
    kind = F.when(F.col("epoch_us").isNotNull(), "count").when(F.col("wall_us").isNull() | offset.isNull(), None).when(F.col("__shift").isNotNull(), "offset").when(size == 1, "unique").when(size > 1, "ambiguous").otherwise("skipped")
    df = df.withColumns({"utc_us": F.coalesce("epoch_us", F.col("wall_us") - offset.cast("bigint") * 1_000_000), "wall_kind": kind})
    added = ("utc_us", "wall_kind")
    return df.select(*[F.col(f"given.`{c}`") for c in cells.columns if c not in added], *added)


STATED_FIELDS = ("due date", "pre bid meeting", "delivery date")


def stated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of extracted fields and of changes that may state a time, with their package's zone and date order."""
    fields = table(spark, sf_dir, "field_outputs").where(folded(F.col("field_name")).isin(*STATED_FIELDS) & F.col("value").isNotNull())
    changes = table(spark, sf_dir, "addendum_changes").where(folded(F.col("field")).isin(*STATED_FIELDS))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("cell_kind"), F.col(k).alias("value")) for k in ("old_value", "new_value")])).alias("c")
    cells = fields.select(F.lit("field_value").alias("cell_kind"), F.col("output_id").alias("rec_id"), "bid_id", "value").unionByName(
        changes.select("change_id", "bid_id", kinds).select("c.cell_kind", F.col("change_id").alias("rec_id"), "bid_id", "c.value").where("value is not null")
    )
    portals = table(spark, sf_dir, "portals").select("portal_id", F.col("tz_name").alias("portal_tz"), "date_order")
    packages = table(spark, sf_dir, "packages").select("bid_id", "portal_id", F.col("tz_name").alias("package_tz")).join(F.broadcast(portals), "portal_id", "left")
    packages = packages.select("bid_id", "date_order", F.coalesce("package_tz", "portal_tz").alias("tz_name")).dropDuplicates(["bid_id"])
    return cells.join(packages, "bid_id", "left")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: one row per cell that fixes an instant; repeated rows count once."""
    out = to_instants(stated_times(spark, sf_dir), table(spark, sf_dir, "zone_labels"))
    return out.where("utc_us is not null").groupBy("cell_kind", "rec_id").agg(F.min("utc_us").alias("utc_us"))
