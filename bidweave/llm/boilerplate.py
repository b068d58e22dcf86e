"""Lines repeated across the documents of one source.

Lines are normalised and hashed (64 bits), distinct documents are counted per source and hash, and lines above a
share of the source's documents are joined back and left out. Every document counts once per line before
anything is gathered by source, and the counts per (source, line) are added up map-side, so a source with a third of
all rows is no single task.

Lines are equal if they are so in lower case, outer white space dropped and inner white space one blank, each run
of digits the same sign; lines without a letter are never boilerplate. Defined results: pages of no known source
(unknown package, null portal) keep their lines; a null text stays null; pages that come again change
nothing; documents are (``bid_id``, ``file_name``), null names included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import stage, table

LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.2
#: Sources, and frequent lines of all sources together, are broadcast up to these numbers (some 16 MB), beyond them joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_LINES = 500_000, 1_000_000


def norm_line(line: Column) -> Column:
    s = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(s), r"\p{Nd}+", "0")


def line_hashes(text: Column) -> Column:
    """For each line the hash of its normal form; null for lines without a letter."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"\p{L}"), F.xxhash64(norm_line(x))))


def frequent_lines(pages: DataFrame, source: str = "portal_id", least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(source, __frequent): the hashes of the frequent lines of each source.

    A source has at most (mean distinct lines of its documents) / ``share`` of them, however many documents it has.
    """
    keyed = pages.where(F.col(source).isNotNull())
    doc = F.xxhash64("bid_id", "file_name", F.col("bid_id").isNull(), F.col("file_name").isNull())
    base = keyed.select(source, doc.alias("__doc"), F.array_distinct(F.filter("__hashes", lambda h: h.isNotNull())).alias("__own"))
    totals = stage(base.select(source, "__doc").distinct().groupBy(source).agg(F.count(F.lit(1)).alias("total")))
    if totals.count() <= BROADCAST_SOURCES:
        totals = F.broadcast(totals)
    # Lines are counted by (source, hash), and only those above the share are gathered by source.
    counts = base.select(source, "__doc", F.explode("__own").alias("h")).distinct().groupBy(source, "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = counts.join(totals, source).where(F.col("n") >= F.col("total") * share)
    return often.groupBy(source).agg(F.collect_list("h").alias("__frequent"))


def hashed(pages: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Adds ``__hashes``; done before any join, so that a query that needs no text moves none."""
    return pages.withColumn("__hashes", line_hashes(F.col(text)))


def flag_lines(pages: DataFrame, source: str = "portal_id", least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """Adds ``__drop`` to hashed pages: for each line whether it is boilerplate of the page's source.

    The frequent lines are broadcast while they are few; each source has a bounded number, but there may be many sources.
    """
    often = stage(frequent_lines(pages, source, least, share))
    n = often.agg(F.coalesce(F.sum(F.size("__frequent")), F.lit(0)).alias("n")).first()["n"]
    both = pages.join(F.broadcast(often) if n <= BROADCAST_LINES else often.hint("merge"), source, "left")
    return both.withColumn("__drop", F.transform("__hashes", lambda h: F.coalesce(F.array_contains("__frequent", h), F.lit(False)))).drop("__hashes", "__frequent")


def strip_lines(pages: DataFrame, text: str = "cleaned_text", source: str = "portal_id", least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """Pages with ``text`` rebuilt without boilerplate lines, and ``n_dropped``."""
    flagged = flag_lines(pages if "__hashes" in pages.columns else hashed(pages, text), source, least, share)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.get("__drop", i)), "\n")
    n = F.coalesce(F.size(F.filter("__drop", lambda d: d)), F.lit(0))
    return flagged.withColumns({text: kept, "n_dropped": F.greatest(n, F.lit(0))}).drop("__drop")


def sourced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "packages").select("bid_id", "portal_id").dropDuplicates(["bid_id"])
    return hashed(table(spark, sf_dir, "parsed_pages").select("page_id", "bid_id", "file_name", "cleaned_text")).join(packages, "bid_id", "left")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: the boilerplate lines of every page."""
    lines = flag_lines(sourced_pages(spark, sf_dir)).select("page_id", F.posexplode("__drop").alias("pos", "drop")).where("drop")
    return lines.select("page_id", (F.col("pos") + 1).alias("line_no")).distinct()


def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_clean: every page's rebuilt text, as length and digest."""
    out = strip_lines(sourced_pages(spark, sf_dir)).dropDuplicates(["page_id"])
    return out.select("page_id", F.length("cleaned_text").alias("n_chars"), F.md5("cleaned_text").alias("digest"), "n_dropped")


_LINES_SQL = r"""
with p as (select distinct page_id, q.portal_id, bid_id, file_name, cleaned_text from parsed_pages left join packages q using (bid_id)),
l as (select *, unnest(string_split(cleaned_text, chr(10))) line, generate_subscripts(string_split(cleaned_text, chr(10)), 1) line_no from p),
n as (select *, regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') k, regexp_matches(line, '\p{L}') has from l),
t as (select portal_id, count(distinct (bid_id, file_name)) total from p group by 1),
f as (select portal_id, k from n join t using (portal_id) where has group by portal_id, k, total having count(distinct (bid_id, file_name)) >= greatest(5, 0.2 * total)),
x as (select n.*, f.k is not null as dropped from n left join f on n.portal_id = f.portal_id and n.k = f.k and n.has)
"""
FOUND_SQL = _LINES_SQL + "select page_id, cast(line_no as integer) line_no from x where dropped"
CLEAN_SQL = _LINES_SQL + """, g as (select page_id, string_agg(line, chr(10) order by line_no) filter (where not dropped) s, count(*) filter (where dropped) d from x group by 1)
select page_id, cast(length(c) as integer) n_chars, md5(c) digest, cast(coalesce(d, 0) as integer) n_dropped
from (select p.page_id, case when p.cleaned_text is null then null else coalesce(s, '') end c, d from (select distinct page_id, cleaned_text from p) p left join g using (page_id))
"""
