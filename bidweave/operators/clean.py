"""Running lines, page captions and repaired page text.

Defined results: null texts are empty pages; a page that comes again counts once; documents are (bid_id, file_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions import text as X
from bidweave.session import spread, table

DOC = ["bid_id", "file_name"]


def _norm(line: Column) -> Column:
    return F.regexp_replace(line, r"\d+", "#")


def zone_lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``zone``: of each page the (line_no, norm) of its first three and last two full lines, or first and last of at most four."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "").alias("line")))
    full = F.filter(lines, lambda x: x["line"] != "")
    n = F.size("__full")
    picked = F.when(n == 0, F.slice("__full", 1, 0)).when(n <= 4, F.concat(F.slice("__full", 1, 1), F.when(n > 1, F.slice("__full", n, 1)).otherwise(F.slice("__full", 1, 0)))).otherwise(F.concat(F.slice("__full", 1, 3), F.slice("__full", n - 1, 2)))
    zone = F.transform(picked, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), _norm(x["line"]).alias("norm")))
    return pages.withColumn("__full", full).withColumn("zone", zone).drop("__full")


def repeated_lines(zoned: DataFrame) -> DataFrame:
    """(bid_id, file_name, norm, n_pages): forms on at least two pages and 35 % of the document's pages; each page counts once."""
    forms = zoned.select(*DOC, F.explode(F.array_distinct(F.transform("zone", lambda x: x["norm"]))).alias("norm")).where(F.length("norm") > 4)
    counts = forms.groupBy(*DOC, "norm").agg(F.count(F.lit(1)).alias("n_pages"))
    sizes = zoned.groupBy(*DOC).agg(F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * 0.35))
    return counts.where("n_pages >= 2").join(sizes, DOC).where(F.col("n_pages") >= least).select(*DOC, "norm", "n_pages")


def running_lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """(page_id, drop): numbers of the lines of each page that are running lines, bare numbers or captions in its zone."""
    zoned = zone_lines(pages, text)
    rows = zoned.select("page_id", *DOC, F.explode("zone").alias("z")).select("page_id", *DOC, "z.*")
    hit = rows.join(repeated_lines(zoned).withColumn("__rep", F.lit(True)), [*DOC, "norm"], "left")
    drop = F.coalesce("__rep", F.lit(False)) | F.col("line").rlike(r"^\d{1,3}$") | F.col("norm").rlike(r"(?i)^\s*Page\s+#(?:\s*(?:of|\|)\s*#)?\s*$")
    return hit.where(drop).groupBy("page_id").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def strip_running(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``stripped`` (text without running lines) and ``label`` (caption found in it)."""
    out = pages.join(running_lines(pages, text), "page_id", "left")
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: ~F.coalesce(F.array_contains("drop", i + 1), F.lit(False)))
    return out.withColumn("stripped", F.array_join(kept, "\n")).withColumn("label", F.nullif(X.page_label(text), F.lit(""))).drop("drop")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_pages").select("page_id", *DOC, "page_number", "raw_text").dropDuplicates(["page_id"])


def _digest(name: str, repair):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spread(table(spark, d, "parsed_pages").select("page_id", "raw_text")).select("page_id", repair("raw_text").alias("s")).dropDuplicates(["page_id"]).select("page_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))

    run.__name__ = name
    return run


def q_running(spark: SparkSession, d: str) -> DataFrame:
    return running_lines(_pages(spark, d)).select("page_id", F.array_join(F.transform("drop", lambda x: x.cast("string")), ",").alias("lines"))


def q_strip(spark: SparkSession, d: str) -> DataFrame:
    return strip_running(_pages(spark, d)).select("page_id", "label", F.md5(X.clean_text("stripped")).alias("digest"))


def q_labels(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", X.page_label("raw_text").alias("label")).where("label <> ''")


QUERIES = {
    "clean_whitespace": _digest("clean_whitespace", X.normalize_whitespace),
    "fix_hyphenation": _digest("fix_hyphenation", X.fix_hyphenation),
    "fix_kerning": _digest("fix_kerning", X.fix_kerning),
    "fix_fused_words": _digest("fix_fused_words", X.fix_fused_words),
    "rejoin_split": _digest("rejoin_split", X.rejoin_split),
    "reflow_lines": _digest("reflow_lines", X.reflow_lines),
    "clean_text": _digest("clean_text", X.clean_text),
    "running_lines": q_running,
    "strip_running": q_strip,
    "page_labels": q_labels,
}
_D = "with p as (select page_id, any_value(coalesce(raw_text, '')) t from parsed_pages group by 1), s as (select page_id, {} s from p) select page_id, cast(length(s) as integer) n_chars, md5(s) digest from s"
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _nested(start: str, steps: list[tuple[str, str]]) -> str:
    for pattern, put in steps:
        p, r = pattern.replace("'", "''"), put.replace("$", "\\").replace("'", "''")
        start = f"regexp_replace({start}, '{p}', '{r}', 'g')"
    return start


def _whitespace(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({x}, '[\x{{200B}}\x{{FEFF}}\x{{AD}}]', '', 'g'), '[\x{{F000}}-\x{{F8FF}}]', '* ', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


def _kerning(x: str) -> str:
    return _nested(x, [*X.KERNING, (r"\b([A-Z]{4,})I(\s+FURTHER)", "$1 I$2"), (r"\b([A-Z]{4,})I(\s*)$", "$1 I$2")])


def _repairs(x: str) -> str:
    """The repairs of a text before its lines are reflowed."""
    x = _nested(x, [(r"([a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,})", "$1$2"), *X.SPLITS])
    return _nested(_kerning(x), [(r"\b(AUTHORITY|TAXATION|AFFIRMATION|VALID)I\b", "$1 I")])


def _reflow(source: str, name: str) -> str:
    """CTEs up to ``name`` (page_id, s): lines of ``source`` (page_id, t) are one with the next where they are fragments."""
    lines = r"string_split(regexp_replace(t, '\n\n?$', ''), chr(10))"
    return rf"""{name}l as (select page_id, generate_subscripts({lines}, 1) i, unnest(list_transform({lines}, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'))) x from {source} where t <> ''),
{name}f as (select *, x = '' or starts_with(x, '|') or ends_with(x, '|') lone, x <> '' and not starts_with(x, '|') and not ends_with(x, '|') and len(string_split_regex(x, '{_WS}+')) <= 2 and length(x) < 22 and not ends_with(x, ':') and not regexp_matches(x, '^(?:[1-9]\.|[*\-•(#])') and not (regexp_matches(x, '\p{{Lu}}') and upper(x) = x) frag from {name}l),
{name}g as (select *, sum(case when lone or i = 1 or not lag_ then 1 else 0 end) over (partition by page_id order by i) g from (select *, coalesce(lag(frag) over (partition by page_id order by i), false) lag_ from {name}f)),
{name}j as (select page_id, g, string_agg(x, ' ' order by i) x from {name}g group by 1, 2),
{name}k as (select page_id, regexp_replace(string_agg(x, chr(10) order by g), '\n{{3,}}', chr(10) || chr(10), 'g') s from {name}j group by 1),
{name} as (select page_id, coalesce(s, '') s from (select page_id from {source}) left join {name}k using (page_id))"""


_P = "p as (select page_id, any_value(coalesce(raw_text, '')) t from parsed_pages group by 1)"
_LABELS = r"""le as (select page_id, case when len(string_split(t, chr(10))) > 5 then list_concat(string_split(t, chr(10))[1:5], string_split(t, chr(10))[-5:]) else string_split(t, chr(10)) end e from p),
lb as (select page_id, coalesce(regexp_extract(list_filter(e, lambda x: regexp_matches(x, '(?i)^\s*Page\s+\d+'))[1], '(?i)^\s*Page\s+(\d+(?:\s*(?:of|\|)\s*\d+)?)', 1), '') label from le)"""
_RUNNING = r"""p as (select page_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(coalesce(raw_text, '')) t from parsed_pages group by 1),
l as (select page_id, bid_id, file_name, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) line_no from p),
f as (select page_id, bid_id, file_name, line_no, trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) line, row_number() over (partition by page_id order by line_no) a, count(*) over (partition by page_id) n from l where regexp_matches(line, '\S')),
z as (select *, regexp_replace(line, '\d+', '#', 'g') norm from f where (n <= 4 and (a = 1 or a = n)) or (n > 4 and (a <= 3 or a >= n - 1))),
s as (select bid_id, file_name, count(*) pages from p group by 1, 2),
r as (select bid_id, file_name, norm from z join s using (bid_id, file_name) where length(norm) > 4 group by 1, 2, 3, pages having count(distinct page_id) >= greatest(2, floor(pages * 0.35))),
x as (select z.page_id, z.line_no from z left join r using (bid_id, file_name, norm) where r.norm is not null or regexp_matches(z.line, '^\d{1,3}$') or regexp_matches(norm, '(?i)^\s*Page\s+#(?:\s*(?:of|\|)\s*#)?\s*$'))"""


#: CTEs up to w (page_id, s: the stripped and repaired text) and lb (page_id, label).
STRIPPED = "with " + _RUNNING + ", d as (select page_id, line_no from x), k as (select l.page_id, string_agg(line, chr(10) order by l.line_no) t from l left join d on d.page_id = l.page_id and d.line_no = l.line_no where d.line_no is null group by 1), u as (select p.page_id, p.t raw, coalesce(k.t, '') t from p left join k using (page_id)), c as (select page_id, " + _repairs("t") + " t from u), " + _reflow("c", "rf") + ", w as (select page_id, " + _whitespace("s") + " s from rf), " + _LABELS

SQL = {
    "clean_whitespace": _D.format(_whitespace("t")),
    "fix_kerning": _D.format(_kerning("t")),
    "reflow_lines": "with " + _P + ", " + _reflow("p", "r") + " select page_id, cast(length(s) as integer) n_chars, md5(s) digest from r",
    "clean_text": "with " + _P + ", c as (select page_id, " + _repairs("t") + " t from p), " + _reflow("c", "r") + ", w as (select page_id, " + _whitespace("s") + " s from r) select page_id, cast(length(s) as integer) n_chars, md5(s) digest from w",
    "page_labels": "with " + _P + ", " + _LABELS + " select page_id, label from lb where label <> ''",
    "strip_running": STRIPPED + " select page_id, nullif(label, '') label, md5(s) digest from w left join lb using (page_id)",
    "fix_hyphenation": _D.format(r"regexp_replace(t, '([a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,})', '\1\2', 'g')"),
    "fix_fused_words": _D.format(r"regexp_replace(t, '\b(AUTHORITY|TAXATION|AFFIRMATION|VALID)I\b', '\1 I', 'g')"),
    "rejoin_split": _D.format(_nested("t", X.SPLITS)),
    "running_lines": "with " + _RUNNING + """
select page_id, string_agg(cast(line_no as varchar), ',' order by line_no) lines from x group by 1""",
}
