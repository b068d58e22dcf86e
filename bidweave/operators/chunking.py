"""Section-aware chunks: segments, packing with overlap, headings, headers, ids, merging, near-copies, tables.

Segments, token counts and headings are made in the JVM; where chunks begin and end is a linear fold in Arrow batches that
sees only each page's counts and headings, no text. Only section carry-forward orders the pages of a document.
Defined results: null and blank pages give no chunk; a page that comes again counts once; ids that would repeat get an
ordinal; chunks of an unknown page (null file name or number) are no copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.config import SETTINGS
from bidweave.functions import text as X
from bidweave.operators import chunking_sql
from bidweave.session import spread, table

#: Fixed value: the line after which a page's text has its tables in Markdown.
TABLE_MARKER = "### Specification / Bid Tables:"
#: Single words that are headings by themselves.
HEADINGS = ["OVERVIEW", "INTRODUCTION", "SCOPE", "SPECIFICATIONS", "REQUIREMENTS", "SUMMARY", "BACKGROUND", "DELIVERABLES", "TIMELINE", "SCHEDULE", "PRICING", "EVALUATION", "ATTACHMENTS", "EXHIBITS", "INSTRUCTIONS", "CONTRACT", "GENERAL", "PURPOSE", "ELIGIBILITY", "SUBMISSION", "AFFIRMATION", "AFFIDAVIT", "DISCLOSURE", "WORKPLACE", "AUTHORITY"]


def segments(text: Column) -> Column:
    """Paragraphs; those over the limit by sentences."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    full = lambda x: F.filter(x, lambda s: s != "")
    paragraphs = full(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), strip))
    parts = F.transform(paragraphs, lambda p: F.when(X.count_tokens(p) > SETTINGS.long_paragraph, full(F.transform(F.split(p, r"(?<=[.!?])\s+"), strip))).otherwise(F.array(p)))
    return F.flatten(parts)


def spans(counts: list[int], heads: list[str | None], first: str | None, start: str | None, size: int, overlap: int) -> list[tuple[int, int, str | None]]:
    """(from, to, section) of each chunk over a page's segments: packed to ``size`` tokens, each beginning with the last segments of the one before, within ``overlap`` tokens but one at least.

    ``heads`` has the last heading of each segment, ``first`` the section at the page's start; a chunk's section is that at its start, ``start`` for the first.
    """
    out: list[tuple[int, int, str | None]] = []
    lo, n, active, own = 0, 0, first, start
    for i, (c, h) in enumerate(zip(counts, heads)):
        active = h or active
        if n + c > size and i > lo:
            out.append((lo, i, own))
            k, kept = i - 1, counts[i - 1]
            while k > lo and kept + counts[k - 1] <= overlap:
                k -= 1
                kept += counts[k]
            lo, n, own = k, kept, active
        n += c
    return [*out, (lo, len(counts), own)] if counts else []


def packed(counts: Column, heads: Column, first: Column, start: Column, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> Column:
    """``spans`` of every page, as an array."""

    @F.pandas_udf("array<struct<lo:int,hi:int,section:string>>")
    def run(n: pd.Series, h: pd.Series, f: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([[{"lo": lo, "hi": hi, "section": own} for lo, hi, own in spans([int(x) for x in c], list(k), a, b, size, overlap)] for c, k, a, b in zip(n, h, f, s)])

    return run(counts, heads, first, start)


def bodies(text: str = "text", size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> Callable[[DataFrame], DataFrame]:
    """Adds ``bodies``, the packed bodies of each text, without sections."""

    def run(df: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        df = df.withColumn("__s", segments(F.col(text)))
        df = df.withColumn("__n", F.transform("__s", lambda x: X.count_tokens(x)))
        df = df.withColumn("__p", packed(F.col("__n"), F.transform("__s", lambda x: none), none, none, size, overlap))
        return df.withColumn("bodies", F.transform("__p", lambda p: joined(F.col("__s"), p))).drop("__s", "__n", "__p")

    return run


def joined(parts: Column, span: Column) -> Column:
    return F.array_join(F.slice(parts, span["lo"] + 1, span["hi"] - span["lo"]), "\n\n")


def heading(line: Column) -> Column:
    """The heading that a line is, or null. Title case follows white space only. The patterns and limits are fixed values."""
    s = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    digits = F.regexp_count(s, F.lit(r"\d"))
    reject = (s == "") | s.startswith("|") | s.endswith("|") | s.rlike(r"(?i)\bEND\s+OF\s+(?:ADDENDUM|SOLICITATION|DOCUMENT|SECTION|FILE|PROPOSAL)\b")
    reject = reject | s.rlike(r"^[A-Z][a-zA-Z]+,\s+[A-Z][a-zA-Z]+(?:\s+[A-Z]\.?)?$") | F.upper(s).rlike(r"^(?:BUYER|CONTACT|OFFICER|NAME:|AFFIANT|REPRESENTATIVE)")
    reject = reject | s.rlike(r"^\w+[-_]\w+$") | ((digits > 0) & ((digits / F.length(s) > 0.18) | (digits >= 5)))
    section = F.regexp_extract(s, r"^(?:Section|SECTION|Article|ARTICLE|Part|PART)\s+([0-9A-Za-z.-]+(?:\s*[-:–]\s*[^\n]+)?)", 0)
    mark = F.trim(F.regexp_extract(s, r"^#{1,4}\s+([^\n]+)", 1))
    caps = F.regexp_replace(s, r"\b([A-Z]{4,})I\b", "$1")
    words = F.regexp_extract_all(caps, F.lit(r"\b[A-Za-z]{3,}\b"), F.lit(0))
    upper = caps.rlike(r"\p{Lu}") & (F.upper(caps) == caps) & F.length(caps).between(5, 54) & ~caps.endswith(".") & ~caps.contains(",")
    known = F.exists(words, lambda w: w.isin(HEADINGS))
    return (
        F.when(reject, None)
        .when(section != "", F.trim(section))
        .when(s.rlike(r"(?i)^addendum"), F.initcap(s))
        .when((mark != "") & ~mark.rlike(r"^\w+[-_]\w+$"), mark)
        .when(upper & ((F.size(words) >= 2) | known), F.regexp_replace(F.initcap(caps), r"(?<=[a-zA-Z]{4})[iI]$", ""))
    )


#: Only lines of these forms can be headings: section words, marks, or no small letter outside a fused roman one.
_MAYBE = r"(?U)^\s*(?:#{1,4}\s|(?i:section|article|part|addendum)|[^\p{Ll}]*$)"


def headings(lines: Column) -> Column:
    """The headings among lines, in order."""
    return F.filter(F.transform(F.filter(lines, lambda x: x.rlike(_MAYBE)), heading), lambda h: h.isNotNull())


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def sections(pages: DataFrame, text: str = "cleaned_text", doc: tuple[str, ...] = ("bid_id", "file_name")) -> DataFrame:
    """Adds ``section``, that of the page's start: its first line if it is a heading, else the last heading of the document's pages before, else the first heading of its first five lines."""
    order = Window.partitionBy(*doc).orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    df = pages.withColumn("__lines", _lines(F.coalesce(text, F.lit(""))))
    heads = headings(F.col("__lines"))
    df = df.withColumns({"__last": F.element_at(F.when(F.size(heads) > 0, heads), -1), "__first": F.get(headings(F.slice("__lines", 1, 1)), F.lit(0)), "__any": F.get(headings(F.slice("__lines", 1, 5)), F.lit(0))})
    df = df.withColumn("__carried", F.coalesce("__first", F.last("__last", ignorenulls=True).over(order)))
    return df.withColumn("section", F.coalesce("__carried", "__any", F.lit("General"))).drop("__last", "__first", "__any", "__carried", "__lines")


def chunk_pages(pages: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """(page columns, seq, is_table, section, context_header, chunk_id, text): the chunks of every page, its tables first, then the prose before the table marker.

    A table's section is the first heading of the page's first five lines (the marker counts as one), else that in force before the page, else one by the document's type.
    """
    doc = ("bid_id", "file_name")
    last = lambda x: F.element_at(F.when(F.size(x) > 0, x), -1)
    marker = r"\Q" + TABLE_MARKER + r"\E"
    cut = F.split(F.coalesce(text, F.lit("")), marker, 2)
    df = pages.withColumns({"__segs": segments(F.get(cut, F.lit(0))), "__md": F.filter(F.transform(F.split(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), r"\n\s*\n"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), lambda t: t != "")})
    df = df.withColumns({"__n": F.transform("__segs", lambda s: X.count_tokens(s)), "__h": F.transform("__segs", lambda s: last(headings(F.split(s, "\n"))))})
    heads = F.filter("__h", lambda h: h.isNotNull())
    df = df.withColumns({"__last": last(heads), "__first": F.get(headings(F.slice(_lines(F.coalesce(F.get("__segs", F.lit(0)), F.lit(""))), 1, 1)), F.lit(0)), "__any": F.get(headings(F.slice(_lines(F.coalesce(text, F.lit(""))), 1, 5)), F.lit(0)), "__prose": F.get(headings(F.slice(_lines(F.coalesce(F.get(cut, F.lit(0)), F.lit(""))), 1, 5)), F.lit(0))})
    order = Window.partitionBy(*doc).orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__before", F.last("__last", ignorenulls=True).over(order)).withColumn("__active", F.coalesce("__first", "__before"))
    df = df.withColumn("__p", packed(F.col("__n"), F.col("__h"), F.col("__active"), F.coalesce("__active", "__prose", F.lit("General"))))
    prose = F.transform("__p", lambda p, i: F.struct(F.struct(F.lit(1).alias("a"), i.alias("b"), F.lit(0).alias("c")).alias("seq"), F.lit(False).alias("is_table"), F.concat(F.lit("c"), i.cast("string")).alias("suffix"), p["section"].alias("section"), joined(F.col("__segs"), p).alias("body")))
    title = F.coalesce("__any", "__before", F.when(F.col("doc_type") == "specs", "Specifications").otherwise(F.concat(F.lit("Table (p."), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(")"))))

    def parts(md: Column, i: Column) -> Column:
        pieces = split_table(md)
        name = F.concat(F.lit("tbl_"), i.cast("string"))
        return F.transform(pieces, lambda t, k: F.struct(F.struct(F.lit(0).alias("a"), i.alias("b"), k.alias("c")).alias("seq"), F.lit(True).alias("is_table"), F.when(F.size(pieces) > 1, F.concat(name, F.lit("_part"), k.cast("string"))).otherwise(name).alias("suffix"), title.alias("section"), t.alias("body")))

    kept = [c for c in pages.columns if c not in (text, "seq", "is_table", "section", "context_header", "chunk_id", "text")]
    df = df.select(*kept, F.explode(F.concat(F.flatten(F.transform("__md", parts)), prose)).alias("c")).select(*kept, "c.*")
    df = df.withColumn("seq", F.row_number().over(Window.partitionBy(*doc, "page_number", "page_id").orderBy("seq")) - 1)
    df = df.withColumn("context_header", X.context_header("bid_id", "doc_type", "addendum_number", "file_name", "page_number", "section"))
    df = df.withColumn("text", F.concat("context_header", F.lit("\n"), "body")).withColumn("chunk_id", X.chunk_id("bid_id", "file_name", "page_number", "suffix", "text"))
    again = F.row_number().over(Window.partitionBy("chunk_id").orderBy("page_id", "seq"))
    df = df.withColumn("__n", again).withColumn("chunk_id", F.when(F.col("__n") > 1, F.concat("chunk_id", F.lit("_"), F.col("__n").cast("string"))).otherwise(F.col("chunk_id")))
    return df.drop("__n", "body", "suffix")


def filled(text: str = "text") -> Column:
    """Whether a chunk is no form left blank."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)\[unfilled/blank\]")) < 5


def chunk_document(pages: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """(bid_id, file_name, page_number, seq, chunk_id, n_parts, is_table, text): the chunks of whole documents: packed, near-copies on a page left out, small ones merged, blank forms left out."""
    raw = chunk_pages(pages, text)
    raw = raw.join(near_copies(raw).where("kept").select("chunk_id"), "chunk_id", "left_semi")
    return merge_small(raw).where(filled()).withColumnRenamed("island", "seq")


def merge_small(chunks: DataFrame, page: tuple[str, ...] = ("bid_id", "file_name", "page_number"), order: str = "seq", least: int = SETTINGS.min_chunk_words) -> DataFrame:
    """Small chunks join the chunk before them on their page: islands that start at each chunk that isn't small, is a table, or is the page's first."""
    body = F.when(F.col("text").contains("\n"), F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise(F.col("text"))
    words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
    w = Window.partitionBy(*page).orderBy(order)
    df = chunks.withColumns({"__body": body, "__small": (words < least) & ~F.coalesce("is_table", F.lit(False)), "__first": F.row_number().over(w) == 1})
    df = df.withColumn("island", F.sum(F.when(F.col("__small") & ~F.col("__first"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct(F.col(order).alias("o"), F.when(F.col("__small") & ~F.col("__first"), F.col("__body")).otherwise(F.col("text")).alias("t"), "chunk_id")
    out = df.groupBy(*page, "island").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min_by(F.coalesce("is_table", F.lit(False)), order).alias("is_table"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")
    file, number = page[1], page[2]
    cid = F.when(F.size("p") > 1, X.chunk_id(page[0], file, number, F.lit("merged"), text)).otherwise(F.col("p")[0]["chunk_id"])
    return out.select(*page, "island", cid.alias("chunk_id"), F.size("p").alias("n_parts"), "is_table", text.alias("text"))


def near_copies(chunks: DataFrame, page: tuple[str, ...] = ("bid_id", "file_name", "page_number"), least: float = SETTINGS.near_dup_overlap) -> DataFrame:
    """(page..., chunk_id, kept): greedy removal on each page of chunks whose word set overlaps a kept one's by more than ``least`` of the smaller.

    The greedy choice depends on the order of a page's chunks, so it is a fold over each page; pages are independent.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("text", r"^\[[^\n]*\]\n", "")), F.lit(r"(?U)\w{3,}"), F.lit(0)))
    docs = chunks.select(*page, "chunk_id", "seq", words.alias("w")).dropDuplicates(["chunk_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                kept: list[set] = []
                for m in row.members:
                    s = set(m["w"])
                    keep = not any(k and s and len(k & s) / min(len(k), len(s)) > least for k in kept)
                    if keep:
                        kept.append(s)
                    out.append((m["chunk_id"], keep))
            yield pd.DataFrame(out, columns=["chunk_id", "kept"])

    # A page is a page of paper: its chunks fit a row. Chunks of an unknown page are left as they are.
    known = F.col(page[1]).isNotNull() & F.col(page[2]).isNotNull()
    alone = docs.where(~known).select("chunk_id", F.lit(True).alias("kept"))
    pages = docs.where(known).groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("seq", "chunk_id", "w"))).alias("members"))
    return pages.select("members").mapInPandas(run, "chunk_id string, kept boolean").unionByName(alone)


def split_table(markdown: Column, whole: int = SETTINGS.table_max_chunk_size, size: int = SETTINGS.chunk_size * 4) -> Column:
    """Pieces of a Markdown table over ``whole`` characters: groups of rows below the two header lines, each closed by the row that reaches ``size``."""
    lines = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x) != "")
    head = F.array_join(F.slice(lines, 1, 2), "\n")

    def step(acc: Column, row: Column) -> Column:
        cur = F.concat(acc["cur"], F.lit("\n"), row)
        full = F.length(cur) >= size
        return F.struct(F.when(full, F.concat(acc["done"], F.array(cur))).otherwise(acc["done"]).alias("done"), F.when(full, acc["head"]).otherwise(cur).alias("cur"), acc["head"].alias("head"))

    start = F.struct(F.array().cast("array<string>").alias("done"), head.alias("cur"), head.alias("head"))
    grouped = F.aggregate(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), start, step, lambda a: F.when(a["cur"] != a["head"], F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return F.when(markdown.isNull(), F.array().cast("array<string>")).when((F.length(markdown) <= whole) | (F.size(lines) < 3), F.array(markdown)).otherwise(grouped)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").select("bid_id", "file_name", "addendum_number").dropDuplicates(["bid_id", "file_name"])
    pages = table(spark, d, "parsed_pages").select("page_id", "bid_id", "file_name", "doc_type", "page_number", "cleaned_text").dropDuplicates(["page_id"])
    return pages.join(files, ["bid_id", "file_name"], "left")


def q_pack(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of all pages, of which the long tables stand in chunks' texts: a page's own table chunks follow its marker."""
    tables = table(spark, d, "chunks").where("is_table").select("bid_id", "file_name", "page_number", F.regexp_replace("text", r"^[^\n]*\n", "").alias("md"))
    tables = tables.groupBy("bid_id", "file_name", "page_number").agg(F.array_join(F.sort_array(F.collect_set("md")), "\n\n").alias("md"))
    pages = spread(_pages(spark, d)).join(tables, ["bid_id", "file_name", "page_number"], "left")
    pages = pages.withColumn("cleaned_text", F.when(F.col("md").isNotNull(), F.concat(F.coalesce("cleaned_text", F.lit("")), F.lit(f"\n\n{TABLE_MARKER}\n\n"), "md")).otherwise(F.col("cleaned_text"))).drop("md")
    return chunk_pages(pages).select("page_id", "seq", "is_table", "section", "chunk_id", X.count_tokens("text").alias("n_tokens"), F.md5("text").alias("digest"))


def q_document(spark: SparkSession, d: str) -> DataFrame:
    return chunk_document(spread(_pages(spark, d))).select("bid_id", "file_name", "page_number", "seq", "chunk_id", "n_parts", F.md5("text").alias("digest"))


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", X.count_tokens("text").alias("n_tokens")).distinct()


def _seq(chunks: DataFrame) -> DataFrame:
    return chunks.dropDuplicates(["chunk_id"]).withColumn("seq", F.row_number().over(Window.partitionBy("bid_id", "file_name", "page_number").orderBy("chunk_id")))


def q_merge(spark: SparkSession, d: str) -> DataFrame:
    chunks = _seq(table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name", "page_number", "text", "is_table"))
    return merge_small(chunks).select("bid_id", "file_name", "page_number", "island", "n_parts", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def q_copies(spark: SparkSession, d: str) -> DataFrame:
    return near_copies(_seq(table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name", "page_number", "text")))


def q_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "parsed_pages").select("page_id", F.explode(F.array_distinct(F.split("cleaned_text", "\n"))).alias("line"))
    return lines.select("page_id", "line", heading(F.col("line")).alias("heading")).where("heading is not null").groupBy("heading").agg(F.count_distinct("page_id").alias("pages"))


def q_unfilled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where(filled()).select("chunk_id", "is_table").distinct()


def q_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("is_table").select("chunk_id", F.regexp_replace("text", r"^[^\n]*\n", "").alias("md")).dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", F.posexplode(split_table(F.col("md"))).alias("part", "piece")).select("chunk_id", "part", F.length("piece").alias("n_chars"))


QUERIES = {"chunk_pack": q_pack, "chunk_document": q_document, "count_tokens": q_tokens, "merge_small": q_merge, "near_copies": q_copies, "heading_lines": q_headings, "drop_blank_forms": q_unfilled, "split_tables": q_tables}
SQL = {
    "chunk_pack": chunking_sql.pack(HEADINGS, TABLE_MARKER),
    "chunk_document": chunking_sql.document(HEADINGS, TABLE_MARKER),
    "heading_lines": chunking_sql.heading_lines(HEADINGS),
    "split_tables": chunking_sql.SPLIT_TABLES,
    "near_copies": chunking_sql.NEAR_COPIES,
    "count_tokens": r"select distinct chunk_id, cast(coalesce(len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\x{200c}\x{200d}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\x{200c}\x{200d}\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')), 0) as integer) n_tokens from chunks",
    "drop_blank_forms": r"select distinct chunk_id, is_table from chunks where len(regexp_extract_all(text, '(?i)\[unfilled/blank\]')) < 5",
    "merge_small": r"""with c as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(page_number) page_number, any_value(text) t, any_value(is_table) tb from chunks group by 1),
b as (select *, case when contains(t, chr(10)) then regexp_replace(t, '^[^\n]*\n', '') else t end body, row_number() over (partition by bid_id, file_name, page_number order by chunk_id) seq from c),
s as (select *, len(list_filter(string_split_regex(body, '\s+'), lambda x: x <> '')) < 40 and not coalesce(tb, false) and seq > 1 small from b),
i as (select *, sum(case when small then 0 else 1 end) over (partition by bid_id, file_name, page_number order by seq) island from s),
g as (select bid_id, file_name, page_number, island, count(*) n, string_agg(case when small then body else t end, chr(10) || chr(10) order by seq) x from i group by 1, 2, 3, 4)
select bid_id, file_name, page_number, cast(island as bigint) island, cast(n as integer) n_parts, cast(length(x) as integer) n_chars, md5(x) digest from g""",
}
