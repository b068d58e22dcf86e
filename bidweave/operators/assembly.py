"""From page records to cleaned pages: running lines stripped over the whole document, prose repaired, tables put below their marker.

The type of a document is first read from its name alone: affidavits and forms have no tables taken; a table from word
coordinates is taken only on pages of specifications that have no other. The second reading sees the first page.
Defined results: null texts are empty pages; a page that comes again counts once; pages without prose and tables are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.functions import text as X
from bidweave.operators.chunking import TABLE_MARKER
from bidweave.operators import clean
from bidweave.operators.classify import classify, type_sql
from bidweave.operators.clean import strip_running
from bidweave.operators.tables import classify_tables, coordinate_table
from bidweave.session import spread, table

#: Types whose boxes are no tables.
WITHOUT_TABLES = ["affidavit", "form"]


def by_name(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds ``name_type``, the type that the name alone tells, and ``skip_tables``."""
    first = classify(files.withColumn("__none", F.lit(None).cast("string")), name, "__none")
    return first.withColumnsRenamed({"found_type": "name_type"}).withColumn("skip_tables", F.col("name_type").isin(WITHOUT_TABLES)).drop("__none", "found_confidence", "found_number", "found_date")


def page_tables(docs: DataFrame, cells: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc, page, tbl, text): Markdown of the tables of documents (doc, name_type, skip_tables)."""
    taken = docs.where(~F.col("skip_tables")).select("doc", F.col("name_type").alias("doc_type"))
    own = classify_tables(cells.join(taken.select("doc"), "doc", "left_semi"), taken).where("is_table").select("doc", "page", "tbl", "text")
    if words is None:
        return own
    specs = words.join(taken.where("doc_type = 'specs'").select("doc"), "doc", "left_semi").join(own.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    rows = coordinate_table(specs).groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.struct("ord", "sku", "description"))).alias("r"))
    lines = F.transform("r", lambda r: F.concat(F.lit("| "), r["sku"], F.lit(" | "), F.replace(r["description"], F.lit("|"), F.lit("\\|")), F.lit(" |")))
    return own.unionByName(rows.select("doc", "page", F.lit(0).alias("tbl"), F.array_join(F.concat(F.array(F.lit("| SKU | Description |"), F.lit("| --- | --- |")), lines), "\n").alias("text")))


def page_text(prose: Column, tables: Column) -> Column:
    """A page's text: its prose, then the marker and its tables, with blank lines between."""
    parts = F.concat(F.filter(F.array(prose), lambda p: p != ""), F.when(F.size(tables) > 0, F.concat(F.array(F.lit("\n" + TABLE_MARKER)), tables)).otherwise(F.array().cast("array<string>")))
    return X.normalize_whitespace(F.array_join(parts, "\n\n"))


def assemble(pages: DataFrame, tables: DataFrame, text: str = "raw_text") -> DataFrame:
    """Pages with ``cleaned_text`` and ``page_label``; ``tables`` has (page_id, tables: array of Markdown)."""
    stripped = strip_running(pages.dropDuplicates(["page_id"]), text)
    out = stripped.join(tables.withColumnRenamed("tables", "__tables"), "page_id", "left")
    both = page_text(X.clean_text("stripped"), F.coalesce("__tables", F.array().cast("array<string>")))
    return out.withColumns({"cleaned_text": both, "page_label": F.col("label")}).drop("stripped", "label", "__tables")


def retyped(pages: DataFrame, name: str = "file_name", doc: tuple[str, ...] = ("bid_id", "file_name")) -> DataFrame:
    """(bid_id, file_name, found_type, found_confidence, found_number, found_date): the second reading, by name and first page."""
    first = Window.partitionBy(*doc).orderBy("page_number", "page_id")
    heads = pages.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*doc, F.col("cleaned_text").alias("preview"))
    return classify(heads, name, "preview").drop("preview")


def q_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Every page, with the tables of its chunks where its name allows tables."""
    pages = spread(table(spark, d, "parsed_pages").select("page_id", "bid_id", "file_name", "page_number", "raw_text").dropDuplicates(["page_id"]))
    found = table(spark, d, "chunks").where("is_table").select("bid_id", "file_name", "page_number", F.regexp_replace("text", r"^[^\n]*\n", "").alias("md")).distinct()
    found = by_name(found).where(~F.col("skip_tables")).groupBy("bid_id", "file_name", "page_number").agg(F.sort_array(F.collect_list("md")).alias("tables"))
    tables = pages.select("page_id", "bid_id", "file_name", "page_number").join(found, ["bid_id", "file_name", "page_number"]).select("page_id", "tables")
    return assemble(pages, tables).select("page_id", "page_label", F.length("cleaned_text").alias("n_chars"), F.md5("cleaned_text").alias("digest"))


QUERIES = {"assemble_pages": q_assemble}
SQL = {
    "assemble_pages": clean.STRIPPED
    + ", nt as (select * from ("
    + type_sql("select distinct file_name file_id, lower(coalesce(file_name, '')) n, cast(null as varchar) p, '' h from chunks")
    + f""")),
tm as (select bid_id, file_name, page_number, string_agg(md, chr(10) || chr(10) order by md) md from (select distinct bid_id, file_name, page_number, regexp_replace(text, '^[^\\n]*\\n', '') md from chunks where is_table) join nt on file_id = file_name where found_type not in ('affidavit', 'form') group by 1, 2, 3),
pg as (select page_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(page_number) page_number from parsed_pages group by 1),
o as (select page_id, nullif(label, '') page_label, {clean._whitespace(f"concat_ws(chr(10) || chr(10), nullif(s, ''), case when md is not null then chr(10) || '{TABLE_MARKER}' end, md)")} t from w join pg using (page_id) left join tm using (bid_id, file_name, page_number) left join lb using (page_id))
select page_id, page_label, cast(length(t) as integer) n_chars, md5(t) digest from o"""
}
