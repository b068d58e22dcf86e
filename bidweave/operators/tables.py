"""Tables and page facts: real tables against layout boxes, tables from word coordinates, page status, coverage.

Cells come as rows (doc, page, tbl, row, col, text), words as boxes (doc, page, x0, y0, x1, y1, text).
Defined results: null cells are empty; a table of fewer than two full rows gives no row; ties of the modal column go to the smaller bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.session import table

KEY = ["doc", "page", "tbl"]


def classify_tables(cells: DataFrame, doc_types: DataFrame | None = None) -> DataFrame:
    """(doc, page, tbl, is_table, text): Markdown of real tables, prose of layout boxes, empty text for noise."""
    c = cells.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    rows = c.groupBy(*KEY, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("r"), F.max("col").alias("last"), F.max(F.length("text")).alias("most"))
    rows = rows.where("most > 0")
    shape = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), (F.max("last") + 1).alias("n_cols"), F.sort_array(F.collect_list(F.struct("row", "r"))).alias("rows"))
    full = c.join(rows.select(*KEY, "row"), [*KEY, "row"], "left_semi").where("text <> ''")
    counts = full.groupBy(*KEY, "col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))
    stats = counts.join(shape.select(*KEY, "n_rows"), KEY).groupBy(*KEY).agg(F.sum("n").alias("n_full"), F.sum("chars").alias("chars"), F.max("longest").alias("longest"), F.count(F.when(F.col("n") >= F.greatest(F.lit(1.0), F.col("n_rows") * 0.25), 1)).alias("populated"))
    df = shape.join(stats, KEY).where("n_rows >= 2")
    df = df.join(doc_types, "doc", "left") if doc_types is not None else df.withColumn("doc_type", F.lit(None).cast("string"))
    empty = 1 - F.col("n_full") / (F.col("n_rows") * F.col("n_cols"))
    noise = (F.col("n_cols") >= 2) & ((F.col("n_cols") >= 8) | (empty > 0.60))
    narrative = (F.coalesce("doc_type", F.lit("")) != "specs") & ((F.col("chars") / F.col("n_full") > 120) | (F.col("longest") > 250))
    real = ~noise & (F.col("n_cols") >= 2) & (F.col("populated") >= 2) & ~narrative

    def at(r: Column, i: Column) -> Column:
        return F.coalesce(F.get(F.transform(F.filter(r, lambda x: x["col"] == i), lambda x: x["text"]), F.lit(0)), F.lit(""))

    columns = F.sequence(F.lit(0), F.col("n_cols") - 1)
    safe = lambda x: F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda values: F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    head = F.transform(columns, lambda i: at(F.col("rows")[0]["r"], i))
    named = F.when(F.array_max(F.transform(head, lambda h: F.length(h))) > 0, F.transform(head, lambda h, i: F.when(h == "", F.concat(F.lit("Field "), (i + 1).cast("string"))).otherwise(h)))
    named = named.when(F.col("n_cols") == 2, F.array(F.lit("Item / Specification"), F.lit("Requirement / Detail"))).otherwise(F.transform(columns, lambda i: F.concat(F.lit("Field "), (i + 1).cast("string"))))
    body = F.transform(F.slice("rows", 2, F.col("n_rows")), lambda x: line(F.transform(columns, lambda i: safe(at(x["r"], i)))))
    markdown = F.array_join(F.concat(F.array(line(F.transform(named, safe)), line(F.transform(columns, lambda i: F.lit("---")))), body), "\n")
    return df.select(*KEY, real.alias("is_table"), F.when(real, markdown).when(noise, "").otherwise(prose(F.col("rows"))).alias("text"))


def prose(rows: Column) -> Column:
    """Rows as paragraphs: one cell as it is, two as ``key: value``, more joined by dashes."""
    full = F.transform(rows, lambda x: F.filter(F.transform(x["r"], lambda c: F.trim(F.replace(c["text"], F.lit("\n"), F.lit(" ")))), lambda c: c != ""))
    each = F.transform(F.filter(full, lambda r: F.size(r) > 0), lambda r: F.when(F.size(r) == 2, F.array_join(r, ": ")).otherwise(F.array_join(r, " - ")))
    return F.array_join(each, "\n\n")


def coordinate_table(words: DataFrame) -> DataFrame:
    """(doc, page, sku, description): rows paired by height on pages with at least four codes in one column.

    Each code owns the words left of the code column from 8 above it to 8 above the next one.
    """
    page = ["doc", "page"]
    codes = words.where(F.col("text").rlike(r"^[A-Za-z0-9]{3,}-[A-Za-z0-9]{3,}$")).withColumn("bucket", (F.bround(F.col("x0") / 30) * 30).cast("int"))
    enough = codes.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").drop("n")
    modal = codes.join(enough, page).groupBy(*page, "bucket").agg(F.count(F.lit(1)).alias("n"))
    modal = modal.groupBy(*page).agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("bucket"), F.max("n").alias("n")).where("n >= 4").drop("n")
    own = codes.join(modal, [*page, "bucket"])
    whole = own.groupBy(*page).agg((F.min("x0") - 10).alias("split"), (F.min("y0") - 15).alias("top"), (F.max("y1") + 15).alias("bottom"))
    order = Window.partitionBy(*page).orderBy("y0", "x0", "text")
    spans = own.join(whole, page).withColumns({"ord": F.row_number().over(order), "lo": F.col("y0") - 8, "hi": F.coalesce(F.lead("y0").over(order) - 8, F.col("bottom") + 10)})
    spans = spans.select(*page, "ord", F.col("text").alias("sku"), "lo", "hi", "split", "top", "bottom")
    left = words.select(*page, "x0", "x1", "y0", "text")
    hit = spans.join(left, page).where("x1 <= split and y0 between top and bottom and y0 >= lo and y0 < hi")
    word = F.struct(F.bround(F.col("y0") / 6).alias("line"), "x0", "text")
    out = hit.groupBy(*page, "ord", "sku").agg(F.sort_array(F.collect_list(word)).alias("w"))
    return out.select(*page, "ord", "sku", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("description"))


def page_status(pages: DataFrame) -> DataFrame:
    """Adds ``status`` from (char_count, drawings, images, widgets); the order of the cases counts."""
    few = F.col("char_count") < 30
    vector = few & (F.col("drawings") > 20)
    status = (
        F.when(vector & (F.col("widgets") > 0), "vector_outlines_form")
        .when(vector, "vector_outlines")
        .when((F.col("char_count") == 0) & (F.col("images") == 0) & (F.col("widgets") == 0), "blank")
        .when(few, "scanned")
        .when(F.col("widgets") > 0, "form_widgets")
        .otherwise("extractable")
    )
    return pages.withColumn("status", status)


def coverage(statuses: DataFrame, doc: tuple[str, ...] = ("bid_id", "file_name")) -> DataFrame:
    """Per document: pages, pages by status, whether any page has no text."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    return statuses.groupBy(*doc).agg(F.count(F.lit(1)).alias("n_pages"), n("extractable"), n("scanned"), n("blank"), n("form_widgets"), n("vector_outlines"), n("vector_outlines_form"), F.bool_or(F.col("status") != "extractable").alias("has_gaps"))


def q_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of every page, roll-up by document; the tables count no drawings, so they are made up from the page's number."""
    pages = table(spark, d, "parsed_pages").dropDuplicates(["page_id"])
    facts = pages.select("page_id", "bid_id", "file_name", F.coalesce(F.length(F.trim("raw_text")), F.lit(0)).alias("char_count"), (F.coalesce("page_id", F.lit(0)) % 60).alias("drawings"), F.coalesce("is_scanned", F.lit(False)).cast("int").alias("images"), F.coalesce("widget_count", F.lit(0)).alias("widgets"))
    return coverage(page_status(facts))


def cells_of(chunks: DataFrame) -> DataFrame:
    """Cells of the Markdown tables in chunk texts."""
    rows = chunks.where("is_table").select(F.col("chunk_id").alias("doc"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^[|\s:-]+$"))).alias("row", "line")).distinct()
    inner = F.regexp_replace("line", r"^\|\s*|\s*\|\s*$", "")
    return rows.select("doc", F.lit(1).alias("page"), F.lit(1).alias("tbl"), "row", F.posexplode(F.split(inner, r"\s*\|\s*")).alias("col", "text"))


def q_tables(spark: SparkSession, d: str) -> DataFrame:
    out = classify_tables(cells_of(table(spark, d, "chunks").select("chunk_id", "text", "is_table")))
    return out.select("doc", "is_table", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def q_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """The cells of chunks' tables as word boxes (of a column 110 wide and a line 20 high, each word 9 further), put together again by coordinates."""
    cells = cells_of(table(spark, d, "chunks").select("chunk_id", "text", "is_table"))
    words = cells.select("doc", "page", "row", "col", F.posexplode(F.split("text", " ")).alias("k", "text")).where("text <> ''")
    x = F.col("col") * 110.0 + F.col("k") * 9.0
    boxes = words.select("doc", "page", x.alias("x0"), (F.col("row") * 20.0).alias("y0"), (x + 8.0).alias("x1"), (F.col("row") * 20.0 + 10.0).alias("y1"), "text")
    return coordinate_table(boxes).select("doc", "ord", "sku", F.md5("description").alias("digest"))


def q_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user counted in the interval from one error to the next: the pairing of words and codes on time."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = e.withColumn("interval_no", F.sum((F.col("event_type") == "error").cast("int")).over(order))
    return seen.where("interval_no > 0").groupBy("user_id", "interval_no").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("from_ts"))


QUERIES = {"coverage_rollup": q_status, "table_or_layout": q_tables, "interval_assign": q_intervals, "coordinate_tables": q_coordinates}
SQL = {
    "table_or_layout": r"""with l as (select distinct chunk_id doc, text from chunks where is_table),
r as (select doc, unnest(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|') and not regexp_matches(x, '^[|\s:-]+$'))) line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|') and not regexp_matches(x, '^[|\s:-]+$')), 1) - 1 rw from l),
i as (select doc, rw, string_split_regex(regexp_replace(line, '^\|\s*|\s*\|\s*$', '', 'g'), '\s*\|\s*') v from r),
c as (select doc, rw, unnest(list_transform(v, lambda x: trim(x))) t, generate_subscripts(v, 1) - 1 cl from i),
k as (select doc, rw, max(cl) last from c group by 1, 2 having max(length(t)) > 0),
s as (select doc, count(*) n_rows, max(last) + 1 n_cols from k group by 1),
n as (select doc, cl, count(*) n, sum(length(t)) chars, max(length(t)) longest from c join k using (doc, rw) where t <> '' group by 1, 2),
z as (select doc, n_rows, n_cols, sum(n) n_full, sum(chars) chars, max(longest) longest, count(*) filter (where n >= greatest(1.0, n_rows * 0.25)) populated from n join s using (doc) where n_rows >= 2 group by 1, 2, 3),
y as (select *, n_cols >= 2 and (n_cols >= 8 or 1 - n_full / (n_rows * n_cols) > 0.60) noise, chars / n_full > 120 or longest > 250 narrative from z),
x as (select *, not noise and n_cols >= 2 and populated >= 2 and not narrative is_real from y),
g as (select x.doc, n_cols, rk, j.cl, coalesce(t, '') t from x join (select doc, rw, row_number() over (partition by doc order by rw) rk from k) q using (doc), lateral (select unnest(range(n_cols)) cl) j left join c on c.doc = x.doc and c.rw = q.rw and c.cl = j.cl),
h as (select g.doc, rk, g.cl, case when rk > 1 or t <> '' then t when hd.any_ then 'Field ' || (g.cl + 1) when n_cols = 2 then case g.cl when 0 then 'Item / Specification' else 'Requirement / Detail' end else 'Field ' || (g.cl + 1) end t from g join (select doc, bool_or(t <> '') any_ from g where rk = 1 group by 1) hd using (doc)),
m as (select doc, rk, '| ' || string_agg(replace(replace(t, '|', '\|'), chr(10), ' '), ' | ' order by cl) || ' |' line from h group by 1, 2),
md as (select m.doc, max(case when rk = 1 then line end) || chr(10) || '| ' || array_to_string(list_transform(range(any_value(n_cols)), lambda q: '---'), ' | ') || ' |' || coalesce(chr(10) || string_agg(case when rk > 1 then line end, chr(10) order by rk), '') t from m join x using (doc) group by 1),
pr as (select doc, rw, count(*) n, string_agg(t, ': ' order by cl) two, string_agg(t, ' - ' order by cl) more from c where t <> '' group by 1, 2),
pt as (select doc, string_agg(case when n = 2 then two else more end, chr(10) || chr(10) order by rw) t from pr join k using (doc, rw) group by 1),
o as (select x.doc, is_real, case when is_real then md.t when noise then '' else pt.t end t from x left join md using (doc) left join pt using (doc))
select doc, is_real is_table, cast(length(t) as integer) n_chars, md5(t) digest from o""",
    "coordinate_tables": r"""with l as (select distinct chunk_id doc, text from chunks where is_table),
r as (select doc, unnest(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|') and not regexp_matches(x, '^[|\s:-]+$'))) line, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|') and not regexp_matches(x, '^[|\s:-]+$')), 1) - 1 rw from l),
c as (select doc, rw, unnest(string_split_regex(regexp_replace(line, '^\|\s*|\s*\|\s*$', '', 'g'), '\s*\|\s*')) t, generate_subscripts(string_split_regex(regexp_replace(line, '^\|\s*|\s*\|\s*$', '', 'g'), '\s*\|\s*'), 1) - 1 cl from r),
w0 as (select doc, rw, cl, unnest(string_split(t, ' ')) t, generate_subscripts(string_split(t, ' '), 1) - 1 k from c),
w as (select doc, cl * 110.0 + k * 9.0 x0, rw * 20.0 y0, cl * 110.0 + k * 9.0 + 8.0 x1, rw * 20.0 + 10.0 y1, t from w0 where t <> ''),
k as (select *, cast(round_even(cast(x0 as double) / 30, 0) * 30 as integer) bk from w where regexp_matches(t, '^[A-Za-z0-9]{3,}-[A-Za-z0-9]{3,}$')),
m as (select doc, bk from (select doc, bk, count(*) n from k where doc in (select doc from k group by 1 having count(*) >= 4) group by 1, 2) where n >= 4 qualify row_number() over (partition by doc order by n desc, bk) = 1),
o as (select k.* from k join m using (doc, bk)),
h as (select doc, min(x0) - 10 sp, min(y0) - 15 tp, max(y1) + 15 bt from o group by 1),
s as (select o.doc, t sku, sp, tp, bt, row_number() over v ord, y0 - 8 lo, coalesce(lead(y0) over v - 8, bt + 10) hi from o join h using (doc) window v as (partition by o.doc order by y0, x0, t)),
d as (select s.doc, ord, sku, string_agg(w.t, ' ' order by round_even(cast(y0 as double) / 6, 0), x0, w.t) x from s join w on w.doc = s.doc and x1 <= sp and y0 between tp and bt and y0 >= lo and y0 < hi group by 1, 2, 3)
select doc, cast(ord as integer) ord, sku, md5(x) digest from d""",
    "coverage_rollup": """with p as (select page_id, any_value(bid_id) bid_id, any_value(file_name) file_name, coalesce(length(trim(any_value(raw_text))), 0) ch, page_id % 60 dr, coalesce(any_value(is_scanned), false)::int im, coalesce(any_value(widget_count), 0) wi from parsed_pages group by 1),
s as (select *, case when ch < 30 and dr > 20 then case when wi > 0 then 'vector_outlines_form' else 'vector_outlines' end when ch = 0 and im = 0 and wi = 0 then 'blank' when ch < 30 then 'scanned' when wi > 0 then 'form_widgets' else 'extractable' end st from p)
select bid_id, file_name, count(*) n_pages, count(*) filter (where st = 'extractable') n_extractable, count(*) filter (where st = 'scanned') n_scanned, count(*) filter (where st = 'blank') n_blank, count(*) filter (where st = 'form_widgets') n_form_widgets, count(*) filter (where st = 'vector_outlines') n_vector_outlines, count(*) filter (where st = 'vector_outlines_form') n_vector_outlines_form, bool_or(st <> 'extractable') has_gaps from s group by 1, 2""",
    "interval_assign": """with s as (select *, sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id) interval_no from events)
select user_id, cast(interval_no as bigint) interval_no, count(*) n_events, min(ts) from_ts from s where interval_no > 0 group by 1, 2""",
}
