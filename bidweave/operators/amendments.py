"""Amendments proposed per addendum: field matching, proof by quote, acceptance in order, merged sources; questions and readiness.

Proposals come from a provider or a table (bid_id, addendum_number, ord, field, new_value, quote, file_name, page_number, reason).
A proposal counts if its field is known (exactly, else without regard to case), its value and quote aren't blank and the quote
stands in a chunk of the same package and addendum, and if its value has the form of its field. Containment is tested only between rows that share both.
Defined results: a null addendum number of a chunk is that of its file's name, else 1; of chunks with the quote the first id holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.functions import text as X
from bidweave.operators.validation import _OK, amendment_confidence, format_ok
from bidweave.session import table

SOURCE = "struct<file:string,page:int,quote:string,chunk_id:string>"


def addendum_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of addenda with ``number``, ordered by number and page."""
    own = chunks.where((F.lower(F.coalesce("doc_type", F.lit(""))) == "addendum") | F.lower(F.coalesce("file_name", F.lit(""))).contains("addendum"))
    named = F.regexp_extract(F.lower("file_name"), r"addendum[\s_]*(?:no\.?)?[\s_#]*0*(\d+)", 1).try_cast("int")
    stated = F.col("addendum_number") if "addendum_number" in chunks.columns else F.lit(None).cast("int")
    return own.withColumn("number", F.coalesce(stated, named, F.lit(1)))


def match_fields(items: DataFrame, known: DataFrame, name: str = "field") -> DataFrame:
    """Items whose field is known, under its known name: exact first, then without regard to case."""
    k = known.select(F.col("field_name").alias("__k"), F.lower("field_name").alias("__l")).distinct()
    hit = items.withColumn("__i", F.monotonically_increasing_id()).join(F.broadcast(k), F.lower(F.col(name)) == F.col("__l"))
    best = Window.partitionBy("__i").orderBy(F.desc(F.col("__k") == F.col(name)), "__k")
    return hit.withColumn("__n", F.row_number().over(best)).where("__n = 1").withColumn(name, F.col("__k")).drop("__k", "__l", "__i", "__n")


def accept(proposals: DataFrame, chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted proposals with ``chunk_id``, place of the quote, ``confidence``, ``old_value`` and ``is_final`` in order of number and ord."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    p = match_fields(proposals.where("field is not null"), known).where((F.trim(F.coalesce("new_value", F.lit(""))) != "") & (norm("quote") != ""))
    p = p.withColumns({"number": F.coalesce("addendum_number", F.lit(1)), "__q": norm("quote")}).drop("file_name", "page_number")
    c = addendum_chunks(chunks).select("bid_id", "number", "chunk_id", "file_name", "page_number", norm("text").alias("__t")).dropDuplicates(["chunk_id"])
    hit = p.join(c, ["bid_id", "number"]).where(F.col("__t").contains(F.col("__q")))
    key = [x for x in p.columns if not x.startswith("__")]
    hit = hit.groupBy(*key, "__q").agg(F.min_by(F.struct("chunk_id", "file_name", "page_number"), "chunk_id").alias("m")).select(*key, "__q", "m.*")
    hit = hit.where(format_ok(F.col("field"), F.col("new_value")))  # the validator's gate; the quote has grounded it
    order = Window.partitionBy("bid_id", "field").orderBy("number", "ord", "chunk_id", "new_value", *[c for c in ("change_id",) if c in key])
    sure = amendment_confidence(F.size(F.split("__q", " ")), F.col("new_value"), F.lit(1.0))
    return hit.withColumns({"confidence": sure, "old_value": F.lag("new_value").over(order), "is_final": F.lead("number").over(order).isNull()}).drop("__q")


def merged_sources(new: Column, old: Column) -> Column:
    """The new source first, then the old ones of other files."""
    return F.concat(F.array(new), F.filter(F.coalesce(old, F.array().cast(f"array<{SOURCE}>")), lambda s: ~s["file"].eqNullSafe(new["file"])))


def _of_addenda(chunks: DataFrame) -> DataFrame:
    """(bid_id, number, passages): the passages of each addendum in order of pages. An addendum is a document, its passages fit a row."""
    c = addendum_chunks(chunks).dropDuplicates(["chunk_id"])
    return c.groupBy("bid_id", "number").agg(F.sort_array(F.collect_list(F.struct("page_number", "chunk_id", "file_name", "text"))).alias("passages"))


def propose(chunks: DataFrame, make, fields: list[str], values: DataFrame | None = None) -> DataFrame:
    """Proposals of a provider (``reconcile(fields, passages) -> list of dicts``), one call per package and addendum; a failure is a row with ``error``.

    The provider is given the package's ``values`` (bid_id, field_name, value) before its addenda, as a dict of all ``fields``.
    """
    import pandas as pd

    def run(batches):
        model = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                held = dict.fromkeys(fields) | {x["field_name"]: x["value"] for x in (r.held if r.held is not None else [])}
                try:
                    for k, x in enumerate(model.reconcile(held, list(r.passages))):
                        rows.append((r.bid_id, r.number, k, x.get("field"), x.get("new_value"), x.get("quote"), x.get("file_name"), x.get("page_number"), x.get("reason"), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.bid_id, r.number, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["bid_id", "addendum_number", "ord", "field", "new_value", "quote", "file_name", "page_number", "reason", "error"])

    passages = _of_addenda(chunks)
    if values is None:
        passages = passages.withColumn("held", F.lit(None).cast("array<struct<field_name:string,value:string>>"))
    else:
        held = values.groupBy("bid_id").agg(F.collect_list(F.struct("field_name", F.col("value").cast("string").alias("value"))).alias("held"))
        passages = passages.join(held, "bid_id", "left")
    return passages.mapInPandas(run, "bid_id string, addendum_number int, ord int, field string, new_value string, quote string, file_name string, page_number int, reason string, error string")


SUMMARY = "bid_id string, number int, file_name string, overview string, changes array<struct<category:string,description:string,quote:string>>, error string"


def summaries(chunks: DataFrame, make) -> DataFrame:
    """(bid_id, number, file_name, overview, changes, error): all that each addendum changes, by a provider (``summarize(number, passages)``); a failure gives no changes and the error."""
    import pandas as pd

    def run(batches):
        model = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                passages, error = list(r.passages), None
                try:
                    got = model.summarize(int(r.number), passages)
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    got = {"overview": f"Addendum changes could not be summarized: {e}"}
                changes = [x if isinstance(x, dict) else {"description": str(x)} for x in got.get("all_changes") or []]
                changes = [{"category": x.get("category") or x.get("section") or "General", "description": x.get("description") or "", "quote": x.get("quote") or ""} for x in changes]
                rows.append((r.bid_id, r.number, passages[0]["file_name"], got.get("overview") or "Summary of the addendum's changes.", changes, error))
            yield pd.DataFrame(rows, columns=["bid_id", "number", "file_name", "overview", "changes", "error"])

    return _of_addenda(chunks).mapInPandas(run, SUMMARY)


def summary_text(summary: dict | None, bid_id: str | None, number: int | None) -> str:
    """Markdown of one addendum's summary."""
    if summary is None:
        return "No addendum found." if bid_id is None else f"No addendum documents found for {bid_id}."
    lines = [f"### Addendum {number} Summary for {bid_id} ({summary['file_name']})", "", f"**Overview:** {summary['overview']}", "", "**Modifications and Clarifications:**"]
    for n, c in enumerate(summary["changes"], 1):
        lines.append(f"{n}. **[{c['category']}]** {c['description']}")
        if c["quote"]:
            lines.append(f'   - *Contiguous Quote:* "{c["quote"]}"')
    return "\n".join(lines if summary["changes"] else [*lines, "No explicit modifications detected in this addendum."])


#: Topics of questions with the words that a search for them adds.
TOPICS = [
    (["product tiers", "quantities requested", "scale"], "product tier target quantity requested quantity line items total units"),
    (["affidavits", "forms"], "required affidavits compliance forms certification"),
    (["bid bond"], "bid bond insurance cashier check surety proposal guarantee"),
    (["submission deadline", "due date", "closing"], "proposal submission deadline closing date extension"),
]


def topic_query(question: str = "question") -> Column:
    """The question with the words of its first topic."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for words, more in TOPICS:
        hit = X.contains_any(q, words)
        value = F.concat_ws(" ", F.col(question), F.lit(more))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.coalesce(question, F.lit("")))


#: Lowest scores worth showing, and those of a strong hit, by mode.
FLOORS = {"bm25_only": (0.0, 5.0), "dense_only": (0.35, 0.60), "hybrid": (-6.5, -2.5)}


def shown(mode: str, score: str = "score") -> tuple[Column, Column]:
    """Whether a result is shown, and whether it is strong."""
    low, high = FLOORS["hybrid" if mode.startswith("hybrid") else mode]
    return (F.col(score) > low if mode == "bm25_only" else F.col(score) >= low), F.col(score) >= high


def clean_citation(file: str = "file_name") -> Column:
    """A file name without a package in brackets before it."""
    return F.regexp_replace(F.coalesce(file, F.lit("")), r"^\[[A-Za-z0-9_\-]+\]\s*", "")


def readiness(fields: DataFrame) -> DataFrame:
    """Per package: title, agency, number (first of their names that has a value) and fields with a value."""
    pick = lambda *names: F.coalesce(*[F.max(F.when(F.lower(F.trim("field_name")) == n, F.col("value"))) for n in names])
    return fields.groupBy("bid_id").agg(pick("title", "solicitation_title").alias("title"), pick("company_name", "company name", "issuing_agency", "agency").alias("agency"), pick("bid number", "bid_number", "solicitation_number").alias("number"), F.count("value").alias("fields_ready"))


def replace_all(text: str | Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other."""
    c = F.col(text) if isinstance(text, str) else text
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def deltas(base: DataFrame, variant: DataFrame) -> DataFrame:
    """One row: changes of the metrics and whether the variant is kept (better rank, recall at 5 not worse)."""
    a, b = base.select(F.col("mrr").alias("m0"), F.col("recall_5").alias("r0")), variant.select(F.col("mrr").alias("m1"), F.col("recall_5").alias("r1"))
    return a.crossJoin(F.broadcast(b)).select(F.round(F.col("m1") - F.col("m0"), 4).alias("delta_mrr"), F.round(F.col("r1") - F.col("r0"), 4).alias("delta_recall_5"), ((F.col("m1") > F.col("m0")) & (F.col("r1") >= F.col("r0"))).alias("keep"))


def q_accept(spark: SparkSession, d: str) -> DataFrame:
    """Recorded changes as proposals, proven by the addendum's chunks."""
    chunks = table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name", "doc_type", "addendum_number", "page_number", "text")
    proposals = table(spark, d, "addendum_changes").select("change_id", "bid_id", "addendum_number", "ord", F.trim("field").alias("field"), "new_value", "quote", "file_name", "page_number").distinct()
    known = table(spark, d, "field_outputs").select("field_name").distinct()
    return accept(proposals, chunks, known).select("change_id", "field", "chunk_id", "confidence", "is_final")


def q_readiness(spark: SparkSession, d: str) -> DataFrame:
    from bidweave.operators.routing import _values

    return readiness(_values(spark, d))


def q_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(topic_query("text")).alias("digest"))


_T = "case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then text || ' {m}'" for ws, m in TOPICS) + " else coalesce(text, '') end"
_V = r"o as (select * from field_outputs qualify row_number() over (partition by output_id order by ingested_at desc, attempt desc) = 1), v as (select bid_id, lower(regexp_replace(field_name, '^\s+|\s+$', '', 'g')) k, value from o qualify row_number() over (partition by bid_id, lower(regexp_replace(field_name, '^\s+|\s+$', '', 'g')) order by attempt desc, output_id desc) = 1)"
QUERIES = {"accept_amendments": q_accept, "package_readiness": q_readiness, "topic_queries": q_topics}
_norm = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
_NUMBER = r"coalesce(addendum_number, try_cast(regexp_extract(lower(file_name), 'addendum[\s_]*(?:no\.?)?[\s_#]*0*(\d+)', 1) as integer), 1)"
SQL = {
    "accept_amendments": f"""with k as (select distinct field_name from field_outputs),
p as (select distinct change_id, bid_id, coalesce(addendum_number, 1) number, addendum_number, ord, trim(field) field, new_value, quote, file_name, page_number from addendum_changes where field is not null),
f as (select p.* exclude field, field_name field from p join k on lower(p.field) = lower(field_name) qualify row_number() over (partition by change_id, p.bid_id, p.addendum_number, p.ord, p.field, p.new_value, p.quote, p.file_name, p.page_number order by (field_name = p.field) desc, field_name) = 1),
c as (select chunk_id, any_value(bid_id) bid_id, any_value({_NUMBER}) number, {_norm("any_value(text)")} t from chunks where lower(coalesce(doc_type, '')) = 'addendum' or contains(lower(coalesce(file_name, '')), 'addendum') group by 1),
h as (select change_id, f.bid_id, f.number, ord, field, new_value, value_, q, min(chunk_id) chunk_id from (select *, new_value value_, {_norm("quote")} q from f) f join c on c.bid_id = f.bid_id and c.number = f.number and q <> '' and contains(t, q) where trim(coalesce(new_value, '')) <> '' group by 1, 2, 3, 4, 5, 6, 7, 8),
g as (select * from (select *, field field_name, new_value as value from h) where {_OK})
select change_id, field, chunk_id, round(least(cast(0.80 as double) + least(cast(0.10 as double), cast(0.008 as double) * len(string_split(q, ' '))) + case when regexp_matches(new_value, '\\d') then cast(0.05 as double) else cast(0.02 as double) end + cast(0.03 as double), cast(0.98 as double)), 2) confidence,
lead(number) over (partition by bid_id, field order by number, ord nulls first, chunk_id, new_value, change_id) is null is_final from g""",
    "topic_queries": f"select doc_id, md5({_T}) digest from documents",
    "package_readiness": f"with {_V} select bid_id, coalesce(max(case when k = 'title' then value end), max(case when k = 'solicitation_title' then value end)) title, coalesce(max(case when k = 'company_name' then value end), max(case when k = 'company name' then value end)) agency, coalesce(max(case when k = 'bid number' then value end), max(case when k = 'bid_number' then value end)) number, count(value) fields_ready from v group by 1",
}
