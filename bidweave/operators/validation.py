"""Grounding of quotes, format checks, confidence and buckets of extracted fields; supersession by addenda; gold audit.

A quote is looked for in the cited chunk, else in the cited page, else in the cited file, else in the whole package, so a
misattributed citation is still found. All are those of the output's own package: containment is tested only between rows
that share it. Corroboration counts the passages that were retrieved for a field, or where none are recorded the chunks of its cited pages.
Defined results: of repeated outputs the last ingested row holds; outputs without source or package are not grounded; null quotes
match nothing; chunks that come again count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.config import FIELDS, field_definitions
from bidweave.functions import text as X
from bidweave.operators.history import numbered
from bidweave.plans.providers import LEAD
from bidweave.session import folded, stage, table

#: Dates that a date field may state.
DATE = r"(?i)(\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b|\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b)"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"


def latest(outputs: DataFrame) -> DataFrame:
    """One row per output id: the last ingested."""
    cols = [c for c in outputs.columns if c != "output_id"]
    return outputs.groupBy("output_id").agg(F.max_by(F.struct(*cols), F.struct("ingested_at", "attempt")).alias("r")).select("output_id", "r.*")


def format_ok(field: Column, value: Column) -> Column:
    """Date fields state a date or a span, contact fields an address."""
    f, v = F.lower(field), F.coalesce(value, F.lit(""))
    date = f.rlike("date|deadline|term of bid") & ~v.rlike(DATE) & ~F.lower(v).rlike("year|month|day|none|n/a")
    contact = f.rlike("contact|email") & ~v.rlike(EMAIL) & ~v.contains("@")
    return ~(date | contact)


#: Cited files and chunks are broadcast up to this number (some 50 MB), so that only their texts are shuffled; beyond it all are.
BROADCAST_CITED = 500_000


def _of(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """The chunks that have one of the keys; few keys are broadcast."""
    keys = stage(keys.distinct())
    return chunks.join(F.broadcast(keys) if keys.count() <= BROADCAST_CITED else keys, keys.columns, "left_semi")


def ground(outputs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Outputs with ``is_grounded``, ``matched_chunk``, ``matched_page`` and ``tier`` (1 the cited chunk, 2 its page, 3 its file, 4 the package).

    Quotes meet the chunks of their cited file and their cited chunk in equi-joins within the package; only those that none of these has
    meet the rest of the package, by runs of three words.
    """
    src = F.get("sources", F.lit(0))
    o = outputs.withColumns({"quote": src["quote"], "cited_file": src["file"], "cited_page": src["page"], "cited_chunk": src["chunk_id"]})
    asked = o.where("quote is not null and bid_id is not null").select("output_id", "bid_id", X.quote_form("quote").alias("q1"), X.plain_form("quote").alias("q2"), F.col("cited_file").alias("file_name"), "cited_page", F.col("cited_chunk").alias("chunk_id"))
    asked = stage(asked.where("q1 <> '' or q2 <> ''"))
    # Texts without marks need one form only.
    marked = F.col("text").rlike(r"[\*_#>`|]")
    forms = lambda c: c.select("bid_id", "chunk_id", "file_name", "page_number", F.regexp_replace(F.lower("text"), r"(?U)\s+", " ").alias("t1"), F.when(marked, X.plain_form("text")).alias("t2"))
    c = chunks.select("bid_id", "chunk_id", "file_name", "page_number", "text").where("bid_id is not null and text is not null")
    inside = ((F.col("q1") != "") & F.col("t1").contains(F.col("q1"))) | ((F.col("q2") != "") & F.coalesce("t2", "t1").contains(F.col("q2")))
    best = lambda x: x.groupBy("output_id").agg(F.min_by(F.struct("chunk_id", "page_number", "tier"), F.struct("tier", "chunk_id")).alias("m")).select("output_id", "m.*")

    def tried(keys: list[str], tier, quotes: DataFrame) -> DataFrame:
        quotes = quotes.dropna(subset=keys).withColumnsRenamed({k: f"cited_{k}" for k in ("file_name", "chunk_id") if k not in keys})
        found = quotes.join(forms(_of(c, quotes.select(*keys))), keys).where(inside)
        return found.select("output_id", "chunk_id", "page_number", tier.alias("tier"))

    def in_package(quotes: DataFrame) -> DataFrame:
        """Chunks of the package with the quote. A quote of five words or more meets only the chunks that have its second to fourth word in a row; few are shorter."""
        words = lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0))
        both = F.array_distinct(F.filter(F.array("q1", "q2"), lambda q: q != ""))
        runs = F.transform(both, lambda q: F.concat_ws(" ", F.slice(words(q), 2, 3)))
        quotes = quotes.withColumns({"runs": runs, "long": F.forall(both, lambda q: F.size(words(q)) >= 5)})
        short, long = quotes.where("not long").drop("runs", "long"), quotes.where("long").select("bid_id", "output_id", "q1", "q2", "runs")
        asked_runs = long.select("bid_id", "output_id", F.explode("runs").alias("run"))
        three = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, 3)))
        own = forms(_of(c, long.select("bid_id"))).select("bid_id", "chunk_id", F.explode(F.array_distinct(F.concat(three(words(F.col("t1"))), three(words(F.coalesce("t2", F.lit(""))))))).alias("run"))
        pairs = stage(own.join(asked_runs, ["bid_id", "run"]).select("bid_id", "chunk_id", "output_id").distinct())
        found = forms(_of(c, pairs.select("bid_id", "chunk_id"))).join(pairs, ["bid_id", "chunk_id"]).join(long.select("output_id", "q1", "q2"), "output_id").where(inside)
        return tried(["bid_id"], F.lit(4), short).unionByName(found.select("output_id", "chunk_id", "page_number", F.lit(4).alias("tier")))

    by_file = F.when(F.col("cited_chunk_id") == F.col("chunk_id"), 1).when(F.col("cited_page") == F.col("page_number"), 2).otherwise(3)
    first = stage(best(tried(["bid_id", "file_name"], by_file, asked).unionByName(tried(["bid_id", "chunk_id"], F.lit(1), asked))))
    rest = stage(asked.join(first.select("output_id"), "output_id", "left_anti"))
    hits = first if rest.isEmpty() else first.unionByName(best(in_package(rest)))
    matched = hits.select("output_id", F.col("chunk_id").alias("matched_chunk"), F.col("page_number").alias("matched_page"), "tier")
    return o.join(matched, "output_id", "left").withColumn("is_grounded", F.col("tier").isNotNull())


def lead(value: Column | str) -> Column:
    return F.substring(F.lower(F.trim(value)), 1, LEAD)


def corroborated(outputs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(output_id, corroborated): how many chunks of the pages that an output cites contain the start of its value."""
    pages = outputs.where(~X.is_absent("value") & F.col("bid_id").isNotNull()).select("output_id", "bid_id", lead("value").alias("lead"), F.explode("sources").alias("s"))
    pages = pages.where("lead <> ''").select("output_id", "bid_id", "lead", F.col("s.file").alias("file_name"), F.col("s.page").alias("page_number")).dropna().distinct()
    keys = ["bid_id", "file_name", "page_number"]
    own = _of(chunks.select(*keys, "chunk_id", F.lower("text").alias("t")), pages.select(*keys))
    return pages.join(own, keys).where(F.col("t").contains(F.col("lead"))).groupBy("output_id").agg(F.count_distinct("chunk_id").alias("corroborated"))


def confidence(retrieval: Column, rank: Column, grounded: Column, page_state: Column, fmt: Column, quote: Column, value: Column, corroborated: Column, secondary: Column | None = None) -> Column:
    """Weighted confidence in [0, 1]: 0.25 retrieval + 0.45 validation + 0.30 agreement; a third or less where anything failed. All factors are fixed values.

    ``page_state``: 2 the matched page is the cited one, 1 a page is cited, 0 none.
    """
    norm = F.when(retrieval >= 1, F.least(retrieval / 4, F.lit(1.0))).when(retrieval >= 0.05, F.least(F.greatest(retrieval, F.lit(0.1)), F.lit(1.0))).when(retrieval > 0, F.least(F.greatest((retrieval - 0.008) / 0.024, F.lit(0.15)), F.lit(1.0))).otherwise(0.2)
    f1 = F.round(norm * F.greatest(1 - rank * 0.05, F.lit(0.75)), 3)
    n = F.length(F.trim(F.coalesce(quote, F.lit(""))))
    clean = F.when((n >= 30) & ~F.coalesce(value, F.lit("")).contains("..."), 0.15).when(n >= 15, 0.10).otherwise(0.05)
    f2 = F.round(F.when(grounded, 0.40).otherwise(0.0) + F.when(page_state == 2, 0.20).when(page_state == 1, 0.14).otherwise(0.05) + F.when(fmt, 0.25).otherwise(0.0) + clean, 3)
    v, q = F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lower(F.coalesce(quote, F.lit("")))
    words = lambda s: F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?U)\w+"), F.lit(0)))
    vt = words(v)
    share = F.try_divide(F.size(F.array_intersect(vt, words(q))), F.size(vt))
    agree = F.when((v != "") & q.contains(v), 0.45).when(share == 1, 0.40).when(share.isNotNull(), F.round(0.15 + share * 0.25, 3)).otherwise(0.15)
    f3 = F.round(agree + F.when(corroborated >= 3, 0.35).when(corroborated == 2, 0.25).otherwise(0.15) + F.when(fmt, 0.20).otherwise(0.05), 3)
    if secondary is not None:
        s = F.lower(F.trim(secondary))
        a, b = F.array_distinct(F.split(s, r"\s+")), F.array_distinct(F.split(v, r"\s+"))
        jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
        alike = F.when(s == v, 0.98).when(v.contains(s) | s.contains(v), 0.85).otherwise(F.round(F.greatest(F.lit(0.30), F.least(F.lit(0.95), 0.40 + jaccard * 0.55)), 3))
        f3 = F.when(secondary.isNotNull(), alike).otherwise(f3)
    raw = 0.25 * f1 + 0.45 * f2 + 0.30 * f3
    return F.round(F.when(grounded & fmt, F.greatest(F.least(F.round(raw, 2), F.lit(0.98)), F.lit(0.45))).otherwise(F.least(F.round(raw * 0.4, 2), F.lit(0.39))), 2)


def validate(outputs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Outputs with bucket, validity, grounding, confidence and the reason of a failure.

    ``retrieval_score`` and ``retrieval_rank`` (from 0) of the cited passage count where the outputs have them, else 0.5 and 0;
    so does ``corroborated``, the number of retrieved passages with the value's start, else the chunks of cited pages are counted.
    A column ``secondary_value`` is a second reading of the field, whose agreement counts.
    """
    score = F.coalesce("retrieval_score", F.lit(0.5)) if "retrieval_score" in outputs.columns else F.lit(0.5)
    rank = F.coalesce("retrieval_rank", F.lit(0)) if "retrieval_rank" in outputs.columns else F.lit(0)
    g = ground(outputs, chunks)
    if "corroborated" not in outputs.columns:
        g = g.join(corroborated(outputs, chunks), "output_id", "left")
    g = g.withColumn("corroborated", F.coalesce("corroborated", F.lit(0)))
    page = F.when(F.col("cited_page") > 0, F.when(F.col("matched_page") == F.col("cited_page"), 2).otherwise(1)).otherwise(0)
    fmt = format_ok(F.col("field_name"), F.col("value"))
    sure = confidence(score, rank, F.col("is_grounded"), page, fmt, F.col("quote"), F.col("value"), F.col("corroborated"), F.col("secondary_value") if "secondary_value" in outputs.columns else None)
    none, error = F.col("value").isNull() | (F.coalesce("status", F.lit("")) == "NOT_FOUND"), F.coalesce("status", F.lit("")) == "ERROR"
    bare = F.size(F.coalesce("sources", F.array().cast("array<struct<file:string,page:int,quote:string,chunk_id:string>>"))) == 0
    valid = F.col("is_grounded") & fmt & ~bare
    bucket = F.when(error, "errors").when(none, "not_found").when(valid, "passed").otherwise("failed")
    issue = F.when(error, "api_error").when(none, None).when(bare, "no_source").when(~F.col("is_grounded"), "not_grounded").when(~fmt, "format")
    conf = F.when(error | none, 0.0).when(bare, 0.20).otherwise(sure)
    return g.withColumns({"bucket": bucket, "is_valid": valid & ~error & ~none, "issue": issue, "computed_confidence": conf})


def finalize(outputs: DataFrame, confidence: str = "confidence") -> DataFrame:
    """Outputs as they are given out: a value without a citation is none, and what wasn't found has no source and confidence 0."""
    bare = F.coalesce(F.size("sources"), F.lit(-1)) <= 0
    uncited = F.col("value").isNotNull() & bare
    gone = uncited | F.col("value").isNull() | (F.coalesce("status", F.lit("")) == "NOT_FOUND")
    kept = {"value": F.when(~uncited, F.col("value")), "status": F.when(uncited, "NOT_FOUND").otherwise(F.col("status")), confidence: F.when(gone, 0.0).otherwise(F.col(confidence)), "sources": F.when(gone, F.slice("sources", 1, 0)).otherwise(F.col("sources"))}
    return outputs.withColumns(kept | {"finalized": F.when(uncited, "uncited").when(gone, "not_found").otherwise("kept")})


def completeness(validated: DataFrame) -> DataFrame:
    """Per package: fields by bucket and the share of those with a value, in per cent."""
    n = lambda b: F.count(F.when(F.col("bucket") == b, 1)).alias(f"n_{b}")
    out = validated.groupBy("bid_id").agg(F.count(F.lit(1)).alias("n_fields"), n("passed"), n("failed"), n("not_found"), n("errors"))
    return out.withColumn("completeness", F.round((F.col("n_passed") + F.col("n_failed")) / F.col("n_fields") * 100, 1))


def histogram(values: DataFrame, column: str = "confidence") -> DataFrame:
    c = F.col(column)
    at = lambda lo, hi, name: F.count(F.when((c > lo) & (c <= hi), 1)).alias(name)
    return values.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 4).alias("mean"), F.count_distinct(c).alias("n_distinct"), F.count(F.when(c <= 0.3, 1)).alias("to_03"), at(0.3, 0.6, "to_06"), at(0.6, 0.8, "to_08"), at(0.8, 1.0, "to_10"))


def amendment_confidence(words: Column, value: Column, score: Column) -> Column:
    """Confidence of an accepted amendment."""
    return F.round(F.least(0.80 + F.least(F.lit(0.10), 0.008 * words) + F.when(value.rlike(r"\d"), 0.05).otherwise(0.02) + F.least(F.lit(0.05), 0.03 * score), F.lit(0.98)), 2)


def supersede(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(bid_id, field, addendum_number, ord, change_id, old_value, new_value, is_final): accepted changes in order, each with the value before it."""
    rows = numbered(changes, files)
    order = Window.partitionBy("bid_id", "field").orderBy("addendum_number", "ord", "change_id")
    before = F.coalesce(F.lag("new_value").over(order), F.when(F.row_number().over(order) == 1, F.col("old_value")))
    return rows.select("bid_id", "field", "addendum_number", "ord", "change_id", before.alias("old_value"), "new_value", F.lead("change_id").over(order).isNull().alias("is_final"))


def strict_match(value: Column, accepted: Column) -> Column:
    """Equal to, part of or around one of the accepted values, in their normal forms."""
    v = X.gold_form(value)
    return F.exists(accepted, lambda a: (X.gold_form(a) == v) | ((v != "") & X.gold_form(a).contains(v)) | ((X.gold_form(a) != "") & v.contains(X.gold_form(a))))


def gold_audit(outputs: DataFrame, gold: DataFrame) -> DataFrame:
    """Counts per package and overall (null bid_id) of matches, expected absences, mismatches and missing values; gold has (bid_id, field_name, accepted), null where absence is expected."""
    both = gold.join(outputs.select("bid_id", "field_name", "value"), ["bid_id", "field_name"], "left")
    absent = X.is_absent("value")
    verdict = F.when(F.col("accepted").isNull(), F.when(absent, "EXPECTED_NULL_OK").otherwise("MISMATCH")).when(absent, "MISSING").when(strict_match(F.col("value"), F.col("accepted")), "MATCH").otherwise("MISMATCH")
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(f"n_{v.lower()}")
    out = both.withColumn("verdict", verdict).rollup("bid_id").agg(F.count(F.lit(1)).alias("n"), n("MATCH"), n("EXPECTED_NULL_OK"), n("MISMATCH"), n("MISSING"))
    return out.withColumn("accuracy", F.round((F.col("n_match") + F.col("n_expected_null_ok")) / F.col("n") * 100, 1))


def specialists(outputs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Fields by specialist; unknown fields go to ``commercial_legal``."""
    d = definitions.select(F.lower("field_name").alias("__k"), F.col("specialist").alias("__s"))
    return outputs.withColumn("__k", folded(F.col("field_name"))).join(F.broadcast(d), "__k", "left").withColumn("group", F.coalesce("__s", F.lit("commercial_legal"))).drop("__k", "__s")


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "field_outputs"))


def _best(spark: SparkSession, d: str) -> DataFrame:
    """The last attempt of each field of a package."""
    return _outputs(spark, d).groupBy("bid_id", folded(F.col("field_name")).alias("field_name")).agg(F.max_by("value", F.struct("attempt", "output_id")).alias("value"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name", "page_number", "text")


def q_ground(spark: SparkSession, d: str) -> DataFrame:
    return ground(_outputs(spark, d), _chunks(spark, d)).select("output_id", "is_grounded", "matched_chunk", "tier")


def q_validate(spark: SparkSession, d: str) -> DataFrame:
    return validate(_outputs(spark, d), _chunks(spark, d)).select("output_id", "bucket", "is_valid", "issue", "computed_confidence")


def q_complete(spark: SparkSession, d: str) -> DataFrame:
    return completeness(validate(_outputs(spark, d), _chunks(spark, d)))


def q_final(spark: SparkSession, d: str) -> DataFrame:
    return finalize(_outputs(spark, d)).select("output_id", "value", "status", "confidence", F.greatest(F.size("sources"), F.lit(0)).alias("n_sources"), "finalized")


def q_hist(spark: SparkSession, d: str) -> DataFrame:
    return histogram(_outputs(spark, d))


def q_supersede(spark: SparkSession, d: str) -> DataFrame:
    out = supersede(table(spark, d, "addendum_changes").distinct(), table(spark, d, "source_files"))
    return out.select("bid_id", "field", "change_id", "old_value", "new_value", "is_final")


def q_gold(spark: SparkSession, d: str) -> DataFrame:
    """First attempts as gold for last attempts."""
    o = _outputs(spark, d)
    first = o.groupBy("bid_id", folded(F.col("field_name")).alias("field_name")).agg(F.min_by(F.struct("value"), F.struct("attempt", "output_id")).alias("v"))
    gold = first.select("bid_id", "field_name", F.when(~X.is_absent(F.col("v.value")), F.array("v.value")).alias("accepted"))
    return gold_audit(_best(spark, d), gold)


def q_specialists(spark: SparkSession, d: str) -> DataFrame:
    o = specialists(_outputs(spark, d), field_definitions(spark))
    return o.groupBy("bid_id", F.col("group").alias("specialist_group")).agg(F.count(F.lit(1)).alias("n_outputs"), F.count_distinct("field_name").alias("n_fields"))


def q_groups(spark: SparkSession, d: str) -> DataFrame:
    """Addendum chunks by number; a null number is that of the file's name, else 1."""
    c = table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name", "doc_type", "addendum_number").distinct()
    own = c.where((F.lower(F.coalesce("doc_type", F.lit(""))) == "addendum") | F.lower(F.coalesce("file_name", F.lit(""))).contains("addendum"))
    named = F.regexp_extract(F.lower("file_name"), r"addendum[\s_]*(?:no\.?)?[\s_#]*0*(\d+)", 1).try_cast("int")
    return own.groupBy("bid_id", F.coalesce("addendum_number", named, F.lit(1)).alias("number")).agg(F.count_distinct("chunk_id").alias("n_chunks"))


def q_format(spark: SparkSession, d: str) -> DataFrame:
    return _outputs(spark, d).select("output_id", format_ok(F.col("field_name"), F.col("value")).alias("ok"), X.is_absent("value").alias("absent"))


_O = "o as (select * from field_outputs qualify row_number() over (partition by output_id order by ingested_at desc, attempt desc) = 1)"
_OK = "not ((regexp_matches(lower(field_name), 'date|deadline|term of bid') and not regexp_matches(coalesce(value, ''), '" + DATE + "') and not regexp_matches(lower(coalesce(value, '')), 'year|month|day|none|n/a')) or (regexp_matches(lower(field_name), 'contact|email') and not contains(coalesce(value, ''), '@')))"
_ABS = "lower(trim(coalesce(value, ''))) in ('none', 'null', 'not found', 'n/a', '')"
_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{M}}\p{{Nd}}_\s@]', ' ', 'g'), '[\s\x{{a0}}]+', ' ', 'g'))"
_GROUPS = ", ".join(f"('{n.lower()}', '{s}')" for n, s, _ in FIELDS)
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_qf = lambda x: f"regexp_replace(regexp_replace(lower({x}), '" + _WS + """', ' ', 'g'), '^[ "''“”‘’:,;]+|[ "''“”‘’:,;]+$', '', 'g')"""
_pf = lambda x: _qf(f"regexp_replace({x}, '[*_#>`|]', '', 'g')")
_GROUND = f"""{_O},
a as (select output_id, bid_id, {_qf("sources[1].quote")} q1, {_pf("sources[1].quote")} q2, sources[1].file f, sources[1].page p, sources[1].chunk_id i from o where sources[1].quote is not null),
c as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(page_number) page_number, any_value(coalesce(text, '')) t from chunks group by 1),
n as (select c.*, regexp_replace(lower(t), '{_WS}', ' ', 'g') t1, {_pf("t")} t2 from c),
m as (select output_id, chunk_id, page_number, case when i = chunk_id then 1 when f = file_name and p = page_number then 2 when f = file_name then 3 else 4 end tier from a join n using (bid_id) where (q1 <> '' and contains(t1, q1)) or (q2 <> '' and contains(t2, q2))),
b as (select * from m qualify row_number() over (partition by output_id order by tier, chunk_id) = 1)"""
_VALID = rf"""{_GROUND},
pg as (select distinct output_id, bid_id, substring(lower(trim(value)), 1, {LEAD}) ld, s.file file_name, s.page page_number from (select output_id, bid_id, value, unnest(sources) s from o where not {_ABS})),
co as (select output_id, count(distinct chunk_id) k from pg join c using (bid_id, file_name, page_number) where ld <> '' and contains(lower(t), ld) group by 1),
w0 as (select o.*, sources[1].quote quote, coalesce(k, 0) k, chunk_id is not null gr, case when sources[1].page > 0 then case when page_number = sources[1].page then 0.20 else 0.14 end else 0.05 end pg, {_OK} fmt, lower(trim(coalesce(value, ''))) vl, lower(coalesce(sources[1].quote, '')) ql, length(trim(coalesce(sources[1].quote, ''))) qn from o left join b using (output_id) left join co using (output_id)),
w1 as (select *, list_distinct(regexp_extract_all(vl, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')) vt, list_distinct(regexp_extract_all(ql, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')) qt from w0),
w2 as (select *, case when len(vt) > 0 then len(list_intersect(vt, qt)) / len(vt) end sh from w1),
w3 as (select *, round(case when gr then 0.40 else 0.0 end + pg + case when fmt then 0.25 else 0.0 end + case when qn >= 30 and not contains(coalesce(value, ''), '...') then 0.15 when qn >= 15 then 0.10 else 0.05 end, 3) f2,
  round(case when vl <> '' and contains(ql, vl) then 0.45 when sh = 1 then 0.40 when sh is not null then round(0.15 + sh * 0.25, 3) else 0.15 end + case when k >= 3 then 0.35 when k = 2 then 0.25 else 0.15 end + case when fmt then 0.20 else 0.05 end, 3) f3 from w2),
w4 as (select *, cast(0.25 * 0.5 as double) + cast(0.45 as double) * f2 + cast(0.30 as double) * f3 rw, coalesce(status, '') = 'ERROR' er, value is null or coalesce(status, '') = 'NOT_FOUND' nn, coalesce(len(sources), 0) = 0 ba from w3),
v as (select output_id, bid_id, case when er then 'errors' when nn then 'not_found' when gr and fmt and not ba then 'passed' else 'failed' end bucket, gr and fmt and not ba and not er and not nn is_valid, case when er then 'api_error' when nn then null when ba then 'no_source' when not gr then 'not_grounded' when not fmt then 'format' end issue,
  case when er or nn then 0.0 when ba then 0.20 when gr and fmt then greatest(least(round(rw, 2), 0.98), 0.45) else least(round(rw * 0.4, 2), 0.39) end computed_confidence from w4)"""

QUERIES = {"ground_quotes": q_ground, "validate_fields": q_validate, "completeness": q_complete, "finalize_outputs": q_final, "confidence_hist": q_hist, "supersede_latest": q_supersede, "gold_audit": q_gold, "specialist_groups": q_specialists, "addendum_groups": q_groups, "format_checks": q_format}
SQL = {
    "ground_quotes": f"with {_GROUND} select output_id, chunk_id is not null is_grounded, chunk_id matched_chunk, tier from o left join b using (output_id)",
    "validate_fields": f"with {_VALID} select output_id, bucket, is_valid, issue, computed_confidence from v",
    "completeness": f"with {_VALID} select bid_id, count(*) n_fields, count(*) filter (where bucket = 'passed') n_passed, count(*) filter (where bucket = 'failed') n_failed, count(*) filter (where bucket = 'not_found') n_not_found, count(*) filter (where bucket = 'errors') n_errors, round(count(*) filter (where bucket in ('passed', 'failed')) / count(*) * 100, 1) completeness from v group by 1",
    "finalize_outputs": f"""with {_O} select output_id, case when value is null or len(sources) > 0 then value end as value, case when value is not null and coalesce(len(sources), 0) = 0 then 'NOT_FOUND' else status end status,
case when value is null or coalesce(len(sources), 0) = 0 or coalesce(status, '') = 'NOT_FOUND' then 0.0 else confidence end confidence, cast(case when value is null or coalesce(len(sources), 0) = 0 or coalesce(status, '') = 'NOT_FOUND' then 0 else len(sources) end as integer) n_sources,
case when value is not null and coalesce(len(sources), 0) = 0 then 'uncited' when value is null or coalesce(status, '') = 'NOT_FOUND' then 'not_found' else 'kept' end finalized from o""",
    "confidence_hist": f"with {_O} select min(confidence) min, max(confidence) max, round(avg(confidence), 4) mean, count(distinct confidence) n_distinct, count(*) filter (where confidence <= 0.3) to_03, count(*) filter (where confidence > 0.3 and confidence <= 0.6) to_06, count(*) filter (where confidence > 0.6 and confidence <= 0.8) to_08, count(*) filter (where confidence > 0.8 and confidence <= 1.0) to_10 from o",
    "format_checks": f"with {_O} select output_id, {_OK} ok, {_ABS} absent from o",
    "specialist_groups": f"with {_O}, g(k, s) as (values {_GROUPS}) select bid_id, coalesce(s, 'commercial_legal') specialist_group, count(*) n_outputs, count(distinct field_name) n_fields from o left join g on k = lower({_STRIP.format('field_name')}) group by 1, 2",
    "addendum_groups": r"""with c as (select distinct chunk_id, bid_id, file_name, doc_type, addendum_number from chunks where lower(coalesce(doc_type, '')) = 'addendum' or contains(lower(coalesce(file_name, '')), 'addendum'))
select bid_id, coalesce(addendum_number, try_cast(regexp_extract(lower(file_name), 'addendum[\s_]*(?:no\.?)?[\s_#]*0*(\d+)', 1) as integer), 1) number, count(distinct chunk_id) n_chunks from c group by 1, 2""",
    "supersede_latest": f"""with d as (select distinct * from addendum_changes),
r as (select d.bid_id, lower({_STRIP.format('d.field')}) field, coalesce(d.addendum_number, s.n) n, d.ord, d.change_id, d.old_value, d.new_value from d left join (select bid_id, file_name, min(addendum_number) n from source_files group by 1, 2) s using (bid_id, file_name)
  where {_STRIP.format('d.field')} <> '' and {_STRIP.format('d.new_value')} <> '')
select bid_id, field, change_id, case when row_number() over w = 1 then old_value else lag(new_value) over w end old_value, new_value, lead(change_id) over w is null is_final from r where n is not null window w as (partition by bid_id, field order by n, ord nulls first, change_id)""",
    "gold_audit": f"""with {_O}, f as (select bid_id, lower({_STRIP.format('field_name')}) k, value, attempt, output_id from o),
a as (select bid_id, k, value g from f qualify row_number() over (partition by bid_id, k order by attempt, output_id) = 1),
b as (select bid_id, k, value from f qualify row_number() over (partition by bid_id, k order by attempt desc, output_id desc) = 1),
m as (select bid_id, {_NORM.format('g')} gn, {_NORM.format('value')} vn, lower(trim(coalesce(g, ''))) in ('none', 'null', 'not found', 'n/a', '') ga, {_ABS} va from a left join b using (bid_id, k)),
v as (select bid_id, case when ga then case when va then 'o' else 'x' end when va then 'm' when gn = vn or (vn <> '' and contains(gn, vn)) or (gn <> '' and contains(vn, gn)) then 'y' else 'x' end v from m)
select bid_id, count(*) n, count(*) filter (where v = 'y') n_match, count(*) filter (where v = 'o') n_expected_null_ok, count(*) filter (where v = 'x') n_mismatch, count(*) filter (where v = 'm') n_missing, round(count(*) filter (where v in ('y', 'o')) / count(*) * 100, 1) accuracy from v group by rollup (bid_id)""",
}
