"""Package catalogue, question routing, evidence scans and comparison across packages.

Questions are a table (question_id, question). Names and numbers of packages are found in a question by equi-joins on its
words and word runs, not by testing every package against every question.
Defined results: null questions score nothing; packages without a catalogue entry score nothing; ties go to the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.config import CONTACT_WORDS, DOCUMENT_WORDS, FIELDS
from bidweave.functions import text as X
from bidweave.operators import retrieve
from bidweave.operators.retrieve import route_by_sum
from bidweave.operators.validation import latest
from bidweave.session import folded, stage, table

#: Words too common in names of agencies and titles.
AGENCY_STOP = ["state", "city", "county", "department", "office", "the", "and", "district", "public", "independent", "school", "schools", "board", "education", "commission", "authority", "division", "agency", "services"]
TITLE_STOP = ["request", "proposal", "solicitation"]
#: Fixed value: how solicitation numbers are written.
NUMBER = r"(?i)\b(?:RFP\s*(?:NO\.?|#)?\s*|PORFP\s*(?:NO\.?|#)?\s*|PROJECT\s*(?:NO\.?|#)?\s*)?([A-Z0-9]{2,}[-_][A-Z0-9-_]{2,}|[A-Z]{2,}\d{4,}[A-Z0-9]*|[A-Z]\d{2}[A-Z]\d{6,})\b"
#: Names are looked up by runs of so many words; longer ones by their first words, and then compared whole.
RUN = 6


def catalogue(chunks: DataFrame, packages: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """(bid_id, kind, value): file names and solicitation numbers from chunks; agencies, titles and numbers from the package table and from saved results (bid_id, field_name, value); without a package table also agencies from covering texts."""
    c = chunks.where("bid_id is not null").select("bid_id", F.lower("file_name").alias("file_name"), "text")
    files = c.where("file_name is not null").select("bid_id", F.lit("file").alias("kind"), F.regexp_replace("file_name", r"\.(pdf|html|htm)", "").alias("value"))
    numbers = c.select("bid_id", F.lit("number").alias("kind"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(NUMBER), F.lit(1)), F.lower))).alias("value"))
    out = files.unionByName(numbers.where("length(value) >= 4 and not startswith(value, 'http')"))
    if packages is not None:
        for column, kind in (("solicitation_number", "number"), ("agency", "agency"), ("title", "title")):
            out = out.unionByName(packages.where(F.col(column).isNotNull() & F.col("bid_id").isNotNull()).select("bid_id", F.lit(kind).alias("kind"), F.lower(F.trim(column)).alias("value")))
        ids = packages.where("bid_id is not null").select("bid_id", F.lit("id").alias("kind"), F.lower("bid_id").alias("value"))
        apart = ids.where(F.col("value").rlike(r"^bid\d+$")).withColumn("value", F.regexp_replace("value", "^bid", "bid "))
        out = out.unionByName(ids).unionByName(apart)
    elif {"page_number", "doc_type"} <= set(chunks.columns):
        out = out.unionByName(agencies(chunks))
    if results is not None:
        out = out.unionByName(known_values(results))
    return out.where("value <> ''").distinct()


def _key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def score_packages(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(question_id, bid_id, score): 15 for the id (also written apart, such as ``bid 2``), 12 per number, 10 per agency, 8 per title, 6 per file name in the question, else 4 per word of an agency and 2 per word of a title."""
    asked = questions.select("question_id", _key(F.coalesce("question", F.lit(""))).alias("__q"))
    words = F.split("__q", " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), n - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " "))))
    asked = asked.select("question_id", "__q", F.explode(F.array_distinct(runs)).alias("key")).where("key <> ''")
    weight = F.when(F.col("kind") == "id", 15.0).when(F.col("kind") == "number", 12.0).when(F.col("kind") == "agency", 10.0).when(F.col("kind") == "title", 8.0).otherwise(6.0)
    keyed = entries.withColumn("key", _key(F.col("value"))).where("key <> ''")
    whole = keyed.where("kind not in ('title', 'file') or (kind = 'title' and length(value) > 6) or (kind = 'file' and length(value) > 4)").withColumn("weight", weight)
    whole = whole.withColumnRenamed("key", "__name").withColumn("key", F.array_join(F.slice(F.split("__name", " "), 1, RUN), " "))
    named = F.concat(F.lit(" "), "__q", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("__name"), F.lit(" ")))
    hits = asked.join(whole, "key").where(named).groupBy("question_id", "bid_id", "kind", "value").agg(F.max("weight").alias("weight"))
    parts = keyed.where("kind in ('agency', 'title')").select("bid_id", "kind", "value", F.explode(F.array_distinct(F.split("key", " "))).alias("key"))
    agency = (F.col("kind") == "agency") & (F.length("key") > 3) & ~F.col("key").isin(AGENCY_STOP)
    title = (F.col("kind") == "title") & (F.length("key") > 4) & ~F.col("key").isin(TITLE_STOP)
    parts = parts.where(agency | title).withColumn("weight", F.when(F.col("kind") == "agency", 4.0).otherwise(2.0))
    single = asked.drop("__q").join(parts, "key").groupBy("question_id", "bid_id", "kind", "value").agg(F.sum("weight").alias("weight"))
    single = single.join(hits.select("question_id", "bid_id", "kind", "value"), ["question_id", "bid_id", "kind", "value"], "left_anti")
    # An id counts once, however it is written.
    hits = hits.withColumn("value", F.when(F.col("kind") != "id", F.col("value"))).distinct()
    return hits.unionByName(single).groupBy("question_id", "bid_id").agg(F.sum("weight").alias("score"))


def route(questions: DataFrame, scores: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(question_id, target): COMPARISON, the best package, the fallback's (question_id, bid_id), or null."""
    best = scores.where("score > 0").groupBy("question_id").agg(F.min_by("bid_id", F.struct(-F.col("score"), "bid_id")).alias("best"))
    out = questions.join(best, "question_id", "left")
    second = F.lit(None).cast("string")
    if fallback is not None:
        out = out.join(fallback.select("question_id", F.col("bid_id").alias("__second")), "question_id", "left")
        second = F.col("__second")
    return out.select("question_id", F.when(X.is_comparison("question"), "COMPARISON").otherwise(F.coalesce("best", second)).alias("target"))


def route_all(questions: DataFrame, scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """``route`` with the package of the highest sum of BM25 scores as fallback; the index is only built if a question needs it."""
    scores = stage(scores)
    first = route(questions, scores)
    lost = stage(first.where("target is null").select("question_id").join(questions.where(F.size(X.terms("question")) > 0), "question_id"))
    if lost.isEmpty():
        return first
    best = route_by_sum(chunks, lost.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")))
    return route(questions, scores, best.select(F.col("query_id").alias("question_id"), "bid_id"))


def cover_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that may tell what a package is: those of first pages, portal pages and specifications."""
    return chunks.where((F.col("page_number") == 1) | F.col("doc_type").isin("bid_page", "specs"))


#: Phrases that ask for an addendum's summary.
SUMMARY_WORDS = ["what changed", "changes in", "changed in", "summary of addendum", "modifications in"]
#: Names of agencies in running text, and how much of a covering text is read for them.
AGENCY = r"([A-Z][A-Za-z0-9&,\.\s]{3,40}(?:School District|ISD|Treasurer|Department|State of|County|City|Commission))"


def addendum_asked(question: Column | str) -> Column:
    """The number of the addendum whose summary a question asks for, or null."""
    q = F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit("")))
    number = F.regexp_extract(q, r"addendum\s*(?:no\.?|#)?\s*(\d+)", 1)
    return F.when((number != "") & X.contains_any(q, SUMMARY_WORDS), number.try_cast("int"))


def agencies(chunks: DataFrame) -> DataFrame:
    """Entries (bid_id, kind, value): names of agencies in the covering texts of packages without a catalogue."""
    found = cover_chunks(chunks).where("bid_id is not null").select("bid_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(AGENCY), F.lit(1)))).alias("value"))
    return found.select("bid_id", F.lit("agency").alias("kind"), F.lower(F.trim("value")).alias("value")).distinct()


def known_values(results: DataFrame) -> DataFrame:
    """Entries (bid_id, kind, value) of saved results (bid_id, field_name, value): number, agency and title."""
    kind = F.when(F.lower(F.trim("field_name")) == "bid number", "number").when(F.lower(F.trim("field_name")) == "company_name", "agency").when(F.lower(F.trim("field_name")) == "title", "title")
    return results.select("bid_id", kind.alias("kind"), F.lower(F.trim("value")).alias("value")).where("kind is not null and bid_id is not null and value <> ''").distinct()


def compared(scores: DataFrame, indexed: DataFrame) -> DataFrame:
    """(question_id, bid_id): the indexed packages that a comparison is about: those its question names if they are two or more, else one row without a package, which stands for all."""
    named = scores.where("score > 0").join(indexed.select("bid_id").distinct(), "bid_id", "left_semi").select("question_id", "bid_id")
    enough = named.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("question_id")
    rest = scores.select("question_id").distinct().join(enough, "question_id", "left_anti").withColumn("bid_id", F.lit(None).cast("string"))
    return named.join(enough, "question_id", "left_semi").unionByName(rest)


#: Packages that come first in lists.
FIRST_BIDS = ["Bid1", "Bid2", "Bid3"]


def bid_order(bid: Column | str = "bid_id") -> list[Column]:
    """Columns to order packages by: the first ones, then by name."""
    c = F.col(bid) if isinstance(bid, str) else bid
    place = F.array_position(F.array(*map(F.lit, FIRST_BIDS)), c)
    return [F.when(place > 0, place).otherwise(len(FIRST_BIDS) + 1), c]


def contact_scan(chunks: DataFrame, per_package: int = 10) -> DataFrame:
    """The chunks of each package that hold contacts: 2 for an address, 1 for a phone, 2 for a role, a half per word."""
    t = F.lower(F.coalesce("text", F.lit("")))
    mail, phone, words = t.contains("@"), F.coalesce("text", F.lit("")).rlike(X.PHONE), X.count_contained(t, CONTACT_WORDS)
    role = X.contains_any(t, ["buyer", "purchasing agent", "contracting officer", "point of contact"])
    score = mail.cast("int") * 2.0 + phone.cast("int") * 1.0 + role.cast("int") * 2.0 + words * 0.5
    return _scan(chunks.where(mail | phone | (words > 0)), score, per_package)


def document_scan(chunks: DataFrame, per_package: int = 12) -> DataFrame:
    """The chunks of each package that ask for documents: 1 per word, 2 for a strong word, 5 for a table with one, else 1.5 for a table."""
    t = F.lower(F.coalesce("text", F.lit("")))
    words = X.count_contained(t, DOCUMENT_WORDS)
    strong = X.contains_any(t, ["w-9", "w9", "mwbe", "affidavit", "ciq"])
    rows = t.contains("|")
    listed = X.contains_any(t, ["w-9", "w9", "mwbe", "affidavit", "form", "file", "submission", "required"])
    score = words * 1.0 + strong.cast("int") * 2.0 + F.when(rows & listed, 5.0).when(rows, 1.5).otherwise(0.0)
    return _scan(chunks.where(words > 0), score, per_package)


def _scan(chunks: DataFrame, score: Column, k: int) -> DataFrame:
    order = Window.partitionBy("bid_id").orderBy(F.desc("score"), "chunk_id")
    return chunks.select("bid_id", "chunk_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def evidence(*lists: DataFrame, key: tuple[str, ...] = ("bid_id", "chunk_id")) -> DataFrame:
    """Ranked lists one after the other, each key once: at its place in the first list that has it."""
    out = None
    for n, x in enumerate(lists):
        part = x.select(*key, F.lit(n).alias("src"), "rank")
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy(*key).orderBy("src", "rank")
    return out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def comparison_matrix(values: DataFrame, packages: DataFrame, fields: list[str]) -> DataFrame:
    """One row per package, one column per field; ``Not found`` where there is none. The fields are configuration."""
    wide = values.groupBy("bid_id").pivot("field_name", fields).agg(F.first("value"))
    names = [F.coalesce(F.col(f"`{f}`"), F.lit("Not found")).alias(f.replace(" ", "_")) for f in fields]
    return packages.select("bid_id").join(wide, "bid_id", "left").select("bid_id", *names)


def field_differences(values: DataFrame, packages: DataFrame, fields: DataFrame) -> DataFrame:
    """(field_name, n_packages, n_values, identical): whether a field has one value everywhere."""
    n = packages.agg(F.count(F.lit(1)).alias("n_packages"))
    have = values.groupBy("field_name").agg(F.count_distinct("value").alias("n_have"), F.count("value").alias("n_found"))
    out = fields.select(F.lower("field_name").alias("field_name")).join(have, "field_name", "left").crossJoin(F.broadcast(n)).na.fill(0, ["n_have", "n_found"])
    total = F.col("n_have") + F.when(F.col("n_found") < F.col("n_packages"), 1).otherwise(0)
    return out.select("field_name", "n_packages", total.alias("n_values"), (total == 1).alias("identical"))


def comparison_report(matrix: list[dict]) -> str:
    """Markdown of a comparison of a few packages."""
    if not matrix:
        return "No packages.\n"
    names = [k for k in matrix[0] if k != "bid_id"]
    rows = ["| Field | " + " | ".join(str(m["bid_id"]) for m in matrix) + " |", "|---" * (len(matrix) + 1) + "|"]
    rows += ["| " + n.replace("_", " ") + " | " + " | ".join(str(m[n]).replace("|", "\\|") for m in matrix) + " |" for n in names]
    return "# Comparison\n\n" + "\n".join(rows) + "\n"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name", "doc_type", "text").dropDuplicates(["chunk_id"])


def _values(spark: SparkSession, d: str) -> DataFrame:
    o = latest(table(spark, d, "field_outputs"))
    return o.groupBy("bid_id", folded(F.col("field_name")).alias("field_name")).agg(F.max_by(F.struct("value"), F.struct("attempt", "output_id")).alias("v")).select("bid_id", "field_name", "v.value")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every file whose id is divisible by 50 asks by its name."""
    return table(spark, d, "source_files").where("file_id % 50 = 0").select(F.col("file_id").alias("question_id"), F.regexp_replace("file_name", r"\.[A-Za-z]+$", "").alias("question"))


def q_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(_chunks(spark, d), table(spark, d, "packages")).groupBy("bid_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def q_route(spark: SparkSession, d: str) -> DataFrame:
    q, chunks = _questions(spark, d), _chunks(spark, d)
    return route_all(q, score_packages(q, catalogue(chunks, table(spark, d, "packages"))), chunks)


def q_contacts(spark: SparkSession, d: str) -> DataFrame:
    return contact_scan(_chunks(spark, d).where("lower(coalesce(doc_type, '')) <> 'addendum'"))


def q_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_scan(_chunks(spark, d).where("lower(coalesce(doc_type, '')) <> 'addendum'"))


def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence(q_contacts(spark, d), q_documents(spark, d)).select("bid_id", "chunk_id", "src")


def q_matrix(spark: SparkSession, d: str) -> DataFrame:
    return comparison_matrix(_values(spark, d), table(spark, d, "packages"), [f.lower() for f, _, _ in FIELDS])


def q_differences(spark: SparkSession, d: str) -> DataFrame:
    from bidweave.config import field_definitions

    return field_differences(_values(spark, d), table(spark, d, "packages"), field_definitions(spark))


def q_comparing(spark: SparkSession, d: str) -> DataFrame:
    """Questions in texts that compare packages or ask for an addendum's summary."""
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", X.is_comparison("text").alias("compares"), addendum_asked(t).alias("asks_addendum"))


def q_cover(spark: SparkSession, d: str) -> DataFrame:
    return cover_chunks(table(spark, d, "chunks")).groupBy("bid_id").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def q_agencies(spark: SparkSession, d: str) -> DataFrame:
    return agencies(table(spark, d, "chunks")).unionByName(known_values(_values(spark, d)))


def q_order(spark: SparkSession, d: str) -> DataFrame:
    """The packages in the order of lists, with the first part of their place."""
    return table(spark, d, "packages").select("bid_id", bid_order()[0].cast("int").alias("place")).orderBy(*bid_order())


def q_compared(spark: SparkSession, d: str) -> DataFrame:
    q, chunks = _questions(spark, d), _chunks(spark, d)
    scores = score_packages(q, catalogue(chunks, table(spark, d, "packages")))
    return compared(scores, chunks.where("bid_id is not null")).groupBy("question_id").agg(F.count("bid_id").alias("n_named"), F.min("bid_id").alias("first_bid"))


_C = "c as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(doc_type) doc_type, any_value(coalesce(text, '')) t from chunks group by 1), l as (select *, lower(t) x from c where lower(coalesce(doc_type, '')) <> 'addendum')"
_any = lambda ws: "(" + " or ".join(f"contains(x, '{w}')" for w in ws) + ")"
_sum = lambda ws: "(" + " + ".join(f"contains(x, '{w}')::int" for w in ws) + ")"
_CONTACT = f"ct as (select bid_id, chunk_id, contains(x, '@')::int * 2.0 + regexp_matches(t, '{X.PHONE}')::int * 1.0 + {_any(['buyer', 'purchasing agent', 'contracting officer', 'point of contact'])}::int * 2.0 + {_sum(CONTACT_WORDS)} * 0.5 score from l where contains(x, '@') or regexp_matches(t, '{X.PHONE}') or {_sum(CONTACT_WORDS)} > 0)"
_DOCS = f"dt as (select bid_id, chunk_id, {_sum(DOCUMENT_WORDS)} * 1.0 + {_any(['w-9', 'w9', 'mwbe', 'affidavit', 'ciq'])}::int * 2.0 + case when contains(x, '|') and {_any(['w-9', 'w9', 'mwbe', 'affidavit', 'form', 'file', 'submission', 'required'])} then 5.0 when contains(x, '|') then 1.5 else 0.0 end score from l where {_sum(DOCUMENT_WORDS)} > 0)"
_RANKED = "select bid_id, chunk_id, cast(score as double) score, cast(rank as integer) rank from (select *, row_number() over (partition by bid_id order by score desc, chunk_id) rank from {}) where rank <= {}"
_V = r"o as (select * from field_outputs qualify row_number() over (partition by output_id order by ingested_at desc, attempt desc) = 1), v as (select bid_id, lower(regexp_replace(field_name, '^\s+|\s+$', '', 'g')) k, value from o qualify row_number() over (partition by bid_id, lower(regexp_replace(field_name, '^\s+|\s+$', '', 'g')) order by attempt desc, output_id desc) = 1)"

_CAT = r"""cc as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(coalesce(text, '')) t from chunks group by 1),
nu as (select bid_id, lower(unnest(regexp_extract_all(t, '\b(?:RFP\s*(?:NO\.?|#)?\s*|PORFP\s*(?:NO\.?|#)?\s*|PROJECT\s*(?:NO\.?|#)?\s*)?([A-Z0-9]{2,}[-_][A-Z0-9_-]{2,}|[A-Z]{2,}\d{4,}[A-Z0-9]*|[A-Z]\d{2}[A-Z]\d{6,})\b', 1, 'i'))) v from cc where bid_id is not null),
en as (select * from (select bid_id, 'file' kind, regexp_replace(lower(file_name), '\.(pdf|html|htm)', '', 'g') v from cc where bid_id is not null and file_name is not null
  union select bid_id, 'number', v from nu where length(v) >= 4 and not starts_with(v, 'http') union select bid_id, 'number', lower(trim(solicitation_number)) from packages where solicitation_number is not null and bid_id is not null
  union select bid_id, 'agency', lower(trim(agency)) from packages where agency is not null and bid_id is not null union select bid_id, 'title', lower(trim(title)) from packages where title is not null and bid_id is not null
  union select bid_id, 'id', lower(bid_id) from packages where bid_id is not null union select bid_id, 'id', regexp_replace(lower(bid_id), '^bid', 'bid ') from packages where regexp_matches(lower(bid_id), '^bid\d+$')) where v <> '')"""
_stop = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_ROUTE = rf"""with {retrieve._sql()}, {retrieve._CHUNK_META}, {_CAT},
k as (select *, trim(regexp_replace(v, '[^a-z0-9]+', ' ', 'g')) key from en), qq as (select query_id, qx, trim(regexp_replace(lower(coalesce(qx, '')), '[^a-z0-9]+', ' ', 'g')) qk from q),
ht as (select query_id, bid_id, kind, v, max(case kind when 'id' then 15 when 'number' then 12 when 'agency' then 10 when 'title' then 8 else 6 end) w from qq join k on key <> '' and contains(' ' || qk || ' ', ' ' || key || ' ') where not (kind = 'title' and length(v) <= 6) and not (kind = 'file' and length(v) <= 4) group by 1, 2, 3, 4),
pt as (select distinct bid_id, kind, v, unnest(string_split(key, ' ')) wd from k where kind in ('agency', 'title') and key <> ''),
sg as (select query_id, bid_id, kind, v, sum(case kind when 'agency' then 4 else 2 end) w from pt join (select distinct query_id, unnest(string_split(qk, ' ')) wd from qq) using (wd) where (kind = 'agency' and length(wd) > 3 and wd not in {_stop(AGENCY_STOP)}) or (kind = 'title' and length(wd) > 4 and wd not in {_stop(TITLE_STOP)}) group by 1, 2, 3, 4),
al as (select distinct query_id, bid_id, kind, case when kind <> 'id' then v end v, w from ht union all select * from sg where not exists (select 1 from ht where ht.query_id = sg.query_id and ht.bid_id = sg.bid_id and ht.kind = sg.kind and ht.v = sg.v)),
be as (select query_id, bid_id from (select query_id, bid_id, sum(w) w from al group by 1, 2) qualify row_number() over (partition by query_id order by w desc, bid_id) = 1),
b8 as (select query_id, chunk_id, score from sc qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 8),
fb as (select query_id, bid_id from (select query_id, bid_id, round(sum(score), 4) total from b8 join m using (chunk_id) where bid_id is not null group by 1, 2) where total > 0.1 qualify row_number() over (partition by query_id order by total desc, bid_id) = 1)
select qq.query_id question_id, case when regexp_matches(lower(coalesce(qx, '')), '{"|".join(X.COMPARING)}') or regexp_matches(lower(coalesce(qx, '')), '\bbetween\s+([a-z0-9_]+)\s+and\s+([a-z0-9_]+)\b') then 'COMPARISON' else coalesce(be.bid_id, fb.bid_id) end target from qq left join be using (query_id) left join fb using (query_id)"""

QUERIES = {"bid_catalogue": q_catalogue, "route_questions": q_route, "contact_scan": q_contacts, "documentation_scan": q_documents, "evidence_union": q_evidence, "comparison_matrix": q_matrix, "field_differences": q_differences, "question_kinds": q_comparing, "cover_chunks": q_cover, "known_agencies": q_agencies, "bid_order": q_order, "compared_packages": q_compared}
SQL = {
    "bid_catalogue": f"with {_CAT} select bid_id, kind, count(*) n from en group by 1, 2",
    "route_questions": _ROUTE,
    "contact_scan": f"with {_C}, {_CONTACT} " + _RANKED.format("ct", 10),
    "documentation_scan": f"with {_C}, {_DOCS} " + _RANKED.format("dt", 12),
    "evidence_union": f"with {_C}, {_CONTACT}, {_DOCS}, a as ({_RANKED.format('ct', 10)}), b as ({_RANKED.format('dt', 12)}) select bid_id, chunk_id, 0 src from a union all select bid_id, chunk_id, 1 from b where not exists (select 1 from a where a.chunk_id = b.chunk_id and a.bid_id is not distinct from b.bid_id)",
    "comparison_matrix": f"with {_V} select p.bid_id, " + ", ".join(f"coalesce(max(case when k = '{f.lower()}' then value end), 'Not found') \"{f.lower().replace(' ', '_')}\"" for f, _, _ in FIELDS) + " from packages p left join v using (bid_id) group by 1",
    "field_differences": f"with {_V}, n as (select count(*) n from packages), f(k) as (values " + ", ".join(f"('{f.lower()}')" for f, _, _ in FIELDS) + "), h as (select f.k, count(distinct value) d, count(value) c from f left join v using (k) group by 1) select k field_name, n n_packages, d + case when c < n then 1 else 0 end n_values, d + case when c < n then 1 else 0 end = 1 identical from h, n",
    "question_kinds": r"select doc_id, regexp_matches(lower(coalesce(text, '')), '" + "|".join(X.COMPARING) + r"') or regexp_matches(lower(coalesce(text, '')), '\bbetween\s+([a-z0-9_]+)\s+and\s+([a-z0-9_]+)\b') compares, case when regexp_matches(lower(coalesce(text, '')), '" + "|".join(SUMMARY_WORDS) + r"') then try_cast(nullif(regexp_extract(lower(coalesce(text, '')), 'addendum\s*(?:no\.?|#)?\s*(\d+)', 1), '') as integer) end asks_addendum from documents",
    "cover_chunks": "select bid_id, count(distinct chunk_id) n_chunks from chunks where page_number = 1 or doc_type in ('bid_page', 'specs') group by 1",
    "known_agencies": f"with {_V} select distinct bid_id, 'agency' kind, lower(trim(x)) as value from (select bid_id, unnest(regexp_extract_all(coalesce(text, ''), '([A-Z][A-Za-z0-9&,\\.\\s]{{3,40}}(?:School District|ISD|Treasurer|Department|State of|County|City|Commission))', 1)) x from chunks where (page_number = 1 or doc_type in ('bid_page', 'specs')) and bid_id is not null) union all select distinct bid_id, case k when 'bid number' then 'number' when 'company_name' then 'agency' else 'title' end, lower(trim(value)) from v where k in ('bid number', 'company_name', 'title') and bid_id is not null and lower(trim(value)) <> ''",
    "bid_order": "select bid_id, case bid_id when 'Bid1' then 1 when 'Bid2' then 2 when 'Bid3' then 3 else 4 end place from packages",
    "compared_packages": _ROUTE.split("be as (")[0] + """nm as (select query_id, bid_id from (select query_id, bid_id, sum(w) w from al group by 1, 2) where w > 0 and bid_id in (select bid_id from cc)),
en2 as (select query_id from nm group by 1 having count(*) >= 2),
o as (select * from nm where query_id in (select query_id from en2) union all select query_id, null from (select distinct query_id from al where query_id not in (select query_id from en2)))
select query_id question_id, count(bid_id) n_named, min(bid_id) first_bid from o group by 1""",
}
