"""Document type, addendum number and verbatim date from a file's name and first page.

Defined results: null names and texts are empty; scores tie in the order of ``KEYWORDS``; a file without any page is judged by its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.config import SETTINGS
from bidweave.session import table

#: Words of each type, in the order of ties.
KEYWORDS = {
    "bid_page": ["bidnet", "bid information", "solicitation type", "reference number", "purchase type", "piggyback contract", "electronic bid"],
    "rfp": ["request for proposal", "rfp", "porfp", "solicitation", "invitation to bid", "scope of work", "instructions to offerors", "purchase order request"],
    "addendum": ["addendum", "amendment", "bulletin", "clarification", "notice of change"],
    "specs": ["specification", "specs", "technical requirement", "datasheet", "system requirements", "minimum hardware specifications"],
    "affidavit": ["affidavit", "sworn statement", "non-collusion", "conflict of interest affidavit", "contract affidavit", "mercury affidavit"],
    "form": ["form", "standard form", "questionnaire", "disclosure form", "exhibit", "acknowledgement form", "w-9"],
}
#: Numbers and dates of addenda and notices.
NUMBERS = [r"(?:addendum|amendment|bulletin|clarification)\s*(?:no\.?|#|_|\s)*0*(\d+)", r"(?:addendum|amendment|bulletin|clarification)[\s_]*0*(\d+)"]
DATES = [
    r"(?i)(?:Publication|Issue Date|Date Issued|Posted Date|Date):\s*([0-1]?\d[/.-][0-3]?\d[/.-]\d{2,4}(?:\s+\d{1,2}:\d{2}(?:\s*[AP]M)?(?:\s+[A-Z]{3,4})?)?)",
    r"(?i)(?:Date):\s*([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})",
    r"(?i)\b([0-1]?\d/[0-3]?\d/20\d{2})\b",
]


def first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def classify(files: DataFrame, name: str = "file_name", preview: str = "preview", low_confidence=None) -> DataFrame:
    """Adds ``found_type``, ``found_confidence``, ``found_number`` and ``found_date``.

    ``low_confidence`` is an optional provider: a function of the frame that may replace type and confidence below the threshold.
    """
    lower, head = F.lower(F.coalesce(name, F.lit(""))), F.substring(F.lower(F.coalesce(preview, F.lit(""))), 1, 3000)
    df = files.withColumns({"__n": lower, "__h": head})
    score = lambda kws: F.round(sum((F.col("__n").contains(k).cast("int") * 2.0 + F.col("__h").contains(k).cast("int") * 0.8 for k in kws), F.lit(0.0)), 1)
    ranked = F.array(*[F.struct(score(k).alias("score"), F.lit(-i).alias("place"), F.lit(t).alias("kind")) for i, (t, k) in enumerate(KEYWORDS.items())])
    df = df.withColumn("__best", F.array_max(ranked))
    top = F.col("__best.score")
    confidence = F.least(F.lit(1.0), top / 3.0)
    general = (confidence < 0.40) & (F.col("__h").contains("proposal") | F.col("__h").contains("contract") | F.col("__h").contains("bid"))
    kind = F.when(general, "rfp").when(top > 0, F.col("__best.kind")).otherwise("other")
    df = df.withColumns({"found_type": kind, "found_confidence": F.when(general, 0.60).otherwise(confidence)})
    if low_confidence is not None:
        df = low_confidence(df, SETTINGS.doc_type_threshold)
    number = F.coalesce(first_match(F.col("__n"), NUMBERS), first_match(F.substring("__h", 1, 2500), NUMBERS))
    df = df.withColumn("found_number", number.try_cast("int"))
    force = F.col("found_number").isNotNull() & ~F.col("found_type").isin("bid_page", "affidavit")
    df = df.withColumns({"found_confidence": F.when(force, F.greatest("found_confidence", F.lit(0.95))).otherwise(F.col("found_confidence")), "found_type": F.when(force, "addendum").otherwise(F.col("found_type")), "found_date": F.trim(first_match(F.coalesce(preview, F.lit("")), DATES))})
    html = F.col("__n").rlike(r"\.html?$")
    df = df.withColumns({"found_type": F.when(html, "bid_page").otherwise(F.col("found_type")), "found_confidence": F.round(F.when(html, 0.98).otherwise(F.col("found_confidence")), 2), "found_number": F.when(~html, F.col("found_number"))})
    return df.drop("__n", "__h", "__best")


def q_classify(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "parsed_pages").where("page_number = 1").groupBy("bid_id", "file_name").agg(F.min("raw_text").alias("preview"))
    files = table(spark, d, "source_files").select("file_id", "bid_id", "file_name").join(first, ["bid_id", "file_name"], "left")
    return classify(files).select("file_id", "found_type", "found_confidence", "found_number", "found_date")


def type_sql(f: str) -> str:
    """SQL of the types of ``f``, a SELECT of file_id, n (name in lower case), p (first page) and h (its start in lower case)."""
    scores = ", ".join("round(" + " + ".join(f"(contains(n, '{k}')::int * 2.0 + contains(h, '{k}')::int * 0.8)" for k in kws) + f", 1) s{i}" for i, kws in enumerate(KEYWORDS.values()))
    top = "greatest(" + ", ".join(f"s{i}" for i in range(len(KEYWORDS))) + ")"
    kind = "case " + " ".join(f"when s{i} = top then '{t}'" for i, t in enumerate(KEYWORDS)) + " end"
    num = "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '{p}', 1), '')" for c in ("n", "substring(h, 1, 2500)") for p in NUMBERS) + ")"
    date = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(p, ''), '{p}', 1), '')" for p in DATES) + ")"
    return f"""with f as ({f}),
s as (select *, {scores} from f), t as (select *, {top} top from s),
c as (select *, least(1.0, top / 3.0) conf, contains(h, 'proposal') or contains(h, 'contract') or contains(h, 'bid') g, try_cast({num} as integer) num, trim({date}) dt, regexp_matches(n, '\\.html?$') html from t),
k as (select *, case when conf < 0.4 and g then 'rfp' when top > 0 then {kind} else 'other' end kind, case when conf < 0.4 and g then 0.6 else conf end cf from c),
z as (select *, num is not null and kind not in ('bid_page', 'affidavit') forced from k)
select file_id, case when html then 'bid_page' when forced then 'addendum' else kind end found_type, cast(round(case when html then 0.98 when forced then greatest(cf, 0.95) else cf end, 2) as double) found_confidence, case when not html then num end found_number, dt found_date from z"""


QUERIES = {"classify_doc": q_classify}
SQL = {
    "classify_doc": type_sql("select file_id, lower(coalesce(file_name, '')) n, p, substring(lower(coalesce(p, '')), 1, 3000) h from source_files left join (select bid_id, file_name, min(raw_text) p from parsed_pages where page_number = 1 group by 1, 2) using (bid_id, file_name)"),
}
