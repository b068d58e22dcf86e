"""The whole run over packages: evidence for all fields as one set of queries, extraction, validation, retries, amendments, results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.config import SETTINGS, field_definitions
from bidweave.operators.retrieve import SparseIndex, build_index, search_within, shown_score, vectors_of
from bidweave.operators.routing import contact_scan, document_scan, evidence
from bidweave.operators.trace import Tracer
from bidweave.operators.amendments import SOURCE, accept, merged_sources, propose
from bidweave.operators.validation import completeness, finalize, supersede, validate
from bidweave.plans.providers import PatternExtractor, PatternReconciler, extract
from bidweave.session import stage, unique

PACKAGE = ["bid_id", "field_name"]


class Result(NamedTuple):
    fields: DataFrame
    summary: DataFrame
    changes: DataFrame | None
    tracer: Tracer


def gather(chunks: DataFrame, definitions: DataFrame, index: SparseIndex, k: int = SETTINGS.top_k, only: DataFrame | None = None, vectors: DataFrame | None = None, absence: bool = False) -> DataFrame:
    """(bid_id, field_name, passages): the scans first, then the k chunks of the package that the hybrid search finds outside addenda, each once.

    With ``absence`` the search that confirms an absence: by the third to fifth hints (fields of one or two hints: by those), without scans.
    """
    known = unique(chunks.where("bid_id is not null"), "chunk_id")
    allowed = known.where("lower(coalesce(doc_type, '')) <> 'addendum'")
    hints = F.when(F.size("hints") > 2, F.slice("hints", 3, 3)).otherwise(F.col("hints")) if absence else F.slice("hints", 1, 3)
    queries = definitions.select(F.col("field_ord").alias("query_id"), F.concat_ws(" ", F.array("field_name"), hints).alias("query"))
    names = F.broadcast(definitions.select(F.col("field_ord").alias("query_id"), "field_name"))
    best = search_within(chunks, queries, k, index, vectors=vectors, exclude_doc_type="addendum").join(names, "query_id").select(*PACKAGE, "chunk_id", "rank", shown_score().alias("score"))
    scans = contact_scan(allowed, max(2 * k, 8)).withColumn("field_name", F.lit("contact_info")).unionByName(document_scan(allowed, max(2 * k, 12)).withColumn("field_name", F.lit("Any Additional Documentation Required")))
    merged = evidence(*([] if absence else [scans]), best, key=(*PACKAGE, "chunk_id"))
    # Each passage keeps the score of the list that brought it.
    given = [x.select(*PACKAGE, "chunk_id", F.lit(n).alias("src"), "score") for n, x in enumerate([best] if absence else [scans, best])]
    merged = merged.join(given[0] if absence else given[0].unionByName(given[1]), [*PACKAGE, "chunk_id", "src"], "left")
    text = known.select("chunk_id", "file_name", "page_number", "text")
    rows = merged.join(text, "chunk_id").groupBy(*PACKAGE).agg(F.sort_array(F.collect_list(F.struct("src", "rank", "chunk_id", "file_name", "page_number", "text", "score"))).alias("passages"))
    wanted = only if only is not None else known.select("bid_id").distinct().crossJoin(F.broadcast(definitions.select("field_name")))
    return wanted.join(rows, PACKAGE, "left")


def run(chunks: DataFrame, make_extractor=PatternExtractor, definitions: DataFrame | None = None, changes: DataFrame | None = None, files: DataFrame | None = None, retries: int = SETTINGS.max_retries, make_reconciler=PatternReconciler) -> Result:
    """Every step is a plan over all packages; between the bounded retries results are written to cut the lineage.

    Amendments are the recorded ``changes`` where they are given, else those that ``make_reconciler`` proposes and the addenda's
    quotes and the validator's gate accept; an amended field's source is the addendum, before its older ones.
    """
    spark, tracer = chunks.sparkSession, Tracer()
    definitions = definitions if definitions is not None else field_definitions(spark)
    with tracer.step("retrieval"):
        index, vectors = build_index(chunks), stage(vectors_of(chunks))
        passages = stage(gather(chunks, definitions, index, vectors=vectors))
    with tracer.step("extraction"):
        found = stage(extract(passages, make_extractor))
    known = chunks.select("chunk_id", "bid_id", "file_name", "page_number", "text")
    names = [r[0] for r in definitions.select("field_name").collect()]

    def confirmed(x: DataFrame) -> DataFrame:
        """Fields that weren't found are searched again by other hints; an error there counts, it isn't absence."""
        status = F.coalesce("status", F.lit(""))
        hinted = definitions.where(F.size("hints") > 0)
        absent = stage(x.where((status != "ERROR") & (F.col("value").isNull() | (status == "NOT_FOUND"))).join(F.broadcast(hinted), "field_name", "left_semi").select(*PACKAGE))
        if absent.isEmpty():
            return x
        again = extract(gather(chunks, hinted, index, SETTINGS.top_k, absent, vectors, True), make_extractor)
        again = stage(again.where("status = 'ERROR' or (status = 'FOUND' and value is not null)"))
        return stage(x.join(again.select(*PACKAGE), PACKAGE, "left_anti").unionByName(again))

    def judged(x: DataFrame) -> DataFrame:
        return stage(validate(x.withColumn("output_id", F.xxhash64(*PACKAGE)), known))

    with tracer.step("validation"):
        found = confirmed(found)
        checked = judged(found)
    for n in range(1, retries + 1):
        failed = checked.where("bucket = 'failed'").select(*PACKAGE)
        if failed.isEmpty():
            break
        with tracer.step("retry", n=n):
            again = confirmed(stage(extract(gather(chunks, definitions, index, 8, failed, vectors), make_extractor)))
            found = stage(found.join(failed, PACKAGE, "left_anti").unionByName(again))
            checked = judged(found)
    with tracer.step("reconciliation"):
        if changes is not None and files is not None:
            accepted = stage(supersede(changes, files))
            last = accepted.where("is_final").select("bid_id", F.col("field").alias("__f"), F.col("new_value").alias("__v"), F.lit(None).cast(SOURCE).alias("__s"), F.lit(None).cast("double").alias("__c"))
        else:
            values = checked.select("bid_id", "field_name", "value")
            proposed = stage(propose(chunks, make_reconciler, names, values))
            accepted = stage(accept(proposed.where("error is null").drop("error"), chunks, definitions))
            source = F.struct(F.col("file_name").alias("file"), F.col("page_number").alias("page"), "quote", "chunk_id")
            last = accepted.where("is_final").select("bid_id", F.lower(F.trim("field")).alias("__f"), F.col("new_value").alias("__v"), source.cast(SOURCE).alias("__s"), F.col("confidence").alias("__c"))
        checked = checked.withColumn("__f", F.lower(F.trim("field_name"))).join(last, ["bid_id", "__f"], "left")
        amended = F.col("__v").isNotNull()
        sources = F.when(amended & F.col("__s").isNotNull(), merged_sources(F.col("__s"), F.col("sources"))).otherwise(F.col("sources"))
        proven = amended & F.col("__s").isNotNull()
        kept = {"value": F.coalesce("__v", "value"), "amended": amended, "sources": sources, "computed_confidence": F.coalesce("__c", "computed_confidence")}
        # An amendment that its addendum proves has passed; it is neither absent nor failed any more.
        kept |= {"bucket": F.when(proven, "passed").otherwise(F.col("bucket")), "status": F.when(proven, "FOUND").otherwise(F.col("status")), "is_valid": F.col("is_valid") | proven, "issue": F.when(~proven, F.col("issue"))}
        checked = stage(checked.withColumns(kept).drop("__f", "__v", "__s", "__c"))
    with tracer.step("finalizer"):
        final = finalize(checked.withColumn("sources", F.when(F.col("amended") & (F.coalesce(F.size("sources"), F.lit(-1)) <= 0), F.array(F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("quote"), F.lit(None).cast("string").alias("chunk_id")))).otherwise(F.col("sources"))), "computed_confidence")
    return Result(final, completeness(checked), accepted, tracer)
