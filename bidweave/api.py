"""Facade: index, search, ask, extract and compare as plain functions over a data folder or a scanned one, and as endpoints."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators import amendments, indexing, retrieve, routing
from bidweave.plans import pipeline
from bidweave.plans.providers import NOT_FOUND, PatternAnswerer, PatternSummarizer
from bidweave.session import table
from bidweave.sources import files
from bidweave.streaming import index_stream

#: Passages of each package that a comparison gets.
PER_PACKAGE = 5
#: Words of questions on deadlines, and the query that finds their changes.
ON_DATES = ["deadline", "due date", "closing", "addendum"]
ON_COMPARED_DATES = ["deadline", "due date", "closing", "earliest"]
DATE_QUERY = "addendum new due date proposal submission deadline extension amended date"
#: What is searched for in each package for a comparison on a topic.
COMPARED_TOPICS = [
    (["procurement scale", "total units", "quantities"], "total units target quantity estimated quantity line items laptops devices quantities"),
    (["issuing authority", "agency"], "issuing authority agency organization department school district treasurer"),
    (["warranty"], "warranty extended warranty manufacturer warranty years coverage support terms"),
    (["earliest", "deadline", "due date"], "submission deadline proposal due date and time closing date addendum"),
    (["pre-bid", "pre-proposal", "meeting"], "pre-bid meeting pre-proposal conference date time teams video conference"),
    (["summarise", "summarize", "paragraph"], "solicitation overview scope of work title project description requirements"),
]
VERSION = "1.0.0"


def health() -> dict:
    return {"status": "ok", "version": VERSION}


def index(chunks: DataFrame, manifest: DataFrame, index_dir: str) -> DataFrame:
    """Writes the index as a new version and gives its statistics."""
    indexing.save(index_dir, chunks, manifest)
    return indexing.stats(chunks, manifest)


def open_index(spark: SparkSession, base: str, index_dir: str, to_chunks: Callable[[DataFrame], DataFrame], chunk_schema: str) -> DataFrame:
    """The chunks of the index; where it is empty, the packages below ``base`` are found and indexed first."""
    if not indexing.versions(spark, index_dir):
        for name in files.discover(base):
            folder = f"{base}/{name}"
            index_stream.index_folder(spark, f"{folder}/solicitations" if Path(folder, "solicitations").is_dir() else folder, f"{index_dir}", to_chunks, chunk_schema)
    return indexing.load(spark, index_dir, "chunks", chunk_schema)


def search(spark: SparkSession, chunks: DataFrame, text: str, bid_id: str | None = None, doc_type: str | None = None, top_k: int = 5, mode: str = "hybrid") -> DataFrame:
    q = spark.createDataFrame([(0, text)], "query_id long, query string")
    return retrieve.search(chunks, q, top_k, mode, bid_id=bid_id, doc_type=doc_type)


def _of_each_package(spark: SparkSession, chunks: DataFrame, text: str, k: int, **filters) -> DataFrame:
    """The k best passages of every package, ranked in each on its own."""
    q = spark.createDataFrame([(0, text)], "query_id long, query string")
    best = retrieve.search_within(chunks, q, k, **filters)
    return retrieve.projected(best.drop("bid_id").join(chunks.dropDuplicates(["chunk_id"]), "chunk_id"))


def route(spark: SparkSession, chunks: DataFrame, packages: DataFrame, question: str) -> tuple[str | None, DataFrame]:
    """The package that a question is about (or COMPARISON), and the packages that a comparison is about (null: all)."""
    q = spark.createDataFrame([(0, question)], "question_id long, question string")
    scores = routing.score_packages(q, routing.catalogue(chunks, packages))
    row = routing.route_all(q, scores, chunks).first()
    return None if row is None else row["target"], routing.compared(scores, chunks.where("bid_id is not null"))


def compared_query(question: str, bids: list[str]) -> str:
    """What is searched for in each package: its topic's words, else the question without the packages and comparing words."""
    low = question.lower()
    for words, query in COMPARED_TOPICS:
        if any(w in low for w in words):
            return query
    for b in bids:
        question = re.sub(rf"\b(?:{re.escape(b)}|{re.escape(b.replace('_', ' '))})\b", "", question, flags=re.IGNORECASE)
    question = re.sub(r"\b(?:between|and|&|both|all|each|compare|comparison)\b|\bbid\s*[-_]?\s*\w+\b", "", question, flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", question).strip()


def ask(spark: SparkSession, chunks: DataFrame, packages: DataFrame, question: str, bid_id: str | None = None, top_k: int = 3) -> DataFrame:
    """The passages that answer a question, from the package it is routed to; a question on deadlines adds passages of addenda.

    A comparison gets the five best passages of every package it is about (on deadlines also three on changed dates).
    """
    low = question.lower()
    target, about = (bid_id, None) if bid_id else route(spark, chunks, packages, question)
    if target == "COMPARISON":
        named = [r["bid_id"] for r in about.where("bid_id is not null").collect()]  # those a question names
        own = chunks.where(F.col("bid_id").isin(named)) if named else chunks
        found = _of_each_package(spark, own, compared_query(question, named) or question, PER_PACKAGE)
        if any(w in low for w in ON_COMPARED_DATES):
            found = found.unionByName(_of_each_package(spark, own, DATE_QUERY, 3))
        return found.withColumn("routed_bid", F.lit(None).cast("string"))
    topic = spark.createDataFrame([(question,)], "question string").select(amendments.topic_query().alias("q")).first()["q"]
    found = search(spark, chunks, topic, target, None, top_k)
    if any(w in low for w in ON_DATES):
        found = found.unionByName(search(spark, chunks, DATE_QUERY, target, None, 3))
    return found.withColumn("routed_bid", F.lit(target).cast("string"))


def _passages(found: DataFrame) -> list[dict]:
    """A question's passages, at most a few of each package it is about, with clean file names and the score each goes on with."""
    rows = found.select("chunk_id", "bid_id", amendments.clean_citation("file_name").alias("file_name"), "citation", "text", retrieve.shown_score().alias("score")).collect()
    page = lambda c: int(m[1]) if (m := re.search(r"\(p\.(\d+)", c or "")) else None
    return [{"chunk_id": r["chunk_id"], "bid_id": r["bid_id"], "file_name": r["file_name"], "page_number": page(r["citation"]), "text": r["text"], "score": r["score"]} for r in rows]


def answer(spark: SparkSession, chunks: DataFrame, packages: DataFrame, question: str, bid_id: str | None = None, top_k: int = 3, make_answerer=PatternAnswerer, make_summarizer=PatternSummarizer) -> dict:
    """The answer to a question with its citations; a question for an addendum's changes gets its summary."""
    number = spark.createDataFrame([(question,)], "question string").select(routing.addendum_asked("question").alias("n")).first()["n"]
    if number is not None:
        return _summary(spark, chunks, packages, question, number, bid_id, make_summarizer)
    found = ask(spark, chunks, packages, question, bid_id, top_k)
    passages = _passages(found)
    routed = found.select("routed_bid").first()
    target, head = routed["routed_bid"] if routed else bid_id, ""
    if routed and target is None and passages:
        bids = sorted({p["bid_id"] for p in passages if p["bid_id"]})
        head = f"Bids included in comparison: {', '.join(bids)}.\n\n"
        target = f"{', '.join(bids)} (Comparison)"
    if not passages:
        return {"question": question, "target_bid": target, "answer": NOT_FOUND, "citations": [], "raw_evidence_count": 0}
    try:
        got = make_answerer().answer(question, passages)
    except Exception as e:  # noqa: BLE001
        got = {"answer": f"Error while the answer was made: {e}", "citations": [], "status": "error"}
    cites = [c | {"file": re.sub(r"^\[[A-Za-z0-9_\-]+\]\s*", "", str(c.get("file") or ""))} for c in got.get("citations", [])]
    return {"question": question, "target_bid": target, "answer": head + got.get("answer", NOT_FOUND), "citations": cites, "raw_evidence_count": len(passages)} | ({"status": got["status"]} if "status" in got else {})


def _summary(spark: SparkSession, chunks: DataFrame, packages: DataFrame, question: str, number: int, bid_id: str | None, make_summarizer) -> dict:
    target = bid_id or route(spark, chunks, packages, question)[0]
    own = amendments.addendum_chunks(chunks)
    if target is None or target == "COMPARISON":
        # The first package that has the addendum, else the first with any.
        best = own.where("bid_id is not null").select("bid_id", (F.col("number") != number).alias("other")).distinct().orderBy("other", *routing.bid_order()).first()
        target = best["bid_id"] if best else None
    row = None if target is None else amendments.summaries(own.where((F.col("bid_id") == target) & (F.col("number") == number)).drop("number"), make_summarizer).first()
    got = None if row is None else row.asDict(recursive=True)
    cites = [{"file": got["file_name"], "page": 1, "quote": c["quote"]} for c in got["changes"] if c["quote"]] if got else []
    return {"question": question, "target_bid": target or "None", "answer": amendments.summary_text(got, target, number), "citations": cites, "is_addendum_summary": True}


def extract(chunks: DataFrame, bid_id: str | None = None, **options) -> pipeline.Result:
    return pipeline.run(chunks.where(F.lower("bid_id") == bid_id.lower()) if bid_id else chunks, **options)


def comparison(values: DataFrame, bids: list[str], fields: list[str], provider=None) -> list[dict]:
    """Rows of a comparison of a few named packages; a provider with ``synthesize(values)`` may add a summary of each field's differences."""
    spark = values.sparkSession
    packages = spark.createDataFrame([(b,) for b in bids], "bid_id string")
    rows = [r.asDict() for r in routing.comparison_matrix(values, packages, fields).orderBy(*routing.bid_order()).collect()]
    told = {}
    if hasattr(provider, "synthesize"):
        try:
            told = provider.synthesize(rows) or {}
        except Exception:  # noqa: BLE001
            told = {}  # the table stands without it
    return [{"field": f, "values": {r["bid_id"]: r[f.replace(" ", "_")] for r in rows}, "summary": told.get(f) or ("identical" if len({r[f.replace(" ", "_")] for r in rows}) == 1 else "different")} for f in fields]


def compare(values: DataFrame, bids: list[str], fields: list[str]) -> str:
    """Markdown over a few named packages."""
    spark = values.sparkSession
    packages = spark.createDataFrame([(b,) for b in bids], "bid_id string")
    return routing.comparison_report([r.asDict() for r in routing.comparison_matrix(values, packages, fields).orderBy(*routing.bid_order()).collect()])


def save_comparison(values: DataFrame, bids: list[str], fields: list[str], out: str, provider=None) -> None:
    """The comparison as Markdown and JSON beside each other."""
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "comparison.md").write_text(compare(values, bids, fields))
    Path(out, "comparison.json").write_text(json.dumps({"bids": bids, "matrix": comparison(values, bids, fields, provider)}, indent=2))


class Service:
    """Endpoints over one data folder: ``call(method, path, body)`` gives (status, body) as a web framework would hand it on."""

    def __init__(self, spark: SparkSession, data: str, index_dir: str | None = None, to_chunks: Callable[[DataFrame], DataFrame] | None = None, chunk_schema: str | None = None):
        self.spark, self.data, self.index_dir, self.to_chunks, self.chunk_schema = spark, data, index_dir, to_chunks, chunk_schema
        self.routes = {("GET", "/health"): self._health, ("GET", "/stats"): self._stats, ("POST", "/index"): self._index, ("POST", "/search"): self._search, ("POST", "/ask"): self._ask, ("POST", "/extract"): self._extract, ("POST", "/compare"): self._compare}

    def call(self, method: str, path: str, body: dict | None = None) -> tuple[int, object]:
        run = self.routes.get((method.upper(), path))
        if run is None:
            return 404, {"detail": f"{method} {path}"}
        try:
            return 200, run(**(body or {}))
        except TypeError as e:
            return 422, {"detail": str(e)}
        except Exception as e:  # noqa: BLE001
            return 500, {"detail": f"{type(e).__name__}: {e}"}

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.data, name)

    def _health(self) -> dict:
        return health()

    def _stats(self) -> dict:
        manifest = self._table("source_files").select(F.concat_ws("/", "bid_id", "file_name").alias("path"))
        return indexing.stats(self._table("chunks"), manifest).first().asDict()

    def _index(self, folder_path: str, force: bool = False) -> dict:
        v = index_stream.index_folder(self.spark, folder_path, self.index_dir, self.to_chunks, self.chunk_schema, force)
        return {"status": "success", "folder": folder_path, "files_indexed": v["files"], "chunks_added": v["added"], "chunks_removed": v["removed"]}

    def _search(self, query: str, bid_id: str | None = None, doc_type: str | None = None, top_k: int = 5, mode: str = "hybrid") -> list[dict]:
        return [r.asDict() for r in search(self.spark, self._table("chunks"), query, bid_id, doc_type, top_k, mode).orderBy("rank").collect()]

    def _ask(self, question: str, bid_id: str | None = None, top_k: int = 3) -> dict:
        return answer(self.spark, self._table("chunks"), self._table("packages"), question, bid_id, top_k)

    def _extract(self, bid_id: str) -> dict:
        got = extract(self._table("chunks"), bid_id)
        rows = got.fields.collect()  # the fields of one package
        return {"bid_id": bid_id, "fields": {r["field_name"]: {"value": r["value"], "status": r["status"], "confidence": r["computed_confidence"], "sources": [s.asDict() for s in r["sources"] or []]} for r in rows}, "summary": [r.asDict() for r in got.summary.collect()], "trace": got.tracer.steps}

    def _compare(self, bids: list[str]) -> dict:
        values = self._table("field_outputs").where(F.col("bid_id").isin(bids)).select("bid_id", F.lower(F.trim("field_name")).alias("field_name"), "value")
        names = [r[0] for r in values.select("field_name").where("field_name is not null").distinct().orderBy("field_name").collect()]
        return {"bids": bids, "matrix": comparison(values, bids, names)}
