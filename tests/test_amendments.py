from pyspark.sql import functions as F

from bidweave.operators import amendments as A
from bidweave.plans.providers import prompt

CHUNKS = [("c1", "B", "Addendum 1.pdf", "addendum", None, 1, "The DUE date is\nnow May 9."), ("c2", "B", "x.pdf", "addendum", 2, 1, "The due date is now May 12."), ("c3", "B", "rfp.pdf", "rfp", None, 1, "made up")]
SCHEMA = "chunk_id string, bid_id string, file_name string, doc_type string, addendum_number int, page_number int, text string"
PROPOSED = "bid_id string, addendum_number int, ord int, field string, new_value string, quote string, file_name string, page_number int, reason string"


def test_accept(spark):
    rows = [
        ("B", 2, 1, "due date", "May 12, 2025", "due date is now May 12", None, None, None),
        ("B", 1, 1, "Due Date", "May 9, 2025", "due date is now may 9", None, None, None),
        ("B", 1, 2, "Due Date", "May 1", "made up", None, None, None),
        ("B", 1, 6, "Due Date", "soon", "due date", None, None, None),
        ("B", 1, 3, None, "x", "due date", None, None, None),
        ("B", 1, 4, "Unknown", "x", "due date", None, None, None),
        ("B", 1, 5, "Due Date", " ", "due date", None, None, None),
    ]
    known = spark.createDataFrame([("Due Date",), ("Title",)], "field_name string")
    got = A.accept(spark.createDataFrame(rows, PROPOSED), spark.createDataFrame(CHUNKS, SCHEMA), known).orderBy("number").collect()
    assert [(r.number, r.new_value, r.old_value, r.is_final, r.chunk_id) for r in got] == [(1, "May 9, 2025", None, False, "c1"), (2, "May 12, 2025", "May 9, 2025", True, "c2")]
    assert 0.8 < got[0].confidence <= 0.98 and got[0].field == got[1].field == "Due Date"


class Model:
    def reconcile(self, fields, passages):
        if "12" in passages[0]["text"]:
            raise RuntimeError("down")
        return [{"field": "Due Date", "new_value": "May 9", "quote": "now May 9"}]


def test_propose(spark):
    got = {r.addendum_number: r for r in A.propose(spark.createDataFrame(CHUNKS, SCHEMA), Model, ["Due Date"]).collect()}
    assert got[1].new_value == "May 9" and got[2].error == "RuntimeError: down"


class Writer:
    def summarize(self, number, passages):
        if number == 2:
            raise RuntimeError("down")
        return {"overview": "", "all_changes": [{"section": "Schedule", "description": "later", "quote": "May 9"}, "other"]}


def test_summaries(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)
    got = {r.number: r.asDict(recursive=True) for r in A.summaries(chunks, Writer).collect()}
    assert got[1]["overview"] and [(c["category"], c["quote"]) for c in got[1]["changes"]] == [("Schedule", "May 9"), ("General", "")]
    assert got[2]["error"] == "RuntimeError: down" and got[2]["changes"] == []
    text = A.summary_text(got[1], "B", 1)
    assert text.startswith("### Addendum 1 Summary for B (Addendum 1.pdf)") and '1. **[Schedule]** later' in text
    assert A.summary_text(None, None, 3) == "No addendum found." and "No explicit" in A.summary_text(got[2], "B", 2)
    assert A.summaries(chunks.limit(0), Writer).collect() == []


def test_small_parts(spark):
    df = spark.createDataFrame([("[Bid1] Big File.pdf", "Which forms?", 0.4)], "file_name string, question string, score double")
    on, strong = A.shown("dense_only")
    r = df.select(A.clean_citation().alias("f"), A.topic_query().alias("q"), on.alias("on"), strong.alias("strong"), A.replace_all("file_name", [("Big", "Small"), ("File", "X")]).alias("x")).first()
    assert tuple(r) == ("Big File.pdf", "Which forms? required affidavits compliance forms certification", True, False, "[Bid1] Small X.pdf")
    src = F.struct(F.lit("a").alias("file"), F.lit(1).alias("page"), F.lit("q").alias("quote"), F.lit("c").alias("chunk_id"))
    old = F.array(src, F.struct(F.lit("b").alias("file"), F.lit(2).alias("page"), F.lit("r").alias("quote"), F.lit("d").alias("chunk_id")))
    assert [s.file for s in df.select(A.merged_sources(src, old).alias("s")).first().s] == ["a", "b"]
    a, b = (spark.createDataFrame([v], "mrr double, recall_5 double") for v in ((0.5, 0.8), (0.6, 0.8)))
    assert A.deltas(a, b).first().keep and not A.deltas(b, a).first().keep
    assert "Quote word for word" in prompt("Title", [{"file_name": "f", "page_number": 1, "chunk_id": "c", "text": "t"}], "d")
