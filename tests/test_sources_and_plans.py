"""Sources, providers, the whole run, the stream and the driver's contract."""

import ast
import importlib.util
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bidweave import api
from bidweave.operators import assembly, chunking, indexing, retrieve, routing, trace, validation
from bidweave.plans import pipeline, providers
from bidweave.sources import files, html, pdf
from bidweave.streaming import index_stream

ROOT = Path(__file__).parents[1]
PAGE = """<html><nav>menu</nav><script>var x</script><dl><dt>Due Date:</dt><dd>May 1</dd><dt>555-123-4567</dt><dd>no</dd></dl>
<div><span class="field-label">Buyer</span><span>Ann Oak</span></div><p>Mail ann@oak.example or 555-123-4567</p>
<table><tr><th>Item</th><th>Qty</th></tr><tr><td>Desk|A</td><td>4</td></tr></table><table><tr><td>solo</td></tr></table></html>"""


def test_html(spark):
    got = html.parse(PAGE)
    assert "menu" not in got["text"] and "var x" not in got["text"] and got["closing_date"] == "May 1"
    assert got["pairs"] == {} or "555-123-4567" not in got["pairs"]
    assert got["contact"] == "Ann Oak | ann@oak.example | 555-123-4567"
    assert got["tables"] == ["| Item | Qty |\n| --- | --- |\n| Desk\\|A | 4 |"]
    rows = html.parse_pages(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>open <b>tags")], "id int, html string")).orderBy("id").collect()
    assert [r.text for r in rows[1:]] == ["", "", "open\ntags"] and rows[0].tables == got["tables"]


def test_scope_items():
    assert html.scope_items("1. Desk Desk oak *new* 4 1/2/2025 2. Chair See more") == ["1. Desk oak *new* | Quantity: 4 | Due Date: 1/2/2025", "2. Chair"]


def test_scan(spark, tmp_path):
    for name in ("b.pdf", "a.HTML", "c.htm", "~d.pdf", "e.txt"):
        folder = tmp_path / "Bid7"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("x")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "z.pdf").write_text("x")
    got = files.scan_folder(spark, str(tmp_path / "Bid7")).orderBy("ord").collect()
    assert [r.file_name for r in got] == ["a.HTML", "b.pdf", "c.htm"] and got[0].bid_id == "Bid7" and len(got[0].hash) == 64
    assert {r.bid_id for r in files.scan_packages(spark, str(tmp_path)).collect()} == {"Bid7"}
    with pytest.raises(FileNotFoundError):
        files.scan_folder(spark, str(tmp_path / "none"))


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise providers.Transient(429 if len(calls) == 1 else 503)
        return {"value": "x", "status": "FOUND"}

    assert providers.with_retries(call, sleep=waits.append)["value"] == "x" and waits == [8.0, 6.0]

    def fail():
        raise providers.Transient()

    assert providers.with_retries(fail, sleep=waits.append)["status"] == "ERROR" and waits[2:] == [2.0, 4.0, 8.0]
    now, slept = [0.0], []
    limit = providers.Limiter(15, lambda: now[0], slept.append)
    limit()
    limit()
    assert slept == [4.0]


CHUNKS = [("c1", "Due Date: May 1, 2025\nmore", "Bid1", "a.pdf", "rfp", 1), ("c2", "Title: Desks", "Bid1", "a.pdf", "rfp", 2), ("c3", "Title: Lamps", "Bid2", "b.pdf", "rfp", 1), ("c4", "Title: Other", "Bid2", "b.pdf", "addendum", 3)]
SCHEMA = "chunk_id string, text string, bid_id string, file_name string, doc_type string, page_number int"


def test_whole_run(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)
    changes = spark.createDataFrame([(1, "Bid1", 1, 1, "due date", "May 1, 2025", "May 9, 2025", "add.pdf")], "change_id int, bid_id string, addendum_number int, ord int, field string, old_value string, new_value string, file_name string")
    none = spark.createDataFrame([], "bid_id string, file_name string, addendum_number int")
    out = pipeline.run(chunks, changes=changes, files=none)
    got = {(r.bid_id, r.field_name): r for r in out.fields.collect()}
    assert len(got) == 40
    assert got["Bid1", "Due Date"].value == "May 9, 2025" and got["Bid1", "Due Date"].amended
    assert got["Bid2", "Title"].value == "Lamps" and got["Bid2", "Title"].bucket == "passed"
    assert got["Bid2", "Due Date"].bucket == "not_found"
    assert {r.bid_id: r.completeness for r in out.summary.collect()} == {"Bid1": 10.0, "Bid2": 5.0}
    assert [s["agent"] for s in out.tracer.steps][:3] == ["retrieval", "extraction", "validation"]


def test_absence_is_confirmed_by_other_hints(spark):
    rows = [(f"c{i}", "Lamps alpha beta gamma", "B", "a.pdf", "rfp", 1) for i in range(9)] + [("c9", "delta epsilon\nLamps: forty", "B", "a.pdf", "rfp", 2), ("d0", "delta epsilon\nChairs: nine", "B", "a.pdf", "addendum", 3)]
    definitions = spark.createDataFrame([(0, "Lamps", ["alpha", "beta", "gamma", "delta", "epsilon"]), (1, "Chairs", ["delta"]), (2, "Desks", [])], "field_ord int, field_name string, hints array<string>")
    got = {r.field_name: r for r in pipeline.run(spark.createDataFrame(rows, SCHEMA), definitions=definitions).fields.collect()}
    assert (got["Lamps"].value, got["Lamps"].bucket) == ("forty", "passed")
    assert got["Chairs"].bucket == got["Desks"].bucket == "not_found" and len(got) == 3


def test_confidence_counts_the_cited_passage(spark):
    rows = [("c1", "Lamps alpha beta gamma", "B", "a.pdf", "rfp", 1), ("c2", "Lamps: forty", "B", "a.pdf", "rfp", 2)]
    definitions = spark.createDataFrame([(0, "Lamps", ["alpha", "beta", "gamma"])], "field_ord int, field_name string, hints array<string>")
    r = pipeline.run(spark.createDataFrame(rows, SCHEMA), definitions=definitions).fields.first()
    assert (r.value, r.retrieval_score, r.retrieval_rank) == ("forty", 0.25, 1)
    assert r.computed_confidence == 0.70


def test_facade(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA).withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number"), "section": F.lit(None).cast("string"), "addendum_number": F.lit(None).cast("int"), "is_table": F.lit(False)})
    packages = spark.createDataFrame([("Bid1", "RFP-1-23", "Oak Desks", "Oak County", 1)], "bid_id string, solicitation_number string, title string, agency string, portal_id int")
    row = api.ask(spark, chunks, packages, "title of RFP-1-23").first()
    assert row.routed_bid == "Bid1" and row.bid_id == "Bid1" and api.health()["status"] == "ok"
    assert providers.embed(chunks.select("text").limit(1)).first().embedding is not None


def test_comparison_and_unnamed_package(spark):
    rows = [(f"a{i}", f"warranty warranty years {i}", "Bid1", "a.pdf", "rfp", i) for i in range(9)] + [("b0", "long warranty text on other matters", "Bid2", "b.pdf", "rfp", 1), ("b1", "zirconium plates", "Bid2", "b.pdf", "addendum", 1)]
    chunks = spark.createDataFrame(rows, SCHEMA).withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number"), "section": F.lit(None).cast("string")})
    packages = spark.createDataFrame([("Bid1", None, None, None, 1)], "bid_id string, solicitation_number string, title string, agency string, portal_id int")
    got = api.ask(spark, chunks, packages, "compare the warranty of all bids").collect()
    assert sorted(r.bid_id for r in got) == ["Bid1"] * 5 + ["Bid2"] * 2 and {r["rank"] for r in got} == {1, 2, 3, 4, 5} and got[0].routed_bid is None
    assert {(r.routed_bid, r.bid_id) for r in api.ask(spark, chunks, packages, "who makes zirconium plates").collect()} == {("Bid2", "Bid2")}


def test_searches_are_hybrid(spark):
    chunks = spark.createDataFrame(CHUNKS, SCHEMA).withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number"), "section": F.lit(None).cast("string")})
    assert {r.chunk_id for r in api.search(spark, chunks, "lamps").collect()} == {"c1", "c2", "c3", "c4"}
    definitions = spark.createDataFrame([(0, "Lamps", ["lamps"])], "field_ord int, field_name string, hints array<string>")
    got = {r.bid_id: [p.chunk_id for p in r.passages] for r in pipeline.gather(chunks, definitions, retrieve.build_index(chunks)).collect()}
    assert got == {"Bid1": ["c1", "c2"], "Bid2": ["c3"]}


def test_stream(spark, tmp_path):
    src, idx = tmp_path / "src", str(tmp_path / "idx")
    src.mkdir()
    (src / "a.txt").write_text("one")

    def to_chunks(df):
        return df.select(F.concat("file_name", F.lit("_"), F.substring("hash", 1, 6)).alias("chunk_id"), "path", F.col("content").cast("string").alias("text"))

    schema = "chunk_id string, path string, text string"
    index_stream.watch(spark, str(src), idx, to_chunks, schema).awaitTermination()
    (src / "b.txt").write_text("two")
    index_stream.watch(spark, str(src), idx, to_chunks, schema).awaitTermination()
    assert {r.text for r in index_stream.current(spark, idx, "chunks", schema).collect()} == {"one", "two"}
    assert index_stream.current(spark, idx, "manifest", "path string").count() == 2
    before = indexing.read_version(spark, idx)
    assert index_stream.merge(spark, idx, None, None, to_chunks, schema, before["batch"]) == before  # run again
    (src / "a.txt").unlink()
    (src / "c.txt").write_text("three")
    index_stream.watch(spark, str(src), idx, to_chunks, schema).awaitTermination()
    assert {r.text for r in index_stream.current(spark, idx, "chunks", schema).collect()} == {"two", "three"}
    (src / "b.txt").unlink()
    v = index_stream.sweep(spark, str(src), idx, schema)
    assert (v["files"], v["added"], v["removed"]) == (1, 0, 1)
    assert {r.text for r in index_stream.current(spark, idx, "chunks", schema).collect()} == {"three"}
    assert index_stream.index_folder(spark, str(src), idx, to_chunks, schema)["files"] == 0
    v = index_stream.index_folder(spark, str(src), idx, to_chunks, schema, force=True)
    assert (v["files"], v["added"], v["removed"]) == (1, 1, 1)
    assert {r.text for r in index_stream.current(spark, idx, "chunks", schema).collect()} == {"three"}


def test_amendments_of_the_run(spark):
    """The provider's proposals are proven by the addenda and pass the validator's gate before they hold."""
    rows = [("c1", "Due Date: May 1, 2025\nmore", "B", "a.pdf", "rfp", 1), ("a1", "New Due Date: May 9, 2025\nNew Title: Lamps", "B", "Addendum 1.pdf", "addendum", 1), ("a2", "New Due Date: soon", "B", "Addendum 2.pdf", "addendum", 1)]
    definitions = spark.createDataFrame([(0, "Due Date", ["deadline"]), (1, "Title", ["title"])], "field_ord int, field_name string, hints array<string>")
    out = pipeline.run(spark.createDataFrame(rows, SCHEMA), definitions=definitions)
    got = {r.field_name: r for r in out.fields.collect()}
    assert got["Due Date"].value == "May 9, 2025" and got["Due Date"].amended and [s.file for s in got["Due Date"].sources] == ["Addendum 1.pdf", "a.pdf"]
    assert (got["Title"].value, got["Title"].bucket, got["Title"].status) == ("Lamps", "passed", "FOUND")
    assert out.changes.count() == 2 and out.tracer.steps[-1]["agent"] == "finalizer"


def test_grounding_stays_in_the_package(spark):
    """One file name in two packages: a quote of one is not proven by the other."""
    chunks = spark.createDataFrame([("x1", "the bond is ten per cent", "A", "RFP.pdf", "rfp", 1), ("y1", "no such words", "B", "RFP.pdf", "rfp", 1), (None, "the bond is ten per cent", "B", None, None, None)], SCHEMA)
    rows = [(1, "A", "The bond is", "RFP.pdf", 1, None), (2, "B", "The bond is ten", "RFP.pdf", 1, "x1"), (3, "A", "the BOND", "other.pdf", 9, "zz"), (4, None, "the bond", "RFP.pdf", 1, "x1"), (5, "A", " ", "RFP.pdf", 1, "x1"), (6, "A", None, None, None, None)]
    outputs = spark.createDataFrame([(i, b, "Bid Bond", "ten", "FOUND", [(f, p, q, c)]) for i, b, q, f, p, c in rows], "output_id long, bid_id string, field_name string, value string, status string, sources array<struct<file:string,page:int,quote:string,chunk_id:string>>")
    got = {r.output_id: (r.is_grounded, r.tier, r.matched_chunk) for r in validation.ground(outputs, chunks).collect()}
    assert got[1] == (True, 2, "x1") and got[3] == (True, 4, "x1") and got[2][1] == 4 and got[2][2] is None
    assert not any(got[i][0] for i in (4, 5, 6))
    long = spark.createDataFrame([("z1", "x |One two| three  FOUR, five\nsix* seven", "A", "z.pdf", "rfp", 1), ("z2", "one two three four", "A", "z.pdf", "rfp", 2), ("z3", "one two three four five six", "B", "z.pdf", "rfp", 2)], SCHEMA)
    quotes = [("two three four, five six", "z1"), ("one two three four, five six seven", "z1"), ("ne two three four, five si", "z1"), ("one two three four five", None), ("one two three four", "z1"), ("two three four", "z1")]
    outputs = spark.createDataFrame([(i, "A", "Bid Bond", "ten", "FOUND", [("none.pdf", 1, q, None)]) for i, (q, _) in enumerate(quotes)], outputs.schema)
    assert {r.output_id: r.matched_chunk for r in validation.ground(outputs, long).collect()} == {i: want for i, (_, want) in enumerate(quotes)}
    assert validation.ground(outputs.limit(0), chunks).collect() == [] and validation.ground(outputs, chunks.limit(0)).where("is_grounded").count() == 0


def test_structured_replies():
    good = '{"value": "x", "status": "FOUND", "quote": "q", "file_name": "f", "page_number": "3"}'
    assert providers.parse_reply(f"```json\n{good}\n```")["page_number"] == 3 and providers.parse_reply(f"So: {good}.")["value"] == "x"
    assert [providers.parse_reply(x) for x in (None, "", "no", "[1]", '{"status": "MAYBE"}', '{"status": "FOUND", "value": 3}')] == [None] * 6
    asked = []

    def call(prompt):
        asked.append(prompt)
        return "broken" if len(asked) == 1 else good

    got = providers.ReplyExtractor(call, lambda f, p: f"ask {f}").extract("Title", [{}])
    assert got == {"value": "x", "status": "FOUND", "quote": "q", "file": "f", "page": 3, "chunk_id": None} and len(asked) == 2 and "broken" in asked[1]
    assert providers.ReplyExtractor(lambda p: "never", lambda f, p: "").extract("Title", [{}])["status"] == "NOT_FOUND"
    assert providers.ReplyExtractor(lambda p: good.replace('"q"', "null"), lambda f, p: "").extract("Title", [{}])["value"] is None


class Pages:
    def pages(self, content):
        if content == b"bad":
            raise ValueError("corrupt")
        return [{"text": "long enough text of a page, by far"}, {"text": "", "drawings": 0}, {"text": "ab", "images": 1}, {"text": "", "drawings": 30, "widgets": [{"name": "n", "value": " v ", "type": "t"}, {"name": "m", "value": "", "type": "t"}]}]


class Seen:
    def recognize(self, page):
        return ("seen", "ocr_success") if page.get("images") else pdf.UNAVAILABLE


def test_pdf_pages(spark):
    df = spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"bad")), ("c", None)], "path string, content binary")
    rows = {(r.path, r.page_number): r for r in pdf.read_pdfs(df, Pages, Seen).collect()}
    assert [rows["a", n].status for n in (1, 2, 3, 4)] == ["extractable", "blank", "scanned (image)", "non-extractable (vector outlines)"]
    assert rows["a", 3].text == "seen" and rows["a", 3].ocr_status == "ocr_success" and rows["a", 4].text == "### Form Fields (Page 4)\n- **n**: v" and rows["a", 4].ocr_status == pdf.UNAVAILABLE[1]
    assert rows["b", None].error == "ValueError: corrupt" and rows["b", None].doc_type == "other"
    assert pdf.read_pdfs(df.limit(0), Pages, Seen).collect() == []
    report = files.coverage_json(pdf.read_pdfs(df.where("path = 'a'"), Pages, Seen).withColumns({"bid_id": F.lit("B"), "file_name": F.lit("a b.pdf")})).first()
    assert report.name == "B_a_b_coverage.json" and '"non_extractable_pages":[4]' in report.report and '"form_widget_pages":[4]' in report.report


def test_assembly(spark):
    pages = spark.createDataFrame([(n, "b", "specs.pdf", n, f"Head line of file\nbody {w} text\nPage {n} of 3") for n, w in enumerate(("one", "two", "three"), 1)] + [(9, "b", "x.pdf", 1, None)], "page_id long, bid_id string, file_name string, page_number int, raw_text string")
    tables = spark.createDataFrame([(2, ["| a |\n|---|", "| b |"])], "page_id long, tables array<string>")
    got = {r.page_id: r for r in assembly.assemble(pages, tables).collect()}
    assert got[1].cleaned_text == "body one text" and got[1].page_label == "1 of 3" and got[9].cleaned_text == ""
    assert got[2].cleaned_text == f"body two text\n\n{chunking.TABLE_MARKER}\n\n| a |\n|---|\n\n| b |"
    typed = assembly.by_name(spark.createDataFrame([("a_Affidavit.pdf",), ("specs.pdf",), (None,)], "file_name string"))
    assert {r.file_name: (r.name_type, r.skip_tables) for r in typed.collect()} == {"a_Affidavit.pdf": ("affidavit", True), "specs.pdf": ("specs", False), None: ("other", False)}
    docs = typed.withColumn("doc", F.coalesce("file_name", F.lit("")))
    cell = lambda doc, r, c, t: (doc, 1, 1, r, c, t)
    cells = [cell(d, r, c, f"{'ab'[c]}{r}") for d in ("a_Affidavit.pdf", "") for r in range(3) for c in range(2)]
    words = [("specs.pdf", 1, 200.0, 40.0 * k, 260.0, 40.0 * k + 10, f"ABC-{k}00") for k in range(1, 6)] + [("specs.pdf", 1, 10.0, 40.0 * k, 60.0, 40.0 * k + 10, f"item{k}") for k in range(1, 6)]
    found = assembly.page_tables(docs, spark.createDataFrame(cells, "doc string, page int, tbl int, row int, col int, text string"), spark.createDataFrame(words, "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert {r.doc: r.text.split("\n")[2] for r in found.collect()} == {"": "| a1 | b1 |", "specs.pdf": "| ABC-100 | item1 |"}


def test_html_sections():
    got = html.parse(PAGE.replace("</dl>", "<dt>Scope of Work</dt><dd>1. Desk 2. Chair</dd></dl>"))["sections"]
    assert got.startswith(html.DETAILS) and f"{html.SCOPE}\n1. Desk\n2. Chair" in got and got.endswith(f"{html.ITEMS}\n\n| Item | Qty |\n| --- | --- |\n| Desk\\|A | 4 |")
    assert html.parse("<p>x</p>")["sections"] == html.DETAILS and html.parse(None)["sections"] == ""


def test_folders_and_saved_results(spark, tmp_path):
    for name in ("Bid2", "bid1", "other", "third/solicitations"):
        (tmp_path / name).mkdir(parents=True)
    assert files.discover(str(tmp_path)) == ["Bid2", "bid1", "third"]
    with pytest.raises(FileNotFoundError):
        files.scan_folder(spark, f"file://{tmp_path}/none")
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    get = lambda **k: files.cached(spark, str(tmp_path / "saved"), "n int", make, **k).first().n
    assert [get(), get(), get(force=True)] == [1, 1, 2]
    t = trace.Tracer()
    with t.step("x"):
        pass
    t.save(spark, str(tmp_path / "trace"), "B")
    t.save(spark, str(tmp_path / "trace"), "B")
    assert spark.read.json(str(tmp_path / "trace")).count() == 2


def test_routing_parts(spark):
    q = spark.createDataFrame([(1, "compare bid 2 and Bid3"), (2, "what changed in addendum no. 4?"), (3, None), (4, "a name of very many words that goes on and on for more than twelve of them")], "question_id long, question string")
    entries = spark.createDataFrame([("Bid2", "id", "bid 2"), ("Bid2", "id", "bid2"), ("Bid3", "id", "bid3"), ("Bid9", "title", "A Name of very-many words that goes on and on for more than twelve of them")], "bid_id string, kind string, value string")
    scores = routing.score_packages(q, entries)
    got = {(r.question_id, r.bid_id): r.score for r in scores.collect()}
    assert got[1, "Bid2"] == got[1, "Bid3"] == 15 and got[4, "Bid9"] == 8
    indexed = spark.createDataFrame([("Bid2",), ("Bid3",), ("Bid9",)], "bid_id string")
    assert {(r.question_id, r.bid_id) for r in routing.compared(scores, indexed).collect()} == {(1, "Bid2"), (1, "Bid3"), (4, None)}
    assert [r.n for r in q.orderBy("question_id").select(routing.addendum_asked("question").alias("n")).collect()] == [None, 4, None, None]
    order = spark.createDataFrame([(b,) for b in ("a", "Bid3", "Bid1", "z", "Bid2")], "bid_id string").orderBy(*routing.bid_order())
    assert [r.bid_id for r in order.collect()] == ["Bid1", "Bid2", "Bid3", "a", "z"]
    chunks = spark.createDataFrame([("c", "Issued by the Oak School District", "B", "f", "rfp", 1), ("d", "Elm City", "B", "f", "rfp", 2)], SCHEMA)
    assert [r.value for r in routing.agencies(chunks).collect()] == ["issued by the oak school district"]


def test_relevance_and_findable_items(spark):
    chunks = spark.createDataFrame([("The Bond text", "Big File.pdf", 2, 4, 2), ("other", None, None, None, None)], "text string, file_name string, page_start int, page_end int, page_number int")
    items = spark.createDataFrame([(1, "bond", "file.pdf", 3), (2, "bond", "file.pdf", 5), (3, "bond", "My Big File.pdf", 4), (4, "none", "Big File.pdf", 3), (5, None, None, None)], "query_id int, target_substring string, expected_file string, expected_page int")
    assert {r.query_id: r.is_findable for r in retrieve.findable(items, chunks).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert retrieve.report_json(spark.createDataFrame([(0.5,)], "mrr double"), mode="hybrid").first().report == '{"mode":"hybrid","mrr":0.5}'


def test_findable_items_meet_only_files_of_their_name(spark):
    names = ["a.pdf", "Big a.pdf", "big A.pdf copy", "f", "", None, "Request 00012.pdf", "00012", "pdf", "Request"]
    spans = [(2, 4, 3), (0, 0, 3), (None, None, 3), (None, 4, 2), (5, None, 9), (1, 2_000_000_000, 1), (4, 2, 3), (None, None, None), (2, None, 2)]
    rows = [(t, n, *s) for i, n in enumerate(names) for j, s in enumerate(spans) for t in ["The Bond", None, f"word {i} {j}"]]
    asked = [(t, f, p) for t in ["bond", "word 1", "WORD 3 5", "word 5", "none"] for f in [*names[:5], "A Request 00012.pdf", "x", "a"] for p in (1, 3, 4, 1_999_999_999, None)]
    chunks = spark.createDataFrame(rows, "text string, file_name string, page_start int, page_end int, page_number int")
    items = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "query_id int, target_substring string, expected_file string, expected_page int")

    def fits(target, file, page):
        for text, name, start, end, number in rows:
            first, last, name = start or number, end or number, (name or "").lower()
            if None not in (page, first, last) and first <= page <= last and target.lower() in (text or "").lower() and (name in file.lower() or file.lower() in name):
                return True
        return False

    assert {r.query_id: r.is_findable for r in retrieve.findable(items, chunks).collect()} == {i: fits(*a) for i, a in enumerate(asked)}
    files = spark.range(300).select(F.concat(F.lit("Notice "), "id", F.lit(" of 2025.pdf")).alias("file_name"), F.lit("text").alias("text"), *[F.lit(1).alias(c) for c in ("page_start", "page_end", "page_number")])
    own = files.select(F.col("file_name").alias("query_id"), F.lit("text").alias("target_substring"), F.col("file_name").alias("expected_file"), F.lit(1).alias("expected_page"))
    assert retrieve._to_compare(own, files).count() == 300
    assert retrieve.findable(own.limit(0), files).count() == 0 and not any(r.is_findable for r in retrieve.findable(own, files.limit(0)).collect())


def test_answers_and_service(spark, tmp_path):
    chunks = spark.createDataFrame([*CHUNKS, ("c5", "head\nThe closing date is changed to May 9.", "Bid1", "Addendum 2.pdf", "addendum", 1)], SCHEMA).withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number"), "section": F.lit(None).cast("string"), "addendum_number": F.lit(None).cast("int"), "is_table": F.lit(False)})
    packages = spark.createDataFrame([("Bid1", "RFP-1-23", "Oak Desks", "Oak County", 1)], "bid_id string, solicitation_number string, title string, agency string, portal_id int")
    got = api.answer(spark, chunks, packages, "what is the title of RFP-1-23")
    assert got["answer"] == "Title: Desks" and got["citations"][0]["file"] == "a.pdf" and got["target_bid"] == "Bid1"
    got = api.answer(spark, chunks, packages, "what changed in addendum 2")
    assert got["target_bid"] == "Bid1" and "changed to May 9" in got["answer"] and got["is_addendum_summary"]
    assert api.answer(spark, chunks.limit(0), packages, "zzz")["answer"] == providers.NOT_FOUND
    assert api.compared_query("compare the warranty of all bids", []).startswith("warranty") and api.compared_query("compare Bid1 and Bid2 desks", ["Bid1", "Bid2"]) == "desks"
    values = spark.createDataFrame([("Bid1", "title", "Desks"), ("Bid2", "title", "Lamps")], "bid_id string, field_name string, value string")

    class Provider:
        def synthesize(self, rows):
            return {"title": "they differ"}

    api.save_comparison(values, ["Bid2", "Bid1"], ["title"], str(tmp_path / "c"), Provider())
    assert "they differ" in (tmp_path / "c" / "comparison.json").read_text() and "| Field | Bid1 | Bid2 |" in (tmp_path / "c" / "comparison.md").read_text()
    chunks.write.parquet(str(tmp_path / "chunks.parquet"))
    packages.write.parquet(str(tmp_path / "packages.parquet"))
    service = api.Service(spark, str(tmp_path))
    assert service.call("GET", "/health") == (200, api.health()) and service.call("GET", "/none")[0] == 404 and service.call("POST", "/search", {"nothing": 1})[0] == 422
    status, rows = service.call("POST", "/search", {"query": "lamps", "mode": "bm25_only"})
    assert status == 200 and rows[0]["chunk_id"] == "c3" and service.call("POST", "/compare", {"bids": ["Bid1"]})[0] == 500


def test_contract():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p1_found", "p6_found", "bm25_topk"} <= set(names)


def test_core_never_imports_llm():
    for p in (ROOT / "bidweave").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "bidweave").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("bidweave.llm") for n in names), p
