"""Operators of the document pipeline against stated cases and plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.config import SETTINGS, field_definitions
from bidweave.functions import text as X
from bidweave import session
from bidweave.operators import chunking, classify, clean, indexing, retrieve, routing, tables, trace, validation


def apply(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.s for r in df.select("i", fn("t").alias("s")).orderBy("i").collect()]


def test_cleaning(spark):
    assert apply(spark, X.normalize_whitespace, ["a​ b\xa0 c \n\n\n\n d", None, ""]) == ["a b c\n\nd*", "", ""]
    assert apply(spark, X.fix_hyphenation, ["com-\n puting state-of-the-art"]) == ["computing state-of-the-art"]
    assert apply(spark, X.fix_kerning, ["Post Bur n Se lect FACTOR Y Elig ible AFFIRMATIONI FURTHER", "provide a REMAIN data"]) == ["Post Burn Select FACTORY Eligible AFFIRMATION I FURTHER", "provide a REMAIN data"]
    assert apply(spark, X.fix_fused_words, ["AUTHORITYI AFFIRM"]) == ["AUTHORITY I AFFIRM"]
    assert apply(spark, X.rejoin_split, ["a@b.md\n.us x\n@c.org https://e.org/f-\ng"]) == ["a@b.md.us x@c.org https://e.org/f-g"]
    assert apply(spark, X.reflow_lines, ["one\ntwo\nthis is a full line of text\n\n| a | b |\nName:\nlast", None]) == ["one two this is a full line of text\n\n| a | b |\nName:\nlast", ""]
    assert apply(spark, X.page_label, ["x\nPage 1 of 3\ny", "none", None]) == ["1 of 3", None, None]


def terms(text):
    out = []
    for t in re.findall(r"[a-z0-9]+(?:[-_.@][a-z0-9]+)*", text.lower()):
        parts = [p for p in re.split(r"[-_.@]+", t) if p and p != t]
        runs = re.findall(r"[a-z]+|[0-9]+", t)
        runs = [r for r in runs if len(r) >= 2 and r != t] if 1 < len(runs) <= 4 else []
        out += [t, *dict.fromkeys(parts + runs)]
    return out


def test_terms_and_tokens(spark):
    texts = ["JA-207652 bpm044557 a@b.org x", "", None, "É-clair 12a34b56c78d9", "v1.2.3"]
    assert [sorted(t) for t in apply(spark, X.terms, texts)] == [sorted(terms(t or "")) for t in texts]
    assert apply(spark, X.count_tokens, ["a b, c!", "É a", None]) == [5, 2, 0]


def test_headers_ids_citations(spark):
    df = spark.createDataFrame([("Bid1", "addendum", 2, "A_long-name of a file that goes on and on and on.pdf", 3, "General terms and conditions of the contract")], "b string, d string, n int, f string, p int, s string")
    r = df.select(X.context_header("b", "d", "n", "f", "p", "s").alias("h"), X.chunk_id("b", "f", "p", F.lit("c0"), F.lit("text")).alias("c"), X.citation("f", "p", F.lit(4), "s").alias("z"), X.field_citation("f", "p", F.lit("q")).alias("q")).first()
    assert r.h == "[Bid1 | Addendum 2 | A long name of a file that goes on and on | p.3 | Section: General terms and conditions of]"
    assert re.fullmatch(r"Bid1_A_long_name_of_a_file_that_goes_on_and_on_and_on_p3_c0_[0-9a-f]{8}", r.c)
    assert r.z.endswith("(p.3-4 | Section: General terms and conditions of the contract)") and r.q.endswith('(p.3)]: "q"')


def test_running_lines(spark):
    pages = [(i, "b", "f", i, f"Agency rev 1.{i}\nbody {'abc'[i]}\nmore {'abc'[i]}\nsame in all\nlast line {'xyz'[i]}\nPage {i} of 3\n{i}") for i in range(3)] + [(9, "b", "g", 1, None)]
    df = spark.createDataFrame(pages, "page_id int, bid_id string, file_name string, page_number int, raw_text string")
    got = {r.page_id: r for r in clean.strip_running(df).collect()}
    assert got[1].stripped == "body b\nmore b\nsame in all\nlast line y" and got[1].label == "1 of 3" and got[9].stripped == ""


@pytest.mark.parametrize(
    ("name", "preview", "kind", "number", "date"),
    [
        ("Addendum_04 RFP.pdf", "x", "addendum", 4, None),
        ("Contract Affidavit.pdf", "Addendum 2", "affidavit", 2, None),
        ("page.HTML", "Date: 1/2/2025", "bid_page", None, "1/2/2025"),
        ("specs.pdf", "technical requirement", "specs", None, None),
        ("x.pdf", "a proposal", "rfp", None, None),
        (None, None, "other", None, None),
    ],
)
def test_classify(spark, name, preview, kind, number, date):
    r = classify.classify(spark.createDataFrame([(name, preview)], "file_name string, preview string")).first()
    assert (r.found_type, r.found_number, r.found_date) == (kind, number, date)


def pack(text, size, overlap):
    def count(s):
        return len(re.findall(r"\w+|[^\w\s]", s))

    segs = []
    for p in (p.strip() for p in text.split("\n\n")):
        if p:
            segs += [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()] if count(p) > SETTINGS.long_paragraph else [p]
    out, cur, n = [], [], 0
    for s in segs:
        k = count(s)
        if n + k > size and cur:
            out.append("\n\n".join(cur))
            kept, total = [], 0
            for x in reversed(cur):
                if kept and total + count(x) > overlap:
                    break
                kept.insert(0, x)
                total += count(x)
            cur, n = kept, total
        cur, n = [*cur, s], n + k
    return [*out, "\n\n".join(cur)] if cur else out


def test_packing_matches_loop(spark):
    rng = random.Random(2)
    texts = ["", None, "one"]
    for _ in range(30):
        texts.append("\n\n".join(" ".join(rng.choice(["alpha", "beta.", "gamma", "delta!"]) for _ in range(rng.randrange(1, 300))) for _ in range(rng.randrange(1, 9))))
    texts.append("\n\n".join(["one short segment."] * 3000))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = chunking.bodies("text", 120, 30)(df).orderBy("i").collect()
    assert [r.bodies for r in got] == [pack(t or "", 120, 30) for t in texts]


@pytest.mark.parametrize("limit", [0, 100])
def test_unique(spark, monkeypatch, limit):
    monkeypatch.setattr(session, "BROADCAST_KEYS", limit)
    df = spark.createDataFrame([(k, "x") for k in ["a", "b", "b", None, None, "c", "c", "c"]], "k string, v string")
    assert sorted(str(r.k) for r in session.unique(df, "k").collect()) == ["None", "a", "b", "c"]
    assert session.unique(df.limit(0), "k").collect() == [] and session.unique(df.where("k = 'a'"), "k").count() == 1
    assert session.write_out(df).count() == 8 and session.write_out(df.limit(0)).columns == ["k", "v"]


@pytest.mark.parametrize(("most", "terms"), [(10**6, 10**6), (7, 10**6), (10**6, 0)])
def test_best_by_row_are_the_best_of_all(spark, monkeypatch, most, terms):
    """Scores summed in rows and cut per task give what all scores ranked give, with ties, filters and groups."""
    monkeypatch.setattr(retrieve, "SCORES_AT_ONCE", most)
    monkeypatch.setattr(retrieve, "BROADCAST_TERMS", terms)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)] + ["ja-20", "x1y"]
    rows = [(f"c{i:03}", " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))), rng.choice(["Bid1", "bid1", "Bid2", None]), rng.choice(["rfp", "addendum", None])) for i in range(160)]
    rows += [*rows[:10], ("zz", None, "Bid1", "rfp")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, bid_id string, doc_type string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=3))) for i in range(9)] + [(10, ""), (11, None), (12, "unknown")], "query_id long, query string")
    index = retrieve.build_index(chunks)
    scores = retrieve.bm25_scores(index, queries)
    meta = chunks.select("chunk_id", "bid_id", "doc_type").distinct()
    got = lambda df, *c: sorted(map(repr, df.select("query_id", "chunk_id", "score", "rank", *c).collect()))
    assert got(retrieve.bm25_top(index, queries, 4)) == got(retrieve.top_k(scores, 4))
    kept = retrieve.metadata_filter(meta, bid_id="BID1", exclude_doc_type="addendum")
    assert got(retrieve.bm25_top(index, queries, 4, bid_id="BID1", exclude_doc_type="addendum")) == got(retrieve.top_k(scores.join(kept, "chunk_id"), 4))
    assert got(retrieve.bm25_top(index, queries, 2, "bid_id"), "bid_id") == got(retrieve.top_k(scores.join(meta, "chunk_id"), 2, by=["query_id", "bid_id"]), "bid_id")
    assert retrieve.bm25_top(index, queries.limit(0), 4).collect() == [] and retrieve.bm25_top(retrieve.build_index(chunks.limit(0)), queries, 4).collect() == []


PAGE = "page_id int, bid_id string, file_name string, doc_type string, addendum_number int, page_number int, cleaned_text string"


def test_tables_become_chunks(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    long = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 30} |" for i in range(200))
    pages = [(1, "b", "f", "specs", None, 1, "a\nb\nc\nd\nSome prose." + f"\n\n{chunking.TABLE_MARKER}\n\n{table}\n\n{long}"), (2, "b", "f", "specs", None, 2, None), (3, "b", "g", "rfp", None, 1, f"{chunking.TABLE_MARKER}\n\n{table}")]
    rows = chunking.chunk_pages(spark.createDataFrame(pages, PAGE)).orderBy("page_id", "seq").collect()
    first = [r for r in rows if r.page_id == 1]
    assert first[0].text.endswith("\n" + table) and first[0].section == "Specifications" and first[0].is_table
    assert not first[-1].is_table and first[-1].text.endswith("\nSome prose.") and len(first) > 4 and first[-1].section == "General"
    assert sum(r.text.count("x" * 30) for r in first) == 200
    assert [r.section for r in rows if r.page_id == 3] == ["Specification / Bid Tables:"] and not any(r.page_id == 2 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_section_of_each_chunk(spark):
    """The heading in force where a chunk begins, also within a page and on the pages after it."""
    prose = lambda n: " ".join(["word"] * n)
    pages = [(1, "b", "f", "rfp", None, 1, "\n\n".join(["SCOPE OF WORK", prose(200), prose(200), "PAYMENT TERMS\n" + prose(180), prose(200), prose(200)])), (2, "b", "f", "rfp", None, 2, prose(50)), (3, "b", "h", "rfp", None, 1, prose(5))]
    rows = chunking.chunk_pages(spark.createDataFrame(pages, PAGE)).orderBy("page_id", "seq").collect()
    assert [r.section for r in rows if r.page_id == 1] == ["Scope Of Work", "Payment Terms", "Payment Terms", "Payment Terms"]
    assert [r.section for r in rows if r.page_id > 1] == ["Payment Terms", "General"]


def test_chunks_of_documents(spark):
    prose = " ".join(f"word{i}" for i in range(100))
    blank = "[Unfilled/BLANK] field " * 5
    pages = [(1, "b", "f", "rfp", None, 1, f"{prose}\n\n{chunking.TABLE_MARKER}\n\n{prose}"), (2, "b", "f", "rfp", None, 2, blank), (3, "b", "f", "rfp", None, 3, "tiny"), (4, None, None, None, None, None, "tiny"), (5, None, None, None, None, None, "tiny")]
    rows = chunking.chunk_document(spark.createDataFrame(pages, PAGE)).collect()
    # The prose is a near-copy of the table text before it on the page.
    assert [r.is_table for r in rows if r.page_number == 1] == [True] and not any(r.page_number == 2 for r in rows)
    assert [r.n_parts for r in rows if r.page_number == 3] == [1] and sum(r.n_parts for r in rows if r.page_number is None) == 2
    assert chunking.chunk_document(spark.createDataFrame([], PAGE)).collect() == []


def test_headings(spark):
    lines = ["SCOPE OF WORK", "Section 3 - Terms", "## Part two", "END OF ADDENDUM", "Smith, John", "AB-123", "| a |", "OVERVIEW", "CALL 555 123 4567", "a plain line", "BUYER NAME", ""]
    assert apply(spark, lambda c: chunking.heading(F.col(c)), lines) == ["Scope Of Work", "Section 3 - Terms", "Part two", None, None, None, None, "Overview", None, None, None, None]


def test_sections_carry(spark):
    pages = [(1, "b", "f", 1, "SCOPE OF WORK\nx"), (2, "b", "f", 2, "text only\nGENERAL TERMS LIST\ny"), (3, "b", "f", 3, "z"), (4, "b", "g", 1, None)]
    df = chunking.sections(spark.createDataFrame(pages, "page_id int, bid_id string, file_name string, page_number int, cleaned_text string"))
    assert [r.section for r in df.orderBy("page_id").collect()] == ["Scope Of Work", "Scope Of Work", "General Terms List", "General"]


def test_merge_small(spark):
    long = "h\n" + " ".join(["w"] * 50)
    rows = [("b", "f", 1, 0, "c0", "h\nshort first", False), ("b", "f", 1, 1, "c1", "h\ntiny", False), ("b", "f", 1, 2, "c2", long, False), ("b", "f", 1, 3, "c3", "h\ntable", True), ("b", "f", 1, 4, "c4", "h\ntail", None), ("b", "f", 2, 0, "c5", "h\nalone", False)]
    df = spark.createDataFrame(rows, "bid_id string, file_name string, page_number int, seq int, chunk_id string, text string, is_table boolean")
    got = chunking.merge_small(df).orderBy("page_number", "island").collect()
    assert [r.text for r in got] == ["h\nshort first\n\ntiny", long, "h\ntable\n\ntail", "h\nalone"] and "_merged_" in got[0].chunk_id and got[1].chunk_id == "c2"


def test_near_copies_and_tables(spark):
    base = " ".join(f"word{i}" for i in range(40))
    rows = [("b", "f", 1, 0, "c0", base), ("b", "f", 1, 1, "c1", base + " extra"), ("b", "f", 1, 2, "c2", "other words entirely here"), ("b", "f", 2, 0, "c3", base)]
    df = spark.createDataFrame(rows, "bid_id string, file_name string, page_number int, seq int, chunk_id string, text string")
    assert {r.chunk_id: r.kept for r in chunking.near_copies(df).collect()} == {"c0": True, "c1": False, "c2": True, "c3": True}
    md = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 30} |" for i in range(200))
    parts = apply(spark, lambda c: chunking.split_table(F.col(c)), [md, "| a |\n| b |", None])
    assert len(parts[0]) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts[0]) and parts[1:] == [["| a |\n| b |"], []]
    assert sum(p.count("\n") - 1 for p in parts[0]) == 200


def test_tables(spark):
    def cells(name, rows):
        return [(name, 1, 1, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]

    rows = cells("real", [["Item", ""], ["A|B", "1\n2"], ["C", "3"]]) + cells("box", [["Name", None], ["x", None]]) + cells("wide", [list("abcdefgh"), list("abcdefgh")]) + cells("prose", [["k", "v" * 300], ["a", "b"]]) + cells("one", [["a", "b"]])
    got = {r.doc: (r.is_table, r.text) for r in tables.classify_tables(spark.createDataFrame(rows, "doc string, page int, tbl int, row int, col int, text string")).collect()}
    assert got["real"] == (True, "| Item | Field 2 |\n| --- | --- |\n| A\\|B | 1 2 |\n| C | 3 |")
    assert got["box"] == (False, "Name\n\nx") and got["wide"] == (False, "") and got["prose"][1].startswith("k: v") and "one" not in got


def test_coordinate_table(spark):
    words = []
    for i in range(5):
        words += [("d", 1, 200.0, 100.0 + 20 * i, 250.0, 110.0 + 20 * i, f"ABC-{i}00"), ("d", 1, 10.0, 100.0 + 20 * i, 50.0, 110.0 + 20 * i, f"item{i}"), ("d", 1, 60.0, 101.0 + 20 * i, 90.0, 111.0 + 20 * i, "text")]
    words += [("d", 1, 10.0, 5.0, 50.0, 15.0, "title"), ("e", 1, 0.0, 0.0, 9.0, 9.0, "ABC-100")]
    got = tables.coordinate_table(spark.createDataFrame(words, "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string")).orderBy("ord").collect()
    assert [(r.sku, r.description) for r in got] == [(f"ABC-{i}00", f"item{i} text") for i in range(5)]


def test_status(spark):
    rows = [(10, 30, 0, 0, "vector_outlines"), (10, 30, 0, 2, "vector_outlines_form"), (0, 0, 0, 0, "blank"), (5, 0, 1, 0, "scanned"), (99, 0, 0, 1, "form_widgets"), (99, 0, 0, 0, "extractable")]
    df = spark.createDataFrame(rows, "char_count int, drawings int, images int, widgets int, want string")
    assert all(r.status == r.want for r in tables.page_status(df).collect())


CHUNKS = [("c1", "The bid number is JA-207652", "Bid1", "a.pdf", "rfp", None, False), ("c2", "Payment terms net 30", "Bid1", "b.pdf", "addendum", 2, False), ("c3", "| SKU | 210-BLYZ |", "Bid2", "c.pdf", "specs", None, True), ("c4", None, "Bid2", None, None, None, None)]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(CHUNKS, "chunk_id string, text string, bid_id string, file_name string, doc_type string, addendum_number int, is_table boolean")
    return df.withColumns({"page_number": F.lit(1), "page_start": F.lit(1), "page_end": F.lit(1), "section": F.lit("General")})


def test_bm25_matches_formula(spark, chunks):
    import math

    docs = {c[0]: terms(c[1] or "") for c in CHUNKS}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    queries = {1: "JA-207652 number number", 2: "terms 210-blyz", 3: "", 4: None}
    got = {(r.query_id, r.chunk_id): r.score for r in retrieve.bm25_scores(retrieve.build_index(chunks), spark.createDataFrame(list(queries.items()), "query_id int, query string")).collect()}
    want = {}
    for q, t in queries.items():
        for c, d in docs.items():
            s = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in terms(t or "") if w in d)
            if s > 0:
                want[q, c] = round(s, 6)
    assert got == pytest.approx(want, abs=2e-6)


def test_filters(chunks):
    ids = lambda **f: {r.chunk_id for r in retrieve.metadata_filter(chunks, **f).collect()}
    assert ids(bid_id="bid1") == {"c1", "c2"} and ids(doc_type="RFP") == set() and ids(exclude_doc_type="Addendum") == {"c1", "c3", "c4"}
    assert ids(addendum_number=2) == {"c2"} and ids(is_table=True) == {"c3"} and ids(bid_id="") == {"c1", "c2", "c3", "c4"}


def test_fusion_and_search(spark, chunks):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: (r.rank, r.rrf_score) for r in retrieve.fuse(a, b).collect()}
    assert got["y"] == (1, pytest.approx(1 / 61 + 1 / 62, abs=1e-9)) and got["x"][0] == 2 and got["z"][0] == 3
    q = spark.createDataFrame([(1, "bid number")], "query_id int, query string")
    for mode in retrieve.MODES:
        rows = retrieve.search(chunks, q, 2, mode).collect()
        assert rows[0].chunk_id == "c1" and rows[0].citation == "a.pdf (p.1 | Section: General)"
    with pytest.raises(ValueError):
        retrieve.search(chunks, q, 2, "other")


def test_expansion(spark):
    q = spark.createDataFrame([(1, "What is the due date?"), (2, "nothing here"), (3, None)], "query_id int, query string")
    got = {r.query_id: r.expanded for r in retrieve.expand(q, retrieve.expansion_terms(spark)).collect()}
    assert got == {1: "What is the due date? proposal due date submission deadline closing date", 2: "nothing here", 3: ""}


def test_dense_matches_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieve.dense_scores(df, q, 5, block=3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    f = m.astype(np.float32).astype(float)
    for i in range(7):
        s = np.round(f @ f[i], 6)
        s[i] = -np.inf
        assert [got[i][k] for k in range(1, 6)] == list(np.argsort(-s, kind="stable")[:5])
    assert retrieve.dense_scores(df, q.limit(0), 5).collect() == []


def test_dense_by_chunk_id(spark):
    v = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "x", [0.6, 0.8]), ("c", "y", [0.0, 1.0]), ("d", "y", None)], "chunk_id string, bid_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.chunk_id, r["rank"]) for r in retrieve.dense_scores(v, q, 2, key="chunk_id").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert {(r.bid_id, r.chunk_id) for r in retrieve.dense_scores(v, q, 1, key="chunk_id", within="bid_id").collect()} == {("x", "a"), ("y", "c")}
    assert retrieve.dense_scores(v, q.limit(0), 2, key="chunk_id").collect() == []


def test_hybrid_search_has_chunks_of_the_dense_list(spark, tmp_path):
    text = lambda i: "alpha-beta units" if i == 1 else f"other words {i}"
    rows = [(f"c{i}", text(i), "B", "f.pdf", "rfp" if i < 5 else "addendum", 1, 1, 1, "s") for i in range(1, 7)]
    schema = "chunk_id string, text string, bid_id string, file_name string, doc_type string, page_number int, page_start int, page_end int, section string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(50, "B", "alpha.pdf"), (100, "B", "?.pdf")], "file_id long, bid_id string, file_name string").write.parquet(str(tmp_path / "source_files.parquet"))
    got = retrieve.q_search(spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {50} and {r.chunk_id for r in got} == {"c1", "c2", "c3", "c4"} and got[0].chunk_id == "c1"


def test_metrics(spark):
    r = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 3, True)], "query_id int, rank int, ok boolean")
    m = retrieve.metrics(r, F.col("ok"), spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).first()
    assert (m.recall_1, m.recall_3, m.mrr) == (0.3333, 0.6667, 0.4444)


def test_manifest(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("a", "a", "1", 0.0, ["x"]), ("b", "b", "9", 0.0, ["y"]), ("d", "d", "4", 0.0, ["z"])], indexing.MANIFEST)
    changes = indexing.diff(files, old)
    assert {r.path: r.status for r in changes.collect()} == {"a": "unchanged", "b": "modified", "c": "new", "d": "deleted"}
    kept = indexing.evict(spark.createDataFrame([("x",), ("y",), ("z",)], "chunk_id string"), changes)
    assert [r.chunk_id for r in kept.collect()] == ["x"]
    fresh = spark.createDataFrame([("b", "b", "2", 1.0, ["n"])], indexing.MANIFEST)
    assert {r.path for r in indexing.record(old, fresh, changes).collect()} == {"a", "b"}
    assert indexing.load(spark, str(tmp_path / "none"), "manifest", indexing.MANIFEST).collect() == []


def test_save_and_load(spark, chunks, tmp_path):
    indexing.save(str(tmp_path), chunks, spark.createDataFrame([], indexing.MANIFEST))
    assert indexing.load(spark, str(tmp_path), "chunks", "chunk_id string").count() == 4
    assert indexing.load(spark, str(tmp_path), "corpus").first().n == 4
    # A crash before the commit leaves the version before it.
    (tmp_path / "data" / "2").mkdir(parents=True)
    (tmp_path / "versions" / "_2.tmp").write_text("{")
    assert indexing.versions(spark, str(tmp_path)) == [1] and indexing.stored_index(spark, str(tmp_path)).corpus.first().n == 4
    assert indexing.save(str(tmp_path), chunks.limit(1), spark.createDataFrame([], indexing.MANIFEST)) == 2
    assert indexing.load(spark, str(tmp_path), "chunks").count() == 1
    with pytest.raises(FileNotFoundError):
        indexing.load(spark, str(tmp_path / "none"), "chunks")


SRC = "array<struct<file:string,page:int,quote:string,chunk_id:string>>"


def test_grounding_and_confidence(spark):
    c = spark.createDataFrame([("c1", "B", "f", 1, "The **due date** is\nMay 1, 2025 at noon sharp"), ("c2", "B", "g", 2, "something else about May"), ("c3", "X", "f", 1, "due date is May 1, 2025")], "chunk_id string, bid_id string, file_name string, page_number int, text string")
    rows = [
        (1, "B", "Due Date", "May 1, 2025", "FOUND", [("f", 1, "due date is May 1, 2025", "c1")]),
        (2, "B", "Due Date", "May 1, 2025", "FOUND", [("g", 2, "due date is May 1, 2025", "c2")]),
        (3, "B", "Due Date", "May 9, 2025", "FOUND", [("f", 1, "made up quote", "c1")]),
        (4, "B", "Title", "x", "FOUND", []),
        (5, "B", "Title", None, "NOT_FOUND", None),
        (6, "B", "Title", None, "ERROR", []),
        (7, "B", "contact_info", "May", "FOUND", [("g", 2, "else about May", "c2")]),
    ]
    got = {r.output_id: r for r in validation.validate(spark.createDataFrame(rows, f"output_id int, bid_id string, field_name string, value string, status string, sources {SRC}"), c).collect()}
    assert [(got[i].bucket, got[i].issue) for i in range(1, 8)] == [("passed", None), ("passed", None), ("failed", "not_grounded"), ("failed", "no_source"), ("not_found", None), ("errors", "api_error"), ("failed", "format")]
    assert got[2].matched_chunk == "c1" and got[2].tier == 4 and got[1].tier == 1
    assert got[1].computed_confidence > got[2].computed_confidence >= 0.45 and got[3].computed_confidence <= 0.39


def test_supersede_and_audit(spark):
    rows = [(1, "B", 2, 1, "Due ", "a", "c", "f"), (2, "B", 1, 1, "due", "a", "b", "f"), (3, "B", None, 1, "due", None, "d", "f3"), (4, "B", 1, 1, None, "a", "b", "f")]
    ch = spark.createDataFrame(rows, "change_id int, bid_id string, addendum_number int, ord int, field string, old_value string, new_value string, file_name string")
    got = validation.supersede(ch, spark.createDataFrame([("B", "f3", 3)], "bid_id string, file_name string, addendum_number int")).orderBy("addendum_number").collect()
    assert [(r.old_value, r.new_value, r.is_final) for r in got] == [("a", "b", False), ("b", "c", False), ("c", "d", True)]
    out = spark.createDataFrame([("B", "t", "Big School District, TX"), ("B", "u", "n/a"), ("B", "v", "x")], "bid_id string, field_name string, value string")
    gold = spark.createDataFrame([("B", "t", ["big school district"]), ("B", "u", None), ("B", "v", ["y"]), ("B", "w", ["z"])], "bid_id string, field_name string, accepted array<string>")
    r = validation.gold_audit(out, gold).where("bid_id is null").first()
    assert (r.n, r.n_match, r.n_expected_null_ok, r.n_mismatch, r.n_missing, r.accuracy) == (4, 1, 1, 1, 1, 50.0)


def test_routing(spark, chunks):
    packages = spark.createDataFrame([("Bid1", "JA-207652", "Shared Laptop Purchase", "Oak School District", 1), ("PKG-9", "RFP-7-22", "Road Salt Supply", "Lake County", 1)], "bid_id string, solicitation_number string, title string, agency string, portal_id int")
    q = spark.createDataFrame([(1, "When is JA-207652 due?"), (2, "compare all bids"), (3, "who sells road salt at Lake County?"), (4, "zzz"), (5, None), (6, "about PKG-9")], "question_id int, question string")
    got = {r.question_id: r.target for r in routing.route(q, routing.score_packages(q, routing.catalogue(chunks, packages))).collect()}
    assert got == {1: "Bid1", 2: "COMPARISON", 3: "PKG-9", 4: None, 5: None, 6: "PKG-9"}


def test_route_questions_falls_back_to_the_score_sum(spark, tmp_path):
    spark.createDataFrame([("c1", "Bid1", "a.pdf", "rfp", "zirconium plates"), *((f"c{i}", "Bid2", "b.pdf", "rfp", f"steel {i}") for i in range(2, 8))], "chunk_id string, bid_id string, file_name string, doc_type string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(50, "zirconium.pdf"), (100, "unheard.pdf"), (150, "compare zirconium.pdf")], "file_id long, file_name string").write.parquet(str(tmp_path / "source_files.parquet"))
    spark.createDataFrame([("Bid1", None, None, None)], "bid_id string, solicitation_number string, title string, agency string").write.parquet(str(tmp_path / "packages.parquet"))
    assert {r.question_id: r.target for r in routing.q_route(spark, str(tmp_path)).collect()} == {50: "Bid1", 100: None, 150: "COMPARISON"}


def test_route_questions_reads_numbers_in_texts(spark, tmp_path):
    rows = [("c1", "Bid1", "a.pdf", "rfp", "This is RFP-77-2041 of the county"), ("c2", "Bid2", "b.pdf", "rfp", "RFP 77 2041 steel"), ("c3", "Bid2", "b.pdf", "rfp", "more steel")]
    spark.createDataFrame(rows, "chunk_id string, bid_id string, file_name string, doc_type string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(50, "rfp-77-2041 steel.pdf")], "file_id long, file_name string").write.parquet(str(tmp_path / "source_files.parquet"))
    spark.createDataFrame([("Bid1", None, None, None), ("Bid2", "RFP-77-2O41", "Steel plates", None)], "bid_id string, solicitation_number string, title string, agency string").write.parquet(str(tmp_path / "packages.parquet"))
    assert [r.target for r in routing.q_route(spark, str(tmp_path)).collect()] == ["Bid1"]


def test_comparison(spark):
    v = spark.createDataFrame([("a", "title", "x"), ("b", "title", "x"), ("a", "due date", "1")], "bid_id string, field_name string, value string")
    p = spark.createDataFrame([("a",), ("b",)], "bid_id string")
    m = [r.asDict() for r in routing.comparison_matrix(v, p, ["title", "due date"]).orderBy("bid_id").collect()]
    assert m[1] == {"bid_id": "b", "title": "x", "due_date": "Not found"}
    assert routing.comparison_report(m).splitlines()[2:] == ["| Field | a | b |", "|---|---|---|", "| title | x | x |", "| due date | 1 | Not found |"]
    same = {r.field_name: r.identical for r in routing.field_differences(v, p, field_definitions(spark)).collect()}
    assert same["title"] and not same["due date"]


def test_tracer(spark):
    t = trace.Tracer()
    with t.step("a", x=1) as s:
        s.tool("search", "3 hits", q="y")
        s.output(prompt_tokens=5, completion_tokens=2, n=3)
    with pytest.raises(RuntimeError), t.step("b"):
        raise RuntimeError("no")
    rows = {r.agent: r for r in trace.rollup(t.frame(spark)).collect()}
    assert rows["a"].tokens == 7 and rows[None].n_steps == 2 and t.steps[1]["output"]["error"] == "RuntimeError: no"
