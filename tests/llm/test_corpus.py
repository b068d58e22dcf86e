"""Corpus operators against brute force, round trips and stated cases."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from bidweave.llm import boilerplate, mixing, neardup, personal, scans, split, tokens

WORDS = "the vendor shall deliver every unit to site under seal of county clerk before noon with copies sent office agency must keep log visit".split()


def words(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


# Tokens


def test_ids_match_library_and_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "  \n\t ", "Hello world, it's 12.5% <|endoftext|>", "naïve ẞ 你好 🙂👩‍👩‍👧", "a" * 5000, "x" * 3 + "​" + "é" * 700, "we'll WE'LL don't"]
    rng = random.Random(1)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x500), 10])) for _ in range(200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in tokens.with_text(tokens.with_ids(df), name="back").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].ids == lib.encode_ordinary(t or "")
        assert got[i].back == (t or "")


def test_ids_of_empty_table(spark):
    assert tokens.with_ids(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Splitting


def check_pieces(text, limit, overlap):
    spans, _ = split.levels(text)
    got = split.pieces(text, limit, overlap)
    if len(spans) <= limit:
        assert got == []
        return
    at = {s: i for i, (s, _) in enumerate(spans)}
    ends = {e: i + 1 for i, (_, e) in enumerate(spans)}
    covered = 0
    for k, (a, b, n) in enumerate(got):
        assert ends[b] - at[a] == n <= limit
        assert at[a] == (0 if k == 0 else covered - overlap)
        assert ends[b] > covered
        covered = ends[b]
    assert covered == len(spans)


def test_pieces_cover_and_overlap():
    rng = random.Random(2)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(" ".join(words(rng, rng.randrange(1, 90))).replace(" the", rng.choice([". The", " the", "\nthe"])))
        text = rng.choice(["\n\n", "\n\nSection 4: Terms\n\n", " "]).join(parts)
        check_pieces(text, 100, 15)
    check_pieces("." * 700, 100, 15)
    check_pieces("x" * 5000, 100, 15)
    check_pieces("", 100, 15)


def test_pieces_cut_at_paragraphs():
    text = "\n\n".join(" ".join(["w"] * 60) for _ in range(4))
    assert [text[b : b + 2] for _, b, _ in split.pieces(text, 100, 10)][:-1] == ["\n\n"] * 3


def test_split_frame(spark):
    long = "word " * 600
    df = spark.createDataFrame([("a", long, 1), ("b", "short", 1), ("c", None, 1), ("d", "", 1), ("e", "   ", 1)], "item string, text string, piece_no int")
    rows = split.split(df).orderBy("piece_no").collect()
    assert {r.item for r in rows} == {"a"} and [r.piece_no for r in rows] == [1, 2]
    assert all(long[r.start_pos : r.end_pos] == r.piece for r in rows)
    assert split.split(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        split.split(df, overlap=500)


# Boilerplate


def test_boilerplate(spark):
    rows, k = [], 0
    for doc in range(20):
        lines = ["Share this Notice", f"own line {'abc'[doc % 3]}{chr(97 + doc)}", "", "12 / 5", f"Page {doc} of 20"]
        if doc < 4:
            lines.append("four of twenty")
        rows.append((k, "b", f"f{doc}", "\n".join(lines), 1, "x"))
        k += 1
    rows += [(0, "b", "f0", rows[0][3], 1, "x"), (90, "b", None, None, 1, "x"), (91, "z", "f", "Share this notice", None, "x"), (92, "b", "f1", "  SHARE   this notice ", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, bid_id string, file_name string, cleaned_text string, portal_id int, frequent string")
    out = {r.page_id: r for r in boilerplate.strip_lines(df).collect()}
    assert out[5].cleaned_text == f"own line {'abc'[5 % 3]}f\n\n12 / 5" and out[5].n_dropped == 2
    assert "four of twenty" in out[0].cleaned_text
    assert out[90].cleaned_text is None and out[91].n_dropped == 0 and out[92].cleaned_text == ""
    assert boilerplate.strip_lines(df.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lines_of_one_large_source(spark, monkeypatch, limit):
    """A source of very many lines on some documents each, of which few reach the share; many small sources beside it."""
    monkeypatch.setattr(boilerplate, "BROADCAST_SOURCES", limit)
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", limit)
    part = lambda n: F.concat(F.lit("line "), F.translate((F.col("id") % n).cast("string"), "0123456789", "abcdefghij"))
    text = F.concat_ws("\n", F.lit("Terms of use"), part(700), part(701), part(703), F.when(F.col("id") % 4 == 0, F.lit("one in four")))
    big = spark.range(7000).select(F.col("id").alias("page_id"), F.lit("b").alias("bid_id"), F.col("id").cast("string").alias("file_name"), text.alias("cleaned_text"), F.lit(1).alias("portal_id"))
    small = spark.range(600).select((F.col("id") + 10_000).alias("page_id"), F.lit("c").alias("bid_id"), F.col("id").cast("string").alias("file_name"), F.lit("Terms of use").alias("cleaned_text"), (F.col("id") % 100 + 2).cast("int").alias("portal_id"))
    got = boilerplate.strip_lines(big.unionByName(small)).groupBy("bid_id", "n_dropped").count().collect()
    assert {(r.bid_id, r.n_dropped): r["count"] for r in got} == {("b", 1): 5250, ("b", 2): 1750, ("c", 1): 600}


# Mixing


def test_mix_reaches_shares(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(words(rng, rng.randrange(1, 60))), rng.choice(["a", "a", "a", "B ", "c", None])) for i in range(900)]
    docs += [(1000, "", "a"), (1001, None, "a")]
    targets = spark.createDataFrame([("A", 0.4, 2), ("b", 0.3, 3), ("c", 0.2, 4), ("missing", 0.1, 4)], "source string, target_share double, max_repeats int")
    records = mixing.counted(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets)
    got = {r.source: r for r in mixing.shares(records, targets).collect()}
    assert got["missing"].tokens == 0 and sum(r.reached_share for r in got.values()) == pytest.approx(1, abs=1e-5)
    for s, share in (("a", 0.4 / 0.9), ("b", 0.3 / 0.9), ("c", 0.2 / 0.9)):
        assert got[s].reached_share == pytest.approx(share, abs=0.01) and got[s].most_uses <= got[s].max_repeats
    rows = mixing.mix(records, targets).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and not {1000, 1001} & {r.doc_id for r in rows}
    # Head sources come earlier in training than tail sources.
    early = [r for r in rows if r.position < 0.5]
    part = lambda rs, s: sum(r.n_tokens for r in rs if r.source == s) / sum(r.n_tokens for r in rs)
    assert part(early, "a") > part(rows, "a") and part(early, "c") < part(rows, "c")
    short = {r.source: r for r in mixing.shares(records, targets, 10**7).collect()}
    assert all(short[s].most_uses == short[s].max_repeats for s in "abc")


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    records = mixing.counted(spark.createDataFrame([], "doc_id long, text string, source string"), targets)
    assert mixing.mix(records, targets).collect() == []
    assert mixing.shares(records, targets).collect()[0].reached_share == 0


# Near-duplicates


def shingles(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def test_pairs_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = {}
    for i in range(120):
        base = words(rng, rng.randrange(20, 200))
        texts[f"k{i}"] = " ".join(base)
        for j in range(rng.randrange(3)):
            w = list(base)
            for _ in range(rng.randrange(1, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = "Edit" + str(rng.randrange(99))
            texts[f"k{i}v{j}"] = " ".join(w)
    texts |= {"copy1": texts["k0"], "copy2": texts["k0"].upper(), "few": "two words", "few2": "two words", "empty": "", "none": None}
    rows = [(k, t, 1) for k, t in texts.items()] + [("k1", texts["k1"], 1)]
    df = spark.createDataFrame(rows, "chunk string, content string, id int")
    got = neardup.similar_pairs(df, "chunk", "content").collect()
    want = set()
    names = sorted(k for k, t in texts.items() if t is not None)
    sets = {k: shingles(texts[k]) for k in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and len(s & t) / len(s | t) >= 0.5:
                want.add((a, b))
    pairs = {(r.id_a, r.id_b) for r in got}
    assert len(pairs) == len(got)
    assert pairs <= want
    assert len(pairs & want) >= 0.97 * len(want)
    assert neardup.similar_pairs(df.limit(0), "chunk", "content").collect() == []


@pytest.mark.parametrize(("whole", "pairs"), [(300, 300 * 299 // 2), (299, 299)])
def test_classes_of_copies_are_counted_exactly(spark, monkeypatch, whole, pairs):
    monkeypatch.setattr(neardup, "WHOLE", whole)
    df = spark.createDataFrame([(f"k{i}", "one and the same text of some words") for i in range(300)], "chunk string, content string")
    assert neardup.similar_pairs(df, "chunk", "content").count() == pairs


def test_hot_buckets_stream_through():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = neardup.HOT + 500
    b = rng.integers(0, 2**62, (n, neardup.B_WORDS))
    b[7] = b[9]
    cols = [np.full(n, 3), np.arange(n), *b.T]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "id", *neardup.B_COLS])
    out = [r for x in neardup._bucket_pairs(neardup.B_PAIRS, neardup.HOT)([batch]) for r in x.to_pylist()]
    assert len(out) == n and {r["kind"] for r in out} == {neardup.ROW}
    for tables in (0, neardup.B_PAIRS):
        pairs = [(r["x"], r["y"]) for x in neardup._bucket_pairs(tables, 2 * n)([batch]) for r in x.to_pylist() if r["kind"] == neardup.PAIR]
        assert (7, 9) in pairs


@pytest.mark.parametrize("levels", [0, 2])
def test_hot_buckets_lose_no_pair(spark, monkeypatch, levels):
    """Texts that share one passage make hot buckets; division, and below it blocks, find the pairs all the same."""
    rng = random.Random(8)
    shared = words(rng, 60)
    texts = {}
    for i in range(60):
        own = words(rng, 60)
        texts[f"k{i}"] = " ".join(shared + own)
        if i % 3 == 0:
            texts[f"k{i}v"] = " ".join([*shared, *own[:50], "edited", "by", "hand"])
    texts["again"] = texts["k1"] + " once more"
    df = spark.createDataFrame([*texts.items(), *[("again", texts["again"])] * 40], "chunk string, content string")
    sets = {k: shingles(t) for k, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    monkeypatch.setattr(neardup, "HOT", 48)
    monkeypatch.setattr(neardup, "LEVELS", neardup.LEVELS[:levels])
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs(df, "chunk", "content").collect()}
    assert got <= want and len(want) > 20 and len(got) >= 0.95 * len(want)


def test_texts_without_shingles(spark):
    """Whole slices of texts that have no run of three words."""
    df = spark.createDataFrame([(f"k{i}", ["", "two words", "...", None][i % 4]) for i in range(2000)], "chunk string, content string").repartition(1)
    assert neardup.similar_pairs(df, "chunk", "content").collect() == []


# Scans


@pytest.fixture(scope="module")
def reader():
    return scans.Reader("the vendor shall deliver each additional manufacturer sheet without through walk-through walk a site county clerk copies discount proceed".split())


def test_noise_kinds(reader):
    text = "Acme County - RFP-1\nThe vendor shall de-\nliver each additi-\nonal sheet thr0ugh the manu facturer\nafter a walk-\nthrough. The ven·dor shall discoiint it.\n\nThe clerk\n- 4 -"
    found, fixed = scans.noise(text, [1], 4, reader)
    assert set(found) == {(1, "header"), (2, "hyphen"), (3, "hyphen"), (4, "misread"), (6, "misread"), (9, "page_no")}
    assert fixed == "The vendor shall deliver each additional sheet through the manufacturer after a walk-through. The vendor shall discount it.\n\nThe clerk"


def test_noise_of_nothing(reader):
    assert scans.noise(None, None, 1, reader) == ([], None)
    assert scans.noise("", None, 1, reader) == ([], "")
    assert scans.noise(" \n ", None, None, reader) == ([], "")
    assert scans.noise("Item 12-\n34 of 5-B", None, 1, reader)[0] == []


def test_repair_frame(spark):
    rows = []
    for p in range(4):
        head = "Lake County - RFP-7 file 3" if p < 3 else "Lake Covnty - RFP-7 file 3"
        rows.append((p, "b", "f", p + 1, f"{head}\nThe vendor shall deliver the sheet.\n{p + 1} / 4", None, True))
    rows += [(9, "b", "g", 1, "the vendor shall deliver the sheet", None, False), (10, "b", "g", 2, "the vendor shall deliver the sheet", None, False), (11, "b", "g", 3, "the vendor shall deliver the sheet", None, False)]
    rows += [rows[0], (12, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, bid_id string, file_name string, page_number int, raw_text string, cleaned_text string, is_scanned boolean")
    got = {(r.page_id, r.text_field): r for r in scans.repair(df).collect()}
    assert len(got) == 10 and got[12, "raw_text"].repaired is None
    for p in range(4):
        assert [tuple(n) for n in got[p, "raw_text"].noise] == [(1, "header"), (3, "page_no")]
        assert got[p, "raw_text"].repaired == "The vendor shall deliver the sheet."
    assert scans.repair(df.limit(0)).collect() == []


def test_vocabulary_keeps_words_of_three_pages(spark):
    text = F.when(F.col("id") < 3, "Quillberg common").when(F.col("id") < 5, "twice common").otherwise("common")
    pages = spark.range(90_000).select(F.col("id").alias("page_id"), text.alias("raw_text"), F.lit(None).cast("string").alias("cleaned_text"), F.lit(False).alias("is_scanned"))
    assert {r.word: r.pages for r in scans.vocabulary(pages).collect()} == {"common": 90_000, "quillberg": 3}


@pytest.mark.parametrize("limit", [0, 1, 4])
def test_rare_words_are_looked_up(spark, monkeypatch, limit):
    clean = "the the vendor shall deliver walk-through sheets from Quillberg with additional manufacturer discount notes well-known to all"
    scanned = "tbe vend0r shall de-\nliver walk-\nthrough sheets frorn Qui1lberg with additi-\nonal manu facturer disc-\nonnt notcs and vveII-kn0wn t0 a11 Zzyzx ve-\nnd0r well-\nkncwn"
    rows = [(p, "b", "g", p, clean, None, False) for p in range(3)] + [(p, "b", "g", p, "the vendor", "shall deliver to all", False) for p in (3, 4)]
    rows += [(7, "b", "f", 1, scanned, None, True), (8, "b", "h", 1, scanned.upper(), clean, True), (9, "b", "h", 2, None, "", None), (None, "b", "k", 1, "Qui1lberg", None, True)]
    df = spark.createDataFrame(rows, "page_id long, bid_id string, file_name string, page_number int, raw_text string, cleaned_text string, is_scanned boolean")
    want = sorted(map(repr, scans.repair(df).collect()))
    assert any("Quillberg" in w and "vendor" in w for w in want)
    monkeypatch.setattr(scans, "BROADCAST_WORDS", limit)
    assert sorted(map(repr, scans.repair(df).collect())) == want


def test_running_lines_without_a_right_copy(spark):
    other = ["quick brown foxes jump", "seven lazy dogs sleep", "nine pens of ink", "old maps and charts", "two empty crates here"]
    head = {0: "Countv Notice of Request", 1: "County Notjce of Request", 2: "Leaflet", 3: "Leaflct"}
    # More forms of the document end like the first line, and stand before it.
    near = [f"a{'abcdefghijkl'[i] * 11} notice of request" for i in range(12)]
    rows = [(p, "b", "f", p + 1, f"{h}\n{other[p]}", None, True) for p, h in head.items()]
    rows += [(10 + p, "b", "f", 10 + p, x, None, True) for p, x in enumerate(near)]
    df = spark.createDataFrame(rows, "page_id long, bid_id string, file_name string, page_number int, raw_text string, cleaned_text string, is_scanned boolean")
    got = scans.edge_headers(scans.edge_lines(df)).collect()
    assert {r.page_id: r.header_lines for r in got} == {p: [1] for p in range(4)}


def test_forms_of_large_documents(spark, monkeypatch):
    """Forms that share parts are those that a comparison of all finds."""
    rng = random.Random(11)
    forms = set()
    while len(forms) < 260:
        base = "".join(rng.choice("abcdeflmnotu") for _ in range(rng.choice([4, 6, 8, 9, 15, 23, 24, 31, 39, 40, 60])))
        forms.add(base)
        for _ in range(3):
            x = list(base)
            for _ in range(rng.randrange(1, 6)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([["z"], [], [x[k], "q"]])
            forms.add("".join(x))
    rows = [(i, "b", "f", "raw_text", i, x, None) for i, x in enumerate(sorted(f for f in forms if len(f) >= 4))]
    edges = spark.createDataFrame(rows, "page_id long, bid_id string, file_name string, text_field string, line_no int, form string, ahead int")
    want = sorted(r.page_id for r in scans.edge_headers(edges).collect())
    monkeypatch.setattr(scans, "MANY_FORMS", 10)
    assert sorted(r.page_id for r in scans.edge_headers(edges).collect()) == want and 100 < len(want) < len(rows)


def test_page_number_sequences(spark):
    assert not scans._is_page_no("Page 12 of 20", 3) and scans._is_page_no("Page 3 of 20", 3) and scans._is_page_no("iii", 3)
    assert scans._is_page_no("Page 12 of 20", 3, [9]) and scans._is_page_no("Page 12", None)
    numbers = {1: "- 11 -", 2: "- 12 -", 3: "Page 13 of 20", 4: "Page 9", 5: "5"}
    rows = [(p, "b", "f", p, f"The vendor shall deliver.\n{x}", None, True) for p, x in numbers.items()]
    df = spark.createDataFrame(rows, "page_id long, bid_id string, file_name string, page_number int, raw_text string, cleaned_text string, is_scanned boolean")
    got = {r.page_id: [tuple(n) for n in r.noise] for r in scans.repair(df).where("text_field = 'raw_text'").collect()}
    assert {p for p, n in got.items() if (2, "page_no") in n} == {1, 2, 3, 5}


# Personal information


@pytest.fixture(scope="module")
def names():
    surnames = [h + t for h in ("Brindle", "Corve", "Dray", "Finch", "Quill") for t in ("berg", "combe", "low", "stad", "well")]
    surnames.remove("Finchlow")
    return personal.Names(["Amara", "Hugo", "Odette"], surnames)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mail amara.x@dept.example.org now", [("email", "amara.x@dept.example.org")]),
        ("Mail x [at] mail [dot] example [dot] com or y+z at a dot test.", [("email", "x [at] mail [dot] example [dot] com"), ("email", "y+z at a dot test")]),
        ("to x\n@site.example and y@site.\nexample end", [("email", "x\n@site.example"), ("email", "y@site.\nexample")]),
        ("Mail аmara@example.org", [("email", "аmara@example.org")]),
        ("Follow @bids for notices", []),
        ("call (214) 555-\n0101 or +1 214 555 0101 or 020 7946 0101", [("phone", "(214) 555-\n0101"), ("phone", "+1 214 555 0101"), ("phone", "020 7946 0101")]),
        ("call two one four five five five zero one zero one", [("phone", "two one four five five five zero one zero one")]),
        ("Purchase order 4500913714 replaces 4983-093, account code 30.364.1943", []),
        ("SSN 960-34-3690, EIN 00-5939383, State ID QW 49 62 10 B, Passport X90125548", [("idnum", "960-34-3690"), ("idnum", "00-5939383"), ("idnum", "QW 49 62 10 B"), ("idnum", "X90125548")]),
        ("The form shows XXX-XX-7355 and 123456789", []),
        ("at 31 N. Oak Street, Apt 4, Lakeside, OH 00011 or P.O. Box 17 or Calle Mayor 12", [("address", "31 N. Oak Street, Apt 4, Lakeside, OH 00011"), ("address", "P.O. Box 17"), ("address", "Calle Mayor 12")]),
        ("The Oak Street office", []),
        ("Dear Mr. Hugo Finchlow, Jr., see BRINDLEBERG, ODETTE and A. Drayberg", [("name", "Hugo Finchlow, Jr."), ("name", "BRINDLEBERG, ODETTE"), ("name", "A. Drayberg")]),
        ("Brindleberg & Corvelow Ltd and The Hugo Street Bridge", []),
        ("Contact Dr. Jane Smithson and Mr. Łukasz Żółkowski", [("name", "Jane Smithson"), ("name", "Łukasz Żółkowski")]),
        ("Maria Garcia met Wei Zhang at Maria Street School", [("name", "Maria Garcia"), ("name", "Wei Zhang")]),
        ("john dot doe at example dot com, jane @ example . com", [("email", "john dot doe at example dot com"), ("email", "jane @ example . com")]),
        ("two one four, five five five, zero one zero one", [("phone", "two one four, five five five, zero one zero one")]),
        ("2-1-4 five five five 0101 or 214-555-OIOI", [("phone", "2-1-4 five five five 0101"), ("phone", "214-555-OIOI")]),
        ("call double five five two one four double zero one two", [("phone", "double five five two one four double zero one two")]),
        ("Lakeside, OH 00055\n530-555-0101, items one and two of 3 4 5", [("phone", "530-555-0101")]),
    ],
)
def test_items(names, text, want):
    assert [(k, text[a:b]) for k, a, b in personal.items(text, names)] == want


def test_long_monotonous_texts(names):
    """No pattern takes more than proportional time on long texts of one kind."""
    import time

    for part in ("dot ", "Mr. ", "Mr. Ab B. ", "a at ", "a@", "one two ", "1 ", "Ab ", "x"):
        began = time.time()
        personal.items(part * (100_000 // len(part)), names)
        assert time.time() - began < 8, part


def test_classifier_of_names(names):
    """Names with no part in the lexicon are found by what stands beside them; other runs of capitalised words are not."""
    rng = random.Random(7)
    known = [f"{g} {h}{t}" for g in ("Amara", "Hugo", "Odette") for h in ("Brindle", "Corve", "Dray", "Quill") for t in ("berg", "combe", "stad")]
    frames = ["The affiant, {}, states that the goods were shipped.", "Signed: {}, residing there.", "Please write to {} before noon."]
    other = ["The Marfold Velgrove line was closed.", "Deliver near Norfold Galwicke on time.", "The Purchase Order names goods, purchase and order."]
    texts = [rng.choice(frames).format(rng.choice(known)) + " " + rng.choice(other) for _ in range(600)]
    assert personal.Model.fit(texts[:50], names) is None
    own = personal.Names([], [])
    own.model = personal.Model.fit(texts, names)
    spans = lambda t: [t[a:b] for k, a, b in personal.items(t, own)]
    assert spans("The affiant, Tamsin Okonkwo, states that all is well.") == ["Tamsin Okonkwo"]
    assert spans("Please write to Ngozi Adeyemi before the end.") == ["Ngozi Adeyemi"]
    assert spans("The Marfold Velgrove line. Deliver near Stoltham Erewhon on time.") == [] and spans("A Purchase Order") == []


def test_classifier_learns_from_all_texts(spark):
    """Few texts among many hold names, the only evidence on one word is in a long text; the rows' order and number of parts change nothing."""
    known = [f"{g} {h}{t}" for g in ("Amara", "Hugo", "Odette") for h in ("Brindle", "Corve", "Dray", "Quill") for t in ("berg", "combe", "stad")]
    lexicon = spark.createDataFrame([(w, "given") for w in ("Amara", "Hugo", "Odette")] + [(w.split()[1], "surname") for w in known[:12]], "name_part string, part_kind string")
    texts = [f"The affiant, {known[k % 36]}, states that lot {k} was shipped." if k % 12 == 0 else f"The Marfold Velgrove line was closed on day {k}." for k in range(3000)]
    texts += ["The affiant, Tamsin Okonkwo, states that all is well.", "The affiant, Tarred Gravel, states that all is well.", "x " * 15_000 + "tarred"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    given, surnames = ["Amara", "Hugo", "Odette"], [w.split()[1] for w in known[:12]]
    model = personal.Model.fit(texts, personal.Names(given, surnames))
    for parts in (1, 7):
        told = personal.seen(df.orderBy(F.xxhash64("doc_id")).repartition(parts), given, surnames, "text")
        got, _ = personal.trained(told, given, surnames, "text", ["doc_id"])
        assert (got.common, got.weights, got.least) == (model.common, model.weights, model.least) and "tarred" in got.common
    got = {r.doc_id: r.redacted for r in personal.redact(df, lexicon).where("doc_id >= 3000").select("doc_id", "redacted").collect()}
    assert got == {3000: "The affiant, [NAME], states that all is well.", 3001: texts[3001], 3002: texts[3002]}


def test_items_are_not_sought_twice(names):
    """Gates that spare a pattern spare none of its matches."""
    rng = random.Random(11)
    parts = ["214", "2OO", "55S", "OIOI", "0lO1", "(2l4)", "555", "-", " ", ".", ") ", "x", "5 of", "a@b.org", "\n", "@site.example", "x@", "\t"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=8))
        assert not personal._LETTERED.search(s) or personal._LETTER.search(s) or all(m[0] == m[0].translate(personal._TO_DIGITS) for m in personal._LETTERED.finditer(s))
        assert not personal._BREAK_AT.search(s) or personal._BREAK.search(s)


def test_redact_frame(spark):
    lexicon = spark.createDataFrame([("Hugo", "given"), ("Finchlow", "surname"), (None, "given")], "name_part string, part_kind string")
    df = spark.createDataFrame([(1, "😀 Hugo Finchlow <a@b.example>", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, items int")
    got = {r.doc_id: r for r in personal.redact(df, lexicon).collect()}
    assert got[1].redacted == "😀 [NAME] <[EMAIL]>" and [(i.pii_kind, i.start_pos) for i in got[1]["items"]] == [("name", 3), ("email", 18)]
    assert got[2].redacted is None and got[3].redacted == "" and got[2]["items"] == []
    assert personal.redact(df.limit(0), lexicon).collect() == []


def test_transducers_keep_offsets():
    rng = random.Random(6)
    pieces = ["plain words ", "x [at] y [dot] com ", "a\n@b.org ", "z​w ", "one two three four five six seven ", "é "]
    for _ in range(200):
        s = "".join(rng.choice(pieces) for _ in range(6))
        t = personal.normalised(s)
        back = [t.back(i) for i in range(len(t.s))]
        assert back == sorted(back) and all(0 <= b < len(s) for b in back)
        for i, ch in enumerate(t.s):
            if ch.isalpha():
                assert s[t.back(i)] == ch
