"""Repair of text from scanned pages: running headers, page numbers, cut and misread words.

Headers and footers are found by fuzzy repetition of lines at page edges within a document, page-number sequences by
their form and their number, which is that of the page or runs ahead of it by the same count on several pages. The vocabulary counts the pages on which each word stands, over the whole corpus;
a word cut at a line's end is joined if the vocabulary has the joined word, or lacks the hyphenated one; a word outside
the vocabulary is misread if undoing one or two usual confusions, a stray sign or a split gives a word of it.

Defined results: pages that aren't scanned are left out (``is_scanned`` null counts as scanned); a null text has
no noise and stays null; a page that comes again (same id) counts once; without unscanned pages the vocabulary is counted
over all pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import spread, stage, table

#: Lines from each end of a page that can be a header, footer or page number.
EDGE = 3
#: What a recogniser reads, and what stands there.
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("3", "e"), ("1", "i"), ("1", "l"), ("l", "i"), ("i", "l"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("0", "o"), ("@", "a"), ("5", "s"), ("$", "s"),
    ("rn", "m"), ("m", "rn"), ("li", "h"), ("h", "li"), ("h", "fi"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("4", "a"), ("7", "t"), ("n", "ri"), ("vv", "w"), ("w", "vi"), ("w", "vv"), ("rm", "nn"), ("nn", "rm"), ("u", "ii"), ("!", "l"), ("|", "l"),
]
STRAY = "~^|¦·•`_*°¬"
HYPHENS = "-‐‑¬\xad"
#: Page numbers that aren't the page's own are a sequence if they lie equally far from it on so many pages of a document.
SEQUENCE = 3
#: A word of the vocabulary stands on at least so many pages, whatever the size of the corpus.
MIN_PAGES = 3
#: The words on most pages are broadcast, up to this number (some 20 MB a worker); all others are looked up by a join.
BROADCAST_WORDS = 200_000

#: Documents with pages of unknown kind are broadcast up to this number (some 10 MB), beyond it joined by a shuffle.
BROADCAST_DOCUMENTS = 100_000

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PAGE_NO = re.compile(r"^\W*(?:(?:page|pg|p)\b\W*)?(\d{1,4}|[ivxlc]{1,7})(?:\W*(?:of|/)\W*(\d{1,4}|[ivxlc]{1,7}))?\W*$")
_LEFT = re.compile(rf"([^\W_]+(?:[-'’][^\W_]+)*)[{HYPHENS}]\s*$")
_RIGHT = re.compile(r"\s*([^\W_]+(?:[-'’][^\W_]+)*)")
_CORE = re.compile(r"^[\"'(\[{<“‘]*(.*?)[\"')\]}>”’.,;:?!]*$", re.DOTALL)
_NUMBER = re.compile(r"^[$#]?\d[\d,.:/%-]*$")


def roman(n: int) -> str:
    out = ""
    for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, pages): the corpus vocabulary; words are counted once a page, in lower case."""
    text = F.lower(F.concat_ws(" ", F.regexp_replace("raw_text", rf"[{HYPHENS}]\s*\n", " "), "cleaned_text"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0)))
    # The null word stands for the page itself.
    words = pages.select(F.coalesce("is_scanned", F.lit(True)).alias("scanned"), F.explode(F.concat(found, F.array(F.lit(None).cast("string")))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("all_pages"), F.count(F.when(~F.col("scanned"), 1)).alias("clean_pages"))
    counts = stage(counts.where(F.col("word").isNull() | (F.col("all_pages") >= MIN_PAGES)))
    unclean = counts.where("word is null and clean_pages > 0").isEmpty()
    n = F.col("all_pages") if unclean else F.col("clean_pages")
    return counts.where(F.col("word").isNotNull() & (n >= MIN_PAGES)).select("word", n.alias("pages"))


_DOC = ["bid_id", "file_name", "text_field"]
#: Documents with more forms than this find misread ones by shared parts instead of comparing all of fitting length.
MANY_FORMS = 2000


def edge_lines(pages: DataFrame) -> DataFrame:
    """(page_id, bid_id, file_name, text_field, line_no, form, ahead): the lines at page edges of scanned pages, and of other pages of documents with pages of unknown kind.

    ``form`` has the letters only, null where the line can't run; ``ahead`` says how far the number of a line that is a
    page number lies beyond the page's. Null names count as one. Texts are read once; the lines are written for the passes over them.
    """
    unsure = stage(pages.where("is_scanned is null").select("bid_id", "file_name").distinct()).withColumn("unsure", F.lit(True))
    if unsure.count() <= BROADCAST_DOCUMENTS:
        unsure = F.broadcast(unsure)

    def edges(text: str) -> Column:
        lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
        full = F.filter(lines, lambda x: x["line"].rlike(r"\S"))
        return F.array_distinct(F.concat(F.slice(full, 1, EDGE), F.reverse(F.slice(F.reverse(full), 1, EDGE))))

    fields = F.array(*[F.struct(F.lit(f).alias("text_field"), edges(f).alias("edges")) for f in ("raw_text", "cleaned_text")])
    rows = pages.select("page_id", "bid_id", "file_name", "page_number", F.coalesce("is_scanned", F.lit(True)).alias("scanned"), fields.alias("f"))
    # A page of unknown kind may lie among unscanned pages that carry the same running lines.
    rows = rows.join(unsure, ["bid_id", "file_name"], "left").where("scanned or unsure").select("*", F.explode("f").alias("g")).select("*", "g.text_field", F.explode("g.edges").alias("e"))
    line = F.col("e.line")
    form = F.regexp_replace(F.lower(line), r"[^\p{L}@]", "")
    # The last line of a paragraph ends with a full stop; running lines don't.
    form = F.when((F.length(form) >= 4) & ~line.rlike(r"[.;,:]\s*$"), form)
    ahead = F.regexp_extract(F.lower(F.trim(line)), r"^\W*(?:(?:page|pg|p)\b\W*)?(\d{1,4})(?:\W*(?:of|/)\W*\d{1,4})?\W*$", 1).try_cast("int") - F.col("page_number")
    rows = rows.select("page_id", *[F.coalesce(c, F.lit("\u0000")).alias(c) for c in _DOC], "e.line_no", form.alias("form"), ahead.alias("ahead"))
    return stage(rows.where("form is not null or ahead <> 0"))


def sequences(edges: DataFrame) -> DataFrame:
    """(page_id, text_field, ahead): how far the page numbers of the page's document run ahead of its pages."""
    rows = edges.where("ahead <> 0")
    runs = rows.groupBy(*_DOC, "ahead").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") >= SEQUENCE)
    return rows.join(runs, [*_DOC, "ahead"]).groupBy("page_id", "text_field").agg(F.collect_set("ahead").alias("ahead"))


def edge_headers(edges: DataFrame) -> DataFrame:
    """(page_id, text_field, header_lines): numbers of the edge lines that run through the document.

    Forms are counted per document before any two are compared; a form on one page is compared with all
    forms of its document whose length allows it to be the same line misread.
    """
    rows = edges.where("form is not null").select("page_id", *_DOC, "line_no", "form")
    forms = rows.groupBy(*_DOC, "form").agg(F.count_distinct("page_id").alias("pages"))
    n = F.length("form")
    allowed = F.when(n <= 8, 1).otherwise(F.least(F.greatest(F.lit(2), F.floor(n / 8)), F.lit(5))).cast("int")
    # Forms within the allowed distance differ by no more in length.
    forms = stage(forms.withColumn("allowed", allowed))
    large = stage(forms.groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_FORMS).select(*_DOC))
    few = forms if large.isEmpty() else forms.join(large, _DOC, "left_anti")
    single = few.where("pages = 1").withColumn("length", F.explode(F.sequence(n - F.col("allowed"), n + F.col("allowed"))))
    heads = few.select(*_DOC, n.alias("length"), F.col("form").alias("head"))
    near = lambda x: x.where(F.levenshtein("form", "head", 5).between(1, F.col("allowed"))).select(*_DOC, "form")
    fuzzy = near(single.join(heads, [*_DOC, "length"]))
    if few is not forms:
        fuzzy = fuzzy.unionByName(near(sharing_parts(forms.join(large, _DOC, "left_semi"))))
    running = forms.where("pages >= 2").select(*_DOC, "form").unionByName(fuzzy).distinct()
    return rows.join(running, [*_DOC, "form"]).groupBy("page_id", "text_field").agg(F.collect_set("line_no").alias("header_lines"))


def sharing_parts(forms: DataFrame) -> DataFrame:
    """(document, form, allowed, head): pairs of forms, the first on one page, of which the second has a part of the first at about its place.

    A form that may have d misreadings is cut into d + 1 parts; any form within that distance has one of them unchanged, shifted by
    d letters at most, so no pair within the distance is lost.
    """
    at = lambda n, i, d: F.floor(i * n / (d + 1)).cast("int")
    n, d = F.length("form"), F.col("allowed")
    own = F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(n.alias("n"), i.alias("i"), F.substr("form", at(n, i, d) + 1, at(n, i + 1, d) - at(n, i, d)).alias("part")))
    parts = forms.where("pages = 1").select(*_DOC, "form", "allowed", F.explode(own).alias("k")).select(*_DOC, "form", "allowed", "k.*")

    def of_length(m: Column) -> Column:
        most = F.when(m <= 8, 1).otherwise(F.least(F.greatest(F.lit(2), F.floor(m / 8)), F.lit(5))).cast("int")
        fits = F.abs(m - n) <= most

        def places(i: Column) -> Column:
            size = at(m, i + 1, most) - at(m, i, most)
            lo, hi = F.greatest(F.lit(0), at(m, i, most) - most), F.least(n - size, at(m, i, most) + most)
            shifts = F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))
            return F.array_distinct(F.transform(shifts, lambda p: F.struct(m.alias("n"), i.alias("i"), F.substr("form", p + 1, size).alias("part"))))

        return F.when(fits, F.flatten(F.transform(F.sequence(F.lit(0), most), places))).otherwise(F.array().cast("array<struct<n:int,i:int,part:string>>"))

    lengths = F.sequence(F.greatest(F.lit(4), n - 5), n + 5)
    heads = forms.select(*_DOC, F.col("form").alias("head"), F.explode(F.flatten(F.transform(lengths, of_length))).alias("k")).select(*_DOC, "head", "k.*")
    return parts.join(heads, [*_DOC, "n", "i", "part"]).where("form <> head").select(*_DOC, "form", "allowed", "head").distinct()


def undone(low: str) -> Iterator[list[str]]:
    """What a form in lower case can be a misreading of: first by one usual confusion, then by two."""
    seen, ring = {low}, [low]
    for depth in range(2):
        if depth and len(low) < 6:
            break
        ahead = []
        for w in ring:
            for wrong, right in CONFUSIONS:
                at = w.find(wrong)
                while at >= 0:
                    x = w[:at] + right + w[at + len(wrong) :]
                    if x not in seen:
                        seen.add(x)
                        ahead.append(x)
                    at = w.find(wrong, at + 1)
        yield ahead
        ring = ahead


class Reader:
    """Judges words by a vocabulary: ``words``, and of the rest of it at least those (``rare``) that the page in hand asks for."""

    def __init__(self, words: list[str]):
        self.words = frozenset(words)
        self.rare: frozenset[str] = frozenset()
        self.memo: dict[str, str | None] = {}

    def has(self, word: str | None) -> bool:
        return word in self.words or word in self.rare

    def knows(self, word: str) -> bool:
        w = word.lower()
        return self.has(w) or ("-" in w and all(len(p) > 1 and self.has(p) for p in w.split("-")))

    def repaired(self, token: str) -> str | None:
        """The word that a misread token stands for; None if it isn't misread."""
        if token not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[token] = self._repair(token)
        return self.memo[token]

    def _repair(self, token: str) -> str | None:
        if not token or self.knows(token) or _NUMBER.match(token):
            return None
        bare = token.strip("-")
        if any(s in bare[1:-1] for s in STRAY) and sum(ch.isalnum() for ch in bare) > 1:
            out = "".join(ch for ch in bare if ch not in STRAY)
            if re.fullmatch(r"[^\W_]+(?:['’-][^\W_]+)*|[$#]?[\d,.]+", out):
                return out
        if len(token) < 3 and token.isalpha() or len(token) > 40:
            return None
        if re.search(r"\d", token):
            plain = token.translate(str.maketrans("OoIlSBZ", "0011582"))
            if plain != token and re.fullmatch(r"[$#]?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?|\d{1,2}/\d{1,2}/\d{2,4}", plain) and sum(ch.isdigit() for ch in token) >= 1 and not re.fullmatch(r"\d+[A-Z]|[A-Z]\d+", token):
                return plain
        low = token.lower()
        if sum(ch.isalpha() for ch in low) < 2:
            return None
        return next((x for ring in undone(low) for x in ring if self.knows(x)), None)

    def asked(self, form: str, misread: bool) -> list[str]:
        """The words outside ``words`` on which it depends whether a form in lower case is known or, with ``misread``, what it stands for."""
        out = {form, *form.split("-")}
        if misread and len(form) <= 80:
            for ring in undone(form):
                for x in ring:
                    out.update((x, *x.split("-")))
                if any(self.knows(x) for x in ring):
                    break
        return [x for x in out if x not in self.words and _WORD.fullmatch(x)]


def _is_page_no(line: str, page: int | None, ahead: list[int] | None = None) -> bool:
    """Whether a line is the number of its page, or of a page as far from it as ``ahead`` has; of a page without number any that says so."""
    s = line.strip().lower()
    if not s or len(s) > 24:
        return False
    m = _PAGE_NO.match(s) or _PAGE_NO.match(re.sub(r"^(\W*)pa?[gq9][ec3]?\b", r"\1page", s))
    if not m:
        return False
    return page is None or m[1] in (str(page), roman(page)) or m[1] in {str(page + n) for n in ahead or ()}


def _parts(lines: list[str], header_lines: list[int] | None, page: int | None, ahead: list[int] | None = None) -> tuple[list[tuple[int, str]], list[int]]:
    """(line number, kind) of page numbers and running lines, and the places of all other lines with text."""
    full = [i for i, line in enumerate(lines) if line.strip()]
    edge = {*full[:EDGE], *full[-EDGE:]}
    headers = {n - 1 for n in header_lines or ()}
    out: list[tuple[int, str]] = []
    body: list[int] = []
    for i in full:
        if i in edge and _is_page_no(lines[i], page, ahead):
            out.append((i + 1, "page_no"))
        elif i in headers:
            out.append((i + 1, "header"))
        else:
            body.append(i)
    return out, body


def _at_end(left: str, right: str) -> tuple[str, str] | None:
    """The two fragments of a word that may be cut between two lines."""
    a, b = _LEFT.search(left), _RIGHT.match(right)
    return (a[1], b[1]) if a and b and a[1][-1].isalpha() and b[1][0].isalpha() else None


def forms(text: str | None, header_lines: list[int] | None, page: int | None, reader: Reader, ahead: list[int] | None = None) -> set[tuple[str, bool]]:
    """(form, misread) in lower case: all forms of a text that ``noise`` looks up and the reader's ``words`` don't settle."""
    out: set[tuple[str, bool]] = set()
    lines = (text or "").split("\n")
    _, body = _parts(lines, header_lines, page, ahead)
    for i, k in zip(body, body[1:]):
        cut = _at_end(lines[i], lines[k])
        if cut:
            a, b = cut
            out.update((x.lower(), True) for x in (f"{a}-{b}", a + b, a, b))
    for i in body:
        row = lines[i].split()
        cores = [_CORE.match(t)[1] for t in row]
        out.update((c.lower(), True) for c in cores if c and not reader.knows(c))
        out.update(((cores[j] + cores[j + 1]).lower(), False) for j in range(len(row) - 1) if cores[j].isalpha() and cores[j + 1] and not (reader.knows(cores[j]) and reader.knows(cores[j + 1])))
    return {x for x in out if x[0] not in reader.words}


def noise(text: str | None, header_lines: list[int] | None, page: int | None, reader: Reader, ahead: list[int] | None = None) -> tuple[list[tuple[int, str]], str | None]:
    """(line number, kind) of all noise of a text, and the text repaired into paragraphs."""
    if text is None:
        return [], None
    lines = text.split("\n")
    out, body = _parts(lines, header_lines, page, ahead)
    tokens = {i: lines[i].split() for i in body}
    joins: set[int] = set()
    keeps: set[int] = set()  # the hyphen at the line's end belongs to the word
    for i, k in zip(body, body[1:]):
        fragments = _at_end(lines[i], lines[k])
        if not fragments:
            continue
        a, b = fragments
        whole, joined = f"{a}-{b}".lower(), (a + b).lower()
        if reader.has(joined) or reader.has(reader.repaired(joined)):
            cut = not (reader.has(whole) and not reader.has(joined))
        elif reader.has(whole) or (reader.knows(a) and reader.knows(b)):
            cut = False
        else:
            fixed = reader.repaired(whole)
            cut = not (fixed and "-" in fixed) and b[0].islower()
        if not cut:
            keeps.add(i)
        else:
            joins.add(i)
            out.append((i + 1, "hyphen"))
            if not reader.knows(joined):
                fixed = reader.repaired(joined)
                if fixed:
                    # The fragment that isn't a part of the right word is the misread one.
                    f, low_a, low_b = fixed.lower(), a.lower(), b.lower()
                    if not f.startswith(low_a):
                        out.append((i + 1, "misread"))
                    if not f.endswith(low_b):
                        out.append((k + 1, "misread"))
                    tokens[i][-1] = tokens[i][-1].replace(a, fixed[: max(0, len(f) - len(b))], 1) if f.endswith(low_b) else tokens[i][-1]
    starts = {k for i, k in zip(body, body[1:]) if i in joins}
    flagged = {n for n, kind in out if kind == "misread"}
    for i in body:
        row = tokens[i]
        skip_last = i in joins
        skip_first = i in starts
        cores = [_CORE.match(t)[1] for t in row]
        j = 0
        while j < len(row):
            if (j == 0 and skip_first) or (j == len(row) - 1 and skip_last):
                j += 1
                continue
            core = cores[j]
            fixed = None
            if core and not reader.knows(core):
                fixed = reader.repaired(core)
            if fixed is None and j + 1 < len(row) and not (j + 2 == len(row) and skip_last) and row[j][-1:].isalnum() and cores[j + 1] and row[j + 1][:1].isalnum():
                a, b = cores[j], cores[j + 1]
                if reader.has((a + b).lower()) and a.isalpha() and not (reader.knows(a) and reader.knows(b)):
                    flagged.add(i + 1)
                    row[j] = row[j] + row[j + 1]
                    row[j + 1] = ""
                    j += 2
                    continue
            if fixed is not None:
                flagged.add(i + 1)
                row[j] = row[j].replace(core, fixed[0].upper() + fixed[1:] if core[0].isupper() else fixed, 1)
            j += 1
    out = [*(x for x in out if x[1] != "misread"), *((n, "misread") for n in flagged)]
    # Continuous paragraphs: blank lines part them.
    parts, last = [], None
    for i in body:
        s = " ".join(t for t in tokens[i] if t)
        if i in joins:
            s = s.rstrip().rstrip(HYPHENS)
        if last is None:
            parts.append(s)
        elif last in joins or last in keeps:
            parts.append(s)
        elif any(not lines[x].strip() for x in range(last + 1, i)):
            parts.append("\n\n" + s)
        else:
            parts.append(" " + s)
        last = i
    return sorted(set(out)), "".join(parts)


def _listed(x) -> list | None:
    return None if x is None else list(x)


def _with_rare(texts: DataFrame, known: DataFrame, words: Broadcast) -> DataFrame:
    """Adds ``rare``: the words of the vocabulary beyond the broadcast ones on which the judgement of a text depends.

    Only forms that the broadcast words don't settle are shuffled; each form is looked up once.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(words.value)
        for pdf in batches:
            rows = []
            for pid, number, field, text, heads, ahead in zip(*(pdf[c] for c in ("page_id", "page_number", "text_field", "text", "header_lines", "ahead"))):
                rows += [(pid, field, f, m) for f, m in forms(text, _listed(heads), None if pd.isna(number) else int(number), reader, _listed(ahead))]
            yield pd.DataFrame(rows, columns=["page_id", "text_field", "form", "misread"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(words.value)
        for pdf in batches:
            yield pd.DataFrame([(f, m, w) for f, m in zip(pdf["form"], pdf["misread"]) for w in reader.asked(f, m)], columns=["form", "misread", "word"])

    asked = stage(texts.mapInPandas(ask, "page_id bigint, text_field string, form string, misread boolean"))
    hits = asked.select("form", "misread").distinct().mapInPandas(look, "form string, misread boolean, word string").join(known.select("word"), "word")
    per = asked.join(hits, ["form", "misread"]).groupBy("page_id", "text_field").agg(F.collect_set("word").alias("rare"))
    per = per.withColumnsRenamed({"page_id": "__p", "text_field": "__f"})
    return texts.join(per, F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("text_field") == F.col("__f")), "left").drop("__p", "__f")


def repair(pages: DataFrame) -> DataFrame:
    """(page_id, text_field, repaired, noise): the repaired text of both text fields of scanned pages, and each line's noise."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("text_field"), F.col(f).alias("text")) for f in ("raw_text", "cleaned_text")])).alias("f")
    texts = pages.where(F.coalesce("is_scanned", F.lit(True))).select("page_id", "page_number", fields).select("page_id", "page_number", "f.*")
    edges = edge_lines(pages)
    marks = edge_headers(edges).join(sequences(edges), ["page_id", "text_field"], "full_outer")
    known = stage(vocabulary(pages))
    rare = known.count() > BROADCAST_WORDS
    head = known.orderBy(F.desc("pages"), "word").limit(BROADCAST_WORDS) if rare else known
    words = pages.sparkSession.sparkContext.broadcast([r[0] for r in head.select("word").toLocalIterator()])
    joined = spread(texts).join(marks, ["page_id", "text_field"], "left")
    joined = _with_rare(stage(joined), known, words) if rare else joined.withColumn("rare", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(words.value)
        for pdf in batches:
            rows = []
            for pid, number, field, text, heads, ahead, more in zip(*(pdf[c] for c in ("page_id", "page_number", "text_field", "text", "header_lines", "ahead", "rare"))):
                reader.rare = frozenset(() if more is None else more)
                found, fixed = noise(text, _listed(heads), None if pd.isna(number) else int(number), reader, _listed(ahead))
                rows.append((pid, field, fixed, [{"line_no": n, "noise_kind": k} for n, k in found]))
            yield pd.DataFrame(rows, columns=["page_id", "text_field", "repaired", "noise"])

    out = joined.mapInPandas(run, "page_id bigint, text_field string, repaired string, noise array<struct<line_no:int,noise_kind:string>>")
    return out.dropDuplicates(["page_id", "text_field"])


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_pages").select("page_id", "bid_id", "file_name", "page_number", "raw_text", "cleaned_text", "is_scanned")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: every noisy line of scanned pages with its kind of noise."""
    return repair(page_texts(spark, sf_dir)).select("page_id", "text_field", F.explode("noise").alias("n")).select("page_id", "text_field", "n.line_no", "n.noise_kind")


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_repaired: the continuous text of every scanned page."""
    return repair(page_texts(spark, sf_dir)).select("page_id", "text_field", "repaired")
