"""Column functions on text: cleaning, tokens, normal forms, detectors, identifiers, citations.

All are null-safe in the way of the package: a cleaner gives the empty text for a null or empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


# The patterns in the cleaners, in page captions and in context headers are fixed values.


def normalize_whitespace(x: Column | str) -> Column:
    s = F.regexp_replace(_or_empty(x), r"[\x{200B}\x{FEFF}\x{AD}]", "")
    s = F.regexp_replace(s, r"[\x{F000}-\x{F8FF}]", "* ")
    s = F.regexp_replace(F.regexp_replace(s, r"\x{A0}", " "), r"[ \t]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def fix_hyphenation(x: Column | str) -> Column:
    return F.regexp_replace(_or_empty(x), r"([a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,})", "$1$2")


#: Words that kerning splits, as (pattern, replacement).
KERNING = [
    (r"(?i)\bBur\s+n\b", "Burn"),
    (r"(?i)\b(se)\s+(lect(?:ion|ed|ing|s)?)\b", "$1$2"),
    (r"(?i)\b(elig)\s+(ible|ibility)\b", "$1$2"),
    (r"\bFACTOR\s+Y\b", "FACTORY"),
]


def fix_kerning(x: Column | str) -> Column:
    s = _or_empty(x)
    for pattern, put in KERNING:
        s = F.regexp_replace(s, pattern, put)
    return F.regexp_replace(s, r"\b([A-Z]{4,})I\b(?=\s+FURTHER|\s*$)", "$1 I")


def fix_fused_words(x: Column | str) -> Column:
    return F.regexp_replace(_or_empty(x), r"\b(AUTHORITY|TAXATION|AFFIRMATION|VALID)I\b", "$1 I")


#: Line breaks inside e-mail addresses and links, in order.
SPLITS = [
    (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)\n\s*(\.[a-zA-Z]{2,}\b)", "$1$2"),
    (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*\.)\n\s*([a-zA-Z0-9.-]+\b)", "$1$2"),
    (r"([A-Za-z0-9._%+-]+)\n\s*(@[A-Za-z0-9.-]+\.[a-zA-Z]{2,}\b)", "$1$2"),
    (r"(https?://[^\s]+)-\n\s*([a-zA-Z0-9_\-./?=&%#]+)", "$1-$2"),
    (r"(https?://[^\s]+/\b)\n\s*([a-zA-Z0-9_\-./?=&%#]+)", "$1$2"),
]


def rejoin_split(x: Column | str) -> Column:
    s = _or_empty(x)
    for pattern, put in SPLITS:
        s = F.regexp_replace(s, pattern, put)
    return s


def reflow_lines(x: Column | str) -> Column:
    """Joins one- and two-word lines with the next full line: one fold over the text's lines."""

    def step(acc: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
        row = line.startswith("|") | line.endswith("|")
        short = (F.size(F.split(line, r"(?U)\s+")) <= 2) & (F.length(line) < 22)
        plain = ~line.endswith(":") & ~line.rlike(r"^(?:[1-9]\.|[*\-•(#])") & ~(line.rlike(r"\p{Lu}") & (F.upper(line) == line))
        fragment = (line != "") & ~row & short & plain
        waiting = F.size(acc["buf"]) > 0
        flushed = F.when(waiting, F.concat(acc["out"], F.array(F.array_join(acc["buf"], " ")))).otherwise(acc["out"])
        alone = F.concat(flushed, F.array(line))
        joined = F.when(waiting, F.concat(acc["out"], F.array(F.array_join(F.concat(acc["buf"], F.array(line)), " ")))).otherwise(alone)
        out = F.when(fragment, acc["out"]).when((line == "") | row, alone).otherwise(joined)
        buf = F.when(fragment, F.concat(acc["buf"], F.array(line))).otherwise(F.array().cast("array<string>"))
        return F.struct(out.alias("out"), buf.alias("buf"))

    empty = F.array().cast("array<string>")
    lines = F.split(F.regexp_replace(_or_empty(x), r"\n$", ""), "\n")
    done = F.aggregate(lines, F.struct(empty.alias("out"), empty.alias("buf")), step, lambda a: F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"]))
    return F.when(_or_empty(x) == "", "").otherwise(F.regexp_replace(F.array_join(done, "\n"), r"\n{3,}", "\n\n"))


def clean_text(x: Column | str) -> Column:
    """All repairs in their fixed order."""
    s = fix_fused_words(fix_kerning(rejoin_split(fix_hyphenation(x))))
    return normalize_whitespace(reflow_lines(s))


def page_label(x: Column | str) -> Column:
    """The first page caption in the first or last five lines."""
    lines = F.split(_or_empty(x), "\n")
    edge = F.concat(F.slice(lines, 1, 5), F.when(F.size(lines) > 5, F.slice(lines, F.greatest(F.lit(-5), -F.size(lines)), 5)).otherwise(lines))
    pattern = r"(?i)^\s*Page\s+(\d+(?:\s*(?:of|\|)\s*\d+)?)"
    return F.regexp_extract(F.get(F.filter(edge, lambda s: s.rlike(pattern)), F.lit(0)), pattern, 1)


def count_tokens(x: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_c(x), F.lit(r"(?U)\w+|[^\w\s]")), F.lit(0))


def terms(x: Column | str) -> Column:
    """Index terms: all tokens, then of each compound one, once each, its parts at separators and at changes of letters and digits."""
    tokens = F.regexp_extract_all(F.lower(_or_empty(x)), F.lit(r"[a-z0-9]+(?:[-_.@][a-z0-9]+)*"), F.lit(0))

    def parts(t: Column) -> Column:
        split = F.filter(F.split(t, r"[-_.@]+"), lambda p: (p != "") & (p != t))
        runs = F.regexp_extract_all(t, F.lit(r"[a-z]+|[0-9]+"), F.lit(0))
        runs = F.when(F.size(runs).between(2, 4), F.filter(runs, lambda p: (F.length(p) >= 2) & (p != t))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(split, runs))

    # Plain words, by far the most, have no parts.
    compound = F.filter(tokens, lambda t: t.rlike(r"[-_.@]|[a-z][0-9]|[0-9][a-z]"))
    return F.concat(tokens, F.flatten(F.transform(compound, parts)))


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")


def stem(x: Column | str) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(_c(x), r"(?<=.)\.[^.]*$", "")


def chunk_id(bid: Column | str, file: Column | str, page: Column | str, suffix: Column | str, content: Column | str) -> Column:
    bid, file, suffix = (_or_empty(v) for v in (bid, file, suffix))
    page = F.coalesce(_c(page).cast("string"), F.lit(""))
    digest = F.substring(F.md5(F.concat_ws("_", bid, file, page, suffix, F.substring(_or_empty(content), 1, 100))), 1, 8)
    return F.concat(bid, F.lit("_"), slug(stem(file)), F.lit("_p"), page, F.lit("_"), suffix, F.lit("_"), digest)


def clip(x: Column | str, size: int, least: int) -> Column:
    """The text cut at a word boundary below ``size``, if there is one beyond ``least`` characters."""
    c = _c(x)
    head = F.substring(c, 1, size)
    space = size - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space > least), F.left(head, space)).otherwise(head)
    return F.when(F.length(c) > size, F.trim(cut)).otherwise(c)


#: How a header calls a document of a type; an addendum adds its number.
TYPE_LABELS = {"affidavit": "Affidavit", "form": "Form", "specs": "Specifications", "bid_page": "Portal Summary"}


def context_header(bid: Column | str, doc_type: Column | str, number: Column | str, file: Column | str, page: Column | str, section: Column | str, page_end: Column | str | None = None) -> Column:
    kind = F.lower(_or_empty(doc_type))
    label = F.when(kind == "addendum", F.when(_c(number) > 0, F.concat(F.lit("Addendum "), _c(number).cast("string"))).otherwise("Addendum"))
    for k, v in TYPE_LABELS.items():
        label = label.when(kind == k, v)
    title = F.trim(F.regexp_replace(stem(_or_empty(file)), r"[_\-]+", " "))
    title = F.regexp_replace(title, r"(?i)\b(?:SOURCING\s*\d+|Bid\s+Information|\{\d+\}|BidNet\s+Direct)\b", "")
    title = clip(F.trim(F.regexp_replace(title, r"\s+", " ")), 42, 20)
    part = clip(F.coalesce(F.nullif(F.trim(_or_empty(section)), F.lit("")), F.lit("General")), 35, 15)
    shown = F.concat(F.lit("p."), _c(page).cast("string"))
    if page_end is not None:
        shown = F.when(_c(page_end) != _c(page), F.concat(shown, F.lit("-"), _c(page_end).cast("string"))).otherwise(shown)
    return F.concat(F.lit("["), F.concat_ws(" | ", _or_empty(bid), label.otherwise("RFP"), title, shown, F.concat(F.lit("Section: "), part)), F.lit("]"))


def citation(file: Column | str, page_start: Column | str, page_end: Column | str, section: Column | str) -> Column:
    pages = F.concat(F.lit("p."), _c(page_start).cast("string"), F.when(_c(page_end) != _c(page_start), F.concat(F.lit("-"), _c(page_end).cast("string"))).otherwise(""))
    part = F.when(_or_empty(section) != "", F.concat(F.lit(" | Section: "), _c(section))).otherwise("")
    return F.concat(_or_empty(file), F.lit(" ("), F.coalesce(pages, F.lit("p.?")), part, F.lit(")"))


def field_citation(file: Column | str, page: Column | str, quote: Column | str) -> Column:
    return F.concat(F.lit("["), _or_empty(file), F.lit(" (p."), F.coalesce(_c(page).cast("string"), F.lit("?")), F.lit(')]: "'), _or_empty(quote), F.lit('"'))


def gold_form(x: Column | str) -> Column:
    """Lower case, signs but @ as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_or_empty(x)), r"(?U)[^\w\s@]", " "), r"(?U)\s+", " "))


def quote_form(x: Column | str) -> Column:
    s = F.regexp_replace(F.lower(_or_empty(x)), r"(?U)\s+", " ")
    return F.regexp_replace(s, "^[ \"'“”‘’:,;]+|[ \"'“”‘’:,;]+$", "")


def plain_form(x: Column | str) -> Column:
    return quote_form(F.regexp_replace(_or_empty(x), r"[\*_#>`|]", ""))


#: How an absent value is written.
ABSENT = ["none", "null", "not found", "n/a", ""]


def is_absent(x: Column | str) -> Column:
    return F.lower(F.trim(_or_empty(x))).isin(ABSENT)


PHONE = r"\b(?:\d{3}[-.\s]??\d{3}[-.\s]??\d{4}|\(\d{3}\)\s*\d{3}[-.\s]??\d{4})\b"
#: Phrases of questions that compare packages.
COMPARING = ["compare", "comparison", "both bids", "all bids", "all three bids", "all 3 bids", "across bids", "across all bids", "difference between", "differ between", "which bid", "summarise all", "summarize all", "each bid", "every bid"]


def is_comparison(x: Column | str) -> Column:
    q = F.lower(_or_empty(x))
    return q.rlike("|".join(COMPARING)) | q.rlike(r"\bbetween\s+([a-z0-9_]+)\s+and\s+([a-z0-9_]+)\b")


def contains_any(x: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | x.contains(w)
    return hit


def count_contained(x: Column, words: list[str]) -> Column:
    n = F.lit(0)
    for w in words:
        n = n + x.contains(w).cast("int")
    return n
