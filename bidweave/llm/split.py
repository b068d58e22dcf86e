"""Splitting of oversized texts at natural boundaries, with overlap.

Boundaries form a hierarchy: section, paragraph, sentence, word, character. A text over the limit is split at its
sections, a section that is still too large at its paragraphs, and so on; the pieces are packed greedily up to the
limit, each new piece starting with the last ``overlap`` tokens of the one before.

A token is a maximal run of letters, digits and underscores, or any other single character that isn't white space.
Defined results: null, empty and blank texts and texts within the limit give no piece; an item that comes again
(same id) counts once; the pieces of a text cover all its tokens, each but the first shares exactly ``overlap``
tokens with the one before, and none exceeds ``limit``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import table

LIMIT, OVERLAP = 500, 75
TOKEN = r"[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]"
SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = range(5)
#: A line that opens a section.
HEADING = r"(?:#{1,4}\s|(?:Section|SECTION|Article|ARTICLE|Part|PART)\s+[\dIVX]+\b|\d+(?:\.\d+)+\s+\p{Lu}|[\p{Lu}\d][\p{Lu}\d &/',.()-]{4,60}\s*$)"


def levels(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the tokens, and for each token the strongest boundary just before it."""
    import regex

    spans = [m.span() for m in regex.finditer(TOKEN, text)]
    heads = {m.end() for m in regex.finditer(rf"(?:^|\n)[^\S\n]*(?={HEADING})", text, flags=regex.MULTILINE)}
    out = [SECTION] * len(spans)
    for i in range(1, len(spans)):
        before, start = spans[i - 1][1], spans[i][0]
        if before == start:
            out[i] = CHARACTER
            continue
        gap = text[before:start]
        if start in heads and "\n" in gap:
            out[i] = SECTION
        elif gap.count("\n") > 1:
            out[i] = PARAGRAPH
        elif text[before - 1] in ".!?" or "\n" in gap:
            out[i] = SENTENCE
        else:
            out[i] = WORD
    return spans, out


def atoms(lvl: list[int], limit: int) -> list[int]:
    """Ends of the pieces of at most ``limit`` tokens got by splitting at ever weaker boundaries."""
    out, todo = [], [(0, len(lvl), SECTION)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= limit:
            out.append(hi)
            continue
        if level == CHARACTER:
            out += [*range(lo + limit, hi, limit), hi]
            continue
        cuts = [lo, *(i for i in range(lo + 1, hi) if lvl[i] <= level), hi]
        todo += [(a, b, level + 1) for a, b in zip(cuts[-2::-1], cuts[:0:-1])]
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of a text over the limit, as character positions; else no piece."""
    spans, lvl = levels(text)
    if len(spans) <= limit:
        return []
    ends, out, first = atoms(lvl, limit - overlap), [], 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or ends[k + 1] - first > limit:
            out.append((spans[first][0], spans[end - 1][1], end - first))
            first = end - overlap
    return out


def split(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows of ``df`` whose text is over the limit, once per piece: ``piece_no`` from 1, ``start_pos`` and ``end_pos``
    (characters from 0, end excluded), ``n_tokens`` and ``piece`` are added (columns of these names are replaced).

    Tokens are counted in the JVM and only texts over the limit reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    names = ("piece_no", "start_pos", "end_pos", "n_tokens", "piece")
    if text in names:
        raise ValueError("the text's column must not have the name of an added one")
    df = df.drop(*names)
    over = df.where((F.length(text) > limit) & (F.regexp_count(F.col(text), F.lit(rf"(?U){TOKEN}")) > limit))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = [pieces(t, limit, overlap) for t in pdf[text]]
            rows = pdf.loc[pdf.index.repeat([len(c) for c in cut])].reset_index(drop=True)
            flat = [(k + 1, a, b, n, t[a:b]) for t, c in zip(pdf[text], cut) for k, (a, b, n) in enumerate(c)]
            yield pd.concat([rows, pd.DataFrame(flat, columns=list(names))], axis=1)

    from pyspark.sql import types as T

    added = [T.StructField(n, T.StringType() if n == "piece" else T.IntegerType()) for n in names]
    return over.mapInPandas(run, T.StructType([*over.schema.fields, *added]))


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_pieces: the pieces of all oversized pages and chunks, each item once."""
    pages = table(spark, sf_dir, "parsed_pages").select(F.lit("page").alias("item_kind"), F.col("page_id").cast("string").alias("item_id"), F.col("cleaned_text").alias("text"))
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    # Two pages of one id have the same content, so one piece of each number is enough.
    return split(pages.unionByName(chunks)).drop("text").dropDuplicates(["item_kind", "item_id", "piece_no"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: the items that were cut."""
    return oversized(spark, sf_dir).where("piece_no = 1").select("item_kind", "item_id")


FOUND_SQL = r"""
select 'page' item_kind, cast(page_id as varchar) item_id from (select distinct page_id, cleaned_text t from parsed_pages) where len(regexp_extract_all(t, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]')) > 500
union select 'chunk', chunk_id from (select distinct chunk_id, text t from chunks) where len(regexp_extract_all(t, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]')) > 500
"""
