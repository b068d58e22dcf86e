"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Each pre-token is merged by a priority queue of merge ranks over a doubly linked list of symbols; queue entries
that no longer describe two neighbours are skipped as stale. Results are kept per distinct pre-token in each
worker, in a table of bounded size. Decoding concatenates the vocabulary's byte strings.

Defined results: an empty text and a null text both give an empty list of ids. Strings of special tokens in a
text are ordinary text. Rows are neither dropped nor repeated; no shuffle is needed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidweave.session import spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 200_000  # pre-tokens kept by a worker


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    end = list(range(1, n + 1))  # end of the symbol that starts here; 0: merged into its left neighbour
    left = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            queue.append((r, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # stale
        end[i], end[mid] = stop, 0
        if stop < n:
            left[stop] = i
            r = ranks.get(word[i : end[stop]])
            if r is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        p = left[i]
        if p >= 0:
            r = ranks.get(word[p:stop])
            if r is not None:
                heapq.heappush(queue, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Ids by pre-token, merged at first sight."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        super().__init__()
        self.ranks, self.find = ranks, regex.compile(PATTERN).findall
        self.words: list[bytes] | None = None

    def __missing__(self, word: str) -> list[int]:
        ids = merge(word.encode(), self.ranks)
        if len(self) >= MEMO:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for w in self.find(text) for i in self[w]] if text else []

    def count(self, text: str | None) -> int:
        return sum([len(self[w]) for w in self.find(text)]) if text else 0

    def decode(self, ids: list[int]) -> str:
        if self.words is None:
            self.words = [b""] * (max(self.ranks.values()) + 1)
            for w, i in self.ranks.items():
                self.words[i] = w
        return b"".join(self.words[i] for i in ids).decode(errors="replace")


@lru_cache(maxsize=2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})


def encoder(path: str = VOCABULARY) -> Encoder:
    with open(path, "rb") as f:
        return _encoder(f.read())


def _per_text(df: DataFrame, text: str, name: str, kind: T.DataType, make, vocabulary: str) -> DataFrame:
    """Adds or replaces column ``name``; ``make(encoder, texts)`` gives its Arrow array. The vocabulary is sent to the workers once."""
    with open(vocabulary, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in df.columns if c != name or c == text]
    if name == text:
        raise ValueError("the added column must not be the text's")
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(raw.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, make(own, texts)], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _id_lists(own: Encoder, texts: list) -> pa.Array:
    flat, ends = [], [0]
    for t in texts:
        flat += own.encode(t)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def with_ids(df: DataFrame, text: str = "text", name: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the list of token ids of each text."""
    return _per_text(df, text, name, T.ArrayType(T.IntegerType()), _id_lists, vocabulary)


def with_count(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of each text."""
    return _per_text(df, text, name, T.LongType(), lambda own, texts: pa.array([own.count(t) for t in texts], pa.int64()), vocabulary)


def with_text(df: DataFrame, ids: str = "ids", name: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the text of each list of ids; null for null."""
    return _per_text(df, ids, name, T.StringType(), lambda own, lists: pa.array([None if x is None else own.decode(x) for x in lists], pa.string()), vocabulary)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_ids: doc_id and ids of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return with_ids(docs).select("doc_id", "ids")
