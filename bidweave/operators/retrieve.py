"""Sparse and dense retrieval for sets of queries: BM25, cosine, expansion, fusion, reranking, metrics.

Queries are a table (query_id, query); every operator answers all of them in one plan. Corpus statistics always come from
the whole corpus; filters only choose which scored rows are ranked. Ties are broken by chunk id.
Defined results: empty and null queries and texts have no terms and no hits; chunks that come again count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bidweave.config import FIELDS, SETTINGS, field_definitions
from bidweave.functions import text as X
from bidweave.plans.providers import Embedder, HashEmbedder, Reranker, embed
from bidweave.session import spread, stage, table, unique, write_out

K1, B, EPSILON = 1.5, 0.75, 0.25


#: Query terms are broadcast up to this number (some 60 MB), beyond it postings and query terms meet by a shuffle.
BROADCAST_TERMS = 1_000_000


class SparseIndex(NamedTuple):
    """``rows`` (chunk_id, dl, terms, tfs and the chunks' ``METADATA``: a row for each chunk), ``term_stats`` (term, df, idf), ``corpus`` (one row: n, avgdl, avg_idf, vocabulary)."""

    rows: DataFrame
    term_stats: DataFrame
    corpus: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, dl, term, tf)."""
        return self.rows.select("chunk_id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).toDF("chunk_id", "dl", "term", "tf")


#: Columns of chunks that an index keeps, so that filters need no join.
METADATA = ("bid_id", "doc_type", "addendum_number", "is_table")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct terms with their counts, on Arrow arrays as they are."""
    for b in batches:
        lists = b.column("terms")
        words = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        key = np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
        own, tf = np.unique(key, return_counts=True)
        row, word = np.divmod(own, max(1, len(words.dictionary)))
        ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(word)))
        tfs = pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))
        more = [c for c in b.schema.names if c not in ("chunk_id", "terms")]
        yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(sizes.astype(np.int32)), terms, tfs, *(b.column(c) for c in more)], ["chunk_id", "dl", "terms", "tfs", *more])


def build_index(chunks: DataFrame, text: str = "text") -> SparseIndex:
    """Terms are made and counted inside each chunk's row and written once; all statistics are read from there.

    Only partial counts by term are shuffled, never the postings.
    """
    kept = [c for c in METADATA if c in chunks.columns and c != text]
    docs = spread(unique(chunks.select("chunk_id", text, *kept), "chunk_id")).select("chunk_id", X.terms(text).alias("terms"), *kept)
    added = "chunk_id string, dl int, terms array<string>, tfs array<int>"
    rows = write_out(docs.mapInArrow(_counted, ", ".join([added, *(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept)])))
    base = stage(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = stage(df.crossJoin(F.broadcast(base)).withColumn("raw", raw))
    corpus = base.crossJoin(F.broadcast(stats.agg(F.avg("raw").alias("avg_idf"), F.count(F.lit(1)).alias("vocabulary"))))
    floor = F.broadcast(corpus.select("avg_idf"))
    term_stats = stats.crossJoin(floor).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw")).alias("idf"))
    return SparseIndex(rows, term_stats, corpus)


def bm25_scores(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) with score > 0: postings of other terms leave before anything is shuffled, and a chunk's parts are summed where its row lies."""
    wanted = queries.select("query_id", F.explode(X.terms("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = stage(wanted.join(index.term_stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    few = wanted.count() <= BROADCAST_TERMS
    hits = index.postings.join(F.broadcast(wanted) if few else wanted, "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


#: Scores that a task holds at once.
SCORES_AT_ONCE = 4_000_000


def bm25_top(index: SparseIndex, queries: DataFrame, k: int, within: str | None = None, **filters) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query, with ``within`` of each of its groups; as ``top_k`` over ``bm25_scores``, filtered before.

    Every chunk's scores are summed in its row, and a task gives on only what can be among the k best, so that no score matrix is
    shuffled. More query terms than can be broadcast go by the postings instead.
    """
    rows = metadata_filter(index.rows, **filters)
    wanted = queries.select("query_id", F.explode(X.terms("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = stage(wanted.join(index.term_stats, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    by = ["query_id", within] if within else ["query_id"]
    if wanted.count() > BROADCAST_TERMS:
        scores = bm25_scores(index, queries).join(rows.select("chunk_id", *by[1:]), "chunk_id")
        return top_k(scores, k, by=by)
    asked = wanted.toPandas()  # at most BROADCAST_TERMS rows
    avgdl = index.corpus.select("avgdl").first()["avgdl"] or 1.0
    ids, query = np.unique(asked["query_id"].to_numpy(), return_inverse=True) if len(asked) else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(asked["term"].to_numpy(), kind="stable")
    names, first = np.unique(asked["term"].to_numpy()[order], return_index=True) if len(asked) else ([], np.empty(0, np.int64))
    ends = np.append(first, len(order)).astype(np.int64)
    sent = rows.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(names)}, ends, query[order], asked["weight"].to_numpy()[order], ids))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double" + (f", {within} {index.rows.schema[within].dataType.simpleString()}" if within else "")

    kind = to_arrow_type(queries.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ends, query, weight, ids = sent.value
        step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
        for whole in batches:
            for lo in range(0, len(whole) if len(ids) else 0, step):
                b = whole.slice(lo, step)
                lists = b.column("terms")
                words = lists.flatten().dictionary_encode()
                known = np.array([place.get(t, -1) for t in words.dictionary.to_pylist()], np.int64)
                offsets = lists.offsets.to_numpy()
                term = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)
                at = np.flatnonzero(term >= 0)
                if not len(at):
                    continue
                row = np.repeat(np.arange(len(b)), np.diff(offsets))[at]
                term, tf = term[at], b.column("tfs").flatten().to_numpy()[at].astype(np.float64)
                dl = b.column("dl").to_numpy()[row]
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
                # Every posting meets the queries that have its term.
                n = ends[term + 1] - ends[term]
                own = np.repeat(ends[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                scores = np.bincount(np.repeat(row, n) * len(ids) + query[own], weights=np.repeat(part, n) * weight[own], minlength=len(b) * len(ids)).reshape(len(b), len(ids))
                scores = np.round(scores, 6)
                group = pd.factorize(b.column(within).to_pandas(), use_na_sentinel=False)[0] if within else np.zeros(len(b), np.int64)
                for g in range(group.max() + 1):
                    members = np.flatnonzero(group == g)
                    s = scores[members]
                    least = np.partition(s, len(members) - k, axis=0)[len(members) - k] if len(members) > k else np.zeros(len(ids))
                    r, q = np.nonzero((s > 0) & (s >= least))
                    places = pa.array(members[r])
                    columns = [pa.array(ids[q].tolist(), kind), b.column("chunk_id").take(places), pa.array(s[r, q])]
                    yield pa.RecordBatch.from_arrays([*columns, *(b.column(c).take(places) for c in by[1:])], ["query_id", "chunk_id", "score", *by[1:]])

    found = rows.select("chunk_id", "dl", "terms", "tfs", *by[1:]).where("chunk_id is not null").mapInArrow(run, schema)
    return top_k(found, k, by=by)


def metadata_filter(df: DataFrame, bid_id: str | None = None, doc_type: str | None = None, exclude_doc_type: str | None = None, addendum_number: int | None = None, is_table: bool | None = None) -> DataFrame:
    """Package without regard to case, type exactly, excluded type without regard to case; null numbers never match."""
    if bid_id:
        df = df.where(F.lower("bid_id") == bid_id.lower())
    if doc_type:
        df = df.where(F.col("doc_type") == doc_type)
    if exclude_doc_type:
        df = df.where(F.lower(F.coalesce("doc_type", F.lit(""))) != exclude_doc_type.lower())
    if addendum_number is not None:
        df = df.where(F.col("addendum_number") == addendum_number)
    if is_table is not None:
        df = df.where(F.col("is_table") == is_table)
    return df


def top_k(scores: DataFrame, k: int, key: str = "chunk_id", by: str | list[str] = "query_id", score: str = "score") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)



#: Bytes of queries that one scan of the vectors answers, and queries of one matrix product.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 1024


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int, block: int | None = None, key: str = "vec_id", within: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k most similar vectors of each query (query_id, embedding); vectors and queries by the same ``vec_id`` apart.

    With ``within`` (kept as a column) the k most similar of each group. Queries go in blocks of ``QUERY_BYTES`` (or ``block``
    queries) against all rows, a scan each; a task keeps k rows per query and group before anything is shuffled.
    """
    out = None
    chunk: list = []
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), key: vectors.schema[key].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double" + (f", {within} {vectors.schema[within].dataType.simpleString()}" if within else "")
    array = lambda x, name: np.array(x, dtype=np.int64 if kinds[name] in ("int", "bigint") else object)
    needed = [key, "embedding", *([within] if within else [])]

    def against(rows: list) -> DataFrame:
        ids = array([r[0] for r in rows], "query_id")
        matrix = np.array([r[1] for r in rows], dtype=np.float32 if queries.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def best_of(pdf: pd.DataFrame) -> pd.DataFrame:
            q, m = sent.value
            v = array(pdf[key].to_list(), key)
            order = np.argsort(v, kind="stable")
            v = v[order]
            rows = np.stack(pdf["embedding"].to_numpy())[order].astype(np.float64).T
            n, out = min(k, len(v)), []
            for lo in range(0, len(q), QUERY_BLOCK):
                own = q[lo : lo + QUERY_BLOCK]
                s = np.round(m[lo : lo + QUERY_BLOCK].astype(np.float64) @ rows, 6)
                if key == "vec_id":
                    s[own[:, None] == v[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :n]  # ties: smaller id first
                out.append(pd.DataFrame({"query_id": np.repeat(own, n), key: v[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
            return pd.concat(out)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna() & pdf[key].notna()]
                if not len(pdf):
                    continue
                if within:
                    for group, part in pdf.groupby(within, sort=False):
                        yield best_of(part).assign(**{within: group})
                else:
                    yield best_of(pdf)

        return vectors.select(needed).mapInPandas(run, schema).where("score > double('-Infinity')")

    for row in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        chunk.append(row)
        if len(chunk) == (block or max(QUERY_BLOCK, QUERY_BYTES // (4 * max(1, len(row["embedding"]))))):
            part = against(chunk)
            out, chunk = part if out is None else out.unionByName(part), []
    if chunk or out is None:
        part = against(chunk) if chunk else vectors.sparkSession.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, key, ["query_id", within] if within else "query_id")


def vectors_of(chunks: DataFrame, make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """(chunk_id, embedding): each chunk with terms once, by the provider."""
    docs = unique(chunks.select("chunk_id", "text"), "chunk_id").where(F.lower("text").rlike("[a-z0-9]"))
    return embed(docs, "text", make).select("chunk_id", "embedding")


def _embedded(chunks: DataFrame, make: Callable[[], Embedder], columns: list[str]) -> DataFrame:
    """The given columns and ``embedding`` of unique chunks with terms."""
    return embed(chunks.where(F.lower("text").rlike("[a-z0-9]")).select(*columns, "text"), "text", make).drop("text")


def dense_list(chunks: DataFrame, queries: DataFrame, k: int = SETTINGS.top_k, make: Callable[[], Embedder] = HashEmbedder, vectors: DataFrame | None = None, within: str | None = None, **filters) -> DataFrame:
    """(query_id, chunk_id, score, rank): the candidates of each query (query_id, query) by cosine; filtered before they are ranked."""
    allowed = metadata_filter(unique(chunks, "chunk_id"), **filters)
    columns = ["chunk_id", *([within] if within else [])]
    rows = vectors.join(allowed.select(columns), "chunk_id") if vectors is not None else _embedded(allowed, make, columns)
    # Models that are trained so put words before a query, never before a passage.
    ahead = getattr(make(), "query_prefix", "")
    asked = queries.where(F.size(X.terms("query")) > 0)
    asked = embed(asked.withColumn("query", F.concat(F.lit(ahead), "query")) if ahead else asked, "query", make)
    return dense_scores(rows, asked, pool_size(k), key="chunk_id", within=within)


def fuse(first: DataFrame, second: DataFrame, k: int = SETTINGS.rrf_k, weights: tuple[float, float] = (1.0, 1.0), key: str = "chunk_id") -> DataFrame:
    """(query_id, key, rrf_score, rank): reciprocal-rank fusion of two ranked lists; ties by first, then second list."""
    a = first.select("query_id", key, F.col("rank").alias("rank_a"))
    b = second.select("query_id", key, F.col("rank").alias("rank_b"))
    both = a.join(b, ["query_id", key], "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part(weights[0], "rank_a") + part(weights[1], "rank_b"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"), key)
    return both.withColumn("rank", F.row_number().over(order))


def expansion_terms(spark: SparkSession, definitions: DataFrame | None = None) -> DataFrame:
    """(key, hints, ord): field names lead to their hints, hints to their field and its other hints; the first use of a key holds."""
    d = definitions if definitions is not None else field_definitions(spark)
    own = d.select(F.lower(F.trim("field_name")).alias("key"), F.slice("hints", 1, 3).alias("hints"), (F.col("field_ord") * 1000).alias("ord"), F.lit(0).alias("level"))
    sib = d.select("field_name", "field_ord", "hints", F.posexplode("hints").alias("pos", "hint"))
    sib = sib.select(F.lower(F.trim("hint")).alias("key"), F.slice(F.concat(F.array("field_name"), F.array_remove("hints", F.col("hint"))), 1, 3).alias("hints"), (F.col("field_ord") * 1000 + F.col("pos") + 1).alias("ord"), F.lit(1).alias("level"))
    first = Window.partitionBy("key").orderBy("level", "ord")
    return own.unionByName(sib).withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "hints", "ord")


def expand(queries: DataFrame, expansion: DataFrame) -> DataFrame:
    """Adds ``expanded``: the query and the first four hints, in order of definition, of the terms in it that it lacks.

    The expansion terms come from the configuration, a table of bounded size.
    """
    listed = expansion.agg(F.sort_array(F.collect_list(F.struct("ord", "key", "hints"))).alias("__all"))
    q = F.lower("query")
    words = F.concat(F.lit(" "), F.regexp_replace(q, r"[^a-z0-9]+", " "), F.lit(" "))
    norm = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"[^a-z0-9]+", " "), F.lit(" "))
    hit = F.filter("__all", lambda e: words.contains(norm(e["key"])) & q.contains(e["key"]))
    hints = F.array_distinct(F.flatten(F.transform(hit, lambda e: e["hints"])))
    fresh = F.slice(F.filter(hints, lambda h: ~q.contains(F.lower(h))), 1, 4)
    out = queries.crossJoin(F.broadcast(listed)).withColumn("expanded", F.when(F.coalesce("query", F.lit("")) == "", "").otherwise(F.concat_ws(" ", F.array("query"), fresh)))
    return out.drop("__all")


def rerank(candidates: DataFrame, score: Column, k: int = SETTINGS.top_k) -> DataFrame:
    """The k best candidates of each query by a provider's score column."""
    return top_k(candidates.withColumn("rerank_score", F.round(score, 6)), k, score="rerank_score")


def overlap_score(query: str = "query", text: str = "text") -> Column:
    """Offline default of a reranker: share of the query's terms in the text."""
    q, t = F.array_distinct(X.terms(query)), F.array_distinct(X.terms(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))


def model_score(make: Callable[[], Reranker], query: str = "query", text: str = "text") -> Column:
    """Scores of a provider's model for (query, text) pairs; the model is made once per worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series(model.scores([(a or "", b or "") for a, b in zip(q, t)]), dtype="float64")

    return run(F.col(query), F.col(text))


def shown_score(rerank_score: str = "rerank_score", rrf_score: str = "rrf_score") -> Column:
    """The score a result goes on with: that of the reranker, or the fusion's where the reranker gave none or 0."""
    return F.coalesce(F.nullif(F.col(rerank_score), F.lit(0.0)), F.col(rrf_score))


def pool_size(k: int | None) -> int:
    """How many candidates each list gives to a fusion."""
    return max(SETTINGS.candidate_pool, 2 * (k or SETTINGS.top_k))


#: Candidates of all queries are broadcast up to this number (some 20 MB), beyond it joined by a shuffle.
BROADCAST_RESULTS = 200_000
MODES = ("bm25_only", "dense_only", "hybrid_norerank", "hybrid")


def search(chunks: DataFrame, queries: DataFrame, k: int = SETTINGS.top_k, mode: str = "bm25_only", index: SparseIndex | None = None, dense: DataFrame | None = None, expand_query: bool = True, weights: tuple[float, float] = (1.0, 1.0), make: Callable[[], Embedder] = HashEmbedder, make_reranker: Callable[[], Reranker] | None = None, **filters) -> DataFrame:
    """Ranked results of all queries, with text and citation.

    ``dense`` is a ranked list (query_id, chunk_id, score, rank) from an embedding provider; where a mode needs one and none is
    given, it is ``dense_list`` by the provider's default with the same filters.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    pool = pool_size(k)
    index = index or build_index(chunks)
    known = unique(chunks, "chunk_id")
    allowed = metadata_filter(known, **filters).select("chunk_id")
    asked = expand(queries, expansion_terms(chunks.sparkSession)).select("query_id", F.col("expanded").alias("query")) if expand_query else queries
    sparse = bm25_top(index, asked, pool, **filters)
    if mode != "bm25_only" and dense is None:
        dense = dense_list(spread(known), queries, k, make, **filters)
    if mode == "bm25_only":
        ranked = sparse.select("query_id", "chunk_id", F.col("score").alias("rrf_score"), "rank")
    elif mode == "dense_only":
        ranked = dense.join(allowed, "chunk_id", "left_semi").select("query_id", "chunk_id", F.col("score").alias("rrf_score"), "rank")
    else:
        ranked = fuse(sparse, dense.join(allowed, "chunk_id", "left_semi"), weights=weights).where(F.col("rank") <= pool).select("query_id", "chunk_id", "rrf_score", "rank")
    # A few candidates of each query: texts are read for them, not shuffled.
    ranked = stage(ranked)
    ranked = F.broadcast(ranked) if ranked.count() <= BROADCAST_RESULTS else ranked
    cols = ["chunk_id", "text", "file_name", "page_number", "page_start", "page_end", "section", "bid_id", "doc_type"]
    out = known.select(*cols).join(ranked, "chunk_id").join(queries, "query_id")
    if mode == "hybrid":
        out = rerank(out, overlap_score() if make_reranker is None else model_score(make_reranker), k or SETTINGS.top_k)
    else:
        out = out.withColumn("rerank_score", F.lit(0.0))
    return projected(out.where(F.col("rank") <= (k or SETTINGS.top_k)))


def projected(found: DataFrame) -> DataFrame:
    """Results as they are given out, with text and citation."""
    start = F.coalesce("page_start", "page_number")
    return found.select("query_id", "rank", "chunk_id", "bid_id", "file_name", "doc_type", F.round("rrf_score", 6).alias("rrf_score"), F.round("rerank_score", 4).alias("rerank_score"), X.citation("file_name", start, F.coalesce("page_end", "page_number"), "section").alias("citation"), "text")


def search_within(chunks: DataFrame, queries: DataFrame, k: int = SETTINGS.top_k, index: SparseIndex | None = None, make: Callable[[], Embedder] = HashEmbedder, vectors: DataFrame | None = None, **filters) -> DataFrame:
    """(bid_id, query_id, chunk_id, rank, rrf_score, rerank_score): the hybrid search of every query in each package on its own."""
    known = unique(chunks.where("bid_id is not null"), "chunk_id")
    allowed = metadata_filter(known, **filters)
    slot = F.struct("bid_id", "query_id").alias("query_id")
    asked = expand(queries, expansion_terms(chunks.sparkSession)).select("query_id", F.col("expanded").alias("query"))
    sparse = bm25_top(index or build_index(chunks), asked, pool_size(k), "bid_id", **filters).where("bid_id is not null").select(slot, "chunk_id", "score", "rank")
    dense = dense_list(known, queries, k, make, vectors, "bid_id", **filters).select(slot, "chunk_id", "rank")
    fused = fuse(sparse, dense).where(F.col("rank") <= pool_size(k)).select("query_id.*", "chunk_id", "rrf_score")
    pairs = fused.join(known.select("chunk_id", "text"), "chunk_id").join(F.broadcast(queries.select("query_id", "query")), "query_id")
    best = top_k(pairs.withColumn("rerank_score", F.round(overlap_score(), 6)), k, by=["bid_id", "query_id"], score="rerank_score")
    return best.select("bid_id", "query_id", "chunk_id", "rank", "rrf_score", "rerank_score")


def route_by_sum(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, bid_id, total): the package with the highest sum of a query's eight best scores."""
    best = bm25_top(build_index(chunks), queries, 8).join(chunks.select("chunk_id", "bid_id").where("bid_id is not null").distinct(), "chunk_id")
    per = best.groupBy("query_id", "bid_id").agg(F.round(F.sum("score"), 4).alias("total"))
    return top_k(per.where("total > 0.1"), 1, "bid_id", score="total").select("query_id", "bid_id", "total")


def relevant(target: str = "target_substring", file: str = "expected_file", page: str = "expected_page") -> Column:
    """Whether a result (text, file_name, page_start, page_end, page_number) is what a benchmark item looks for: its text, either file name in the other, and its page in the range."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    named = low("file_name").contains(low(file)) | low(file).contains(low("file_name"))
    first = F.coalesce(F.nullif("page_start", F.lit(0)), F.col("page_number"))
    last = F.coalesce(F.nullif("page_end", F.lit(0)), F.col("page_number"))
    return F.coalesce(low("text").contains(low(target)) & named & F.col(page).between(first, last), F.lit(False))


#: Lengths of the pieces by which names meet; a name takes the first that isn't longer than itself.
PIECES = (8, 4, 2, 1, 0)
#: Names whose pieces are broadcast (some 20 MB), and items; beyond that both are joined by a shuffle.
BROADCAST_NAMES, BROADCAST_ITEMS = 10_000, 200_000


def _pieces(name: str, n: int) -> Column:
    """The distinct pieces of length ``n`` of a name, hashed; none of a shorter name."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1)))
    found = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.lit(n), F.col(name).substr(i, F.lit(n)))))
    return F.when(F.length(name) >= n, found).otherwise(F.array().cast("array<bigint>"))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): each ``name`` of the first table with all names of the second that it is part of.

    A name meets only those that have its rarest piece; one with a piece that none of them has is part of none.
    """
    size = F.coalesce(*[F.when(F.length("name") >= n, n) for n in PIECES])
    used = [r.n for r in inner.select(size.alias("n")).distinct().collect()]
    own = inner.select(F.col("name").alias("inner"), F.explode(F.coalesce(*[F.when(size == n, _pieces("name", n)) for n in PIECES])).alias("piece"))
    every = outer.select(F.col("name").alias("outer"), F.explode(F.concat(F.array().cast("array<bigint>"), *[_pieces("name", n) for n in used])).alias("piece"))
    few, few_outer = inner.count() <= BROADCAST_NAMES, outer.count() <= BROADCAST_NAMES
    asked = every.join(F.broadcast(own.select("piece").distinct()), "piece", "left_semi") if few else every
    counts = asked.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(F.broadcast(counts) if few or few_outer else counts, "piece", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = stage(counted.groupBy("inner").agg(F.min_by("piece", "n").alias("piece"), F.min("n").alias("n")).where("n > 0").select("inner", "piece"))
    side = F.broadcast(rarest) if rarest.count() <= BROADCAST_ITEMS else rarest
    return every.join(side, "piece").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def _to_compare(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items beside the chunks whose texts must be compared with theirs: one file name is in the other, and the page is near.

    Distinct names meet first. A chunk lies in the one or two blocks of 2^level pages that its range touches, where 2^level is
    above the difference of its pages; an item looks in its page's block of every level that the file has.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    first = F.coalesce(F.nullif("page_start", F.lit(0)), F.col("page_number")).cast("bigint")
    last = F.coalesce(F.nullif("page_end", F.lit(0)), F.col("page_number")).cast("bigint")
    level = F.when(last > first, F.length(F.bin(last - first))).otherwise(0)
    spans = chunks.where(first <= last).select("file_name", "page_start", "page_end", "page_number", "text", low("file_name").alias("name"), level.alias("level"), first.alias("first"), last.alias("last"))
    own = items.where("expected_page is not null").withColumn("asked", low("expected_file"))
    names, asked = stage(spans.groupBy("name").agg(F.collect_set("level").alias("levels"))), stage(own.select(F.col("asked").alias("name")).distinct())
    pairs = _contained(asked, names).toDF("asked", "name").unionByName(_contained(names, asked).toDF("name", "asked")).distinct()
    wanted = own.join(pairs, "asked").join(names, "name").withColumn("level", F.explode("levels"))
    wanted = stage(wanted.withColumn("block", F.expr("shiftright(cast(expected_page as bigint), level)")).drop("asked", "levels"))
    spans = spans.withColumn("block", F.explode(F.expr("array_distinct(array(shiftright(first, level), shiftright(last, level)))"))).drop("first", "last")
    return spans.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ITEMS else wanted, ["name", "level", "block"])


def findable(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, is_findable): whether any chunk is relevant to an item (query_id, target_substring, expected_file, expected_page).

    Items meet chunks by file name and page, so the texts compared are those of one page of the files meant.
    """
    own = stage(items.select("query_id", "target_substring", "expected_file", "expected_page"))
    hits = _to_compare(own, chunks).where(relevant()).select("query_id").distinct().withColumn("is_findable", F.lit(True))
    return own.select("query_id").distinct().join(hits, "query_id", "left").withColumn("is_findable", F.coalesce("is_findable", F.lit(False)))


def report_json(measured: DataFrame, **labels: str) -> DataFrame:
    """(report): a JSON line per row of metrics, with labels such as the mode."""
    return measured.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in labels.items()], *[F.col(c) for c in measured.columns])).alias("report"))


def metrics(results: DataFrame, relevant: Column, queries: DataFrame) -> DataFrame:
    """Recall at 1, 3 and 5 and mean reciprocal rank over all queries; a query without a relevant result counts 0."""
    best = results.where(relevant).groupBy("query_id").agg(F.min("rank").alias("best"))
    per = queries.select("query_id").distinct().join(best, "query_id", "left")
    at = lambda n: F.round(F.avg(F.when(F.col("best") <= n, 1.0).otherwise(0.0)), 4).alias(f"recall_{n}")
    return per.agg(F.count(F.lit(1)).alias("n_queries"), at(1), at(3), at(5), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 4).alias("mrr"))


# Queries on the given tables. The queries of a search are every file whose id is divisible by 50, by name.


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), F.regexp_replace("file_name", r"\.[A-Za-z]+$", "").alias("query"), F.col("bid_id").alias("own_bid"), F.col("file_name").alias("own_file"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "text", "context_header", "bid_id", "file_name", "doc_type", "addendum_number", "is_table", "section")


def q_terms(spark: SparkSession, d: str) -> DataFrame:
    index = build_index(_chunks(spark, d))
    return index.postings.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


def q_corpus(spark: SparkSession, d: str) -> DataFrame:
    return build_index(_chunks(spark, d)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"), "vocabulary", F.round("avg_idf", 6).alias("avg_idf"))


def q_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_top(build_index(_chunks(spark, d)), _files(spark, d), 10).select("query_id", "rank", "chunk_id", "score")


def q_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every field's name and first hints as a query over all chunks outside addenda."""
    definitions = field_definitions(spark)
    asked = definitions.select(F.col("field_ord").alias("query_id"), F.concat_ws(" ", F.array("field_name"), F.slice("hints", 1, 3)).alias("query"))
    chunks = _chunks(spark, d)
    best = bm25_top(build_index(chunks), asked, SETTINGS.top_k, exclude_doc_type="addendum")
    return best.join(F.broadcast(definitions.select(F.col("field_ord").alias("query_id"), "field_name")), "query_id").select("field_name", "rank", "chunk_id", "score")


def q_filtered(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return bm25_top(build_index(chunks), _files(spark, d), 10, exclude_doc_type="addendum", is_table=False).select("query_id", "rank", "chunk_id", "score")


def _two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks, q = _chunks(spark, d), _files(spark, d)
    a = bm25_top(build_index(chunks), q, 20)
    b = bm25_top(build_index(chunks.where("context_header is not null"), "context_header"), q, 20)
    return a, b


def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fuse(*_two_lists(spark, d)).where("rank <= 20").select("query_id", "rank", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"))


def q_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fuse(*_two_lists(spark, d), weights=(0.7, 0.3)).where("rank <= 20").select("query_id", "rank", "chunk_id", F.round("rrf_score", 6).alias("rrf_score"))


def q_route(spark: SparkSession, d: str) -> DataFrame:
    return route_by_sum(_chunks(spark, d), _files(spark, d)).select("query_id", F.col("bid_id").alias("routed_bid"), "total")


def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    chunks, q = _chunks(spark, d), _files(spark, d)
    best = bm25_top(build_index(chunks), q, 5).join(chunks.select("chunk_id", "file_name").distinct(), "chunk_id").join(q.select("query_id", "own_file"), "query_id")
    return metrics(best, F.col("file_name") == F.col("own_file"), q)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items from chunks: of every file whose id is divisible by 50 its first chunk's last 60 characters, every third with a letter put in."""
    files = table(spark, d, "source_files").where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), "bid_id", "file_name")
    side = F.broadcast(files) if files.count() <= BROADCAST_ITEMS else files
    own = table(spark, d, "chunks").where("length(text) > 80").join(side, ["bid_id", "file_name"]).groupBy("query_id", "file_name").agg(F.min_by(F.struct("text", "page_number"), "chunk_id").alias("c"))
    tail = F.substring("c.text", -60, 60)
    return own.select("query_id", F.when(F.col("query_id") % 3 == 0, F.concat(tail, F.lit("#"))).otherwise(tail).alias("target_substring"), F.col("file_name").alias("expected_file"), F.col("c.page_number").alias("expected_page"))


def q_findable(spark: SparkSession, d: str) -> DataFrame:
    return findable(_items(spark, d), table(spark, d, "chunks"))


def q_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """The items searched by their own text, judged by text, file and page."""
    items, chunks = _items(spark, d), table(spark, d, "chunks")
    best = bm25_top(build_index(chunks), items.select("query_id", F.col("target_substring").alias("query")), 5)
    found = best.join(chunks.select("chunk_id", "text", "file_name", "page_start", "page_end", "page_number").dropDuplicates(["chunk_id"]), "chunk_id").join(items, "query_id")
    return metrics(found, relevant(), items)


def q_dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dense_scores(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10).select("query_id", "rank", "vec_id", "score")


def q_expand(spark: SparkSession, d: str) -> DataFrame:
    """The expansion of every field's description of itself as a query."""
    names = table(spark, d, "field_outputs").select(F.col("output_id").alias("query_id"), F.col("field_name").alias("query")).dropDuplicates(["query_id"])
    return expand(names, expansion_terms(spark)).select("query_id", "expanded")


def q_search(spark: SparkSession, d: str) -> DataFrame:
    chunks, q = table(spark, d, "chunks"), _files(spark, d).select("query_id", "query")
    return search(chunks, q, 5, "hybrid", exclude_doc_type="addendum").drop("text")


_T = r"""
d as (select chunk_id, any_value({text}) tx from chunks where {where} group by 1),
t0 as (select chunk_id, unnest(regexp_extract_all(lower(tx), '[a-z0-9]+(?:[-_.@][a-z0-9]+)*')) t from d),
t1 as (select *, regexp_extract_all(t, '[a-z]+|[0-9]+') r from t0),
tk as (select chunk_id, t term from t1 union all
  select chunk_id, unnest(list_distinct(list_concat(list_filter(string_split_regex(t, '[-_.@]+'), lambda x: x <> '' and x <> t), case when len(r) between 2 and 4 then list_filter(r, lambda x: len(x) >= 2 and x <> t) else [] end))) from t1),
po as (select term, chunk_id, count(*) tf from tk group by 1, 2),
dl as (select chunk_id, count(term) dl from d left join tk using (chunk_id) group by 1),
cs as (select count(*) n, avg(dl) avgdl from dl),
ts0 as (select term, count(*) df, sum(tf) occurrences, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) raw from po, cs group by 1),
ts as (select term, df, occurrences, case when raw < 0 then 0.25 * (select avg(raw) from ts0) else raw end idf from ts0)
"""
_Q = r"""
q as (select file_id query_id, regexp_replace(file_name, '\.[A-Za-z]+$', '') qx, bid_id own_bid, file_name own_file from source_files where file_id % 50 = 0),
q0 as (select query_id, unnest(regexp_extract_all(lower(qx), '[a-z0-9]+(?:[-_.@][a-z0-9]+)*')) t from q),
q1 as (select *, regexp_extract_all(t, '[a-z]+|[0-9]+') r from q0),
qk as (select query_id, t term from q1 union all
  select query_id, unnest(list_distinct(list_concat(list_filter(string_split_regex(t, '[-_.@]+'), lambda x: x <> '' and x <> t), case when len(r) between 2 and 4 then list_filter(r, lambda x: len(x) >= 2 and x <> t) else [] end))) from q1),
qt as (select query_id, term, count(*) qtf from qk group by 1, 2),
sc as (select * from (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from qt join ts using (term) join po using (term) join dl using (chunk_id), cs group by 1, 2) where score > 0)
"""


def _sql(text: str = "text", where: str = "true", names: str = "") -> str:
    import re

    body = _T.replace("{text}", text).replace("{where}", where) + "," + _Q
    if names:  # a second set of the same tables
        for n in ("d", "t0", "t1", "tk", "po", "dl", "cs", "ts0", "ts", "q", "q0", "q1", "qk", "qt", "sc"):
            body = re.sub(rf"(?m)^{n} as", f"{n}{names} as", body)
            body = re.sub(rf"\b(from|join) {n}\b", rf"\1 {n}{names}", body)
            body = re.sub(rf", {n}\b(?= group)", f", {n}{names}", body)
    return body


def _expansions() -> str:
    """The expansion table as SQL rows, made without Spark."""
    rows: dict[str, tuple[int, list[str]]] = {}
    for i, (name, _, hints) in enumerate(FIELDS):
        rows.setdefault(name.lower(), (i * 1000, hints[:3]))
    for i, (name, _, hints) in enumerate(FIELDS):
        for k, h in enumerate(hints):
            rows.setdefault(h.lower(), (i * 1000 + k + 1, [name, *(x for x in hints if x != h)][:3]))
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join(f"({quoted(k)}, {o}, [{', '.join(map(quoted, h))}])" for k, (o, h) in rows.items()) + ")"


#: CTEs from q (query_id, qx) to xp (query_id, ex), the expanded queries.
_EXPAND = rf"""
xt(key, ord, hints) as {_expansions()},
x0 as (select *, lower(coalesce(qx, '')) ql, ' ' || regexp_replace(lower(coalesce(qx, '')), '[^a-z0-9]+', ' ', 'g') || ' ' w from q),
x1 as (select query_id, ql, ord, unnest(hints) h, generate_subscripts(hints, 1) j from x0 join xt on contains(ql, key) and contains(w, ' ' || regexp_replace(key, '[^a-z0-9]+', ' ', 'g') || ' ')),
x2 as (select query_id, h, min(ord * 10 + j) o from x1 where not contains(ql, lower(h)) group by 1, 2 qualify row_number() over (partition by query_id order by min(ord * 10 + j)) <= 4),
xp as (select query_id, case when coalesce(qx, '') = '' then '' else qx || coalesce(' ' || (select string_agg(h, ' ' order by o) from x2 where x2.query_id = q.query_id), '') end ex from q)"""


def _terms_of(source: str, key: str, text: str, name: str) -> str:
    return rf"""{name}0 as (select {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+(?:[-_.@][a-z0-9]+)*')) t from {source}),
{name}1 as (select *, regexp_extract_all(t, '[a-z]+|[0-9]+') r from {name}0),
{name} as (select {key}, t term from {name}1 union all
  select {key}, unnest(list_distinct(list_concat(list_filter(string_split_regex(t, '[-_.@]+'), lambda x: x <> '' and x <> t), case when len(r) between 2 and 4 then list_filter(r, lambda x: len(x) >= 2 and x <> t) else [] end))) from {name}1)"""


def _vectors(source: str, key: str, text: str, name: str) -> str:
    """CTEs up to ``name`` (key, p, v): the places of the hashed word vectors of ``source`` that aren't 0."""
    return rf"""{name}w as (select {key}, md5_number_upper(unnest(regexp_extract_all(lower({text}), '[a-z0-9]+'))) h from {source}),
{name}n as (select {key}, cast((h >> 56) & 63 as integer) p, sum(case when (h >> 24) & 1 = 1 then 1 else -1 end) n from {name}w group by 1, 2),
{name} as (select {key}, p, cast(cast(cast(n as float) / cast(sqrt(sum(n * n) over (partition by {key})) as float) as float) as double) v from {name}n where n <> 0)"""


_ITEMS = """fi as (select f.file_id query_id, f.file_name, arg_min({'t': text, 'p': page_number}, chunk_id) c from source_files f join chunks c using (bid_id, file_name) where f.file_id % 50 = 0 and length(text) > 80 group by 1, 2),
it as (select query_id, right(c.t, 60) || case when query_id % 3 = 0 then '#' else '' end target_substring, file_name expected_file, c.p expected_page from fi)"""
_RELEVANT = "contains(lower(coalesce(c.text, '')), lower(target_substring)) and (contains(lower(coalesce(c.file_name, '')), lower(expected_file)) or contains(lower(expected_file), lower(coalesce(c.file_name, '')))) and coalesce(expected_page between coalesce(nullif(c.page_start, 0), c.page_number) and coalesce(nullif(c.page_end, 0), c.page_number), false)"

_CHUNK_META = "m as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(doc_type) doc_type, any_value(is_table) is_table from chunks group by 1)"
_RRF = (
    "with " + _sql() + "," + _sql("context_header", "context_header is not null", "_h") + """,
a as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from sc) where rank <= 20),
b as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from sc_h) where rank <= 20),
f as (select query_id, chunk_id, a.rank ra, b.rank rb, round(coalesce({wa} / (60 + a.rank), 0) + coalesce({wb} / (60 + b.rank), 0), 9) s from a full outer join b using (query_id, chunk_id)),
g as (select *, row_number() over (partition by query_id order by s desc, ra nulls last, rb nulls last, chunk_id) rank from f)
select query_id, cast(rank as integer) rank, chunk_id, round(s, 6) rrf_score from g where rank <= 20"""
)
_TOP = "select query_id, cast(rank as integer) rank, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from {src}) where rank <= {k}"

QUERIES = {
    "bm25_topk": q_topk,
    "field_search": q_fields,
    "bm25_filtered": q_filtered,
    "tokenize_terms": q_terms,
    "corpus_stats": q_corpus,
    "rrf_fusion": q_rrf,
    "weighted_rrf": q_weighted,
    "route_by_score_sum": q_route,
    "retrieval_metrics": q_metrics,
    "dense_topk": q_dense,
    "benchmark_items": q_findable,
    "benchmark_metrics": q_benchmark,
    "query_expansion": q_expand,
    "hybrid_search": q_search,
}
SQL = {
    "tokenize_terms": "with " + _T.replace("{text}", "text").replace("{where}", "true") + " select term, cast(occurrences as bigint) occurrences, df from ts0",
    "corpus_stats": "with " + _T.replace("{text}", "text").replace("{where}", "true") + " select n, round(avgdl, 6) avgdl, (select count(*) from ts0) vocabulary, (select round(avg(raw), 6) from ts0) avg_idf from cs",
    "bm25_topk": "with " + _sql() + _TOP.replace("{src}", "sc").replace("{k}", "10"),
    "bm25_filtered": "with " + _sql() + "," + _CHUNK_META + ", k as (select sc.* from sc join m using (chunk_id) where lower(coalesce(doc_type, '')) <> 'addendum' and is_table = false) " + _TOP.replace("{src}", "k").replace("{k}", "10"),
    "rrf_fusion": _RRF.replace("{wa}", "1.0").replace("{wb}", "1.0"),
    "weighted_rrf": _RRF.replace("{wa}", "0.7").replace("{wb}", "0.3"),
    "route_by_score_sum": "with " + _sql() + "," + _CHUNK_META + """, b as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from sc) where rank <= 8),
p as (select query_id, bid_id, round(sum(score), 4) total from b join m using (chunk_id) where bid_id is not null group by 1, 2)
select query_id, bid_id routed_bid, total from p where total > 0.1 qualify row_number() over (partition by query_id order by total desc, bid_id) = 1""",
    "retrieval_metrics": "with " + _sql() + "," + _CHUNK_META + """, b as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id) rank from sc) where rank <= 5),
r as (select q.query_id, min(rank) best from q left join (select b.query_id, b.rank, file_name from b join m using (chunk_id)) x on x.query_id = q.query_id and x.file_name = q.own_file group by 1)
select count(*) n_queries, round(avg(case when best <= 1 then 1.0 else 0.0 end), 4) recall_1, round(avg(case when best <= 3 then 1.0 else 0.0 end), 4) recall_3, round(avg(case when best <= 5 then 1.0 else 0.0 end), 4) recall_5, round(avg(coalesce(1.0 / best, 0.0)), 4) mrr from r""",
    "query_expansion": "with q as (select distinct output_id query_id, field_name qx from field_outputs), " + _EXPAND + " select query_id, ex expanded from xp",
    "hybrid_search": "with " + _T.replace("{text}", "text").replace("{where}", "true") + r""",
q as (select file_id query_id, regexp_replace(file_name, '\.[A-Za-z]+$', '') qx from source_files where file_id % 50 = 0),""" + _EXPAND + "," + _terms_of("q", "query_id", "qx", "qk") + "," + _terms_of("xp", "query_id", "ex", "ek") + r""",
m as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(doc_type) doc_type, coalesce(any_value(page_start), any_value(page_number)) ps, coalesce(any_value(page_end), any_value(page_number)) pe, any_value(section) section from chunks group by 1),
al as (select * from m where lower(coalesce(doc_type, '')) <> 'addendum'),
s1 as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from (select query_id, term, count(*) qtf from ek group by 1, 2) join ts using (term) join po using (term) join dl using (chunk_id), cs group by 1, 2),
a as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) rank from s1 join al using (chunk_id) where score > 0 qualify rank <= 20),
""" + _vectors("(select chunk_id, tx from d where chunk_id in (select chunk_id from tk))", "chunk_id", "tx", "cv") + "," + _vectors("(select * from q where query_id in (select query_id from qk))", "query_id", "qx", "qv") + r""",
c1 as (select query_id, chunk_id, round(sum(qv.v * cv.v), 6) score from qv join cv using (p) join al using (chunk_id) group by 1, 2),
c2 as (select query_id, chunk_id, coalesce(score, 0.0) score from (select distinct query_id from qk) cross join (select chunk_id from al where chunk_id in (select chunk_id from tk)) left join c1 using (query_id, chunk_id)),
b as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) rank from c2 qualify rank <= 20),
f as (select query_id, chunk_id, a.rank ra, b.rank rb, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) rrf from a full outer join b using (query_id, chunk_id)),
g as (select * from f qualify row_number() over (partition by query_id order by rrf desc, ra nulls last, rb nulls last, chunk_id) <= 20),
o as (select query_id, chunk_id, count(*) n from g join (select distinct query_id, term from qk) using (query_id) join (select distinct chunk_id, term from tk) using (chunk_id, term) group by 1, 2),
r as (select g.*, round(coalesce(n, 0) / (select count(distinct term) from qk where qk.query_id = g.query_id), 6) rr from g left join o using (query_id, chunk_id))
select query_id, cast(row_number() over (partition by query_id order by rr desc, chunk_id) as integer) rank, chunk_id, bid_id, file_name, doc_type, round(rrf, 6) rrf_score, round(rr, 4) rerank_score,
coalesce(file_name, '') || ' (' || coalesce('p.' || ps || case when pe <> ps then '-' || pe else '' end, 'p.?') || case when coalesce(section, '') <> '' then ' | Section: ' || section else '' end || ')' citation from r join m using (chunk_id) qualify rank <= 5""",
    "field_search": "with " + _T.replace("{text}", "text").replace("{where}", "true") + ", q(query_id, field_name, qx) as (values " + ", ".join(f"({i}, '{n}', '{' '.join([n, *h[:3]])}')" for i, (n, _, h) in enumerate(FIELDS)) + ")," + _terms_of("q", "query_id", "qx", "qk") + """,
al as (select chunk_id from chunks group by 1 having lower(coalesce(any_value(doc_type), '')) <> 'addendum'),
sc as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from (select query_id, term, count(*) qtf from qk group by 1, 2) join ts using (term) join po using (term) join dl using (chunk_id), cs group by 1, 2)
select field_name, cast(row_number() over (partition by query_id order by score desc, chunk_id) as integer) rank, chunk_id, score from sc join al using (chunk_id) join q using (query_id) where score > 0 qualify rank <= 5""",
    "benchmark_items": f"with {_ITEMS} select query_id, coalesce(bool_or({_RELEVANT}), false) is_findable from it, chunks c group by 1",
    "benchmark_metrics": "with " + _T.replace("{text}", "text").replace("{where}", "true") + f", {_ITEMS}, " + _terms_of("it", "query_id", "target_substring", "qk") + f""",
sc as (select query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from (select query_id, term, count(*) qtf from qk group by 1, 2) join ts using (term) join po using (term) join dl using (chunk_id), cs group by 1, 2),
b as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) rank from sc where score > 0 qualify rank <= 5),
c as (select chunk_id, any_value(text) as text, any_value(file_name) file_name, any_value(page_start) page_start, any_value(page_end) page_end, any_value(page_number) page_number from chunks group by 1),
r as (select it.query_id, min(rank) filter (where {_RELEVANT}) best from it left join b using (query_id) left join c using (chunk_id) group by 1)
select count(*) n_queries, round(avg(case when best <= 1 then 1.0 else 0.0 end), 4) recall_1, round(avg(case when best <= 3 then 1.0 else 0.0 end), 4) recall_3, round(avg(case when best <= 5 then 1.0 else 0.0 end), 4) recall_5, round(avg(coalesce(1.0 / best, 0.0)), 4) mrr from r""",
    "dense_topk": """with q as (select vec_id query_id, embedding e from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_dot_product(cast(e as double[]), cast(embedding as double[])), 6) score from q join embeddings on vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 10""",
}
