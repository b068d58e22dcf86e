"""Incremental index: content hashes, manifest diff, eviction, upsert, statistics, storage.

The manifest has a row per file (path, file_name, hash, mtime, chunk_ids). Files that are gone are evicted too.
Defined results: a null content has the hash of the empty one; of repeated rows of a path the latest holds.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators.retrieve import SparseIndex, build_index
from bidweave.session import table

#: Micro-seconds of a time without zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {})"
MANIFEST = "path string, file_name string, hash string, mtime double, chunk_ids array<string>"


def content_hash(column: str = "content"):
    return F.sha2(F.coalesce(column, F.lit("").cast("binary")), 256)


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status, hash, old_chunk_ids): new, modified, unchanged or deleted."""
    old = manifest.select("path", F.col("hash").alias("old_hash"), F.col("chunk_ids").alias("old_chunk_ids"))
    both = files.select("path", "hash", F.lit(True).alias("here")).join(old, "path", "full_outer")
    status = F.when(F.col("here").isNull(), "deleted").when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("hash"), "modified").otherwise("unchanged")
    return both.select("path", status.alias("status"), "hash", "old_chunk_ids")


def evict(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks without those of modified and deleted files."""
    gone = changes.where(F.col("status").isin("modified", "deleted")).select(F.explode("old_chunk_ids").alias("chunk_id"))
    return chunks.join(gone, "chunk_id", "left_anti")


def upsert(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of the same id replaced."""
    return chunks.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def record(manifest: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The manifest after changes: rows of changed files replaced, of deleted files left out."""
    touched = changes.where("status <> 'unchanged'").select("path")
    return manifest.join(touched, "path", "left_anti").unionByName(fresh)


def tracked(manifest: DataFrame) -> DataFrame:
    """(chunk_id): the ids of all chunks that the manifest's files have."""
    return manifest.select(F.explode("chunk_ids").alias("chunk_id")).distinct()


# Versions: an index is what its highest version names. Data go to new folders first, then one small file commits them, so
# a crash leaves the version before it.


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, index_dir: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    p, system = _file_system(spark, f"{index_dir}/versions")
    if not system.exists(p):
        return []
    names = [f.getPath().getName() for f in system.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_version(spark: SparkSession, index_dir: str, number: int | None = None) -> dict:
    """What a version names (the highest if no number is given): ``parts`` by name and bucket, and its counts; empty without versions."""
    have = versions(spark, index_dir)
    if not have:
        return {"number": 0, "parts": {}}
    p, system = _file_system(spark, f"{index_dir}/versions/{number or have[-1]}.json")
    stream = system.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, index_dir: str, version: dict) -> None:
    """Makes a version the current one: its file is written aside and renamed."""
    final, system = _file_system(spark, f"{index_dir}/versions/{version['number']}.json")
    aside, _ = _file_system(spark, f"{index_dir}/versions/_{version['number']}.tmp")
    out = system.create(aside, True)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    system.delete(final, False)
    if not system.rename(aside, final):
        raise OSError(f"version {version['number']} of {index_dir} couldn't be committed")


def save(index_dir: str, chunks: DataFrame, manifest: DataFrame) -> int:
    """Writes all parts as a new version and makes it the current one; gives its number."""
    spark = chunks.sparkSession
    number = read_version(spark, index_dir)["number"] + 1
    to, index = f"{index_dir}/data/{number}", build_index(chunks)
    parts = {"chunks": chunks, "rows": index.rows, "term_stats": index.term_stats, "corpus": index.corpus, "manifest": manifest}
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{to}/{name}")
    commit(spark, index_dir, {"number": number, "parts": {name: {"all": f"{to}/{name}"} for name in parts}})
    return number


def load(spark: SparkSession, index_dir: str, name: str, schema: str | None = None, buckets: list[str] | None = None) -> DataFrame:
    """A part of the current version, or only some of its buckets; an empty frame where it is missing."""
    paths = read_version(spark, index_dir)["parts"].get(name, {})
    kept = [p for b, p in paths.items() if buckets is None or b in buckets]
    if kept:
        return (spark.read.schema(schema) if schema else spark.read).parquet(*kept)
    if schema is None:
        raise FileNotFoundError(f"{index_dir}: {name}")
    return spark.createDataFrame([], schema)


def stored_index(spark: SparkSession, index_dir: str) -> SparseIndex:
    """The sparse index of the current version."""
    return SparseIndex(*(load(spark, index_dir, n) for n in ("rows", "term_stats", "corpus")))


def stats(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: files, chunks, packages; chunks with terms, which have a vector each."""
    has_terms = F.coalesce(F.lower("text").rlike("[a-z0-9]"), F.lit(False))
    a = chunks.agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("bid_id").alias("n_bids"), F.count_distinct(F.when(has_terms, F.col("chunk_id"))).alias("n_vectors"))
    return a.crossJoin(F.broadcast(manifest.agg(F.count_distinct("path").alias("n_files"))))


def tracked_paths(manifest: DataFrame) -> DataFrame:
    """(path, n_chunks) of the manifest's files."""
    return manifest.groupBy("path").agg(F.max(F.greatest(F.size("chunk_ids"), F.lit(0))).alias("n_chunks"))


# Two states of the index: what was there before the middle of ingestion, and all of it.


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "source_files").select("file_path", "file_name", "bid_id", "total_pages", "ingested_at", F.lower("file_name").alias("key"))
    cut = files.agg(F.expr(f"percentile_approx({MICROS.format('ingested_at')}, 0.5, 100000)").alias("cut"))
    now = files.select(F.concat_ws("/", "bid_id", "file_name").alias("path"), F.sha2(F.concat_ws("|", "file_name", "total_pages", "ingested_at"), 256).alias("hash"))
    old = files.crossJoin(F.broadcast(cut)).where(f"{MICROS.format('ingested_at')} <= cut")
    # An older content of files with many pages.
    old = old.select(F.concat_ws("/", "bid_id", "file_name").alias("path"), "file_name", F.when(F.col("total_pages") > 2, F.sha2("file_name", 256)).otherwise(F.sha2(F.concat_ws("|", "file_name", "total_pages", "ingested_at"), 256)).alias("hash"), F.lit(0.0).alias("mtime"), "bid_id")
    chunks = table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name").distinct().groupBy("bid_id", "file_name").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    manifest = old.join(chunks, ["bid_id", "file_name"], "left").select("path", "file_name", "hash", "mtime", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    # Files of one page whose name has an odd length are gone now.
    lost = files.where("total_pages = 1 and length(file_name) % 2 = 1").select(F.concat_ws("/", "bid_id", "file_name").alias("path"))
    return now.join(lost, "path", "left_anti"), manifest


def q_diff(spark: SparkSession, d: str) -> DataFrame:
    now, manifest = _states(spark, d)
    return diff(now, manifest).select("path", "status", F.coalesce(F.size("old_chunk_ids"), F.lit(0)).alias("n_old")).withColumn("n_old", F.greatest("n_old", F.lit(0)))


def q_evict(spark: SparkSession, d: str) -> DataFrame:
    now, manifest = _states(spark, d)
    chunks = table(spark, d, "chunks").select("chunk_id", "bid_id", "file_name").distinct()
    return evict(chunks, diff(now, manifest)).groupBy("bid_id").agg(F.count(F.lit(1)).alias("n_left"))


def q_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with its latest row: rows that come again replace the earlier ones."""
    rows = table(spark, d, "chunks").select("chunk_id", "bid_id", "indexed_at")
    first = rows.groupBy("chunk_id").agg(F.min_by("bid_id", "indexed_at").alias("bid_id"), F.min("indexed_at").alias("indexed_at"))
    later = rows.groupBy("chunk_id").agg(F.max_by("bid_id", "indexed_at").alias("bid_id"), F.max("indexed_at").alias("indexed_at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return upsert(first, later).select("chunk_id", "bid_id", F.expr(MICROS.format("indexed_at")).alias("indexed_us"))


def q_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats(table(spark, d, "chunks"), table(spark, d, "source_files").select(F.concat_ws("/", "bid_id", "file_name").alias("path")))


def q_tracked(spark: SparkSession, d: str) -> DataFrame:
    return tracked(record(_states(spark, d)[1], _states(spark, d)[1].limit(0), diff(*_states(spark, d)))).agg(F.count(F.lit(1)).alias("n_tracked"))


def q_bids(spark: SparkSession, d: str) -> DataFrame:
    """Packages with chunks, ``Bid`` put before bare numbers."""
    b = F.col("bid_id")
    return table(spark, d, "chunks").where("bid_id is not null").select(F.when(b.rlike(r"^\d+$"), F.concat(F.lit("Bid"), b)).otherwise(b).alias("bid")).distinct()


def q_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


QUERIES = {"manifest_diff": q_diff, "evict_chunks": q_evict, "upsert_chunks": q_upsert, "index_stats": q_stats, "tracked_chunks": q_tracked, "distinct_bids": q_bids, "content_hashes": q_hashes}
SQL = {
    "upsert_chunks": "select chunk_id, max_by(bid_id, indexed_at) bid_id, epoch_us(max(indexed_at)) indexed_us from chunks group by 1",
    "index_stats": "select (select count(distinct chunk_id) from chunks) n_chunks, (select count(distinct bid_id) from chunks) n_bids, (select count(distinct concat_ws('/', bid_id, file_name)) from source_files) n_files, (select count(distinct chunk_id) from chunks where regexp_matches(lower(text), '[a-z0-9]')) n_vectors",
    "tracked_chunks": "with c as (select quantile_disc(ingested_at, 0.5) cut from source_files), u as (select bid_id, file_name from source_files, c where ingested_at <= cut and total_pages <= 2 and not (total_pages = 1 and length(file_name) % 2 = 1)) select count(distinct chunk_id) n_tracked from chunks join u using (bid_id, file_name)",
    "distinct_bids": r"select distinct case when regexp_matches(bid_id, '^\d+$') then 'Bid' || bid_id else bid_id end bid from chunks where bid_id is not null",
    "content_hashes": "select doc_id, sha256(coalesce(text, '')) hash from documents",
    "manifest_diff": """with c as (select quantile_disc(ingested_at, 0.5) cut from source_files),
s as (select * from (select *, concat_ws('/', bid_id, file_name) path, total_pages = 1 and length(file_name) % 2 = 1 lost, case when ingested_at <= cut then case when total_pages = 1 and length(file_name) % 2 = 1 then 'deleted' when total_pages > 2 then 'modified' else 'unchanged' end else 'new' end status from source_files, c) where not (lost and status = 'new')),
k as (select bid_id, file_name, count(distinct chunk_id) n from chunks group by 1, 2)
select path, status, cast(case when status = 'new' then 0 else coalesce(n, 0) end as integer) n_old from s left join k using (bid_id, file_name)""",
    "evict_chunks": """with c as (select quantile_disc(ingested_at, 0.5) cut from source_files),
m as (select bid_id, file_name from source_files, c where ingested_at <= cut and (total_pages > 2 or (total_pages = 1 and length(file_name) % 2 = 1))),
k as (select distinct chunk_id, bid_id, file_name from chunks)
select bid_id, count(*) n_left from k where not exists (select 1 from m where m.bid_id = k.bid_id and m.file_name = k.file_name) group by 1""",
}
