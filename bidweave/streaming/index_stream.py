"""Incremental indexing as a stream: new and changed files of a folder, each batch diffed against the manifest and merged.

Chunks and manifest lie in buckets by the file's path. A batch reads and writes only the buckets that its files touch and commits a
version that names them beside the untouched ones, so the work of a batch follows its files, not the index. A batch that is run
again after a crash finds the version before it, or its own already committed, and gives the same index.

Files that are gone are evicted with the next batch, or by ``sweep`` where nothing new comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidweave.operators.indexing import MANIFEST, commit, diff, evict, load, read_version, record, upsert
from bidweave.session import stage

FILES = "path string, modificationTime timestamp, length long, content binary"
BUCKETS = 64


def bucket(path: str = "path"):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("string")


def merge(spark: SparkSession, index_dir: str, files: DataFrame, listing: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], chunk_schema: str, batch: int | None = None, force: bool = False) -> dict:
    """Brings files (path, file_name, content, mtime, hash) into the index and evicts those that aren't in ``listing`` (path); gives the committed version with its counts.

    With ``force`` unchanged files are indexed again too.
    """
    before = read_version(spark, index_dir)
    if batch is not None and before.get("batch", -1) >= batch:
        return before
    manifest = load(spark, index_dir, "manifest", MANIFEST)
    gone = manifest.select("path").join(listing.select("path"), "path", "left_anti")
    seen = manifest.join(files.select("path").unionByName(gone).distinct(), "path", "left_semi")
    changes = diff(files, seen)
    changes = stage(changes if force else changes.where("status <> 'unchanged'"))
    fresh_files = files.join(changes.where("status <> 'deleted'").select("path"), "path", "left_semi")
    fresh = stage(to_chunks(fresh_files))
    touched = [r[0] for r in changes.select(bucket().alias("b")).distinct().collect()]  # at most BUCKETS
    own = fresh.groupBy("path").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    rows = fresh_files.join(own, "path", "left").select("path", "file_name", "hash", "mtime", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    number = before["number"] + 1
    parts = {name: dict(before["parts"].get(name, {})) for name in ("chunks", "manifest")}
    replaced = changes.withColumn("status", F.when(F.col("status") == "unchanged", "modified").otherwise(F.col("status")))
    chunks = load(spark, index_dir, "chunks", chunk_schema, touched)
    new = {
        "chunks": upsert(evict(chunks, replaced), fresh.select(*chunks.columns)),
        "manifest": record(load(spark, index_dir, "manifest", MANIFEST, touched), rows, replaced),
    }
    for name, df in new.items():
        to = f"{index_dir}/data/{number}/{name}"
        df.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
        written = {r[0] for r in df.select(bucket().alias("b")).distinct().collect()}
        for b in touched:
            parts[name].pop(b, None)
            if b in written:
                parts[name][b] = f"{to}/bucket={b}"
    removed = replaced.where("status in ('modified', 'deleted')").select(F.explode("old_chunk_ids")).count()
    version = {"number": number, "parts": parts, "batch": before.get("batch", -1) if batch is None else batch, "files": changes.count(), "added": fresh.count(), "removed": removed}
    commit(spark, index_dir, version)
    return version


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the folder's files; their contents aren't read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format("binaryFile").load(folder).select("path")
    except AnalysisException:
        return spark.createDataFrame([], "path string")


def _files(df: DataFrame) -> DataFrame:
    files = df.groupBy("path").agg(F.max_by(F.struct("content", "modificationTime"), "modificationTime").alias("f"))
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), "f.content", F.unix_timestamp("f.modificationTime").cast("double").alias("mtime"), F.sha2("f.content", 256).alias("hash"))


def watch(spark: SparkSession, folder: str, index_dir: str, to_chunks: Callable[[DataFrame], DataFrame], chunk_schema: str, once: bool = True) -> StreamingQuery:
    """Indexes ``folder``; ``to_chunks`` turns (path, file_name, content, mtime, hash) into chunks with a ``path``."""

    def each(batch: DataFrame, number: int) -> None:
        merge(spark, index_dir, _files(batch), _listing(spark, folder), to_chunks, chunk_schema, number)

    stream = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{index_dir}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def index_folder(spark: SparkSession, folder: str, index_dir: str, to_chunks: Callable[[DataFrame], DataFrame], chunk_schema: str, force: bool = False) -> dict:
    """The same without a stream: all files of the folder in one merge."""
    files = spark.read.format("binaryFile").load(folder)
    return merge(spark, index_dir, stage(_files(files)), files.select("path"), to_chunks, chunk_schema, force=force)


def sweep(spark: SparkSession, folder: str, index_dir: str, chunk_schema: str) -> dict:
    """Evicts the chunks of files that are gone."""
    none = spark.createDataFrame([], "path string, file_name string, content binary, mtime double, hash string")
    return merge(spark, index_dir, none, _listing(spark, folder), lambda f: spark.createDataFrame([], chunk_schema), chunk_schema)


def current(spark: SparkSession, index_dir: str, name: str, schema: str) -> DataFrame:
    return load(spark, index_dir, name, schema)
