"""File sources: folder scan, several packages, incremental listing, JSON results.

Only regular files with a document suffix count; names that begin with ``~`` are left out. One bad file never ends a scan:
parsers report it in an ``error`` column.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions import text as X

SUFFIXES = (".pdf", ".html", ".htm")


def scan_folder(spark: SparkSession, folder: str, bid_id: str | None = None) -> DataFrame:
    """(path, file_name, bid_id, content, hash, mtime, ord) of a folder's documents, HTML first, then by name.

    A folder that isn't there raises FileNotFoundError. ``bid_id`` overrides the folder's name.
    """
    if not _is_folder(spark, folder):
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return _documents(files, F.lit(bid_id or Path(folder).name))


def _is_folder(spark: SparkSession, folder: str) -> bool:
    """Whether a path of any file system is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path) and system.getFileStatus(path).isDirectory()


def scan_packages(spark: SparkSession, base: str) -> DataFrame:
    """The documents of all folders below ``base`` whose name begins with ``bid``, in one read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(f"{base}/[Bb][Ii][Dd]*/*")
    return _documents(files, F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))


def _documents(files: DataFrame, bid) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    df = files.select("path", name.alias("file_name"), bid.alias("bid_id"), "content", F.unix_timestamp("modificationTime").cast("double").alias("mtime"), suffix.alias("suffix"))
    df = df.where(F.col("suffix").isin(*SUFFIXES) & ~F.col("file_name").startswith("~"))
    order = F.struct((F.col("suffix") != ".html").alias("late"), "file_name")
    return df.withColumns({"hash": F.sha2("content", 256), "ord": order})


def coverage_json(pages: DataFrame, doc: tuple[str, ...] = ("bid_id", "file_name")) -> DataFrame:
    """(bid_id, name, report): a JSON report per document over its page records, and the name of its file."""
    kept = [c for c in ("page_number", "status", "char_count", "raw_char_count", "drawings", "images", "widgets", "has_vector_outlines", "ocr_attempted", "ocr_status") if c in pages.columns]
    per = pages.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("pages"), F.count(F.lit(1)).alias("total_pages"), F.coalesce(F.bool_or("has_vector_outlines"), F.lit(False)).alias("has_vector_outlines"))
    at = lambda keep: F.transform(F.filter("pages", keep), lambda p: p["page_number"])
    report = F.struct("file_name", "total_pages", "pages", "has_vector_outlines", at(lambda p: p["has_vector_outlines"]).alias("non_extractable_pages"), at(lambda p: F.size(p["widgets"]) > 0).alias("form_widget_pages"))
    return per.select("bid_id", F.concat(F.coalesce("bid_id", F.lit("")), F.lit("_"), X.slug(X.stem(F.coalesce("file_name", F.lit("")))), F.lit("_coverage.json")).alias("name"), F.to_json(report).alias("report"))


def write_json(df: DataFrame, path: str, by: str = "name", text: str = "report") -> None:
    """One folder of JSON lines per value of ``by``."""
    df.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def discover(base: str) -> list[str]:
    """Folders of packages below ``base``: named ``bid...`` or with a folder ``solicitations``, by name."""
    return sorted(p.name for p in Path(base).iterdir() if p.is_dir() and (p.name.lower().startswith("bid") or (p / "solicitations").exists()))


def cached(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Saved results where there are any and ``force`` isn't set; else those made and saved now."""
    if not force:
        kept = read_results(spark, path, schema)
        if not kept.isEmpty():
            return kept
    make().write.mode("overwrite").json(path)
    return read_results(spark, path, schema)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved results, or an empty frame where there are none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_results(df: DataFrame, path: str, key: str = "bid_id") -> None:
    """One JSON folder per key."""
    df.write.mode("overwrite").partitionBy(key).json(path)
