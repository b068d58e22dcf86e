"""Command line: run a registered query, search, ask, answer, extract, compare or index over a data folder."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from bidweave import api
from bidweave.session import table
from bidweave.sources.files import read_results


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bidweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name, positional in (("query", "name"), ("search", "text"), ("ask", "text"), ("answer", "text"), ("extract", "bid"), ("compare", "bids"), ("index", "index_dir"), ("stats", None)):
        s = sub.add_parser(name)
        if positional:
            s.add_argument(positional, nargs="+" if positional == "bids" else None)
        s.add_argument("--data", required=True)
        if positional != "bid":
            s.add_argument("--bid")
        s.add_argument("--top", type=int, default=5)
        s.add_argument("--mode", default="hybrid")
        s.add_argument("--force", action="store_true", help="make results again that are saved")
        s.add_argument("--out", help="folder to write instead of showing rows")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("bidweave").getOrCreate()
    chunks = lambda: table(spark, a.data, "chunks")
    if a.command == "query":
        from bidweave.plans.registry import QUERIES

        df = QUERIES[a.name](spark, a.data)
    elif a.command == "search":
        df = api.search(spark, chunks(), a.text, a.bid, None, a.top, a.mode)
    elif a.command == "ask":
        df = api.ask(spark, chunks(), table(spark, a.data, "packages"), a.text, a.bid, a.top)
    elif a.command == "answer":
        print(json.dumps(api.answer(spark, chunks(), table(spark, a.data, "packages"), a.text, a.bid, a.top), indent=2))
        return 0
    elif a.command == "extract":
        saved = f"{a.out}/{a.bid}_extraction" if a.out else None
        schema = "field_name string, value string, status string, bucket string, computed_confidence double"
        if saved and not a.force and not (df := read_results(spark, saved, schema)).isEmpty():
            df.show(20, 80)
            return 0
        got = api.extract(chunks(), a.bid)
        df = got.fields.select("field_name", "value", "status", "bucket", "computed_confidence")
        if saved:
            df.write.mode("overwrite").json(saved)
            got.tracer.save(spark, f"{a.out}/trace", a.bid)
            return 0
    elif a.command == "compare":
        from bidweave.config import FIELDS
        from bidweave.operators.routing import _values

        names = [f.lower() for f, _, _ in FIELDS]
        if a.out:
            api.save_comparison(_values(spark, a.data), a.bids, names, a.out)
        else:
            print(api.compare(_values(spark, a.data), a.bids, names))
        return 0
    elif a.command == "index":
        from bidweave.operators.indexing import MANIFEST

        df = api.index(chunks(), spark.createDataFrame([], MANIFEST), a.index_dir)
    else:
        print(json.dumps(api.Service(spark, a.data).call("GET", "/stats")[1]))
        return 0
    if a.out:
        Path(a.out).parent.mkdir(parents=True, exist_ok=True)
        df.write.mode("overwrite").json(a.out)
    else:
        df.show(20, 80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
