"""Trace of steps: recording on the driver, roll-ups as aggregates.

Defined results: steps without an agent are counted under null; an empty trace gives no group.
"""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import table

SCHEMA = "step_id int, timestamp string, agent string, input map<string,string>, tool_calls array<struct<tool:string,args:map<string,string>,output_summary:string>>, output map<string,string>, tokens int, prompt_tokens int, completion_tokens int, latency_ms double"


class Tracer:
    """Collects steps; ``step`` is a context manager that times its block and keeps an error as output."""

    def __init__(self) -> None:
        self.steps: list[dict] = []

    def step(self, agent: str, **given: object) -> _Step:
        return _Step(self, agent, given)

    def save(self, spark: SparkSession, path: str, bid_id: str | None = None) -> None:
        """Adds the steps to the JSON trace at ``path``, under the package's folder if one is named."""
        self.frame(spark).coalesce(1).write.mode("append").json(f"{path}/bid_id={bid_id}" if bid_id else path)

    def frame(self, spark: SparkSession) -> DataFrame:
        cols = [c.split(" ")[0] for c in ("step_id", "timestamp", "agent", "input", "tool_calls", "output", "tokens", "prompt_tokens", "completion_tokens", "latency_ms")]
        return spark.createDataFrame([tuple(s[c] for c in cols) for s in self.steps], SCHEMA)


class _Step:
    def __init__(self, tracer: Tracer, agent: str, given: dict):
        self.tracer, self.row = tracer, {"agent": agent, "input": {k: str(v) for k, v in given.items()}, "tool_calls": [], "output": {}, "prompt_tokens": 0, "completion_tokens": 0}

    def __enter__(self) -> _Step:
        self.began = time.perf_counter()
        self.row["timestamp"] = datetime.now(UTC).isoformat()
        return self

    def tool(self, name: str, summary: str = "", **args: object) -> None:
        self.row["tool_calls"].append((name, {k: str(v) for k, v in args.items()}, summary))

    def output(self, prompt_tokens: int = 0, completion_tokens: int = 0, **values: object) -> None:
        self.row["output"] |= {k: str(v) for k, v in values.items()}
        self.row["prompt_tokens"] += prompt_tokens
        self.row["completion_tokens"] += completion_tokens

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None:
            self.row["output"]["error"] = f"{kind.__name__}: {error}"
        self.row |= {"step_id": len(self.tracer.steps) + 1, "tokens": self.row["prompt_tokens"] + self.row["completion_tokens"], "latency_ms": (time.perf_counter() - self.began) * 1000}
        self.tracer.steps.append(self.row)
        return False


def rollup(trace: DataFrame, agent: str = "agent", latency: str = "latency_ms", tokens: str = "tokens") -> DataFrame:
    """Steps, latency and tokens by agent, and overall (null agent)."""
    return trace.rollup(agent).agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.sum(latency), 4).alias("total_latency"), F.round(F.avg(latency), 4).alias("mean_latency"), F.round(F.max(latency), 4).alias("max_latency"), F.sum(tokens).alias("tokens"))


def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("agent"), F.col("value").alias("latency_ms"), F.length("props").cast("long").alias("tokens"))
    return rollup(e)


QUERIES = {"trace_rollup": q_rollup}
SQL = {"trace_rollup": "select event_type agent, count(*) n_steps, round(sum(value), 4) total_latency, round(avg(value), 4) mean_latency, round(max(value), 4) max_latency, cast(sum(length(props)) as bigint) tokens from events group by rollup (event_type)"}
