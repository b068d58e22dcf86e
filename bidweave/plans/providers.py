"""Providers of what needs a model or a service, each with a deterministic offline default, and calls with limits and retries."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value: how many characters of a value corroborate it in a passage.
LEAD = 20


class Transient(Exception):
    """A failure that may pass; ``status`` is the service's code, 0 for the network."""

    def __init__(self, status: int = 0):
        super().__init__(f"status {status}")
        self.status = status


class Embedder(Protocol):
    """An attribute ``query_prefix`` is put before queries, not before passages."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def scores(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Extractor(Protocol):
    def extract(self, field: str, passages: list[dict]) -> dict: ...


class HashEmbedder:
    """Unit vectors of hashed words: alike texts have alike vectors, without a model."""

    def __init__(self, size: int = 64):
        self.size = size
        self.memo: dict[str, int] = {}

    def _place(self, word: str) -> int:
        """The word's place, beyond ``size`` if it counts negatively."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
            self.memo[word] = h % self.size + (0 if h >> 32 & 1 else self.size)
        return self.memo[word]

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            places = [self._place(w) for w in re.findall(r"[a-z0-9]+", (t or "").lower())]
            n = np.bincount(np.array(places, np.int64), minlength=2 * self.size)
            out[i] = n[: self.size] - n[self.size :]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class PatternExtractor:
    """The line after the field's name in the first passage that has it."""

    def extract(self, field: str, passages: list[dict]) -> dict:
        for p in passages:
            m = re.search(rf"(?im)^.*\b{re.escape(field)}\b\s*[:\-]\s*(.+)$", p["text"] or "")
            if m:
                return {"value": m[1].strip(), "status": "FOUND", "quote": m[0].strip(), "file": p["file_name"], "page": p["page_number"], "chunk_id": p["chunk_id"]}
        return {"value": None, "status": "NOT_FOUND", "quote": None, "file": None, "page": None, "chunk_id": None}


#: The keys of a structured reply and their types.
REPLY = {"value": (str, type(None)), "status": (str,), "reason": (str, type(None)), "quote": (str, type(None)), "file_name": (str, type(None)), "page_number": (int, type(None)), "chunk_id": (str, type(None))}


def parse_reply(text: str | None) -> dict | None:
    """A structured reply, also inside a code fence or other words; None where it isn't one."""
    raw = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", text or "")
    try:
        got = json.loads(raw)
    except ValueError:
        inner = re.search(r"\{.*\}", raw, re.DOTALL)
        try:
            got = json.loads(inner[0]) if inner else None
        except ValueError:
            return None
    if not isinstance(got, dict) or got.get("status") not in ("FOUND", "NOT_FOUND"):
        return None
    got = {k: got.get(k) for k in REPLY}
    if isinstance(got["page_number"], str) and got["page_number"].isdigit():
        got["page_number"] = int(got["page_number"])
    return got if all(isinstance(got[k], kinds) for k, kinds in REPLY.items()) else None


def prompt(field: str, passages: list[dict], description: str = "") -> str:
    """Text that asks a language model for one field."""
    body = "\n\n".join(f"[{n}] {p['file_name']} p.{p['page_number']} ({p['chunk_id']})\n{p['text']}" for n, p in enumerate(passages, 1))
    return f"Field: {field}\n{description}\n\nPassages:\n{body}\n\nAnswer as JSON with value, status, reason, quote, file_name, page_number, chunk_id. Quote word for word."


def repair_prompt(prompt: str, reply: str) -> str:
    return f"The reply below isn't valid JSON with the keys {', '.join(REPLY)}.\n{reply}\n\nAnswer again, with the JSON only.\n\n{prompt}"


class ReplyExtractor:
    """Fields by a language model: ``call(prompt)`` gives its text; a reply that isn't valid is asked for once more."""

    def __init__(self, call: Callable[[str], str], prompt: Callable[[str, list[dict]], str] = prompt):
        self.call, self.prompt = call, prompt

    def extract(self, field: str, passages: list[dict]) -> dict:
        asked = self.prompt(field, passages)
        reply = self.call(asked)
        got = parse_reply(reply) or parse_reply(self.call(repair_prompt(asked, reply)))
        if got is None or got["status"] != "FOUND" or not got["value"] or not got["quote"] or not got["file_name"]:
            return {"value": None, "status": "NOT_FOUND", "quote": None, "file": None, "page": None, "chunk_id": None}
        return {"value": got["value"], "status": "FOUND", "quote": got["quote"], "file": got["file_name"], "page": got["page_number"], "chunk_id": got["chunk_id"]}


class Reconciler(Protocol):
    def reconcile(self, fields: dict[str, str | None], passages: list[dict]) -> list[dict]: ...


class Summarizer(Protocol):
    def summarize(self, number: int | None, passages: list[dict]) -> dict: ...


class Answerer(Protocol):
    """May also have ``synthesize(values)``: for a comparison, a dict of field to summary."""

    def answer(self, question: str, passages: list[dict]) -> dict: ...


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")
_ASKING = {"the", "what", "which", "who", "when", "where", "how", "are", "was", "for", "and", "this", "that", "with", "does", "did", "has", "have"}
_CHANGES = re.compile(r"(?i)\b(?:chang|amend|extend|revis|replac|delet|clarif|supersed|new|now)\w*")


class PatternReconciler:
    """Changes written as ``field is changed to value`` or ``new field: value``."""

    def reconcile(self, fields: dict[str, str | None], passages: list[dict]) -> list[dict]:
        out = []
        for p in passages:
            for f in fields:
                m = re.search(rf"(?im)^.*\b(?:new\s+{re.escape(f)}\s*(?:is|:)|{re.escape(f)}\s+(?:is|has been)\s+(?:changed|extended|revised)\s+to)\s*:?\s*([^\n]+?)\.?$", p["text"] or "")
                if m:
                    out.append({"field": f, "new_value": m[1].strip(), "quote": m[0].strip(), "file_name": p["file_name"], "page_number": p["page_number"], "reason": None})
        return out


class PatternSummarizer:
    """The sentences of an addendum that speak of changes."""

    def summarize(self, number: int | None, passages: list[dict]) -> dict:
        found = [(s.strip(), p) for p in passages for s in _SENTENCE.findall((p["text"] or "").partition("\n")[2] or p["text"] or "") if _CHANGES.search(s)]
        return {"overview": f"{len(found)} statements of changes.", "all_changes": [{"category": "General", "description": s, "quote": s} for s, _ in found]}


class PatternAnswerer:
    """The sentence of the passages that has most words of the question."""

    def answer(self, question: str, passages: list[dict]) -> dict:
        asked = set(re.findall(r"[a-z0-9]{3,}", question.lower())) - _ASKING
        best = max(((len(asked & set(re.findall(r"[a-z0-9]{3,}", s.lower()))), -n, s.strip(), p) for n, p in enumerate(passages) for s in _SENTENCE.findall(p["text"] or "")), key=lambda x: x[:2], default=(0,))
        if not best[0]:
            return {"answer": NOT_FOUND, "citations": []}
        return {"answer": best[2], "citations": [{"file": best[3]["file_name"], "page": best[3]["page_number"], "quote": best[2]}]}


NOT_FOUND = "Not found in documents."


def wait_for(error: Transient, attempt: int) -> float:
    """Seconds before the next attempt."""
    if error.status == 429:
        return 8.0 * attempt
    return 3.0 * attempt if error.status >= 500 else 2.0 * 2 ** (attempt - 1)


def with_retries(call: Callable[[], dict], attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; after the last attempt an ERROR result, which never reads as absence."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Transient as e:
            if n == attempts:
                return {"value": None, "status": "ERROR", "error": str(e)}
            sleep(wait_for(e, n))
        except Exception as e:  # noqa: BLE001
            return {"value": None, "status": "ERROR", "error": f"{type(e).__name__}: {e}"}
    raise AssertionError


class Limiter:
    """At least ``60 / per_minute`` seconds between calls of one worker."""

    def __init__(self, per_minute: float = 15, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = 60 / per_minute, clock, sleep, 0.0

    def __call__(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def embed(df: DataFrame, text: str = "text", make: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """Adds ``embedding``; the model is made once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model.embed(["" if t is None else t for t in s])))

    return df.withColumn("embedding", run(F.col(text)))


def extract(evidence: DataFrame, make: Callable[[], Extractor] = PatternExtractor, per_minute: float | None = None) -> DataFrame:
    """(bid_id, field_name, value, status, sources, error, retrieval_score, retrieval_rank, corroborated) from evidence rows (bid_id, field_name, passages); no evidence is NOT_FOUND without a call.

    ``corroborated`` is the number of the passages with the start of the value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, limit = make(), Limiter(per_minute) if per_minute else None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                passages = list(r.passages) if r.passages is not None else []
                if limit and passages:
                    limit()
                x = with_retries(lambda r=r, p=passages: model.extract(r.field_name, p)) if passages else {"value": None, "status": "NOT_FOUND"}
                src = [{"file": x.get("file"), "page": x.get("page"), "quote": x.get("quote"), "chunk_id": x.get("chunk_id")}] if x.get("quote") else []
                if x["status"] == "FOUND" and not src:
                    x["value"], x["status"] = None, "NOT_FOUND"  # a value without a citation is none
                cited = next(((p.get("score"), n) for n, p in enumerate(passages) if src and p["chunk_id"] == x.get("chunk_id")), (None, None))
                start = (x["value"] or "").strip(" ").lower()[:LEAD]
                agree = sum(start in (p["text"] or "").lower() for p in passages) if start else 0
                rows.append((r.bid_id, r.field_name, x["value"], x["status"], src, x.get("error"), *cited, agree))
            out = pd.DataFrame(rows, columns=["bid_id", "field_name", "value", "status", "sources", "error", "retrieval_score", "retrieval_rank", "corroborated"])
            yield out.astype({"retrieval_score": "float64", "retrieval_rank": "Int32"})

    return evidence.mapInPandas(run, "bid_id string, field_name string, value string, status string, sources array<struct<file:string,page:int,quote:string,chunk_id:string>>, error string, retrieval_score double, retrieval_rank int, corroborated long")
