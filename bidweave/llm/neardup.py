"""Near-duplicate records by tensored banding of minhashes, with exact verification.

Two collections of minhash pairs are drawn, A and B; a table key is a pair (A_i, B_j), so that ``A_PAIRS`` x
``B_PAIRS`` tables of four minhashes each cost only 2 (A_PAIRS + B_PAIRS) minhashes. The tables are not written out:
rows are shuffled once per A_i and carry one byte of each minhash of B, and each bucket of A_i is divided
by the B_j where it lies. Buckets with more than ``HOT`` rows stream through and are divided by the B_j over all tasks;
what is still hot is divided again, level by level, by further pairs of minhash bytes (``LEVELS``), and rows that
agree in all of them are compared block by block, so no task ever holds a hot bucket. Candidates whose minhash
bytes agree too little are left out, the others are verified on their whole texts.

A pair of similarity s shares a key with probability (1 - (1 - s^2)^A_PAIRS) (1 - (1 - s^2)^B_PAIRS): 0.9999 at 0.65, 0.995 at
0.55 and 0.984 at 0.5. Exact copies (same content) are one class with one representative; only representatives are
compared. Classes of at most ``WHOLE`` copies are expanded into all their pairs, larger ones give one pair per copy with
their representative, which is the membership.

Defined results: a null text has no content and no pair; a text of fewer than three words has no shingles, hence no
similarity and no pair; an item that comes again (same id) counts once; a null name counts as empty. Contents count as equal
by 128 bits of hashes; two ids of one 64-bit hash are told apart when candidates are verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.session import spread, stage, table

SHINGLE = 3
A_PAIRS, B_PAIRS = 18, 16
HOT = 4096
WHOLE = 32
#: Ids of candidates are broadcast up to this number (8 MB), beyond it joined by a shuffle.
BROADCAST_IDS = 500_000
#: Least number of the 32 minhash bytes of B that a candidate must share; a pair of similarity 0.5 shares 16 of them in the mean.
LEAST_SAME = 9
#: Minhash bytes of A, and the least number of them that a candidate must share before its text is read: 16 in the mean at similarity 0.5.
C_BYTES, LEAST_MORE = 32, 8
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.random.default_rng(20_240_601).integers(1, 2**63, 2 * (A_PAIRS + B_PAIRS), dtype=np.uint64) * U(2) + U(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        step = np.full(size, _BASE, U)
        back = np.full(size, pow(_BASE, -1, 2**64), U)
        step[0] = back[0] = 1
        _POWERS[:] = [np.cumprod(step, dtype=U), np.cumprod(back, dtype=U)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_hashes(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and for each its text's number."""
    raw = [t.lower().encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = _WORD[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    power, back = _powers(len(buf) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], dtype=U)])
    words = _mix((total[ends] - total[starts]) * back[starts])
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    if len(words) < width:
        return words[:0], owner[:0]
    runs = np.zeros(len(words) - width + 1, U)
    for k in range(width):
        runs = _mix(runs * U(3) + words[k : len(words) - width + 1 + k])
    whole = owner[: len(runs)] == owner[width - 1 :]
    return runs[whole], owner[: len(runs)][whole]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):  # texts at a time, to keep the arrays in cache
            b = batch.slice(lo, 512)
            texts = b.column("content").to_pylist()
            runs, owner = shingle_hashes(texts)
            have, first = np.unique(owner, return_index=True)
            least = np.empty((len(have), len(_ODD)), U)
            if len(have):
                for k, odd in enumerate(_ODD):
                    least[:, k] = np.minimum.reduceat(runs * odd, first)
            least = _mix(least)
            pairs = _mix(least[:, 0 : 2 * A_PAIRS : 2] * U(5) + least[:, 1 : 2 * A_PAIRS : 2] + np.arange(A_PAIRS, dtype=U))
            # Bytes of B, then some of A for a second look.
            small = np.concatenate([least[:, 2 * A_PAIRS :], least[:, :C_BYTES]], axis=1) & U(255)
            small = np.ascontiguousarray(small.astype(np.uint8)).view(np.int64).reshape(len(have), B_WORDS + C_BYTES // 8)
            row = pa.array(have, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(row),
                    b.column("copy").take(row),
                    b.column("copy2").take(row),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * A_PAIRS), pa.array(pairs.view(np.int64).ravel())),
                    *[pa.array(small[:, k].copy()) for k in range(small.shape[1])],
                ],
                ["id", "copy", "copy2", "a", *B_COLS, *C_COLS],
            )


B_WORDS = 2 * B_PAIRS // 8
B_COLS = [f"b{k}" for k in range(B_WORDS)]
C_COLS = [f"c{k}" for k in range(C_BYTES // 8)]


def _within(key: np.ndarray, ids: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """Pairs (smaller id, larger id) of rows that share the key and, for some j below ``tables``, B_j (``tables`` 0: the key alone), and have enough bytes in common."""
    out = [np.empty((0, 2), np.int64)]
    if not len(ids):
        return out[0]
    bytes_ = np.ascontiguousarray(b).view(np.uint8).reshape(len(ids), -1)
    codes = bytes_.view(np.uint16)
    for j in range(max(tables, 1)):
        bucket = _mix(key.view(U) + codes[:, j].astype(U) * U(0x9E3779B97F4A7C15)) if tables else key.view(U)
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        at = np.flatnonzero(sorted_[1:] == sorted_[:-1])
        step = 1
        while len(at):
            for lo in range(0, len(at), 1 << 18):
                x, y = order[at[lo : lo + (1 << 18)]], order[at[lo : lo + (1 << 18)] + step]
                good = ((bytes_[x] == bytes_[y]).sum(1) >= LEAST_SAME) & (ids[x] != ids[y]) & (key[x] == key[y])
                p = np.stack([ids[x[good]], ids[y[good]]], 1)
                p.sort(axis=1)
                out.append(p)
            step += 1
            at = at[at + step < len(sorted_)]
            at = at[sorted_[at + step] == sorted_[at]]
    return np.unique(np.concatenate(out), axis=0)


PAIR, ROW = 0, 1


def _bucket_pairs(tables: int, most: int):
    """Over rows (key, id, B) sorted by key: pairs of each bucket, or its rows as they are where it has more than ``most``.

    A bucket that goes on in the next batch waits for it; one that is known to be hot streams through, so that at most a
    batch and ``most`` rows are held.
    """

    def out(kind: int, x: np.ndarray, y: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        cols = [np.full(len(x), kind, np.int64), x, y, *(b[:, k] for k in range(B_WORDS))]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["kind", "x", "y", *B_COLS])

    def emit(rows: np.ndarray, hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        key = rows[:, 0]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        many = np.repeat(size > most, size)
        if hot is not None:
            many |= key == hot
        if many.any():
            yield out(ROW, key[many], rows[many, 1], rows[many, 2 : 2 + B_WORDS])
        rows = rows[np.repeat(size > 1, size) & ~many]  # most buckets hold one row
        p = _within(rows[:, 0].copy(), rows[:, 1].copy(), rows[:, 2 : 2 + B_WORDS], tables)
        yield out(PAIR, p[:, 0], p[:, 1], np.zeros((len(p), B_WORDS), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        hot = None
        for batch in batches:
            rest.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            if sum(map(len, rest)) < 100_000:
                continue
            rows = np.concatenate(rest)
            if rows[0, 0] == rows[-1, 0]:
                hot, rest = rows[0, 0], []
                yield out(ROW, rows[:, 0], rows[:, 1], rows[:, 2 : 2 + B_WORDS])
                continue
            cut = np.searchsorted(rows[:, 0], rows[-1, 0], side="left")
            yield from emit(rows[:cut], hot)
            rest = [rows[cut:]]
        if rest and sum(map(len, rest)):
            yield from emit(np.concatenate(rest), hot)

    return run


_OUT = "kind bigint, x bigint, y bigint, " + ", ".join(f"{c} bigint" for c in B_COLS)


def _by_key(rows: DataFrame, tables: int) -> DataFrame:
    return rows.select("key", "id", *B_COLS).repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_pairs(tables, HOT), _OUT)


def _byte(columns: list[str], n: int) -> str:
    n %= 8 * len(columns)
    return f"(shiftright({columns[n // 8]}, {8 * (n % 8)}) & 255)"


#: How hot buckets are divided, level by level: the bytes, and where the first code begins. Sixteen codes of two bytes each. A level
#: makes 16 s^2 rows of one (s: what the rows share) and compares 16 s^4 times the pairs, so at most two pay off near the threshold.
LEVELS = [(B_COLS, 0), (C_COLS, 1)]


def _codes(level: int) -> list:
    columns, first = LEVELS[level]
    return [F.expr(f"cast({_byte(columns, first + 2 * k)} * 256 + {_byte(columns, first + 2 * k + 1)} as int)") for k in range(16)]


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of buckets that can't be divided, dealt out to blocks of less than ``HOT`` rows and repeated for each pair of blocks."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 4 / HOT).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", *B_COLS)


def candidates(signed: DataFrame) -> DataFrame:
    """(x, y), x < y: ids that share a key of some table and enough minhash bytes."""
    done = stage(_by_key(signed.select(F.explode("a").alias("key"), "id", *B_COLS), B_PAIRS))
    pairs = done.where(F.col("kind") == PAIR).select("x", "y")
    more = signed.select("id", *C_COLS)
    for level in range(len(LEVELS) + 1):
        hot = done.where(F.col("kind") == ROW).select(F.col("x").alias("key"), F.col("y").alias("id"), *B_COLS)
        if hot.isEmpty():
            break
        if level == 0:
            hot = hot.dropDuplicates(["key", "id"])  # an item that comes again and again
        if level < len(LEVELS):
            own = hot.join(more, "id") if LEVELS[level][0] is C_COLS else hot
            split = own.select("key", "id", *B_COLS, F.posexplode(F.array(*_codes(level))).alias("k", "code"))
            done = stage(_by_key(split.withColumn("key", F.xxhash64("key", "k", "code")), 0))
        else:
            done = _by_key(_in_blocks(hot), 0)
        pairs = pairs.unionByName(done.where(F.col("kind") == PAIR).select("x", "y"))
    pairs = pairs.distinct()
    for side in ("x", "y"):
        pairs = pairs.join(signed.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in C_COLS]), side)
    return pairs.mapInArrow(_alike, "x bigint, y bigint").distinct()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share enough of the further minhash bytes."""
    for b in batches:
        x, y = (np.stack([b.column(f"{side}_{c}").to_numpy() for c in C_COLS], 1).copy().view(np.uint8).reshape(len(b), C_BYTES) for side in ("x", "y"))
        keep = pa.array((x == y).sum(1) >= LEAST_MORE)
        yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], ["x", "y"])


def _similar(least: float):
    find = re.compile("[a-z0-9]+").findall

    def shingles(text: str) -> set:
        w = find(text.lower())
        return set(zip(*(w[k:] for k in range(SHINGLE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = []
            for s, t in zip(b.column("content_x").to_pylist(), b.column("content_y").to_pylist()):
                x, y = shingles(s), shingles(t)
                both = len(x & y)
                sims.append(both / max(1, len(x) + len(y) - both))
            keep = pa.array([s >= least for s in sims])
            names = ["id_x", "id_y", "rep_x", "rep_y"]
            yield pa.RecordBatch.from_arrays([*(b.column(n).filter(keep) for n in names), pa.array(sims, pa.float64()).filter(keep)], [*names, "similarity"])

    return run


def _copy_key() -> list:
    """128 bits by which two contents are the same."""
    low = F.lower("content")
    return [F.xxhash64(low).alias("copy"), F.xxhash64(low, F.lit("copy")).alias("copy2")]


def similar_pairs(items: DataFrame, key: str, content: str, least: float = 0.5) -> DataFrame:
    """(id_a, id_b, similarity): pairs of ``key`` values, id_a < id_b, whose contents reach the similarity ``least``.

    Similarity is that of the sets of runs of three words, exact for every pair given out.
    """
    items = items.where(F.col(content).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("name"), F.col(content).alias("content"))
    items = items.withColumn("id", F.xxhash64("name"))
    signed = spread(items).select("id", *_copy_key(), "content")
    signed = stage(signed.mapInArrow(_signatures, "id bigint, copy bigint, copy2 bigint, a array<bigint>, " + ", ".join(f"{c} bigint" for c in [*B_COLS, *C_COLS])))
    # Classes of copies; most contents are alone and leave here.
    classes = signed.groupBy("copy", "copy2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last")
    members = stage(signed.join(classes, ["copy", "copy2"]).select("rep", "id", "copy", "copy2").distinct())
    alone = signed.join(members.where("id <> rep").select("id"), "id", "left_anti")
    found = stage(candidates(alone))
    ids = stage(found.select(F.explode(F.array("x", "y")).alias("id")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = items.join(ids, "id", "left_semi").groupBy("id", "name").agg(F.first("content").alias("content"))
    one = texts.select(F.col("id").alias("x"), F.col("name").alias("id_x"), F.col("content").alias("content_x"))
    two = texts.select(F.col("id").alias("y"), F.col("name").alias("id_y"), F.col("content").alias("content_y"))
    joined = found.join(one, "x").join(two, "y").select("id_x", "id_y", F.col("x").alias("rep_x"), F.col("y").alias("rep_y"), "content_x", "content_y")
    linked = joined.mapInArrow(_similar(least), "id_x string, id_y string, rep_x bigint, rep_y bigint, similarity double")
    cols = ["id_x", "id_y", "similarity"]
    ordered = [F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "similarity"]
    if members.isEmpty():
        return linked.select(ordered)
    linked = stage(linked)
    # Copies: small classes in full, large ones through their representative.
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
    names = members.join(sizes, "rep").join(items.select("id", "name", *_copy_key()).distinct(), ["id", "copy", "copy2"]).drop("copy", "copy2")
    small = names.where(F.col("size") <= WHOLE)
    own = names.join(names.where("id = rep").select("rep", F.col("name").alias("rep_name")), "rep").where("id <> rep").select(F.col("rep_name").alias("id_x"), F.col("name").alias("id_y"), F.lit(1.0).alias("similarity"))
    inner = small.where("id <> rep")
    among = inner.select("rep", F.col("name").alias("id_x")).join(inner.select("rep", F.col("name").alias("id_y")), "rep").where("id_x < id_y").select("id_x", "id_y", F.lit(1.0).alias("similarity"))
    stand = lambda side, other: linked.join(inner.select(F.col("rep").alias(f"rep_{side}"), F.col("name").alias("copy_name")), f"rep_{side}").select(F.col("copy_name").alias("id_x"), F.col(f"id_{other}").alias("id_y"), f"rep_{other}", "similarity")
    left, right = stand("x", "y"), stand("y", "x")
    both = left.join(inner.select(F.col("rep").alias("rep_y"), F.col("name").alias("copy_name")), "rep_y").select("id_x", F.col("copy_name").alias("id_y"), "similarity")
    pairs = linked.select(cols).unionByName(own).unionByName(among).unionByName(left.select(cols)).unionByName(right.select(cols)).unionByName(both)
    return pairs.select(ordered)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found: all pairs of near-duplicate chunks, over all packages."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", F.concat(F.coalesce("file_name", F.lit("")), F.lit(" "), F.col("text")).alias("content"))
    pairs = similar_pairs(chunks, "chunk_id", "content")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


#: All pairs by a join of the runs of three words.
FOUND_SQL = """with c as (select chunk_id, any_value(regexp_extract_all(lower(coalesce(file_name, '') || ' ' || text), '[a-z0-9]+')) w from chunks where text is not null group by 1),
s as (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g from c),
n as (select chunk_id, count(*) n from s group by 1),
p as (select a.chunk_id x, b.chunk_id y, count(*) k from s a join s b on a.g = b.g and a.chunk_id < b.chunk_id group by 1, 2)
select x chunk_id_a, y chunk_id_b from p join n on n.chunk_id = x join n m on m.chunk_id = y where k >= 0.5 * (n.n + m.n - k)"""
