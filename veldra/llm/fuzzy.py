"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes decides where chunks end: a position
ends a chunk of block size 2**k when the k lowest bits of its hash are set, so
the boundaries of a larger block size are among those of a smaller one. Each
chunk becomes one of 64 letters by its own hash. A fingerprint is
``2**k:letters at 2**k:letters at 2**(k+1)`` with the smallest k that needs at
most 64 letters; the whole text is in it, nothing is cut off. Fingerprints are
compared where their block sizes meet, by insert/delete edit distance of the
letters, computed for many pairs at once on 64-bit words.

Defined results: null counts as empty; the empty text has the fingerprint
``1::``, and two empty texts have likeness 1; equal texts have equal
fingerprints. In ``with_next`` the next of a row is the following one in
ascending (id, text) order, nulls first, repeated rows included, and the first
follows the last; a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from veldra.llm.store import staged
from veldra.llm.textcore import U64, mix

#: The letters of a signature.
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ROLL = 7
MOST = 64
#: Letters that must agree in a row before two longer signatures count as alike at all.
COMMON = 5
_BASE = 0xA24BAED4963EE407


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` at least."""
    if not _powers or len(_powers[0]) < n:
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(1 << max(16, (n - 1).bit_length()), b, U64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if len(both[0]) > 1 << 22:
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


def _levels(data: np.ndarray) -> np.ndarray:
    """For each byte the number of set low bits of the hash of the seven bytes that end there."""
    padded = np.r_[np.zeros(ROLL - 1, U64), data.astype(U64) + U64(1)]
    h = np.zeros(len(data), U64)
    for j in range(ROLL):
        h = h * U64(0x9E3779B97F4A7C15) + padded[j : j + len(data)]
    h = mix(h)
    low = ~h & (h + U64(1))  # the lowest zero bit
    return np.log2(np.maximum(low, U64(1)).astype(float)).astype(np.int8)


def fingerprint(data: bytes) -> str:
    if not data:
        return "1::"
    raw = np.frombuffer(data, np.uint8)
    level = _levels(raw)
    level[-1] = 64  # the text's end closes a chunk at every size
    counts = np.cumsum(np.bincount(np.minimum(level, 40), minlength=41)[::-1])[::-1]  # chunks at each k
    k = int(np.argmax(counts <= MOST))
    up, down = powers(len(raw))
    sums = np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)])
    out = []
    for size in (k, k + 1):
        ends = np.flatnonzero(level >= size)
        starts = np.r_[0, ends[:-1] + 1]
        whole = sums[ends] - np.where(starts > 0, sums[starts - 1], U64(0))
        out.append(LETTERS[(mix(whole * down[starts]) >> U64(58)).astype(np.int64)].tobytes().decode())
    return f"{1 << k}:{out[0]}:{out[1]}"


def _pairs_alike(a: list[str], b: list[str]) -> np.ndarray:
    """1 - distance / length for signature pairs of at most 64 letters each; 0 if longer ones share no run of letters."""
    n = len(a)
    code = np.zeros(256, np.int64)
    code[LETTERS] = np.arange(64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    pad = lambda xs: np.frombuffer("".join(x.ljust(MOST, "A") for x in xs).encode(), np.uint8).reshape(n, MOST)
    ca, cb = code[pad(a)], code[pad(b)]
    at = np.arange(n)
    places = np.zeros((n, 64), U64)  # of each letter in a, as bits
    for j in range(MOST):
        live = j < la
        places[at[live], ca[live, j]] |= U64(1) << U64(j)
    v = np.full(n, ~U64(0), U64)
    run = np.zeros(n, U64)
    runs = [run]
    common = np.zeros(n, bool)
    for j in range(int(lb.max(initial=0))):
        live = j < lb
        m = np.where(live, places[at, cb[:, j]], U64(0))
        u = v & m
        v = np.where(live, (v + u) | (v - u), v)
        # bit i of runs[r]: the last r + 1 letters of b up to j end at place i of a
        runs = [m, *((x << U64(1)) & m for x in runs[: COMMON - 1])]
        if len(runs) == COMMON:
            common |= runs[-1] != 0
    mask = np.where(la < 64, (U64(1) << np.minimum(la, 63).astype(U64)) - U64(1), ~U64(0))
    lcs = np.bitwise_count(~v & mask).astype(np.int64)
    alike = np.where(la + lb > 0, 2.0 * lcs / np.maximum(la + lb, 1), 1.0)
    return np.where((np.minimum(la, lb) >= 2 * COMMON) & ~common, 0.0, alike)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness (0 to 1) of fingerprint pairs; 0 where block sizes differ by more than a factor of two."""
    x, y = [s.split(":") for s in a], [s.split(":") for s in b]
    best = np.zeros(len(a))
    jobs: list[tuple[int, str, str]] = []
    for i, (p, q) in enumerate(zip(x, y)):
        s, t = int(p[0]), int(q[0])
        if s == t:
            jobs += [(i, p[1], q[1]), (i, p[2], q[2])] if p[2] and q[2] else [(i, p[1], q[1])]
        elif s == 2 * t:
            jobs.append((i, p[1], q[2]))
        elif t == 2 * s:
            jobs.append((i, p[2], q[1]))
    if jobs:
        found = _pairs_alike([j[1] for j in jobs], [j[2] for j in jobs])
        np.maximum.at(best, [j[0] for j in jobs], found)
    best[[i for i in range(len(a)) if a[i] == b[i]]] = 1.0
    return best


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of each text (null: as empty)."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint((t or "").encode()))

    return docs.withColumn(out, of(F.col(text)))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(rows: list[tuple]) -> pd.DataFrame:
    """rows: id, text, fingerprint, next text, next fingerprint."""
    mixed = [edited(t, n) for _, t, _, n, _ in rows]
    raw = [m.encode() for m in mixed]
    marks = [fingerprint(m) for m in raw]
    own = [r[2] for r in rows]
    return pd.DataFrame({
        "doc_id": pd.array([r[0] for r in rows], "Int64"), "n_chars": [len(r[1]) for r in rows], "edited_sha256": [hashlib.sha256(m).hexdigest() for m in raw],
        "fingerprint": own, "edited_fingerprint": marks, "near_edited": likeness(own, marks), "near_next": likeness(own, [r[4] for r in rows]),
    })


def with_next(docs: DataFrame, partitions: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's fingerprint against that of its edited version (see ``edited``) and of the next text.

    One range shuffle brings neighbours together. The last row of a partition
    needs the first of the next one: these two rows of each partition, and no
    others, pass through a second, small step.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, held, first = TaskContext.get().partitionId(), None, True
        empty = {"part": part, "edge": "", "text": None}
        todo: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                now = (key, t, fingerprint(t.encode()))
                if held is not None:
                    todo.append((*held, now[1], now[2]))
                    size += len(held[1])
                elif first:
                    first = False
                    yield pd.DataFrame({"doc_id": pd.array([key], "Int64"), "fingerprint": [now[2]], **(empty | {"edge": "head", "text": t})})
                held = now
                if len(todo) >= 2000 or size > 4_000_000:
                    yield _judge(todo).assign(**empty)
                    todo, size = [], 0
        if todo:
            yield _judge(todo).assign(**empty)
        if held is not None:
            yield pd.DataFrame({"doc_id": pd.array([held[0]], "Int64"), "fingerprint": [held[2]], **(empty | {"edge": "tail", "text": held[1]})})

    names = [f.split()[0] for f in _OUT.split(", ")]
    schema = f"{_OUT}, part int, edge string, text string"
    arrow = spark.createDataFrame([], schema).schema

    def to_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.string())) for f in arrow])
        for table in run(batches):
            yield from pa.Table.from_pandas(table.reindex(columns=kinds.names), kinds, preserve_index=False).combine_chunks().to_batches()

    all_rows = staged(rows.mapInArrow(to_arrow, arrow), "fingerprints")
    # two rows of each partition at most
    edges = all_rows.where("edge <> ''").select("part", "edge", "doc_id", "text", "fingerprint")
    heads = edges.where("edge = 'head'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    follow = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    tails = edges.where("edge = 'tail'").join(follow, "part").join(heads.withColumnRenamed("part", "next"), "next")

    def close(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in tables:
            ids = [None if pd.isna(x) else int(x) for x in t["doc_id"]]
            yield _judge(list(zip(ids, t["text"], t["fingerprint"], t["next_text"], t["next_mark"])))

    closed = tails.select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInPandas(close, _OUT)
    return all_rows.where("edge = ''").select(*names).unionByName(closed)
