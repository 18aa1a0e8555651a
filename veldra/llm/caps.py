"""Near-duplicate vectors by spherical-cap filters.

After a random rotation the coordinates fall into two blocks, each with a code
of random directions; every pair of code words is a filter direction. A
vector is list-decoded to all directions with which its inner product exceeds
a bound: from each list of a first word only those second words are read that
reach it. The number of words and the bound follow from the counted vectors, so
that a filter holds a bounded number of them at any size of the table. Filters
are joined in bundles (one first word, a run of second words), so a vector is
shipped once for a bundle; a bundle with more vectors than expected is compared
block by block. Every meeting is verified by the cosine in double precision. A
pair counts in the least bundle that it shares, so no pair list is ever formed:
a block returns, for each vector, its number of links there and one link of
each that keeps components connected.

Defined results: null vectors, zero vectors and those with null or non-finite
components link with nothing (n_links 0, a component of their own); vectors of
different lengths are never linked; equal vectors are collapsed first and
count as links of one another; rows that repeat an id are one node and count
as links of each other; a row without an id counts as a link of others but its
component is null if it stands alone; an empty table gives no rows; labels and
other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldra.llm.components import components
from veldra.llm.store import staged

#: Expected number of filters of a vector for a filter that every second neighbour at the threshold shares; it grows as that share sinks.
FILTERS = 26
#: Largest share of all vectors in a filter, and the expected number of vectors in one beyond that size.
SHARE, CROWD = 0.0023, 64
#: Expected number of vectors in a bundle of filters.
BUNDLE = 2048
#: Larger bundles are compared in blocks of about this many vectors.
BLOCK = 3000
#: Crowded bundles are broadcast up to this number, and joined beyond it.
MAX_BROADCAST = 100_000
#: Shorter vectors are turned into this many dimensions.
LEAST_DIM = 16


def _tail(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in [-1, 1], and there the weight and the upper tail of one coordinate of a random unit vector."""
    x = np.linspace(-1, 1, 20_001)
    w = (1 - x * x) ** ((dim - 3) / 2)
    w /= w.sum()
    return x, w, np.cumsum(w[::-1])[::-1]


@functools.lru_cache(64)
def sizes(n: int, dim: int, least: float) -> tuple[int, float, int]:
    """Code words of a block, bound of the inner product, and second words of a bundle for ``n`` vectors."""
    dim = max(dim, LEAST_DIM)
    x, w, tail = _tail(dim)
    at = int(np.searchsorted(-tail, -min(SHARE, CROWD / max(n, 1))))
    bound, share = x[at], tail[at]
    side = np.sqrt(np.maximum((1 - least * least) * (1 - x * x), 1e-12))
    both = (w * np.interp((bound - least * x) / side, x, _tail(dim - 1)[2]))[at:].sum() / share
    words = int(np.ceil(np.sqrt(FILTERS / both / share)))
    bundles = max(n * FILTERS / both / 1.5 / BUNDLE, words)  # in large tables some filters of a vector lie in one bundle
    return words, float(bound), max(1, -(-words * words // int(bundles)))


@functools.lru_cache(16)
def _code(dim: int, count: int, seed: int = 31) -> tuple[np.ndarray, list[np.ndarray], list[slice]]:
    """Rotation, code words of each block and the blocks' coordinates."""
    wide = max(dim, LEAST_DIM)
    rng = np.random.default_rng([seed, dim])
    rotation = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim]
    edges = [0, (wide + 1) // 2, wide]
    words = []
    for a, b in zip(edges, edges[1:]):
        w = rng.normal(size=(count, b - a))
        words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt((b - a) / wide))
    return rotation, words, [slice(a, b) for a, b in zip(edges, edges[1:])]


def decoded(vectors: np.ndarray, count: int, bound: float) -> list[np.ndarray]:
    """Filters (first word * ``count`` + second word) whose directions each unit vector exceeds; the best one alone if there is none."""
    rotation, words, parts = _code(vectors.shape[1], count)
    turned = vectors @ rotation
    x, y = (turned[:, p] @ w.T for p, w in zip(parts, words))
    out = []
    for a, b in zip(x, y):
        able = np.flatnonzero(a + b.max() >= bound)  # the other lists cannot reach the bound
        if not len(able):
            out.append(np.array([int(a.argmax()) * count + int(b.argmax())]))
            continue
        second = np.flatnonzero(b >= bound - a[able].max())
        second = second[np.argsort(-b[second])]
        reach = np.searchsorted(-b[second], a[able] - bound, side="right")
        starts = np.repeat(np.cumsum(reach) - reach, reach)
        out.append(np.repeat(able, reach) * count + second[np.arange(reach.sum()) - starts])
    return out


def bundles(vectors: np.ndarray, n: int, least: float) -> list[np.ndarray]:
    """Sorted bundles of filters of each unit vector in a table of ``n``."""
    words, bound, run = sizes(n, vectors.shape[1], least)
    runs = -(-words // run)
    return [np.unique(f // words * runs + f % words // run) for f in decoded(vectors, words, bound)]


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _coded(vectors: DataFrame, n: int, least: float, kind: str) -> DataFrame:
    """node, n, vector (raw bytes of its numbers), code (bytes of its bundles) and bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                lists = [np.asarray(v, kind) for v in c.column(1).to_pylist()]
                found: list = [None] * len(lists)
                for dim in {len(v) for v in lists}:
                    rows = [i for i, v in enumerate(lists) if len(v) == dim]
                    for i, f in zip(rows, bundles(_unit(np.stack([lists[i] for i in rows])), n, least)):
                        found[i] = f.astype("<i8")
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([v.tobytes() for v in lists], pa.binary()), c.column(2), pa.array([f.tobytes() for f in found], pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["node", "vector", "n", "code", "bundles"])

    return vectors.select("node", "vector", "n").mapInArrow(run, "node long, vector binary, n long, code binary, bundles array<long>")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the pairs that connect what all pairs connect."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            keep.append(k)
    return keep


def _met_before(p: list[bytes], q: list[bytes], here: int) -> np.ndarray:
    """Whether two vectors share a bundle below ``here``."""
    codes = [[f[f < here] for f in (np.frombuffer(c, "<i8") for c in side)] for side in (p, q)]
    flat = [np.concatenate(c) for c in codes]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(p), len(q)), bool)
    for a in range(0, len(shared), 1024):
        part = shared[a : a + 1024]
        marks = []
        for c, f in zip(codes, flat):
            at = np.minimum(np.searchsorted(part, f), len(part) - 1)
            m = np.zeros((len(c), len(part)), np.float32)
            hit = part[at] == f
            m[np.repeat(np.arange(len(c)), [len(x) for x in c])[hit], at[hit]] = 1
            marks.append(m)
        out |= marks[0] @ marks[1].T > 0
    return out


def _met(task: pd.DataFrame, least: float, kind: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, links) rows of one bundle's block: links of a with b below 0, or a link a, b."""
    left, right = task[task["own"] == task["i"].iloc[0]], task[task["own"] == task["j"].iloc[0]]
    here, out = task["bundle"].iloc[0], []
    same = task["i"].iloc[0] == task["j"].iloc[0]
    for size in set(left["vector"].map(len)):
        p, q = (t[t["vector"].map(len) == size] for t in (left, right))
        if not len(q):
            continue
        u, v = (_unit(np.frombuffer(b"".join(t["vector"]), kind).reshape(len(t), -1)) for t in (p, q))
        # in single precision first, with room for its error; what may be near is computed in double precision
        near = u.astype(np.float32) @ v.astype(np.float32).T >= least - 1e-3
        ids, others = p["node"].to_numpy(), q["node"].to_numpy()
        if same:
            near &= ids[:, None] < others
        some, any_ = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(some):
            continue
        p, q, ids, others = p.iloc[some], q.iloc[any_], ids[some], others[any_]
        near = near[np.ix_(some, any_)] & (u[some] @ v[any_].T >= least) & ~_met_before(p["code"].tolist(), q["code"].tolist(), here)
        x, y = np.nonzero(near)
        if len(x):
            n, m = p["n"].to_numpy(), q["n"].to_numpy()
            for side, gained in ((ids, np.bincount(x, m[y], len(ids))), (others, np.bincount(y, n[x], len(others)))):
                some = np.flatnonzero(gained)
                out.append((side[some], np.full(len(some), -1), gained[some].astype(np.int64)))
            k = _forest(ids[x], others[y])
            out.append((ids[x[k]], others[y[k]], np.zeros(len(k), np.int64)))
    return out


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; vectors with a cosine of ``least`` or more are linked."""
    v = F.col(column)
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        v = v.cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("vector"))
    rows = rows.withColumn("h", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).withColumn("g", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(3), F.col("vector"))))
    # a node is a set of equal vectors, named by its least id (ids below 0 are free for nodes without one)
    groups = rows.where("h is not null").groupBy("h", "g").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("vector").alias("vector"))
    groups = groups.withColumn("node", F.shiftrightunsigned(F.xxhash64("h", "g"), 1))
    names = staged(groups.select("h", "g", "n", "least_id", "node"), "names")
    coded = staged(_coded(groups, names.count(), least, kind), "coded")
    entries = coded.withColumn("bundle", F.explode("bundles")).drop("bundles")
    # only bundles beyond a block are listed
    crowds = entries.groupBy("bundle").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("bundle", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    crowds = staged(crowds, "crowds")
    few = crowds.count() <= MAX_BROADCAST
    met = entries.join(F.broadcast(crowds) if few else crowds, "bundle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bundle", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "n", "vector", "code")

    def compare(task: pd.DataFrame) -> pd.DataFrame:
        found = _met(task, least, kind)
        columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3)]
        return pd.DataFrame(dict(zip(("a", "b", "links"), columns)))

    found = staged(met.groupBy("bundle", "i", "j").applyInPandas(compare, "a long, b long, links long"), "met")
    links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    # one node may hold rows of several ids and one id rows of several nodes: ids are linked to the least id of their node
    least_of = names.select("node", "least_id")
    edges = found.where("b >= 0").join(least_of.select(F.col("node").alias("a"), F.col("least_id").alias("x")), "a").join(least_of.select(F.col("node").alias("b"), F.col("least_id").alias("y")), "b")
    rows = rows.join(names, ["h", "g"], "left")
    within = rows.where("vec_id <> least_id").select(F.col("least_id").alias("a"), F.col("vec_id").alias("b"))
    groups = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(within))
    out = rows.join(links, "node", "left").withColumn("n_links", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)))
    out = out.select("vec_id", "n_links").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
