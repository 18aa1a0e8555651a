"""Hard negatives of anchors by a Voronoi-partitioned kNN join over inner products.

Components become integers (``floor(SCALE * x)``). Each vector gains one more
coordinate that brings it to the largest norm of the table, anchors gain a 0:
the largest inner products are then the smallest distances. Vectors go to the
nearest of a bounded number of pivots and lie in blocks of one cell in order of
the distance to its pivot; anchors lie in groups of neighbouring cells. Three
bounds tell which rows of which cell a group may need: the triangle inequality
around the pivot from both sides and the hyperplane between the pivots of the
two cells. Only blocks that such a range touches are copied to the group, where
their exact scores are computed.

What has to be exceeded is first learned from one block of the anchor's own
cell: the k-th best score there is never above the k-th best of all, so no
answer is lost. First the positives are found this way, then, between the
limits that each positive sets, the negatives. A task holds one group of
anchors and some blocks and returns at most k rows for each list, so neither a
crowded cell nor a popular anchor gathers anywhere.

Defined results: rows with a null id or label, a null vector, a null or
non-finite component or a squared norm beyond double precision take no part; a
shorter vector counts as padded with zeros (an empty one as all zeros); of rows
that repeat an anchor's id the one with the least label, then the least vector,
asks, and none of them answers it; repeated rows of other ids answer once for
each row (``positive_rank`` tells equal positives apart); an anchor without a
row of its own label gives no rows; an empty table gives no rows; other columns
are ignored. Labels are integers. Scores are exact up to 2**53.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veldra.llm.store import staged

#: Components are multiplied by this and rounded down.
SCALE = 256.0
#: Largest number of pivots, and of bytes of their coordinates.
MAX_PIVOTS, PIVOT_BYTES = 2048, 32_000_000
#: Largest number of rows and bytes of a block of candidates, blocks of a task, and expected anchors of a group.
BLOCK_ROWS, BLOCK_BYTES, TASK_BLOCKS, GROUP = 512, 2_000_000, 16, 64
#: Room for rounding in distances, as a share of the largest norm.
ROOM = 1e-6


def _matrix(vectors, kind: str, width: int | None = None) -> np.ndarray:
    """Integer components of raw vectors (bytes), one a row, padded with zeros."""
    lists = [np.frombuffer(v, kind) for v in vectors]
    out = np.zeros((len(lists), max([len(v) for v in lists], default=0) if width is None else width))
    for row, v in zip(out, lists):
        row[: len(v)] = v
    return np.floor(SCALE * out)


class Pivots:
    """Pivots in augmented space; ``top`` is the largest squared norm of all rows."""

    def __init__(self, points: np.ndarray, top: float):
        self.top, self.width = top, points.shape[1]
        self.points, self.last = points, np.sqrt(np.maximum(top - (points**2).sum(axis=1), 0))
        self.room = ROOM * math.sqrt(top) + 1e-9

    @functools.cached_property
    def apart(self) -> np.ndarray:
        """Distances between pivots."""
        return self.distances(self.points, False)

    def distances(self, rows: np.ndarray, anchors: bool) -> np.ndarray:
        """Distance of each row (an anchor has 0 in the further coordinate) to each pivot."""
        squares = (rows**2).sum(axis=1)
        last = np.zeros(len(rows)) if anchors else np.sqrt(np.maximum(self.top - squares, 0))
        inner = rows @ self.points.T + np.outer(last, self.last)
        return np.sqrt(np.maximum((squares + last**2)[:, None] + self.top - 2 * inner, 0))

    def chain(self) -> list[int]:
        """The pivots in an order in which each is followed by a near one."""
        left = set(range(1, len(self.points)))
        out = [0] if len(self.points) else []
        open_ = np.ones(len(self.points), bool)
        open_[:1] = False
        while left:
            row = np.where(open_, self.apart[out[-1]], np.inf)
            out.append(int(row.argmin()))
            open_[out[-1]] = False
            left.discard(out[-1])
        return out

    def ranges(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each cell, between which distances to its pivot rows lie that may score ``least`` to ``most`` with one of the anchors (an empty range: none)."""
        d = self.distances(anchors, True)
        squares = (anchors**2).sum(axis=1) + self.top
        far = np.sqrt(np.maximum(squares - 2 * least, 0))[:, None] + self.room
        near = np.sqrt(np.maximum(squares - 2 * most, 0))[:, None] - self.room
        low, high = np.maximum(d - far, near - d), d + far
        home = d.argmin(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * self.apart[home])
        none = (np.nan_to_num(plane, nan=0.0, posinf=0.0) > far + self.room) | (low > high)
        return np.where(none, np.inf, low).min(axis=0), np.where(none, -np.inf, high).max(axis=0)


def _best(groups: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, *groups[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def _rows(vectors: DataFrame, vec_id: str, column: str, label: str, anchors: Column) -> tuple[DataFrame, str]:
    """id, label, vector (raw numbers) and asks of the rows that take part, and the numbers' kind."""
    v = F.col(column)
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        v = v.cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                c = b.slice(a, 1024)
                lists = [np.asarray(x, kind) for x in c.column(2).to_pylist()]
                with np.errstate(over="ignore"):
                    squares = np.array([(np.floor(SCALE * x.astype(float)) ** 2).sum() for x in lists], float)
                out = pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([x.tobytes() for x in lists], pa.binary()), pa.array(squares), c.column(3)], ["id", "label", "vector", "squares", "asks"])
                yield out.filter(pa.array(np.isfinite(squares)))

    return rows.mapInArrow(raw, "id long, label long, vector binary, squares double, asks boolean"), kind


def _pivots(rows: DataFrame, n: int, kind: str, width: int, top: float) -> Pivots:
    """Different vectors with the smallest hashes: about the root of the number of rows, at most ``MAX_PIVOTS`` and ``PIVOT_BYTES``."""
    want = max(1, min(math.isqrt(n), MAX_PIVOTS, PIVOT_BYTES // (8 * max(width, 1))))
    share = min(1.0, 2 * want / n)
    hashed = rows.withColumn("h", F.xxhash64("vector"))
    few = hashed.where(F.col("h") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else hashed
    found = few.groupBy("h").agg(F.first("vector").alias("vector")).orderBy("h").limit(want).collect()
    if not found:  # nearly all rows are alike and their hashes are above the bound
        found = hashed.agg(F.min_by("vector", "h").alias("vector")).collect()
    return Pivots(_matrix([r["vector"] for r in found], kind, width), top)


def _blocks(rows: DataFrame, pivots: Pivots, kind: str) -> DataFrame:
    """Blocks of rows of one cell, next to each other by the distance to its pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                c = b.slice(a, 2048)
                d = pivots.distances(_matrix(c.column(2).to_pylist(), kind, pivots.width), False)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*c.columns[:3], pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "label", "vector", "cell", "d"])

    def packed(rows: list[tuple], cell: int) -> pa.RecordBatch:
        ids, labels, vectors, d = zip(*rows)
        width = max(len(v) for v in vectors)
        data = [[cell], [d[0]], [d[-1]], [len(rows)], [np.array(ids, "<i8").tobytes()], [np.array(labels, "<i8").tobytes()], [b"".join(v.ljust(width, b"\0") for v in vectors)]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kinds)], names)

    names = ["cell", "low", "high", "rows", "ids", "labels", "vectors"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, width = None, 0
        for b in batches:
            for i, label, v, cell, d in zip(*(x.to_pylist() for x in b.columns)):
                width_now = max(width, len(v))
                if held and (cell != last or len(held) >= BLOCK_ROWS or width_now * (len(held) + 1) > BLOCK_BYTES):
                    yield packed(held, last)
                    held, width_now = [], len(v)
                held.append((i, label, v, d))
                last, width = cell, width_now
        if held:
            yield packed(held, last)

    placed = rows.mapInArrow(assign, "id long, label long, vector binary, cell int, d double")
    # rows of one cell may go to many tasks; equal distances are told apart by id
    placed = placed.repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d", "id")
    blocks = placed.mapInArrow(pack, "cell int, low double, high double, rows int, ids binary, labels binary, vectors binary")
    return staged(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _anchors(rows: DataFrame, pivots: Pivots, kind: str) -> DataFrame:
    """id, label, vector, home (the nearest pivot) and group of each anchor; groups are made of neighbouring cells, crowded cells make several."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                c = b.slice(a, 2048)
                home = pivots.distances(_matrix(c.column(2).to_pylist(), kind, pivots.width), True).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(home.astype(np.int32))], ["id", "label", "vector", "home"])

    asked = rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    placed = staged(asked.mapInArrow(assign, "id long, label long, vector binary, home int"), "anchors")
    counts = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most one row a pivot
    first, slices, now, held = {}, {}, 0, 0
    for cell in pivots.chain():
        n = counts.get(cell, 0)
        if held and held + n > GROUP:
            now, held = now + 1, 0
        first[cell], slices[cell] = now, max(1, -(-n // GROUP))
        held += n
        if slices[cell] > 1:
            now, held = now + slices[cell], 0
    plan = placed.sparkSession.createDataFrame([(c, first[c], slices[c]) for c in first], "home int, first long, slices int")  # at most one row a pivot
    return staged(placed.join(F.broadcast(plan), "home").select("id", "label", "vector", "home", (F.col("first") + F.pmod(F.xxhash64("id"), "slices")).alias("group")), "grouped")


def _joined(blocks: DataFrame, n_blocks: int, ranges: DataFrame, anchors: DataFrame, kind: str, limits: bool, k: int) -> DataFrame:
    """anchor, place, other, score: the first k rows of each list of each anchor, by task; the blocks are copied to the groups whose range of their cell they touch.

    Without ``limits`` the list is of rows of the anchor's label, with a score of ``tau`` or more; with them there is one list for each
    of its positives, of rows of other labels within that positive's limits.
    """
    tasks = max(1, -(-n_blocks // TASK_BLOCKS))
    sent = blocks.join(ranges, "cell").where("low <= upto and high >= since")
    sent = sent.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)))
    keys = sent.select(F.col("group").alias("g"), F.col("task").alias("t")).distinct()
    asked = anchors.withColumnRenamed("group", "g").join(keys, "g")

    def compare(asking: pd.DataFrame, answering: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asking) and len(answering):
            ids, labels = asking["id"].to_numpy()[:, None], asking["label"].to_numpy()[:, None]
            vectors = _matrix(asking["vector"], kind)
            if not limits:
                lists = [(0, None, asking["tau"].to_numpy()[:, None])]
            else:
                positive, taus = asking["scores"].tolist(), asking["taus"].tolist()
                lists = [(p, *(np.array([x[p] if p < len(x) else np.nan for x in v])[:, None] for v in (positive, taus))) for p in range(max(map(len, positive)))]
            for n, i, own, raw in zip(*(answering[c] for c in ("rows", "ids", "labels", "vectors"))):
                others, own = np.frombuffer(i, "<i8"), np.frombuffer(own, "<i8")
                cand = np.floor(SCALE * np.frombuffer(raw, kind).reshape(n, -1).astype(float))
                width = min(vectors.shape[1], cand.shape[1])
                scores = vectors[:, :width] @ cand[:, :width].T
                able = (labels != own if limits else labels == own) & (ids != others)
                for place, positive_score, tau in lists:
                    # a positive that the anchor lacks is NaN and lets nothing through
                    fit = able & (scores >= tau) & ((30 * positive_score <= 100 * scores) & (100 * scores <= 90 * positive_score) if limits else True)
                    r, c = np.nonzero(fit)
                    if len(r):
                        best = _best([r], scores[r, c], others[c], k)
                        r, c = r[best], c[best]
                        out.append((ids[r, 0], np.full(len(r), place), others[c], scores[r, c]))
        anchor, place, other, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 4
        best = _best([anchor, place], score, other, k)
        return pd.DataFrame({"anchor": anchor[best], "place": place[best], "other": other[best], "score": score[best].astype(float)})

    return sent.groupBy("group", "task").cogroup(asked.groupBy("g", "t")).applyInPandas(lambda x, y: compare(y, x), "anchor long, place int, other long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each list from the first k of each task; no task sends more, so a list stays short."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranges(anchors: DataFrame, pivots: Pivots, kind: str, limits: bool) -> DataFrame:
    """group, cell, since, upto: the rows that a group of anchors may need."""

    def bound(group: pd.DataFrame) -> pd.DataFrame:
        rows = _matrix(group["vector"], kind, pivots.width)
        if limits:
            least = np.array([min(max(0.3 * s, t) for s, t in zip(x, y)) for x, y in zip(group["scores"], group["taus"])])
            most = np.array([max(0.9 * s for s in x) for x in group["scores"]])
        else:
            least, most = group["tau"].to_numpy(), np.full(len(group), np.inf)
        low, high = pivots.ranges(rows, least, most)
        some = np.flatnonzero(low <= high)
        return pd.DataFrame({"group": np.full(len(some), group["group"].iloc[0]), "cell": some.astype(np.int32), "since": low[some], "upto": high[some]})

    return anchors.groupBy("group").applyInPandas(bound, "group long, cell int, since double, upto double")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, vec_id: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score and positive_rank for the rows where ``anchors`` holds.

    Positives are the first ``positives`` rows of the anchor's label, negatives
    of each of them the first ``negatives`` rows of other labels with 30 to 90
    percent of the positive's score.
    """
    spark = vectors.sparkSession
    rows, kind = _rows(vectors, vec_id, column, label, anchors)
    stats = rows.agg(F.count("*").alias("n"), F.max("squares").alias("top"), F.max(F.octet_length("vector")).alias("bytes")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    width = stats["bytes"] // np.dtype(kind).itemsize
    pivots = _pivots(rows, stats["n"], kind, width, stats["top"])
    blocks = _blocks(rows.drop("asks", "squares"), pivots, kind)
    n_blocks = blocks.count()
    asking = _anchors(rows, pivots, kind)
    # one block of each cell, the one nearest to its pivot, sets what has to be exceeded
    first = blocks.groupBy("cell").agg(F.min_by("block", F.struct("low", "block")).alias("block"))
    pilot = blocks.join(first, ["cell", "block"])
    homes = asking.select("group", F.col("home").alias("cell")).distinct().withColumn("since", F.lit(float("-inf"))).withColumn("upto", F.lit(float("inf")))

    found = _ranked(_joined(pilot, n_blocks, homes, asking.withColumn("tau", F.lit(float("-inf"))), kind, False, positives), positives)
    tau = found.groupBy(F.col("anchor").alias("id")).agg(F.max(F.when(F.col("rank") == positives, F.col("score"))).alias("tau"))
    bounded = staged(asking.join(tau, "id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("-inf")))), "bounded")
    found = staged(_ranked(_joined(blocks, n_blocks, _ranges(bounded, pivots, kind, False), bounded, kind, False, positives), positives), "positives")

    listed = found.groupBy(F.col("anchor").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    asking = staged(asking.join(listed, "id").withColumn("taus", F.transform("scores", lambda s: F.lit(float("-inf")))), "asking")
    some = _ranked(_joined(pilot, n_blocks, homes, asking, kind, True, negatives), negatives)
    taus = some.where(F.col("rank") == negatives).groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("known"))
    bounded = asking.join(taus, "id", "left").withColumn("taus", F.transform("scores", lambda s, i: F.coalesce(F.col("known")[i], F.lit(float("-inf"))))).drop("known")
    bounded = staged(bounded, "bounded_negatives")
    mined = _ranked(_joined(blocks, n_blocks, _ranges(bounded, pivots, kind, True), bounded, kind, True, negatives), negatives)
    of = found.select("anchor", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    out = mined.join(of, ["anchor", "place"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").cast("long").alias("negative_score"), (F.col("place") + 1).alias("positive_rank"))
