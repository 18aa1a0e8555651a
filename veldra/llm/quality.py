"""Document quality by random Fourier features, ridge regression and isotonic calibration.

Statistics of a text (shares of character classes, word and line shapes,
repetition) are standardised and mapped to cosines of random projections,
which approximate a Gaussian kernel. Each partition sums its part of the
normal equations, the sums give ridge weights, and pool-adjacent-violators on
binned scores of rows that were not fitted turns raw scores into rising
probabilities.

Defined results: null counts as empty, and empty texts get the score of their
(zero) statistics; labels other than 0 and 1, and null ones, are left out, and
repeated labels of a document count once each;
with fewer than two classes to learn from, every score is the share of label 1
(0.5 without labels); rows are kept one to one; labels, language, source and
id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from veldra.llm.store import staged
from veldra.llm.textcore import IS_SPACE, Words, chunks, distinct_words, flat

#: Cosines of the feature map.
FEATURES = 192
#: Kernel width in units of the root of the number of statistics.
WIDTH = 0.7
RIDGE = 1e-3
#: Labelled rows that are fitted at most; beyond, a hash of the id picks this many.
MAX_FIT_ROWS = 500_000
#: Partitions that sum normal equations, each of (FEATURES + 1) ** 2 doubles.
SUMS = 16
#: Bins of raw scores for the calibration.
BINS = 256
_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate([range(97, 123), range(65, 91), range(48, 58), b".,;:'\"-?()", b"!", b"#$%&*@^~+=<>_\\/", b"|[]{}`", range(128, 256)], 1):
    _CLASS[list(_set)] = _i
_CLASS[10] = 9


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    buf, off = flat(texts)
    words = Words(buf, off)
    n_bytes, n = np.diff(off), words.counts.astype(float)
    safe = lambda x, y: x / np.maximum(y, 1)
    kind = _CLASS[buf]
    some = np.flatnonzero(n_bytes)

    def per_text(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n_bytes))
        if len(some):
            out[some] = np.add.reduceat(mask, off[some], dtype=np.int64)
        return out

    counts = [per_text(kind == k) for k in range(1, 10)]
    out = [safe(c, n_bytes) for c in counts]
    lengths = (words.ends - words.starts).astype(float)
    some_words = np.flatnonzero(words.counts)

    def per_word(values: np.ndarray, how=np.add) -> np.ndarray:
        res = np.zeros(len(n))
        if len(some_words):
            res[some_words] = how.reduceat(values, words.bounds[some_words])
        return res

    mean = safe(per_word(lengths), n)
    first, last = (kind[words.starts], kind[words.ends - 1]) if len(lengths) else (kind[:0], kind[:0])
    owner = np.repeat(np.arange(len(n)), words.counts)
    unique = np.bincount(owner[distinct_words(words.hashes, owner)], minlength=len(n)) if len(owner) else np.zeros(len(n))
    lines = counts[8] + (n_bytes > 0)
    out += [
        np.log1p(n_bytes), np.log1p(n), mean, np.sqrt(np.maximum(safe(per_word(lengths**2), n) - mean**2, 0)), np.log1p(per_word(lengths, np.maximum)),
        safe(unique, n), safe(per_word((first == 2).astype(float)), n), safe(per_word(np.isin(last, (5, 6, 7)).astype(float)), n),
        safe(per_word(((first == 6) | (first == 7)).astype(float)), n), safe(per_word((lengths <= 3).astype(float)), n), np.log1p(safe(n, lines)),
        safe(per_text(IS_SPACE[buf]), n_bytes),
    ]
    return np.stack(out, axis=1)


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats`` array<float> of every text."""
    schema = StructType([*(docs.schema[k] for k in keep), StructField("stats", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "__text"):
            x = statistics(b.column(b.num_columns - 1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


@dataclass
class Model:
    """Standardisation, projections, ridge weights and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def scores(self, stats: np.ndarray, calibrate: bool = True) -> np.ndarray:
        raw = self.lifted(stats) @ self.weights
        return np.interp(raw, self.raw, self.calibrated) if calibrate else raw


def rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def fit(rows: DataFrame, seed: int = 7) -> Model:
    """A model from ``stats`` and ``label`` (0 or 1); ``pick`` is a long that names rows for the calibration part."""
    width = statistics(pa.array(["a"])).shape[1]
    rows = staged(rows.select("stats", F.col("label").cast("double").alias("label"), F.xxhash64("pick").alias("pick")), "labelled")
    n, positives = rows.agg(F.count("*"), F.sum("label")).first()
    rng = np.random.default_rng(seed)
    base = (positives or 0) / n if n else 0.5
    if not n or positives in (0, n):
        return Model(np.zeros(width), np.ones(width), np.zeros((width, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([base]))
    moments = rows.select(*[F.col("stats")[i].cast("double").alias(f"s{i}") for i in range(width)]).agg(*[f(F.col(f"s{i}")) for f in (F.avg, F.stddev_pop) for i in range(width)]).first()
    mean, scale = np.array(moments[:width], float), np.array(moments[width:], float)
    scale[~(scale > 1e-9)] = 1.0
    model = Model(mean, scale, rng.normal(size=(width, FEATURES)) / (WIDTH * np.sqrt(width)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    fitted = F.pmod("pick", F.lit(5)) != 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, seen = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for b in batches:
            if b.num_rows:
                z, y = model.lifted(_matrix(b.column(0), width)), b.column(1).to_numpy()
                left, right, seen = left + z.T @ z, right + z.T @ y, seen + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()]), pa.array([seen])], ["left", "right", "seen"])

    parts = rows.where(fitted).select("stats", "label").repartition(SUMS).mapInArrow(sums, "left binary, right binary, seen long").collect()
    left = sum(np.frombuffer(p["left"]).reshape(FEATURES + 1, -1) for p in parts)
    right = sum(np.frombuffer(p["right"]) for p in parts)
    seen = max(sum(p["seen"] for p in parts), 1)
    model.weights = np.linalg.solve(left + RIDGE * seen / FEATURES * np.eye(FEATURES + 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.clip((model.scores(_matrix(b.column(0), width), False) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], ["bin", "label"])

    bins = rows.where(~fitted).select("stats", "label").mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").toPandas()
    if not len(bins):
        bins = pd.DataFrame({"bin": [BINS // 2], "n": [1], "ones": [base]})
    model.raw = (bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    model.calibrated = np.clip(rising((bins["ones"] / bins["n"]).to_numpy(float), bins["n"].to_numpy(float)), 0, 1)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: a fifth of all, by the checksum of the id's text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """A model from the labels that are not held out; of more than ``max_rows``, a hash of the id picks about as many. Statistics are taken of their texts alone."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.shiftright(F.xxhash64("doc_id"), 20), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # about max_rows labels at most
    return fit(with_statistics(texts, ("doc_id", "label")).withColumnRenamed("doc_id", "pick"))


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    return model.scores(statistics(texts).astype(np.float32).astype(float)) if len(texts) else np.empty(0)


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out and score of every document; learns from the labelled rows that are not held out."""
    model = learnt(docs, labels, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(model, b.column(1)))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("held_out", held_out(F.col("doc_id")))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose own text scores ``least`` or more, whatever rows share their id; nothing is shuffled."""
    model = learnt(docs, labels, max_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.filter(pa.array(_scores(model, b.column(at)) >= least))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
