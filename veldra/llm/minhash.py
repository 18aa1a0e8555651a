"""Near-duplicate documents by MinHash with banding, verified on full shingle sets.

Every set of word shingles is sketched by the minima of many universal hash
functions. Bands of minima name buckets; within a bucket, members are paired
with one head at a time (never all with all), pairs whose signatures rule out
the threshold are dropped, and the others are verified on their full sets, by
the words themselves. Components are kept as labels, and each round joins only
what it has found.
Heads change from round to round; when stars make no more progress, the pairs
that are still open inside buckets (different components, never compared) are
compared exhaustively, so no link between components is lost to the star
shape. Large buckets are compared block by block on parity signatures, whose
distance never exceeds the size of the sets' difference; such a block emits
only the pairs that this bound leaves open. Components come from alternating large-star and small-star.

Words are runs of anything but space and the control characters 9 to 13, with
A to Z lower-cased. A document's set holds its distinct ``words``-word
shingles, or the whole sequence if it is shorter.

Defined results: null, empty and blank texts have empty sets and link with
nothing; documents with equal sets (named by 128 bits of two independent hash
families) are collapsed before banding and share a component; rows that repeat an id count as one document; a row without an id
links with nothing, its component is null and it is kept; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veldra.llm.components import merged
from veldra.llm.store import staged
from veldra.llm.textcore import U64, Words, chunks, distinct_words, flat, mix, runs

#: Minima in a band.
ROWS = 4
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-7
#: Standard deviations below the threshold at which a sketch rules a pair out.
SPREAD = 5.5
#: Bits of a parity signature: bit i tells whether an odd number of shingles hashes to i.
PARITY = 2048
#: Larger buckets are compared in blocks of so many members at most (about).
BLOCK = 1024
#: Buckets up to this size are compared by a join.
SMALL = 64
#: Ids of candidates are broadcast up to this many (16 bytes each) and joined by shuffle beyond.
BROADCAST_IDS = 250_000
#: Rounds of star comparisons before open pairs are compared exhaustively.
STAR_ROUNDS = 6


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (in text order) and the text of each."""
    first, owner = _places(words.counts, words.bounds, size)
    return _hashed(words.hashes, first, words.counts[owner], size), owner


def _places(n: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each shingle; a shorter text has one shingle."""
    per = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), per)
    return bounds[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per), owner


def _hashed(hashes: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles that begin at ``first`` in texts of ``n`` words."""
    out = np.empty(len(first), U64)
    for k in range(1, size + 1):  # shorter texts are one run of all their words
        at = np.flatnonzero(n == k if k < size else n >= size)
        if len(at):
            out[at] = mix(runs(hashes, k)[first[at]] + U64(k))
    return out


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128-bit name of the set), buckets array<long>, minima (32 bits each) and parity binary."""
    n_hashes = bands * ROWS
    rng = np.random.default_rng(20_011)
    mul = rng.integers(0, 1 << 63, n_hashes, np.uint64) * U64(2) + U64(1)
    add = rng.integers(0, 1 << 63, n_hashes, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found = Words(*flat(b.column(1)), lower=True, hashes=2)
            first, owner = _places(found.counts, found.bounds, words)
            hashes = _hashed(found.hashes, first, found.counts[owner], words)
            at = distinct_words(hashes, owner)
            hashes, first, owner = hashes[at], first[at], owner[at]
            others = _hashed(found.others, first, found.counts[owner], words)
            n = np.bincount(owner, minlength=b.num_rows)
            some = np.flatnonzero(n)
            firsts = (np.cumsum(n) - n)[some]
            minima = np.zeros((b.num_rows, n_hashes), U64)
            names = np.zeros((2, b.num_rows), U64)
            if len(some):
                for i in range(n_hashes):
                    minima[some, i] = np.minimum.reduceat(hashes * mul[i] + add[i], firsts)
                names[0, some] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), firsts)
                names[1, some] = np.add.reduceat(mix(others ^ U64(0x14057B7EF767814F)), firsts)
            keys = np.zeros((b.num_rows, bands), U64) + np.arange(bands, dtype=U64)
            for r in range(ROWS):
                keys = mix(keys * U64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
            short = (minima >> U64(32)).astype("<u4")
            places = owner * PARITY + (mix(hashes ^ U64(0x2545F4914F6CDD1D)) >> U64(64 - PARITY.bit_length() + 1)).astype(np.int64)
            odd = np.zeros(b.num_rows * PARITY, np.uint8)
            where, times = np.unique(places, return_counts=True)
            odd[where] = times & 1
            parity = np.packbits(odd)
            ends = np.arange(b.num_rows + 1, dtype=np.int32)
            fixed = lambda x, size: pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), b.num_rows, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(n, pa.int64()), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends * bands), pa.array(keys.view(np.int64).ravel())),
                fixed(short, 4 * n_hashes), fixed(parity, PARITY // 8),
            ], ["doc_id", "n_shingles", "set_a", "set_b", "buckets", "minima", "parity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, buckets array<long>, minima binary, parity binary")


def _apart(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of sets of these sizes at the threshold (rounded up)."""
    total = (n_a + n_b).astype(float)
    return np.ceil(total - 2 * percent * total / (100 + percent) + 1e-6)


def _words64(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), U64).reshape(len(column), -1)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int, n_hashes: int) -> DataFrame:
    """Pairs whose sizes and signatures do not rule the threshold out."""
    t = percent / 100
    least = math.floor(n_hashes * t - SPREAD * math.sqrt(n_hashes * t * (1 - t)))
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("minima").alias(f"m_{x}"), F.col("parity").alias(f"p_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                m, k = (np.frombuffer(b"".join(x.column(i).to_pylist()), "<u4").reshape(x.num_rows, -1) for i in (4, 5))
                p, q = (_words64(x.column(i).to_pylist()) for i in (6, 7))
                n_a, n_b = (x.column(i).to_numpy() for i in (2, 3))
                keep = (m == k).sum(axis=1) >= least
                keep &= np.bitwise_count(p ^ q).sum(axis=1) <= _apart(n_a, n_b, percent)
                yield x.select([0, 1]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "m_a", "m_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of one bucket and two components that parity signatures leave open; only what no star could settle comes here."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    sized = members.select("bucket", "doc_id", "component").join(sizes, "bucket")
    small = sized.where(F.col("n") <= SMALL)
    other = small.select("bucket", F.col("doc_id").alias("y"), F.col("component").alias("other"))
    pairs = small.withColumnRenamed("doc_id", "x").join(other, "bucket").where("component < other").select("x", "y")

    large = sized.where(F.col("n") > SMALL).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    large = large.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "doc_id", "component")
    large = large.join(sets.select("doc_id", "n_shingles", "parity", F.col("buckets").alias("all")), "doc_id")

    def compare(t: pd.DataFrame) -> pd.DataFrame:
        left, right = t[t["own"] == t["i"].iloc[0]], t[t["own"] == t["j"].iloc[0]]
        out = [np.empty((0, 2), np.int64)]
        p, q = _words64(left["parity"].tolist()) if len(left) else None, _words64(right["parity"].tolist()) if len(right) else None
        if p is None or q is None:
            return pd.DataFrame(out[0], columns=["x", "y"])
        n, comp, ids = right["n_shingles"].to_numpy(), right["component"].to_numpy(), right["doc_id"].to_numpy()
        bands = np.array(right["all"].tolist())
        mine = np.array(left["all"].tolist())
        same = left["i"].iloc[0] == left["j"].iloc[0]
        for r, (i, c, size) in enumerate(zip(left["doc_id"].tolist(), left["component"].tolist(), left["n_shingles"].tolist())):
            hit = (comp != c) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
            if same:
                hit &= ids > i
            hit = np.flatnonzero(hit)
            hit = hit[np.bitwise_count(q[hit] ^ p[r]).sum(axis=1) <= _apart(n[hit], np.int64(size), percent)]
            if len(hit):  # a pair belongs to the first bucket that it shares
                hit = hit[mine[r][(bands[hit] == mine[r]).argmax(axis=1)] == t["bucket"].iloc[0]]
                out.append(np.stack([np.full(len(hit), i), ids[hit]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["x", "y"])

    return pairs.unionByName(large.groupBy("bucket", "i", "j").applyInPandas(compare, "x long, y long"))


class _Numbers(dict):
    """Words by number, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def overlaps(left: pa.Array, right: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and of the union of the shingle sets of each pair of texts, by the words themselves (no hashes)."""
    number = _Numbers()
    sides = []
    for texts in (left, right):
        parts = []
        for t in texts.to_pylist():
            w = (t or "").encode().lower().split()
            parts.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        sides += parts
    n = np.array([len(p) for p in sides], np.int64)
    flat_words = np.concatenate([*sides, np.zeros(size, np.int64)])
    first, owner = _places(n, np.r_[0, np.cumsum(n)], size)
    name = flat_words[first]
    for k in range(1, size):  # 0 stands for the words that a short text lacks
        more = np.where(k < n[owner], flat_words[first + k], 0)
        name = np.unique(name * (len(number) + 1) + more, return_inverse=True)[1]
    pair = owner % len(left)
    key = np.unique((name * 2 + owner // len(left)) + pair * (2 * (name.max(initial=0) + 1)))
    in_pair = key // (2 * (name.max(initial=0) + 1))
    sizes = np.bincount(in_pair, minlength=len(left))
    common = np.bincount(in_pair[1:][(key[1:] >> 1 == key[:-1] >> 1)], minlength=len(left))
    return common, sizes - common


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text_a"):
            for x in chunks(iter([part]), "text_b"):
                common, union = overlaps(x.column(2), x.column(3), words)
                yield x.select([0, 1]).filter(pa.array((common > 0) & (100 * common >= percent * union)))

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: documents whose shingle sets have 100 * intersection >= percent * union are linked."""
    bands = bands_for(percent)
    rows = staged(sketches(docs, words, bands), "sketches")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    heads = named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("head"))
    same = staged(named.select("doc_id", "set_a", "set_b").join(heads, ["set_a", "set_b"]).select("doc_id", "head").distinct(), "same")
    sets = named.join(same.where("doc_id = head").select("doc_id").distinct(), "doc_id", "left_semi")
    links = same.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))

    buckets = sets.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = staged(buckets.join(shared, "bucket"), "buckets")
    sketch = sets.select("doc_id", "n_shingles", "minima", "parity")
    labels, tried, open_before = None, None, None
    members = buckets.withColumn("component", F.col("doc_id"))
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            members = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            mixed = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
            members = staged(members.join(mixed, "bucket", "left_semi"), "open")
        still = members.count()
        if not still:
            break
        last = turn == STAR_ROUNDS or open_before is not None and still >= 0.9 * open_before
        if last:
            pairs = _open_pairs(members, sets.select("doc_id", "n_shingles", "parity", "buckets"), percent)
        else:
            # a star around one member of each bucket, another one each round
            rank = F.struct((F.col("doc_id") if not turn else F.xxhash64("doc_id", F.lit(turn))).alias("order"), F.col("doc_id"), F.col("component"))
            center = members.groupBy("bucket").agg(F.min(rank).alias("c"))
            pairs = members.join(center, "bucket").where("component <> c.component").select(F.col("c.doc_id").alias("x"), F.col("doc_id").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        labels = merged(labels, _verified(staged(_likely(pairs, sketch, percent, bands * ROWS), "likely"), docs, words, percent))
        if last:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        open_before = still
    if same.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        groups = merged(labels, links)  # documents that repeat an id may stand in several sets
    elif labels is None:
        groups = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    else:
        copies = links.join(labels.withColumnRenamed("node", "a"), "a", "left").select(F.col("b").alias("node"), F.coalesce("component", "a").alias("component"))
        groups = labels.unionByName(copies)
    groups = groups.withColumnRenamed("node", "doc_id")
    out = rows.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each group, and of rows that repeat its id and text one; rows without an id stay."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    ids = staged(ids, "repeated")
    if ids.count():
        # no more rows are shuffled whole than repeat an id
        rows = docs.withColumn("__id", F.col("doc_id").cast("long"))
        again = rows.join(ids, "__id", "left_semi").withColumn("__h", F.xxhash64("text")).withColumn("__g", F.xxhash64(F.lit(5), F.col("text"))).dropDuplicates(["__id", "__h", "__g"])
        docs = staged(rows.join(ids, "__id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns)), "rows")
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
