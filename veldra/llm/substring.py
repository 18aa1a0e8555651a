"""Passages that repeat across a corpus, by a log-structured fingerprint index.

The fingerprint of a window of ``window`` words is the least hash among its
``GRAM``-word runs; equal windows have equal fingerprints, and neighbouring
windows mostly share one, so about a twelfth of all positions is indexed. Each
batch becomes an immutable run of (fingerprint, occurrences), bucketed and
sorted by fingerprint. A new run is merge-joined with every earlier one, bucket
by bucket and without a shuffle; what they share, and what the new run holds
more than once, is added to the fingerprints that repeat. ``FAN_IN`` runs of a
level are compacted into one of the next, so an index of n batches holds about
FAN_IN * log(n) runs.

An index that keeps history also writes, for each batch, a run of all its window
digests with their count and one place each, bucketed and sorted by digest. A
batch is then cleaned against all batches before it by their runs alone,
whether it has been appended already (a second look) or not: the digests of its
windows are shuffled into the buckets and merge-joined with each run; earlier
texts are not read again. A row whose id and text the index has seen is taken
as that row, not as a copy of it. An index lies in a folder: ``open`` finds it
again in another application by the newest of its manifests, which is written
after all files that it names.

Only windows whose fingerprint repeats are compared: a bit map of fixed size
(broadcast; false hits cost rows, never results) picks them in a second scan.
What they have in common is verified by 96 bits of a cryptographic digest
(BLAKE2b) of their words, counted over the whole corpus, not by the hashes that
picked them. Of equal texts one speaks for all: whole copies of a window or
more are repeats throughout.

Defined results: words are runs of anything but space and the control
characters 9 to 13, unchanged; null and blank texts have no words; texts
shorter than a window keep everything; every occurrence of a repeated window
goes, the first one and those inside one document included; rows that repeat
an id with the same text count as two documents; an empty table gives no rows;
columns not named in ``keep`` are left out; ``names`` renames the added columns
where ``keep`` has columns of those names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veldra.llm.store import new_path, staged
from veldra.llm.textcore import U64, Words, chunks, flat, mix, runs

GRAM = 12
#: Runs of a level that are merged into one of the next.
FAN_IN = 4
#: Batches in which a whole table is indexed.
BATCHES = 3
#: Bits for each repeated fingerprint in the bit map, and its largest size in bits (8 MB).
BITS_EACH, MOST_BITS = 12, 1 << 26
#: Keys of changed texts are broadcast up to this many (16 bytes each) and joined by shuffle beyond.
BROADCAST_KEYS = 250_000


def _sliding(values: np.ndarray, size: int, how: np.ufunc) -> np.ndarray:
    """``how`` over ``size`` values from each place on, by doubling."""
    if len(values) < size:
        return values[:0]
    have = 1
    while 2 * have <= size:
        values = how(values[:-have], values[have:])
        have *= 2
    return how(values[: -(size - have)], values[size - have :]) if size > have else values


def _fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and fingerprint of every window, and the hashes of all runs of ``GRAM`` words (or of ``window``, if that is less)."""
    gram = min(GRAM, window)
    full = np.maximum(words.counts - window + 1, 0)
    starts = np.repeat(words.bounds[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    grams = runs(words.hashes, gram)
    return starts, _sliding(grams, window - gram + 1, np.minimum)[starts], grams


def _anchors(starts: np.ndarray, least: np.ndarray, grams: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the runs that are the least of some window, one for each place."""
    width = window - min(GRAM, window) + 1
    of_window = np.zeros(len(grams) + width - 1, U64)
    of_window[starts + width - 1] = least
    # a run is the least of some window if the largest fingerprint of those around it is its own
    return grams[_sliding(of_window, width, np.maximum) == grams]


def _spaced(buf: np.ndarray, words: Words) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """All words with one space between, and where each begins and ends."""
    size = words.ends - words.starts
    first = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    joined[inside] = buf[inside - np.repeat(first - words.starts, size)]
    return memoryview(joined.tobytes()), first, first + size


def _digests(spaced: tuple[memoryview, np.ndarray, np.ndarray], starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits (as 64 and 32) of the BLAKE2b digest of the words of each window."""
    data, first, last = spaced
    of = hashlib.blake2b
    raw = b"".join([of(data[a:b], digest_size=12).digest() for a, b in zip(first[starts].tolist(), last[starts + window - 1].tolist())])
    both = np.frombuffer(raw, np.dtype([("h", "<i8"), ("g", "<i4")]))
    return np.ascontiguousarray(both["h"]), np.ascontiguousarray(both["g"])


def _place() -> Column:
    """Where a window stands: the key of its text and its start."""
    return F.xxhash64("__key", "__more", "start")


def _keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, __id, __key and __more (96 bits that name id and text), hashes of the text, and __text."""
    text, doc_id = F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(*keep, doc_id.alias("__id"), F.xxhash64(doc_id, text).alias("__key"), F.shiftright(F.xxhash64(F.lit(5), doc_id, text), 32).cast("int").alias("__more"), F.xxhash64(text).alias("__t"), F.xxhash64(F.lit(7), text).alias("__u"), text.alias("__text"))


def _marked(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, __key and __more (they name id and text), __text, and for texts that occur more than once __rep, the least id among their rows."""
    rows = _keyed(docs, keep)
    copies = staged(rows.where("length(__text) > 0").groupBy("__t", "__u").agg(F.count("*").alias("__n"), F.min("__id").alias("__rep")).where("__n > 1").drop("__n"), "copies")
    if copies.count() <= BROADCAST_KEYS:
        copies = F.broadcast(copies)
    return rows.join(copies, ["__t", "__u"], "left").drop("__t", "__u")


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = mix(hashes ^ U64(0xBF58476D1CE4E5B9))
    return (m & U64(bits - 1)).astype(np.int64), (m >> U64(32)).astype(np.int64) & (bits - 1)


def _in_map(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    x, y = _places(hashes, bits)
    return ((table[x >> 6] >> (x & 63).astype(U64)) & (table[y >> 6] >> (y & 63).astype(U64)) & U64(1)).astype(bool)


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints and, with ``history``, of window digests, in a folder; ``append`` batches, then ask what repeats in any batch."""

    def __init__(self, spark: SparkSession, window: int = 35, fan_in: int = FAN_IN, history: bool = True, path: str | None = None, buckets: int | None = None):
        # as many buckets as a shuffle has partitions: what is summed up there is in its bucket already, and a run is one file a bucket
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.window, self.fan_in, self.history, self.buckets = spark, window, fan_in, history, buckets
        self.path = path or new_path(spark, "index")
        self.runs: list[dict] = []
        self.window_runs: list[dict] = []
        self.hits: list[str] = []
        self.version = 0
        self._tables: dict[str, str] = {}
        if path and self._versions():
            raise FileExistsError(f"{path} holds an index already")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index in a folder as its newest manifest describes it."""
        index = cls.__new__(cls)
        index.spark, index.path, index._tables = spark, path, {}
        versions = index._versions()
        if not versions:
            raise FileNotFoundError(f"{path} holds no index")
        index.version = max(versions)
        text = spark.read.text(f"{path}/manifest-{index.version:08d}.json", wholetext=True).first()[0]
        state = json.loads(text)
        index.window, index.fan_in, index.history, index.buckets = (state[k] for k in ("window", "fan_in", "history", "buckets"))
        index.runs, index.window_runs, index.hits = state["runs"], state["window_runs"], state["hits"]
        return index

    def _fs(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        place, fs = self._fs()
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return [int(n[9:17]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _commit(self, gone: list[str] = ()) -> None:
        """Write the next manifest, under a hidden name first; then remove what it no longer names."""
        place, fs = self._fs()
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.version += 1
        state = {"window": self.window, "fan_in": self.fan_in, "history": self.history, "buckets": self.buckets, "runs": self.runs, "window_runs": self.window_runs, "hits": self.hits}
        hidden, final = make(place, f".manifest-{uuid.uuid4().hex}"), make(place, f"manifest-{self.version:08d}.json")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(hidden, final):
            raise OSError(f"cannot write {final}")
        for name in gone:
            if table := self._tables.pop(name, None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            fs.delete(make(place, name), True)

    def _write(self, rows: DataFrame, by: tuple[str, ...], level: int) -> dict:
        """A new run of the rows, bucketed and sorted by ``by``."""
        name = f"run-{uuid.uuid4().hex}"
        table = self._tables[name] = "veldra_" + name.replace("-", "_")
        rows.write.format("parquet").bucketBy(self.buckets, *by).sortBy(*by).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(table)
        return {"name": name, "level": level}

    def _table(self, run: dict, columns: str, by: str) -> DataFrame:
        """A run as the bucketed table that it is, also in an application that has not written it."""
        name = run["name"]
        if name not in self._tables:
            self._tables[name] = "veldra_" + name.replace("-", "_")
            place = f"{self.path}/{name}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._tables[name]} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(self._tables[name])

    def _read(self, run: dict) -> DataFrame:
        return self._table(run, "fingerprint BIGINT, n BIGINT", "fingerprint")

    def _read_windows(self, run: dict) -> DataFrame:
        return self._table(run, "h BIGINT, g INT, n BIGINT, place BIGINT", "h, g")

    def shared(self, run: dict, earlier: dict) -> DataFrame:
        """Fingerprints of a run that an earlier run has, too: a merge join of their buckets."""
        return self._read(run).hint("merge").join(self._read(earlier).select("fingerprint"), "fingerprint", "left_semi").select("fingerprint")

    def append(self, docs: DataFrame) -> None:
        """Index a batch as one more run."""
        window = self.window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "text"):
                hashes, n = np.unique(_anchors(*_fingerprints(Words(*flat(b.column(0))), window), window), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], ["fingerprint", "n"])

        found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "fingerprint long, n long")
        new = self._write(found.groupBy("fingerprint").agg(F.sum("n").alias("n")), ("fingerprint",), 0)
        hits = self._read(new).where("n > 1").select("fingerprint")
        for earlier in self.runs:
            hits = hits.unionByName(self.shared(new, earlier))
        name = f"hits-{uuid.uuid4().hex}"
        hits.distinct().write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.hits.append(name)
        self.runs.append(new)
        if self.history:
            windows = self._windows(_keyed(docs).select("__key", "__more", "__text")).select("h", "g", _place().alias("place"))
            self.window_runs.append(self._write(windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("place").alias("place")), ("h", "g"), 0))
        self._commit()
        self.compact()

    def compact(self) -> None:
        """Merge the runs of a level into one of the next where there are ``fan_in`` of them."""
        while full := sorted(k for k in {r["level"] for r in self.runs} if sum(r["level"] == k for r in self.runs) >= self.fan_in):
            level, gone = full[0], []
            for runs, read, by, more in ((self.runs, self._read, ("fingerprint",), []), (self.window_runs, self._read_windows, ("h", "g"), [F.min("place").alias("place")])):
                old = [r for r in runs if r["level"] == level]
                if not old:
                    continue
                rows = read(old[0])
                for r in old[1:]:
                    rows = rows.unionByName(read(r))
                merged = self._write(rows.groupBy(*by).agg(F.sum("n").alias("n"), *more), by, level + 1)
                runs[:] = [r for r in runs if r["level"] != level] + [merged]
                gone += [r["name"] for r in old]
            self._commit(gone)

    def repeated(self) -> DataFrame:
        """Fingerprints that occur more than once in all batches together."""
        return self.spark.read.schema("fingerprint long").parquet(*[f"{self.path}/{name}" for name in self.hits]).distinct()

    def _map_of(self, repeated: DataFrame) -> tuple[np.ndarray, int]:
        bits = 1 << 16
        n = repeated.count()
        while bits < min(BITS_EACH * n, MOST_BITS):
            bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.unique(np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False).view(U64), bits)))
                words, first = np.unique(at >> 6, return_index=True)
                if len(words):
                    masks = np.bitwise_or.reduceat(U64(1) << (at & 63).astype(U64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks.view(np.int64))], ["word", "mask"])

        got = repeated.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        out = np.zeros(bits // 64, U64)
        out[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(U64)
        return out, bits

    def _windows(self, rows: DataFrame, have: tuple | None = None) -> DataFrame:
        """h, g, __key, __more, start of all windows of ``rows`` (__key, __more, __text), or of those whose fingerprint is in the bit map ``have``."""
        window = self.window
        table, bits = have or (None, 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, "__text"):
                buf, off = flat(b.column(2))
                words = Words(buf, off)
                starts, least, _ = _fingerprints(words, window)
                s = starts if table is None else starts[_in_map(least, table.value, bits)]
                owner = np.searchsorted(words.bounds, s, "right") - 1
                spaced = _spaced(buf, words) if len(s) else None
                for a in range(0, len(s), 100_000):
                    o = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, _digests(spaced, s[o], window)), *(pa.array(b.column(k).to_numpy()[owner[o]]) for k in (0, 1)), pa.array((s[o] - words.bounds[owner[o]]).astype(np.int32))], ["h", "g", "__key", "__more", "start"])

        return rows.mapInArrow(run, "h long, g int, __key long, __more int, start int")

    def repeats(self, marked: DataFrame) -> DataFrame:
        """__key, __more and __starts array<int>: the windows of ``marked`` (as ``_marked`` gives it) that also start in another text or place, there or in any batch of a kept history."""
        speakers = marked.where("__rep is null or __rep = __id").select("__key", "__more", "__text")
        if self.history:
            return self._repeats_in_history(staged(self._windows(speakers), "windows"))
        table, bits = self._map_of(staged(self.repeated(), "repeated"))
        windows = staged(self._windows(speakers, (self.spark.sparkContext.broadcast(table), bits)), "windows")
        twice = windows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g")
        return windows.join(twice, ["h", "g"], "left_semi").groupBy("__key", "__more").agg(F.collect_set("start").alias("__starts"))

    def _past(self, own: DataFrame) -> DataFrame:
        """h, g, past (occurrences in all runs) and place of the digests of ``own`` (h, g) that the history has: they are shuffled into the buckets of each run, the run is not."""
        hits, own = None, own.select("h", "g").repartition(self.buckets, "h", "g")
        for run in self.window_runs:
            found = self._read_windows(run).hint("merge").join(own, ["h", "g"]).select("h", "g", "n", "place")
            hits = found if hits is None else hits.unionByName(found)
        return hits.groupBy("h", "g").agg(F.sum("n").alias("past"), F.min("place").alias("place"))

    def _repeats_in_history(self, windows: DataFrame) -> DataFrame:
        own = windows.groupBy("h", "g").agg(F.count("*").alias("here"))
        found = windows.join(own, ["h", "g"])
        if self.window_runs:
            past = staged(self._past(own), "past")
            found = found.join(past, ["h", "g"], "left").where((F.col("here") > 1) | (F.col("past") > 1) | ((F.col("past") == 1) & (F.col("place") != _place())))
        else:
            found = found.where("here > 1")
        return found.groupBy("__key", "__more").agg(F.collect_set("start").alias("__starts"))


def indexed(docs: DataFrame, window: int = 35, batches: int = BATCHES) -> FingerprintIndex:
    """An index, without history, of all rows of ``docs`` in batches by the hash of their id."""
    index = FingerprintIndex(docs.sparkSession, window, history=False)
    for k in range(batches):
        index.append(docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(batches)) == k))
    return index


def without_repeats(docs: DataFrame, window: int = 35, keep: tuple[str, ...] = ("doc_id",), index: FingerprintIndex | None = None, names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """``keep`` columns, n_words, n_removed and kept_text (or what ``names`` calls them; the words not covered by a repeated window, joined by one space); with an ``index``, against all its batches too."""
    if index is None:
        index = indexed(docs, window)
    rows = _marked(docs, keep)
    starts = staged(index.repeats(rows), "starts")
    rows = rows.select(*keep, "__key", "__more", F.col("__rep").isNotNull().alias("__copy"), "__text")
    keys = starts.select("__key", "__more")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    untouched = rows.join(keys, ["__key", "__more"], "left_anti").select(*keep, "__copy", F.lit(None).cast("array<int>").alias("__starts"), "__text")
    touched = rows.join(keys, ["__key", "__more"], "left_semi").join(starts, ["__key", "__more"]).select(*keep, "__copy", "__starts", "__text")
    schema = StructType([*(docs.schema[k] for k in keep), *map(StructField, names, (LongType(), LongType(), StringType()))])
    size = index.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "__text"):
            n_words, n_removed, kept = [], [], []
            for copy, s, t in zip(*(b.column(b.num_columns - i).to_pylist() for i in (3, 2, 1))):
                words = (t or "").encode().split()
                gone = 0
                if copy and len(words) >= size:
                    n_words.append(len(words))
                    gone, words = len(words), []
                elif s:
                    cover = np.zeros(len(words) + 1, np.int64)
                    at = np.array(s)
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + size, 1)
                    left = np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()
                    gone = len(words) - len(left)
                    n_words.append(len(words))
                    words = [words[i] for i in left]
                else:
                    n_words.append(len(words))
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return untouched.mapInArrow(run, schema).unionByName(touched.mapInArrow(run, schema))


def deduplicated(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; texts without any stay as they are."""
    columns = docs.columns
    out = without_repeats(docs, window, tuple(columns), names=("__words", "__removed", "__kept"))
    out = out.withColumn("text", F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns)
