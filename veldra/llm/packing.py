"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of documents. The corpus is cut into blocks of
``windows`` windows; block b takes from queue s the tokens floor(b*T_s/B) to
floor((b+1)*T_s/B) of its stream, so each block has the target proportions (the
corpus's own) to within a grain and inherits the rest, the deficit, from the
block before. Inside a block the grains of all queues are served in the order
in which a perfectly even server would be half through each, so a queue is
never more than about a grain ahead or behind. A grain is one token for up to
``FINE_QUEUES`` queues; beyond, ``GRAIN`` tokens, with block bounds in whole
grains and staggered by queue, so that pieces stay fewer than tokens / ``GRAIN``
and windows. Only the last window of a block can have padding (half a window
in ``windows`` on average).

Defined results: a null text counts as empty and still yields its end token;
a null source is a queue of its own; repeated rows are packed once each; every
source is a queue, however many there are; an empty table yields no pieces.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from veldra.llm.store import staged
from veldra.llm.textcore import IS_SPACE, LOWER, caches, chunks, flat

#: Distinct parts (and words that have none) kept with their ids in each worker, and their bytes.
CACHE_WORDS, CACHE_BYTES = 700_000, 32_000_000
#: The suffix of ids that end a part of a word, and such parts: letters, single digits, runs of marks (no apostrophes, which may begin endings).
WORD_END = "</w>"
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Kinds of bytes: of parts, and others, whose words go through the library whole.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[IS_SPACE] = SPACE
for _kind, _bytes in ((LETTER, rb"[A-Za-z]"), (DIGIT, rb"[0-9]"), (MARK, rb"[!-&(-/:-@\[-`{-~]")):
    KIND[[m.start() for m in re.finditer(_bytes, bytes(range(256)))]] = _kind
#: The steps of the vocabulary whose parts these are.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Offsets of (partition, queue) are broadcast up to this many rows and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
#: Queues up to which tokens are dealt one by one, and tokens dealt at once beyond.
FINE_QUEUES, GRAIN = 256, 8


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` at least; twice its size if it has to grow, so all growth together copies each entry a few times."""
    if n <= len(array):
        return array
    out = np.empty(max(n, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class _Slots(dict):
    """Words by their slot; a new word takes the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        return slot


class _Ids:
    """Strings with their ids, one after the other in a pool."""

    def __init__(self) -> None:
        self.slots, self.filled = _Slots(), 0
        self.begin, self.size, self.pool = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), np.empty(1 << 18, np.uint32)

    def look_up(self, strings: list) -> tuple[np.ndarray, list]:
        """The slot of each string, and those strings that are new; ``add`` has to follow with their ids."""
        known = len(self.slots)
        slots = np.fromiter(map(self.slots.__getitem__, strings), np.int64, len(strings))
        return slots, list(itertools.islice(reversed(self.slots), len(self.slots) - known))[::-1]

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        to, end = len(self.slots), self.filled + len(ids)
        self.begin, self.size, self.pool = (_grown(x, n) for x, n in ((self.begin, to), (self.size, to), (self.pool, end)))
        self.size[to - len(size) : to] = size
        self.begin[to - len(size) : to] = self.filled + np.cumsum(size) - size
        self.pool[self.filled : end] = ids
        self.filled = end

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids behind the slots, one after the other, and how many each has."""
        size = self.size[slots]
        ends = np.cumsum(size)
        return self.pool[np.repeat(self.begin[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class WordIds:
    """Ids of texts by the tokenizers library, called once for each distinct part of a word.

    This vocabulary drops white space, so words (runs of anything else) are
    encoded apart. A word of Latin letters, digits and marks falls into parts
    that the vocabulary never joins (runs of letters, single digits, runs of
    marks): these are found for all bytes of a slice at once, and Arrow names
    the distinct ones, so Python sees each of those once for a slice. The
    library encodes many parts in one call, and the suffix of their last ids
    tells them apart. All other words go through the library whole. What a
    slice of texts needs is in the cache; between slices a full cache starts
    anew.
    """

    _loaded: dict[str, WordIds] = {}

    @classmethod
    def load(cls, path: str) -> WordIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.plain = self._plain(path)
        self.names = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.is_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.is_end[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
        self._clear()

    def _plain(self, path: str):
        """The same model for parts that stand apart and in lower case already, without the steps that would change nothing; the tokenizer itself for a vocabulary with other steps."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        steps = json.loads(self.tokenizer.to_str())
        if (steps["normalizer"], steps["pre_tokenizer"], steps["post_processor"]) != (NORMALIZER, PRE_TOKENIZER, None):
            return self.tokenizer
        plain = Tokenizer.from_file(path)
        plain.no_padding()
        plain.no_truncation()
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def _clear(self) -> None:
        self.known, self.bytes = _Ids(), 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has."""
        found, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for a in range(0, len(parts), 2000):
            some = parts[a : a + 2000]
            (encoded,) = self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(some):  # a vocabulary of another kind
                each = [self._encode(x) for x in some]
                ids, ends = np.concatenate(each), np.cumsum(list(map(len, each)))
            found.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(found), np.concatenate(sizes)

    def _learn(self, fresh: list[bytes]) -> None:
        """Ids of new parts and of new words that go through the library whole."""
        self.bytes += sum(map(len, fresh))
        texts = [x.decode() for x in fresh]
        is_part = np.fromiter((PARTS.fullmatch(t) is not None for t in texts), bool, len(texts))
        ids, size = self._encode_parts([t for t, p in zip(texts, is_part) if p])
        if not is_part.all():
            each = [self._encode(t) for t, p in zip(texts, is_part) if not p]
            lengths = np.array(list(map(len, each)), np.int64)
            ends = np.r_[0, np.cumsum(size)][np.cumsum(is_part)[~is_part]]  # the ids of the parts before each word
            ids = np.insert(ids, np.repeat(ends, lengths), np.concatenate(each))
            all_sizes = np.empty(len(texts), np.int64)
            all_sizes[is_part], all_sizes[~is_part] = size, lengths
            size = all_sizes
        self.known.add(ids, size)

    def _units(self, buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """What is looked up, in order (parts in lower case; whole words where parts don't do), and where in the bytes each begins."""
        kind, low = KIND[buf], LOWER[buf]
        if len(lead := np.flatnonzero(buf[:-1] == 0xC3)):  # Latin letters of two bytes
            after = buf[lead + 1]
            lead, after = lead[(after != 0x97) & (after != 0xB7)], after[(after != 0x97) & (after != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            low[lead + 1] += np.where(after < 0x9F, np.uint8(0x20), np.uint8(0))
        inside = kind != SPACE
        first = np.zeros(len(buf) + 1, bool)
        first[off] = True
        first = first[:-1]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:]
        cut = begin | (inside & (kind == DIGIT))
        cut[1:] |= inside[1:] & (kind[1:] != kind[:-1])
        words = np.flatnonzero(begin)
        odd = np.flatnonzero(kind == OTHER)
        found = [m.start() for name in self.names for m in re.finditer(re.escape(name), buf)]
        if len(odd) or found:
            whole = np.zeros(len(words), bool)
            whole[np.searchsorted(words, np.r_[odd, np.array(found, np.int64)].astype(np.int64), "right") - 1] = True
            of_whole = whole[np.cumsum(begin) - 1] & inside
            cut &= ~of_whole | begin
            low = np.where(of_whole, buf, low)
        starts = np.flatnonzero(cut)
        # within a word, a unit ends where the next one begins; white space is left out
        ends = np.r_[np.cumsum(inside, dtype=np.int64)[starts] - 1, np.count_nonzero(inside)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])]), starts

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        if len(self.known.slots) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self._clear()
        buf, off = flat(texts)
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        units, starts = self._units(buf, off)
        named = units.dictionary_encode()
        slots, fresh = self.known.look_up(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        if fresh:
            self._learn(fresh)
        ids, size = self.known.take(slots[named.indices.to_numpy()])
        return ids, np.diff(np.r_[0, np.cumsum(size)][np.searchsorted(starts, off)])


caches.append(WordIds._loaded.clear)


def tokenised(docs: DataFrame, vocab: str, end_id: int, text: str = "text", source: str = "source", doc_id: str = "doc_id", narrow: bool = True) -> DataFrame:
    """doc_id, queue, part, start (in the queue's stream of this partition), n_tokens and ids (2 bytes each if ``narrow``, else 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds.load(vocab)
        part, at = TaskContext.get().partitionId(), {}
        kind = "<u2" if narrow else "<u4"
        for b in chunks(batches, "text", cached=True):
            ids, n = ids_of.encode_flat(b.column(2))
            ids = np.insert(ids, np.cumsum(n), end_id).astype(kind)
            n = n + 1
            start = []
            for q, k in zip(b.column(1).to_pylist(), n.tolist()):
                start.append(at.get(q, 0))
                at[q] = start[-1] + k
            ends = np.r_[0, np.cumsum(n)] * ids.itemsize
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(n), part, np.int32)), pa.array(start, pa.int64()), pa.array(n, pa.int64()), data.cast(pa.binary())], ["doc_id", "queue", "part", "start", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("="), F.col(source)).alias("queue"), F.col(text).alias("text"))
    rows = rows.withColumn("queue", F.coalesce("queue", F.lit("null")))
    return rows.mapInArrow(run, "doc_id long, queue string, part int, start long, n_tokens long, ids binary")


def serve(amounts: np.ndarray, share: np.ndarray, lag: np.ndarray, size: int, grain: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Flat starts (queues one after the other) and windows of all draws: grains in the order of their even service times.

    ``share`` is what a queue earns in a block and ``lag`` what it is owed from the block before.
    """
    first = np.cumsum(amounts) - amounts
    lane = np.repeat(np.arange(len(amounts)), amounts)
    k = np.arange(len(lane)) - first[lane]
    order = np.argsort((k // grain * grain + grain / 2 - lag[lane]) / share[lane], kind="stable")
    window = np.empty(len(lane), np.int64)
    window[order] = np.arange(len(lane)) // size
    starts = np.flatnonzero(np.r_[True, (lane[1:] != lane[:-1]) | (window[1:] != window[:-1])][: len(lane)])
    return starts, window[starts]


def pack(docs: DataFrame, vocab: str, size: int = 2048, windows: int = 512, end_id: int = 1, text: str = "text", source: str = "source", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, source queue and, if asked, its ids."""
    narrow = WordIds.load(vocab).tokenizer.get_vocab_size() <= 1 << 16
    width, kind = (2, "<u2") if narrow else (4, "<u4")
    rows = staged(tokenised(docs, vocab, end_id, text, source, doc_id, narrow), "tokens")
    parts = staged(rows.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")), "parts")
    totals = staged(parts.groupBy("queue").agg(F.sum("n").alias("queue_total")), "totals")
    whole, queues = totals.agg(F.coalesce(F.sum("queue_total"), F.lit(0)), F.count("*")).first()
    blocks = max(1, round(whole / (size * windows)))
    grain = 1 if queues <= FINE_QUEUES else GRAIN
    if queues <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    base = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.join(totals, "queue").select("queue", "part", "queue_total", F.coalesce(base, F.lit(0)).alias("base"), (F.lit(0) if grain == 1 else F.pmod(F.xxhash64("queue"), F.lit(blocks))).cast("long").alias("phase"))
    offsets = staged(offsets, "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, ["queue", "part"]).withColumn("at", F.col("base") + F.col("start"))

    total, phase = F.col("queue_total"), F.col("phase")
    grains = F.expr(f"(queue_total + {grain - 1}) div {grain}")
    each, rest = F.expr(f"(queue_total + {grain - 1}) div {grain} div {blocks}"), grains % blocks
    owed = lambda b: (b * rest + phase) % blocks / F.lit(blocks)  # noqa: E731  of the next grain, when block b begins

    def low(b):
        """First token of block b: grain floor((b * grains + phase) / blocks)."""
        return F.least((b * each + F.floor((b * rest + phase) / F.lit(blocks)).cast("long")) * grain, total)

    # exact while tokens * blocks < 2**63; an overflow is an error, never a wrong block
    parts_of = F.expr(f"at div {grain}"), F.expr(f"(at + n_tokens - 1) div {grain}")
    placed = placed.withColumn("grains", grains).withColumn("first", parts_of[0] * blocks + (blocks - 1) - phase).withColumn("last", parts_of[1] * blocks + (blocks - 1) - phase)
    spread = F.sequence(F.expr("first div grains"), F.expr("last div grains"))
    cut = placed.withColumn("block", F.explode(spread if grain == 1 else F.filter(spread, lambda b: low(b + 1) > low(b))))
    a = F.greatest(low(F.col("block")), F.col("at"))
    b = F.least(low(F.col("block") + 1), F.col("at") + F.col("n_tokens"))
    cut = cut.withColumn("a", a).withColumn("b", b).where("b > a").select(
        "block", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "queue", F.col("n_tokens").alias("doc_tokens"), "a", (F.col("a") - F.col("at")).alias("from"),
        (grains * grain / F.lit(blocks)).alias("share"), (owed(F.col("block")) * grain - (0 if grain == 1 else grain / 2)).alias("lag"),
        F.expr(f"substring(ids, cast({width} * (a - at) + 1 as int), cast({width} * (b - a) as int))").alias("ids"))

    def fill(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["queue", "a"], kind="stable", ignore_index=True)
        lengths = table["ids"].map(len).to_numpy(np.int64) // width
        ids = np.frombuffer(b"".join(table["ids"]), kind).astype("<u4")
        lane, names = pd.factorize(table["queue"])  # in order of names, as the table is
        amounts = np.bincount(lane, lengths, len(names)).astype(np.int64)
        head = np.searchsorted(lane, np.arange(len(names)))
        starts, window = serve(amounts, table["share"].to_numpy(float)[head], table["lag"].to_numpy(float)[head], size, grain)
        # draws of a window stand one after the other, in order of names
        drawn = np.diff(np.r_[starts, len(ids)])
        order = np.argsort(window, kind="stable")
        filled = np.bincount(window, drawn).astype(np.int64)
        place = np.empty(len(starts), np.int64)
        place[order] = np.cumsum(drawn[order]) - drawn[order] - (np.cumsum(filled) - filled)[window[order]]
        doc_start = np.r_[0, np.cumsum(lengths)]
        edges = np.union1d(doc_start, starts)
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_start, lo, "right") - 1
        draw = np.searchsorted(starts, lo, "right") - 1
        window = window[draw]
        view = memoryview(ids).cast("B")
        t = table.iloc[doc]
        return pd.DataFrame({
            "doc_id": t["doc_id"].array, "nameless": t["nameless"].array, "start": t["from"].to_numpy() + lo - doc_start[doc], "length": hi - lo,
            "ids_crc32": [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(lo.tolist(), hi.tolist())], "doc_tokens": t["doc_tokens"].array,
            "sequence_id": t["block"].to_numpy(np.int64) * (2 * windows + 2) + window, "offset": place[draw] + lo - starts[draw],
            "sequence_length": filled[window], "queue": t["queue"].array,
            "ids": [ids[i:j].tolist() if with_ids else None for i, j in zip(lo.tolist(), hi.tolist())],
        })

    pieces = cut.groupBy("block").applyInPandas(fill, "doc_id long, nameless boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, queue string, ids array<int>")
    return pieces.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")
