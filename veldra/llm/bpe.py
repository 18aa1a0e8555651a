"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round forms the keys of
all adjacent pairs, finds their ranks by binary search over the sorted pair
keys, and merges the lowest-rank pair of every word at once.

Defined results: a null text counts as empty; an empty text has no ids; the
text of a special token inside a document becomes that token's id, as the
vocabulary file's library does; rows are kept one to one, repeated rows and
repeated ids included; other columns are left out unless listed in ``keep``.
Memory is bounded by slices of about 1 MB of text and a word cache of fixed
size; a longer single text is encoded alone.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from veldra.llm.textcore import chunks

#: The published pre-tokenisation pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space below U+0530.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: Runs that the pattern never splits across: white space, or one optional blank and what follows up to white space.
_RUN = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Runs kept with their ids in each worker; later ones are encoded slice by slice.
CACHE_RUNS = 600_000
#: Later code points are classed differently by different Unicode versions; such texts are split by the library that defines the file.
_LATE = re.compile("[^\u0000-ԯ]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(shown)))
    return [out[b] for b in range(256)]


class ByteBPE:
    """An encoder and decoder for one vocabulary file; build one per worker by ``load``."""

    _loaded: dict[str, ByteBPE] = {}

    @classmethod
    def load(cls, path: str) -> ByteBPE:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.keys, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {s: b for b, s in enumerate(symbols)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.names = [str(i) for i in range(size)]
        self.split = regex.compile(PATTERN)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.cache: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the number of pairs: none) and its place among the sorted keys."""
        keys = (left << 32) | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys)), at

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, merged together round by round, and where each word's ids begin (and the last ones end)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_owner = [], []
        none = len(self.keys)
        rank, at = np.full(len(symbols), none, np.int64), np.zeros(len(symbols), np.int64)
        fresh = np.flatnonzero(owner[:-1] == owner[1:])  # places whose pair is not looked up yet
        while len(symbols):
            rank[fresh], at[fresh] = self._ranks(symbols[fresh], symbols[fresh + 1])
            firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, firsts), np.diff(np.r_[firsts, len(symbols)]))
            over = best == none
            if over.any():  # words without a pair left
                done_ids.append(symbols[over])
                done_owner.append(owner[over])
            keep = ~over
            hit = np.flatnonzero((rank == best) & keep)
            if not len(hit):
                break
            # in a run of overlapping hits (a a a) every second one merges, from the left
            run = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[at[hit]]
            keep[hit + 1] = False
            rank[hit] = none
            hit = np.cumsum(keep)[hit] - 1
            symbols, owner, rank, at = symbols[keep], owner[keep], rank[keep], at[keep]
            # a merged symbol has new pairs on both sides
            near = np.zeros(len(symbols) + 1, bool)
            near[hit] = near[hit - 1] = True
            near = near[: len(symbols)]
            near[-1] = False
            near[:-1] &= owner[:-1] == owner[1:]
            fresh = np.flatnonzero(near)
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(of, kind="stable")
        return ids[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(words)))]

    def _words(self, run: str) -> list[str]:
        bare = run[1:] if run[0] == " " else run
        if bare.isalpha() and max(bare) < "\u0530":  # letters alone are one word
            return [run]
        if _LATE.search(run) is None:
            return self.split.findall(run)
        return [run[a:b] for _, (a, b) in self.library.pre_tokenize_str(run)]

    def _runs(self, text: str) -> list[str]:
        return _RUN.findall(text) if _LATE.search(text) is None else self._words(text)

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each run."""
        words = [[r] if r in self.special else self._words(r) for r in runs]
        plain = list({w for ws in words for w in ws if w not in self.special})
        ids, starts = self.merge_words([w.encode() for w in plain])
        raw, cuts = ids.astype("<i4").tobytes(), (starts * 4).tolist()
        known = {w: raw[a:b] for w, a, b in zip(plain, cuts, cuts[1:])}
        known.update((s, np.array([i], "<i4").tobytes()) for s, i in self.special.items())
        return [known[ws[0]] if len(ws) == 1 else b"".join(map(known.__getitem__, ws)) for ws in words]

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        split = []
        for text in texts:
            if not text:
                split.append([])
            elif self.at_special is None or self.at_special.search(text) is None:
                split.append(self._runs(text))
            else:
                runs: list = []
                for part in self.at_special.split(text):
                    runs.extend([part] if part in self.special else self._runs(part))
                split.append(runs)
        fresh = list(set().union(*split).difference(self.cache))
        known = self.cache
        if len(known) + len(fresh) > CACHE_RUNS:
            known = ChainMap({}, known)
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            known.update(zip(part, self._encode_runs(part)))
        if known is not self.cache:
            late, kept = known.maps[0], self.cache
            return [np.frombuffer(b"".join([kept[r] if r in kept else late[r] for r in runs]), "<i4") for runs in split]
        return [np.frombuffer(b"".join(map(known.__getitem__, runs)), "<i4") for runs in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _kept(df: DataFrame, keep: list[str]) -> list[StructField]:
    return [df.schema[k] for k in keep]


def encode(docs: DataFrame, vocab: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids`` array<int> of every text."""
    fields = _kept(docs, list(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(vocab)
        for b in chunks(batches, "__text", 1_000_000):
            ids = bpe.encode_batch(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    rows = docs.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(run, StructType([*fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, vocab: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the ``text`` of every id list (null list: null text)."""
    fields = _kept(rows, list(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(vocab)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, StructType([*fields, StructField("text", StringType())]))


def round_trip(docs: DataFrame, vocab: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass over the table: ``keep``, ``n_tokens``, ``ids_csv_sha256`` and ``decoded_sha256`` (raw digests).

    The ids never leave the task, so nothing but digests is written.
    """
    fields = _kept(docs, list(keep))
    out = StructType([*fields, StructField("n_tokens", IntegerType()), StructField("ids_csv_sha256", BinaryType()), StructField("decoded_sha256", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE.load(vocab)
        for b in chunks(batches, "__text", 1_000_000):
            lists = [x.tolist() for x in bpe.encode_batch(b.column(b.num_columns - 1).to_pylist())]
            csv = [hashlib.sha256(",".join(map(bpe.names.__getitem__, x)).encode()).digest() for x in lists]
            back = [hashlib.sha256(bpe.decode(x).encode()).digest() for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) for x in lists], pa.int32()), pa.array(csv, pa.binary()), pa.array(back, pa.binary())], [*keep, "n_tokens", "ids_csv_sha256", "decoded_sha256"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)
