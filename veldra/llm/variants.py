"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Two words that differ by one inserted, deleted or replaced code point agree
before the place of the edit and after it. Words are sorted forwards and
backwards; for each place of a word what it begins with is an interval of the
first order, what it ends with an interval of the second, and a wavelet tree
over the backward ranks in forward order counts and reports the words in both.

Work is dealt out by what the two words of a pair share. A class ``m`` holds
words of ``m`` and ``m - 1`` code points; an edit in the places [a, b) of the
longer one leaves the first ``a`` and the last ``m - b`` code points alone, so
both meet under the key of these. Classes start with two halves. Keys that too
many words share are split into two ranges of places, as often as it takes:
under the key of a single place there is no more than one word for each letter.
A task indexes all keys of a range that it has been dealt at once, and returns
for each word the number of its near words there and the best of them.

Defined results: null and empty texts have no words; a null id counts as an
empty one; words are distinct, so repeated rows only add to their counts; an
empty table or no word that is frequent enough gives no rows; other columns are
ignored. Words may be of any length: a group holds up to 128 of them, so about
128 times the longest word has to fit into a task if that many long words are
alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veldra.llm.store import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys with more words than this (or with more letters) are split; keys of one place have at most 26 + 64 + 1 words.
GROUP_WORDS, GROUP_LETTERS, LEAST_GROUP = 20_000, 2_000_000, 128
#: Keys are indexed together up to about this many words or letters.
CHUNK_WORDS, CHUNK_LETTERS = 60_000, 2_000_000
#: Split keys are broadcast up to this number, and joined beyond it.
MAX_BROADCAST = 100_000
#: A form is at least this many times as frequent as its word.
RATIO = 10


class WaveletTree:
    """A permutation of 0 to n - 1; counts and reports its values between two bounds in intervals of places, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.depth - 1, -1, -1):
            one = values >> bit & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def _below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        out = np.where(bound >> self.depth > 0, hi - lo, 0)
        inside = bound >> self.depth == 0
        for level, zeros in enumerate(self.zeros):
            one = bound >> (self.depth - 1 - level) & 1 == 1
            l0, h0 = zeros[lo], zeros[hi]
            out += np.where(one & inside, h0 - l0, 0)
            lo, hi = np.where(one, zeros[-1] + lo - l0, l0), np.where(one, zeros[-1] + hi - h0, h0)
        return out

    def count(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How many of the places [lo, hi) have a value in [least, upto)."""
        return self._below(lo, hi, upto) - self._below(lo, hi, least)

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the query and the value, for each value that ``count`` counts."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            bit = self.depth - 1 - level
            l0, h0 = zeros[lo], zeros[hi]
            query = np.concatenate([query, query])
            value = np.concatenate([value, value | 1 << bit])
            lo, hi = np.concatenate([l0, zeros[-1] + lo - l0]), np.concatenate([h0, zeros[-1] + hi - h0])
            some = (hi > lo) & (value < upto[query]) & (value + (1 << bit) > least[query])
            query, value, lo, hi = query[some], value[some], lo[some], hi[some]
        return query, value


def _sorted(words: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words in order, their letters row by row (short ones end with 0), and the common beginning of each with the one before it."""
    strings = np.array(words, f"S{m}")
    order = np.argsort(strings, kind="stable")
    letters = strings[order].view(np.uint8).reshape(len(words), m)
    shared = np.zeros(len(words), np.int64)
    shared[1:] = (letters[1:] != letters[:-1]).argmax(axis=1)
    return order, letters, shared


def _intervals(shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) of the words that have the first ``length`` letters of each in common."""
    new = shared < length
    new[0] = True
    at = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    return at[number], np.append(at[1:], len(shared))[number]


def near_pairs(words: list[bytes], m: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places x, y of near words (both directions) of m or m - 1 letters whose edit lies in the places [a, b) of the longer, and the words' order."""
    forward, letters, shared = _sorted(words, m)
    backward, _, shared_back = _sorted([w[::-1] for w in words], m)
    rank_back = np.empty(len(words), np.int64)
    rank_back[backward] = np.arange(len(words))
    ranks = rank_back[forward]
    rank = np.empty(len(words), np.int64)
    rank[forward] = np.arange(len(words))
    tree = None
    long = letters[:, m - 1] > 0
    xs, ys = [], []
    for i in range(max(a, m - 1 - int(shared_back.max())), min(b, int(shared.max()) + 1)):
        lo, hi = _intervals(shared, i)
        least, upto = (v[ranks] for v in _intervals(shared_back, m - 1 - i))
        ask = np.flatnonzero(long & (hi - lo > 1) & (upto - least > 1))
        if not len(ask):
            continue
        tree = tree or WaveletTree(ranks)
        box = lo[ask], hi[ask], least[ask], upto[ask]
        more = tree.count(*box) > 1  # than the word itself
        ask = ask[more]
        query, value = tree.report(*(v[more] for v in box))
        x, y = ask[query], rank[backward[value]]
        # a letter that may be taken out at several places in a row is taken out at the last
        last = np.ones(len(x), bool) if i == m - 1 else letters[x, i] != letters[x, i + 1]
        fit = (x != y) & (long[y] | last)
        x, y = x[fit], y[fit]
        xs += [x, y[~long[y]]]
        ys += [y, x[~long[y]]]
    none = np.empty(0, np.int64)
    x, y = (forward[np.concatenate(v)] if v else none for v in (xs, ys))
    return x, y, rank


def _summary(words: list[bytes], n: np.ndarray, m: int, a: int, b: int) -> pa.RecordBatch | None:
    """word, n_near, best_n and best of each word with near words."""
    x, y, rank = near_pairs(words, m, a, b)
    if not len(x):
        return None
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    text = lambda places: pa.array([words[i].decode("latin-1") for i in places.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([text(x[first]), pa.array(np.diff(np.append(first, len(x)))), pa.array(n[y[first]]), text(y[first])], ["word", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows m, a, b, k, word, n that come in order of their keys."""
    held: list[tuple[bytes, int, int]] = []
    now = (0, 0, 0)

    def flush() -> Iterator[pa.RecordBatch]:
        words, n, keys = zip(*held)
        k = np.array(keys, np.int64)
        same = np.concatenate([[False], k[1:] == k[:-1], [False]])
        some = np.flatnonzero(same[1:] | same[:-1]).tolist()  # a word that is alone with its key has no near word here
        if some and (out := _summary([words[i] for i in some], np.array(n, np.int64)[some], *now)) is not None:
            yield out

    for batch in batches:
        for m, a, b, k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if held and ((m, a, b) != now or k != held[-1][2] and (len(held) >= CHUNK_WORDS or len(held) * m >= CHUNK_LETTERS)):
                yield from flush()
                held = []
            now = (m, a, b)
            held.append((word.encode("latin-1"), n, k))
    if held:
        yield from flush()


def _keyed(entries: DataFrame) -> DataFrame:
    """With ``k``, the hash of what the words under a key have in common."""
    return entries.withColumn("k", F.xxhash64("m", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)")))


def _entries(words: DataFrame) -> DataFrame:
    """m, a, b, k, word, n: the keys of each word, with those that too many words share split."""
    size = F.length("word")
    half = lambda m, first: F.struct(m.alias("m"), (F.lit(0) if first else F.floor(m / 2).cast("int")).alias("a"), (F.floor(m / 2).cast("int") if first else m).alias("b"))
    ranges = F.array(*(half(m, first) for m in (size, size + 1) for first in (True, False)))
    entries = _keyed(words.withColumn("r", F.explode(ranges)).select("r.m", "r.a", "r.b", "word", "n"))
    limit = F.greatest(F.lit(LEAST_GROUP), F.least(F.lit(GROUP_WORDS), F.lit(GROUP_LETTERS) / F.col("m")))
    while True:
        keys = entries.where("b - a > 1").groupBy("m", "a", "b", "k").agg(F.count("*").alias("words")).where(F.col("words") > limit)
        keys = staged(keys.select("m", "a", "b", "k", F.lit(True).alias("split")), "split")
        found = keys.count()
        if not found:
            return entries
        marked = entries.join(F.broadcast(keys) if found <= MAX_BROADCAST else keys, ["m", "a", "b", "k"], "left")
        mid = ((F.col("a") + F.col("b")) / 2).cast("int")
        parts = F.when(F.col("split"), F.array(F.struct("a", mid.alias("b")), F.struct(mid.alias("a"), "b"))).otherwise(F.array(F.struct("a", "b")))
        entries = _keyed(marked.withColumn("r", F.explode(parts)).select("m", "r.a", "r.b", "word", "n"))


def words(docs: DataFrame, doc_id: str = "doc_id", least_length: int = 7, least_n: int = 2, mutate: bool = True) -> DataFrame:
    """word and n of the runs of letters (A-Z lower-cased) that are long and frequent enough.

    With ``mutate`` one code point of every 31st run (by crc32 of id and run) is deleted.
    """
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least_length},}}+"), F.lit(0))
    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if mutate:
        found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        found = found.withColumn("word", F.when(F.col("h") % 31 != 0, F.col("word")).otherwise(F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")))
        found = found.where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form: what following forms ends in. Forms grow tenfold at each step, so a few doublings do."""
    up = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        raised = staged(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots", instead_of=None)
        if not raised.where("moved").limit(1).count():
            return raised.drop("moved")
        up = raised.drop("moved")


def near_words(counted: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n of distinct ``counted`` words (word, n).

    Near words differ by one code point. A word's form is its near word of
    largest n (ties: the smallest) if that n is ``RATIO`` times its own.
    Letters are those up to U+00FF.
    """
    counted = staged(counted, "words")
    entries = _entries(counted).select("m", "a", "b", "k", "word", "n").repartition("m", "a", "b", "k").sortWithinPartitions("m", "a", "b", "k")
    found = entries.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    rows = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *_form())
    rows = staged(rows, "near")
    return rows.join(_roots(rows.where("form is not null")), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def _form() -> tuple[Column, Column]:
    grown = -F.col("b.less") >= RATIO * F.col("n")
    return F.when(grown, F.col("b.best")).alias("form"), F.when(grown, -F.col("b.less")).alias("form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The spelling variants of the words of ``docs`` (see ``words`` and ``near_words``)."""
    return near_words(words(docs))
