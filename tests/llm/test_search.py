"""Personal data, spelling variants and hard negatives against plain versions on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.llm import negatives, pii, queries, variants

SF = "/root/testdata/sf0.001"
CLASH = ", key string, k string, word string, n long, cell int, label2 string"

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    return sum(x if i % 2 == 0 else x * 2 if x < 5 else x * 2 - 9 for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and plain_luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


PRIVATE = [
    None, "", "  \n", "a@b", "@b.c", "a@b.c@d.e", "x.y%z+1@a-b.c-d.ee.", "é.ü@b.c 日本 a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "4111111111111111", "1 2", "+1 (988) 555-2485 x", "+12+345 678 901",
    "+1 (988) 555-2485 4111111111111111", "٣٤٥٦٧٨٩٠١٢٣٤", "call (988) 555-2485 now", "write to anna.bell (at) mail dot example dot org today", "on 2024-05-06 version 1.22.33 isbn 978-3-16-148410-0 at 12:30:45", "IBAN DE89 3704 0044 0532 0130 00.", "ssn 219-09-9999;",
    "a" * 30_000 + "@", "7" * 30_000, "1.1." * 10_000, "+" * 10_000, "a@" * 10_000, "12 34 56 78 " * 3_000, "x (at) " * 3_000,
]


def test_patterns_as_written():
    r = random.Random(3)
    for text in [t for t in PRIVATE if t and len(t) < 1000]:
        assert pii.base_spans(text) == plain_base(text), text
    for _ in range(6000):
        text = "".join(r.choice("0123456789019..--  ++@@()ab_\né") for _ in range(r.randint(1, 45)))
        assert pii.base_spans(text) == plain_base(text), text


def test_personal(spark):
    rows = [(i, t, "k", "k", "w", 1, 2, "l") for i, t in enumerate(PRIVATE)] + [(12, PRIVATE[12], None, None, None, None, None, None)]
    schema = "doc_id long, text string" + CLASH
    found = pii.personal(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = PRIVATE[r.doc_id] or ""
        spans, base = ([(s.start, pii.KINDS.index(s.kind), s.end) for s in v] for v in (r.spans, r.base))
        if len(text) < 1000:
            assert base == plain_base(text)
        assert spans == sorted(spans) and not Counter(base) - Counter(spans)
        more = sorted((Counter(spans) - Counter(base)).elements())
        for a, _, b in more:  # what is added touches nothing else
            assert 0 <= a < b <= len(text) and all(b <= x or y <= a for x, _, y in base) and sum(x < b and a < y for x, _, y in more) == 1
    by = {r.doc_id: [PRIVATE[r.doc_id][s.start : s.end] for s in r.spans] for r in found}
    assert by[16] == ["(988) 555-2485"] and by[17] == ["anna.bell (at) mail dot example dot org"] and by[18] == [] and by[19] == ["DE89 3704 0044 0532 0130 00"] and by[20] == ["219-09-9999"]
    assert "+1 (988) 555-2485" in by[14]
    assert not pii.personal(spark.createDataFrame([], schema)).collect()


def plain_best(zone, field):
    """The best segmentation by trying all of them, shortest prefix first."""
    by_end, none = zone.segments(), len(pii.KINDS)
    best = {(0, none): (0.0, ())}
    for j in range(1, zone.n + 1):
        arcs = [(j - 1, none, 0.0)] + [(i, k, field.score(k, f)) for i, k, f in by_end.get(j, ())]
        for i, k, s in arcs:
            for p in range(none + 1):
                if (i, p) in best:
                    gain, path = best[i, p]
                    new = (gain + field.after[p][k] + s, path + (((i, k, j),) if k != none else ()))
                    best[j, k] = max(best.get((j, k), (-math.inf, ())), new, key=lambda x: x[0])
    return max((best[zone.n, k] for k in range(none + 1) if (zone.n, k) in best), key=lambda x: x[0])


def test_field_is_a_distribution_and_its_best_is_best():
    field = pii.trained()
    for text, spans in pii.examples(71, 60):
        zone = pii.Zone(text, 0, len(text), pii._cover(pii.base_spans(text)))
        if zone.fixed:
            continue
        score, path = plain_best(zone, field)
        got = field.best(zone)
        assert got == [(zone.starts[i], k, zone.ends[j - 1]) for i, k, j in path]
        # the likelihoods of all segmentations sum up to 1: followed from left to right, path by path
        none, by_end = len(pii.KINDS), zone.segments()
        paths, total, tried = [(0, none, ())], 0.0, 0
        while paths and tried < 300:
            at, last, done = paths.pop()
            if at == zone.n:
                other = pii.Field()
                other.weights, other.bias, other.after = field.weights, field.bias, field.after
                total, tried = total + math.exp(other.learn(zone, list(done), 0.0, {})), tried + 1
                continue
            paths.append((at + 1, none, done))
            paths += [(j, k, (*done, (at, k, j))) for j, found in by_end.items() for i, k, _ in found if i == at]
        if not paths:
            assert abs(total - 1) < 1e-6


def test_field_on_unseen_sentences():
    field, hit, extra, missed = pii.trained(), 0, 0, 0
    for text, spans in pii.examples(1234, 600):
        got = {(k, a, b) for k, a, b, fixed in pii.spans_of(text, field) if not fixed}
        want = {(pii.KINDS[k], a, b) for a, k, b in spans}
        hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_near(words):
    keys = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            keys[w[:i], w[i + 1 :], True].add(w)
            keys[w[:i] + w[i + 1 :], None, False].add(w)
        keys[w, None, False].add(w)
    near = defaultdict(set)
    for (_, _, replaced), group in keys.items():
        for x in group:
            near[x] |= {y for y in group if x != y and (len(x) == len(y) if replaced else abs(len(x) - len(y)) == 1)}
    return near


def plain_variants(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda y: (-words[y], y))
            if words[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, form.get(w), root, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def found_variants(df):
    return sorted((tuple(r) for r in df.select("word", "n", "form", "root", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("split", [False, True])
def test_near_words(spark, monkeypatch, split):
    if split:  # nearly every key is split down to single places
        monkeypatch.setattr(variants, "GROUP_WORDS", 1)
        monkeypatch.setattr(variants, "LEAST_GROUP", 1)
    r = random.Random(8)
    words = {"".join(r.choice("abÿ") for _ in range(r.randint(7, 9))): r.choice([2, 3, 30, 400, 5000]) for _ in range(1500)}
    words |= {"common" + "".join(r.choice("xyz") for _ in range(k)): 2 * 10 ** (k % 4) for k in range(1, 8) for _ in range(20)}
    words |= {"a" * 3000: 2, "a" * 2999: 50, "a" * 1500 + "b" + "a" * 1499: 700, "aaaaaaa": 2, "aaaaaaaa": 20}
    got = found_variants(variants.near_words(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)))
    assert got == plain_variants(words)


def test_variants_of_texts(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(words) + r.choice(["", "", "", "x"]) for _ in range(200)).title()) for i in range(40)]
    rows += [(None, None), (None, "Straßenbahn straßenbahn STRASSENBAHN ÀÉÎõüÿ× àéîõüÿ×"), (7, ""), (8, "1234 abc"), (9, rows[0][1]), (9, rows[0][1]), (10, "zebrafish " * 5000 + "q" * 20_000 + " " + "q" * 20_000)]
    docs = spark.createDataFrame([(i, t, "k", "k", "w", 1, 2, "l") for i, t in rows], "doc_id long, text string" + CLASH).repartition(3)
    assert found_variants(variants.variants(docs)) == plain_variants(plain_words(rows))
    assert not variants.variants(docs.limit(0)).collect()


def test_wavelet_tree():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 65, 300):
        values = r.permutation(n)
        tree = variants.WaveletTree(values)
        lo, least = r.integers(0, n + 1, 200), r.integers(0, n + 1, 200)
        hi, upto = r.integers(lo, n + 1), r.integers(least, n + 1)
        want = [sorted(v for v in values[a:b] if c <= v < d) for a, b, c, d in zip(lo, hi, least, upto)]
        assert tree.count(lo, hi, least, upto).tolist() == [len(w) for w in want]
        query, value = tree.report(lo, hi, least, upto)
        got = defaultdict(list)
        for q, v in zip(query.tolist(), value.tolist()):
            got[q].append(v)
        assert [sorted(got[q]) for q in range(200)] == want


def plain_negatives(rows, asks, k=5, m=10):
    fine = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and not any(x is None or not math.isfinite(x) for x in v)]
    width = max([len(v) for _, _, v in fine], default=0)
    fine = [(i, label, tuple(v + [0] * (width - len(v)))) for i, label, v in fine]
    out = []
    for a in sorted({i for i, _, _ in fine if asks(i)}):
        label, v = min((label, v) for i, label, v in fine if i == a)
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in fine if i != a)
        for p, (s, i, _) in enumerate([x for x in scored if x[2] == label][:k]):
            some = [(t, j) for t, j, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:m]
            out += [(a, i, rank, j, -s, -t, p + 1) for rank, (t, j) in enumerate(some, 1)]
    return sorted(out)


def found_negatives(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect())


@pytest.mark.parametrize("blocks", [512, 7])
def test_hard_negatives(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(negatives, "GROUP", 4)
    r = np.random.default_rng(6)
    centres = r.normal(size=(6, 12))
    rows = [(i, int(r.integers(0, 4)), (centres[i % 6] * r.choice([0.5, 1, 2]) + r.normal(scale=0.3, size=12)).astype("f4").tolist()) for i in range(600)]
    hot = rows[20][2]
    rows += [(i, i % 3, hot) for i in range(1000, 1200)]  # a third of all: equal vectors, ties by id
    rows += [(2000, None, hot), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [float("nan")] * 12), (2040, 1, [float("inf")] * 12), (None, 1, hot), (2050, 1, []), (2060, 2, [0.0] * 12), (2070, 1, [1.5, -2.5]), (2080, 99, hot)]
    rows += [(33, rows[33][1], rows[33][2])] * 3 + [(2090, 7, hot), (-10, 1, hot)]
    df = spark.createDataFrame([(*x, "c", "k") for x in rows], "vec_id long, label int, embedding array<float>, cell string, block string").repartition(5)
    got = found_negatives(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0)
    assert len({x[0] for x in got}) > 60
    assert not negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect()
    assert not negatives.hard_negatives(df, F.lit(False)).collect()


def test_bounds_hold():
    """No pair whose score is asked for lies outside of the ranges."""
    r = np.random.default_rng(11)
    points = np.floor(256 * (r.normal(size=(40, 6)) + r.integers(-2, 3, (40, 1))))
    rows = np.floor(256 * (r.normal(size=(900, 6)) * r.choice([0.3, 1, 2], (900, 1))))
    top = max((points**2).sum(axis=1).max(), (rows**2).sum(axis=1).max())
    pivots = negatives.Pivots(points, float(top))
    d = pivots.distances(rows, False)
    cell = d.argmin(axis=1)
    own = d[np.arange(len(d)), cell]
    away = []
    for a in rows[:60]:
        scores = rows @ a
        for least, most in [(np.quantile(scores, 0.99), np.inf), (np.quantile(scores, 0.6), np.quantile(scores, 0.7)), (-np.inf, np.quantile(scores, 0.01))]:
            low, high = pivots.ranges(a[None], np.array([least]), np.array([most]))
            asked = (scores >= least) & (scores <= most)
            assert (low[cell] <= own)[asked].all() and (own <= high[cell])[asked].all()
            away.append(((low[cell] > own) | (own > high[cell])).mean())
    assert np.mean(away) > 0.05  # and they do keep rows away


def test_registered(spark):
    got = queries.QUERIES["op11_pii"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and sum(r.n_email for r in got) > 0
