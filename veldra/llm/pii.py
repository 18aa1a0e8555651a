"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field over whole spans.

Four patterns (email, ip, card, phone) are always reported. Around digits and
marks of addresses the text is cut into tokens, and the field scores whole
segments of them: how their digits are grouped and parted, whether checksums
hold, how an address is written out, what stands before and after. A dynamic
programme over segments of bounded length chooses boundaries and kinds at once;
what the patterns have found is held fixed in it, and no chosen segment touches
it. So phone numbers without a plus, numbers and addresses with unusual
separators, written-out addresses ("name (at) host dot org"), IBANs and social
security numbers are added.

The weights are learned here, by maximum likelihood over all segmentations of
sentences that ``examples`` makes from a seed: spans of each kind in many
notations, and dates, prices, versions, codes and measures that are none. They
are the same for every corpus and every size.

Defined results: null and empty texts have no spans; positions count code
points, ends are exclusive; spans are in order of start, then kind; spans of
different patterns may overlap; rows are kept one to one, in any number of
repeats; columns not named in ``keep`` are left out; an empty table gives no
rows. Time is linear in a text's length; memory is about 60 bytes for each
token of a stretch that is full of digits.
"""

from __future__ import annotations

import functools
import math
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veldra.llm.textcore import chunks

#: Kinds in the order in which spans with the same start are listed; the last two come from the field alone.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
#: The patterns. A run of digits is entered at its beginning only, which changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Most tokens of an entity, groups of digits in one, and characters around digits and marks that are read.
MAX_TOKENS, MAX_GROUPS, AROUND = 32, 7, 200
#: Training: seed, sentences, rounds, step and weight of the penalty.
SEED, SENTENCES, ROUNDS, STEP, PENALTY = 5, 3000, 6, 0.4, 1e-3

_DIGITS = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_MARKS = re.compile(r"[0-9]{2}|@|[(\[{]\s?(?:at|AT)\s?[)\]}]|\b(?:at|AT|chez|arroba)\b(?=\s\S+\s(?:dot|DOT|punkt|point|punto)\b)")
_DOTS = frozenset(("dot", "punkt", "point", "punto"))
_ATS = frozenset(("at", "chez", "arroba"))
_OPEN, _CLOSE = "([{", ")]}"
#: Words that often come before a kind of span, and before numbers that are none.
CUES = {
    "phone": "phone tel telephone telefon telefono teléfono téléphone call fax mobile cell handy whatsapp sms dial ring rufnummer portable móvil",
    "email": "email mail contact write kontakt correo courriel contacto reach",
    "card": "card visa mastercard amex credit karte kreditkarte carte tarjeta debit payment",
    "ip": "ip host server address addr login gateway from ping dns",
    "iban": "iban account konto compte cuenta bank transfer",
    "ssn": "ssn social security taxpayer",
    "other": "version isbn order invoice page chapter part serial ref build rfc section lot code ticket room paragraph patent model batch tracking sku date born issue number no nr id",
}
#: Ends of host names that are common.
TOP_LEVEL = frozenset("com org net edu gov info example test io co de fr es it nl at ch be uk eu pt pl se dk us ca au jp br mx dev app biz".split())
_CUE = {w: k for k, words in CUES.items() for w in words.split()}
_UNITS = frozenset("kg g km m cm mm eur usd chf gb mb kb ms s h percent pages bytes euros dollars meter stück".split()) | set("%€$£°")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes Luhn's check."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _mod97(letters: str) -> bool:
    return int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        if at >= end and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, 0, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    if _FIRST_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    found.sort()
    return found


_FIRST_DIGIT = re.compile(r"[0-9]")


class Zone:
    """Tokens of a stretch of text, and the segments of them that may be entities."""

    def __init__(self, text: str, start: int, end: int, cover: list[tuple[int, int, int]] = ()):
        self.text = text
        self.starts, self.ends = array("q"), array("q")
        for m in _TOKEN.finditer(text, start, end):
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.n = len(self.starts)
        #: For a token in a span that is held fixed: its number in ``fixed``, else -1.
        self.held = array("q", [-1]) * self.n
        self.fixed: list[tuple[int, int, int]] = []
        for a, kind, b in cover:
            i, j = bisect_left(self.ends, a + 1), bisect_left(self.starts, b)
            if i < j and i < self.n:
                for t in range(i, j):
                    self.held[t] = len(self.fixed)
                self.fixed.append((i, kind, j))

    def token(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def near(self, i: int) -> bool:
        """Whether token i follows the one before it with nothing or one blank between."""
        gap = self.starts[i] - self.ends[i - 1]
        return gap == 0 or gap == 1 and self.text[self.ends[i - 1]] not in "\n\r\x0b\x0c"

    def glued(self, i: int, j: int) -> bool:
        """Whether a letter or digit touches the segment."""
        a, b = self.starts[i], self.ends[j - 1]
        return a > 0 and (self.text[a - 1].isalnum() or self.text[a - 1] in "_@") or b < len(self.text) and (self.text[b].isalnum() or self.text[b] in "_@")

    def _dot(self, i: int) -> int:
        """Tokens of the mark for a dot at i ('.', 'dot', either in brackets); 0 if there is none."""
        if i >= self.n or self.held[i] >= 0:
            return 0
        t = self.token(i)
        if t == "." or t.lower() in _DOTS:
            return 1
        if t in _OPEN and i + 2 < self.n and self.token(i + 2) in _CLOSE and (self.token(i + 1) == "." or self.token(i + 1).lower() in _DOTS) and self.near(i + 1) and self.near(i + 2):
            return 3
        return 0

    def _at(self, i: int) -> int:
        t = self.token(i)
        if t == "@" or t.lower() in _ATS:
            return 1
        return 3 if t in _OPEN and i + 2 < self.n and self.token(i + 1).lower() in _ATS and self.token(i + 2) in _CLOSE else 0

    def addresses(self, i: int) -> Iterator[tuple[int, int, list[str]]]:
        """Segments around a mark for '@' at token i, with their features."""
        k = self._at(i)
        if not k or any(self.held[t] >= 0 for t in range(i, min(i + k, self.n))):
            return
        mark = "@" if self.token(i) == "@" else "bracket" if k == 3 else "word"
        ends, j, dots = [], i + k, []
        while j < self.n and j - i < MAX_TOKENS // 2 and self.held[j] < 0 and self.near(j):
            if not self.token(j).isalnum():
                break
            while j + 1 < self.n and self.ends[j] == self.starts[j + 1] and self.held[j + 1] < 0 and (self.token(j + 1).isalnum() or self.token(j + 1) == "-"):
                j += 1
            j += 1
            if dots and self.token(j - 1).isalpha():
                ends.append((j, "dot" if dots[-1] != "." else "."))
            d = self._dot(j)
            if not d or not self.near(j):
                break
            dots.append("." if self.token(j) == "." else "dot")
            j += d
        s = i
        while s > 0 and i - s < MAX_TOKENS // 2 and self.held[s - 1] < 0 and self.near(s):
            t = self.token(s - 1)
            if not (t.isalnum() or t in "._%+-)]}([{") or t.lower() in _ATS:
                break
            s -= 1
            if not t.isalnum() or s + 1 < self.n and t.lower() in _DOTS:
                continue
            spaced = sum(self.starts[x + 1] > self.ends[x] and self._dot(x) == 0 and self._dot(x + 1) == 0 for x in range(s, i - 1))
            for e, dot in ends:
                if not self.glued(s, e):
                    tld = self.token(e - 1)
                    whole = s == 0 or self.starts[s] > self.ends[s - 1] or self.token(s - 1) in "(<[:;,\"'"
                    cut = s > 0 and self.near(s) and (self._dot(s - 1) == 1 or self.token(s - 1) in _CLOSE and s > 2 and self._dot(s - 3) == 3)
                    yield s, e, [f"cut:{cut}", f"top:{tld.lower() in TOP_LEVEL}", f"at:{mark}:{dot}:top:{tld.lower() in TOP_LEVEL}", f"at:{mark}", f"at:{mark}:{dot}", f"at:{mark}:spaced{min(spaced, 2)}", f"tld:{min(len(tld), 7)}", f"tld:{tld.islower()}", f"whole:{whole}", f"ended:{e == ends[-1][0]}", f"gap:{self.starts[i] > self.ends[i - 1]}", *self._around(s, e)]

    def numbers(self, i: int) -> Iterator[tuple[int, int, list[str], tuple[int, ...]]]:
        """Segments that begin at token i and may be a number of some kind, with their features and kinds."""
        first = self.token(i)
        if self.held[i] >= 0:
            return
        head = first.isalpha() and first.isascii() and len(first) == 2 and first.isupper() and i + 1 < self.n and self.starts[i + 1] == self.ends[i] and self.token(i + 1).isdigit()
        if head:
            yield from self._iban(i)
            return
        if not (first[0] in "0123456789" or first in "+(" and i + 1 < self.n and self.token(i + 1)[0] in "0123456789(" and self.starts[i + 1] == self.ends[i]):
            return
        groups: list[str] = []
        parts: list[str] = []
        between, j = "", i
        while j < self.n and j - i < MAX_TOKENS and self.held[j] < 0:
            if j > i:
                if not self.near(j):
                    return
                if self.starts[j] > self.ends[j - 1]:
                    between += " "
            t = self.token(j)
            if t[0] in "0123456789":
                if groups:
                    parts.append(between)
                elif between.strip() not in ("", "+", "(", "+("):
                    return
                groups.append(t)
                n = sum(map(len, groups))
                if n > 19 or len(groups) > MAX_GROUPS:
                    return
                j += 1
                if n >= 4 and not self.glued(i, j):
                    kinds = tuple(k for k, able in ((1, len(groups) == 4 and n <= 12), (2, n >= 12), (3, 7 <= n <= 15), (5, n == 9 and len(groups) == 3)) if able)
                    if kinds:
                        yield i, j, self._numeric(i, j, groups, parts), kinds
                between = ""
                continue
            d = self._dot(j)
            if d and d > 1 or d and t != ".":
                between += "dot"
                j += d
            elif t in "-./()+–":
                if t == "+" and j > i:
                    return
                between += t
                j += 1
            else:
                return
            if len(between.replace(" ", "")) > 3:
                return

    def _numeric(self, i: int, j: int, groups: list[str], parts: list[str]) -> list[str]:
        digits = "".join(groups)
        sizes = [len(g) for g in groups]
        seps = sorted({p.strip() or p[:1] for p in parts})
        out = [f"n:{len(digits)}", f"groups:{len(groups)}", "sizes:" + "-".join(map(str, sizes)), "seps:" + "|".join(seps), f"mixed:{len(seps) > 1}", f"lead:{self.token(i) if not self.token(i).isdigit() else '0' if digits[0] == '0' else 'd'}"]
        out += [f"last:{min(sizes[-1], 5)}", f"short:{min(sizes) if len(sizes) > 1 else 'one'}", f"even:{len(set(sizes[:-1])) <= 1 and len(sizes) > 2}"]
        if len(digits) >= 12:
            out.append(f"luhn:{luhn(digits)}")
        if len(groups) == 4:
            fine = all(int(g) <= 255 and (len(g) == 1 or g[0] != "0") for g in groups)
            out.append(f"octets:{fine}:{'dot' if seps in (['.'], ['dot']) else 'else'}:{len(seps) == 1}")
        if len(groups) == 3:
            year = [len(g) == 4 and 1800 <= int(g) <= 2100 for g in groups]
            small = [len(g) <= 2 and 1 <= int(g) <= 31 for g in groups]
            if (year[0] and small[1] and small[2]) or (year[2] and small[0] and small[1]):
                out.append("date")
            if sizes == [3, 2, 4]:
                out.append(f"ssn:{groups[0] not in ('000', '666') and groups[0][0] != '9' and groups[1] != '00'}:{seps}")
        if any(len(g) == 4 and 1800 <= int(g) <= 2100 for g in groups) and len(groups) > 1:
            out.append("year")
        if sizes[1:] and all(s == 3 for s in sizes[1:]) and sizes[0] <= 3 and len(seps) == 1 and seps[0] in ".  ":
            out.append("thousands")
        return out + self._around(i, j)

    def _iban(self, i: int) -> Iterator[tuple[int, int, list[str], tuple[int, ...]]]:
        whole, blocks, size = self.token(i), 1, 2
        for j in range(i + 1, min(self.n, i + MAX_TOKENS)):
            t = self.token(j)
            if self.held[j] >= 0 or not self.near(j) or not (t.isalnum() and t.isascii()):
                return
            if self.starts[j] > self.ends[j - 1]:
                blocks += 1
            whole += t
            size = len(whole)
            if size > 34:
                return
            if size >= 15 and whole[2:4].isdigit() and not self.glued(i, j + 1):
                fine = whole.isupper() and _mod97(whole)
                yield i, j + 1, [f"mod97:{fine}", f"blocks:{'one' if blocks == 1 else 'fours' if blocks == -(-size // 4) else 'else'}", *self._around(i, j + 1)], (4,)

    def _around(self, i: int, j: int) -> list[str]:
        cues, seen = set(), 0
        for t in range(i - 1, max(-1, i - 8), -1):
            w = self.token(t)
            if w.isalpha():
                seen += 1
                if cue := _CUE.get(w.lower()):
                    cues.add(cue)
                if seen == 3:
                    break
        out = [f"cue:{c}" for c in sorted(cues)] if cues else ["cue:none"]
        if cues == {"other"}:
            out.append("cue:other only")
        before = self.text[self.starts[i] - 1] if self.starts[i] else " "
        after = self.token(j).lower() if j < self.n else ""
        out.append("before:" + (before if before in "#:=/.,-+€$£\"'(<*x" else "blank" if before.isspace() else "else"))
        if after in _UNITS:
            out.append("unit")
        if j < self.n and self.near(j) and after[0] in "0123456789":
            out.append("number after")
        if i > 0 and self.near(i) and self.token(i - 1)[0] in "0123456789":
            out.append("number before")
        if after and after in "./,-:=" and self.starts[j] == self.ends[j - 1] and j + 1 < self.n and self.starts[j + 1] == self.ends[j]:
            out.append("goes on")
        return out

    def segments(self) -> dict[int, list[tuple[int, int, tuple[str, ...]]]]:
        """By end: start, kind and features of all segments that may be entities."""
        out: dict[int, list] = {}
        for i in range(self.n):
            t = self.text[self.starts[i]]
            if t in "0123456789+(" or "A" <= t <= "Z":
                for a, b, features, kinds in self.numbers(i):
                    out.setdefault(b, []).extend((a, k, features) for k in kinds)
            if t in "@([{aAcC":
                for a, b, features in self.addresses(i):
                    out.setdefault(b, []).append((a, 0, features))
        return out


class Field:
    """Weights of the semi-Markov field: of features by kind, and of a kind after another (the last one is none)."""

    def __init__(self) -> None:
        self.weights: list[dict[str, float]] = [{} for _ in KINDS]
        self.bias = [0.0] * len(KINDS)
        self.after = [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)]

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights[kind].get
        return self.bias[kind] + sum([get(f, 0.0) for f in features])

    def best(self, zone: Zone) -> list[tuple[int, int, int]]:
        """The best segmentation of a zone: (start, kind, end) in characters, without what is held fixed."""
        segments = zone.segments()
        if not segments:
            return []
        none, n = len(KINDS), zone.n
        low = -1e18
        score = [array("d", [low]) * (n + 1) for _ in range(none + 1)]
        start, came = ([array("i", [0]) * (n + 1) for _ in range(none + 1)] for _ in range(2))
        score[none][0] = 0.0

        def reach(i: int, j: int, kind: int, gain: float) -> None:
            x, y = max((score[p][i] + self.after[p][kind], p) for p in range(none + 1))
            if x + gain > score[kind][j]:
                score[kind][j], start[kind][j], came[kind][j] = x + gain, i, y

        for j in range(1, n + 1):
            held = zone.held[j - 1]
            if held < 0:
                reach(j - 1, j, none, 0.0)
                for i, kind, features in segments.get(j, ()):
                    reach(i, j, kind, self.score(kind, features))
            elif zone.fixed[held][2] == j or j == n:
                reach(zone.fixed[held][0], j, zone.fixed[held][1], 0.0)
        out, j = [], n
        kind = max(range(none + 1), key=lambda k: score[k][n])
        while j > 0:
            i = start[kind][j]
            if kind != none and zone.held[i] < 0:
                out.append((zone.starts[i], kind, zone.ends[j - 1]))
            kind, j = came[kind][j], i
        return out[::-1]

    def learn(self, zone: Zone, gold: list[tuple[int, int, int]], step: float, sums: dict) -> float:
        """One step of adaptive gradient ascent on the log-likelihood of a zone's true segmentation (token starts, kinds, token ends); returns that likelihood."""
        none, n, after = len(KINDS), zone.n, self.after
        by_end = zone.cached if hasattr(zone, "cached") else zone.segments()
        zone.cached = by_end
        arcs = [(i, j, k, f, self.score(k, f)) for j, found in by_end.items() for i, k, f in found]
        arcs += [(j - 1, j, none, (), 0.0) for j in range(1, n + 1)]
        arcs.sort(key=lambda a: (a[1], a[0]))
        kinds = range(none + 1)
        forward = [[-math.inf] * (none + 1) for _ in range(n + 1)]
        backward = [[-math.inf] * (none + 1) for _ in range(n + 1)]
        forward[0][none], backward[n] = 0.0, [0.0] * (none + 1)
        into = []  # for each arc: the sum of the paths that enter it
        for i, j, k, _, s in arcs:
            enter = _total([forward[i][p] + after[p][k] for p in kinds])
            into.append(enter)
            forward[j][k] = _total([forward[j][k], enter + s])
        for i, j, k, _, s in reversed(arcs):
            for p in kinds:
                if forward[i][p] > -math.inf:
                    backward[i][p] = _total([backward[i][p], after[p][k] + s + backward[j][k]])
        z = _total(forward[n])
        grads: dict = {}
        for (i, j, k, features, s), enter in zip(arcs, into):
            share = math.exp(min(0.0, enter + s + backward[j][k] - z))
            if share > 1e-9:
                if k != none:
                    for f in (None, *features):
                        grads[k, f] = grads.get((k, f), 0.0) - share
                for p in kinds:
                    if forward[i][p] > -math.inf and (p != none or k != none):
                        grads[p, k, ""] = grads.get((p, k, ""), 0.0) - math.exp(min(0.0, forward[i][p] + after[p][k] + s + backward[j][k] - z))
        at, last, likelihood = 0, none, -z
        known = {(i, j, k): (f, s) for i, j, k, f, s in arcs}
        for i, kind, j in [*gold, (n, none, n)]:
            for t in range(at, i):
                likelihood += after[last][none]
                if last != none:
                    grads[last, none, ""] = grads.get((last, none, ""), 0.0) + 1
                last = none
            if i < j:
                f, s = known[i, j, kind]
                likelihood += after[last][kind] + s
                grads[last, kind, ""] = grads.get((last, kind, ""), 0.0) + 1
                for x in (None, *f):
                    grads[kind, x] = grads.get((kind, x), 0.0) + 1
                last, at = kind, j
        for key, g in grads.items():
            old = self._get(key)
            g -= PENALTY * old
            sums[key] = sums.get(key, 1e-8) + g * g
            self._set(key, old + step * g / math.sqrt(sums[key]))
        return likelihood

    def _get(self, key: tuple) -> float:
        return self.after[key[0]][key[1]] if len(key) == 3 else self.bias[key[0]] if key[1] is None else self.weights[key[0]].get(key[1], 0.0)

    def _set(self, key: tuple, value: float) -> None:
        if len(key) == 3:
            self.after[key[0]][key[1]] = value
        elif key[1] is None:
            self.bias[key[0]] = value
        else:
            self.weights[key[0]][key[1]] = value


def _total(logs: list[float]) -> float:
    top = max(logs)
    return top if top == -math.inf else top + math.log(sum([math.exp(x - top) for x in logs]))


class _Maker:
    """Makes spans of each kind, things that only look like them, and sentences around them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def word(self) -> str:
        return "".join(self.r.choice("bcdfghlmnprstvw") + self.r.choice("aeiouäé" if self.r.random() < 0.1 else "aeiou") for _ in range(self.r.randint(1, 4))) + self.r.choice(["", "n", "s", "r"])

    def name(self) -> str:
        return "".join(self.r.choice("bcdfghjklmnprstvz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 4)))

    def split(self, digits: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(digits[at : at + s])
            at += s
        return sep.join(out)

    def email(self) -> str:
        r = self.r
        host, tld = self.name() + r.choice(["", "", "-" + self.name(), str(r.randint(1, 99))]), r.choice(["com", "org", "net", "de", "fr", "es", "io", "co", "info", "example"])
        parts = [self.name(), *([self.name()] if r.random() < 0.6 else []), *([str(r.randint(1, 99))] if r.random() < 0.2 else [])]
        hosts = [host, *([self.name()] if r.random() < 0.3 else []), tld]
        style = r.randrange(6)
        if style == 0:
            return r.choice([".", "_", "-"]).join(parts) + r.choice([" @ ", " @", "@ "]) + ".".join(hosts)
        if style == 1:
            return ".".join(parts) + r.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}", " [AT] "]) + ".".join(hosts)
        dot = r.choice([" dot ", " (dot) ", " [dot] ", "[dot]", "(dot)", " DOT "]) if style != 5 else " . "
        at = r.choice([" at ", " AT ", " (at) ", " [at] ", "[at]", " @ "]) if style != 5 else " @ "
        return (dot if r.random() < 0.5 or style == 5 else ".").join(parts) + at + dot.join(hosts)

    def ip(self) -> str:
        return self.r.choice([" . ", "[.]", "(.)", " dot ", " [.] ", "[dot]", ". ", " ."]).join(str(self.r.randint(1, 255)) for _ in range(4))

    def card(self) -> str:
        n = self.r.choice([15, 16, 16, 16])
        head = self.digits(n - 1, "3456")
        digits = next(head + c for c in "0123456789" if luhn(head + c))
        return self.split(digits, [4, 4, 4, 4] if n == 16 else [4, 6, 5], self.r.choice([".", " - ", "/", ". ", "–", " / "]))

    def phone(self) -> str:
        r = self.r
        a, b, c = self.digits(3, "23456789"), self.digits(3, "23456789"), self.digits(4)
        return r.choice([
            lambda: f"({a}) {b}-{c}", lambda: f"({a}){b}-{c}", lambda: f"{a}-{b}-{c}", lambda: f"{a}.{b}.{c}", lambda: f"{a} {b} {c}", lambda: f"1-{a}-{b}-{c}", lambda: f"({a}) {b} {c}",
            lambda: f"0{self.digits(r.choice([2, 3]), '123456789')}{r.choice([' ', '/', '-', ' / '])}{self.digits(r.choice([6, 7, 8]))}", lambda: f"0{r.randint(1, 9)} " + " ".join(self.digits(2) for _ in range(4)),
            lambda: f"00{r.choice(['49', '33', '34', '1', '44'])} {self.digits(3, '123456789')} {self.digits(r.choice([6, 7, 8]))}", lambda: f"(0{self.digits(2, '123456789')}) {self.digits(3)} {self.digits(4)}",
            lambda: f"{r.choice('6789')}{self.digits(2)} {self.digits(3)} {self.digits(3)}", lambda: f"+{self.digits(2, '1234')}/{self.digits(3)}/{self.digits(6)}",
            lambda: f"+1 ({a}) {b}-{c}", lambda: f"+{self.digits(2, '1234')} {self.digits(3, '123456789')} {self.digits(7)}",
        ])()

    def bare(self) -> str:
        """A phone number that only its cue tells."""
        return self.r.choice([lambda: self.digits(10, "23456789"), lambda: f"{self.digits(3, '23456789')}-{self.digits(4)}", lambda: f"0{self.digits(self.r.choice([9, 10]), '123456789')}", lambda: f"{self.digits(3)} {self.digits(4)}"])()

    def iban(self) -> str:
        country, n = self.r.choice([("DE", 18), ("FR", 23), ("ES", 20), ("NL", 14), ("GB", 18), ("AT", 16), ("IT", 23)])
        body = self.digits(n) if country in ("DE", "ES", "AT", "FR") else "ABNA" + self.digits(n - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        whole = f"{country}{check:02}{body}"
        return whole if self.r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def ssn(self) -> str:
        return self.r.choice(["-", "-", " "]).join([f"{self.r.randint(1, 665):03}", f"{self.r.randint(1, 99):02}", self.digits(4)])

    def nothing(self) -> str:
        r = self.r
        day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1900, 2040)
        return r.choice([
            lambda: f"{year}-{month:02}-{day:02}", lambda: f"{day:02}.{month:02}.{year}", lambda: f"{month}/{day}/{year}", lambda: f"{year}-{month:02}-{day:02} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
            lambda: f"{year}{month:02}{day:02}", lambda: f"{year}-{year + 1} {r.randint(1, 999)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 999)}-{r.randint(1, 9)}",
            lambda: f"{r.randint(1, 999)}.{r.randint(0, 999):03}.{r.randint(0, 999):03}", lambda: f"{r.randint(1, 999)},{r.randint(0, 999):03},{r.randint(0, 999):03}", lambda: f"{r.randint(1, 99)} {r.randint(0, 999):03} {r.randint(0, 999):03} {r.choice(['kg', 'km', 'EUR', '€', 'bytes', '%'])}",
            lambda: f"isbn 978-{r.randint(0, 9)}-{self.digits(2)}-{self.digits(6)}-{r.randint(0, 9)}", lambda: f"order {self.digits(r.randint(7, 12))}", lambda: f"invoice {self.digits(4)}-{self.digits(5)}", lambda: f"#{self.digits(r.randint(7, 10))}",
            lambda: f"serial {self.digits(3)}-{self.digits(3)}-{self.digits(4)}", lambda: f"part no {self.digits(3)}-{self.digits(4)}", lambda: self.digits(r.randint(7, 20)), lambda: f"{self.digits(4)} {self.digits(4)} {self.digits(4)} {self.digits(4)}",
            lambda: f"{self.digits(2)}.{self.digits(6)}, {self.digits(1)}.{self.digits(6)}", lambda: f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)}", lambda: f"{self.digits(3)} {self.digits(3)} {self.digits(3)} {self.digits(3)}", lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{r.randint(0, 255)}.{r.randint(0, 255)}",
            lambda: f"pages {self.digits(3)}-{self.digits(3)}, {self.digits(3)}-{self.digits(3)}", lambda: f"{r.randint(1, 12)} . {r.randint(1, 12)}", lambda: " ".join(str(r.randint(1, 40)) for _ in range(r.randint(3, 7))), lambda: f"{year} {year + 1} {year + 2}",
            lambda: f"look at {self.name()}.com", lambda: f"we met at {self.name()} dot by dot", lambda: f"hosted at {self.name()}.{self.name()}.net", lambda: f"see @{self.name()} and @{self.name()}", lambda: f"{self.name()} @ {r.randint(2, 99)} each", lambda: f"arrived at {self.name()} point of {self.name()}",
            lambda: f"section {r.randint(1, 20)}.{r.randint(1, 20)}.{r.randint(1, 20)}.{r.randint(1, 20)}", lambda: f"{r.choice(['AB', 'XK', 'DE', 'NR'])}{self.digits(r.randint(14, 20))}", lambda: f"ticket {self.digits(3)}-{self.digits(2)}-{self.digits(4)}", lambda: f"{self.digits(2)} {self.digits(2)} {self.digits(2)} {self.digits(2)}",
            lambda: f"{r.randint(10, 999)}-{r.randint(10, 999)}", lambda: f"{r.randint(1, 99)} + {r.randint(1, 99)} = {r.randint(1, 999)}", lambda: f"{self.digits(4)}x{self.digits(4)}", lambda: f"scores {r.randint(1, 9)}-{r.randint(1, 9)} {r.randint(1, 9)}-{r.randint(1, 9)} {r.randint(1, 9)}-{r.randint(1, 9)} {r.randint(1, 9)}-{r.randint(1, 9)}",
        ])()

    def sentence(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text and its spans (start, kind, end)."""
        r = self.r
        text, spans = " ".join(self.word() for _ in range(r.randint(0, 5))), []
        for _ in range(r.choice([1, 1, 2])):
            text += " " if text else ""
            if r.random() < 0.5:
                text += self.nothing()
            else:
                kind = r.choice([0, 0, 1, 2, 3, 3, 3, 4, 5, 6])
                cue = "phone" if kind == 6 else KINDS[kind]
                if kind in (5, 6) or r.random() < 0.4:
                    text += r.choice(CUES[cue].split()) + r.choice([" ", ": ", ":", " is ", " no ", " number ", "="][: 6 if kind == 0 else 7])
                make = (self.email, self.ip, self.card, self.phone, self.iban, self.ssn, self.bare)[kind]
                made = make()
                spans.append((len(text), min(kind, 3) if kind == 6 else kind, len(text) + len(made)))
                text += made
                if made[0] == "+" and "/" not in made:  # the pattern reads on into the number that follows, and drops both
                    text += " " + (self.digits(r.randint(12, 17)) if r.random() < 0.6 else ".".join(str(r.randint(10, 255)) for _ in range(4)))
            text += r.choice(["", ".", ",", ")", ";", "\n", " and", " " + self.word(), " " + self.word() + " " + self.word()])
            if r.random() < 0.2:
                text += " " + str(r.randint(1, 2030))
        return text, spans


def examples(seed: int, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts and the spans in them that the patterns do not find; sentences in which a pattern finds a part of such a span are left out."""
    maker, out = _Maker(seed), []
    while len(out) < n:
        text, spans = maker.sentence()
        if not any(a < y and x < b for a, _, b in base_spans(text) for x, _, y in spans):
            out.append((text, spans))
    return out


def _cover(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans with those that overlap put together, of the kind of the first."""
    out: list[tuple[int, int, int]] = []
    for a, kind, b in spans:
        if out and a < out[-1][2]:
            out[-1] = (*out[-1][:2], max(out[-1][2], b))
        else:
            out.append((a, kind, b))
    return out


@functools.cache
def trained() -> Field:
    """The field, learned from ``SENTENCES`` sentences."""
    field, sums = Field(), {}
    zones = []
    for text, spans in examples(SEED, SENTENCES):
        zone = Zone(text, 0, len(text), _cover(base_spans(text)))
        gold = [(bisect_left(zone.starts, a), k, bisect_left(zone.starts, b)) for a, k, b in spans]
        known = {(i, k, j) for j, found in zone.segments().items() for i, k, _ in found}
        if all(g in known for g in gold):  # what no segment can express teaches nothing
            zones.append((zone, gold))
    order = random.Random(SEED)
    for _ in range(ROUNDS):
        order.shuffle(zones)
        for zone, gold in zones:
            field.learn(zone, gold, STEP, sums)
    return field


def spans_of(text: str | None, field: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a pattern found it) of all personal data of a text."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, True) for s in base]
    cover = _cover(base)
    starts = [c[0] for c in cover]
    for a, b in _zones(text):
        inside = cover[max(0, bisect_left(starts, a) - 1) : bisect_left(starts, b)]
        found += [(*s, False) for s in field.best(Zone(text, a, b, inside))]
    found.sort()
    return [(KINDS[k], a, b, fixed) for a, k, b, fixed in found]


def _zones(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and marks of addresses; what lies between is no part of an entity."""
    out: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text) if _ANY.search(text) else ():
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    # whole tokens at both ends
    return [(_edge(text, a, -1), _edge(text, b, 1)) for a, b in out]


_ANY = re.compile(r"[0-9@]|[Aa][Tt][)\]}\s]|arroba|chez")


def _edge(text: str, at: int, step: int) -> int:
    """Moves a cut out of a word, but not by more than the stretch that is read anyway."""
    for _ in range(AROUND):
        if not 0 < at < len(text) or not (text[at - 1].isalnum() and text[at].isalnum()):
            break
        at += step
    return at


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def personal(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``spans`` (all) and ``base`` (of the patterns alone), both array<struct<kind, start, end>>, of every text."""
    schema = StructType([*(docs.schema[k] for k in keep), StructField("spans", SPANS), StructField("base", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    field = trained()  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "__text"):
            found = [spans_of(t, field) for t in b.column(b.num_columns - 1).to_pylist()]
            lists = [[[{"kind": k, "start": s, "end": e} for k, s, e, fixed in f if fixed or not base] for f in found] for base in (False, True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, kind) for x in lists)], schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
