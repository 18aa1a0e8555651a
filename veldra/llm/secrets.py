"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

Three patterns (assignments, access keys, long hexadecimal runs) are always
reported. Besides, every string of 12 characters or more that follows a
sensitive word in its statement, at any distance, or closely (or what such a
word inside of it is followed by) is a candidate: a zstandard compressor primed with a
dictionary of common identifiers compresses the surrounding code with and
without it, a model of letter pairs and character classes spells it, and
candidates that neither makes shorter than a random string of their length
and alphabet are reported as ``novel``, unless a pattern has all of them already.
A line of nothing but such a string right after a secret is a candidate too,
so keys of several lines are followed to their end.

Defined results: null and empty texts have no spans; positions count code
points, ends are exclusive; spans are in order of start, then kind; spans of
different patterns may overlap; rows are kept one to one, in any number of
repeats; columns not named in ``keep`` are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veldra.llm.textcore import chunks

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "novel")
#: The patterns, on UTF-8 bytes (letters in either case are ASCII).
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Words that make what follows sensitive, in lower case.
SENSITIVE = (b"passw", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"credential", b"bearer", b"authorization", b"private_key", b"private key", b"access_key", b"client_id", b"akia")
#: What stands for a secret in a masked text.
MASK = b"[secret]"
#: Bytes after a sensitive word in which candidates begin even beyond its statement, and bytes of code around a candidate.
REACH, AROUND = 64, 160
#: Ends of statements: lines, sentences, and marks that code ends them with.
STATEMENT_END = re.compile(rb"[.!?;}](?=\s)|[\r\n]")
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
#: A line of its own after a secret, and what may stand between the two.
NEXT_LINE = re.compile(rb"[\"',;\\]{0,3}(?:\r?\n|\\n)[ \t>#*\"']{0,16}([A-Za-z0-9+/_=-]+)(?=[\"',;\\ \t\r\n]|$)")
#: Costs of a candidate in the compressor and by spelling, as shares of that of a random string like it, from which it counts as random.
NOVELTY, SPELLING, SLACK = 0.93, 1.02, 12
#: Bits that a random string like it has to hold at least (one without letters: as many as 20 digits).
LEAST_BITS, LEAST_DIGITS = 45, 20
#: Common identifiers that prime the compressor.
IDENTIFIERS = b" ".join(
    b"password passwd username secret token api_key apikey client_id client_secret access_key private_key public_key authorization bearer credential "
    b"config settings environment variable default example placeholder changeme localhost http https www com org net index html json yaml return import "
    b"function class const static string integer boolean true false null none self this request response header content type length value name "
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 12345678 xxxxxxxx 1234567890abcdef".split()
)
#: Words (and, with the identifiers, pairs of letters) that the model of spelling knows.
WORDS = (
    b"the of and to in is that for it was on are as with his they be at one have this from or had by but what some we can out other were all there when up use your how said each she which "
    b"their time will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water "
    b"than call first who may down side been now find any new work part take get place made live where after back little only round man year came show every good me give our under name very "
    b"through just form sentence great think say help low line differ turn cause much mean before move right boy old too same tell does set three want air well also play small end put home "
    b"read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house picture try us again animal point mother world near build "
    b"international authentication authorization application administrator configuration information development production management connection description transaction organization "
    b"generation verification permission expiration validation registration subscription implementation documentation initialize serializer repository exception "
    b"user account manager service session provider handler controller factory builder context database table column index cluster instance endpoint bucket region network address gateway "
    b"client server callback refresh signature encrypted decrypt certificate keystore vault hash salt digest expire revoke rotate login logout signin signup email profile update delete "
    b"aws rsa tls ssl aes gcm cbc sha hmac pkcs oaep padding ecdhe ecdsa utf json xml yaml http https api url uri uuid oauth jwt ssh pem iam sql mysql postgresql redis github python java linux "
    b"create insert select project package module version release feature branch master main staging testing temporary backup archive document payment customer invoice order product "
    b"der die und das ist nicht ein eine mit auf den von sich auch werden haben nach wie bei aus dem noch nur oder aber wenn kann ich wir ihre gegen zwischen verwaltung schluessel "
    b"benutzer passwort anmeldung einstellungen berechtigung datei ordner geheimnis zugang sicherheit entwicklung umgebung verbindung le la les des est une dans que qui pour pas sur avec "
    b"plus par sont mais comme tout nous vous leur cette fait utilisateur connexion securite fichier parametre mot de passe identifiant el los las una por con para como pero sus este "
    b"desde todo cuando muy sin sobre tambien hasta hay donde quien contrasena usuario clave acceso configuracion seguridad archivo conexion aplicacion"
)
#: Bits of the class of a character (lower case, upper case, digit, other) after that of the one before; 4 is the start, 5 a further upper case letter.
_SWITCH = [[-log2(x / 100) for x in row] for row in ((86, 5, 2.5, 6.5), (38, 50, 4, 8), (4, 3, 75, 18), (56, 20, 18, 6), (62, 24, 8, 6), (4, 81, 3, 12))]
_CLASS = bytes(0 if 97 <= i <= 122 else 1 if 65 <= i <= 90 else 2 if 48 <= i <= 57 else 3 for i in range(256))
_pairs: list[list[float]] = []
_KNOWN = frozenset(w for w in (WORDS + b" " + IDENTIFIERS).lower().split() if len(w) > 2 and w.isalpha())
#: Words inside of identifiers, and the bits of one that is known.
PART, KNOWN_BITS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+"), 10.0
_RUNS = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_compressor = None


def _cost(data: bytes) -> int:
    global _compressor
    if _compressor is None:
        import zstandard

        prime = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _compressor = zstandard.ZstdCompressor(level=6, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(_compressor.compress(data))


def _letter_bits() -> list[list[float]]:
    """Bits of a letter (0 to 25) after another (26: after none)."""
    if not _pairs:
        for last in range(27):
            _pairs.append([0.15] * 26)
        for word in re.findall(rb"[a-z]+", (WORDS + b" " + IDENTIFIERS.replace(b"abcdefghijklmnopqrstuvwxyz", b"")).lower()):
            for x, y in zip(b"\x7b" + word, word):
                _pairs[(x - 97) % 27][y - 97] += 1
        for row in _pairs:
            total = sum(row)
            row[:] = [-log2(x / total) for x in row]
    return _pairs


def floor_bits(candidate: bytes) -> float:
    """Bits of a random string of the candidate's length over the character classes that it uses."""
    found = set(candidate)
    letters = 0
    for a, z in ((97, 122), (65, 90)):
        used = [c for c in found if a <= c <= z]
        letters += 0 if not used else 6 if max(used) < a + 6 else 26
    digits = 10 if any(48 <= c <= 57 for c in found) else 0
    return len(candidate) * log2(max(letters + digits + sum(_CLASS[c] == 3 for c in found), 2))


def spelling_bits(candidate: bytes) -> float:
    """Bits of the candidate in a model of words, digits and marks."""
    letters = _letter_bits()
    bits, last = 0.0, 4
    for c in candidate:
        k = _CLASS[c]
        bits += _SWITCH[last][k] + (0 if k < 2 else 3.32 if k == 2 else 2.58)
        last = 5 if k == 1 and last in (1, 5) else k
    for part in PART.findall(candidate):
        part = part.lower()
        spelt = sum(letters[(x - 97) % 27][y - 97] for x, y in zip(b"\x7b" + part, part))
        bits += min(spelt, KNOWN_BITS) if part in _KNOWN else spelt
    return bits


def novelty(before: bytes, candidate: bytes, after: bytes) -> float:
    """Compressed bits that the candidate adds to its surroundings (whole bytes, so ``SLACK`` more), in proportion to a random string like it."""
    return (8 * (_cost(before + after + b"\n" + candidate) - _cost(before + after + b"\n")) + SLACK) / floor_bits(candidate)


def _random(data: bytes, a: int, b: int) -> bool:
    candidate = data[a:b]
    if floor_bits(candidate) < LEAST_BITS or not any(c >= 65 and c != 95 for c in candidate) and sum(_CLASS[c] == 2 for c in candidate) < LEAST_DIGITS:
        return False
    return spelling_bits(candidate) >= SPELLING * floor_bits(candidate) and novelty(data[max(0, a - AROUND) : a], candidate, data[b : b + AROUND]) >= NOVELTY


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a text."""
    if not text:
        return []
    data = text.encode()
    found: list[tuple[int, int, int]] = []
    if b":" in data or b"=" in data:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if len(m[0]) >= LEAST["access"]]
    if b"x" * LEAST["hex"] in data.translate(_RUNS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(data) if len(m[0]) >= LEAST["hex"]]
    inside = _Cover([(a, b) for a, _, b in found])
    seen, novel = set(), []

    def follow(b: int) -> None:
        """Report the lines that carry a secret on from b."""
        while m := NEXT_LINE.match(data, b):
            a, b = m.span(1)
            short = b - a < 12 and (data[b - 1] == 61 or data[b : b + 24].lstrip(b"\"',;\\nr \t\r\n").startswith(b"-----END"))
            if a in seen or not (short or b - a >= 12 and _random(data, a, b)):
                break
            seen.add(a)
            novel.append((a, b))

    ends = _sensitive_ends(data.lower())
    stops = [m.start() for m in STATEMENT_END.finditer(data)] if ends else []
    for m in TOKEN.finditer(data) if ends else ():
        a, b = m.span()
        while b > a and data[b - 1] == 46:  # the end of a sentence
            b -= 1
        if b - a < LEAST["assign"]:
            continue
        # the string, if a sensitive word comes closely before it, else what follows the last such word inside of it
        k, last = bisect_right(ends, a) - 1, bisect_right(ends, b - LEAST["assign"]) - 1
        stop = bisect_right(stops, a) - 1
        near = k >= 0 and (ends[k] >= a - REACH or stop < 0 or ends[k] > stops[stop])
        for a in ([a] if near else []) + ([ends[last]] if last > k else []):
            if a in seen:
                break
            seen.add(a)
            if inside(a, b):
                follow(b)
                break
            if _random(data, a, b):
                novel.append((a, b))
                follow(b)
                break
    end = -1
    for a, b in sorted(novel, key=lambda x: (x[0], -x[1])):
        if a >= end and not inside(a, b):
            found.append((a, 3, b))
            end = b
    found.sort()
    if len(data) == len(text):
        return [(KINDS[k], a, b) for a, k, b in found]
    places, chars, at = {}, 0, 0
    for i in sorted({x for a, _, b in found for x in (a, b)}):
        chars += len(data[at:i].decode())
        places[i], at = chars, i
    return [(KINDS[k], places[a], places[b]) for a, k, b in found]


def _sensitive_ends(low: bytes) -> list[int]:
    """Where sensitive words end, in order; masks are none."""
    low = low.replace(MASK, b" " * len(MASK))
    ends = []
    for word in SENSITIVE:
        at = low.find(word)
        while at >= 0:
            ends.append(at + len(word))
            at = low.find(word, at + 1)
    return sorted(ends)


class _Cover:
    """Tells whether one of some spans holds another span whole."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.reach[k - 1] >= b


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans`` array<struct<kind, start, end>> of every text."""
    schema = StructType([*(docs.schema[k] for k in keep), StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "__text"):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t)] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, kind)], schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


def masked(text: str | None, mask: str = MASK.decode()) -> str | None:
    """The text with every secret (overlapping ones as one) replaced."""
    out, at = [], 0
    for _, a, b in spans_of(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return text if not out else "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in the texts; n_chars follows."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
