"""Files in pieces against json and hashlib."""

import hashlib
import json
import random

import pytest

from veldra.sources import files


def cut(data, r):
    at = 0
    while at < len(data):
        n = r.choice([1, 2, 3, 7, 50])
        yield data[at : at + n]
        at += n


def value(r, depth=0):
    kind = r.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(r.choice('a"\\[]{},é\n日 ') for _ in range(r.randrange(6)))
    if kind < 4:
        return r.choice([None, True, -1.5e9, 12, "", "\\"])
    return [value(r, depth + 1) for _ in range(r.randrange(4))] if kind < 6 else {f"{k}]": value(r, depth + 1) for k in range(r.randrange(4))}


def test_elements():
    r = random.Random(1)
    for _ in range(400):
        v = [value(r) for _ in range(r.randrange(6))]
        data = json.dumps(v, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])).encode() + r.choice([b"", b" \n"])
        got = list(files.elements(cut(data, r)))
        assert [json.loads(x) for x in got] == v
    for bad, before in [(b"", []), (b"  ", []), (b"{}", []), (b'{"a": [1]}', []), (b"[1, 2", ["1"]), (b"[1,,2]", ["1"]), (b"[1,]", ["1"]), (b"[1] x", ["1"]), (b"x[1]", []), (b"[1}", []), (b'["a', []), (b'["\xff"]', []), (b"5", [])]:
        assert list(files.elements(cut(bad, r))) == [*before, None], bad
    assert list(files.elements(iter([b"\xef\xbb\xbf [ ]"]))) == []


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    r = random.Random(2)
    values = {"a.json": [value(r) for _ in range(2500)], "deep/b.json": [], "c.json": [{"x": "é" * 3_000_000}, 1]}
    for n, v in values.items():
        (tmp_path / "in" / n).write_text(json.dumps(v))
    (tmp_path / "in" / "bad.json").write_text("[1, 2")
    (tmp_path / "in" / "_hidden").write_text("no")
    got = files.json_elements(spark, str(tmp_path / "in")).collect()
    for n, v in values.items():
        rows = sorted((x.place, x.value) for x in got if x.file.endswith(n))
        assert [p for p, _ in rows] == list(range(len(v))) and [json.loads(x) for _, x in rows] == v
    assert sorted(((x.place, x.value) for x in got if x.file.endswith("bad.json")), key=str) == [(0, "1"), (None, None)]
    sums = {x.path.rsplit("/in/")[1]: (x.length, x.sha256) for x in files.file_digests(spark, f"file://{tmp_path}/in").collect()}
    for n in [*values, "bad.json"]:
        data = (tmp_path / "in" / n).read_bytes()
        assert sums.pop(n) == (len(data), hashlib.sha256(data).hexdigest())
    assert not sums
    with pytest.raises(Exception, match="none"):
        files.file_digests(spark, str(tmp_path / "none")).collect()
    (tmp_path / "empty").mkdir()
    assert not files.json_elements(spark, str(tmp_path / "empty")).collect()
