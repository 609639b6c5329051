"""Files read by byte ranges against the standard library, for ranges of any size."""

import csv
import hashlib
import io
import json
import random

import pytest

from actiongrid.domain import ReviewError
from actiongrid.sources import documents as D
from actiongrid.sources import manifest_csv as C
from actiongrid.sources.media import PIECE_BYTES, digest, fingerprints
from actiongrid.sources.ranges import Range, cut_into_ranges

CELLS = ["", "a", '"x"', '"a,b"', '"l1\nl2"', '"l1\r\nl2"', '"say ""hi"""', '""', 'mid"quote', '"tail"x', " ", "é", '"\n\n"', '""""', "😀", '","']


def csv_rows(ranges, seen):
    """All rows of one file, range by range, composed as `planned` composes."""
    inside, out = False, []
    for one in ranges:
        found = next(iter(C.summarise(one))).to_pylist()[0]
        state = {"inside": inside, "index": len(out) + 1, "header": seen, "names": seen, "place": "record_index"}
        rows = [r for batch in C.parse(one._replace(state=state)) for r in batch.to_pylist()]
        assert len(rows) == found["records"][inside] - (one.start == 0)
        out += rows
        inside = found["ends_inside"][inside]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_csv_ranges(tmp_path, seed):
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n", "\r"])
    lines = [",".join(rng.choices(CELLS, k=rng.randint(1, 5))) for _ in range(60)]
    lines = [line for line in lines if line] + [""] * 3
    rng.shuffle(lines)
    text = "﻿" * (seed % 2) + "p,q,r" + end + end.join(lines) + (end if seed % 3 else "")
    path = tmp_path / "m.csv"
    path.write_bytes(text.encode())
    plain = text.removeprefix("﻿").replace("\r\n", "\n")
    expect = [row for row in csv.reader(io.StringIO(plain, newline="")) if row][1:]
    expect = [tuple((row[i] or None) if i < len(row) else None for i in range(3)) + (len(row) > 3,) for row in expect]
    for size in (9, 13, 50, 10_000):
        rows = csv_rows(cut_into_ranges([(str(path), len(text.encode()))], size), ["p", "q", "r"])
        assert [(r["p"], r["q"], r["r"], r["extra_cells"]) for r in rows] == expect
        assert [r["record_index"] for r in rows] == list(range(1, len(expect) + 1))


def test_scan_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('p,q\n1,"x\ny"\n2,\n')
    (tmp_path / "b.csv").write_text('q,p,r\nb,3,c\n\n4\n')
    rows = C.scan_manifest(spark, str(tmp_path / "*.csv"), range_bytes=8).orderBy("record_index").collect()
    assert [(r.record_index, r.p, r.q, r.r, r.extra_cells) for r in rows] == [
        (1, "1", "x\ny", None, False), (2, "2", None, None, False), (3, "3", "b", "c", False), (4, None, "4", None, False)]
    assert C.header_names(spark, str(tmp_path / "*.csv")) == ["p", "q", "r"]


VALUES = [1, -2.5, True, None, "", 'a"b', "back\\", "\\\\\"", "[,]", "{\"x\": [1,2]}", "é😀\n", [], {}, [1, [2, "]"]], {"a": {"b": [",", 1]}}]


@pytest.mark.parametrize("seed", range(5))
def test_document_ranges(spark, tmp_path, seed):
    rng = random.Random(seed)
    many = [rng.choice(VALUES) for _ in range(rng.choice([0, 1, 30]))]
    doc = {"format_version": 1, "note": "a \"[1,2]\" \\", "small": {"x": [1, 2], "y": {}}, "many": many, "few": [rng.choice(VALUES)], "end": None}
    keys = list(doc)
    rng.shuffle(keys)
    doc = {k: doc[k] for k in keys}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=rng.choice([None, 2]), ensure_ascii=bool(seed % 2)), encoding="utf-8")
    for size in (7, 61, 100_000):
        found = D.Document(spark, str(path), size)
        assert {k: v for k, v in found.fields.items() if not isinstance(v, (list, dict))} == {k: v for k, v in doc.items() if not isinstance(v, (list, dict))}
        assert list(found.fields) == keys and found.kind("small") == "object" and found.kind("gone") == "absent"
        for name in ("many", "few"):
            rows = found.items(name).orderBy("position").collect()
            assert [(r.position, json.loads(r.item)) for r in rows] == list(enumerate(doc[name], 1))


@pytest.mark.parametrize("text", ["[1]", "", "{", '{"a": [1}', '{"a": 1} x', "3", '{"requests": ["x]}'])
def test_no_document(spark, tmp_path, text):
    path = tmp_path / "doc.json"
    path.write_text(text)
    with pytest.raises(ReviewError) as caught:
        D.Document(spark, str(path), 5)
    assert caught.value.code == "document"


def test_broken_item(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text('{"format_version": 1, "manifest": "m", "target_team": "t", "requests": [{"record_index": 1}, {"record_index" 2}]}')
    with pytest.raises(ReviewError) as caught:
        D.read_spec(spark, str(path), 20)
    assert caught.value.code == "document"


def test_fingerprints(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"f{i}.bin").write_bytes(bytes([i]) * i * 100)
    got = {r.video_id: (r.length, r.sha256) for r in fingerprints(spark, str(tmp_path), 200).collect()}
    assert got == {f"f{i}": (i * 100, hashlib.sha256(bytes([i]) * i * 100).hexdigest()) for i in range(9)}


def test_file_above_two_gigabytes(tmp_path, monkeypatch):
    """A sparse file is hashed with no more than one piece of it in memory."""
    from actiongrid.sources import media

    size, sizes = (2 << 30) + 5, []
    path = tmp_path / "large.bin"
    with open(path, "wb") as file:
        file.truncate(size)

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            sizes.append(n)
            return self.file.read(n)

    true = media.open_file
    monkeypatch.setattr(media, "open_file", lambda p: Watched(true(p)))
    (row,) = next(iter(digest(Range(str(path), size, 0, size)))).to_pylist()
    expect = hashlib.sha256()
    for _ in range(2 << 4):
        expect.update(bytes(64 << 20))
    expect.update(bytes(5))
    assert (row["length"], row["sha256"]) == (size, expect.hexdigest())
    assert max(sizes) == PIECE_BYTES <= 64 << 20


def test_small_ranges_neither_multiply_nor_make_tasks(spark, tmp_path):
    """Ranges grow with a listing and share tasks: the driver holds a row of each range."""
    assert len(cut_into_ranges([("x", 1 << 30)], 1 << 16)) <= 2049
    assert len(cut_into_ranges([("x", 1 << 34)], 1 << 16)) == 1 << 12  # 4 MB at most
    path = tmp_path / "a.csv"
    path.write_text("p,q\n" + "".join(f'{i},"x{i}\n"\n' for i in range(20_000)))
    found = C.scan_manifest(spark, str(path), range_bytes=1 << 10)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
    assert found.where("q <> concat('x', p, '\n') or p <> record_index - 1").isEmpty() and found.count() == 20_000
