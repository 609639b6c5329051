import os
import re

import pytest

from actiongrid.domain import ManifestError, ReviewError
from actiongrid.operators import manifest as M
from actiongrid.sources.manifest_csv import require_no_extra_cells, scan_manifest
from actiongrid.sources.media import file_listing, fingerprints, media_table
from actiongrid.sources.synthetic import synthetic_manifest

HEAD = "video_path,start_seconds,end_seconds,label,split"


def write(tmp_path, text, name="m.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def load(spark, tmp_path, text, **kw):
    return M.load_manifest(spark, write(tmp_path, text), video_root="/media", **kw)


def code(spark, tmp_path, text, **kw):
    with pytest.raises(ManifestError) as caught:
        load(spark, tmp_path, text, **kw)
    return caught.value.code, caught.value.position


def test_load_and_summary(spark, tmp_path):
    df = load(spark, tmp_path, f"\ufeff{HEAD},notes\r\na.mp4,0,1.5,serve,train,\"x\r\ny\"\r\n\r\nsub/../b.mp4, 2 ,3,dig,VAL,\r\n")
    rows = df.orderBy("record_index").collect()
    assert [(r.record_index, r.video_path, r.split, r.start_us, r.notes) for r in rows] == [
        (1, "/media/a.mp4", "train", 0, "x\ny"), (2, "/media/b.mp4", "val", 2_000_000, None)]
    doc = M.summary_document(M.manifest_summary(df))
    assert doc == {"records": 2, "videos": 2, "duration_seconds": 2.5,
                   "records_by_split": {"train": 1, "val": 1}, "videos_by_split": {"test": 0, "train": 1, "val": 1},
                   "records_by_label": {"dig": 1, "serve": 1}}


@pytest.mark.parametrize("row,expected", [
    ("a.mp4,x,1,serve,train", "bad_time"), ("a.mp4,,1,serve,train", "bad_time"),
    (" ,0,1,serve,train", "empty_path"), ("a.mp4,0,1,spike,train", "unknown_label"),
    ("a.mp4,0,1,Serve,train", "unknown_label"), ("a.mp4,0,1,serve,dev", "bad_split"),
    ("a.mp4,nan,1,serve,train", "not_finite"), ("a.mp4,0,inf,serve,train", "not_finite"),
    ("a.mp4,-inf,1,serve,train", "not_finite"), ("a.mp4,2,1,serve,train", "bad_order"),
    ("a.mp4,-1,1,serve,train", "bad_order"), ("a.mp4,1,1,serve,train", "bad_order"),
])
def test_row_rules(spark, tmp_path, row, expected):
    assert code(spark, tmp_path, f"{HEAD}\nok.mp4,0,1,set,val\n{row}\n") == (expected, 3)


def test_crops_and_report(spark, tmp_path):
    head = HEAD + ",crop_x1,crop_y1,crop_x2,crop_y2"
    text = f"{head}\n" + "\n".join(
        f"a.mp4,0,1,set,val,{c}" for c in ("1,2,3,4", ",,,", "1,2,3,", "1,2,x,4", "3,2,1,4", "-1,2,3,4")) + "\n"
    path = write(tmp_path, text)
    checked = M.check_manifest(scan_manifest(spark, path))
    rows = checked.orderBy("record_index").collect()
    assert tuple(rows[0].crop) == (1, 2, 3, 4) and rows[1].crop is None
    assert [[e.code for e in r.errors] for r in rows] == [
        [], [], ["crop_incomplete"], ["crop_not_integer"], ["crop_invalid"], ["crop_invalid"]]
    assert M.first_error(checked).first().code == "crop_incomplete"
    capped = M.capped_report(checked, 2).collect()
    assert len(capped) == 2 and {r.total_errors for r in capped} == {4}


def test_dataset_rules(spark, tmp_path):
    assert code(spark, tmp_path, f"{HEAD}\n")[0] == "empty"
    assert code(spark, tmp_path, "video_path,label\na,serve\n")[0] == "missing_columns"
    with pytest.raises(ManifestError, match="a.mp4: train, val"):
        load(spark, tmp_path, f"{HEAD}\na.mp4,0,1,set,train\n./a.mp4,1,2,set,val\n")


def test_files_exist(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.mp4").write_bytes(b"abc")
    listing = file_listing(spark, str(tmp_path / "v"))
    path = write(tmp_path, f"{HEAD}\na.mp4,0,1,set,train\nb.mp4,0,1,set,train\n")
    checked = M.check_manifest(scan_manifest(spark, path), video_root=str(tmp_path / "v"), existing=listing)
    assert M.first_error(checked).first().asDict()["record_index"] == 2
    print_ = fingerprints(spark, str(tmp_path / "v")).first()
    assert print_.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert print_.video_id == "a"


def test_extra_and_short_cells(spark, tmp_path):
    path = write(tmp_path, f'{HEAD}\na.mp4,0,1,set\n"a,b.mp4",0,1,set,train\na.mp4,0,1,set,train,"x,\n1"\n')
    rows = scan_manifest(spark, path)
    assert [(r.record_index, r.extra_cells) for r in rows.orderBy("record_index").collect()] == [
        (1, False), (2, False), (3, True)]
    with pytest.raises(ReviewError) as caught:
        require_no_extra_cells(rows)
    assert caught.value.position == 4


def test_media_rules(spark, tmp_path):
    facts = spark.createDataFrame([("/m/a", 10.0, 100, 640, 360), ("/m/b", 0.0, 1, 1, 1)],
                                  "video_path string, fps double, frame_count long, width int, height int")
    media = media_table(facts)
    assert [r.duration_seconds for r in media.collect()] == [10.0]
    with pytest.raises(ValueError):
        media_table(facts, strict=True)
    checked = M.check_manifest(spark.createDataFrame(
        [(1, "a", "9", "10.1", "set", "train", "0", "0", "640", "360"), (2, "a", "9", "10.2", "set", "train", "0", "0", "641", "360"),
         (3, "c", "0", "1", "set", "train", None, None, None, None)],
        "record_index long, video_path string, start_seconds string, end_seconds string, label string, split string, "
        "crop_x1 string, crop_y1 string, crop_x2 string, crop_y2 string"), video_root="/m")
    assert [r.record_index for r in M.bounds_violations(checked, media).collect()] == [2]
    assert [r.record_index for r in M.crop_violations(checked, media).collect()] == [2]
    assert [r.record_index for r in M.without_media(checked, media).collect()] == [3]


def test_publish(spark, tmp_path):
    rows = synthetic_manifest(spark, 3)
    M.require_train_and_val(M.require_valid(M.check_manifest(rows)))
    columns = [c for c in rows.columns if c != "record_index"]
    out = str(tmp_path / "v2")
    doc = M.publish_manifest(rows, columns, out)
    assert doc["records"] == 21 and doc["videos_by_split"] == {"test": 0, "train": 2, "val": 1}
    bad = rows.withColumn("label", rows.split)
    with pytest.raises(ManifestError):
        M.publish_manifest(bad, columns, str(tmp_path / "v3"))
    assert not os.path.exists(tmp_path / "v3")
    with pytest.raises(ValueError):
        M.publish_manifest(rows, columns, out, inputs=[out])


def test_failed_read_back_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = synthetic_manifest(spark, 2)
    columns = [c for c in rows.columns if c != "record_index"]
    true, calls = M.require_valid, []

    def fails_on_the_second(checked, **kw):
        calls.append(1)
        if len(calls) > 1:
            raise ManifestError("broken", "read back differs")
        return true(checked, **kw)

    monkeypatch.setattr(M, "require_valid", fails_on_the_second)
    with pytest.raises(ManifestError):
        M.publish_manifest(rows, columns, str(tmp_path / "v"))
    assert os.listdir(tmp_path) == []


def test_whole_leakage_is_named(spark):
    rows = spark.createDataFrame([(2 * i + j, f"v{i:03}.mp4", "0", "1", "set", s) for i in range(30) for j, s in enumerate(("train", "val"))],
                                 "record_index long, video_path string, start_seconds string, end_seconds string, label string, split string")
    with pytest.raises(ManifestError) as caught:
        M.require_valid(M.check_manifest(rows), shown=2)
    path = re.search(r"all 30 lines: (.*)\)", str(caught.value))[1]
    assert spark.read.text(path).count() == 30
