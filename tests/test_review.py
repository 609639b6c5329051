import json
import os

import pytest
from pyspark.sql import functions as F

from actiongrid.domain import REVIEW_QUEUE_COLUMNS, ManifestError, ReviewError
from actiongrid.operators import review as R
from actiongrid.sources.documents import read_results, read_spec
from actiongrid.sources.manifest_csv import require_unique_index, scan_manifest

MANIFEST = (
    "video_path,start_seconds,end_seconds,label,split,team_side,player_number,crop_x1,crop_y1,crop_x2,crop_y2,notes\n"
    "a.mp4,10.5,11.25,receive,train,near,7,1,2,30,40,first; Reviewer Note: check it \n"
    "a.mp4,20,21,dig,train,far,,,,,,\n"
    "a.mp4,3659.4,3660,serve,train,far,,,,,,\n"
)


def request(index, **kw):
    return {"record_index": index, "reason": " why ", **kw}


def confirmation(index, op, action, start, end, source, note=""):
    keys = ("video_path", "start_seconds", "end_seconds", "action", "split", "team_side", "player_number", "crop", "notes")
    return {"record_index": index, **{f"source_{k}": v for k, v in zip(keys, source)}, "operation": op,
            "confirmed_action": action, "confirmed_start_seconds": start, "confirmed_end_seconds": end,
            "confirmation_note": note}


SOURCE = {
    1: ("a.mp4", 10.5, 11.25, "receive", "train", "near", "7", "1,2,30,40", "first; Reviewer Note: check it"),
    2: ("a.mp4", 20, 21, "dig", "train", "far", "", "", ""),
    3: ("a.mp4", 3659.4, 3660, "serve", "train", "far", "", "", ""),
}
REQUESTS = [request(3, suggested_operation="keep"),
            request(1, suggested_operation="move_window", suggested_action="dig", suggested_start_seconds=10),
            request(2, suggested_operation="add_window")]
CONFIRMATIONS = [
    confirmation(1, "move_window", "dig", 10, 11.125, SOURCE[1], " moved "),
    confirmation(2, "add_window", "set", 22.1, 23, SOURCE[2]),
    confirmation(3, "keep", "serve", 3658, 3660, SOURCE[3]),
]


class Files:
    def __init__(self, folder):
        self.manifest, self.spec, self.results = (str(folder / n) for n in ("m.csv", "s.json", "r.json"))
        self.output = str(folder / "out")
        self.write()

    def write(self, manifest=MANIFEST, requests=REQUESTS, confirmations=CONFIRMATIONS, spec=None, results=None):
        with open(self.manifest, "w") as f:
            f.write(manifest)
        head = {"format_version": 1, "manifest": "x/m.csv", "target_team": " near "}
        with open(self.spec, "w") as f:
            json.dump({**head, "requests": requests, **(spec or {})}, f)
        head = {"format_version": 1, "manifest": "m.csv", "spec": "s.json", "time_precision_seconds": 0.1}
        with open(self.results, "w") as f:
            json.dump({**head, "confirmations": confirmations, **(results or {})}, f)


@pytest.fixture
def files(tmp_path):
    return Files(tmp_path)


def apply(spark, files):
    return R.apply_review(spark, files.manifest, files.spec, files.results, files.output)


def test_queue(spark, files):
    doc = R.prepare_review_queue(spark, files.manifest, files.spec, files.output)
    assert (doc["records"], doc["target_team"]) == (3, "near")
    queue = spark.read.option("header", True).option("escape", '"').csv(files.output)
    assert tuple(queue.columns) == REVIEW_QUEUE_COLUMNS
    rows = queue.toDF(*REVIEW_QUEUE_COLUMNS).collect()
    assert [r.record_index for r in rows] == ["1", "2", "3"]
    one = rows[0].asDict()
    assert one["current_start_time"] == "00:00:10.50" and one["crop"] == "1,2,30,40"
    assert one["reviewer_note"] == "check it" and one["review_reason"] == "why"
    assert one["suggested_start_time"] == "00:00:10.00" and one["suggested_end_time"] is None
    with pytest.raises(ValueError):
        R.prepare_review_queue(spark, files.manifest, files.spec, files.manifest)


def test_apply(spark, files):
    doc = apply(spark, files)
    assert (doc["source_records"], doc["updated_records"], doc["added_records"], doc["output_records"], doc["keep_changed"]) == (3, 2, 1, 4, 1)
    assert doc["records"] == 4 and doc["records_by_label"] == {"dig": 2, "serve": 1, "set": 1}
    rows = scan_manifest(spark, files.output).orderBy("source_file", "record_index").collect()
    assert [(r.start_seconds, r.end_seconds, r.label, r.review_status) for r in rows] == [
        ("10", "11.125", "dig", "reviewed"), ("20", "21", "dig", None),
        ("3658", "3660", "serve", "reviewed"), ("22.1", "23", "set", "reviewed")]
    assert rows[0].notes == (
        "first; Reviewer Note: check it; Second-pass human-reviewed; operation=move_window; "
        "prior=receive@10.5-11.25; confirmed=dig@10-11.125; reviewer note: moved")
    assert rows[3].notes == "Second-pass human-reviewed; added from source record 2; confirmed=set@22.1-23"
    with pytest.raises(Exception):
        apply(spark, files)  # a published version is never replaced


def changed(i, **kw):
    out = [dict(c) for c in CONFIRMATIONS]
    out[i].update(kw)
    return out


@pytest.mark.parametrize("kw,expected", [
    (dict(confirmations=CONFIRMATIONS[:2]), "incomplete"),
    (dict(confirmations=CONFIRMATIONS[::-1]), "order"),
    (dict(confirmations=changed(0, source_start_seconds=10.5000005)), "snapshot"),
    (dict(results={"time_precision_seconds": 0}), "time_precision_seconds"),
    (dict(results={"time_precision_seconds": True}), "time_precision_seconds"),
    (dict(results={"spec": "other.json"}), "binding"),
    (dict(spec={"manifest": "other.csv"}), "binding"),
    (dict(spec={"format_version": 2}), "format_version"),
    (dict(spec={"surplus": 2}), "unknown_fields"),
    (dict(spec={"requests": []}), "requests"),
])
def test_apply_refuses(spark, files, kw, expected):
    files.write(**kw)
    with pytest.raises(ReviewError) as caught:
        apply(spark, files)
    assert caught.value.code == expected


def test_confirmation_rules(spark, files):
    cases = [
        (CONFIRMATIONS[0], None), (CONFIRMATIONS[0], "index_repeated"),
        (changed(0, source_start_seconds=10.5000005)[0], "index_repeated"),
        (changed(1, source_notes="x")[1], "snapshot"), (changed(1, source_crop="1,2,3,4")[1], "index_repeated"),
        (5, "not_object"), (changed(1, extra=1)[1], "unknown_fields"), (changed(1, record_index=True)[1], "index_type"),
        (changed(1, record_index=9)[1], "not_requested"),
    ]
    single = [
        (dict(operation="keep"), "operation_differs"), (dict(operation="drop"), "operation"),
        (dict(confirmed_action="spike"), "action"), (dict(confirmed_end_seconds=1), "time_order"),
        (dict(confirmed_end_seconds=True), "end_time"), (dict(confirmed_start_seconds=-1), "start_time"),
        (dict(confirmation_note=None), "note_type"), (dict(source_end_seconds="20"), "source_time"),
        (dict(source_crop="1,2,3,4"), "snapshot"), (dict(source_video_path=None), "snapshot"), (dict(), None),
    ]
    rows = scan_manifest(spark, files.manifest)
    _, requests = read_spec(spark, files.spec)
    files.write(confirmations=[c for c, _ in cases])
    _, given = read_results(spark, files.results)
    got = R.check_confirmations(given, requests, rows).orderBy("position").collect()
    assert [r.errors[0].code if r.errors else None for r in got] == [code for _, code in cases]
    # one record per case: the manifest repeats its second row
    lines = MANIFEST.splitlines()
    manifest = "\n".join([lines[0]] + [lines[2]] * len(single)) + "\n"
    files.write(
        manifest=manifest, requests=[request(i + 1, suggested_operation="add_window") for i in range(len(single))],
        confirmations=[changed(1, record_index=i + 1, **kw)[1] for i, (kw, _) in enumerate(single)],
    )
    _, requests = read_spec(spark, files.spec)
    _, given = read_results(spark, files.results)
    got = R.check_confirmations(given, requests, scan_manifest(spark, files.manifest)).orderBy("position").collect()
    assert [r.errors[0].code if r.errors else None for r in got] == [code for _, code in single]


def test_request_rules(spark, files):
    cases = [
        (request(2), None), (7, "not_object"), (request(1, foo=1), "unknown_fields"), (request(True), "index_type"),
        (request(1.0), "index_type"), (request(40), "index_range"), (request(0), "index_range"),
        (request(2), "index_repeated"), ({"record_index": 3, "reason": "  "}, "reason"),
        (request(4, suggested_operation="x"), "operation"), (request(5, suggested_operation="keep", suggested_action="x"), "action"),
        (request(6, suggested_action="set"), "operation_missing"), (request(7, suggested_start_seconds=1), "operation_missing"),
        (request(8, suggested_operation="keep", suggested_start_seconds=None), "start_time"),
        (request(9, suggested_operation="keep", suggested_end_seconds=-1), "end_time"),
        (request(10, suggested_operation="keep", suggested_start_seconds=2, suggested_end_seconds=2), "time_order"),
        (request(11, suggested_operation=None, suggested_action=None), None),
    ]
    files.write(requests=[c for c, _ in cases])
    _, requests = read_spec(spark, files.spec)
    checked = R.check_requests(requests, 39)
    got = checked.orderBy("position").collect()
    assert [r.errors[0].code if r.errors else None for r in got] == [code for _, code in cases]
    first = R.first_failure(checked).first()
    assert (first.position, first.code) == (2, "not_object")


def test_extra_cells_and_leak(spark, files):
    files.write(manifest=MANIFEST.replace("a.mp4,20,21,dig,train,far,,,,,,", "a.mp4,20,21,dig,train,far,,,,,,,"))
    with pytest.raises(ReviewError):
        apply(spark, files)
    files.write(manifest=MANIFEST.replace("dig,train", "dig,val"))
    with pytest.raises(ManifestError):
        apply(spark, files)


def test_parts_published_and_reviewed_again(spark, files, tmp_path):
    """A manifest of several files keeps one numbering through review, publication and review."""
    head, *lines = MANIFEST.splitlines(keepends=True)
    os.remove(files.manifest)
    os.mkdir(files.manifest)
    for n, part in enumerate((lines[:1], lines[1:2], lines[2:])):
        with open(f"{files.manifest}/part-0000{n}.csv", "w") as f:
            f.writelines([head, *part])
    queue = R.prepare_review_queue(spark, files.manifest, files.spec, str(tmp_path / "q"))
    assert queue["records"] == 3 and spark.read.option("header", True).csv(str(tmp_path / "q")).count() == 3
    apply(spark, files)
    first = scan_manifest(spark, files.output)
    assert sorted((r.record_index, r.label) for r in first.collect()) == [(1, "dig"), (2, "dig"), (3, "serve"), (4, "set")]
    fourth = first.where("record_index = 4").first()
    again = [confirmation(4, "relabel", "attack", 22.1, 23, ("a.mp4", 22.1, 23, "set", "train", "far", "", "", fourth.notes))]
    with open(files.spec, "w") as f:
        json.dump({"format_version": 1, "manifest": "out", "target_team": "near", "requests": [request(4, suggested_operation="relabel")]}, f)
    with open(files.results, "w") as f:
        json.dump({"format_version": 1, "manifest": "out", "spec": "s.json", "time_precision_seconds": 0.1, "confirmations": again}, f)
    R.apply_review(spark, files.output, files.spec, files.results, str(tmp_path / "next"))
    labels = sorted((r.record_index, r.label) for r in scan_manifest(spark, str(tmp_path / "next")).collect())
    assert labels == [(1, "dig"), (2, "dig"), (3, "serve"), (4, "attack")]


def test_repeated_index_is_refused(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,)], "record_index long")
    with pytest.raises(ReviewError) as caught:
        require_unique_index(rows)
    assert caught.value.code == "index_not_unique"
