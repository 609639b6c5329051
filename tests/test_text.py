import pytest
from pyspark.sql import functions as F

from actiongrid.domain import COMPATIBLE_LABELS
from actiongrid.functions import text as T
from actiongrid.functions.labels import normalize_external
from actiongrid.functions.numbers import half_even_div, rounded_ratio, seconds_to_us
from actiongrid.operators import metrics as M
from actiongrid.plans.guards import output_apart_from_inputs


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expression("v").alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    texts = ["1", " 3 ", "1_0", "1e3", ".5", "5.", "-inf", "NaN", "1d", "", None, "0x1", "1__0"]
    got = apply(spark, texts, T.float_value)
    assert got[:7] == [1.0, 3.0, 10.0, 1000.0, 0.5, 5.0, float("-inf")]
    assert got[7] != got[7] and got[8:] == [None] * 5
    assert apply(spark, ["7", "+7", "7.0", " 1_0 ", ""], T.int_value) == [7, 7, None, 10, None]
    assert apply(spark, [1.5, float("nan"), 1e300, None], seconds_to_us, "double") == [1_500_000, None, None, None]
    halves = [5, 15, 25, 26, 14]
    assert apply(spark, halves, lambda c: half_even_div(c, 10), "long") == [round(x / 10) for x in halves]
    thirds = [0, 1, 2, 100, None]
    assert apply(spark, thirds, lambda c: rounded_ratio(c, F.lit(3), 6), "long") == [0.0, 0.333333, 0.666667, 33.333333, None]
    assert apply(spark, [1, 3], lambda c: rounded_ratio(c, F.lit(8), 2), "long") == [0.12, 0.38]
    assert apply(spark, [1], lambda c: rounded_ratio(c, F.lit(0), 2), "long") == [None]


def test_clock_and_seconds(spark):
    def clock(s):
        c = round(s * 100)
        return f"{c // 360000:02d}:{c // 6000 % 60:02d}:{c // 100 % 60:02d}.{c % 100:02d}"

    values = [0.0, 0.005, 0.015, 59.995, 3659.4, 7687.333333, 400000.25]
    assert apply(spark, values, T.timecode, "double") == [clock(v) for v in values]
    assert apply(spark, values, T.seconds_text, "double") == [f"{v:.10f}".rstrip("0").rstrip(".") for v in values]
    assert apply(spark, [3_659_400_000, 10_000_000, 1], T.seconds_text_us, "long") == ["3659.4", "10", "0.000001"]
    assert apply(spark, [61.5, None], T.caption, "double") == ["01:01.50", None]


def test_texts(spark):
    notes = ["x; Reviewer note: a; REVIEWER NOTE: b\n", "none", "reviewer note:", "long " * 20_000]
    assert apply(spark, notes, T.reviewer_note) == ["b", "", "", ""]
    crops = ["1,2,3,4", " 1 , 2,3,4", "1,2,3", "3,2,1,4", "1,2,x,4", "-1,2,3,4", "", "1,2,3,4,5"]
    assert apply(spark, crops, lambda c: T.crop_text(T.parse_crop(c))) == ["1,2,3,4", "1,2,3,4"] + [""] * 6
    assert apply(spark, ["1, 2.5,", "1,-2", "", "a"], T.parse_times) == [[1.0, 2.5], None, None, None]
    paths = ["a/../b.mp4", "/x//y/./z", "../../up", "plain.mp4", "d/"]
    assert apply(spark, paths, lambda c: T.resolve_path(c, "/r/s")) == ["/r/s/b.mp4", "/x/y/z", "/up", "/r/s/plain.mp4", "/r/s/d"]
    assert apply(spark, ["/a/b.c.mp4", ".hidden", "plain"], T.file_stem) == ["b.c", ".hidden", "plain"]
    assert apply(spark, ["=1", "@x", "ok", "-"], T.formula_guard) == ["'=1", "'@x", "ok", "'-"]
    assert apply(spark, [" Spike", "ball", "SET\t", "x", None], normalize_external) == ["attack", None, "set", None, None]


def test_output_guard():
    for bad in ("/a/b", "/a/./b", "file:/a/b", "/a"):
        with pytest.raises(ValueError):
            output_apart_from_inputs(bad, ["/a/b"])
    output_apart_from_inputs("/a/c", ["/a/b"])


# Two published count matrices (rows: truth) and their published scores.
PUBLISHED = [
    ([[37, 0, 0, 1, 0, 1], [7, 2, 0, 0, 0, 0], [3, 0, 2, 0, 2, 1], [2, 0, 1, 1, 0, 0], [1, 1, 0, 1, 0, 0], [3, 0, 0, 3, 0, 4]],
     0.630137, 0.366886),
    ([[37, 0, 0, 1, 0, 1], [7, 2, 0, 0, 0, 0], [2, 0, 2, 0, 2, 1], [1, 0, 1, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 0, 4, 0, 5]],
     0.676471, 0.368151),
]


@pytest.mark.parametrize("cells,accuracy,macro_f1", PUBLISHED)
def test_published_scores(spark, cells, accuracy, macro_f1):
    flat = [(t, p, n) for t, row in enumerate(cells) for p, n in enumerate(row) if n]
    rows = spark.createDataFrame(flat, "target int, prediction int, n int").select(
        "target", "prediction", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    doc = M.metrics_document(M.confusion(rows, COMPATIBLE_LABELS), COMPATIBLE_LABELS)
    assert (doc["accuracy"], doc["macro_f1"]) == (accuracy, macro_f1)
    assert doc["confusion_matrix"]["values"] == cells
