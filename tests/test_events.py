import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from actiongrid.domain import EVENT_COLUMNS, WINDOWS
from actiongrid.operators.events import event_table, merge_windows, run_counters

SEC = 1_000_000


def greedy(rows, threshold, gap, shortest):
    """Direct restatement of the merge rule for one video."""
    usable = [r for r in rows if r[4] != "background" and r[5] >= threshold and r[3] > r[2]]
    usable.sort(key=lambda r: (r[2], r[3], r[1]))
    open_events = []
    for _, _, start, end, action, conf in usable:
        last = open_events[-1] if open_events else None
        if last and last[2] == action and start <= last[1] + gap:
            last[1] = max(last[1], end)
            last[3] += conf
            last[4] += 1
        else:
            open_events.append([start, end, action, conf, 1])
    return [tuple(e) for e in open_events if e[1] - e[0] >= shortest]


def merged(spark, rows, **kw):
    out = merge_windows(spark.createDataFrame(rows, WINDOWS), **kw).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.video_id, r.event_no)):
        found.setdefault(r.video_id, []).append(
            (r.event_no, (r.start_us, r.end_us, r.action, r.conf_sum, r.n_windows))
        )
    return found


def test_merge_and_publish(spark):
    rows = [
        ("v", 0, 0, SEC, "background", 990_000),
        ("v", 1, SEC, 2 * SEC, "serve", 800_000),
        ("v", 2, SEC * 3 // 2, SEC * 5 // 2, "serve", 600_000),
        ("v", 3, 3 * SEC, 4 * SEC, "attack", 400_000),
    ]
    df = spark.createDataFrame(rows, WINDOWS)
    events = merge_windows(df, confidence_threshold=0.5, merge_gap_seconds=0.1)
    table = event_table(events, model_version="m1")
    assert tuple(table.columns) == EVENT_COLUMNS
    (row,) = table.collect()
    assert (row.event_id, row.start_ms, row.end_ms, row.confidence) == ("evt_000001", 1000, 2500, 0.7)
    assert (row.action, row.status, row.source, row.team_side) == (
        "serve", "predicted", "sliding_window", None,
    )
    (count,) = run_counters(df, events).collect()
    assert (count.window_count, count.event_count) == (4, 1)


def test_other_action_splits(spark):
    rows = [
        ("v", 0, 0, SEC, "serve", 900_000),
        ("v", 1, SEC // 2, SEC, "receive", 900_000),
        ("v", 2, SEC * 3 // 4, 2 * SEC, "serve", 900_000),
    ]
    assert [e[1][2] for e in merged(spark, rows)["v"]] == ["serve", "receive", "serve"]


def random_rows(seed, videos=6, n=60):
    rng = random.Random(seed)
    rows = []
    for v in range(videos):
        for i in range(rng.randrange(1, n)):
            start = rng.randrange(0, 40) * 100_000
            length = rng.choice([0, 100_000, 200_000, 500_000, 3_000_000])
            rows.append((
                f"v{v}", i, start, start + length,
                rng.choice(["serve", "set", "set", "background"]), rng.randrange(0, 10) * 100_000,
            ))
    return rows


@pytest.mark.parametrize("max_rows", [4_000_000, 12, 3])
def test_equals_greedy_also_in_chunks(spark, max_rows):
    rows = random_rows(7) + [("hot", i, 100_000 * (i // 3), 100_000 * (i // 3) + 150_000 * (1 + i % 4),
                              "serve" if i % 17 else "dig", 700_000) for i in range(150)]
    got = merged(spark, rows, confidence_threshold=0.3, merge_gap_seconds=0.1,
                 min_event_seconds=0.2, max_rows=max_rows)
    for video in {r[0] for r in rows}:
        want = greedy([r for r in rows if r[0] == video], 300_000, 100_000, 200_000)
        assert got.get(video, []) == list(enumerate(want, start=1))


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), max_rows=st.sampled_from([2, 5, 1000]))
def test_property(spark, seed, max_rows):
    rows = random_rows(seed, videos=3, n=25)
    got = merged(spark, rows, confidence_threshold=0.2, merge_gap_seconds=0.1,
                 min_event_seconds=0.1, max_rows=max_rows)
    for video in {r[0] for r in rows}:
        want = greedy([r for r in rows if r[0] == video], 200_000, 100_000, 100_000)
        assert got.get(video, []) == list(enumerate(want, start=1))


def test_guards(spark):
    df = spark.createDataFrame([], WINDOWS)
    with pytest.raises(ValueError):
        merge_windows(df, confidence_threshold=1.5)
    with pytest.raises(ValueError):
        merge_windows(df, merge_gap_seconds=-1)
    assert merge_windows(df).count() == 0
