"""Every query against its SQL twin on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_all_queries(spark):
    from workload import load
    from workload.check import compare, connection

    queries, oracles = load()
    assert set(oracles) <= set(queries)
    con = connection(FOLDER)
    # slow to start and covered by their own tests
    names = [n for n in queries if not n.startswith(("stream_", "train_")) and n != "published_version"]

    def one(name):
        try:
            return name, compare(spark, con.cursor(), name, queries[name], oracles.get(name), FOLDER)[0]
        except Exception as error:  # noqa: BLE001
            return name, repr(error)[:500]

    with ThreadPoolExecutor(6) as pool:
        problems = {n: p for n, p in pool.map(one, names) if p}
    assert not problems


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", ["merge_events_hot_videos", "number_conflicts_hot_videos", "track_relink_hot_players"])
def test_hot_queries_cross_their_threshold(spark, monkeypatch, name):
    from actiongrid.plans import ordered
    from workload import load

    stored, true = [], ordered.durable
    monkeypatch.setattr(ordered, "durable", lambda df: stored.append(1) or true(df))
    load()[0][name](spark, FOLDER)
    assert len(stored) >= 2
