"""Action statistics with their evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, set_hash
from ..functions.numbers import ratio
from ..functions.text import optional_text
from ..plans.intervals import cover
from ..plans.sweep import sweep_pairs

UNKNOWN = "Unknown"


def known_player(column: str = "player_number") -> Column:
    return F.coalesce(optional_text(F.col(column).cast("string")), F.lit(UNKNOWN))


def action_counts(events: DataFrame, *, player: str = "player_number") -> DataFrame:
    """Counts per player and action with an explicit bucket for unknown players."""
    return events.groupBy(known_player(player).alias("player"), "action").agg(F.count(F.lit(1)).alias("n"))


def action_rollup(events: DataFrame, *, player: str = "player_number") -> DataFrame:
    """Player x action, player totals, action totals and the grand total in one pass.
    level: 0 cell, 1 player total, 2 action total, 3 grand total."""
    cells = action_counts(events, player=player)
    return cells.cube("player", "action").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n")
    )


def attribution(events: DataFrame, *, team: str = "team", player: str = "player_number") -> DataFrame:
    """Team totals beside what is attributed to players."""
    return events.groupBy(team).agg(
        F.count(F.lit(1)).alias("team_total"),
        F.count_if(known_player(player) != UNKNOWN).alias("attributed"),
        F.count_if(known_player(player) == UNKNOWN).alias("unattributed"),
    )


def ratio_stats(events: DataFrame, groups: Sequence[str], definitions: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Ratios as numerator, denominator and value (null for denominator 0), long form.
    A definition is (numerator condition, denominator condition)."""
    counts = []
    for name, (num, den) in definitions.items():
        counts += [F.count_if(num & den).alias(f"{name}__n"), F.count_if(den).alias(f"{name}__d")]
    wide = events.groupBy(*groups).agg(*counts)
    items = F.array(*[
        F.struct(F.lit(n).alias("stat"), F.col(f"{n}__n").alias("numerator"), F.col(f"{n}__d").alias("denominator"))
        for n in definitions
    ])
    return wide.select(*groups, F.inline(items)).withColumn("value", ratio("numerator", "denominator", None))


def stat_evidence(events: DataFrame, groups: Sequence[str], definitions: Mapping[str, tuple[Column, Column]], *, id_col: str = "event_id") -> DataFrame:
    """The events behind each ratio, one row per event and statistic: the evidence stays a
    table, whatever its size."""
    items = F.array(*[
        F.when(den, F.struct(F.lit(n).alias("stat"), F.coalesce(num, F.lit(False)).alias("counted")))
        for n, (num, den) in definitions.items()
    ])
    return events.select(*groups, id_col, F.inline(F.filter(items, lambda x: x.isNotNull())))


def set_points(rallies: DataFrame, sets: DataFrame, *, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Points per set and winning side; a rally belongs to the one set that contains it."""
    placed = cover(rallies, sets, keys, id_col="rally_id", cover_id="set_id")
    return placed.groupBy(*keys, F.col("cover_id").alias("set_id"), "winner").agg(F.count(F.lit(1)).alias("points"))


def playing_time(stints: DataFrame, sets: DataFrame, *, keys: Sequence[str] = ("video_id",), **kw) -> DataFrame:
    """On-court time per player and set: stints clipped to the sets."""
    clipped = sweep_pairs(stints, sets, keys, left_id="stint_id", right_id="set_id", **kw)
    players = stints.select("stint_id", "player")
    return clipped.join(players, "stint_id").groupBy(*keys, "set_id", "player").agg(
        F.sum("overlap_us").alias("played_us"), F.count(F.lit(1)).alias("stints")
    )


def confirmed_only(rows: DataFrame) -> DataFrame:
    """Only confirmed identities count as facts."""
    return rows.where(F.col("identity_status") == "confirmed")


def snapshot(revisions: DataFrame, groups: Sequence[str], *, version: str, hash_columns: Sequence[str]) -> DataFrame:
    """A statistics snapshot: counts per group, the hash of the exact revisions used (of each
    group, and of the snapshot as a whole), and the version it is stored under. Recomputing
    over the same revisions gives the same rows."""
    hashed = revisions.withColumn("__h", content_hash(hash_columns))
    whole = set_hash(hashed, "__h", out="snapshot_sha256").select("snapshot_sha256")
    found = set_hash(hashed, "__h", groups, count="n", out="revision_set_sha256")
    return found.join(F.broadcast(whole), F.lit(True)).withColumn("snapshot", F.lit(version))  # one row by construction


def supersede(old: DataFrame, new: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Old snapshot rows with their state against a rebuild: current, superseded or gone."""
    fresh = new.select(*groups, F.col("revision_set_sha256").alias("__new"))
    return old.join(fresh, list(groups), "left").withColumn(
        "state",
        F.when(F.col("__new").isNull(), "gone")
        .when(F.col("__new") == F.col("revision_set_sha256"), "current").otherwise("superseded"),
    ).drop("__new")


def metric_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric: ids, metric, value."""
    return wide.unpivot(list(ids), list(metrics), "metric", "value")
