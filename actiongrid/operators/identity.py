"""Player identity over tracks: votes, roster checks, conflicts and assignments.

Events are read and never rewritten; candidates stay candidates until confirmed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..plans.intervals import earlier_overlap
from ..plans.sweep import sweep_pairs
from ..plans.ordered import MAX_ROWS, Running, order_by_key


def number_votes(readings: DataFrame) -> DataFrame:
    """Ranked number candidates per track. readings: track_id, number, conf_micro.
    Readings are summed first, so the ranking sees at most one row per number."""
    votes = readings.where("number is not null").groupBy("track_id", "number").agg(
        F.sum("conf_micro").alias("score"), F.count(F.lit(1)).alias("frames")
    )
    by_score = Window.partitionBy("track_id").orderBy(F.desc("score"), "number")
    return votes.withColumn("rank", F.row_number().over(by_score)).withColumn(
        "lead_over_next", F.col("score") - F.coalesce(F.lead("score").over(by_score), F.lit(0))
    )


def restrict_to_roster(candidates: DataFrame, roster: DataFrame, *, keys: Sequence[str] = ("team", "number")) -> DataFrame:
    """Flag candidates that the roster knows; the others go to review."""
    known = roster.select(*keys).distinct().withColumn("__known", F.lit(True))
    return candidates.join(known, list(keys), "left").withColumn(
        "in_roster", F.coalesce("__known", F.lit(False))
    ).drop("__known")


def roster_conflicts(roster: DataFrame, *, keys: Sequence[str] = ("team", "number"), id_col: str = "entry_id", **kw) -> DataFrame:
    """Entries of one team and number whose validity overlaps an earlier entry."""
    return earlier_overlap(roster, keys, id_col=id_col, **kw).where("witness is not null")


def number_conflicts(tracks: DataFrame, *, keys: Sequence[str] = ("video_id", "team", "number"), id_col: str = "track_id", **kw) -> DataFrame:
    """Tracks that carry a number another track of the team carries at the same time."""
    return earlier_overlap(tracks.where("number is not null"), keys, id_col=id_col, **kw).where("witness is not null")


def assign_events(events: DataFrame, tracks: DataFrame, *, keys: Sequence[str] = ("video_id",), **kw) -> DataFrame:
    """Every event with each track it overlaps in time and by how much; events without a
    track stay with null. No single actor is chosen."""
    return sweep_pairs(events, tracks, keys, left_id="event_id", right_id="track_id", how="left", **kw)


def assignment_counts(assigned: DataFrame, *, keys: Sequence[str] = ("video_id", "event_id")) -> DataFrame:
    n = F.count("track_id")
    return assigned.groupBy(*keys).agg(
        n.alias("tracks"), F.coalesce(F.sum("overlap_us"), F.lit(0)).alias("overlap_us"),
        F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("ambiguity"),
    )


def relink_tracks(tracks: DataFrame, *, max_gap_us: int = 1_000_000, keys: Sequence[str] = ("video_id", "player"), max_rows: int = MAX_ROWS) -> DataFrame:
    """Join fragments of one player while gaps stay within `max_gap_us`: adds `gap_us` to
    the furthest end so far, `linked` and `link_no`, the number of the joined track."""
    order = ("start_us", "end_us", "track_id")
    reached = order_by_key(tracks, keys, order, max_rows=max_rows).scan(
        running={"__reach": Running("max", F.col("end_us"), before=True)}
    )
    linked = F.coalesce(F.col("start_us") <= F.col("__reach") + max_gap_us, F.lit(False))
    marked = reached.map(
        lambda d: d.withColumn("gap_us", F.col("start_us") - F.col("__reach")).withColumn("linked", linked)
    )
    return marked.scan(
        running={"link_no": Running("sum", F.when(F.col("linked"), 0).otherwise(1).cast("long"))}
    ).rows().drop("__reach")


def tracking_faults(frames: DataFrame, *, keys: Sequence[str] = ("video_id", "truth_id"), max_rows: int = MAX_ROWS) -> DataFrame:
    """Per true player: frames, identity switches (another track than the last known one)
    and fragments (tracked again after a gap). frames: keys, frame_index, track_id?"""
    seen = order_by_key(frames, keys, ("frame_index",), max_rows=max_rows).scan(
        lag={"__prev": "track_id"},
        running={"__last": Running("last", F.col("track_id"), before=True)},
    ).rows()
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count("track_id").alias("tracked"),
        F.count_if(F.col("track_id") != F.col("__last")).alias("switches"),
        F.count_if(F.col("track_id").isNotNull() & F.col("__prev").isNull() & F.col("__last").isNotNull()).alias("fragments"),
    )


# The cases that must reach a human, in the order they are listed.
GATES = (
    "team_uncertain", "no_clear_winner", "not_in_roster", "relinked", "number_conflict",
    "many_tracks", "segment_boundary", "weak_reading", "no_reading",
)


def review_gates(tracks: DataFrame, *, min_lead: int = 200_000, min_confidence: int = 500_000) -> DataFrame:
    """Tracks with the list of gates they trip.

    Columns used: team, candidates, lead_over_next, in_roster, linked, number_conflict,
    ambiguity, near_boundary, digits, conf_micro, visibility."""
    c = F.col
    tripped = {
        "team_uncertain": F.coalesce(c("team") == "unknown", F.lit(True)),
        "no_clear_winner": (c("candidates") > 1) & (c("lead_over_next") < min_lead),
        "not_in_roster": (c("candidates") > 0) & ~c("in_roster"),
        "relinked": c("linked"),
        "number_conflict": c("number_conflict"),
        "many_tracks": c("ambiguity") == "many",
        "segment_boundary": c("near_boundary"),
        "weak_reading": (c("candidates") > 0) & ((c("digits") == 1) | (c("conf_micro") < min_confidence)),
        "no_reading": (c("candidates") == 0) & c("visibility").isin("occluded", "back_only", "not_visible"),
    }
    items = F.array(*[F.when(F.coalesce(tripped[g], F.lit(False)), F.lit(g)) for g in GATES])
    return tracks.withColumn("gates", F.filter(items, lambda g: g.isNotNull())).withColumn(
        "needs_review", F.size("gates") > 0
    )


def identity_metrics(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Coverage and accuracy side by side; unreadable and unresolved are not wrong.

    rows: readable, truth_number, number, truth_ref, identity_ref, identity_status,
    routed_to_review, truth_team, team."""
    c = F.col
    readable = c("readable") & c("truth_number").isNotNull()
    answered = readable & c("number").isNotNull()
    resolved = c("identity_ref").isNotNull()
    ours, truly = c("team") == "own", c("truth_team") == "own"
    counts = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(readable).alias("readable"),
        F.count_if(answered).alias("answered"),
        F.count_if(answered & (c("number") == c("truth_number"))).alias("number_correct"),
        F.count_if(truly & c("truth_ref").isNotNull()).alias("evaluable"),
        F.count_if(
            truly & (c("identity_ref") == c("truth_ref")) & (c("number") == c("truth_number"))
        ).alias("identity_correct"),
        F.count_if(c("identity_status") == "confirmed").alias("confirmed"),
        F.count_if(c("routed_to_review")).alias("routed"),
        F.count_if(~resolved).alias("unresolved"),
        F.count_if(ours & truly).alias("team_tp"),
        F.count_if(ours & ~truly).alias("team_fp"),
        F.count_if(~ours & truly).alias("team_fn"),
    )
    return (
        counts.withColumn("number_accuracy", ratio("number_correct", "readable", None))
        .withColumn("identity_accuracy", ratio("identity_correct", "evaluable", None))
        .withColumn("coverage", ratio("confirmed", "total", None))
        .withColumn("team_precision", ratio("team_tp", c("team_tp") + c("team_fp")))
        .withColumn("team_recall", ratio("team_tp", c("team_tp") + c("team_fn")))
        .withColumn("team_f1", ratio(2 * c("team_tp"), 2 * c("team_tp") + c("team_fp") + c("team_fn")))
    )


def character_accuracy(readings: DataFrame) -> DataFrame:
    """Supporting OCR metric: digits matched in place, over the longer of both texts."""
    longest = F.greatest(F.length("truth_number"), F.length("number"))
    hits = F.aggregate(
        F.sequence(F.lit(1), longest), F.lit(0),
        lambda n, i: n + F.when(
            F.substr(F.col("truth_number"), i, F.lit(1)) == F.substr(F.col("number"), i, F.lit(1)),
            F.when(i <= F.least(F.length("truth_number"), F.length("number")), 1).otherwise(0),
        ).otherwise(0),
    )
    usable = readings.where("length(truth_number) > 0 and length(number) > 0")
    return usable.agg(F.sum(hits).alias("hits"), F.sum(longest).alias("characters"))
