"""Dataset versions: expansions, differences, revisions, imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import ACTION_LABELS, BACKGROUND_LABEL, ReviewError
from ..functions.hashing import content_hash, set_hash
from ..functions.numbers import as_col
from ..functions.text import seconds_text
from ..plans.ordered import MAX_ROWS, order_by_key
from ..session import durable

# A remark with one of these words says that no touch happened.
NO_TOUCH = ("没碰到",)
SNAPSHOT_COLUMNS = ("video_path", "start_seconds", "end_seconds", "label", "split")


# --- rally notes -----------------------------------------------------------------

def _clock_seconds(text: Column) -> Column:
    minutes = F.coalesce(F.regexp_extract(text, r"^(\d+):", 1).try_cast("long"), F.lit(0))
    return minutes * 60 + F.regexp_extract(text, r"(\d+)$", 1).try_cast("long")


def rally_notes(intervals: DataFrame) -> DataFrame:
    """Actions written in interval notes, e.g. '45-46 receive; 14:00-01 set'.

    intervals: interval_id, note, start_us, end_us. A time gives seconds, or minutes and
    seconds; the missing larger units come from the interval: the first matching moment at
    or after its start. Output: interval_id, position, source_text, label, input_time,
    start_us, end_us and `ignored` (no touch, or outside of the interval)."""
    clock = r"(?:\d{1,3}:)?\d{1,2}"
    labels = "|".join(x for x in ACTION_LABELS if x != BACKGROUND_LABEL)
    piece = rf"({clock})\s*-\s*({clock})\s+({labels})\b(?:\s*([（(][^）)]*[）)]))?"
    found = intervals.select(
        "interval_id", "start_us", "end_us",
        F.posexplode(F.regexp_extract_all("note", F.lit(piece), F.lit(0))).alias("position", "source_text"),
    ).withColumnsRenamed({"start_us": "low", "end_us": "high"})
    part = lambda i: F.regexp_extract("source_text", piece, i)
    second = F.lit(1_000_000).cast("long")
    period = lambda t: F.when(t.contains(":"), F.lit(3600)).otherwise(F.lit(60)) * second
    begin, finish = _clock_seconds(part(1)) * second, _clock_seconds(part(2)) * second
    # the end may drop the minutes, so it is taken modulo its own period
    resolved = found.select(
        "interval_id", "position", "source_text", part(3).alias("label"), part(4).alias("remark"),
        F.concat(part(1), F.lit("-"), part(2)).alias("input_time"), "low", "high",
        (F.col("low") + F.pmod(begin - F.col("low"), period(part(1)))).alias("start_us"),
        finish.alias("__finish"), period(part(2)).alias("__period"),
    ).withColumn("end_us", F.col("start_us") + F.pmod(F.col("__finish") - F.col("start_us"), F.col("__period")))
    no_touch = F.lit(False)
    for word in NO_TOUCH:
        no_touch = no_touch | F.col("remark").contains(word)
    outside = (F.col("start_us") < F.col("low")) | (F.col("end_us") > F.col("high"))
    return resolved.withColumn(
        "ignored", F.when(no_touch, "no_touch").when(outside, "outside")
    ).drop("low", "high", "remark", "__finish", "__period")


def notes_without_actions(intervals: DataFrame, actions: DataFrame) -> DataFrame:
    """Intervals with a note that yields no action."""
    used = actions.where("ignored is null").select("interval_id").distinct()
    return intervals.where("trim(coalesce(note, '')) <> ''").join(used, "interval_id", "left_anti")


# --- expansion -------------------------------------------------------------------

def removal_faults(rows: DataFrame, removals: DataFrame, columns: Sequence[str] = SNAPSHOT_COLUMNS) -> DataFrame:
    """Removals whose removed or kept snapshot differs from the source row.

    removals: remove_record_index, keep_record_index, removed and kept (structs of text)."""
    side = lambda name: rows.select(
        F.col("record_index").alias(f"{name}_record_index"),
        F.struct(*[F.col(c) for c in columns]).alias(f"{name}_row"),
    )
    joined = removals.join(side("remove"), "remove_record_index", "left").join(
        side("keep"), "keep_record_index", "left"
    )
    same = F.lit(True)
    for snapshot, row in (("removed", "remove_row"), ("kept", "keep_row")):
        for c in columns:
            same = same & F.col(f"{snapshot}.{c}").eqNullSafe(F.col(f"{row}.{c}"))
        same = same & F.col(row).isNotNull()
    return joined.where(~same).select("remove_record_index", "keep_record_index")


def expansion_note(batch: str) -> Column:
    # The wording of the note.
    return F.concat(
        F.lit(f"Expansion batch {batch}; source workbook cell "), F.col("workbook_cell"),
        F.lit("; input time "), F.col("input_time"), F.lit("; confirmed="), F.col("label"), F.lit("@"),
        seconds_text("start_seconds"), F.lit("-"), seconds_text("end_seconds"),
        F.lit("; source note: "), F.col("source_note"),
    )


def apply_expansion(rows: DataFrame, removals: DataFrame, actions: DataFrame, *, batch: str, strict: bool = True) -> DataFrame:
    """Source rows without the removed ones, followed by the actions in their order.

    actions: position, video_path, label, start_seconds, end_seconds (double), team_side,
    player_number, split, workbook_cell, input_time, source_note, and crop columns."""
    if strict and not removal_faults(rows, removals).isEmpty():
        raise ReviewError("snapshot", "a removed or kept source row has changed")
    columns = [c for c in rows.columns if c not in ("record_index", "source_file", "extra_cells")]
    kept = rows.join(
        removals.select(F.col("remove_record_index").alias("record_index")), "record_index", "left_anti"
    ).select(F.lit(0).alias("origin"), F.col("record_index").alias("ordinal"), *columns)
    values = {
        "start_seconds": seconds_text("start_seconds"), "end_seconds": seconds_text("end_seconds"),
        "notes": expansion_note(batch), "review_status": F.lit("reviewed"),
    }
    added = actions.select(
        F.lit(1).alias("origin"), F.col("position").cast("long").alias("ordinal"),
        *[values.get(c, F.col(c).cast("string") if c in actions.columns else F.lit(None).cast("string")).alias(c)
          for c in columns],
    )
    return kept.unionByName(added)


def expansion_summary(result: DataFrame, removals: DataFrame) -> DataFrame:
    counts = result.agg(
        F.count_if(F.col("origin") == 0).alias("kept_records"),
        F.count_if(F.col("origin") == 1).alias("added_records"), F.count(F.lit(1)).alias("output_records"),
    )
    removed = removals.agg(F.count(F.lit(1)).alias("removed_records"))
    return counts.join(F.broadcast(removed), F.lit(True))  # one row each


# --- differences -----------------------------------------------------------------

def version_diff(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Multiset difference: distinct rows with their counts on both sides and a status.
    One partially aggregated shuffle; repeated rows collapse before it."""
    side = lambda df, o, n: df.select(*columns, F.lit(o).alias("o"), F.lit(n).alias("n"))
    counted = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*columns).agg(
        F.sum("o").alias("old_count"), F.sum("n").alias("new_count")
    )
    return counted.withColumn(
        "status",
        F.when(F.col("old_count") == F.col("new_count"), "unchanged")
        .when(F.col("old_count") > F.col("new_count"), "removed").otherwise("added"),
    )


def change_set(old: DataFrame, new: DataFrame, *, key: str = "source_record_id") -> DataFrame:
    """What happened to each record between two versions: keep, relabel, move_window,
    add_window or remove_window. A record with new label and times counts as relabel."""
    fields = ("label", "start_us", "end_us")
    a = old.select(F.col(key), F.struct(*fields).alias("before"))
    b = new.select(F.col(key), F.struct(*fields).alias("after"))
    moved = (F.col("before.start_us") != F.col("after.start_us")) | (F.col("before.end_us") != F.col("after.end_us"))
    return a.join(b, key, "full_outer").withColumn(
        "operation",
        F.when(F.col("before").isNull(), "add_window").when(F.col("after").isNull(), "remove_window")
        .when(F.col("before.label") != F.col("after.label"), "relabel")
        .when(moved, "move_window").otherwise("keep"),
    )


# --- revisions -------------------------------------------------------------------

def current_revisions(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """Events with the revision their pointer names (left: dangling pointers stay visible)."""
    return events.join(
        revisions.withColumnRenamed("revision_id", "current_revision_id").drop("event_id"),
        "current_revision_id", "left",
    )


def latest_revisions(revisions: DataFrame, *, aggregate: str = "event_id") -> DataFrame:
    """The revision with the highest number per aggregate, as a partial aggregate."""
    rest = [c for c in revisions.columns if c != aggregate]
    best = F.max_by(F.struct(*rest), F.struct("revision_no", "revision_id"))
    return revisions.groupBy(aggregate).agg(best.alias("r")).select(aggregate, "r.*")


def raw_predictions(revisions: DataFrame) -> DataFrame:
    return revisions.where("revision_no = 1 and origin = 'predicted'")


def revision_faults(revisions: DataFrame, *, aggregate: str = "event_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """Broken chains. Numbers must rise strictly and a parent must be an earlier revision
    of the same aggregate; parents that are always earlier cannot form a cycle."""
    parents = revisions.select(
        F.col("revision_id").alias("parent_id"), F.col(aggregate).alias("__pa"), F.col("revision_no").alias("__pn"),
    )
    joined = revisions.join(parents, "parent_id", "left")
    chained = order_by_key(joined, (aggregate,), ("revision_no", "revision_id"), max_rows=max_rows).scan(
        lag={"__prev": "revision_no"}
    ).rows()
    return chained.withColumn(
        "fault",
        F.when(F.col("__prev") == F.col("revision_no"), "number_repeated")
        .when(F.col("parent_id").isNull() & F.col("__prev").isNotNull(), "second_root")
        .when(F.col("parent_id").isNotNull() & F.col("__pa").isNull(), "parent_missing")
        .when(F.col("__pa") != F.col(aggregate), "parent_foreign")
        .when(F.col("__pn") >= F.col("revision_no"), "parent_not_earlier"),
    ).where("fault is not null").select("revision_id", aggregate, "revision_no", "parent_id", "fault")


def revision_lineage(revisions: DataFrame, *, id_col: str = "revision_id", parent_col: str = "parent_id") -> DataFrame:
    """(id, state, root, depth, cycle, cycle_size) of every revision, by pointer doubling.

    state is `rooted` (root is the first revision of its chain, `depth` steps away; one whose
    parent is missing is a root), `cycle` (a member; cycle is its smallest id) or `into_cycle`
    (a chain that runs into one). Each round doubles how far a revision sees, so a chain of n
    takes log2(n) rounds; a round is a stored table of the revisions not resolved yet.
    """
    ids = revisions.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    known = ids.select(F.col("id").alias("parent"), F.lit(True).alias("__known"))
    start = ids.join(known, "parent", "left")
    up = F.when(F.col("__known"), F.col("parent"))
    state = durable(start.select(
        "id", up.alias("to"), F.when(up.isNull(), F.col("id")).alias("root"),
        F.when(up.isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("id").alias("low"),
    ))
    done, seen, left = state.where("to IS NULL"), 1, state.where("to IS NOT NULL")
    n, before = left.count(), -1
    # a round without a newly resolved row leaves cycles and what leads to them; their members
    # are told apart once every revision sees at least as far as there are revisions
    while n and (n != before or seen < n):
        ahead = done.unionByName(left).select(
            F.col("id").alias("to"), F.col("to").alias("__to"), F.col("root").alias("__root"),
            F.col("steps").alias("__steps"), F.col("low").alias("__low"))
        state = durable(left.join(ahead, "to").select(
            "id", F.col("__to").alias("to"), F.col("__root").alias("root"),
            (F.col("steps") + F.col("__steps")).alias("steps"), F.least("low", "__low").alias("low")))
        done, left = done.unionByName(state.where("to IS NULL")), state.where("to IS NOT NULL")
        before, n, seen = n, left.count(), seen * 2
    ends = left.select(F.col("to").alias("id")).distinct().withColumn("__on", F.lit(True))
    looped = left.join(ends, "id", "left").withColumn("__on", F.coalesce("__on", F.lit(False)))
    members = looped.where("__on").select(F.col("id").alias("to"), F.col("low").alias("cycle"))
    sizes = members.groupBy("cycle").agg(F.count(F.lit(1)).alias("cycle_size"))
    looped = looped.join(members, "to").join(sizes, "cycle")
    kind = left.schema["id"].dataType
    rooted = done.select("id", F.lit("rooted").alias("state"), "root", F.col("steps").alias("depth"),
                         F.lit(None).cast(kind).alias("cycle"), F.lit(None).cast("long").alias("cycle_size"))
    return rooted.unionByName(looped.select(
        "id", F.when(F.col("__on"), "cycle").otherwise("into_cycle").alias("state"), F.lit(None).cast(kind).alias("root"),
        F.lit(None).cast("long").alias("depth"), "cycle", "cycle_size",
    ))


def fixed_snapshot(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rows of the revisions that are current now. The pointers are resolved once and
    stored, so a pointer that moves later cannot change a running export."""
    ids = durable(events.select(F.col("current_revision_id").alias("revision_id")))
    return revisions.join(ids, "revision_id", "left_semi")


def row_hashes(rows: DataFrame, columns: Sequence[str], *, out: str = "content_sha256") -> DataFrame:
    return rows.withColumn(out, content_hash(columns))


def table_hash(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return set_hash(rows.select(content_hash(columns).alias("h")), "h")


# --- imports ---------------------------------------------------------------------

def idempotency_key(columns: Sequence[str] = ("workspace_id", "import_kind", "source_sha256", "contract_version", "options")) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in columns]), 256)


def classify_imports(requests: DataFrame, finished: DataFrame, *, key: str = "idempotency_key", order: str = "job_id") -> DataFrame:
    """`reuse` where a finished job has the key, `duplicate` after the first request with
    it, else `run`."""
    first = requests.groupBy(key).agg(F.min(order).alias("first_job"))
    done = finished.where("status = 'succeeded'").groupBy(key).agg(F.min(order).alias("done_job"))
    return requests.join(first, key).join(done, key, "left").withColumn(
        "decision",
        F.when(F.col("done_job").isNotNull(), "reuse")
        .when(F.col(order) != F.col("first_job"), "duplicate").otherwise("run"),
    )


CONFLICT_POLICIES = ("fail", "skip_identical", "fork_versions", "remap_ids")


def resolve_conflicts(existing: DataFrame, incoming: DataFrame, policy: str, *, versioned: Sequence[str] = ()) -> DataFrame:
    """Decision per incoming entity (entity_type, id, sha): insert, reuse, fork, remap or fail."""
    if policy not in CONFLICT_POLICIES:
        raise ValueError(f"unknown conflict policy {policy}")
    known = existing.select("entity_type", "id", F.col("sha").alias("known_sha"))
    joined = incoming.join(known, ["entity_type", "id"], "left")
    state = (
        F.when(F.col("known_sha").isNull(), "new").when(F.col("known_sha") == F.col("sha"), "identical")
        .otherwise("conflict")
    )
    s = F.col("state")
    if policy == "fail":  # one conflict fails the whole package
        verdict = joined.agg(F.coalesce(F.bool_or(state == "conflict"), F.lit(False)).alias("__broken"))
        joined = joined.join(F.broadcast(verdict), F.lit(True))  # one row by construction
        decision = F.when(F.col("__broken"), "fail").when(s == "new", "insert").otherwise("reuse")
    elif policy == "skip_identical":
        decision = F.when(s == "new", "insert").when(s == "identical", "reuse").otherwise("fail")
    elif policy == "fork_versions":
        can_fork = F.col("entity_type").isin(*versioned) if versioned else F.lit(False)
        decision = (
            F.when(s == "new", "insert").when(s == "identical", "reuse").when(can_fork, "fork").otherwise("fail")
        )
    else:
        decision = F.lit("remap")
    return joined.withColumn("state", state).withColumn("decision", decision).drop("__broken")


def remap_ids(entities: DataFrame, references: DataFrame, package: str) -> tuple[DataFrame, DataFrame]:
    """New stable ids for a package and its references rewritten through the id map."""
    new_id = lambda t, i: F.sha2(F.concat_ws("\x1f", F.lit(package), t, i.cast("string")), 256)
    ids = entities.select("entity_type", "id", new_id(F.col("entity_type"), F.col("id")).alias("new_id"))
    targets = ids.select(
        F.col("entity_type").alias("target_type"), F.col("id").alias("target_id"), F.col("new_id").alias("new_target_id")
    )
    return entities.join(ids, ["entity_type", "id"]), references.join(targets, ["target_type", "target_id"], "left")


# --- item state and scope ----------------------------------------------------------

def item_state() -> Column:
    """Review state of an item with columns origin, queued, operation."""
    by_operation = (
        F.when(F.col("operation") == "keep", "reviewed_keep").when(F.col("operation") == "relabel", "reviewed_relabel")
        .when(F.col("operation") == "move_window", "reviewed_moved").when(F.col("operation") == "add_window", "reviewed_added")
    )
    return F.coalesce(
        by_operation, F.when(F.col("queued"), "queued_for_review"),
        F.when(F.col("origin") == "predicted", "predicted"), F.lit("source"),
    )


def shared_matches(train: DataFrame, evaluated: DataFrame, *, key: str = "video_id") -> DataFrame:
    """Videos seen in training and in an evaluation: its scores are then in-match only."""
    return train.select(key).intersect(evaluated.select(key))
