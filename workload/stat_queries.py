"""Statistics, health, storage and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.operators import health as H
from actiongrid.operators import manifest as M
from actiongrid.operators import stats as S

from .bindings import EVENTS_SQL, HOUR, events, manifest_rows, manifest_sql
from .registry import query, table
from .version_queries import POINTERS, REVISIONS_SQL, _pointers, revisions, set_sql

PLAYER_SQL = "coalesce(case when k % 5 = 0 then null else cast(k % 20 as varchar) end, 'Unknown')"


def played(spark, folder):
    """Events with a player number (missing or blank for some) and a team."""
    k = F.col("k")
    return events(spark, folder).select(
        "event_id", "user_id", "action", "k", "start_us", "end_us",
        F.when(k % 10 == 0, F.lit(None)).when(k % 5 == 0, "  ").otherwise((k % 20).cast("string")).alias("player_number"),
        F.when(F.col("user_id") % 2 == 0, "own").otherwise("other").alias("team"))


@query("action_stats_unknown", f"with {EVENTS_SQL} select {PLAYER_SQL} as player, action, count(*) as n from ev group by 1, 2")
def action_stats_unknown(spark, folder):
    return S.action_counts(played(spark, folder))


@query("action_rollup", f"""with {EVENTS_SQL}, p as (select {PLAYER_SQL} as player, action from ev)
select player, action, cast(grouping(player) * 2 + grouping(action) as integer) as level, count(*) as n from p group by cube (player, action)""")
def action_rollup(spark, folder):
    return S.action_rollup(played(spark, folder))


@query("attribution", f"""with {EVENTS_SQL} select case when user_id % 2 = 0 then 'own' else 'other' end as team, count(*) as team_total,
  count(case when k % 5 <> 0 then 1 end) as attributed, count(case when k % 5 = 0 then 1 end) as unattributed from ev group by 1""")
def attribution(spark, folder):
    return S.attribution(played(spark, folder))


def _ratios():
    return {
        "attack_share": (F.col("action") == "attack", F.lit(True)),
        "strong_dig": (F.col("k") >= 50, F.col("action") == "dig"),
        "block_rate": (F.col("k") >= 50, F.col("action") == "block"),
    }


@query("ratio_stats", f"""with {EVENTS_SQL},
r as (
  select user_id, 'attack_share' as stat, count(case when action = 'attack' then 1 end) as numerator, count(*) as denominator from ev group by 1
  union all select user_id, 'strong_dig', count(case when action = 'dig' and k >= 50 then 1 end), count(case when action = 'dig' then 1 end) from ev group by 1
  union all select user_id, 'block_rate', count(case when action = 'block' and k >= 50 then 1 end), count(case when action = 'block' then 1 end) from ev group by 1
) select *, numerator::double / nullif(denominator, 0) as value from r""")
def ratio_stats(spark, folder):
    return S.ratio_stats(played(spark, folder), ["user_id"], _ratios())


@query("stat_evidence", f"""with {EVENTS_SQL}
select user_id, event_id, 'attack_share' as stat, action = 'attack' as counted from ev
union all select user_id, event_id, 'strong_dig', k >= 50 from ev where action = 'dig'
union all select user_id, event_id, 'block_rate', k >= 50 from ev where action = 'block'""")
def stat_evidence(spark, folder):
    return S.stat_evidence(played(spark, folder), ["user_id"], _ratios())


SETS_SQL = f"""
st as (select user_id as video_id, start_us // {48 * HOUR} as set_no, user_id * 100 + start_us // {48 * HOUR} as set_id,
       min(start_us) as start_us, max(start_us) + {12 * HOUR} as end_us from ev group by 1, 2, 3)"""


def sets(spark, folder):
    no = F.floor(F.col("start_us") / (48 * HOUR))
    return events(spark, folder).groupBy(F.col("user_id").alias("video_id"), (F.col("user_id") * 100 + no).alias("set_id")).agg(
        F.min("start_us").alias("start_us"), (F.max("start_us") + 12 * HOUR).alias("end_us"))


@query("set_points", f"""with {EVENTS_SQL}, {SETS_SQL},
p as (select event_id, k % 2 as winner, user_id as video_id, (select case when count(*) = 1 then max(set_id) end from st
      where st.video_id = ev.user_id and st.start_us <= ev.start_us and ev.end_us <= st.end_us) as set_id from ev)
select video_id, set_id, winner, count(*) as points from p group by all""")
def set_points(spark, folder):
    rallies = events(spark, folder).select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("rally_id"), (F.col("k") % 2).alias("winner"), "start_us", "end_us")
    return S.set_points(rallies, sets(spark, folder))


@query("playing_time", f"""with {EVENTS_SQL}, {SETS_SQL}
select st.video_id, set_id, k % 6 as player, cast(sum(least(ev.end_us, st.end_us) - greatest(ev.start_us, st.start_us)) as bigint) as played_us, count(*) as stints
from ev join st on st.video_id = ev.user_id and ev.start_us < st.end_us and st.start_us < ev.end_us group by 1, 2, 3""")
def playing_time(spark, folder):
    stints = events(spark, folder).select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("stint_id"), (F.col("k") % 6).alias("player"), "start_us", "end_us")
    return S.playing_time(stints, sets(spark, folder))


SNAP = """sha256('{"action":"' || action || '","event_id":"' || event_id || '"}')"""


@query("stat_snapshot", f"""with {EVENTS_SQL}, d as (select user_id, {SNAP} as h from ev), {set_sql('d', 'h', 's', 'user_id')}, {set_sql('d', 'h', 'w')}
select user_id, s.n, s.h as revision_set_sha256, w.h as snapshot_sha256, 'v1' as snapshot from s, w""")
def stat_snapshot(spark, folder):
    return S.snapshot(events(spark, folder), ["user_id"], version="v1", hash_columns=["event_id", "action"])


@query("superseded_snapshots", f"""with {EVENTS_SQL}
select user_id, case when count(case when k <> 99 then 1 end) = 0 then 'gone' when count(case when k = 99 then 1 end) > 0 then 'superseded' else 'current' end as state
from ev group by user_id""")
def superseded_snapshots(spark, folder):
    """Rebuilding without the events of k = 99 supersedes the snapshots that used one."""
    e = events(spark, folder)
    old = S.snapshot(e, ["user_id"], version="v1", hash_columns=["event_id", "action"])
    new = S.snapshot(e.where("k <> 99"), ["user_id"], version="v2", hash_columns=["event_id", "action"])
    return S.supersede(old, new, ["user_id"]).select("user_id", "state")


@query("metric_long", f"""with {EVENTS_SQL}, w as (select user_id, count(*) as events, cast(sum(k) as bigint) as k_sum, max(end_us) as last_us from ev group by 1)
select user_id, 'events' as metric, events as value from w union all select user_id, 'k_sum', k_sum from w union all select user_id, 'last_us', last_us from w""")
def metric_long(spark, folder):
    wide = events(spark, folder).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("k").alias("k_sum"), F.max("end_us").alias("last_us"))
    return S.metric_long(wide, ["user_id"], ["events", "k_sum", "last_us"])


@query("confirmed_facts", "select l_suppkey, count(*) as n from lineitem where l_returnflag = 'A' group by 1")
def confirmed_facts(spark, folder):
    status = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "rejected").otherwise("candidate")
    rows = table(spark, folder, "lineitem").withColumn("identity_status", status)
    return S.confirmed_only(rows).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("health_checks", f"""with {manifest_sql()}, {REVISIONS_SQL},
c as (
  select 'current_version_pointers' as check_name, 'error' as bad, (select count(*) from {POINTERS} p where current_revision_id not in (select revision_id from rv)) as faults
  union all select 'foreign_keys', 'error', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))
  union all select 'annotation_split_isolation', 'error', (select count(*) from (select video_path from m group by 1 having min(split) <> max(split)))
  union all select 'event_revision_chains', 'error', (select count(*) from rv where parent_id is not null and parent_id not in (select revision_id from rv))
  union all select 'asset_hashes', 'error', (select count(*) from documents where sha256(case when doc_id % 97 = 0 then text || 'x' else text end) <> sha256(text))
  union all select 'orphaned_assets', 'warning', (select count(*) from documents where doc_id not in (select doc_id from labels))
)
select check_name, case when faults = 0 then 'healthy' else bad end as status, faults from c
union all select 'storage_engine', 'not_run', 0""")
def health_checks(spark, folder):
    rv, docs = revisions(spark, folder), table(spark, folder, "documents")
    checked = M.check_manifest(manifest_rows(spark, folder), video_root="/media")
    kept = F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    assets = docs.select(F.sha2(kept, 256).alias("recorded"), F.sha2("text", 256).alias("seen"))
    return H.status_table([
        H.check("current_version_pointers", H.dangling(_pointers(spark, folder), "current_revision_id", rv, "revision_id")),
        H.check("foreign_keys", H.dangling(table(spark, folder, "lineitem"), "l_orderkey", table(spark, folder, "orders"), "o_orderkey")),
        H.check("annotation_split_isolation", H.split_mixing(checked, key="video_path")),
        H.check("event_revision_chains", H.dangling(rv.select("parent_id"), "parent_id", rv.select("revision_id"), "revision_id")),
        H.check("asset_hashes", H.hash_drift(assets, "recorded", "seen")),
        H.check("orphaned_assets", H.orphans(docs, table(spark, folder, "labels"), key="doc_id"), severity="warning"),
        H.not_run(spark, "storage_engine"),
    ])


@query("storage_usage", """select source as kind, count(*) as assets, cast(sum(n_chars) as bigint) as bytes,
  count(case when doc_id not in (select doc_id from labels) then 1 end) as unreferenced_assets,
  cast(sum(case when doc_id not in (select doc_id from labels) then n_chars else 0 end) as bigint) as unreferenced_bytes from documents group by 1""")
def storage_usage(spark, folder):
    assets = table(spark, folder, "documents").select(F.col("doc_id").alias("asset_id"), F.col("source").alias("kind"), F.col("n_chars").alias("bytes"))
    return H.storage_usage(assets, table(spark, folder, "labels").select(F.col("doc_id").alias("asset_id")))


@query("entity_counts", f"""with e as (
  select 'order' as entity_type, sha256(cast(o_orderkey as varchar)) as sha from orders
  union all select 'page', sha256(html) from pages
  union all select 'document', sha256(text) from documents), {set_sql('e', 'sha', 's', 'entity_type')}
select entity_type, n as entities, h as entities_sha256 from s""")
def entity_counts(spark, folder):
    t = lambda n, i, h: table(spark, folder, n).select(F.col(i).alias("id"), F.sha2(F.col(h).cast("string"), 256).alias("sha"))
    return H.entity_inventory({"order": t("orders", "o_orderkey", "o_orderkey"), "page": t("pages", "page_id", "html"), "document": t("documents", "doc_id", "text")})


@query("workspace_rows", "select o_orderkey from orders where o_orderpriority = '2-HIGH'")
def workspace_rows(spark, folder):
    rows = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "workspace_id")
    return H.in_workspace(rows, "2-HIGH").select("o_orderkey")
