"""Versions, revisions, imports and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.functions.hashing import drifted, merkle_tree, updated_tree
from actiongrid.operators import versions as V
from actiongrid.session import durable

from .bindings import EVENTS_SQL, events, manifest_rows, manifest_sql
from .registry import query, table
from .review_queries import SEC_SQL

COLUMNS = ("video_path", "start_seconds", "end_seconds", "label", "split")


def _expansion(spark, folder):
    """Background rows of every user are removed in favour of the record before, and each
    signup adds one action a second later."""
    rows = manifest_rows(spark, folder, clean=True).select("record_index", *COLUMNS, "notes").withColumn(
        "review_status", F.lit("reviewed"))
    snap = F.struct(*[F.col(c) for c in COLUMNS])
    taken = rows.where("trim(label) = 'background'").select(
        F.col("record_index").alias("remove_record_index"), F.col("record_index").alias("keep_record_index"),
        snap.alias("removed"), snap.alias("kept"))
    signups = events(spark, folder).where("event_type = 'signup'")
    actions = signups.select(
        (F.col("event_id") + 1).alias("position"), F.concat(F.lit("u"), "user_id").alias("video_path"), F.lit("dig").alias("label"),
        ((F.col("start_us") + 1_000_000) / F.lit(1e6)).alias("start_seconds"), ((F.col("end_us") + 2_000_000) / F.lit(1e6)).alias("end_seconds"),
        F.lit("train").alias("split"), F.concat(F.lit("S!G"), "k").alias("workbook_cell"), F.lit("1-2").alias("input_time"),
        F.col("event_type").alias("source_note"))
    return rows, taken, actions


EXPANDED = f"""with {manifest_sql(clean=True)},
x as (
  select 0 as origin, record_index as ordinal, label, (s_us // 1000000) || '.' || printf('%06d', s_us % 1000000) as start_seconds,
    'n' || k || case when k % 4 = 0 then '; Reviewer note: see this ' else '' end as notes from m where label <> 'background'
  union all
  select 1, event_id + 1, 'dig', {SEC_SQL('(start_us + 1000000)')},
    'Expansion batch 07; source workbook cell S!G' || k || '; input time 1-2; confirmed=dig@' || {SEC_SQL('(start_us + 1000000)')} || '-'
     || {SEC_SQL('(end_us + 2000000)')} || '; source note: signup' from m where event_type = 'signup'
)"""


@query("expansion_apply", EXPANDED + " select * from x")
def expansion_apply(spark, folder):
    made = V.apply_expansion(*_expansion(spark, folder), batch="07")
    return made.select("origin", "ordinal", F.trim("label").alias("label"), "start_seconds", "notes")


@query("expansion_summary", EXPANDED + """
select count(case when origin = 0 then 1 end) as kept_records, count(case when origin = 1 then 1 end) as added_records, count(*) as output_records,
       (select count(*) from m where label = 'background') as removed_records from x""")
def expansion_summary(spark, folder):
    rows, taken, actions = _expansion(spark, folder)
    return V.expansion_summary(V.apply_expansion(rows, taken, actions, batch="07"), taken)


@query("removal_faults", f"with {EVENTS_SQL} select event_id + 1 as remove_record_index, event_id + 1 as keep_record_index from ev where event_type = 'view' and k % 10 = 0")
def removal_faults(spark, folder):
    rows, taken, _ = _expansion(spark, folder)
    broken = F.struct(*[(F.lit("x") if c == "split" else F.col(f"kept.{c}")).alias(c) for c in COLUMNS])
    k = events(spark, folder).select((F.col("event_id") + 1).alias("remove_record_index"), "k")
    changed = taken.join(k, "remove_record_index").withColumn(
        "kept", F.when(F.col("k") % 10 == 0, broken).otherwise(F.col("kept"))).drop("k")
    return V.removal_faults(rows, changed)


@query("rally_notes", f"""with {EVENTS_SQL}, r as (select *, (start_us // 1000000) * 1000000 as low from ev)
select event_id as interval_id, 0 as position, 'serve' as label, low + 5000000 as start_us, low + 7000000 as end_us, case when k % 3 = 0 then 'no_touch' end as ignored from r
union all
select event_id, 1, 'dig', low + 61000000, low + 62000000, case when k % 2 = 0 then 'outside' end from r""")
def rally_notes(spark, folder):
    """Notes written from the event times: seconds only, then minutes and seconds."""
    low = F.floor(F.col("start_us") / 1_000_000) * 1_000_000
    two = lambda x: F.lpad((x % 60).cast("string"), 2, "0")
    t = F.floor(F.col("start_us") / 1_000_000)
    minute = lambda x: F.concat((F.floor(x / 60) % 60).cast("string"), F.lit(":"), two(x))
    note = F.concat(
        two(t + 5), F.lit("-"), two(t + 7), F.lit(" serve"), F.when(F.col("k") % 3 == 0, "（没碰到球）").otherwise(""), F.lit("; "),
        minute(t + 61), F.lit("-"), two(t + 62), F.lit(" dig, nothing else"))
    rows = events(spark, folder).select(
        F.col("event_id").alias("interval_id"), note.alias("note"), low.alias("start_us"),
        (low + F.when(F.col("k") % 2 == 0, 61_500_000).otherwise(62_000_000)).alias("end_us"))
    return V.rally_notes(rows).drop("source_text", "input_time")


@query("notes_without_actions", f"""with {EVENTS_SQL} select user_id as interval_id, count(*) as n from ev where k % 3 <> 0 and k % 5 <> 0 group by 1""")
def notes_without_actions(spark, folder):
    note = F.when(F.col("k") % 5 == 0, " ").when(F.col("k") % 3 == 0, "01-02 set").otherwise("opponent error")
    rows = events(spark, folder).select(F.col("event_id").alias("interval_id"), note.alias("note"), "start_us", (F.col("start_us") + 120_000_000).alias("end_us"), "user_id")
    return V.notes_without_actions(rows, V.rally_notes(rows)).groupBy(F.col("user_id").alias("interval_id")).agg(F.count(F.lit(1)).alias("n"))


@query("version_diff", """with o as (select o_custkey, o_orderstatus from orders where o_orderpriority <> '1-URGENT'),
n as (select o_custkey, o_orderstatus from orders where o_orderpriority <> '5-LOW'),
u as (select o_custkey, o_orderstatus, 1 as o, 0 as n from o union all select o_custkey, o_orderstatus, 0, 1 from n)
select o_custkey, o_orderstatus, cast(sum(o) as bigint) as old_count, cast(sum(n) as bigint) as new_count,
  case when sum(o) = sum(n) then 'unchanged' when sum(o) > sum(n) then 'removed' else 'added' end as status from u group by 1, 2""")
def version_diff(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return V.version_diff(rows.where("o_orderpriority <> '1-URGENT'"), rows.where("o_orderpriority <> '5-LOW'"), ["o_custkey", "o_orderstatus"])


@query("change_set", f"""with {EVENTS_SQL},
o as (select event_id, action, start_us, end_us from ev where event_type <> 'view'),
n as (select event_id, case when k % 7 = 0 then 'block' else action end as action, start_us, case when k % 5 = 0 then end_us + 1 else end_us end as end_us from ev where event_type <> 'click')
select coalesce(o.event_id, n.event_id) as source_record_id, case when o.event_id is null then 'add_window' when n.event_id is null then 'remove_window'
  when o.action <> n.action then 'relabel' when o.end_us <> n.end_us then 'move_window' else 'keep' end as operation
from o full join n on o.event_id = n.event_id""")
def change_set(spark, folder):
    e = events(spark, folder).withColumnsRenamed({"event_id": "source_record_id", "action": "label"})
    new = e.where("event_type <> 'click'").withColumn("label", F.when(F.col("k") % 7 == 0, "block").otherwise(F.col("label"))).withColumn(
        "end_us", F.when(F.col("k") % 5 == 0, F.col("end_us") + 1).otherwise(F.col("end_us")))
    return V.change_set(e.where("event_type <> 'view'"), new).select("source_record_id", "operation")


def revisions(spark, folder):
    """Orders of a customer as revisions of one event, numbered by day; several orders of
    one day repeat a number, and parents follow from the order key."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("revision_id"), F.col("o_custkey").alias("event_id"),
        F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate)").alias("revision_no"),
        F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, key - 1).otherwise(key + 1_000_000_000 * (key % 2)).alias("parent_id"),
        F.when(F.col("o_orderstatus") == "P", "predicted").otherwise("review").alias("origin"))


REVISIONS_SQL = """
rv as (select o_orderkey as revision_id, o_custkey as event_id, date_diff('day', timestamp '1990-01-01', o_orderdate) as revision_no,
        case o_orderkey % 3 when 0 then null when 1 then o_orderkey - 1 else o_orderkey + 1000000000 * (o_orderkey % 2) end as parent_id,
        case when o_orderstatus = 'P' then 'predicted' else 'review' end as origin from orders)"""


REVISION_FAULTS = f"""with {REVISIONS_SQL},
j as (select r.*, p.event_id as pa, p.revision_no as pn, p.revision_id as pid,
      lag(r.revision_no) over (partition by r.event_id order by r.revision_no, r.revision_id) as prev
      from rv r left join rv p on p.revision_id = r.parent_id),
f as (select *, case when prev = revision_no then 'number_repeated' when parent_id is null and prev is not null then 'second_root'
       when parent_id is not null and pid is null then 'parent_missing' when pa <> event_id then 'parent_foreign' when pn >= revision_no then 'parent_not_earlier' end as fault from j)
select revision_id, event_id, revision_no, parent_id, fault from f where fault is not null"""


@query("revision_faults", REVISION_FAULTS)
def revision_faults(spark, folder):
    return V.revision_faults(revisions(spark, folder))


@query("revision_faults_hot_events", REVISION_FAULTS)
def revision_faults_hot_events(spark, folder):
    return V.revision_faults(revisions(spark, folder), max_rows=17)


LINE = """case when c_custkey % 100 = 1 then c_custkey when c_custkey % 100 in (2, 11, 12, 13, 14) then c_custkey + 1
  when c_custkey % 100 = 15 then c_custkey - 4 when c_custkey % 100 in (0, 20) then null else c_custkey - 1 end"""


@query("revision_lineage", f"""with recursive rv as (select c_custkey as id, {LINE} as parent from customer),
up(id, cur, d) as (select id, id, 0 from rv
  union all select up.id, rv.parent, d + 1 from up join rv on rv.id = up.cur where rv.parent in (select id from rv) and d < 200),
far as (select id, max(d) as depth, arg_max(cur, d) as root, min(case when d >= 100 then cur end) as cycle,
        count(distinct case when d >= 100 then cur end) as cycle_size, bool_or(cur = id and d > 0) as looped from up group by id)
select id, case when depth < 200 then 'rooted' when looped then 'cycle' else 'into_cycle' end as state,
  case when depth < 200 then root end as root, case when depth < 200 then cast(depth as bigint) end as depth,
  case when depth = 200 then cycle end as cycle, case when depth = 200 then cycle_size end as cycle_size from far""")
def revision_lineage(spark, folder):
    """Chains of up to 79 steps, cycles of one, two and five revisions, and chains into them."""
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("revision_id"), F.expr(LINE).alias("parent_id"))
    return V.revision_lineage(rows)


@query("latest_revisions", f"with {REVISIONS_SQL} select event_id, revision_id, revision_no from (select *, row_number() over (partition by event_id order by revision_no desc, revision_id desc) as rn from rv) where rn = 1")
def latest_revisions(spark, folder):
    return V.latest_revisions(revisions(spark, folder)).select("event_id", "revision_id", "revision_no")


@query("raw_predictions", f"with {REVISIONS_SQL}, f as (select *, row_number() over (partition by event_id order by revision_no, revision_id) as n from rv) select event_id, revision_id from f where n = 1 and origin = 'predicted'")
def raw_predictions(spark, folder):
    from actiongrid.plans.ordered import order_by_key

    numbered = order_by_key(revisions(spark, folder), ["event_id"], ["revision_no", "revision_id"]).scan(number="n").rows()
    return V.raw_predictions(numbered.withColumn("revision_no", F.col("n"))).select("event_id", "revision_id")


POINTERS = "(select c_custkey as event_id, c_custkey * 7 as current_revision_id from customer)"


def _pointers(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("event_id"), (F.col("c_custkey") * 7).alias("current_revision_id"))


@query("current_revision", f"with {REVISIONS_SQL} select p.event_id, p.current_revision_id, r.revision_no, r.origin from {POINTERS} p left join rv r on r.revision_id = p.current_revision_id")
def current_revision(spark, folder):
    return V.current_revisions(_pointers(spark, folder), revisions(spark, folder)).select("event_id", "current_revision_id", "revision_no", "origin")


@query("fixed_snapshot", f"with {REVISIONS_SQL} select * from rv where revision_id in (select current_revision_id from {POINTERS})")
def fixed_snapshot(spark, folder):
    return V.fixed_snapshot(_pointers(spark, folder), revisions(spark, folder))


JSON_SQL = """sha256('{"o_custkey":"' || o_custkey || '","o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '"}')"""


def set_sql(source: str, column: str, name: str, group: str = "") -> str:
    """CTE `name`(group, n, h): rows and set hash of the digests of `source`."""
    by = f"{group}, " if group else ""
    return f"""
{name}1 as (select {by}{column} as d1, count(*) as n1 from {source} group by all),
{name}4 as (select {by}substr(d1, 1, 4) as p4, sum(n1) as n4, sha256(string_agg(d1 || ':' || n1, '' order by d1)) as h4 from {name}1 group by all),
{name}2 as (select {by}substr(p4, 1, 2) as p2, sum(n4) as n2, sha256(string_agg(h4, '' order by p4, h4)) as h2 from {name}4 group by all),
{name} as (select {by}cast(sum(n2) as bigint) as n, sha256(string_agg(h2, '' order by p2, h2)) as h from {name}2 {"group by all" if group else ""})"""


@query("content_hash", f"select o_orderkey, {JSON_SQL} as content_sha256 from orders")
def content_hash(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return V.row_hashes(rows, ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", "content_sha256")


@query("table_hash", f"with d as (select {JSON_SQL} as h from orders), {set_sql('d', 'h', 's')} select n as rows, h as set_sha256 from s")
def table_hash(spark, folder):
    return V.table_hash(table(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


def _two_states(spark, folder):
    """Digests of the orders as they were and as they are: some changed, some gone, some twice."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus"]
    old = table(spark, folder, "orders").select(*columns)
    moved = old.withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    new = moved.where("o_orderkey % 70 <> 1").withColumn("copies", F.when(F.col("o_orderkey") % 90 == 2, 2).otherwise(1))
    new = new.select(*columns, F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)
    return tuple(V.row_hashes(d, columns, out="h").select("h", "o_orderkey") for d in (old, new))


DRIFT_SQL = f"""with a as (select {JSON_SQL} as h from orders),
b as (select {JSON_SQL.replace("o_custkey ||", "(case when o_orderkey % 50 = 0 then o_custkey + 1 else o_custkey end) ||")} as h
      from orders, (select unnest([1, 2]) as copy) where o_orderkey % 70 <> 1 and (copy = 1 or o_orderkey % 90 = 2)),
ca as (select h, count(*) as n from a group by h), cb as (select h, count(*) as n from b group by h)"""


@query("hash_drift_rows", DRIFT_SQL + """
select coalesce(ca.h, cb.h) as digest, coalesce(ca.n, 0) as old_count, coalesce(cb.n, 0) as new_count
from ca full outer join cb on ca.h = cb.h where ca.n is distinct from cb.n""")
def hash_drift_rows(spark, folder):
    """The rows in which two states differ, found by walking their trees from the roots."""
    trees = [durable(merkle_tree(side, "h")) for side in _two_states(spark, folder)]
    return drifted(*trees)


@query("hash_tree_update", DRIFT_SQL + f""", {set_sql('b', 'h', 's')} select n as rows, h as set_sha256 from s""")
def hash_tree_update(spark, folder):
    """The root after a change, from the stored tree and the changed rows alone."""
    old, new = _two_states(spark, folder)
    tree = durable(merkle_tree(old, "h"))
    drift = durable(drifted(tree, durable(merkle_tree(new, "h"))))
    times = lambda a, b: drift.where(f"{a} > {b}").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col(a) - F.col(b))), "digest").select("digest")
    made = updated_tree(tree, times("new_count", "old_count"), times("old_count", "new_count"), "digest")
    return made.where("depth = 0").select(F.col("n").alias("rows"), F.col("sha256").alias("set_sha256"))


@query("idempotent_imports", f"""with {EVENTS_SQL},
j as (select event_id as job_id, sha256(concat_ws(chr(31), cast(user_id % 10 as varchar), event_type, cast(k as varchar), '1', '')) as key from ev),
f as (select key, min(job_id) as first_job from j group by key),
d as (select distinct key from j where job_id % 50 = 0)
select job_id, case when d.key is not null then 'reuse' when job_id <> first_job then 'duplicate' else 'run' end as decision
from j join f using (key) left join d using (key)""")
def idempotent_imports(spark, folder):
    jobs = events(spark, folder).select(
        F.col("event_id").alias("job_id"), (F.col("user_id") % 10).alias("workspace_id"), F.col("event_type").alias("import_kind"),
        F.col("k").alias("source_sha256"), F.lit(1).alias("contract_version"), F.lit("").alias("options"),
    ).withColumn("idempotency_key", V.idempotency_key())
    done = jobs.where("job_id % 50 = 0").withColumn("status", F.lit("succeeded"))
    return V.classify_imports(jobs, done).select("job_id", "decision")


def _entities(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("entity_type"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    old = o.where("o_orderstatus <> 'P'").withColumn("sha", F.sha2(F.col("o_custkey").cast("string"), 256))
    new = o.where("o_orderstatus <> 'F'").withColumn("sha", F.sha2((F.col("o_custkey") - F.when(F.col("o_custkey") % 4 == 0, 1).otherwise(0)).cast("string"), 256))
    return old, new


@query("conflict_check", """
select p.policy, o_orderkey as id, case when o_orderstatus = 'P' then 'new' when o_custkey % 4 <> 0 then 'identical' else 'conflict' end as state,
  case when p.policy = 'remap_ids' then 'remap'
       when p.policy = 'fail' and exists (select 1 from orders where o_orderstatus not in ('F', 'P') and o_custkey % 4 = 0) then 'fail'
       when o_orderstatus = 'P' then 'insert' when o_custkey % 4 <> 0 then 'reuse'
       when p.policy = 'fork_versions' and o_orderpriority = '2-HIGH' then 'fork' else 'fail' end as decision
from orders, (select unnest(['fail', 'skip_identical', 'fork_versions', 'remap_ids']) as policy) p where o_orderstatus <> 'F'""")
def conflict_check(spark, folder):
    old, new = _entities(spark, folder)
    made = None
    for policy in V.CONFLICT_POLICIES:
        one = V.resolve_conflicts(old, new, policy, versioned=["2-HIGH"]).select(F.lit(policy).alias("policy"), "id", "state", "decision")
        made = one if made is None else made.unionByName(one)
    return made


@query("remapped_ids", """
select o_orderkey as id, sha256(concat_ws(chr(31), 'pkg', o_orderpriority, cast(o_orderkey as varchar))) as new_target_id from orders where o_orderstatus <> 'F'""")
def remapped_ids(spark, folder):
    _, new = _entities(spark, folder)
    references = new.select("id", F.col("entity_type").alias("target_type"), F.col("id").alias("target_id"))
    _, rewritten = V.remap_ids(new.select("entity_type", "id"), references, "pkg")
    return rewritten.select("id", "new_target_id")


@query("item_states", f"""with {EVENTS_SQL} select event_id, case when k % 10 = 0 then 'reviewed_keep' when k % 10 = 1 then 'reviewed_relabel' when k % 10 = 2 then 'reviewed_moved'
  when k % 10 = 3 then 'reviewed_added' when k % 3 = 0 then 'queued_for_review' when event_type = 'view' then 'source' else 'predicted' end as state from ev""")
def item_states(spark, folder):
    k = F.col("k") % 10
    rows = events(spark, folder).select(
        "event_id", F.when(F.col("event_type") == "view", "imported").otherwise("predicted").alias("origin"), (F.col("k") % 3 == 0).alias("queued"),
        F.when(k == 0, "keep").when(k == 1, "relabel").when(k == 2, "move_window").when(k == 3, "add_window").alias("operation"))
    return rows.select("event_id", V.item_state().alias("state"))


@query("shared_matches", f"with {EVENTS_SQL} select distinct user_id as video_id from ev where k < 50 intersect select user_id from ev where k >= 50")
def shared_matches(spark, folder):
    e = events(spark, folder).withColumnRenamed("user_id", "video_id")
    return V.shared_matches(e.where("k < 50"), e.where("k >= 50"))
