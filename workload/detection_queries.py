"""Detections, winners, scores and evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.domain import ACTION_LABELS
from actiongrid.functions.labels import normalize_external
from actiongrid.operators import detections as D
from actiongrid.operators import manifest as M
from actiongrid.operators.evaluation import evaluate_detections, write_report
from actiongrid.operators.inference import infer_events, score_windows
from actiongrid.session import scratch_path
from actiongrid.sources.sinks import read_record, write_evaluation_csv, write_record

from .bindings import EVENTS_SQL, HOUR, clock_sql, events, half_even_sql, islands_sql, manifest_rows, manifest_sql
from .registry import query, table

ORDER = ("frame_index", "l_partkey", "l_suppkey", "price")


def line_detections(spark, folder):
    action = (
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "attack")
        .when(F.col("l_returnflag") == "A", "block").when(F.col("l_returnflag") == "R", "receive")
        .when(F.col("l_linestatus") == "F", "serve").otherwise("referee")
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return lines.select(
        F.col("l_orderkey").alias("window_id"), F.col("l_linenumber").alias("frame_index"), "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
        action.alias("action"), F.concat(F.lit(" "), F.upper(action)).alias("source_label"),
        (F.round(F.col("l_discount") * 100).cast("long") * 100_000).alias("conf_micro"),
        F.array("l_quantity", F.lit(0.0), F.col("l_quantity") + 1, F.lit(2.0)).alias("box_xyxy"),
    )


LINES_SQL = """
d as (
  select l_orderkey as window_id, l_linenumber as frame_index, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint) as price,
         case when l_returnflag = 'A' and l_linestatus = 'F' then 'attack' when l_returnflag = 'A' then 'block'
              when l_returnflag = 'R' then 'receive' when l_linestatus = 'F' then 'serve' else 'referee' end as action,
         cast(round(l_discount * 100) as bigint) * 100000 as conf_micro
  from lineitem
)"""


@query("window_winner", f"""with {LINES_SQL},
o as (select *, list_position(['background','serve','receive','set','attack','block','dig'], action) as ord from d),
r as (select window_id, action, conf_micro, row_number() over (partition by window_id order by conf_micro desc, ord, frame_index, l_partkey, l_suppkey, price) as rn
      from o where conf_micro >= 250000 and ord is not null),
n as (select o_orderkey as window_id, (select count(*) from d where d.window_id = o_orderkey) as n_detections from orders)
select n.window_id, coalesce(r.action, 'background') as action, coalesce(r.conf_micro, 0) as conf_micro, n_detections
from n left join r on r.window_id = n.window_id and rn = 1""")
def window_winner(spark, folder):
    windows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("window_id"))
    return D.window_winner(line_detections(spark, folder), confidence_threshold=0.25, windows=windows, order=ORDER)


EVIDENCE = f"""with {LINES_SQL},
r as (select *, row_number() over (partition by window_id order by frame_index, l_partkey, l_suppkey, price) - 1 as nth from d)
select window_id, nth // 3 as part, string_agg(frame_index || action, ',' order by nth) as items, cast(sum(conf_micro) as bigint) as conf
from r group by window_id, nth // 3"""


@query("evidence_parts", EVIDENCE)
def evidence_parts(spark, folder):
    parts = D.evidence_parts(line_detections(spark, folder), order=ORDER, part_rows=3)
    return parts.select(
        "window_id", "part",
        F.array_join(F.transform("evidence", lambda e: F.concat(e["frame_index"], e["action"])), ",").alias("items"),
        F.aggregate("evidence", F.lit(0).cast("long"), lambda a, e: a + F.round(e["confidence"] * 1e6).cast("long")).alias("conf"),
    )


def vector_frames(spark, folder):
    """Each vector as one frame, all components read: eleven class ids, ten confidences and eleven
    boxes, of which two are short."""
    e = F.col("embedding")
    unit = lambda x: F.floor(F.abs(x.cast("double")) * 1000)
    names = F.create_map(*[F.lit(x) for kv in {0: "ball", 1: "spike", 2: " Serve", 3: "SET", 4: "block", 5: "umpire"}.items() for x in kv])
    boxes = F.array(*[F.slice(e, 22 + 4 * i, 3 if i == 3 else 4) for i in range(11)])
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("window_id"), (F.col("label") % 3).alias("frame_index"),
        F.transform(F.slice(e, 1, 11), lambda x: (unit(x) % 7).cast("int")).alias("class_ids"),
        F.transform(F.slice(e, 12, 10), lambda x: unit(x) % 1000 / F.lit(1000.0)).alias("confidences"),
        boxes.alias("boxes"), names.alias("names"),
    )


@query("detection_extract", """
with p as (select vec_id, label, embedding as e, unnest(range(1, 11)) as i from embeddings),
q as (select vec_id as window_id, cast(label % 3 as integer) as frame_index, cast(i - 1 as integer) as position,
             cast(floor(abs(e[i]::double) * 1000) as bigint) % 7 as c, cast(floor(abs(e[i + 11]::double) * 1000) as bigint) % 1000 as f,
             e[18 + 4 * i]::double as x1, e[19 + 4 * i]::double as y1, e[20 + 4 * i]::double as x2, e[21 + 4 * i]::double as y2 from p)
select window_id, frame_index, position, case c when 1 then 'spike' when 2 then ' Serve' when 3 then 'SET' else 'block' end as source_label,
       case c when 1 then 'attack' when 2 then 'serve' when 3 then 'set' else 'block' end as action, f * 1000 as conf_micro, x1, y1, x2, y2
from q where c between 1 and 4 and position <> 3""")
def detection_extract(spark, folder):
    found = D.extract_detections(vector_frames(spark, folder))
    corners = [F.get("box_xyxy", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return found.select(*[c for c in found.columns if c != "box_xyxy"], *corners)


@query("sample_frames", """
with p as (select vec_id as window_id, embedding as e, unnest(range(0, 32)) as i from embeddings)
select window_id, cast(i as integer) as frame_index, e[i * 2 + 1]::double as a, e[i * 2 + 2]::double as b from p""")
def sample_frames(spark, folder):
    e = F.col("embedding")
    pair = lambda i: F.struct(F.get(e, F.lit(2 * i)).cast("double").alias("a"), F.get(e, F.lit(2 * i + 1)).cast("double").alias("b"))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("window_id"), F.array(*[pair(i) for i in range(32)]).alias("frames"))
    return D.frames_of_samples(rows, "frames")


#: One class for each component of a vector.
CLASSES = ("background", *(f"c{i}" for i in range(1, 64)))
CLASS_SQL = "case list_position(x, top) when 1 then 'background' else 'c' || (list_position(x, top) - 1) end"


@query("scores_argmax", f"""
with s as (select vec_id, embedding::double[] as x from embeddings),
t as (select *, list_max(x) as top from s)
select vec_id, {CLASS_SQL} as action,
       cast(round(cast(round(1000000.0 / list_sum(list_transform(x, lambda v: exp(v - top)))) as bigint) / 1000.0) as bigint) as conf_milli
from t""")
def scores_argmax(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("scores"))
    scored = D.score_to_label(rows, "scores", CLASSES)
    return scored.select("vec_id", "action", F.round(F.col("conf_micro") / 1000.0).cast("long").alias("conf_milli"))


@query("label_normalize", f"""with {EVENTS_SQL}
select event_id, case k % 7 when 0 then null when 1 then 'block' when 2 then 'receive' when 3 then 'set' when 4 then 'attack' when 5 then 'serve' end as action
from ev""")
def label_normalize(spark, folder):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("ball", " Block", "RECEIVE\t", "set", " spike ", "Serve", "referee")]),
                       (F.col("k") % 7 + 1).cast("int"))
    return events(spark, folder).select("event_id", normalize_external(raw).alias("action"))


def models(spark, folder):
    """Each user names a model whose labels are the ones the user's events mention."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("ball", "Block", "receive ", "set", "spike", "serve")]), (F.col("k") % 6 + 1).cast("int"))
    named = events(spark, folder).select("user_id", (F.col("k") % 6).cast("string").alias("id"), label.alias("label")).distinct()
    return named.groupBy(F.col("user_id").alias("model_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("names"))


MODEL_SQL = f"""with {EVENTS_SQL}, d as (select distinct user_id as model_id, k % 6 as c from ev),
l as (select *, ['ball','Block','receive ','set','spike','serve'][c + 1] as label from d)"""


@query("model_labels", MODEL_SQL + " select model_id, string_agg(label, ',' order by c) as labels from l group by model_id")
def model_labels(spark, folder):
    return D.model_labels(models(spark, folder)).withColumn("labels", F.array_join("labels", ","))


@query("missing_capabilities", MODEL_SQL + """,
r as (select unnest(['block','receive','serve','set','spike']) as need)
select model_id, coalesce(string_agg(need, ',' order by need) filter (where not exists
  (select 1 from l where l.model_id = m.model_id and lower(trim(l.label)) = need)), '') as missing
from (select distinct model_id from d) m, r group by model_id""")
def missing_capabilities(spark, folder):
    return D.missing_capabilities(models(spark, folder)).withColumn("missing", F.array_join("missing", ","))


def _evaluation(spark, folder):
    """Annotations of the clean manifest against a prediction per record and its evidence."""
    annotations = M.check_manifest(manifest_rows(spark, folder, clean=True), video_root="/media")
    guess = F.element_at(F.array(*[F.lit(x) for x in ACTION_LABELS]), (F.col("k") % 7 + 1).cast("int"))
    base = events(spark, folder).withColumn("record_index", F.col("event_id") + 1)
    predictions = base.select("record_index", guess.alias("action"), (F.col("k") * 10_000).alias("conf_micro"))
    evidence = base.where("k % 2 = 0").select(
        "record_index",
        F.array(F.struct(F.col("k").cast("int").alias("frame_index"), F.col("event_type").alias("source_label"), guess.alias("action"),
                         (F.col("k") / 100.0).cast("double").alias("confidence"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("box_xyxy"))).alias("evidence"))
    return D.evaluation_rows(annotations, predictions, evidence)


EVALUATED = f"""with {manifest_sql(clean=True)},
e as (select *, ['background','serve','receive','set','attack','block','dig'][k % 7 + 1] as predicted_action from m),
r as (
  select record_index, video_path, s_us / 1000000.0::double as start_seconds, e_us / 1000000.0::double as end_seconds,
       {clock_sql('s_us')} as start_time, {clock_sql('e_us')} as end_time, split,
       case when k % 2 = 0 then 'near' else 'far' end as team_side,
       case when k % 5 = 0 then '' else cast(k % 20 as varchar) end as player_number,
       label as expected_action, predicted_action, k * 10000 / 1000000.0::double as confidence, label = predicted_action as correct,
       case when has_crop then '0,10,' || (k * 14 + 10) || ',700' else '' end as crop, k, event_type
  from e
)"""


@query("evaluation_rows", EVALUATED + """
select * exclude (k, event_type), case when k % 2 = 0 then event_type || predicted_action || k else '' end as evidence from r""")
def evaluation_rows(spark, folder):
    return _evaluation(spark, folder).withColumn("evidence", F.array_join(
        F.transform("evidence", lambda e: F.concat(e["source_label"], e["action"], e["frame_index"])), ","))


@query("evaluation_csv", EVALUATED + """
select record_index, case when correct then 'true' else 'false' end as correct, expected_action, start_time,
       case when k % 2 = 0 then '[{"frame_index":' || k || ',"source_label":"' || event_type || '","action":"' || predicted_action || '"' else '[' end as evidence
from r""")
def evaluation_csv(spark, folder):
    """Written as CSV with JSON evidence and read back."""
    path = write_evaluation_csv(_evaluation(spark, folder), scratch_path(spark, "evaluation"), bom=False)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(
        F.col("record_index").cast("long").alias("record_index"), "correct", "expected_action", "start_time",
        F.regexp_extract("evidence", r'^(\[(?:\{"frame_index":\d+,"source_label":"\w+","action":"\w+")?)', 1).alias("evidence"))


DETECTED = EVALUATED + f""",
{LINES_SQL.replace("select l_orderkey as window_id,", "select l_orderkey as window_id, l_quantity,")},
o as (select *, list_position(['background','serve','receive','set','attack','block','dig'], action) as ord from d),
wn as (select window_id, action, conf_micro, row_number() over (partition by window_id order by conf_micro desc, ord, frame_index, l_partkey, l_suppkey, price) as rn
      from o where conf_micro >= 250000 and ord is not null),
ed as (select window_id, string_agg(frame_index || '| ' || upper(action) || '|' || action || '|' || conf_micro || '|' || cast(l_quantity as bigint) || '|0|' || cast(l_quantity + 1 as bigint) || '|2', ','
       order by frame_index, l_partkey, l_suppkey, price) as evidence from d group by window_id),
dr as (
  select r.* exclude (predicted_action, confidence, correct, k, event_type), coalesce(wn.action, 'background') as predicted_action,
         coalesce(wn.conf_micro, 0) / 1000000.0::double as confidence, r.expected_action = coalesce(wn.action, 'background') as correct,
         coalesce(ed.evidence, '') as evidence
  from r left join wn on wn.window_id = r.record_index and rn = 1 left join ed on ed.window_id = r.record_index
)"""


def detected(spark, folder):
    annotations = M.check_manifest(manifest_rows(spark, folder, clean=True), video_root="/media")
    return evaluate_detections(annotations, line_detections(spark, folder), confidence_threshold=0.25, order=ORDER)


@query("evaluate_detections", DETECTED + " select * from dr")
def evaluate_detections_query(spark, folder):
    """Winner and whole evidence of every annotated window."""
    whole = lambda x: F.floor(x).cast("bigint")
    item = lambda e: F.concat_ws(
        "|", e["frame_index"], e["source_label"], e["action"], F.round(e["confidence"] * 1e6).cast("bigint"), *[whole(e["box_xyxy"][i]) for i in range(4)])
    return detected(spark, folder).withColumn("evidence", F.array_join(F.transform("evidence", item), ","))


@query("evaluation_report", DETECTED + """,
p as (select 'strict' as metric_set, expected_action as t, predicted_action as p from dr union all
      select 'compatible', case when expected_action = 'dig' then 'receive' else expected_action end, case when predicted_action = 'dig' then 'receive' else predicted_action end from dr),
l as (select metric_set, unnest(case when metric_set = 'strict' then ['background','serve','receive','set','attack','block','dig'] else ['background','serve','receive','set','attack','block'] end) as label
      from (select distinct metric_set from p)),
c as (select l.metric_set, label, count(*) filter (where t = label and p = label)::double as tp, count(*) filter (where t = label)::double as support,
             count(*) filter (where p = label)::double as predicted from l join p using (metric_set) group by 1, 2),
s as (select *, case when predicted = 0 then 0 else tp / predicted end as precision, case when support = 0 then 0 else tp / support end as recall from c),
f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from s),
v as (
  select metric_set, unnest(['precision','recall','f1','support']) as metric, label, unnest([precision, recall, f1, support]) as value from f
  union all select metric_set, unnest(['samples','accuracy','macro_f1']), '', unnest([sum(support), sum(tp) / sum(support), avg(f1)]) from f group by metric_set
)
select metric_set, metric, label, round(value, 9) as value, (select count(*) from dr) as records from v""")
def evaluation_report(spark, folder):
    """The report written and read back: both metric sets beside the number of records."""
    path = write_report(detected(spark, folder), scratch_path(spark, "report"), settings={"confidence_threshold": 0.25}, manifest={})
    whole = "struct<samples:double,accuracy:double,macro_f1:double,per_class:map<string,map<string,double>>>"
    head = spark.read.text(f"{path}/head").select(F.from_json("value", f"metrics map<string,{whole}>").alias("h"))
    sets = head.select(F.explode("h.metrics").alias("metric_set", "m"))
    single = sets.select("metric_set", F.explode(F.create_map(*[x for m in ("samples", "accuracy", "macro_f1") for x in (F.lit(m), F.col(f"m.{m}"))])).alias("metric", "value"), F.lit("").alias("label"))
    classes = sets.select("metric_set", F.explode("m.per_class").alias("label", "scores")).select("metric_set", "label", F.explode("scores").alias("metric", "value"))
    records = spark.read.json(f"{path}/records").agg(F.count(F.lit(1)).alias("records"))
    return single.unionByName(classes).withColumn("value", F.round("value", 9)).join(F.broadcast(records), F.lit(True))


@query("scored_events", islands_sql(EVENTS_SQL + f""",
sc as (select e.user_id, e.event_id, e.start_us, e.end_us, v.embedding::double[] as x
       from ev e join embeddings v on v.vec_id = e.event_id % (select count(*) from embeddings)),
st as (select *, list_max(x) as top from sc),
w as (select cast(user_id as varchar) as video_id, event_id as ordinal, start_us, end_us, {CLASS_SQL} as action,
             cast(round(1000000.0 / list_sum(list_transform(x, lambda v: exp(v - top)))) as bigint) as conf_micro from st)""",
    0, HOUR, 60_000_000) + f"""
select video_id, format('evt_{{:06d}}', event_no) as event_id, {half_even_sql('start_us', '1000')} as start_ms,
       {half_even_sql('end_us', '1000')} as end_ms, action, {half_even_sql('conf_sum', 'n_windows')} as conf_micro from merged""")
def scored_events(spark, folder):
    """Score arrays of all components to labels to events with their confidence."""
    e = events(spark, folder)
    grid = e.select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("ordinal"), "start_us", "end_us")
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("scores"))
    many = vectors.count()
    scores = e.select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("ordinal"),
                      (F.col("event_id") % many).alias("vec_id")).join(vectors, "vec_id")
    made, _ = infer_events(score_windows(grid, scores, CLASSES), model_version="m1",
                           confidence_threshold=0.0, merge_gap_seconds=3600.0, min_event_seconds=60.0)
    return made.select("video_id", "event_id", "start_ms", "end_ms", "action", F.round(F.col("confidence") * 1_000_000).cast("long").alias("conf_micro"))


@query("run_record", "select count(*) as events, cast(sum(event_id) as bigint) as id_sum from events")
def run_record(spark, folder):
    """A run record written as one JSON object and read back."""
    head = table(spark, folder, "events").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("id_sum"))
    path = write_record(spark, head.first().asDict(), scratch_path(spark, "record"))
    back = read_record(spark, path)
    return spark.createDataFrame([(back["events"], back["id_sum"])], "events long, id_sum long")
