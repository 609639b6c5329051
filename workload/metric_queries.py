"""Classification quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.domain import ACTION_LABELS, COMPATIBLE_LABELS
from actiongrid.operators import metrics as M

from .bindings import ACTION_EVALUATION_SQL, CLASSES, EVALUATION_SQL, EVENTS_SQL, action_evaluation, evaluation, events
from .registry import query, table

DENSE = """
cm as (
  select t.i as target, p.i as prediction,
         (select count(*) from ea where ea.target = t.i and ea.prediction = p.i) as n
  from (select cast(unnest(range(0, 10)) as integer) as i) t, (select cast(unnest(range(0, 10)) as integer) as i) p
),
pc as (
  select c.i as class,
         (select cast(sum(n) as bigint) from cm where target = c.i and prediction = c.i) as tp,
         (select cast(sum(n) as bigint) from cm where target = c.i) as support,
         (select cast(sum(n) as bigint) from cm where prediction = c.i) as predicted
  from (select cast(unnest(range(0, 10)) as integer) as i) c
),
pr as (
  select *, coalesce(tp::double / nullif(predicted, 0), 0) as precision, coalesce(tp::double / nullif(support, 0), 0) as recall from pc
),
ps as (
  select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pr
)"""
MATRIX = f"with {EVALUATION_SQL}, {DENSE} "


def matrix(spark, folder):
    return M.confusion(evaluation(spark, folder), CLASSES)


@query("confusion_matrix", MATRIX + "select * from cm")
def confusion_matrix(spark, folder):
    return matrix(spark, folder)


@query("confusion_quality_toxic", """
select t.i as target, p.i as prediction,
       (select count(*) from labels where quality = t.i and toxic = p.i) as n
from (select cast(unnest(range(0, 2)) as integer) as i) t, (select cast(unnest(range(0, 2)) as integer) as i) p""")
def confusion_quality_toxic(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("quality").alias("target"), F.col("toxic").alias("prediction"))
    return M.confusion(rows, ("low", "high"))


@query("class_index_faults", "select doc_id, quality as target, quality + toxic as prediction from labels where quality + toxic not between 0 and 1")
def class_index_faults(spark, folder):
    rows = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("target"), (F.col("quality") + F.col("toxic")).alias("prediction"))
    return M.out_of_domain(rows, 2)


@query("per_class_counts", MATRIX + "select * from pc")
def per_class_counts(spark, folder):
    return M.per_class_counts(matrix(spark, folder))


@query("per_class_scores", MATRIX + "select class, 'c' || class as label, tp, support, predicted, precision, recall, f1 from ps")
def per_class_scores(spark, folder):
    return M.per_class(matrix(spark, folder), CLASSES)


@query("eval_summary", MATRIX + """
select cast(sum(support) as bigint) as samples, cast(sum(tp) as bigint) as correct,
       sum(tp)::double / sum(support) as accuracy, cast(round(sum(f1) / 10 * 1000000) as bigint) as macro_f1_micro
from ps""")
def eval_summary(spark, folder):
    return M.summary(matrix(spark, folder), CLASSES).select(
        "samples", "correct", "accuracy", F.round(F.col("macro_f1") * 1_000_000).cast("long").alias("macro_f1_micro"))


@query("strict_eval", f"""with {ACTION_EVALUATION_SQL},
d as (select unnest(['background','serve','receive','set','attack','block','dig']) as label, unnest(range(0, 7)) as i)
select cast(t.i as integer) as target, cast(p.i as integer) as prediction,
       (select count(*) from ae where expected_action = t.label and predicted_action = p.label) as n
from d t, d p""")
def strict_eval(spark, folder):
    return M.evaluate(action_evaluation(spark, folder))["strict"]


@query("compat_eval", f"""with {ACTION_EVALUATION_SQL},
d as (select unnest(['background','serve','receive','set','attack','block']) as label, unnest(range(0, 6)) as i),
r as (select case expected_action when 'dig' then 'receive' else expected_action end as e,
             case predicted_action when 'dig' then 'receive' else predicted_action end as g from ae)
select t.label, (select count(*) from r where e = t.label) as support,
       (select count(*) from r where e = t.label and g = t.label) as tp,
       (select count(*) from r where g = t.label) as predicted
from d t""")
def compat_eval(spark, folder):
    m = M.evaluate(action_evaluation(spark, folder))["compatible"]
    return M.per_class(m, COMPATIBLE_LABELS).select("label", "support", "tp", "predicted")


@query("correct_flag", f"with {ACTION_EVALUATION_SQL} select *, expected_action = predicted_action as correct from ae")
def correct_flag(spark, folder):
    return M.correct_flag(action_evaluation(spark, folder), "expected_action", "predicted_action")


@query("top_errors", MATRIX + """
select target, prediction, 'c' || target as target_label, 'c' || prediction as predicted_label, n
from cm where target <> prediction and n > 0 order by n desc, target, prediction limit 3""")
def top_errors(spark, folder):
    return M.top_errors(matrix(spark, folder), CLASSES)


@query("class_weights", f"""with {EVENTS_SQL},
d as (select unnest(['background','serve','receive','set','attack','block','dig']) as label, unnest(range(0, 7)) as i),
c as (select d.i, d.label, (select count(*) from ev where action = d.label) as n from d)
select cast(i as integer) as ordinal, label, n,
       case when n > 0 then (select count(*) from ev) / (7.0::double * n) else 0.0::double end as weight from c""")
def class_weights(spark, folder):
    return M.class_weights(events(spark, folder), ACTION_LABELS, label="action")


@query("epoch_losses", f"""with {EVENTS_SQL}
select user_id % 20 as epoch, cast(sum(k) as bigint) as samples,
       coalesce(sum(cast(event_id % 7 as double) * k) / nullif(sum(k), 0), 0) as loss
from ev group by user_id % 20""")
def epoch_losses(spark, folder):
    batches = events(spark, folder).select(
        (F.col("user_id") % 20).alias("epoch"), (F.col("event_id") % 7).cast("double").alias("loss"), F.col("k").alias("samples"))
    return M.epoch_losses(batches)


@query("best_epoch", f"""with {EVALUATION_SQL},
h as (select vec_id % 25 as epoch, count(case when target = prediction then 1 end)::double / count(*) as score from ea group by 1)
select epoch, score from h order by score desc, epoch limit 1""")
def best_epoch(spark, folder):
    history = evaluation(spark, folder).groupBy((F.col("vec_id") % 25).alias("epoch")).agg(
        (F.count_if(F.col("target") == F.col("prediction")).cast("double") / F.count(F.lit(1))).alias("score"))
    return M.best_epoch(history, score="score")


COMPARED = f"""with {EVALUATION_SQL},
old as (select vec_id, target, prediction from ea where target <> 3),
new as (select vec_id, target, case when vec_id % 8 = 0 then target else prediction end as prediction from ea where target <> 7),
"""


def _two_evaluations(spark, folder):
    rows = evaluation(spark, folder)
    better = F.when(F.col("vec_id") % 8 == 0, F.col("target")).otherwise(F.col("prediction"))
    return rows.where("target <> 3"), rows.where("target <> 7").withColumn("prediction", better)


@query("eval_compare", COMPARED + """
j as (select o.vec_id as a, n.vec_id as b, o.target = o.prediction as oh, n.target = n.prediction as nh
      from old o full join new n on o.vec_id = n.vec_id)
select count(case when a is not null and b is not null then 1 end) as shared,
       count(case when b is null then 1 end) as removed, count(case when a is null then 1 end) as added,
       count(a) as old_samples, count(b) as new_samples,
       count(case when oh then 1 end) as old_correct, count(case when nh then 1 end) as new_correct,
       count(case when not oh and nh then 1 end) as fixed, count(case when oh and not nh then 1 end) as broken
from j""")
def eval_compare(spark, folder):
    old, new = _two_evaluations(spark, folder)
    return M.comparison_report(M.compare_evaluations(old, new, ["vec_id"]))


@query("score_deltas", COMPARED + """
d as (select unnest(range(0, 10)) as i),
c as (
  select i, (select count(*) from old where target = i and prediction = i) as tp1, (select count(*) from old where target = i) as s1,
         (select count(*) from old where prediction = i) as p1,
         (select count(*) from new where target = i and prediction = i) as tp2, (select count(*) from new where target = i) as s2,
         (select count(*) from new where prediction = i) as p2 from d
),
f as (select *, case when s1 + p1 > 0 then 2.0 * tp1 / (s1 + p1) else 0 end as f1, case when s2 + p2 > 0 then 2.0 * tp2 / (s2 + p2) else 0 end as f2 from c),
r as (
  select 'f1/c' || i as metric, f1 as a, f2 as b from f
  union all select 'macro_f1', sum(f1) / 10, sum(f2) / 10 from f
  union all select 'accuracy', sum(tp1) / sum(s1), sum(tp2) / sum(s2) from f
  union all select 'samples', sum(s1), sum(s2) from f
)
select metric, cast(round(a * 10000) as bigint) as old_value, cast(round(b * 10000) as bigint) as new_value from r""")
def score_deltas(spark, folder):
    old, new = _two_evaluations(spark, folder)
    deltas = M.score_deltas(M.confusion(old, CLASSES), M.confusion(new, CLASSES), CLASSES)
    return deltas.select("metric", *[F.round(F.col(c) * 10_000).cast("long").alias(c) for c in ("old_value", "new_value")])
