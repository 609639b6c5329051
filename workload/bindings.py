"""How the driver tables are read as windows, manifests, evaluations and tracks, each
once as a DataFrame and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actiongrid.functions.numbers import int_div
from actiongrid.plans.literal import mapped

from .registry import table

# Event types of the tables read as actions.
ACTION_OF = {"view": "background", "click": "serve", "purchase": "attack", "signup": "set", "error": "dig"}
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01
HOUR = 3_600_000_000

ACTION_SQL = (
    "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in ACTION_OF.items()) + " end"
)
K_SQL = "cast(regexp_extract(props, '\"k\": (\\d+)', 1) as bigint)"


def micros(column: str, epoch: str = "2024-01-01") -> Column:
    """Microseconds since `epoch` of a zone-free timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{epoch} 00:00:00', {column})")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with its integer `k`, start and end."""
    start = micros("ts")
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props", "ts")
    return rows.select(
        "event_id", "user_id", "event_type", "value",
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("long").alias("k"),
        start.alias("start_us"),
        (start + F.floor(F.col("value") * 60) * 1_000_000).alias("end_us"),
        mapped("event_type", ACTION_OF).alias("action"),
    )


EVENTS_SQL = f"""
ev as (
  select event_id, user_id, event_type, value, {K_SQL} as k,
         epoch_us(ts) - {EPOCH_US} as start_us,
         epoch_us(ts) - {EPOCH_US} + cast(floor(value * 60) as bigint) * 1000000 as end_us,
         {ACTION_SQL} as action
  from events
)"""


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("ordinal"),
        "start_us", "end_us", "action", (F.col("k") * 10_000).alias("conf_micro"),
    )


WINDOWS_SQL = EVENTS_SQL + """,
w as (
  select cast(user_id as varchar) as video_id, event_id as ordinal, start_us, end_us, action,
         k * 10000 as conf_micro
  from ev
)"""


def lineitem_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of a supplier as windows of a video."""
    start = micros("l_shipdate", "1990-01-01") + (
        F.pmod(F.col("l_orderkey") * 97 + F.col("l_linenumber") * 13, F.lit(86_400)) * 1_000_000
    )
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    return lines.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("video_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("ordinal"),
        start.alias("start_us"),
        (start + F.col("l_quantity").cast("long") * HOUR).alias("end_us"),
        F.when(F.col("l_returnflag") == "A", "attack").when(F.col("l_returnflag") == "R", "receive")
        .otherwise(F.when(F.col("l_linestatus") == "O", "background").otherwise("set")).alias("action"),
        (F.round(F.col("l_discount") * 100).cast("long") * 100_000).alias("conf_micro"),
    )


LINEITEM_WINDOWS_SQL = f"""
w0 as (
  select concat('s', l_suppkey) as video_id,
         (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as ordinal,
         epoch_us(l_shipdate) - epoch_us(timestamp '1990-01-01')
           + ((l_orderkey * 97 + l_linenumber * 13) % 86400) * 1000000 as start_us,
         cast(l_quantity as bigint) * {HOUR} as length_us,
         case when l_returnflag = 'A' then 'attack' when l_returnflag = 'R' then 'receive'
              when l_linestatus = 'O' then 'background' else 'set' end as action,
         cast(round(l_discount * 100) as bigint) * 100000 as conf_micro
  from lineitem
),
w as (select video_id, ordinal, start_us, start_us + length_us as end_us, action, conf_micro from w0)"""


def islands_sql(prelude: str, threshold: int, gap_us: int, min_us: int) -> str:
    """Independent restatement of the merge as SQL: CTE `merged`."""
    return f"""
with {prelude},
usable as (
  select * from w where action <> 'background' and conf_micro >= {threshold} and end_us > start_us
),
turns as (
  select *, case when action is distinct from lag(action) over o then 1 else 0 end as turn
  from usable window o as (partition by video_id order by start_us, end_us, ordinal)
),
runs as (
  select *, sum(turn) over (partition by video_id order by start_us, end_us, ordinal
                            rows unbounded preceding) as run from turns
),
marks as (
  select *, case when start_us <= max(end_us) over (partition by video_id, run
      order by start_us, end_us, ordinal rows between unbounded preceding and 1 preceding) + {gap_us}
      then 0 else 1 end as opens from runs
),
isles as (
  select *, sum(opens) over (partition by video_id order by start_us, end_us, ordinal
                             rows unbounded preceding) as isle from marks
),
folded as (
  select video_id, isle, min(action) as action, min(start_us) as start_us, max(end_us) as end_us,
         cast(sum(conf_micro) as bigint) as conf_sum, count(*) as n_windows
  from isles group by video_id, isle
),
merged as (
  select video_id, row_number() over (partition by video_id order by isle) as event_no,
         start_us, end_us, action, conf_sum, n_windows
  from folded where end_us - start_us >= {min_us}
)"""


def half_even_sql(a: str, b: str) -> str:
    return (
        f"(({a}) // ({b}) + case when 2 * (({a}) % ({b})) > ({b}) or "
        f"(2 * (({a}) % ({b})) = ({b}) and (({a}) // ({b})) % 2 = 1) then 1 else 0 end)"
    )


def clock_sql(us: str) -> str:
    c = half_even_sql(us, "10000")
    return (
        f"printf('%02d:%02d:%02d.%02d', ({c}) // 360000, (({c}) // 6000) % 60, (({c}) // 100) % 60, ({c}) % 100)"
    )


def clock_of_seconds_sql(seconds: str) -> str:
    """Time code of double seconds; ties and near ties follow the double product."""
    c = f"cast(round_even(({seconds}) * 100, 0) as bigint)"
    return f"printf('%02d:%02d:%02d.%02d', {c} // 360000, ({c} // 6000) % 60, ({c} // 100) % 60, {c} % 100)"


# --- manifests ---------------------------------------------------------------------

BAD = 97  # every 97th event gives a broken row


def manifest_rows(spark: SparkSession, folder: str, *, clean: bool = False) -> DataFrame:
    """Events as text rows of a manifest. Broken rows are injected unless `clean`; their
    kind follows from k."""
    e = events(spark, folder)
    bad = F.lit(False) if clean else (F.col("event_id") % BAD == 0)
    kind = F.col("k") % 8
    start, end = F.col("start_us"), F.col("end_us") + 1_000_000
    text = lambda us: F.concat(
        int_div(us, 1_000_000).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0")
    )
    by_user, by_event = F.col("user_id") % 10, F.col("event_id") % 10
    split = lambda m: F.when(m < 7, "train").when(m < 9, "val").otherwise("test")
    has_crop = F.col("k") % 3 == 0
    crop = lambda v: F.when(has_crop, v.cast("string")).otherwise(F.lit(""))
    return e.select(
        (F.col("event_id") + 1).alias("record_index"),
        F.when(bad & (kind == 0), "  ").otherwise(F.concat(F.lit("clips/../u"), F.col("user_id"), F.lit(".mp4"))).alias("video_path"),
        F.when(bad & (kind == 1), "x1").when(bad & (kind == 2), "nan").otherwise(text(start)).alias("start_seconds"),
        F.when(bad & (kind == 3), "0").otherwise(text(end)).alias("end_seconds"),
        F.when(bad & (kind == 4), "spike").otherwise(F.concat(F.lit(" "), F.col("action"))).alias("label"),
        F.when(bad & (kind == 5), "dev").otherwise(F.upper(split(by_user if clean else by_event))).alias("split"),
        F.when(F.col("k") % 2 == 0, "near").otherwise("far").alias("team_side"),
        F.when(F.col("k") % 5 == 0, "").otherwise((F.col("k") % 20).cast("string")).alias("player_number"),
        F.when(bad & (kind == 6), F.lit("")).otherwise(crop(F.lit(0))).alias("crop_x1"),
        crop(F.lit(10)).alias("crop_y1"),
        F.when(bad & (kind == 7), crop(F.lit(-5))).otherwise(crop(F.col("k") * 14 + 10)).alias("crop_x2"),
        crop(F.lit(700)).alias("crop_y2"),
        F.concat(F.lit("n"), F.col("k"), F.when(F.col("k") % 4 == 0, "; Reviewer note: see this ").otherwise("")).alias("notes"),
    )


def manifest_sql(*, clean: bool = False) -> str:
    """CTE `m`: the same rows, already typed, with their error codes in rule order."""
    bad = "false" if clean else f"(event_id % {BAD} = 0)"
    owner = "user_id" if clean else "event_id"
    return EVENTS_SQL + f""",
m0 as (
  select *, event_id + 1 as record_index, k % 8 as kind, {bad} as bad, k % 3 = 0 as has_crop,
         concat('/media/u', user_id, '.mp4') as good_path,
         case when {owner} % 10 < 7 then 'train' when {owner} % 10 < 9 then 'val' else 'test' end as good_split
  from ev
),
m as (
  select *,
    case when bad and kind = 0 then '/media' else good_path end as video_path,
    case when bad and kind in (1, 2) then null else start_us end as s_us,
    case when bad and kind = 3 then 0 else end_us + 1000000 end as e_us,
    case when bad and kind = 4 then 'spike' else action end as label,
    case when bad and kind = 5 then 'dev' else good_split end as split,
    case when not bad then null
         when kind = 0 then 'empty_path' when kind = 1 then 'bad_time' when kind = 2 then 'not_finite'
         when kind = 3 then 'bad_order' when kind = 4 then 'unknown_label' when kind = 5 then 'bad_split'
         when kind = 6 and has_crop then 'crop_incomplete'
         when kind = 7 and has_crop then 'crop_invalid' end as code
  from m0
)"""


def media(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per user: 30 fps and a length that ends near the 99th part of the last window,
    so some annotations end after their video."""
    ends = events(spark, folder).groupBy("user_id").agg(F.max("end_us").alias("last_us"))
    return ends.select(
        F.concat(F.lit("/media/u"), F.col("user_id"), F.lit(".mp4")).alias("video_path"),
        F.col("user_id").cast("string").alias("video_id"),
        F.lit(30.0).alias("fps"),
        F.when(F.col("user_id") % 13 == 0, 0).otherwise(int_div(F.col("last_us") * 30, 1_000_000)).cast("long").alias("frame_count"),
        F.lit(1280).alias("width"), F.lit(720).alias("height"),
    )


MEDIA_SQL = """
md as (
  select concat('/media/u', user_id, '.mp4') as video_path, cast(user_id as varchar) as video_id,
         cast(30.0 as double) as fps, (max(end_us) * 30) // 1000000 as frame_count, user_id
  from ev group by user_id having user_id % 13 <> 0
),
med as (select *, frame_count / fps as duration_seconds from md where frame_count > 0)"""


# --- evaluations -------------------------------------------------------------------

CLASSES = tuple(f"c{i}" for i in range(10))


def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding labels against a prediction that is wrong for a fixed part."""
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("label").alias("target"),
        F.when(F.col("vec_id") % 4 == 0, (F.col("label") + F.col("vec_id")) % 10).otherwise(F.col("label"))
        .cast("int").alias("prediction"),
    )


EVALUATION_SQL = """
ea as (
  select vec_id, label as target,
         cast(case when vec_id % 4 = 0 then (label + vec_id) % 10 else label end as integer) as prediction
  from embeddings
)"""


def action_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Events: the action against a label derived from k."""
    from actiongrid.domain import ACTION_LABELS

    guess = F.element_at(F.array(*[F.lit(x) for x in ACTION_LABELS]), (F.col("k") % 7 + 1).cast("int"))
    return events(spark, folder).select(
        "event_id", F.col("action").alias("expected_action"),
        F.when(F.col("k") % 3 == 0, guess).otherwise(F.col("action")).alias("predicted_action"),
    )


ACTION_EVALUATION_SQL = EVENTS_SQL + """,
ae as (
  select event_id, action as expected_action,
         case when k % 3 = 0 then ['background','serve','receive','set','attack','block','dig'][k % 7 + 1]
              else action end as predicted_action
  from ev
)"""
