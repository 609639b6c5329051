"""Generated windows and sample times, texts and numbers at the edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiongrid.functions import numbers as N
from actiongrid.functions import text as T
from actiongrid.operators import windows as W
from actiongrid.operators.inference import window_grid
from actiongrid.sources.media import media_table

from .bindings import EVENTS_SQL, MEDIA_SQL, WINDOWS_SQL, clock_sql, events, half_even_sql, media, windows
from .registry import query, table

SPAN_SQL = f"with {EVENTS_SQL}, sp as (select cast(user_id as varchar) as video_id, max(end_us) as d from ev group by user_id)"


def spans(spark, folder):
    return W.span_of(windows(spark, folder))


def grid_sql(window: int, stride: int) -> str:
    return f"""{SPAN_SQL},
n as (select *, case when d <= {window} then 1 else (d - {window}) // {stride} + 1 end as n_regular,
      case when d > {window} and ((d - {window}) // {stride}) * {stride} <> d - {window} then 1 else 0 end as tail from sp where d > 0),
g as (select video_id, d, n_regular, unnest(range(0, n_regular + tail)) as ordinal from n)
select video_id, ordinal,
       case when d <= {window} then 0 when ordinal < n_regular then ordinal * {stride} else d - {window} end as start_us,
       case when d <= {window} then d when ordinal < n_regular then ordinal * {stride} + {window} else d end as end_us
from g"""


@query("sliding_windows", grid_sql(21_600_000_000, 7_200_000_000))
def sliding_windows(spark, folder):
    return W.sliding_windows(spans(spark, folder), window_seconds=21_600.0, stride_seconds=7_200.0)


@query("sliding_windows_accumulated", f"""with recursive st(i, s) as (
  select 0::bigint, 0.0::double union all select i + 1, s + 7199.9::double from st where s <= 100000000.0),
{SPAN_SQL.removeprefix("with ")},
d as (select video_id, d / 1000000.0::double as d from sp where d > 0),
r as (select video_id, d, i, s from d join st on d > 21600.3::double and s <= d - 21600.3::double + 1e-9),
m as (select video_id, d, max(i) as i, max(s) as s from r group by 1, 2),
g as (
  select video_id, i as ordinal, s as a, s + 21600.3::double as b from r
  union all select video_id, i + 1, d - 21600.3::double, d from m where abs(s - (d - 21600.3::double)) > 1e-9 and d - 21600.3::double > 0
  union all select video_id, 0, 0.0, d from d where d <= 21600.3::double)
select video_id, ordinal, cast(round_even(a * 1e6, 0) as bigint) as start_us, cast(round_even(b * 1e6, 0) as bigint) as end_us from g""")
def sliding_windows_accumulated(spark, folder):
    """A stride that has no exact double: starts drift as they are added up."""
    return W.sliding_windows(spans(spark, folder), window_seconds=21_600.3, stride_seconds=7_199.9, accumulate=True)


@query("window_grid_counts", f"""with {EVENTS_SQL}, {MEDIA_SQL}
select video_id, case when duration_seconds <= 3600 then 1
  else floor((cast(round(duration_seconds * 1000000) as bigint) - 3600000000) / 1500000000)::bigint + 1
       + case when (cast(round(duration_seconds * 1000000) as bigint) - 3600000000) % 1500000000 <> 0 then 1 else 0 end end as n
from med""")
def window_grid_counts(spark, folder):
    made = window_grid(media_table(media(spark, folder)), window_seconds=3600.0, stride_seconds=1500.0)
    return made.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query("frame_times", f"""with {WINDOWS_SQL}, f as (select *, unnest(range(0, 6)) as frame_index from w where end_us > start_us)
select video_id, ordinal, cast(frame_index as integer) as frame_index,
       start_us * 12 + (2 * frame_index + 1) * (end_us - start_us) as sample_numerator,
       (start_us * 12 + (2 * frame_index + 1) * (end_us - start_us)) / 12000000.0::double as sample_seconds
from f""")
def frame_times(spark, folder):
    return W.frame_times(windows(spark, folder), 6).select("video_id", "ordinal", "frame_index", "sample_numerator", "sample_seconds")


@query("sheet_times", f"""with {EVENTS_SQL}, {MEDIA_SQL}, f as (select *, unnest(range(0, 9)) as sample from med)
select video_id, cast(sample as integer) as sample,
       least(duration_seconds / 10 * (sample + 1), greatest(duration_seconds - 1.0::double / fps, 0.0::double)) as time_seconds
from f""")
def sheet_times(spark, folder):
    return W.sheet_times(media_table(media(spark, folder)), 9)


BATCHES = f"""with {WINDOWS_SQL}, b as (
  select video_id, ordinal, (row_number() over (partition by video_id order by start_us, end_us, ordinal) - 1) // 8 as batch,
         count(*) over (partition by video_id) as total from w)
select video_id, ordinal, batch, least((batch + 1) * 8, total) as completed from b"""


@query("batch_groups", BATCHES)
def batch_groups(spark, folder):
    return W.batch_groups(windows(spark, folder), 8).select("video_id", "ordinal", "batch", "completed")


@query("batch_groups_hot_videos", BATCHES)
def batch_groups_hot_videos(spark, folder):
    return W.batch_groups(windows(spark, folder), 8, max_rows=75).select("video_id", "ordinal", "batch", "completed")


FILL = f"""with {EVENTS_SQL}, s as (select user_id, event_id, start_us, case when k >= 50 then event_type end as frame from ev),
f as (select *, last_value(frame ignore nulls) over (partition by user_id order by start_us, event_id rows unbounded preceding) as filled from s)
select user_id, event_id, filled, filled is null as missing_first from f"""


@query("forward_fill", FILL)
def forward_fill(spark, folder):
    samples = events(spark, folder).select(
        "user_id", "event_id", "start_us", F.when(F.col("k") >= 50, F.col("event_type")).alias("frame"))
    return W.forward_fill(samples, keys=["user_id"], order=["start_us", "event_id"], value="frame").select(
        "user_id", "event_id", "filled", "missing_first")


@query("timecodes", f"with {EVENTS_SQL} select event_id, {clock_sql('start_us')} as at, {clock_sql('end_us')} as until from ev")
def timecodes(spark, folder):
    return events(spark, folder).select(
        "event_id", T.timecode_us("start_us").alias("at"), T.timecode_us("end_us").alias("until"))


@query("timecodes_of_seconds", """select event_id,
  printf('%02d:%02d:%02d.%02d', c // 360000, (c // 6000) % 60, (c // 100) % 60, c % 100) as at
from (select event_id, cast(round(value * 100) as bigint) as c from events)""")
def timecodes_of_seconds(spark, folder):
    """The values have two decimals, so no tie can occur."""
    return table(spark, folder, "events").select("event_id", T.timecode("value").alias("at"))


@query("captions", """select event_id, printf('%02d:%02d.%02d', c // 6000, (c // 100) % 60, c % 100) as caption
from (select event_id, cast(round(value * 100) as bigint) as c from events)""")
def captions(spark, folder):
    return table(spark, folder, "events").select("event_id", T.caption("value").alias("caption"))


@query("seconds_text", f"""with {EVENTS_SQL}
select event_id, case when start_us % 1000000 = 0 then cast(start_us // 1000000 as varchar)
  else (start_us // 1000000) || '.' || rtrim(printf('%06d', start_us % 1000000), '0') end as exact,
  rtrim(rtrim(printf('%.10f', value), '0'), '.') as plain
from ev""")
def seconds_text(spark, folder):
    return events(spark, folder).select(
        "event_id", T.seconds_text_us("start_us").alias("exact"), T.seconds_text("value").alias("plain"))


@query("event_milliseconds", f"""with {EVENTS_SQL}
select event_id, {half_even_sql('start_us', '1000')} as start_ms, end_us - start_us as length_us from ev""")
def event_milliseconds(spark, folder):
    return events(spark, folder).select(
        "event_id", N.us_to_ms("start_us").alias("start_ms"), N.duration("start_us", "end_us").alias("length_us"))


@query("decimal_times", """select event_id, t, case when regexp_matches(t, '^\\d+(\\.\\d{1,3})?$') then cast(round(cast(t as double) * 1000) as bigint) end as ms,
  case when not regexp_matches(t, '^\\d+(\\.\\d{1,3})?$') then null when t not like '%.%' then 1000 when t like '%.__' then 10 else 1 end as precision_ms
from (select event_id, case when event_id % 3 = 0 then cast(event_id as varchar) when event_id % 3 = 1 then printf('%.2f', value) else printf('%.4f', value) end as t from events)""")
def decimal_times(spark, folder):
    text = F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).when(
        F.col("event_id") % 3 == 1, F.format_string("%.2f", "value")).otherwise(F.format_string("%.4f", "value"))
    ms, precision = T.decimal_ms("t")
    return table(spark, folder, "events").select("event_id", text.alias("t")).select(
        "event_id", "t", ms.alias("ms"), precision.alias("precision_ms"))


@query("time_lists", """select o_orderkey, case when o_custkey % 5 = 0 then null else cast((o_custkey % 90) + 0.5 + o_orderkey as double) end as total,
  case when o_custkey % 5 = 0 then null else 2 end as n from orders""")
def time_lists(spark, folder):
    cells = F.concat(F.col("o_custkey") % 90, F.lit(".5, ,"),
                     F.when(F.col("o_custkey") % 5 == 0, "-").otherwise(""), F.col("o_orderkey") + 1)
    times = T.parse_times("cells")
    known = table(spark, folder, "orders").select("o_orderkey", cells.alias("cells"), "o_custkey")
    return known.select("o_orderkey", times.alias("times")).select(
        "o_orderkey",
        (F.aggregate("times", F.lit(0.0), lambda a, x: a + x) - 1).alias("total"),
        F.when(F.col("times").isNotNull(), F.size("times")).alias("n"))


@query("crop_texts", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_partkey % 7 = 0 then '' else cast(q as varchar) || ',0,' || (q + 1 + l_partkey % 9) || ',' || (1 + l_linenumber) end as crop
from (select *, cast(l_quantity as bigint) as q from lineitem)""")
def crop_texts(spark, folder):
    q = F.col("l_quantity").cast("long")
    text = F.concat(q, F.lit(", 0,"), q + 1 + F.col("l_partkey") % 9, F.lit(" ,"),
                    F.when(F.col("l_partkey") % 7 == 0, -1).otherwise(1 + F.col("l_linenumber")))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.crop_text(T.parse_crop(text)).alias("crop"))


@query("resolved_paths", """select page_id, '/media/' || split_part(split_part(url, '//', 2), '/', 1) || '/u' || page_id || '.mp4' as path,
  'u' || page_id as video_id from pages""")
def resolved_paths(spark, folder):
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    path = F.concat(F.lit("./x//../"), host, F.lit("/a/.././u"), "page_id", F.lit(".mp4"))
    return table(spark, folder, "pages").select(
        "page_id", T.resolve_path(path, "/media").alias("path"), T.file_stem(path).alias("video_id"))


@query("reviewer_notes", """select doc_id, sha256(trim(regexp_extract(n, '(?is).*reviewer note:(.*)$', 1), e' \\t\\n\\r')) as sha256
from (select doc_id, case when doc_id % 4 = 0 then text else 'kept; Reviewer NOTE: first; reviewer note: ' || text || '  ' end as n from documents)""")
def reviewer_notes(spark, folder):
    note = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(
        F.concat(F.lit("kept; Reviewer NOTE: first; reviewer note: "), "text", F.lit("  ")))
    return table(spark, folder, "documents").select("doc_id", F.sha2(T.reviewer_note(note), 256).alias("sha256"))


@query("rounded_ratios", f"""
with r as (select o_custkey, count(*) as n, cast(sum(o_orderkey) as bigint) as s from orders group by o_custkey)
select o_custkey, {half_even_sql('s * 1000000', 'n')} / 1000000.0::double as mean from r""")
def rounded_ratios(spark, folder):
    """Quotients rounded half to even at six decimals."""
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))
    return rows.select("o_custkey", N.rounded_ratio("s", "n", 6).alias("mean"))
