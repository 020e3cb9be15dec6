"""Queries over the driver tables that apply the operators, and the SQL that states their results."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lagstone.functions import grades, text
from lagstone.operators import correlate, matching, summary
from lagstone.operators import pairs as pair_ops
from lagstone.sources import files, probe, requests, sinks, wav_source
from lagstone.sources.requests import SyncRequest
from lagstone.sources.scratch import scratch_path
from lagstone.streaming import consume, runs

#: Hours of a head or tail, hours that one needs more than, and the milliseconds that an hour of the event series stands for.
SEGMENT, LEAST, UNIT = 168, 24, 10

# ---------------------------------------------------------------- tables and common parts


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hourly_ends(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """id, head, tail (the first and last ``segment`` values) and n of the events per hour of each user, from the first hour to the last.

    Counted before they are collected, so a user's row holds one entry an hour with events; the gaps are filled in the ends only, which
    is all that goes on from here.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    counts = events.where("ts IS NOT NULL AND user_id IS NOT NULL").groupBy("user_id", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    users = counts.groupBy(F.col("user_id").alias("id")).agg(F.collect_list("hour").alias("hours"), F.collect_list("n").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            hours, counts = (batch.column(k).values.to_numpy() for k in (1, 2))
            heads, tails, lengths = [], [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                h, n = hours[a:b], counts[a:b]
                first, last = int(h.min()), int(h.max())
                width = min(segment, last - first + 1)
                for out, begin in ((heads, first), (tails, last - width + 1)):
                    here = (h >= begin) & (h < begin + width)
                    out.append(np.bincount(h[here] - begin, n[here], width))
                lengths.append(last - first + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.float64())) for x in (heads, tails)), pa.array(lengths, pa.int64())], names=["id", "head", "tail", "n"])

    return users.mapInArrow(run, "id long, head array<double>, tail array<double>, n long")


def _neighbours(ends: DataFrame) -> DataFrame:
    """p_id, s_id and the ends of series with ids k and k + 1: each series' ends are made once and sent to both pairs that it belongs to."""
    x = F.struct("head", "tail", "n")
    sides = ends.select(F.explode(F.array(F.struct(F.col("id").alias("p_id"), x.alias("p"), F.lit(None).cast(_ENDS).alias("s")), F.struct((F.col("id") - 1).alias("p_id"), F.lit(None).cast(_ENDS).alias("p"), x.alias("s")))).alias("x")).select("x.*")
    pairs = sides.groupBy("p_id").agg(F.first("p", ignorenulls=True).alias("p"), F.first("s", ignorenulls=True).alias("s")).where("p IS NOT NULL AND s IS NOT NULL")
    return pairs.select("p_id", (F.col("p_id") + 1).alias("s_id"), *(F.col(f"{c}.{name}").alias(f"__{c}{name[0]}") for c in ("p", "s") for name in ("head", "tail", "n")))


_ENDS = "struct<head:array<double>,tail:array<double>,n:bigint>"
_SERIES_SQL = """
hourly AS (SELECT user_id AS id, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2),
spans AS (SELECT id, min(hour) AS first, max(hour) - min(hour) + 1 AS dur FROM hourly GROUP BY id),
series AS (SELECT s.id, g.i AS i, coalesce(h.n, 0) AS x, s.dur FROM spans s, LATERAL (SELECT unnest(range(0, s.dur)) AS i) g LEFT JOIN hourly h ON h.id = s.id AND h.hour = s.first + g.i)
"""


def _offsets_sql(exact: bool = False) -> str:
    between = f"greatest(0, p_dur - {SEGMENT}) - greatest(0, s_dur - {SEGMENT})" if exact else "p_dur - s_dur"
    return f"""WITH {_SERIES_SQL},
pairs AS (SELECT a.id AS p_id, b.id AS s_id, a.dur AS p_dur, b.dur AS s_dur, least(a.dur, b.dur, {SEGMENT}) AS n FROM spans a JOIN spans b ON b.id = a.id + 1),
parts AS (SELECT p_id, s_id, n, 'head' AS part, 0 AS p_off, 0 AS s_off FROM pairs UNION ALL SELECT p_id, s_id, n, 'tail', greatest(0, p_dur - {SEGMENT}), greatest(0, s_dur - {SEGMENT}) FROM pairs),
usable AS (SELECT * FROM parts WHERE n > {LEAST}),
p AS (SELECT u.p_id, u.s_id, part, x.i - p_off AS i, x.x - avg(x.x) OVER w AS c, stddev_pop(x.x) OVER w AS d FROM usable u JOIN series x ON x.id = u.p_id AND x.i >= p_off AND x.i < p_off + n WINDOW w AS (PARTITION BY u.p_id, u.s_id, part)),
s AS (SELECT u.p_id, u.s_id, part, x.i - s_off AS i, x.x - avg(x.x) OVER w AS c, stddev_pop(x.x) OVER w AS d FROM usable u JOIN series x ON x.id = u.s_id AND x.i >= s_off AND x.i < s_off + n WINDOW w AS (PARTITION BY u.p_id, u.s_id, part)),
corr AS (SELECT p_id, s_id, part, p.i - s.i AS lag, round(sum((CASE WHEN p.d > 1e-8 THEN p.c / p.d ELSE p.c END) * (CASE WHEN s.d > 1e-8 THEN s.c / s.d ELSE s.c END)), 6) AS r FROM p JOIN s USING (p_id, s_id, part) GROUP BY 1, 2, 3, 4),
best AS (SELECT p_id, s_id, part, lag FROM (SELECT *, row_number() OVER (PARTITION BY p_id, s_id, part ORDER BY r DESC, lag) AS k FROM corr) WHERE k = 1),
delays AS (SELECT q.p_id, q.s_id, CAST(h.lag * {UNIT} AS DOUBLE) AS start_delay_ms, CAST((t.lag + {between}) * {UNIT} AS DOUBLE) AS end_delay_ms,
  CASE WHEN n <= {LEAST} THEN 'Insufficient audio at start for analysis.' END AS error
  FROM pairs q LEFT JOIN best h ON h.p_id = q.p_id AND h.s_id = q.s_id AND h.part = 'head' LEFT JOIN best t ON t.p_id = q.p_id AND t.s_id = q.s_id AND t.part = 'tail')
"""


_CONFIDENCE_SQL = "CASE WHEN abs({0} - {1}) < 50 THEN 'high' WHEN abs({0} - {1}) < 500 THEN 'medium' ELSE 'low' END"


def sync_series_events(spark: SparkSession, d: str, *, exact: bool = False) -> DataFrame:
    """Offsets of the hourly event counts of neighbouring users, from head and tail, with confidence."""
    got = correlate.slice_offsets(_neighbours(hourly_ends(_t(spark, d, "events"))), rate=1000 / UNIT, segment=SEGMENT, least=LEAST, exact=exact)
    rounded = {c: F.round(c, 3) for c in ("start_delay_ms", "end_delay_ms")}
    return got.withColumns(rounded).select("p_id", "s_id", "start_delay_ms", "end_delay_ms", "error", grades.confidence("start_delay_ms", "end_delay_ms").alias("confidence"))


def tail_correction(spark: SparkSession, d: str) -> DataFrame:
    """The same with the tail corrected by the offsets that were used."""
    return sync_series_events(spark, d, exact=True)


def head_tail_slices(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and sums of heads and tails, and whether they suffice."""
    x = hourly_ends(_t(spark, d, "events"))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    return x.select("id", F.size("head").cast("long").alias("head_n"), F.size("tail").cast("long").alias("tail_n"), total("head").alias("head_sum"), total("tail").alias("tail_sum"), (F.size("head") > LEAST).alias("usable"))


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings")
    ids = e.select("vec_id")
    pairs = ids.select(F.col("vec_id").alias("p_id")).join(ids.select(F.col("vec_id").alias("s_id")), F.col("s_id") == F.col("p_id") + 1)
    return e, pairs


def xcorr_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e, pairs = _embeddings(spark, d)
    return correlate.lags_sql(e, pairs, id_col="vec_id", samples="embedding").select("p_id", "s_id", "lag")


def xcorr_embeddings_udf(spark: SparkSession, d: str) -> DataFrame:
    e, pairs = _embeddings(spark, d)
    return correlate.lags_arrow(e, pairs, id_col="vec_id", samples="embedding")


def batch_one_to_many(spark: SparkSession, d: str) -> DataFrame:
    """Every vector of a label against the label's first."""
    e = _t(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("s_id"), F.col("embedding").alias("s")), "vec_id").alias("one"))
    rows = e.join(first, "label").select(F.col("vec_id").alias("p_id"), F.col("one.s_id").alias("s_id"), F.col("embedding").cast("array<double>").alias("p"), F.col("one.s").cast("array<double>").alias("s"))
    return rows.select("p_id", "s_id", correlate.estimate_lag("p", "s").alias("lag"))


def degenerate_signals(spark: SparkSession, d: str) -> DataFrame:
    """Flat signals: the lag is the least possible, and says nothing."""
    flat = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.array_repeat(F.col("r_regionkey").cast("double"), 16).alias("x"))
    return flat.select("id", correlate.estimate_lag("x", "x").alias("lag"), correlate.degenerate(F.col("x")).alias("degenerate"))


def znorm_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sum and sum of squares of the normalised vectors."""
    x = _t(spark, d, "embeddings").select("vec_id", correlate.znormalise(F.col("embedding").cast("array<double>")).alias("z"))

    def total(f):
        return F.round(F.aggregate("z", F.lit(0.0), lambda a, v: a + f(v)), 4)

    return x.select("vec_id", (total(lambda v: v) + 0.0).alias("z_sum"), total(lambda v: v * v).alias("z_squares"))


def _xcorr_sql(pairs: str) -> str:
    return f"""WITH x AS (SELECT vec_id AS id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
z AS (SELECT id, i, CASE WHEN stddev_pop(v) OVER w > 1e-8 THEN (v - avg(v) OVER w) / stddev_pop(v) OVER w ELSE v - avg(v) OVER w END AS z FROM x WINDOW w AS (PARTITION BY id)),
pairs AS ({pairs}),
c AS (SELECT p_id, s_id, p.i - s.i AS lag, round(sum(p.z * s.z), 6) AS r FROM pairs JOIN z p ON p.id = p_id JOIN z s ON s.id = s_id GROUP BY 1, 2, 3)
SELECT p_id, s_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY p_id, s_id ORDER BY r DESC, lag) AS k FROM c) WHERE k = 1"""


_NEXT_SQL = "SELECT a.vec_id AS p_id, b.vec_id AS s_id FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_FIRST_SQL = "SELECT vec_id AS p_id, min(vec_id) OVER (PARTITION BY label) AS s_id FROM embeddings"

# ---------------------------------------------------------------- pairing

_URL = r"/([a-z]{2})/(\d+)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages with an even and with an odd id, as two lists of paths."""
    pages = _t(spark, d, "pages").select(F.col("url").alias("path"), "page_id")
    return pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")


def _lang_key():
    return matching.match_key(F.col("path"), r"/([a-z]{2})/")


def pair_regex_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one language and number, on any host: the last path of each key with the last copy of each."""
    pages = _t(spark, d, "pages")
    key = matching.match_key(F.col("path"), _URL)
    left, right = (matching.keyed(pages.select(c.alias("path")), key) for c in (F.col("url"), F.concat(F.col("url"), F.lit("#copy"))))
    return matching.join_keys(left, right).orderBy("primary_path", "secondary_path")


def pair_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return matching.join_keys(matching.keyed(a, _lang_key()), matching.keyed(b, _lang_key()))


def pair_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    a, b = (matching.first_wins(matching.keyed(x, _lang_key())) for x in _sides(spark, d))
    return a.withColumnRenamed("path", "primary_path").join(b.withColumnRenamed("path", "secondary_path"), "key").select("primary_path", "secondary_path")


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers as recordings of a series."""
    n = F.lpad((F.col("n") % 40).cast("string"), 2, "0")
    p = _t(spark, d, "customer").select(F.col("c_custkey").alias("n")).select(F.concat(F.lit("/video/Show S01E"), n, F.lit(" take "), F.col("n").cast("string"), F.lit(".mkv")).alias("path"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("n")).select(F.concat(F.lit("/audio/show_s01e"), n, F.lit("_dub"), F.col("n").cast("string"), F.lit(".aac")).alias("path"))
    return p, s


def pair_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Series names paired by the first pattern that meets."""
    return matching.pair_files(*_named(spark, d))


def pair_one_plan(spark: SparkSession, d: str) -> DataFrame:
    """The same as a single plan, with the rank of the pattern."""
    return matching.pair_in_one_plan(*_named(spark, d)).withColumn("pattern_rank", F.col("pattern_rank").cast("long"))


def pair_digits_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers with the same digits."""
    c = matching.keyed(_t(spark, d, "customer").select(F.col("c_name").alias("path")), matching.digits_key(F.col("path")))
    s = matching.keyed(_t(spark, d, "supplier").select(F.col("s_name").alias("path")), matching.digits_key(F.col("path")))
    return matching.join_keys(c, s)


def preview_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the first supplier of its padded key."""
    p, s = (x.select(text.basename("path").alias("name")) for x in _named(spark, d))
    return matching.preview(p, s)


def key_intersection(spark: SparkSession, d: str) -> DataFrame:
    a, b = (matching.keyed(x, _lang_key()).select("key").distinct() for x in _sides(spark, d))
    return a.intersect(b).select(F.get("key", F.lit(0)).alias("key"))


_NAMED_SQL = """p AS (SELECT '/video/Show S01E' || lpad(CAST(c_custkey % 40 AS VARCHAR), 2, '0') || ' take ' || c_custkey || '.mkv' AS path FROM customer),
s AS (SELECT '/audio/show_s01e' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0') || '_dub' || s_suppkey || '.aac' AS path FROM supplier)"""
_EPISODES_SQL = f"""WITH {_NAMED_SQL},
a AS (SELECT regexp_extract(path, '[Ss](\\d+)[Ee](\\d+)', 1) || '/' || regexp_extract(path, '[Ss](\\d+)[Ee](\\d+)', 2) AS key, max(path) AS path FROM p GROUP BY 1),
b AS (SELECT regexp_extract(path, '[Ss](\\d+)[Ee](\\d+)', 1) || '/' || regexp_extract(path, '[Ss](\\d+)[Ee](\\d+)', 2) AS key, max(path) AS path FROM s GROUP BY 1)"""


def _dedupe_sql(pick: str) -> str:
    side = "SELECT regexp_extract(url, '/([a-z]{{2}})/', 1) AS key, {0}(url) AS path FROM pages WHERE page_id % 2 = {1} AND regexp_matches(url, '/([a-z]{{2}})/') GROUP BY 1"
    return f"SELECT a.path AS primary_path, b.path AS secondary_path FROM ({side.format(pick, 0)}) a JOIN ({side.format(pick, 1)}) b USING (key)"


# ---------------------------------------------------------------- grades over order and shipping dates


def day_results(spark: SparkSession, d: str) -> DataFrame:
    """A result for each line of each order: the delays are days of shipping and of ordering after 1998; orders of low priority have no
    end delay yet, and some results have errors."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    rows = _t(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    day = F.to_date(F.lit("1998-01-01"))
    ordered = F.when(F.coalesce("o_orderpriority", F.lit("")) != "5-LOW", F.to_date("o_orderdate"))
    return rows.select(
        F.concat(F.lit("/v/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".mkv")).alias("primary_path"),
        F.concat(F.lit("/a/"), F.col("l_suppkey").cast("string"), F.lit(".aac")).alias("secondary_path"),
        F.date_diff(F.to_date("l_shipdate"), day).cast("double").alias("start_delay_ms"),
        F.date_diff(ordered, day).cast("double").alias("end_delay_ms"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "").alias("error"),
        F.col("l_orderkey").alias("elapsed_ms"),
        F.timestamp_seconds("l_orderkey").alias("completed_at"),
    )


def _graded_days(spark: SparkSession, d: str) -> DataFrame:
    return day_results(spark, d).withColumn("confidence", grades.confidence("start_delay_ms", "end_delay_ms"))


_DAYS_SQL = f"""r AS (SELECT '/v/' || l_orderkey || '-' || l_linenumber || '.mkv' AS primary_path, '/a/' || l_suppkey || '.aac' AS secondary_path, CAST(date_diff('day', DATE '1998-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS start_delay_ms,
  CASE WHEN coalesce(o_orderpriority, '') <> '5-LOW' THEN CAST(date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) END AS end_delay_ms, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN '' END AS error, l_orderkey AS elapsed_ms
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, {_CONFIDENCE_SQL.format("start_delay_ms", "end_delay_ms")} AS confidence FROM r)"""
_BAD_SQL = "coalesce(error, '') <> ''"


def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    return _graded_days(spark, d).select("primary_path", "secondary_path", grades.drift("start_delay_ms", "end_delay_ms").alias("drift"), "confidence")


def outlier_flag(spark: SparkSession, d: str) -> DataFrame:
    return day_results(spark, d).select("primary_path", "secondary_path", grades.outlier("start_delay_ms", "end_delay_ms").alias("is_outlier"))


def status_cli(spark: SparkSession, d: str) -> DataFrame:
    from lagstone.operators.pairs import report

    return report(day_results(spark, d))


def result_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.result_counts(_graded_days(spark, d))


def success_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.success_counts(day_results(spark, d))


def warn_any_low(spark: SparkSession, d: str) -> DataFrame:
    return summary.any_low(_graded_days(spark, d))


def filter_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    return summary.by_confidence(_graded_days(spark, d), "medium").orderBy("primary_path").select("primary_path", "secondary_path", "confidence")


def format_delay_ui(spark: SparkSession, d: str) -> DataFrame:
    x = day_results(spark, d).withColumn("ms", F.col("end_delay_ms") / 8)
    return x.select("primary_path", "secondary_path", text.format_delay("ms").alias("shown"), text.format_delay("ms", plus_zero=True, null="—").alias("shown_table"))


def format_delay_cli(spark: SparkSession, d: str) -> DataFrame:
    x = day_results(spark, d).withColumn("ms", F.col("end_delay_ms") / 8)
    return x.select("primary_path", "secondary_path", text.format_delay_cli("ms").alias("shown"))


# ---------------------------------------------------------------- sizes, paths, progress


def format_size(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.format_size(F.col("n_chars") * F.pow(F.lit(32), F.col("doc_id") % 6)).alias("size"))


def total_size_by_type(spark: SparkSession, d: str) -> DataFrame:
    return summary.total_size(_t(spark, d, "documents"), "lang", size="n_chars")


def unique_parent(spark: SparkSession, d: str) -> DataFrame:
    """The folder that all pages share, if there is one, and that all pages of each host, and of each host and language, do."""
    pages = _t(spark, d, "pages").select("url", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    by_host, by_both = (summary.unique_parent(pages, *by, path="url") for by in (("host",), ("host", "lang")))
    return summary.unique_parent(pages, path="url").unionByName(by_host, True).unionByName(by_both, True)


def basename_ext(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".MKV").when(F.col("page_id") % 3 == 1, ".eac3").otherwise(""))
    rows = _t(spark, d, "pages").select("page_id", page.alias("path"))
    return rows.select("page_id", text.basename("path").alias("name"), text.parent_folder("path").alias("parent"), text.has_extension("path", files.VIDEO_EXTENSIONS).alias("is_video"))


def progress_running(spark: SparkSession, d: str) -> DataFrame:
    """Processed, total and percent of each user's events in order."""
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return summary.progress(e, order="ts", by="user_id").select("event_id", "processed", "total", "percent")


def format_eta(spark: SparkSession, d: str) -> DataFrame:
    """Time left after each event of a user, from the time so far."""
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    first = F.min("ts").over(Window.partitionBy("user_id"))
    elapsed = ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 1000).cast("double")
    rows = summary.progress(e.withColumn("elapsed", elapsed), order="ts", by="user_id")
    return rows.select("event_id", text.format_eta(summary.eta_ms("elapsed", "processed", "total")).alias("eta"), text.seconds_text("elapsed").alias("seconds"))


def remove_selected(spark: SparkSession, d: str) -> DataFrame:
    return files.remove_ids(_t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels"), "doc_id")


def toggle_selection(spark: SparkSession, d: str) -> DataFrame:
    clicked = _t(spark, d, "documents").where("lang = 'fr'")
    return files.toggle(_t(spark, d, "labels"), clicked, "doc_id")


def probe_streams(spark: SparkSession, d: str) -> DataFrame:
    """Probes of events: the number in the properties decides what streams there are."""
    k = F.get_json_object("props", "$.k").cast("int")
    streams = F.when(k % 3 == 0, '[{"codec_type":"audio"},{"codec_type":"video"}]').when(k % 3 == 1, '[{"codec_type":"audio"}]').otherwise("[]")
    length = F.when(k % 5 == 0, "N/A").otherwise(k.cast("string"))
    json = F.when(k % 7 == 0, "not json").otherwise(F.concat(F.lit('{"streams":'), streams, F.lit(',"format":{"duration":"'), length, F.lit('"}}')))
    rows = _t(spark, d, "events").select("event_id", json.alias("json"))
    return probe.parse_probes(rows, keep=("event_id",))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest event."""
    return probe.latest(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), key="user_id").select("user_id", "event_id", "event_type")


def log_tail_200(spark: SparkSession, d: str) -> DataFrame:
    return summary.last_lines(_t(spark, d, "events").select("event_id", "ts", "event_type"), order="ts").select("event_id", "event_type")


# ---------------------------------------------------------------- history, sinks, streams


def _history(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as runs, their turns as results."""
    turn = F.struct(
        F.col("turn"), F.col("role").alias("videoFile"), F.lit("x").alias("audioFile"), F.col("turn").cast("double").alias("startDelay"), (F.col("turn") * F.lit(40.0)).alias("endDelay"), F.lit(None).cast("string").alias("error"), F.length("text").cast("long").alias("elapsed_ms")
    )
    runs_ = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    results = F.transform("turns", lambda t: F.struct(*(t.getField(n).alias(n) for n in ("videoFile", "audioFile", "startDelay", "endDelay", "error", "elapsed_ms"))))
    return runs_.select(F.col("conv_id").cast("string").alias("id"), F.timestamp_seconds(F.col("conv_id") * 3600).alias("date"), F.lit("series").alias("mode"), results.alias("results"), F.size("turns").cast("long").alias("fileCount"))


def history_top20(spark: SparkSession, d: str) -> DataFrame:
    return sinks.newest(_history(spark, d)).select("id", "fileCount")


def history_flatten(spark: SparkSession, d: str) -> DataFrame:
    return sinks.flatten_history(_history(spark, d)).select("id", "videoFile", "startDelay", "elapsed_ms")


def high_per_run(spark: SparkSession, d: str) -> DataFrame:
    return summary.high_per_run(_history(spark, d)).withColumn("high", F.col("high").cast("long"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results written as CSV and read back."""
    path = scratch_path(spark, "csv")
    sinks.write_csv(day_results(spark, d), path, sinks.CSV_EXPORT)
    names = ("video", "audio", "start_delay", "end_delay", "elapsed", "error")
    return sinks.read_csv(spark, path, sinks.CSV_EXPORT).toDF(*names)


def stream_file_drop(spark: SparkSession, d: str) -> DataFrame:
    """Event drops streamed through a projection; the result table is what a batch would give."""
    drops, out, marks = (scratch_path(spark, x) for x in ("drops", "out", "marks"))
    events = _t(spark, d, "events").select("event_id", "user_id", "value")
    events.where("event_id % 2 = 0").write.parquet(drops)
    events.where("event_id % 2 = 1").write.mode("append").parquet(drops)
    runs.stream_table(spark, drops, events.schema, lambda x: x.select("event_id", text.format_delay("value").alias("shown")), out, marks).awaitTermination()
    return spark.read.parquet(out)


#: What the runs over order and shipping dates were asked for.
_REQUEST = SyncRequest("series", video_folder="/v", audio_folder="/a", match_pattern="x")


def _days_run(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_events(day_results(spark, d), _REQUEST)


def _numbered_days(spark: SparkSession, d: str, path: str) -> tuple[DataFrame, int]:
    """The numbered results, kept under ``path``, and how many there are."""
    numbered = runs.numbered_results(day_results(spark, d), path)
    first = numbered.select("total").first()
    return numbered, first.total if first else 0


def _by_type(events: DataFrame) -> DataFrame:
    counts = {"with_elapsed": "elapsed_ms", "with_file": "file", "with_current": "current", "with_video": "videoFile", "with_message": "message"}
    sums = [F.sum(F.col(c).cast("long")).alias(f"{c}_sum") for c in ("percent", "processed", "total")]
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(n) for n, c in counts.items()), *sums, F.sum(F.size("results")).cast("long").alias("listed"))


def event_protocol(spark: SparkSession, d: str) -> DataFrame:
    """Rows by type of all events of a run over all results."""
    return _by_type(_days_run(spark, d))


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same written as lines, with blank lines and others that are no events between them, and read back; those have a null type."""
    path, ranges = scratch_path(spark, "lines"), scratch_path(spark, "ranges")
    runs.write_run(*_numbered_days(spark, d, ranges), _REQUEST, path, compression="gzip")
    files.remove(spark, ranges)
    _t(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("no event "), "n_name")).alias("value")).write.text(f"{path}/batch=1")
    return _by_type(requests.read_events(spark, f"{path}/*"))


def _lines_of_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a whole run, and those of one that is half done: a file has begun, another one's progress comes late, and a line is no event."""
    path, ranges = scratch_path(spark, "runs"), scratch_path(spark, "ranges")
    numbered, total = _numbered_days(spark, d, ranges)
    runs.write_run(numbered, total, _REQUEST, f"{path}/run=whole", compression="gzip")
    runs.write_run(numbered.where(F.col("processed") <= total // 2), total, _REQUEST, f"{path}/run=cut", closed=False, compression="gzip")
    files.remove(spark, ranges)
    more = [("file_start", "late.mkv", None), ("file_progress", "late.mkv", 50), ("file_progress", "old.mkv", 100)]
    more = spark.createDataFrame([(0, k, *x) for k, x in enumerate(more)], "number long, step int, type string, file string, percent int")
    runs.write_in_order(more, f"{path}/run=cut/batch=10")
    spark.createDataFrame([("no event",)], "value string").write.text(f"{path}/run=cut/batch=11")
    return requests.read_lines(spark, path).withColumn("run", F.substring_index(F.substring_index("line.file", "/run=", -1), "/", 1))


def consumed_state(spark: SparkSession, d: str) -> DataFrame:
    """What a viewer shows of both runs once it has taken in all their lines."""
    return consume.run_state(_lines_of_two_runs(spark, d), by=["run"])


def consumed_results(spark: SparkSession, d: str) -> DataFrame:
    """The results of both runs: those of done where it came, else those that came one by one."""
    return consume.run_results(_lines_of_two_runs(spark, d), by=["run"]).drop("line", "place")


def consumed_log(spark: SparkSession, d: str) -> DataFrame:
    """The last 200 log lines of both runs."""
    return consume.run_log(_lines_of_two_runs(spark, d), by=["run"])


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of missing recordings, streamed in three batches in two starts: the lines of the run by type, and how far the numbers go."""
    drops, out, marks = (scratch_path(spark, x) for x in ("drops", "out", "marks"))
    request = SyncRequest("series", video_folder="/v", audio_folder="/a", match_pattern="x")
    pairs = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("/none/"), "s_name", F.lit(".wav")).alias("primary_path"), F.lit("/none/a.wav").alias("secondary_path"))
    for k in range(3):
        pairs.where(F.col("s_suppkey") % 3 == k).drop("s_suppkey").coalesce(1).write.mode("append").parquet(drops)
        if k:
            runs.stream_pairs(spark, drops, out, marks, request=request, at_once=1).awaitTermination()
    runs.finish(spark, out, part=7)
    return _by_type(requests.read_lines(spark, f"{out}/events")).drop("with_elapsed")


def event_progress(spark: SparkSession, d: str) -> DataFrame:
    """The progress events of a run."""
    return runs.events_of(day_results(spark, d)).where("type = 'progress'").select("processed", "total", "current")


# ---------------------------------------------------------------- recordings, listings, layouts


def _recordings(spark: SparkSession, d: str) -> str:
    """A folder with a file for each nation, of as many bytes as its key; some are hidden, and there is a subfolder."""
    folder, k = scratch_path(spark, "recordings"), F.col("n_nationkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in (".mkv", ".wav", ".EAC3", ".txt"))), (k % 4 + 1).cast("int"))
    name = F.concat(F.when(k % 5 == 4, ".").otherwise(""), F.translate("n_name", " ", "_"), kind)
    rows = _t(spark, d, "nation").select(name.alias("name"), F.expr("CAST(repeat('x', CAST(n_nationkey AS INT)) AS BINARY)").alias("content"))
    files.write_files(rows, folder)
    files.write_files(rows.limit(0).unionByName(spark.createDataFrame([("in.mkv", bytearray(b"x"))], "name string, content binary")), f"{folder}/below")
    return folder


def list_recordings(spark: SparkSession, d: str) -> DataFrame:
    """The listings of one folder, by kind of listing."""
    folder = _recordings(spark, d)
    all_ = files.list_folder(spark, folder)
    given = [r.n_name for r in _t(spark, d, "nation").select("n_name").collect()]
    listings = {
        "entries": files.list_entries(spark, folder), "folder": all_, "audio": files.as_audio(all_), "batch": files.list_batch(spark, folder), "movies": files.list_movies(spark, folder),
        "explicit": files.list_movies(spark, folder, [f"/given/{n}.avi" for n in given]), "first": files.first_file(all_), "missing": files.list_folder(spark, f"{folder}/none"),
        "dropped": files.drop_files(files.as_audio(files.list_movies(spark, folder)), all_, mode="series", kind="audio"),
        "one dropped": files.drop_files(files.as_audio(files.list_movies(spark, folder)), all_, mode="movie", kind="audio"),
    }
    rows = [x.select(F.lit(k).alias("listing"), "name", "type", "size") for k, x in listings.items()]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    counted = files.count_by_extension(all_).select(F.lit("mp4 and mkv").alias("listing"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.col("n").alias("size"))
    return out.unionByName(counted)


@F.pandas_udf(BinaryType())
def _noise(seed: pd.Series, late: pd.Series, n: pd.Series) -> pd.Series:
    """WAV files of 16 bits at 8 kHz: ``n`` samples of the noise of a seed, whose content stands ``late`` samples later."""

    def one(k: int, s: int, m: int) -> bytes:
        x = np.random.default_rng(int(k)).integers(-8000, 8000, 26_000).astype("<i2")
        raw = io.BytesIO()
        with wave.open(raw, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(8000)
            f.writeframes(x[1000 - int(s) : 1000 - int(s) + int(m)].tobytes())
        return raw.getvalue()

    return pd.Series([one(*x) for x in zip(seed, late, n, strict=True)])


def wav_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A pair of recordings for each nation, the first of them late by a known time: too short for every fifth nation, and without a second
    file for every seventh."""
    folder, k = scratch_path(spark, "wav"), F.col("n_nationkey")
    name = F.translate("n_name", " ", "_")
    n = F.when(k % 5 == 1, 4000).otherwise(24_000)
    nation = _t(spark, d, "nation")
    first = nation.select(F.concat(F.lit("v_"), name, F.lit(".wav")).alias("name"), _noise(k, k * 7, n).alias("content"))
    second = nation.where("n_nationkey % 7 <> 3").select(F.concat(F.lit("a_"), name, F.lit(".wav")).alias("name"), _noise(k, F.lit(0), n).alias("content"))
    files.write_files(first.unionByName(second), folder)
    pairs = nation.select(F.concat(F.lit(f"{folder}/v_"), name, F.lit(".wav")).alias("primary_path"), F.concat(F.lit(f"{folder}/a_"), name, F.lit(".wav")).alias("secondary_path"))
    got = pair_ops.graded(pair_ops.process_pairs(pairs, segment=1.5))
    return got.select("primary_name", "secondary_name", "start_delay_ms", "end_delay_ms", "error", "degenerate", "confidence", "is_outlier", F.col("completed_at").isNotNull().alias("completed"))


@F.pandas_udf(BinaryType())
def _ramp(seconds: pd.Series, rate: pd.Series, width: pd.Series) -> pd.Series:
    """WAV files of so many seconds: sample k is k % 1000, as integers of 16 bits, or as floats (width 4) of k % 1000 / 32768."""

    def one(n: int, r: int, w: int) -> bytes:
        x = (np.arange(int(n) * int(r)) % 1000).astype("<i2")
        data = x.tobytes() if w == 2 else (x / 32768).astype("<f4").tobytes()
        head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1 if w == 2 else 3, 1, int(r), int(r * w), int(w), int(8 * w), b"data", len(data))
        return head + data

    return pd.Series([one(*x) for x in zip(seconds, rate, width, strict=True)])


def _ramps(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder and name and content of a file for each nation: every third holds 2 bytes of nothing, the others 1 to 5 seconds; the last third isn't written."""
    folder, k = scratch_path(spark, "ramps"), F.col("n_nationkey")
    rows = _t(spark, d, "nation").select(k.alias("k"), F.concat(F.translate("n_name", " ", "_"), F.lit(".wav")).alias("name"))
    content = F.when(F.col("k") % 3 == 1, F.lit(b"no")).otherwise(_ramp(F.col("k") % 5 + 1, F.lit(8000), F.when(F.col("k") % 2 == 0, 2).otherwise(4)))
    files.write_files(rows.where("k % 3 < 2").select("name", content.alias("content")), folder)
    return folder, rows


def probe_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Probes of recordings, of files that are none and of files that aren't there."""
    folder, rows = _ramps(spark, d)
    listed = rows.select("name", F.concat(F.lit(f"{folder}/"), "name").alias("path"))
    return probe.with_probes(listed, probe.probe_files(listed)).drop("path")


def wav_windows(spark: SparkSession, d: str) -> DataFrame:
    """The tails of recordings of over 2 seconds through the data source, and the sum of their samples."""
    folder, _ = _ramps(spark, d)
    wav_source.register(spark)
    windows = spark.read.format("wav_windows").option("path", folder).option("window", 1.5).load().where("part = 'tail' AND seconds > 2")
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 32768).cast("long"))
    return windows.select(text.basename("path").alias("name"), "part", "begin", "seconds", F.size("samples").cast("long").alias("n"), total.alias("total"))


def _styled(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Names that meet by the second pattern, by the third, by all digits, and not at all, as the digit of an extension counts."""
    n = F.col("n").cast("string")
    k = (F.col("n") % 40).cast("string")
    c, s = _t(spark, d, "customer").select(F.col("c_custkey").alias("n")), _t(spark, d, "supplier").select(F.col("s_suppkey").alias("n"))
    styles = {
        "cross": (("/v/Show ", n, " of 1x", k, ".mkv"), ("/a/dub", n, " 1x", k, ".aac")), "part": (("/v/Show.", k, ".take", n, ".mkv"), ("/a/dub_", k, "_by", n, ".aac")),
        "digits": (("/v/Show", n, ".mkv"), ("/a/dub", n, ".aac")), "none": (("/v/Show", n, ".mp4"), ("/a/dub", n, ".mp3")),
    }
    return {x: tuple(side.select(F.concat(*(F.lit(y) if isinstance(y, str) else y for y in parts)).alias("path")) for side, parts in zip((c, s), both, strict=True)) for x, both in styles.items()}


def _each_style(spark: SparkSession, d: str, pair) -> DataFrame:
    out = None
    for style, sides in _styled(spark, d).items():
        rows = pair(*sides).withColumn("style", F.lit(style))
        out = rows if out is None else out.unionByName(rows)
    return out


def waterfall_styles(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of names in four styles, each by its own step of the waterfall."""
    return _each_style(spark, d, lambda p, s: matching.pair_files(p, s).withColumn("step", F.lit(matching.choose_keys(p, s)[2])))


def one_plan_styles(spark: SparkSession, d: str) -> DataFrame:
    """The same as single plans, with the rank of the step."""
    return _each_style(spark, d, lambda p, s: matching.pair_in_one_plan(p, s).withColumn("pattern_rank", F.col("pattern_rank").cast("long")))


def preview_movie(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with one audio file, and with none."""
    p = _t(spark, d, "customer").select(F.concat("c_name", F.lit(".mkv")).alias("name"))
    return matching.preview_movie(p, "dub.aac").unionByName(matching.preview_movie(p, None))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Extensions, capitals, dates and matches that ignore case, of all pages and events."""
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".MKV").when(F.col("page_id") % 3 == 1, "/.Hidden").otherwise(""))
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("id"), text.extension(path).alias("a"), text.capitalise(text.basename("url")).alias("b"), text.contains_ignoring_case(F.upper("url"), "Example").alias("c"))
    events = _t(spark, d, "events").select(F.col("event_id").alias("id"), text.date_text(F.col("ts").cast("timestamp")).alias("a"), text.capitalise("event_type").alias("b"), text.contains_ignoring_case("event_type", "CLICK").alias("c"))
    return pages.withColumn("of", F.lit("page")).unionByName(events.withColumn("of", F.lit("event")))


def result_status(spark: SparkSession, d: str) -> DataFrame:
    return day_results(spark, d).select("primary_path", grades.result_status("error").alias("status"))


def probe_missing(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the probe of its properties; every third one has none."""
    names = F.col("event_id").cast("string").alias("path")
    probes = _t(spark, d, "events").where("event_id % 3 <> 0").select(names, F.lit('{"streams":[{"codec_type":"audio"}],"format":{"duration":"1.5"}}').alias("json"))
    return probe.with_probes(_t(spark, d, "events").select(names), probe.parse_probes(probes))


def csv_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Results in both console layouts, as files and as one file."""
    out = None
    for layout, one in ((sinks.CSV_SERIES, False), (sinks.CSV_MOVIE, True)):
        path = scratch_path(spark, "csv")
        sinks.write_csv(day_results(spark, d), path, layout, one_file=one)
        rows = sinks.read_csv(spark, path, layout).toDF("a", "b", "start_delay", "end_delay", "error").withColumn("layout", F.lit(layout[0]))
        out = rows if out is None else out.unionByName(rows)
    return out


def history_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All runs kept one after the other, of which 20 stay, and the ten that are shown; a missing history has none."""
    path, all_ = scratch_path(spark, "history"), _history(spark, d)
    none = requests.read_history(spark, path).select("id")
    sinks.keep_history(spark, path, all_.where("CAST(id AS BIGINT) % 2 = 0"))
    sinks.keep_history(spark, path, all_.where("CAST(id AS BIGINT) % 2 = 1"))
    kept = requests.read_history(spark, path)
    shown = sinks.newest(kept, 10).select("id")
    return kept.select("id", F.lit("kept").alias("list")).unionByName(shown.withColumn("list", F.lit("shown"))).unionByName(none.withColumn("list", F.lit("none")))


def history_export(spark: SparkSession, d: str) -> DataFrame:
    """The results of all runs written as CSV and read back."""
    path = scratch_path(spark, "export")
    sinks.export_history(_history(spark, d), path)
    return sinks.read_csv(spark, path, sinks.CSV_EXPORT).toDF("video", "audio", "start_delay", "end_delay", "elapsed", "error")


QUERIES = {
    f.__name__: f
    for f in (
        sync_series_events, tail_correction, head_tail_slices, xcorr_embeddings, xcorr_embeddings_udf, batch_one_to_many, degenerate_signals, znorm_stats, pair_regex_groups, pair_waterfall, pair_one_plan,
        pair_digits_fallback, pair_dedupe_last, pair_dedupe_first, preview_left_join, key_intersection, confidence_tiers, outlier_flag, status_cli, result_counts, success_counts, warn_any_low, filter_by_confidence,
        format_delay_ui, format_delay_cli, format_size, format_eta, progress_running, total_size_by_type, unique_parent, basename_ext, remove_selected, toggle_selection, probe_streams, history_top20,
        history_flatten, high_per_run, log_tail_200, upsert_latest, csv_round_trip, stream_file_drop, stream_progress, event_protocol, event_lines, consumed_state, consumed_results, consumed_log,
        event_progress, list_recordings, wav_pairs, probe_recordings, wav_windows, waterfall_styles, one_plan_styles, preview_movie, text_forms, result_status, probe_missing, csv_layouts, history_round_trip, history_export,
    )
}

_EVENTS_SQL = _DAYS_SQL + """,
o AS (SELECT *, row_number() OVER (ORDER BY elapsed_ms, primary_path, secondary_path) AS k, count(*) OVER () AS total FROM r),
x AS (SELECT type, percent, CASE WHEN type IN ('file_end', 'result') THEN elapsed_ms END AS e, CASE WHEN type LIKE 'file_%' THEN primary_path END AS f, CASE WHEN type = 'progress' THEN primary_path END AS c,
    CASE WHEN type = 'result' THEN primary_path END AS v, CASE WHEN type = 'progress' THEN k END AS p, CASE WHEN type = 'progress' THEN total END AS t
  FROM o, (VALUES ('file_start', NULL), ('file_progress', 0), ('file_progress', 50), ('file_progress', 100), ('file_end', NULL), ('progress', NULL), ('result', NULL)) s(type, percent)
  WHERE percent IS DISTINCT FROM 50 OR start_delay_ms IS NOT NULL),
by_type AS (SELECT type, count(*) AS n, count(e) AS with_elapsed, count(f) AS with_file, count(c) AS with_current, count(v) AS with_video, 0 AS with_message, CAST(sum(percent) AS BIGINT) AS percent_sum, CAST(sum(p) AS BIGINT) AS processed_sum,
    CAST(sum(t) AS BIGINT) AS total_sum, CAST(NULL AS BIGINT) AS listed FROM x GROUP BY type
  UNION ALL SELECT 'log', 4, 0, 0, 0, 0, 4, NULL, NULL, NULL, NULL UNION ALL SELECT 'done', greatest(1, CAST(ceil(count(*) / 10000.0) AS BIGINT)), 0, 0, 0, 0, 0, NULL, NULL, CAST(count(*) * greatest(1, ceil(count(*) / 10000.0)) AS BIGINT), count(*) FROM r),
lines AS (SELECT 'whole' AS run, k * 2 AS pos, 'Starting: ' || substr(primary_path, 4) AS message FROM o UNION ALL SELECT 'whole', k * 2 + 1, 'Finished: ' || substr(primary_path, 4) || ' (' || printf('%.1f', round(elapsed_ms / 1000.0, 1)) || 's)' FROM o)"""
_CUT_SQL = "(SELECT count(*) // 2 FROM r)"
_STYLES_SQL = """p AS (SELECT c_custkey AS n FROM customer), s AS (SELECT s_suppkey AS n FROM supplier),
a AS (SELECT 'cross' AS style, n % 40 AS key, '/v/Show ' || n || ' of 1x' || n % 40 || '.mkv' AS path FROM p UNION ALL SELECT 'part', n % 40, '/v/Show.' || n % 40 || '.take' || n || '.mkv' FROM p UNION ALL SELECT 'digits', n, '/v/Show' || n || '.mkv' FROM p),
b AS (SELECT 'cross' AS style, n % 40 AS key, '/a/dub' || n || ' 1x' || n % 40 || '.aac' AS path FROM s UNION ALL SELECT 'part', n % 40, '/a/dub_' || n % 40 || '_by' || n || '.aac' FROM s UNION ALL SELECT 'digits', n, '/a/dub' || n || '.aac' FROM s),
j AS (SELECT style, x.path AS primary_path, y.path AS secondary_path, CASE style WHEN 'cross' THEN '(\\d+)x(\\d+)' WHEN 'part' THEN '[._\\s-](\\d{1,3})[._\\s-]' ELSE 'digits' END AS step, CASE style WHEN 'cross' THEN 1 WHEN 'part' THEN 2 ELSE 3 END AS rank
  FROM (SELECT style, key, max(path) AS path FROM a GROUP BY 1, 2) x JOIN (SELECT style, key, max(path) AS path FROM b GROUP BY 1, 2) y USING (style, key))"""
_UI_SQL = "CASE WHEN ms IS NULL THEN '{1}' ELSE CASE WHEN ms {0} 0 THEN '+' ELSE '' END || printf('%.1fms', round(ms, 1)) END"
_CLI_SQL = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE printf('%+.1f', round_even({0}, 1)) END"
_PARENT_SQL = "nullif(regexp_extract(replace({0}, '\\', '/'), '^(.+)/[^/]*$', 1), '')"

ORACLES: dict[str, str] = {
    "sync_series_events": f"{_offsets_sql()} SELECT *, {_CONFIDENCE_SQL.format('start_delay_ms', 'end_delay_ms')} AS confidence FROM delays",
    "tail_correction": f"{_offsets_sql(True)} SELECT *, {_CONFIDENCE_SQL.format('start_delay_ms', 'end_delay_ms')} AS confidence FROM delays",
    "head_tail_slices": f"""WITH {_SERIES_SQL} SELECT id, CAST(least(max(dur), {SEGMENT}) AS BIGINT) AS head_n, CAST(least(max(dur), {SEGMENT}) AS BIGINT) AS tail_n,
      CAST(coalesce(sum(x) FILTER (i < {SEGMENT}), 0) AS DOUBLE) AS head_sum, CAST(coalesce(sum(x) FILTER (i >= dur - {SEGMENT}), 0) AS DOUBLE) AS tail_sum, least(max(dur), {SEGMENT}) > {LEAST} AS usable FROM series GROUP BY id""",
    "xcorr_embeddings": _xcorr_sql(_NEXT_SQL),
    "xcorr_embeddings_udf": _xcorr_sql(_NEXT_SQL),
    "batch_one_to_many": _xcorr_sql(_FIRST_SQL),
    "degenerate_signals": "SELECT r_regionkey AS id, CAST(-15 AS BIGINT) AS lag, true AS degenerate FROM region",
    "znorm_stats": """WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY 1)
      SELECT vec_id, round(sum(CASE WHEN sd > 1e-8 THEN (v - m) / sd ELSE v - m END), 4) + 0.0 AS z_sum, round(sum(pow(CASE WHEN sd > 1e-8 THEN (v - m) / sd ELSE v - m END, 2)), 4) AS z_squares FROM x JOIN s USING (vec_id) GROUP BY vec_id""",
    "pair_regex_groups": """WITH k AS (SELECT url, regexp_extract(url, '/([a-z]{2})/(\\d+)', 0) AS key FROM pages WHERE regexp_matches(url, '/([a-z]{2})/(\\d+)'))
      SELECT a.path AS primary_path, b.path AS secondary_path FROM (SELECT key, max(url) AS path FROM k GROUP BY key) a JOIN (SELECT key, max(url || '#copy') AS path FROM k GROUP BY key) b USING (key)""",
    "pair_waterfall": f"{_EPISODES_SQL} SELECT a.path AS primary_path, b.path AS secondary_path FROM a JOIN b USING (key)",
    "pair_one_plan": f"{_EPISODES_SQL} SELECT a.path AS primary_path, b.path AS secondary_path, CAST(0 AS BIGINT) AS pattern_rank FROM a JOIN b USING (key)",
    "pair_digits_fallback": """SELECT a.path AS primary_path, b.path AS secondary_path FROM (SELECT regexp_extract_all(c_name, '\\d+') AS key, max(c_name) AS path FROM customer GROUP BY 1) a
      JOIN (SELECT regexp_extract_all(s_name, '\\d+') AS key, max(s_name) AS path FROM supplier GROUP BY 1) b USING (key) WHERE len(key) > 0""",
    "pair_dedupe_last": _dedupe_sql("max"),
    "pair_dedupe_first": _dedupe_sql("min"),
    "preview_left_join": f"""WITH {_NAMED_SQL}, n AS (SELECT regexp_extract(path, '[^/]+$', 0) AS name, regexp_extract(path, '(?i)S(\\d+)E(\\d+)', 1) || '-' || regexp_extract(path, '(?i)S(\\d+)E(\\d+)', 2) AS key FROM p),
      m AS (SELECT min(regexp_extract(path, '[^/]+$', 0)) AS other, regexp_extract(path, '(?i)S(\\d+)E(\\d+)', 1) || '-' || regexp_extract(path, '(?i)S(\\d+)E(\\d+)', 2) AS key FROM s GROUP BY 2)
      SELECT name AS primary_name, coalesce(other, 'No match') AS secondary_name, CASE WHEN other IS NULL THEN 'missing' ELSE 'matched' END AS status FROM n LEFT JOIN m USING (key)""",
    "key_intersection": """SELECT regexp_extract(url, '/([a-z]{2})/', 1) AS key FROM pages WHERE page_id % 2 = 0 AND regexp_matches(url, '/([a-z]{2})/')
      INTERSECT SELECT regexp_extract(url, '/([a-z]{2})/', 1) FROM pages WHERE page_id % 2 = 1 AND regexp_matches(url, '/([a-z]{2})/')""",
    "confidence_tiers": f"WITH {_DAYS_SQL} SELECT primary_path, secondary_path, abs(start_delay_ms - end_delay_ms) AS drift, confidence FROM g",
    "outlier_flag": f"WITH {_DAYS_SQL} SELECT primary_path, secondary_path, coalesce(abs(start_delay_ms - end_delay_ms) > 500, true) AS is_outlier FROM r",
    "status_cli": f"""WITH {_DAYS_SQL} SELECT substr(primary_path, 4) AS "primary", substr(secondary_path, 4) AS secondary, CASE WHEN {_BAD_SQL} OR start_delay_ms IS NULL THEN '-' ELSE {_CLI_SQL.format('start_delay_ms')} END AS start_delay,
      CASE WHEN {_BAD_SQL} OR start_delay_ms IS NULL THEN '-' ELSE {_CLI_SQL.format('end_delay_ms')} END AS end_delay,
      CASE WHEN NOT ({_BAD_SQL}) AND start_delay_ms IS NOT NULL AND end_delay_ms IS NOT NULL THEN upper(confidence[1]) || confidence[2:] ELSE '-' END AS confidence,
      CASE WHEN {_BAD_SQL} THEN 'ERROR: ' || error WHEN start_delay_ms IS NOT NULL THEN 'OK' ELSE 'Failed' END AS status FROM g""",
    "result_counts": f"WITH {_DAYS_SQL} SELECT count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER ({_BAD_SQL}) AS error, count(*) AS total FROM g",
    "success_counts": f"WITH {_DAYS_SQL} SELECT count(*) FILTER (NOT ({_BAD_SQL})) AS success, count(*) FILTER ({_BAD_SQL}) AS failed FROM r",
    "warn_any_low": f"WITH {_DAYS_SQL} SELECT coalesce(bool_or(confidence = 'low' OR start_delay_ms IS NULL OR end_delay_ms IS NULL), false) AS warn FROM g",
    "filter_by_confidence": f"WITH {_DAYS_SQL} SELECT primary_path, secondary_path, confidence FROM g WHERE confidence = 'medium'",
    "format_delay_ui": f"WITH {_DAYS_SQL}, m AS (SELECT *, end_delay_ms / 8 AS ms FROM r) SELECT primary_path, secondary_path, {_UI_SQL.format('>', '--')} AS shown, {_UI_SQL.format('>=', '—')} AS shown_table FROM m",
    "format_delay_cli": f"WITH {_DAYS_SQL}, m AS (SELECT *, end_delay_ms / 8 AS ms FROM r) SELECT primary_path, secondary_path, {_CLI_SQL.format('ms')} AS shown FROM m",
    "format_size": """SELECT doc_id, CASE WHEN n IS NULL OR n <= 0 THEN '--' WHEN n < 1024 THEN printf('%.0fB', n) WHEN n < pow(1024, 2) THEN printf('%.1fKB', round(n / 1024, 1))
      WHEN n < pow(1024, 3) THEN printf('%.1fMB', round(n / pow(1024, 2), 1)) ELSE printf('%.1fGB', round(n / pow(1024, 3), 1)) END AS size FROM (SELECT doc_id, n_chars * pow(32.0, doc_id % 6) AS n FROM documents)""",
    "format_eta": """WITH e AS (SELECT event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0 AS elapsed, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p, count(*) OVER (PARTITION BY user_id) AS t FROM events),
      r AS (SELECT event_id, elapsed, CAST(greatest(0, floor(elapsed / p * (t - p) / 1000 + 0.5)) AS BIGINT) AS s FROM e)
      SELECT event_id, (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS eta, printf('%.1f', round(elapsed / 1000, 1)) AS seconds FROM r""",
    "progress_running": """SELECT event_id, processed, total, CAST(floor(processed * 100.0 / total + 0.5) AS INTEGER) AS percent
      FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS processed, count(*) OVER (PARTITION BY user_id) AS total FROM events)""",
    "total_size_by_type": "SELECT lang, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS total_size FROM documents GROUP BY lang",
    "unique_parent": f"""WITH a AS (SELECT {_PARENT_SQL.format('url')} AS p, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang FROM pages)
      SELECT CASE WHEN count(DISTINCT p) = 1 THEN max(p) END AS parent, CAST(NULL AS VARCHAR) AS host, CAST(NULL AS VARCHAR) AS lang FROM a
      UNION ALL SELECT CASE WHEN count(DISTINCT p) = 1 THEN max(p) END, host, NULL FROM a GROUP BY host
      UNION ALL SELECT CASE WHEN count(DISTINCT p) = 1 THEN max(p) END, host, lang FROM a GROUP BY host, lang""",
    "basename_ext": f"""WITH x AS (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.MKV' WHEN 1 THEN '.eac3' ELSE '' END AS path FROM pages)
      SELECT page_id, regexp_extract(path, '[^/]*$', 0) AS name, {_PARENT_SQL.format('path')} AS parent, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) IN ('mp4', 'mkv', 'webm', 'avi', 'mov', 'eac3', 'ac3') AS is_video FROM x""",
    "remove_selected": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "toggle_selection": """SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels UNION ALL SELECT DISTINCT doc_id FROM documents WHERE lang = 'fr') GROUP BY doc_id HAVING count(*) = 1""",
    "probe_streams": """SELECT event_id, k % 7 <> 0 AND k % 3 <> 2 AS has_audio, k % 7 <> 0 AND k % 3 = 0 AS has_video, CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS duration
      FROM (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""",
    "history_top20": "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS fileCount FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20",
    "history_flatten": "SELECT CAST(conv_id AS VARCHAR) AS id, role AS videoFile, CAST(turn AS DOUBLE) AS startDelay, CAST(length(text) AS BIGINT) AS elapsed_ms FROM conversations",
    "high_per_run": "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) FILTER (turn * 39.0 < 50) AS high FROM conversations GROUP BY conv_id",
    "log_tail_200": "SELECT event_id, event_type FROM events ORDER BY ts DESC LIMIT 200",
    "upsert_latest": "SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id",
    "csv_round_trip": f"""WITH {_DAYS_SQL} SELECT substr(primary_path, 4) AS video, substr(secondary_path, 4) AS audio, printf('%.1f', start_delay_ms) AS start_delay, CASE WHEN end_delay_ms IS NOT NULL THEN printf('%.1f', end_delay_ms) END AS end_delay,
      CAST(elapsed_ms AS VARCHAR) AS elapsed, nullif(error, '') AS error FROM r""",
    "stream_file_drop": "SELECT event_id, CASE WHEN value IS NULL THEN '--' ELSE CASE WHEN value > 0 THEN '+' ELSE '' END || printf('%.1fms', round(value, 1)) END AS shown FROM events",
    "event_protocol": f"WITH {_EVENTS_SQL} SELECT * FROM by_type",
    "event_lines": f"WITH {_EVENTS_SQL} SELECT * FROM by_type UNION ALL SELECT NULL, count(*) FILTER (n_nationkey % 2 = 1), 0, 0, 0, 0, 0, NULL, NULL, NULL, NULL FROM nation",
    "consumed_state": f"""WITH {_EVENTS_SQL} SELECT 'whole' AS run, arg_max(substr(primary_path, 4), k) AS current_file, 100 AS file_percent, count(*) AS processed, count(*) AS total, 100 AS percent, true AS finished FROM o
      UNION ALL SELECT 'cut', 'late.mkv', 50, count(*) // 2, count(*), CAST(floor(count(*) // 2 * 100.0 / count(*) + 0.5) AS INTEGER), false FROM o""",
    "consumed_results": f"""WITH {_EVENTS_SQL}, b AS (SELECT k, substr(primary_path, 4) AS videoFile, substr(secondary_path, 4) AS audioFile, start_delay_ms AS startDelay, end_delay_ms AS endDelay, error, elapsed_ms, {_CONFIDENCE_SQL.format('start_delay_ms', 'end_delay_ms')} AS confidence FROM o)
      SELECT 'whole' AS run, b.* EXCLUDE k FROM b UNION ALL SELECT 'cut', b.* EXCLUDE k FROM b WHERE k <= {_CUT_SQL}""",
    "consumed_log": f"""WITH {_EVENTS_SQL}, m AS (SELECT * FROM lines UNION ALL SELECT 'whole', -k, t FROM (VALUES (4, 'Series mode: matched ' || (SELECT count(*) FROM r) || ' file pairs.'), (3, 'Video folder: /v'), (2, 'Audio folder: /a'), (1, 'Match pattern: x')) v(k, t)),
      c AS (SELECT * FROM m UNION ALL SELECT 'cut', pos, message FROM m WHERE pos < 2 * {_CUT_SQL} + 2 UNION ALL SELECT 'cut', 2000000000, 'Starting: late.mkv' UNION ALL SELECT 'cut', 2000000001, 'Invalid bridge message: no event')
      SELECT run, row_number() OVER (PARTITION BY run ORDER BY pos DESC) AS back, message FROM c QUALIFY back <= 200""",
    "stream_progress": """WITH n AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 3 < 2) AS two FROM supplier)
      SELECT 'log' AS type, 4 AS n, 0 AS with_file, 0 AS with_current, 0 AS with_video, 4 AS with_message, CAST(NULL AS BIGINT) AS percent_sum, CAST(NULL AS BIGINT) AS processed_sum, CAST(NULL AS BIGINT) AS total_sum, CAST(NULL AS BIGINT) AS listed
      UNION ALL SELECT 'file_start', n, n, 0, 0, 0, NULL, NULL, NULL, NULL FROM n UNION ALL SELECT 'file_progress', 2 * n, 2 * n, 0, 0, 0, 100 * n, NULL, NULL, NULL FROM n UNION ALL SELECT 'file_end', n, n, 0, 0, 0, NULL, NULL, NULL, NULL FROM n
      UNION ALL SELECT 'progress', n, 0, n, 0, 0, NULL, n * (n + 1) // 2, two * two + (n - two) * n, NULL FROM n UNION ALL SELECT 'result', n, 0, 0, n, 0, NULL, NULL, NULL, NULL FROM n
      UNION ALL SELECT 'done', (n + 6) // 7, 0, 0, 0, 0, NULL, NULL, n * ((n + 6) // 7), n FROM n""",
    "event_progress": f"WITH {_EVENTS_SQL} SELECT k AS processed, total, substr(primary_path, 4) AS current FROM o",
    "list_recordings": """WITH f AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN '.' ELSE '' END || replace(n_name, ' ', '_') || ['.mkv', '.wav', '.EAC3', '.txt'][n_nationkey % 4 + 1] AS name, CAST(n_nationkey AS BIGINT) AS size,
        n_nationkey % 4 AS kind, n_nationkey % 5 = 4 AS hidden FROM nation), v AS (SELECT * FROM f WHERE NOT hidden)
      SELECT 'entries' AS listing, name, 'video' AS type, size FROM f UNION ALL SELECT 'entries', 'below', 'folder', NULL UNION ALL SELECT 'folder', name, 'video', size FROM v UNION ALL SELECT 'audio', name, 'audio', size FROM v
      UNION ALL SELECT 'batch', name, 'video', size FROM v WHERE kind < 3 UNION ALL SELECT 'movies', name, 'video', size FROM v WHERE kind = 0 UNION ALL SELECT 'explicit', n_name || '.avi', 'video', NULL FROM nation
      UNION ALL (SELECT 'first', name, 'video', size FROM v ORDER BY name LIMIT 1) UNION ALL SELECT 'dropped', name, 'audio', size FROM v WHERE kind = 0 UNION ALL SELECT 'dropped', name, 'video', size FROM v
      UNION ALL (SELECT 'one dropped', name, 'audio', size FROM v WHERE kind = 0 ORDER BY name LIMIT 1) UNION ALL SELECT 'mp4 and mkv', NULL, NULL, count(*) FROM v WHERE kind = 0""",
    "wav_pairs": """WITH n AS (SELECT n_nationkey AS k, replace(n_name, ' ', '_') || '.wav' AS name FROM nation),
      r AS (SELECT *, CASE WHEN k % 7 = 3 THEN 'Failed to load start of secondary: a_' || name WHEN k % 5 = 1 THEN 'Insufficient audio at start for analysis.' END AS error FROM n)
      SELECT 'v_' || name AS primary_name, 'a_' || name AS secondary_name, CASE WHEN error IS NULL THEN k * 7 / 8.0 END AS start_delay_ms, CASE WHEN error IS NULL THEN k * 7 / 8.0 END AS end_delay_ms, error,
        CASE WHEN error IS NULL THEN false END AS degenerate, CASE WHEN error IS NULL THEN 'high' ELSE 'low' END AS confidence, error IS NOT NULL AS is_outlier, true AS completed FROM r""",
    "probe_recordings": """SELECT replace(n_name, ' ', '_') || '.wav' AS name, n_nationkey % 3 = 0 AS has_audio, false AS has_video, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey % 5 + 1 AS DOUBLE) END AS duration FROM nation""",
    "wav_windows": """WITH f AS (SELECT replace(n_name, ' ', '_') || '.wav' AS name, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS seconds FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 5 > 1),
      s AS (SELECT name, seconds, unnest(range(CAST((seconds - 1.5) * 8000 AS BIGINT), CAST(seconds * 8000 AS BIGINT))) % 1000 AS x FROM f)
      SELECT name, 'tail' AS part, seconds - 1.5 AS "begin", seconds, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM s GROUP BY name, seconds""",
    "waterfall_styles": f"WITH {_STYLES_SQL} SELECT style, primary_path, secondary_path, step FROM j",
    "one_plan_styles": f"WITH {_STYLES_SQL} SELECT style, primary_path, secondary_path, CAST(rank AS BIGINT) AS pattern_rank FROM j",
    "preview_movie": """SELECT c_name || '.mkv' AS primary_name, 'dub.aac' AS secondary_name, 'matched' AS status FROM customer UNION ALL SELECT c_name || '.mkv', 'No match', 'missing' FROM customer""",
    "text_forms": """WITH p AS (SELECT page_id, url, url || CASE page_id % 3 WHEN 0 THEN '.MKV' WHEN 1 THEN '/.Hidden' ELSE '' END AS path FROM pages), q AS (SELECT *, regexp_extract(path, '[^/]*$', 0) AS name, regexp_extract(url, '[^/]*$', 0) AS base FROM p)
      SELECT page_id AS id, CASE WHEN starts_with(name, '.') THEN '' ELSE lower(regexp_extract(name, '\\.[^.]*$', 0)) END AS a, upper(substr(base, 1, 1)) || substr(base, 2) AS b, contains(lower(url), 'example') AS c, 'page' AS of FROM q
      UNION ALL SELECT event_id, strftime(ts, '%-m/%-d/%Y, %I:%M %p'), upper(substr(event_type, 1, 1)) || substr(event_type, 2), contains(lower(event_type), 'click'), 'event' FROM events""",
    "result_status": f"WITH {_DAYS_SQL} SELECT primary_path, CASE WHEN {_BAD_SQL} THEN 'error' ELSE 'success' END AS status FROM r",
    "probe_missing": "SELECT CAST(event_id AS VARCHAR) AS path, event_id % 3 <> 0 AS has_audio, false AS has_video, CASE WHEN event_id % 3 <> 0 THEN 1.5::DOUBLE END AS duration FROM events",
    "csv_layouts": f"""WITH {_DAYS_SQL} SELECT substr(primary_path, 4) AS a, substr(secondary_path, 4) AS b, printf('%.1f', start_delay_ms) AS start_delay, CASE WHEN end_delay_ms IS NOT NULL THEN printf('%.1f', end_delay_ms) END AS end_delay,
      nullif(error, '') AS error, layout FROM r, (SELECT unnest(['Primary File', 'Video File']) AS layout)""",
    "history_round_trip": """WITH k AS (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id DESC),
      e AS (SELECT conv_id FROM k WHERE conv_id % 2 = 0 ORDER BY conv_id DESC LIMIT 20), a AS (SELECT conv_id FROM (SELECT * FROM e UNION ALL SELECT conv_id FROM k WHERE conv_id % 2 = 1) ORDER BY conv_id DESC LIMIT 20)
      SELECT CAST(conv_id AS VARCHAR) AS id, 'kept' AS list FROM a UNION ALL SELECT CAST(conv_id AS VARCHAR), 'shown' FROM (SELECT conv_id FROM a ORDER BY conv_id DESC LIMIT 10)""",
    "history_export": """SELECT role AS video, 'x' AS audio, printf('%.1f', CAST(turn AS DOUBLE)) AS start_delay, printf('%.1f', turn * 40.0) AS end_delay, CAST(length(text) AS VARCHAR) AS elapsed, CAST(NULL AS VARCHAR) AS error FROM conversations""",
}
