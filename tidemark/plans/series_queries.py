"""Queries on grids, gaps, windows and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import series as S
from ..operators import tables as T
from ..operators import windows as W
from ..sources import feeds, tables
from .inputs import SQL_EV, SQL_ORD, SQL_SHIP, ev, ord_, rounded, ship, sql_pos, sql_segments, stamp, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
TS = STAMP.format("ts")


@query("hourly_series", f"WITH {SQL_EV} SELECT sid, {TS} AS ts, v FROM ev")
def hourly_series(spark, d):
    return ev(spark, d).select("sid", stamp("ts"), "v")


@query("resample_hourly", f"""WITH {SQL_EV}, span AS (SELECT sid, min(ts) AS a, max(ts) AS b FROM ev GROUP BY sid), grid AS (SELECT sid, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span)
    SELECT g.sid, strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS ts, e.v FROM grid g LEFT JOIN ev e ON e.sid = g.sid AND e.ts = g.ts""")
def resample_hourly(spark, d):
    return S.resample(ev(spark, d), "hour").select("sid", stamp("ts"), "v")


@query("dedup_keep_first", """SELECT user_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS ts, event_id, value FROM (SELECT *, date_trunc('hour', ts) AS hour FROM events)
    QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id) = 1""")
def dedup_keep_first(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("ts"), "event_id", "value")
    return S.dedup_first(e, ["user_id", "ts"], ["event_id"]).select("user_id", stamp("ts"), "event_id", "value")


@query("admissibility", f"WITH {SQL_EV} SELECT sid, count(*) FILTER (ts >= TIMESTAMP '2024-01-08') AS n_kept, count(*) FILTER (ts < TIMESTAMP '2024-01-08') AS n_dropped, strftime(min(ts) FILTER (ts >= TIMESTAMP '2024-01-08'), '%Y-%m-%d %H:%M:%S') AS first_ts FROM ev GROUP BY sid HAVING count(*) FILTER (ts >= TIMESTAMP '2024-01-08') > 0")
def admissibility(spark, d):
    return S.admissibility(ev(spark, d), "2024-01-08").select("sid", "n_kept", "n_dropped", stamp("first_ts"))


@query("segment_summary", f"WITH {SQL_EV} SELECT sid, count(*) AS n_obs, count(*) - count(v) AS n_missing, greatest(0, count(*) - 535)::BIGINT AS n_windows, {STAMP.format('min(ts)')} AS start, {STAMP.format('max(ts)')} AS \"end\" FROM ev GROUP BY sid")
def segment_summary(spark, d):
    return S.summary(ev(spark, d)).select("sid", "n_obs", "n_missing", "n_windows", stamp("start"), stamp("end"))


@query("modal_step", f"""WITH {SQL_EV}, {SQL_ORD}, al AS (SELECT * FROM ev UNION ALL SELECT * FROM ord), st AS (SELECT sid, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sid ORDER BY ts)) AS d FROM al)
    SELECT sid, d::BIGINT AS step_us FROM (SELECT sid, d, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, d) AS rk FROM st WHERE d IS NOT NULL GROUP BY sid, d) WHERE rk = 1""")
def modal_step(spark, d):
    return S.modal_step(ev(spark, d).union(ord_(spark, d)))


@query("gap_segments", f"WITH {SQL_EV}, {sql_segments('ev', 12)} SELECT sid, segment_number, segments_found, {STAMP.format('min(ts)')} AS start, {STAMP.format('max(ts)')} AS \"end\", count(*) AS n FROM ev_g GROUP BY 1, 2, 3")
def gap_segments(spark, d):
    return S.segment_table(ev(spark, d), 12).select("sid", "segment_number", "segments_found", stamp("start"), stamp("end"), "n")


_DAILY = "SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, " + ", ".join(f"sum({c}::DECIMAL(18,2))::DOUBLE AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY 1"


@query("unpivot_series", f"SELECT channel, {TS} AS ts, v FROM (UNPIVOT ({_DAILY}) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME channel VALUE v)")
def unpivot_series(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    daily = table(spark, d, "lineitem").groupBy(F.date_trunc("day", "l_shipdate").alias("ts")).agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in names])
    return S.unpivot(daily, "ts", names).select("channel", stamp("ts"), "v")


_FREQS = ["h", "H", "15min", "30min", "D", "W-SUN", "W-THU", "M", "Q-DEC", "Q-OCT", "Y-DEC", "B", "7min", ""]


@query("freq_seasonality", """SELECT * FROM (VALUES ('h', 'H', 24), ('H', 'H', 24), ('15min', 'T', 96), ('30min', 'T', 48), ('D', 'D', 1), ('W-SUN', 'W', 1), ('W-THU', 'W', 1), ('M', 'M', 12),
    ('Q-DEC', 'Q', 4), ('Q-OCT', 'Q', 4), ('Y-DEC', 'A', 1), ('B', 'B', 5), ('7min', 'T', 1), ('', '', 1)) t(freq, legacy, season)""")
def freq_seasonality(spark, d):
    f = spark.createDataFrame([(x,) for x in _FREQS], "freq string")
    return f.select("freq", X.legacy_freq(F.col("freq")).alias("legacy"), X.seasonality(F.col("freq")).alias("season"))


@query("derive_seed", "SELECT sid, k::BIGINT AS k, ('0x' || substr(sha256('20260726|block|' || sid || '|' || k), 9, 8))::BIGINT AS seed FROM (SELECT DISTINCT o_orderpriority AS sid FROM orders), range(0, 20) r(k)")
def derive_seed(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("sid")).distinct()
    k = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    return k.select("sid", "k", X.derive_seed("block", F.col("sid"), F.col("k")).alias("seed"))


@query("split_fixed_offset", f"WITH {SQL_SHIP}, {sql_pos('ship')} SELECT sid, CASE WHEN pos < n - 28 THEN 'past' ELSE 'target' END AS part, CASE WHEN pos < n - 28 THEN pos ELSE pos - (n - 28) END AS step, v FROM ship_p WHERE n > 28 AND pos < n - 14")
def split_fixed_offset(spark, d):
    return W.split_fixed(ship(spark, d), -28, 14)


@query("rolling_windows", f"""WITH {SQL_SHIP}, {sql_pos('ship')}, c AS (SELECT least(greatest(ceil(0.1 * min(n) / 14), 1), 20)::BIGINT AS w FROM ship_p),
    e AS (SELECT p.*, i AS window_index, n - 14 * (w - i) AS s FROM ship_p p, c, range(0, 20) r(i) WHERE i < w)
    SELECT sid, window_index::INTEGER AS window_index, count(*) FILTER (pos < s) AS n_past, {STAMP.format('min(ts) FILTER (pos >= s)')} AS target_start, round(sum(v) FILTER (pos >= s), 2) AS target_sum
    FROM e WHERE s > 0 AND pos < s + 14 GROUP BY 1, 2""")
def rolling_windows(spark, d):
    return rounded(W.rolling_table(ship(spark, d), 14), "target_sum", digits=2).select("sid", "window_index", "n_past", stamp("target_start"), "target_sum")


@query("backward_windows", f"WITH {SQL_SHIP}, {sql_pos('ship')} SELECT sid, k::INTEGER AS k, n - 14 * k - 70 AS past_start, n - 14 * k AS target_end FROM (SELECT DISTINCT sid, n FROM ship_p), range(0, 10) r(k) WHERE n - 14 * k - 14 >= 56")
def backward_windows(spark, d):
    return W.backward(ship(spark, d), 56, 14)


@query("even_sample", f"WITH {SQL_SHIP}, {sql_pos('ship')} SELECT sid, pos, v FROM ship_p WHERE pos % greatest(1, n // 15) = 0 AND pos // greatest(1, n // 15) < 15")
def even_sample(spark, d):
    return S.even_sample(ship(spark, d), 15)


@query("tail_positions", f"WITH {SQL_SHIP}, {sql_pos('ship')} SELECT sid, {TS} AS ts, v, pos - greatest(0, n - 56) AS pos FROM ship_p WHERE pos >= n - 56")
def tail_positions(spark, d):
    return S.tail(ship(spark, d), 56).select("sid", stamp("ts"), "v", "pos")


@query("query_windows", f"""WITH {SQL_SHIP}, {sql_pos('ship')}, c AS (SELECT *, unnest([0, n // 2]) AS a, unnest(['start', 'middle']) AS cut FROM ship_p)
    SELECT sid, cut, count(*) AS n, round(sum(v), 2) AS total FROM c WHERE pos >= a AND pos < a + 256 GROUP BY 1, 2 HAVING count(*) = 256""")
def query_windows(spark, d):
    w = W.query_windows(ship(spark, d), 256)
    return rounded(w.select("sid", "cut", F.size("values").cast("bigint").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")), "total", digits=2)


_FIRST = f"WITH {SQL_EV}, {SQL_ORD}, {SQL_SHIP}, al AS (SELECT * FROM ev UNION ALL SELECT * FROM ord UNION ALL SELECT * FROM ship), {sql_segments('al', 12)} SELECT split_part(sid, ':', 1) AS domain, sid, segment_number FROM (SELECT DISTINCT sid, segment_number FROM al_g) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sid, segment_number) = 1"


@query("first_per_domain", _FIRST)
def first_per_domain(spark, d):
    al = ev(spark, d).union(ord_(spark, d)).union(ship(spark, d))
    t = S.segment_table(al, 12).select(F.split("sid", ":")[0].alias("domain"), "sid", "segment_number")
    return W.first_per_domain(t).select("domain", "sid", "segment_number")


@query("task_windows", """SELECT * FROM (VALUES ('ett1/H/short', 'ett1', 'H', 'short', 48, 20), ('m4_daily/D/short', 'm4_daily', 'D', 'short', 14, 1), ('solar/W/short', 'solar', 'W', 'short', 8, 20),
    ('ett1/15T/medium', 'ett1', '15T', 'medium', 480, 4), ('ett1/D/long', 'ett1', 'D', 'long', 450, 4)) t(task, dataset, freq, term, horizon, windows)""")
def task_windows(spark, d):
    t = spark.createDataFrame([(x,) for x in ("ett1/H/short", "m4_daily/D/short", "solar/W/short", "ett1/15T/medium", "ett1/D/long")], "task string").select("task", X.parse_task_key(F.col("task")).alias("k")).select("task", "k.*")
    t = t.withColumn("horizon", X.prediction_length(F.col("dataset"), F.col("freq"), F.col("term")))
    return t.withColumn("windows", X.rolling_count(F.col("dataset"), F.lit(17420), F.col("horizon")))


@query("nested_dimensions", """SELECT vec_id::VARCHAR AS sid, (i - 1)::INTEGER AS dimension, len(part) AS n, round(list_sum(list_transform(part, lambda x: x::DOUBLE)), 6) AS total
    FROM (SELECT vec_id, i, embedding[(i - 1) * 8 + 1 : i * 8] AS part FROM embeddings, range(1, 5) r(i))""")
def nested_dimensions(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.array(*[F.slice("embedding", 8 * i + 1, 8) for i in range(4)]).alias("target"))
    p = S.dimensions(e, "id", "target")
    return rounded(p.select("sid", "dimension", F.size("values").cast("bigint").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query("upsert_keep_last", """SELECT o_custkey AS key, o_orderkey, batch FROM (SELECT o_custkey, o_orderkey, (o_orderkey % 3 = 0)::INTEGER AS batch FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY batch DESC, o_orderkey DESC) = 1""")
def upsert_keep_last(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return T.upsert(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), ["key"], ["o_orderkey"]).select("key", "o_orderkey", "batch")


@query("rows_replaced_anti", "SELECT o_custkey AS key, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def rows_replaced_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return T.not_replaced(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), ["key"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("range_chunks", "SELECT * FROM (VALUES ('2023-01-01', '2024-01-01'), ('2024-01-01', '2024-12-31'), ('2024-12-31', '2025-03-01')) t(a, b)")
def range_chunks(spark, d):
    one = spark.range(1).select(F.explode(feeds.chunks(F.lit("2023-01-01").cast("date"), F.lit("2025-03-01").cast("date"))).alias("c"))
    return one.select(F.col("c.from").cast("string").alias("a"), F.col("c.to").cast("string").alias("b"))


@query("weather_json", "SELECT * FROM (VALUES ('a', '2025-01-01 00:00:00', 1.5), ('a', '2025-01-01 01:00:00', NULL), ('a', '2025-01-01 02:00:00', -2.0)) t(sid, ts, v)")
def weather_json(spark, d):
    body = '{"hourly":{"time":["2025-01-01T00:00","2025-01-01T01:00","2025-01-01T02:00"],"temperature_2m":[1.5,null,-2.0]},"hourly_units":{"temperature_2m":"C"}}'
    p = spark.createDataFrame([("a", body), ("b", "{}")], "sid string, body string")
    return feeds.parse_weather(p).select("sid", stamp("ts"), "v")


@query("pageview_json", "SELECT * FROM (VALUES ('x', '2025-01-01 00:00:00', 10.0::DOUBLE), ('x', '2025-01-02 00:00:00', 12.0)) t(sid, ts, v)")
def pageview_json(spark, d):
    p = spark.createDataFrame([("x", '{"items":[{"timestamp":"2025010100","views":10},{"timestamp":"2025010200","views":12}]}')], "sid string, body string")
    return feeds.parse_pageviews(p).select("sid", stamp("ts"), "v")


LOAD_XML = """<ns0:GL_MarketDocument xmlns:ns0="urn:x"><ns0:TimeSeries><ns0:Period><ns0:timeInterval><ns0:start>2025-01-01T00:00Z</ns0:start><ns0:end>2025-01-01T03:00Z</ns0:end></ns0:timeInterval><ns0:resolution>PT30M</ns0:resolution><ns0:Point><ns0:position>1</ns0:position><ns0:quantity>10</ns0:quantity></ns0:Point><ns0:Point><ns0:position>2</ns0:position><ns0:quantity>20</ns0:quantity></ns0:Point><ns0:Point><ns0:position>5</ns0:position><ns0:quantity>40</ns0:quantity></ns0:Point></ns0:Period></ns0:TimeSeries></ns0:GL_MarketDocument>"""


@query("xml_load", "SELECT * FROM (VALUES ('z', '2025-01-01 00:00:00', 15.0::DOUBLE), ('z', '2025-01-01 01:00:00', NULL), ('z', '2025-01-01 02:00:00', 40.0)) t(sid, ts, v)")
def xml_load(spark, d):
    p = spark.createDataFrame([("z", 0, LOAD_XML), ("z", 1, LOAD_XML.replace(">10<", ">99<")), ("z", 2, "<broken")], "sid string, chunk int, body string")
    return feeds.load_series(p).select("sid", stamp("ts"), "v")


@query("content_hash")
def content_hash(spark, d):
    return S.content_hash(ship(spark, d))


@query("corpus_size_status", "SELECT event_type AS subset, count(*)::DOUBLE AS mb, CASE WHEN count(*) > 1000 THEN 'skipped_size' ELSE 'searched' END AS status FROM events GROUP BY 1")
def corpus_size_status(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("subset")).agg(F.count(F.lit(1)).cast("double").alias("mb"))
    return s.withColumn("status", tables.status_of_size(F.col("mb"), 1000))


@query("latest_snapshot", "SELECT 'fresh_20250301.parquet' AS name")
def latest_snapshot(spark, d):
    names = spark.createDataFrame([("fresh_20250101.parquet",), ("fresh_20250301.parquet",), ("other_9.parquet",)], "name string")
    return tables.latest(names)


@query("longest_run", f"""WITH {SQL_EV}, {sql_segments('ev', 1)}, b AS (SELECT sid, segment_number FROM (SELECT sid, segment_number, count(*) AS c FROM ev_g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY sid ORDER BY c DESC, segment_number) = 1)
    SELECT sid, {TS} AS ts, v FROM ev_g JOIN b USING (sid, segment_number)""")
def longest_run(spark, d):
    return S.longest_run(ev(spark, d)).select("sid", stamp("ts"), "v")


@query("metadata_merge", f"""WITH {SQL_EV}, m AS (SELECT DISTINCT sid, unnest(['unit', 'source', 'parent_series_id']) AS key FROM ev)
    SELECT sid, key, CASE key WHEN 'unit' THEN 'value' WHEN 'source' THEN 'table' ELSE sid END AS value FROM m""")
def metadata_merge(spark, d):
    old = F.create_map(F.lit("unit"), F.lit("value"), F.lit("source"), F.lit("none"))
    new = F.create_map(F.lit("source"), F.lit("table"), F.lit("parent_series_id"), F.col("sid"))
    each = ev(spark, d).select("sid").distinct().select("sid", F.explode(S.merged_metadata(old, new)).alias("key", "value"))
    return each


@query("segment_metadata", f"""WITH {SQL_EV}, {sql_segments('ev', 12)}, g AS (SELECT DISTINCT sid, segment_number, segments_found FROM ev_g), k AS (SELECT *, unnest(['unit', 'parent_series_id', 'segment_number', 'segments_found']) AS key FROM g)
    SELECT sid || '#s' || segment_number AS sid, key, CASE key WHEN 'unit' THEN 'value' WHEN 'parent_series_id' THEN sid WHEN 'segment_number' THEN segment_number::VARCHAR ELSE segments_found::VARCHAR END AS value FROM k""")
def segment_metadata(spark, d):
    e = ev(spark, d)
    metadata = e.select("sid").distinct().withColumn("metadata", F.create_map(F.lit("unit"), F.lit("value")))
    return S.segment_metadata(S.segment_table(e, 12), metadata).select("sid", F.explode("metadata").alias("key", "value"))


@query("drop_missing", f"WITH {SQL_ORD}, k AS (SELECT sid, ts, nullif(v, round(v / 2) * 2) AS v FROM ord) SELECT sid, {TS} AS ts, v FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM k WHERE v IS NOT NULL) WHERE n >= 5")
def drop_missing(spark, d):
    o = ord_(spark, d)
    return S.drop_missing(o.withColumn("v", F.nullif("v", F.round(F.col("v") / 2) * 2)), 5).select("sid", stamp("ts"), "v")


def _sequences(spark, d):
    """Each vector as an item with two sequences of hourly values."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("x"))
    times = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.timestamp_seconds(i * 3600))
    return e.select("item_id", times.alias("timestamp"), "x", F.reverse("x").alias("y"))


@query("sequence_scan", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), s AS (SELECT vec_id || ':x' AS sid, x FROM e UNION ALL SELECT vec_id || ':y', list_reverse(x) FROM e)
    SELECT sid, len(x)::BIGINT AS n, round(x[1], 6) AS first, round(x[len(x)], 6) AS last FROM s""")
def sequence_scan(spark, d):
    rows = tables.read_sequences(_sequences(spark, d))
    out = rows.groupBy("sid").agg(F.count("v").alias("n"), F.min_by("v", "ts").alias("first"), F.max_by("v", "ts").alias("last"))
    return rounded(out, "first", "last")


@query("long_frame", f"""WITH e AS (SELECT vec_id::VARCHAR AS sid, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings)
    SELECT sid, {STAMP.format("to_timestamp(i * 3600)::TIMESTAMP")} AS ts, round(CASE WHEN i % 7 = 0 THEN NULL ELSE x::DOUBLE END, 6) AS v FROM e""")
def long_frame(spark, d):
    """Parallel arrays as rows; every seventh value is NaN, which becomes NULL."""
    e = _sequences(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when(i % 7 == 0, F.lit(float("nan"))).otherwise(v)))
    rows = S.zipped(e, "item_id", "timestamp", "x")
    return rounded(S.canonical(rows, F.col("sid"), F.col("ts"), F.col("v")).select("sid", stamp("ts"), "v"), "v")


@query("guarded_scores", f"WITH {SQL_SHIP} SELECT 'ship_day' AS dataset, round(avg(v), 2) AS mean, NULL::VARCHAR AS error FROM ship UNION ALL SELECT 'broken', NULL, 'no such dataset'")
def guarded_scores(spark, d):
    def score(name):
        if name == "broken":
            raise ValueError("no such dataset")
        return rounded(ship(spark, d).agg(F.avg("v").alias("mean")), "mean", digits=2)

    return T.guarded(spark, ["ship_day", "broken"], score).select("dataset", "mean", "error")
