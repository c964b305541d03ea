"""The given tables as series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean value per event type; hours without events are missing rows."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("ev_hour:"), "event_type").alias("sid"), F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.avg("value"), 4).alias("v"))


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order value per priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("ord_day:"), "o_orderpriority").alias("sid"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))


def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily shipped value per return flag."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.concat(F.lit("ship_day:"), "l_returnflag").alias("sid"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("v"))


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded, with no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


SQL_EV = "ev AS (SELECT 'ev_hour:' || event_type AS sid, date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value), 4) AS v FROM events GROUP BY 1, 2)"
SQL_ORD = "ord AS (SELECT 'ord_day:' || o_orderpriority AS sid, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS v FROM orders GROUP BY 1, 2)"
SQL_SHIP = "ship AS (SELECT 'ship_day:' || l_returnflag AS sid, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS v FROM lineitem GROUP BY 1, 2)"


def sql_pos(name: str) -> str:
    """A step that numbers the rows of ``name`` by time: <name>_p with pos and n."""
    return f"{name}_p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n FROM {name})"


def sql_segments(name: str, least: int) -> str:
    """Steps from ``name`` to <name>_g: its gap-free runs of at least ``least`` points."""
    return f"""
        {name}_d AS (SELECT sid, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sid ORDER BY ts)) AS d FROM {name}),
        {name}_m AS (SELECT sid, d AS step_us FROM (SELECT sid, d, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, d) AS rk FROM {name}_d WHERE d IS NOT NULL GROUP BY sid, d) WHERE rk = 1),
        {name}_f AS (SELECT s.*, CASE WHEN v IS NOT NULL AND (lag(ts) OVER w IS NULL OR lag(v) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) <> step_us) THEN 1 ELSE 0 END AS flag
            FROM {name} s LEFT JOIN {name}_m USING (sid) WINDOW w AS (PARTITION BY sid ORDER BY ts)),
        {name}_n AS (SELECT *, sum(flag) OVER (PARTITION BY sid ORDER BY ts)::INTEGER AS segment_number FROM {name}_f),
        {name}_g AS (SELECT *, max(segment_number) OVER (PARTITION BY sid) AS segments_found, count(*) OVER (PARTITION BY sid, segment_number) AS run_n FROM {name}_n WHERE v IS NOT NULL QUALIFY run_n >= {least})"""


def sql_split(name: str, offset: int, h: int) -> str:
    return f"""{sql_pos(name)},
        {name}_s AS (SELECT sid, CASE WHEN pos < n + ({offset}) THEN 'past' ELSE 'target' END AS part, CASE WHEN pos < n + ({offset}) THEN pos ELSE pos - (n + ({offset})) END AS step, v
            FROM {name}_p WHERE n + ({offset}) > 0 AND pos < n + ({offset}) + {h})"""


def sql_mase(name: str, m: int, h: int) -> str:
    """Steps after ``sql_split``: <name>_y forecasts, <name>_e errors, <name>_a scores."""
    return f"""
        {name}_k AS (SELECT *, count(*) OVER (PARTITION BY sid) AS k FROM {name}_s WHERE part = 'past'),
        {name}_y AS (SELECT p.sid, s.step::BIGINT AS step, p.v AS yhat FROM {name}_k p, range(0, {h}) s(step) WHERE p.step = CASE WHEN p.k >= {m} THEN p.k - {m} + s.step % {m} ELSE p.k - 1 END),
        {name}_e AS (SELECT a.sid, avg(abs(a.v - b.v)) AS err FROM {name}_k a LEFT JOIN {name}_k b ON b.sid = a.sid AND b.step = a.step - CASE WHEN a.k >= {m} THEN {m} ELSE 1 END GROUP BY a.sid),
        {name}_a AS (SELECT t.sid, avg(abs(t.v - y.yhat)) / nullif(any_value(e.err), 0) AS mase FROM {name}_s t JOIN {name}_y y ON y.sid = t.sid AND y.step = t.step JOIN {name}_e e ON e.sid = t.sid WHERE t.part = 'target' GROUP BY t.sid)"""
