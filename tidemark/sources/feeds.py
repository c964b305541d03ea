"""Feeds of observations: payload parsers in Spark SQL, and a data source that fetches on executors."""

from __future__ import annotations

import contextlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import SOURCES
from ..operators.series import dedup_first, resample

# What each feed is asked for.
LOCATIONS = {"reykjavik": (64.1466, -21.9426), "warsaw": (52.2297, 21.0122), "phoenix": (33.4484, -112.0740), "singapore": (1.3521, 103.8198), "nairobi": (-1.2921, 36.8219), "sydney": (-33.8688, 151.2093)}
ARTICLES = ("Python_(programming_language)", "Association_football", "Climate_change", "Stock_market", "Influenza", "Christmas")
ZONES = {"PL": "10YPL-AREA-----S", "DE_LU": "10Y1001A1001A82H", "ES": "10YES-REE------0"}
RESOLUTIONS = {"PT15M": 15, "PT30M": 30, "PT60M": 60, "PT1H": 60}


def parse_weather(payloads: DataFrame, sid: str = "sid", body: str = "body") -> DataFrame:
    """(sid, ts, v) from JSON with parallel arrays; null stays NULL, an empty payload gives no rows."""
    shape = "hourly struct<time: array<string>, temperature_2m: array<double>>"
    h = F.from_json(body, shape)["hourly"]
    rows = payloads.select(F.col(sid).alias("sid"), F.inline(F.arrays_zip(h["time"].alias("t"), h["temperature_2m"].alias("v"))))
    return rows.select("sid", F.to_timestamp("t", "yyyy-MM-dd'T'HH:mm").alias("ts"), "v")


def parse_pageviews(payloads: DataFrame, sid: str = "sid", body: str = "body") -> DataFrame:
    """(sid, ts, v) from JSON items with stamps like 2025010100."""
    items = F.from_json(body, "items array<struct<timestamp: string, views: double>>")["items"]
    return payloads.select(F.col(sid).alias("sid"), F.inline(items)).select("sid", F.to_timestamp("timestamp", "yyyyMMddHH").alias("ts"), F.col("views").alias("v"))


_LOAD = "TimeSeries array<struct<Period: array<struct<timeInterval: struct<start: string, end: string>, resolution: string, Point: array<struct<position: int, quantity: double>>>>>>"


def parse_load(payloads: DataFrame, sid: str = "sid", body: str = "body", chunk: str = "chunk") -> DataFrame:
    """(sid, ts, v, chunk, ord) from XML in any namespace prefix.

    Periods of an unknown resolution and points without a place or a value are left out; malformed XML gives no rows.
    """
    bare = F.regexp_replace(F.col(body), r"<(/?)[A-Za-z_][\w.-]*:", "<$1")
    doc = F.from_xml(bare, _LOAD, {"mode": "PERMISSIVE"})
    series = payloads.select(F.col(sid).alias("sid"), F.col(chunk).alias("chunk"), F.posexplode(doc["TimeSeries"]).alias("a", "s"))
    periods = series.select("sid", "chunk", "a", F.posexplode("s.Period").alias("b", "p"))
    points = periods.select("sid", "chunk", "a", "b", F.col("p.timeInterval.start").alias("start"), F.col("p.resolution").alias("resolution"), F.posexplode("p.Point").alias("c", "x"))
    minutes = F.create_map(*[F.lit(v) for kv in RESOLUTIONS.items() for v in kv])[F.col("resolution")]
    start = F.try_to_timestamp("start", F.lit("yyyy-MM-dd'T'HH:mmX"))
    rows = points.where(minutes.isNotNull() & F.col("x.position").isNotNull() & F.col("x.quantity").isNotNull())
    rows = rows.select("sid", F.timestamp_add("MINUTE", (minutes * (F.col("x.position") - 1)).cast("int"), start).alias("ts"), F.col("x.quantity").alias("v"), "chunk", F.struct("a", "b", "c").alias("ord"))
    return rows.where(F.col("ts").isNotNull())


def load_series(payloads: DataFrame) -> DataFrame:
    """Hourly load: of repeated stamps the one of the earliest chunk and place stays, empty hours become NULL."""
    first = dedup_first(parse_load(payloads), ["sid", "ts"], ["chunk", "ord"]).select("sid", "ts", "v")
    return resample(first, "hour")


def chunks(start: Column, end: Column, days: int = 365) -> Column:
    """Half-open ranges of ``days`` from start, the last one cut at the end."""
    begins = F.filter(F.sequence(start.cast("date"), end.cast("date"), F.expr(f"interval {days} days")), lambda x: x < end)
    return F.transform(begins, lambda x: F.struct(x.alias("from"), F.least(F.date_add(x, days), end.cast("date")).alias("to")))


def _may_pass(failure: OSError) -> bool:
    """Whether asking again can help: no answer, too many requests, or a fault of the server."""
    code = getattr(failure, "code", None)
    return code is None or code == 429 or code // 100 != 4


def get_text(url: str, params: dict | None = None, retries: int = 3, backoff: float = 2.0, timeout: float = 60, opener: Callable | None = None, sleep: Callable = time.sleep) -> str:
    """The body of a URL, asked for up to ``retries`` times with a wait that grows; a refusal raises at once."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    request = urllib.request.Request(full, headers={"User-Agent": "tidemark"})
    ask = opener or urllib.request.urlopen
    failures: list[OSError] = []
    for wait in (0.0, *(backoff * k for k in range(1, retries))):
        if wait:
            sleep(wait)
        with contextlib.ExitStack() as held:
            try:
                return held.enter_context(ask(request, timeout=timeout)).read().decode()
            except OSError as e:
                failures.append(e)
        if not _may_pass(failures[-1]):
            raise failures[-1]
    raise RuntimeError(f"{url} gave no answer in {len(failures)} attempts") from failures[-1]


def get_json(url: str, params: dict | None = None, **options):
    return json.loads(get_text(url, params, **options))


class _Part(InputPartition):
    def __init__(self, sid: str, url: str, params: dict, chunk: int = 0) -> None:
        self.sid, self.url, self.params, self.chunk = sid, url, params, chunk


class _Reader(DataSourceReader):
    def __init__(self, parts: list[_Part]) -> None:
        self.parts = parts

    def partitions(self) -> list[_Part]:
        return self.parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield partition.sid, partition.chunk, get_text(partition.url, partition.params)


class _Feed(DataSource):
    """Payloads (sid, chunk, body), one partition per series and chunk; options start and end."""

    def schema(self) -> str:
        return "sid string, chunk int, body string"

    def reader(self, schema) -> DataSourceReader:
        a, b = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        return _Reader(self.parts(a, b))


class WeatherFeed(_Feed):
    @classmethod
    def name(cls) -> str:
        return "open_meteo"

    def parts(self, a: date, b: date) -> list[_Part]:
        url = "https://archive-api.open-meteo.com/v1/archive"
        return [_Part(f"open_meteo:{k}", url, {"latitude": x, "longitude": y, "start_date": a, "end_date": b, "hourly": "temperature_2m", "timezone": "UTC"}) for k, (x, y) in LOCATIONS.items()]


class PageviewFeed(_Feed):
    @classmethod
    def name(cls) -> str:
        return "wikipedia"

    def parts(self, a: date, b: date) -> list[_Part]:
        base = "https://wikimedia.org/api/rest_v1/metrics/pageviews/per-article/en.wikipedia/all-access/user"
        return [_Part(f"wikipedia:{k}", f"{base}/{urllib.parse.quote(k, safe='')}/daily/{a:%Y%m%d}00/{b:%Y%m%d}00", {}) for k in ARTICLES]


class LoadFeed(_Feed):
    @classmethod
    def name(cls) -> str:
        return "entsoe"

    def parts(self, a: date, b: date) -> list[_Part]:
        token, out = os.environ.get(SOURCES["entsoe"].token_env, ""), []
        for zone, code in ZONES.items():
            begin, k = a, 0
            while begin < b:
                end = min(begin + timedelta(days=365), b)
                out.append(_Part(f"entsoe:{zone}", "https://web-api.tp.entsoe.eu/api", {"securityToken": token, "documentType": "A65", "processType": "A16", "outBiddingZone_Domain": code, "periodStart": f"{begin:%Y%m%d}0000", "periodEnd": f"{end:%Y%m%d}0000"}, k))
                begin, k = end, k + 1
        return out


FEEDS = {"open_meteo": (WeatherFeed, parse_weather), "wikipedia": (PageviewFeed, parse_pageviews), "entsoe": (LoadFeed, load_series)}


def model_revision(repo: str) -> dict:
    """What the public model hub knows of a repository, its ``sha`` among it; for ``config.lock``."""
    return get_json(f"https://huggingface.co/api/models/{repo}", timeout=30)


def fetch(spark: SparkSession, key: str, start: date, end: date) -> DataFrame:
    """(sid, ts, v) of one source; an unknown key is a KeyError."""
    feed, parse = FEEDS[key]
    spark.dataSource.register(feed)
    return parse(spark.read.format(feed.name()).option("start", str(start)).option("end", str(end)).load())


def fetch_all(spark: SparkSession, keys: list[str], start: date, end: date, fetcher: Callable = fetch, landing: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations of all sources that answer, and a status row (source, ok, n_series, error) for each.

    With a folder ``landing`` each source is asked once: its observations are written there, and all that follows reads
    the file. Without it every action on the result asks again.
    """
    frames, status = [], []
    for key in keys:
        if key not in FEEDS:
            raise KeyError(key)
        try:
            df = fetcher(spark, key, start, end).withColumn("source", F.lit(key))
            if landing:
                df.write.mode("overwrite").parquet(f"{landing}/{key}")
                df = spark.read.parquet(f"{landing}/{key}")
            n = df.select("sid").distinct().count()
            frames.append(df)
            status.append((key, True, n, None))
        except Exception as e:  # one source that fails is a status row and stops no other
            status.append((key, False, 0, str(e)[:120]))
    empty = spark.createDataFrame([], "sid string, ts timestamp, v double, source string")
    for df in frames:
        empty = empty.unionByName(df, allowMissingColumns=True)
    return empty, spark.createDataFrame(status, "source string, ok boolean, n_series long, error string")
