"""Operators on small literal inputs."""

from __future__ import annotations

import hashlib
import io
import urllib.error
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import expressions as X
from tidemark.operators import duplicates as D
from tidemark.operators import forecast as P
from tidemark.operators import scoring as C
from tidemark.operators import series as S
from tidemark.operators import statistics as V
from tidemark.operators import surrogates as G
from tidemark.operators import tables as T
from tidemark.operators import windows as W
from tidemark.sources import feeds, tables
from tidemark.streaming.hourly import hourly_means

START = datetime(2025, 1, 1)


def long(spark, values, sid="a", step=timedelta(hours=1), hours=None):
    hours = hours or range(len(values))
    return spark.createDataFrame([(sid, START + step * h, v if v is None else float(v)) for h, v in zip(hours, values, strict=True)], "sid string, ts timestamp, v double")


def runs(df, least):
    return [(r.segment_number, r.segments_found, r.n) for r in S.segment_table(df, least).orderBy("segment_number").collect()]


@pytest.mark.parametrize(
    ("values", "least", "want"),
    [
        ([1.0] * 10, 3, [(1, 1, 10)]),
        ([1, 2, 3, None, 5, 6, 7], 3, [(1, 2, 3), (2, 2, 3)]),
        ([1, 2, 3, 4, None, 9, None, 5, 6, 7, 8], 3, [(1, 3, 4), (3, 3, 4)]),
        ([1, 2, 3, 4] + [None] * 20 + [5, 6, 7, 8], 4, [(1, 2, 4), (2, 2, 4)]),
        ([None] * 5, 1, []),
    ],
)
def test_segments(spark, values, least, want):
    assert runs(long(spark, values), least) == want


def test_a_break_of_the_grid_splits(spark):
    assert runs(long(spark, range(8), hours=[0, 1, 2, 3, 6, 7, 8, 9]), 3) == [(1, 2, 4), (2, 2, 4)]


def test_modal_step_ties_take_the_smallest(spark):
    assert S.modal_step(long(spark, range(5), hours=[0, 1, 2, 4, 6])).first().step_us == 3_600_000_000
    assert S.modal_step(long(spark, [1.0])).first().step_us is None


@pytest.mark.parametrize(("n", "want"), [(536, 1), (535, 0), (0, 0), (635, 100), (566, 31)])
def test_window_count(spark, n, want):
    assert spark.range(1).select(X.n_windows(F.lit(n)).alias("x")).first().x == want


def test_admissibility_is_inclusive(spark):
    df = spark.createDataFrame([("a", datetime(2024, 12, 25) + timedelta(days=i), float(i)) for i in range(14)], "sid string, ts timestamp, v double")
    r = S.admissibility(df, "2025-01-01").first()
    assert (r.n_dropped, r.n_kept, r.first_ts) == (7, 7, datetime(2025, 1, 1))
    assert [r.v for r in S.admissible(df, "2025-01-01").orderBy("ts").limit(2).collect()] == [7.0, 8.0]


def test_split_takes_the_tail_when_offset_equals_horizon(spark):
    rows = W.split_fixed(long(spark, range(100)), -12, 12).collect()
    assert sum(r.part == "past" for r in rows) == 88 and sorted(r.v for r in rows if r.part == "target") == list(range(88, 100))
    deep = W.split_fixed(long(spark, range(500)), -96, 24).collect()
    assert sum(r.part == "past" for r in deep) == 404 and sorted(r.v for r in deep if r.part == "target") == list(range(404, 428))
    assert W.split_fixed(long(spark, range(12)), -12, 12).count() == 0


def test_rolling_windows_skip_those_without_a_past(spark):
    got = sorted((r.window_index, r.n_past) for r in W.rolling_table(long(spark, range(10)), 4, 3).collect())
    assert got == [(1, 2), (2, 6)]


def score(spark, past, target, m):
    split = W.split_fixed(long(spark, [*past, *target]), -len(target), len(target))
    errors = C.seasonal_error(split, m)
    return errors.first().err, C.mase(split, P.seasonal_naive(split, len(target), m), errors).first().mase


def test_scaled_errors(spark):
    assert score(spark, range(1, 7), [7], 1)[0] == 1.0
    assert score(spark, range(1, 7), [7], 2)[0] == 2.0
    assert score(spark, [1, 2, 3], [4], 24)[0] == 1.0
    assert score(spark, [1, 2, 3], [4], 3)[0] is None
    assert score(spark, [1, 5, 3, 9] * 10, [1, 5, 3, 9], 4) == (0.0, None)


def test_seasons_by_series_agree_with_one_for_all(spark):
    split = W.split_fixed(long(spark, [1, 4, 2, 8, 5, 7, 1, 3, 9, 9]).union(long(spark, [2, 1, 5], "b")), -1, 1)
    for m in (1, 2, 3, 9, 20):
        one, each = (sorted((r.sid, r.err if r.err is None else round(r.err, 9)) for r in C.seasonal_error(split, x).collect()) for x in (m, F.lit(m)))
        assert one == each


def test_naive_repeats_the_season(spark):
    split = W.split_fixed(long(spark, [1, 5, 3, 9] * 10 + [0] * 8), -8, 8)
    assert [r.yhat for r in P.seasonal_naive(split, 8, 4).orderBy("step").collect()] == [1, 5, 3, 9] * 2
    short = W.split_fixed(long(spark, [4, 6, 0, 0]), -2, 2)
    assert [r.yhat for r in P.seasonal_naive(short, 2, 24).collect()] == [6, 6]


def test_quantile_loss_is_asymmetric(spark):
    loss = lambda p, q: spark.range(1).select(X.pinball(F.lit(10.0), F.lit(p), F.lit(q)).alias("x")).first().x
    assert loss(8.0, 0.9) > loss(12.0, 0.9) and loss(8.0, 0.5) == pytest.approx(loss(12.0, 0.5))


def test_wql_pools_over_series(spark):
    big, small = W.split_fixed(long(spark, [1000.0] * 9, "x:a"), -4, 4), W.split_fixed(long(spark, [0.001] * 9, "x:b"), -4, 4)
    split = big.union(small)
    f = P.quantiles(P.seasonal_naive(split, 4, 1).withColumn("yhat", F.when(F.col("sid") == "x:b", 0.002).otherwise(F.col("yhat"))), config.LEVELS)
    assert C.wql(split, f, F.split("sid", ":")[0]).first().wql < 1e-5


def test_seeds_are_bytes_five_to_eight_of_the_hash(spark):
    got = spark.range(1).select(X.derive_seed("block", F.lit("a"), F.lit(3)).alias("s")).first().s
    assert got == int.from_bytes(hashlib.sha256(b"20260726|block|a|3").digest()[4:8], "big")


@pytest.mark.parametrize(("n", "m", "want"), [(1000, 24, 24), (1000, 1, 10), (5, 24, 5)])
def test_block_length(spark, n, m, want):
    assert spark.range(1).select(X.block_length(F.lit(n), F.lit(m)).alias("x")).first().x == want


def wave(n=512):
    rng = np.random.default_rng(0)
    t = np.arange(n)
    return 10 + 0.01 * t + 3 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.3, n)


def test_surrogates_permute_and_keep_the_spectrum(spark):
    x = wave()
    s = np.array([G.iaaft(x, f"t|{k}")[0] for k in range(10)])
    assert all((np.sort(r) == np.sort(x)).all() for r in s) and (s[0] == G.iaaft(x, "t|0")[0]).all() and (s[0] != s[1]).any()
    drawn = spark.createDataFrame([("a", k, r.tolist()) for k, r in enumerate(s)], "sid string, k long, surrogate array<double>")
    got = G.validation_report(long(spark, x), drawn).first()
    assert got.dist_max_rel_diff < 1e-9 and got.acf_max_abs_diff < 0.2 and got.spec_median_rel_diff < 0.25 and got.n_surrogates == 10
    # the same three figures straight from their definitions
    q = np.linspace(0, 1, 101)
    assert got.dist_max_rel_diff == pytest.approx(np.abs(np.mean([np.quantile(r, q) for r in s], 0) - np.quantile(x, q)).max() / np.ptp(x), abs=1e-9)
    r = lambda y, k: float(((y - y.mean())[:-k] * (y - y.mean())[k:]).sum() / ((y - y.mean()) ** 2).sum())
    assert got.acf_max_abs_diff == pytest.approx(max(abs(np.mean([r(y, k) for y in s]) - r(x, k)) for k in range(1, 51)))
    power = lambda y: np.abs(np.fft.rfft(y - y.mean())) ** 2
    off = np.abs(np.mean([power(y) for y in s], 0) - power(x)) / np.maximum(power(x), 1e-12 * power(x).max())
    assert got.spec_median_rel_diff == pytest.approx(np.median(off))
    for bad in (np.array([1.0, np.nan] * 8), np.arange(4.0)):
        with pytest.raises(ValueError):
            G.iaaft(bad, "t")


def test_bootstrap_keeps_length_and_values(spark):
    got = G.block_bootstrap(long(spark, range(50)), 7, 3).collect()
    assert len(got) == 150 and {r.v for r in got} <= set(range(50))
    assert G.block_bootstrap(long(spark, [1, None, 3]), 1, 2).count() == 0


def corpus(n=2000):
    rng = np.random.default_rng(1)
    return 10 + 3 * np.sin(2 * np.pi * np.arange(n) / 24) + np.cumsum(rng.normal(0, 0.3, n))


def test_planted_copies_are_found():
    c = corpus()
    assert D.find_matches(c[700:1100], c)[0][:1] == (700,) and D.find_matches(c[700:1100], c)[0][1] < 1e-6
    assert D.find_matches(c[300:800] * 1000 - 47.5, c)[0][0] == 300
    holes = c.copy()
    holes[100:121], holes[1500:1511] = np.nan, np.nan
    assert D.find_matches(c[600:900], holes)[0][0] == 600
    other = np.cumsum(np.random.default_rng(9).normal(0, 1, 400))
    assert D.find_matches(other, c) == [] and D.find_matches(np.ones(100), c) == []
    assert D.find_matches(np.full(50, np.nan), c) == []


def test_a_flat_stretch_at_a_high_level_matches_nothing():
    c = np.random.default_rng(2).normal(0, 1, 1000)
    c[400:600] = 1e7
    assert not [m for m in D.find_matches(np.sin(np.arange(64.0)), c) if 350 < m[0] < 600 and m[2] == "match"]


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([("g", i, p, 0.1) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "grp string, sid int, p double, g double")
    got = [r.p_adj for r in V.benjamini_hochberg(t, ["grp"]).orderBy("sid").collect()]
    assert got == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_verdict_needs_both_families(spark):
    rows = [("d", f, i, fires, 0.5) for f, share in (("iaaft", 10), ("block", 1)) for i, fires in enumerate([True] * share + [False] * (10 - share))]
    t = spark.createDataFrame(rows, "dataset string, family string, sid int, fires boolean, g double")
    assert V.firing(t, ["dataset"]).first().verdict == "undetermined"
    assert V.firing(t, ["dataset"], floor=0.1).first().verdict == "silent"
    assert V.firing(t.withColumn("fires", F.lit(True)), ["dataset"], floor=0.1).first().verdict == "fires"


def test_noise_does_not_fire(spark):
    real = spark.createDataFrame([(str(i), 1.0) for i in range(20)], "sid string, mase double")
    surrogate = spark.createDataFrame([(str(i), 0.8 + 0.4 * (((i * 7 + k * 13) % 19) / 19)) for i in range(20) for k in range(19)], "sid string, mase double")
    p = V.rank_pvalue(real, surrogate).withColumn("grp", F.lit(1))
    assert V.benjamini_hochberg(p, ["grp"]).where("fires").count() == 0


def test_content_hash_ignores_the_id(spark):
    h = {r.sid: r.content_hash for r in S.content_hash(long(spark, [1, None, 3], "a").union(long(spark, [1, None, 3], "b")).union(long(spark, [1, 2, 3], "c"))).collect()}
    assert h["a"] == h["b"] != h["c"] and len(h["a"]) == 16


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([("a", [START], [1.0, 2.0])], "sid string, t array<timestamp>, x array<double>")
    with pytest.raises(Exception, match="differ in length"):
        S.zipped(df, "sid", "t", "x").collect()


def test_upsert_keeps_the_later_row(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "k string, o int, x double")
    new = spark.createDataFrame([("b", 0, 3.0), ("c", 0, 4.0)], "k string, o int, x double")
    assert {r.k: r.x for r in T.upsert(old, new, ["k"], ["o"]).collect()} == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_tables_round_trip(spark, tmp_path):
    df = long(spark, [1, None, 3]).withColumns({"source": F.lit("s"), "domain": F.lit("d"), "freq": F.lit("H")})
    status = spark.createDataFrame([("s", True, 1, None), ("t", False, 0, "down")], "source string, ok boolean, n_series long, error string")
    m = tables.snapshot(spark, df, status, str(tmp_path / "fresh_1"), ("2025-01-01", "2025-01-02"), "2025-01-01 01:00:00", "now")
    back = tables.read_series(spark, str(tmp_path / "fresh_1.parquet"))
    assert m["observations_dropped_before_cutoff"] == 1 and m["n_observations"] == back.count() == 2 and m["series"][0]["n_missing"] == 1
    assert m["sources"]["t"]["error"] == "down" and m["data_sha256"] == tables.files_sha256(spark, str(tmp_path / "fresh_1.parquet"))
    T.overwrite_datasets(df.withColumn("dataset", F.lit("x")), str(tmp_path / "o"))
    T.overwrite_datasets(df.withColumn("dataset", F.lit("y")), str(tmp_path / "o"))
    T.append(df, str(tmp_path / "p"))
    T.append(df, str(tmp_path / "p"))
    T.overwrite(df, str(tmp_path / "c"), "csv", header="true")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 6 and spark.read.parquet(str(tmp_path / "p")).count() == 6


def test_other_readers(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,a,b\n2025-01-01 00:00:00,1,2\n2025-01-01 01:00:00,3,4\n")
    assert sorted((r.sid, r.v) for r in tables.read_wide_csv(spark, str(tmp_path / "w.csv")).collect()) == [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 4.0)]
    (tmp_path / "p.csv").write_text("dataset,eval_metrics/MASE[0.5]\nx,0.5\n")
    assert tables.published_results(spark, str(tmp_path / "p.csv"), "eval_metrics/MASE[0.5]").first().ref == 0.5
    seq = spark.createDataFrame([("i", [START], [1.0], [2.0])], "item_id string, timestamp array<timestamp>, x array<double>, y array<double>")
    assert sorted(r.sid for r in tables.read_sequences(seq).collect()) == ["i:x", "i:y"]


class _Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_http_retries_and_refusals():
    waits, calls = [], []

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return _Answer(b'{"a": 1}')

    assert feeds.get_json("http://x", opener=opener, sleep=waits.append) == {"a": 1} and waits == [2.0, 4.0]

    def refuse(code):
        def f(request, timeout):
            calls.append(code)
            raise urllib.error.HTTPError("http://x", code, "no", {}, None)

        return f

    with pytest.raises(urllib.error.HTTPError):
        feeds.get_text("http://x", opener=refuse(404), sleep=waits.append)
    assert calls.count(404) == 1
    with pytest.raises(RuntimeError):
        feeds.get_text("http://x", opener=refuse(429), sleep=waits.append)
    assert calls.count(429) == 3


def test_a_failing_source_is_a_status_row(spark):
    def fetcher(spark, key, a, b):
        if key == "wikipedia":
            raise RuntimeError("down")
        return long(spark, [1, 2], key)

    df, status = feeds.fetch_all(spark, ["open_meteo", "wikipedia"], date(2025, 1, 1), date(2025, 2, 1), fetcher)
    assert df.count() == 2 and {r.source: r.ok for r in status.collect()} == {"open_meteo": True, "wikipedia": False}
    with pytest.raises(KeyError):
        feeds.fetch_all(spark, ["nothing"], date(2025, 1, 1), date(2025, 2, 1), fetcher)


def test_config(tmp_path, monkeypatch):
    assert config.fetch_window(date(2025, 1, 1), today=date(2025, 3, 10))[1] == date(2025, 3, 3)
    with pytest.raises(ValueError):
        config.fetch_window(date(2024, 12, 31))
    (tmp_path / ".env").write_text("# c\nexport TM_A='x'\nTM_B=y\n\n")
    monkeypatch.setenv("TM_B", "kept")
    monkeypatch.delenv("TM_A", raising=False)
    assert config.load_dotenv(str(tmp_path / ".env")) == ["TM_A"]
    with pytest.raises(RuntimeError):
        config.pinned_revision({}, "m")
    with pytest.raises(Exception):
        config.Protocol().fdr = 0.2


def test_stream_of_hours(spark, tmp_path):
    long(spark, [1, 3, 5, None], step=timedelta(minutes=30)).write.parquet(str(tmp_path / "in"))
    q = hourly_means(spark.readStream.schema("sid string, ts timestamp, v double").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.v for r in spark.table("hours").collect()) == [2.0, 5.0]


def test_forecasters_follow_a_season():
    t = np.arange(200.0)
    x = 5 + np.sin(2 * np.pi * t / 7)
    want = 5 + np.sin(2 * np.pi * np.arange(200, 214) / 7)
    for name in ("harmonic", "ar", "theta"):
        assert np.abs(P.FORECASTERS[name](x, 14, 7) - want).max() < 0.3, name


def test_imported_forecasts_must_be_whole(spark):
    w = spark.createDataFrame([("a",)], "window_id string")
    f = spark.createDataFrame([("a", s, 1.0) for s in range(3)], "window_id string, step int, yhat double")
    assert P.import_forecasts(f, w, 3).count() == 3
    with pytest.raises(Exception, match="forecast steps"):
        P.import_forecasts(f, w, 4).collect()


def test_quantile_model_in_batches(spark):
    w = spark.createDataFrame([(str(i), [float(i)] * 3, 7) for i in range(5)], "sid string, past array<double>, seed long")

    def load():
        return lambda pasts, h, levels, seed: np.array([[[p[-1] + q for q in levels] for _ in range(h)] for p in pasts])

    got = {(r.sid, r.step, r.q): r.yhat for r in P.apply_quantile_forecaster(w, load, 2, [0.1, 0.9], batch=2).collect()}
    assert len(got) == 20 and got["3", 1, 0.9] == 3.9


def test_a_failing_dataset_is_an_error_row(spark):
    def score(name):
        if name == "bad":
            raise ValueError("x" * 500)
        return spark.createDataFrame([(0.5,)], "mase double")

    got = {r.dataset: (r.mase, r.error) for r in T.guarded(spark, ["good", "bad"], score).collect()}
    assert got["good"] == (0.5, None) and got["bad"][0] is None and len(got["bad"][1]) == 120


def test_ties_and_nulls_among_p_values(spark):
    t = spark.createDataFrame([("g", i, p) for i, p in enumerate([0.02, 0.02, 0.5, None, 0.9])] + [("h", 9, 0.01)], "grp string, sid int, p double")
    got = {r.sid: (r.p_adj, r.fires) for r in V.benjamini_hochberg(t, ["grp"]).collect()}
    assert got[0] == got[1] == (pytest.approx(0.04), True) and got[2][0] == pytest.approx(0.5 * 4 / 3) and got[3] == (None, False) and got[9][0] == 0.01


@pytest.mark.parametrize(("h", "m", "windows"), [(4, 3, 5), (3, 7, 4), (5, 1, 3), (2, 40, 6), (4, 4, None)])
def test_rolling_scores_in_one_pass(spark, h, m, windows):
    rng = np.random.default_rng(3)
    df = long(spark, rng.normal(size=60)).union(long(spark, rng.normal(size=23), "b")).union(long(spark, [1.0, None, 2.0, 4.0, 1.0, 7.0, 3.0, 8.0, 2.0, 2.0, 5.0, 9.0], "c"))
    keys = ("sid", "window_index")
    split = W.rolling(df, h, windows).drop("ts")
    whole = split.where("part = 'target'").groupBy(*keys).count().where(F.col("count") == h)
    want = C.mase(split, P.seasonal_naive(split, h, m, keys), C.seasonal_error(split, m, keys), keys).join(whole, list(keys), "left_semi")
    shape = lambda x: sorted((r.sid, r.window_index, r.mase is None, round(r.mase or 0, 9)) for r in x.collect())
    assert shape(C.rolling_mase(df, h, m, windows)) == shape(want)


@pytest.mark.parametrize("m", [1, 3, 7, 30])
def test_scores_of_arrays(spark, m):
    df = long(spark, [1.0, 4, 2, 8, 5, 7, 1, 3, 9, 9, 4, 6]).union(long(spark, [3.0] * 12, "b")).union(long(spark, [2.0, 5.0, 1.0], "c"))
    split = W.split_fixed(df, -2, 2)
    want = {r.sid: r.mase for r in C.mase(split, P.seasonal_naive(split, 2, m), C.seasonal_error(split, m)).collect()}
    got = {r.sid: r.mase for r in G.held(df).select("sid", C.array_mase(F.col("x"), 2, m).alias("mase")).collect()}
    assert got.keys() == want.keys() and all(got[k] == (v if v is None else pytest.approx(v)) for k, v in want.items())


def test_blocks_cut_from_arrays_are_those_of_the_join(spark):
    df = long(spark, range(50)).union(long(spark, range(7), "b")).union(long(spark, [1, None, 3], "c"))
    for family, length in (("block", None), ("single", F.lit(1).cast("bigint"))):
        want = {(r.sid, r.k, r.pos): r.v for r in G.block_bootstrap(df, 4, 3, length, family).collect()}
        rows = G.ensembles(G.held(df), (family,), 4, 3).select("sid", "k", F.posexplode("x").alias("pos", "v")).collect()
        assert {(r.sid, r.k, r.pos): r.v for r in rows} == want


def test_matches_around_holes_against_a_plain_search():
    rng = np.random.default_rng(5)
    c = np.round(rng.normal(size=400), 2)
    c[[50, 51, 180]] = np.nan
    q = c[100:130]
    z = lambda x: (x - x.mean()) / x.std()
    rms = {i: np.sqrt(((z(q) - z(c[i : i + 30])) ** 2).mean()) for i in range(371) if np.isfinite(c[i : i + 30]).all()}
    got = D.distances(q, c)
    assert all(got[i] == pytest.approx(v, abs=1e-6) for i, v in rms.items()) and np.isinf(np.delete(got, list(rms))).all()
    found = D.find_matches(q, c)
    assert found[0][0] == 100 and all(abs(a[0] - b[0]) >= 30 for i, a in enumerate(found) for b in found[:i])


def test_queries_in_blocks(spark):
    c = corpus(300)
    df = long(spark, c).union(long(spark, c[::-1], "b"))
    queries = spark.createDataFrame([(str(i), c[10 * i : 10 * i + 40].tolist()) for i in range(9)], "query string, q array<double>")
    few = D._pairs(queries, df, None)
    blocks = D._pairs(queries, df, None, at_once=2)
    assert sorted((r.query, r.sid) for r in few.collect()) == sorted((r.query, r.sid) for r in blocks.collect()) and few.count() == 18


def test_nanosecond_files_can_be_read(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = pd.to_datetime(["2025-01-01 00:00:00.123456789", "2025-01-01 01:00:00.000000000"])
    t = pa.table({"series_id": ["a", "a"], "source": ["s", "t"], "domain": ["d", "d"], "freq": ["H", "H"], "timestamp": pa.array(at, pa.timestamp("ns")), "value": [1.0, float("nan")]})
    pq.write_table(t, str(tmp_path / "n.parquet"), version="2.6")
    got = tables.read_series(spark, str(tmp_path / "n.parquet")).orderBy("ts").collect()
    assert [r.ts.microsecond for r in got] == [123456, 0] and got[1].v is None and {r.source for r in got} == {"s"}


def test_a_source_is_asked_once(spark, tmp_path):
    calls = []

    def fetcher(spark, key, a, b):
        calls.append(key)
        return long(spark, [1, 2], key)

    df, _ = feeds.fetch_all(spark, ["open_meteo"], date(2025, 1, 1), date(2025, 2, 1), fetcher, str(tmp_path / "landing"))
    assert df.count() == 2 and "landing" in df.inputFiles()[0] and calls == ["open_meteo"]


def test_one_file_has_its_own_digest(spark, tmp_path):
    long(spark, [1, 2]).coalesce(1).write.parquet(str(tmp_path / "x"))
    one = next((tmp_path / "x").glob("*.parquet"))
    assert tables.files_sha256(spark, str(tmp_path / "x")) == hashlib.sha256(one.read_bytes()).hexdigest()


def test_registry_and_lock():
    assert config.model("moirai-base").context_cap is None and config.latest_release() <= config.CUTOFF
    with pytest.raises(KeyError, match="lag-llama"):
        config.model("nothing")

    def resolve(repo):
        if "Lag" in repo:
            raise OSError("gated")
        return {"sha": repo[:3], "lastModified": "x"}

    got = config.lock(resolve, "now")["models"]
    assert config.pinned_revision(got, "chronos-base") == "ama" and got["lag-llama"]["revision"] is None and "gated" in got["lag-llama"]["error"]
    with pytest.raises(RuntimeError):
        config.pinned_revision(got, "lag-llama")


def test_nested_targets_and_short_series(spark):
    t = spark.createDataFrame([("a", [[1.0, 2.0, 3.0, 4.0, 5.0], [5.0, 4.0, 3.0, 2.0, 1.0]]), ("b", [[7.0, 8.0, 9.0]])], "sid string, target array<array<double>>")
    got = {(r.sid, r.dimension, r.window_index): (r.past, r.target) for r in W.nested_windows(t, 1, 2).collect()}
    assert got["a", 1, 0] == ([5.0, 4, 3], [2.0]) and got["b", 0, 1] == ([7.0, 8], [9.0]) and len(got) == 6
    df = long(spark, [1, None, 3, 4]).union(long(spark, range(6), "b"))
    assert {r.sid for r in S.drop_missing(df, 5).collect()} == {"b"} and S.drop_missing(df).count() == 9


def test_a_missing_forecast_is_no_equivalence(spark):
    split = W.split_fixed(long(spark, [1.0, 4, 2, 8, 5, 7]), -2, 2)
    ours, errors = P.seasonal_naive(split, 2, 1), C.seasonal_error(split, 1)
    assert C.equivalence(split, ours, ours, errors).first().equivalent
    assert not C.equivalence(split, ours, ours.withColumn("yhat", F.col("yhat") + 1), errors).first().equivalent
    with pytest.raises(Exception, match="missing on one side"):
        C.equivalence(split, ours, ours.where("step = 0"), errors).collect()


def test_content_hash_against_its_definition(spark):
    import struct

    values = [1.5, None, -0.0, 1e300]
    want = hashlib.sha256(b"".join(struct.pack("<d", float("nan") if v is None else v) for v in values)).hexdigest()[:16]
    assert S.content_hash(long(spark, values)).first().content_hash == want


def test_regressions_against_plain_solutions():
    rng = np.random.default_rng(7)
    past, h, m = 20 + np.cumsum(rng.normal(size=60)), 9, 5
    t = np.arange(69.0)
    columns = [np.ones(69), t / 60]
    for k in (1, 2, 3, 4, 5, 6, 7, 8):
        columns += [np.sin(2 * np.pi * k * t / 24), np.cos(2 * np.pi * k * t / 24)]
    x = np.stack(columns, 1)
    want = x[60:] @ np.linalg.solve(x[:60].T @ x[:60], x[:60].T @ past)
    assert P.FORECASTERS["harmonic"](past, h, 24) == pytest.approx(want, rel=1e-6)
    rows = [[*(past[i - k] for k in range(1, m + 1)), 1.0] for i in range(m, 60)]
    w = np.linalg.solve(np.array(rows).T @ np.array(rows), np.array(rows).T @ past[m:])
    held = list(past)
    for _ in range(h):
        held.append(sum(w[k - 1] * held[-k] for k in range(1, m + 1)) + w[m])
    assert P.FORECASTERS["ar"](past, h, m) == pytest.approx(held[60:], rel=1e-6)


def test_fourier_surrogates_against_the_plain_iteration():
    x = wave(64)
    got, rounds, done = G.iaaft(x, "t|0", rounds=200)
    draw = [int.from_bytes(hashlib.sha256(f"20260726|t|0|{i}".encode()).digest()[4:8], "big") for i in range(64)]
    now = [x[i] for i in sorted(range(64), key=lambda i: draw[i])]
    target, before = np.abs(np.fft.fft(x)), None
    for k in range(1, 201):
        f = np.fft.fft(now)
        y = np.fft.ifft(target * f / np.abs(f)).real
        rank = np.argsort(np.argsort(y, kind="stable"), kind="stable")
        now = np.sort(x)[rank]
        if before is not None and (rank == before).all():
            break
        before = rank
    assert rounds == k and done and (got == now).all()


def test_the_protocols_verdict_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = {"s:a": wave(64), "s:b": rng.normal(size=64)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "sid string, x array<double>").withColumn("r", C.array_mase(F.col("x"), 6, 4))
    got = {(r.sid, r.family): (r.p, r.g) for r in V.rank_members(G.ensembles(rows, ("iaaft", "block"), 4, 15).select("sid", "family", "r", C.array_mase(F.col("x"), 6, 4).alias("s")), ("sid", "family")).collect()}

    def score(v):
        past, target = v[:-6], v[-6:]
        return np.abs(target - np.array([past[len(past) - 4 + t % 4] for t in range(6)])).mean() / np.abs(past[4:] - past[:-4]).mean()

    for sid, v in x.items():
        s = np.array([score(G.iaaft(v, f"iaaft|{sid}|{k}")[0]) for k in range(15)])
        assert got[sid, "iaaft"] == (pytest.approx((1 + (s <= score(v)).sum()) / 16), pytest.approx((np.median(s) - score(v)) / np.median(s)))
    assert len(got) == 4


def test_a_family_of_ones_own(spark, monkeypatch):
    monkeypatch.setitem(G.FAMILIES, "reversed", lambda series, m, k: G.members(series, k).withColumn("x", F.reverse("x")))
    got = G.ensembles(G.held(long(spark, range(5))), ("reversed", "single"), 2, 2).collect()
    assert sorted((r.family, r.k) for r in got) == [("reversed", 0), ("reversed", 1), ("single", 0), ("single", 1)]
    assert all(r.x == [4.0, 3.0, 2.0, 1.0, 0.0] for r in got if r.family == "reversed")
