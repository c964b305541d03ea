"""Queries on forecasts, scores, surrogates, duplicates and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LEVELS, Protocol
from ..functions import expressions as X
from ..operators import duplicates as D
from ..operators import forecast as P
from ..operators import scoring as C
from ..operators import series as S
from ..operators import statistics as V
from ..operators import surrogates as G
from ..operators import windows as W
from ..sources import tables
from .inputs import SQL_EV, SQL_ORD, SQL_SHIP, ev, ord_, rounded, ship, sql_mase, sql_pos, sql_segments, sql_split, stamp, table
from .series_queries import query

H, OFFSET, M = 14, -28, 7
_SPLIT = f"WITH {SQL_SHIP}, {sql_split('ship', OFFSET, H)}"
_MASE = f"{_SPLIT}, {sql_mase('ship', M, H)}"
_LEVELS = "(SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS q)"
_PIN = "2 * CASE WHEN t.v >= y.yhat THEN q * (t.v - y.yhat) ELSE (q - 1) * (t.v - y.yhat) END"


def _scored(df, m=M, h=H, offset=OFFSET):
    split = W.split_fixed(df, offset, h)
    return split, P.seasonal_naive(split, h, m), C.seasonal_error(split, m)


def _mase(df, m=M, h=H, offset=OFFSET):
    return C.mase(*_scored(df, m, h, offset))


def flagship(spark, d):
    """Daily shipped value: gap-free runs, fixed split, seasonal-naive forecast, mean scaled error per flag."""
    runs = S.segments(ship(spark, d), 8).select(S.segment_id(F.col("sid"), F.col("segment_number")).alias("sid"), "ts", "v")
    scores = _mase(runs, m=1, h=2, offset=-2)
    return scores.groupBy(F.split("sid", "#")[0].alias("series")).agg(F.avg("mase").alias("mase"), F.count(F.lit(1)).alias("segments"))


@query("seasonal_naive", f"{_MASE} SELECT sid, step, yhat FROM ship_y")
def seasonal_naive(spark, d):
    return P.seasonal_naive(W.split_fixed(ship(spark, d), OFFSET, H), H, M)


@query("seasonal_naive_quantiles", f"{_MASE} SELECT sid, step, yhat, q FROM ship_y, {_LEVELS}")
def seasonal_naive_quantiles(spark, d):
    return P.quantiles(seasonal_naive(spark, d), LEVELS)


@query("swa_forecast", f"""{_MASE} , w AS (SELECT sid, (step - (k - 28)) % 7 AS ph, avg(v) AS yhat FROM ship_k WHERE k >= 28 AND step >= k - 28 GROUP BY 1, 2)
    SELECT sid, s.step::BIGINT AS step, round(yhat, 4) AS yhat FROM w, range(0, 14) s(step) WHERE s.step % 7 = ph""")
def swa_forecast(spark, d):
    return rounded(P.seasonal_average(W.split_fixed(ship(spark, d), OFFSET, H), H, M), "yhat", digits=4)


_TWO = f"""WITH {SQL_SHIP}, {sql_split('ship', OFFSET, H)}, z AS (SELECT sid, step, v, c.m FROM ship_s, (SELECT unnest([7, 5000]) AS m) c WHERE part = 'past'
    UNION ALL SELECT sid || '#cut', step, v, 7 FROM ship_s WHERE part = 'past' AND step < 7), k AS (SELECT *, count(*) OVER (PARTITION BY sid, m) AS k FROM z)"""


@query("seasonal_error", f"{_TWO} SELECT a.sid, a.m::INTEGER AS m, round(avg(abs(a.v - b.v)), 4) AS err FROM k a LEFT JOIN k b ON b.sid = a.sid AND b.m = a.m AND b.step = a.step - CASE WHEN a.k >= a.m THEN a.m ELSE 1 END GROUP BY 1, 2")
def seasonal_error(spark, d):
    split = W.split_fixed(ship(spark, d), OFFSET, H)
    past = split.where("part = 'past'")
    short = past.where("step < 7").withColumn("sid", F.concat("sid", F.lit("#cut")))
    out = C.seasonal_error(past.unionByName(short), 7).unionByName(C.seasonal_error(past, 5000))
    return rounded(out, "err", digits=4)


@query("mase", f"WITH {SQL_EV}, {SQL_SHIP}, al AS (SELECT *, 7 AS m FROM ship UNION ALL SELECT *, 24 FROM ev), {sql_split('ship', OFFSET, H)}, {sql_mase('ship', M, H)}, {sql_split('ev', -48, 24)}, {sql_mase('ev', 24, 24)} SELECT sid, round(mase, 6) AS mase FROM (SELECT * FROM ship_a UNION ALL SELECT * FROM ev_a)")
def mase(spark, d):
    return rounded(_mase(ship(spark, d)).unionByName(_mase(ev(spark, d), 24, 24, -48)), "mase")


@query("dataset_score", f"WITH {SQL_SHIP}, {sql_split('ship', OFFSET, H)}, {sql_mase('ship', M, H)} SELECT 'ship_day' AS family, round(avg(mase), 6) AS mase, count(mase) AS n FROM ship_a")
def dataset_score(spark, d):
    return rounded(_mase(ship(spark, d)).groupBy(F.split("sid", ":")[0].alias("family")).agg(F.avg("mase").alias("mase"), F.count("mase").alias("n")), "mase")


@query("pinball", f"{_MASE} SELECT t.sid, q, round(avg({_PIN}), 4) AS loss FROM ship_s t JOIN ship_y y ON y.sid = t.sid AND y.step = t.step, {_LEVELS} WHERE t.part = 'target' GROUP BY 1, 2")
def pinball(spark, d):
    split, naive, _ = _scored(ship(spark, d))
    return rounded(C.quantile_losses(split, P.quantiles(naive, LEVELS)), "loss", digits=4)


@query("wql", f"""{_MASE}, l AS (SELECT q, sum({_PIN}) AS loss FROM ship_s t JOIN ship_y y ON y.sid = t.sid AND y.step = t.step, {_LEVELS} WHERE t.part = 'target' GROUP BY 1)
    SELECT 'ship_day' AS family, round(avg(loss / (SELECT sum(abs(v)) FROM ship_s WHERE part = 'target')), 6) AS wql FROM l""")
def wql(spark, d):
    split, naive, _ = _scored(ship(spark, d))
    return rounded(C.wql(split, P.quantiles(naive, LEVELS), F.split("sid", ":")[0]), "wql")


@query("crps", f"{_MASE} SELECT t.sid, round(avg({_PIN}), 4) AS crps FROM ship_s t JOIN ship_y y ON y.sid = t.sid AND y.step = t.step, {_LEVELS} WHERE t.part = 'target' GROUP BY 1")
def crps(spark, d):
    split, naive, _ = _scored(ship(spark, d))
    return rounded(C.crps(split, P.quantiles(naive, LEVELS)).groupBy("sid").agg(F.avg("loss").alias("crps")), "crps", digits=4)


_REF = "(SELECT * FROM (VALUES ('ship_day:A', 0.9), ('ship_day:N', 1.1)) r(sid, ref))"


def _published(spark):
    return spark.createDataFrame([("ship_day:A", 0.9), ("ship_day:N", 1.1)], "sid string, ref double")


@query("published_left_join", f"{_MASE} SELECT sid, round(mase, 6) AS mase, ref::DOUBLE AS ref, round(100 * (mase - ref) / ref, 4) AS dev_pct FROM ship_a LEFT JOIN {_REF} USING (sid)")
def published_left_join(spark, d):
    return rounded(rounded(C.against_published(_mase(ship(spark, d)), F.broadcast(_published(spark))), "mase"), "dev_pct", digits=4)


@query("deviation_band", f"{_MASE} SELECT sid, round(100 * (mase - ref) / ref, 4) AS dev_pct, round(2.5 + 3 * 18.5 / sqrt(14), 6) AS band_pct, abs(100 * (mase - ref) / ref) <= 2.5 + 3 * 18.5 / sqrt(14) AS pass FROM ship_a JOIN {_REF} USING (sid)")
def deviation_band(spark, d):
    s = C.against_published(_mase(ship(spark, d)), F.broadcast(_published(spark))).where("ref IS NOT NULL").withColumn("n", F.lit(14))
    return rounded(rounded(C.within_band(s), "band_pct"), "dev_pct", digits=4).select("sid", "dev_pct", "band_pct", "pass")


@query("score_spread", f"{_MASE} SELECT 'ship_day' AS family, round(avg(mase), 6) AS mean, round(stddev_samp(mase), 6) AS sd, round(min(mase), 6) AS least, round(max(mase), 6) AS most, round(median(mase), 6) AS median, round(100 * stddev_samp(mase) / avg(mase), 4) AS rel_sd_pct FROM ship_a")
def score_spread(spark, d):
    s = C.spread(_mase(ship(spark, d)).withColumn("family", F.split("sid", ":")[0]), ["family"], "mase")
    return rounded(rounded(s, "mean", "sd", "least", "most", "median"), "rel_sd_pct", digits=4)


@query("quantile_profile", f"""WITH {SQL_SHIP}, o AS (SELECT sid, list(v ORDER BY v) AS a FROM ship GROUP BY 1), p AS (SELECT sid, a, q, (len(a) - 1) * q AS r FROM o, (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]::DOUBLE[]) AS q))
    SELECT sid, q, round(a[floor(r)::INT + 1] + (r - floor(r)) * (a[least(floor(r)::INT + 2, len(a))] - a[floor(r)::INT + 1]), 4) AS v FROM p""")
def quantile_profile(spark, d):
    return rounded(G.quantile_profile(ship(spark, d), [i / 10 for i in range(11)]), "v", digits=4)


@query("acf", f"""WITH {SQL_SHIP}, {sql_pos('ship')}, c AS (SELECT sid, pos, v - avg(v) OVER (PARTITION BY sid) AS d FROM ship_p), e AS (SELECT sid, sum(d * d) AS e FROM c GROUP BY 1)
    SELECT a.sid, lag AS lag, round(sum(a.d * b.d) / any_value(e.e), 6) AS r FROM c a, range(1, 15) g(lag), c b, e WHERE b.sid = a.sid AND b.pos = a.pos + lag AND e.sid = a.sid GROUP BY 1, 2""")
def acf(spark, d):
    return rounded(G.autocorrelation(ship(spark, d), 14), "r")


@query("spectrum", f"""WITH {SQL_SHIP}, n AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY sid) AS n, v - avg(v) OVER (PARTITION BY sid) AS x, max(v) OVER (PARTITION BY sid) AS top FROM ship),
    c AS (SELECT sid, f, n, any_value(top) AS top, sum(x * cos(2 * pi() * ((f * t) % n) / n)) AS a, sum(x * sin(2 * pi() * ((f * t) % n) / n)) AS b FROM n, range(0, 3000) g(f) WHERE f <= n // 2 GROUP BY 1, 2, 3)
    SELECT sid, f::BIGINT AS f, round((a / top) ** 2 + (b / top) ** 2, 4) AS power FROM c""")
def spectrum(spark, d):
    """Power of every frequency of each daily series, whole, in units of its largest value."""
    s = ship(spark, d)
    scaled = s.join(s.groupBy("sid").agg(F.max("v").alias("top")), "sid").select("sid", "ts", (F.col("v") / F.col("top")).alias("v"))
    return rounded(G.spectrum(scaled), "power", digits=4)


@query("sliding_stats", f"""WITH {SQL_EV}, {sql_pos('ev')} SELECT sid, pos, round(m, 7) AS mean, round(s, 7) AS std FROM (SELECT sid, pos, n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM ev_p WINDOW w AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE pos <= n - 24""")
def sliding_stats(spark, d):
    return rounded(D.sliding_stats(ev(spark, d), 24), "mean", "std", digits=7)


_W = 24
_QUERIES = f"""{sql_pos('ev')}, s AS (SELECT sid, row_number() OVER (ORDER BY sid) AS rk FROM (SELECT DISTINCT sid FROM ev)),
    q AS (SELECT 'copy' AS query, pos - 100 AS i, v FROM ev_p JOIN s USING (sid) WHERE rk = 1 AND pos BETWEEN 100 AND 123
    UNION ALL SELECT 'rescaled', pos - 60, v * 1000 - 47.5 FROM ev_p JOIN s USING (sid) WHERE rk = 2 AND pos BETWEEN 60 AND 83
    UNION ALL SELECT 'other', i, ((i * 7919) % 101)::DOUBLE FROM range(0, 24) r(i))"""
_PROFILE = f"""{_QUERIES}, qz AS (SELECT query, i, (v - avg(v) OVER (PARTITION BY query)) / stddev_pop(v) OVER (PARTITION BY query) AS z FROM q),
    st AS (SELECT * FROM (SELECT sid, pos, n, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM ev_p WINDOW w AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)) WHERE pos <= n - 24),
    pr AS (SELECT query, st.sid, st.pos AS "offset", sqrt(2 * greatest(0, least(4, 1 - sum(z * (e.v - m) / s) / 24))) AS rms FROM st, qz, ev_p e WHERE e.sid = st.sid AND e.pos = st.pos + qz.i GROUP BY 1, 2, 3)"""


def _queries(spark, d):
    """A copy out of the first series by name, a rescaled one out of the second, and noise."""
    p = S.positions(ev(spark, d))
    first = p.agg(F.min("sid").alias("one"))
    names = first.join(p.join(F.broadcast(first), F.col("sid") > F.col("one")).agg(F.min("sid").alias("two")))
    p = p.join(F.broadcast(names), F.col("sid").isin(F.col("one"), F.col("two")))
    cut = lambda name, column, a, f: p.where((F.col("sid") == F.col(column)) & F.col("pos").between(a, a + _W - 1)).select(F.lit(name).alias("query"), (F.col("pos") - a).alias("i"), f(F.col("v")).alias("v"))
    noise = spark.range(_W).select(F.lit("other").alias("query"), F.col("id").alias("i"), (F.col("id") * 7919 % 101).cast("double").alias("v"))
    rows = cut("copy", "one", 100, lambda v: v).unionByName(cut("rescaled", "two", 60, lambda v: v * 1000 - 47.5)).unionByName(noise)
    held = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("o")).where(F.size("o") == _W)
    return held.select("query", F.transform("o", lambda x: x["v"]).alias("q"))


@query("znorm_profile", f"WITH {SQL_EV}, {_PROFILE} SELECT query, sid, \"offset\", round(rms, 5) AS rms FROM pr")
def znorm_profile(spark, d):
    return rounded(D.profiles(_queries(spark, d), ev(spark, d)), "rms", digits=5)


def _found(spark, d):
    q = _queries(spark, d)
    return q, D.matches(q, ev(spark, d))


@query("match_best", f"WITH {SQL_EV}, {_PROFILE} SELECT query, sid, \"offset\", round(rms, 5) AS rms, CASE WHEN rms <= 0.05 THEN 'match' ELSE 'near-miss' END AS kind FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query ORDER BY rms, sid, \"offset\") = 1) WHERE rms <= 0.25")
def match_best(spark, d):
    return rounded(D.best_match(_found(spark, d)[1]), "rms", digits=5)


@query("match_counts", f"WITH {SQL_EV}, {_PROFILE}, b AS (SELECT query, min(rms) AS rms FROM pr GROUP BY 1) SELECT CASE WHEN rms <= 0.05 THEN 'match' WHEN rms <= 0.25 THEN 'near-miss' ELSE 'none' END AS kind, count(*) AS n FROM b GROUP BY 1")
def match_counts(spark, d):
    q, found = _found(spark, d)
    return D.match_counts(q, D.best_match(found))


@query("block_length", f"""WITH {SQL_EV}, {SQL_SHIP}, al AS (SELECT sid, 24 AS m FROM ev UNION ALL SELECT sid, 7 FROM ship) SELECT sid, count(*) AS n, any_value(m)::INTEGER AS m, least(greatest(round_even(count(*) ** (1.0 / 3), 0)::BIGINT, any_value(m)), count(*))::BIGINT AS l FROM al GROUP BY sid""")
def block_length(spark, d):
    al = ev(spark, d).withColumn("m", F.lit(24)).unionByName(ship(spark, d).withColumn("m", F.lit(7)))
    n = al.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"))
    return n.withColumn("l", X.block_length(F.col("n"), F.col("m")))


_BOOT = """b AS (SELECT sid, k, j, n, l, ('0x' || substr(sha256('20260726|' || fam || '|' || sid || '|' || k || '|' || j), 9, 8))::BIGINT % (n - l + 1) AS start
        FROM (SELECT fam, sid, n, CASE WHEN fam = 'block' THEN least(greatest(round_even(n ** (1.0 / 3), 0)::BIGINT, 7), n) ELSE 1 END AS l FROM (SELECT DISTINCT sid, n FROM {0}_p), (SELECT unnest([{1}]) AS fam)), range(0, {2}) r(k), range(0, 3000) u(j) WHERE j * l < n),
    boot AS (SELECT b.sid, b.k, b.j * b.l + i AS pos, p.v, b.l FROM b, range(0, 3000) t(i), {0}_p p WHERE i < b.l AND b.j * b.l + i < b.n AND p.sid = b.sid AND p.pos = b.start + i)"""


@query("block_bootstrap", f"WITH {SQL_SHIP}, {sql_pos('ship')}, {_BOOT.format('ship', chr(39) + 'block' + chr(39), 5)} SELECT sid, k, pos, v FROM boot")
def block_bootstrap(spark, d):
    return G.block_bootstrap(ship(spark, d), M, 5)


_TAIL = f"{sql_pos('ship')}, tl AS (SELECT sid, ts, v FROM ship_p WHERE pos >= n - 256), tl_p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n FROM tl)"


@query("iaaft_invariant", f"WITH {SQL_SHIP}, {_TAIL} SELECT sid, k, count(*) AS n, round(sum(v), 2) AS total, min(v) AS least, max(v) AS most, round(median(v), 4) AS median FROM tl, range(0, 3) r(k) GROUP BY 1, 2")
def iaaft_invariant(spark, d):
    s = G.iaaft_ensemble(S.tail(ship(spark, d), 256).select("sid", "ts", "v"), 3).select("sid", "k", F.explode("surrogate").alias("v"))
    return rounded(rounded(s.groupBy("sid", "k").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.median("v").alias("median")), "total", digits=2), "median", digits=4)


@query("iaaft")
def iaaft(spark, d):
    return G.iaaft_ensemble(S.tail(ship(spark, d), 256).select("sid", "ts", "v"), 3)


@query("surrogate_validation")
def surrogate_validation(spark, d):
    t = S.tail(ship(spark, d), 256).select("sid", "ts", "v")
    return G.validation_report(t, G.iaaft_ensemble(t, Protocol().surrogates))


_K = Protocol().surrogates
_REAL = f"""r_s AS (SELECT sid, CASE WHEN pos < n - 14 THEN 'past' ELSE 'target' END AS part, CASE WHEN pos < n - 14 THEN pos ELSE pos - (n - 14) END AS step, v FROM tl_p), {sql_mase('r', M, H)}"""


def _surr(family: str) -> str:
    name = "x" if family == "block" else "u"
    boot = _BOOT.format("tl", f"'{family}'", _K).replace("b AS (", f"{name}b AS (", 1).replace("boot AS (", f"{name}boot AS (").replace("FROM b, range(0, 3000) t", f"FROM {name}b b, range(0, 3000) t")
    return f"""{boot}, {name}_s AS (SELECT sid || '@' || k AS sid, CASE WHEN pos < 242 THEN 'past' ELSE 'target' END AS part, CASE WHEN pos < 242 THEN pos ELSE pos - 242 END AS step, v FROM {name}boot), {sql_mase(name, M, H)},
    {name}_m AS (SELECT split_part(sid, '@', 1) AS sid, '{family}' AS family, mase FROM {name}_a)"""


_GAP = f"WITH {SQL_SHIP}, {_TAIL}, {_REAL}, {_surr('block')}"
_TESTS = f"""WITH {SQL_SHIP}, {_TAIL}, {_REAL}, {_surr('block')}, {_surr('single')}, al AS (SELECT * FROM x_m UNION ALL SELECT * FROM u_m),
    pv AS (SELECT a.sid, family, (1 + count(*) FILTER (a.mase <= r.mase)) / (count(a.mase) + 1.0::DOUBLE) AS p, (median(a.mase) - any_value(r.mase)) / median(a.mase) AS g FROM al a JOIN r_a r ON r.sid = a.sid GROUP BY 1, 2),
    bh AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, sid) AS raw, row_number() OVER (PARTITION BY family ORDER BY p, sid) AS rk FROM pv),
    ad AS (SELECT *, least(1, min(raw) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM bh)"""


def _members(spark, d, families):
    """(sid, family, k, r, s): scores of the last 256 points of each series and, beside them, of its surrogates.

    One scan: the real score rides with its series, and a member is one row.
    """
    series = G.held(S.tail(ship(spark, d), 256)).withColumn("r", C.array_mase(F.col("x"), H, M))
    return G.ensembles(series, families, M, _K).select("sid", "family", "k", "r", C.array_mase(F.col("x"), H, M).alias("s"))


@query("surrogate_gap", f"{_GAP} SELECT r.sid, round(any_value(r.mase), 6) AS real, round(median(x.mase), 6) AS median, round(100 * (median(x.mase) - any_value(r.mase)) / median(x.mase), 4) AS gap_pct FROM x_m x JOIN r_a r ON r.sid = x.sid GROUP BY 1")
def surrogate_gap(spark, d):
    med = _members(spark, d, ("block",)).groupBy("sid").agg(F.first("r").alias("real"), F.median("s").alias("median"))
    g = med.withColumn("gap_pct", X.gap_pct(F.col("real"), F.col("median")))
    return rounded(rounded(g, "real", "median"), "gap_pct", digits=4)


def _tests(spark, d, families=("block", "single")):
    return V.rank_members(_members(spark, d, families), ("sid", "family"))


@query("rank_pvalue", f"{_TESTS} SELECT sid, family, round(p, 6) AS p, round(g, 6) AS g FROM pv")
def rank_pvalue(spark, d):
    return rounded(_tests(spark, d), "p", "g")


def _bh(spark, d, families=("block", "single")):
    return V.benjamini_hochberg(_tests(spark, d, families), ["family"], Protocol().fdr)


@query("bh_fdr", f"{_TESTS} SELECT sid, family, round(p, 6) AS p, round(g, 6) AS g, round(p_adj, 6) AS p_adj, p_adj <= 0.1 AS fires FROM ad")
def bh_fdr(spark, d):
    return rounded(_bh(spark, d), "p", "g", "p_adj")


@query("firing_verdict", f"""{_TESTS}, v AS (SELECT 'ship_day' AS dataset, avg((family = 'block' AND p_adj <= 0.1)::INT) FILTER (family = 'block') AS br, median(g) FILTER (family = 'block') AS be, avg((p_adj <= 0.1)::INT) FILTER (family = 'single') AS sr, median(g) FILTER (family = 'single') AS se FROM ad)
    SELECT dataset, round(br, 6) AS block_rate, round(be, 6) AS block_effect, round(sr, 6) AS single_rate, round(se, 6) AS single_effect,
           CASE WHEN least(br, sr) >= 0.2 AND least(be, se) > 0 THEN 'fires' ELSE 'silent' END AS verdict FROM v""")
def firing_verdict(spark, d):
    t = _bh(spark, d).withColumn("dataset", F.split("sid", ":")[0])
    out = V.firing(t, ["dataset"], Protocol().firing, 0.0, ("block", "single"))
    return rounded(out, "block_rate", "block_effect", "single_rate", "single_effect")


@query("null_control")
def null_control(spark, d):
    """The protocol's own pair of families, each of a hundred surrogates; Fourier surrogates have no SQL form."""
    families = Protocol().families
    t = _bh(spark, d, families).withColumn("dataset", F.split("sid", ":")[0])
    return rounded(V.firing(t, ["dataset"], Protocol().firing, 0.0, families), *[f"{f}_{x}" for f in families for x in ("rate", "effect")])


@query("median_ratio", f"""{_MASE}, w AS (SELECT sid, (step - (k - 28)) % 7 AS ph, avg(v) AS yhat FROM ship_k WHERE k >= 28 AND step >= k - 28 GROUP BY 1, 2), sw AS (SELECT t.sid, avg(abs(t.v - w.yhat)) / any_value(err) AS mase FROM ship_s t JOIN w ON w.sid = t.sid AND w.ph = t.step % 7 JOIN ship_e e ON e.sid = t.sid WHERE t.part = 'target' GROUP BY 1)
    SELECT 'ship_day' AS family, round(median(sw.mase / a.mase), 6) AS ratio FROM sw JOIN ship_a a USING (sid)""")
def median_ratio(spark, d):
    split, naive, errors = _scored(ship(spark, d))
    swa = C.mase(split, P.seasonal_average(split, H, M), errors)
    return rounded(C.median_ratio(swa, C.mase(split, naive, errors), F.split("sid", ":")[0]), "ratio")


def _rolling_scores(spark, d):
    return C.rolling_mase(ship(spark, d), H, M)


_ROLL = f"""WITH {SQL_SHIP}, {sql_pos('ship')}, c AS (SELECT least(greatest(ceil(0.1 * min(n) / 14), 1), 20)::BIGINT AS w FROM ship_p),
    e AS (SELECT p.*, i AS window_index, n - 14 * (w - i) AS s FROM ship_p p, c, range(0, 20) r(i) WHERE i < w),
    z_s AS (SELECT sid || '@' || window_index AS sid, CASE WHEN pos < s THEN 'past' ELSE 'target' END AS part, CASE WHEN pos < s THEN pos ELSE pos - s END AS step, v FROM e WHERE s > 0 AND pos < s + 14), {sql_mase('z', M, H)},
    rs AS (SELECT split_part(sid, '@', 1) AS sid, split_part(sid, '@', 2)::INT AS window_index, mase FROM z_a)"""


@query("rolling_scores", f"{_ROLL} SELECT sid, window_index, round(mase, 6) AS mase FROM rs")
def rolling_scores(spark, d):
    return rounded(_rolling_scores(spark, d), "mase")


@query("bootstrap_ci", f"""{_ROLL}, nb AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY window_index) - 1 AS i, count(*) OVER (PARTITION BY sid) AS n FROM rs WHERE mase IS NOT NULL), sz AS (SELECT DISTINCT sid, n FROM nb),
    dr AS (SELECT sid, b, ('0x' || substr(sha256('20260726|bootstrap|' || sid || '|' || b || '|' || j), 9, 8))::BIGINT % n AS i FROM sz, range(0, 2000) r(b), range(0, 20) u(j) WHERE j < n),
    me AS (SELECT dr.sid, b, avg(mase) AS m FROM dr JOIN nb ON nb.sid = dr.sid AND nb.i = dr.i GROUP BY 1, 2) SELECT sid, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM me GROUP BY 1""")
def bootstrap_ci(spark, d):
    return rounded(V.bootstrap_interval(_rolling_scores(spark, d), Protocol().resamples), "lo", "hi")


@query("left_pad", f"""{_SPLIT}, a AS (SELECT sid, list(v ORDER BY step) AS p FROM ship_s WHERE part = 'past' GROUP BY 1)
    SELECT sid, least(len(p), 4096)::BIGINT AS observed, greatest(0, 4096 - len(p))::BIGINT AS padding, round(list_sum(p[-4096:]), 2) AS total FROM a""")
def left_pad(spark, d):
    a = W.left_pad(W.as_arrays(W.split_fixed(ship(spark, d), OFFSET, H), ["sid"]), "past", 4096)
    many = lambda c: F.size(F.filter(c, lambda x: x)).cast("bigint")
    return rounded(a.select("sid", many("observed").alias("observed"), many("is_pad").alias("padding"), F.aggregate("padded", F.lit(0.0), lambda s, x: s + x).alias("total")), "total", digits=2)


@query("forecast_cache", "SELECT o_custkey AS window_id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def forecast_cache(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("window_id"))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("window_id"))
    return P.cached(wanted, known, ("window_id",)).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))


@query("relative_difference", f"{_MASE} SELECT sid, round(median(abs(v - yhat) / greatest(abs(v), 1e-8)), 6) AS median FROM ship_s JOIN ship_y USING (sid, step) WHERE part = 'target' GROUP BY 1")
def relative_difference(spark, d):
    split, naive, _ = _scored(ship(spark, d))
    t = split.where("part = 'target'").join(naive, ["sid", "step"])
    return rounded(t.groupBy("sid").agg(F.median(X.relative_difference(F.col("v"), F.col("yhat"))).alias("median")), "median")


@query("published_strict", f"""{_MASE} SELECT sid, round(mase, 6) AS mase, length(sid)::DOUBLE AS ref, round(100 * (mase - length(sid)) / length(sid), 4) AS dev_pct FROM ship_a""")
def published_strict(spark, d):
    """Every series has a published score, or the join raises."""
    s = ship(spark, d)
    published = s.select("sid").distinct().withColumn("ref", F.length("sid").cast("double"))
    return rounded(rounded(C.against_published(_mase(s), published, strict=True), "mase"), "dev_pct", digits=4)


@query("closest_score", f"""{_MASE}, al AS (SELECT 'naive' AS model, sid, mase FROM ship_a UNION ALL SELECT 'half', sid, mase / 2 FROM ship_a)
    SELECT sid, model, round(mase, 6) AS mase, round(100 * (mase - 0.9) / 0.9, 4) AS dev_pct FROM al QUALIFY row_number() OVER (PARTITION BY sid ORDER BY abs(mase - 0.9), model) = 1""")
def closest_score(spark, d):
    """Of several runs of a model the one whose score is closest to the published 0.9."""
    s = _mase(ship(spark, d))
    runs = s.select("sid", F.lit("naive").alias("model"), "mase").union(s.select("sid", F.lit("half"), F.col("mase") / 2))
    runs = runs.withColumn("dev_pct", X.deviation_pct(F.col("mase"), F.lit(0.9)))
    return rounded(rounded(V.best_row(runs, ["sid"], F.col("dev_pct")), "mase"), "dev_pct", digits=4)


@query("forecast_equivalence", f"""{_MASE}, y2 AS (SELECT sid, step, yhat * (1 + 0.0001 * (step % 3)) AS yhat FROM ship_y),
    a2 AS (SELECT t.sid, avg(abs(t.v - y.yhat)) / nullif(any_value(e.err), 0) AS mase FROM ship_s t JOIN y2 y ON y.sid = t.sid AND y.step = t.step JOIN ship_e e ON e.sid = t.sid WHERE t.part = 'target' GROUP BY t.sid),
    p AS (SELECT count(*) AS points, median(abs(a.yhat - b.yhat) / greatest(abs(a.yhat), 1e-8)) AS median_rel, quantile_cont(abs(a.yhat - b.yhat) / greatest(abs(a.yhat), 1e-8), 0.95) AS p95_rel,
        max(abs(a.yhat - b.yhat) / greatest(abs(a.yhat), 1e-8)) AS max_rel, max(abs(a.yhat - b.yhat)) AS max_abs FROM ship_y a JOIN y2 b USING (sid, step)),
    m AS (SELECT (SELECT avg(mase) FROM ship_a) AS a, (SELECT avg(mase) FROM a2) AS b)
    SELECT points, round(median_rel, 8) AS median_rel, round(p95_rel, 8) AS p95_rel, round(max_rel, 8) AS max_rel, round(max_abs, 4) AS max_abs, round(a, 6) AS mase_a, round(b, 6) AS mase_b, round(100 * abs(b - a) / a, 6) AS mase_diff_pct,
        median_rel < 0.001 AND 100 * abs(b - a) / a < 0.5 AS equivalent FROM p, m""")
def forecast_equivalence(spark, d):
    """Seasonal-naive forecasts against a copy that is off by up to two in ten thousand."""
    split, naive, errors = _scored(ship(spark, d))
    other = naive.withColumn("yhat", F.col("yhat") * (1 + F.lit(0.0001) * (F.col("step") % 3)))
    out = C.equivalence(split, naive, other, errors)
    return rounded(rounded(rounded(out, "median_rel", "p95_rel", "max_rel", digits=8), "max_abs", digits=4), "mase_a", "mase_b", "mase_diff_pct")


@query("customer_backtest", """WITH o AS (SELECT o_custkey::VARCHAR AS sid, o_orderkey, o_orderdate, o_totalprice AS v FROM orders),
    p AS (SELECT sid, v, row_number() OVER (PARTITION BY sid ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n FROM o),
    e AS (SELECT sid, avg(abs(v - u)) AS err, count(*) + 1 AS k FROM (SELECT sid, pos, n, v, lag(v) OVER (PARTITION BY sid ORDER BY pos) AS u FROM p) WHERE pos < n - 2 AND pos > 0 GROUP BY 1),
    t AS (SELECT a.sid, avg(abs(a.v - b.v)) AS mae FROM p a JOIN p b ON b.sid = a.sid AND b.pos = a.n - 3 WHERE a.pos >= a.n - 2 GROUP BY 1)
    SELECT t.sid, round(mae / nullif(err, 0), 6) AS mase FROM t LEFT JOIN e USING (sid)""")
def customer_backtest(spark, d):
    """A backtest of many short series: the last two orders of each customer from the one before them."""
    o = table(spark, d, "orders")
    # orders of one day follow their keys
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    rows = o.select(F.col("o_custkey").cast("string").alias("sid"), ts.alias("ts"), F.col("o_totalprice").cast("double").alias("v"))
    return rounded(_mase(rows, 1, 2, -2), "mase")


@query("split_by_config", f"""WITH {SQL_SHIP}, {SQL_EV}, al AS (SELECT * FROM ship UNION ALL SELECT * FROM ev), {sql_pos('al')}, c AS (SELECT * FROM (VALUES ('ship_day', -28, 14), ('ev_hour', -48, 24)) t(name, o, h))
    SELECT sid, CASE WHEN pos < n + o THEN 'past' ELSE 'target' END AS part, CASE WHEN pos < n + o THEN pos ELSE pos - (n + o) END AS step, v FROM al_p JOIN c ON name = split_part(sid, ':', 1) WHERE n + o > 0 AND pos < n + o + h""")
def split_by_config(spark, d):
    configs = spark.createDataFrame([("ship_day", -28, 14), ("ev_hour", -48, 24)], "name string, offset int, h int")
    return W.split_by_config(ship(spark, d).union(ev(spark, d)), configs, F.split("sid", ":")[0])


@query("nested_windows", """WITH x AS (SELECT vec_id::VARCHAR AS sid, (i - 1)::INTEGER AS dimension, embedding[(i - 1) * 16 + 1 : i * 16] AS x FROM embeddings, range(1, 3) r(i)), c AS (SELECT least(greatest(ceil(0.1 * min(len(x)) / 1), 1), 20)::INTEGER AS w FROM x),
    e AS (SELECT sid, dimension, i::INTEGER AS window_index, x, len(x) - (w - i) AS s FROM x, c, range(0, 20) r(i) WHERE i < w)
    SELECT sid, dimension, window_index, s::INTEGER AS n_past, round(x[s + 1]::DOUBLE, 6) AS target FROM e WHERE s > 0""")
def nested_windows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sid"), F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(2)]).alias("target"))
    w = W.nested_windows(e, 1)
    return rounded(w.select("sid", "dimension", "window_index", F.size("past").alias("n_past"), F.element_at("target", 1).cast("double").alias("target")), "target")


@query("context_factor", "SELECT n_nationkey AS trained, round(greatest(1.0, (512 + 24) / (n_nationkey * 32 + 32)), 6) AS factor FROM nation")
def context_factor(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("trained"))
    return rounded(t.withColumn("factor", X.context_factor(F.lit(512), F.lit(24), F.col("trained") * 32 + 32)), "factor")


@query("match_declared", f"WITH {SQL_EV}, {_PROFILE}, dl AS (SELECT 'copy' AS query, sid FROM s WHERE rk = 1 UNION ALL SELECT 'rescaled', sid FROM s WHERE rk = 1) SELECT query, sid, min(rms) <= 0.05 AS is_match FROM pr JOIN dl USING (query, sid) GROUP BY 1, 2 HAVING min(rms) <= 0.25")
def match_declared(spark, d):
    """Only declared pairs are searched: the copy in its own series, the rescaled copy where it isn't."""
    first = ev(spark, d).agg(F.min("sid").alias("sid"))
    pairs = first.select(F.explode(F.array(F.lit("copy"), F.lit("rescaled"))).alias("query"), "sid")
    found = D.matches(_queries(spark, d), ev(spark, d), pairs)
    return found.groupBy("query", "sid").agg((F.min("rms") <= D.MATCH).alias("is_match"))


def _forecaster(name):
    def run(spark, d):
        w = W.as_arrays(W.split_fixed(S.tail(ship(spark, d), 256).select("sid", "ts", "v"), -H, H), ["sid"])
        return rounded(P.apply_forecaster(w, P.FORECASTERS[name], H, M), "yhat", digits=2)

    return run


_SMOOTHED = """sm AS (SELECT sid, k, list_reduce(list_transform(x, lambda v: {'v': v, 'l': v, 'c': 0.0::DOUBLE}), lambda s, e: {'v': e.v, 'l': s.l + (k / 20.0) * (e.v - s.l), 'c': s.c + (e.v - s.l) ** 2}) AS r FROM p, range(1, 21) g(k)),
    lv AS (SELECT sid, r.l AS level FROM sm QUALIFY row_number() OVER (PARTITION BY sid ORDER BY r.c, k) = 1)"""
_SES = f"""WITH {SQL_SHIP}, {_TAIL}, p AS (SELECT sid, list(v ORDER BY pos) AS x FROM tl_p WHERE pos < n - 14 GROUP BY 1), {_SMOOTHED}
    SELECT sid, s.step::BIGINT AS step, round(level, 2) AS yhat FROM lv, range(0, 14) s(step)"""
_THETA = f"""WITH {SQL_SHIP}, {_TAIL}, pt AS (SELECT sid, pos, n - 14 AS past, v FROM tl_p WHERE pos < n - 14), se AS (SELECT sid, pos % 7 AS ph, avg(v) - any_value(m) AS season FROM (SELECT *, avg(v) OVER (PARTITION BY sid) AS m FROM pt) GROUP BY 1, 2),
    fl AS (SELECT pt.sid, pos, past, v - season AS f FROM pt JOIN se ON se.sid = pt.sid AND se.ph = pt.pos % 7), p AS (SELECT sid, list(f ORDER BY pos) AS x, any_value(past) AS past, regr_slope(f, pos) AS slope FROM fl GROUP BY 1), {_SMOOTHED}
    SELECT p.sid, s.step::BIGINT AS step, round(level + slope / 2 * (s.step + 1) + season, 2) AS yhat FROM p JOIN lv USING (sid), range(0, 14) s(step), se WHERE se.sid = p.sid AND se.ph = (p.past + s.step) % 7"""
for _name, _key, _sql in (("harmonic", "harmonic_ols", None), ("ar", "ar_ols", None), ("ses", "ses_forecast", _SES), ("theta", "theta_forecast", _THETA)):
    query(_key, _sql)(_forecaster(_name))


@query("frozen_inputs", f"""{_MASE}, c AS (SELECT sid, list(v ORDER BY step) AS p FROM ship_s WHERE part = 'past' GROUP BY 1), t AS (SELECT sid, count(*) AS horizon, sum(v) AS total FROM ship_s WHERE part = 'target' GROUP BY 1)
    SELECT sid, least(len(p), 512)::BIGINT AS context, horizon, round(total, 2) AS target, round(err, 4) AS seasonal_error FROM c JOIN t USING (sid) JOIN ship_e USING (sid)""")
def frozen_inputs(spark, d):
    split, _, errors = _scored(ship(spark, d))
    f = P.frozen_inputs(W.as_arrays(split, ["sid"]), errors, 512)
    total = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    return rounded(rounded(f.select("sid", F.size("context").cast("bigint").alias("context"), "horizon", total.alias("target"), "seasonal_error"), "target", digits=2), "seasonal_error", digits=4)


@query("order_segments", f"WITH {SQL_ORD}, {sql_segments('ord', 12)} SELECT sid, segment_number, segments_found, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM ord_g GROUP BY 1, 2, 3")
def order_segments(spark, d):
    return S.segment_table(ord_(spark, d), 12).select("sid", "segment_number", "segments_found", stamp("start"), stamp("end"), "n")


@query("recall_gate", "SELECT user_id % 10 AS planted, count(*) AS n, count(*) FILTER (event_id % 8 > 0) AS matched, count(*) FILTER (event_id % 8 > 0) >= floor(0.9 * count(*)) AS pass FROM events GROUP BY 1")
def recall_gate(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("planted")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 8 > 0).alias("matched"))
    return e.withColumn("pass", D.passes_gate(F.col("matched"), F.col("n")))


@query("frozen_scan", f"{_SPLIT}, a AS (SELECT sid, list(v ORDER BY step) FILTER (part = 'past') AS p, list(v ORDER BY step) FILTER (part = 'target') AS t FROM ship_s GROUP BY 1) SELECT sid, 64::BIGINT AS context, 14::BIGINT AS horizon, round(list_sum(p[-64:]), 2) AS total FROM a")
def frozen_scan(spark, d):
    """Frozen inputs are read back only in the shape that they were frozen in."""
    w = W.as_arrays(W.split_fixed(ship(spark, d), OFFSET, H), ["sid"]).withColumn("context", F.slice("past", -64, 64))
    f = tables.frozen(w, 64, H)
    total = F.aggregate("context", F.lit(0.0), lambda a, x: a + x)
    return rounded(f.select("sid", F.size("context").cast("bigint").alias("context"), F.size("target").cast("bigint").alias("horizon"), total.alias("total")), "total", digits=2)


@query("corpus_hits", f"""WITH {SQL_EV}, {_PROFILE}, h AS (SELECT sid, query, rms FROM (SELECT query, sid, min(rms) AS rms FROM pr GROUP BY 1, 2) WHERE rms <= 0.25), z AS (SELECT sid AS subset, count(*)::DOUBLE AS mb FROM ev GROUP BY 1)
    SELECT subset, mb, CASE WHEN mb > 690 THEN 'skipped_size' WHEN count(query) > 0 THEN 'hits' ELSE 'clean' END AS status, count(query)::BIGINT AS n_hits FROM z LEFT JOIN h ON h.sid = z.subset GROUP BY 1, 2""")
def corpus_hits(spark, d):
    """Each series as a part of a corpus, with what was found in it; parts over the size are said to be left out."""
    q, found = _found(spark, d)
    best = found.groupBy("query", "sid").agg(F.min("rms").alias("rms")).withColumn("subset", F.col("sid"))
    subsets = ev(spark, d).groupBy(F.col("sid").alias("subset")).agg(F.count(F.lit(1)).cast("double").alias("mb"))
    status = D.corpus_status(subsets, 690.0, best)
    return status.select("subset", "mb", "status", F.coalesce(F.size("hits"), F.lit(0)).cast("bigint").alias("n_hits"))
