"""Statistics, recursions and models without SQL, against plain Python."""

import datetime
import math
import random

import numpy as np
import pytest

from chronopanel.operators import aggregates, models, recursive, stats
from chronopanel.plans import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2000, 1, 3)


def density(x, df):
    return math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)


@pytest.mark.parametrize("t,df", [(0.0, 3), (1.3, 2), (-0.7, 5), (2.6, 30), (4.0, 100)])
def test_t_upper_by_integration(t, df):
    x = np.linspace(0, abs(t), 20_001)
    y = np.array([density(v, df) for v in x])
    half = ((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()
    assert stats.t_upper(t, df) == pytest.approx(0.5 - math.copysign(half, t), abs=1e-8)


def large_sums(spark, **more):
    """3,000 rows whose n * ss passes 2^63, and their exact t."""
    values = [20_000_000 - 7 * (i % 2) if i % 3 else -10_000_000 for i in range(3000)]
    n, s, ss = len(values), sum(values), sum(v * v for v in values)
    assert ss < 2**63 < n * ss
    df = spark.createDataFrame([("a", v) for v in values], "label string, y long").withColumns(more)
    return df, n, (s / n) / (math.sqrt((n * ss - s * s) / (n * (n - 1))) / math.sqrt(n))


def test_conditional_t_of_large_sums(spark):
    df, n, t = large_sums(spark)
    got = stats.conditional_t(df, "y", "label", spark.createDataFrame([("a", 9)], "label string, episodes int"), 5).first()
    assert got["n"] == n and got["t"] == pytest.approx(t, abs=1e-8) and got["p"] == pytest.approx(stats.t_upper(t, n - 1), abs=1e-12)
    doubles = stats.t_moments(df.withColumn("y", F.col("y").cast("double")), "y", ["label"]).first()
    assert doubles["t"] == pytest.approx(t, rel=1e-8)


def test_screen_of_large_sums(spark):
    df, _, t = large_sums(spark, part=F.explode(F.array(F.lit(True), F.lit(False))))
    got = stats.screen_and_test(df, "y", ["label"], F.col("part"), 20, 0.5, 1.645).first()
    assert got["t_inner"] == got["t_outer"] == pytest.approx(t, abs=1e-8) and got["verdict"] == "confirmed"


def test_trade_metrics_without_wins_or_losses(spark):
    rows = [("lost", -3), ("lost", -5), ("lost", 0), ("won", 4), ("won", 2), ("even", 0), ("both", 6), ("both", -4), ("open", None)]
    out = aggregates.trade_metrics(spark.createDataFrame(rows, "run string, pnl long"), "pnl", "run")
    got = {r["run"]: tuple(r)[1:] for r in out.select("run", "n_closed", "win_rate", "profit_factor", "mean_win", "mean_loss").collect()}
    assert got == {"lost": (3, 0.0, None, None, 4.0), "won": (2, 1.0, None, 3.0, None), "even": (1, 0.0, None, None, None), "both": (2, 0.5, 1.5, 6.0, 4.0)}


def test_left_join_of_features_is_one_pass(spark):
    """The lines are read once, and dealt once."""
    df = QUERIES["c02_feature_left_join"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [") == 1
    assert plan.executedPlan().toString().count("Exchange ") == 1


def test_one_sample_t(spark):
    rows = [("a", v) for v in (1.0, 2.0, 4.0, 3.0)] + [("b", 5.0)] + [("c", 2.0)] * 3 + [("d", -1.0), ("d", -2.0), ("d", None)]
    got = {r["k"]: r for r in stats.one_sample_t(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    x = np.array([1.0, 2, 4, 3])
    t = x.mean() / (x.std(ddof=1) / 2)
    assert got["a"]["t"] == pytest.approx(t) and got["a"]["p"] == pytest.approx(stats.t_upper(t, 3))
    assert (got["b"]["p"], got["c"]["p"], got["c"]["t"]) == (1.0, 1.0, None) and got["d"]["p"] > 0.5


def test_hac_interaction(spark):
    rng = np.random.default_rng(3)
    n = 60
    s, c = rng.normal(size=n), rng.normal(size=n)
    y = 0.5 * s - 0.2 * c + 0.8 * s * c + rng.normal(size=n)
    rows = [("k", DAY + datetime.timedelta(i), float(y[i]), float(s[i]), float(c[i])) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([("k", datetime.date.fromisoformat(str(r[1])), float(r[2]), float(r[3]), float(r[4])) for r in rows], "k string, d date, y double, s double, c double")
    got = stats.hac_interaction(df, "y", "s", "c", ["k"], "d").first()
    x = np.column_stack([np.ones(n), s, c, s * c])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e, lags = y - x @ beta, int(4 * (n / 100) ** (2 / 9))
    meat = np.zeros((4, 4))
    for i in range(n):
        for j in range(n):
            if abs(i - j) <= lags:
                meat += (1 - abs(i - j) / (lags + 1)) * e[i] * e[j] * np.outer(x[i], x[j])
    bread = np.linalg.inv(x.T @ x)
    t = beta[3] / math.sqrt((bread @ meat @ bread)[3, 3])
    assert got["beta"] == pytest.approx(beta[3]) and got["t"] == pytest.approx(t) and got["p"] == pytest.approx(2 * stats.t_upper(abs(t), n - 4))


def test_bootstrap_spa(spark):
    rng = np.random.default_rng(5)

    def frame(shifts):
        return spark.createDataFrame([(f"u{k}", i, float(x)) for k, m in enumerate(shifts) for i, x in enumerate(rng.normal(m, 1, 80))], "u string, i int, v double")

    df = frame([0.0, 0.3])
    scale = {r["u"]: r for r in stats.hac_scale(df, "u", "i", "v", 3).collect()}
    for u in ("u0", "u1"):
        x = np.array([r["v"] for r in df.where(F.col("u") == u).orderBy("i").collect()])
        x = x - x.mean()
        v = sum((1 - abs(i - j) / 4) * x[i] * x[j] for i in range(80) for j in range(80) if abs(i - j) <= 3) / 80
        assert scale[u]["scale"] == pytest.approx(math.sqrt(v))
    good, none = (stats.bootstrap_spa(frame(m), "u", "i", "v", 200, 4, 1).first() for m in ([0.0, 0.8, -0.1], [-0.5, -0.4, -0.3]))
    assert good["iterations"] == 200 and good["p_upper"] < 0.05 and none["p_lower"] > 0.5
    for r in (good, none):
        assert r["p_lower"] <= r["p_consistent"] <= r["p_upper"]


def test_block_length_grows_with_dependence(spark):
    rng = np.random.default_rng(7)
    noise, walk, x = rng.normal(size=300), [], 0.0
    for e in rng.normal(size=300):
        x = 0.9 * x + e
        walk.append(x)
    rows = [(k, i, float(v)) for k, s in (("noise", noise), ("walk", walk)) for i, v in enumerate(s)] + [("flat", i, 1.0) for i in range(20)]
    got = {r["k"]: r["length"] for r in stats.block_length(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    assert got["flat"] == 1.0 and 1.0 <= got["noise"] < 8 < got["walk"]


def test_adx():
    rng = random.Random(2)
    c = [100.0]
    for _ in range(60):
        c.append(c[-1] + rng.uniform(-2, 2))
    h, low = [x + rng.uniform(0, 2) for x in c], [x - rng.uniform(0, 2) for x in c]
    p = 14
    plus = [max(h[i] - h[i - 1], 0) if h[i] - h[i - 1] > low[i - 1] - low[i] else 0 for i in range(1, 61)]
    minus = [max(low[i - 1] - low[i], 0) if low[i - 1] - low[i] > h[i] - h[i - 1] else 0 for i in range(1, 61)]
    reach = [max(h[i], c[i - 1]) - min(low[i], c[i - 1]) for i in range(1, 61)]

    def smooth(x):
        out = [sum(x[:p]) / p]
        for v in x[p:]:
            out.append(out[-1] + (v - out[-1]) / p)
        return out

    a, b = ([100 * s / t for s, t in zip(smooth(x), smooth(reach))] for x in (plus, minus))
    want = smooth([100 * abs(u - d) / (u + d) for u, d in zip(a, b)])
    got = [x for x in recursive.adx(h, low, c) if x is not None]
    assert got == pytest.approx(want)
    up = [float(i) for i in range(50)]
    assert [x for x in recursive.adx([x + 1 for x in up], up, up) if x is not None][-1] == pytest.approx(100)


def test_parabolic_sar():
    up = list(range(10, 40))
    rows = list(recursive.parabolic_sar([x + 1 for x in up], up))
    assert all(side == "long" and stop <= low for (stop, side), low in zip(rows, up))
    assert [s for s, _ in rows] == sorted(s for s, _ in rows)
    rows = list(recursive.parabolic_sar([*range(10, 20), 5, 4, 3], [*range(9, 19), 4, 3, 2]))
    assert [side for _, side in rows[-3:]] == ["short"] * 3 and rows[-3][0] == 19.0  # turns to the extreme
    assert list(recursive.parabolic_sar([], [])) == []


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_quantile_regression(spark, q):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 10, 400)
    y = 3 + 2 * x + rng.normal(size=400) * (1 + x / 5)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    line = models.linear(models.quantile_regression(df, ["x"], "y", q, rounds=40), ["x"])
    fit = np.array([r["f"] for r in df.select(line.alias("f"), "y").collect()])

    def pinball(f):
        e = y - f
        return np.maximum(q * e, (q - 1) * e).mean()

    best = min(pinball(a + b * x) for a in np.linspace(0, 6, 61) for b in np.linspace(1, 3, 81))
    assert pinball(fit) <= best * 1.02 and abs((y < fit).mean() - q) < 0.04


def test_detectors_by_hand(spark):
    bars: dict = {}
    for r in QUERIES["k02_series_adapter"](spark, SF).select("entity_id", "d").collect():
        bars.setdefault(r["entity_id"], []).append(r["d"])
    got: dict = {}
    for r in QUERIES["k05_detectors"](spark, SF).collect():
        got.setdefault(r["entity_id"], {})[r["d"]] = r["state"]
    assert {k: sorted(v) for k, v in bars.items()} == {k: sorted(v) for k, v in got.items()}
    assert all({"high", "low"} >= set(v.values()) for v in got.values())


def test_derived_series_by_hand(spark):
    got: dict = {}
    for r in QUERIES["i05_derive_in_order"](spark, SF).collect():
        got.setdefault(r["series"], {})[r["d"]] = r["value"]
    assert got["per_share"] and all(v == pytest.approx(got["total"][d] / got["volume"][d]) for d, v in got["per_share"].items())
    status = {r["series"]: (r["status"], r["n_rows"]) for r in QUERIES["i07_refresh_all"](spark, SF).collect()}
    assert status["broken"][0].endswith("Exception") and status["missing"] == ("AnalysisException", 0) and status["total"] == ("ok", len(got["total"])) == status["median"]


def test_margin_closeout_reads_lines_once(spark):
    """Positions are a row an entity and read several times; the lines below them are read when they are staged."""
    made = QUERIES["e50_margin_closeout"](spark, "/root/testdata/sf0.001")
    assert "l_suppkey" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_arm_medians_come_from_counts(spark):
    """Odd, even and tied volumes and none; no map of an arm's volumes in one task."""
    volumes = {"A": [5, 1, 9], "B": [4, 4, 7, 100], "C": [3, None], "D": [None]}
    rows = [(arm, 10 * k + ord(arm), k, "long" if k % 2 else "short", float(k), v) for arm, vs in volumes.items() for k, v in enumerate(vs)]
    positions = spark.createDataFrame(rows, "arm string, entity_id long, d int, side string, raw_return double, dollar_volume long")
    out = aggregates.arm_summaries(positions, positions.select("entity_id"))
    assert {r["arm"]: (r["n"], r["capacity"]) for r in out.collect()} == {"A": (3, 5.0), "B": (4, 5.5), "C": (2, 3.0), "D": (1, None)}
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
