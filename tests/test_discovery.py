"""Candidates, their tests and verdicts, complete panels, two-sample tests and block lengths against plain Python."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import aggregates, discovery, stats


def test_variance_of_large_sums(spark):
    """n * sum of squares passes 2^63, the sum of squares doesn't."""
    values = [20_000_000 - 7 * (i % 2) if i % 3 else -10_000_000 for i in range(3000)]
    assert sum(v * v for v in values) < 2**63 < len(values) * sum(v * v for v in values)
    got = spark.createDataFrame([(v,) for v in values], "v long").agg(aggregates.variance("v").alias("v")).first()["v"]
    assert got == pytest.approx(statistics.pvariance(values), rel=1e-12)


def upper(t, df):
    """P(T > t) by integrating the density."""
    x = np.linspace(0, abs(t), 20_001)
    y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(x * x / df))
    half = 0.5 - float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
    return half if t > 0 else 1 - half


def t_of(values):
    n = len(values)
    if n < 2 or len(set(values)) == 1:
        return None
    return statistics.mean(values) / math.sqrt(statistics.variance(values) / n)


def world(spark, seed, days=400):
    """Dates with three atoms, one of which tells the outcome; some dates lack an outcome."""
    rng = random.Random(seed)
    flags, sticky = [], {a: False for a in "abc"}
    for i in range(days):
        for a in sticky:
            if rng.random() < 0.3:
                sticky[a] = not sticky[a]
        flags.append((i, *sticky.values()))
    outcomes = [(k, i, i < 250, rng.randint(-100, 100) + (60 if f[1] else -60)) for k in (1, 2) for i, f in enumerate(flags) if rng.random() < 0.8]
    return flags, outcomes, spark.createDataFrame(flags, "i long, a boolean, b boolean, c boolean"), spark.createDataFrame(outcomes, "k int, i long, inner_part boolean, r long").repartition(3)


def test_candidates_tests_and_verdicts(spark):
    flags, outcomes, flag_frame, outcome_frame = world(spark, 4)
    names = spark.createDataFrame([("c",), ("a",), ("b",)], "a string")
    every = {r["id"]: r for r in discovery.candidates(names, "a", 8).collect()}
    order = [(x, None, None) for x in "abc"] + [(x, y, op) for x, y in itertools.combinations("abc", 2) for op in ("AND", "OR")]
    assert [(every[k + 1]["a"], every[k + 1]["b"], every[k + 1]["op"]) for k in range(9)] == order
    assert all(r["family"] == 9 and r["within"] == (k <= 8) for k, r in every.items())
    tried = discovery.candidates(names, "a", 8).where("within")
    bits = discovery.combined(tried, discovery.words(flag_frame, ["a", "b", "c"]))
    holds = {k: {i for i, *f in flags if (lambda x, y: x if y is None else x and y if r["op"] == "AND" else x or y)(f["abc".index(r["a"])], None if r["b"] is None else f["abc".index(r["b"])])} for k, r in every.items() if k <= 8}
    counted = {r["id"]: r["n"] for r in bits.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("n")).collect()}
    assert counted == {k: len(h) for k, h in holds.items() if h}
    tested = discovery.tests(tried, bits, outcome_frame, "r", "inner_part", ("k",))
    got = {(r["k"], r["id"], r["inner_part"], r["bucket"]): r for r in tested.collect()}
    want, p = {}, {}
    for k, c, part in itertools.product((1, 2), holds, (True, False)):
        own = {i: v for key, i, inner, v in outcomes if key == k and inner == part}
        for bucket in ("on", "off"):
            days = sorted(i for i in own if (i in holds[c]) == (bucket == "on"))
            if days:
                episodes = sum(1 for d in days if d - 1 not in own or (d - 1 in holds[c]) != (bucket == "on"))
                values = [own[d] for d in days]
                t = t_of(values) if episodes >= 5 else None
                want[k, c, part, bucket] = (len(days), sum(values), sum(v * v for v in values), episodes)
                p[k, c, part, bucket] = None if t is None else upper(t, len(days) - 1)
                assert (got[k, c, part, bucket]["t"] is None) == (t is None) and (t is None or got[k, c, part, bucket]["t"] == pytest.approx(t, abs=1e-8))
    assert {k: (r["n"], r["s"], r["ss"], r["episodes"]) for k, r in got.items()} == want
    judged = {(r["k"], r["id"]): r for r in discovery.verdicts(tested, "inner_part", 0.05, 0.1, ("k",)).collect()}
    for k in (1, 2):
        best = {c: min((p[k, c, True, b] for b in ("on", "off") if p.get((k, c, True, b)) is not None), default=None) for c in holds}
        family = sorted(p[k, c, False, b] for c in holds for b in ("on", "off") if best[c] is not None and best[c] <= 0.05 and p.get((k, c, False, b)) is not None)
        cut = max((x for n, x in enumerate(family, 1) if x <= n * 0.1 / len(family)), default=-1)
        for c in holds:
            outer = [p[k, c, False, b] for b in ("on", "off") if p.get((k, c, False, b)) is not None]
            verdict = "refused_low_power" if best[c] is None else "rejected" if best[c] > 0.05 else "refused_low_power" if not outer else "admitted" if min(outer) <= cut * (1 + 1e-9) else "rejected"
            assert judged[k, c]["verdict"] == verdict and judged[k, c]["p_inner"] == pytest.approx(best[c], abs=1e-6)
    assert {"admitted", "rejected"} <= {r["verdict"] for r in judged.values()}


def test_runs_over_words(spark):
    """Runs that cross words, sets without a date, and dates that nothing is known of."""
    days = [i for i in range(300) if i not in (63, 64, 200)]
    flags = spark.createDataFrame([(i, 10 <= i < 140, False) for i in range(300)], "i long, a boolean, b boolean")
    tried = discovery.candidates(spark.createDataFrame([("a",), ("b",)], "a string"))
    rows = spark.createDataFrame([(i, True, i) for i in days], "i long, inner_part boolean, r long")
    got = discovery.tests(tried, discovery.combined(tried, discovery.words(flags, ["a", "b"])), rows, "r", "inner_part", floor=1)
    runs = {(r["a"], r["op"], r["bucket"]): (r["episodes"], r["n"]) for r in got.join(tried, "id").collect()}
    assert runs["a", None, "on"] == (2, 128) and runs["a", None, "off"] == (3, 169) and runs["b", None, "off"] == (3, 297)
    assert ("b", None, "on") not in runs and ("a", "AND", "on") not in runs and runs["a", "OR", "on"] == (2, 128)


def plain_panel(rows, least, window, entity_cover, time_cover):
    """Drops the entity that lacks most, one after another."""
    by: dict = {}
    for e, t, v in rows:
        by.setdefault(e, {})[t] = v
    times = sorted({t for x in by.values() for t in x})[-window:]
    able = {e: {t for t in times if t in x} for e, x in by.items()}
    able = {e: s for e, s in able.items() if len(s) >= entity_cover * len(times)}
    shared = [t for t in times if sum(t in s for s in able.values()) >= time_cover * len(able)]
    kept = {e: s & set(shared) for e, s in able.items()}
    while len(kept) >= 2:
        common = [t for t in shared if all(t in s for s in kept.values())]
        if len(common) >= least:
            x = np.array([[by[e][t] for t in common] for e in kept], float)
            x = x[x.std(1) > 0]
            rho = float(np.corrcoef(x)[np.triu_indices(len(x), 1)].mean()) if len(x) > 1 else None
            n = len(by)
            return n, len(kept), len(common), rho, None if rho is None else max(1.0, min(n, n / (1 + (n - 1) * max(0.0, min(0.999999, rho)))))
        kept.pop(max(kept, key=lambda e: (len(shared) - len(kept[e]), e)))
    return len(by), None, None, None, None


@pytest.mark.parametrize("least", [3, 25, 39, 60])
def test_complete_panel(spark, least):
    """Several keys at once; ragged entities, old ones, one that never changes; the best covered over all time isn't the last to go."""
    rng = random.Random(9)
    rows = []
    for k in range(3):
        for e in range(14):
            base = rng.random()
            lost = rng.choice([0.0, 0.02, 0.1, 0.3])
            for t in range(-60 if e < 4 else 0, 50):
                if rng.random() >= (lost if t >= 0 else 0):
                    rows.append((k, e, t, 5 if e == 3 else int(100 * (math.sin(t) * base + rng.random()))))
    df = spark.createDataFrame(rows, "k int, entity_id long, d int, y long").repartition(4)
    got = {r["k"]: r for r in aggregates.complete_panel(df, "y", least, ("k",), window=48, entity_cover=0.6, time_cover=0.7).collect()}
    for k in range(3):
        n, kept, dates, rho, size = plain_panel([r[1:] for r in rows if r[0] == k], least, 48, 0.6, 0.7)
        r = got[k]
        assert (r["entities"], r["kept"], r["dates"], r["thin"]) == (n, kept, dates, rho is None)
        assert rho is None or (r["rho"] == pytest.approx(rho, abs=1e-6) and r["n_eff"] == pytest.approx(size, abs=1e-5))


@pytest.mark.parametrize("near", [1, 1024])
def test_panels_of_members(spark, near):
    """Entities that count for several keys or none are sent once; their panels are those of a copy of their rows a key, however far places are looked at."""
    rng = random.Random(4)
    rows = [(e, t, None if rng.random() < 0.05 else rng.randint(-50, 50) + t % 7) for e in range(40) for t in range(30) if rng.random() >= (0.0 if e < 20 else 0.15)]
    df = spark.createDataFrame(rows, "entity_id long, d int, y long").withColumn("c", F.lit(1)).repartition(3)
    members = spark.createDataFrame([(k, e) for k in range(3) for e in range(40) if rng.random() < 0.6 and e != 39], "k int, entity_id long")
    kept = aggregates.histories(df, "y", ("k",), members, beside=("c",))
    got = sorted(map(tuple, aggregates.densest_panel(kept, 8, ("k",), 25, 0.6, 0.7, near).collect()))
    assert got == sorted(map(tuple, aggregates.complete_panel(df.join(members, "entity_id"), "y", 8, ("k",), 25, 0.6, 0.7).collect()))
    for k, n, kept_n, dates, _, rho, _ in got:
        own = {r["entity_id"] for r in members.where(f"k = {k}").collect()}
        assert (n, kept_n, dates, pytest.approx(rho, abs=1e-6)) == plain_panel([r for r in rows if r[0] in own and r[2] is not None], 8, 25, 0.6, 0.7)[:4]
    assert kept.select(F.inline("_all")).count() == len(rows)


def test_two_sample_t(spark):
    rng = random.Random(2)
    base = [(g, k, rng.randint(0, 100)) for g, n in (("paired", 30), ("pooled", 30), ("other keys", 10), ("alone", 5), ("flat", 6), ("one", 1)) for k in range(n)]
    other = [(g, k, v - rng.randint(-20, 40)) for g, k, v in base if g == "paired" or (g == "pooled" and k % 3)] + [("other keys", k + 100, rng.randint(0, 100)) for k in range(10)] + [("flat", k, v) for g, k, v in base if g == "flat"] + [("one", 0, 3)]
    schema = "g string, k long, v long"
    for less in (True, False):
        got = {r["g"]: r for r in stats.one_sided_t(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema), "v", ["g"], ["k"], less).collect()}
        for g in {b[0] for b in base}:
            x, y = {k: v for h, k, v in base if h == g}, {k: v for h, k, v in other if h == g}
            if x.keys() == y.keys():
                method, t, df = "paired", t_of([x[k] - y[k] for k in x]), len(x) - 1
            else:
                method, df = "pooled", len(x) + len(y) - 2
                scatter = lambda z: sum((v - statistics.mean(z.values())) ** 2 for v in z.values())
                t = (statistics.mean(x.values()) - statistics.mean(y.values())) / math.sqrt((scatter(x) + scatter(y)) / df * (1 / len(x) + 1 / len(y))) if y else None
            t = t if less or t is None else -t
            r = got[g]
            assert (r["method"], r["n_base"], r["n_other"], r["df"]) == (method, len(x), len(y), df)
            assert (r["t"] is None) == (t is None) and (t is None or r["t"] == pytest.approx(t, abs=1e-8))
            assert r["p"] == (1.0 if t is None else pytest.approx(upper(t, df), abs=1e-6))


def plain_length(x):
    """The flat-top rule, lag by lag."""
    n = len(x)
    mean = sum(x) / n
    cov = lambda k: sum((x[i] - mean) * (x[i + k] - mean) for i in range(n - k)) / n
    if n < 10 or cov(0) <= 0:
        return 1.0
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    lags = min(n - 2, math.ceil(math.sqrt(n)) + run)
    small = [abs(cov(k) / cov(0)) < 2 * math.sqrt(math.log10(n) / n) for k in range(1, lags + 1)]
    first = next((k for k in range(lags) if all(small[k : k + run])), lags)
    m = min(2 * first, lags)
    if not m:
        return 1.0
    weight = lambda k: 1 if k <= m / 2 else 2 * (1 - k / m)
    g0 = cov(0) + 2 * sum(weight(k) * cov(k) for k in range(1, m + 1))
    g = 2 * sum(weight(k) * k * cov(k) for k in range(1, m + 1))
    return min(max(1.0, (2 * g * g / (2 * g0 * g0)) ** (1 / 3) * n ** (1 / 3)), n / 3)


def test_block_length(spark):
    rng = random.Random(12)
    series = {"noise": [rng.gauss(0, 1) for _ in range(200)], "short": [1.0, 2.0, 3.0], "flat": [2.0] * 40, "wave": [math.sin(i / 7) for i in range(120)]}
    for name, keep in (("weak", 0.4), ("strong", 0.9)):
        x = [0.0]
        for _ in range(399):
            x.append(keep * x[-1] + rng.gauss(0, 1))
        series[name] = x
    series["late"] = [v + (3 * series["noise"][i - 15] if i >= 15 else 0) for i, v in enumerate(series["noise"])]  # one significant lag, beyond a run of quiet ones
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    got = {r["k"]: r["length"] for r in stats.block_length(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    assert got == {k: pytest.approx(plain_length(x), abs=1e-9) for k, x in series.items()}
    assert got["noise"] == got["short"] == got["flat"] == 1.0 and got["strong"] > got["weak"] > 1
