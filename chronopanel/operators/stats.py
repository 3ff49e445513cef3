"""Statistical tests over many groups at once; small solves run inside grouped functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel().tolist()]).reshape(x.shape)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, for all elements at once."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 / np.maximum(1 - (a + b) * x / (a + 1), tiny)
    out = d.copy()
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d = 1 / np.where(np.abs(d) > tiny, d, tiny)
            c = np.where(np.abs(c) > tiny, c, tiny)
            out = out * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    near = inside < (a + 1) / (a + b + 2)
    p, q, y = np.where(near, a, b), np.where(near, b, a), np.where(near, inside, 1 - inside)
    part = front * _beta_fraction(p, q, y) / p
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(near, part, 1 - part)))


def t_upper(t, df):
    """P(T > t) of Student's t; 1 where undefined."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    known = ~(np.isnan(t) | np.isnan(df)) & (df > 0)
    u, n = np.where(known, t, 0.0), np.where(known, df, 1.0)
    half = incomplete_beta(n / 2, 0.5, n / (n + u * u)) / 2
    return np.where(known, np.where(u > 0, half, 1 - half), 1.0)[()]


@F.pandas_udf(T.DoubleType())
def upper_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T > t) of Student's t with df degrees of freedom; 1 where t is null."""
    return pd.Series(np.atleast_1d(t_upper(t.astype(float), df.astype(float))))


def scatter(n: Column, s: Column, ss: Column, kind: str) -> Column:
    """n * ss - s * s; of whole numbers as a decimal, which holds products that a long can't."""
    if kind in ("double", "float"):
        return n * ss - s * s
    n, s, ss = (c.cast("decimal(38,0)") for c in (n, s, ss))
    return n * ss - s * s


def t_statistic(n: Column, s: Column, ss: Column, least: int = 2, kind: str = "bigint") -> Column:
    """t of a mean above zero from exact sums of values of a ``kind``; null below ``least`` rows or without spread."""
    wide = scatter(n, s, ss, kind)
    spread = F.sqrt(wide.cast("double") / (n * (n - 1))) / F.sqrt(n.cast("double"))
    return F.when((n >= max(2, least)) & (wide > 0), F.round(s / n / spread, 9))


def t_moments(df: DataFrame, value: str, keys: list[str], least: int = 2) -> DataFrame:
    """Per group: n, s, ss and the t statistic of a mean above zero; no t below ``least`` rows or without spread."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    return out.withColumn("t", t_statistic(F.col("n"), F.col("s"), F.col("ss"), least, dict(df.dtypes)[value]))


def conditional_t(df: DataFrame, value: str, label: str, episodes: DataFrame, floor: int) -> DataFrame:
    """``t_moments`` and p per label; refused (null, p of 1) below ``floor`` episodes."""
    out = episodes.join(t_moments(df, value, [label]), label)
    out = out.withColumn("t", F.when(F.col("episodes") >= floor, F.col("t")))
    return out.withColumn("p", upper_p("t", F.col("n") - 1))


def screen_and_test(df: DataFrame, value: str, keys: list[str], inner: Column, least: int, screen: float, confirm: float) -> DataFrame:
    """Candidates that pass the screen on inner rows are tested on outer ones: t_inner, t_outer, p_outer, verdict."""
    parts = t_moments(df.withColumn("_inner", inner), value, [*keys, "_inner"], least)
    side = lambda holds, c: F.max(F.when(holds, F.col(c)))
    out = parts.groupBy(*keys).agg(side(F.col("_inner"), "t").alias("t_inner"), side(~F.col("_inner"), "t").alias("t_outer"), side(~F.col("_inner"), "n").alias("n_outer"))
    verdict = F.when(F.col("t_inner").isNull(), "no evidence").when(F.col("t_inner") <= screen, "screened out").when(F.col("t_outer").isNull(), "no evidence").when(F.col("t_outer") > confirm, "confirmed").otherwise("failed")
    return out.withColumns({"verdict": verdict, "p_outer": upper_p("t_outer", F.coalesce(F.col("n_outer"), F.lit(2)) - 1)})


def fold_grades(df: DataFrame, value: str, keys: list[str], fold: str, least: int, bound: float) -> DataFrame:
    """Retests per fold: confirmed if every evaluable one is above the bound; folds of low power are no evidence."""
    t = t_moments(df, value, [*keys, fold], least)
    n, ok = F.count("t"), F.count_if(F.col("t") > bound)
    verdict = F.when(n == 0, "no evidence").when(ok == n, "confirmed").otherwise("failed")
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("folds"), n.alias("evaluable"), verdict.alias("verdict"), (ok / F.nullif(n, F.lit(0))).alias("grade"))


def recomputed(stored: DataFrame, again: DataFrame, keys: list[str], p: str = "p", absolute: float = 1e-9, relative: float = 1e-6) -> DataFrame:
    """Recomputed rows with ``matches``: whether the stored p is the same within the tolerances, or both are missing."""
    old = stored.select(*keys, F.col(p).alias("_stored"))
    near = F.abs(F.col(p) - F.col("_stored")) <= F.greatest(F.lit(absolute), relative * F.abs("_stored"))
    return again.join(old, keys, "left").withColumn("matches", F.coalesce(near, F.col(p).isNull() & F.col("_stored").isNull())).drop("_stored")


def one_sample_t(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Per group: n, mean, t and the p-value of a mean above zero; fewer than two rows give 1."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    out = out.withColumn("t", F.when(F.col("_s") > 0, F.col("mean") / (F.col("_s") / F.sqrt("n"))))
    return out.withColumn("p", upper_p("t", F.col("n") - 1)).drop("_s")


def one_sided_t(base: DataFrame, other: DataFrame, value: str, keys: list[str], pair: list[str], less: bool = True) -> DataFrame:
    """Per group: whether the mean of ``other`` is below (or above) that of ``base``; method, n_base, n_other, t, df, p.

    Paired where both sides hold the same ``pair`` keys, else two samples with a
    pooled variance; chosen per group.  Sums of integers are exact.  Without
    spread, or with too few rows, t is null and p is 1.  Pair keys are unique
    within a side; null scores are left out.
    """
    side = lambda df, name: df.where(F.col(value).isNotNull()).select(*keys, *pair, F.col(value).alias(name))
    both = side(base, "_a").join(side(other, "_b"), [*keys, *pair], "full").withColumn("_d", F.col("_a") - F.col("_b"))
    sums = [f.alias(f"{c}{k}") for c in ("_a", "_b", "_d") for k, f in (("n", F.count(c)), ("s", F.sum(c)), ("q", F.sum(F.col(c) * F.col(c))))]
    m = both.groupBy(*keys).agg(*sums)
    na, nb, nd = F.col("_an"), F.col("_bn"), F.col("_dn")
    kind = "double" if {"double", "float"} & {dict(side.dtypes)[value] for side in (base, other)} else "bigint"
    scattered = lambda c: scatter(F.col(f"{c}n"), F.col(f"{c}s"), F.col(f"{c}q"), kind).cast("double") / F.col(f"{c}n")
    paired, n = (na == nd) & (nb == nd), nd.cast("double")
    by_pair = F.when((nd > 1) & (scattered("_d") > 0), F.col("_ds") / n / F.sqrt(scattered("_d") / (n - 1) / n))
    pooled = (scattered("_a") + scattered("_b")) / (na + nb - 2)
    apart = F.when((na > 0) & (nb > 0) & (na + nb > 2) & (pooled > 0), (F.col("_as") / na - F.col("_bs") / nb) / F.sqrt(pooled * (1 / na + 1 / nb)))
    t = F.when(paired, by_pair).otherwise(apart)
    out = m.select(*keys, F.when(paired, "paired").otherwise("pooled").alias("method"), na.alias("n_base"), nb.alias("n_other"), F.round(t if less else -t, 9).alias("t"), F.when(paired, nd - 1).otherwise(na + nb - 2).alias("df"))
    return out.withColumn("p", upper_p("t", "df"))


def hac_interaction(df: DataFrame, y: str, s: str, c: str, keys: list[str], time: str) -> DataFrame:
    """Per group: y on 1, s, c and s * c; the interaction's coefficient with Newey-West t and two-sided p."""
    kinds = dict(df.dtypes)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        n = len(rows)
        out = rows[keys].head(1).copy()
        x = np.column_stack([np.ones(n), rows[s], rows[c], rows[s] * rows[c]]).astype(float)
        if n <= 4 or np.linalg.matrix_rank(x) < 4:
            return out.assign(n=n, beta=np.nan, t=np.nan, p=1.0)
        inverse = np.linalg.inv(x.T @ x)
        beta = inverse @ x.T @ rows[y].to_numpy(float)
        u = x * (rows[y].to_numpy(float) - x @ beta)[:, None]
        lags = int(4 * (n / 100) ** (2 / 9))
        meat = u.T @ u
        for k in range(1, lags + 1):
            part = u[k:].T @ u[:-k]
            meat += (1 - k / (lags + 1)) * (part + part.T)
        t = beta[3] / math.sqrt(max((inverse @ meat @ inverse)[3, 3], 1e-300))
        return out.assign(n=n, beta=beta[3], t=t, p=min(1.0, 2 * t_upper(abs(t), n - 4)))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, beta double, t double, p double"
    return df.groupBy(*keys).applyInPandas(solve, schema)


def hac_scale(df: DataFrame, unit: str, place: str, value: str, lags: int) -> DataFrame:
    """Per unit: n, mean and the root of the long-run variance with Bartlett weights; places that a unit lacks count as its mean."""
    centre = df.groupBy(unit).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.pow(F.stddev_pop(value), 2).alias("_v"))
    x = df.join(centre.select(unit, "mean"), unit).select(unit, place, (F.col(value) - F.col("mean")).alias("_x"))
    shifted = x.select(unit, F.col("_x").alias("_y"), F.explode(F.sequence(F.lit(1), F.lit(max(1, lags)))).alias("_k"), place).withColumn(place, F.col(place) + F.col("_k"))
    weight = 1 - F.col("_k") / (lags + 1)
    cross = x.join(shifted, [unit, place]).groupBy(unit).agg(F.sum(weight * F.col("_x") * F.col("_y")).alias("_c"))
    long_run = F.col("_v") + 2 * F.coalesce("_c", F.lit(0.0)) / F.col("n")
    return centre.join(cross, unit, "left").select(unit, "n", "mean", F.sqrt(F.greatest(long_run, F.lit(1e-12))).alias("scale"))


def bootstrap_spa(df: DataFrame, unit: str, place: str, value: str, iterations: int, block: int, seed: int) -> DataFrame:
    """Test for superior ability by stationary bootstrap: t of the best unit, and its lower, consistent and upper p.

    Iterations are rows; paths come from a seeded hash over all places, of which
    ``place`` counts from 0, and join the units' values on the place.
    """
    spark = df.sparkSession
    n_places = (df.agg(F.max(place)).first()[0] or 0) + 1
    lags = int(4 * (n_places / 100) ** (2 / 9))
    scale = hac_scale(df, unit, place, value, lags)
    draws = spark.range(iterations).withColumnRenamed("id", "it").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_places - 1))))
    fresh = F.pmod(F.xxhash64(F.lit(seed), "it", "i"), F.lit(block)) == 0
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "it", "i"), F.lit(n_places))
    draws = draws.withColumn("_at", F.when(fresh | (F.col("i") == 0), F.struct("i", start.alias("from_"))))
    last = F.last("_at", ignorenulls=True).over(W.partitionBy("it").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    path = draws.withColumn("_l", last).select("it", F.pmod(F.col("_l.from_") + F.col("i") - F.col("_l.i"), F.lit(n_places)).cast("int").alias(place))
    count = path.groupBy("it", place).agg(F.count(F.lit(1)).alias("k"))  # a path is a multiset of places
    rows = df.select(unit, F.col(place).cast("int").alias(place), F.col(value).cast("double").alias("_x"))
    means = count.join(rows, place).groupBy("it", unit).agg((F.sum(F.col("k") * F.col("_x")) / F.sum("k")).alias("m")).join(scale, unit)
    root = F.sqrt(F.col("n").cast("double"))
    z = root * F.col("mean") / F.col("scale")
    enough = z >= -F.sqrt(2 * F.log(F.log(F.greatest(F.col("n"), F.lit(3)).cast("double"))))
    centre = {"lower": F.greatest("mean", F.lit(0.0)), "consistent": F.when(enough, F.col("mean")).otherwise(0.0), "upper": F.col("mean")}
    best = means.groupBy("it").agg(*[F.greatest(F.lit(0.0), F.max(root * (F.col("m") - c) / F.col("scale"))).alias(k) for k, c in centre.items()])
    t = F.broadcast(scale.agg(F.greatest(F.lit(0.0), F.max(z)).alias("t")))  # one row
    p = [F.avg((F.col(k) >= F.col("t")).cast("double")).alias(f"p_{k}") for k in centre]
    return best.join(t, F.lit(True)).agg(F.count(F.lit(1)).alias("iterations"), F.first("t").alias("t"), *p)


def flat_top_length(x: np.ndarray) -> float:
    """Expected block length of the stationary bootstrap by the flat-top rule, from 1 to a third of the series.

    Autocorrelations count up to the first lag that is followed by a run of
    insignificant ones; twice that many lags are weighed by a trapezoid.
    """
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 10:
        return 1.0
    x = x - x.mean()
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    lags = min(n - 2, math.ceil(math.sqrt(n)) + run)
    cov = np.array([x[k:] @ x[: n - k] for k in range(lags + 1)]) / n
    if cov[0] <= 0:
        return 1.0
    far = np.flatnonzero(np.abs(cov[1:] / cov[0]) >= 2 * math.sqrt(math.log10(n) / n))  # significant lags, from 0
    quiet = [k for k in (0, *(far + 1)) if not ((far >= k) & (far < k + run)).any() and k < lags]
    m = min(2 * (quiet[0] if quiet else lags), lags)
    if m == 0:
        return 1.0
    at = np.arange(1, m + 1)
    weighed = np.minimum(1, 2 * (1 - at / m)) * cov[1 : m + 1]
    slope, level = 2 * (weighed @ at), 2 * (cov[0] + 2 * weighed.sum()) ** 2
    if level <= 0 or abs(slope) < 1e-12:
        return 1.0
    return float(min(max(1.0, (2 * slope**2 / level) ** (1 / 3) * n ** (1 / 3)), n / 3))


def block_length(df: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Per series ``length``: the expected block length; a series is one row a place, so it fits a task."""
    kinds = dict(df.dtypes)

    def rule(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[keys].head(1).assign(length=flat_top_length(rows.sort_values(place)[value].to_numpy(float)))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", length double"
    return df.select(*keys, place, value).groupBy(*keys).applyInPandas(rule, schema)
