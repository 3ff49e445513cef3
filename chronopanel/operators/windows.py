"""Ordered-sequence operators over entity-by-time panels.

Every function takes a frame and column names and adds columns.  Windows are
partitioned by entity, so one shuffle on the entity serves all of them.
Means and deviations come from sums, so integer inputs give the same doubles
on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over(entity: str = "entity_id", time: str = "d"):
    return W.partitionBy(entity).orderBy(time)


def trailing(n: int, entity: str = "entity_id", time: str = "d"):
    """The current row and the n - 1 before it."""
    return over(entity, time).rowsBetween(1 - n, 0)


def prior(n: int, entity: str = "entity_id", time: str = "d"):
    """The n rows before the current one."""
    return over(entity, time).rowsBetween(-n, -1)


def full(value, frame, n: int, result: Column) -> Column:
    """``result`` where the frame holds n values, else null."""
    return F.when(F.count(value).over(frame) == n, result)


def mean(value: str | Column, frame, n: int) -> Column:
    """Simple mean of n values; null in the warm-up."""
    value = F.col(value) if isinstance(value, str) else value
    return full(value, frame, n, F.sum(value).over(frame) / F.lit(n))


def variance(value: str | Column, frame, n: int, sample: bool = False) -> Column:
    """Variance of n values from the sum and the sum of squares."""
    value = F.col(value) if isinstance(value, str) else value
    s, ss = F.sum(value).over(frame), F.sum(value * value).over(frame)
    return full(value, frame, n, (n * ss - s * s) / F.lit(n * (n - 1) if sample else n * n))


def sma(df: DataFrame, value: str, n: int, out: str = "sma", entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Simple moving average."""
    return df.withColumn(out, mean(value, trailing(n, entity, time), n))


def bollinger(df: DataFrame, value: str, n: int = 20, k: float = 2.0, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Mean and bands of k population deviations, and the squared width over the mean."""
    frame = trailing(n, entity, time)
    df = df.withColumns({"mid": mean(value, frame, n), "var": variance(value, frame, n)})
    dev = k * F.sqrt("var")
    return df.withColumns({"upper": F.col("mid") + dev, "lower": F.col("mid") - dev}).drop("var")


def stochastic(df: DataFrame, high: str, low: str, close: str, n: int = 14, smooth: int = 3, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Slow %K and %D; a flat range gives null."""
    frame = trailing(n, entity, time)
    top, bottom = F.max(high).over(frame), F.min(low).over(frame)
    df = df.withColumn("raw_k", full(close, frame, n, 100 * (F.col(close) - bottom) / F.nullif(top - bottom, F.lit(0))))
    short = trailing(smooth, entity, time)
    df = df.withColumn("slow_k", full("raw_k", short, smooth, F.sum("raw_k").over(short) / smooth))
    return df.withColumn("slow_d", full("slow_k", short, smooth, F.sum("slow_k").over(short) / smooth))


def change(value: str, k: int = 1, entity: str = "entity_id", time: str = "d") -> Column:
    """value / value k rows before - 1; null where the earlier one is zero or missing."""
    before = F.lag(value, k).over(over(entity, time))
    return F.when(before != 0, F.col(value) / before - 1)


def forward(value: str, k: int, entity: str = "entity_id", time: str = "d") -> Column:
    """Value k rows later / value - 1."""
    return F.when(F.col(value) != 0, F.lead(value, k).over(over(entity, time)) / F.col(value) - 1)


def true_range(high: str, low: str, close: str, entity: str = "entity_id", time: str = "d") -> Column:
    """max(high - low, |high - previous close|, |low - previous close|)."""
    before = F.lag(close).over(over(entity, time))
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def rsi_simple(df: DataFrame, value: str, n: int = 14, out: str = "rsi", entity: str = "entity_id", time: str = "d") -> DataFrame:
    """RSI from plain sums of gains and losses; without losses 100, without either 50."""
    df = df.withColumn("_m", F.col(value) - F.lag(value).over(over(entity, time)))
    frame = trailing(n, entity, time)
    gain, loss = F.sum(F.greatest("_m", F.lit(0))).over(frame), F.sum(F.greatest(-F.col("_m"), F.lit(0))).over(frame)
    value_ = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 * gain / F.nullif(gain + loss, F.lit(0)))
    return df.withColumn(out, full("_m", frame, n, value_)).drop("_m")


def slope(df: DataFrame, value: str, n: int, out: str = "slope", entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Least-squares slope of the last n values against their place."""
    frame = trailing(n, entity, time)
    df = df.withColumn("_i", F.row_number().over(over(entity, time)).cast("long"))
    si, sv, siv, sii = (F.sum(x).over(frame) for x in (F.col("_i"), F.col(value), F.col("_i") * F.col(value), F.col("_i") * F.col("_i")))
    return df.withColumn(out, full(value, frame, n, (n * siv - si * sv) / (n * sii - si * si))).drop("_i")


def concavity(df: DataFrame, value: str, n: int, out: str = "concavity", entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Second-order coefficient of a quadratic fit to the last n equally spaced values (n odd)."""
    half = n // 2
    z = [k * k for k in range(-half, half + 1)]
    weights = [n * x - sum(z) for x in z]  # orthogonal to constants and lines
    scale = sum(w * x for w, x in zip(weights, z, strict=True))
    order = over(entity, time)
    total = sum((F.lag(value, n - 1 - k).over(order) * w for k, w in enumerate(weights)), F.lit(0))
    return df.withColumn(out, total / scale)


def drawdown(value: str, entity: str = "entity_id", time: str = "d") -> Column:
    """(value - running maximum) / running maximum."""
    top = F.max(value).over(over(entity, time).rowsBetween(W.unboundedPreceding, 0))
    return (F.col(value) - top) / F.nullif(top, F.lit(0))


def split_adjust(df: DataFrame, prices: tuple[str, ...], volume: str, coefficient: str, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Divide prices by the product of strictly later coefficients; an entity with an unknown or non-positive one is dropped."""
    later = over(entity, time).rowsBetween(1, W.unboundedFollowing)
    valid = F.min(F.when(F.col(coefficient) > 0, 1).otherwise(0)).over(W.partitionBy(entity))
    divisor = F.coalesce(F.product(coefficient).over(later), F.lit(1.0))
    out = df.withColumns({"_ok": valid, "divisor": divisor}).where("_ok = 1").drop("_ok")
    return out.withColumns({p: F.col(p) / F.col("divisor") for p in prices} | {volume: F.col(volume) * F.col("divisor")})


def implausible(df: DataFrame, close: str, factor: float = 4.0, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Per offending entity: its first bar that is not positive or moves by the factor or more."""
    before = F.lag(close).over(over(entity, time))
    bad = F.col(close).isNull() | (F.col(close) <= 0) | (F.col(close) >= factor * before) | (factor * F.col(close) <= before)
    return df.withColumn("_bad", F.coalesce(bad, F.lit(False))).where("_bad").groupBy(entity).agg(F.min(time).alias("first_bad"), F.count(F.lit(1)).alias("n_bad"))


def islands(df: DataFrame, state: str, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Runs of equal state: entity, state, start, end, length, is_open (reaches the last row)."""
    order = over(entity, time)
    turn = F.when(F.col(state).eqNullSafe(F.lag(state).over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
    rows = df.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_last", F.max(time).over(W.partitionBy(entity)))
    return rows.groupBy(entity, "_run", state).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("length"), (F.max(time) == F.max("_last")).alias("is_open")).drop("_run")


def intervals(df: DataFrame, predicate: Column, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Runs in which the predicate holds: entity, from_d, to_d; a run that reaches the last row has no end."""
    runs = islands(df.withColumn("_hit", F.coalesce(predicate, F.lit(False))), "_hit", entity, time).where("_hit")
    return runs.select(entity, F.col("start").alias("from_d"), F.when(~F.col("is_open"), F.col("end")).alias("to_d"))


def tercile_labels(df: DataFrame, value: str, n: int, out: str = "label", entity: str = "entity_id", time: str = "d") -> DataFrame:
    """low, mid or high by the terciles of the trailing n values; 'undefined' in the warm-up."""
    frame = trailing(n, entity, time)
    cut = F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(frame)
    df = df.withColumns({"_cut": cut, "_n": F.count(value).over(frame)})
    label = F.when(F.col("_n") < n, "undefined").when(F.col(value) <= F.col("_cut")[0], "low").when(F.col(value) <= F.col("_cut")[1], "mid").otherwise("high")
    return df.withColumn(out, label).drop("_cut", "_n")


def ranks(df: DataFrame, value: str, tie: str, keys: tuple[str, ...]) -> DataFrame:
    """Descending competition rank, and percentile by position: (n - position) / (n - 1), 1 if alone; nulls take no part."""
    part = W.partitionBy(*keys)
    order = part.orderBy(F.desc(value), tie)
    df = df.where(F.col(value).isNotNull())
    df = df.withColumns({"rank": F.rank().over(part.orderBy(F.desc(value))), "_pos": F.row_number().over(order), "n": F.count(F.lit(1)).over(part)})
    return df.withColumn("percentile", F.when(F.col("n") == 1, 1.0).otherwise((F.col("n") - F.col("_pos")) / (F.col("n") - 1))).drop("_pos")


def group_ranks(df: DataFrame, value: str, tie: str, time: str, groups: dict[str, str]) -> DataFrame:
    """Ranks within the market and within each group column, in one result: group is 'market' or 'name:value'."""
    names = F.array(F.lit("market"), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c))) for k, c in groups.items()])
    return ranks(df.withColumn("group", F.explode(F.array_compact(names))), value, tie, ("group", time))


def share_below(df: DataFrame, value: str, keys: tuple[str, ...], out: str = "share_below") -> DataFrame:
    """Share of the group that lies strictly below the value."""
    part = W.partitionBy(*keys)
    return df.withColumn(out, (F.rank().over(part.orderBy(value)) - 1) / F.count(F.lit(1)).over(part))


def spikes(df: DataFrame, value: str, factor: int, floor: float, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Rows far above both neighbours where the next one is small again."""
    order = over(entity, time)
    v, before, after = F.abs(value), F.abs(F.lag(value).over(order)), F.abs(F.lead(value).over(order))
    return df.withColumn("_s", (v > factor * F.greatest(before, after, F.lit(floor))) & (after * factor < v)).where("_s").drop("_s")


def crosses(df: DataFrame, value: str, short: int, long: int, ahead: int = 0, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """'golden' or 'death' where the short average crosses the long one, and the bars to a cross that is at most ``ahead`` away at the last pace."""
    sums = [F.sum(value).over(trailing(n, entity, time)) for n in (short, long)]
    gap = full(value, trailing(long, entity, time), long, long * sums[0] - short * sums[1])  # the sign of the averages' difference
    df = df.withColumn("_gap", gap)
    df = df.withColumn("_was", F.lag("_gap").over(over(entity, time)))
    now, was = F.col("_gap"), F.col("_was")
    event = F.when((now > 0) & (was <= 0), "golden").when((now <= 0) & (was > 0), "death")
    left = F.when((F.signum(now.cast("double")) == F.signum(was.cast("double"))) & (F.abs(now) < F.abs(was)), F.ceil(F.abs(now) / (F.abs(was) - F.abs(now))))
    return df.withColumns({"event": event, "bars_to_cross": left.cast("long")}).where(F.col("event").isNotNull() | (F.col("bars_to_cross") <= ahead)).drop("_gap", "_was")


def divergence(df: DataFrame, value: str, oscillator: str, lookback: int, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """'bullish' where the last two troughs of the value fall while those of the oscillator rise, 'bearish' for peaks the other way round.

    Turning points are those inside the last ``lookback`` bars, whose neighbours are known.
    """
    order = over(entity, time)
    frame = order.rowsBetween(2 - lookback, -1)
    turn = lambda c, s: (s * F.col(c) > s * F.lag(c).over(order)) & (s * F.col(c) > s * F.lead(c).over(order))
    for c in (value, oscillator):
        df = df.withColumns({f"_{c}_low": F.when(turn(c, -1), F.col(c)), f"_{c}_high": F.when(turn(c, 1), F.col(c))})
    last = lambda c, k: F.try_element_at(F.collect_list(c).over(frame), F.lit(-k))
    low = (last(f"_{value}_low", 1) < last(f"_{value}_low", 2)) & (last(f"_{oscillator}_low", 1) > last(f"_{oscillator}_low", 2))
    high = (last(f"_{value}_high", 1) > last(f"_{value}_high", 2)) & (last(f"_{oscillator}_high", 1) < last(f"_{oscillator}_high", 2))
    whole = F.count(F.lit(1)).over(frame) == lookback - 2
    return df.withColumn("signal", F.when(whole & low, "bullish").when(whole & high, "bearish")).where("signal is not null")


def rolling_templates(df: DataFrame, close: str, volume: str, change_: str, short: int = 5, long: int = 20, lag: int = 5, pairs: int = 45, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Variance ratio, z-score, acceleration, divergence of volume and price, tail quantile, lag autocorrelation, rescaled range."""
    order, frame, wide = over(entity, time), trailing(long, entity, time), trailing(pairs, entity, time)
    r = F.col(change_)
    df = df.withColumn("_q", F.lag(change_, lag).over(order))
    x = F.when(F.col("_q").isNotNull(), r)
    sums = {k: F.sum(v).over(wide) for k, v in {"x": x, "y": F.col("_q"), "xx": x * x, "yy": F.col("_q") * F.col("_q"), "xy": x * F.col("_q")}.items()}
    df = df.withColumns({
        "_v": variance(change_, frame, long, True), "_rs": full(change_, frame, long, F.collect_list(change_).over(frame)), "_total": F.sum(change_).over(frame),
        "_an": F.count("_q").over(wide), "_xx": pairs * sums["xx"] - sums["x"] * sums["x"], "_yy": pairs * sums["yy"] - sums["y"] * sums["y"], "_xy": pairs * sums["xy"] - sums["x"] * sums["y"],
    })
    # along the window once: how many values, their sum, the walk's least and greatest place
    null = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"), null.alias("lo"), null.alias("hi"))

    def step(a: Column, v: Column) -> Column:
        place = long * (a["s"] + v) - (a["k"] + 1) * F.col("_total")
        return F.struct((a["k"] + 1).alias("k"), (a["s"] + v).alias("s"), F.least(a["lo"], place).alias("lo"), F.greatest(a["hi"], place).alias("hi"))

    span = F.aggregate("_rs", start, step, lambda a: a["hi"] - a["lo"])
    at = 0.05 * (long - 1)
    low, sorted_ = int(at), F.sort_array("_rs")
    tail = (low + 1 - at) * F.get(sorted_, F.lit(low)) + (at - low) * F.get(sorted_, F.lit(min(low + 1, long - 1)))
    before = lambda c: F.lag(c, long).over(order)
    spread = F.sqrt(variance(close, frame, long, True))
    return df.withColumns({
        "variance_ratio": variance(change_, trailing(short, entity, time), short, True) / F.nullif("_v", F.lit(0)),
        "distance": (F.col(close) - mean(close, frame, long)) / F.nullif(spread, F.lit(0)),
        "acceleration": r - F.lag(change_, lag).over(order),
        "divergence": F.try_divide(F.col(volume), before(volume)) - F.try_divide(F.col(close), before(close)),
        "tail": F.round(tail, 6),
        "autocorrelation": F.when((F.col("_an") == pairs) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx").cast("double")) / F.sqrt(F.col("_yy").cast("double"))),
        "rescaled_range": F.when(F.col("_v") > 0, span / long / F.sqrt("_v")),
    }).drop("_q", "_v", "_rs", "_total", "_an", "_xx", "_yy", "_xy")


def breakouts(df: DataFrame, high: str, low: str, close: str, volume: str, n: int, k: float, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Closes beyond the extreme of the n bars before, on more than k times their mean volume."""
    frame = prior(n, entity, time)
    busy = F.col(volume) * n > k * F.sum(volume).over(frame)
    side = F.when(F.col(close) > F.max(high).over(frame), "up").when(F.col(close) < F.min(low).over(frame), "down")
    return df.withColumn("side", F.when((F.count(volume).over(frame) == n) & busy, side)).where("side is not null")


def swing_points(df: DataFrame, high: str, low: str, half: int = 5, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Highs and lows that are extreme within ``half`` bars on either side."""
    frame = over(entity, time).rowsBetween(-half, half)
    whole = F.count(F.lit(1)).over(frame) == 2 * half + 1
    return df.withColumns({
        "swing_high": whole & (F.col(high) == F.max(high).over(frame)),
        "swing_low": whole & (F.col(low) == F.min(low).over(frame)),
    }).where("swing_high or swing_low")


def notable_bars(df: DataFrame, high: str, low: str, close: str, volume: str, half: int = 5, busy: int = 2, move: int = 3, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Bars with a swing point, a volume over ``busy`` times the entity's mean, or a move over ``move`` percent."""
    frame, all_ = over(entity, time).rowsBetween(-half, half), W.partitionBy(entity)
    whole = F.count(F.lit(1)).over(frame) == 2 * half + 1
    before = F.lag(close).over(over(entity, time))
    return df.withColumns({
        "swing_high": whole & (F.col(high) == F.max(high).over(frame)),
        "swing_low": whole & (F.col(low) == F.min(low).over(frame)),
        "volume_spike": F.col(volume) * F.count(F.lit(1)).over(all_) > busy * F.sum(volume).over(all_),
        "big_move": F.coalesce(100 * F.abs(F.col(close) - before) > move * before, F.lit(False)),
    }).where("swing_high or swing_low or volume_spike or big_move")


def price_patterns(df: DataFrame, high: str, low: str, close: str, bars: int, recent: int, entity: str = "entity_id", time: str = "d") -> DataFrame:
    """Over the last ``bars``: double top, double bottom (extremes within 2 % of each other, five bars or more apart, 3 % between, left by 2 %) and a range under 8 %."""
    part = W.partitionBy(entity)
    last = df.withColumn("back", F.row_number().over(part.orderBy(F.desc(time)))).where(F.col("back") <= bars)
    last = last.withColumns({"kh": F.row_number().over(part.orderBy(F.desc(high), "back")), "kl": F.row_number().over(part.orderBy(low, "back"))})
    at = lambda k, n, c: F.max(F.when(F.col(k) == n, F.col(c)))
    ends = {f"{k}{i}": f(F.when(F.col(f"k{k}") <= 2, F.col("back"))) for k in "hl" for i, f in (("a", F.min), ("b", F.max))}
    tops = last.groupBy(entity).agg(
        at("kh", 1, high).alias("h1"), at("kh", 2, high).alias("h2"), at("kl", 1, low).alias("l1"), at("kl", 2, low).alias("l2"), *[e.alias(k) for k, e in ends.items()], at("back", 1, close).alias("last_c"),
        (100 * recent * (F.max(high) - F.min(low)) < 8 * F.sum(F.when(F.col("back") <= recent, F.col(close)))).alias("consolidation"), F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") == bars)
    both = last.join(tops, entity).groupBy(*tops.columns).agg(F.min(F.when(F.expr("back between ha and hb"), F.col(low))).alias("valley"), F.max(F.when(F.expr("back between la and lb"), F.col(high))).alias("peak"))
    top = F.expr("hb - ha >= 5 and 100 * (h1 - h2) < 2 * h1 and 100 * (h1 - valley) > 3 * h1 and 100 * (last_c - h1) < -2 * h1")
    bottom = F.expr("lb - la >= 5 and 100 * (l2 - l1) < 2 * l1 and 100 * (peak - l1) > 3 * l1 and 100 * (last_c - l1) > 2 * l1")
    return both.select(entity, top.alias("double_top"), bottom.alias("double_bottom"), "consolidation")


def extremes_each_side(df: DataFrame, value: str, tie: str, time: str, share: float) -> DataFrame:
    """max(1, int(n * share)) rows at either end per date: 'long' for the highest, 'short' for the lowest."""
    part = W.partitionBy(time)
    df = df.where(F.col(value).isNotNull())
    df = df.withColumns({"_hi": F.row_number().over(part.orderBy(F.desc(value), tie)), "_lo": F.row_number().over(part.orderBy(value, tie)), "_n": F.count(F.lit(1)).over(part)})
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return df.withColumn("side", F.when(F.col("_hi") <= k, "long").when(F.col("_lo") <= k, "short")).where("side is not null").drop("_hi", "_lo", "_n")


def holdout_parts(df: DataFrame, holdout: Column, reserve: Column, time: str = "d", until: str = "until") -> DataFrame:
    """train before the holdout's start, then holdout, then reserve; ``leaks`` where the row's outcome, known at ``until``, reaches the next part."""
    part = F.when(F.col(time) < holdout, "train").when(F.col(time) < reserve, "holdout").otherwise("reserve")
    leaks = ((part == "train") & (F.col(until) >= holdout)) | ((part == "holdout") & (F.col(until) >= reserve))
    return df.withColumns({"part": part, "leaks": F.coalesce(leaks, F.lit(False))})


def two_state(df: DataFrame, value: str, inner: Column, refit: Column, share: float, bounds: tuple[float, float], least_agreement: float, entity: str = "entity_id") -> DataFrame:
    """'high' or 'low' by a cut fitted on inner rows; entities are refused whose share of highs is out of bounds or whose labels change too much with a cut refitted on fewer rows."""
    cut = F.expr(f"percentile_disc({share}) within group (order by `{value}`)")
    fits = [df.where(where).groupBy(entity).agg(cut.alias(name)) for name, where in (("_cut", inner), ("_refit", refit))]
    rows = df.join(fits[0], entity).join(fits[1], entity).withColumns({"_high": F.col(value) > F.col("_cut"), "_same": (F.col(value) > F.col("_cut")) == (F.col(value) > F.col("_refit"))})
    n = F.count(F.lit(1))
    screens = rows.groupBy(entity).agg((F.count_if("_high") / n).alias("share"), (F.count_if("_same") / n).alias("agreement"))
    kept = screens.where(F.col("share").between(*bounds) & (F.col("agreement") >= least_agreement))
    return rows.join(kept, entity).withColumn("state", F.when(F.col("_high"), "high").otherwise("low")).drop("_cut", "_refit", "_high", "_same")


def segregated(parts: DataFrame, purge: bool = False) -> DataFrame:
    """Rows of train, holdout and reserve whose outcomes stay within their part.

    ``parts`` has part and leaks, as ``holdout_parts`` gives them.  Leaking rows
    are refused with an error that counts them, or left out on request.
    """
    if not purge and (n := parts.where("leaks").count()):
        raise ValueError(f"{n} rows have outcomes beyond their part")
    return parts.where("not leaks").drop("leaks")
