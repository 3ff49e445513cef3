"""Recursions along a series: smoothing, debouncing, ledgers.

A window frame can't carry state, and an ``aggregate`` over a collected array
copies its output at every step, which is quadratic in the length.

Smoothing is linear in its state, so any stretch of a history is one pair (a, b):
state out = a * state in + b.  ``smooth`` cuts long histories into chunks of time,
reduces each to such pairs, combines them along the chunks, and then follows
each chunk from its own first state.  No task holds more than a chunk.

Recursions that aren't linear go through ``ordered_fold``, one fold per entity in
``applyInPandas``; there an entity's history must fit in a task, which daily
bars of decades do.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, fold: Callable[..., Iterator[tuple]], inputs: list[str], outputs: dict[str, str], keep: list[str], entity: str = "entity_id", time: str = "d") -> DataFrame:
    """``fold(*columns)`` yields one tuple of outputs for each row of an entity, in time order."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        out = rows[[entity, *keep]].copy()
        made = list(zip(*fold(*(rows[c].tolist() for c in inputs)), strict=True))
        for name, values in zip(outputs, made, strict=True):
            out[name] = pd.Series(values, index=rows.index, dtype="object" if outputs[name] == "string" else None)
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in (entity, *keep)) + "".join(f", {n} {k}" for n, k in outputs.items())
    return df.select(*dict.fromkeys((entity, time, *inputs, *keep))).groupBy(entity).applyInPandas(run, schema)


def wilder(values, period: int) -> Iterator[float | None]:
    """Wilder's mean: seeded with a simple mean, then (state * (period - 1) + x) / period."""
    seed, state = [], None
    for x in values:
        if x is None:
            yield state
            continue
        if state is None:
            seed.append(x)
            if len(seed) == period:
                state = sum(seed) / period
        else:
            state = (state * (period - 1) + x) / period
        yield state


def adx(high, low, close, period: int = 14) -> Iterator[float | None]:
    """Average directional index from Wilder means of moves and true range."""
    up, down, reach = [None], [None], [None]
    for i in range(1, len(high)):
        u, d = high[i] - high[i - 1], low[i - 1] - low[i]
        up.append(u if u > d and u > 0 else 0)
        down.append(d if d > u and d > 0 else 0)
        reach.append(max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])))
    dx = []
    for u, d, r in zip(wilder(up, period), wilder(down, period), wilder(reach, period), strict=True):
        dx.append(None if r is None else 0.0 if u + d == 0 else 100 * abs(u - d) / (u + d))
    return wilder(dx, period)


def parabolic_sar(high, low, step: float = 0.02, most: float = 0.2) -> Iterator[tuple]:
    """Stop and side: trails the extreme with growing acceleration and turns when it is touched."""
    if not high:
        return
    rising, af = True, step
    stop, extreme = low[0], high[0]
    yield float(stop), "long"
    for i in range(1, len(high)):
        stop += af * (extreme - stop)
        edge = low[max(0, i - 2) : i] if rising else high[max(0, i - 2) : i]
        stop = min(stop, *edge) if rising else max(stop, *edge)
        if (low[i] < stop) if rising else (high[i] > stop):
            rising, stop, af = not rising, extreme, step
            extreme = high[i] if rising else low[i]
        elif (high[i] > extreme) if rising else (low[i] < extreme):
            extreme, af = (high[i] if rising else low[i]), min(most, af + step)
        yield float(stop), "long" if rising else "short"


def debounce(labels, k: int) -> Iterator[str]:
    """A label counts once it has lasted k rows; until then the one before goes on."""
    known = candidate = None
    run = 0
    for x in labels:
        run = run + 1 if x == candidate else 1
        candidate = x
        if known is None or run >= k:
            known = x
        yield known


def average_cost(side, shares, price) -> Iterator[tuple]:
    """Held shares and realised profit of each row, long only, at average cost in whole units."""
    held = cost = 0
    for s, n, p in zip(side, shares, price, strict=True):
        if s == "buy":
            held, cost = held + n, cost + n * p
            yield held, 0
        else:
            out = min(n, held)
            part = cost * out // held if held else 0
            held, cost = held - out, cost - part
            yield held, out * p - part


@dataclass(frozen=True)
class Recurrence:
    """state = step(state, x), which is a * state + b * x; the first ``seed`` known values make its simple mean (0: it starts from 0)."""

    a: float
    b: float
    step: Callable[[float, float], float]
    seed: int

    #: Known values so far, their sum while they are seeds, and the state.
    START = (0, 0, None)

    def fold(self, state: tuple, x) -> tuple:
        n, total, y = state
        if x is None or x != x:
            return state
        if y is not None:
            return n + 1, total, self.step(y, x)
        if not self.seed:
            return n + 1, total, self.step(0.0, x)
        n, total = n + 1, total + x
        return n, total, total / self.seed if n == self.seed else None

    def digest(self, values: list) -> tuple[int, list, list, list]:
        """A stretch, whatever comes before: number of known values, the first ones, and the pair (a, b) of what follows each of those."""
        known = [x for x in values if x is not None and x == x]
        m = min(len(known), self.seed)
        a, b = 1.0, 0.0
        for x in known[m:]:
            a, b = self.a * a, self.step(b, x)
        many_a, many_b = [a], [b]
        for x in reversed(known[:m]):
            a, b = a * self.a, a * self.b * x + b
            many_a.append(a)
            many_b.append(b)
        return len(known), [float(x) for x in known[:m]], many_a[::-1], many_b[::-1]

    def carry(self, state: tuple, digest: tuple) -> tuple:
        """The state after a stretch."""
        (n, total, y), (more, first, a, b) = state, digest
        if y is None and self.seed:
            used = self.seed - n
            if more < used:
                return n + more, total + sum(first), None
            return n + more, total, a[used] * ((total + sum(first[:used])) / self.seed) + b[used]
        return n + more, total, (a[0] * (y or 0.0) + b[0]) if more or y is not None else None


def exponential(period: int) -> Recurrence:
    k = 2 / (period + 1)
    return Recurrence(1 - k, k, lambda y, x: y * (1 - k) + x * k, period)


def wilders(period: int) -> Recurrence:
    return Recurrence((period - 1) / period, 1 / period, lambda y, x: (y * (period - 1) + x) / period, period)


def decayed_sum(period: int) -> Recurrence:
    keep = 1 - 2 / (period + 1)
    return Recurrence(keep, 1.0, lambda y, x: x + keep * y, 0)


def chunked(df: DataFrame, entity: str, time: str, chunk_rows: int) -> tuple[DataFrame, bool]:
    """``df`` with ``_c``, the place of a row's stretch of time within its entity, and whether any entity has several."""
    most = df.groupBy(entity).count().agg(F.max("count")).first()[0] or 0
    if most <= chunk_rows:
        return df.withColumn("_c", F.lit(0)), False
    n, tick = -(-most // chunk_rows), F.col(time).cast("timestamp").cast("double")
    cuts = df.groupBy(entity).agg(F.percentile_approx(tick, [k / n for k in range(1, n)]).alias("_cuts"))
    place = F.aggregate("_cuts", F.lit(0), lambda k, cut: k + (cut < tick).cast("int"))
    return df.join(cuts, entity).withColumn("_c", place).drop("_cuts"), True


def smooth(
    df: DataFrame, value: str, recurrences: list[Recurrence], finish: Callable[..., tuple], outputs: dict[str, str], keep: list[str],
    feeds: list[Callable] | None = None, moves: bool = False, entity: str = "entity_id", time: str = "d", chunk_rows: int = 1 << 16,
) -> DataFrame:
    """Per row the ``outputs`` that ``finish`` makes of all states after it.

    Each recurrence is fed the value, or with ``moves`` the value less the one
    before, through its function of ``feeds``.  Unknown values leave states as
    they are.  Histories up to ``chunk_rows`` are followed from the start, so
    results are those of the plain recursion to the last bit; longer ones differ by
    rounding of the first state of a chunk at most.
    """
    kinds, size = dict(df.dtypes), len(recurrences)
    feeds = feeds or [lambda x: x] * size
    rows, many = chunked(df.select(*dict.fromkeys((entity, time, value, *keep))), entity, time, chunk_rows)

    def inputs(values: list, before) -> list:
        if not moves:
            return [None if x is None or x != x else x for x in values]
        return [None if a is None or b is None or a != a or b != b else b - a for a, b in zip([before, *values], values)]

    def feed(f: Callable, xs: list) -> list:
        return [None if x is None else f(x) for x in xs]

    def results(values: list, states: list[tuple], before) -> tuple[list, list[tuple]]:
        """What ``finish`` makes of each value, and the states after the last."""
        xs, made, after = inputs(values, before), [], []
        for r, f, state in zip(recurrences, feeds, states, strict=True):
            along = []
            for x in feed(f, xs):
                state = r.fold(state, x)
                along.append(state[2])
            made.append(along)
            after.append(state)
        return [finish(*ys) for ys in zip(*made, strict=True)], after

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole histories one after another, in order of entity and time; states go on from batch to batch."""
        last, states, before = object(), start, None
        for batch in batches:
            keys, values, made = batch.column(entity).to_pylist(), batch.column(value).to_pylist(), []
            for e, run in itertools.groupby(range(len(keys)), keys.__getitem__):
                part = [values[i] for i in run]
                if e != last:
                    last, states, before = e, start, None
                rows, states = results(part, states, before)
                made += rows
                before = part[-1]
            made = [pa.array(x, pa.float64() if kind == "double" else None) for x, kind in zip(zip(*made, strict=True), outputs.values(), strict=True)] if made else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in (entity, *keep)] + made, [entity, *keep, *outputs])

    def follow(part: pd.DataFrame, states: list[tuple], before) -> pd.DataFrame:
        part = part.sort_values(time)
        out = part[[entity, *keep]].copy()
        rows, _ = results(part[value].tolist(), states, before)
        for name, values in zip(outputs, zip(*rows, strict=True), strict=True):
            out[name] = pd.Series(values, index=part.index, dtype="float64" if outputs[name] == "double" else "object")
        return out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (entity, *keep)) + "".join(f", `{n}` {k}" for n, k in outputs.items())
    start = [Recurrence.START] * size
    if not many:
        return rows.drop("_c").repartition(entity).sortWithinPartitions(entity, time).mapInArrow(pass_over, schema)

    def digest(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values(time)[value].tolist()
        xs = inputs(values, None)[1 if moves else 0 :]
        row = {entity: part[entity].iloc[0], "_c": part["_c"].iloc[0], "_first": values[0], "_last": values[-1]}
        for k, (r, f) in enumerate(zip(recurrences, feeds, strict=True)):
            row |= dict(zip((f"_n{k}", f"_x{k}", f"_a{k}", f"_b{k}"), r.digest(feed(f, xs)), strict=True))
        return pd.DataFrame([row])

    def carry(chunks: pd.DataFrame) -> pd.DataFrame:
        """Along an entity's chunks, a row each: the states before each, and the value before it."""
        states, before, out = start, None, []
        for c in chunks.sort_values("_c").to_dict("records"):
            out.append({entity: c[entity], "_c": c["_c"], "_before": before} | {f"_{n}{k}": v for k, s in enumerate(states) for n, v in zip("nsy", s, strict=True)})
            step = inputs([c["_first"]], before) if moves else []
            states = [r.carry(r.fold(s, feed(f, step)[0]) if step else s, tuple(c[f"_{n}{k}"] for n in "nxab")) for k, (r, f, s) in enumerate(zip(recurrences, feeds, states, strict=True))]
            before = c["_last"]
        return pd.DataFrame(out)

    def go_on(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({n: [] for n in (entity, *keep, *outputs)})
        c = known.iloc[0]
        states = [(int(c[f"_n{k}"]), c[f"_s{k}"], None if pd.isna(c[f"_y{k}"]) else float(c[f"_y{k}"])) for k in range(size)]
        return follow(part, states, None if pd.isna(c["_before"]) else c["_before"])

    key = f"`{entity}` {kinds[entity]}, _c int"
    digests = rows.groupBy(entity, "_c").applyInPandas(digest, f"{key}, _first double, _last double" + "".join(f", _n{k} long, _x{k} array<double>, _a{k} array<double>, _b{k} array<double>" for k in range(size)))
    carried = digests.groupBy(entity).applyInPandas(carry, f"{key}, _before double" + "".join(f", _n{k} long, _s{k} double, _y{k} double" for k in range(size)))
    return rows.groupBy(entity, "_c").cogroup(carried.groupBy(entity, "_c")).applyInPandas(go_on, schema)


def ema(df: DataFrame, value: str, period: int, keep: list[str], **where) -> DataFrame:
    """Exponential mean seeded with the simple mean of the first ``period`` known values."""
    return smooth(df, value, [exponential(period)], lambda y: (y,), {"ema": "double"}, keep, **where)


def macd_line(df: DataFrame, value: str, keep: list[str], fast: int = 12, slow: int = 26, **where) -> DataFrame:
    """Fast minus slow mean, both from one pass."""
    less = lambda f, s: (None if f is None or s is None else f - s,)
    return smooth(df, value, [exponential(fast), exponential(slow)], less, {"macd": "double"}, keep, **where)


def macd(df: DataFrame, value: str, keep: list[str], fast: int = 12, slow: int = 26, signal: int = 9, entity: str = "entity_id", time: str = "d", **where) -> DataFrame:
    """Fast minus slow mean, the mean of that, and their difference."""
    line = macd_line(df, value, list(dict.fromkeys((time, *keep))), fast, slow, entity=entity, time=time, **where)
    out = smooth(line, "macd", [exponential(signal)], lambda y: (y,), {"signal": "double"}, list(dict.fromkeys((time, *keep, "macd"))), entity=entity, time=time, **where)
    out = out.withColumn("signal", F.when(F.col("macd").isNotNull(), F.col("signal")))
    return out.select(entity, *keep, "macd", "signal", (F.col("macd") - F.col("signal")).alias("hist"))


def rsi(df: DataFrame, value: str, period: int, keep: list[str], **where) -> DataFrame:
    """Wilder's RSI; without losses 100, without either 50."""

    def index(gain, loss):
        return (None if gain is None else 50.0 if gain + loss == 0 else 100 * gain / (gain + loss),)

    return smooth(df, value, [wilders(period)] * 2, index, {"rsi": "double"}, keep, [lambda m: max(m, 0), lambda m: max(-m, 0)], moves=True, **where)


def adjusted_ema(df: DataFrame, value: str, period: int, keep: list[str], **where) -> DataFrame:
    """Weights that sum to one over what has been seen so far."""
    return smooth(df, value, [decayed_sum(period)] * 2, lambda num, den: (None if not den else num / den,), {"ema": "double"}, keep, [lambda x: x, lambda _: 1], **where)
