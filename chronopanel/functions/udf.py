"""User functions by shape: per entity, per series, per date, per row of named series.

A plain Column expression is preferred where one exists; these adapters run
pandas code inside Spark tasks, one group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def entity_function(df: DataFrame, compute: Callable[[pd.DataFrame], pd.DataFrame], entity: str, time: str, schema: str) -> DataFrame:
    """``compute`` on the ordered rows of each entity; its columns follow ``schema``."""
    kind = dict(df.dtypes)[entity]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time).reset_index(drop=True)
        out = compute(rows)
        out.insert(0, entity, rows[entity].iloc[0])
        return out

    return df.groupBy(entity).applyInPandas(run, f"{entity} {kind}, {schema}")


def series_adapter(df: DataFrame, fn: Callable, specs: dict[str, dict], entity: str, time: str) -> DataFrame:
    """One call of ``fn(rows, **params)`` per named spec, aligned to the rows."""

    def compute(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({time: rows[time]} | {name: fn(rows, **params).astype(float) for name, params in specs.items()})

    return entity_function(df, compute, entity, time, f"{time} date, " + ", ".join(f"{n} double" for n in specs))


def market_function(df: DataFrame, fn: Callable[[pd.DataFrame], float | None], time: str, least: int = 1) -> DataFrame:
    """``fn`` on the rows of each date: None, not finite or too few rows is a gap; another type is refused."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value = fn(rows) if len(rows) >= least else None
        if value is not None and type(value) not in (int, float):
            raise TypeError(f"a market function returned {type(value).__name__}")
        ok = value is not None and math.isfinite(value)
        out = rows[[time]].head(1 if ok else 0)
        return out.assign(value=float(value) if ok else 0.0)

    return df.groupBy(time).applyInPandas(run, f"{time} date, value double")


def composite_function(wide: DataFrame, fn: Callable, inputs: list[str]) -> DataFrame:
    """``fn`` of named series as a vectorised function; a row with a missing input is a gap."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return fn(*columns)

    return wide.dropna(subset=inputs).withColumn("value", run(*inputs))


def grid_values(spec: list | dict) -> list:
    """A list as it is; {low, high, step} whole numbers, both ends included; {low, high, steps} so many evenly spaced ones."""
    if isinstance(spec, list):
        return spec
    low, high = spec["low"], spec["high"]
    if "steps" in spec:
        n = spec["steps"]
        return [low + i * (high - low) / (n - 1) for i in range(n)] if n > 1 else [low]
    return list(range(low, high + 1, spec.get("step", 1)))


def parameter_grid(spark: SparkSession, choices: dict[str, list | dict]) -> DataFrame:
    """Every combination of the listed or spanned values."""
    out = spark.range(1).drop("id")
    for name, spec in choices.items():
        values = grid_values(spec)
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def random_parameters(spark: SparkSession, n: int, ranges: dict[str, tuple], seed: int) -> DataFrame:
    """n uniform draws from a hash of seed, name and id, so the same on any cluster; whole numbers between integer bounds."""
    out = spark.range(n)
    for name, (low, high) in ranges.items():
        unit = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(name), "id"), 256), 1, 13), 16, 10).cast("long") / F.lit(1 << 52)
        draw = low + unit * (high - low)
        out = out.withColumn(name, F.floor(draw).cast("int") if isinstance(low, int) else draw)
    return out
