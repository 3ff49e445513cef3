"""Dataset folders: prices, long features and long labels, written with filters and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a dataset.
PARTS = ("prices", "features", "labels")


def export_dataset(
    frames: dict[str, DataFrame], path: str, kind: str = "parquet", start: str | None = None, end: str | None = None, entities: DataFrame | None = None,
    include: list[str] | None = None, exclude: list[str] = (), entity: str = "entity_id", time: str = "d", feature: str = "feature",
) -> None:
    """Write the tables of ``PARTS`` that ``frames`` holds below ``path``, as Parquet or CSV.

    Dates are kept from ``start`` to ``end``, both included, and the entities of
    ``entities``.  Features are those of ``include`` (None: all) less ``exclude``;
    a feature in both is refused, so is another format.
    """
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown format {kind!r}")
    if both := set(include or ()) & set(exclude):
        raise ValueError(f"features both included and excluded: {sorted(both)}")
    for name in PARTS:
        if name not in frames:
            continue
        df = frames[name]
        df = df.where(F.col(time) >= F.lit(start).cast("date")) if start else df
        df = df.where(F.col(time) <= F.lit(end).cast("date")) if end else df
        df = df.join(entities.select(entity).distinct(), entity, "left_semi") if entities is not None else df
        if name == "features":
            df = df.where(F.col(feature).isin(*include)) if include is not None else df
            df = df.where(~F.col(feature).isin(*exclude)) if exclude else df
        writer = df.hint("rebalance").write
        (writer.parquet if kind == "parquet" else writer.option("header", True).csv)(f"{path}/{name}.{kind}")


def _is_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of a dataset: Parquet if it was written whole, else CSV; neither is an error."""
    for kind in ("parquet", "csv"):
        if _is_there(spark, f"{path}/{name}.{kind}"):
            reader = spark.read.schema(schema)
            return reader.parquet(f"{path}/{name}.parquet") if kind == "parquet" else reader.option("header", True).csv(f"{path}/{name}.csv")
    raise FileNotFoundError(f"{path} holds no {name}")


def read_matrix(spark: SparkSession, path: str, features: list[str], horizon: int, keys: str = "entity_id long, d date") -> DataFrame:
    """Features wide beside the labels of one horizon, on the rows that have a label; a feature that a row lacks is null."""
    names = [k.split()[0] for k in keys.split(",")]
    wide = read_part(spark, path, "features", f"{keys}, feature string, value double").groupBy(*names).pivot("feature", features).agg(F.first("value"))
    labels = read_part(spark, path, "labels", f"{keys}, horizon int, label double").where(F.col("horizon") == horizon).drop("horizon")
    return labels.join(wide, names, "left")
