"""Queries of sources and sinks (section A); payloads are first built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.sources import datasets as data
from chronopanel.sources import fixtures as fx
from chronopanel.sources import ingest as op
from chronopanel.sources.staging import shared_path as scratch

from .joins import _LONG, long_features
from .registry import query


def bar_payloads(spark, sf_dir):
    """One payload per entity in the provider's shape; some dates and closes are spoilt."""
    text = lambda c: F.col(c).cast("string")
    values = F.create_map(*[x for n, c in (("1. open", "o"), ("2. high", "h"), ("3. low", "l"), ("4. close", "c"), ("6. volume", "vol")) for x in (F.lit(n), F.when((F.col("vol") % 13 == 0) & F.lit(c == "c"), "n/a").otherwise(text(c)))])
    rows = fx.bars(spark, sf_dir).select("entity_id", F.struct(F.when(F.col("vol") % 17 == 0, F.concat(F.lit("x"), text("d"))).otherwise(text("d")).alias("k"), values.alias("v")).alias("e"))
    body = rows.groupBy("entity_id").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    return body.select("entity_id", F.to_json(F.create_map(F.lit("Time Series (Daily)"), "m")).alias("payload"))


@query("SELECT entity_id, d, o::DOUBLE AS o, h::DOUBLE AS h, l::DOUBLE AS l, c::DOUBLE AS c, vol::DOUBLE AS vol FROM bars WHERE vol % 13 <> 0 AND vol % 17 <> 0")
def a01_daily_bars(spark, sf_dir):
    good, _ = op.daily_bars(bar_payloads(spark, sf_dir), "entity_id", "payload")
    return good.select("entity_id", "d", "o", "h", "l", "c", "vol")


@query("SELECT entity_id, count(*) AS n FROM bars WHERE vol % 13 = 0 OR vol % 17 = 0 GROUP BY 1")
def a01_quarantine(spark, sf_dir):
    return op.daily_bars(bar_payloads(spark, sf_dir), "entity_id", "payload")[1].groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT entity_id, d AS "fiscalDateEnding", c::DOUBLE AS "totalRevenue", '{"vol":"' || vol || '"}' AS raw FROM nbars WHERE rn % 13 = 5""")
def a02_statements(spark, sf_dir):
    rows = fx.numbered(fx.bars(spark, sf_dir)).where("rn % 13 = 5")
    item = F.create_map(F.lit("fiscalDateEnding"), F.col("d").cast("string"), F.lit("totalRevenue"), F.col("c").cast("string"), F.lit("vol"), F.col("vol").cast("string"))
    payloads = rows.groupBy("entity_id").agg(F.to_json(F.struct(F.collect_list(item).alias("quarterlyReports"))).alias("payload"))
    return op.statements(payloads, "entity_id", "payload", "quarterlyReports", {"fiscalDateEnding": "date", "totalRevenue": "double"})


@query("""q AS (SELECT * FROM nbars WHERE rn % 13 = 5)
SELECT entity_id, 'income' AS statement_type, d, NULL::DATE AS reported_at, c::DOUBLE AS revenue, NULL::DOUBLE AS assets, NULL::DOUBLE AS cashflow, NULL::DOUBLE AS eps, '{"note":"' || vol || '"}' AS raw FROM q WHERE vol % 17 <> 0
UNION ALL SELECT entity_id, 'balance_sheet', d, NULL, NULL, CASE WHEN vol % 5 > 0 THEN h::DOUBLE END, NULL, NULL, NULL FROM q WHERE vol % 17 <> 0
UNION ALL SELECT entity_id, 'cash_flow', d, NULL, NULL, NULL, l::DOUBLE, NULL, NULL FROM q WHERE vol % 17 <> 0
UNION ALL SELECT entity_id, 'earnings', d, d + 40, NULL, NULL, NULL, vol::DOUBLE, NULL FROM q WHERE vol % 17 <> 0""")
def a02_all_statements(spark, sf_dir):
    """Four payloads an entity, one a type; some dates and numbers are spoilt, unknown fields go to raw."""
    text = lambda c: F.col(c).cast("string")
    date = F.when(F.col("vol") % 17 == 0, F.lit("soon")).otherwise(text("d"))
    fields = {
        "income": (F.lit("totalRevenue"), text("c"), F.lit("note"), text("vol")), "balance_sheet": (F.lit("totalAssets"), F.when(F.col("vol") % 5 > 0, text("h")).otherwise("None")),
        "cash_flow": (F.lit("operatingCashflow"), text("l"), F.lit("reportedCurrency"), F.lit("USD")), "earnings": (F.lit("reportedEPS"), text("vol"), F.lit("reportedDate"), F.date_add("d", 40).cast("string")),
    }
    kinds = F.explode(F.create_map(*[x for k, f in fields.items() for x in (F.lit(k), F.create_map(F.lit("fiscalDateEnding"), date, *f))])).alias("kind", "item")
    rows = fx.numbered(fx.bars(spark, sf_dir)).where("rn % 13 = 5").select("entity_id", kinds)
    array = F.when(F.col("kind") == "earnings", "quarterlyEarnings").otherwise("quarterlyReports")
    payloads = rows.groupBy("entity_id", "kind").agg(F.collect_list("item").alias("items")).select("entity_id", "kind", F.to_json(F.create_map(array, "items")).alias("payload"))
    out = op.statement_rows(payloads, "entity_id", "kind", "payload")
    return out.select("entity_id", "statement_type", "d", "reported_at", F.col("totalRevenue").alias("revenue"), F.col("totalAssets").alias("assets"), F.col("operatingCashflow").alias("cashflow"), F.col("reportedEPS").alias("eps"), "raw")


@query("SELECT entity_id, CASE WHEN upper(trim(sector)) = 'ASIA' THEN NULL ELSE upper(sector) END AS sector, CASE WHEN entity_id % 3 > 0 THEN entity_id::DOUBLE END AS pe FROM dims")
def a03_overview(spark, sf_dir):
    from chronopanel.functions.scalars import class_name

    m = F.create_map(F.lit("Sector"), F.when(F.col("sector") == "ASIA", "None").otherwise(F.lower("sector")), F.lit("PERatio"), F.when(F.col("entity_id") % 3 == 0, "-").otherwise(F.col("entity_id").cast("string")))
    rows = fx.dims(spark, sf_dir).select("entity_id", F.from_json(F.to_json(m), "map<string,string>").alias("m"))
    return rows.select("entity_id", class_name(F.element_at("m", "Sector")).alias("sector"), op.snapshot_value(F.col("m"), "PERatio").alias("pe"))


@query("SELECT entity_id, symbol FROM dims WHERE sector = 'EUROPE' AND entity_id % 2 = 0")
def a04_listing(spark, sf_dir):
    rows = fx.dims(spark, sf_dir).withColumn("status", F.when(F.col("entity_id") % 2 == 0, "Active").otherwise("Delisted"))
    return op.listing(rows, sector="Europe", status="ACTIVE").select("entity_id", "symbol")


@query("SELECT d, sum(c)::DOUBLE AS value FROM bars GROUP BY d HAVING count(*) % 5 <> 0")
def a05_macro_csv(spark, sf_dir):
    s = fx.bars(spark, sf_dir).groupBy("d").agg(F.sum("c").alias("v"), F.count(F.lit(1)).alias("n"))
    lines = s.select(F.concat_ws(",", F.col("d").cast("string"), F.when(F.col("n") % 5 == 0, ".").otherwise(F.col("v").cast("string"))).alias("line"))
    return op.macro_csv(lines, "line")


@query("SELECT entity_id, d, c::DOUBLE AS value, o::DOUBLE AS o, h::DOUBLE AS h, l::DOUBLE AS l FROM bars WHERE vol % 13 <> 0 AND vol % 17 <> 0")
def a05_index_json(spark, sf_dir):
    return op.index_json(bar_payloads(spark, sf_dir), "entity_id", "payload")


@query("SELECT sector, date_trunc('month', d)::DATE AS d, sum(c)::DOUBLE AS value FROM bars JOIN dims USING (entity_id) GROUP BY 1, 2 HAVING count(*) % 5 <> 0")
def a05_monthly_json(spark, sf_dir):
    s = fx.bars(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id").groupBy("sector", F.trunc("d", "month").alias("d")).agg(F.sum("c").alias("v"), F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col("d").cast("string").alias("date"), F.when(F.col("n") % 5 == 0, ".").otherwise(F.col("v").cast("string")).alias("value"))
    payloads = s.groupBy("sector").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("payload"))
    return op.monthly_json(payloads, "sector", "payload")


@query("SELECT entity_id, d, c::DOUBLE AS macd, vol::DOUBLE AS signal FROM bars")
def a06_indicator_payload(spark, sf_dir):
    item = F.create_map(F.lit("MACD"), F.col("c").cast("string"), F.lit("MACD_Signal"), F.col("vol").cast("string"))
    rows = fx.bars(spark, sf_dir).groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d").cast("string"), item))).alias("m"))
    payloads = rows.select("entity_id", F.to_json(F.create_map(F.lit("Technical Analysis: MACD"), "m")).alias("payload"))
    return op.keyed_series(payloads, "entity_id", "payload", "Technical Analysis: MACD", {"macd": "MACD", "signal": "MACD_Signal"})


@query(_LONG + " SELECT entity_id, d, 'close' AS name, c AS value FROM bars UNION ALL SELECT entity_id, d, 'q50', value FROM feats WHERE feature = 'q50'")
def a07_routed_scan(spark, sf_dir):
    tables = {"bars": lambda c: fx.bars(spark, sf_dir).select("entity_id", "d", F.col(c).alias("value")), "feats": lambda c: long_features(spark, sf_dir).where(F.col("feature") == c).select("entity_id", "d", "value")}
    out = None
    for name, source, column in (("close", "bars", "c"), ("q50", "feats", "q50")):
        one = tables[source](column).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT entity_id, d, 'h' AS feature, h AS value FROM bars WHERE vol % 3 > 0 UNION ALL SELECT entity_id, d, 'l', l FROM bars")
def a08_long_store(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).withColumn("h", F.when(F.col("vol") % 3 > 0, F.col("h")))
    return rows.unpivot(["entity_id", "d"], ["h", "l"], "feature", "value").where("value is not null")


@query(_LONG + " SELECT entity_id, feature, count(*) AS n, sum(value)::BIGINT AS total FROM feats WHERE d >= DATE '1997-01-01' GROUP BY 1, 2")
def a09_dataset_export(spark, sf_dir):
    path = scratch(spark, "dataset")
    long_features(spark, sf_dir).where("d >= date'1997-01-01'").write.partitionBy("feature").parquet(path)
    back = spark.read.schema("entity_id long, d date, value long, feature string").parquet(path)
    return back.groupBy("entity_id", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT entity_id, d, c, vol FROM bars")
def a10_dataset_read(spark, sf_dir):
    path = scratch(spark, "csv")
    fx.bars(spark, sf_dir).select("entity_id", "d", "c", "vol").write.option("header", True).csv(path)
    return spark.read.schema("entity_id long, d date, c long, vol long").option("header", True).csv(path)


_SET = _LONG + """, e AS (SELECT entity_id FROM dims WHERE sector <> 'ASIA'),
l AS (SELECT entity_id, d, h AS horizon, y * h AS label FROM outcomes, (SELECT unnest([1, 2]) AS h))"""


def dataset(spark, sf_dir, kind):
    """A dataset of some entities and dates without the feature y, written below a new path."""
    path = scratch(spark, "dataset")
    labels = fx.outcomes(spark, sf_dir).withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(2)))).select("entity_id", "d", "horizon", (F.col("y") * F.col("horizon")).cast("double").alias("label"))
    frames = {"prices": fx.bars(spark, sf_dir).select("entity_id", "d", "c"), "features": long_features(spark, sf_dir).withColumn("value", F.col("value").cast("double")), "labels": labels}
    data.export_dataset(frames, path, kind, "1996-01-01", "1999-12-31", fx.dims(spark, sf_dir).where("sector <> 'ASIA'"), exclude=["y"])
    return path


@query(_SET + """ SELECT 'prices' AS part, entity_id, count(*) AS n, sum(c)::DOUBLE AS total FROM bars SEMI JOIN e USING (entity_id) WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 2
UNION ALL SELECT 'features', entity_id, count(*), sum(value)::DOUBLE FROM feats SEMI JOIN e USING (entity_id) WHERE feature <> 'y' AND d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 2
UNION ALL SELECT 'labels', entity_id, count(*), sum(label)::DOUBLE FROM l SEMI JOIN e USING (entity_id) WHERE d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 2""")
def a09_filtered_export(spark, sf_dir):
    path = dataset(spark, sf_dir, "csv")
    parts = {"prices": ("entity_id long, d date, c double", "c"), "features": ("entity_id long, d date, feature string, value double", "value"), "labels": ("entity_id long, d date, horizon int, label double", "label")}
    out = None
    for name, (schema, value) in parts.items():
        one = data.read_part(spark, path, name, schema).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.lit(name).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(_SET + """ SELECT entity_id, d, label::DOUBLE AS label, max(value) FILTER (WHERE feature = 'q10')::DOUBLE AS q10, max(value) FILTER (WHERE feature = 'q50')::DOUBLE AS q50
FROM l SEMI JOIN e USING (entity_id) LEFT JOIN feats USING (entity_id, d) WHERE horizon = 2 AND d BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2, 3""")
def a10_features_and_labels(spark, sf_dir):
    return data.read_matrix(spark, dataset(spark, sf_dir, "parquet"), ["q10", "q50"], 2)


@query("SELECT 'bars' AS name, count(*) AS n_rows, true AS verified FROM bars WHERE d >= DATE '1998-01-01' UNION ALL SELECT 'dims', count(*), true FROM dims")
def a11_snapshot_verify(spark, sf_dir):
    frames = {"bars": fx.bars(spark, sf_dir).where("d >= date'1998-01-01'"), "dims": fx.dims(spark, sf_dir)}
    path = scratch(spark, "snapshot")
    for name, df in frames.items():
        df.write.parquet(f"{path}/{name}")
    back = {n: spark.read.schema(df.schema).parquet(f"{path}/{n}").select(*df.columns) for n, df in frames.items()}
    now = op.snapshot_manifest(back).withColumnsRenamed({"n_rows": "n2", "checksum": "c2"})
    return op.snapshot_manifest(frames).join(now, "name").select("name", "n_rows", ((F.col("n_rows") == F.col("n2")) & F.col("checksum").eqNullSafe(F.col("c2"))).alias("verified"))
