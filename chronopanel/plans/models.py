"""Queries of statistical tests (L2, L4, L7, L8), pipelines (B29), detectors (K5) and models (M)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions.udf import entity_function
from chronopanel.operators import models as mod
from chronopanel.operators import stats as op
from chronopanel.operators import windows as win
from chronopanel.sources import fixtures as fx
from chronopanel.sources.staging import staged

from .registry import query


def matrix(spark, sf_dir):
    """entity_id, d, three features, y in basis points, label 0-4 from strong fall to strong rise, fold by date."""
    rows = fx.bars(spark, sf_dir, along=True).withColumns({"f1": 100 * win.change("c"), "f2": F.col("vol").cast("double"), "f3": 100 * win.change("c", 4), "y": F.floor(10000 * win.forward("c", 4)).cast("double")})
    label = F.when(F.col("y") < -1500, 0).when(F.col("y") < -500, 1).when(F.col("y") <= 500, 2).when(F.col("y") <= 1500, 3).otherwise(4)
    fold = lambda day: F.pmod(F.expr(f"datediff({day}, date'1995-01-01') div 180"), F.lit(3)).cast("int")
    near = F.array(fold("date_sub(d, 35)"), fold("date_add(d, 35)"))  # outcomes reach over four bars
    return rows.where("y is not null").select("entity_id", "d", "f1", "f2", "f3", "y", label.alias("label"), fold("d").alias("fold"), near.alias("near"))


@query()
def l02_one_sample(spark, sf_dir):
    return op.one_sample_t(fx.outcomes(spark, sf_dir), "y", ["entity_id"])


def pinball_scores(spark, sf_dir):
    """entity_id, d, and ten times the median's pinball loss of the forecast and of a forecast of none, both where a class says so."""
    rows = fx.predictions(spark, sf_dir).join(fx.outcomes(spark, sf_dir), ["entity_id", "d"])
    loss = lambda q: 5 * F.abs(F.col("y") - q)
    base = rows.select("entity_id", "d", loss(F.lit(0)).alias("score"))
    return base, rows.where("entity_id % 3 <> 0 or cls <> 1").select("entity_id", "d", loss(F.col("q50")).alias("score"))


@query("""s AS (SELECT entity_id, d, 5 * abs(y) AS a, CASE WHEN entity_id % 3 <> 0 OR cls <> 1 THEN 5 * abs(y - q50) END AS b FROM predictions JOIN outcomes USING (entity_id, d)),
m AS (SELECT entity_id, count(a) AS na, count(b) AS nb, sum(a)::BIGINT AS sa, coalesce(sum(b), 0)::BIGINT AS sb, sum(a * a)::BIGINT AS qa, coalesce(sum(b * b), 0)::BIGINT AS qb, sum(a - b)::BIGINT AS sd, sum((a - b) * (a - b))::BIGINT AS qd FROM s GROUP BY 1),
v AS (SELECT *, na = nb AS paired, (nb * qd - sd * sd)::DOUBLE / nb AS xd, ((na * qa - sa * sa)::DOUBLE / na + (nb * qb - sb * sb)::DOUBLE / nullif(nb, 0)) / (na + nb - 2) AS pooled FROM m)
SELECT entity_id, CASE WHEN paired THEN 'paired' ELSE 'pooled' END AS method, na AS n_base, nb AS n_other, CASE WHEN paired THEN nb - 1 ELSE na + nb - 2 END AS df,
  round(CASE WHEN paired THEN CASE WHEN nb > 1 AND xd > 0 THEN sd / nb::DOUBLE / sqrt(xd / (nb::DOUBLE - 1) / nb::DOUBLE) END
    WHEN nb > 0 AND na + nb > 2 AND pooled > 0 THEN (sa::DOUBLE / na - sb::DOUBLE / nb) / sqrt(pooled * (1::DOUBLE / na + 1::DOUBLE / nb)) END, 9) AS t FROM v""")
def l02_two_sample_t(spark, sf_dir):
    """Is the forecast's loss below that of no forecast?  Paired where both have every date, else pooled."""
    return op.one_sided_t(*pinball_scores(spark, sf_dir), "score", ["entity_id"], ["d"]).drop("p")


@query()
def l02_t_tests(spark, sf_dir):
    return op.one_sided_t(*pinball_scores(spark, sf_dir), "score", ["entity_id"], ["d"])


@query()
def l04_hac_interaction(spark, sf_dir):
    rows = matrix(spark, sf_dir).dropna()
    return op.hac_interaction(rows, "y", "f1", "f2", ["entity_id"], "d")


@query()
def l07_bootstrap_spa(spark, sf_dir):
    by = fx.outcomes(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id").groupBy("sector", "d").agg(F.avg("y").alias("y"))
    days = by.select("d").distinct().withColumn("one", F.lit(1))  # one row a date
    places = days.select("d", (F.row_number().over(W.partitionBy("one").orderBy("d")) - 1).alias("i"))
    return op.bootstrap_spa(by.join(places, "d"), "sector", "i", "y", 200, 5, 11)


@query()
def l08_block_length(spark, sf_dir):
    """Of each sector's mean outcome, and of the mean of all."""
    rows = fx.outcomes(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id").select(F.explode(F.array(F.lit("market"), F.col("sector"))).alias("scope"), "d", "y")
    return op.block_length(rows.groupBy("scope", "d").agg(F.avg("y").alias("y")), ["scope"], "d", "y")


@query()
def k05_detectors(spark, sf_dir):
    def detect(rows):
        cut = rows["c"].head(max(1, len(rows) // 2)).median()
        return rows.assign(state=(rows["c"] > cut).map({True: "high", False: "low"}))[["d", "state"]]

    return entity_function(fx.bars(spark, sf_dir).select("entity_id", "d", "c"), detect, "entity_id", "d", "d date, state string")


@query()
def b29_pipeline_stages(spark, sf_dir):
    stages = [lambda df: df.withColumn("f4", F.col("f1") - F.col("f3")), lambda df: df.withColumn("y", F.signum("y") * F.sqrt(F.abs("y"))), lambda df: df.dropna()]
    out = matrix(spark, sf_dir)
    for stage in stages:
        out = out.transform(stage)
    out = staged(out, "stages")  # every round of the fit reads it
    beta = mod.quantile_regression(out, ["f2", "f4"], "y", 0.5)
    return out.select("entity_id", "d", "y", mod.linear(beta, ["f2", "f4"]).alias("q50"))


@query()
def m1_trend_classifier(spark, sf_dir):
    rows = staged(matrix(spark, sf_dir), "matrix")  # every pass of the fit reads it
    fitted = mod.classifier(["f1", "f2", "f3"], "label", maxIter=20).fit(rows.where("d < date'2000-01-01'"))
    return mod.predict_classes(fitted, rows.where("d >= date'2000-01-01'"), ["entity_id", "d", "label"])


def split(spark, sf_dir, features):
    """Rows before 2000 and rows since, gaps filled with the medians of the former; outcomes reach over four bars, so the last five weeks before are left out."""
    rows = staged(matrix(spark, sf_dir), "matrix")
    train, held = rows.where("d < date'1999-11-27'"), rows.where("d >= date'2000-01-01'")
    fill = mod.medians(train, features)
    return mod.imputed(train, fill), mod.imputed(held, fill)


@query()
def m2_quantile_regression(spark, sf_dir):
    """Quantiles of rows that no fit has seen, clamped, beside those of the training outcomes alone."""
    train, held = split(spark, sf_dir, ["f1", "f2"])
    fitted = {q: mod.linear(mod.quantile_regression(train, ["f1", "f2"], "y", q / 100), ["f1", "f2"]) for q in (10, 50, 90)}
    base = train.agg(*[F.percentile("y", q / 100).alias(f"base{q}") for q in (10, 50, 90)])
    out = held.join(F.broadcast(base), F.lit(True))  # one row
    return out.select("entity_id", "d", "y", F.least(fitted[10], fitted[50]).alias("q10"), fitted[50].alias("q50"), F.greatest(fitted[50], fitted[90]).alias("q90"), "base10", "base50", "base90")


FEATURES = ["f1", "f2", "f3"]
GRID = [mod.Choice("mean", ())] + [mod.Choice(f"{name} {p}", fs, p) for name, fs in (("volume", ("f2",)), ("moves", ("f1", "f3")), ("all", ("f1", "f2", "f3"))) for p in (0.0, 10.0, 1000.0)]


@query()
def m3_cross_validated_search(spark, sf_dir):
    """Ten choices on purged folds: scores, their mean, and the best."""
    train, _ = split(spark, sf_dir, FEATURES)
    return mod.cross_validated(train, "fold", 3, FEATURES, "y", GRID, "near")[0]


@query()
def m3_expanding_search(spark, sf_dir):
    """The same on half-years in order, each tested by what came before it."""
    train, _ = split(spark, sf_dir, FEATURES)
    half = lambda day: F.expr(f"cast(datediff({day}, date'1995-01-01') div 180 as int)")
    dated = train.withColumns({"half": half("d"), "reach": F.array(half("date_add(d, 35)"))})
    return mod.cross_validated(dated, "half", 10, FEATURES, "y", GRID, "reach", expanding=True)[0]


@query()
def m4_permutation_importance(spark, sf_dir):
    rows = staged(matrix(spark, sf_dir).dropna(), "matrix")  # every round of the fit and every column's ranks read it
    beta = mod.quantile_regression(rows, ["f1", "f2", "f3"], "y", 0.5)
    return mod.permutation_importance(rows, ["f1", "f2", "f3"], mod.linear(beta, ["f1", "f2", "f3"]), 5)


@query()
def m5_arm_comparison(spark, sf_dir):
    """Does an arm with all features err less than one with volume alone?  Fitted before 2000, scored per entity since, paired."""
    train, held = split(spark, sf_dir, FEATURES)
    base, other = (mod.holdout_scores(train, held, FEATURES, "y", mod.Choice(n, fs), ["entity_id"]).withColumn("arm", F.lit("all")) for n, fs in (("volume", ("f2",)), ("all", tuple(FEATURES))))
    return op.one_sided_t(base, other, "score", ["arm"], ["entity_id"])


@query()
def m6_model_comparison(spark, sf_dir):
    """The best choice of the search against the mean: both fitted on all rows before 2000, the holdout touched once, scores paired by entity."""
    train, held = split(spark, sf_dir, FEATURES)
    _, best = mod.cross_validated(train, "fold", 3, FEATURES, "y", GRID, "near")
    base, other = (mod.holdout_scores(train, held, FEATURES, "y", c, ["entity_id"]).withColumn("model", F.lit(best.name)) for c in (GRID[0], best))
    return op.one_sided_t(base, other, "score", ["model"], ["entity_id"])


@query()
def m6_classifier_comparison(spark, sf_dir):
    choices = [{"algorithm": "logistic", "maxIter": 10}, {"algorithm": "forest", "numTrees": 8, "maxDepth": 4, "seed": 3}]
    return mod.cross_validate(matrix(spark, sf_dir), "fold", 3, FEATURES, "label", choices, "near").groupBy("choice", "parameters").agg(F.avg("accuracy").alias("accuracy"))
