"""Model jobs on pyspark.ml and on normal equations summed in Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.sources.staging import staged


def classifier(features: list[str], label: str, algorithm: str = "logistic", **params) -> Pipeline:
    """Median imputation, assembly, and a multinomial classifier."""
    return Pipeline(stages=[*assembly(features), estimator(label, algorithm, **params)])


def assembly(features: list[str]) -> list:
    """Median imputation and assembly."""
    filled = [f"_{f}" for f in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x")]


def estimator(label: str, algorithm: str = "logistic", **params):
    """A multinomial classifier of assembled rows."""
    kinds = {"logistic": LogisticRegression, "forest": RandomForestClassifier}
    return kinds[algorithm](featuresCol="_x", labelCol=label, **params)


def predict_classes(fitted, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predicted class and the probability of each."""
    out = fitted.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("p"))


def quantile_regression(df: DataFrame, features: list[str], y: str, q: float, rounds: int = 12, eps: float | None = None) -> list[float]:
    """Coefficients (intercept first) of a linear quantile model by reweighted least squares; each round sums one set of normal equations.

    Residuals weigh no more than those of ``eps`` do, a thousandth of the target's deviation if not given.
    """
    if eps is None:
        eps = 1e-3 * (df.agg(F.stddev_pop(y)).first()[0] or 1.0)
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    k = len(x)
    beta = np.zeros(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(rounds):
        e = F.col(y) - sum((x[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
        w = F.when(e >= 0, q).otherwise(1 - q) / F.greatest(F.abs(e), F.lit(eps))
        row = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(w * x[i] * F.col(y)).alias(f"b{i}") for i in range(k)]).first()
        a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        new = np.linalg.lstsq(a + 1e-9 * np.eye(k), np.array([row[f"b{i}"] or 0.0 for i in range(k)]), rcond=None)[0]
        if np.abs(new - beta).max() < 1e-6:
            return new.tolist()
        beta = new
    return beta.tolist()


def linear(beta: list[float], features: list[str]):
    return sum((F.col(f) * b for f, b in zip(features, beta[1:], strict=True)), F.lit(beta[0]))


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Median of each feature, by a sketch: one row to the driver."""
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), 0.5).alias(f) for f in features]).first()
    return {f: row[f] if row[f] is not None else 0.0 for f in features}


def imputed(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Missing features replaced by what was learned of the training rows."""
    return df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(v)) for f, v in fill.items()})


#: Group of the sums over all training rows, beside those of the folds.
ALL = -1


@dataclass(frozen=True)
class Choice:
    """A linear model to try: its features (none: the mean alone) and the penalty on their coefficients."""

    name: str
    features: tuple[str, ...]
    penalty: float = 0.0


def fold_sums(df: DataFrame, fold: str, n_folds: int, features: list[str], y: str, near: str | None = None, expanding: bool = False) -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, features, y) over the rows that train it, and over all rows.

    A row trains the folds that it isn't in (with ``expanding`` only later
    ones), less those that ``near``, an array, says its outcome reaches.  One
    grouped aggregate over the rows makes the sums of all folds; every model that
    is tried is solved from them.
    """
    k = F.col("_k")
    trains = F.col("_f") < k if expanding else F.col("_f") != k
    if near:
        trains = trains & ~F.array_contains(near, k)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, y)]]
    wide = df.withColumns({"_f": F.col(fold), "_k": F.explode(F.array(*map(F.lit, (ALL, *range(n_folds)))))}).where((k == ALL) | trains)
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    out = {}
    for r in wide.groupBy("_k").agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in cells]).collect():  # a row a fold
        m = np.zeros((len(x), len(x)))
        for i, j in cells:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r["_k"]] = m
    return out


def solved(sums: np.ndarray, features: list[str], choice: Choice) -> list[float]:
    """Coefficients, intercept first, of a choice from the sums over its training rows."""
    at = [0, *[1 + features.index(f) for f in choice.features]]
    a, b = sums[np.ix_(at, at)], sums[at, -1]
    ridge = choice.penalty * sums[0, 0] * np.diag([0.0] + [1.0] * len(choice.features))
    return np.linalg.lstsq(a + ridge, b, rcond=None)[0].tolist()


def cross_validated(df: DataFrame, fold: str, n_folds: int, features: list[str], y: str, choices: list[Choice], near: str | None = None, expanding: bool = False) -> tuple[DataFrame, Choice]:
    """(model, fold, rows, score, mean, best): mean absolute error of each choice on each fold, and the choice of the least mean.

    Two passes over the rows, whatever the number of choices: one for all folds'
    sums, one for all scores.  Folds that nothing trains (the first one of an
    expanding search) have no score.  Ties go to the choice named first.
    """
    sums = fold_sums(df, fold, n_folds, features, y, near, expanding)
    tried = [k for k in range(n_folds) if k in sums]
    at = F.col(fold)
    losses = []
    for n, c in enumerate(choices):
        predicted = F.lit(None).cast("double")
        for k in tried:
            predicted = F.when(at == k, linear(solved(sums[k], features, c), list(c.features))).otherwise(predicted)
        losses.append(F.avg(F.abs(F.col(y) - predicted)).alias(f"l{n}"))
    seen = {r["_f"]: r for r in df.where(at.isin(tried)).groupBy(at.alias("_f")).agg(F.count(F.lit(1)).alias("rows"), *losses).collect()}  # a row a fold
    mean = [float(np.mean([r[f"l{n}"] for r in seen.values()])) for n in range(len(choices))]
    best = int(np.argmin(mean))
    rows = [(c.name, k, r["rows"], r[f"l{n}"], mean[n], n == best) for n, c in enumerate(choices) for k, r in sorted(seen.items())]
    return df.sparkSession.createDataFrame(rows, "model string, fold int, rows long, score double, mean double, best boolean"), choices[best]


def holdout_scores(train: DataFrame, held: DataFrame, features: list[str], y: str, choice: Choice, keys: list[str]) -> DataFrame:
    """Mean absolute error per key on rows that no fit has seen, of a choice fitted on all training rows."""
    beta = solved(fold_sums(train.withColumn("_fold", F.lit(0)), "_fold", 0, features, y)[ALL], features, choice)
    return held.groupBy(*keys).agg(F.avg(F.abs(F.col(y) - linear(beta, list(choice.features)))).alias("score"))


def cross_validate(df: DataFrame, fold: str, n_folds: int, features: list[str], label: str, choices: list[dict], near: str | None = None) -> DataFrame:
    """Accuracy of each choice {algorithm, parameters} of classifiers on each fold; every fit is a job, so for few choices.

    ``near`` names an array of folds that a row's outcome may reach: such rows
    are purged from the training of these folds.  All choices of a fold share its
    medians.
    """
    df, rows = staged(df.select(fold, *([near] if near else []), *features, label), "matrix"), []  # every fit reads it
    for k in range(n_folds):
        train = df.where(F.col(fold) != k)
        train = train.where(~F.array_contains(near, k)) if near else train
        ready = Pipeline(stages=assembly(features)).fit(train)
        train, held = (ready.transform(x).select("_x", label) for x in (train, df.where(F.col(fold) == k)))
        for c, choice in enumerate(choices):
            fitted = estimator(label, **choice).fit(train)
            hits = predict_classes(fitted, held, [label]).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()["a"]
            rows.append((c, str(sorted(choice.items())), k, hits))
    rows.sort(key=lambda r: (r[0], r[2]))
    return df.sparkSession.createDataFrame(rows, "choice int, parameters string, fold int, accuracy double")


def permutation_importance(df: DataFrame, features: list[str], score, seed: int) -> DataFrame:
    """Mean absolute change of the score when one column is permuted; ranks within buckets pair rows with permuted ones."""
    out = None
    base = df.withColumn("_b", F.pmod(F.xxhash64(*features), F.lit(max(64, df.count() // 100_000))))
    for k, f in enumerate(features):
        one = base.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed), *features), *features)))
        other = base.select("_b", F.col(f).alias("_p"), F.row_number().over(W.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + k + 1), *features), *features)).alias("_r"))
        both = one.join(other, ["_b", "_r"]).withColumn("_s", score)
        part = both.withColumn(f, F.col("_p")).agg(F.avg(F.abs(score - F.col("_s"))).alias("importance")).select(F.lit(f).alias("feature"), "importance")
        out = part if out is None else out.unionByName(part)
    return out
