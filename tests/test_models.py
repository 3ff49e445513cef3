"""Search, holdout and paired scores against plain numpy; rules with references against plain Python; digests."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import models, regimes, tables
from chronopanel.plans import QUERIES

FEATURES = ["a", "b"]
CHOICES = [models.Choice("mean", ()), models.Choice("a", ("a",)), models.Choice("both", ("a", "b")), models.Choice("both flat", ("a", "b"), 50.0)]


def rows(n=240, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 3 * a - b + rng.normal(size=n) + 2
    fold = [i * 4 // n for i in range(n)]
    near = [sorted({min(3, (i + 5) * 4 // n)}) for i in range(n)]
    return [(i % 7, float(a[i]), float(b[i]), float(y[i]), fold[i], near[i]) for i in range(n)]


def plain_fit(data, choice):
    x = np.array([[1.0, *[r[1 + FEATURES.index(f)] for f in choice.features]] for r in data])
    y = np.array([r[3] for r in data])
    ridge = choice.penalty * len(data) * np.diag([0.0] + [1.0] * len(choice.features))
    return np.linalg.solve(x.T @ x + ridge, x.T @ y)


def plain_loss(beta, data, choice):
    return [abs(r[3] - beta[0] - sum(w * r[1 + FEATURES.index(f)] for w, f in zip(beta[1:], choice.features))) for r in data]


@pytest.mark.parametrize("expanding", [False, True])
def test_cross_validated(spark, expanding):
    data = rows()
    df = spark.createDataFrame(data, "entity_id int, a double, b double, y double, fold int, near array<int>").repartition(3)
    got, best = models.cross_validated(df, "fold", 4, FEATURES, "y", CHOICES, "near", expanding)
    scores = {(r["model"], r["fold"]): r["score"] for r in got.collect()}
    want = {}
    for k in range(4):
        train = [r for r in data if (r[4] < k if expanding else r[4] != k) and k not in r[5]]
        if train:
            for c in CHOICES:
                want[c.name, k] = float(np.mean(plain_loss(plain_fit(train, c), [r for r in data if r[4] == k], c)))
    assert scores == pytest.approx(want) and len(want) == (12 if expanding else 16)
    mean = {c.name: np.mean([v for (n, _), v in want.items() if n == c.name]) for c in CHOICES}
    assert best.name == min(mean, key=mean.get) and {r["model"] for r in got.collect() if r["best"]} == {best.name}
    assert {r["model"]: r["mean"] for r in got.collect()} == pytest.approx(mean)


def test_holdout_scores(spark):
    data = rows()
    df = spark.createDataFrame(data, "entity_id int, a double, b double, y double, fold int, near array<int>")
    got = {r["entity_id"]: r["score"] for r in models.holdout_scores(df.where("fold < 3"), df.where("fold = 3"), FEATURES, "y", CHOICES[2], ["entity_id"]).collect()}
    beta = plain_fit([r for r in data if r[4] < 3], CHOICES[2])
    held = [r for r in data if r[4] == 3]
    assert got == pytest.approx({e: float(np.mean(plain_loss(beta, [r for r in held if r[0] == e], CHOICES[2]))) for e in range(7)})


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (None, 4.0), (3.0, float("nan")), (5.0, 8.0)], "a double, b double")
    fill = models.medians(df.where("a is not null"), ["a"])
    assert fill == {"a": 3.0}
    assert [r["a"] for r in models.imputed(df, fill).collect()] == [1.0, 3.0, 3.0, 5.0]
    assert [r["b"] for r in models.imputed(df, {"b": 0.5}).collect()] == [0.5, 4.0, 0.5, 8.0]


def leaf(feature, cmp, value):
    return {"feature": feature, "cmp": cmp, "value": value}


def test_regimes_refuse(spark):
    at = lambda tree, scope="market": {"scope": scope, "tree": tree}
    refer = lambda name: {"reference": name}
    with pytest.raises(ValueError, match="a -> b -> a"):
        regimes.in_order({"a": at(refer("b")), "b": at(refer("a"))}, set())
    with pytest.raises(ValueError, match="a -> a"):
        regimes.in_order({"a": at({"op": "NOT", "children": [refer("a")]})}, set())
    with pytest.raises(LookupError, match="no labels"):
        regimes.in_order({"a": at(refer("gone"))}, {"kept"})
    with pytest.raises(ValueError, match="another scope"):
        regimes.in_order({"a": at(refer("b")), "b": at(leaf("x", ">", 1), "sector")}, set())
    with pytest.raises(ValueError, match="unknown scope"):
        regimes.in_order({"a": at(leaf("x", ">", 1), "planet")}, set())
    for bad in ({"op": "XOR", "children": [leaf("x", ">", 1)] * 2}, leaf("x", "~", 1)):
        with pytest.raises(ValueError, match="unknown"):
            regimes.condition(bad, {})
    assert regimes.in_order({"a": at(refer("b")), "b": at(refer("kept"))}, {"kept"}) == ["b", "a"]


def test_regimes_drop_unknown_dates(spark):
    """Gaps in features and in stored labels give no label, even where the other input alone would decide."""
    rng = random.Random(4)
    values = {(u, t): (None if rng.random() < 0.2 else rng.randint(-5, 5), None if rng.random() < 0.2 else rng.randint(-5, 5)) for u in "pq" for t in range(40)}
    frame = spark.createDataFrame([(u, t, *v) for (u, t), v in values.items()], "unit string, d int, f int, g int")
    stored = spark.createDataFrame([("old", "p", "true", 3, 9), ("old", "p", "false", 10, 12), ("old", "p", "undefined", 13, 20), ("old", "q", "true", 0, 30)], "regime string, unit string, label string, start int, end int")
    rules = {
        "mixed": {"scope": "sector", "tree": {"op": "OR", "children": [{"reference": "old"}, {"op": "AND", "children": [leaf("f", ">", 0), {"op": "NOT", "children": [leaf("g", "<=", 1)]}]}]}},
        "on top": {"scope": "sector", "tree": {"op": "AND", "children": [{"reference": "mixed", "label": "false"}, {"reference": "old", "label": "true"}]}},
    }
    members = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "unit string, entity_id long")
    got = {(r["regime"], r["entity_id"], r["d"]): r["label"] for r in regimes.regime_labels({"sector": frame}, rules, {"sector": members}, stored).collect()}
    old = {("p", t): "true" if t <= 9 else "false" for t in range(3, 13)} | {("q", t): "true" for t in range(31)}
    want, mixed = {}, {}
    for (u, t), (f, g) in values.items():
        if (u, t) in old and f is not None and g is not None:
            mixed[u, t] = old[u, t] == "true" or (f > 0 and not g <= 1)
    spans: dict = {}  # a label holds over the interval of its episode
    for u in "pq":
        days = sorted(t for v, t in mixed if v == u)
        for i, t in enumerate(days):
            spans[u, t] = mixed[u, t]
            if i and mixed[u, days[i - 1]] == mixed[u, t]:
                spans |= {(u, x): mixed[u, t] for x in range(days[i - 1], t)}
    for u, entities in (("p", (1, 2)), ("q", (3,))):
        for e in entities:
            want |= {("mixed", e, t): str(v).lower() for (w, t), v in mixed.items() if w == u}
            want |= {("on top", e, t): str(not v and old[w, t] == "true").lower() for (w, t), v in spans.items() if w == u and (w, t) in old}
    assert got == want


def test_digests(spark):
    values = [("a", f"s{i}") for i in range(50)] + [("b", f"s{i}") for i in range(49)] + [("c", f"s{i}") for i in reversed(range(50))] + [("d", None), ("e", "s1"), ("e", "s1")]
    df = spark.createDataFrame(values, "g string, s string")
    digest = lambda frame: {r["g"]: r["x"] for r in frame.groupBy("g").agg(tables.set_digest(F.col("s")).alias("x")).collect()}
    got = digest(df.repartition(7))
    assert got == digest(df.coalesce(1)) and got["a"] == got["c"] != got["b"] and got["d"].endswith("-0") and got["e"].endswith("-2")
    x, y = leaf("x", ">", 1), {"op": "OR", "children": [leaf("y", "<", 2), leaf("a", "<", 2)]}
    turned = {"op": "AND", "children": [{"op": "OR", "children": y["children"][::-1]}, x]}
    assert tables.canonical({"op": "AND", "children": [x, y]}) == tables.canonical(turned) != tables.canonical({"op": "OR", "children": [x, y]})


def test_list_digests(spark):
    """The hash of the sorted list itself: other joints of the same letters differ, batches and partitions don't matter."""
    lists = {"a": [f"s{i % 70}" for i in range(90)], "b": ["s1s2"], "c": ["s1", "s2", None], None: ["x"], "e": [None, None], "f": [""]}
    values = [(g, s) for g, texts in lists.items() for s in texts]
    random.Random(2).shuffle(values)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["g"]: (r["fingerprint"], r["n"]) for r in tables.list_digest(spark.createDataFrame(values, "g string, s string").repartition(5), "g", "s").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    joined = {g: [t for t in texts if t is not None] for g, texts in lists.items()}
    assert got == {g: (hashlib.sha256(",".join(sorted(t)).encode()).hexdigest() if t else None, len(lists[g])) for g, t in joined.items()}


@pytest.mark.parametrize("name", ["m4_permutation_importance", "b29_pipeline_stages", "m1_trend_classifier"])
def test_fits_read_staged_rows(spark, monkeypatch, name):
    """A fit passes over its rows many times: they are files by then, not the bars' shuffles."""

    class Seen(Exception):
        pass

    def fit(df, *_, **__):
        raise Seen(df.inputFiles())

    monkeypatch.setattr(models, "quantile_regression", fit)
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, df: fit(df))
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    files = seen.value.args[0]
    assert files and all("/chronopanel-" in f for f in files)


def test_refusals(spark):
    """Leaks, empty memberships and fast growth are refused; pins and force let them pass."""
    from chronopanel.operators import windows

    parts = spark.createDataFrame([("train", 1, False), ("train", 2, True), ("holdout", 3, False)], "part string, d int, leaks boolean")
    with pytest.raises(ValueError, match="1 rows"):
        windows.segregated(parts)
    assert sorted(r["d"] for r in windows.segregated(parts, purge=True).collect()) == [1, 3]
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "k long")
    refresh = lambda *a, **b: {(r["k"], r["action"]) for r in tables.guarded_refresh(*map(frame, a), "k", **b).collect()}
    everyone = range(8)
    assert refresh(everyone, [1, 2, 2, 99], [2, 3], []) == {(1, "add"), (3, "remove")}
    with pytest.raises(ValueError, match="no member"):
        refresh(everyone, everyone, everyone, [])
    with pytest.raises(ValueError, match="from 1 to 4 of 8"):
        refresh(everyone, [1, 2, 3, 4], [1], [])
    assert refresh(everyone, [1, 2, 3, 4], [1], [], force=True) == {(k, "add") for k in (2, 3, 4)}
    assert refresh(everyone, [1, 2, 3, 4], [1], [4, 1]) == {(2, "add"), (3, "add"), (1, "remove")}


def test_datasets(spark, tmp_path):
    from chronopanel.sources import datasets

    rows = spark.createDataFrame([(e, f"2020-01-{d:02d}", f, float(e * d)) for e in (1, 2) for d in (1, 2, 3) for f in ("a", "b")], "entity_id long, d string, feature string, value double").withColumn("d", F.col("d").cast("date"))
    for kind in ("csv", "parquet"):
        path = f"file://{tmp_path}/{kind}"
        datasets.export_dataset({"features": rows}, path, kind, start="2020-01-02", entities=rows.where("entity_id = 2"), include=["a"])
        got = datasets.read_part(spark, path, "features", "entity_id long, d date, feature string, value double").collect()
        assert sorted((r["entity_id"], str(r["d"]), r["feature"], r["value"]) for r in got) == [(2, "2020-01-02", "a", 4.0), (2, "2020-01-03", "a", 6.0)]
        with pytest.raises(FileNotFoundError):
            datasets.read_part(spark, path, "labels", "entity_id long")
    datasets.export_dataset({"features": rows}, f"file://{tmp_path}/csv", "parquet", exclude=["a"])
    assert {r["feature"] for r in datasets.read_part(spark, f"file://{tmp_path}/csv", "features", "entity_id long, d date, feature string, value double").collect()} == {"b"}
    with pytest.raises(ValueError, match="unknown format"):
        datasets.export_dataset({}, "x", "orc")
    with pytest.raises(ValueError, match="both"):
        datasets.export_dataset({}, "x", include=["a"], exclude=["a"])


def test_choices_share_a_folds_medians(spark, monkeypatch):
    """Two choices on two folds: medians are fitted twice, and rows come by choice, then fold."""
    made, plain = [], models.assembly
    monkeypatch.setattr(models, "assembly", lambda features: made.append(1) or plain(features))
    df = spark.createDataFrame([(i % 2, float(i) if i % 7 else None, int(i > 20)) for i in range(40)], "fold int, f double, label int")
    out = models.cross_validate(df, "fold", 2, ["f"], "label", [{"maxIter": 5}, {"algorithm": "forest", "numTrees": 2, "seed": 1}])
    got = [(r["choice"], r["fold"]) for r in out.collect()]
    assert len(made) == 2 and got == [(0, 0), (0, 1), (1, 0), (1, 1)]
