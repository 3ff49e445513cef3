"""Labels from rules over the series of a market, its sectors, industries or assets, and over labels stored before.

A rule is a scope and a tree: AND, OR and NOT over comparisons of a scope's
series with a number and over references to labels of the same scope.  Labels
are kept as episodes, so a reference is a join on the unit and the date's
interval.  Where any input of a rule is unknown the date has no label: an unknown
state is no evidence either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import islands

SCOPES = ("market", "sector", "industry", "asset")

_COMPARE = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "==": lambda c, v: c == v}


def references(tree: dict) -> list[tuple[str, str]]:
    """(rule, label) of all references of a tree."""
    if "reference" in tree:
        return [(tree["reference"], tree.get("label", "true"))]
    return [r for child in tree.get("children", []) for r in references(child)]


def in_order(rules: dict[str, dict], stored: set[str]) -> list[str]:
    """Rules after those that they refer to; cycles, unknown names, scopes and mixed scopes are refused."""
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError("rules refer to each other: " + " -> ".join([*above[above.index(name) :], name]))
        if name in done:
            return
        if rules[name]["scope"] not in SCOPES:
            raise ValueError(f"unknown scope {rules[name]['scope']!r}")
        for other, _ in references(rules[name]["tree"]):
            if other in rules:
                if rules[other]["scope"] != rules[name]["scope"]:
                    raise ValueError(f"{name!r} refers to {other!r} of another scope")
                visit(other, (*above, name))
            elif other not in stored:
                raise LookupError(f"{name!r} refers to {other!r}, which has no labels")
        done.append(name)

    for name in rules:
        visit(name, ())
    return done


def condition(tree: dict, known: dict[tuple[str, str], Column]) -> Column:
    """The tree as one column, null where any of its inputs is."""
    if "reference" in tree:
        return known[tree["reference"], tree.get("label", "true")]
    if "feature" in tree:
        if tree["cmp"] not in _COMPARE:
            raise ValueError(f"unknown comparison {tree['cmp']!r}")
        return _COMPARE[tree["cmp"]](F.col(tree["feature"]), F.lit(tree["value"]))
    parts = [condition(c, known) for c in tree["children"]]
    if tree["op"] == "NOT" and len(parts) == 1:
        return ~parts[0]
    if tree["op"] not in ("AND", "OR") or not parts:
        raise ValueError(f"unknown operation {tree['op']!r}")
    joined = reduce((lambda a, b: a & b) if tree["op"] == "AND" else (lambda a, b: a | b), parts)
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), joined)


def episodes(labels: DataFrame, time: str = "d") -> DataFrame:
    """(unit, label, start, end) of runs of equal labels."""
    return islands(labels, "label", "unit", time).select("unit", "label", "start", "end")


def regime_labels(series: dict[str, DataFrame], rules: dict[str, dict], members: dict[str, DataFrame], stored: DataFrame | None = None, time: str = "d") -> DataFrame:
    """(regime, scope, entity_id, time, label) of all rules; entity 0 stands for the market.

    ``series``: for each scope unit, time and the features.  ``members``: for each
    scope but the market unit and entity_id; a unit's label holds for its
    members.  ``stored``: regime, unit, label, start, end of labels from before.
    """
    names = {r["regime"] for r in stored.select("regime").distinct().collect()} if stored is not None else set()  # declared rules, so few
    made: dict[str, DataFrame] = {}
    out = None
    for name in in_order(rules, names):
        rule = rules[name]
        rows, known = series[rule["scope"]], {}
        for k, other in enumerate(dict.fromkeys(r for r, _ in references(rule["tree"]))):
            runs = episodes(made[other], time) if other in made else stored.where(F.col("regime") == other).select("unit", "label", "start", "end")
            runs = runs.where("label <> 'undefined'").select(F.col("unit").alias("_unit"), F.col("label").alias(f"_label{k}"), "start", "end")
            covered = (F.col("unit") == F.col("_unit")) & (F.col("start") <= F.col(time)) & (F.col(time) <= F.col("end"))
            rows = rows.join(runs, covered, "left").drop("_unit", "start", "end")
            known |= {(other, label): F.col(f"_label{k}") == label for r, label in references(rule["tree"]) if r == other}
        made[name] = rows.select("unit", time, condition(rule["tree"], known).cast("string").alias("label")).where("label is not null")
        units = made[name].withColumn("entity_id", F.lit(0).cast("long")) if rule["scope"] == "market" else made[name].join(members[rule["scope"]], "unit")
        part = units.select(F.lit(name).alias("regime"), F.lit(rule["scope"]).alias("scope"), "entity_id", time, "label")
        out = part if out is None else out.unionByName(part)
    return out
