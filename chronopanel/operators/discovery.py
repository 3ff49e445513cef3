"""Search over conditions on dates: boolean atoms, their pairs, tests and verdicts.

An atom is a set of dates.  Dates are numbered and 64 of them make a word, so an
atom is a few long integers, and AND and OR of two atoms are bit operations on
joined words.  Runs of dates are counted on the words too.  Outcomes meet a
candidate by word and are kept where its bit is set, so all candidates and all
samples are tested in one grouped plan.

Defined cases: an atom that is null on a date doesn't hold there; dates without
an outcome are in no test; a test without enough runs, rows or spread has no p,
and without p nothing survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.sources.staging import staged

from .stats import t_statistic, upper_p
from .tables import benjamini_hochberg

WORD, BIT = "i div 64 as word", "cast(i % 64 as int)"


def numbered(dates: DataFrame, time: str) -> DataFrame:
    """``i``, a date's number from 0 over all distinct dates: one row a date."""
    days = dates.select(time).distinct().withColumn("_one", F.lit(1))
    return days.select(time, (F.row_number().over(W.partitionBy("_one").orderBy(time)) - 1).cast("long").alias("i"))


def candidates(atoms: DataFrame, name: str = "a", budget: int | None = None) -> DataFrame:
    """Atoms, then AND and OR of all pairs, numbered in that order: id, a, b, op, family, and whether the budget admits it.

    Atoms are few: a search space is declared, and its size is the square of theirs.
    """
    other = atoms.select(F.col(name).alias("b"))
    pairs = atoms.select(F.col(name).alias("a")).join(other, F.col(name) < F.col("b")).withColumn("op", F.explode(F.array(F.lit("AND"), F.lit("OR"))))
    every = pairs.unionByName(atoms.select(F.col(name).alias("a")), allowMissingColumns=True).withColumn("_one", F.lit(1))
    part = W.partitionBy("_one")
    order = part.orderBy(F.col("b").isNotNull(), "a", "b", "op")
    out = every.select(F.row_number().over(order).alias("id"), "a", "b", "op", F.count(F.lit(1)).over(part).alias("family"))
    return out.withColumn("within", F.lit(True) if budget is None else F.col("id") <= budget)


def words(flags: DataFrame, atoms: list[str], place: str = "i") -> DataFrame:
    """(atom, word, bits): the words of each atom that hold a date."""
    held = flags.select(F.col(place).alias("i"), *atoms).unpivot(["i"], atoms, "atom", "on").where("on")
    return held.selectExpr("atom", WORD, f"shiftleft(1L, {BIT}) as bit").groupBy("atom", "word").agg(F.bit_or("bit").alias("bits"))


def combined(tried: DataFrame, atom_words: DataFrame) -> DataFrame:
    """(id, word, bits) of candidates: an AND needs both atoms' words, an OR either's."""
    members = tried.select("id", "op", F.explode(F.array_compact(F.array("a", "b"))).alias("atom"))
    met = members.join(atom_words, "atom").groupBy("id", "op", "word").agg(F.bit_and("bits").alias("both"), F.bit_or("bits").alias("any"), F.count(F.lit(1)).alias("n"))
    bits = F.when(F.col("op") == "AND", F.when(F.col("n") == 2, F.col("both"))).otherwise(F.col("any"))
    return met.select("id", "word", bits.alias("bits")).where("bits <> 0")


def runs(bits: Column, before: Column) -> Column:
    """Runs that begin in a word, given the word before."""
    carried = F.shiftleft(bits, 1).bitwiseOR(F.shiftrightunsigned(before, 63))
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(carried)))


def tests(tried: DataFrame, bits: DataFrame, outcomes: DataFrame, value: str, part: str, keys: tuple[str, ...] = (), floor: int = 5, least: int = 2) -> DataFrame:
    """Per key, candidate, part of the dates and bucket (on, off): n, s, ss, episodes and t of a mean above zero.

    ``outcomes``: keys, i, part, value, one row a key and date; buckets without a date have no row.
    """
    rows = outcomes.select(*keys, "i", part, F.col(value).alias("_v")).where("_v is not null").selectExpr("*", WORD)
    rows, bits = staged(rows, "outcomes"), staged(bits, "bits")
    sums = lambda p="": [F.count(F.lit(1)).alias(f"{p}n"), F.sum("_v").alias(f"{p}s"), F.sum(F.col("_v") * F.col("_v")).alias(f"{p}ss")]
    on = rows.join(bits, "word").where(f"getbit(bits, {BIT}) = 1").groupBy(*keys, part, "id").agg(*sums())
    # dates of a key and part as words of their own; runs are counted among them
    own = rows.selectExpr(*keys, part, "word", f"shiftleft(1L, {BIT}) as bit").groupBy(*keys, part, "word").agg(F.bit_or("bit").alias("dates"))
    dense = own.join(F.broadcast(tried.select("id")), F.lit(True)).join(bits, ["id", "word"], "left")  # candidates are within their budget
    along = W.partitionBy(*keys, part, "id").orderBy("word")
    held = F.coalesce("bits", F.lit(0).cast("long"))
    masked = dense.withColumns({"_on": held.bitwiseAND(F.col("dates")), "_off": F.bitwise_not(held).bitwiseAND(F.col("dates"))})
    before = lambda c: F.coalesce(F.when(F.lag("word").over(along) == F.col("word") - 1, F.lag(c).over(along)), F.lit(0).cast("long"))
    counted = masked.withColumns({f"{c}_runs": runs(F.col(c), before(c)) for c in ("_on", "_off")}).groupBy(*keys, part, "id").agg(F.sum("_on_runs").alias("on_runs"), F.sum("_off_runs").alias("off_runs"))
    whole = counted.join(rows.groupBy(*keys, part).agg(*sums("all_")), [*keys, part]).join(on, [*keys, part, "id"], "left").na.fill(0, ["n", "s", "ss"])
    side = lambda name, n, s, ss, k: F.struct(F.lit(name).alias("bucket"), n.alias("n"), s.alias("s"), ss.alias("ss"), F.col(k).alias("episodes"))
    kept, rest = [F.col(c) for c in ("n", "s", "ss")], [F.col(f"all_{c}") - F.col(c) for c in ("n", "s", "ss")]
    out = whole.select(*keys, part, "id", F.explode(F.array(side("on", *kept, "on_runs"), side("off", *rest, "off_runs"))).alias("x")).select(*keys, part, "id", "x.*").where("n > 0")
    return out.withColumn("t", F.when(F.col("episodes") >= floor, t_statistic(F.col("n"), F.col("s"), F.col("ss"), least, dict(outcomes.dtypes)[value])))


def verdicts(tested: DataFrame, part: str, screen: float, rate: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key and candidate: the least inner and outer p, and the verdict.

    A candidate is selected by an inner p up to ``screen``; outer p of selected
    ones make one family a key.  ``part`` is true on inner dates.
    """
    by = [*keys, "id"]
    rows = staged(tested.withColumn("p", F.when(F.col("t").isNotNull(), upper_p("t", F.col("n") - 1))), "tested")
    inner = rows.where(part).groupBy(*by).agg(F.min("p").alias("p_inner"))
    outer = rows.where(~F.col(part)).join(inner.where(F.col("p_inner") <= screen).select(*by), by)
    family = staged(outer.where("p is not null").withColumn("_family", F.lit(1)), "family")
    judged = benjamini_hochberg(family, "p", [*keys, "_family"], rate).groupBy(*by).agg(F.min("p").alias("p_outer"), F.bool_or("survivor").alias("survived"))
    out = inner.join(judged, by, "left")
    verdict = (
        F.when(F.col("p_inner").isNull(), "refused_low_power").when(F.col("p_inner") > screen, "rejected").when(F.col("p_outer").isNull(), "refused_low_power").when(F.col("survived"), "admitted").otherwise("rejected")
    )
    return out.select(*by, "p_inner", "p_outer", verdict.alias("verdict"))
