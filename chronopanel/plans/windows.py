"""Queries of the window family (section E)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators import windows as op
from chronopanel.sources import fixtures as fx

from .registry import query

_E = "PARTITION BY entity_id ORDER BY d"
_T = lambda n: f"(PARTITION BY entity_id ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("""
x AS (SELECT entity_id, symbol, d, 'market' AS g, c FROM bars JOIN dims USING (entity_id)
  UNION ALL SELECT entity_id, symbol, d, 'sector:' || sector, c FROM bars JOIN dims USING (entity_id)
  UNION ALL SELECT entity_id, symbol, d, 'industry:' || industry, c FROM bars JOIN dims USING (entity_id))
SELECT entity_id, d, g AS "group", c, rank() OVER (PARTITION BY g, d ORDER BY c DESC) AS rank,
  CASE WHEN count(*) OVER (PARTITION BY g, d) = 1 THEN 1.0::DOUBLE ELSE (count(*) OVER (PARTITION BY g, d) - row_number() OVER (PARTITION BY g, d ORDER BY c DESC, symbol))::DOUBLE / (count(*) OVER (PARTITION BY g, d) - 1) END AS percentile
FROM x""")
def xsec_rank(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id")
    return op.group_ranks(rows, "c", "symbol", "d", {"sector": "sector", "industry": "industry"}).select("entity_id", "d", "group", "c", F.col("rank").cast("long"), "percentile")


@query(f"SELECT entity_id, d, CASE WHEN count(c) OVER w = 20 THEN sum(c) OVER w / 20 END AS sma FROM bars WINDOW w AS {_T(20)}")
def e01_sma(spark, sf_dir):
    return op.sma(fx.bars(spark, sf_dir), "c", 20).select("entity_id", "d", "sma")


@query(f"""
SELECT entity_id, d, mid, mid + 2 * sqrt(v) AS upper, mid - 2 * sqrt(v) AS lower FROM (
  SELECT entity_id, d, CASE WHEN count(c) OVER w = 20 THEN sum(c) OVER w / 20 END AS mid,
    CASE WHEN count(c) OVER w = 20 THEN (20 * sum(c * c) OVER w - (sum(c) OVER w) * (sum(c) OVER w)) / 400 END AS v FROM bars WINDOW w AS {_T(20)})""")
def e02_bollinger(spark, sf_dir):
    return op.bollinger(fx.bars(spark, sf_dir), "c").select("entity_id", "d", "mid", "upper", "lower")


@query(f"""
a AS (SELECT entity_id, d, CASE WHEN count(c) OVER w = 14 THEN 100 * (c - min(l) OVER w) / nullif(max(h) OVER w - min(l) OVER w, 0) END AS raw_k FROM bars WINDOW w AS {_T(14)}),
b AS (SELECT *, CASE WHEN count(raw_k) OVER w = 3 THEN sum(raw_k) OVER w / 3 END AS slow_k FROM a WINDOW w AS {_T(3)})
SELECT entity_id, d, raw_k, slow_k IS NOT NULL AS has_k, count(slow_k) OVER w = 3 AS has_d FROM b WINDOW w AS {_T(3)}""")
def e03_stochastic(spark, sf_dir):
    out = op.stochastic(fx.bars(spark, sf_dir), "h", "l", "c")
    return out.select("entity_id", "d", "raw_k", F.col("slow_k").isNotNull().alias("has_k"), F.col("slow_d").isNotNull().alias("has_d"))


@query(f"""
r AS (SELECT entity_id, d, CAST(floor(10000 * (c / lag(c) OVER ({_E}) - 1)) AS BIGINT) AS r FROM bars)
SELECT entity_id, d, CASE WHEN count(r) OVER w = 20 THEN (20 * sum(r * r) OVER w - (sum(r) OVER w) * (sum(r) OVER w)) / 380 END AS variance FROM r WINDOW w AS {_T(20)}""")
def e04_realised_vol(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).withColumn("r", F.floor(10000 * op.change("c")).cast("long"))
    return rows.withColumn("variance", op.variance("r", op.trailing(20), 20, sample=True)).select("entity_id", "d", "variance")


@query(f"SELECT entity_id, d, " + ", ".join(f"c / lag(c, {k}) OVER ({_E}) - 1 AS r{k}" for k in (1, 5, 21, 63)) + " FROM bars")
def e05_returns(spark, sf_dir):
    return fx.bars(spark, sf_dir).select("entity_id", "d", *[op.change("c", k).alias(f"r{k}") for k in (1, 5, 21, 63)])


@query(f"""
m AS (SELECT entity_id, d, c - lag(c) OVER ({_E}) AS m FROM bars),
g AS (SELECT entity_id, d, count(m) OVER w AS n, sum(greatest(m, 0)) OVER w AS gain, sum(greatest(-m, 0)) OVER w AS loss FROM m WINDOW w AS {_T(14)})
SELECT entity_id, d, CASE WHEN n = 14 THEN CASE WHEN gain = 0 AND loss = 0 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 * gain / (gain + loss) END END AS rsi FROM g""")
def e09_rsi_simple(spark, sf_dir):
    return op.rsi_simple(fx.bars(spark, sf_dir), "c").select("entity_id", "d", "rsi")


@query(f"""
t AS (SELECT entity_id, d, greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) AS tr FROM bars WINDOW w AS ({_E}))
SELECT entity_id, d, tr, CASE WHEN count(tr) OVER w = 14 THEN sum(tr) OVER w / 14 END AS atr FROM t WINDOW w AS {_T(14)}""")
def e12_true_range(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).withColumn("tr", op.true_range("h", "l", "c"))
    return rows.withColumn("atr", op.mean("tr", op.trailing(14), 14)).select("entity_id", "d", "tr", "atr")


@query(f"""
x AS (SELECT entity_id, d, rn::BIGINT AS i, c FROM nbars)
SELECT entity_id, d, CASE WHEN count(c) OVER w = 10 THEN (10 * sum(i * c) OVER w - (sum(i) OVER w) * (sum(c) OVER w)) / (10 * sum(i * i) OVER w - (sum(i) OVER w) * (sum(i) OVER w)) END AS slope FROM x WINDOW w AS {_T(10)}""")
def e13_slope(spark, sf_dir):
    return op.slope(fx.bars(spark, sf_dir), "c", 10).select("entity_id", "d", "slope")


@query(f"SELECT entity_id, d, (10 * lag(c, 4) OVER w - 5 * lag(c, 3) OVER w - 10 * lag(c, 2) OVER w - 5 * lag(c, 1) OVER w + 10 * c) / 70 AS concavity FROM bars WINDOW w AS ({_E})")
def e14_concavity(spark, sf_dir):
    return op.concavity(fx.bars(spark, sf_dir), "c", 5).select("entity_id", "d", "concavity")


@query(f"""
r AS (SELECT *, CAST(floor(10000 * (c / lag(c) OVER ({_E}) - 1)) AS BIGINT) AS r FROM bars),
q AS (SELECT *, lag(r, 5) OVER ({_E}) AS q FROM r),
v AS (SELECT entity_id, d, c, vol, r,
  CASE WHEN count(r) OVER s = 5 THEN (5 * sum(r * r) OVER s - (sum(r) OVER s) * (sum(r) OVER s)) / 20 END AS v5,
  CASE WHEN count(r) OVER t = 20 THEN (20 * sum(r * r) OVER t - (sum(r) OVER t) * (sum(r) OVER t)) / 380 END AS v20,
  CASE WHEN count(c) OVER t = 20 THEN sum(c) OVER t / 20 END AS m20, CASE WHEN count(c) OVER t = 20 THEN sqrt((20 * sum(c * c) OVER t - (sum(c) OVER t) * (sum(c) OVER t))::DOUBLE / 380) END AS s20,
  CASE WHEN count(r) OVER t = 20 THEN round(quantile_cont(r, 0.05) OVER t, 6) END AS tail, CASE WHEN count(r) OVER t = 20 THEN list(r) OVER t END AS rs,
  count(q) OVER u AS an, sum(r) FILTER (WHERE q IS NOT NULL) OVER u AS sx, sum(q) OVER u AS sy, sum(r * r) FILTER (WHERE q IS NOT NULL) OVER u AS sxx, sum(q * q) OVER u AS syy, sum(r * q) OVER u AS sxy
  FROM q WINDOW s AS {_T(5)}, t AS {_T(20)}, u AS {_T(45)}),
z AS (SELECT *, list_transform(range(1, 21), lambda k: 20 * list_sum(rs[1:k]) - k * list_sum(rs)) AS walk FROM v)
SELECT entity_id, d, v5 / nullif(v20, 0) AS variance_ratio, (c - m20) / nullif(s20, 0) AS distance, r - lag(r, 5) OVER w AS acceleration,
  vol / lag(vol, 20) OVER w - c / lag(c, 20) OVER w AS divergence, tail,
  CASE WHEN an = 45 AND 45 * sxx > sx * sx AND 45 * syy > sy * sy THEN (45 * sxy - sx * sy)::DOUBLE / sqrt((45 * sxx - sx * sx)::DOUBLE) / sqrt((45 * syy - sy * sy)::DOUBLE) END AS autocorrelation,
  CASE WHEN rs IS NOT NULL AND v20 > 0 THEN (list_max(walk) - list_min(walk)) / 20 / sqrt(v20) END::DOUBLE AS rescaled_range FROM z WINDOW w AS ({_E})""")
def e15_rolling_templates(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).withColumn("r", F.floor(10000 * op.change("c")).cast("long"))
    return op.rolling_templates(rows, "c", "vol", "r").select("entity_id", "d", "variance_ratio", "distance", "acceleration", "divergence", "tail", "autocorrelation", "rescaled_range")


@query(f"SELECT entity_id, d, (c - max(c) OVER w) / max(c) OVER w AS drawdown FROM bars WINDOW w AS ({_E} ROWS UNBOUNDED PRECEDING)")
def e16_drawdown(spark, sf_dir):
    return fx.bars(spark, sf_dir).select("entity_id", "d", op.drawdown("c").alias("drawdown"))


@query(f"""
SELECT entity_id, d, c / divisor AS c, vol * divisor AS vol, divisor FROM (
  SELECT entity_id, d, c, vol, coalesce(product(split_coefficient) OVER ({_E} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS divisor,
    min(CASE WHEN split_coefficient > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id) AS ok FROM split_bars) WHERE ok = 1""")
def e17_split_adjust(spark, sf_dir):
    return op.split_adjust(fx.split_bars(spark, sf_dir), ("c",), "vol", "split_coefficient").select("entity_id", "d", "c", "vol", "divisor")


@query(f"""
x AS (SELECT entity_id, d, c <= 0 OR c >= 4 * lag(c) OVER w OR 4 * c <= lag(c) OVER w AS bad FROM bars WINDOW w AS ({_E}))
SELECT entity_id, min(d) AS first_bad, count(*) AS n_bad FROM x WHERE bad GROUP BY entity_id""")
def e18_implausible(spark, sf_dir):
    return op.implausible(fx.bars(spark, sf_dir), "c")


@query(f"SELECT * FROM (SELECT entity_id, d, c / lag(c, 20) OVER ({_E}) - 1 AS ret_20 FROM bars) WHERE d >= DATE '1997-01-06'")
def e19_lagged_return(spark, sf_dir):
    return fx.bars(spark, sf_dir).select("entity_id", "d", op.change("c", 20).alias("ret_20")).where("d >= date'1997-01-06'")


@query(" UNION ALL ".join(f"""
SELECT entity_id, d, {h} AS horizon, r, CASE WHEN r < -0.06 THEN 'strong_down' WHEN r < -0.02 THEN 'weak_down' WHEN r <= 0.02 THEN 'neutral' WHEN r <= 0.06 THEN 'weak_up' ELSE 'strong_up' END AS label
FROM (SELECT entity_id, d, lead(c, {h}) OVER ({_E}) / c - 1 AS r FROM bars) WHERE r IS NOT NULL""" for h in (1, 4, 13)).strip())
def e20_forward_labels(spark, sf_dir):
    from chronopanel.functions.scalars import return_class

    rows = fx.bars(spark, sf_dir).select("entity_id", "d", *[op.forward("c", h).alias(str(h)) for h in (1, 4, 13)]).unpivot(["entity_id", "d"], ["1", "4", "13"], "horizon", "r").withColumn("horizon", F.col("horizon").cast("int"))
    return rows.where("r is not null").withColumn("label", return_class(F.col("r"), 0.02, 0.06))


@query("SELECT entity_id, d, (rank() OVER (PARTITION BY d ORDER BY c) - 1)::DOUBLE / count(*) OVER (PARTITION BY d) AS share_below FROM bars")
def e22_share_below(spark, sf_dir):
    return op.share_below(fx.bars(spark, sf_dir), "c", ("d",)).select("entity_id", "d", "share_below")


@query("SELECT entity_id, from_d, to_d FROM exclusions")
def e23_intervals(spark, sf_dir):
    return op.intervals(fx.bars(spark, sf_dir), F.col("c") < 1_000_000)


_TERCILE = f"""
q AS (SELECT entity_id, d, c, rn, quantile_cont(c, 1.0/3) OVER w AS q1, quantile_cont(c, 2.0/3) OVER w AS q2, count(c) OVER w AS n FROM nbars WINDOW w AS {_T(26)}),
lab AS (SELECT entity_id, d, CASE WHEN n < 26 THEN 'undefined' WHEN c <= q1 THEN 'low' WHEN c <= q2 THEN 'mid' ELSE 'high' END AS label FROM q)"""


@query(_TERCILE + " SELECT * FROM lab")
def e26_tercile_labels(spark, sf_dir):
    return op.tercile_labels(fx.bars(spark, sf_dir), "c", 26).select("entity_id", "d", "label")


@query(_TERCILE + f""",
t AS (SELECT *, row_number() OVER ({_E}) - row_number() OVER (PARTITION BY entity_id, label ORDER BY d) AS g FROM lab)
SELECT entity_id, label, min(d) AS start, max(d) AS "end", count(*) AS length FROM t WHERE label <> 'undefined' GROUP BY entity_id, label, g""")
def e24_episodes(spark, sf_dir):
    labels = op.tercile_labels(fx.bars(spark, sf_dir), "c", 26)
    return op.islands(labels, "label").where("label <> 'undefined'").select("entity_id", "label", "start", "end", "length")


@query(f"""
m AS (SELECT d, median(c) AS v FROM bars GROUP BY d),
s AS (SELECT entity_id, d, c, lead(c, 4) OVER ({_E}) AS f, count(c) OVER t AS n, median(c) OVER t AS q FROM bars WINDOW t AS {_T(12)})
SELECT entity_id, d, sign(c - q)::INTEGER AS side, f / c - 1 AS edge FROM s WHERE n = 12 AND f IS NOT NULL""")
def e28_edge_records(spark, sf_dir):
    frame = op.trailing(12)
    rows = fx.bars(spark, sf_dir).withColumns({"q": F.percentile("c", F.lit(0.5)).over(frame), "n": F.count("c").over(frame), "edge": op.forward("c", 4)})
    return rows.where("n = 12 and edge is not null").select("entity_id", "d", F.signum(F.col("c") - F.col("q")).cast("int").alias("side"), "edge")


@query("m AS (SELECT d, sum(c) AS v FROM bars GROUP BY d) SELECT d, v, v / lag(v) OVER (ORDER BY d) - 1 AS r FROM m")
def e29_level_to_return(spark, sf_dir):
    series = fx.bars(spark, sf_dir).groupBy("d").agg(F.sum("c").alias("v")).withColumn("one", F.lit(1))
    return series.select("d", "v", op.change("v", entity="one").alias("r"))


@query(f"""
x AS (SELECT entity_id, d, c, lag(c) OVER w AS p, lead(c) OVER w AS n FROM bars WINDOW w AS ({_E}))
SELECT entity_id, d, c FROM x WHERE p IS NOT NULL AND n IS NOT NULL AND c > 3 * greatest(p, n, 50) AND n * 3 < c""")
def e30_spikes(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    edge = F.lag("c").over(op.over()).isNotNull()
    return op.spikes(rows.withColumn("inner", edge), "c", 3, 50).where("inner").select("entity_id", "d", "c")


@query(f"""
a AS (SELECT entity_id, d, CASE WHEN count(c) OVER t = 20 THEN 4 * sum(c) OVER s - sum(c) OVER t END::BIGINT AS gap FROM bars WINDOW s AS {_T(5)}, t AS {_T(20)}),
u AS (SELECT entity_id, d, gap, lag(gap) OVER ({_E}) AS was FROM a),
e AS (SELECT entity_id, d, CASE WHEN gap > 0 AND was <= 0 THEN 'golden' WHEN gap <= 0 AND was > 0 THEN 'death' END AS event,
  CASE WHEN sign(gap) = sign(was) AND abs(gap) < abs(was) THEN ceil(abs(gap)::DOUBLE / (abs(was) - abs(gap)))::BIGINT END AS bars_to_cross FROM u)
SELECT * FROM e WHERE event IS NOT NULL OR bars_to_cross <= 10""")
def e32_crosses(spark, sf_dir):
    return op.crosses(fx.bars(spark, sf_dir), "c", 5, 20, ahead=10).select("entity_id", "d", "event", "bars_to_cross")


@query(f"""
x AS (SELECT entity_id, d, c, vol, count(vol) OVER w AS n, sum(vol) OVER w AS sv, max(h) OVER w AS mh, min(l) OVER w AS ml FROM bars WINDOW w AS ({_E} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT entity_id, d, CASE WHEN c > mh THEN 'up' ELSE 'down' END AS side FROM x WHERE n = 10 AND vol * 10 > 1.2 * sv AND (c > mh OR c < ml)""")
def e33_breakouts(spark, sf_dir):
    return op.breakouts(fx.bars(spark, sf_dir), "h", "l", "c", "vol", 10, 1.2).select("entity_id", "d", "side")


@query(f"""
m AS (SELECT entity_id, d, c / lag(c, 11) OVER ({_E}) - 1 AS r FROM bars),
k AS (SELECT entity_id, d, r, CASE WHEN r > 0 THEN 'long' ELSE 'short' END AS side, row_number() OVER (PARTITION BY d, r > 0 ORDER BY abs(r) DESC, entity_id) AS place FROM m
  WHERE r <> 0 AND CAST(floor(date_diff('day', DATE '1990-01-01', d) / 7) AS BIGINT) % 4 = 0)
SELECT * FROM k WHERE place <= 5""")
def e34_momentum_rank(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", op.change("c", 11).alias("r")).where(F.col("r").isNotNull() & (F.col("r") != 0) & (fx.week_number() % 4 == 0))
    place = F.row_number().over(W.partitionBy("d", F.col("r") > 0).orderBy(F.desc(F.abs("r")), "entity_id"))
    return rows.select("entity_id", "d", "r", F.when(F.col("r") > 0, "long").otherwise("short").alias("side"), place.cast("long").alias("place")).where("place <= 5")


@query(f"""
m AS (SELECT entity_id, d, c - lag(c) OVER ({_E}) AS m FROM bars),
g AS (SELECT entity_id, d, count(m) OVER w AS n, sum(greatest(m, 0)) OVER w AS gain, sum(greatest(-m, 0)) OVER w AS loss FROM m WINDOW w AS {_T(14)}),
r AS (SELECT entity_id, d, CASE WHEN gain = 0 AND loss = 0 THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 * gain / (gain + loss) END AS rsi FROM g WHERE n = 14)
SELECT entity_id, d, rsi, CASE WHEN rsi < 40 THEN 'oversold' ELSE 'overbought' END AS side, row_number() OVER (PARTITION BY d ORDER BY rsi, entity_id) AS place FROM r WHERE rsi < 40 OR rsi > 60""")
def e35_oversold(spark, sf_dir):
    rows = op.rsi_simple(fx.bars(spark, sf_dir), "c").where("rsi < 40 or rsi > 60")
    place = F.row_number().over(W.partitionBy("d").orderBy("rsi", "entity_id")).cast("long")
    return rows.select("entity_id", "d", "rsi", F.when(F.col("rsi") < 40, "oversold").otherwise("overbought").alias("side"), place.alias("place"))


@query(f"""
w AS (SELECT entity_id, d, CASE WHEN count(c) OVER w = 20 THEN max(h) OVER w - min(l) OVER w END AS width, sum(c) OVER w AS s FROM bars WINDOW w AS {_T(20)})
SELECT entity_id, d FROM (SELECT entity_id, d, width, s, min(width * 20 < 1.2 * s) OVER (PARTITION BY entity_id ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x,
  max(CASE WHEN width * 20 < 1.3 * s THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS tight FROM w) WHERE tight = 1 AND width * 20 > 1.5 * s""")
def e36_squeeze(spark, sf_dir):
    frame = op.trailing(20)
    rows = fx.bars(spark, sf_dir).withColumns({"width": op.full("c", frame, 20, F.max("h").over(frame) - F.min("l").over(frame)), "s": F.sum("c").over(frame)})
    tight = F.max(F.when(F.col("width") * 20 < 1.3 * F.col("s"), 1).otherwise(0)).over(op.prior(10))
    return rows.withColumn("tight", tight).where("tight = 1 and width * 20 > 1.5D * s").select("entity_id", "d")


@query(f"""
m AS (SELECT entity_id, d, c / lag(c, 4) OVER ({_E}) - 1 AS r FROM bars),
k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY r DESC, entity_id) AS hi, row_number() OVER (PARTITION BY d ORDER BY r, entity_id) AS lo, count(*) OVER (PARTITION BY d) AS n FROM m WHERE r IS NOT NULL)
SELECT entity_id, d, CASE WHEN hi <= greatest(1, floor(n * 0.1)) THEN 'long' ELSE 'short' END AS side FROM k WHERE hi <= greatest(1, floor(n * 0.1)) OR lo <= greatest(1, floor(n * 0.1))""")
def e39_decile_sides(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", op.change("c", 4).alias("r"))
    return op.extremes_each_side(rows, "r", "entity_id", "d", 0.1).select("entity_id", "d", "side")


@query("""
p AS (SELECT 'threshold' AS rule, entity_id, d, q50, q50 AS first, 0 AS second FROM predictions WHERE q50 > 50 AND q10 > -400
  UNION ALL SELECT 'rank', entity_id, d, q50, q50, 0 FROM predictions WHERE q50 > 0 AND q10 > -400
  UNION ALL SELECT 'pure_rank', entity_id, d, q50, q50, 0 FROM predictions
  UNION ALL SELECT 'class', entity_id, d, q50, cls, q50 FROM predictions WHERE cls >= 3)
SELECT rule, entity_id, d, q50, row_number() OVER (PARTITION BY rule, d ORDER BY first DESC, second DESC, entity_id) AS place FROM p QUALIFY place <= 10""")
def e40_prediction_rank(spark, sf_dir):
    q50, floor, none = F.col("q50"), F.col("q10") > -400, F.lit(0).cast("long")
    rule = lambda name, holds, first, second: F.when(holds, F.struct(F.lit(name).alias("rule"), first.cast("long").alias("first"), second.alias("second")))
    rules = F.array_compact(F.array(rule("threshold", (q50 > 50) & floor, q50, none), rule("rank", (q50 > 0) & floor, q50, none), rule("pure_rank", q50.isNotNull(), q50, none), rule("class", F.col("cls") >= 3, F.col("cls"), q50)))
    rows = fx.predictions(spark, sf_dir).select("entity_id", "d", "q50", F.inline(rules))
    place = F.row_number().over(W.partitionBy("rule", "d").orderBy(F.desc("first"), F.desc("second"), "entity_id")).cast("long")
    return rows.select("rule", "entity_id", "d", "q50", place.alias("place")).where("place <= 10")


@query(f"""
x AS (SELECT entity_id, d, h, l, count(*) OVER w AS n, max(h) OVER w AS mh, min(l) OVER w AS ml, vol * count(*) OVER e > 2 * sum(vol) OVER e AS volume_spike,
  coalesce(100 * abs(c - lag(c) OVER ({_E})) > 3 * lag(c) OVER ({_E}), false) AS big_move FROM bars
  WINDOW w AS ({_E} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), e AS (PARTITION BY entity_id)),
y AS (SELECT entity_id, d, n = 11 AND h = mh AS swing_high, n = 11 AND l = ml AS swing_low, volume_spike, big_move FROM x)
SELECT * FROM y WHERE swing_high OR swing_low OR volume_spike OR big_move""")
def e41_swing_points(spark, sf_dir):
    return op.notable_bars(fx.bars(spark, sf_dir), "h", "l", "c", "vol").select("entity_id", "d", "swing_high", "swing_low", "volume_spike", "big_move")


@query("""
r AS (SELECT entity_id, min(l) AS lo, max(h) AS hi, arg_max(c, d) AS last_c FROM bars GROUP BY 1),
b AS (SELECT entity_id, least(19, floor(20 * (c - lo) / nullif(hi - lo, 0)))::BIGINT AS bucket, lo, hi, last_c, count(*) AS n FROM bars JOIN r USING (entity_id) GROUP BY ALL),
k AS (SELECT *, 40 * lo + (2 * bucket + 1) * (hi - lo) > 40 * last_c AS above FROM (SELECT *, sum(n) OVER (PARTITION BY entity_id) AS total FROM b) WHERE n * 20 > 1.5 * total)
SELECT entity_id, bucket, n, above, bucket = CASE WHEN above THEN min(bucket) OVER w ELSE max(bucket) OVER w END AS nearest FROM k WINDOW w AS (PARTITION BY entity_id, above)""")
def e42_price_levels(spark, sf_dir):
    part = W.partitionBy("entity_id")
    ends = fx.bars(spark, sf_dir).groupBy("entity_id").agg(F.min("l").alias("lo"), F.max("h").alias("hi"), F.max_by("c", "d").alias("last_c"))
    rows = fx.bars(spark, sf_dir).join(ends, "entity_id")
    bucket = F.least(F.lit(19), F.floor(20 * (F.col("c") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))).cast("long")
    counts = rows.groupBy("entity_id", bucket.alias("bucket"), "lo", "hi", "last_c").agg(F.count(F.lit(1)).alias("n"))
    above = 40 * F.col("lo") + (2 * F.col("bucket") + 1) * (F.col("hi") - F.col("lo")) > 40 * F.col("last_c")
    levels = counts.withColumn("total", F.sum("n").over(part)).where("n * 20 > 1.5D * total").withColumn("above", above)
    side = W.partitionBy("entity_id", "above")
    nearest = F.col("bucket") == F.when(F.col("above"), F.min("bucket").over(side)).otherwise(F.max("bucket").over(side))
    return levels.select("entity_id", "bucket", "n", "above", nearest.alias("nearest"))


@query("""
x AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d DESC) AS back FROM bars QUALIFY back <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY h DESC, back) AS kh, row_number() OVER (PARTITION BY entity_id ORDER BY l, back) AS kl FROM x),
p AS (SELECT entity_id, max(h) FILTER (WHERE kh = 1) AS h1, max(h) FILTER (WHERE kh = 2) AS h2, min(back) FILTER (WHERE kh <= 2) AS ha, max(back) FILTER (WHERE kh <= 2) AS hb,
  min(l) FILTER (WHERE kl = 1) AS l1, min(l) FILTER (WHERE kl = 2) AS l2, min(back) FILTER (WHERE kl <= 2) AS la, max(back) FILTER (WHERE kl <= 2) AS lb,
  max(c) FILTER (WHERE back = 1) AS last_c, 2000 * (max(h) - min(l)) < 8 * sum(c) FILTER (WHERE back <= 20) AS consolidation FROM r GROUP BY 1 HAVING count(*) = 30),
b AS (SELECT p.entity_id, min(l) FILTER (WHERE back BETWEEN ha AND hb) AS valley, max(h) FILTER (WHERE back BETWEEN la AND lb) AS peak FROM p JOIN x USING (entity_id) GROUP BY 1)
SELECT entity_id, hb - ha >= 5 AND 100 * (h1 - h2) < 2 * h1 AND 100 * (h1 - valley) > 3 * h1 AND 100 * (last_c - h1) < -2 * h1 AS double_top,
  lb - la >= 5 AND 100 * (l2 - l1) < 2 * l1 AND 100 * (peak - l1) > 3 * l1 AND 100 * (last_c - l1) > 2 * l1 AS double_bottom, consolidation FROM p JOIN b USING (entity_id)""")
def e43_double_top(spark, sf_dir):
    return op.price_patterns(fx.bars(spark, sf_dir), "h", "l", "c", 30, 20)


@query("""
x AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d DESC) AS back, CAST(floor(10000 * (c / lag(c) OVER (PARTITION BY entity_id ORDER BY d) - 1)) AS BIGINT) AS r FROM bars),
s AS (SELECT entity_id, max(d) AS last_d, arg_max(c, d) AS last_c, max(CASE WHEN back = 6 THEN c END) AS c_5, max(h) FILTER (WHERE back <= 52) AS high_52, min(l) FILTER (WHERE back <= 52) AS low_52,
  sum(vol) FILTER (WHERE back <= 10)::BIGINT AS vol_recent, sum(vol) FILTER (WHERE back BETWEEN 11 AND 20)::BIGINT AS vol_before, arg_max(c, d) > avg(c) FILTER (WHERE back <= 20) AS above_ma,
  count(r) FILTER (WHERE back <= 20) AS n, sum(r) FILTER (WHERE back <= 20) AS s, sum(r * r) FILTER (WHERE back <= 20) AS ss FROM x GROUP BY 1)
SELECT * EXCLUDE (n, s, ss), sqrt((n * ss - s * s)::DOUBLE / nullif(n * (n - 1), 0)) AS volatility FROM s""")
def e44_price_summary(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).withColumns({"back": F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("d"))), "r": F.floor(10000 * op.change("c")).cast("long")})
    upto = lambda n, c: F.when(F.col("back") <= n, F.col(c))
    r = upto(20, "r")
    n, s, ss = F.count(r), F.sum(r), F.sum(r * r)
    return rows.groupBy("entity_id").agg(
        F.max("d").alias("last_d"), F.max_by("c", "d").alias("last_c"), F.max(F.when(F.col("back") == 6, F.col("c"))).alias("c_5"), F.max(upto(52, "h")).alias("high_52"), F.min(upto(52, "l")).alias("low_52"),
        F.sum(upto(10, "vol")).alias("vol_recent"), F.sum(F.when(F.col("back").between(11, 20), F.col("vol"))).alias("vol_before"), (F.max_by("c", "d") > F.avg(upto(20, "c"))).alias("above_ma"),
        F.sqrt((n * ss - s * s).cast("double") / F.nullif(n * (n - 1), F.lit(0))).alias("volatility"),
    )


@query("""
b AS (SELECT min(d) AS lo, max(d) AS hi FROM bars),
s AS (SELECT k::BIGINT AS k, lo + CAST(91 * k AS INTEGER) AS train_start, hi FROM b, range(0, 100) t(k)),
w AS (SELECT k, train_start, train_start + 364 AS train_end, train_start + 365 AS test_start, train_start + 455 AS test_end FROM s WHERE train_start + 455 <= hi)
SELECT k, train_start, train_end, test_start, test_end, count(*) FILTER (WHERE d BETWEEN train_start AND train_end) AS n_train, count(*) FILTER (WHERE d BETWEEN test_start AND test_end) AS n_test
FROM w JOIN bars ON d BETWEEN train_start AND test_end GROUP BY ALL""")
def e45_walk_forward(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    ends = rows.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    w = ends.select("hi", F.posexplode(F.expr("sequence(lo, hi, interval 91 days)")).alias("k", "train_start")).where("date_add(train_start, 455) <= hi")
    w = w.select(F.col("k").cast("long"), "train_start", *[F.date_add("train_start", n).alias(c) for c, n in (("train_end", 364), ("test_start", 365), ("test_end", 455))])
    days = rows.groupBy("d").count()  # one row a date before the range join
    joined = days.join(w, (F.col("d") >= F.col("train_start")) & (F.col("d") <= F.col("test_end")))
    count = lambda a, b: F.sum(F.when(F.col("d").between(F.col(a), F.col(b)), F.col("count")).otherwise(0))
    return joined.groupBy(*w.columns).agg(count("train_start", "train_end").alias("n_train"), count("test_start", "test_end").alias("n_test"))


@query("""
t AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM bars)),
f AS (SELECT k::BIGINT AS fold FROM range(0, 5) x(k)),
a AS (SELECT d, fold, i, fold * n // 5 AS lo, (fold + 1) * n // 5 - 1 AS hi FROM t, f)
SELECT d, fold, CASE WHEN i BETWEEN lo AND hi THEN 'test' WHEN i BETWEEN lo - 4 AND lo - 1 THEN 'purged' WHEN i BETWEEN lo - 6 AND lo - 5 OR i BETWEEN hi + 1 AND hi + 2 THEN 'embargo' ELSE 'train' END AS role FROM a""")
def e46_purged_folds(spark, sf_dir):
    days = fx.bars(spark, sf_dir).select("d").distinct().withColumn("one", F.lit(1))
    w = W.partitionBy("one")
    rows = days.withColumns({"i": F.row_number().over(w.orderBy("d")) - 1, "n": F.count(F.lit(1)).over(w)}).select("d", "i", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("fold"))
    lo, hi, i = F.expr("fold * n div 5"), F.expr("(fold + 1) * n div 5 - 1"), F.col("i")
    near = i.between(lo - 6, lo - 5) | i.between(hi + 1, hi + 2)
    role = F.when(i.between(lo, hi), "test").when(i.between(lo - 4, lo - 1), "purged").when(near, "embargo").otherwise("train")
    return rows.select("d", "fold", role.alias("role"))


@query(f"""
m AS (SELECT max(d) AS hi FROM bars),
x AS (SELECT entity_id, d, lead(d, 4) OVER ({_E}) AS until, hi, CASE WHEN d < hi - 364 THEN 'train' WHEN d < hi - 91 THEN 'holdout' ELSE 'reserve' END AS part FROM bars, m)
SELECT entity_id, d, part, coalesce(part = 'train' AND until >= hi - 364 OR part = 'holdout' AND until >= hi - 91, false) AS leaks FROM x""")
def e47_holdout_masks(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    hi = F.broadcast(rows.agg(F.max("d").alias("hi")))  # one row
    rows = rows.withColumn("until", F.lead("d", 4).over(op.over())).join(hi, F.col("d") <= F.col("hi"))
    return op.holdout_parts(rows, F.date_sub("hi", 364), F.date_sub("hi", 91)).select("entity_id", "d", "part", "leaks")


@query(f"""
m AS (SELECT max(d) AS hi FROM bars),
x AS (SELECT entity_id, d, lead(d, 4) OVER ({_E}) AS until, hi, CASE WHEN d < hi - 364 THEN 'train' WHEN d < hi - 91 THEN 'holdout' ELSE 'reserve' END AS part FROM bars, m)
SELECT part, count(*) AS n, max(d) AS last_d FROM x WHERE NOT coalesce(part = 'train' AND until >= hi - 364 OR part = 'holdout' AND until >= hi - 91, false) GROUP BY 1""")
def e47_segregated(spark, sf_dir):
    """Parts without the rows that reach into the next one; a second look refuses nothing."""
    clean = op.segregated(e47_holdout_masks(spark, sf_dir), purge=True)
    return op.segregated(clean.withColumn("leaks", F.lit(False))).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last_d"))


@query(f"""
s AS (SELECT entity_id FROM dims WHERE sector = 'ASIA')
SELECT entity_id, d, c / lag(c) OVER ({_E}) - 1 AS r FROM bars SEMI JOIN s USING (entity_id) WHERE d <= DATE '1999-12-31'""")
def e49_return_panel(spark, sf_dir):
    members = fx.dims(spark, sf_dir).where("sector = 'ASIA'").select("entity_id")
    rows = fx.bars(spark, sf_dir).where("d <= date'1999-12-31'").join(members, "entity_id", "left_semi")
    return rows.select("entity_id", "d", op.change("c").alias("r"))


@query(f"""
x AS (SELECT entity_id, d, c, vol, sum(c) OVER w AS s, sum(c * c) OVER w AS ss, count(c) OVER w AS n, lag(c) OVER (PARTITION BY entity_id ORDER BY d) AS p FROM bars WINDOW w AS {_T(10)}),
y AS (SELECT *, sqrt((10 * ss - s * s)::DOUBLE / 90) AS std FROM x)
SELECT entity_id, d, CASE WHEN n = 10 THEN s / 10 END AS mean_10, CASE WHEN n = 10 THEN std END AS std_10, CASE WHEN n = 10 THEN (c - s / 10) / nullif(std, 0) END AS z_10, c - p AS momentum,
  c / p - 1 AS simple_return, round(ln(c / p), 9) AS log_return FROM y""")
def e52_column_features(spark, sf_dir):
    frame = op.trailing(10)
    rows = fx.bars(spark, sf_dir).withColumns({"mean_10": op.mean("c", frame, 10), "std_10": F.sqrt(op.variance("c", frame, 10, True)), "p": F.lag("c").over(op.over())})
    return rows.select(
        "entity_id", "d", "mean_10", "std_10", ((F.col("c") - F.col("mean_10")) / F.nullif("std_10", F.lit(0))).alias("z_10"), (F.col("c") - F.col("p")).alias("momentum"),
        op.change("c").alias("simple_return"), F.round(F.log(F.col("c") / F.col("p")), 9).alias("log_return"),
    )


@query(f"""
t AS (SELECT entity_id, d, c, vol, CASE WHEN n = 14 THEN CASE WHEN gain = 0 AND loss = 0 THEN 50.0::DOUBLE WHEN loss = 0 THEN 100.0::DOUBLE ELSE 100 * gain / (gain + loss) END END AS rsi FROM (
  SELECT entity_id, d, c, vol, count(m) OVER w AS n, sum(greatest(m, 0)) OVER w AS gain, sum(greatest(-m, 0)) OVER w AS loss
  FROM (SELECT *, c - lag(c) OVER ({_E}) AS m FROM bars) WINDOW w AS {_T(14)})),
x AS (SELECT *, c < lag(c) OVER w AND c < lead(c) OVER w AS ct, c > lag(c) OVER w AND c > lead(c) OVER w AS cp,
  rsi < lag(rsi) OVER w AND rsi < lead(rsi) OVER w AS rt, rsi > lag(rsi) OVER w AND rsi > lead(rsi) OVER w AS rp FROM t WHERE rsi IS NOT NULL WINDOW w AS ({_E})),
k AS (SELECT entity_id, d, count(*) OVER w AS n, list(c) FILTER (WHERE ct) OVER w AS lows, list(c) FILTER (WHERE cp) OVER w AS highs, list(rsi) FILTER (WHERE rt) OVER w AS rlows, list(rsi) FILTER (WHERE rp) OVER w AS rhighs
  FROM x WINDOW w AS ({_E} ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
s AS (SELECT entity_id, d, CASE WHEN lows[-1] < lows[-2] AND rlows[-1] > rlows[-2] THEN 'bullish' WHEN highs[-1] > highs[-2] AND rhighs[-1] < rhighs[-2] THEN 'bearish' END AS signal FROM k WHERE n = 26)
SELECT * FROM s WHERE signal IS NOT NULL""")
def e37_divergence(spark, sf_dir):
    rows = op.rsi_simple(fx.bars(spark, sf_dir), "c").where("rsi is not null")
    return op.divergence(rows, "c", "rsi", 28).select("entity_id", "d", "signal")
