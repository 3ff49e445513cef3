"""Queries of scalar functions, limits, set operations, table jobs, registries and tests (sections B, F, G, H, I, K, L)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions import scalars as fn
from chronopanel.operators import aggregates as agg
from chronopanel.operators import discovery as dis
from chronopanel.operators import stats as sta
from chronopanel.operators import tables as tab
from chronopanel.operators import windows as win
from chronopanel.sources import fixtures as fx
from chronopanel.sources import ingest as ing
from chronopanel.sources.staging import shared_path as scratch
from chronopanel.sources.staging import staged

from .aggregates import scored
from .joins import _LONG, long_features
from .registry import query

_E = "PARTITION BY entity_id ORDER BY d"


@query("x AS (SELECT entity_id, d, CASE WHEN entity_id % 3 = 0 THEN 'n/a' WHEN entity_id % 3 = 1 THEN CAST(c AS VARCHAR) ELSE CAST(c AS VARCHAR) || '000000000' END AS t FROM bars) SELECT entity_id, d, CASE WHEN abs(TRY_CAST(t AS DOUBLE)) < 1e12 THEN TRY_CAST(t AS DOUBLE) END AS x FROM x")
def b01_sane_number(spark, sf_dir):
    c = F.col("c").cast("string")
    text = F.when(F.col("entity_id") % 3 == 0, "n/a").when(F.col("entity_id") % 3 == 1, c).otherwise(F.concat(c, F.lit("000000000")))
    return fx.bars(spark, sf_dir).select("entity_id", "d", fn.sane_number(text).alias("x"))


@query("x AS (SELECT entity_id, CASE WHEN vol % 7 = 0 THEN 'soon' ELSE CAST(d AS VARCHAR) END AS t, CASE WHEN vol % 5 > 0 THEN o END AS o, CASE WHEN vol % 3 > 0 THEN c END AS c FROM bars) SELECT entity_id, CAST(t AS DATE) AS d, o, c FROM x WHERE TRY_CAST(t AS DATE) IS NOT NULL AND coalesce(o, c) IS NOT NULL")
def b02_date_coercion(spark, sf_dir):
    text = F.when(F.col("vol") % 7 == 0, "soon").otherwise(F.col("d").cast("string"))
    rows = fx.bars(spark, sf_dir).select("entity_id", F.try_to_date(text).alias("d"), F.when(F.col("vol") % 5 > 0, F.col("o")).alias("o"), F.when(F.col("vol") % 3 > 0, F.col("c")).alias("c"))
    return rows.where("d is not null and coalesce(o, c) is not null")


@query("m AS (SELECT entity_id, max(d) AS latest FROM bars WHERE vol % 11 = 0 GROUP BY 1) SELECT entity_id, d, c FROM bars LEFT JOIN m USING (entity_id) WHERE latest IS NULL OR d > latest")
def b03_new_rows(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", "c", "vol")
    return tab.newer_than_stored(rows, rows.where("vol % 11 = 0"), ["entity_id"], "d").drop("vol")


@query("n AS (SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN ' none ' WHEN 1 THEN 'Capital Markets' WHEN 2 THEN '-' ELSE lower(sector) END AS t FROM dims) SELECT entity_id, CASE WHEN upper(trim(t)) IN ('NONE', 'OTHER', 'N/A', '-', '') THEN NULL WHEN upper(trim(t)) IN ('FINANCIALS', 'CAPITAL MARKETS') THEN 'FINANCIAL SERVICES' ELSE upper(trim(t)) END AS name FROM n")
def b04_class_name(spark, sf_dir):
    k = F.col("entity_id") % 4
    return fx.dims(spark, sf_dir).select("entity_id", fn.class_name(F.when(k == 0, " none ").when(k == 1, "Capital Markets").when(k == 2, "-").otherwise(F.lower("sector"))).alias("name"))


@query("s AS (SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part) SELECT slug, count(*) AS n, count(*) > 1 AS clash FROM s GROUP BY slug")
def b05_slug(spark, sf_dir):
    names = fx.table(spark, sf_dir, "part").select("p_type").distinct()
    return names.groupBy(fn.slug(F.col("p_type")).alias("slug")).agg(F.count(F.lit(1)).alias("n")).withColumn("clash", F.col("n") > 1)


@query("s AS (SELECT entity_id, CASE WHEN entity_id % 5 = 0 THEN 'ZAZZT' ELSE symbol END AS symbol FROM dims) SELECT count(*) FILTER (WHERE NOT regexp_matches(symbol, '^Z[A-Z]ZZT$')) AS kept, count(*) FILTER (WHERE regexp_matches(symbol, '^Z[A-Z]ZZT$')) AS excluded FROM s")
def b06_test_entities(spark, sf_dir):
    rows = fx.dims(spark, sf_dir).select(F.when(F.col("entity_id") % 5 == 0, "ZAZZT").otherwise(F.col("symbol")).alias("symbol"))
    test = F.col("symbol").rlike("^Z[A-Z]ZZT$")
    return rows.agg(F.count_if(~test).alias("kept"), F.count_if(test).alias("excluded"))


@query("SELECT entity_id, symbol FROM dims WHERE sector IN ('ASIA', 'EUROPE') AND ('0x' || substr(sha256(symbol), 1, 2))::INTEGER % 2 = 0")
def b07_filter_chain(spark, sf_dir):
    chain = [lambda df: df.where(F.col("sector").isin("ASIA", "EUROPE")), lambda df: df.where(fn.half(F.col("symbol")) == "a")]
    out = fx.dims(spark, sf_dir)
    for step in chain:
        out = out.transform(step)
    return out.select("entity_id", "symbol")


@query("SELECT c_custkey, CASE WHEN ('0x' || substr(sha256(c_name), 1, 2))::INTEGER % 2 = 0 THEN 'a' ELSE 'b' END AS half FROM customer")
def b08_half_split(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select("c_custkey", fn.half(F.col("c_name")).alias("half"))


@query("k AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_name || '7'), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, c_custkey FROM k WHERE 10 * k <= 3 * n")
def b09_stratified_sample(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").withColumn("key", F.sha2(F.concat("c_name", F.lit("7")), 256))
    return tab.lowest_share(rows, ["c_mktsegment"], "key", ["c_custkey"], 3, 10).select("c_mktsegment", "c_custkey")


def prediction_json(spark, sf_dir):
    """Predictions as JSON values."""
    return fx.predictions(spark, sf_dir).select("entity_id", "d", F.to_json(F.struct("q10", "q50", "q90", "cls")).alias("value"))


@query("SELECT entity_id, d, q10, q50, q90 FROM predictions WHERE cls = 2")
def b10_json_projection(spark, sf_dir):
    rows = prediction_json(spark, sf_dir).withColumn("v", F.from_json("value", "q10 long, q50 long, q90 long, cls int"))
    return rows.where("v.cls = 2").select("entity_id", "d", "v.q10", "v.q50", "v.q90")


@query("""SELECT entity_id, d, '{"q10":' || q10 || ',"q50":' || q50 || ',"q90":' || q90 || ',"cls":' || cls || '}' AS value FROM predictions""")
def b11_json_writer(spark, sf_dir):
    return prediction_json(spark, sf_dir)


@query("SELECT entity_id, d, CASE WHEN c > 0 THEN o * (c - vol) / c ELSE o END AS o, c - vol AS c FROM bars")
def b12_adjusted_ohlc(spark, sf_dir):
    adj = F.col("c") - F.col("vol")
    return fx.bars(spark, sf_dir).select("entity_id", "d", fn.adjusted(F.col("o"), F.col("c"), adj).alias("o"), adj.alias("c"))


@query("SELECT entity_id, d, (h - l) / nullif(vol - 20, 0) + (-o) * 2 AS x FROM bars")
def b13_restricted_expression(spark, sf_dir):
    return fx.bars(spark, sf_dir).select("entity_id", "d", fn.restricted("(h - l) / (vol - 20) + (-o) * 2", ("h", "l", "o", "vol")).alias("x"))


@query("SELECT entity_id, d, CASE WHEN y < -600 THEN 'strong_down' WHEN y < -200 THEN 'weak_down' WHEN y <= 200 THEN 'neutral' WHEN y <= 600 THEN 'weak_up' ELSE 'strong_up' END AS label FROM outcomes")
def b14_return_class(spark, sf_dir):
    return fx.outcomes(spark, sf_dir).select("entity_id", "d", fn.return_class(F.col("y"), 200, 600).alias("label"))


@query("q AS (SELECT quantile_disc(y, 0.05) AS lo, quantile_disc(y, 0.95) AS hi FROM outcomes) SELECT entity_id, d, greatest(lo, least(hi, y)) AS winsorised, greatest(-1000, least(1000, y)) AS clipped, sign(y)::DOUBLE * sqrt(abs(y)::DOUBLE) AS signed_root, (rank() OVER (ORDER BY y) + rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1)::DOUBLE / (2 * count(*) OVER ()) - 0.5 AS centred_rank FROM outcomes, q")
def b15_label_transforms(spark, sf_dir):
    rows = fx.outcomes(spark, sf_dir)
    before = tab.running_total(rows.groupBy("y").agg(F.count(F.lit(1)).alias("ties")), "y", "ties", "upto", "n")  # ranks over values, not rows
    ends = F.broadcast(before.agg(*[F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("y"))).alias(c) for c, q in (("lo", 0.05), ("hi", 0.95))]))  # one row
    place = (2 * (F.col("upto") - F.col("ties") + 1) + F.col("ties") - 1) / (2 * F.col("n")) - 0.5
    y = F.col("y")
    return rows.join(before, "y").join(ends, F.lit(True)).select("entity_id", "d", F.greatest("lo", F.least("hi", y)).alias("winsorised"), F.greatest(F.lit(-1000), F.least(F.lit(1000), y)).alias("clipped"), (F.signum(y.cast("double")) * F.sqrt(F.abs(y).cast("double"))).alias("signed_root"), place.alias("centred_rank"))


@query("SELECT entity_id, d, 0.5::DOUBLE * (vol / 100.0::DOUBLE * sqrt(21 / 252.0::DOUBLE) * s) AS weak, 1.5::DOUBLE * (vol / 100.0::DOUBLE * sqrt(21 / 252.0::DOUBLE) * s) AS strong FROM (SELECT *, CASE WHEN vol % 100 > 90 THEN 1.2::DOUBLE WHEN vol % 100 < 10 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS s FROM bars)")
def b16_adaptive_thresholds(spark, sf_dir):
    weak, strong = fn.adaptive_thresholds(F.col("vol") / 100.0, 21, F.col("vol") % 100 / 100.0)
    return fx.bars(spark, sf_dir).select("entity_id", "d", weak.alias("weak"), strong.alias("strong"))


@query("SELECT entity_id, d, round(0.7::DOUBLE * exp(-(q90 - q10) / 350.0::DOUBLE) + 0.3::DOUBLE * least(1.0::DOUBLE, abs(q50) / 350.0::DOUBLE), 9) AS confidence FROM predictions")
def b17_quantile_confidence(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    confidence = fn.quantile_confidence((F.col("q90") - F.col("q10")).cast("double"), F.lit(350.0), F.col("q50").cast("double"))
    return p.select("entity_id", "d", F.round(confidence, 9).alias("confidence"))


@query("""x AS (SELECT entity_id, d, unnest(range(0, 5)) AS k, vol FROM bars), r AS (SELECT entity_id, d, vol % (k + 3) + 1 AS r FROM x),
p AS (SELECT entity_id, d, r::DOUBLE / sum(r) OVER (PARTITION BY entity_id, d) AS p, row_number() OVER (PARTITION BY entity_id, d ORDER BY r DESC) AS place FROM r)
SELECT entity_id, d, round(0.5::DOUBLE * (1 - sum(-p * ln(p)) / ln(5.0::DOUBLE)) + 0.5::DOUBLE * (sum(p) FILTER (WHERE place = 1) - sum(p) FILTER (WHERE place = 2)), 9) + 0.0::DOUBLE AS confidence FROM p GROUP BY 1, 2""")
def b18_class_confidence(spark, sf_dir):
    raw = [F.col("vol") % (k + 3) + 1 for k in range(5)]
    total = sum(raw[1:], raw[0])
    return fx.bars(spark, sf_dir).select("entity_id", "d", (F.round(fn.class_confidence(F.array(*[x / total for x in raw]), 5), 9) + F.lit(0.0)).alias("confidence"))


@query("x AS (SELECT entity_id, d, unnest([q10, q50, q90]) AS v FROM predictions), y AS (SELECT entity_id, d, max(v) - min(v) AS spread, (count(*) * sum(v * v) - sum(v) * sum(v))::DOUBLE / (count(*) * count(*)) AS variance FROM x GROUP BY 1, 2) SELECT *, round(exp(-20 * sqrt(variance) / 10000), 9) AS agreement FROM y")
def b19_disagreement(spark, sf_dir):
    x = fx.predictions(spark, sf_dir).select("entity_id", "d", F.explode(F.array("q10", "q50", "q90")).alias("v"))
    n, s = F.count(F.lit(1)), F.sum("v")
    out = x.groupBy("entity_id", "d").agg((F.max("v") - F.min("v")).alias("spread"), ((n * F.sum(F.col("v") * F.col("v")) - s * s) / (n * n)).alias("variance"))
    return out.withColumn("agreement", F.round(F.exp(-20 * F.sqrt("variance") / 10_000), 9))  # deviations in basis points


@query("SELECT entity_id, d, least(q10 + 160, q50) AS q10, greatest(q50, q90 - 160) AS q90 FROM predictions")
def b20_clamp(spark, sf_dir):
    low, high = fn.clamp_quantiles(F.col("q10") + 160, F.col("q50"), F.col("q90") - 160)
    return fx.predictions(spark, sf_dir).select("entity_id", "d", low.alias("q10"), high.alias("q90"))


@query("""w AS (SELECT * FROM (VALUES (0, 3), (1, 2), (2, 5)) t(k, w)), m AS (SELECT entity_id, d, k, q10 + 300 * k AS q10, q50 + 10 * k AS q50, q90 - 120 * k AS q90 FROM predictions, w),
e AS (SELECT entity_id, d, sum(w * q10)::DOUBLE / sum(w) AS a, sum(w * q50)::DOUBLE / sum(w) AS b, sum(w * q90)::DOUBLE / sum(w) AS c FROM m JOIN w USING (k) GROUP BY 1, 2)
SELECT entity_id, d, least(a, b) AS q10, b AS q50, greatest(b, c) AS q90 FROM e""")
def b21_ensemble(spark, sf_dir):
    """All quantiles of three weighted models, clamped where they cross."""
    weights = spark.createDataFrame([(0, 3), (1, 2), (2, 5)], "k int, w int")
    k = F.col("k")
    models = fx.predictions(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2))))).select("entity_id", "d", "k", (F.col("q10") + 300 * k).alias("q10"), (F.col("q50") + 10 * k).alias("q50"), (F.col("q90") - 120 * k).alias("q90"))
    means = models.join(F.broadcast(weights), "k").groupBy("entity_id", "d").agg(*[(F.sum(F.col("w") * F.col(q)) / F.sum("w")).alias(q) for q in ("q10", "q50", "q90")])
    low, high = fn.clamp_quantiles(F.col("q10"), F.col("q50"), F.col("q90"))
    return means.select("entity_id", "d", low.alias("q10"), "q50", high.alias("q90"))


@query("""x AS (SELECT t.entity_id, t.d, side, shares * price AS value, sqrt(shares::DOUBLE / nullif(vol, 0)) AS part, shares FROM trades t JOIN bars b USING (entity_id, d))
SELECT entity_id, d, least(greatest(100 + 2 * shares, 150), 10000)::BIGINT AS commission, value * 2 / 10000 AS spread, coalesce(part * 0.1::DOUBLE * value, 0) AS impact,
  CASE WHEN side = 'sell' THEN value * (0.03::DOUBLE / 252) ELSE 0 END AS borrow_fee_a_day FROM x""")
def b22_trade_costs(spark, sf_dir):
    rows = fx.trades(spark, sf_dir).join(fx.bars(spark, sf_dir).select("entity_id", "d", "vol"), ["entity_id", "d"])
    cost = fn.trade_cost("shares", "price", "vol", per_trade=100, per_share=2, least=150, most=10_000, spread=2, impact=0.1)
    fee = F.when(F.col("side") == "sell", fn.borrow_fee("shares", "price", 0.03)).otherwise(0.0)
    return rows.select("entity_id", "d", *[c.alias(k) for k, c in cost.items()], fee.alias("borrow_fee_a_day"))


@query("""x AS (SELECT t.entity_id, t.d, side, price, o, 0.0005::DOUBLE + coalesce(sqrt(shares::DOUBLE / nullif(vol, 0)) * 0.01::DOUBLE, 0) + coalesce((h - l) / c * 0.02::DOUBLE, 0) AS slip FROM trades t JOIN bars b USING (entity_id, d))
SELECT entity_id, d, side, CASE WHEN side = 'buy' THEN price * (1 + slip) ELSE price * (1 - slip) END AS fill, CASE WHEN side = 'buy' AND price <= o OR side = 'sell' AND price >= o THEN o END AS limit_fill FROM x""")
def b23_execution_price(spark, sf_dir):
    rows = fx.trades(spark, sf_dir).join(fx.bars(spark, sf_dir).select("entity_id", "d", "o", "h", "l", "c", "vol"), ["entity_id", "d"])
    buy = F.col("side") == "buy"
    fill = fn.fill_price(buy, "price", "shares", "vol", (F.col("h") - F.col("l")) / F.col("c"), fixed=0.0005, participation=0.01, volatility=0.02)
    return rows.select("entity_id", "d", "side", fill.alias("fill"), fn.limit_fill(buy, "price", "o").alias("limit_fill"))


@query("""w AS (SELECT entity_id, count(*) FILTER (WHERE y > 0)::DOUBLE / count(*) AS rate, (sum(y) FILTER (WHERE y > 0)::DOUBLE / count(*) FILTER (WHERE y > 0)) / nullif(sum(-y) FILTER (WHERE y < 0)::DOUBLE / nullif(count(*) FILTER (WHERE y < 0), 0), 0) AS ratio FROM outcomes GROUP BY 1),
x AS (SELECT entity_id, d, c, (rate * ratio - (1 - rate)) / ratio AS kelly, (h - l) / nullif(c, 0) AS vola FROM bars LEFT JOIN w USING (entity_id))
SELECT entity_id, d, 100000000 // c AS fixed_dollar, 5000000000 // (100 * c) AS fixed_percent, coalesce(CASE WHEN kelly > 0 THEN CAST(trunc(1e9::DOUBLE * (kelly * 0.25::DOUBLE) / c) AS BIGINT) END, 0) AS kelly_shares,
  coalesce(CASE WHEN vola > 0 THEN CAST(trunc(1e9::DOUBLE * (0.15::DOUBLE / vola) / c) AS BIGINT) END, 0) AS vol_target, coalesce(CASE WHEN vola > 0 THEN CAST(trunc(1e9::DOUBLE * least(1.0::DOUBLE, 0.1::DOUBLE / vola) / c) AS BIGINT) END, 0) AS risk_parity FROM x""")
def b24_position_size(spark, sf_dir):
    up, down = F.when(F.col("y") > 0, F.col("y")), F.when(F.col("y") < 0, -F.col("y"))
    wins = fx.outcomes(spark, sf_dir).groupBy("entity_id").agg((F.count(up) / F.count("y")).alias("rate"), (F.sum(up) / F.count(up) / F.nullif(F.sum(down) / F.nullif(F.count(down), F.lit(0)), F.lit(0))).alias("ratio"))
    rows = fx.bars(spark, sf_dir).join(wins, "entity_id", "left").withColumn("vola", (F.col("h") - F.col("l")) / F.nullif("c", F.lit(0)))
    sized = fn.position_sizes(1e9, "c", "rate", "ratio", "vola", kelly=0.25, target=0.15, per_asset=0.1)
    return rows.select("entity_id", "d", F.expr("100000000L div c").alias("fixed_dollar"), F.expr("5000000000L div (100 * c)").alias("fixed_percent"), *[c.alias(k) for k, c in sized.items()])


_POS = f"p AS (SELECT entity_id, d, c AS entry, lead(c, 4) OVER ({_E}) AS now, CASE WHEN vol % 2 = 0 THEN 'long' ELSE 'short' END AS side FROM bars)"
_EXIT = "CASE WHEN side = 'long' AND 100 * now <= 90 * entry OR side = 'short' AND 100 * now >= 110 * entry THEN 'stop_loss' WHEN side = 'long' AND 100 * now >= 120 * entry OR side = 'short' AND 100 * now <= 80 * entry THEN 'take_profit' END"


def exits(spark, sf_dir):
    """Positions opened at each bar and what closes them four bars later."""
    p = fx.bars(spark, sf_dir).select("entity_id", "d", F.col("c").alias("entry"), F.lead("c", 4).over(win.over()).alias("now"), F.when(F.col("vol") % 2 == 0, "long").otherwise("short").alias("side")).where("now is not null")
    gain = F.when(F.col("side") == "long", F.col("now") - F.col("entry")).otherwise(F.col("entry") - F.col("now"))
    return p.withColumn("reason", fn.exit_reason(gain, F.col("entry")))


@query(_POS + f""", e AS (SELECT *, row_number() OVER w AS k, sum(entry) OVER (PARTITION BY d) AS total FROM p WINDOW w AS (PARTITION BY d ORDER BY entity_id)),
m AS (SELECT d, sum(c) AS v FROM bars GROUP BY d), q AS (SELECT d, v, max(v) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM m)
SELECT entity_id, d, side, {_EXIT} AS reason, CASE WHEN k > 5 THEN 'max_positions' WHEN 100 * entry > 20 * total THEN 'max_weight' WHEN 100 * (peak - v) > 50 * peak THEN 'drawdown' END AS blocked FROM e JOIN q USING (d) WHERE now IS NOT NULL""")
def b25_exit_flags(spark, sf_dir):
    by_date = W.partitionBy("d")
    rows = fx.bars(spark, sf_dir)
    ranked = rows.select("entity_id", "d", F.row_number().over(by_date.orderBy("entity_id")).alias("k"), F.sum("c").over(by_date).alias("total"))
    market = rows.groupBy("d").agg(F.sum("c").alias("v")).withColumn("one", F.lit(1))  # one row a date
    market = market.withColumn("peak", F.max("v").over(W.partitionBy("one").orderBy("d").rowsBetween(W.unboundedPreceding, 0)))
    out = exits(spark, sf_dir).join(ranked, ["entity_id", "d"]).join(market, "d")
    blocked = fn.block_reason(F.col("k") - 1, F.col("entry"), F.col("total"), F.col("v"), F.col("peak"), positions=5, weight=20, drawdown=50)
    return out.select("entity_id", "d", "side", "reason", blocked.alias("blocked"))


@query(_POS + f", x AS (SELECT entity_id, d, {_EXIT} AS reason FROM p WHERE now IS NOT NULL) SELECT * FROM x WHERE reason IS NOT NULL")
def e51_exits(spark, sf_dir):
    return exits(spark, sf_dir).where("reason is not null").select("entity_id", "d", "reason")


@query("SELECT entity_id, d, q50 FROM predictions WHERE q50 > 100 AND q10 > -300 AND NOT (cls = 0)")
def b26_gate(spark, sf_dir):
    return fx.predictions(spark, sf_dir).where("q50 > 100 and q10 > -300 and cls <> 0").select("entity_id", "d", "q50")


@query("SELECT sector, sha256(string_agg(symbol, ',' ORDER BY symbol)) AS fingerprint, count(*) AS n FROM dims GROUP BY sector")
def b27_fingerprints(spark, sf_dir):
    return tab.list_digest(fx.dims(spark, sf_dir), "sector", "symbol")


@query("""f AS (SELECT t.entity_id, t.d, sha256(concat_ws('|', 'shares=' || (shares % 7), 'side=' || side)) AS fingerprint, t.entity_id * 100000 + date_diff('day', DATE '1990-01-01', t.d) AS id FROM trades t),
g AS (SELECT fingerprint, min(id) AS first_id, count(*) AS copies FROM f GROUP BY 1 HAVING count(*) > 1) SELECT id, fingerprint, first_id, copies FROM f JOIN g USING (fingerprint)""")
def b27_duplicates(spark, sf_dir):
    """Settings that were tried before, found by their fingerprints."""
    rows = fx.trades(spark, sf_dir).select((F.col("entity_id") * 100_000 + F.datediff("d", F.lit("1990-01-01").cast("date"))).alias("id"), "side", (F.col("shares") % 7).alias("shares"))
    return tab.duplicates(rows, "id", ["side", "shares"])


@query("SELECT entity_id, d FROM bars JOIN dims USING (entity_id) WHERE sector <> 'ASIA' AND c BETWEEN 1000000 AND 4000000 AND vol >= 20")
def b28_rule_predicates(spark, sf_dir):
    out = fx.bars(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id")
    for rule in ({"attribute": "sector", "op": "ne", "value": "ASIA"}, {"attribute": "c", "op": "between", "value": (1_000_000, 4_000_000)}, {"attribute": "vol", "op": "gte", "value": 20}):
        out = out.where(fn.rule_predicate(rule))
    return out.select("entity_id", "d")


@query(f"SELECT entity_id, c / lag(c) OVER ({_E}) - 1 AS pct, d FROM bars QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY d DESC) = 1 AND pct IS NOT NULL ORDER BY pct DESC, entity_id LIMIT 5")
def f01_top_movers(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).withColumns({"pct": win.change("c"), "k": F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("d")))})
    return rows.where("k = 1 and pct is not null").select("entity_id", "d", "pct").orderBy(F.desc("pct"), "entity_id").limit(5)


@query("t AS (SELECT entity_id FROM bars GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 3) SELECT entity_id, d, c FROM bars SEMI JOIN t USING (entity_id)")
def f02_top_by_history(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", "c")
    top = rows.groupBy("entity_id").count().orderBy(F.desc("count"), "entity_id").limit(3).select("entity_id")
    return rows.join(top, "entity_id", "left_semi")


@query("SELECT entity_id, d, q50 FROM predictions ORDER BY d DESC, entity_id LIMIT 20")
def f03_latest_predictions(spark, sf_dir):
    return fx.predictions(spark, sf_dir).select("entity_id", "d", "q50").orderBy(F.desc("d"), "entity_id").limit(20)


@query("k AS (SELECT d, y, row_number() OVER (PARTITION BY d ORDER BY q50 DESC, entity_id) AS k FROM predictions JOIN outcomes USING (entity_id, d)) SELECT d, sum(y)::DOUBLE / count(*) AS mean_y FROM k WHERE k <= 5 GROUP BY d")
def f04_top_per_group(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("d").orderBy(F.desc("q50"), "entity_id"))
    return scored(spark, sf_dir).withColumn("k", k).where("k <= 5").groupBy("d").agg((F.sum("y") / F.count("y")).alias("mean_y"))


@query("SELECT entity_id, d, c FROM bars WHERE d <= DATE '1999-01-01' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY d DESC) <= 10")
def f05_last_rows(spark, sf_dir):
    return tab.latest_rows(fx.bars(spark, sf_dir).where("d <= date'1999-01-01'").select("entity_id", "d", "c"), ["entity_id"], "d", 10)


@query("SELECT entity_id, d, c FROM bars QUALIFY d > DATE '1999-01-01' OR row_number() OVER (PARTITION BY entity_id, d > DATE '1999-01-01' ORDER BY d DESC) <= 10")
def g01_windowed_union(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", "c")
    return tab.latest_rows(rows.where("d <= date'1999-01-01'"), ["entity_id"], "d", 10).unionByName(rows.where("d > date'1999-01-01'"))


@query("w AS (SELECT entity_id, d FROM bars WHERE c < 1200000), s AS (SELECT entity_id, d FROM bars WHERE c < 1000000 OR vol > 95) SELECT *, 'add' AS action FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM s) UNION ALL SELECT *, 'remove' FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM w)")
def g02_reconcile(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    return tab.reconcile(rows.where("c < 1200000").select("entity_id", "d"), rows.where("c < 1000000 or vol > 95").select("entity_id", "d"))


@query("SELECT d FROM bars WHERE entity_id % 2 = 0 INTERSECT SELECT d FROM bars WHERE entity_id % 3 = 0 AND vol > 20")
def g03_date_intersection(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    return rows.where("entity_id % 2 = 0").select("d").intersect(rows.where("entity_id % 3 = 0 and vol > 20").select("d"))


@query(" UNION ALL ".join(f"SELECT entity_id, d, {h} AS horizon, CAST(floor(10000 * (lead(c, {h}) OVER ({_E}) / c - 1)) AS BIGINT) AS y FROM bars" for h in (1, 4)))
def g04_stacked_horizons(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", *[F.floor(10000 * win.forward("c", h)).cast("long").alias(f"y{h}") for h in (1, 4)])
    return rows.select("entity_id", "d", F.expr("stack(2, 1, y1, 4, y4) as (horizon, y)"))


_OLD = "old AS (SELECT entity_id, d, c FROM bars WHERE vol % 3 > 0), new AS (SELECT entity_id, d, c + 1 AS c FROM bars WHERE vol % 2 = 0)"


def old_and_new(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    return rows.where("vol % 3 > 0").select("entity_id", "d", "c"), rows.where("vol % 2 = 0").select("entity_id", "d", (F.col("c") + 1).alias("c"))


@query(_OLD + " SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (entity_id, d)")
def h01_insert_or_ignore(spark, sf_dir):
    old, new = old_and_new(spark, sf_dir)
    return old.unionByName(tab.insert_or_ignore(old, new, ["entity_id", "d"], ["c"]))


@query(_OLD + " SELECT * FROM old ANTI JOIN new USING (entity_id, d) UNION ALL SELECT * FROM new")
def h02_upsert(spark, sf_dir):
    old, new = old_and_new(spark, sf_dir)
    return tab.upsert(old, new, ["entity_id", "d"], ["c"])


@query("n AS (SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'X' END AS sector, CASE WHEN entity_id % 3 = 0 THEN 'Y' END AS industry FROM dims) SELECT entity_id, coalesce(n.sector, dims.sector) AS sector, coalesce(n.industry, dims.industry) AS industry FROM dims JOIN n USING (entity_id)")
def h03_fill_upsert(spark, sf_dir):
    old = fx.dims(spark, sf_dir).select("entity_id", "sector", "industry")
    new = old.select("entity_id", F.when(F.col("entity_id") % 2 == 0, "X").alias("sector"), F.when(F.col("entity_id") % 3 == 0, "Y").alias("industry"))
    return tab.fill_upsert(old, new, ["entity_id"])


@query("SELECT entity_id, d, c FROM bars WHERE NOT ((d < DATE '1996-01-01' OR d > DATE '2000-01-01') AND entity_id % 2 = 0)")
def h04_trim(spark, sf_dir):
    import datetime as dt

    return tab.trim(fx.bars(spark, sf_dir).select("entity_id", "d", "c"), "d", dt.date(1996, 1, 1), dt.date(2000, 1, 1), F.col("entity_id") % 2 == 0)


_DOOMED = "doomed AS (SELECT entity_id FROM dims WHERE sector = 'ASIA')"


@query(_DOOMED + " SELECT 'bars' AS dependent, entity_id, count(*) AS n FROM bars SEMI JOIN doomed USING (entity_id) GROUP BY 2 UNION ALL SELECT 'trades', entity_id, count(*) FROM trades SEMI JOIN doomed USING (entity_id) GROUP BY 2 UNION ALL SELECT 'exclusions', entity_id, count(*) FROM exclusions SEMI JOIN doomed USING (entity_id) GROUP BY 2")
def h06_delete_plan(spark, sf_dir):
    doomed = fx.dims(spark, sf_dir).where("sector = 'ASIA'")
    return tab.delete_plan({"bars": fx.bars(spark, sf_dir), "trades": fx.trades(spark, sf_dir), "exclusions": fx.exclusions(spark, sf_dir)}, "entity_id", doomed)


@query("b AS (SELECT * FROM bars WHERE d >= DATE '1998-01-01') SELECT 'bars' AS step, count(*) AS n FROM bars WHERE d < DATE '1998-01-01' UNION ALL SELECT 'orphans', count(*) FROM dims WHERE entity_id NOT IN (SELECT entity_id FROM b WHERE c > 6000000)")
def h05_cull_plan(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    late = rows.where("d >= date'1998-01-01' and c > 6000000").select("entity_id")
    one = rows.where("d < date'1998-01-01'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bars").alias("step"), "n")
    return one.unionByName(fx.dims(spark, sf_dir).join(late, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans").alias("step"), "n"))


@query("w AS (SELECT entity_id FROM bars WHERE c < 900000 GROUP BY 1), s AS (SELECT entity_id FROM bars WHERE c < 950000 GROUP BY 1), n AS (SELECT count(*) AS all_n FROM dims) SELECT (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM s) AS stored, (SELECT count(*) FROM w ANTI JOIN s USING (entity_id)) AS added, (SELECT count(*) FROM s ANTI JOIN w USING (entity_id)) AS removed, (SELECT count(*) FROM w) = all_n OR 100 * ((SELECT count(*) FROM w) - (SELECT count(*) FROM s)) > 25 * all_n AS refused FROM n")
def h07_guarded_refresh(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    flags = rows.groupBy("entity_id").agg(F.max((F.col("c") < 900_000).cast("int")).alias("w"), F.max((F.col("c") < 950_000).cast("int")).alias("s"))
    all_ = fx.dims(spark, sf_dir).select("entity_id").join(flags, "entity_id", "left")
    out = all_.agg(F.count(F.lit(1)).alias("all_n"), F.count_if(F.col("w") == 1).alias("wanted"), F.count_if(F.col("s") == 1).alias("stored"), F.count_if((F.col("w") == 1) & (F.col("s") == 0)).alias("added"), F.count_if((F.col("s") == 1) & (F.col("w") == 0)).alias("removed"))
    return out.withColumn("refused", (F.col("wanted") == F.col("all_n")) | (100 * (F.col("wanted") - F.col("stored")) > 25 * F.col("all_n"))).drop("all_n")


@query("""w AS (SELECT entity_id FROM bars WHERE entity_id % 10 > 0 GROUP BY 1 HAVING max(c) > 9000000), s AS (SELECT entity_id FROM bars GROUP BY 1 HAVING max(c) > 9300000)
SELECT entity_id, 'add' AS action FROM w ANTI JOIN s USING (entity_id) UNION ALL SELECT entity_id, 'remove' FROM s ANTI JOIN w USING (entity_id)""")
def h07_forced_refresh(spark, sf_dir):
    """Pinned entities stay members, and the growth guard is told to let it pass."""
    dims, most = fx.dims(spark, sf_dir), fx.bars(spark, sf_dir).groupBy("entity_id").agg(F.max("c").alias("c"))
    return tab.guarded_refresh(dims, most.where("c > 9000000"), most.where("c > 9300000"), dims.where("entity_id % 10 = 0"), "entity_id", force=True)


@query("f AS (SELECT entity_id, d, vol > 90 AS resolved FROM bars WHERE c > 8000000) SELECT entity_id, d, CASE WHEN resolved THEN d + 30 END AS resolved_at FROM f")
def h08_resolve_findings(spark, sf_dir):
    found = fx.bars(spark, sf_dir).where("c > 8000000").select("entity_id", "d", F.lit(None).cast("date").alias("resolved_at"), "vol")
    resolved = found.where("vol > 90").withColumn("resolved_at", F.date_add("d", 30)).drop("vol")
    return tab.upsert(found.drop("vol"), resolved, ["entity_id", "d"], ["resolved_at"])


@query(_DOOMED + " SELECT 'predictions' AS dependent, entity_id, count(*) AS n FROM predictions SEMI JOIN doomed USING (entity_id) GROUP BY 2 UNION ALL SELECT 'outcomes', entity_id, count(*) FROM outcomes SEMI JOIN doomed USING (entity_id) GROUP BY 2")
def h09_registry_delete_plan(spark, sf_dir):
    doomed = fx.dims(spark, sf_dir).where("sector = 'ASIA'")
    return tab.delete_plan({"predictions": fx.predictions(spark, sf_dir), "outcomes": fx.outcomes(spark, sf_dir)}, "entity_id", doomed)


@query("l AS (SELECT entity_id, 'NYSE' AS exchange FROM dims WHERE entity_id % 2 = 0) SELECT entity_id, coalesce(CASE WHEN entity_id % 4 = 0 THEN 'OLD' END, exchange) AS exchange FROM dims LEFT JOIN l USING (entity_id)")
def h10_listing_backfill(spark, sf_dir):
    known = fx.dims(spark, sf_dir).select("entity_id", F.when(F.col("entity_id") % 4 == 0, "OLD").alias("exchange"))
    listing = known.where("entity_id % 2 = 0").select("entity_id", F.lit("NYSE").alias("listed"))
    return known.join(listing, "entity_id", "left").select("entity_id", F.coalesce("exchange", "listed").alias("exchange"))


@query(_LONG + ", curve AS (SELECT 0 AS entity_id, d, 'equity' AS feature, sum(c)::BIGINT AS value FROM bars GROUP BY d) SELECT entity_id, d, feature, value FROM feats WHERE feature = 'q50' UNION ALL SELECT entity_id, d, feature, value FROM curve")
def h11_curve_to_store(spark, sf_dir):
    store = long_features(spark, sf_dir).where("feature = 'q50'")
    curve = fx.bars(spark, sf_dir).groupBy("d").agg(F.sum("c").alias("value")).select(F.lit(0).cast("long").alias("entity_id"), "d", F.lit("equity").alias("feature"), "value")
    return tab.upsert(store, curve, ["entity_id", "d", "feature"], ["value"])


_SMA20 = f"s AS (SELECT entity_id, d, CASE WHEN count(c) OVER w = 20 THEN sum(c) OVER w / 20 END AS sma FROM bars WINDOW w AS ({_E} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


@query(_SMA20 + ", k AS (SELECT entity_id, max(d) AS cutoff FROM bars WHERE d <= DATE '1999-01-01' AND entity_id % 7 > 0 GROUP BY 1) SELECT s.entity_id, s.d, sma FROM s LEFT JOIN k USING (entity_id) WHERE cutoff IS NULL OR d > cutoff")
def i01_incremental_features(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    stored = rows.where("d <= date'1999-01-01' and entity_id % 7 > 0").select("entity_id", "d")
    return tab.incremental(rows, stored, ["entity_id"], "d", tab.lookback("window", 20), lambda df: win.sma(df, "c", 20), ["entity_id", "d", "sma"])


@query("""a AS (SELECT entity_id, CASE entity_id % 3 WHEN 0 THEN 'window' WHEN 1 THEN 'converging' ELSE 'full' END AS kind, 5 + entity_id % 46 AS period, count(*) AS n FROM bars GROUP BY 1),
b AS (SELECT *, CASE kind WHEN 'window' THEN greatest(20, period) + 10 WHEN 'converging' THEN greatest(400, 25 * period) + 10 END AS bars FROM a)
SELECT entity_id, kind, period, bars, least(n, coalesce(bars, n)) AS n_read FROM b""")
def i02_lookback_policy(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("window"), F.lit("converging"), F.lit("full")), (F.col("entity_id") % 3 + 1).cast("int"))
    asked = fx.bars(spark, sf_dir).select("entity_id", "d", kind.alias("kind"), (5 + F.col("entity_id") % 46).alias("period"))
    policy = asked.select("kind", "period").distinct()
    bound = tab.lookback_column("kind", "period")
    back = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("d")))
    read = asked.withColumn("back", back).join(policy.withColumn("bars", bound), ["kind", "period"]).where("bars is null or back <= bars")
    return read.groupBy("entity_id", "kind", "period", "bars").agg(F.count(F.lit(1)).alias("n_read"))


@query("m AS (SELECT d, sum(c) AS v FROM bars GROUP BY d) SELECT d, v, v - lag(v) OVER (ORDER BY d) AS step FROM m QUALIFY d > DATE '1999-01-01'")
def i03_incremental_market(spark, sf_dir):
    series = fx.bars(spark, sf_dir).groupBy("d").agg(F.sum("c").alias("v")).withColumn("one", F.lit(1))
    cutoff = series.where("d <= date'1999-01-01'").groupBy("one").agg(F.max("d").alias("cutoff"))
    near = tab.bounded_read(series, cutoff, ["one"], "d", 1)
    return near.withColumn("step", F.col("v") - F.lag("v").over(W.partitionBy("one").orderBy("d"))).where("d > cutoff").select("d", "v", "step")


@query("u AS (SELECT entity_id, d, 'q10' AS feature, q10 AS value FROM predictions UNION ALL SELECT entity_id, d, 'q90', q90 FROM predictions) SELECT * FROM u WHERE NOT (d < DATE '1997-01-01' AND feature = 'q10')")
def i04_incremental_predictions(spark, sf_dir):
    long = fx.predictions(spark, sf_dir).unpivot(["entity_id", "d"], ["q10", "q90"], "feature", "value")
    stored = long.where("d < date'1997-01-01' and feature = 'q10'").select("entity_id", "d", "feature")
    return tab.insert_or_ignore(stored, long, ["entity_id", "d", "feature"], ["value"])


@query()
def i05_derive_in_order(spark, sf_dir):
    from graphlib import TopologicalSorter

    rows = fx.bars(spark, sf_dir)
    jobs = {
        "total": ((), lambda _: rows.groupBy("d").agg(F.sum("c").alias("value"))),
        "volume": ((), lambda _: rows.groupBy("d").agg(F.sum("vol").alias("value"))),
        "per_share": (("total", "volume"), lambda f: f["total"].join(f["volume"].withColumnRenamed("value", "v"), "d").select("d", F.try_divide("value", "v").alias("value"))),
    }
    frames: dict = {}
    for name in TopologicalSorter({k: v[0] for k, v in jobs.items()}).static_order():  # a cycle is refused
        frames[name] = jobs[name][1](frames)
    out = None
    for name, df in frames.items():
        df = df.select(F.lit(name).alias("series"), "d", F.col("value").cast("double").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


@query("""x AS (SELECT entity_id, d, c, (c > 9000000 OR c < 150000) AS bad, (c > 9000000 OR c < 150000) AND vol % 5 = 0 AS resolved FROM bars),
old AS (SELECT entity_id, d, c + 1 AS c FROM bars WHERE vol % 7 = 0), ok AS (SELECT entity_id, d, c FROM x WHERE NOT bad OR resolved)
SELECT entity_id, d, c FROM ok UNION ALL SELECT entity_id, d, c FROM old WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.entity_id = old.entity_id AND ok.d = old.d)""")
def i06_materialise_filtered(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    trash = rows.where("c > 9000000 or c < 150000").where("vol % 5 <> 0").select("entity_id", "d")  # findings nobody resolved
    stored = rows.where("vol % 7 = 0").select("entity_id", "d", (F.col("c") + 1).alias("c"))
    return tab.upsert(stored, rows.select("entity_id", "d", "c").join(trash, ["entity_id", "d"], "left_anti"), ["entity_id", "d"], [F.lit(0)])


@query()
def i07_refresh_all(spark, sf_dir):
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    rows = fx.bars(spark, sf_dir)
    jobs = {"median": lambda: rows.groupBy("d").agg(agg.median("c").alias("v")), "missing": lambda: rows.select("nothing"), "broken": lambda: rows.groupBy("d").agg(F.max(F.concat(F.lit("x"), "c").cast("long")).alias("v")), "total": lambda: rows.groupBy("d").agg(F.sum("c").alias("v"))}
    status = []
    for name, job in jobs.items():
        try:
            status.append((name, "ok", job().where("v is not null").count()))
        except (PySparkException, Py4JJavaError) as e:  # a missing column or a failing task is reported: one series must not stop the others
            status.append((name, type(e).__name__, 0))
    return spark.createDataFrame(status, "series string, status string, n_rows long")


@query("""new AS (SELECT entity_id AS series, d, c AS value FROM bars WHERE vol % 3 > 0), old AS (SELECT entity_id AS series, d, c + 1 AS value FROM bars WHERE vol % 2 = 0),
v AS (SELECT series, d, value FROM new UNION ALL SELECT series, d, value FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.series = old.series AND new.d = old.d)),
f AS (SELECT series, d, 'out_of_bounds' AS rule FROM v WHERE value > 9000000 OR value < 150000),
g AS (SELECT * FROM v ANTI JOIN f USING (series, d))
SELECT n.series, n.symbol, count(v.d) AS stored, count(f.d) AS findings, count(g.d) AS materialised, sum(g.value)::BIGINT AS total, max(g.d) AS last_d
FROM (SELECT entity_id AS series, symbol FROM dims) n JOIN v USING (series) LEFT JOIN f USING (series, d) LEFT JOIN g USING (series, d) GROUP BY ALL""")
def i08_ingest_pipeline(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select(F.col("entity_id").alias("series"), "d", F.col("c").alias("value"), "vol")
    catalog = fx.dims(spark, sf_dir).select(F.col("entity_id").alias("series"), "symbol")
    old = rows.where("vol % 2 = 0").select("series", "d", (F.col("value") + 1).alias("value"))
    path = scratch(spark, "ingest")
    return ing.ingest(catalog, old, rows.where("vol % 3 > 0").select("series", "d", "value"), ["series", "d"], {"out_of_bounds": (F.col("value") > 9_000_000) | (F.col("value") < 150_000)}, path)


_PV = "pv AS (SELECT entity_id, sector, CASE WHEN entity_id % 7 = 0 THEN NULL ELSE (entity_id * 37 % 101) / 400.0::DOUBLE END AS p FROM dims)"


@query(_PV + ", k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY p NULLS LAST) AS k, count(*) OVER (PARTITION BY sector) AS n FROM pv), t AS (SELECT *, max(CASE WHEN p <= k * 0.1::DOUBLE / n THEN k END) OVER (PARTITION BY sector) AS top FROM k) SELECT entity_id, p, coalesce(p IS NOT NULL AND k <= top, false) AS survivor FROM t")
def l01_fdr(spark, sf_dir):
    p = F.when(F.col("entity_id") % 7 != 0, F.col("entity_id") * 37 % 101 / 400.0)
    return tab.benjamini_hochberg(fx.dims(spark, sf_dir).withColumn("p", p), "p", ["sector"], 0.1).select("entity_id", "p", "survivor")


@query("SELECT entity_id, count(*) AS n, sum(y)::BIGINT AS s, (count(*) * sum(y * y) - sum(y) * sum(y))::DOUBLE / (count(*) * (count(*) - 1)) AS variance FROM outcomes GROUP BY 1 HAVING count(*) > 1")
def l02_t_moments(spark, sf_dir):
    n, s = F.count(F.lit(1)), F.sum("y")
    return fx.outcomes(spark, sf_dir).groupBy("entity_id").agg(n.alias("n"), s.alias("s"), ((n * F.sum(F.col("y") * F.col("y")) - s * s) / (n * (n - 1))).alias("variance")).where("n > 1")


def conditional(spark, sf_dir):
    """Outcomes by label of their bar: episodes, moments, t and p; refused below five episodes."""
    rows = fx.bars(spark, sf_dir).withColumn("label", F.when(F.col("vol") > 30, "busy").otherwise("calm"))
    episodes = win.islands(rows, "label").groupBy("label").agg(F.count(F.lit(1)).alias("episodes"))
    return sta.conditional_t(rows.join(fx.outcomes(spark, sf_dir), ["entity_id", "d"]), "y", "label", episodes, 5)


def screened(spark, sf_dir):
    """Candidates (busy or not) by sector: frozen on dates before 1998, tested on those after."""
    rows = fx.outcomes(spark, sf_dir).join(fx.bars(spark, sf_dir).select("entity_id", "d", (F.col("vol") > 30).alias("busy")), ["entity_id", "d"]).join(fx.dims(spark, sf_dir), "entity_id")
    return sta.screen_and_test(rows, "y", ["sector", "busy"], F.col("d") < F.lit("1998-01-01").cast("date"), 20, 0.5, 1.645)


@query("""lab AS (SELECT entity_id, d, CASE WHEN vol > 30 THEN 'busy' ELSE 'calm' END AS label FROM bars),
e AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d) - row_number() OVER (PARTITION BY entity_id, label ORDER BY d) AS g FROM lab),
n AS (SELECT label, count(*) AS episodes FROM (SELECT DISTINCT entity_id, label, g FROM e) GROUP BY 1),
m AS (SELECT label, count(*) AS n, sum(y)::BIGINT AS s, sum(y * y)::BIGINT AS ss FROM lab JOIN outcomes USING (entity_id, d) GROUP BY 1)
SELECT label, episodes, n, s, ss, CASE WHEN episodes >= 5 AND n >= 2 AND n * ss > s * s THEN round((s::DOUBLE / n) / (sqrt((n * ss - s * s)::DOUBLE / (n * (n - 1))) / sqrt(n::DOUBLE)), 9) END AS t FROM n JOIN m USING (label)""")
def l03_conditional_moments(spark, sf_dir):
    return conditional(spark, sf_dir).drop("p")


@query("""x AS (SELECT sector AS a FROM bars JOIN dims USING (entity_id) GROUP BY 1 HAVING max(c) > 1000000)
SELECT a.a, b.a AS b, op, (SELECT count(*) * count(*) FROM x) AS family FROM x a JOIN x b ON a.a < b.a, (SELECT unnest(['AND', 'OR']) AS op) UNION ALL SELECT a, NULL, NULL, (SELECT count(*) * count(*) FROM x) FROM x""")
def l05_candidates(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id")
    return dis.candidates(rows.groupBy(F.col("sector").alias("a")).agg(F.max("c").alias("most")).where("most > 1000000").select("a")).select("a", "b", "op", "family")


@query("""z AS (SELECT sector, y, d < DATE '1998-01-01' AS inner_part, vol > 30 AS busy FROM outcomes JOIN bars USING (entity_id, d) JOIN dims USING (entity_id)),
m AS (SELECT sector, busy, inner_part, count(*) AS n, sum(y)::BIGINT AS s, sum(y * y)::BIGINT AS ss FROM z GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN n >= 20 AND n * ss > s * s THEN round((s::DOUBLE / n) / (sqrt((n * ss - s * s)::DOUBLE / (n * (n - 1))) / sqrt(n::DOUBLE)), 9) END AS t FROM m),
p AS (SELECT sector, busy, max(t) FILTER (WHERE inner_part) AS t_inner, max(t) FILTER (WHERE NOT inner_part) AS t_outer FROM t GROUP BY 1, 2)
SELECT sector, busy, t_inner, t_outer, CASE WHEN t_inner IS NULL THEN 'no evidence' WHEN t_inner <= 0.5 THEN 'screened out' WHEN t_outer IS NULL THEN 'no evidence' WHEN t_outer > 1.645 THEN 'confirmed' ELSE 'failed' END AS verdict FROM p""")
def l06_verdicts(spark, sf_dir):
    return screened(spark, sf_dir).select("sector", "busy", "t_inner", "t_outer", "verdict")


@query("""f AS (SELECT entity_id, date_diff('day', DATE '1995-01-01', d) // 180 AS fold, count(*) AS n, sum(y)::BIGINT AS s, sum(y * y)::BIGINT AS ss FROM outcomes WHERE d >= DATE '1995-01-01' GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN n >= 8 AND n * ss > s * s THEN round((s::DOUBLE / n) / (sqrt((n * ss - s * s)::DOUBLE / (n * (n - 1))) / sqrt(n::DOUBLE)), 9) END AS t FROM f)
SELECT entity_id, count(*) AS folds, count(t) AS evaluable, CASE WHEN count(t) = 0 THEN 'no evidence' WHEN bool_and(t > 0.5) FILTER (WHERE t IS NOT NULL) THEN 'confirmed' ELSE 'failed' END AS verdict,
  count(*) FILTER (WHERE t > 0.5)::DOUBLE / nullif(count(t), 0) AS grade FROM t GROUP BY 1""")
def l09_fold_grades(spark, sf_dir):
    fold = F.expr("datediff(d, date'1995-01-01') div 180")
    return sta.fold_grades(fx.outcomes(spark, sf_dir).where("d >= date'1995-01-01'").withColumn("fold", fold), "y", ["entity_id"], "fold", 8, 0.5)


@query("t AS (SELECT count(DISTINCT d) AS t FROM bars) SELECT entity_id, count(DISTINCT d) AS n, count(DISTINCT d)::DOUBLE / any_value(t) AS coverage, count(DISTINCT d) * 100 >= 80 * any_value(t) AS passed FROM bars, t GROUP BY 1")
def l10_coverage_gate(spark, sf_dir):
    rows = fx.bars(spark, sf_dir)
    total = F.broadcast(rows.agg(F.countDistinct("d").alias("t")))  # one row
    out = rows.groupBy("entity_id").agg(F.countDistinct("d").alias("n")).join(total, F.lit(True))
    return out.select("entity_id", "n", (F.col("n") / F.col("t")).alias("coverage"), (F.col("n") * 100 >= 80 * F.col("t")).alias("passed"))


@query("""m AS (SELECT sector, vol > 30 AS busy, count(*) AS n, sum(y)::BIGINT AS s, sum(y * y)::BIGINT AS ss FROM outcomes JOIN bars USING (entity_id, d) JOIN dims USING (entity_id) GROUP BY 1, 2)
SELECT sector, busy, n > 1 AND n * ss > s * s AS has_p, NOT (sector = 'ASIA' AND busy AND n > 1 AND n * ss > s * s) AS matches FROM m""")
def l12_recompute_check(spark, sf_dir):
    rows = fx.outcomes(spark, sf_dir).join(fx.bars(spark, sf_dir).select("entity_id", "d", (F.col("vol") > 30).alias("busy")), ["entity_id", "d"]).join(fx.dims(spark, sf_dir), "entity_id")
    keys = ["sector", "busy"]
    drift = F.when((F.col("sector") == "ASIA") & F.col("busy"), F.col("p") + 0.001).otherwise(F.col("p"))
    stored = sta.one_sample_t(rows.repartition("d"), "y", keys).withColumn("p", drift)  # another order of sums
    return sta.recomputed(stored, sta.one_sample_t(rows, "y", keys), keys).select(*keys, F.col("t").isNotNull().alias("has_p"), "matches")


@query("""r AS (SELECT entity_id, date_diff('day', DATE '1990-01-01', d) // 28 AS run, count(*) FILTER (WHERE q50 > 400) AS admitted, bool_and(q10 < q50 - 160) AS passed FROM predictions GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY run DESC) AS k FROM r)
SELECT entity_id, count(*) AS runs, sum(admitted)::BIGINT AS admitted, bool_and(passed OR admitted = 0) AS coherent FROM k WHERE k <= 5 GROUP BY 1""")
def l13_coherence_gate(spark, sf_dir):
    run = F.expr("datediff(d, date'1990-01-01') div 28")
    runs = fx.predictions(spark, sf_dir).groupBy("entity_id", run.alias("run")).agg(F.count_if(F.col("q50") > 400).alias("admitted"), F.bool_and(F.col("q10") < F.col("q50") - 160).alias("passed"), F.count(F.lit(1)).alias("n"))
    return tab.coherence(runs.where("n >= 2"), ["entity_id"], "run", "admitted", "passed", 5)


@query("""v AS (SELECT industry AS name, entity_id AS version, vol % 4 > 0 AS active, d AS updated FROM bars JOIN dims USING (entity_id)),
a AS (SELECT name, version, updated FROM v WHERE active QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated DESC, version DESC) = 1),
u AS (SELECT DISTINCT n_name AS name FROM nation)
SELECT u.name, version, updated, version IS NULL AS orphan FROM u LEFT JOIN a USING (name)""")
def k06_registry(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id").select(F.col("industry").alias("name"), F.col("entity_id").alias("version"), (F.col("vol") % 4 > 0).alias("active"), F.col("d").alias("updated"))
    newest = tab.first_per_key(rows.where("active"), ["name"], [F.desc("updated"), F.desc("version")]).select("name", "version", "updated")
    named = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).distinct()
    return named.join(newest, "name", "left").withColumn("orphan", F.col("version").isNull())


@query("""g AS (SELECT p::INTEGER AS period, w AS weight, kind FROM (SELECT unnest([5, 10, 15]) AS p), (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS w), (SELECT unnest(['a', 'b']) AS kind)),
s AS (SELECT sector, vol % 16 AS k, count(*) AS n FROM bars JOIN dims USING (entity_id) GROUP BY ALL)
SELECT sector, period, weight, kind, weight * sum(CASE WHEN (kind = 'a') = (k >= period) THEN n ELSE 0 END)::BIGINT AS score FROM g, s GROUP BY sector, period, weight, kind""")
def k07_parameter_grid(spark, sf_dir):
    from chronopanel.functions.udf import parameter_grid

    grid = parameter_grid(spark, {"period": {"low": 5, "high": 15, "step": 5}, "weight": {"low": 0.5, "high": 1.0, "steps": 2}, "kind": ["a", "b"]})
    counts = fx.bars(spark, sf_dir).join(fx.dims(spark, sf_dir), "entity_id").groupBy("sector", (F.col("vol") % 16).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    hit = (F.col("kind") == "a") == (F.col("k") >= F.col("period"))
    tried = counts.join(F.broadcast(grid), F.lit(True))  # a dozen rows
    return tried.groupBy("sector", "period", "weight", "kind").agg((F.first("weight") * F.sum(F.when(hit, F.col("n")).otherwise(0))).alias("score"))


@query("""u AS (SELECT i AS draw, ('0x' || substr(sha256('7:period:' || i), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS p, ('0x' || substr(sha256('7:weight:' || i), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS w FROM range(0, 50) t(i)),
k AS (SELECT draw, floor(5 + p * 45)::INTEGER AS period, 0 + w * 1 AS weight FROM u), s AS (SELECT vol, count(*) AS n FROM bars GROUP BY 1)
SELECT draw, period, weight, weight * sum(CASE WHEN vol >= period THEN n ELSE 0 END)::BIGINT AS score FROM k, s GROUP BY 1, 2, 3""")
def k08_random_parameters(spark, sf_dir):
    from chronopanel.functions.udf import random_parameters

    drawn = random_parameters(spark, 50, {"period": (5, 50), "weight": (0.0, 1.0)}, seed=7).withColumnRenamed("id", "draw")
    counts = fx.bars(spark, sf_dir).groupBy("vol").agg(F.count(F.lit(1)).alias("n"))
    tried = counts.join(F.broadcast(drawn), F.lit(True))  # fifty rows
    return tried.groupBy("draw", "period", "weight").agg((F.first("weight") * F.sum(F.when(F.col("vol") >= F.col("period"), F.col("n")).otherwise(0))).alias("score"))


@query(f"SELECT entity_id, d, CASE WHEN count(c) OVER w = 20 THEN sum(c) OVER w / 20 END AS sma_20 FROM bars WINDOW w AS ({_E} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def k01_entity_function(spark, sf_dir):
    from chronopanel.functions.udf import entity_function

    def compute(rows):
        return rows.assign(sma_20=rows["c"].rolling(20).sum() / 20)[["d", "sma_20"]]

    return entity_function(fx.bars(spark, sf_dir).select("entity_id", "d", "c"), compute, "entity_id", "d", "d date, sma_20 double")


@query(f"SELECT entity_id, d, sum(c) OVER (PARTITION BY entity_id ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE AS s5, sum(c) OVER (PARTITION BY entity_id ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::DOUBLE AS s10 FROM bars")
def k02_series_adapter(spark, sf_dir):
    from chronopanel.functions.udf import series_adapter

    def rolling(rows, period):
        return rows["c"].rolling(period, min_periods=1).sum()

    return series_adapter(fx.bars(spark, sf_dir).select("entity_id", "d", "c"), rolling, {"s5": {"period": 5}, "s10": {"period": 10}}, "entity_id", "d")


@query("SELECT d, count(*) FILTER (WHERE 2 * c > h + l)::DOUBLE / count(*) AS value FROM bars GROUP BY d HAVING count(*) >= 5")
def k03_market_function(spark, sf_dir):
    from chronopanel.functions.udf import market_function

    return market_function(fx.bars(spark, sf_dir), lambda rows: float((2 * rows["c"] > rows["h"] + rows["l"]).mean()), "d", least=5)


@query("SELECT d, (sum(c)::DOUBLE) / sum(vol) AS value FROM bars GROUP BY d")
def k04_composite_function(spark, sf_dir):
    from chronopanel.functions.udf import composite_function

    wide = fx.bars(spark, sf_dir).groupBy("d").agg(F.sum("c").cast("double").alias("c"), F.sum("vol").cast("double").alias("vol"))
    return composite_function(wide, lambda c, vol: c / vol, ["c", "vol"]).select("d", "value")


@query("""q AS (SELECT entity_id, quantile_disc(c, 0.5) FILTER (WHERE d < DATE '1998-01-01') AS cut, quantile_disc(c, 0.5) FILTER (WHERE d < DATE '1996-07-01') AS refit FROM bars GROUP BY 1),
s AS (SELECT entity_id, d, c > cut AS high, (c > cut) = (c > refit) AS same FROM bars JOIN q USING (entity_id) WHERE cut IS NOT NULL AND refit IS NOT NULL),
a AS (SELECT entity_id, count(*) FILTER (WHERE high)::DOUBLE / count(*) AS share, count(*) FILTER (WHERE same)::DOUBLE / count(*) AS agreement FROM s GROUP BY 1)
SELECT entity_id, d, CASE WHEN high THEN 'high' ELSE 'low' END AS state, share, agreement FROM s JOIN a USING (entity_id) WHERE share BETWEEN 0.02 AND 0.9 AND agreement >= 0.8""")
def e31_two_state(spark, sf_dir):
    rows = fx.bars(spark, sf_dir).select("entity_id", "d", "c")
    before = lambda d: F.col("d") < F.lit(d).cast("date")
    return win.two_state(rows, "c", before("1998-01-01"), before("1996-07-01"), 0.5, (0.02, 0.9), 0.8).select("entity_id", "d", "state", "share", "agreement")


@query()
def l03_conditional_p(spark, sf_dir):
    return conditional(spark, sf_dir).select("label", "episodes", "n", "t", "p")


ATOMS = {"busier": "volume > volume_1", "dearer": "total > total_1", "rising": "total > total_4", "wider": "n > n_1"}

#: Per date: what the atoms compare, and the mean outcome as a whole number.
_DAYS = """w AS (SELECT d, sum(c)::BIGINT AS total, sum(vol)::BIGINT AS volume, count(*) AS n FROM bars GROUP BY d),
f AS (SELECT d, volume > lag(volume) OVER o AS busier, total > lag(total) OVER o AS dearer, total > lag(total, 4) OVER o AS rising, n > lag(n) OVER o AS wider FROM w WINDOW o AS (ORDER BY d)),
r AS (SELECT d, floor(sum(y)::DOUBLE / count(*))::BIGINT AS r FROM outcomes GROUP BY d)"""


def atom_flags(bars):
    """i, d and whether each atom holds: one row a date."""
    days = bars.groupBy("d").agg(F.sum("c").alias("total"), F.sum("vol").alias("volume"), F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    along = W.partitionBy("one").orderBy("d")
    seen = days.withColumns({f"{c}_{k}": F.lag(c, k).over(along) for c, k in (("volume", 1), ("total", 1), ("total", 4), ("n", 1))} | {"i": (F.row_number().over(along) - 1).cast("long")})
    return seen.select("i", "d", *[F.coalesce(F.expr(e), F.lit(False)).alias(a) for a, e in ATOMS.items()])


def market_outcomes(rows, *keys):
    """keys, d, r: the mean outcome of a date as a whole number."""
    return rows.groupBy(*keys, "d").agg(F.floor(F.sum("y").cast("double") / F.count(F.lit(1))).cast("long").alias("r"))


def composite_tests(spark, bars, budget, outcomes, keys=()):
    """Candidates within the budget, tested before and after 1998."""
    flags = staged(atom_flags(bars), "flags")  # one row a date, read twice
    atoms = spark.createDataFrame([(a,) for a in ATOMS], "a string")
    tried = dis.candidates(atoms, "a", budget).where("within").drop("within")
    bits = dis.combined(tried, dis.words(flags, list(ATOMS)))
    placed = market_outcomes(outcomes, *keys).join(flags.select("d", "i"), "d").withColumn("inner_part", F.col("d") < F.lit("1998-01-01").cast("date"))
    return tried, dis.tests(tried, bits, placed, "r", "inner_part", keys)


@query(_DAYS + """, n AS (SELECT unnest(['busier', 'dearer', 'rising', 'wider']) AS a),
e AS (SELECT row_number() OVER (ORDER BY b IS NOT NULL, a, b, op) AS id, a, b, op FROM (SELECT a, NULL AS b, NULL AS op FROM n UNION ALL SELECT x.a, y.a, op FROM n x JOIN n y ON x.a < y.a, (SELECT unnest(['AND', 'OR']) AS op))),
g AS (UNPIVOT f ON busier, dearer, rising, wider INTO NAME a VALUE held),
u AS (SELECT d, a, coalesce(held, false) AS held FROM (SELECT d.d, n.a, g.held FROM f d CROSS JOIN n LEFT JOIN g ON g.d = d.d AND g.a = n.a)),
h AS (SELECT id, e.a, e.b, e.op, x.d, CASE op WHEN 'AND' THEN x.held AND y.held WHEN 'OR' THEN x.held OR y.held ELSE x.held END AS held, row_number() OVER (PARTITION BY id ORDER BY x.d) AS i
  FROM e JOIN u x ON x.a = e.a LEFT JOIN u y ON y.a = e.b AND y.d = x.d WHERE id <= 14),
o AS (SELECT h.*, r, h.d < DATE '1998-01-01' AS inner_part FROM h JOIN r USING (d)),
q AS (SELECT *, held AND NOT coalesce(lag(held) OVER k AND lag(i) OVER k = i - 1, false) AS on_starts, NOT held AND NOT coalesce(NOT lag(held) OVER k AND lag(i) OVER k = i - 1, false) AS off_starts FROM o WINDOW k AS (PARTITION BY id, inner_part ORDER BY d)),
m AS (SELECT id, a, b, op, inner_part, held, count(*) AS n, sum(r)::BIGINT AS s, sum(r * r)::BIGINT AS ss, count(*) FILTER (WHERE on_starts OR off_starts) AS episodes FROM q GROUP BY ALL)
SELECT id, a, b, op, inner_part, CASE WHEN held THEN 'on' ELSE 'off' END AS bucket, n, s, ss, episodes,
  CASE WHEN episodes >= 5 AND n >= 2 AND n * ss > s * s THEN round((s::DOUBLE / n) / (sqrt((n * ss - s * s)::DOUBLE / (n * (n - 1))) / sqrt(n::DOUBLE)), 9) END AS t FROM m""")
def l06_composite_tests(spark, sf_dir):
    """Atoms and their pairs as words of bits: rows, runs and t of both sides in both parts, 14 of 16 candidates."""
    tried, tested = composite_tests(spark, fx.bars(spark, sf_dir), 14, fx.outcomes(spark, sf_dir))
    return tested.join(tried.drop("family"), "id").select("id", "a", "b", "op", "inner_part", "bucket", "n", "s", "ss", "episodes", "t")


@query()
def l06_composite_verdicts(spark, sf_dir):
    """What became of all candidates; those beyond the budget are recorded as cut."""
    tried, tested = composite_tests(spark, fx.bars(spark, sf_dir), 14, fx.outcomes(spark, sf_dir))
    every = dis.candidates(spark.createDataFrame([(a,) for a in ATOMS], "a string"), "a", 14)
    judged = dis.verdicts(tested, "inner_part", 0.6, 0.5)
    verdict = F.when(~F.col("within"), "budget_exhausted").otherwise(F.coalesce("verdict", F.lit("refused_low_power")))
    return every.join(judged, "id", "left").select("id", "a", "b", "op", "family", "p_inner", "p_outer", verdict.alias("verdict"))


@query()
def l11_power_sweep(spark, sf_dir):
    """Samples by sector of three sizes, three draws each: size, correlation, effective size and admissions of every draw in one plan."""
    settings = [(f, k) for f in (30, 60, 90) for k in range(3)]
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(k).alias("draw")) for f, k in settings]))
    pool = fx.dims(spark, sf_dir).select("entity_id", "sector", wanted.alias("s")).select("entity_id", "sector", "s.*").withColumn("key", F.sha2(F.concat_ws(":", F.lit(17), "fraction", "draw", "entity_id"), 256))
    sample = tab.lowest_share(pool, ["fraction", "draw", "sector"], "key", ["entity_id"], "fraction", 100)
    keys = ("fraction", "draw")
    ahead = F.lead("c", 4).over(W.partitionBy("entity_id").orderBy("d"))  # outcomes beside their bars, in one pass
    rows = fx.bars(spark, sf_dir, along=True).select("entity_id", "d", "c", "vol", F.floor(10000 * (ahead / F.col("c") - 1)).cast("long").alias("y"))
    kept = agg.histories(rows, "y", keys, sample.select(*keys, "entity_id"), beside=("c", "vol"))
    size = agg.densest_panel(kept, 20, keys, entity_cover=0.6, time_cover=0.7)
    drawn = kept.select(F.explode("_of").alias("of"), "_h").select("of.*", F.explode("_h").alias("p")).select(*keys, F.col("p._t").alias("d"), F.col("p._v").alias("y"))
    _, tested = composite_tests(spark, kept.select(F.inline("_all")), 16, drawn, keys)
    judged = dis.verdicts(tested, "inner_part", 0.6, 0.5, keys).groupBy(*keys).agg(F.count_if(F.col("verdict") == "admitted").alias("admitted"), F.count("p_outer").alias("tested"))
    return size.join(judged, list(keys), "left")


@query()
def l06_survivors(spark, sf_dir):
    """Outer p-values of screened candidates, and which survive the false discovery rate."""
    tested = screened(spark, sf_dir).where("verdict in ('confirmed', 'failed')")
    return tab.benjamini_hochberg(tested.withColumn("family", F.lit("outer")), "p_outer", ["family"], 0.1).select("sector", "busy", "p_outer", "survivor")
