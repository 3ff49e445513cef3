"""Ingest of landed payloads: JSON maps and CSV texts into typed rows.

Payloads are columns of text, as ``spark.read.text(wholetext=True)`` or a landing
table gives them; malformed values become null and malformed rows are dropped
or quarantined, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NESTED = "map<string,map<string,string>>"


def keyed_series(payloads: DataFrame, key: str, payload: str, series: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a payload {series: {date: {field: text}}}: key, d and the named fields as numbers; rows without a date are dropped."""
    body = F.from_json(F.get_json_object(payload, f"$['{series}']"), _NESTED)
    rows = payloads.select(key, F.explode(body).alias("t", "values"))
    return rows.select(key, F.try_to_date("t").alias("d"), *[F.element_at("values", name).try_cast("double").alias(out) for out, name in fields.items()]).where("d is not null")


def daily_bars(payloads: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars, and the rows put in quarantine: those without a date or a close."""
    names = {"o": "1. open", "h": "2. high", "l": "3. low", "c": "4. close", "adjusted": "5. adjusted close", "vol": "6. volume", "split_coefficient": "8. split coefficient"}
    body = F.from_json(F.get_json_object(payload, "$['Time Series (Daily)']"), _NESTED)
    rows = payloads.select(key, F.explode(body).alias("t", "values"))
    typed = rows.select(key, "t", F.try_to_date("t").alias("d"), *[F.element_at("values", n).try_cast("double").alias(c) for c, n in names.items()])
    good = F.col("d").isNotNull() & F.col("c").isNotNull()
    return typed.where(good).drop("t"), typed.where(~good).select(key, "t")


def statements(payloads: DataFrame, key: str, payload: str, array: str, core: dict[str, str]) -> DataFrame:
    """Statement rows: core fields typed, every other field kept as JSON in ``raw``."""
    rows = payloads.select(key, F.explode(F.from_json(F.get_json_object(payload, f"$.{array}"), "array<map<string,string>>")).alias("m"))
    names = list(core)
    rest = F.map_filter("m", lambda k, _: ~k.isin(*names))
    return rows.select(key, *[F.element_at("m", n).try_cast(kind).alias(n) for n, kind in core.items()], F.to_json(rest).alias("raw"))


#: For each statement type the provider's list, and the fields that have a column.
STATEMENTS = {
    "income": ("quarterlyReports", {"totalRevenue": "double", "grossProfit": "double", "operatingIncome": "double", "netIncome": "double", "ebitda": "double"}),
    "balance_sheet": ("quarterlyReports", {"totalAssets": "double", "totalLiabilities": "double", "totalShareholderEquity": "double"}),
    "cash_flow": ("quarterlyReports", {"operatingCashflow": "double", "capitalExpenditures": "double", "dividendPayout": "double"}),
    "earnings": ("quarterlyEarnings", {"reportedEPS": "double", "estimatedEPS": "double", "surprise": "double", "surprisePercentage": "double"}),
}


def statement_rows(payloads: DataFrame, key: str, kind: str, payload: str) -> DataFrame:
    """Statements of all types in one table: key, statement_type, d, reported_at, every type's columns, and the rest as JSON in ``raw``.

    ``payloads`` holds key, the type and the payload.  Rows without a date and
    payloads of unknown types are dropped; a date of report is that of earnings alone.
    """
    lists = F.create_map(*[x for name, (array, _) in STATEMENTS.items() for x in (F.lit(name), F.lit(array))])
    body = F.from_json(payload, "map<string,string>")
    each = F.from_json(F.element_at(body, F.element_at(lists, F.col(kind))), "array<map<string,string>>")
    rows = payloads.select(key, F.col(kind).alias("statement_type"), F.explode(each).alias("m"))
    d = F.try_to_date(F.element_at("m", "fiscalDateEnding"))
    own = F.create_map(*[x for name, (_, core) in STATEMENTS.items() for x in (F.lit(name), F.array(*map(F.lit, core)))])
    skip = F.concat(F.element_at(own, F.col("statement_type")), F.array(F.lit("fiscalDateEnding"), F.lit("reportedDate"), F.lit("reportedCurrency")))
    raw = F.map_filter("m", lambda k, _: ~F.array_contains(skip, k))
    columns = [F.when(F.col("statement_type") == name, F.element_at("m", c).try_cast(t)).alias(c) for name, (_, core) in STATEMENTS.items() for c, t in core.items()]
    reported = F.when(F.col("statement_type") == "earnings", F.try_to_date(F.element_at("m", "reportedDate")))
    return rows.select(key, "statement_type", d.alias("d"), reported.alias("reported_at"), *columns, F.when(F.size(raw) > 0, F.to_json(raw)).alias("raw")).where("d is not null")


def index_json(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Daily index bars as macro rows: key, d, value (the close), o, h, l; rows with a missing number are dropped."""
    rows = keyed_series(payloads, key, payload, "Time Series (Daily)", {"value": "4. close", "o": "1. open", "h": "2. high", "l": "3. low"})
    return rows.dropna(subset=["value", "o", "h", "l"])


def monthly_json(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """A payload {data: [{date, value}]} as key, d, value; entries without a date or a number are dropped."""
    rows = payloads.select(key, F.explode(F.from_json(F.get_json_object(payload, "$.data"), "array<struct<date:string,value:string>>")).alias("e"))
    return rows.select(key, F.try_to_date("e.date").alias("d"), F.col("e.value").try_cast("double").alias("value")).dropna(subset=["d", "value"])


def snapshot_value(m: Column, name: str, kind: str = "double") -> Column:
    """A field of a flat map; 'None', '-' and '' are null."""
    text = F.element_at(m, name)
    return F.when(~text.isin("None", "-", ""), text).try_cast(kind)


def listing(rows: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns equal the given texts, whatever their case."""
    for column, value in wanted.items():
        rows = rows.where(F.lower(column) == value.lower())
    return rows


def macro_csv(lines: DataFrame, line: str) -> DataFrame:
    """Two-column CSV lines as (d, value); '.' and whatever is no date or number is dropped."""
    cells = F.split(line, ",")
    return lines.select(F.try_to_date(F.trim(cells[0])).alias("d"), F.trim(F.get(cells, F.lit(1))).try_cast("double").alias("value")).dropna()


def snapshot_manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-independent checksum of each table, to verify a restored one."""
    out = None
    for name, df in frames.items():
        total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("string").alias("checksum")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def ingest(catalog: DataFrame, stored: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column], path: str) -> DataFrame:
    """Upsert values, record findings, materialise what none touches; all three are written below ``path``.

    Returns a row per catalogued series with values: stored, findings, materialised, total and last_d.
    ``keys`` are the series and the date.
    """
    from chronopanel.operators.tables import upsert

    series, time = keys
    upsert(stored, new, keys, [F.lit(0)]).write.parquet(f"{path}/values")
    values = stored.sparkSession.read.schema(stored.schema).parquet(f"{path}/values")
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    values.select(*keys, F.explode(broken).alias("rule")).write.parquet(f"{path}/findings")
    findings = stored.sparkSession.read.parquet(f"{path}/findings")
    values.join(findings.select(*keys), keys, "left_anti").write.parquet(f"{path}/series")
    clean = stored.sparkSession.read.schema(stored.schema).parquet(f"{path}/series")
    count = lambda df, *more: df.groupBy(series).agg(*more)
    out = catalog.join(count(values, F.count(F.lit(1)).alias("stored")), series)
    out = out.join(count(findings, F.count(F.lit(1)).alias("findings")), series, "left")
    out = out.join(count(clean, F.count(F.lit(1)).alias("materialised"), F.sum("value").alias("total"), F.max(time).alias("last_d")), series, "left")
    return out.fillna(0, ["findings", "materialised"])
