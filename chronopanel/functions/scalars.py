"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def return_class(r: Column, weak: float, strong: float) -> Column:
    """strong_down, weak_down, neutral, weak_up or strong_up."""
    return F.when(r < -strong, "strong_down").when(r < -weak, "weak_down").when(r <= weak, "neutral").when(r <= strong, "weak_up").when(r > strong, "strong_up")


def sane_number(text: Column, limit: float = 1e12) -> Column:
    """A number, or null where it can't be read or its size is at or over the limit."""
    x = text.try_cast("double")
    return F.when(F.abs(x) < limit, x)


#: Names that stand for a missing class, and names that mean another one.
MISSING_CLASSES = ("NONE", "OTHER", "N/A", "-", "")
CLASS_ALIASES = {"FINANCIALS": "FINANCIAL SERVICES", "CAPITAL MARKETS": "FINANCIAL SERVICES"}


def class_name(text: Column) -> Column:
    """Trimmed upper-case class name; missing ones null, aliases resolved."""
    name = F.upper(F.trim(text))
    out = F.when(~name.isin(*MISSING_CLASSES), name)
    for alias, known in CLASS_ALIASES.items():
        out = F.when(out == alias, known).otherwise(out)
    return out


def slug(text: Column) -> Column:
    """Runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def half(text: Column) -> Column:
    """'a' or 'b' by the first byte of the SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int") % 2 == 0, "a").otherwise("b")


def adjusted(price: Column, close: Column, adjusted_close: Column) -> Column:
    """A price scaled by adjusted close / close where close is positive."""
    return F.when(close > 0, price * F.coalesce(adjusted_close, close) / close).otherwise(price)


def restricted(expression: str, inputs: tuple[str, ...]) -> Column:
    """An expression of + - * / over the named inputs; null in gives null, and so does division by zero."""
    import ast

    def walk(node) -> Column:
        match node:
            case ast.Expression(body=b):
                return walk(b)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(walk(a), walk(b))
            case ast.BinOp(left=a, op=ast.Add(), right=b):
                return walk(a) + walk(b)
            case ast.BinOp(left=a, op=ast.Sub(), right=b):
                return walk(a) - walk(b)
            case ast.BinOp(left=a, op=ast.Mult(), right=b):
                return walk(a) * walk(b)
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -walk(a)
            case ast.Name(id=name) if name in inputs:
                return F.col(name)
            case ast.Constant(value=v) if type(v) in (int, float):
                return F.lit(v)
        raise ValueError(f"not allowed in {expression!r}: {ast.dump(node)}")

    return walk(ast.parse(expression, mode="eval"))


def rule_predicate(rule: dict) -> Column:
    """A declared rule {attribute, op, value} as a condition; an unknown op is refused.

    A null attribute never meets ``ne``.
    """
    c, op, v = F.col(rule["attribute"]), rule["op"], rule.get("value")
    kinds = {
        "eq": lambda: c == v, "ne": lambda: c.isNotNull() & (c != v), "in": lambda: c.isin(*v), "is_missing": lambda: c.isNull(), "lt": lambda: c < v, "lte": lambda: c <= v, "gt": lambda: c > v, "gte": lambda: c >= v, "between": lambda: c.between(*v),
    }
    if op not in kinds:
        raise ValueError(f"unknown op {op!r}")
    return F.coalesce(kinds[op](), F.lit(False))


def adaptive_thresholds(vol: Column, horizon: int, rank: Column) -> tuple[Column, Column]:
    """Weak and strong thresholds of half and one and a half deviations over the horizon, wider in the top tenth of volatility and narrower in the lowest."""
    scale = F.when(rank > 0.9, 1.2).when(rank < 0.1, 0.8).otherwise(1.0)
    sigma = vol * F.sqrt(F.lit(horizon / 252)) * scale
    return 0.5 * sigma, 1.5 * sigma


def quantile_confidence(iqr: Column, usual_iqr: Column, q50: Column) -> Column:
    """0.7 for a narrow band and 0.3 for a large centre; 0.5 without a usual width."""
    return F.when(usual_iqr <= 0, 0.5).otherwise(0.7 * F.exp(-iqr / usual_iqr) + 0.3 * F.least(F.lit(1.0), F.abs(q50) / usual_iqr))


def class_confidence(p: Column, n: int) -> Column:
    """Half of one minus the normalised entropy, half of the margin between the two likeliest."""
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    ordered = F.sort_array(p, asc=False)
    return 0.5 * (1 - entropy / F.log(F.lit(float(n)))) + 0.5 * (ordered[0] - ordered[1])


def clamp_quantiles(low: Column, mid: Column, high: Column) -> tuple[Column, Column]:
    """Outer quantiles that do not cross the middle one."""
    return F.least(low, mid), F.greatest(mid, high)


def _root_share(shares: str, volume: str) -> Column:
    """Square root of the part of the volume that an order takes; null without a volume."""
    return F.sqrt(F.col(shares).cast("double") / F.nullif(volume, F.lit(0)))


def trade_cost(shares: str, price: str, volume: str, per_trade: int, per_share: int, least: int, most: int, spread: float, impact: float) -> dict[str, Column]:
    """Commission within its bounds, half-spread in basis points, and an impact with the root of the share of volume."""
    value = F.col(shares) * F.col(price)
    commission = F.least(F.greatest(per_trade + per_share * F.col(shares), F.lit(least)), F.lit(most)).cast("long")
    return {"commission": commission, "spread": value * spread / 10000, "impact": F.coalesce(_root_share(shares, volume) * impact * value, F.lit(0.0))}


def borrow_fee(shares: str, price: str, annual_rate: float, days: int = 252) -> Column:
    """Fee of one day for shares held short."""
    return F.col(shares) * F.col(price) * F.lit(annual_rate / days)


def fill_price(buy: Column, price: str, shares: str, volume: str, spread: Column, fixed: float, participation: float, volatility: float) -> Column:
    """Market orders fill against the trader by a fixed part, the root of the share of volume, and volatility."""
    slip = fixed + F.coalesce(_root_share(shares, volume) * participation, F.lit(0.0)) + F.coalesce(spread * volatility, F.lit(0.0))
    return F.when(buy, F.col(price) * (1 + slip)).otherwise(F.col(price) * (1 - slip))


def limit_fill(buy: Column, price: str, limit: str) -> Column:
    """Limit orders fill at their limit, or not at all (null) where the price is beyond it."""
    return F.when(buy & (F.col(price) <= F.col(limit)) | ~buy & (F.col(price) >= F.col(limit)), F.col(limit))


def position_sizes(capital: float, price: str, win_rate: str, win_loss: str, volatility: str, kelly: float, target: float, per_asset: float) -> dict[str, Column]:
    """Whole shares by fractional Kelly, volatility target and capped risk parity; none where an input is missing or has no edge."""
    rate, ratio, vola = F.col(win_rate), F.col(win_loss), F.col(volatility)
    edge = (rate * ratio - (1 - rate)) / ratio
    shares = lambda holds, part: F.coalesce(F.when(holds, (capital * part / F.col(price)).cast("long")), F.lit(0).cast("long"))
    return {
        "kelly_shares": shares(edge > 0, edge * kelly),
        "vol_target": shares(vola > 0, target / vola),
        "risk_parity": shares(vola > 0, F.least(F.lit(1.0), per_asset / vola)),
    }


def block_reason(held: Column, value: Column, total: Column, equity: Column, peak: Column, positions: int, weight: int, drawdown: int) -> Column:
    """Why a new position is not allowed: too many held, too large a percentage of the total, or too deep a drawdown."""
    return F.when(held >= positions, "max_positions").when(100 * value > weight * total, "max_weight").when(100 * (peak - equity) > drawdown * peak, "drawdown")


def exit_reason(gain: Column, entry: Column, stop_percent: int = 10, take_percent: int = 20) -> Column:
    """stop_loss or take_profit where a position's gain reaches either bound, else null."""
    return F.when(100 * gain <= -stop_percent * entry, "stop_loss").when(100 * gain >= take_percent * entry, "take_profit")
