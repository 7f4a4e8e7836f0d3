"""Per-symbol indicators over a price table (symbol, trade_date, close).

Windows give every row its own value; an indicator is null until enough rows
precede it. Symbols are partitions, so a symbol's rows meet in one task: a
series has as many rows as trading days, whatever the number of symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RETURN_DAYS = (3, 5, 10, 20)
TRADING_DAYS = 252


def usable(prices: DataFrame) -> DataFrame:
    """Rows with a close, one for each symbol and day."""
    return prices.where("close is not null and symbol is not null and trade_date is not null")


def by_day() -> W:
    return W.partitionBy("symbol").orderBy("trade_date")


def last(p: int) -> W:
    return by_day().rowsBetween(-(p - 1), 0)


def full(c: Column, p: int) -> Column:
    """c where p rows are there, else null."""
    return F.when(F.count("close").over(last(p)) == p, c)


def sma(p: int) -> Column:
    return full(F.round(F.avg("close").over(last(p)), 4), p)


def n_day_return(n: int) -> Column:
    """Percent change to the close n rows before; null without it or if it is 0."""
    before = F.lag("close", n).over(by_day())
    return F.when(before != 0, F.round((F.col("close") - before) / F.abs(before) * 100, 4))


def with_changes(prices: DataFrame) -> DataFrame:
    """close minus the previous close, and the simple return on its absolute value."""
    before = F.lag("close").over(by_day())
    out = prices.withColumn("delta", F.col("close") - before)
    return out.withColumn("ret", F.when(before != 0, F.col("delta") / F.abs(before)))


def rsi(p: int = 14) -> Column:
    """Relative strength with simple means of the last p gains and losses; needs p + 1 closes."""
    gain = F.sum(F.greatest("delta", F.lit(0.0))).over(last(p)) / p
    loss = F.sum(F.greatest(-F.col("delta"), F.lit(0.0))).over(last(p)) / p
    value = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(F.round(100 - 100 / (1 + gain / loss), 2))
    return F.when(F.count("delta").over(last(p)) == p, value)


def volatility(p: int = 20) -> Column:
    """Annualised sample deviation of the last p returns in percent; needs p + 1 closes."""
    value = F.round(F.stddev_samp("ret").over(last(p)) * F.lit(TRADING_DAYS**0.5) * 100, 2)
    return F.when((F.count("delta").over(last(p)) == p) & (F.count("ret").over(last(p)) >= 2), value)


def indicators(prices: DataFrame) -> DataFrame:
    """Every windowed indicator of every row."""
    out = with_changes(usable(prices))
    mid, dev = F.avg("close").over(last(20)), F.stddev_pop("close").over(last(20))
    out = out.withColumns(
        {"ma5": sma(5), "ma20": sma(20), "rsi_14": rsi(), "volatility_20d": volatility()}
        | {f"pct_{n}d": n_day_return(n) for n in RETURN_DAYS}
        | {
            "boll_upper": full(F.round(mid + 2 * dev, 4), 20),
            "boll_middle": full(F.round(mid, 4), 20),
            "boll_lower": full(F.round(mid - 2 * dev, 4), 20),
            "boll_bandwidth": full(F.when(mid != 0, F.round(4 * dev / mid * 100, 4)), 20),
        }
    )
    out = out.withColumns({"above_ma5": F.col("close") > F.col("ma5"), "above_ma20": F.col("close") > F.col("ma20")})
    return out.withColumn("trend_signal", trend()).drop("delta", "ret")


def trend() -> Column:
    """Five votes: close against both averages, their cross, strength beyond 60 or 40, five-day move beyond 2 %."""
    pairs = [("close", "ma5"), ("close", "ma20"), ("ma5", "ma20")]
    up = [F.col(a) > F.col(b) for a, b in pairs] + [F.col("rsi_14") > 60, F.col("pct_5d") > 2]
    down = [F.col(a) < F.col(b) for a, b in pairs] + [F.col("rsi_14") < 40, F.col("pct_5d") < -2]
    votes = lambda cs: sum(F.coalesce(c.cast("int"), F.lit(0)) for c in cs)
    return F.when(votes(up) >= 3, "bullish").when(votes(down) >= 3, "bearish").otherwise("neutral")


def latest(df: DataFrame, key: str = "symbol", by: str = "trade_date") -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(by)))).where("__n = 1").drop("__n")


def ema(closes: Column, p: int) -> Column:
    """Exponential average of an ordered array: seeded with the mean of the first p, rounded at the end."""
    mean = F.aggregate(F.slice(closes, 1, p), F.lit(0.0), lambda s, x: s + x) / p
    step = F.aggregate(F.slice(closes, F.lit(p + 1), F.greatest(F.size(closes) - p, F.lit(0))), mean, lambda e, x: (x - e) * F.lit(2 / (p + 1)) + e)
    return F.when(F.size(closes) >= p, F.round(step, 4))


def latest_macd(prices: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(symbol, ema12, ema26, macd_line, signal_line, histogram) at each symbol's last day.

    The signal is the mean of the line's last values, not an exponential average.
    """
    pairs = usable(prices).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("trade_date", "close"))).alias("h"))
    out = pairs.select("symbol", F.transform("h", lambda x: x["close"].cast("double")).alias("c"))
    line = lambda c: ema(c, fast) - ema(c, slow)
    offsets = F.sequence(F.lit(0), F.least(F.lit(signal), F.size("c") - slow + 1) - 1)
    values = F.when(F.size("c") >= slow, F.transform(offsets, lambda k: line(F.slice("c", F.lit(1), F.size("c") - k))))
    out = out.withColumns({f"ema{fast}": ema(F.col("c"), fast), f"ema{slow}": ema(F.col("c"), slow), "v": values})
    out = out.withColumn("macd_line", F.round(F.col(f"ema{fast}") - F.col(f"ema{slow}"), 4))
    out = out.withColumn("signal_line", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v"), 4))
    out = out.withColumn("signal_line", F.when(F.size("c") >= slow, F.col("signal_line")))
    return out.withColumn("histogram", F.round(F.col("macd_line") - F.col("signal_line"), 4)).drop("c", "v")


def fill_pct_change(rows: DataFrame) -> DataFrame:
    """pct_change_1d from the previous close where it is missing and both closes are usable."""
    before = F.lag("close").over(by_day())
    filled = F.when((before != 0) & F.col("close").isNotNull(), F.round((F.col("close") - before) / before * 100, 4))
    return rows.withColumn("pct_change_1d", F.coalesce("pct_change_1d", filled))


def last_history(prices: DataFrame, n: int = 5) -> DataFrame:
    """(symbol, history): the n latest (trade_date, close) of each symbol, latest first."""
    ranked = prices.withColumn("__n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("trade_date")))).where(F.col("__n") <= n)
    items = F.array_sort(F.collect_list(F.struct("__n", "trade_date", "close")))
    return ranked.groupBy("symbol").agg(F.transform(items, lambda x: F.struct(x["trade_date"], x["close"])).alias("history"))


def signal_priority(rows: DataFrame) -> DataFrame:
    """One market signal a symbol: market_api before index_daily; of market_api the last, of index_daily the first."""
    api = (F.col("source_type") == "market_api").cast("int")
    order = F.when(api == 1, -F.col("ord")).otherwise(F.col("ord"))
    w = W.partitionBy("symbol").orderBy(F.desc(api), order)
    return rows.where(F.col("source_type").isin("market_api", "index_daily")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
