"""Price levels: pivots, retracements, clusters, ladders, break potential, trade zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSIC = ("p", "r1", "s1", "r2", "s2", "r3", "s3")
#: Retracements and extensions.
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.272, 1.618)


def pivots(periods: DataFrame) -> DataFrame:
    """(symbol, name, price): classic and Fibonacci pivots of each symbol's high, low and close."""
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    p, span = (h + lo + c) / 3, h - lo
    classic = {"p": p, "r1": 2 * p - lo, "s1": 2 * p - h, "r2": p + span, "s2": p - span, "r3": h + 2 * (p - lo), "s3": lo - 2 * (h - p)}
    fib = {f"f{side}{i + 1}": p + sign * r * span for side, sign in (("r", 1), ("s", -1)) for i, r in enumerate((0.382, 0.618, 1.0))}
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), x.alias("price")) for n, x in (classic | fib).items())))
    return periods.select("symbol", levels.alias("l")).select("symbol", "l.name", "l.price")


def fibonacci(bars: DataFrame, lookback: int = 250) -> DataFrame:
    """Retracements between the first highest high and first lowest low of the last bars; upward if the low came first."""
    b = bars.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))).where(F.col("r") <= lookback)
    ends = b.groupBy("symbol").agg(F.min_by("day", F.struct(-F.col("high"), "day")).alias("top_day"), F.max("high").alias("top"), F.min_by("day", F.struct("low", "day")).alias("bottom_day"), F.min("low").alias("bottom"))
    up = F.col("bottom_day") < F.col("top_day")
    span = F.col("top") - F.col("bottom")
    # an extension lies beyond the end by what exceeds the whole span
    e = ends.withColumn("ratio", F.explode(F.array(*map(F.lit, RATIOS + EXTENSIONS))))
    share = F.when(F.col("ratio") > 1, 1 - F.col("ratio")).otherwise(F.col("ratio"))
    return e.select("symbol", up.alias("upward"), "top", "bottom", "ratio", F.when(up, F.col("top") - share * span).otherwise(F.col("bottom") + share * span).alias("price"))


def cluster(levels: DataFrame, tolerance: Column) -> DataFrame:
    """Single linkage in one dimension: a level opens a cluster if it lies more than ``tolerance`` above the one before.

    (symbol, cluster, price mean, name of the lowest priority, names in order, n).
    """
    w = Window.partitionBy("symbol").orderBy("price", "priority", "name")
    new = F.coalesce((F.col("price") - F.lag("price").over(w) > tolerance).cast("int"), F.lit(0))
    l = levels.withColumn("new", new).withColumn("cluster", F.sum("new").over(w))
    named = F.transform(F.array_sort(F.collect_list(F.struct("priority", "name"))), lambda x: x["name"])
    return l.groupBy("symbol", "cluster").agg(F.avg("price").alias("price"), named.alias("names"), F.count("*").alias("n")).withColumn("name", F.col("names")[0])


def merged(levels: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Greedy clusters of (symbol, price, name, weight, touches): ascending levels join the open cluster if they lie within the tolerance above its running mean.

    (symbol, cluster, mean, price, score, names, n, touches); the price is weighted
    by the members' weights, whose sum is the score. The order decides, so each
    symbol's sorted levels are folded; their number is that of its candidates, not
    of its bars. ``tolerances`` has (symbol, tolerance).
    """
    start = F.array().cast("array<struct<sum:double,n:int,weighted:double,score:double,touches:bigint,names:array<string>>>")

    def one(x: Column) -> Column:
        return F.struct(x["price"].alias("sum"), F.lit(1).alias("n"), (x["price"] * x["weight"]).alias("weighted"), x["weight"].alias("score"), x["touches"].alias("touches"), F.array(x["name"]).alias("names"))

    def step(acc: Column, x: Column) -> Column:
        last, new = F.element_at(acc, -1), one(x)
        joins = (F.size(acc) > 0) & (x["price"] - last["sum"] / last["n"] <= F.col("tolerance"))
        grown = F.struct(*((last[c] + new[c]).alias(c) for c in ("sum", "n", "weighted", "score", "touches")), F.concat(last["names"], new["names"]).alias("names"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    each = F.struct(F.col("price").cast("double").alias("price"), "name", F.col("weight").cast("double").alias("weight"), F.col("touches").cast("long").alias("touches"))
    groups = levels.groupBy("symbol").agg(F.array_sort(F.collect_list(each)).alias("all")).join(tolerances, "symbol")
    found = F.posexplode(F.aggregate("all", start, step)).alias("cluster", "c")
    mean = F.col("c.sum") / F.col("c.n")
    return groups.select("symbol", found).select("symbol", "cluster", mean.alias("mean"), F.when(F.col("c.score") > 0, F.col("c.weighted") / F.col("c.score")).otherwise(mean).alias("price"), F.col("c.score").alias("score"), F.array_join("c.names", "|").alias("names"), F.col("c.n").alias("n"), F.col("c.touches").alias("touches"))


def round_levels(last: DataFrame, step: int = 50, share: float = 0.06) -> DataFrame:
    """Multiples of ``step`` within a share of each symbol's close; multiples of 100 weigh twice as much."""
    lo, hi = F.ceil(F.col("close") * (1 - share) / step) * step, F.floor(F.col("close") * (1 + share) / step) * step
    return last.where(lo <= hi).select("symbol", F.explode(F.sequence(lo, hi, F.lit(step).cast("long"))).alias("price")).withColumn("weight", F.when(F.col("price") % 100 == 0, 0.5).otherwise(0.25))


def live_levels(levels: DataFrame, live: DataFrame, each: int = 3) -> DataFrame:
    """Levels (symbol, name, price) against a live price: (symbol, name, price, role, rank, gap).

    ``live`` has (symbol, close, live, margin). Within the margin a level is being
    touched; beyond it, the nearest ``each`` above are resistance and below support.
    A level between the last close and the live price has been crossed today, which
    is a row of its own.
    """
    l = levels.join(live, "symbol")
    over = F.col("price") - F.col("live")
    role = F.when(F.abs(over) <= F.col("margin"), "touching").when(over > 0, "resistance").otherwise("support")
    both = F.array_compact(F.array(role, F.when((F.col("price") - F.col("close")) * over < 0, F.lit("crossed"))))
    l = l.select("symbol", "name", "price", F.explode(both).alias("role"), F.abs(over).alias("distance"), (F.col("price") / F.col("live") - 1).alias("gap"))
    rank = F.row_number().over(Window.partitionBy("symbol", "role").orderBy("distance", "name"))
    return l.withColumn("rank", rank).where(F.col("role").isin("touching", "crossed") | (F.col("rank") <= each)).select("symbol", "name", "price", "role", "rank", "gap")


def break_score(reach: Column, strength: Column) -> Column:
    """Between 0 and 1: how far the expected move reaches, at most the whole way, times the momentum's strength in percent, under a root."""
    return F.when(reach.isNotNull() & strength.isNotNull(), F.sqrt(F.least(F.lit(1.0), reach) * F.greatest(F.lit(0.0), F.least(F.lit(100.0), strength)) / 100))


def break_label(score: Column) -> Column:
    return F.when(score >= 2 / 3, "strong").when(score >= 1 / 3, "medium").when(score.isNotNull(), "weak")


def break_potential(levels: DataFrame, moves: DataFrame) -> DataFrame:
    """(symbol, name, price, reach, score, label) of levels against (symbol, close, move, strength).

    Distances and the expected ``move`` are shares of the price. Null where the
    close or the move is not positive or the level is the close itself.
    """
    l = levels.join(moves, "symbol")
    distance = F.abs(F.col("price") / F.col("close") - 1)
    l = l.withColumn("reach", F.when((F.col("close") > 0) & (F.col("move") > 0) & (distance > 0), F.col("move") / distance))
    l = l.withColumn("score", break_score(F.col("reach"), F.col("strength")))
    return l.select("symbol", "name", "price", "reach", "score", break_label(F.col("score")).alias("label"))


def trade_zones(forecasts: DataFrame, capital: float, risk_percent: float) -> DataFrame:
    """Buying and selling zones around a forecast (symbol, close, mean, error, atr), all as shares of the close, with stop and units."""
    near, band = F.col("close") * (1 + F.col("mean")), F.col("close") * F.col("error")
    f = forecasts.withColumns({"near": near, "band": band, "range": F.col("atr") * F.col("close")})
    at = lambda share: F.col("near") + share * F.col("band")
    f = f.withColumns({"buy_low": at(-0.72), "buy_high": at(-0.38), "sell_low": at(0.35), "sell_high": at(0.72)})
    f = f.withColumns({"entry": (F.col("buy_low") + F.col("buy_high")) / 2, "stop": F.col("buy_low") - F.greatest(F.col("range") * 1.5, F.col("band") * 0.18)})
    units = F.lit(capital * risk_percent / 100) / F.greatest(F.lit(1.0), F.col("entry") - F.col("stop"))
    return f.select("symbol", "near", "band", "buy_low", "buy_high", "sell_low", "sell_high", "entry", "stop", units.alias("units"))


def read_quotes(quotes: DataFrame) -> DataFrame:
    """(id, spread, has_range, position, change) of (id, bid, ask, low, high, previous).

    A day's range counts only if it holds the ask and its low is not absurd (under
    half the ask); the previous close, if it lies within half the range around it.
    """
    ask, low, high, previous = (F.col(c) for c in ("ask", "low", "high", "previous"))
    band = high - low
    whole = F.coalesce((low > 0) & (high > low) & (low >= ask * 0.5) & ask.between(low, high), F.lit(False))
    trusted = whole & (previous > 0) & previous.between(low - band * 0.5, high + band * 0.5)
    position = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (ask - low) / band * 100))
    return quotes.select("id", (ask - F.col("bid")).alias("spread"), whole.alias("has_range"), F.when(whole, position).alias("position"), F.when(trusted, ask / previous - 1).alias("change"))


def ladder(levels: DataFrame, last: DataFrame, each: int = 3, share: float = 0.12) -> DataFrame:
    """The nearest levels above and below each symbol's close, within a share of it."""
    l = levels.join(last.select("symbol", "close"), "symbol").where(F.abs(F.col("price") / F.col("close") - 1) <= share)
    l = l.withColumns({"side": F.when(F.col("price") > F.col("close"), "resistance").otherwise("support"), "distance": F.abs(F.col("price") - F.col("close"))})
    rank = F.row_number().over(Window.partitionBy("symbol", "side").orderBy("distance", "name"))
    return l.withColumn("rank", rank).where(F.col("rank") <= each).select("symbol", "side", "rank", "name", "price", (F.col("price") / F.col("close") - 1).alias("gap"))


def nearest(levels: DataFrame, last: DataFrame) -> DataFrame:
    """Highest level below and lowest above each symbol's close."""
    l = levels.join(last.select("symbol", "close"), "symbol")
    return l.groupBy("symbol").agg(F.max(F.when(F.col("price") < F.col("close"), F.col("price"))).alias("support"), F.min(F.when(F.col("price") > F.col("close"), F.col("price"))).alias("resistance"))


def trend_lines(swing: DataFrame, bars: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """For each symbol and kind, the line through two of the last five swings that is best: not broken by a later close, then with most touches, then with the latest second swing.

    Five swings make ten lines, so the pairs are bounded; closes are joined by symbol to these few.
    """
    r = F.row_number().over(Window.partitionBy("symbol", "kind").orderBy(F.desc("day")))
    at = bars.select("symbol", "day", "close", F.row_number().over(Window.partitionBy("symbol").orderBy("day")).alias("x"))
    s = swing.withColumn("r", r).where("r <= 5").join(at.select("symbol", "day", "x"), ["symbol", "day"]).select("symbol", "kind", "x", "price")
    a, b = s.select("symbol", "kind", F.col("x").alias("xa"), F.col("price").alias("pa")), s.select("symbol", "kind", F.col("x").alias("xb"), F.col("price").alias("pb"))
    lines = a.join(b, ["symbol", "kind"]).where("xa < xb").withColumn("slope", (F.col("pb") - F.col("pa")) / (F.col("xb") - F.col("xa")))
    on = lambda x: F.col("pa") + F.col("slope") * (x - F.col("xa"))
    touched = lines.join(s, ["symbol", "kind"]).groupBy(*lines.columns).agg(F.sum((F.abs(F.col("price") / on(F.col("x")) - 1) <= tolerance).cast("int")).alias("touches"))
    closes = at.select("symbol", F.col("x").alias("xc"), "close")
    beyond = F.when(F.col("kind") == "low", F.col("close") < on(F.col("xc")) * (1 - tolerance)).otherwise(F.col("close") > on(F.col("xc")) * (1 + tolerance))
    judged = touched.join(closes, "symbol").where("xc > xb").groupBy(*touched.columns).agg(F.max(beyond.cast("int")).alias("broken"))
    best = F.max_by(F.struct("xa", "xb", "pa", "pb", "touches", "broken"), F.struct((1 - F.col("broken")), "touches", "xb", -F.col("xa")))
    return judged.groupBy("symbol", "kind").agg(best.alias("l")).select("symbol", "kind", "l.*")
