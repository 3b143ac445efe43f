"""Feature tables, forward-looking labels and rule mining over bars.

Features and labels are lines (see barloom.plans.lines); statistics over them are aggregates.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalar import max_of, min_of
from barloom.operators.indicators import CLOSE, HIGH, LOW, OPEN, VOLUME, gain, loss
from barloom.plans.lines import Line, col, cumulative, fold, lag, last_known, lead, op, over, rolling, row_number
from barloom.plans.ordered import in_order, numbered_rows

Lines = dict[str, Line]

# Features: exponential means that start from the first value


def ewm(x, alpha: float) -> Line:
    return fold("FirstEma", x, params=(alpha,))


def ewm_span(x, span: int) -> Line:
    return ewm(x, 2.0 / (span + 1))


def feature_ema(period: int) -> Lines:
    e = ewm_span(CLOSE, period)
    return {f"ema{period}": e, f"dist_ema{period}": (CLOSE - e) / e}


def feature_rsi(period: int = 14) -> Lines:
    up, down = ewm(gain(CLOSE, 1), 1.0 / period), ewm(loss(CLOSE, 1), 1.0 / period)
    return {f"rsi{period}": 100 - 100 / (1 + up / down)}


def feature_macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Lines:
    m = ewm_span(CLOSE, fast) - ewm_span(CLOSE, slow)
    s = ewm_span(m, signal)
    return {"macd": m, "macd_signal": s, "macd_hist": m - s}


def feature_dmi(period: int = 14) -> Lines:
    up, down = HIGH - lag(HIGH, 1), lag(LOW, 1) - LOW
    plus = op("CASE WHEN {0} > {1} AND {0} > 0 THEN {0} WHEN {0} IS NOT NULL THEN CAST(0 AS DOUBLE) END", up, down)
    minus = op("CASE WHEN {1} > {0} AND {1} > 0 THEN {1} WHEN {1} IS NOT NULL THEN CAST(0 AS DOUBLE) END", up, down)
    size = ewm(max_of(HIGH - LOW, abs(HIGH - lag(CLOSE, 1)), abs(LOW - lag(CLOSE, 1))), 1.0 / period)
    a, b = 100 * ewm(plus, 1.0 / period) / size, 100 * ewm(minus, 1.0 / period) / size
    dx = 100 * abs(a - b) / (a + b)
    return {"plus_di": a, "minus_di": b, "dx": dx, "adx": ewm(dx, 1.0 / period)}


def feature_volume(window: int = 50) -> Lines:
    return {"vol_z": (VOLUME - rolling("avg", window, VOLUME)) / rolling("stddev_samp", window, VOLUME)}


def feature_levels(window: int = 20) -> Lines:
    low, high = rolling("min", window, LOW), rolling("max", window, HIGH)
    return {"dist_support": (CLOSE - low) / CLOSE, "dist_resist": (high - CLOSE) / CLOSE}


def feature_vwap(day: str = "day") -> Lines:
    """Cumulative price by volume over the rows of a key; give the day as part of the key."""
    typical = (HIGH + LOW + CLOSE) / 3
    v = cumulative("sum", typical * VOLUME) / cumulative("sum", VOLUME)
    return {"vwap": v, "dist_vwap": (CLOSE - v) / v}


def timeframe_features() -> Lines:
    return feature_ema(20) | feature_rsi() | feature_macd() | feature_dmi() | feature_volume() | feature_levels()


def bars_since(flag: Line) -> Line:
    n = row_number()
    return n - last_known(op("CASE WHEN {0} <> 0 THEN {1} END", flag, n))


def price_action(lookback: int = 20) -> Lines:
    """Candle ratios, breakouts of the bars before, gaps over three bars, sweeps of liquidity and market structure."""
    size = HIGH - LOW
    top = lag(rolling("max", lookback, HIGH), 1)
    bottom = lag(rolling("min", lookback, LOW), 1)
    up, down = CLOSE > top, CLOSE < bottom
    gap_up, gap_down = LOW - lag(HIGH, 2), lag(LOW, 2) - HIGH
    block = last_known(op("CASE WHEN {0} <> 0 THEN {1} END", (lag(CLOSE, 1) < lag(OPEN, 1)) * (CLOSE > lag(HIGH, 1)), lag(LOW, 1)))
    return {
        "body_ratio": abs(CLOSE - OPEN) / size, "upper_wick": (HIGH - max_of(OPEN, CLOSE)) / size, "lower_wick": (min_of(OPEN, CLOSE) - LOW) / size,
        "breakout_up": up, "breakout_down": down, "breakout_up_dist": (CLOSE - top) / CLOSE, "breakout_down_dist": (bottom - CLOSE) / CLOSE, "since_breakout_up": bars_since(up), "since_breakout_down": bars_since(down),
        "fvg_up": gap_up > 0, "fvg_down": gap_down > 0, "fvg_up_size": max_of(gap_up, 0) / CLOSE, "fvg_down_size": max_of(gap_down, 0) / CLOSE,
        "sweep_high": (HIGH > top) * (CLOSE < top), "sweep_low": (LOW < bottom) * (CLOSE > bottom),
        "higher_high": HIGH > lag(HIGH, 1), "lower_low": LOW < lag(LOW, 1), "orderblock_dist": (CLOSE - block) / CLOSE,
    }


def session_features(dt: str = "dt") -> dict[str, Column]:
    """Hour on a circle, day of the week (Monday is 0), London, New York, their overlap, and weekends."""
    hour, day = F.hour(dt) + F.minute(dt) / 60.0, F.weekday(dt)
    london, york = (hour >= 7) & (hour < 16), (hour >= 13) & (hour < 22)
    flag = lambda c: c.cast("int")
    return {"hour_sin": F.sin(2 * 3.141592653589793 * hour / 24), "hour_cos": F.cos(2 * 3.141592653589793 * hour / 24), "dow": day.cast("int"), "london": flag(london), "newyork": flag(york), "overlap": flag(london & york), "weekend": flag(day >= 5)}


def deltas(columns: list[str], windows: list[int]) -> Lines:
    return {f"delta_{w}_{c}": col(c) - lag(c, w) for c in columns for w in windows}


def dynamics(columns: list[str], windows: list[int]) -> Lines:
    out: Lines = {}
    for c in columns:
        for w in windows:
            d = col(c) - lag(c, w)
            out |= {f"{c}_d{w}": d, f"{c}_acc{w}": d - lag(d, w)}
        step = col(c) - lag(c, 1)
        out[f"{c}_turn"] = (step > 0) * (lag(step, 1) < 0) * (lag(step, 2) < 0) * (lag(step, 3) < 0)
    return out


def targets(horizons: list[int]) -> Lines:
    return {f"fwd_ret_{h}": lead(CLOSE, h) / CLOSE - 1 for h in horizons}


# Labels


def _first(conditions: list[str], lines: list[Line]) -> Line:
    """The number of the first condition that holds, from 1; null for none."""
    return op("CASE " + " ".join(f"WHEN {c} THEN CAST({k} AS DOUBLE)" for k, c in enumerate(conditions, 1)) + " END", *lines)


def first_hit_label(horizon: int, take: float, stop: float) -> Lines:
    """1 if a close gains `take` before one loses `stop` within the next bars; else 0; 0 without a full horizon."""
    ahead = [CLOSE, *(lead(CLOSE, k) for k in range(1, horizon + 1))]
    up = _first([f"{{{k}}} >= {{0}} * {1 + take}" for k in range(1, horizon + 1)], ahead)
    down = _first([f"{{{k}}} <= {{0}} * {1 - stop}" for k in range(1, horizon + 1)], ahead)
    return {"label": op("CASE WHEN {2} IS NULL THEN CAST(0 AS DOUBLE) WHEN {0} IS NOT NULL AND ({1} IS NULL OR {0} < {1}) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", up, down, lead(CLOSE, horizon + 1))}


def pessimistic_label(hold: int, take: float, stop: float) -> Lines:
    """-1, 0 or 1, and the bars to it: lows reach the stop or highs the target first; both in one bar is a loss."""
    lows, highs = [CLOSE, *(lead(LOW, k) for k in range(1, hold + 1))], [CLOSE, *(lead(HIGH, k) for k in range(1, hold + 1))]
    down = _first([f"{{{k}}} <= {{0}} * {1 - stop}" for k in range(1, hold + 1)], lows)
    up = _first([f"{{{k}}} >= {{0}} * {1 + take}" for k in range(1, hold + 1)], highs)
    label = op("CASE WHEN {0} IS NOT NULL AND ({1} IS NULL OR {0} <= {1}) THEN CAST(-1 AS DOUBLE) WHEN {1} IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", down, up)
    return {"label": label, "bars": op("coalesce(least({0}, {1}), {0}, {1})", down, up)}


def excursion(hold: int) -> Lines:
    """The largest rise and fall of the next bars, relative to the close, and when they came."""
    frame = f"ROWS BETWEEN 1 FOLLOWING AND {hold} FOLLOWING"
    high, low = over(f"max({{0}}) OVER ({{w}} {frame})", HIGH), over(f"min({{0}}) OVER ({{w}} {frame})", LOW)
    when = lambda x, best: _first([f"{{{k}}} = {{0}}" for k in range(1, hold + 1)], [best, *(lead(x, k) for k in range(1, hold + 1))])
    return {"mfe": high / CLOSE - 1, "mae": low / CLOSE - 1, "mfe_bar": when(HIGH, high), "mae_bar": when(LOW, low)}


# Rules: "col <= x & col >= y"

_CONDITION = re.compile(r"\s*([A-Za-z_]\w*)\s*(<=|>=)\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*")


def parse_rule(rule: str) -> list[tuple[str, str, float]]:
    out = []
    for part in rule.split("&"):
        m = _CONDITION.fullmatch(part)
        if not m:
            raise ValueError(f"not a condition: {part!r}")
        out.append((m[1], m[2], float(m[3])))
    return out


def simplify_rule(conditions: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The tightest bound of every column and direction."""
    best: dict[tuple[str, str], float] = {}
    for c, sign, v in conditions:
        best[c, sign] = v if (c, sign) not in best else (min if sign == "<=" else max)(best[c, sign], v)
    return [(c, sign, v) for (c, sign), v in sorted(best.items())]


def rule_mask(conditions: list[tuple[str, str, float]]) -> Column:
    tests = [(F.col(c) <= v) if sign == "<=" else (F.col(c) >= v) for c, sign, v in conditions]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def evaluate_rules(df: DataFrame, rules: dict[str, str], label: str, base: str | None = None) -> DataFrame:
    """rule, hits, wins, rate for every rule, all in one pass over the rows."""
    masks = {n: rule_mask(simplify_rule(parse_rule(r))) for n, r in rules.items()}
    pairs = F.explode(F.array(*(F.when(m, F.lit(n)) for n, m in masks.items())))
    hits = df.select(F.col(label).cast("double").alias("y"), pairs.alias("rule")).where("rule IS NOT NULL")
    return hits.groupBy("rule").agg(F.count("*").alias("hits"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("wins"), F.avg((F.col("y") > 0).cast("double")).alias("rate"))


# Statistics


def quantile_edges(df: DataFrame, columns: list[str], q: int = 5, accuracy: int | None = None) -> dict[str, list[float]]:
    """The distinct quantiles of each column: one aggregate, a few numbers.

    They are exact (linear between ranks), for which the aggregate keeps a count of every distinct value; with `accuracy` they
    are values whose rank is off by at most 1 / accuracy of the rows, from sketches of bounded size, as a huge table needs.
    """
    shares = [k / q for k in range(q + 1)]
    quantile = (lambda c: F.percentile(c, shares)) if accuracy is None else (lambda c: F.percentile_approx(c, shares, accuracy))
    row = df.agg(*(quantile(c).alias(c) for c in columns)).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def apply_bins(x: str, edges: list[float]) -> Column:
    """The bin of a value, from 0; the lowest edge is included; -1 outside or null."""
    out, v = F.lit(-1), F.col(x)
    for k in range(len(edges) - 2, -1, -1):
        low = (v >= edges[k]) if k == 0 else (v > edges[k])
        out = F.when(low & (v <= edges[k + 1]), k).otherwise(out)
    return F.when(v.isNull(), -1).otherwise(out)


def lift_table(df: DataFrame, label: str, bins: dict[str, Column], min_count: int = 1) -> DataFrame:
    """feature, bin, n, event_rate, lift (rate by the rate of all rows): rows are unpivoted and combined before the shuffle."""
    base = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    long = df.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), b.alias("bin")) for n, b in bins.items()))).alias("f"))
    out = long.where("f.bin >= 0").groupBy("f.feature", "f.bin").agg(F.count("*").alias("n"), F.avg("y").alias("event_rate"))
    return out.where(F.col("n") >= min_count).withColumn("lift", F.col("event_rate") / F.lit(base) if base else F.lit(None).cast("double"))


def best_bins(lift: DataFrame, top: int = 1) -> DataFrame:
    w = Window.partitionBy("feature").orderBy(F.desc("lift"), F.desc("n"), "bin")
    return lift.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def top_features(lift: DataFrame, top_n: int) -> DataFrame:
    return best_bins(lift).orderBy(F.desc("lift"), "feature").limit(top_n)


def rule_search(df: DataFrame, label: str, flags: dict[str, Column], sizes: tuple[int, ...] = (2, 3), min_count: int = 1) -> DataFrame:
    """rule, n, rate, lift of every combination of flags: rows become bit masks, equal ones are counted once, then tested."""
    names = list(flags)
    mask = reduce(lambda a, b: a + b, (F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(flags.values())))
    counted = df.select(mask.cast("long").alias("mask"), F.col(label).cast("double").alias("y")).groupBy("mask").agg(F.count("*").alias("n"), F.sum("y").alias("events"))
    rules = [(" & ".join(names[k] for k in c), sum(1 << k for k in c)) for s in sizes for c in itertools.combinations(range(len(names)), s)]
    tested = counted.select("n", "events", F.explode(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(m)) == m, F.lit(r)) for r, m in rules))).alias("rule")).where("rule IS NOT NULL")
    base = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    out = tested.groupBy("rule").agg(F.sum("n").alias("n"), (F.sum("events") / F.sum("n")).alias("rate"))
    return out.where(F.col("n") >= min_count).withColumn("lift", F.col("rate") / F.lit(base))


def mine_rule(df: DataFrame, label: str, candidates: list[tuple[str, str, float]], max_conditions: int = 3, min_hits: int = 20, decay: float = 0.5) -> tuple[list[tuple[str, str, float]], float]:
    """Greedy forward selection: every round scores all extensions of the rule in one aggregate; the needed hits shrink by `decay`."""
    rule: list[tuple[str, str, float]] = []
    best, need = -1.0, float(min_hits)
    for _ in range(max_conditions):
        rest = [c for c in candidates if c not in rule and sum(c[0] == r[0] for r in rule) < 2]
        if not rest:
            break
        aggregates = []
        for k, c in enumerate(rest):
            m = rule_mask([*rule, c])
            aggregates += [F.sum(m.cast("long")).alias(f"n{k}"), F.avg(F.when(m, (F.col(label) > 0).cast("double"))).alias(f"r{k}")]
        row = df.agg(*aggregates).first()
        scored = [(row[f"r{k}"], row[f"n{k}"], k) for k in range(len(rest)) if (row[f"n{k}"] or 0) >= need]
        if not scored or max(scored)[0] <= best:
            break
        best, _, k = max(scored, key=lambda x: (x[0], x[1], -x[2]))
        rule, need = [*rule, rest[k]], need * decay
    return simplify_rule(rule), best


def walk_forward(df: DataFrame, order: str, pnl: str, folds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The keys, fold, hits, win, ev over folds of (nearly) equal numbers of rows in order, each series by itself; fold k
    begins at row k * n // folds. Without keys the table is one series, which is numbered by ranges and in no single task.
    """
    if keys:
        w = Window.partitionBy(*keys)
        placed = df.withColumns({"_n": F.row_number().over(w.orderBy(order)) - 1, "_all": F.count("*").over(w)})
    else:
        placed = numbered_rows(df, order, "_n").withColumn("_all", F.lit(df.count()))
    fold_ = F.floor(((F.col("_n") + 1) * folds - 1) / F.col("_all")).cast("int")
    return placed.groupBy(*keys, fold_.alias("fold")).agg(F.count("*").alias("hits"), F.avg((F.col(pnl) > 0).cast("double")).alias("win"), F.avg(pnl).alias("ev"))


def walk_forward_stats(folds: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean and least rate of wins, mean outcome and all hits over the folds of `walk_forward`."""
    return folds.groupBy(*keys).agg(F.avg("win").alias("mean_win"), F.min("win").alias("min_win"), F.avg("ev").alias("mean_ev"), F.sum("hits").alias("total_hits"))


RATIOS = "SELECT symbol, round(avg(x) / nullif(stddev_pop(x), 0), 6) AS sharpe, round(avg(x) / nullif(stddev_pop(CASE WHEN x < 0 THEN x END), 0), 6) AS sortino FROM @values GROUP BY symbol"
LOSS_STREAKS = "SELECT symbol, round(avg(loss), 6) AS loss_rate, CAST(max(CASE WHEN loss = 1 THEN n END) AS BIGINT) AS max_losses, round(min(x), 6) AS worst FROM (SELECT *, sum(loss) OVER (PARTITION BY symbol, island ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, sum(1 - loss) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (SELECT symbol, dt, x, CASE WHEN x < 0 THEN 1 ELSE 0 END AS loss FROM @values))) GROUP BY symbol"


def events(rows: DataFrame, gap_seconds: int, keys: list[str], dt: str = "dt") -> DataFrame:
    """The rows with `event`, the number of the cluster they fall in: a new one begins after a gap of more than `gap_seconds`."""
    w = Window.partitionBy(*keys).orderBy(dt)
    far = F.timestamp_diff("MICROSECOND", F.lag(dt).over(w), F.col(dt)) > gap_seconds * 1_000_000
    return rows.withColumn("_far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("event", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


#: Scores at the three anchors, and how near to 0 and 1 a score may come.
_ANCHORS, _EDGE = (0.25, 0.5, 0.75), 1e-12


def score_higher(x: Column, bad: float, mid: float, good: float, k_low: float = 1.0, k_high: float = 1.0) -> Column:
    """0 to 1: a quarter at `bad`, a half at `mid`, three quarters at `good`, straight between them; below `bad` it decays, above
    `good` it nears 1, by k_low and k_high for each unit of x. No number, or anchors out of order: as good as 0."""
    if not bad < mid < good:
        return F.lit(_EDGE)
    at_bad, at_mid, at_good = map(F.lit, _ANCHORS)
    low = at_bad * F.exp(-max(_EDGE, k_low) * (F.lit(bad) - x))
    high = at_good + (1 - at_good) * (1 - F.exp(-max(_EDGE, k_high) * (x - F.lit(good))))
    inside = F.when(x < mid, at_bad + (at_mid - at_bad) * (x - bad) / (mid - bad)).otherwise(at_mid + (at_good - at_mid) * (x - mid) / (good - mid))
    score = F.when(x <= bad, low).when(x >= good, high).otherwise(inside)
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(usable, F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), score))).otherwise(F.lit(_EDGE))


def score_lower(x: Column, good: float, mid: float, bad: float, k_low: float = 1.0, k_high: float = 1.0) -> Column:
    """The same for values of which less is better."""
    return score_higher(-x, -bad, -mid, -good, k_low, k_high)


def weighted_objective(df: DataFrame, value: str, weight: str, mode: str = "weighted") -> DataFrame:
    how = {"mean": F.avg(value), "max": F.max(value), "min": F.min(value), "weighted": F.sum(F.col(value) * F.col(weight)) / F.sum(weight)}[mode]
    return df.agg(how.alias("objective"))


def annualized(factor: Column, years: Column) -> Column:
    """Null without a positive time or capital."""
    return F.when((years > 1e-12) & (1 + factor > 1e-12), F.pow(1 + factor, 1 / years) - 1)


# Greedy picks: ordered folds with one time as their state


def greedy_pick(rows: DataFrame, keys: list[str], order: list[Column], cooldown_seconds: int, limit: int | None = None, until: str | None = None) -> DataFrame:
    """Rows in order of `order` within `keys`, each taken if it lies `cooldown_seconds` or more from every row taken (or, with
    `until`, not before the time in that column of the last row taken), up to `limit` for a key. Sorted partitions are read
    once; the state of a key is what it has taken, at most `limit` times, or the last one.
    """
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, free, n = object(), [], None, 0
        for batch in batches:
            keep, table = [], batch.select([*keys, "dt", *([until] if until else [])]).to_pylist()
            for r in table:
                key = tuple(r[k] for k in keys)
                if key != last:
                    last, taken, free, n = key, [], None, 0
                ok = limit is None or n < limit
                if until:
                    ok = ok and (free is None or r["dt"] >= free)
                else:
                    ok = ok and all(abs((r["dt"] - t).total_seconds()) >= cooldown_seconds for t in (taken if limit else taken[-1:]))
                keep.append(ok)
                if ok:
                    n, free = n + 1, r[until] if until else None
                    taken = [*taken, r["dt"]] if limit else [r["dt"]]
            yield batch.filter(pa.array(keep))

    return in_order(rows, keys, *order).mapInArrow(run, T.StructType(schema.fields))


# Checks


def sanity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: rows, rows without a time, repeated times, constant columns, and the feature of largest correlation with the target."""
    pairs = F.array(*(F.struct(F.abs(F.corr(f, target)).alias("c"), F.lit(f).alias("f")) for f in features))
    flat = F.filter(F.array(*(F.when(F.stddev_pop(f) < 1e-12, F.lit(f)) for f in features)), lambda x: x.isNotNull())
    out = df.agg(F.count("*").alias("rows"), F.sum(F.col("dt").isNull().cast("long")).alias("bad_dt"), (F.count("*") - F.count_distinct("symbol", "dt")).alias("repeated"), flat.alias("constant"), F.array_max(pairs).alias("top"))
    return out.select("rows", "bad_dt", "repeated", "constant", F.col("top.f").alias("top_feature"), F.col("top.c").alias("top_corr"), (F.col("top.c") >= 0.98).alias("leak"))


def correlations(df: DataFrame, features: list[str], horizons: list[str]) -> DataFrame:
    """feature, target, corr of all pairs, from one aggregate."""
    row = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(h).alias("target"), F.corr(f, h).alias("corr")) for f in features for h in horizons))
    return df.agg(row.alias("r")).select(F.inline("r"))




# Feature names and search spaces: small things that the driver holds

_NAME = re.compile(r"(?:delta_(?P<delta>\d+)_)?(?P<family>[a-z_]+?)_?(?P<scale>\d+)?(?:_tf(?P<tf>\d+))?")


def feature_meta(name: str) -> dict:
    """family, scale, tf and delta of a feature's name, e.g. delta_5_ema20_tf60; None for what it lacks."""
    m = _NAME.fullmatch(name)
    number = lambda k: int(m[k]) if m and m[k] else None
    return {"family": m["family"] if m else name, "scale": number("scale"), "tf": number("tf"), "delta": number("delta")}


def candidate_features(columns: list[str], prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c.startswith(prefixes) or c.startswith(tuple(f"delta_{k}_{p}" for p in prefixes for k in range(1, 241)))]


def may_extend(rule: list[str], name: str, per_family: int = 2, ratio: float = 2.0) -> bool:
    """Whether a feature may join a rule: at most `per_family` of a family, and no two whose scales are within `ratio` of one another."""
    new, old = feature_meta(name), [feature_meta(r) for r in rule]
    same = [m for m in old if m["family"] == new["family"]]
    if name in rule or len(same) >= per_family:
        return False
    return all(m["tf"] != new["tf"] or not (m["scale"] and new["scale"]) or not 1 / ratio <= m["scale"] / new["scale"] <= ratio for m in same)


def sample_spec(spec: dict, n: int, seed: int = 0) -> list[dict]:
    """n random settings: 'a-b' is a range (of whole numbers if both are), a list a choice, anything else itself."""
    import random

    r, out = random.Random(seed), []
    for _ in range(n):
        one = {}
        for k, v in spec.items():
            if isinstance(v, str) and re.fullmatch(r"-?[\d.]+-[\d.]+", v):
                a, b = v.rsplit("-", 1)
                one[k] = r.uniform(float(a), float(b)) if "." in v else r.randint(int(a), int(b))
            else:
                one[k] = r.choice(v) if isinstance(v, (list, tuple)) else v
        out.append(one)
    return out


def loss_risk(loss_rate: float, worst: float, drawdown: float) -> dict:
    """How many of the worst losses reach a drawdown, and the probability of as many in a row."""
    import math

    n = math.ceil(math.log(1 - drawdown) / math.log(1 + worst)) if -1 < worst < 0 else None
    return {"losses_to_drawdown": n, "streak_probability": loss_rate**n if n is not None else None}
