"""Pivots, trendlines and break-outs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.intervals import range_join

from . import kernels as K, segments as S


def fractal_pivots(df: DataFrame, value: str = "obv", swing: int = 5, key: str = "ticker", seq: str = "ts") -> DataFrame:
    """Rows that are the highest or lowest of a centred window, and the row at which that is known."""
    n = max(swing, 3)
    w = W.partitionBy(key).orderBy(seq)
    frame = w.rowsBetween(-(n // 2), (n - 1) // 2)
    x = F.col(value)
    rows = df.withColumn("seq", F.row_number().over(w)).withColumn("_n", F.count(x).over(frame)).withColumn("_hi", F.max(x).over(frame)).withColumn("_lo", F.min(x).over(frame))
    full = F.col("_n") == n
    kind = F.when(full & (x == F.col("_hi")), F.lit("top")).when(full & (x == F.col("_lo")), F.lit("bottom"))
    return rows.withColumn("kind", kind).filter("kind is not null").select(key, seq, "seq", F.col(value).alias("value"), "kind", (F.col("seq") + n // 2).alias("act_seq"))


def classify_pivots(pivots: DataFrame, n: int = 1, key: str = "ticker") -> DataFrame:
    """Tops are higher (HH) or lower (LH) than the highest of the n tops before; bottoms HL or LL."""
    w = W.partitionBy(key, "kind").orderBy("seq").rowsBetween(-n, -1)
    top = F.when(F.col("value") > F.max("value").over(w), "HH").otherwise("LH")
    bottom = F.when(F.col("value") < F.min("value").over(w), "LL").otherwise("HL")
    return pivots.withColumn("ptype", F.when(F.count("value").over(w) > 0, F.when(F.col("kind") == "top", top).otherwise(bottom))).filter("ptype is not null")


# Which pivots open and close a position, by mapping.
MAPPINGS = {"A": (("HL",), ("LH",)), "B": (("HH",), ("LL",))}


def pivot_positions(bars: DataFrame, pivots: DataFrame, mapping: str = "A", key: str = "ticker", seq: str = "ts") -> DataFrame:
    """0/1 position carried forward from the last pivot that says something. Mapping C needs a low
    after a low (LL then HL) to open and a high after a high (HH then LH) to close."""
    rows = bars.withColumn("seq", F.row_number().over(W.partitionBy(key).orderBy(seq)))
    p = pivots
    if mapping == "C":
        w = W.partitionBy(key, "kind").orderBy("seq")
        p = p.withColumn("_b", F.lag("ptype").over(w)).withColumn("go", F.when((F.col("ptype") == "HL") & (F.col("_b") == "LL"), 1).when((F.col("ptype") == "LH") & (F.col("_b") == "HH"), 0))
    else:
        into, out = MAPPINGS[mapping]
        p = p.withColumn("go", F.when(F.col("ptype").isin(*into), 1).when(F.col("ptype").isin(*out), 0))
    at = p.filter("go is not null").groupBy(key, F.col("act_seq").alias("seq")).agg(F.max_by("go", F.struct("seq", "kind")).alias("go"))
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(at, [key, "seq"], "left").withColumn("position", F.coalesce(F.last("go", ignorenulls=True).over(w), F.lit(0))).drop("go")


class Prominences:
    """How far peaks stand out in growing parts of a series.

    A peak's left base, and its right base once something higher has come, never change; until then its
    right base is the lowest value so far. So each part costs one running minimum.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = x
        self.peaks = np.nonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]))[0] + 1 if n > 2 else np.empty(0, np.int64)
        self.left, _ = self._bases(x)
        right, gone = self._bases(x[::-1])
        self.right, self.higher = right[::-1], n - 1 - gone[::-1]  # the next higher place, n without one

    @staticmethod
    def _bases(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest value from each place back to the last higher one, and where that is (-1: nowhere)."""
        base, place, stack = np.empty(len(x)), np.empty(len(x), dtype=np.int64), []
        for i, v in enumerate(x.tolist()):
            low = v
            while stack and stack[-1][0] <= v:
                low = min(low, stack.pop()[1])
            base[i], place[i] = low, stack[-1][2] if stack else -1
            stack.append((v, low, i))
        return base, place

    def of(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The peaks of the part before ``end``, and their prominence there."""
        at = self.peaks[self.peaks < end - 1]
        so_far = np.minimum.accumulate(self.x[:end][::-1])[::-1]
        right = np.where(self.higher[at] < end, self.right[at], so_far[at])
        return at, self.x[at] - np.maximum(self.left[at], right)


def prominence(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    held = Prominences(x)
    at, found = held.of(len(x))
    return found[np.searchsorted(at, peaks)]


def _most(at: np.ndarray, weight: np.ndarray, top: int) -> np.ndarray:
    return np.sort(at[np.argsort(-weight, kind="stable")[:top]])


def topological(x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The most prominent peaks and troughs."""
    return tuple(_most(*Prominences(v).of(len(v)), top) for v in (x, -x))


def important_order(x: np.ndarray, k: int) -> list[int]:
    """Greedy: the point farthest from the line between its chosen neighbours, until there are k with both ends."""
    found: list[int] = []
    heap: list[tuple[float, int, int, int]] = []

    def open_up(a: int, b: int) -> None:
        if b - a > 1:
            i = np.arange(a + 1, b)
            d = np.abs(x[i] - (x[a] + (x[b] - x[a]) * (i - a) / (b - a)))
            j = int(np.argmax(d))
            heapq.heappush(heap, (-float(d[j]), int(i[j]), a, b))

    open_up(0, len(x) - 1)
    while heap and len(found) < k - 2:
        _, i, a, b = heapq.heappop(heap)
        found.append(i)
        open_up(a, i)
        open_up(i, b)
    return found


def important_points(x: np.ndarray, k: int) -> np.ndarray:
    """Of the first k points those that turn the series."""
    return np.array(sorted(i for i in important_order(x, k) if (x[i] - x[i - 1]) * (x[i] - x[i + 1]) >= 0), dtype=np.int64)


def expanding_detection(x: np.ndarray, detect, warmup: int = 120, step: int = 5) -> dict[int, int]:
    """Index of each pivot and the bar at which it was first seen, re-detecting every ``step`` bars."""
    seen: dict[int, int] = {}
    for t in range(warmup, len(x) + 1, step):
        for i in detect(x[:t]):
            seen.setdefault(int(i), t - 1)
    return seen


LINES = "pair string, kind string, start_idx long, end_idx long, slope double, intercept double, n_points long, score double"
KINDS = {"resistance": 1.0, "support": -1.0}


def lines_by_start(high: np.ndarray, low: np.ndarray, kind: str, starts: np.ndarray | None = None, scored: bool = True, least_points: int = 3, error_pct: float = 0.1, least_period: int = 30, most_period: int | None = None) -> Iterator[tuple]:
    """For each start (all, or those given) that has lines: (start, ends, slopes, intercepts), with the points and
    scores of each line behind them if ``scored``.

    All ends of one start are tested together: slopes as a column, bars as rows.
    """
    n = len(high)
    if n < 100:
        return
    x, sign = high if kind == "resistance" else low, KINDS[kind]
    error = error_pct * float(np.mean(high - low))
    for i in (range(n - least_period) if starts is None else starts[starts < n - least_period].tolist()):
        j = np.arange(i + least_period, n if most_period is None else min(n, i + most_period + 1))
        if not len(j):
            continue
        slope = (x[j] - x[i]) / (j - i)
        ok = slope * sign < 0
        # A line is broken before j if some bar between lies beyond it: compare slopes from i.
        bars = np.arange(i + 1, j[-1] + 1)
        rise = sign * (x[bars] - x[i])
        most = np.maximum.accumulate((rise - error) / (bars - i))
        ok &= sign * slope >= most[j - i - 1] - 1e-15
        if not ok.any():
            continue
        reach = int(j[ok][-1]) - i
        # No bar lies beyond by more than the error, so a bar touches if it is near enough from the other side:
        # a line has k touches by its end if the k-th highest so far is as high as its slope.
        near = (rise + error) / (bars - i)
        left = near
        for _ in range(least_points - 1):
            highest = np.maximum.accumulate(left)
            left = np.minimum(left, np.concatenate(([-np.inf], highest[:-1])))
        if least_points > 1:
            ok &= highest[j - i - 1] >= sign * slope
        ends, steep = j[ok], slope[ok]
        if not len(ends):
            continue
        if not scored:
            yield i, ends, steep, x[i] - steep * i
            continue
        bars, near = bars[:reach], near[:reach]
        points, score = np.empty(len(ends), dtype=np.int64), np.empty(len(ends))
        for lo in range(0, len(ends), 64):
            e, s = ends[lo : lo + 64], steep[lo : lo + 64]
            touch = (near >= (sign * s)[:, None]) & (bars <= e[:, None])
            off = np.where(touch, np.abs(x[bars] - (x[i] + s[:, None] * (bars - i))), 0.0)
            points[lo : lo + 64] = some = touch.sum(axis=1) + 1
            score[lo : lo + 64] = -np.log(off.sum(axis=1) / some + 0.001) + some * math.log(2.5)
        yield i, ends, steep, x[i] - steep * i, points, score


def trendlines_of(high: np.ndarray, low: np.ndarray, kind: str, least_points: int = 3, error_pct: float = 0.1, least_period: int = 30, most_period: int | None = None) -> list[tuple]:
    """Lines through two extremes that no bar between breaks by more than the error and enough touch."""
    out = []
    for i, *line in lines_by_start(high, low, kind, None, True, least_points, error_pct, least_period, most_period):
        e, s, at, points, score = (v.tolist() for v in line)
        out += zip([kind] * len(e), [i] * len(e), e, s, at, points, score)
    return sorted(out, key=lambda r: (-r[6], r[1], r[2]))


#: Pairs of bars that one group tests, groups that a pair's starts are dealt to at most, and partitions of the groups.
SHARE, MOST_SHARES, DEALT = 1 << 17, 256, 96


def _shares(bars: DataFrame, order: str) -> DataFrame:
    """``bars`` numbered from 0 (_i), for each share of its pair's starts: share s of _n has the starts s, s + _n, ...

    A pair has about as many shares as the square of its bars asks for, so that no task has all lines of a pair.
    """
    w = W.partitionBy("pair")
    n = F.count(F.lit(1)).over(w)
    count = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARES), F.ceil(n * n / SHARE))).cast("int")
    rows = bars.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", count)
    return rows.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).repartition(DEALT, "pair", "_share")


def _share_starts(rows: pd.DataFrame) -> np.ndarray:
    return np.arange(int(rows["_share"].iloc[0]), len(rows), int(rows["_n"].iloc[0]))


def trendlines(ohlc: DataFrame, top: int | None = None, **options) -> DataFrame:
    """All lines of each pair and kind, or the best ``top``, a row each."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("_i")
        h, lo = rows["high"].to_numpy(float), rows["low"].to_numpy(float)
        pair, starts = rows["pair"].iloc[0], _share_starts(rows)
        for kind in KINDS:
            held, n = [], 0
            for i, *line in lines_by_start(h, lo, kind, starts, **options):
                held.append(pd.DataFrame(dict(zip(names, (pair, kind, i, *line)))))
                n += len(line[0])
                if n >= SHARE and top is not None:
                    held, n = [_best(pd.concat(held), top)], top
                elif n >= SHARE:
                    yield pd.concat(held)
                    held, n = [], 0
            if held:
                yield pd.concat(held) if top is None else _best(pd.concat(held), top)

    found = _shares(ohlc.select("pair", "ts", "high", "low"), "ts").groupBy("pair", "_share").applyInPandas(some, LINES)
    if top is None:
        return found
    best = W.partitionBy("pair", "kind").orderBy(F.desc("score"), "start_idx", "end_idx")
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top).drop("_rank")


def _best(lines: pd.DataFrame, top: int) -> pd.DataFrame:
    return lines.sort_values(["score", "start_idx", "end_idx"], ascending=[False, True, True]).head(top)


def live_lines(bars: DataFrame, lines: DataFrame, width: int = 128) -> DataFrame:
    """(pair, seq, kind, n_live, lowest, highest): for each bar (pair, seq from 0) the lines that are live, those that
    ended before it (and not after ``last_idx``, where the table has it), and the bounds of their levels there.

    Bars and lines meet in bins of bars, not in a loop over both.
    """
    last = F.col("last_idx") if "last_idx" in lines.columns else F.col("_most")
    longest = bars.groupBy("pair").agg(F.max("seq").alias("_most"))
    ranges = lines.select("pair", "kind", "end_idx", "slope", "intercept", *(["last_idx"] if "last_idx" in lines.columns else [])).join(longest, "pair")
    met = range_join(bars.select("pair", "seq"), ranges, F.col("seq"), F.col("end_idx") + 1, F.least(last, F.col("_most")), width, ("pair",))
    level = F.col("slope") * F.col("seq") + F.col("intercept")
    return met.groupBy("pair", "seq", "kind").agg(F.count("*").alias("n_live"), F.min(level).alias("lowest"), F.max(level).alias("highest"))


def breakout(bars: DataFrame, entry_conf: int = 1, exit_conf: int = 1, atr_k: float = 3.0, **lines) -> DataFrame:
    """Enter after so many bars in a row over some live resistance; leave under support or at the trailing
    stop. From (pair, ts, seq, high, low, close of the ratio, num_close); flags act one bar later."""

    def run(c: K.Columns) -> K.Columns:
        num, over, under = c["num_close"], c["over0"], c["under0"]
        atr = K.atr_close(num)
        floor = np.where(np.isnan(atr), -np.inf, num - atr_k * atr)
        into, out, t = np.zeros(len(num), bool), np.zeros(len(num), bool), 0
        while t < len(num):
            ahead = np.flatnonzero(over[t:])
            if not len(ahead):
                break
            t += int(ahead[0])
            into[t] = True
            later = slice(t + 1, len(num))
            gone = np.flatnonzero(under[later] | (num[later] <= np.maximum.accumulate(floor[later])))
            if not len(gone):
                break
            t += 1 + int(gone[0])
            out[t] = True
            t += 1
        return {"entry": K.shifted(into), "exit": K.shifted(out)}

    flagged = line_events(bars, (entry_conf,), (exit_conf,), "seq", **lines).drop("n_lines")
    return K.per_key(flagged, run, {"entry": "boolean", "exit": "boolean"}, ["num_close", "over0", "under0"]).drop("over0", "under0")


CONFIRMATIONS = (3, 4, 5, 6, 7)
BREAK_STOPS = (0.0, 0.1, 0.15, 0.2)


def streaks(close: np.ndarray, kind: str, ends: np.ndarray, slope: np.ndarray, level: np.ndarray, confirmations: tuple[int, ...]) -> np.ndarray:
    """For each bar and confirmation, whether some of the lines has just been closed beyond (over resistance, under
    support) that many bars in a row. A line is live after its end."""
    n, hit, most = len(close), np.zeros((len(close), len(confirmations)), dtype=bool), max(confirmations, default=0)
    order = np.argsort(ends, kind="stable")
    for lo in range(0, len(ends), 512):
        e, s, v = (x[order[lo : lo + 512]] for x in (ends, slope, level))
        first = int(e[0]) + 1  # no line of these is live before
        if first >= n:
            break
        t = np.arange(first, n, dtype=float)[:, None]
        line = s * t
        line += v
        beyond = line < close[first:, None] if kind == "resistance" else line > close[first:, None]
        for at in [k for k, c in enumerate(confirmations) if c == 0]:
            hit[first:, at] |= (~beyond & (t > e)).any(axis=1)
        later = int(e[-1]) + 1 - first  # from here all are live
        beyond[:later] &= t[:later] > e
        beyond = np.packbits(beyond, axis=1)  # a bit a line
        run = beyond.copy()
        run[1:] &= ~beyond[:-1]
        for c in range(1, most + 1):  # run[k]: c bars in a row, and no more, at bar first + k + c - 1
            if c > 1:
                run = run[:-1] & beyond[c - 1 :]
            for at in [k for k, x in enumerate(confirmations) if x == c]:
                hit[first + c - 1 :, at] |= run.any(axis=1)
    return hit


def line_events(bars: DataFrame, over: tuple, under: tuple, order: str = "ts", **lines) -> DataFrame:
    """``bars`` (pair, ``order``, high, low, close of the ratio, ...) with over0, over1, ...: whether some live resistance
    has just been closed over as many bars in a row as ``over`` says (numbers or columns of the pair), under0, ...: support
    under likewise, and n_lines, whose sum over the pair's bars is the number of its lines.

    Lines are found and followed by shares of their starts and never leave their task: what the shares have seen is put together by bar.
    """
    wanted, n_over = [c if isinstance(c, Column) else F.lit(c) for c in (*over, *under)], len(over)
    flags = [f"over{k}" for k in range(len(over))] + [f"under{k}" for k in range(len(under))]
    fields = [*bars.schema.fields, *T.StructType.fromDDL(", ".join([*(f"{c} boolean" for c in flags), "n_lines long", "_i int"]))]

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i").reset_index(drop=True)
        high, low, close = (rows[c].to_numpy(float) for c in ("high", "low", "close"))
        starts, confs = _share_starts(rows), [int(c) for c in rows["_confs"].iloc[0]]
        want = {"resistance": tuple(confs[:n_over]), "support": tuple(confs[n_over:])}
        total, hits = 0, []
        for kind, mine in want.items():
            hit, held, n = np.zeros((len(rows), len(mine)), dtype=bool), [], 0
            for _, *line in lines_by_start(high, low, kind, starts, scored=False, **lines):
                held.append(line)
                n += len(line[0])
                if n >= 1 << 15:
                    hit |= streaks(close, kind, *map(np.concatenate, zip(*held)), mine)
                    total, held, n = total + n, [], 0
            if held:
                hit |= streaks(close, kind, *map(np.concatenate, zip(*held)), mine)
            total, hits = total + n, [*hits, hit]
        hits = np.hstack(hits)
        for k, c in enumerate(flags):
            rows[c] = hits[:, k]
        rows["n_lines"] = np.where(rows["_i"] == 0, total, 0)
        # The first share returns every bar, the others what they have seen.
        seen = hits.any(axis=1) | (rows["_i"] == 0) | (rows["_share"] == 0)
        return rows.loc[seen, [f.name for f in fields]]

    dealt = _shares(bars.withColumn("_confs", F.array(*wanted)), order)
    found = dealt.groupBy("pair", "_share").applyInPandas(some, T.StructType(fields))
    own = [F.first(c).alias(c) for c in bars.columns if c != "pair"]
    return found.groupBy("pair", "_i").agg(*own, *[F.bool_or(c).alias(c) for c in flags], F.sum("n_lines").alias("n_lines")).select(*bars.columns, *flags, "n_lines")


def breakout_trades(close: np.ndarray, into: np.ndarray, out: np.ndarray, stop: float, cost: float = 0.001, slip: float = 0.0005) -> tuple[np.ndarray, list[tuple]]:
    """(returns, trades) of one walk: in at the close of a bar that confirms, out at the stop or at the close
    of a bar that confirms the other way; both sides' costs are taken on the way out, a bar's return is the
    move up to its close. A trade is (entry bar, exit bar, entry price, exit price, return, reason)."""
    n = len(close)
    ret, trades, at, t = np.zeros(n), [], -1, 0
    while t < n:
        if at < 0:
            ahead = np.flatnonzero(into[t:])
            if not len(ahead) or t + ahead[0] >= n - 1:
                break
            at = t + int(ahead[0])
            t = at + 1
            continue
        low = np.flatnonzero(close[t:] <= close[at] * (1 - stop)) if stop > 0 else np.empty(0, np.int64)
        leave = np.flatnonzero(out[t:])
        first = min((t + int(v[0]) for v in (low, leave) if len(v)), default=n - 1)
        reason = "stop" if len(low) and t + int(low[0]) == first else "signal" if len(leave) and t + int(leave[0]) == first else "eod"
        price = close[at] * (1 - stop) * (1 - slip) if reason == "stop" else close[first]
        ret[at + 1 : first + 1] = close[at + 1 : first + 1] / close[at:first] - 1
        ret[first] = price / close[first - 1] - 1 - 2 * cost
        trades.append((at, first, float(close[at]), float(price), float(price / close[at] - 1 - 2 * cost), reason))
        at, t = -1, first + 1
    return ret, trades


BREAKOUT = "pair string, entry_conf int, exit_conf int, stop_pct double, is_sharpe double, is_penalized_sharpe double, is_trades long, oos_sharpe double, oos_cagr double, oos_max_dd double, oos_trades long, oos_hit_rate double, n_lines long, best boolean, passed boolean, fail_reason string"
BREAKOUT_TRADES = "pair string, entry_conf int, exit_conf int, stop_pct double, entry_ts date, exit_ts date, entry_price double, exit_price double, pnl double, exit_reason string"


def _breakout_pairs(bars: DataFrame, over: tuple, under: tuple, make, schema: str, **lines) -> DataFrame:
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(make(rows.sort_values("ts")), columns=[c.split()[0] for c in schema.split(", ")])

    return line_events(bars.select("pair", "ts", "high", "low", "close", "num_close"), over, under, **lines).groupBy("pair").applyInPandas(one, schema)


def _flags(rows: pd.DataFrame, name: str, n: int) -> np.ndarray:
    return rows[[f"{name}{k}" for k in range(n)]].to_numpy(bool)


def grid_breakout(bars: DataFrame, entry_confs: tuple[int, ...] = CONFIRMATIONS, exit_confs: tuple[int, ...] = CONFIRMATIONS, stops: tuple[float, ...] = BREAK_STOPS, is_ratio: float = 0.7, least_is: float = 0.5, least_oos: float = 0.0, least_trades: int = 5, n_params: int = 3, cost: float = 0.001, slip: float = 0.0005, full: bool = True, **lines) -> DataFrame:
    """Every entry and exit confirmation and stop over the lines of each pair (pair, ts, high, low, close of
    the ratio, num_close): a row for each combination, or the best alone, and a reason where none passes.

    Lines are detected once on all bars and live after their end, so a line is never known before it ends.
    """

    def make(rows: pd.DataFrame) -> list[tuple]:
        num, over, under = rows["num_close"].to_numpy(float), _flags(rows, "over", len(entry_confs)), _flags(rows, "under", len(exit_confs))
        found, cut, pair, out = int(rows["n_lines"].sum()), int(len(rows) * is_ratio), rows["pair"].iloc[0], []
        for go, e in zip(over.T, entry_confs):
            for leave, x in zip(under.T, exit_confs):
                for stop in stops:
                    r, trades = breakout_trades(num[:cut], go[:cut], leave[:cut], stop, cost, slip)
                    sr, n = S.sharpe(r), len(trades)
                    pen = sr * math.sqrt(1 - n_params / n) if n > n_params else 0.0
                    q, later = breakout_trades(num[cut:], go[cut:], leave[cut:], stop, cost, slip)
                    hits = float(np.mean([t[4] > 0 for t in later])) if later else 0.0
                    why = "no lines" if not found else "too few trades" if n < least_trades else "in-sample Sharpe" if sr < least_is else "too few trades out of sample" if len(later) < least_trades else "out-of-sample Sharpe" if S.sharpe(q) < least_oos else None
                    out.append([pair, e, x, float(stop), sr, pen, n, S.sharpe(q), S.cagr(q), S.deepest(q), len(later), hits, found, False, why is None, why])
        if out:
            out[int(np.argmax([o[5] if o[6] >= least_trades else -np.inf for o in out]))][13] = True
        return [tuple(o) for o in out if full or o[13]]

    return _breakout_pairs(bars, tuple(entry_confs), tuple(exit_confs), make, BREAKOUT, **lines)


def breakout_trace(bars: DataFrame, entry_conf: int = 3, exit_conf: int = 3, stop: float = 0.1, cost: float = 0.001, slip: float = 0.0005, **lines) -> DataFrame:
    """A row for each trade of one combination."""

    def make(rows: pd.DataFrame) -> list[tuple]:
        num, over, under = rows["num_close"].to_numpy(float), _flags(rows, "over", 1), _flags(rows, "under", 1)
        ts, pair = rows["ts"].to_numpy(), rows["pair"].iloc[0]
        return [(pair, entry_conf, exit_conf, float(stop), ts[a], ts[b], p, q, r, why) for a, b, p, q, r, why in breakout_trades(num, over[:, 0], under[:, 0], stop, cost, slip)[1]]

    return _breakout_pairs(bars, (entry_conf,), (exit_conf,), make, BREAKOUT_TRADES, **lines)


CHOSEN = ("entry_thresh", "exit_thresh", "stop_pct")


class _Chosen:
    """A pair's bars with the combination an optimiser chose for it, in the columns ``CHOSEN``, and its flags."""

    def __init__(self, rows: pd.DataFrame, cost: float, slip: float):
        rows = rows.sort_values("ts")
        self.num = rows["num_close"].to_numpy(float)
        self.over, self.under = (_flags(rows, c, len(NEAR)) for c in ("over", "under"))
        self.entry, self.exit, self.stop = (float(rows[c].iloc[0]) for c in CHOSEN)
        self.pair, self.cost, self.slip = rows["pair"].iloc[0], cost, slip

    def returns(self, cut: int = 0, entry: int = 0, exit_: int = 0, stop: float | None = None) -> np.ndarray:
        """With the chosen confirmations, or those so many bars (of ``NEAR``) away from them."""
        over, under = self.over[cut:, NEAR.index(entry)], self.under[cut:, NEAR.index(exit_)]
        return breakout_trades(self.num[cut:], over, under, self.stop if stop is None else stop, self.cost, self.slip)[0]


#: Bars from a chosen confirmation that its pair is walked with.
NEAR = (0, -1, 1)


def _chosen_events(bars: DataFrame, chosen: DataFrame, **lines) -> DataFrame:
    near = lambda c: tuple(F.greatest(F.lit(1), (F.col(c) + k).cast("int")) for k in NEAR)
    return line_events(bars.join(chosen.select("pair", *CHOSEN), "pair"), near("entry_thresh"), near("exit_thresh"), **lines)


def breakout_returns(bars: DataFrame, chosen: DataFrame, cost: float = 0.001, slip: float = 0.0005, **lines) -> DataFrame:
    """(pair, seq, ret): each pair walked with its own row of ``chosen`` (pair, entry_thresh, exit_thresh, stop_pct)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        p = _Chosen(rows, cost, slip)
        return pd.DataFrame({"pair": p.pair, "seq": np.arange(1, len(rows) + 1), "ret": p.returns()})

    return _chosen_events(bars, chosen, **lines).groupBy("pair").applyInPandas(one, "pair string, seq long, ret double")


def breakout_sensitivity(bars: DataFrame, chosen: DataFrame, schema: str, is_ratio: float = 0.7, shift: float = 0.2, most: float = 0.5, least: float = 0.0, cost: float = 0.001, slip: float = 0.0005, **lines) -> DataFrame:
    """The last part of each pair with each confirmation one bar fewer and more and the stop a fifth lower and
    higher, against the chosen combination. Columns as ``schema`` names them."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        p = _Chosen(rows, cost, slip)
        cut = int(len(rows) * is_ratio)
        whole = p.returns(cut)
        base = S.sharpe(whole)
        variants = [{"entry": s} for s in (-1, 1) if p.entry + s >= 1] + [{"exit_": s} for s in (-1, 1) if p.exit + s >= 1]
        variants += [{"stop": p.stop * (1 + s * shift)} for s in (-1, 1) if p.stop > 0]
        tried = [S.sharpe(p.returns(cut, **v)) for v in variants]
        mean = float(np.mean(tried))
        down = 1 - mean / base if base > 1e-6 else None
        row = {
            "pair": p.pair, "mean_test_sharpe": mean, "std_test_sharpe": float(np.std(tried, ddof=1)), "n_test_periods": len(tried), "n_oos_bars": len(whole), "baseline_sharpe": base, "degradation": down,
            "oos_cagr": S.cagr(whole), "oos_max_dd": S.deepest(whole), "pct_positive": float(np.mean([t > 0 for t in tried])), "wfe": mean / base if base > 0 and mean > 0 else 0.0,
            "passed": bool(base >= least and down is not None and down < most), "val_method": "sensitivity",
        }
        return pd.DataFrame([row])[[c.split()[0] for c in schema.split(", ")]]

    return _chosen_events(bars, chosen, **lines).groupBy("pair").applyInPandas(one, schema)


def _classified(tops: np.ndarray, bottoms: np.ndarray, x: np.ndarray, n: int = 1) -> dict[int, str]:
    """Each pivot's type against the n pivots of its kind before it; the first ones have none."""
    out = {}
    for kind, at in (("top", tops), ("bottom", bottoms)):
        for k in range(n, len(at)):
            before = x[at[k - n : k]]
            out[int(at[k])] = ("HH" if x[at[k]] > before.max() else "LH") if kind == "top" else ("LL" if x[at[k]] < before.min() else "HL")
    return out


def _fractal(x: np.ndarray, swing: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(swing, 3)
    if len(x) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(x, n)
    centre = np.arange(n // 2, n // 2 + len(views))
    return centre[x[centre] == views.max(axis=1)], centre[x[centre] == views.min(axis=1)]


def _sides(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = x[at] >= x[at - 1] if len(at) else np.empty(0, bool)
    return at[up], at[~up]


#: The settings of each detector, and the stops.
DETECTORS = {"fractal": (25, 50, 100), "topological": (15, 30, 60), "pip": (30, 60, 120)}
OBV_STOPS = (("none", "none", 0.0), ("fixed_10%", "pct", 0.10), ("fixed_15%", "pct", 0.15), ("fixed_20%", "pct", 0.20), ("atr_2x", "atr", 2.0), ("atr_3x", "atr", 3.0))


def _growing(x: np.ndarray, method: str, params: tuple[int, ...], ends: range):
    """(end, pivots by setting) for growing parts; what all settings share is found once."""
    if method == "topological":
        up, down = Prominences(x), Prominences(-x)
        for end in ends:
            a, b = up.of(end), down.of(end)
            yield end, {p: (_most(*a, p), _most(*b, p)) for p in params}
    elif method == "pip":
        for end in ends:
            part = x[:end]
            order = np.array(important_order(part, max(params)), dtype=np.int64)
            turns = (part[order] - part[order - 1]) * (part[order] - part[order + 1]) >= 0
            yield end, {p: _sides(part, np.sort(order[: max(p - 2, 0)][turns[: max(p - 2, 0)]])) for p in params}
    else:
        raise KeyError(f"no pivots {method!r}; there are fractal, topological, pip")


def pivot_timelines(x: np.ndarray, method: str, params: tuple[int, ...], n: int = 1, warmup: int = 120, step: int = 5) -> dict[int, list[tuple[int, str]]]:
    """By setting the (bar, type) of each pivot on the bar it is known: a fractal when its window has closed,
    others when the detector, run again every ``step`` bars on all bars so far, first shows them."""
    if method == "fractal":
        found = {p: _classified(*_fractal(x, p), x, n) for p in params}
        return {p: sorted((i + p // 2, t) for i, t in f.items() if i + p // 2 < len(x)) for p, f in found.items()}
    seen: dict[int, dict[int, tuple[int, str]]] = {p: {} for p in params}
    for end, pivots in _growing(x, method, params, range(warmup + 1, len(x) + 1, step)):
        for p, sides in pivots.items():
            for i, kind in _classified(*sides, x, n).items():
                seen[p].setdefault(i, (end - 1, kind))
    return {p: sorted(s.values()) for p, s in seen.items()}


def timeline_position(timeline: list[tuple[int, str]], n: int, mapping: str) -> np.ndarray:
    """0/1 from the events: A opens on HL and closes on LH, B on HH and LL; C opens on HL if the last
    extreme was LL, and closes on LH if it was HH, each extreme counting once."""
    state, last = 0, None
    moves = np.zeros(n, dtype=np.int64)
    for at, kind in timeline:
        if mapping == "C":
            if kind in ("LL", "HH"):
                last = kind
                continue
            new = 1 if kind == "HL" and last == "LL" and state == 0 else 0 if kind == "LH" and last == "HH" and state == 1 else None
            last = last if new is None else None
        else:
            into, out = MAPPINGS[mapping]
            new = 1 if kind in into else 0 if kind in out else None
        if new is not None:
            moves[at] += new - state
            state = new
    return np.cumsum(moves)


def walk_position(close: np.ndarray, low: np.ndarray, atr: np.ndarray, position: np.ndarray, stop: str, param: float, cost: float = 0.001, slip: float = 0.0005) -> tuple[np.ndarray, int, int, int]:
    """(returns, trades, wins, bars in) of a 0/1 position with a stop.

    In at the close of the first bar with a 1 while flat, also after a stop; out at a 0 or on the last bar at
    the close, before that at a percent stop by the low or an ATR trail by the close. A side's cost is taken
    on its bar, slippage on the prices; a trade wins if it sells above what it paid.
    """
    n = len(close)
    ret, trades, wins, inside, t = np.zeros(n), 0, 0, 0, 0
    while t < n:
        ones = np.flatnonzero(position[t:] == 1)
        if not len(ones):
            break
        t += int(ones[0])
        paid = close[t] * (1 + slip)
        zeros = np.flatnonzero(position[t + 1 :] == 0)
        end, price = (t + 1 + int(zeros[0]) if len(zeros) else n - 1), None
        span = slice(t + 1, end + 1)
        if stop == "pct":
            hit = np.flatnonzero(low[span] <= paid * (1 - param))
            price = paid * (1 - param) if len(hit) else None
        elif stop == "atr":
            trail = np.maximum.accumulate(close[t : end + 1] - param * atr[t : end + 1])
            hit = np.flatnonzero(close[span] <= trail[1:])
            price = trail[1 + hit[0]] if len(hit) else None
        if price is not None:
            end = t + 1 + int(hit[0])
        sold = (close[end] if price is None else price) * (1 - slip)
        marks = np.concatenate([[paid], close[t + 1 : end], [sold]]) if end > t else np.array([paid, sold])
        ret[t] -= cost
        ret[end - len(marks) + 2 : end + 1] += marks[1:] / marks[:-1] - 1
        ret[end] -= cost
        trades, wins, inside, t = trades + 1, wins + int(sold > paid), inside + end - t, end + 1
    return ret, trades, wins, inside


OBV_GRID = "ticker string, method string, method_param int, mapping string, stop_type string, is_sharpe double, is_cagr double, is_maxdd double, is_trades long, is_hit_rate double, is_time_in_market double, oos_sharpe double, oos_cagr double, oos_maxdd double, oos_calmar double, oos_trades long, oos_hit_rate double, oos_time_in_market double, bh_is_sharpe double, bh_is_cagr double, bh_oos_sharpe double, bh_oos_cagr double, oos_excess_sr_vs_bh double, oos_excess_cagr_vs_bh double, n_bars long, passed boolean"


def grid_obv_pivot(bars: DataFrame, is_ratio: float = 0.7, cost: float = 0.001, slip: float = 0.0005, least_bars: int = 504, n_compare: int = 1, warmup: int = 120, step: int = 5) -> DataFrame:
    """On-balance volume pivots: 3 detectors x 3 settings x 3 mappings x 6 stops, 162 rows for each ticker
    of (ticker, ts, high, low, close, volume), beside buying and holding."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        close, high, low, volume = (rows[c].to_numpy(float) for c in ("close", "high", "low", "volume"))
        n, cut, out = len(close), int(len(close) * is_ratio), []
        if n >= least_bars and cut >= 100 and n - cut >= 50:
            x = np.cumsum(np.concatenate([[0.0], np.sign(np.diff(close))]) * volume)
            atr = K.atr_wilder(high, low, close)
            hold = np.diff(close) / close[:-1]
            base = [f(part) for part in (hold[: cut - 1], hold[cut - 1 :]) for f in (lambda r: S.sharpe(r, 0), S.cagr)]
            for method, params in DETECTORS.items():
                for param, timeline in pivot_timelines(x, method, params, n_compare, warmup, step).items():
                    for mapping in "ABC":
                        position = timeline_position(timeline, n, mapping)
                        for label, stop, p in OBV_STOPS:
                            sides = []
                            for part in (slice(0, cut), slice(cut, n)):
                                r, trades, wins, inside = walk_position(close[part], low[part], atr[part], position[part], stop, p, cost, slip)
                                sides.append((S.sharpe(r, 0), S.cagr(r), S.deepest(r), trades, wins / trades if trades else 0.0, inside / len(r)))
                            a, b = sides
                            calmar = b[1] / abs(b[2]) if b[2] else None
                            out.append((rows["ticker"].iloc[0], method, param, mapping, label, *a, *b[:3], calmar, *b[3:], *base, b[0] - base[2], b[1] - base[3], n, bool(b[0] > 0 and b[3] >= 5)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OBV_GRID.split(", ")])

    return bars.select("ticker", "ts", "high", "low", "close", "volume").groupBy("ticker").applyInPandas(one, OBV_GRID)


def obv_walk(bars: DataFrame, stop: str = "none", param: float = 0.0, cost: float = 0.001, slip: float = 0.0005, key: str = "ticker", seq: str = "ts") -> DataFrame:
    """``bars`` with the return of a 0/1 ``position`` with a stop (none, pct or atr)."""
    return K.per_key(bars, lambda c: {"ret": walk_position(c["close"], c["low"], K.atr_wilder(c["high"], c["low"], c["close"]), c["position"], stop, param, cost, slip)[0]}, {"ret": "double"}, ["close", "high", "low", "position"], key, seq)
