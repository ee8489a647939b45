"""Truly sequential recursions. A series is dealt to one partition and read there in order, batch by batch: what one
batch leaves is carried into the next, so that a series of any length takes the memory of a batch. Arrow passes the
columns that a recursion does not read through as they are. A null key is a key like any other."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspark.frames import TICKS, Series

KINDS = {"double": (T.DoubleType(), pa.float64()), "int": (T.IntegerType(), pa.int32()), "boolean": (T.BooleanType(), pa.bool_())}


class Carry:
    """What the stretch of a series that was read so far leaves for the next one, by name."""

    def __init__(self) -> None:
        self.kept: dict[str, object] = {}

    def get(self, name: str, start: float) -> float:
        return self.kept.get(name, start)

    def before(self, name: str, x: pd.Series) -> pd.Series:
        """x a row earlier; missing at the start of the series."""
        out = x.shift(1)
        if name in self.kept:
            out.iloc[0] = self.kept[name]
        self.kept[name] = x.iloc[-1]
        return out

    def ewm(self, name: str, x: pd.Series, alpha: float) -> pd.Series:
        """y0 = x0, then alpha x + (1 - alpha) y; a missing x keeps y, whose weight goes on to fall."""
        head = self.kept.get(name, [])
        y = pd.concat([pd.Series(head, dtype="float64"), x.astype("float64")], ignore_index=True)
        mean = y.ewm(alpha=alpha, adjust=False).mean()
        known = np.flatnonzero(y.notna())
        if len(known):
            # The mean at the last known value stands for all before it. Past 40 / alpha missing ones its weight is nil.
            gap = min(len(y) - 1 - int(known[-1]), int(40 / alpha))
            self.kept[name] = [float(mean.iloc[-1]), *[np.nan] * gap]
        return mean.iloc[len(head) :].reset_index(drop=True)


Kernel = Callable[[pd.DataFrame, Carry], dict[str, object]]


def _cuts(keys: pd.DataFrame) -> np.ndarray:
    """Places where a row's key differs from that of the row before; null equals null."""
    other = np.zeros(len(keys), bool)
    for name in keys:
        c, b = keys[name], keys[name].shift(1)
        other |= ((c != b) & ~(c.isna() & b.isna())).to_numpy(bool)
    other[:1] = False
    return np.flatnonzero(other)


def scanned(df: DataFrame, s: Series, inputs: list[str], kernel: Kernel, outs: dict[str, str]) -> DataFrame:
    """df with columns that the kernel computes along each series from the inputs. outs: their names and types.

    The kernel gets the next stretch of one series in order and the series' Carry. Rows of one key and order come in any
    order among themselves; an empty table gives an empty result.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, KINDS[t][0]) for n, t in outs.items()]])
    names = list(dict.fromkeys([*s.key, *inputs]))
    key = list(s.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, Carry()
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.select(names).to_pandas()
            edges = [0, *_cuts(frame[key]), len(frame)]
            found: dict[str, list[pa.Array]] = {n: [] for n in outs}
            for a, b in zip(edges, edges[1:], strict=False):
                if a or last is None or len(_cuts(pd.concat([last, frame.loc[[0], key]], ignore_index=True))):
                    carry = Carry()
                columns = kernel(frame.iloc[a:b].reset_index(drop=True), carry)
                for n, t in outs.items():
                    found[n].append(pa.array(columns[n], KINDS[t][1], from_pandas=True))
            last = frame.iloc[[-1]][key]
            arrays = [*batch.columns, *[pa.concat_arrays(found[n]) for n in outs]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *outs])

    order = [F.col(c).asc_nulls_last() for c in s.order]
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def grouped(df: DataFrame, s: Series, kernel: Callable[[pd.DataFrame], dict[str, object]], outs: dict[str, str]) -> DataFrame:
    """df with columns that a user's function computes from a whole series in order, which one task then holds. outs:
    their names and types."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, KINDS[t][0]) for n, t in outs.items()]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(s.order), kind="stable").reset_index(drop=True)
        return frame.assign(**kernel(frame))

    return df.groupBy(*s.key).applyInPandas(run, schema)


def _with_stats(df: DataFrame, s: Series, **stats) -> DataFrame:
    """df with statistics of its series beside each row; a null key has its own."""
    rows = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(s.key)]).agg(*[c.alias(n) for n, c in stats.items()])
    for i, k in enumerate(s.key):
        match = df[k].eqNullSafe(rows[f"__k{i}"]) if not i else match & df[k].eqNullSafe(rows[f"__k{i}"])
    return df.join(rows, match).drop(*[f"__k{i}" for i in range(len(s.key))])


def _safe(top: pd.Series, bottom: pd.Series, neutral: float) -> pd.Series:
    return (top / bottom.where(bottom != 0)).where(bottom != 0, neutral).where(top.notna() & bottom.notna())


def ema(df: DataFrame, s: Series = TICKS, x: str = "price", span: int = 10) -> DataFrame:
    return scanned(df, s, [x], lambda f, c: {"ema": c.ewm("x", f[x], 2 / (span + 1))}, {"ema": "double"})


def return_volatility(df: DataFrame, s: Series = TICKS, price: str = "price", span: int = 20, skip: bool = False) -> DataFrame:
    """df with volatility: root of the exponential mean of squared returns less the squared exponential mean. A missing
    return keeps both means, whose weight goes on to fall, or stays with skip. Plain numbers, because many short series
    are the usual case."""
    alpha = 2 / (span + 1)

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        before, weight, square, mean = (c.get(n, start) for n, start in (("before", math.nan), ("weight", 0.0), ("square", 0.0), ("mean", 0.0)))
        out = []
        for now in f[price].to_numpy(float).tolist():
            r = now / before - 1 if before else math.nan
            before = now
            if not skip or not math.isnan(r):
                weight *= 1 - alpha
            if math.isnan(r):
                out.append(math.nan)
                continue
            part = alpha / (alpha + weight)
            square, mean, weight = square + part * (r * r - square), mean + part * (r - mean), 1.0
            out.append(math.sqrt(max(square - mean * mean, 0.0)))
        c.kept |= {"before": before, "weight": weight, "square": square, "mean": mean}
        return {"volatility": out}

    return scanned(df, s, [price], kernel, {"volatility": "double"})


def ema_adjusted(df: DataFrame, s: Series = TICKS, x: str = "price", span: int = 10) -> DataFrame:
    """The ratio of discounted sums, which forgets its start."""
    alpha = 2 / (span + 1)

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        # Both sums start from nothing, so that their common factor alpha falls out of the ratio.
        c.kept.setdefault("sum", [0.0])
        c.kept.setdefault("weight", [0.0])
        weight = c.ewm("weight", f[x].notna().astype("float64"), alpha)
        return {"ema": c.ewm("sum", f[x].fillna(0.0), alpha) / weight.where(weight > 0)}

    return scanned(df, s, [x], kernel, {"ema": "double"})


def _macd(x: pd.Series, c: Carry, fast: int, slow: int, signal: int) -> tuple[pd.Series, pd.Series]:
    line = c.ewm("fast", x, 2 / (fast + 1)) - c.ewm("slow", x, 2 / (slow + 1))
    return line, c.ewm("signal", line, 2 / (signal + 1))


def macd(df: DataFrame, s: Series = TICKS, x: str = "price", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        line, smooth = _macd(f[x], c, fast, slow, signal)
        return {"macd": line, "macd_signal": smooth, "macd_hist": line - smooth}

    return scanned(df, s, [x], kernel, dict.fromkeys(("macd", "macd_signal", "macd_hist"), "double"))


def macd_cross(df: DataFrame, s: Series = TICKS, x: str = "price", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """1 where the line crosses above its signal, -1 below."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        line, smooth = _macd(f[x], c, fast, slow, signal)
        gap = line - smooth
        before = c.before("gap", gap)
        return {"signal": np.where((gap > 0) & (before <= 0), 1, np.where((gap < 0) & (before >= 0), -1, 0))}

    return scanned(df, s, [x], kernel, {"signal": "int"})


def rsi_wilder(df: DataFrame, s: Series = TICKS, x: str = "price", n: int = 14) -> DataFrame:
    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        d = f[x] - c.before("x", f[x])
        gain, loss = c.ewm("gain", d.clip(lower=0), 1 / n), c.ewm("loss", (-d).clip(lower=0), 1 / n)
        value = 100 - 100 / (1 + gain / loss.where(loss != 0))
        return {"rsi": value.where(loss != 0, np.where(gain == 0, 50.0, 100.0)).where(d.notna())}

    return scanned(df, s, [x], kernel, {"rsi": "double"})


def _true_range(f: pd.DataFrame, c: Carry) -> pd.Series:
    before = c.before("close", f["close"])
    return pd.concat([f["high"] - f["low"], (f["high"] - before).abs(), (f["low"] - before).abs()], axis=1).max(axis=1)


def atr(df: DataFrame, s: Series = TICKS, n: int = 14) -> DataFrame:
    return scanned(df, s, ["high", "low", "close"], lambda f, c: {"atr": c.ewm("range", _true_range(f, c), 1 / n)}, {"atr": "double"})


def adx(df: DataFrame, s: Series = TICKS, n: int = 14) -> DataFrame:
    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        up, down = (f["high"] - c.before("high", f["high"])).fillna(0.0), (c.before("low", f["low"]) - f["low"]).fillna(0.0)
        plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
        wide = c.ewm("range", _true_range(f, c), 1 / n)
        a, b = 100 * _safe(c.ewm("plus", plus, 1 / n), wide, 0.0), 100 * _safe(c.ewm("minus", minus, 1 / n), wide, 0.0)
        return {"plus_di": a, "minus_di": b, "adx": c.ewm("adx", 100 * _safe((a - b).abs(), a + b, 0.0), 1 / n)}

    return scanned(df, s, ["high", "low", "close"], kernel, dict.fromkeys(("plus_di", "minus_di", "adx"), "double"))


def ewma_volatility(df: DataFrame, s: Series = TICKS, x: str = "ret", decay: float = 0.94) -> DataFrame:
    """Root of the discounted mean of squared returns; missing ones are skipped and leave all weights as they are."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        square = f[x].astype("float64").reset_index(drop=True) ** 2
        known = square.dropna()
        mean = pd.Series(c.ewm("square", known, 1 - decay).to_numpy(), index=known.index).reindex(square.index).ffill().fillna(c.get("last", math.nan))
        c.kept["last"] = float(mean.iloc[-1])
        return {"ewma_vol": np.sqrt(mean)}

    return scanned(df, s, [x], kernel, {"ewma_vol": "double"})


def garch(df: DataFrame, s: Series = TICKS, x: str = "ret", omega: float = 1e-6, alpha: float = 0.1, beta: float = 0.85) -> DataFrame:
    """Conditional variance of GARCH(1,1) with given parameters, from the series' own variance; null returns keep it."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        r = f[x].to_numpy(float)
        out = np.empty(len(r))
        level = c.get("level", f["__start"].iloc[0])
        for i, value in enumerate(r):
            out[i] = level
            if not np.isnan(value):
                level = omega + alpha * value * value + beta * level
        c.kept["level"] = level
        return {"variance": out}

    return scanned(_with_stats(df, s, __start=F.var_pop(x)), s, [x, "__start"], kernel, {"variance": "double"}).drop("__start")


def cusum(df: DataFrame, s: Series = TICKS, x: str = "price", threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """Two-sided CUSUM of the standardised series; sums restart after an alarm (1 up, -1 down). A null value counts as
    the mean, and all of a series without spread."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        spread = f["__spread"].iloc[0]
        z = ((f[x] - f["__mean"]) / (spread if spread > 0 else np.inf)).fillna(0.0).to_numpy(float)
        up, down = c.get("up", 0.0), c.get("down", 0.0)
        alarm = np.zeros(len(z), np.int32)
        for i, value in enumerate(z):
            up, down = max(0.0, up + value - drift), max(0.0, down - value - drift)
            if up > threshold or down > threshold:
                alarm[i] = 1 if up > threshold else -1
                up = down = 0.0
        c.kept |= {"up": up, "down": down}
        return {"alarm": alarm}

    rows = _with_stats(df, s, __mean=F.avg(x), __spread=F.stddev_samp(x))
    return scanned(rows, s, [x, "__mean", "__spread"], kernel, {"alarm": "int"}).drop("__mean", "__spread")


def kalman_level(df: DataFrame, s: Series = TICKS, x: str = "price", process: float = 1e-3, measure: float = 1e-1) -> DataFrame:
    """Local-level Kalman filter from the first value; a null value leaves the level and widens the spread."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        v = f[x].to_numpy(float)
        out, level, spread = np.empty(len(v)), c.get("level", np.nan), c.get("spread", 1.0)
        for i, value in enumerate(v):
            spread += process
            if not np.isnan(value):
                gain = spread / (spread + measure)
                level = value if np.isnan(level) else level + gain * (value - level)
                spread *= 1 - gain
            out[i] = level
        c.kept |= {"level": level, "spread": spread}
        return {"level": out}

    return scanned(df, s, [x], kernel, {"level": "double"})


def circuit_breaker(df: DataFrame, s: Series = TICKS, x: str = "ret", most: float = 0.2, pause: int = 5) -> DataFrame:
    """Trading stops for pause rows once the loss from the peak of what was traded exceeds most; then the peak restarts."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        r = f[x].fillna(0.0).to_numpy(float)
        equity, peak, wait = c.get("equity", 1.0), c.get("peak", 1.0), c.get("wait", 0)
        on, curve = np.ones(len(r), bool), np.empty(len(r))
        for i, value in enumerate(r):
            if wait:
                on[i], wait = False, wait - 1
                if not wait:
                    peak = equity
            else:
                equity *= 1 + value
                peak = max(peak, equity)
                if equity < peak * (1 - most):
                    wait = pause
            curve[i] = equity
        c.kept |= {"equity": equity, "peak": peak, "wait": wait}
        return {"trading": on, "equity": curve}

    return scanned(df, s, [x], kernel, {"trading": "boolean", "equity": "double"})


def dynamic_threshold(df: DataFrame, s: Series = TICKS, x: str = "score", start: float = 0.3, rate: float = 0.05, target: float = 0.2) -> DataFrame:
    """A threshold that rises after each signal and falls otherwise, so that about target of the rows signal."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        v = f[x].fillna(0.0).to_numpy(float)
        level, out, levels = c.get("level", start), np.zeros(len(v), np.int32), np.empty(len(v))
        for i, value in enumerate(v):
            levels[i] = level
            out[i] = int(abs(value) > level) * int(np.sign(value))
            level = max(0.0, level + rate * ((out[i] != 0) - target))
        c.kept["level"] = level
        return {"signal": out, "threshold": levels}

    return scanned(df, s, [x], kernel, {"signal": "int", "threshold": "double"})


def threshold_policy(df: DataFrame, s: Series = TICKS, prob: str = "prob_up", ret: str = "ret", start: float = 0.5, rate: float = 0.1, after: int = 5) -> DataFrame:
    """Signals of a threshold that learns: after so many wrong predictions it moves at the rate towards one half and their
    mean distance from one half, within 0.2 to 0.8. A row without return or prediction teaches nothing."""

    def kernel(f: pd.DataFrame, c: Carry) -> dict:
        p, r = f[prob].to_numpy(float), f[ret].to_numpy(float)
        level, wrong, total = c.get("level", start), c.get("wrong", 0), c.get("total", 0.0)
        out, levels = np.zeros(len(p), np.int32), np.empty(len(p))
        for i in range(len(p)):
            levels[i] = level
            out[i] = 1 if p[i] > level else -1 if p[i] < 1 - level else 0
            if np.isnan(p[i]) or np.isnan(r[i]) or (p[i] > 0.5 and r[i] > 0) or (p[i] < 0.5 and r[i] < 0):
                continue
            wrong, total = wrong + 1, total + abs(p[i] - 0.5)
            if wrong == after:
                level = max(0.2, min(0.8, rate * (0.5 + total / after) + (1 - rate) * level))
                wrong, total = 0, 0.0
        c.kept |= {"level": level, "wrong": wrong, "total": total}
        return {"signal": out, "threshold": levels}

    return scanned(df, s, [prob, ret], kernel, {"signal": "int", "threshold": "double"})
