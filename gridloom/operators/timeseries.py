"""Ordered series: rolling anomalies, autocorrelation, walk-forward folds, smoothing forecasts.

A series is ``(series, pos, value)``; windows are always partitioned by the series.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import DataValidationError
from gridloom.functions.joins import join_groups
from gridloom.functions.quantiles import median_of


def _centred(series: str, pos: str, window: int):
    """The pandas-style centred frame of ``window`` rows."""
    return Window.partitionBy(series).orderBy(pos).rowsBetween(-(window // 2), window - 1 - window // 2)


def rolling_mean_anomalies(df: DataFrame, window: int = 48, n_sigma: float = 3.0, series: str = "series", pos: str = "pos", value: str = "value") -> DataFrame:
    """``series, pos, value, centre, spread, is_anomaly``: beyond n sample deviations of a centred mean.

    Frames that are not full, at both ends, flag nothing.
    """
    w = _centred(series, pos, window)
    full = F.count(value).over(w) == window
    rolled = df.select(
        series, pos, value,
        F.when(full, F.avg(value).over(w)).alias("centre"),
        F.when(full, F.stddev_samp(value).over(w)).alias("spread"),
    )
    return rolled.withColumn("is_anomaly", F.coalesce(F.abs(F.col(value) - F.col("centre")) > n_sigma * F.col("spread"), F.lit(False)))


def rolling_median_anomalies(df: DataFrame, window: int = 48, n_sigma: float = 3.0, series: str = "series", pos: str = "pos", value: str = "value") -> DataFrame:
    """As the mean rule, with the median and 1.4826 times the median absolute deviation of the frame."""
    w = _centred(series, pos, window)
    framed = df.select(series, pos, value, F.collect_list(value).over(w).alias("frame_"))
    full = F.size("frame_") == window
    centred = framed.withColumn("centre", F.when(full, median_of(F.array_sort("frame_"))))
    off = F.array_sort(F.transform("frame_", lambda v: F.abs(v - F.col("centre"))))
    spread = centred.withColumn("spread", F.when(full, 1.4826 * median_of(off))).drop("frame_")
    return spread.withColumn("is_anomaly", F.coalesce(F.abs(F.col(value) - F.col("centre")) > n_sigma * F.col("spread"), F.lit(False)))


def residual_anomalies(df: DataFrame, residual: str, n_sigma: float = 3.0, series: str = "series") -> DataFrame:
    """``is_anomaly``: residuals beyond n population deviations of their series' mean."""
    stats = df.groupBy(series).agg(F.avg(residual).alias("m_"), F.stddev_pop(residual).alias("s_"))
    return (
        join_groups(df, stats, series)
        .withColumn("is_anomaly", F.coalesce(F.abs(F.col(residual) - F.col("m_")) > n_sigma * F.col("s_"), F.lit(False)))
        .drop("m_", "s_")
    )


def sequences(df: DataFrame, length: int, series: str = "series", pos: str = "pos", value: str = "value") -> DataFrame:
    """Overlapping runs of ``length`` values at stride one; ``pos`` is that of the last value."""
    w = Window.partitionBy(series).orderBy(pos).rowsBetween(-(length - 1), 0)
    return df.select(series, pos, F.collect_list(value).over(w).alias("sequence")).where(F.size("sequence") == length)


def sequence_errors(df: DataFrame, length: int = 24, k: int = 2, series: str = "series", pos: str = "pos", value: str = "value") -> DataFrame:
    """``series, pos, error``: squared distance of each run of ``length`` values to the k main shapes of all runs.

    Runs are taken less their mean. Principal components of the runs stand in for a convolutional
    autoencoder, which they are not. ``residual_anomalies`` of the errors flags odd runs.
    """
    runs = sequences(df.where(F.col(value).isNotNull()), length, series, pos, value)
    mean = F.aggregate("sequence", F.lit(0.0), lambda s, v: s + v) / length
    flat = runs.withColumn("m_", mean).select(series, pos, F.transform("sequence", lambda v: v - F.col("m_")).alias("x_"))
    ready = flat.withColumn("features", array_to_vector("x_"))
    fitted = PCA(k=min(k, length), inputCol="features", outputCol="pc_").fit(ready)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    found = fitted.transform(ready).withColumn("p_", vector_to_array("pc_"))
    return found.select(series, pos, F.greatest(F.lit(0.0), square("x_") - square("p_")).alias("error"))


def autocorrelation(df: DataFrame, most_lags: int = 100, series: str = "series", pos: str = "pos", value: str = "value") -> DataFrame:
    """``series, lag, acf`` for lags 0 to min(n / 2, most_lags).

    Each value is paired with the one ``lag`` places on by an equi-join on place, so lags are
    computed side by side; products are summed before they are shuffled.
    """
    stats = df.groupBy(series).agg(F.avg(value).alias("m_"), F.count("*").alias("n_"))
    place = F.row_number().over(Window.partitionBy(series).orderBy(pos)).alias("i_")
    x = join_groups(df.select(series, place, value), stats, series).select(series, "i_", "n_", (F.col(value) - F.col("m_")).alias("d_"))
    lags = F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("n_") / 2), F.lit(most_lags)).cast("int")))
    ahead = x.select(series, "d_", "i_", lags.alias("lag")).withColumn("i_", F.col("i_") + F.col("lag"))
    pairs = join_groups(ahead, x.select(series, "i_", F.col("d_").alias("e_")), series, "i_", how="inner")
    sums = pairs.groupBy(series, "lag").agg(F.sum(F.col("d_") * F.col("e_")).alias("p_"))
    var = x.groupBy(series).agg(F.sum(F.col("d_") * F.col("d_")).alias("v_"))
    return join_groups(sums, var, series).select(series, "lag", F.try_divide(F.col("p_"), F.col("v_")).alias("acf"))


def seasonal_period(acf: DataFrame, above: float = 0.1, series: str = "series") -> DataFrame:
    """``series, period``: the first lag from 2 on that is a local peak above the bound, else 1."""
    w = Window.partitionBy(series).orderBy("lag")
    peak = (F.col("acf") > F.lag("acf").over(w)) & (F.col("acf") > F.lead("acf").over(w)) & (F.col("acf") > above) & (F.col("lag") >= 2)
    marked = acf.select(series, F.when(peak, F.col("lag")).alias("p_"))
    return marked.groupBy(series).agg(F.coalesce(F.min("p_"), F.lit(1)).alias("period"))


def walk_forward(df: DataFrame, k: int, horizon: int, series: str = "series") -> DataFrame:
    """``series, fold, train_end, test_end``: expanding windows; each fold tests the next ``horizon``.

    The first trains on n - k * horizon values, or max(10, n // 2) if that is under ten.
    """
    sizes = df.groupBy(series).agg(F.count("*").alias("n_"))
    first = F.col("n_") - k * horizon
    first = F.when(first < 10, F.greatest(F.lit(10), F.floor(F.col("n_") / 2))).otherwise(first)
    spine = sizes.select(series, "n_", first.alias("first_"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    end = F.col("first_") + F.col("fold") * horizon
    return spine.where(end < F.col("n_")).select(series, "fold", end.cast("long").alias("train_end"), F.least(end + horizon, F.col("n_")).cast("long").alias("test_end"))


def walk_forward_scores(
    df: DataFrame, k: int, horizon: int, period: int = 1, alpha: float | None = None, series: str = "series", pos: str = "pos", value: str = "value"
) -> DataFrame:
    """``series, fold, n, mae, rmse, mape``: exponential smoothing fitted before each fold's end, against what follows.

    A task for each fold of each series; values are repeated once for each fold that learns from or tests them.
    """
    place = F.row_number().over(Window.partitionBy(series).orderBy(pos)).alias("at_")
    ends = walk_forward(df.where(F.col(value).isNotNull()), k, horizon, series)
    rows = join_groups(df.where(F.col(value).isNotNull()).select(series, place, F.col(value).cast("double").alias("v_")), ends, series, how="inner").where("at_ <= test_end")
    kind = df.schema[series].dataType.simpleString()

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values("at_")["v_"].to_numpy(float)
        known = int(frame["train_end"].iloc[0])
        choices = [alpha] if alpha is not None else [a / 10 for a in range(1, 10)]
        ahead, _ = min((_smooth(y[:known], period, a, 0.1, 0.1, horizon) for a in choices), key=lambda r: r[1])
        e = y[known:] - ahead[: len(y) - known]
        share = float(np.mean(np.abs(e / (y[known:] + 1e-8))) * 100) if len(e) else None
        return pd.DataFrame(
            {series: [frame[series].iloc[0]], "fold": [int(frame["fold"].iloc[0])], "n": [len(e)], "mae": [float(np.mean(np.abs(e)))], "rmse": [float(np.sqrt(np.mean(e**2)))], "mape": [share]}
        )

    return rows.groupBy(series, "fold").applyInPandas(judge, f"`{series}` {kind}, fold int, n long, mae double, rmse double, mape double")


def auto_method(n: int, period: int) -> str:
    """Which forecast suits a series of n values with this period."""
    if period > 1:
        return "sarima" if n > 2 * period else "exp_smoothing"
    return "arima"


def _smooth(y: np.ndarray, period: int, alpha: float, beta: float, gamma: float, horizon: int) -> tuple[np.ndarray, float]:
    """Additive trend, and season if the period is over 1 and fits twice; forecasts and residual variance."""
    seasonal = period > 1 and len(y) >= 2 * period
    if seasonal:
        level = y[:period].mean()
        trend = (y[period : 2 * period].mean() - level) / period
        season = list(y[:period] - level)
    else:
        level, trend, season = y[0], (y[1] - y[0] if len(y) > 1 else 0.0), [0.0]
    errors = []
    m = len(season)
    for t, v in enumerate(y):
        s = season[t % m]
        errors.append(v - (level + trend + s))
        new = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        if seasonal:
            season[t % m] = gamma * (v - new) + (1 - gamma) * s
        level = new
    steps = np.arange(1, horizon + 1)
    ahead = level + steps * trend + np.array([season[(len(y) + h - 1) % m] for h in steps])
    return ahead, float(np.var(errors[1:])) if len(errors) > 1 else 0.0


def forecast(
    df: DataFrame, horizon: int = 12, period: int = 1, alpha: float | None = None, beta: float = 0.1, gamma: float = 0.1,
    series: str = "series", pos: str = "pos", value: str = "value", z: float = 1.959963984540054,
) -> DataFrame:
    """``series, step, forecast, lower, upper`` by exponential smoothing, a task for each series.

    Without ``alpha`` the one of 0.1 to 0.9 with the least squared error is taken for each series.
    The interval is normal with the residual variance. Series need ten values.
    """
    kind = df.schema[series].dataType.simpleString()

    def ahead(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values(pos)[value].dropna().to_numpy(float)
        if len(y) < 10:
            raise DataValidationError("a forecast needs ten values")
        choices = [alpha] if alpha is not None else [a / 10 for a in range(1, 10)]
        values, var = min((_smooth(y, period, a, beta, gamma, horizon) for a in choices), key=lambda r: r[1])
        half = z * np.sqrt(var * np.arange(1, horizon + 1))
        return pd.DataFrame({series: frame[series].iloc[0], "step": range(1, horizon + 1), "forecast": values, "lower": values - half, "upper": values + half})

    return df.select(series, pos, value).groupBy(series).applyInPandas(ahead, f"`{series}` {kind}, step long, forecast double, lower double, upper double")


def _css(y: np.ndarray, p: int, q: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Hannan-Rissanen estimates of an ARMA(p, q) with constant; coefficients, variance and residuals."""
    n, k = len(y), max(p, q)
    if q:
        m = min(max(p + q, 4), n // 3)
        x = np.column_stack([np.ones(n - m)] + [y[m - i - 1 : n - i - 1] for i in range(m)])
        e = np.concatenate((np.zeros(m), y[m:] - x @ np.linalg.lstsq(x, y[m:], rcond=None)[0]))
        k = max(k, m)
    else:
        e = np.zeros(n)
    x = np.column_stack([np.ones(n - k)] + [y[k - i - 1 : n - i - 1] for i in range(p)] + [e[k - i - 1 : n - i - 1] for i in range(q)])
    coef = np.linalg.lstsq(x, y[k:], rcond=None)[0]
    res = y[k:] - x @ coef
    return coef, float(res @ res / max(len(res), 1)), np.concatenate((np.zeros(k), res))


def arima(df: DataFrame, horizon: int = 12, series: str = "series", pos: str = "pos", value: str = "value", z: float = 1.959963984540054) -> DataFrame:
    """As ``forecast``, by the ARIMA(p<=2, d<=1, q<=2) with the least AIC on conditional least squares."""
    kind = df.schema[series].dataType.simpleString()

    def ahead(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values(pos)[value].dropna().to_numpy(float)
        if len(y) < 10:
            raise DataValidationError("a forecast needs ten values")
        best = None
        for d in (0, 1):
            w = np.diff(y, d) if d else y
            for p in range(3):
                for q in range(3):
                    coef, var, res = _css(w, p, q)
                    aic = len(w) * np.log(max(var, 1e-12)) + 2 * (p + q + 1)
                    if best is None or aic < best[0]:
                        best = (aic, d, p, q, coef, var, res, w)
        _, d, p, q, coef, var, res, w = best
        past, errors, out = list(w), list(res), []
        for _ in range(horizon):
            v = coef[0] + sum(coef[1 + i] * past[-1 - i] for i in range(p)) + sum(coef[1 + p + i] * errors[-1 - i] for i in range(q))
            past.append(v)
            errors.append(0.0)
            out.append(v)
        values = y[-1] + np.cumsum(out) if d else np.array(out)
        half = z * np.sqrt(var * (np.arange(1, horizon + 1) if d else np.ones(horizon)))
        return pd.DataFrame({series: frame[series].iloc[0], "step": range(1, horizon + 1), "forecast": values, "lower": values - half, "upper": values + half})

    return df.select(series, pos, value).groupBy(series).applyInPandas(ahead, f"`{series}` {kind}, step long, forecast double, lower double, upper double")




def _descend(f, start: np.ndarray, step: float = 0.2, rounds: int = 120) -> np.ndarray:
    """The simplex search of Nelder and Mead."""
    points = [start] + [start + step * e for e in np.eye(len(start))]
    values = [f(x) for x in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= 1e-10 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = [(f(x), x) for x in (centre + (centre - points[-1]),)]
        if tried[0][0] < values[0]:
            x = centre + 2 * (centre - points[-1])
            tried.append((f(x), x))
        elif tried[0][0] >= values[-2]:
            x = centre + 0.5 * ((tried[0][1] if tried[0][0] < values[-1] else points[-1]) - centre)
            tried.append((f(x), x))
        best = min(tried, key=lambda t: t[0])
        if best[0] < values[-1]:
            values[-1], points[-1] = best
        else:
            points = [points[0]] + [(p + points[0]) / 2 for p in points[1:]]
            values = [values[0]] + [f(x) for x in points[1:]]
    return points[int(np.argmin(values))]


def _seasonal_errors(w: np.ndarray, p: np.ndarray, s: int) -> np.ndarray:
    """One-step errors of the multiplicative seasonal model on the differenced series, by lags 1, s and s + 1."""
    a, b, c, d = p
    e = np.zeros(len(w))
    ar = w.copy()
    ar[1:] -= a * w[:-1]
    ar[s:] -= b * w[: len(w) - s]
    ar[s + 1 :] += a * b * w[: len(w) - s - 1]
    values = ar.tolist()
    out = [0.0] * len(w)
    for t, v in enumerate(values):
        if t:
            v -= c * out[t - 1]
        if t >= s:
            v -= d * out[t - s]
        if t > s:
            v -= c * d * out[t - s - 1]
        out[t] = v
    e[:] = out
    return e


def sarima(df: DataFrame, horizon: int = 12, period: int = 12, series: str = "series", pos: str = "pos", value: str = "value", z: float = 1.959963984540054) -> DataFrame:
    """As ``forecast``, by the multiplicative seasonal ARIMA(1,1,1)(1,1,1) of the period.

    The four coefficients minimise the conditional sum of squares within the unit interval; the
    interval grows with the weights of past shocks. A series needs over two periods, else an error is
    raised. A series is a task.
    """
    if period < 2:
        raise DataValidationError("a seasonal model needs a period")
    kind = df.schema[series].dataType.simpleString()

    def ahead(frame: pd.DataFrame) -> pd.DataFrame:
        y = frame.sort_values(pos)[value].dropna().to_numpy(float)
        if len(y) < max(10, 2 * period + 2):
            raise DataValidationError("a seasonal forecast needs over two periods")
        w = np.diff(y)
        w = w[period:] - w[:-period]

        def loss(p: np.ndarray) -> float:
            over = np.maximum(np.abs(p) - 0.98, 0).sum()
            e = _seasonal_errors(w, np.clip(p, -0.98, 0.98), period)
            return float(e @ e) * (1 + over)

        p = np.clip(_descend(loss, np.zeros(4)), -0.98, 0.98)
        e = _seasonal_errors(w, p, period)
        var = float(e @ e / len(e))
        a, b, c, d = p
        w2, e2, y2 = w.tolist(), e.tolist(), y.tolist()
        weights = []
        shock_w, shock_e, shock_y = [0.0] * (period + 1), [0.0] * (period + 1), [0.0] * (period + 1)
        step = lambda w, e: a * w[-1] + b * w[-period] - a * b * w[-period - 1] + c * e[-1] + d * e[-period] + c * d * e[-period - 1]
        pad = [0.0] * (period + 2)
        w2, e2 = pad + w2, pad + e2
        for h in range(horizon):
            v = step(w2, e2)
            w2.append(v)
            e2.append(0.0)
            y2.append(v + y2[-1] + y2[-period] - y2[-period - 1])
            v = (step(shock_w, shock_e) if h else 0.0) + (0.0 if h else 1.0)
            shock_w.append(v)
            shock_e.append(0.0 if h else 1.0)
            shock_y.append(v + shock_y[-1] + shock_y[-period] - shock_y[-period - 1])
            weights.append(shock_y[-1])
        half = z * np.sqrt(var * np.cumsum(np.square(weights)))
        values = np.array(y2[len(y) :])
        return pd.DataFrame({series: frame[series].iloc[0], "step": range(1, horizon + 1), "forecast": values, "lower": values - half, "upper": values + half})

    return df.select(series, pos, value).groupBy(series).applyInPandas(ahead, f"`{series}` {kind}, step long, forecast double, lower double, upper double")
