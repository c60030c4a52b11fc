"""Noise models: correlated-mode products and spectrum fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nmat_apply(ft: DataFrame, bins: DataFrame, diag: DataFrame, vecs: DataFrame, s: float = 1.0, norm: float = 1.0, pairs: bool = True) -> DataFrame:
    """Applies a noise model bin by bin: ft = diag/norm ft + s/norm V (V^T ft).

    ft: det, mode, v; bins: bin, b0, b1 (in frequencies, two modes each, or one
    with pairs=False); diag: bin, det, d; vecs: bin, det, vec, w.  Modes outside
    all bins are kept.  Both products are aggregations; the sums over detectors
    are partial before the shuffle.
    """
    k = 2 if pairs else 1
    n = (F.col("n_modes") - 1).cast("long")
    span = bins.join(F.broadcast(ft.agg((F.max("mode") + 1).alias("n_modes"))))  # one row
    at = span.select("bin", F.least(F.col("b0") * k, n).alias("lo"), F.least(F.col("b1") * k, F.col("n_modes").cast("long")).alias("hi")).where("lo < hi")
    at = at.select("bin", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("mode"))
    inside = ft.join(at, "mode").join(diag, ["bin", "det"])
    q = ft.join(at, "mode").join(vecs, ["bin", "det"]).groupBy("bin", "vec", "mode").agg(F.sum(F.col("w") * F.col("v")).alias("q"))
    back = vecs.join(q, ["bin", "vec"]).groupBy("det", "mode").agg(F.sum(F.col("w") * F.col("q")).alias("low"))
    done = inside.join(back, ["det", "mode"], "left").select("det", "mode", (F.col("d") / norm * F.col("v") + s / norm * F.coalesce("low", F.lit(0.0))).alias("v"))
    return done.unionByName(ft.join(at.select("mode"), "mode", "left_anti").select("det", "mode", "v"))


def _model(p, f):
    return p[1] * (1 + (p[0] / f) ** p[2])


def _loss(p, f, y):
    if p[1] <= 0 or p[0] <= 0:
        return np.inf
    with np.errstate(all="ignore"):
        m = _model(p, f)
        return float(np.sum(np.log(m) + y / m)) if np.all(m > 0) else np.inf


def _hessian(p, f, y, eps):
    h = np.empty((3, 3))
    step = eps * np.maximum(np.abs(p), 1e-12)
    for i in range(3):
        for j in range(3):
            a, b = np.eye(3)[i] * step[i], np.eye(3)[j] * step[j]
            h[i, j] = (_loss(p + a + b, f, y) - _loss(p + a - b, f, y) - _loss(p - a + b, f, y) + _loss(p - a - b, f, y)) / (4 * step[i] * step[j])
    return h


def fit_one(f, y, low_f, white_lo, white_hi, tol=1e-8, rounds=600, eps=1e-4):
    """(knee, white, alpha) and their errors by damped Newton steps on the likelihood; NaN where that fails."""
    nan = np.full(3, np.nan)
    if white_lo < low_f or white_lo >= white_hi:
        raise ValueError("white noise range must lie above the low range and not be empty")
    f, y = np.asarray(f, float), np.asarray(y, float)
    last = lambda v: int(np.flatnonzero(f <= v)[-1]) if (f <= v).any() else 0
    lo, wl, wh = last(low_f), last(white_lo), last(white_hi)
    white = float(np.median(y[wl : wh + 1]))
    with np.errstate(all="ignore"):
        slope, level = np.polyfit(np.log10(f[: lo + 1]), np.log10(y[: lo + 1]), 1) if lo > 0 else (-1.0, np.log10(y[0]))
    slope, level = min(slope, -1e-3), max(level, 0.0)
    knee = float(f[np.flatnonzero(np.abs(10 ** (level + slope * np.log10(f)) - white) == np.abs(10 ** (level + slope * np.log10(f)) - white).min())[-1]])
    p = np.array([max(knee, f[0]), white, -slope])
    # logs keep the parameters positive on the way
    q, best = np.log(np.maximum(p, 1e-9)), _loss(p, f, y)
    damp = 1e-3
    for _ in range(rounds):
        p = np.exp(q)
        m = _model(p, f)
        ratio = (p[0] / f) ** p[2]
        part = np.stack((p[1] * ratio * p[2], m, p[1] * ratio * p[2] * np.log(p[0] / f)))  # d m / d log p
        g = (part * ((1 - y / m) / m)).sum(1)
        fisher = (part / m) @ (part / m).T
        try:
            step = np.linalg.solve(fisher + damp * np.diag(np.diag(fisher) + 1e-12), g)
        except np.linalg.LinAlgError:
            return nan, nan
        new = _loss(np.exp(q - step), f, y)
        if new <= best:
            gain, best, q, damp = best - new, new, q - step, damp / 5
            if gain <= tol * abs(best):
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    p = np.exp(q)
    if not np.isfinite(p).all():
        return nan, nan
    try:
        with np.errstate(all="ignore"):
            error = np.sqrt(np.diag(np.linalg.inv(_hessian(p, f, y, eps))))
    except np.linalg.LinAlgError:
        error = nan
    return p, error


def fit_noise(psd: DataFrame, low_f: float, white_lo: float, white_hi: float, tol: float = 1e-8, rounds: int = 600) -> DataFrame:
    """det, knee, white, alpha and errors of every detector's spectrum (det, f, pxx)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("f")
        p, e = fit_one(g["f"], g["pxx"], low_f, white_lo, white_hi, tol, rounds)
        return pd.DataFrame({"det": [g["det"].iloc[0]], "knee": [p[0]], "white": [p[1]], "alpha": [p[2]], "knee_err": [e[0]], "white_err": [e[1]], "alpha_err": [e[2]]})

    return psd.select("det", "f", "pxx").groupBy("det").applyInPandas(run, "det long, knee double, white double, alpha double, knee_err double, white_err double, alpha_err double")


def frequency_index(freqs: DataFrame, value: float) -> DataFrame:
    """Last index with f <= value for every detector."""
    return freqs.groupBy("det").agg(F.max(F.when(F.col("f") <= value, F.col("i"))).alias("i"))
