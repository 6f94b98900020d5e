"""Portfolios by conic programs: a variance cap (a second-order cone) and the market impact of trades (powers of 3/2), date by date.

Each rebalance date is a problem of its own, and dates are solved in parallel by a splitting method: the weights agree with a copy
in the box and the budget, a copy of their risk in a ball, and a copy of their trades in the impact's proximal map; one
factorisation serves all steps of a date. A date's task has its stocks' returns and as many eigenvectors as dates look back: memory
and a step's time grow with the stocks that are tradable on that date, not with their square.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.books import Spectrum, by_date, histories, project


def traded_least(v: np.ndarray, cost: float) -> np.ndarray:
    """argmin over x of cost * |x|^(3/2) + (x - v)^2 / 2, componentwise: a quadratic in the root of |x|."""
    root = (-1.5 * cost + np.sqrt((1.5 * cost) ** 2 + 4 * np.abs(v))) / 2
    return np.sign(v) * root**2


def into_ball(v: np.ndarray, radius: float) -> np.ndarray:
    size = np.linalg.norm(v)
    return v if size <= radius else v * (radius / size)


def solve(mu: np.ndarray, cov: np.ndarray | Spectrum, before: np.ndarray, aversion: float = 1.0, impact: float = 0.0, variance: float | None = None, cap: float = 0.05, total: float = 1.0, low: float = 0.0, steps: int = 5000, close: float = 1e-9) -> np.ndarray:
    """argmax mu.w - aversion * w'cov w - impact * sum |w - before|^(3/2) with sum w = total, low <= w <= cap and, with variance, w'cov w <= variance.

    Where no weights of the budget and the box are under the variance, those come out that are between both sets.
    """
    p = len(mu)
    cap = max(cap, total / p)
    cov = Spectrum.of(cov).at_least(1e-12)
    vectors, largest = cov.vectors, cov.largest()
    scale = 1 / max(largest, 1e-12)  # the risk's copy is as large as the weights
    rate = max(2 * aversion * cov.mean(), np.abs(mu).max() / max(cap, 1e-9) / 10, 1e-6)
    # (2 aversion cov + rate (1 + 1 + scale cov)) w = ..., along the eigenvectors and, by one number, beside them; risk @ risk = scale cov
    diagonal, beside = (2 * aversion * v + rate * (2 + (scale * v if variance is not None else 0)) for v in (cov.values, cov.rest))
    risk, risk_beside = np.sqrt(scale * cov.values), np.sqrt(scale * cov.rest)
    box = project(np.full(p, total / p), total, low, cap)
    ball, trades = risk_beside * box + vectors @ ((risk - risk_beside) * (box @ vectors)), box - before
    a, b, c = np.zeros(p), np.zeros(p), np.zeros(p)
    for _ in range(steps):
        right = mu + rate * ((box - a) + (trades + before - c))
        if variance is not None:
            # of both vectors at once along the eigenvectors, and back
            apart = ball - b
            along, along_apart = np.stack([right, apart]) @ vectors
            all_along = (along + rate * risk * along_apart) / diagonal
            right = right + rate * (risk_beside * apart)
            along = along + rate * risk_beside * along_apart
            w, of = (vectors @ np.stack([all_along - along / beside, (risk - risk_beside) * all_along], axis=1)).T
            w = w + right / beside
            of = of + risk_beside * w
        else:
            along = right @ vectors
            w = right / beside + vectors @ (along / diagonal - along / beside)
        held = box
        box = project(w + a, total, low, cap)
        a = a + w - box
        if variance is not None:
            ball = into_ball(of + b, np.sqrt(scale * variance))
            b = b + of - ball
        trades = traded_least(w - before + c, impact / rate)
        c = c + w - before - trades
        if max(np.abs(w - box).max(), np.abs(box - held).max(), np.abs(w - before - trades).max()) < close:
            break
    return box


def programmes(rows: DataFrame, aversions=(1.0,), impact: float = 0.0, variance: float | None = None, cap: float = 0.05, lookback: int = 60, step: int = 20, least: int = 5, most: int | None = None) -> DataFrame:
    """aversion, t, n, weight, expected, variance on every step-th date, for each aversion; trades are from equal weights of the date's stocks.

    rows: t, n, score, ret, valid. most: only so many stocks of a date, by score; by default all.
    """

    def points(mu, cov):
        before = np.full(len(mu), 1 / len(mu))
        return ((aversion, solve(mu, cov, before, aversion, impact, variance, cap)) for aversion in aversions)

    return by_date(histories(rows, lookback, step, most), lookback, least, points)


def frontier(solved: DataFrame) -> DataFrame:
    """aversion, expected and variance: means over dates of a frontier's points."""
    points = solved.groupBy("aversion", "t").agg(F.max("expected").alias("expected"), F.max("variance").alias("variance"))
    return points.groupBy("aversion").agg(F.avg("expected").alias("expected"), F.avg("variance").alias("variance"))
