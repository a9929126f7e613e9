"""Zero-inflated negative-binomial counts by expectation-maximisation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from standlab.operators.gram import partial_sums


def _log_gamma_ratio(values: np.ndarray, theta: float) -> np.ndarray:
    """ln Gamma(y + theta) - ln Gamma(theta) - ln y! of distinct counts."""
    return np.array([math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1) for v in values])


def _log_nb(v, values, at, mu, log_mu, theta):
    """Log probabilities of counts ``v``, which are ``values[at]``."""
    far = np.log(theta + mu)
    return _log_gamma_ratio(values, theta)[at] + theta * (math.log(theta) - far) + v * (log_mu - far)


def _dispersion(v, values, at, mu, log_mu, weight, grid) -> list[float]:
    """Weighted sums of the log probabilities at every trial dispersion.

    The gamma terms depend on the count alone, so rows enter them as weights of the few distinct
    counts; what is left is one logarithm a row and trial.
    """
    per_count = np.bincount(at, weight, len(values))
    seen, fixed = per_count @ values, weight @ (v * log_mu)
    return [float(per_count @ _log_gamma_ratio(values, th) + fixed - math.log(th) * seen
                  - (weight * (th + v)) @ np.log(1 + mu / th)) for th in grid]


def zinb(df: DataFrame, y: str, count_terms: list[str], zero_terms: list[str], max_iter: int = 500,
         tol: float = 1e-8) -> dict:
    """Fit count mean (log link), dispersion and excess-zero probability (logit link).

    One pass per iteration sums both parts' Newton systems and the dispersion grid; the
    driver holds only the coefficients.  Terms are standardised inside.  The fit stops when no
    standardised coefficient and no log dispersion moves by ``tol`` or more; a fit that has not
    stopped after ``max_iter`` steps raises.
    """
    terms = list(dict.fromkeys([*count_terms, *zero_terms]))
    rows = df.dropna(subset=[y, *terms]).select(F.col(y).cast("double").alias("_y"),
                                                *[F.col(c).cast("double").alias(c) for c in terms])
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y"),
                 F.avg((F.col("_y") == 0).cast("double")).alias("z"),
                 F.array(*[F.avg(c) for c in terms]).alias("m"),
                 F.array(*[F.stddev_pop(c) for c in terms]).alias("s")).first()
    centre, scale = np.array(s["m"], float), np.maximum(np.array(s["s"], float), 1e-9)
    ci = np.array([terms.index(c) for c in count_terms], int)
    zi = np.array([terms.index(c) for c in zero_terms], int)
    p, q, n = len(ci) + 1, len(zi) + 1, s["n"]
    beta, gamma = np.zeros(p), np.zeros(q)
    beta[0] = math.log(max(s["y"] / max(1 - s["z"] / 2, 0.1), 1e-6))
    gamma[0] = math.log(max(s["z"] / 2, 1e-4) / (1 - max(s["z"] / 2, 1e-4)))
    theta, width, loglik, converged = 1.0, 1.5, -np.inf, False
    size = p * p + p + q * q + q + 1 + 15
    rows = rows.persist()
    try:
        for step in range(max_iter):
            grid = theta * np.exp(np.linspace(-width, width, 15))

            def kernel(x, beta=beta, gamma=gamma, theta=theta, grid=grid):
                v, t = x[:, 0], (x[:, 1:] - centre) / scale
                one = np.ones((len(v), 1))
                xc, xz = np.hstack([one, t[:, ci]]), np.hstack([one, t[:, zi]])
                log_mu = np.clip(xc @ beta, -30, 30)
                mu = np.exp(log_mu)
                pi = 1 / (1 + np.exp(-np.clip(xz @ gamma, -30, 30)))
                values, at = np.unique(v, return_inverse=True)
                lnb = _log_nb(v, values, at, mu, log_mu, theta)
                mix = np.where(v == 0, pi, 0.0) + (1 - pi) * np.exp(lnb)
                excess = np.where(v == 0, pi / mix, 0.0)
                keep = 1 - excess
                wc = keep * mu / (1 + mu / theta)
                gc = xc.T @ (keep * (v - mu) / (1 + mu / theta))
                wz = pi * (1 - pi)
                gz = xz.T @ (excess - pi)
                disp = _dispersion(v, values, at, mu, log_mu, keep, grid)
                return np.concatenate([(xc.T * wc @ xc).ravel(), gc, (xz.T * wz @ xz).ravel(), gz,
                                       [np.log(np.maximum(mix, 1e-300)).sum()], disp])

            out = partial_sums(rows, kernel, size)
            a, b = p * p, p * p + p
            hc, gc = out[:a].reshape(p, p), out[a:b]
            hz, gz = out[b:b + q * q].reshape(q, q), out[b + q * q:b + q * q + q]
            loglik, disp = out[b + q * q + q], out[b + q * q + q + 1:]
            to_beta, to_gamma = np.clip(np.linalg.pinv(hc) @ gc, -2, 2), np.clip(np.linalg.pinv(hz) @ gz, -2, 2)
            best = int(np.argmax(disp))
            old, theta = theta, float(grid[best])
            if 0 < best < 14:  # the top of the parabola through the best three, then a finer grid
                y0, y1, y2 = disp[best - 1:best + 2]
                bend = y0 - 2 * y1 + y2
                if bend < 0:
                    theta *= math.exp((y0 - y2) / (2 * bend) * width / 7)
                width = max(width / 2, 0.01)
            moved = max(np.abs(to_beta).max(), np.abs(to_gamma).max(), abs(math.log(theta / old)))
            if moved < tol:
                converged = True
                break
            beta, gamma = beta + to_beta, gamma + to_gamma
    finally:
        rows.unpersist()
    if not converged:
        raise ArithmeticError(f"no convergence in {max_iter} steps; the last moved by {moved:.1e}")

    def restore(coef, at):
        slope = coef[1:] / scale[at]
        return np.concatenate([[coef[0] - slope @ centre[at]], slope])

    return {"count": dict(zip(["(Intercept)", *count_terms], restore(beta, ci).tolist())),
            "zero": dict(zip(["(Intercept)", *zero_terms], restore(gamma, zi).tolist())),
            "theta": theta, "loglik": float(loglik), "n": n, "steps": step + 1, "converged": converged}


def zinb_response(fit: dict) -> Column:
    """Expected count: (1 - excess-zero probability) * count mean."""
    def line(part):
        return sum((F.lit(float(v)) * (F.lit(1.0) if k == "(Intercept)" else F.col(k))
                    for k, v in part.items()), F.lit(0.0))
    return F.exp(line(fit["count"])) / (1 + F.exp(line(fit["zero"])))
