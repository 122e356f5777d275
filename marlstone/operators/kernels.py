"""Numerical kernels on small dense arrays; they run inside Arrow-backed groups, one model a group."""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-12


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def normal_p(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else math.nan


def chi2_1_p(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2)) if math.isfinite(x) else math.nan


def zscore(x: np.ndarray, mean: np.ndarray | None = None, sd: np.ndarray | None = None) -> np.ndarray:
    """By population deviations; a column without spread stays centred."""
    mean = x.mean(axis=0) if mean is None else mean
    sd = x.std(axis=0) if sd is None else sd
    return (x - mean) / np.where(sd > 0, sd, 1.0)


def with_constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def fit_logit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.0, iterations: int = 100, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Newton fit of a logistic model whose first column is the constant: coefficients, covariance, log likelihood.

    ``ridge`` penalises squares of all but the constant by ridge/2, as 1/C does. Steps that lower the
    objective are halved, so separated data stop at large but finite coefficients. ``start`` are the
    coefficients to begin with (default: zero); the solution does not depend on them.
    """
    w = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0.0
    b = np.zeros(x.shape[1]) if start is None else start

    def objective(c: np.ndarray) -> float:
        e = x @ c
        return float((w * (y * e - np.logaddexp(0, e))).sum() - 0.5 * (penalty * c * c).sum())

    now = objective(b)
    for _ in range(iterations):
        p = sigmoid(x @ b)
        gradient = x.T @ (w * (y - p)) - penalty * b
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.pinv(hessian) @ gradient
        size = 1.0
        while size > 1e-8 and objective(b + size * step) < now:
            size /= 2
        b = b + size * step
        new = objective(b)
        if abs(new - now) < 1e-10 and np.abs(size * step).max() < 1e-8:
            break
        now = new
    p = sigmoid(x @ b)
    information = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
    e = x @ b
    return b, np.linalg.pinv(information), float((w * (y * e - np.logaddexp(0, e))).sum())


def fit_firth(x: np.ndarray, y: np.ndarray, fixed: int | None = None, iterations: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Logit penalised by Jeffreys' prior: coefficients and penalised log likelihood.

    ``fixed`` holds one coefficient at zero while the penalty keeps the whole model's information.
    """
    free = np.array([j for j in range(x.shape[1]) if j != fixed])
    b = np.zeros(x.shape[1])

    def objective(c: np.ndarray) -> float:
        p = np.clip(sigmoid(x @ c), EPS, 1 - EPS)
        sign, logdet = np.linalg.slogdet((x * (p * (1 - p))[:, None]).T @ x)
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (0.5 * logdet if sign > 0 else -np.inf))

    now = objective(b)
    for _ in range(iterations):
        p = np.clip(sigmoid(x @ b), EPS, 1 - EPS)
        w = p * (1 - p)
        inverse = np.linalg.pinv((x * w[:, None]).T @ x)
        leverage = w * np.einsum("ij,jk,ik->i", x, inverse, x)
        score = x[:, free].T @ (y - p + leverage * (0.5 - p))
        step = np.zeros_like(b)
        step[free] = np.linalg.pinv((x[:, free] * w[:, None]).T @ x[:, free]) @ score
        size = 1.0
        while size > 1e-6 and objective(b + size * step) < now - 1e-14:
            size /= 2
        b = b + size * step
        now = objective(b)
        if np.abs(size * step).max() < tolerance:
            break
    return b, now


def firth_test(x: np.ndarray, y: np.ndarray, j: int, compat: bool = False) -> tuple[float, float, float]:
    """Coefficient j, penalised likelihood-ratio statistic and p.

    The null model holds the coefficient at zero under the full penalty. ``compat`` deletes the
    column instead, whose penalties are of different size: it inflates the statistic.
    """
    b, full = fit_firth(x, y)
    null = fit_firth(np.delete(x, j, axis=1), y)[1] if compat else fit_firth(x, y, fixed=j)[1]
    stat = max(0.0, 2 * (full - null))
    return float(b[j]), stat, chi2_1_p(stat)


def auc(y: np.ndarray, p: np.ndarray) -> float:
    """Chance that an event scores above a non-event, ties one half."""
    pos = int(y.sum())
    if pos in (0, len(y)):
        return math.nan
    order = np.argsort(p, kind="stable")
    _, inverse, counts = np.unique(p[order], return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = np.empty(len(p))
    ranks[order] = (ends - (counts - 1) / 2)[inverse]
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def quantile_regression(x: np.ndarray, y: np.ndarray, tau: float, iterations: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and standard errors of the tau-th conditional quantile.

    Majorise-minimise steps on the smoothed check loss, sharpened as it converges; errors from the
    kernel sandwich with the Hall-Sheather bandwidth.
    """
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    smooth = max(1e-6, 1e-2 * float(np.std(y)))
    for k in range(iterations):
        r = y - x @ b
        w = 1.0 / (smooth + np.abs(r))
        new = np.linalg.pinv((x * w[:, None]).T @ x) @ (x.T @ (w * y + (2 * tau - 1)))
        moved = np.abs(new - b).max()
        b = new
        if moved < 1e-10:
            if smooth < 1e-9:
                break
            smooth /= 10
    r = y - x @ b
    n = len(y)
    z = _normal_quantile(0.975)
    q = _normal_quantile(tau)
    density = math.exp(-q * q / 2) / math.sqrt(2 * math.pi)
    h = n ** (-1 / 3) * z ** (2 / 3) * (1.5 * density**2 / (2 * q * q + 1)) ** (1 / 3)
    spread = min(np.std(r), (np.quantile(r, 0.75) - np.quantile(r, 0.25)) / 1.34) or 1e-9
    width = max(1e-12, spread * (_normal_quantile(min(tau + h, 1 - 1e-6)) - _normal_quantile(max(tau - h, 1e-6))))
    kernel = np.exp(-((r / width) ** 2) / 2) / math.sqrt(2 * math.pi) / width
    bread = np.linalg.pinv((x * kernel[:, None]).T @ x)
    cov = tau * (1 - tau) * bread @ (x.T @ x) @ bread
    return b, np.sqrt(np.maximum(np.diag(cov), 0))


def _normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by bisection on erfc."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def fit_gpd(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto fit to positive excesses: profile likelihood in one parameter."""
    x = np.asarray(excess, dtype=float)
    top, mean = x.max(), x.mean()
    theta = np.concatenate([-np.geomspace(1e-4, 0.999, 200) / top, np.geomspace(1e-4, 50, 300) / mean])

    def profile(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        xi = np.log1p(np.outer(t, x)).mean(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = np.where(xi / t > 0, -np.log(xi / t) - xi - 1, -np.inf)
        return ll, xi

    for _ in range(6):
        ll, xi = profile(theta)
        k = int(np.nanargmax(ll))
        lo, hi = theta[max(0, k - 1)], theta[min(len(theta) - 1, k + 1)]
        best = (float(ll[k]), float(xi[k]), float(xi[k] / theta[k]))
        theta = np.linspace(lo, hi, 101)
        theta = theta[np.abs(theta) > 1e-12]
    exponential = -math.log(mean) - 1
    return (0.0, float(mean)) if exponential >= best[0] else (best[1], best[2])


def gpd_tail(x: np.ndarray, shape: float, scale: float) -> np.ndarray:
    """P(excess > x)."""
    if abs(shape) < 1e-9:
        return np.exp(-np.maximum(x, 0) / scale)
    return np.maximum(0.0, 1 + shape * np.maximum(x, 0) / scale) ** (-1 / shape)


def ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    a, b = ranks(x), ranks(y)
    return float(np.corrcoef(a, b)[0, 1]) if a.std() > 0 and b.std() > 0 else math.nan


def grow_trees(x: np.ndarray, y: np.ndarray, rounds: int = 300, depth: int = 3, rate: float = 0.05, l2: float = 1.0, bins: int = 32, least: int = 20) -> list:
    """Gradient-boosted trees on binned features with logistic loss; for small tables within a group."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)])
    base = math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    score = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = sigmoid(score)
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int):
            value = -g[rows].sum() / (h[rows].sum() + l2)
            if level == depth or len(rows) < 2 * least:
                return value
            best = (1e-9, -1, -1)
            whole = g[rows].sum() ** 2 / (h[rows].sum() + l2)
            for j in range(x.shape[1]):
                size = len(edges[j]) + 1
                gs, hs, ns = (np.bincount(binned[rows, j], weights=v, minlength=size).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + l2) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + l2) - whole
                gain = np.where((ns >= least) & (len(rows) - ns >= least), gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] < 0:
                return value
            left = binned[rows, best[1]] <= best[2]
            return (best[1], edges[best[1]][best[2]], grow(rows[left], level + 1), grow(rows[~left], level + 1))

        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        score = score + rate * _leaves(tree, x)
    return [base, rate, trees]


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    return np.where(x[:, j] < cut, _leaves(left, x), _leaves(right, x))


def predict_trees(model: list, x: np.ndarray) -> np.ndarray:
    base, rate, trees = model
    return sigmoid(base + rate * sum((_leaves(t, x) for t in trees), np.zeros(len(x))))
