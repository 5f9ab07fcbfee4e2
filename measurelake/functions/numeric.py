"""NumPy kernels of the grouped operators: regression, pooling, resampling, Cox and logistic models."""

from __future__ import annotations

import numpy as np

from . import special


def ols(x: np.ndarray, y: np.ndarray, clusters: np.ndarray | None = None) -> dict:
    """Least squares with HC3 or cluster-robust (CR1) covariance.

    ``x`` holds the intercept.  Returns coefficients, standard errors, p and
    the residual degrees of freedom; None for a rank-deficient design.
    """
    n, k = x.shape
    if n <= k or np.linalg.matrix_rank(x) < k:
        return {"status": "rank_deficient"}
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    residual = y - x @ beta
    if clusters is None:
        leverage = np.einsum("ij,jk,ik->i", x, bread, x)
        scaled = x * (residual / np.maximum(1 - leverage, 1e-12))[:, None]
        cov = bread @ (scaled.T @ scaled) @ bread
        df, p_of = n - k, special.t_two_sided
    else:
        _, code = np.unique(clusters, return_inverse=True)
        groups = int(code.max()) + 1
        sums = np.zeros((groups, k))
        np.add.at(sums, code, x * residual[:, None])
        factor = groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 else np.nan
        cov = factor * bread @ (sums.T @ sums) @ bread
        df, p_of = groups - 1, lambda t, _: 2 * special.norm_sf(np.abs(t))
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
    return {"status": "estimated", "beta": beta, "se": se, "t": t, "p": p_of(t, df), "df": df}


def _golden(f, low: float, high: float, tolerance: float) -> float:
    """Minimum of a unimodal function on an interval."""
    r = (np.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2


def meta_reml(effect: np.ndarray, variance: np.ndarray, bound: float = 2000.0, tolerance: float = 1e-10) -> dict:
    """Random-effects pooling by REML with modified Hartung-Knapp intervals (scale at least one)."""
    y, v = np.asarray(effect, float), np.asarray(variance, float)
    k = len(y)

    def negative_log_likelihood(tau2: float) -> float:
        w = 1 / (v + tau2)
        mean = (w * y).sum() / w.sum()
        return 0.5 * (np.log(v + tau2).sum() + np.log(w.sum()) + (w * (y - mean) ** 2).sum())

    # The likelihood need not be unimodal over the whole box: bracket on a grid first.
    grid = np.concatenate([[0.0], np.geomspace(1e-8, bound, 120)])
    values = np.array([negative_log_likelihood(t) for t in grid])
    at = int(values.argmin())
    tau2 = _golden(negative_log_likelihood, grid[max(at - 1, 0)], grid[min(at + 1, len(grid) - 1)], tolerance)
    if negative_log_likelihood(0.0) <= negative_log_likelihood(tau2):
        tau2 = 0.0
    w, w0 = 1 / (v + tau2), 1 / v
    mean = (w * y).sum() / w.sum()
    fixed = (w0 * y).sum() / w0.sum()
    q = (w0 * (y - fixed) ** 2).sum()
    scale = max(1.0, (w * (y - mean) ** 2).sum() / (k - 1))
    se = np.sqrt(scale / w.sum())
    half = float(special.t_ppf(0.975, k - 1)) * se
    return {
        "k": k, "effect": mean, "se": se, "ci_low": mean - half, "ci_high": mean + half,
        "p": float(special.t_two_sided(mean / se, k - 1)), "tau2": tau2, "q": q, "i2": max(0.0, (q - (k - 1)) / q * 100) if q > 0 else 0.0, "hk_scale": scale,
    }


def midranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along the first axis of one column."""
    _, code, n = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    return (ends - (n - 1) / 2.0)[code]


def spearman(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """rho and two-sided t p-value; nulls (nan) for fewer than three values or a constant."""
    if len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return np.nan, np.nan
    rho = float(np.corrcoef(midranks(x), midranks(y))[0, 1])
    t = rho * np.sqrt((len(x) - 2) / max(1 - rho * rho, 1e-300))
    return rho, float(special.t_two_sided(t, len(x) - 2))


def partial_spearman(x: np.ndarray, y: np.ndarray, covariates: np.ndarray) -> tuple[float, float, int]:
    """Correlation of rank residuals on covariates; df = n - rank - 1."""
    design = np.column_stack([np.ones(len(x)), *[midranks(c) for c in covariates.T]])
    rank = int(np.linalg.matrix_rank(design))
    df = len(x) - rank - 1
    residual = []
    for v in (midranks(x), midranks(y)):
        residual.append(v - design @ np.linalg.lstsq(design, v, rcond=None)[0])
    if df < 1 or min(np.abs(r).max() for r in residual) < 1e-10:
        return np.nan, np.nan, df
    rho = float(np.corrcoef(*residual)[0, 1])
    t = rho * np.sqrt(df / max(1 - rho * rho, 1e-300))
    return rho, float(special.t_two_sided(t, df)), df


def wilcoxon_p(d: np.ndarray) -> float:
    """Signed-rank p: exact without ties up to 50 values, else normal with tie correction."""
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    r = midranks(np.abs(d))
    low = min(r[d > 0].sum(), r[d < 0].sum())
    if n <= 50 and len(np.unique(np.abs(d))) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k]
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    _, c = np.unique(np.abs(d), return_counts=True)
    spread = np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (c**3 - c).sum() / 48)
    return float(2 * special.norm_sf(abs((low - n * (n + 1) / 4) / spread)))


def bca_interval(x: np.ndarray, draws: np.ndarray, level: float = 0.95, half_ties: bool = True) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of a mean from given draws.

    Where no draw lies on one side the share below is kept half a draw away from
    the end; without spread in the jackknife there is no acceleration.
    """
    n, mean = len(x), x.mean()
    if n < 3:
        return np.nan, np.nan
    tails = np.array([(1 - level) / 2, (1 + level) / 2])
    below = (draws < mean).mean() + (0.5 * (draws == mean).mean() if half_ties else 0)
    jack = (x.sum() - x) / (n - 1)
    diff = jack.mean() - jack
    denominator = 6 * (diff**2).sum() ** 1.5
    edge = 1 / (2 * len(draws))
    z0 = special.norm_ppf(min(max(below, edge), 1 - edge))
    a = (diff**3).sum() / denominator if denominator else 0.0
    z = z0 + special.norm_ppf(tails)
    return tuple(np.quantile(draws, special.norm_cdf(z0 + z / (1 - a * z))))


def pc1(x: np.ndarray, ddof: int = 1, sign: str = "largest") -> tuple[np.ndarray, np.ndarray, float]:
    """First axis of z-scored columns: loadings, scores and its share of the variance.

    ``sign``: "largest" absolute loading positive, or "sum" of loadings positive.
    """
    sd = x.std(0, ddof=ddof)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    load = vt[0]
    flip = load[np.abs(load).argmax()] < 0 if sign == "largest" else load.sum() < 0
    load = -load if flip else load
    return load, z @ load, float(s[0] ** 2 / (s**2).sum())


def ridge_logistic(x: np.ndarray, y: np.ndarray, c: float, weights: np.ndarray | None = None, penalise_intercept: bool = False) -> np.ndarray:
    """Penalised logistic regression by Newton steps: coefficients, the intercept last.

    Minimises |w|^2 / 2 + c * log loss.
    """
    design = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(y)) if weights is None else weights
    penalty = np.ones(design.shape[1])
    penalty[-1] = 1.0 if penalise_intercept else 1e-10
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = c * design.T @ (w * (p - y)) + penalty * beta
        hess = c * (design.T * (w * np.maximum(p * (1 - p), 1e-10))) @ design + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta = beta - step * min(1.0, 5 / max(size, 1e-12))
        if size < 1e-9:
            break
    return beta


def fast_auc(y: np.ndarray, score: np.ndarray) -> float:
    pos = int((y == 1).sum())
    neg = len(y) - pos
    return float((midranks(score)[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else np.nan


def cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.0, ties: str = "efron") -> dict:
    """Cox regression by Newton steps over rows with frequency weights: beta, se and log likelihood.

    ``ridge`` adds ridge * |beta|^2 / 2 to the mean negative log likelihood.
    """
    weight = np.ones(len(time)) if weight is None else weight
    order = np.argsort(-time, kind="stable")
    time, event, x, weight = time[order], event[order], x[order], weight[order]
    k, total = x.shape[1], weight.sum()
    ends = np.flatnonzero(np.diff(time, append=-np.inf))  # last row of each time, in falling order
    starts = np.concatenate([[0], ends[:-1] + 1])
    beta = np.zeros(k)
    for _ in range(60):
        r = weight * np.exp(x @ beta - (x @ beta).max())
        s0, s1 = np.cumsum(r), np.cumsum(r[:, None] * x, 0)
        s2 = np.cumsum(r[:, None, None] * x[:, :, None] * x[:, None, :], 0)
        ll, grad, info = 0.0, np.zeros(k), np.zeros((k, k))
        shift = (x @ beta).max()
        for a, b in zip(starts, ends):
            dead = event[a : b + 1] == 1
            if not dead.any():
                continue
            rows = np.arange(a, b + 1)[dead]
            d = weight[rows].sum()
            e0, e1 = r[rows].sum(), r[rows] @ x[rows]
            e2 = np.einsum("i,ij,ik->jk", r[rows], x[rows], x[rows])
            ll += weight[rows] @ (x[rows] @ beta)
            grad += weight[rows] @ x[rows]
            parts = np.arange(int(round(d))) / d if ties == "efron" else np.zeros(int(round(d)))
            t0 = s0[b] - parts * e0
            t1 = s1[b] - parts[:, None] * e1
            mean = t1 / t0[:, None]
            ll -= (np.log(t0) + shift).sum()
            grad -= mean.sum(0)
            info += (s2[b] * (1 / t0).sum() - e2 * (parts / t0).sum()) - mean.T @ mean
        grad = grad - ridge * total * beta
        info = info + ridge * total * np.eye(k)
        step = np.linalg.solve(info, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return {"beta": beta, "se": np.sqrt(np.diag(np.linalg.inv(info))), "log_likelihood": ll}


def elastic_net_logistic(x: np.ndarray, y: np.ndarray, c: float, mix: float = 0.5, steps: int = 2000) -> np.ndarray:
    """Logistic regression with penalty mix*|w|_1 + (1-mix)/2*|w|^2 by accelerated proximal steps; intercept last.

    Minimises the penalty + c * log loss.
    """
    design = np.column_stack([x, np.ones(len(x))])
    rate = 1 / (0.25 * c * np.linalg.norm(design, 2) ** 2 + (1 - mix))
    beta = momentum = np.zeros(design.shape[1])
    pace = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ momentum, -40, 40)))
        grad = c * design.T @ (p - y)
        grad[:-1] += (1 - mix) * momentum[:-1]
        new = momentum - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * mix, 0)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = new + (pace - 1) / next_pace * (new - beta)
        moved, beta, pace = np.abs(new - beta).max(), new, next_pace
        if moved < 1e-10:
            break
    return beta


#: Coordinate steps for each row of a set, and rows that are solved together after them.
ASCENT_STEPS, TOGETHER = 20, 1024


def box_optimum(m: np.ndarray, p: np.ndarray, upper: np.ndarray, steps: int = 100, gap: float = 1e-9) -> np.ndarray:
    """The least a'ma / 2 - p'a with a from 0 to ``upper`` (positive) by primal-dual interior steps; ends at a bound are exact.

    The number of steps hardly depends on how ill-conditioned the (semidefinite) matrix is.
    """
    n = len(p)
    a = upper / 2
    low = high = np.maximum(np.abs(m @ a - p).max(initial=0), 1.0) * np.ones(n)
    for _ in range(steps):
        slope, rest = m @ a - p, upper - a
        complementary = (low @ a + high @ rest) / (2 * n)
        if complementary < gap and np.abs(slope - low + high).max(initial=0) < 1e-7:
            break
        target = 0.1 * complementary
        h = m.copy()
        h[np.arange(n), np.arange(n)] += low / a + high / rest
        da = np.linalg.solve(h, target / a - target / rest - slope)
        dl, dh = target / a - low - low / a * da, target / rest - high + high / rest * da
        share = 1.0
        for x, dx in ((a, da), (rest, -da), (low, dl), (high, dh)):
            down = dx < 0
            share = min(share, 0.995 * float((-x[down] / dx[down]).min(initial=np.inf)))
        a, low, high = a + share * da, low + share * dl, high + share * dh
    # Of a pair whose product vanishes the smaller one is zero.
    return np.where(a < low, 0.0, np.where(upper - a < high, upper, a))


def box_ascent(m: np.ndarray, slope: np.ndarray, a: np.ndarray, upper: np.ndarray, slack: float) -> np.ndarray:
    """From ``a``, where p - m a is ``slope``: the least a'ma / 2 - p'a with a from 0 to ``upper``, to within ``slack`` of its conditions.

    Always the coordinate that violates them most is solved; where that is slow, those that are not settled at a bound
    are solved together (`box_optimum`), if they are few.
    """
    a, slope, curve = a.copy(), slope.copy(), np.diag(m).astype(float)
    violated = lambda: np.where(np.where(slope > 0, a < upper, a > 0), np.abs(slope), 0.0)
    for _ in range(ASCENT_STEPS * len(a)):
        bad = violated()
        i = int(bad.argmax())
        if bad[i] < slack:
            return a
        new = min(max(a[i] + slope[i] / curve[i], 0.0), upper[i])
        slope -= float(new - a[i]) * m[i]
        a[i] = new
    open_ = np.flatnonzero(((a > 0) & (a < upper)) | (violated() >= slack))
    if len(open_) <= TOGETHER:
        own = m[np.ix_(open_, open_)].astype(float)
        a[open_] = box_optimum(own, slope[open_] + own @ a[open_], upper[open_])
    return a


def rbf_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, gamma: float | None = None, sweeps: int = 200):
    """Soft-margin support vector machine with a Gaussian kernel: a function to decision values.

    The offset is part of the kernel (an added constant), so the dual has only
    box constraints and coordinate ascent solves it.
    """
    gamma = 1 / (x.shape[1] * max(x.var(), 1e-12)) if gamma is None else gamma
    square = (x * x).sum(1)
    sign = np.where(y == 1, 1.0, -1.0)
    kernel = np.exp(-gamma * np.maximum(square[:, None] + square - 2 * x @ x.T, 0)) + 1.0
    alpha, value = np.zeros(len(x)), np.zeros(len(x))
    for _ in range(sweeps):
        change = 0.0
        for i in range(len(x)):
            new = np.clip(alpha[i] + (1 - sign[i] * value[i]) / kernel[i, i], 0, c)
            step = new - alpha[i]
            if step:
                value += step * sign[i] * kernel[i]
                alpha[i] = new
                change = max(change, abs(step))
        if change < 1e-6:
            break
    used = alpha > 0
    weight, support, own = (alpha * sign)[used], x[used], square[used]

    def decide(z: np.ndarray) -> np.ndarray:
        distance = (z * z).sum(1)[:, None] + own - 2 * z @ support.T
        return (np.exp(-gamma * np.maximum(distance, 0)) + 1.0) @ weight

    return decide


def weighted_scale(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample standard deviation of columns with frequency weights; a constant column has 1."""
    total = weight.sum()
    mean = weight @ x / total
    sd = np.sqrt(weight @ (x - mean) ** 2 / max(total - 1, 1))
    return mean, np.where(sd > 1e-12, sd, 1.0)


class _RiskSets:
    """Counted rows in falling order of time, with the last row of each time's risk set."""

    def __init__(self, time: np.ndarray, event: np.ndarray, weight: np.ndarray):
        self.order = np.argsort(-time, kind="stable")
        t, self.weight = time[self.order], weight[self.order]
        self.ends = np.flatnonzero(np.diff(t, append=-np.inf))
        self.of = np.searchsorted(self.ends, np.arange(len(t)))
        dead = self.weight * (event[self.order] == 1)
        self.dead = dead
        self.deaths = np.bincount(self.of, dead, len(self.ends))
        self.times = t[self.ends]

    def moments(self, x: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Sum of risks, mean and mean square of x at each time; the shift of eta."""
        shift = eta.max()
        r = self.weight * np.exp(eta - shift)
        s0 = np.cumsum(r)[self.ends]
        m1 = np.cumsum(r[:, None] * x, 0)[self.ends] / s0[:, None]
        m2 = np.cumsum(r[:, None, None] * x[:, :, None] * x[:, None, :], 0)[self.ends] / s0[:, None, None]
        return s0, m1, m2, shift


def cox_path(time: np.ndarray, event: np.ndarray, x: np.ndarray, weight: np.ndarray, penalties: list[float], mix: float) -> np.ndarray:
    """Cox coefficients (Breslow ties) for each penalty, in the order given.

    Minimises -loglik / total weight + penalty * (mix * |b|_1 + (1 - mix) / 2 * |b|^2):
    Newton steps whose penalised quadratic is solved by coordinate descent, and
    a step is halved until the objective falls.
    """
    sets = _RiskSets(time, event, weight)
    x = x[sets.order]
    total = weight.sum()
    seen = (sets.dead @ x) / total
    k = x.shape[1]

    def state(beta):
        eta = x @ beta
        s0, m1, m2, shift = sets.moments(x, eta)
        d = sets.deaths
        value = (d @ (np.log(s0) + shift) - sets.dead @ eta) / total
        grad = d @ m1 / total - seen
        hess = (np.einsum("t,tij->ij", d, m2) - (m1.T * d) @ m1) / total
        return value, grad, hess

    found, beta = {}, np.zeros(k)
    for penalty in sorted(set(penalties), reverse=True):
        one, two = penalty * mix, penalty * (1 - mix)

        def cost(value, b):
            return value + one * np.abs(b).sum() + two / 2 * b @ b

        value, grad, hess = state(beta)
        for _ in range(100):
            new = beta.copy()
            for _ in range(1000):
                before = new.copy()
                for j in range(k):
                    slope = grad[j] + hess[j] @ (new - beta) - hess[j, j] * new[j]
                    curve = hess[j, j] + two
                    new[j] = -np.sign(slope) * max(abs(slope) - one, 0) / curve if curve > 0 else 0.0
                if np.abs(new - before).max() < 1e-12:
                    break
            step, now = 1.0, cost(value, beta)
            while True:
                trial = beta + step * (new - beta)
                told = state(trial)
                if cost(told[0], trial) <= now + 1e-13 or step < 1e-6:
                    break
                step /= 2
            moved = np.abs(trial - beta).max()
            beta, (value, grad, hess) = trial, told
            if moved < 1e-9:
                break
        found[penalty] = beta.copy()
    return np.array([found[p] for p in penalties])


def cox_deviance(time: np.ndarray, event: np.ndarray, eta: np.ndarray, weight: np.ndarray) -> float:
    """Twice the log partial likelihood (Breslow ties) lacking to the saturated model."""
    sets = _RiskSets(time, event, weight)
    eta = eta[sets.order]
    shift = eta.max()
    s0 = np.cumsum(sets.weight * np.exp(eta - shift))[sets.ends]
    d = sets.deaths
    log_likelihood = sets.dead @ eta - d @ (np.log(s0) + shift)
    saturated = -(d[d > 0] * np.log(d[d > 0])).sum()
    return float(2 * (saturated - log_likelihood))


def one_se(losses: np.ndarray, penalties: list[float]) -> tuple[float, float]:
    """The penalty of least mean loss over folds (rows) and the strongest within one standard error of it."""
    order = np.argsort(penalties, kind="stable")
    table, sizes = losses[:, order], np.asarray(penalties)[order]
    valid = np.isfinite(table).all(0)
    if not valid.any():
        return np.nan, np.nan
    mean = np.where(valid, table.mean(0), np.inf)
    best = int(np.argmin(mean))
    error = table[:, best].std(ddof=1) / np.sqrt(len(table)) if len(table) > 1 else 0.0
    return float(sizes[best]), float(sizes[np.flatnonzero(mean <= mean[best] + error)[-1]])


def schoenfeld_trend(time: np.ndarray, event: np.ndarray, x: np.ndarray, weight: np.ndarray, beta: float, se: float) -> tuple[float, float]:
    """Correlation of one covariate's Schoenfeld residuals with event time, and the chi-square of their trend (1 df)."""
    sets = _RiskSets(time, event, weight)
    x = x[sets.order]
    _, mean, _, _ = sets.moments(x[:, None], x * beta)
    residual = x - mean[sets.of, 0]
    d, g = sets.dead, sets.times[sets.of]
    total = d.sum()
    if total < 2:
        return np.nan, np.nan
    g = g - d @ g / total
    spread, own = d @ (g * g), d @ (residual - d @ residual / total) ** 2
    trend = d @ (g * residual)
    if spread <= 0 or own <= 0:
        return np.nan, np.nan
    # Scaled residuals are total * variance * residual.
    return float(trend / np.sqrt(spread * own)), float(trend**2 * total * se**2 / spread)


def random_table(table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A table with the margins of ``table``, distributed as by permuting its subjects' columns."""
    left, out = table.sum(0), np.zeros_like(table)
    for i, size in enumerate(table.sum(1)):
        out[i] = rng.multivariate_hypergeometric(left, int(size), method="marginals")
        left = left - out[i]
    return out


def uno_c(table: np.ndarray, time: np.ndarray, event: np.ndarray, horizon: float, floor: float) -> float:
    """Uno's C of counts by score (rows, rising) and (time, event) (columns); NaN without pairs or support."""
    times, at = np.unique(time, return_inverse=True)
    leave = np.bincount(at, table.sum(0), len(times))
    lost = np.bincount(at, table.sum(0) * (event == 0), len(times))
    risk = np.cumsum(leave[::-1])[::-1]
    g = np.cumprod(1 - lost / np.maximum(risk, 1))
    before = np.concatenate([[1.0], g[:-1]])
    by_time = np.zeros((len(table), len(times)))
    dead = np.zeros_like(by_time)
    for c, place in enumerate(at):
        by_time[:, place] += table[:, c]
        dead[:, place] += table[:, c] * (event[c] == 1)
    later = by_time.sum(1, keepdims=True) - np.cumsum(by_time, 1)  # of each score, after each time
    lower = np.cumsum(later, 0) - later
    counted = (times < horizon) & (dead.sum(0) > 0) & (later.sum(0) > 0)
    if not counted.any() or before[counted].min() <= floor:
        return np.nan
    w = np.where(counted, 1 / np.maximum(before, floor) ** 2, 0.0)
    return float((dead * w * (lower + later / 2)).sum() / (dead * w * later.sum(0)).sum())
