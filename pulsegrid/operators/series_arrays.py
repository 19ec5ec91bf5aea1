"""Calculators that read a whole series as one array: spectra, wavelets, correlations over many lags, regressions, complexity.

Each takes the series and the list of its parameter settings and gives one value per setting, so what settings share
(a spectrum, autocorrelations, a regression) is computed once per series. None stands for an undefined value. Those of ``BATCHES`` take series of one length as the rows of a
matrix and give a matrix of values (NaN: undefined), as numpy spends more on a call than on the points of a wave.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Points up to which work that grows with the square of a series is done as one matrix or one correlation.
SHORT = 512

# ---------------------------------------------------------------- spectra


def spectrum_moments(x: np.ndarray) -> dict[str, float | None]:
    """Centroid, variance, skew and kurtosis of |rfft| over its bins; the last two are None where the variance is below 0.5."""
    a = np.abs(np.fft.rfft(x))
    total = a.sum()
    if not total:
        return dict.fromkeys(("centroid", "variance", "skew", "kurtosis"))
    k = np.arange(len(a), dtype=float)
    m1, m2, m3, m4 = ((k**p * a).sum() / total for p in (1, 2, 3, 4))
    var = m2 - m1**2
    out = {"centroid": float(m1), "variance": float(var), "skew": None, "kurtosis": None}
    if var >= 0.5:
        out["skew"] = float((m3 - 3 * m1 * var - m1**3) / var**1.5)
        out["kurtosis"] = float((m4 - 4 * m1 * m3 + 6 * m2 * m1**2 - 3 * m1**4) / var**2)
    return out


def fft_coefficients(x: np.ndarray, settings: list[dict]) -> list[float | None]:
    """Real and imaginary part, modulus and angle (degrees) of single bins."""
    f = np.fft.rfft(x)
    of = {"real": f.real, "imag": f.imag, "abs": np.abs(f), "angle": np.angle(f, deg=True)}
    return [float(of[s["attr"]][s["coeff"]]) if s["coeff"] < len(f) else None for s in settings]


def welch(x: np.ndarray) -> np.ndarray:
    """One-sided power density of windows of at most 256 points (periodic Hann, half overlapping, means removed).

    Every bin but the first stands for its mirror as well; at an even length so does not the last, which is its own mirror.
    """
    m = min(256, x.shape[-1])
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
    parts = [x[..., a : a + m] for a in range(0, max(1, x.shape[-1] - m + 1), max(1, m // 2))]
    density = np.mean([np.abs(np.fft.rfft((p - p.mean(axis=-1, keepdims=True)) * win)) ** 2 for p in parts], axis=0) / (win**2).sum()
    density[..., 1 : -1 if m % 2 == 0 else None] *= 2
    return density


def _one(batch: Callable[[np.ndarray, list[dict]], np.ndarray]) -> Callable[[np.ndarray, list[dict]], list[float | None]]:
    return lambda x, settings: [None if v != v else float(v) for v in batch(x[None], settings)[0]]


def welch_density(x: np.ndarray, coeff: int) -> float | None:
    return _one(_welch_densities)(x, [{"coeff": coeff}])[0]


def _welch_densities(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    density = welch(xs) if xs.shape[1] >= 2 else np.zeros((len(xs), 0))
    none = np.full(len(xs), np.nan)
    return np.stack([density[:, s["coeff"]] if s["coeff"] < density.shape[1] else none for s in settings], axis=1)


# ---------------------------------------------------------------- wavelets


@lru_cache(maxsize=256)
def ricker(points: int, a: float) -> np.ndarray:
    x = np.arange(points) - (points - 1) / 2
    wavelet = 2 / (np.sqrt(3 * a) * np.pi**0.25) * (1 - (x / a) ** 2) * np.exp(-((x / a) ** 2) / 2)
    wavelet.setflags(write=False)
    return wavelet


def wavelet_row(x: np.ndarray, width: int) -> np.ndarray:
    """The transform at one width: the wavelet is cut at ten widths or at the series' length."""
    return np.convolve(x, ricker(min(10 * width, len(x)), width), mode="same")


def _relative_maxima(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero((row[1:-1] > row[:-2]) & (row[1:-1] > row[2:])) + 1


def ridge_lines(rows: list[np.ndarray], gap: int = 1) -> list[list[tuple[int, int]]]:
    """Ridge lines of relative maxima as lists of (row, position), from the widest row with a maximum down.

    A maximum joins the line whose last position is nearest, at most a quarter of the width away; else it begins a line. A
    line without a maximum for more than ``gap`` rows ends.
    """
    tops = [_relative_maxima(r) for r in rows]
    start = next((w for w in range(len(rows) - 1, -1, -1) if len(tops[w])), None)
    if start is None:
        return []
    live = [[(start, int(p))] for p in tops[start]]
    idle, done = [0] * len(live), []
    for w in range(start - 1, -1, -1):
        idle = [g + 1 for g in idle]
        found = tops[w]
        ends = np.array([line[-1][1] for line in live])
        away = np.abs(found[:, None] - ends[None, :])
        near = away.argmin(axis=1) if len(ends) and len(found) else np.zeros(len(found), int)
        for k, p in enumerate(found.tolist()):
            if len(ends) and away[k, near[k]] <= (w + 1) / 4:
                live[near[k]].append((w, p))
                idle[near[k]] = 0
            else:
                live.append([(w, p)])
                idle.append(0)
        done += [line for line, g in zip(live, idle, strict=True) if g > gap]
        live, idle = [line for line, g in zip(live, idle, strict=True) if g <= gap], [g for g in idle if g <= gap]
    return done + live


def _peaks_of_rows(rows: list[np.ndarray], noise_share: float = 10, least_snr: float = 1) -> int:
    """Ridge lines that live through a quarter of the rows and whose value at the narrowest row is no less than the noise: the
    tenth percentile of the narrowest row within a twentieth of the series around."""
    n, narrow = len(rows[0]), rows[0].tolist()
    half, odd = divmod(math.ceil(n / 20), 2)
    count, least = 0, math.ceil(len(rows) / 4)
    for line in ridge_lines(rows):
        if len(line) < least:
            continue
        w, p = min(line)
        around = sorted(narrow[max(p - half, 0) : min(p + half + odd, n)])
        at = (len(around) - 1) * noise_share / 100
        low = int(at)
        noise = around[low] + (at - low) * (around[min(low + 1, len(around) - 1)] - around[low])
        count += abs(rows[w][p]) >= least_snr * abs(noise)
    return count


def cwt_peaks(x: np.ndarray, widest: int) -> int:
    """Peaks by ridge lines of a Ricker transform of widths 1 to ``widest`` (Du, Kibbe and Lin 2006); fewer than 3 points have none."""
    return _cwt_peaks(x, [{"n": widest}])[0]


def _cwt_peaks(x: np.ndarray, settings: list[dict]) -> list[int]:
    if len(x) < 3:
        return [0] * len(settings)
    rows = [wavelet_row(x, w) for w in range(1, max(s["n"] for s in settings) + 1)]
    return [_peaks_of_rows(rows[: s["n"]]) for s in settings]


def cwt_coefficient(x: np.ndarray, coeff: int, w: int) -> float | None:
    return _cwt_coefficients(x, [{"coeff": coeff, "w": w}])[0]


def _cwt_coefficients(x: np.ndarray, settings: list[dict]) -> list[float | None]:
    rows = {w: wavelet_row(x, w) for w in {s["w"] for s in settings}}
    return [float(rows[s["w"]][s["coeff"]]) if s["coeff"] < len(x) else None for s in settings]


# ---------------------------------------------------------------- correlations and regressions


def autocovariances(x: np.ndarray, upto: int) -> np.ndarray:
    """Lags 0 to ``upto``, each over its own number of products n - k (without the bias towards zero)."""
    n, d = len(x), x - x.mean()
    return np.array([(d[: n - k] * d[k:]).sum() / (n - k) for k in range(upto + 1)])


def autocorrelations(x: np.ndarray, upto: int) -> np.ndarray:
    """Adjusted autocorrelations of lags 0 to ``upto`` < n; zeros after lag 0 where the variance is below 1e-10."""
    if len(x) < 2 or x.var() < 1e-10:
        return np.array([1.0] + [0.0] * upto)
    c = autocovariances(x, upto)
    return c / c[0]


def partial_autocorrelations(x: np.ndarray, upto: int) -> np.ndarray:
    """Durbin-Levinson over the adjusted autocovariances, lags 0 to ``upto`` < n; zeros after a residual variance of zero."""
    r = autocorrelations(x, upto)
    phi, out, rest = np.zeros(0), np.zeros(upto + 1), 1.0
    out[0] = 1.0
    for k in range(1, upto + 1):
        if not rest:
            break
        out[k] = last = (r[k] - phi @ r[k - 1 : 0 : -1]) / rest
        phi = np.append(phi - last * phi[::-1], last)
        rest *= 1 - last * last
    return out


def partial_autocorrelation(x: np.ndarray, lag: int) -> float | None:
    """None from half the length of the series on."""
    return _partials(x, [{"lag": lag}])[0]


def _partials(x: np.ndarray, settings: list[dict]) -> list[float | None]:
    upto = max([s["lag"] for s in settings if s["lag"] < len(x) // 2], default=-1)
    found = partial_autocorrelations(x, upto) if upto >= 0 else []
    return [float(found[s["lag"]]) if s["lag"] <= upto else None for s in settings]


def agg_autocorrelation(x: np.ndarray, f_agg: str, maxlag: int) -> float:
    return _one(_agg_autocorrelations)(x, [{"f_agg": f_agg, "maxlag": maxlag}])[0]


def _agg_autocorrelations(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    n, f = xs.shape[1], {"mean": np.mean, "median": np.median, "var": np.var}
    most = min(max(s["maxlag"] for s in settings), n - 1)
    if most < 1:
        return np.zeros((len(xs), len(settings)))
    d, flat = xs - xs.mean(axis=1, keepdims=True), xs.var(axis=1) < 1e-10
    c = np.stack([(d[:, : n - k] * d[:, k:]).sum(axis=1) / (n - k) for k in range(most + 1)], axis=1)
    r = np.where(flat[:, None], 0.0, c[:, 1:] / np.where(flat, 1.0, c[:, 0])[:, None])
    return np.stack([f[s["f_agg"]](r[:, : s["maxlag"]], axis=1) for s in settings], axis=1)


def ar_from_products(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    """(intercept, lag 1 ... lag k) of least squares from n, the sums (k + 1) and products (k + 1, k + 1) of lags 0 to k.

    Where the lags are collinear (a flat series) the shortest of the best coefficients are taken.
    """
    mean = sums / n
    centred = products / n - np.outer(mean, mean)
    b = np.linalg.lstsq(centred[1:, 1:], centred[1:, 0], rcond=1e-12)[0]
    return np.append(mean[0] - b @ mean[1:], b)


def ar_coefficients(x: np.ndarray, settings: list[dict]) -> list[float | None]:
    """Coefficients of autoregressions with intercept (coeff 0) by least squares; None where points are fewer than twice the unknowns."""
    fits, shift = {}, x.mean()
    for k in {s["k"] for s in settings}:
        if len(x) - k > k + 1:
            lags = np.stack([x[k - i : len(x) - i] - shift for i in range(k + 1)])
            fits[k] = ar_from_products(lags.shape[1], lags.sum(1), lags @ lags.T)
            fits[k][0] += shift * (1 - fits[k][1:].sum())
    return [float(fits[s["k"]][s["coeff"]]) if s["k"] in fits and s["coeff"] <= s["k"] else None for s in settings]


# fixed values: response surface of the unit-root test with intercept (MacKinnon 1994), and where its two parts meet and end
_TAU_LEAST, _TAU_MEET, _TAU_MOST = -18.83, -1.61, 2.74
_TAU_LOW = (2.1659, 1.4412, 0.038269)
_TAU_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(tau: float) -> float:
    if tau >= _TAU_MOST:
        return 1.0
    if tau <= _TAU_LEAST:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(_TAU_LOW if tau <= _TAU_MEET else _TAU_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _nested_rss(a: np.ndarray, y: np.ndarray) -> list[float]:
    """Squared residuals of y on the first 2, 3, ... columns of ``a``: one factorisation serves all of them.

    Where columns are nearly collinear or a fit is nearly perfect, each is fitted on its own, by the shortest best coefficients.
    """
    if len(a) > a.shape[1]:
        q, r = np.linalg.qr(a)
        along = q.T @ y
        rest = y - q @ along
        rss = float(rest @ rest) + np.append(np.cumsum(along[:1:-1] ** 2)[::-1], 0.0)
        if (np.abs(np.diag(r)) > 1e-7 * np.sqrt((a * a).sum(axis=0))).all() and rss[-1] > 1e-16 * float(y @ y):
            return rss.tolist()
    parts = [a[:, :k] for k in range(2, a.shape[1] + 1)]
    return [float(((y - p @ np.linalg.lstsq(p, y, rcond=None)[0]) ** 2).sum()) for p in parts]


def dickey_fuller(x: np.ndarray) -> dict[str, float | None]:
    """Augmented Dickey-Fuller test with intercept: differences on the level and on lagged differences.

    The number of lags is the one of least Akaike criterion, all counts up to 12 (n/100)^(1/4) being compared on the same
    rows; the statistic is then taken on all rows that this number of lags leaves. Flat or very short series give None.
    """
    none: dict[str, float | None] = dict.fromkeys(("teststat", "pvalue", "usedlag"))
    n = len(x)
    most = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    if most < 0 or n < 4 or x.max() == x.min():
        return none
    dx = np.diff(x)

    def design(lags: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(dx) - lags
        return dx[lags:], np.column_stack([np.ones(rows), x[lags:-1], *[dx[lags - i : len(dx) - i] for i in range(1, lags + 1)]])

    y, a = design(most)
    scores = [len(y) * math.log(rss / len(y)) + 2 * (k + 2) if rss > 0 else -math.inf for k, rss in enumerate(_nested_rss(a, y))]
    used = int(np.argmin(scores))
    y, a = design(used)
    b, _, rank, _ = np.linalg.lstsq(a, y, rcond=None)
    free = len(y) - a.shape[1]
    rss = ((y - a @ b) ** 2).sum()
    if free <= 0 or rank < a.shape[1] or rss <= 0:
        return none
    spread = math.sqrt(rss / free * np.linalg.inv(a.T @ a)[1, 1])
    tau = float(b[1] / spread)
    return {"teststat": tau, "pvalue": unit_root_p(tau), "usedlag": float(used)}


# ---------------------------------------------------------------- complexity


def _row_entropies(codes: np.ndarray) -> np.ndarray:
    """Entropy (nats) of the values of each row."""
    n, codes = codes.shape[1], np.sort(codes, axis=1)
    ends = np.ones(codes.shape, bool)
    ends[:, :-1] = codes[:, 1:] != codes[:, :-1]
    at = np.flatnonzero(ends)
    p = np.diff(at, prepend=-1) / n
    return np.bincount(at // n, weights=-p * np.log(p), minlength=len(codes)) + 0.0


def _bins(xs: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each value among ``bins`` equal ones from the least to the largest of its row, the last one closed, as ``np.histogram`` has it."""
    low, high = xs.min(axis=1, keepdims=True), xs.max(axis=1, keepdims=True)
    high = np.where(low == high, low + 1, high)  # equal values lie in one bin
    edges = np.linspace(low[:, 0], high[:, 0], bins + 1, axis=1)
    at = np.minimum(((xs - low) / (high - low) * bins).astype(np.int64), bins - 1)
    at -= xs < np.take_along_axis(edges, at, axis=1)  # values next to an edge belong where the edge says
    return at + ((xs >= np.take_along_axis(edges, at + 1, axis=1)) & (at != bins - 1))


def binned_entropy(x: np.ndarray, bins: int) -> float:
    """Entropy (nats) of the values' histogram over ``bins`` equal bins."""
    return _one(_binned_entropies)(x, [{"max_bins": bins}])[0]


def _binned_entropies(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    return np.stack([_row_entropies(_bins(xs, s["max_bins"])) for s in settings], axis=1)


def _fourier_entropies(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    out = np.full((len(xs), len(settings)), np.nan)
    density = welch(xs) if xs.shape[1] >= 2 else np.zeros((len(xs), 1))
    top = density.max(axis=1)
    if (top > 0).any():
        share = (density / np.where(top > 0, top, 1.0)[:, None])[top > 0]
        out[top > 0] = np.stack([_row_entropies(_bins(share, s["bins"])) for s in settings], axis=1)
    return out


def permutation_entropy(x: np.ndarray, tau: int, dimension: int) -> float | None:
    """Entropy (nats) of the ordinal patterns of points ``tau`` apart; equal values rank by position; None without a pattern."""
    return _one(_permutation_entropies)(x, [{"tau": tau, "dimension": dimension}])[0]


def _permutation_entropies(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    """A pattern is told by which of its points lie above a later one; a longer pattern adds the bits of its last point."""
    found, none, xs = {}, np.full(len(xs), np.nan), np.where(np.isnan(xs), np.inf, xs)
    for tau in {s["tau"] for s in settings}:
        asked = {s["dimension"] for s in settings if s["tau"] == tau and 0 < xs.shape[1] - (s["dimension"] - 1) * tau}
        above = [xs[:, : -k * tau] > xs[:, k * tau :] for k in range(1, max(asked, default=0))]
        code = np.zeros(xs.shape, np.int64)
        for last in range(max(asked, default=0)):
            n = xs.shape[1] - last * tau
            code = code[:, :n]
            for i in range(last):
                code = code << 1 | above[last - i - 1][:, i * tau : i * tau + n]
                if last > 9:  # the bits of more points need not fit into 64: codes are numbered anew
                    code = np.unique(code, return_inverse=True)[1].reshape(code.shape)
            if last + 1 in asked:
                found[tau, last + 1] = _row_entropies(code)
    return np.stack([found.get((s["tau"], s["dimension"]), none) for s in settings], axis=1)


def _change_quantiles(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    """Mean or variance of the (absolute) steps whose two points lie between two quantiles of the series; 0 without such a step.

    Missing points count neither for the quantiles nor as ends of steps.
    """
    xs = np.where(np.isnan(xs).all(axis=1, keepdims=True), 0.0, xs)
    corridors = sorted({(s["ql"], s["qh"]) for s in settings})
    quantiles = sorted({q for c in corridors for q in c})
    edges = dict(zip(quantiles, (np.nanquantile if np.isnan(xs).any() else np.quantile)(xs, quantiles, axis=1), strict=True))
    low, high = (np.stack([edges[c[k]] for c in corridors], axis=1)[:, :, None] for k in (0, 1))
    low, high = low - 1e-12 * np.abs(low), high + 1e-12 * np.abs(high)  # an edge that is a value of the series, interpolated
    inside = (np.minimum(xs[:, 1:], xs[:, :-1])[:, None] >= low) & (np.maximum(xs[:, 1:], xs[:, :-1])[:, None] <= high)
    n, found, steps = np.maximum(inside.sum(axis=2), 1), {}, np.diff(xs, axis=1)[:, None]
    for isabs in {s["isabs"] for s in settings}:
        step = np.abs(steps) if isabs else steps
        mean = np.where(inside, step, 0.0).sum(axis=2) / n
        found[isabs, "mean"], found[isabs, "var"] = mean, (np.where(inside, step - mean[:, :, None], 0.0) ** 2).sum(axis=2) / n
    at = {c: k for k, c in enumerate(corridors)}
    return np.stack([found[s["isabs"], s["f_agg"]][:, at[s["ql"], s["qh"]]] for s in settings], axis=1)


def _distances(xs: np.ndarray, upto: int) -> list[np.ndarray]:
    """For 1 to ``upto`` points the largest difference between any two templates of so many points of a row; for short series."""
    one = np.abs(xs[:, :, None] - xs[:, None, :])
    out = [one]
    for k in range(1, upto):
        out.append(np.maximum(out[-1][:, :-1, :-1], one[:, k:, k:]))
    return out


def _template_matches(x: np.ndarray, m: int, reach: float) -> np.ndarray:
    """For each template of ``m`` points how many templates (itself included) differ by at most ``reach`` at every point.

    Short series are compared as a whole matrix; longer ones by one pass per shift, so memory is linear in the series.
    """
    n = len(x) - m + 1
    if len(x) <= SHORT:
        return (_distances(x[None], m)[-1][0] <= reach).sum(axis=1)
    counts = np.ones(n, np.int64)
    for d in range(1, n):
        near = np.abs(x[d:] - x[:-d]) <= reach
        whole = near[: len(near) - m + 1].copy()
        for i in range(1, m):
            whole &= near[i : len(near) - m + 1 + i]
        counts[: n - d] += whole
        counts[d:] += whole
    return counts


def _two_matches(xs: np.ndarray, m: int, shares: list[float]) -> list[list[np.ndarray]]:
    """``_template_matches`` of m and of m + 1 points of each row within several shares of its deviation; differences are taken once."""
    reaches = [r * xs.std(axis=1) for r in shares]
    if xs.shape[1] > SHORT:
        return [[np.stack([_template_matches(x, k, r) for x, r in zip(xs, reach, strict=True)]) for k in (m, m + 1)] for reach in reaches]
    both = _distances(xs, m + 1)[-2:]
    return [[(d <= reach[:, None, None]).sum(axis=2) for d in both] for reach in reaches]


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float | None:
    """-ln(pairs of templates of m + 1 points that match / pairs of m points that match), within r deviations; None without a match."""
    return _one(_sample_entropies)(x, [{"m": m, "r": r}])[0]


def _sample_entropies(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    out = np.full((len(xs), len(settings)), np.nan)
    for k, s in enumerate(settings):
        m = s.get("m", 2)
        if xs.shape[1] >= m + 2:
            short, long = ((c - 1).sum(axis=1) for c in _two_matches(xs, m, [s.get("r", 0.2)])[0])
            some = (short > 0) & (long > 0)
            out[some, k] = -np.log(long[some] / short[some]) + 0.0
    return out


def approximate_entropy(x: np.ndarray, m: int, r: float) -> float:
    """Difference of the mean logarithms of template frequencies at m and m + 1 points, within r deviations; 0 for series of m + 1 points or fewer."""
    return _one(_approximate_entropies)(x, [{"m": m, "r": r}])[0]


def _approximate_entropies(xs: np.ndarray, settings: list[dict]) -> np.ndarray:
    found, none = {}, np.zeros(len(xs))
    for m in {s["m"] for s in settings if xs.shape[1] > s["m"] + 1}:
        every = [s["r"] for s in settings if s["m"] == m]
        for r, both in zip(every, _two_matches(xs, m, every), strict=True):
            short, long = (np.log(c / c.shape[1]).mean(axis=1) for c in both)
            found[m, r] = np.abs(short - long)
    return np.stack([found.get((s["m"], s["r"]), none) for s in settings], axis=1)


def lempel_ziv(x: np.ndarray, bins: int) -> float:
    """Distinct phrases of the series cut into ``bins`` equal levels, over its length; a phrase ends where it is new."""
    found = np.searchsorted(np.linspace(x.min(), x.max(), bins + 1)[1:], x).tolist()
    levels = "".join(map(chr, found)) if bins < 0xD800 else tuple(found)
    phrases, start = set(), 0
    for end in range(1, len(levels) + 1):
        phrase = levels[start:end]
        if phrase not in phrases:
            phrases.add(phrase)
            start = end
    return len(phrases) / len(levels)


def mean_n_absolute_max(x: np.ndarray, n: int) -> float | None:
    return float(np.sort(np.abs(x))[-n:].mean()) if len(x) >= n else None


def benford_correlation(x: np.ndarray) -> float | None:
    """Correlation of the shares of first digits with log10(1 + 1/d); None where a side does not vary."""
    a = np.abs(x[x != 0])
    if not len(a):
        return None
    digit = np.floor(a / 10.0 ** np.floor(np.log10(a)) + 1e-12).clip(1, 9).astype(int)
    share = np.bincount(digit, minlength=10)[1:] / len(a)
    if share.std() == 0:
        return None
    return float(np.corrcoef(share, np.log10(1 + 1 / np.arange(1, 10)))[0, 1])


def _each(f: Callable[..., float | None]) -> Callable[[np.ndarray, list[dict]], list[float | None]]:
    return lambda x, settings: [f(x, **s) for s in settings]


def _picked(f: Callable[[np.ndarray], dict], key: str) -> Callable[[np.ndarray, list[dict]], list[float | None]]:
    def run(x, settings):
        found = f(x)
        return [found[s[key]] for s in settings]

    return run


#: calculator -> function of series of one length (rows) and its settings, one column per setting
BATCHES: dict[str, Callable[[np.ndarray, list[dict]], np.ndarray]] = {
    "change_quantiles": _change_quantiles,
    "agg_autocorrelation": _agg_autocorrelations,
    "spkt_welch_density": _welch_densities,
    "binned_entropy": _binned_entropies,
    "fourier_entropy": _fourier_entropies,
    "permutation_entropy": _permutation_entropies,
    "sample_entropy": _sample_entropies,
    "approximate_entropy": _approximate_entropies,
}

#: calculator -> function of the whole series (one point at least) and its settings, one value per setting; new ones may be registered
ARRAY_CALCULATORS: dict[str, Callable[[np.ndarray, list[dict]], list[float | None]]] = {
    **{c: _one(f) for c, f in BATCHES.items()},
    "fft_coefficient": fft_coefficients,
    "fft_aggregated": _picked(spectrum_moments, "aggtype"),
    "number_cwt_peaks": _cwt_peaks,
    "partial_autocorrelation": _partials,
    "cwt_coefficients": _cwt_coefficients,
    "ar_coefficient": ar_coefficients,
    "augmented_dickey_fuller": _picked(dickey_fuller, "attr"),
    "lempel_ziv_complexity": _each(lempel_ziv),
    "mean_n_absolute_max": _each(lambda x, number_of_maxima: mean_n_absolute_max(x, number_of_maxima)),
    "benford_correlation": _each(benford_correlation),
}


def array_features(xs: np.ndarray, chosen: dict[str, list[dict]]) -> np.ndarray:
    """Series of one length (rows) -> the values of all settings in order (columns), NaN where undefined."""
    many = max(1, SHORT**2 // xs.shape[1] ** 2)  # comparisons of all points of a series stay within a few MB
    out = []
    for c, settings in chosen.items():
        f, one = BATCHES.get(c), ARRAY_CALCULATORS[c]
        if f is not None:
            out.append(np.concatenate([f(xs[at : at + many], settings) for at in range(0, len(xs), many)]))
        else:
            out.append(np.array([[np.nan if y is None else y for y in one(x, settings)] for x in xs], float))
    return np.concatenate(out, axis=1)
