"""Whole-series calculators against hand-computed series, direct statements of their definitions, and published values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import features as T
from pulsegrid.operators import series_arrays as S

RNG = np.random.default_rng(7)


def walk(n, phi, seed=1):
    e, x = np.random.default_rng(seed).normal(size=n), np.zeros(n)
    for t in range(1, n):
        x[t] = phi * x[t - 1] + e[t]
    return x


def test_permutation_entropy_by_hand():
    # 4 7 9 10 6 11 3: patterns of two 4 up and 2 down; of three 2 012, 1 each of 201 and 210 by rank, 1 of 102... counted below
    x = np.array([4, 7, 9, 10, 6, 11, 3.0])
    assert S.permutation_entropy(x, 1, 2) == pytest.approx(-(4 / 6) * math.log(4 / 6) - (2 / 6) * math.log(2 / 6))
    assert S.permutation_entropy(x, 1, 3) / math.log(2) == pytest.approx(1.5219, abs=1e-4)  # Bandt and Pompe 2002
    assert S.permutation_entropy(np.arange(10.0), 1, 4) == 0 and S.permutation_entropy(np.arange(3.0), 1, 4) is None
    assert S.permutation_entropy(np.array([1.0, 9, 2, 8, 3, 7]), 2, 2) == pytest.approx(math.log(2))  # pairs two apart: up, down, up, down


def test_native_permutation_entropy_is_that_of_the_array(spark):
    rows = [(k, t, float(v)) for k in range(4) for t, v in enumerate(RNG.integers(0, 6, 5 + 20 * k))]
    df = spark.createDataFrame(rows, "id int, time int, value double").repartition(4)
    for tau, dim in ((1, 3), (2, 4)):
        got = {r.id: r.entropy for r in T.permutation_entropies(df, dim, tau).collect()}
        for k in range(4):
            want = S.permutation_entropy(np.array([v for i, _, v in rows if i == k]), tau, dim)
            assert (got.get(k) is None) if want is None else got[k] == pytest.approx(want)


def plain_matches(x, m, reach):
    parts = [x[i : i + m] for i in range(len(x) - m + 1)]
    return [sum(max(abs(a - b) for a, b in zip(p, q, strict=True)) <= reach for q in parts) for p in parts]


def test_sample_and_approximate_entropy():
    for n in (3, 5, 12, 60):
        x = RNG.integers(0, 4, n).astype(float)
        reach = 0.2 * x.std()
        b, a = (sum(c - 1 for c in plain_matches(x, m, reach)) for m in (2, 3))
        want = -math.log(a / b) if n >= 4 and a and b else None
        got = S.sample_entropy(x)
        assert got is None if want is None else got == pytest.approx(want)
        phi = [np.mean([math.log(c / (n - m + 1)) for c in plain_matches(x, m, 0.3 * x.std())]) for m in (2, 3)] if n > 3 else [0, 0]
        assert S.approximate_entropy(x, 2, 0.3) == pytest.approx(abs(phi[0] - phi[1]))
    x = RNG.integers(0, 5, 700).astype(float)
    assert S._template_matches(x, 3, 1.0).tolist() == plain_matches(x, 3, 1.0)  # by shifts
    heart = np.array([85, 80, 89] * 17, float)  # the published example of approximate entropy: about 1.1e-5
    assert S.approximate_entropy(heart, 2, 3 / heart.std()) == pytest.approx(1.0996541105257052e-05, rel=1e-6)


def test_lempel_ziv_by_hand():
    # levels 1 0 0 1 1 1 1 0 0 ...: phrases end where they are new
    assert S.lempel_ziv(np.array([1, 0, 0, 1, 1, 1, 1, 0, 0, 0], float), 2) == pytest.approx(len(["1", "0", "01", "11", "10", "00"]) / 10)
    assert S.lempel_ziv(np.zeros(6), 2) == pytest.approx(3 / 6)  # 0, 00, 000
    assert S.lempel_ziv(np.array([5.0]), 100) == 1


def test_binned_and_fourier_entropy():
    assert S.binned_entropy(np.arange(100.0), 10) == pytest.approx(math.log(10)) and S.binned_entropy(np.ones(5), 10) == 0
    sine, noise = np.sin(np.arange(256) / 4), RNG.normal(size=256)
    low, high = (S.ARRAY_CALCULATORS["fourier_entropy"](x, [{"bins": 100}])[0] for x in (sine, noise))
    assert 0 <= low < 0.3 * high and S.ARRAY_CALCULATORS["fourier_entropy"](np.ones(8), [{"bins": 3}]) == [None]


def direct_fit(x, k):
    a = np.column_stack([np.ones(len(x) - k), *[x[k - i : len(x) - i] for i in range(1, k + 1)]])
    return np.linalg.lstsq(a, x[k:], rcond=None)[0]


def test_autoregression_from_products(spark):
    x, y = walk(300, 0.7) + 40, RNG.normal(size=40).cumsum() * 1e3
    for v in (x, y):
        for k in (1, 3, 10):
            got = S.ar_coefficients(v, [{"coeff": c, "k": k} for c in range(k + 2)])
            assert got[: k + 1] == pytest.approx(list(direct_fit(v, k)), rel=1e-6, abs=1e-6) and got[k + 1] is None
    assert abs(S.ar_coefficients(walk(20_000, 0.7), [{"coeff": 1, "k": 1}])[0] - 0.7) < 0.03
    assert S.ar_coefficients(np.ones(21), [{"coeff": 0, "k": 10}]) == [None]
    flat = S.ar_coefficients(np.full(60, 3.0), [{"coeff": c, "k": 2} for c in range(3)])
    assert flat == pytest.approx([3, 0, 0])
    rows = [(n, t, float(v)) for n, s in (("x", x), ("y", y), ("short", y[:6])) for t, v in enumerate(s)]
    df = spark.createDataFrame(rows, "id string, time int, value double").repartition(4)
    got = {r.id: [r.intercept, *r.phi] for r in T.ar_model(df, 3).collect()}
    assert set(got) == {"x", "y"} and got["x"] == pytest.approx(list(direct_fit(x, 3)), rel=1e-5) and got["y"] == pytest.approx(list(direct_fit(y, 3)), rel=1e-5)


def test_unit_root():
    # response surface: the usual critical values of the test with intercept
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert S.unit_root_p(tau) == pytest.approx(p, abs=0.002)
    assert S.unit_root_p(3) == 1 and S.unit_root_p(-20) == 0
    still = [S.dickey_fuller(walk(250, 0.3, s))["pvalue"] for s in range(20)]
    wander = [S.dickey_fuller(walk(250, 1.0, s))["pvalue"] for s in range(20)]
    assert max(still) < 0.01 and np.median(wander) > 0.2
    got = S.dickey_fuller(walk(60, 0.9))
    assert got["usedlag"] == int(got["usedlag"]) and 0 <= got["usedlag"] <= math.ceil(12 * 0.6**0.25)
    # with no lags the statistic is the t value of the level in a plain regression
    x = walk(400, 0.5, 9)
    r = S.dickey_fuller(x)
    if r["usedlag"] == 0:
        a, y = np.column_stack([np.ones(399), x[:-1]]), np.diff(x)
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        s = ((y - a @ b) ** 2).sum() / 397
        assert r["teststat"] == pytest.approx(b[1] / math.sqrt(s * np.linalg.inv(a.T @ a)[1, 1]))
    assert S.dickey_fuller(np.ones(50))["teststat"] is None and S.dickey_fuller(np.arange(3.0))["pvalue"] is None


def test_adjusted_autocorrelations():
    x = walk(41, 0.6, 3)
    d = x - x.mean()
    r = S.autocorrelations(x, 40)
    for k in range(41):
        assert r[k] == pytest.approx(sum(d[t] * d[t + k] for t in range(41 - k)) / (41 - k) / x.var())
    for k in range(1, 8):  # Yule-Walker equations over the adjusted values, solved outright
        yw = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1 : k + 1])
        assert S.partial_autocorrelation(x, k) == pytest.approx(yw[-1])
    assert S.partial_autocorrelation(x, 20) is None and S.partial_autocorrelation(x, 19) is not None
    assert S.agg_autocorrelation(x, "median", 7) == pytest.approx(np.median(r[1:8])) and S.agg_autocorrelation(x, "var", 400) == pytest.approx(r[1:].var())


def test_welch_power_is_kept_at_even_and_odd_lengths():
    for m in (2, 3, 32, 33, 64):
        x = RNG.normal(size=m)
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
        whole = np.abs(np.fft.fft((x - x.mean()) * win)) ** 2 / (win**2).sum()
        assert S.welch(x).sum() == pytest.approx(whole.sum())


def plain_ridges(x, widest):
    """The published rule, stated over sets: link maxima down the widths, then drop short and noisy lines."""
    rows = [S.wavelet_row(x, w) for w in range(1, widest + 1)]
    top = lambda r: [i for i in range(1, len(r) - 1) if r[i] > r[i - 1] and r[i] > r[i + 1]]
    lines, ended, begun = [], [], False
    for w in range(widest, 0, -1):
        found = top(rows[w - 1])
        if not begun:
            begun = bool(found)
            lines = [{"points": [(w, p)], "gap": 0} for p in found]
            continue
        heads = [line["points"][-1][1] for line in lines]
        for line in lines:
            line["gap"] += 1
        for p in found:
            best = min(range(len(heads)), key=lambda i: (abs(heads[i] - p), i), default=None)
            if best is not None and abs(heads[best] - p) <= w / 4:
                lines[best]["points"].append((w, p))
                lines[best]["gap"] = 0
            else:
                lines.append({"points": [(w, p)], "gap": 0})
        ended += [line for line in lines if line["gap"] > 1]
        lines = [line for line in lines if line["gap"] <= 1]
    n, size = 0, math.ceil(len(x) / 20)
    for line in ended + lines:
        w, p = min(line["points"], key=lambda q: q[0])
        around = sorted(rows[0][max(0, p - size // 2) : min(len(x), p + size // 2 + size % 2)])
        at = 0.1 * (len(around) - 1)
        noise = around[int(at)] + (at - int(at)) * (around[min(int(at) + 1, len(around) - 1)] - around[int(at)])
        n += len(line["points"]) >= math.ceil(widest / 4) and (noise == 0 or abs(rows[w - 1][p] / noise) >= 1)
    return n


def test_ridge_lines():
    for widest, n in itertools.product((1, 3, 5, 12), (3, 20, 60, 200)):
        for x in (RNG.normal(size=n), np.sin(np.arange(n) / 3), RNG.normal(size=n).cumsum()):
            assert S.cwt_peaks(x, widest) == plain_ridges(x, widest)
    planted = np.zeros(200)
    for p in (30, 90, 160):
        planted += 10 * np.exp(-(((np.arange(200) - p) / 4) ** 2))
    rows = [S.wavelet_row(planted + RNG.normal(size=200) / 10, w) for w in range(1, 13)]
    ends = [min(line)[1] for line in S.ridge_lines(rows) if len(line) >= 8]
    assert all(any(abs(p - e) <= 4 for e in ends) for p in (30, 90, 160))  # each planted peak has a line through most widths
    counts = [S._peaks_of_rows(rows, least_snr=s) for s in (0, 1, 1e9)]
    assert counts[0] > counts[1] > counts[2] == 0
    assert S.cwt_peaks(np.ones(2), 5) == 0 and S._cwt_peaks(planted, [{"n": 1}, {"n": 5}]) == [S.cwt_peaks(planted, 1), S.cwt_peaks(planted, 5)]


def test_digits_and_largest_values():
    powers = 2.0 ** np.arange(200)
    assert S.benford_correlation(powers) > 0.99 and S.benford_correlation(np.zeros(4)) is None
    assert S.mean_n_absolute_max(np.array([1, -5, 3.0]), 2) == 4 and S.mean_n_absolute_max(np.ones(2), 3) is None


def test_mass_and_corridors_by_hand(spark):
    rows = [("a", t, v) for t, v in enumerate([1.0, -3.0, 2.0, 4.0])] + [("z", t, 0.0) for t in range(3)] + [("s", 0, 5.0)]
    df = spark.createDataFrame(rows, "id string, time int, value double")
    got = {r.id: r.asDict() for r in T.extract_features(df, T.MASS).collect()}
    a, z, s = got["a"], got["z"], got["s"]
    assert a["value__index_mass_quantile__q_0_1"] == 0.25 and a["value__index_mass_quantile__q_0_4"] == 0.5 and a["value__index_mass_quantile__q_0_7"] == 1
    assert z["value__index_mass_quantile__q_0_5"] is None and s["value__index_mass_quantile__q_0_9"] == 1
    energy = [a[f"value__energy_ratio_by_chunks__num_segments_10__segment_focus_{k}"] for k in range(10)]
    assert energy == pytest.approx([1 / 30, 9 / 30, 4 / 30, 16 / 30] + [0] * 6)
    assert a["value__cid_ce__normalize_False"] == pytest.approx(math.sqrt(16 + 25 + 4)) and z["value__cid_ce__normalize_True"] == 0 == s["value__cid_ce__normalize_False"]
    assert a["value__change_quantiles__ql_0_0__qh_1_0__isabs_True__f_agg_mean"] == pytest.approx(11 / 3)
    assert a["value__change_quantiles__ql_0_0__qh_1_0__isabs_False__f_agg_var"] == pytest.approx(np.var([-4, 5, 2]))
    assert a["value__change_quantiles__ql_0_2__qh_0_8__isabs_False__f_agg_mean"] == 0  # 1 and 2 are inside but not neighbours


def test_efficient_covers_the_calculators(spark):
    rows = [(k, t, float((t * 7 + k * 3) % 11)) for k in range(3) for t in range(30)]
    out = T.extract_features(spark.createDataFrame(rows, "id int, time int, value double"), "efficient")
    names = {c.split("__")[1] for c in out.columns[1:]}
    assert len(out.columns) > 400 and names >= {*T.MASS, *T.COUNTS, *T.REGRESSIVE, *T.COMPLEXITY}
    first = out.where("id = 1").first().asDict()
    x = np.array([v for k, _, v in rows if k == 1])
    f = np.fft.rfft(x)
    for k in (0, 1, 15):
        assert first[f"value__fft_coefficient__coeff_{k}__attr_abs"] == pytest.approx(abs(f[k]), abs=1e-9)
    assert first["value__fft_coefficient__coeff_20__attr_abs"] is None
    few = T.extract_features(spark.createDataFrame(rows, "id int, time int, value double"), {"fft_coefficient": [{"coeff": 1, "attr": a} for a in ("real", "imag", "abs")]}).where(F.col("id") == 1).first()
    assert list(few)[1:] == pytest.approx([f[1].real, f[1].imag, abs(f[1])])


def test_mass_that_is_a_share_exactly_counts_as_reached(spark):
    # 0.36 + 0.16 + 0.56 is 0.9 of 1.20, but 0.8999999999999999 in doubles
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate((0.36, 0.16, 0.56, 0.12))], "id string, time int, value double")
    assert T.extract_features(df, {"index_mass_quantile": [{"q": 0.9}, {"q": 0.95}]}).first()[1:] == (0.75, 1.0)


def test_autoregression_hands_arrays_of_numbers_to_python(spark):
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(walk(40, 0.5))], "id string, time int, value double")
    plan = T.ar_model(df, 3)._jdf.queryExecution().optimizedPlan()
    sent = plan.children().head().schema().catalogString()
    assert "array<struct" not in sent  # a struct a pair is a dict a pair in Python
    assert plan.toString().count("Aggregate") == 1  # sums are not spread over rows and gathered again
    phi = T.ar_model(df, 3).first()
    assert [phi.intercept, *phi.phi] == pytest.approx(S.ar_coefficients(walk(40, 0.5), [{"coeff": c, "k": 3} for c in range(4)]))


def test_series_of_one_length_are_taken_together(monkeypatch):
    """A wave costs calls of numpy rather than points: many waves are few calls, and each has the values it has alone."""
    xs, calls = np.vstack([RNG.normal(size=(150, 64)), RNG.integers(0, 3, (150, 64)), np.ones((1, 64))]), []
    counted = lambda f: lambda x, settings: calls.append(len(x)) or f(x, settings)
    chosen = {c: T.PRESETS["efficient"][c] for c in S.BATCHES}
    monkeypatch.setattr(S, "BATCHES", {c: counted(f) for c, f in S.BATCHES.items()})
    got = S.array_features(xs, chosen)
    assert sum(calls) == len(xs) * len(chosen) and len(calls) <= len(chosen) * len(xs) / 50
    for x, row in zip(xs, got, strict=True):
        want = [np.nan if v is None else v for c, many in chosen.items() for v in S.ARRAY_CALCULATORS[c](x, many)]
        assert row == pytest.approx(want, nan_ok=True)


def test_change_quantiles_of_arrays_are_the_aggregates(spark):
    rows = [(n, t, None if n > 5 and t % 7 == 3 or n == 9 else float(v)) for n in range(10) for t, v in enumerate(RNG.integers(0, 9 + n, (1, 2, 5, 30, 64)[n % 5]))]
    df = spark.createDataFrame(rows, "id int, time int, value double").repartition(4)
    many = T.MASS["change_quantiles"]
    assert len(many) > T.MANY
    together = {r.id: r for r in T.extract_features(df, {"change_quantiles": many}).collect()}
    alone = {r.id: r for r in T.extract_features(df, {"change_quantiles": many[::4]}).collect()}
    assert set(together) == set(alone) == set(range(10))
    for k, r in alone.items():
        for name in (T.feature_name("change_quantiles", p) for p in many[::4]):
            assert together[k][name] == pytest.approx(r[name], abs=1e-12), (k, name)
