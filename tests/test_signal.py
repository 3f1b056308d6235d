"""Complex spectra, peaks, scaling and uncorrelated features against plain formulas and planted structure."""

import math

import numpy as np
import pytest

from cohortwave.operators import evaluation as E
from cohortwave.operators import fourier as T
from cohortwave.operators import independence as I
from cohortwave.operators import peaks as P
from cohortwave.operators import scaling as C
from cohortwave.operators import selection as S

EPOCHS = "subject long, state string, channel string, epoch long, xs array<double>"


def epochs(spark, rows):
    return spark.createDataFrame([(1, "open", c, e, [float(v) for v in x]) for c, e, x in rows], EPOCHS)


def spectrum(spark, power, freq=None):
    return spark.createDataFrame([(1, "open", "c", k, float(freq[k] if freq is not None else k), float(p)) for k, p in enumerate(power)], "subject long, state string, channel string, k int, freq double, power double")


def test_sine_peaks_at_its_frequency(spark):
    x = np.sin(2 * math.pi * 10 * np.arange(200) / 100)
    got = T.multitaper_psd(T.dft(epochs(spark, [("c", 0, x)]), T.sine_tapers(spark, 200, 4)), 100.0).collect()
    assert abs(max(got, key=lambda r: r.power).freq - 10) < 1.01
    # the density of a sine of amplitude 1 adds up to its mean square
    assert abs(sum(r.power for r in got) * 0.5 - 0.5) < 0.01


def test_coefficients_are_those_of_numpy(spark):
    r = np.random.default_rng(1)
    rows = [("a", 0, r.normal(size=16)), ("b", 0, r.normal(size=16)), ("a", 1, r.normal(size=9))]
    got = {(q.channel, q.epoch): [c.re + 1j * c.im for c in q.coef] for q in T.dft(epochs(spark, rows), centre=False).collect()}
    for c, e, x in rows:
        np.testing.assert_allclose(got[c, e], np.fft.rfft(x), atol=1e-9)


def test_tapers_are_orthonormal_and_bounded(spark, monkeypatch):
    h = np.array([r.h for r in T.sine_tapers(spark, 50, 6).orderBy("j").collect()])
    np.testing.assert_allclose(h @ h.T, np.eye(6), atol=1e-9)
    monkeypatch.setattr(T, "MOST_VALUES", 10)
    with pytest.raises(ValueError):
        T.dft(epochs(spark, [("a", 0, range(50))]), T.sine_tapers(spark, 50, 6))


def test_epochs_with_nulls_or_of_other_lengths_are_left_out(spark):
    odd = spark.createDataFrame([(1, "o", "a", 0, [1.0, None]), (1, "o", "a", 1, None), (1, "o", "a", 2, [1.0, 2.0, 3.0]), (1, "o", "a", 3, [1.0, 2.0])], EPOCHS)
    assert [r.epoch for r in T.dft(odd, T.hann_taper(spark, 2)).collect()] == [3]
    assert T.dft(odd.limit(0)).collect() == []


def test_delayed_copies_are_coherent_and_locked(spark):
    r = np.random.default_rng(2)
    rows = []
    for e in range(30):
        z = r.normal(size=66)
        rows += [("a", e, z[2:]), ("b", e, z[:-2]), ("n", e, r.normal(size=64))]
    cross = T.cross_spectra(T.dft(epochs(spark, rows), T.hann_taper(spark, 64)))
    bands = [(0.05, 0.2)]
    coh = {(q.a, q.b): q.coherence for q in T.pair_coherence(cross, 1.0, bands).collect()}
    lock = {(q.a, q.b): q for q in T.pair_phase_locking(cross, 1.0, bands).collect()}
    phase = {(q.a, q.b): q.phase for q in T.pair_phase(cross, 1.0, bands).collect()}
    assert coh["a", "b"] > 0.9 > 0.2 > coh["a", "n"]
    assert lock["a", "b"].plv > 0.9 and lock["a", "b"].pli > 0.9 and lock["a", "n"].plv < 0.4
    # b lags by two samples: at 0.125 of the rate that is 90 degrees
    assert abs(phase["a", "b"] * 0.15 - 90) < 10 and phase["b", "a"] == -phase["a", "b"]


def brute_peaks(p, f, harmonics, prominence):
    v, out, n = np.log10(p), [], len(p)
    i = 1
    while i < n - 1:
        j = i
        while j < n - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < n - 1 and v[j + 1] < v[i]:
            out.append((i + j) // 2)
        i = j + 1

    def prom(x, k):
        a = b = k
        while a > 0 and x[a - 1] <= x[k]:
            a -= 1
        while b < n - 1 and x[b + 1] <= x[k]:
            b += 1
        return x[k] - max(x[a : k + 1].min(), x[k : b + 1].min())

    got = []
    for k in out:
        if prom(v, k) >= prominence and any(np.isclose(f[k], h, rtol=0.05) for h in harmonics):
            height = p[k] - prom(p, k) / 2
            a, b = k, k
            while p[a] > height:
                a -= 1
            while p[b] > height:
                b += 1
            width = (b - (height - p[b]) / (p[b - 1] - p[b])) - (a + (height - p[a]) / (p[a + 1] - p[a]))
            got.append((k, round(prom(v, k), 6), round(width, 6), f[max(int(k - width), 0)], f[min(int(k + width), n - 1)]))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_line_noise_peaks_are_those_of_a_walk_from_the_peak(spark, seed):
    r = np.random.default_rng(seed)
    p = 10 ** r.integers(0, 4 if seed else 2, 120).astype(float)  # many equal heights
    f = np.arange(120) + 0.5
    got = [(q.k, round(q.prominence, 6), round(q.width, 6), q.lo, q.hi) for q in P.line_noise_peaks(spectrum(spark, p, f), [30.0, 60.0, 90.0, 115.0]).orderBy("k").collect()]
    assert got == brute_peaks(p, f, [30.0, 60.0, 90.0, 115.0], 0.5)


def test_knee_is_found_on_the_grid(spark):
    f = np.arange(1, 80) * 1.0
    got = P.aperiodic_knee(spectrum(spark, 10 ** (1.5 - np.log10(25 + f**2)), f), 1.0, 80.0, [0.0, 5.0, 25.0, 100.0], [1.0, 1.5, 2.0, 2.5]).first()
    assert (got.knee, got.exponent) == (25.0, 2.0) and abs(got["offset"] - 1.5) < 1e-9 and got.mse < 1e-12


def test_peaks_of_bands_are_where_they_were_put(spark):
    f = np.arange(1, 60) * 0.5
    v = 1 - np.log10(f) + 0.8 * np.exp(-((f - 6) ** 2) / 2) + 0.5 * np.exp(-((f - 10) ** 2) / 0.5)
    got = {r.band_id: r for r in P.band_peaks(spectrum(spark, 10**v, f), 0.5, 30.0, [(4.0, 8.0), (8.0, 12.0), (20.0, 28.0)]).collect()}
    assert got[0].center == 6.0 and got[1].center == 10.0 and got[0].height > got[1].height > 0.4
    assert got[0].width > got[1].width and got[2].height < 0.1


def reference_dfa(x):
    walk, sizes, f = np.cumsum(x - x.mean()), [], []
    for i in range(int(math.log(0.1 * len(x) / 4) / math.log(1.2)) + 1):
        n = int(4 * 1.2**i)
        if n not in sizes:
            sizes.append(n)
            d = walk[: len(x) // n * n].reshape(-1, n)
            t = np.arange(n)
            f.append(math.sqrt(np.mean([np.mean((row - np.polyval(np.polyfit(t, row, 1), t)) ** 2) for row in d])))
    return np.polyfit(np.log(sizes), np.log(f), 1)[0]


def reference_hurst(x):
    sizes = [int(10**e) for e in np.arange(1, math.log10(len(x) - 1), 0.25)] + [len(x)]
    rs = []
    for w in sizes:
        each = []
        for a in range(0, len(x) - w + 1, w):
            steps = np.diff(x[a : a + w])
            z = np.cumsum(steps - steps.mean())
            each.append((z.max() - z.min()) / steps.std(ddof=1))
        rs.append(np.mean(each))
    h, c = np.polyfit(np.log10(sizes), np.log10(rs), 1)
    return h, 10**c


def test_scaling_exponents(spark):
    r = np.random.default_rng(5)
    noise = r.normal(size=600)
    walk = np.cumsum(noise)
    df = epochs(spark, [("noise", 0, noise), ("walk", 0, walk), ("flat", 0, np.ones(600)), ("short", 0, [1, 2, 3])])
    got = {q.channel: q for q in C.hurst(df).collect()}
    d = {q.channel: q.dfa for q in C.dfa(df).collect()}
    assert abs(d["noise"] - reference_dfa(noise)) < 1e-6 and abs(d["walk"] - reference_dfa(walk)) < 1e-6 and 0.4 < d["noise"] < 0.65 < 1.3 < d["walk"]
    h, c = reference_hurst(walk)
    assert abs(got["walk"].hurst - h) < 1e-6 and abs(got["walk"].constant - c) < 1e-6 and 0.4 < h < 0.7
    assert "flat" not in got and "short" not in got


def greedy(keys, rank, near):
    kept = []
    for k in sorted(keys, key=rank.get):
        if not near[k] & set(kept):
            kept.append(k)
    return set(kept)


@pytest.mark.parametrize("seed,density", [(0, 0.02), (1, 0.1), (2, 0.5), (3, 1.0), (4, 0.0)])
def test_rounds_keep_what_the_greedy_walk_keeps(spark, seed, density):
    r = np.random.default_rng(seed)
    keys = [f"k{i}" for i in range(60)]
    rank = dict(zip(keys, r.permutation(60).tolist()))
    pairs = [(a, b) for a in keys for b in keys if a < b and r.random() < density]
    near = {k: {b for a, b in pairs if a == k} | {a for a, b in pairs if b == k} for k in keys}
    nodes = spark.createDataFrame(list(rank.items()), "key string, rank long")
    edges = spark.createDataFrame([*pairs, ("k1", "k1"), ("k1", "gone")], "k1 string, k2 string")
    assert {q.key for q in I.greedy_independent(nodes, edges).collect()} == greedy(keys, rank, near)


def test_a_chain_takes_every_second_key(spark):
    nodes = spark.createDataFrame([(f"{i:03d}", i) for i in range(15)], "key string, rank long")
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(14)], "k1 string, k2 string")
    assert sorted(int(q.key) for q in I.greedy_independent(nodes, edges).collect()) == list(range(0, 15, 2))


def test_decollinearized_matrix(spark):
    """As random matrices show: as many as asked for at least, no more than the best ones, none correlated."""
    r = np.random.default_rng(7)
    x = r.random((100, 30))
    x[:, 10:20] = x[:, :10] + 1e-3 * r.random((100, 10))
    y = (r.random(100) > 0.5).astype(int)
    f = spark.createDataFrame([(i, f"f{j:02d}", float(x[i, j])) for i in range(100) for j in range(30)], "subject long, key string, value double")
    t = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "subject long, y int")
    scores = S.score_pearson(f, t)
    got = I.decollinearize(f, scores, num_features=25, feat_threshold=0.9).collect()
    kept = [int(q.key[1:]) for q in got]
    c = np.abs(np.corrcoef(x.T))
    assert all(c[a, b] < 0.9 for a in kept for b in kept if a != b) and 15 <= len(kept) <= 20 and not any(q.padded for q in got)
    assert len(I.decollinearize(f, scores, num_features=25, targ_threshold=2.0, min_features=5).collect()) == 5
    none = f.where("key = 'none'")
    assert I.decollinearize(none, scores.limit(0)).collect() == []


def test_kendall_counts_pairs(spark):
    r = np.random.default_rng(3)
    x, y = r.integers(0, 12, 90).astype(float), r.normal(size=90).round(1)
    f = spark.createDataFrame([(i, "a", None if i % 9 == 0 else float(x[i])) for i in range(90)] + [(i, "flat", 1.0) for i in range(90)], "subject long, key string, value double")
    t = spark.createDataFrame([(i, None if i == 4 else float(y[i])) for i in range(90)], "subject long, y double")
    some = [i for i in range(90) if i % 9 and i != 4]
    pairs = [(np.sign(x[a] - x[b]), np.sign(y[a] - y[b])) for a in some for b in some if a < b]
    tau = sum(u * v for u, v in pairs) / math.sqrt(sum(abs(u) for u, _ in pairs) * sum(abs(v) for _, v in pairs))
    got = {q.key: q.score for q in S.score_kendall(f, t).collect()}
    assert abs(got["a"] - abs(tau)) < 1e-12 and got["flat"] is None


def test_spearman_ranks_the_rows_that_have_both(spark):
    v, y = [3.0, None, 1.0, 2.0, 5.0, None, 4.0], [1.0, 9.0, 2.0, 3.0, 4.0, 0.0, 5.0]
    f = spark.createDataFrame([(i, k, x) for i, x in enumerate(v) for k in "a"] + [(i, "b", float(i)) for i in range(7)], "subject long, key string, value double")
    t = spark.createDataFrame(list(enumerate(y)), "subject long, y double")
    rank = lambda a: np.argsort(np.argsort(a))
    some = [i for i in range(7) if v[i] is not None]
    got = {q.key: q.score for q in S.score_spearman(f, t).collect()}
    assert abs(got["a"] - abs(np.corrcoef(rank([v[i] for i in some]), rank([y[i] for i in some]))[0, 1])) < 1e-12
    assert abs(got["b"] - abs(np.corrcoef(np.arange(7), rank(y))[0, 1])) < 1e-12


def test_perturbed_splits_hold_each_subject_once(spark):
    r = np.random.default_rng(8)
    y = r.integers(0, 2, 50)
    rows = [(i, int(y[i]), "good", float(y[i])) for i in range(50)] + [(i, int(y[i]), "bad", float(r.random())) for i in range(50)]
    p = spark.createDataFrame(rows, "subject long, y int, model string, p double")
    got = E.perturbation_splits(p, 5).collect()
    assert {q.split for q in got} == set(range(5)) and {q.model for q in got} == {"good"} and all(q.ival_mcc == q.holdout_mcc == 1.0 for q in got)
    assert sorted(map(tuple, E.perturbation_splits(p.repartition(7), 5).collect())) == sorted(map(tuple, got))


def test_constant_keys_have_no_correlation(spark):
    """Spark's own correlation raises an error there."""
    f = spark.createDataFrame([(i, k, 1.0 if k == "flat" else float(i)) for i in range(5) for k in ("flat", "x")] + [(0, "one", 2.0)], "subject long, key string, value double")
    t = spark.createDataFrame([(i, float(i % 2)) for i in range(5)], "subject long, y double")
    for score in (S.score_pearson, S.score_spearman, S.score_kendall):
        got = {q.key: q.score for q in score(f, t).collect()}
        assert got["flat"] is None and got["one"] is None and got["x"] is not None
    assert {(q.k1, q.k2): q.r for q in S.pair_correlation(f).collect()}["flat", "x"] is None


def test_confidence_of_the_f_statistic(spark):
    """Known quantiles: F(1, 10) at 4.964603 is 0.95, F(2, 6) at 5.143253 is 0.95, F(9, 20) at 3.456676 is 0.99."""
    r = np.random.default_rng(1)
    for k, n, f95, want in ((2, 12, 4.964603, 0.95), (3, 9, 5.143253, 0.95), (10, 30, 3.456676, 0.99)):
        y = np.arange(n) % k
        e = r.normal(size=n)
        e -= np.array([e[y == c].mean() for c in range(k)])[y]
        within = (e**2).sum() / (n - k)
        m = r.normal(size=k)
        m -= m.mean()
        m *= math.sqrt(f95 * within * (k - 1) / (n / k * (m**2).sum()))
        f = spark.createDataFrame([(i, "a", float(m[y[i]] + e[i])) for i in range(n)] + [(0, "one", 1.0)], "subject long, key string, value double")
        t = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "subject long, y int")
        got = {q.key: q for q in S.anova_confidence(f, t).collect()}
        assert abs(got["a"].score - f95) < 1e-6 and abs(got["a"].confidence - want) < 1e-5 and got["one"].confidence is None


def test_entropy_of_singular_values_of_any_order(spark):
    from cohortwave.operators import complexity

    x = np.sin(np.arange(150) * 0.3) + 0.2 * np.random.default_rng(2).normal(size=150)
    rows = [(1, "c", "o", i, float(v)) for i, v in enumerate(x)] + [(2, "c", "o", i, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "subject long, channel string, state string, t_idx long, x double")
    for order, delay in ((3, 1), (5, 2)):
        m = np.stack([x[k * delay : len(x) - (order - 1 - k) * delay] for k in range(order)], 1)
        p = np.linalg.svd(m, compute_uv=False)
        p /= p.sum()
        got = {q.subject: q.svd_entropy for q in complexity.svd_entropy_of(df, order, delay).collect()}
        assert abs(got[1] + (p * np.log2(p)).sum() / math.log2(order)) < 1e-6 and got[2] is None
