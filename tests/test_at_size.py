"""Steps that must stay in bounds on large tables, against plain versions of them."""

import math

import numpy as np
from pyspark.util import PythonEvalType

from cohortwave.operators import complexity as X
from cohortwave.operators import fourier as T
from cohortwave.operators import learning as L
from cohortwave.operators import scaling as C
from cohortwave.operators import selection as S


def _epochs(spark, rows):
    points = [(1, "c", "open", e, i, v) for e, xs in enumerate(rows) for i, v in enumerate(xs)]
    return spark.createDataFrame(points, "subject long, channel string, state string, epoch long, i long, x double")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _alike(x, m, n, tol):
    near = lambda a, b: a is not None and b is not None and (abs(a - b) <= tol or math.isnan(tol))
    return [[all(near(x[i + k], x[j + k]) for k in range(m)) for j in range(n)] for i in range(n)]


def test_entropies_are_those_of_plain_loops(spark):
    r = np.random.default_rng(5)
    rows = [r.normal(size=20).tolist(), r.integers(0, 3, 20).astype(float).tolist(), [1.0] * 20, [None, *r.integers(0, 2, 19).astype(float).tolist()], r.integers(0, 3, 12).astype(float).tolist(), [None] * 20]
    rows.append([*r.normal(size=19).tolist(), float("nan")])
    e = _epochs(spark, rows)
    for got in (X.app_entropy(e), X.sample_entropy(e)):
        # before, each pair of samples was a call of interpreted expressions
        assert "ArrowEvalPython" in _plan(got)
    app, sample = ({q.epoch: q[-1] for q in f(e).collect()} for f in (X.app_entropy, X.sample_entropy))
    assert set(app) == set(sample) == set(range(len(rows)))
    for n, x in enumerate(rows):
        known = [v for v in x if v is not None]
        tol = 0.2 * float(np.std(known)) if known else 0.0
        phi = lambda m: sum(math.log(sum(row) / (len(x) - m + 1)) for row in _alike(x, m, len(x) - m + 1, tol)) / (len(x) - m + 1)
        a, b = (sum(map(bool, np.triu(_alike(x, m, len(x) - 2, tol), 1).ravel())) for m in (3, 2))
        assert app[n] is None if None in x else abs(app[n] - (phi(2) - phi(3))) < 1e-9
        assert sample[n] is None if not a else abs(sample[n] + math.log(a / b)) < 1e-9


def test_hurst_is_worked_out_in_the_epochs_row(spark):
    r = np.random.default_rng(6)
    rows = [("s", "open", "c", n, xs) for n, xs in enumerate([r.normal(size=96).cumsum().tolist(), [0.1 * i for i in range(40)], [2.0] * 40, r.normal(size=11).tolist(), [*r.normal(size=30).tolist(), float("inf")], [1.0, None] * 10])]
    got = C.hurst(spark.createDataFrame(rows, "subject string, state string, channel string, epoch long, xs array<double>"))
    assert "Exchange" not in _plan(got) and "Window" not in _plan(got)  # before, a row a point and size was shuffled and sorted
    said = {q.epoch: q.hurst for q in got.collect()}
    assert 2 not in said and 3 not in said and 5 not in said and math.isnan(said[4])
    x, lx, ly = np.array(rows[0][4]), [], []
    for size in (10, 17, 31, 56, 96):
        steps = [np.diff(x[a : a + size]) for a in range(0, 96 - size + 1, size)]
        z = [np.cumsum(s - s.mean()) for s in steps]
        lx.append(math.log10(size))
        ly.append(math.log10(np.mean([(a.max() - a.min()) / s.std(ddof=1) for a, s in zip(z, steps)])))
    assert abs(said[0] - np.polyfit(lx, ly, 1)[0]) < 1e-9


def test_transforms_of_many_lengths_make_no_object_a_row(spark):
    r = np.random.default_rng(7)
    rows = [("s", "open", "c", n, r.normal(size=size).tolist()) for n, size in enumerate([8, 9, 0, 8, 1, 32] * 40)]
    coefs = T.dft(spark.createDataFrame(rows, "subject string, state string, channel string, epoch long, xs array<double>"), centre=False)
    # pandas would hold two objects for each row
    assert T._transform.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    for q in coefs.collect():
        want = np.fft.rfft(rows[q.epoch][4]) if rows[q.epoch][4] else []
        assert np.allclose([c.re + 1j * c.im for c in q.coef], want)


def test_neighbours_of_many_ties_and_other_distances(spark):
    r = np.random.default_rng(9)
    x, y = r.integers(0, 3, (300, 3)).astype(float), r.random(300)
    v = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(300)], "id long, v array<double>, y double")
    for p in (2.0, 1.0):
        got = {q.id: q.y for q in L.knn_predict(v.where("id < 200"), v.where("id >= 200").select("id", "v"), 5, p, block=64).collect()}
        want = {i: y[np.argsort((np.abs(x[:200] - x[i]) ** p).sum(1), kind="stable")[:5]].mean() for i in range(200, 300)}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_neighbours_far_from_the_origin_are_not_lost_to_rounding():
    r = np.random.default_rng(10)
    x = 1e6 + r.normal(size=(2000, 16)) * 1e-3
    i, j, d = L._nearest(x, x[:40], 5, 2.0)
    for n in range(40):
        exact = ((x - x[n]) ** 2).sum(1)
        assert j[i == n].tolist() == np.argsort(exact, kind="stable")[:5].tolist()
    assert L._nearest(x[:3], x[:2], 5, 2.0)[0].tolist() == [0, 0, 0, 1, 1, 1]


def test_tau_is_the_same_for_any_buckets(spark):
    r = np.random.default_rng(11)
    x, y = [r.normal(size=90), r.integers(0, 4, 90) * 1.0, np.ones(90), r.integers(0, 30, 90) * 1.0], [r.integers(0, 2, 90) * 1.0, r.normal(size=90)]
    for target in y:
        rows = spark.createDataFrame([(f"k{j}", float(v), float(target[i])) for j, col in enumerate(x) for i, v in enumerate(col)], "key string, value double, y double")
        for span in (3, 10, None):
            got = S.tau(rows, 90, span)
            # before, a row was made for each pair of digits of ranks
            assert "Generate" not in _plan(got)
            got = {q.key: q.score for q in got.collect()}
            for j, col in enumerate(x):
                up, side = np.sign(col[:, None] - col), np.sign(target[:, None] - target)
                below = math.sqrt(float((up != 0).sum()) * float((side != 0).sum()))
                assert got[f"k{j}"] is None if not below else abs(got[f"k{j}"] - abs((up * side).sum()) / below) < 1e-12
