"""Periodic runs against a scan of every lag, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortwave.llm import periodic

from .common import D, ODD, SCHEMA, WORD


def brute(w, least=12):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def quick(w, least=12):
    """The same with whole lags compared at once."""
    _, x = np.unique(np.array(w, object).astype(str), return_inverse=True) if w else (0, np.zeros(0, int))
    return sorted(((s, e - s, q) for s, e, q in zip(*(v.tolist() for v in periodic.plain(x, range(1, len(x) // 2 + 1), least)))), key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def random_words(rng):
    w = []
    for _ in range(rng.randint(0, 5)):
        if rng.random() < 0.5:
            k = rng.choice([1, 2, 3, 30])
            w += [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        else:
            w += ([rng.randrange(9) for _ in range(rng.randint(1, 15))] * 8)[: rng.randint(5, 60)]
    return w


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_brute_force(seed):
    rng = random.Random(seed)
    rows = [random_words(rng) for _ in range(8)]
    first = np.append(0, np.cumsum([len(r) for r in rows]))
    row, start, end, lag = periodic.runs_of(np.array(sum(rows, []), np.uint64), first)
    for i, w in enumerate(rows):
        assert [(s - first[i], e - s, q) for r, s, e, q in zip(row, start, end, lag) if r == i] == brute(w) == quick(w)


def test_scan_by_words_is_the_scan_by_blocks():
    rng = random.Random(5)
    x = np.array(sum((random_words(rng) for _ in range(30)), []))
    start, end, lag = periodic.scan(x, np.array([len(x)]))
    assert sorted(zip(start, end, lag)) == sorted(zip(*periodic.plain(x, range(1, len(x) // 2 + 1), 12)))


def test_splitting_is_only_quicker():
    rng = random.Random(9)
    w = np.array(sum((random_words(rng) for _ in range(20)), []))
    assert (np.diff(periodic.surviving(w, np.zeros(len(w), int))) > 0).all()
    assert len(periodic.surviving(np.arange(1000), np.zeros(1000, int))) == 0


def test_long_texts_take_little_time():
    """Any repetition: one word, one period, none. By lag these would be 10^10 comparisons each."""
    for w in (np.zeros(200_000), np.tile(np.random.default_rng(1).integers(0, 5000, 5000), 40), np.random.default_rng(2).integers(0, 300, 200_000)):
        periodic.runs_of(w.astype(np.uint64), np.array([0, len(w)]))


def checked(rows, got):
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        w = contract(doc_id, text)
        runs, r = quick(w), by[doc_id][0]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


def test_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    got = periodic.op12_periodic_runs(spark, D).collect()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    checked(rows, got)


def test_odd_rows_and_clashing_names(spark):
    odd = spark.createDataFrame([(*r, 1, 2) for r in ODD], SCHEMA + ", runs long, collapsed long")
    got = periodic.find(odd).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.collapsed for r in got}[1] == ""
    assert [tuple(x) for x in {r.doc_id: r.runs for r in got}[7]] == [(0, 60_000, 1)]
    assert {r.doc_id: r.collapsed for r in got}[7] == "word"
    assert {r.doc_id: r.collapsed for r in got}[8] == "ünï cödé ☃ 👍🏽 A\x00B"


def test_empty_table(spark):
    assert periodic.find(spark.createDataFrame([], SCHEMA)).collect() == []
