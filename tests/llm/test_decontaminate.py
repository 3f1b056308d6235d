"""Benchmark windows against string search, and SQL."""

import hashlib
import re

import duckdb
import pytest

from cohortwave.llm import decontaminate
from cohortwave.llm.registry import oracle_sql

from .common import D, ODD, SCHEMA

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def words(text):
    return PART.findall((text or "").translate(LOWER))


def brute(rows, items, n=10):
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            k = min(n, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1 if v else 0):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    if item_id is not None:
                        ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."), (10, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (2, "short ITEM"), (3, None), (4, "?! ..."),
    (5, "Ünï cödé"), (None, "no id at all"), (2, "short ITEM"), (9, "x" * 300_000),
]
TEXTS = [
    (20, "see: alpha-beta gamma/delta epsilon\nzeta eta theta iota kappa, and then a SHORT item!"), (21, "alpha beta gamma delta epsilon zeta eta theta iota"), (22, "short item short item no id at all"),
    (23, "short"), (24, "item"), (25, "ünï cödé and Ünï cödé"), (26, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (27, None), (28, "x" * 300_000),
]


@pytest.fixture(scope="module")
def tables(spark):
    odd = [r[:2] for r in ODD]
    return spark.createDataFrame(TEXTS + odd, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def digest(found):
    return sorted(
        ((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), bool(r.hits)) for r in found.collect()), key=repr
    )


@pytest.mark.parametrize("part_bytes", [1 << 24, 120_000])
def test_small_cases_are_brute_force(tables, part_bytes):
    """With one part and with several."""
    docs, items = tables
    assert digest(decontaminate.scan(docs, items, part_bytes=part_bytes)) == brute(TEXTS + [r[:2] for r in ODD], ITEMS)


def test_query_is_brute_force_and_sql(spark):
    got = sorted(map(tuple, decontaminate.op13_benchmark_windows(spark, D).collect()), key=repr)
    rows, items = ([tuple(r) for r in spark.read.parquet(f"{D}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == brute(rows, items) and any(r[-1] for r in got)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert sorted(con.sql(oracle_sql()["op13_benchmark_windows"]).fetchall(), key=repr) == got


def test_spans_and_documents_go(tables):
    docs, items = tables
    cut = {20: "see: , and then a !", 22: "", 25: "ünï cödé and ", 26: " nu", 28: "", 6: ""}
    want = dict([*TEXTS, *[r[:2] for r in ODD]]) | cut
    assert {r.doc_id: r.text for r in decontaminate.clean(docs, items).collect()} == want
    kept = {r.doc_id for r in decontaminate.clean(docs, items, "documents").collect()}
    assert kept == set(want) - set(cut)


def test_clashing_names_and_empty_tables(spark, tables):
    docs, items = tables
    wide = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in ODD], SCHEMA + ", hits long, item_ids long, n_words long, row long")
    out = decontaminate.clean(wide, items)
    assert out.columns == wide.columns and out.count() == len(ODD)
    assert decontaminate.scan(docs.limit(0), items).collect() == []
    assert all(not r.hits for r in decontaminate.scan(docs, items.limit(0)).collect())
