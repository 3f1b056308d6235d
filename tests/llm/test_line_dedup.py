"""The template tree against all pairs of lines of a leaf, on whole small tables."""

import collections
import re

import pytest

from cohortwave.llm import line_dedup as T

from .common import D, ODD, SCHEMA


def tokens(line):
    return [w for w in re.split("[ \t\x0b\x0c\r]+", line) if w]


def masked(line):
    w = tokens(line)
    wild = [T.WILD if re.search("[0-9]", x) else x for x in w]
    return tuple(w if all(x == T.WILD for x in wild) else wild)


def enough(n, least=T.LEAST_DOCS):
    return min(least, T.LEAST_LONG) if n >= T.LONG_TOKENS else least


def recurring(rows, key):
    """Templates in enough documents of different text, and the first document of each."""
    texts = collections.defaultdict(dict)
    for r in rows:
        d = texts[r[key]]
        d[r["print"]] = min(d.get(r["print"], r["id"]), r["id"])
    size = {r[key]: r["n"] for r in rows}
    return {k: min(d.values()) for k, d in texts.items() if len(d) >= enough(size[k])}


def brute(docs):
    rows = []
    for i, text in docs:
        for pos, line in enumerate((text or "").split("\n")):
            m = masked(line)
            if m:
                rows.append({"id": 2**63 - 1 if i is None else i, "print": text, "pos": pos, "n": len(m), "line": m, "leaf": (len(m), m[: T.DEPTH])})
    drops = collections.defaultdict(set)
    equal = recurring(rows, "line")
    for r in rows:
        if r["line"] in equal and r["id"] != equal[r["line"]]:
            drops[r["id"], r["print"]].add(r["pos"])
    rest = [r for r in rows if r["line"] not in equal]
    leaves = collections.defaultdict(list)
    for r in rest:
        leaves[r["leaf"]].append(r)
    found = []
    for leaf, some in leaves.items():
        n = leaf[0]
        if n <= T.LEAST_FIXED or len({r["print"] for r in some}) < 2 or len(some) < enough(n):
            continue
        lines = sorted({r["line"] for r in some})
        root = {x: x for x in lines}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for k, a in enumerate(lines):
            for b in lines[k + 1 :]:
                if sum(x == y for x, y in zip(a, b)) >= n * T.AGREE - 1e-9:
                    root[max(top(a), top(b))] = min(top(a), top(b))
        groups = collections.defaultdict(list)
        for x in lines:
            groups[top(x)].append(x)
        for g, members in groups.items():
            votes = collections.Counter((p, t) for x in members for p, t in enumerate(x))
            fixed = {pt for pt, v in votes.items() if 2 * v >= len(members)}
            ok = {x for x in members if sum((p, t) in fixed for p, t in enumerate(x)) >= n * T.AGREE - 1e-9}
            found += [r | {"grp": (leaf, g)} for r in some if r["line"] in ok]
    alike = recurring(found, "grp")
    for r in found:
        if r["grp"] in alike and r["id"] != alike[r["grp"]]:
            drops[r["id"], r["print"]].add(r["pos"])
    out = []
    for i, text in docs:
        gone = drops.get((2**63 - 1 if i is None else i, text), set())
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        out.append((i, kept, 0 if text is None else text.count("\n") + 1, len(gone)))
    return sorted(out, key=repr)


LOGS = [
    (i, "\n".join([f"own words of document {chr(97 + i)}{chr(98 + i)} alone", f"error {i} {i + 3} {i * i}", f"click here to read {chr(97 + i)} story of the {'big' if i % 2 else 'small'} town", f"served {i} of 12 to {chr(99 + i)} in time for the show", f"{i} {i + 1}", "short line", "  short\tline "]))
    for i in range(14)
]


@pytest.mark.parametrize("table", ["sf0.001", "logs", "odd"])
def test_dropped_lines_are_those_of_all_pairs(spark, table):
    if table == "sf0.001":
        docs = spark.read.parquet(f"{D}/documents.parquet")
    else:
        docs = spark.createDataFrame(LOGS, "doc_id long, text string") if table == "logs" else spark.createDataFrame([(*r, 1) for r in ODD], SCHEMA + ", n_lines long")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in T.drop_templates(docs).collect()), key=repr)
    assert got == brute(rows)
    assert table == "odd" or sum(r[3] for r in got) > 20


def test_what_recurs_nowhere_does_not_travel(spark):
    """Shuffled bytes beside those of the text, where nothing is small enough to be broadcast."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = docs.selectExpr("sum(octet_length(text)) AS s").first().s
    least = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(least)
    sent = lambda: sum(x.totalShuffleWrite() for x in _all(spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    spark.conf.set(least, "-1")
    try:
        start = sent()
        T.drop_templates(docs).write.format("noop").mode("overwrite").save()
        shuffled = sent() - start
    finally:
        spark.conf.set(least, before)
    assert shuffled < 1.15 * size, shuffled / size


def _all(seq):
    return [seq.apply(i) for i in range(seq.size())]
