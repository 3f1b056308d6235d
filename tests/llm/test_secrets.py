"""Secret scans: base spans against plain matching over the whole table, and planted keys of public formats."""

import hashlib
import re

import numpy as np
import pytest

from cohortwave.llm import secrets

from .common import D, ODD, SCHEMA

LOW = "abcdefghijklmnopqrstuvwxyz"
BASE62 = LOW + LOW.upper() + "0123456789"


def brute(text):
    """The contract's base, word by word: every leftmost match of a kind, then those that are long enough."""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


@pytest.mark.parametrize("table", ["sf0.001", "odd"])
def test_base_spans_of_whole_tables(spark, table):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text") if table == "sf0.001" else spark.createDataFrame([(*r, 1, 2) for r in ODD], SCHEMA + ", spans long, n_hex long")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = secrets.scan(docs, secrets.fit(docs)).collect()
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r.doc_id, "")))):
        assert doc_id == r.doc_id
    by = {i: t for i, t in rows}
    for r in got:
        want = brute(by[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [x for x in spans if not x.startswith("format")] == want and len(spans) == len(r.scores) == len(want) + r.n_format


@pytest.fixture(scope="module")
def planted(spark):
    """Bare keys of several formats, none after a keyword, beside addresses, identifiers, words and dates."""
    r = np.random.default_rng(21)
    draw = lambda letters, n: "".join(r.choice(list(letters), n))
    kinds = {
        "sk-live": lambda: "sk-live-" + draw(BASE62, 24), "github": lambda: "ghp_" + draw(BASE62, 36), "base64": lambda: draw(BASE62 + "+/", 40), "base62": lambda: draw(BASE62, 32), "stripe": lambda: "sk_live_" + draw(BASE62, 24),
        "google": lambda: "AIza" + draw(BASE62 + "_-", 35), "short": lambda: draw(BASE62, 20),
    }
    rows, keys = [], {}
    for i in range(400):
        words = [draw(LOW, int(r.integers(3, 16))) for _ in range(60)]
        words += [".".join(map(str, r.integers(0, 256, 4))), f"192.168.{r.integers(100, 256)}.{r.integers(100, 256)}", draw(LOW, 7) + "_" + draw(LOW, 8), draw(LOW, 6) + "." + draw(LOW, 5) + ".com", f"2023-0{r.integers(1, 10)}-11T10", draw(LOW, 14).upper(), str(r.integers(10**12, 10**14))]
        if i % 4 == 0:
            name = sorted(kinds)[i // 4 % len(kinds)]
            keys[i] = (name, kinds[name]())
            words.insert(int(r.integers(len(words))), keys[i][1])
        rows.append((i, " ".join(words)))
    return rows, keys, spark.createDataFrame(rows, "doc_id long, text string")


def test_bare_keys_of_public_formats_are_found(planted):
    """Recall 0.9 and precision 0.95 at least, though the table has no labelled value at all."""
    rows, keys, docs = planted
    texts, found = dict(rows), set()
    for r in secrets.scan(docs, secrets.fit(docs)).collect():
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            if kind == "format":
                found.add((r.doc_id, texts[r.doc_id][int(a) : int(b)]))
    want = {(i, key) for i, (_, key) in keys.items()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.95 * len(found)


def test_without_examples_and_labels_nothing_passes(planted):
    _, _, docs = planted
    known = secrets.fit(docs, known=False)
    assert known.secret == {} and all(r.n_format == 0 and r.scores == [] for r in secrets.scan(docs, known).collect())


def test_lengths_count(spark):
    """A format of one length scores its own length far above others."""
    made = secrets.Format(["".join(x) for x in np.random.default_rng(3).choice(list(BASE62), (200, 24))], 1.0)
    s = "".join(np.random.default_rng(4).choice(list(BASE62), 24)).translate(secrets.TABLE)
    assert made.likelihood(s) - made.likelihood(s[:23]) > 1.5
    # and the law of lengths adds up to one
    total = sum((1 - secrets.LOOSE) * made.lengths.get(n, 0) / made.n + secrets.LOOSE * 12 / (n * (n + 1)) for n in range(12, 200_000))
    assert abs(total - 1) < 1e-3


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(empty, secrets.fit(empty)).collect() == []


def test_the_sample_is_that_of_the_least_hashes(spark):
    """With few and with many tokens: what a bound leaves out would not have been taken."""
    for n in (30, 4000):
        docs = spark.createDataFrame([(i, "".join(chr(97 + (i * 7 + k * k * 3 + i // 26 * k) % 26) for k in range(14))) for i in range(n)], "doc_id long, text string")
        seen = []
        original = secrets.fit_formats
        secrets.fit_formats = lambda secret, words, examples, held_out, share: seen.append((words, held_out)) or original(secret, words, examples, held_out, share)
        try:
            secrets.fit(docs, words=40, held_out=10)
        finally:
            secrets.fit_formats = original
        from pyspark.sql import functions as F

        want = [r.text for r in docs.select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(50).collect()]
        assert seen[0][0] + seen[0][1] == want


@pytest.fixture(scope="module")
def many(spark):
    """More labelled and ordinary values than any bound of a sample, each in two documents."""
    r = np.random.default_rng(5)
    draw = lambda letters, n: "".join(r.choice(list(letters), n))
    hexes = {draw("0123456789abcdef", 32) for _ in range(4000)}
    words = {draw(LOW, int(r.integers(12, 18))) for _ in range(13000)} | {draw(LOW, 6) + "." + draw(LOW, 6) for _ in range(2000)} | {draw(LOW, 3) + "_" + draw(LOW, 3) + "-" * (i + 8) for i in range(5)}
    words = {w for w in words if not re.search("[0-9a-f]{16}", w)}
    every = sorted(hexes | words)
    docs = spark.createDataFrame([(i, " ".join(every[i % 40 :: 40])) for i in range(80)], "doc_id long, text string")
    return hexes, words, docs


def test_all_values_of_the_table_count(many):
    """Shapes, lengths and what each state sees, against walking every value."""
    hexes, words, docs = many
    made = secrets.fit(docs)
    for side, kind, strings in ((made.secret, "hex", hexes), (made.plain, "word", words)):
        mine = {name: f for (k, name), f in side.items() if k == kind}
        groups = {}
        for x in strings:
            groups.setdefault(secrets.shape(x), []).append(x)
        least = max(secrets.LEAST_STRINGS, len(strings) * secrets.FORMAT_SHARE)
        want = {}
        for name, some in groups.items():
            want.setdefault(name if len(some) >= least else "rest", []).extend(some)
        assert set(mine) == set(want) and sum(f.n for f in mine.values()) == len(strings)
        for name, f in mine.items():
            seen, lengths = {}, {}
            for x in want[name]:
                at, lengths[len(x)] = 0, lengths.get(len(x), 0) + 1
                for c in x.translate(secrets.TABLE):
                    seen[at, c] = seen.get((at, c), 0) + 1
                    at = f.automaton.moves[at].get(c, at)
            assert f.lengths == lengths
            assert {(q, c): n for q, row in enumerate(f.automaton.counts) for c, n in row.items()} == seen
    # nineteen in twenty of a credential's strings are as likely as is usual
    f = made.secret["hex", "32"]
    own = [f.likelihood(x.translate(secrets.TABLE)) for x in hexes]
    assert sum(x >= f.usual for x in own) >= 0.95 * len(own) >= sum(x > f.usual + 0.011 for x in own)
    assert sum(made.score(x) > made.margin for x in words) <= 0.002 * len(words)


def test_states_are_prefixes_that_enough_strings_share(spark):
    """The prefixes that Spark hands on are all whose parent is a state, with counts of both halves, beyond a block of depths too."""
    strings = ["d" * 20 + "x" * (k % 3) for k in range(90)] + ["dl" + "x" * k for k in range(12, 20)]
    rows = spark.createDataFrame([("hex\t1", s, strings.count(s), 1) for s in sorted(set(strings))], "key string, s string, n0 long, n1 long")
    with secrets.Tables(spark) as tables:
        got = secrets.prefixes(tables, rows)["hex\t1"]
    number = {s: (strings.count(s), 1) for s in set(strings)}
    count = lambda p, i: sum(n[i] for s, n in number.items() if s.startswith(p))
    states = {s[:k] for s in number for k in range(secrets.DEPTH) if count(s[:k], 0) >= 20 or count(s[:k], 0) + count(s[:k], 1) >= 20}
    want = {s[: k + 1]: (count(s[: k + 1], 0), count(s[: k + 1], 1), *number.get(s[: k + 1], (0, 0))) for s in number for k in range(len(s)) if s[:k] in states or k == 0}
    assert {p: n for p, n in got.items() if p in want} == want and max(map(len, got)) > 16
    # beyond those only strings that a block began with, which are no states
    assert all(n[0] + n[1] < 20 for p, n in got.items() if p not in want)


def test_the_margin_lets_no_more_pass_than_asked(spark):
    class Half:
        def __init__(self, by):
            self.by = by

        def above(self, s, own):
            return float(len(s) * self.by)

    rows = spark.createDataFrame([("word\ta", "x" * n, 3, 2) for n in range(1, 100)], "key string, s string, n0 long, n1 long")
    scores = sorted([2.0 * n for n in range(1, 100) for _ in range(3)] + [1.0 * n for n in range(1, 100) for _ in range(2)], reverse=True)
    for most in (0, 7, 100, 400, 10_000):
        margin = secrets.margin_of(rows, [Half(1), Half(2)], most)
        assert sum(x > margin for x in scores) <= most
        want = max(secrets.MARGIN, scores[most] if most < len(scores) else 0)
        assert want <= margin <= want * 2 ** (1 / 1024)
