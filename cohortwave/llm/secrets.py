"""Secret scans: formats of credentials learned as probabilistic automata, by merging prefix-tree states.

Labelled credentials are the values that the base patterns find, and examples of well-known formats made by rule; tokens
of the same length that no pattern touches are the ordinary class, with examples of addresses and numbers. Strings of
one shape (where their signs stand, and how long they are where they have none) make a format. A format's strings, as
sequences of character classes, are a prefix tree of counts; states whose next-symbol and end frequencies differ by no
more than a Hoeffding bound, in all their descendants too, are merged. Merged states forget how long a string is, so
a format has a law of lengths besides. A candidate's score is the log likelihood ratio of the whole token: its likeliest
format among the credentials against the likeliest ordinary one. How high it must be follows from ordinary tokens that
were held out: no more than a given share of them may pass.

All values of the table count. Spark counts the strings of each sequence of classes, and their prefixes as far as a given
share of a format's strings goes, so that the automata are of bounded size whatever the table's; what their states
see is then counted over all strings. Each half of the ordinary tokens is held out from a fit to the other half.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, as_bytes, map_arrow, read

#: The base patterns, in the order in which ties of a start are listed, and the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ASSIGN_LEAST = 12

#: What a labelled kind and the ordinary class weigh at most beside examples, and from how many ordinary tokens on they set the margin.
#: Where a caller bounds the fit, the bounds of what it does not say: strings of each kind, ordinary ones, and ordinary ones held out.
FIT_STRINGS, FIT_ORDINARY, HELD_OUT = 3000, 12000, 12000
#: Confidence of the Hoeffding bound, least count of a state that is tested, strings that make a format of its own.
ALPHA, LEAST_COUNT, LEAST_STRINGS = 0.05, 20, 8
#: In whole tables: share of a kind's strings that makes a format of its own, share of a format's strings that makes a state, depth of a state at most, depths that are counted at once.
FORMAT_SHARE, STATE_SHARE, DEPTH, BLOCK = 1 / 1500, 1 / 200, 64, 8
#: Share of the held-out ordinary tokens that may pass, and the least score of what passes, in nats.
FALSE_POSITIVES, MARGIN = 0.001, 5.0
#: Share of the law of lengths that is spread over lengths not seen.
LOOSE = 0.05

SIGNS = "+/_.=-"
SYMBOL = {**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEF"}, **{c: "L" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
TABLE = str.maketrans(SYMBOL)
ALPHABET = 5 + len(SIGNS)

#: Public formats of keys as (what they begin with, alphabet, lengths of the rest).
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
BASE62 = UPPER + LOWER + DIGITS
FORMATS = [
    ("AKIA", UPPER + DIGITS, (16,)), ("ASIA", UPPER + DIGITS, (16,)), ("ghp_", BASE62, (36,)), ("gho_", BASE62, (36,)), ("github_pat_", BASE62 + "_", (82,)), ("glpat-", BASE62 + "_-", (20,)),
    ("sk-", BASE62, (32, 48)), ("sk-live-", BASE62, (16, 24, 32)), ("sk_live_", BASE62, (24, 32)), ("sk_test_", BASE62, (24, 32)), ("pk_live_", BASE62, (24, 32)), ("rk_live_", BASE62, (24,)), ("xoxb-", DIGITS + "-", (24,)), ("AIza", BASE62 + "_-", (35,)),
    ("npm_", BASE62, (36,)), ("hf_", BASE62, (34,)), ("SG.", BASE62 + "_-", (66,)), ("", BASE62 + "+/", (40, 44, 64)), ("", BASE62, (20, 24, 32, 40)), ("eyJ", BASE62 + "_-", (33, 60)),
]
#: Examples of each format and length, and of each ordinary one.
EXAMPLES = 120


def _drawn(seed: str, alphabet: str, n: int) -> str:
    """n characters that follow from the seed."""
    out, k = "", 0
    while len(out) < n:
        out += "".join(alphabet[b % len(alphabet)] for b in hashlib.sha256(f"{seed}:{k}".encode()).digest())
        k += 1
    return out[:n]


def known_formats() -> dict[str, list[str]]:
    """Examples of the public formats, and of what is ordinary though it looks odd: addresses, dates, long numbers and identifiers."""
    keys = {f"known:{head}:{n}:{len(alphabet)}": [head + _drawn(f"{head}{n}{len(alphabet)}{i}", alphabet, n) for i in range(EXAMPLES)] for head, alphabet, lengths in FORMATS for n in lengths}
    number = lambda seed, most: int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16) % most
    plain = [".".join(str(number(f"ip{i}.{k}", 256)) for k in range(4)) for i in range(EXAMPLES)]
    plain += [f"{number(f'a{i}', 900) + 100}-{number(f'b{i}', 900) + 100}-{number(f'c{i}', 9000) + 1000}" for i in range(EXAMPLES)]
    plain += [f"{number(f'y{i}', 100) + 1950}-{number(f'm{i}', 12) + 1:02d}-{number(f'd{i}', 28) + 1:02d}T{number(f'h{i}', 24):02d}" for i in range(EXAMPLES)]
    plain += [_drawn(f"n{i}", DIGITS, 12 + i % 8) for i in range(EXAMPLES)]
    plain += ["-".join(_drawn(f"u{i}{n}", "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)) for i in range(EXAMPLES)]
    return keys | {"word": [x for x in plain if CANDIDATE.fullmatch(x)]}


class Automaton:
    """A prefix-tree acceptor whose compatible states are merged; state 0 is the root."""

    def __init__(self, strings: list[str]):
        self.moves: list[dict[str, int]] = [{}]
        self.counts: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        for s in strings:
            at = 0
            for c in s.translate(TABLE):
                self.counts[at][c] = self.counts[at].get(c, 0) + 1
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.counts.append({})
                    self.ends.append(0)
                at = self.moves[at][c]
            self.ends[at] += 1
        self._merge()
        self._weigh()

    @classmethod
    def of_prefixes(cls, n: int, tree: dict[str, tuple[int, int]], need: float) -> Automaton:
        """States from how many of n strings (in classes) begin with a prefix and how many are it.

        What fewer than `need` begin with is no state, as if never tested: the root follows. Its counts are set by `recount`.
        """
        out = cls([])
        at = {"": 0}
        for prefix, (total, ends) in sorted(tree.items(), key=lambda x: (len(x[0]), x[0])):
            if (above := at.get(prefix[:-1])) is None:
                continue
            out.counts[above][prefix[-1]] = total
            out.moves[above][prefix[-1]] = len(out.moves)
            if total >= need:
                at[prefix] = len(out.moves)
            out.moves.append({})
            out.counts.append({})
            out.ends.append(ends if total >= need else 0)
        out.ends[0] = max(0, n - sum(out.counts[0].values()))
        out._merge()
        return out

    def recount(self, seen: dict[int, dict[str, int]]) -> None:
        """Set what each state sees; "" is an end."""
        self.counts = [{c: n for c, n in seen.get(q, {}).items() if c} for q in range(len(self.moves))]
        self.ends = [seen.get(q, {}).get("", 0) for q in range(len(self.moves))]
        self._weigh()

    def _weigh(self) -> None:
        self.log = [{c: math.log((n + 0.2) / (self.total(q) + 0.2 * (ALPHABET + 1))) for c, n in self.counts[q].items()} for q in range(len(self.moves))]
        self.unseen = [math.log(0.2 / (self.total(q) + 0.2 * (ALPHABET + 1))) for q in range(len(self.moves))]

    def total(self, q: int) -> int:
        return sum(self.counts[q].values()) + self.ends[q]

    def _alike(self, a: int, b: int) -> bool:
        """No tested frequency of the two states, or of states that the same string leads to, differs beyond the bound."""
        open_ = [(a, b)]
        while open_:
            p, q = open_.pop()
            n, m = self.total(p), self.total(q)
            if n < LEAST_COUNT or m < LEAST_COUNT:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for c in self.counts[p].keys() | self.counts[q].keys():
                if abs(self.counts[p].get(c, 0) / n - self.counts[q].get(c, 0) / m) > bound:
                    return False
                if c in self.moves[p] and c in self.moves[q]:
                    open_.append((self.moves[p][c], self.moves[q][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        open_ = [(a, b)]
        while open_:
            p, q = open_.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.counts[q].items():
                self.counts[p][c] = self.counts[p].get(c, 0) + n
                if c in self.moves[p]:
                    open_.append((self.moves[p][c], self.moves[q][c]))
                else:
                    self.moves[p][c] = self.moves[q][c]

    def _merge(self) -> None:
        """Red states are final; a blue one, a child of a red one, merges with the first red state that it is like, or turns red."""
        red, queue = [0], [(0, c) for c in sorted(self.moves[0])]
        while queue:
            queue.sort(key=lambda x: (-self.counts[x[0]].get(x[1], 0), x))
            p, c = queue.pop(0)
            blue = self.moves[p].get(c)
            if blue is None or blue in red:
                continue
            home = next((r for r in red if self._alike(r, blue)), None)
            if home is None:
                red.append(blue)
                queue += [(blue, s) for s in sorted(self.moves[blue])]
            else:
                self.moves[p][c] = home
                self._fold(home, blue)
                queue += [(r, s) for r in red for s in sorted(self.moves[r]) if self.moves[r][s] not in red]
                queue = list(dict.fromkeys(queue))
        final = set(red)
        self.moves = [m if q in final else {} for q, m in enumerate(self.moves)]

    def likelihood(self, s: str) -> float:
        """Log probability of s, in classes, whose length is given."""
        at, out = 0, 0.0
        for c in s:
            out += self.log[at].get(c, self.unseen[at])
            at = self.moves[at].get(c, at)
        return out


class Format:
    """An automaton, the law of its strings' lengths, and its share among the formats of its side."""

    def __init__(self, strings: list[str], share: float):
        self.automaton, self.share = Automaton(strings), math.log(share)
        self.lengths: dict[int, int] = {}
        for s in strings:
            self.lengths[len(s)] = self.lengths.get(len(s), 0) + 1
        self.n = len(strings)
        own = sorted(self.likelihood(s.translate(TABLE)) for s in strings)
        self.usual = own[len(own) // 20]  # nineteen in twenty of its strings are at least as likely

    @classmethod
    def counted(cls, automaton: Automaton, share: float, lengths: dict[int, int]) -> Format:
        """A format of which Spark has counted the strings; `usual` is set later, of credentials."""
        out = cls.__new__(cls)
        out.automaton, out.share, out.lengths, out.n, out.usual = automaton, math.log(share), lengths, sum(lengths.values()), math.inf
        return out

    def most(self, n: int) -> float:
        """Log probability of a string of n classes at most."""
        spread = LOOSE * 12 / (n * (n + 1))  # adds up to LOOSE over all lengths from 12 on
        return self.share + math.log((1 - LOOSE) * self.lengths.get(n, 0) / self.n + spread)

    def likelihood(self, s: str) -> float:
        """Log probability that the format makes s, in classes."""
        return self.most(len(s)) + self.automaton.likelihood(s)


def shape(s: str) -> str:
    """What strings of one format have in common: capitals or digits only, where the signs stand, or the length of a string without any."""
    if s.isalpha() and s.isupper():
        return "capitals"
    if s.isdigit():
        return "digits"
    bare = re.sub(r"[^+/_.=-]+", "w", s)
    return bare if "w" != bare and len(bare) <= 12 else f"{len(s)}" if bare == "w" else "many"


def grouped(samples: dict[str, list[str]]) -> dict[tuple[str, str], list[str]]:
    """Strings by kind and shape, where a shape has enough; the rest of a kind is one group, and examples of a public format are."""
    groups: dict[tuple[str, str], list[str]] = {}
    for kind, strings in samples.items():
        by: dict[str, list[str]] = {}
        for s in strings:
            by.setdefault("" if kind.startswith("known:") else shape(s), []).append(s)
        for name, some in by.items():
            groups.setdefault((kind, name if len(some) >= LEAST_STRINGS else "rest"), []).extend(some)
    return groups


def formats(groups: dict[tuple[str, str], list[str]]) -> dict[tuple[str, str], Format]:
    """A format for each group of one side."""
    total = sum(map(len, groups.values()))
    return {key: Format(some, len(some) / total) for key, some in sorted(groups.items()) if some}


class Formats:
    """Both sides' formats and the score above which a token passes."""

    def __init__(self, secret: dict[tuple[str, str], Format], plain: dict[tuple[str, str], Format], margin: float = MARGIN):
        self.secret, self.plain, self.margin = secret, plain, margin

    def score(self, token: str, without: tuple[str, str] | None = None) -> float:
        """Log likelihood ratio of the whole token; `without` leaves one ordinary format out."""
        return self.score_of(token.translate(TABLE), without)

    def score_of(self, s: str, without: tuple[str, str] | None = None) -> float:
        """The score of a token in classes."""
        return max(f.likelihood(s) for f in self.secret.values()) - max((f.likelihood(s) for k, f in self.plain.items() if k != without), default=0.0)

    def above(self, s: str, own: tuple[str, str]) -> float:
        """The score of a token in classes where it is above MARGIN, else MARGIN; most are seen to be below by their own ordinary format."""
        low = self.plain[own].likelihood(s) + MARGIN if own in self.plain else -math.inf
        best = max((f.likelihood(s) for f in self.secret.values() if f.most(len(s)) > low), default=-math.inf)
        return MARGIN if best <= low else max(MARGIN, best - max(f.likelihood(s) for f in self.plain.values()))

    def alike(self, token: str, group: tuple[str, str]) -> bool:
        """Whether an ordinary token is as usual for a credential's format as that one's own strings, and no other ordinary format explains it."""
        return self.alike_of(token.translate(TABLE), group)

    def alike_of(self, s: str, group: tuple[str, str]) -> bool:
        """The same of a token in classes."""
        return any(len(s) in f.lengths and f.likelihood(s) >= f.usual for f in self.secret.values()) and self.score_of(s, group) > MARGIN


def fit_formats(secret: dict[str, list[str]], words: list[str], examples: list[str], held_out: list[str], false_positives: float = FALSE_POSITIVES) -> Formats:
    """Formats of both sides from samples, and the margin from ordinary tokens that were held out.

    Tables hold credentials that no pattern labels, so ordinary tokens are looked through first: where more than half of a group are
    as usual for a credential's format as its own strings, and unlike all other ordinary ones, those tokens are left out, of the held-out
    tokens too.
    """
    groups = grouped({"word": words, "example": examples})
    made = Formats(formats(grouped(secret)), formats(groups))
    if not made.secret or not made.plain:
        return Formats({}, {})
    odd = set()
    for key in [k for k in groups if k[0] == "word"]:
        same = {x for x in groups[key] if made.alike(x, key)}
        if 2 * len(same) > len(groups[key]):
            odd.add(key)
            groups[key] = [x for x in groups[key] if x not in same]
    of = lambda x: ("word", shape(x)) if ("word", shape(x)) in groups else ("word", "rest")
    held_out = [x for x in held_out if of(x) not in odd or not made.alike(x, of(x))]
    made = Formats(made.secret, formats(groups))
    scores = sorted(map(made.score, held_out), reverse=True)
    if scores:
        made.margin = max(MARGIN, scores[min(int(false_positives * len(scores)), len(scores) - 1)])
    return made


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed. Matches are leftmost and do not overlap within a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def free(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidate tokens that no span touches; one pass over both, spans in the order of their starts."""
    out, k, reach = [], 0, -1
    for m in CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            out.append(m.span())
    return out


def values(text: str) -> list[tuple[str, str]]:
    """(class, string): what the base patterns find, and candidate tokens that they do not touch."""
    spans = base_spans(text)
    out = []
    for a, b, kind in spans:
        s = text[a:b]
        out.append((kind, ASSIGN.match(s)[2] if kind == "assign" else s))
    out += [("word", text[a:b]) for a, b in free(text, spans)]
    return out


def shape_of(value: Column) -> Column:
    """shape() as a column, of values that patterns match."""
    bare = F.regexp_replace(value, r"[^+/_.=-]+", "w")
    by_sign = F.when(bare == "w", F.length(value).cast("string")).when(F.length(bare) <= 12, bare).otherwise("many")
    return F.when(value.rlike("^[A-Z]+$"), "capitals").when(value.rlike("^[0-9]+$"), "digits").otherwise(by_sign)


def classes(tables: Tables, values: DataFrame) -> DataFrame:
    """key, s, n0, n1: how many of the values (kind, value; different) of a format are s in classes, by halves drawn by hash.

    A key is kind and shape, where a shape has enough of the kind's strings, else kind and `rest`.
    """
    half = F.pmod(F.xxhash64("value", F.lit(1)), F.lit(2))
    letters = "".join(SYMBOL)
    named = values.select("kind", shape_of(F.col("value")).alias("shape"), F.translate("value", letters, "".join(SYMBOL.values())).alias("s"), half.alias("half"))
    rows = tables.cut(named.groupBy("kind", "shape", "s").agg(F.sum(1 - F.col("half")).alias("n0"), F.sum("half").alias("n1")))
    shapes = rows.groupBy("kind", "shape").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"))
    total = F.broadcast(rows.groupBy("kind").agg(F.sum(F.col("n0") + F.col("n1")).alias("total")))
    own = shapes.join(total, "kind").where((F.col("n") >= LEAST_STRINGS) & (F.col("n") >= F.col("total") * FORMAT_SHARE)).select("kind", "shape", F.col("shape").alias("own"))
    keyed = rows.join(F.broadcast(own), ["kind", "shape"], "left").withColumn("key", F.concat_ws("\t", "kind", F.coalesce("own", F.lit("rest"))))
    return tables.cut(keyed.select("key", "s", "n0", "n1"))


def _needed(n: int) -> float:
    """How many of n strings make a state."""
    return max(LEAST_COUNT, n * STATE_SHARE)


def prefixes(tables: Tables, rows: DataFrame) -> dict[str, dict[str, tuple[int, int, int, int]]]:
    """For each key the prefixes whose parents may be states: how many strings of either half begin with them, and how many are they."""
    need = lambda n: F.greatest(F.lit(float(LEAST_COUNT)), n * STATE_SHARE)
    a, b = F.sum("n0"), F.sum("n1")
    needs = F.broadcast(tables.cut(rows.groupBy("key").agg(need(a).alias("need0"), need(b).alias("need1"), need(a + b).alias("need"))))
    out: dict[str, dict[str, tuple[int, int, int, int]]] = {}
    for low in range(1, DEPTH + 1, BLOCK):
        high = low + BLOCK - 1
        n = F.length("s")
        cuts = rows.where(n >= low).select("key", "s", "n0", "n1", F.explode(F.sequence(F.lit(low), F.least(n, F.lit(high)))).alias("k"))
        ends = lambda c: F.sum(F.when(F.length("s") == F.col("k"), F.col(c)).otherwise(0))
        counts = tables.cut(cuts.groupBy("key", F.substring("s", F.lit(1), F.col("k")).alias("prefix")).agg(a.alias("n0"), b.alias("n1"), ends("n0").alias("e0"), ends("n1").alias("e1")))
        often = counts.join(needs, "key").where((F.col("n0") >= F.col("need0")) | (F.col("n1") >= F.col("need1")) | (F.col("n0") + F.col("n1") >= F.col("need")))
        often = tables.cut(often.select("key", "prefix"))
        parents = F.broadcast(often.select("key", F.col("prefix").alias("parent"), F.lit(True).alias("kept")))
        children = counts.withColumn("parent", F.substring("prefix", F.lit(1), F.length("prefix") - 1)).join(parents, ["key", "parent"], "left")
        for r in children.where((F.length("prefix") == low) | F.col("kept")).select("key", "prefix", "n0", "n1", "e0", "e1").collect():
            out.setdefault(r[0], {})[r[1]] = tuple(r)[2:]
        # only strings whose prefix may be a state are looked at further
        deep = often.where(F.length("prefix") == high)
        if deep.isEmpty():
            break
        rows = rows.join(F.broadcast(deep.withColumnRenamed("prefix", "head")), (rows["key"] == deep["key"]) & (F.substring("s", 1, high) == F.col("head")), "left_semi")
    return out


def learn(tables: Tables, rows: DataFrame, parts: tuple[int, ...]) -> list[dict[str, tuple[Automaton, dict[int, int]]]]:
    """For each of parts (0 and 1: a half of the strings, 2: all) the automaton and the lengths of each key that has any; rows as of `classes`."""
    part = lambda a, b, w: (a, b, a + b)[w]
    lengths: list[dict[str, dict[int, int]]] = [{} for _ in parts]
    for key, n, a, b in rows.groupBy("key", F.length("s").alias("n")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        for i, w in enumerate(parts):
            if part(a, b, w):
                lengths[i].setdefault(key, {})[n] = part(a, b, w)
    trees = prefixes(tables, rows)
    automata = []
    for i, w in enumerate(parts):
        made = {}
        for key, some in lengths[i].items():
            tree = {p: (part(x[0], x[1], w), part(x[2], x[3], w)) for p, x in trees[key].items() if part(x[0], x[1], w)}
            n = sum(some.values())
            made[key] = Automaton.of_prefixes(n, tree, _needed(n))
        automata.append(made)
    moves = [(w, {key: x.moves for key, x in made.items()}) for w, made in zip(parts, automata)]

    def run(batches):
        seen: dict[tuple[str, int, int], dict[str, int]] = {}
        for batch in batches:
            for key, s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (w, by) in enumerate(moves):
                    if n := part(a, b, w):
                        steps, at = by[key], 0
                        for c in s:
                            row = seen.setdefault((key, i, at), {})
                            row[c] = row.get(c, 0) + n
                            at = steps[at].get(c, at)
                        row = seen.setdefault((key, i, at), {})
                        row[""] = row.get("", 0) + n
        flat = [(*at, c, n) for at, row in seen.items() for c, n in row.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*flat)) or [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["key", "i", "q", "c", "n"])

    seen: dict[tuple[int, str], dict[int, dict[str, int]]] = {}
    for key, i, q, c, n in map_arrow(rows.select("key", "s", "n0", "n1"), run, "key string, i long, q long, c string, n long").groupBy("key", "i", "q", "c").agg(F.sum("n")).collect():
        seen.setdefault((i, key), {}).setdefault(q, {})[c] = n
    for i, made in enumerate(automata):
        for key, x in made.items():
            x.recount(seen[i, key])
    return [{key: (x, lengths[i][key]) for key, x in made.items()} for i, made in enumerate(automata)]


def _side(learned: dict[str, tuple[Automaton, dict[int, int]]], weight: int, examples: dict[tuple[str, str], list[str]]) -> dict[tuple[str, str], Format]:
    """Formats of one side: what a table's kind weighs, `weight` at most, goes to its formats by their strings; examples weigh their number."""
    sizes: dict[str, int] = {}
    for key, (_, lengths) in learned.items():
        kind = key.split("\t")[0]
        sizes[kind] = sizes.get(kind, 0) + sum(lengths.values())
    total = sum(min(n, weight) for n in sizes.values()) + sum(map(len, examples.values()))
    out = {}
    for key, (automaton, lengths) in sorted(learned.items()):
        kind, name = key.split("\t")
        out[kind, name] = Format.counted(automaton, sum(lengths.values()) / sizes[kind] * min(sizes[kind], weight) / total, lengths)
    return out | {key: Format(some, len(some) / total) for key, some in sorted(examples.items())}


def margin_of(rows: DataFrame, halves: list[Formats], most: int) -> float:
    """The least margin, MARGIN at least, that no more than `most` tokens are above, each scored by the formats of the half it is not in.

    Scores count in steps, 1,024 to a power of two; the margin is the upper end of one.
    """

    def high(batches):
        found: dict[int, int] = {}
        for batch in batches:
            for key, s, *counts in zip(*(c.to_pylist() for c in batch.columns)):
                for half, n in enumerate(counts):
                    if n and (x := halves[1 - half].above(s, tuple(key.split("\t")))) > MARGIN:
                        step = math.ceil(1024 * math.log2(x))
                        found[step] = found.get(step, 0) + n
        yield pa.RecordBatch.from_pydict({"step": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    above = 0
    for step, n in map_arrow(rows.select("key", "s", "n0", "n1"), high, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect():
        above += n
        if above > most:
            return 2 ** (step / 1024)
    return MARGIN


def fit_whole(tables: Tables, values: DataFrame, false_positives: float, known: bool) -> Formats:
    """The formats and the margin from all values (kind, value; different, no ordinary one equal to a labelled one)."""
    rows = classes(tables, values)
    ordinary = F.col("key").startswith("word\t")
    examples = grouped(known_formats()) if known else {}
    plain_examples = {("example", name): some for (kind, name), some in examples.items() if kind == "word"}
    secret_rows, words = rows.where(~ordinary), rows.where(ordinary)
    secret = _side(learn(tables, secret_rows, (2,))[0], FIT_STRINGS, {k: some for k, some in examples.items() if k[0] != "word"})

    def likely(batches):
        for batch in batches:
            key, s, a, b = (c.to_pylist() for c in batch.columns)
            # rounded down, so that nineteen in twenty are at least as likely
            found = [math.floor(100 * secret[tuple(k.split("\t"))].likelihood(x)) / 100 for k, x in zip(key, s)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "n": pa.array([x + y for x, y in zip(a, b)], pa.int64()), "p": pa.array(found, pa.float64())})

    for key, usual in map_arrow(secret_rows, likely, "key string, n long, p double").groupBy("key").agg(F.percentile("p", 0.05, F.col("n"))).collect():
        secret[tuple(key.split("\t"))].usual = usual

    def plain(of: list) -> list[Formats]:
        return [Formats(secret, _side(x, FIT_ORDINARY, plain_examples)) for x in of]

    made, *halves = plain(learn(tables, words, (2, 0, 1)))
    if not made.secret or not made.plain:
        return Formats({}, {})

    def looked(batches):
        for batch in batches:
            key, s = (batch.column(i).to_pylist() for i in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([made.alike_of(x, tuple(k.split("\t"))) for k, x in zip(key, s)], pa.bool_())], ["key", "s", "n0", "n1", "same"])

    first = made
    marked = tables.cut(map_arrow(words, looked, "key string, s string, n0 long, n1 long, same boolean"))
    n = F.col("n0") + F.col("n1")
    odd = tables.cut(marked.groupBy("key").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("same"), n).otherwise(0)).alias("k")).where("2 * k > n").select("key"))
    if not odd.isEmpty():
        left = marked.join(F.broadcast(odd.withColumn("odd", F.lit(True))), "key", "left").where(F.col("odd").isNull() | ~F.col("same"))
        words = tables.cut(left.select("key", "s", "n0", "n1"))
        made, *halves = plain(learn(tables, words, (2, 0, 1)))
        made = made if made.plain else first
    held_out = words.agg(F.sum(n)).first()[0] or 0
    if held_out < HELD_OUT:
        return made

    made.margin = margin_of(words, halves, int(false_positives * held_out))
    return made


def fit(docs: DataFrame, strings: int | None = None, words: int | None = None, held_out: int | None = None, false_positives: float = FALSE_POSITIVES, known: bool = True) -> Formats:
    """The formats of both sides and the margin, from all distinct values of the table.

    Ordinary tokens are those that equal no labelled value. The margin is the least score, MARGIN at least, that no more than
    the share `false_positives` of the ordinary tokens exceeds, each scored by formats fitted to the half it is not in; fewer than
    HELD_OUT tokens tell no such share. known adds examples of public formats; without them and
    without labelled values there are no formats, and nothing passes. Null and empty texts have no values; repeated rows
    and values count once; texts and values are read whole.

    With strings, words or held_out the fit is bounded: to the `strings` values of each kind that come first by hash, `words` ordinary
    tokens, and the next `held_out` ordinary ones for the margin.
    """

    def run(batches):
        for batch in batches:
            kept = dict.fromkeys(v for t in batch.column(0) for v in values(t.as_py().decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in kept], pa.string()), "value": pa.array([v for _, v in kept], pa.string())})

    with Tables(docs.sparkSession) as tables:
        found = tables.cut(map_arrow(as_bytes(docs), run, "kind string, value string").distinct())
        labelled = found.where("kind <> 'word'").select(F.xxhash64("value").alias("h")).distinct()
        others = found.where("kind = 'word'").withColumn("h", F.xxhash64("value")).join(labelled, "h", "left_anti").select("kind", "value")
        if strings is None and words is None and held_out is None:
            return fit_whole(tables, found.where("kind <> 'word'").unionByName(others), false_positives, known)
        strings, words, held_out = (y if x is None else x for x, y in ((strings, FIT_STRINGS), (words, FIT_ORDINARY), (held_out, HELD_OUT)))

        def first(rows: DataFrame, n: int) -> list[str]:
            """The n values of the least hashes. Where there are many, those below a bound that some four times as many are below; else each task would hand on n of its own."""
            order, total = F.xxhash64("value"), rows.count()
            if total > 8 * n:
                low = rows.where(order < int(-(2**63) + 2**64 * 4 * n // total))
                rows = low if low.count() >= n else rows
            return rows.orderBy(order, "value").limit(n).toPandas()["value"].tolist()

        secret = {k: some for k in KINDS if (some := first(found.where(F.col("kind") == k), strings))}
        ordinary = first(others, words + held_out)
    examples = known_formats() if known else {"word": []}
    return fit_formats(secret | {k: v for k, v in examples.items() if k != "word"}, ordinary[:words], examples["word"], ordinary[words:], false_positives)


def scan(docs: DataFrame, known: Formats) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, scores of every row.

    A candidate that no base span touches is a span of kind `format` when its score is above the margin. scores holds
    the score of every span, in the order of spans: of an assignment that of its value; empty without formats. Null texts
    count as empty: no spans, the digest of an empty string. Repeated rows give the same. Other columns are ignored.
    """
    able = bool(known.secret and known.plain)

    def run(batches):
        memo: dict[str, float] = {}

        def score(token: str) -> float:
            s = token.translate(TABLE)
            if s not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[s] = known.score(token)
            return memo[s]

        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py().decode("utf-8", "replace")
                base = base_spans(text)
                extra = [(a, b, "format") for a, b in free(text, base) if score(text[a:b]) > known.margin] if able else []
                said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
                every = sorted(base + extra, key=lambda x: (x[0], (*KINDS, "format").index(x[2]), x[1])) if extra else base
                n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                scores = [score(ASSIGN.match(text[a:b])[2] if k == "assign" else text[a:b]) for a, b, k in every] if able else []
                rows.append((*n, hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k in every), len(extra), scores))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "scores"])

    return map_arrow(as_bytes(docs, "doc_id"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, scores array<double>")


def op4_format_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).drop("scores")
