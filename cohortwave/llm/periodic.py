"""Runs of repeated words: stretches of a text that keep a period.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), at least `least` words and
two periods long, that neither neighbour extends. A word of a run stands in it twice at least, so a word that occurs
once in a segment of the text is in no run of it: such words split the segment, and what they leave is counted anew,
until nothing changes. The segments that survive are scanned by lag: lags from q to 2q - 1 together, by blocks of words on
a grid so fine that a run holds a whole block; equal blocks are extended to both sides, and stretches whose period is
a multiple of a smaller one are left out. A text of n words takes time in proportion to n log n, whatever it repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, as_bytes, map_arrow, mix, read, slices, text_buffer, word_hashes, word_spans

#: Words of the shortest run.
LEAST = 12
#: Rounds of splitting at most. Further ones would only make the scan quicker: it finds the same runs in longer segments.
ROUNDS = 64
_U = np.uint64
_BASE = _U(0xD1342543DE82EF95)


def surviving(ids: np.ndarray, row: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Positions of words that may be in a run, ascending; neighbours in a segment are neighbours in the text. row: the text of each word, ascending."""
    at, segment, done = np.arange(len(ids)), row.astype(np.int64), []
    width = np.int64(ids.max(initial=0) + 1)
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, which, counts = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        often = counts[which] > 1
        lost = np.bincount(segment, ~often) > 0
        settled = ~lost[segment]
        done.append(at[settled])
        rest = often & ~settled
        at, segment = at[rest], segment[rest]
        breaks = np.append(True, (np.diff(at) > 1) | (np.diff(segment) != 0))[: len(at)]
        segment = np.cumsum(breaks) - 1
        long = np.bincount(segment) >= least if len(at) else np.zeros(0, bool)
        at, segment = at[long[segment]], segment[long[segment]]
        _, segment = np.unique(segment, return_inverse=True)
    return np.sort(np.concatenate([*done, at]))


class Blocks:
    """Equality of blocks of words by sums of powers, modulo 2^64."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.power = np.multiply.accumulate(np.append(_U(1), np.full(self.n, _BASE, np.uint64)))
        self.sum = np.append(_U(0), np.cumsum(mix(ids.astype(np.uint64) + _U(1)) * self.power[:-1], dtype=np.uint64))

    def same(self, a: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words from a on equal those `lag` later."""
        return (self.sum[a + size] - self.sum[a]) * self.power[lag] == self.sum[a + lag + size] - self.sum[a + lag]

    def names(self, size: int) -> np.ndarray:
        """One name for each block of `size` words, by its start."""
        inverse = pow(int(_BASE), -1, 1 << 64)
        back = np.multiply.accumulate(np.append(_U(1), np.full(max(self.n - size, 0), inverse, np.uint64)))
        return (self.sum[size:] - self.sum[:-size]) * back

    def extend(self, a: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around a whose words equal those `lag` later; the end is that of the later ones."""
        left, right = np.zeros_like(a), np.zeros_like(a)
        for k in reversed(range(self.n.bit_length())):
            step = 1 << k
            ok = a - left - step >= 0
            ok[ok] = self.same((a - left - step)[ok], lag[ok], np.full(ok.sum(), step))
            left += step * ok
            ok = a + lag + right + step <= self.n
            ok[ok] = self.same((a + right)[ok], lag[ok], np.full(ok.sum(), step))
            right += step * ok
        return a - left, a + lag + right


def primitive(blocks: Blocks, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether no proper part of the lag is a period of the stretch: a smaller period of two lags divides the lag, so a prime part of it is tried at a time."""
    out, rest = np.ones(len(lag), bool), lag.copy()
    prime = np.arange(int(lag.max(initial=1)) + 1)
    for d in range(2, int(len(prime) ** 0.5) + 1):
        if prime[d] == d:
            multiples = prime[d * d :: d]
            prime[d * d :: d] = np.where(multiples == np.arange(d * d, len(prime), d), d, multiples)
    while (rest > 1).any():
        factor = np.where(rest > 1, prime[rest], 1)
        part = lag // factor
        tried = factor > 1
        out[tried] &= ~blocks.same(start[tried], part[tried], (end - start - part)[tried])
        rest //= np.maximum(factor, 1)
    return out


def scan(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of the segments, which stand one after another in ids."""
    found = []
    begin = np.cumsum(sizes) - sizes
    first = 1
    while True:
        some = sizes >= max(least, 2 * first)
        if not some.any():
            break
        # the segments that are long enough, each with a word of its own behind it
        begin, sizes = begin[some], sizes[some]
        many = sizes + 1
        to = np.cumsum(many) - many
        at = np.arange(int(many.sum())) - np.repeat(to, many) + np.repeat(begin, many)
        ends = to + sizes
        at[ends] = 0
        x = ids[at].astype(np.int64)
        x[ends] = -1 - np.arange(len(ends))
        blocks = Blocks(x)
        held = min(max(least - q, q) for q in range(first, 2 * first))
        size = (held + 1) // 2
        names = blocks.names(size)
        filler = mix(np.arange(2 * first, dtype=np.uint64) ^ _U(0xABCDEF0123456789))
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([names, filler])[first:], first)[: len(names) : size]
        grid, lag = np.nonzero(windows == names[::size][: len(windows), None])
        order = np.lexsort((grid, lag))
        grid, lag = grid[order], lag[order] + first
        # blocks that follow each other at one lag belong to one stretch
        new = np.append(True, (np.diff(lag) != 0) | (np.diff(grid) != 1))[: len(grid)]
        start, lag = grid[new] * size, lag[new]
        start, end = blocks.extend(start, lag)
        good = end - start >= np.maximum(least, 2 * lag)
        three = np.unique(np.stack([start[good], end[good], lag[good]], 1), axis=0)
        start, end, lag = three.T
        own = primitive(blocks, start, end, lag)
        start, end, lag = start[own], end[own], lag[own]
        if not true(x, start, end, lag):
            start, end, lag = plain(x, range(first, 2 * first), least)
        found.append((at[start], at[end - 1] + 1, lag))
        first *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


def true(x: np.ndarray, start: np.ndarray, end: np.ndarray, lag: np.ndarray) -> bool:
    """Whether the words of each stretch are equal at its lag, and the stretch can't be longer."""
    size = end - start - lag
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + (1 << 20), "right")))
        n = size[a:b]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[a:b], n)
        if (x[at] != x[at + np.repeat(lag[a:b], n)]).any():
            return False
        a = b
    return not (((start > 0) & (x[start - 1] == x[start - 1 + lag])).any() or (x[end] == x[end - lag]).any())


def plain(x: np.ndarray, lags: range, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same stretches lag by lag, word by word, for words whose blocks' names were seen to clash."""
    found = []
    for q in lags:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], x[q:] == x[:-q], [False]])))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(least, 2 * q) and not any(q % p == 0 and (x[s : e - p] == x[s + p : e]).all() for p in range(1, q // 2 + 1)):
                found.append((s, e, q))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def runs_of(hashes: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end, period of all runs, by row, start, period; positions count from the first word of all rows. first: words before each row, and their total."""
    _, ids = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = surviving(ids, row, least)
    breaks = np.append(True, (np.diff(at) > 1) | (np.diff(row[at]) != 0))[: len(at)]
    cuts = np.flatnonzero(breaks)
    start, end, lag = scan(ids[at], np.diff(np.append(cuts, len(at))), least)
    start, end = at[start], at[end - 1] + 1
    order = np.lexsort((lag, start))
    start, end, lag = start[order], end[order], lag[order]
    return row[start], start, end, lag


def collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given words, one space between those of a row, and the rows' offsets."""
    size = ends - starts
    same = np.append(False, row[1:] == row[:-1])[: len(row)]
    wide = size + same
    to = np.cumsum(wide) - wide
    total = int(wide.sum())
    out = np.full(total, 0x20, np.uint8)
    from_ = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[from_ + np.repeat(to + same, size)] = data[from_ + np.repeat(starts, size)]
    return out, np.append(0, np.cumsum(np.bincount(row, wide, n_rows).astype(np.int64)))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """keep, runs and collapsed of every row: its runs (start, length, period; words count from 0; by start, then period) and its text without what a run repeats.

    A word is left out if a run holds it after the run's first period; one space stands between the others. Null and
    empty texts, and those without a word, have no runs and an empty text. Rows are read one by one: repeated rows give
    repeated rows, order and ties don't matter, other columns are ignored, an empty table gives an empty one. Texts are
    read whole, however long.
    """
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for part in slices(batches):
            data, offsets = text_buffer(part.column(part.num_columns - 1))
            starts, ends, first = word_spans(data, offsets)
            row, a, b, lag = runs_of(word_hashes(data, starts, ends), first, least)
            # how many runs hold a word beyond their first period
            held = np.cumsum(np.bincount(a + lag, minlength=len(starts) + 1) - np.bincount(b, minlength=len(starts) + 1))[: len(starts)]
            kept = np.flatnonzero(held == 0)
            owner = np.searchsorted(first, kept, "right") - 1
            text, cuts = collapsed(data, starts[kept], ends[kept], owner, part.num_rows)
            each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (a - first[row], b - a, lag)], fields=list(one))
            where = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            short = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(text))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(where), each), short], [*keep, "runs", "collapsed"])

    return map_arrow(as_bytes(docs, *keep), run, f"{kinds}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """docs where one text in ten, by the check sum h of doc_id, repeats itself: with g = h / 10, from word a = g mod n on it goes round the next 1 + (n - a) / (3 + g mod 8) words. Texts without words, and those of no doc_id, stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))

    def again(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")

    # the words are an array of one element, so that a lambda's name stands for them and they are found once
    made = F.element_at(F.transform(F.array(w), lambda x: F.when(F.size(x) > 0, again(x)).otherwise(F.col("text"))), 1)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), made).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(looped(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
