"""Quality rules: a linear-chain CRF marks each line as content or boilerplate; the content share decides retention.

Line features are byte-class counts taken with numpy over whole Arrow batches. The CRF (two labels, emission weights on
the features, a transition matrix) is fitted by maximum likelihood on a bounded sample of labelled documents, whose
lines carry the document's label; decoding is Viterbi, over all lines of all texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, read, slices, text_buffer, window_hashes, word_hashes, word_spans

#: Bounds of the fitting sample: documents of each label, and lines of one document; documents beyond the latter are not in it.
FIT_DOCS, FIT_LINES, FIT_BYTES = 1500, 200, 100_000
#: Least share of content words in a kept text.
CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123), *range(128, 256)],
    "digit": [*range(48, 58)],
    "mark": [*b"#*$%&<>@^~_=+\\{}[]"],
    "pipe": [124],
    "bang": [*b"!?"],
    "stop": [*b".,;:"],
    "space": [32, 9, 11, 12, 13],
}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[_bytes] = _k
WIDTH = len(CLASSES) + 6


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line and how many lines come before each row. An empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    # rows that begin or end where others do keep their own line: both lists have one entry a line, in the same order
    lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(lines)])


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers for each line."""
    counts = np.zeros((len(starts), len(CLASSES) + 1))
    kinds = _CLASS[data]
    for k in range(len(CLASSES) + 1):
        run = np.concatenate([[0], np.cumsum(kinds == k)])
        counts[:, k] = run[ends] - run[starts]
    n = np.maximum(ends - starts, 1)[:, None]
    out = np.empty((len(starts), WIDTH))
    out[:, : len(CLASSES)] = np.minimum(counts[:, : len(CLASSES)] / n * 4, 4)
    letters = counts[:, 0] + counts[:, 1]
    out[:, -6] = np.log1p(words) / 4
    out[:, -5] = words < 3
    out[:, -4] = counts[:, 0] > 0.6 * np.maximum(letters, 1)
    out[:, -3] = counts[:, 3] + counts[:, 4] > 0.04 * n[:, 0]
    out[:, -2] = repeated
    out[:, -1] = 1
    return out


def measure(batch: pa.RecordBatch) -> dict:
    """Base counts of each row, and the lines with their features."""
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    runes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(runes[ends] - runes[starts])])
    symbols = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))])
    hashes = word_hashes(data, starts, ends)
    line_starts, line_ends, line_first = lines_of(data, offsets)
    line_words = np.searchsorted(starts, line_ends) - np.searchsorted(starts, line_starts)
    repeated, repeats = np.zeros(len(line_starts), bool), np.zeros(len(n_words), np.int64)
    raw = data.tobytes()
    for i in range(len(n_words)):
        a, b = first[i], first[i + 1]
        if b - a > 3:
            grams = window_hashes(hashes[a:b], 3)
            _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
            if len(times) < len(grams):
                covered = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(times[back] > 1)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + 3, -1)
                repeats[i] = np.count_nonzero(np.cumsum(covered[:-1]))
        seen: set[bytes] = set()
        if line_first[i + 1] - line_first[i] > 1:
            for k in range(line_first[i], line_first[i + 1]):
                if line_words[k]:
                    line = raw[line_starts[k] : line_ends[k]]
                    repeated[k] = line in seen
                    seen.add(line)
    dup = np.concatenate([[0], np.cumsum(repeated)])
    return {
        "n_words": n_words,
        "word_chars": np.diff(in_words[first]),
        "n_symbols": np.diff(symbols[offsets]),
        "n_dup_lines": np.diff(dup[line_first]),
        "n_repeat_words": repeats,
        "line_first": line_first,
        "line_words": line_words,
        "features": line_features(data, line_starts, line_ends, line_words, repeated),
    }


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels (0 boilerplate, 1 content) of one chain of line scores."""
    if len(scores) == 1:
        return np.array([int(scores[0, 1] > scores[0, 0])])
    a, b = scores[0].tolist()
    (m00, m01), (m10, m11) = moves.tolist()
    came = []
    for s0, s1 in scores[1:].tolist():
        from0, from1 = (a + m00, b + m10), (a + m01, b + m11)
        came.append((from0[1] > from0[0], from1[1] > from1[0]))
        a, b = max(from0) + s0, max(from1) + s1
    label = int(b > a)
    out = [label]
    for step in reversed(came):
        label = int(step[label])
        out.append(label)
    return np.array(out[::-1])


def climb(packs: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, moves: np.ndarray, rounds: int, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on the log likelihood of packs (features n x t x f, line labels n x t); a pack's chains run forward and backward together."""
    total = sum(y.size for _, y in packs)
    speed_w, speed_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(rounds):
        gw, gm = -ridge * weights * total, -ridge * moves * total
        for x, y in packs:
            n, t, _ = x.shape
            emit = x @ weights
            fwd, bwd = np.empty((t, n, 2)), np.zeros((t, n, 2))
            fwd[0] = emit[:, 0]
            for k in range(1, t):
                fwd[k] = np.logaddexp(fwd[k - 1][:, :1] + moves[0], fwd[k - 1][:, 1:] + moves[1]) + emit[:, k]
            for k in range(t - 2, -1, -1):
                ahead = bwd[k + 1] + emit[:, k + 1]
                bwd[k] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
            norm = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
            p = np.exp(fwd + bwd - norm[None, :, None])
            gold = np.stack([1 - y, y], -1).astype(float)
            gw += np.einsum("ntf,ntl->fl", x, gold - p.transpose(1, 0, 2))
            for a in range(2):
                for b in range(2):
                    if t > 1:
                        pair = np.exp(fwd[:-1, :, a] + moves[a, b] + emit[:, 1:, b].T + bwd[1:, :, b] - norm)
                        gm[a, b] += ((y[:, :-1] == a) & (y[:, 1:] == b)).sum() - pair.sum()
        speed_w = 0.9 * speed_w + gw / total
        speed_m = 0.9 * speed_m + gm / total
        weights, moves = weights + rate * speed_w, moves + rate * speed_m
    return weights, moves


def fit_crf(chains: list[np.ndarray], labels: list[int], rounds: int = 80, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features x 2) and moves (2 x 2).

    Lines of good documents are content. A bad document has ordinary lines too, so its lines first carry its label and
    then, in each further pass, what the fitted chain decodes for them. Without both labels all lines are content.
    """
    weights, moves = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    if len(set(labels)) < 2:
        weights[-1, 1] = 1.0
        return weights, moves
    by: dict[int, list[int]] = {}
    for i, c in enumerate(chains):
        by.setdefault(len(c), []).append(i)
    packs = [(np.stack([chains[i] for i in at]), np.array([labels[i] for i in at])) for at in by.values()]
    gold = [(x, np.repeat(y[:, None], x.shape[1], 1)) for x, y in packs]
    for _ in range(passes):
        weights, moves = climb(gold, weights, moves, rounds)
        gold = [(x, np.stack([np.ones(x.shape[1], int) if good else viterbi(s, moves) for good, s in zip(y, x @ weights)])) for x, y in packs]
    return weights, moves


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the fit_docs documents of each label that come first by hash; line features alone reach the driver."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = docs.where((F.octet_length("text") <= FIT_BYTES) & (F.regexp_count("text", F.lit("\n")) < FIT_LINES))
    order = F.struct(F.xxhash64(F.lit("crf"), "doc_id"), "doc_id")
    picked = [usable.select("doc_id").distinct().join(known.where(F.col("quality") == q), "doc_id").orderBy(order).limit(fit_docs) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select("doc_id", "quality")
    texts = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def run(batches):
        for part in slices(batches):
            m = measure(part)
            f = m["features"].astype(np.float32)
            rows = [f[a:b].tobytes() for a, b in zip(m["line_first"][:-1], m["line_first"][1:])]
            yield pa.RecordBatch.from_pydict({"quality": part.column("quality"), "lines": pa.array(rows, pa.binary())})

    got = map_arrow(as_bytes(texts, "quality"), run, "quality int, lines binary").toPandas()
    got = got.sort_values(["quality", "lines"])
    chains = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x in got["lines"]]
    return fit_crf(chains, got["quality"].astype(int).tolist())


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: str = "doc_id", least: float = CONTENT_SHARE) -> DataFrame:
    """Counts and verdict of every row, beside the column `keep`.

    Null and empty texts have no words, fail the base rules and have content share 0. Ties of the Viterbi path go to
    boilerplate. Repeated rows are judged alike. Other columns are ignored.
    """
    weights, moves = model
    kind = docs.schema[keep].dataType

    def run(batches):
        for part in slices(batches):
            m = measure(part)
            scores = m["features"] @ weights
            first, n = m["line_first"], m["n_words"]
            share = np.zeros(len(n))
            for i in range(len(n)):
                if n[i]:
                    a, b = first[i], first[i + 1]
                    share[i] = (viterbi(scores[a:b], moves) * m["line_words"][a:b]).sum() / n[i]
            failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
            cols = {keep: part.column(keep)} | {k: pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            yield pa.RecordBatch.from_pydict(cols | {"content_share": pa.array(share), "base_failed": pa.array(failed), "kept": pa.array(~failed & (share >= least))})

    return map_arrow(as_bytes(docs, keep), run, f"{keep} {kind.simpleString()}, {OUT}")


def op8_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    model = fit(docs, read(spark, sf_dir, "labels"))
    weights, moves = model
    fields = docs.schema

    def run(batches):
        for batch in batches:
            column = batch.schema.get_field_index("text")
            raw = batch.set_column(column, "text", batch.column(column).fill_null("").cast(pa.binary() if pa.types.is_string(batch.column(column).type) else pa.large_binary()))
            at = 0
            for part in slices([raw]):
                m = measure(part)
                scores, first, n = m["features"] @ weights, m["line_first"], m["n_words"]
                failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
                keep = np.zeros(len(n), bool)
                for i in np.flatnonzero(~failed):
                    a, b = first[i], first[i + 1]
                    keep[i] = (viterbi(scores[a:b], moves) * m["line_words"][a:b]).sum() >= CONTENT_SHARE * n[i]
                yield batch.slice(at, part.num_rows).filter(pa.array(keep))
                at += part.num_rows

    return map_arrow(docs, run, fields)
