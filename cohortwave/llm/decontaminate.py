"""Benchmark decontamination: windows of words of the test items are looked up in the documents.

The normalised windows of all items are a hash set, made by Spark, that is broadcast. A task hashes every window of its
texts, looks it up, compares the words of each hit byte by byte with those of the item, and returns spans of words. The
set is sent in parts of bounded size, one after another where it is larger than one, so what an executor holds doesn't
grow with the benchmark; the documents are then read once for each part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, Tables, as_bytes, map_arrow, read, slices, text_buffer, window_hashes, word_hashes, word_spans

#: Words of a window. Items of fewer are one window of their own length.
WINDOW = 10
#: Bytes of windows that are broadcast at once.
PART_BYTES = 16 << 20
#: Words are runs of digits, letters without case, and characters beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
HITS = "array<struct<start:long,end:long>>"


def _words(part: pa.RecordBatch):
    data, offsets = text_buffer(part.column(part.num_columns - 1))
    starts, ends, first = word_spans(data, offsets, BETWEEN)
    return data, starts, ends, first, word_hashes(data, starts, ends, lower=True)


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """gram (words with a space between), size, hash and the sorted item_ids of every different window of the items (item_id, text).

    Null texts and texts without a word have none. Items that repeat count once; one of null id has its windows, which
    no id stands for.
    """

    def run(batches):
        for part in slices(batches):
            data, starts, ends, first, hashes = _words(part)
            data = _LOWER[data]
            ids = part.column(0).to_pylist()
            rows: list[tuple] = []
            for i in range(part.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                size = min(n, b - a)
                if size:
                    w = [data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])]
                    rows += [(ids[i], size, int(h), b" ".join(w[k : k + size])) for k, h in enumerate(window_hashes(hashes[a:b], size).view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["item_id", "size", "hash", "gram"])

    rows = map_arrow(as_bytes(items.withColumn("item_id", F.col("item_id").cast("string")), "item_id"), run, "item_id string, size long, hash long, gram binary")
    return rows.groupBy("gram", "size", "hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


class WindowSet:
    """Windows by hash, for tasks: the words of each, and the numbers of its items."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: np.uint64(r.hash & 0xFFFFFFFFFFFFFFFF))
        self.hash = np.array([r.hash for r in rows], np.int64).view(np.uint64)
        self.size = np.array([r.size for r in rows], np.int64)
        grams = [bytes(r.gram) + b" " for r in rows]
        self.data = np.frombuffer(b"".join(grams), np.uint8)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(self.ends)]
        self.word = np.cumsum(self.size) - self.size
        self.items = sorted({i for r in rows for i in r.item_ids})
        number = {x: k for k, x in enumerate(self.items)}
        self.many = np.array([len(r.item_ids) for r in rows], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.item = np.array([number[x] for r in rows for x in r.item_ids], np.int64)
        self.sizes = sorted(set(self.size.tolist()))

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows of all occurrences in the rows; data is lower case."""
        at, which = [], []
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size in self.sizes:
            seen = window_hashes(hashes, size)
            low = np.searchsorted(self.hash, seen)
            hit = np.flatnonzero((self.hash[np.minimum(low, len(self.hash) - 1)] == seen) & (row[: len(seen)] == row[size - 1 :][: len(seen)]))
            many = np.searchsorted(self.hash, seen[hit], "right") - low[hit]
            w = np.repeat(low[hit], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            k = np.repeat(hit, many)
            same = self.size[w] == size
            at.append(k[same])
            which.append(w[same])
        at, which = np.concatenate(at), np.concatenate(which)
        # word by word: a word of the text against the one of the window
        size = self.size[which]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        pairs, back = np.unique(np.stack([np.repeat(at, size) + within, np.repeat(self.word[which], size) + within], 1), axis=0, return_inverse=True)
        a, b = pairs.T
        wide = ends[a] - starts[a]
        equal = wide == self.ends[b] - self.starts[b]
        a, b, wide = a[equal], b[equal], wide[equal]
        step = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        off = data[step + np.repeat(starts[a], wide)] != self.data[step + np.repeat(self.starts[b], wide)]
        equal[equal] = np.bincount(np.repeat(np.arange(len(wide)), wide), off, len(wide)) == 0
        good = np.bincount(np.repeat(np.arange(len(size)), size), ~equal[back.ravel()], len(size)) == 0
        return at[good], which[good]


_SETS: dict[str, WindowSet] = {}


def _set_of(rows: list, name: str) -> WindowSet:
    """The set in a Python worker, made once for all its tasks; the last one only."""
    if name not in _SETS:
        _SETS.clear()
        _SETS[name] = WindowSet(rows)
    return _SETS[name]


def _spans(first: np.ndarray, at: np.ndarray, size: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Joined spans of hit words by row: old ones (row, start, end) and new ones."""
    n_words = int(first[-1])
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    if len(old):
        np.add.at(edge, first[old[:, 0]] + old[:, 1], 1)
        np.add.at(edge, first[old[:, 0]] + old[:, 2], -1)
    inside = np.cumsum(edge)[:n_words] > 0
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    opens = inside & np.append(True, ~inside[:-1] | (row[1:] != row[:-1]))[:n_words]
    closes = inside & np.append(~inside[1:] | (row[1:] != row[:-1]), True)[:n_words]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = row[a]
    each = pa.StructArray.from_arrays([pa.array(a - first[owner]), pa.array(b - first[owner])], ["start", "end"])
    return inside, pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(first))).astype(np.int32), each)


def scan(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), n: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """keep, text (null as empty), n_words, hits and item_ids of every row: spans of words (end excluded, joined where they touch) that occurrences of windows cover, and the items whose windows occur.

    Null and empty texts, and those without a word, have no hits, as have all rows where the items have no words. Rows
    are read one by one, so repeated rows give repeated rows and ties don't matter; other columns are ignored.
    """
    with Tables(docs.sparkSession) as tables:
        grams = tables.cut(windows(items, n))
        total = grams.agg(F.sum(F.length("gram") + 32 + 24 * F.size("item_ids"))).first()[0] or 0
        parts = max(1, -(-int(total) // part_bytes))
        kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
        state = as_bytes(docs, *keep).select(*keep, F.lit(None).cast("array<string>").alias("item_ids"), F.lit(None).cast(HITS).alias("hits"), "text")
        for k in range(parts):
            rows = grams.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == k).collect()
            name = hashlib.sha256(repr(sorted((r.hash, bytes(r.gram), *r.item_ids) for r in rows)).encode()).hexdigest()
            state = _pass(state, rows, name, keep, kinds, last=k == parts - 1)
            if k < parts - 1:
                state = tables.cut(state, keep=True)
        return state


def _pass(state: DataFrame, rows: list, name: str, keep: tuple[str, ...], kinds: str, last: bool) -> DataFrame:
    """One part of the windows: state with its hits and items added."""
    sent = state.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        known = _set_of(sent.value, name)
        for part in slices(batches):
            data, starts, ends, first, hashes = _words(part)
            low = _LOWER[data]
            at, which = known.found(low, starts, ends, first, hashes) if len(known.hash) else (np.zeros(0, np.int64),) * 2
            before, held = part.column(part.num_columns - 2), part.column(part.num_columns - 3)
            old = np.array([(i, s["start"], s["end"]) for i, spans in enumerate(before.to_pylist()) for s in spans or ()], np.int64).reshape(-1, 3) if before.null_count < len(before) else np.zeros((0, 3), np.int64)
            _, hits = _spans(first, at, known.size[which] if len(which) else at, old)
            ids: list[set] = [set(x or ()) for x in held.to_pylist()] if held.null_count < len(held) else [set() for _ in range(part.num_rows)]
            if len(at):
                row = np.searchsorted(first, at, "right") - 1
                many = known.many[which]
                item = known.item[np.repeat(known.first[which], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
                for code in np.unique(np.repeat(row, many) * (len(known.items) + 1) + item).tolist():
                    ids[code // (len(known.items) + 1)].add(known.items[code % (len(known.items) + 1)])
            names = pa.array([sorted(x) for x in ids], pa.list_(pa.string()))
            text = part.column(part.num_columns - 1)
            lead = part.columns[: part.num_columns - 3]
            if last:
                yield pa.RecordBatch.from_arrays([*lead, text.cast(pa.string() if pa.types.is_binary(text.type) else pa.large_string()).cast(pa.string()), pa.array(np.diff(first)), hits, names], [*keep, "text", "n_words", "hits", "item_ids"])
            else:
                yield pa.RecordBatch.from_arrays([*lead, names, hits, text], [*keep, "item_ids", "hits", "text"])

    return map_arrow(state, run, f"{kinds}, text string, n_words long, hits {HITS}, item_ids array<string>" if last else f"{kinds}, item_ids array<string>, hits {HITS}, text binary")


def clean(docs: DataFrame, items: DataFrame, how: str = "spans", n: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without what they share with the items: spans of words taken out of the text (`spans`), or whole documents left out (`documents`).

    A span goes with the characters between its words; what stands beside it stays as it is. Texts without hits, null
    ones among them, stay as they are. The columns are those of docs.
    """
    if how not in ("spans", "documents"):
        raise ValueError("how is 'spans' or 'documents'")
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*others).alias("row"), F.col("text").isNull().alias("none"), "text") if others else docs.select(F.lit(0).alias("row"), F.col("text").isNull().alias("none"), "text")
    found = scan(row, items, ("row", "none"), n, part_bytes)
    if how == "documents":
        found = found.where(F.size("hits") == 0).withColumn("short", F.col("text"))
    else:
        found = _without(found)
    text = F.when(~F.col("none"), F.col("short")).alias("text")
    return found.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _without(found: DataFrame) -> DataFrame:
    """row, none and short: the text without its hits."""
    kind = found.schema["row"].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            data, offsets = text_buffer(part.column(part.num_columns - 1))
            starts, ends, first = word_spans(data, offsets, BETWEEN)
            edge = np.zeros(len(data) + 1, np.int64)
            for i, spans in enumerate(part.column(part.num_columns - 2).to_pylist()):
                for s in spans:
                    edge[starts[first[i] + s["start"]]] += 1
                    edge[ends[first[i] + s["end"] - 1]] -= 1
            stays = np.cumsum(edge)[: len(data)] == 0
            cuts = np.append(0, np.cumsum(stays))[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(cuts), pa.py_buffer(data[stays]))], ["row", "none", "short"])

    return map_arrow(found.select("row", "none", "hits", F.col("text").cast("binary").alias("text")), run, f"row {kind}, none boolean, short string")


def op13_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
