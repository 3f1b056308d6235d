"""Alignment of two tokenizers by interval coalescing.

Both cut the same bytes, so a token is an interval of bytes. The intervals of a batch's texts are laid end to end and
sorted by start together; the running maximum of their ends is accumulated, and where a start reaches it a group of
tokens begins that no token of either side crosses. Within a group, each token of A is expanded over those of B that
overlap it. How many documents link two ids is counted by Spark over the whole corpus, from each document's own pairs.

The commonest pairs, a bounded number, are broadcast to the second reading; what is left of a document's pairs meets
its counts in a join. Vocabularies are small, so most pairs are common.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, cut, fresh, map_arrow, read, slices

#: Paths of the two vocabularies; parameters everywhere below.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs of ids that are broadcast: 17 bytes each.
COMMON = 1 << 17
#: Text that a worker takes up at once, and pairs that it counts before it hands them on.
TAKE, HELD = 1 << 20, 1 << 20
#: Fixed value: how a byte-level vocabulary splits text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself where it is one in Latin-1, else the next beyond 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE vocabulary: ids in the order of its merges, which an encoder by ranks needs; special tokens are left out."""

    def __init__(self, model: bytes):
        import tiktoken

        kept = json.loads(model)["model"]
        symbol = byte_of_symbol()
        merged = {"".join(m if isinstance(m, list) else m.split(" ")) for m in kept["merges"]}
        known = {t: i for t, i in kept["vocab"].items() if t in merged or len(t) == 1}
        order = [known["".join(m if isinstance(m, list) else m.split(" "))] for m in kept["merges"]]
        if order != sorted(order):
            raise ValueError("ids that don't follow the order of merges can't serve as ranks")
        names = {i: bytes(symbol[c] for c in t) for t, i in known.items()}
        self.bytes = [names.get(i, b"") for i in range(max(kept["vocab"].values()) + 1)]
        self.coder = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks={b: i for i, b in names.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) for t in texts]


class PieceLevel:
    """A SentencePiece model; it puts the space before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = len(self.coder)
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.coder.is_byte(i) else b"" if self.coder.is_control(i) else p.replace(SPACE, " ").encode() for i, p in ((i, self.coder.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class Aligner:
    """Both coders in a worker, and what their ids look like."""

    def __init__(self, a: bytes, b: bytes):
        self.sides = ByteLevel(a), PieceLevel(b)
        self.size = [np.array([len(x) for x in side.bytes]) for side in self.sides]
        n = max(len(side.bytes) for side in self.sides)
        digits = np.array([str(i).rjust(len(str(n))).encode() for i in range(n)])
        self.digits = np.concatenate([digits.view(np.uint8).reshape(n, -1), np.zeros((n, 1), np.uint8)], 1)
        self.wide = np.array([len(str(i)) for i in range(n)])
        # two ids as one number, of four bytes where both fit in two
        self.shift, self.kind = (16, np.uint32) if n <= 1 << 16 else (32, np.uint64)

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and number of tokens of each text, on either side; a text that either side doesn't give back has none."""
        both = [side.encode(texts) for side in self.sides]
        good = []
        for t, *ids in zip(texts, *both):
            want = b" " + t.encode("utf-8")
            good.append(bool(t) and all(b"".join(map(side.bytes.__getitem__, x)) == want for side, x in zip(self.sides, ids)))
        both = [[x if ok else [] for x, ok in zip(side, good)] for side in both]
        many = [np.array([len(x) for x in side], np.int64) for side in both]
        return [np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in zip(both, many)], many

    def groups(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Group of each token of A and of B: sorted by start, a token begins a group where it starts at the greatest end so far."""
        ends = [np.cumsum(size[x]) for size, x in zip(self.size, ids)]
        starts = np.concatenate([e - size[x] for e, size, x in zip(ends, self.size, ids)])
        side = np.repeat([0, 1], [len(x) for x in ids])
        order = np.lexsort((side, starts))
        reach = np.maximum.accumulate(np.concatenate(ends)[order])
        begins = np.append(True, starts[order][1:] >= reach[:-1])[: len(order)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        return group[: len(ids[0])], group[len(ids[0]) :]

    def links(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of A and of B of all overlaps, by the token of A, then of B."""
        end_a, end_b = (np.cumsum(size[x]) for size, x in zip(self.size, ids))
        low = np.searchsorted(end_b, end_a - self.size[0][ids[0]], "right")
        many = np.searchsorted(end_b - self.size[1][ids[1]], end_a, "left") - low
        a = np.repeat(np.arange(len(many)), many)
        return a, np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)

    def written(self, ids: list[np.ndarray], group: tuple[np.ndarray, np.ndarray], many: list[np.ndarray]) -> list[memoryview]:
        """The groups of each text in a row: `a1,a2|b1;a3|b2,b3`."""
        all_ids, key = np.concatenate(ids), np.concatenate([2 * group[0], 2 * group[1] + 1])
        order = np.argsort(key, kind="stable")
        all_ids, key = all_ids[order], key[order]
        if not len(key):
            return [memoryview(b"")] * len(many[0])
        rows = self.digits[all_ids]
        last = np.append(key[1:] != key[:-1], True)
        rows[:, -1] = np.where(last, np.where(key % 2 == 0, ord("|"), ord(";")), ord(","))
        wide = self.wide[all_ids] + 1
        out = rows[np.arange(rows.shape[1]) >= rows.shape[1] - wide[:, None]]
        cuts = np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(many[0] + many[1]))]
        view = memoryview(out)
        return [view[a : max(a, b - 1)] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


_ALIGNERS: dict[str, Aligner] = {}


def aligner_of(a: bytes, b: bytes) -> Aligner:
    """One for each pair of vocabularies in a Python worker, since it takes long to make."""
    name = hashlib.sha256(a).hexdigest() + hashlib.sha256(b).hexdigest()
    if name not in _ALIGNERS:
        _ALIGNERS[name] = Aligner(a, b)
    return _ALIGNERS[name]


def _sent(docs: DataFrame, paths: tuple[str, str]):
    """The two vocabularies, a few MB whatever the data, as a broadcast."""
    models = []
    for path in paths:
        with open(path, "rb") as f:
            models.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(models)


def _kinds(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)


def _texts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def align(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), paths: tuple[str, str] = (BYTE_LEVEL, PIECES)) -> DataFrame:
    """keep and groups of every row: an array of (start, end, a, b), the bytes of the text with a space before it that the ids a of one vocabulary and b of the other cover.

    Null and empty texts, and those that a vocabulary doesn't give back byte by byte, have no groups. Rows are read one
    by one: repeated rows give repeated rows; other columns are ignored; texts are read whole.
    """
    sent = _sent(docs, paths)

    def run(batches):
        made = aligner_of(*sent.value)
        for part in slices(batches, TAKE):
            ids, many = made.tokens(part.column(part.num_columns - 1).to_pylist())
            group = made.groups(ids)
            n = int(group[0][-1]) + 1 if len(group[0]) else 0
            cuts = [np.searchsorted(g, np.arange(n + 1)) for g in group]
            ends = np.append(0, np.cumsum(made.size[0][ids[0]]))[cuts[0]]
            first = np.searchsorted(cuts[0], np.append(0, np.cumsum(many[0])))
            base = np.repeat(ends[first[:-1]] if n else np.zeros(0, np.int64), np.diff(first))
            lists = [pa.ListArray.from_arrays(c.astype(np.int32), pa.array(x.astype(np.int32))) for c, x in zip(cuts, ids)]
            each = pa.StructArray.from_arrays([pa.array(ends[:-1] - base), pa.array(ends[1:] - base), *lists], ["start", "end", "a", "b"])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(first.astype(np.int32), each)], [*keep, "groups"])

    return map_arrow(_texts(docs, keep), run, f"{_kinds(docs, keep)}, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")


def measured(docs: DataFrame, keep: tuple[str, ...], paths: tuple[str, str]) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, groups_sha256, and a row's different pairs of linked ids (packed, ascending) with the links of each."""
    sent = _sent(docs, paths)

    def run(batches):
        made = aligner_of(*sent.value)
        for part in slices(batches, TAKE):
            ids, many = made.tokens(part.column(part.num_columns - 1).to_pylist())
            group = made.groups(ids)
            a, b = made.links(ids)
            row = np.repeat(np.arange(part.num_rows), many[0])
            owner = row[a]
            pair = ids[0][a].astype(np.uint64) << np.uint64(made.shift) | ids[1][b].astype(np.uint64)
            order = np.lexsort((pair, owner))
            o, p = owner[order], pair[order]
            new = np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1]))[: len(o)]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(o))).astype(np.uint32)
            cuts = np.searchsorted(o[at], np.arange(part.num_rows + 1)).tolist()
            pairs = p[at].astype(made.kind)
            ends = np.append(0, np.cumsum(many[0]))
            # texts are apart, so the groups of a row are those between its tokens
            heads = np.append(group[0], group[0][-1] + 1 if len(group[0]) else 0)
            texts = made.written(ids, group, many)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:-1], pa.array(many[0]), pa.array(many[1]), pa.array(np.diff(heads[ends])), pa.array(np.bincount(owner, minlength=part.num_rows)),
                    pa.array([hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]),
                    pa.array([pairs[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()), pa.array([count[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
                ],
                [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
            )

    return map_arrow(_texts(docs, keep), run, f"{_kinds(docs, keep)}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary")


def pair_counts(rows: DataFrame, shift: int, kind: type) -> DataFrame:
    """pair, n, best: how many rows hold each pair, and whether no other pair of its first id is held by more. A task adds up what it has seen before it hands it on."""

    def run(batches):
        held, counts, size = [], [], 0

        def added():
            pair, which = np.unique(np.concatenate(held), return_inverse=True)
            return pair, np.bincount(which, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            seen, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), return_counts=True)
            held.append(seen)
            counts.append(n)
            size += len(seen)
            if size > HELD:
                pair, n = added()
                held, counts, size = [pair], [n], len(pair)
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])
                    held, counts, size = [], [], 0
        if held:
            pair, n = added()
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

    total = map_arrow(rows.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftrightunsigned("pair", shift)))
    return total.withColumn("best", F.col("n") == top)


def linked(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), paths: tuple[str, str] = (BYTE_LEVEL, PIECES), common: int = COMMON) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A pair's count is the number of rows that link it; n_best are the links whose count no other pair of their id of A
    exceeds, ties included; count_sum adds up the counts of all links. Null, empty and unfaithful texts have zeros and
    an empty groups_sha256. Repeated rows count as often as they stand there; doc_id is not used, so it may be null or
    repeat; an empty table gives an empty one.
    """
    kinds = _kinds(docs, keep)
    (row,) = fresh(docs, "row")
    measures = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    sizes = [len(json.loads(m)["model"]["vocab"]) if k == 0 else len(PieceLevel(m).bytes) for k, m in enumerate(_sent(docs, paths).value)]
    shift, kind = (16, np.uint32) if max(sizes) <= 1 << 16 else (32, np.uint64)
    with Tables(docs.sparkSession) as tables:
        rows = tables.cut(measured(docs, keep, paths), keep=True).withColumn(row, F.monotonically_increasing_id())
        counts = tables.cut(pair_counts(rows, shift, kind), keep=True)
    few = counts.orderBy(F.desc("n"), "pair").limit(common)
    top = few.toArrow()
    order = np.argsort(top["pair"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast([top["pair"].to_numpy()[order], top["n"].to_numpy()[order], top["best"].to_numpy(zero_copy_only=False)[order]])
    whole = top.num_rows < common

    def run(batches):
        pair, n, best = sent.value
        for batch in batches:
            packed = [np.frombuffer(x, kind) for x in batch.column(batch.num_columns - 2).to_pylist()]
            many = np.array([len(x) for x in packed], np.int64)
            p = np.concatenate([np.zeros(0, kind), *packed]).astype(np.int64)
            times = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), many)
            at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
            known = pair[at] == p if len(pair) else np.zeros(len(p), bool)
            score = lambda w: np.bincount(owner[known], w, batch.num_rows)
            # sums of doubles are exact below 2^53; the parts of a count are added apart to stay there
            weight = n[at[known]] * times[known]
            total = score(weight & 0xFFFFFF).astype(np.int64) + (score(weight >> 24).astype(np.int64) << 24)
            top = score(times[known] * best[at[known]]).astype(np.int64)
            cuts = np.append(0, np.cumsum(np.bincount(owner[~known], minlength=batch.num_rows))).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(p[~known]), pa.array(times[~known])], ["pair", "links"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(top), pa.array(total), pa.ListArray.from_arrays(cuts, rest)], [*batch.schema.names[:-2], "n_best", "count_sum", "rest"])

    scored = map_arrow(rows.select(*keep, *measures, row, "pairs", "links"), run, f"{kinds}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {row} long, n_best long, count_sum long, rest array<struct<pair:long,links:long>>")
    if not whole:
        scored = cut(scored)
        rare = scored.select(row, F.explode("rest").alias("r")).select(row, "r.pair", "r.links").join(counts, "pair")
        more = rare.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("_best"), F.sum(F.col("links") * F.col("n")).alias("_sum"))
        scored = scored.join(more, row, "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return scored.select(*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"))
