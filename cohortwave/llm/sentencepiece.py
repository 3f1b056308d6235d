"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text falls into units that no merge crosses (spaces with the letters after them). The units that the task
has not met yet are concatenated; their suffixes, cut at the longest piece, are sorted by doubling ranks; every piece is binary-searched
in them, which gives the range of its occurrences; the occurrences are edges from a position to a later one, sorted
by position and relaxed from left to right.

The public model is of the BPE kind: not the path of greatest score is right but the one that merging by rank ends in.
That path is the only one whose neighbours are compatible (merging the two alone leaves them apart), so an edge relaxes
its end when it is compatible with the edge that its start was reached by. Characters without a piece are coded as bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read, slices

#: Path of the public model; a parameter everywhere below.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units that a task remembers, and twice as many pairs of pieces; beyond that it forgets and starts anew.
MEMO = 200_000
#: Units of more characters are relaxed one by one, and text that a worker takes up at once, in bytes.
LONG, TAKE = 64, 1 << 20
#: The same in the pipeline, whose workers share the machine with what earlier stages left in memory: a quarter, for some more time.
STAGE_TAKE = 1 << 18
CLOSED, FREE = -1, -2


class Pieces:
    """Vocabulary of a model and the encoder that works on batches."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [sp.id_to_piece(i) for i in range(len(sp))]
        plain = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text_of = [n.replace(SPACE, " ").encode("utf-8") for n in self.names]
        for b, i in enumerate(self.byte):
            self.text_of[i] = bytes([b])
        self.code = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.byte_code = [np.int32(i).tobytes() for i in self.byte]
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        # what merging can't end in never occurs
        self.sorted = [p for p in sorted(self.ids) if self.merge(p) == [p]]
        # characters of pieces as two-byte ranks, in the order of their code points; 0 is what no piece holds
        self.alphabet = np.array(sorted({ord(c) for p in self.ids for c in p}), np.uint32)
        self.keys = self.packed("".join(p.ljust(self.longest, "\x00") for p in self.sorted)).reshape(-1, self.longest).view(f"S{2 * self.longest}").ravel()
        # a piece's range ends before the first suffix that is above all its continuations
        high = self.keys.view(np.uint8).reshape(len(self.sorted), -1).copy()
        for row, p in zip(high, self.sorted):
            row[2 * len(p) :] = 255
        self.above = high.view(f"S{2 * self.longest}").ravel()
        self.sizes = np.array([len(p) for p in self.sorted])
        self.codes = [self.code[p] for p in self.sorted]
        self.id_of = np.array([self.ids[p] for p in self.sorted], np.int32)
        self.single = np.array(sorted({0} | {ord(p) for p in self.ids if len(p) == 1}), np.uint32)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.memo: dict[str, bytes] = {}
        self.met, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def packed(self, text: str) -> np.ndarray:
        """Two-byte ranks of the characters, most significant byte first."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(">u2")

    def merge(self, text: str) -> list[str]:
        """Merging by rank, for a piece or two: the neighbours that make the best piece, leftmost first, until none do."""
        parts, get = list(text), self.score.get
        while len(parts) > 1:
            best, top = -1, -np.inf
            for k, pair in enumerate(map(str.__add__, parts, parts[1:])):
                score = get(pair)
                if score is not None and score > top:
                    best, top = k, score
            if best < 0:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging pieces a[k] and b[k] (numbers in the sorted vocabulary) leaves them apart. Known pairs are kept sorted."""
        pairs, which = np.unique(a << 32 | b, return_inverse=True)
        if len(self.met) > 2 * MEMO:
            self.met, self.fits = self.met[:0], self.fits[:0]
        new = np.setdiff1d(pairs, self.met, assume_unique=True)
        if len(new):
            said = [self.merge(one + two) == [one, two] for one, two in ((self.sorted[x >> 32], self.sorted[x & 0xFFFFFFFF]) for x in new.tolist())]
            at = np.searchsorted(self.met, new)
            self.met, self.fits = np.insert(self.met, at, new), np.insert(self.fits, at, said)
        return self.fits[np.searchsorted(self.met, pairs)][which]

    def suffixes(self, packed: np.ndarray, n: int) -> np.ndarray:
        """The first n positions in the order of the text from there on, cut at the longest piece or later: ranks of four characters, then of twice as many."""
        p = np.append(packed, np.zeros(4, packed.dtype)).astype(np.uint64)
        key = p[:n] << 48 | p[1 : n + 1] << 32 | p[2 : n + 2] << 16 | p[3 : n + 3]
        span = 4
        while True:
            order = np.argsort(key)
            if span >= self.longest:
                return order
            row = key[order]
            rank = np.zeros(n + span, np.uint64)
            rank[order] = np.cumsum(np.append(True, row[1:] != row[:-1]))
            key = rank[:n] << 32 | rank[span : n + span]
            span *= 2

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece number of every occurrence of every piece in text, sorted by start, then piece; of those at one start, each begins the next."""
        n, width = len(text), self.longest
        padded = self.packed(text + "\x00" * width)
        order = self.suffixes(padded, n)
        ranked = np.lib.stride_tricks.sliding_window_view(padded, width)[order].view(f"S{2 * width}").ravel()
        low = np.searchsorted(ranked, self.keys, "left")
        many = np.searchsorted(ranked, self.above, "right") - low
        del ranked, padded
        # in place, since occurrences are several times the text
        both = np.repeat(low - (np.cumsum(many) - many), many)
        both += np.arange(len(both))
        both = order[both]
        both <<= 24
        both |= np.repeat(np.arange(len(many)), many)
        both.sort()
        starts = both >> 24
        both &= 0xFFFFFF
        return starts, both

    def relax(self, pos: np.ndarray, first: np.ndarray, starts: np.ndarray, pieces: np.ndarray, last: np.ndarray, came: np.ndarray) -> None:
        """Relax the edges that start at positions pos, of which none follows from another."""
        low = first[pos]
        many = first[pos + 1] - low
        e = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
        before = np.repeat(last[pos], many)
        end = starts[e] + self.sizes[pieces[e]]
        some = last[end] == CLOSED
        e, before, end = e[some], before[some], end[some]
        ok = before == FREE
        ok[~ok] = self.compatible(before[~ok], pieces[e[~ok]])
        last[end[ok]], came[end[ok]] = pieces[e[ok]], starts[e[ok]]

    def walk(self, a: int, b: int, first: np.ndarray, pieces: np.ndarray, last: np.ndarray, came: np.ndarray) -> None:
        """Relax the edges of one long unit, position by position."""
        known: dict[tuple[int, int], bool] = {}
        mine, reached = last[a : b + 1].tolist(), came[a : b + 1].tolist()
        bounds = first[a : b + 1].tolist()
        some, sizes = pieces[bounds[0] : bounds[-1]].tolist(), self.sizes.tolist()
        for i in range(b - a):
            before = mine[i]
            for p in some[bounds[i] - bounds[0] : bounds[i + 1] - bounds[0]]:
                end = i + sizes[p]
                if mine[end] == CLOSED:
                    ok = before == FREE or known.get((before, p))
                    if ok is None:
                        one, two = self.sorted[before], self.sorted[p]
                        ok = known[before, p] = self.merge(one + two) == [one, two]
                    if ok:
                        mine[end], reached[end] = p, a + i
        last[a : b + 1], came[a : b + 1] = mine, reached

    def learn(self, units: list[str]) -> None:
        """Encode units that are new; each ends in a separator that no piece holds.

        A position is reached by one edge at most: the last piece of the text before it. Edges that end where one has
        ended already are passed over. Position k of all units is relaxed at once; units of more than LONG characters
        are walked one by one.
        """
        text = "\x00".join(units) + "\x00"
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        begin = np.cumsum(sizes + 1) - sizes - 1
        last = np.full(len(text) + 1, CLOSED, np.int64)  # the piece that ends there; FREE where any piece may begin
        came = np.zeros(len(text) + 1, np.int64)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bare = np.flatnonzero(self.single[np.minimum(np.searchsorted(self.single, chars), len(self.single) - 1)] != chars)
        last[begin], last[bare + 1], came[bare + 1] = FREE, FREE, bare
        starts, pieces = self.edges(text)
        first = np.searchsorted(starts, np.arange(len(text) + 1))
        short = np.flatnonzero(sizes <= LONG)
        for k in range(int(sizes[short].max(initial=0))):
            short = short[sizes[short] > k]
            self.relax(begin[short] + k, first, starts, pieces, last, came)
        for u in np.flatnonzero(sizes > LONG).tolist():
            self.walk(int(begin[u]), int(begin[u] + sizes[u]), first, pieces, last, came)
        # back from the end of each unit; those with a character that has no piece one by one
        whole = np.searchsorted(bare, begin) == np.searchsorted(bare, begin + sizes)
        easy = np.flatnonzero(whole & (sizes <= LONG))
        unit, at, found = easy, begin[easy] + sizes[easy], []
        while len(unit):
            found.append((unit, last[at]))
            at = came[at]
            more = at > begin[unit]
            unit, at = unit[more], at[more]
        if found:
            owner = np.concatenate([u for u, _ in reversed(found)])
            by = np.argsort(owner, kind="stable")
            ids = self.id_of[np.concatenate([p for _, p in reversed(found)])[by]].tobytes()
            cuts = (4 * np.searchsorted(owner[by], np.append(easy, len(units)))).tolist()
            self.memo.update((units[u], ids[a:b]) for u, a, b in zip(easy.tolist(), cuts, cuts[1:]))
        for u in np.flatnonzero(~whole | (sizes > LONG)).tolist():
            out: list[bytes] = []
            a, j = int(begin[u]), int(begin[u] + sizes[u])
            while j > a:
                i = int(came[j])
                out.append(self.codes[last[j]] if last[j] >= 0 else b"".join([self.byte_code[b] for b in text[i:j].encode("utf-8", "surrogatepass")]))
                j = i
            self.memo[units[u]] = b"".join(reversed(out))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text as 32-bit integers in a row; an empty text has none."""
        if self.crossing:
            raise ValueError("the model has pieces with a space inside or at the end: units can't be coded apart")
        split = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = {u for units in split for u in units}.difference(self.memo)
        # a unit with the separator in it is coded around it
        odd = [u for u in new if "\x00" in u]
        plain = {u for u in new if "\x00" not in u} | {x for u in odd for x in u.split("\x00") if x and x not in self.memo}
        if plain:
            self.learn(sorted(plain))
        for u in odd:
            self.memo[u] = self.byte_code[0].join(self.memo[x] if x else b"" for x in u.split("\x00"))
        get = self.memo.__getitem__
        return [b"".join(map(get, units)) for units in split]

    def forget(self) -> None:
        """Drop the units and pairs met so far."""
        self.memo.clear()
        self.met, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")[1:]


_CODERS: dict[str, Pieces] = {}


def coder_of(model: bytes) -> Pieces:
    """One encoder for each model in a Python worker, since its tables take seconds to make."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _CODERS:
        _CODERS[name] = Pieces(model)
    return _CODERS[name]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokens(docs: DataFrame, path: str = MODEL, keep: tuple[str, ...] = ("doc_id",), take: int = TAKE) -> DataFrame:
    """keep, n_tokens, token_ids, decoded_sha256 and round_trip of every row.

    round_trip says whether decoding the ids gives the text back; it is false only where the text holds the space mark
    itself. Null and empty texts have no tokens. Repeated rows give repeated rows; other columns are ignored. The model
    is half a megabyte and travels with the task. A worker takes up `take` bytes of text at once; the result does not depend on it.
    """
    model = model_bytes(path)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        coder = coder_of(model)
        for part in slices(batches, take):
            texts = part.column(part.num_columns - 1).to_pylist()
            ids = coder.encode(texts)
            sizes = np.array([len(x) // 4 for x in ids])
            back = [coder.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:-1],
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))),
                    pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back]),
                    pa.array([b == t for b, t in zip(back, texts)], pa.bool_()),
                ],
                [*keep, "n_tokens", "token_ids", "decoded_sha256", "round_trip"],
            )
        coder.forget()

    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_arrow(rows, run, f"{kinds}, n_tokens long, token_ids array<int>, decoded_sha256 string, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with what identifies them. Columns named as the new ones are replaced; nulls, empty texts and repeated rows as in `tokens`."""
    keep = tuple(c for c in docs.columns if c not in ("text", "n_tokens", "token_ids", "decoded_sha256", "round_trip"))
    return tokens(docs, keep=keep, take=STAGE_TAKE)
