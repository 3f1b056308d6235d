"""Compression classifier: a text's quality from how well dictionaries of good and of bad text compress it.

Two zstandard dictionaries are trained on a bounded sample of labelled texts, one a label. A text is compressed whole,
in pieces so short that the dictionaries' own tables code them, with either dictionary. Its inputs are the normalised
size difference (bad - good) / (bad + good) and the size with the good dictionary a byte; a logistic curve, fitted on
labelled texts that neither dictionary has seen, makes them a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow, read

#: Bounds of the fitting sample: labelled texts of each label for a dictionary, pieces of them, and texts for the curve.
FIT_TEXTS, FIT_PIECES, CURVE_TEXTS = 1500, 60_000, 1500
DICTIONARY_BYTES = 65_536
LEVEL, PIECE = 1, 256
FOLDS = 5
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(pieces: list[bytes]) -> bytes:
    """A dictionary from the pieces; where they are too few to train on, all their bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content) if content else None
        if d:
            d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def contrast(text: bytes, by: list[zstandard.ZstdCompressor]) -> tuple[float, float, float]:
    """(bad size - good size) / (bad size + good size), good size a byte, and log(1 + bytes)."""
    good = bad = 0
    one, two = by[0].compress, by[1].compress
    for a in range(0, len(text), PIECE):
        piece = text[a : a + PIECE]
        good += len(one(piece))
        bad += len(two(piece))
    return ((bad - good) / (bad + good), good / len(text), float(np.log1p(len(text)))) if text else (0.0, 1.0, 0.0)


def inputs(m: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of (contrast, size a byte, log length)."""
    d, r, n = m[:, 0], np.log(np.clip(m[:, 1], 1e-3, 2)), (m[:, 2] - 7) / 3
    return np.stack([d * 10, d * 10 * n, np.minimum(r + 1.5, 0) * 4, r, n, np.ones_like(d)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_texts: int = FIT_TEXTS, curve_texts: int = CURVE_TEXTS) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries and curve from rows whose fold is not 0.

    Fold 1 feeds the curve and the others the dictionaries, each the texts of each label that come first by hash, of any
    length. A dictionary is trained on the FIT_PIECES pieces of its texts, 15 MB, that come first by hash. With no text
    of a label its dictionary is empty. Rows that repeat a doc_id count once; null and empty texts don't count.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(fold(F.col("doc_id")) != 0)
    usable = docs.where(F.octet_length("text") > 0)
    ids = usable.select("doc_id").distinct().join(known, "doc_id").withColumn("curve", fold(F.col("doc_id")) == 1)
    order = F.struct(F.xxhash64(F.lit("dictionary"), "doc_id"), "doc_id")
    parts = [ids.where((F.col("quality") == q) & (F.col("curve") == c)).orderBy(order).limit(curve_texts if c else fit_texts) for q in (0, 1) for c in (False, True)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    rows = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    cuts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / PIECE).cast("int"))
    pieces = rows.where(~F.col("curve")).select("quality", F.explode(F.transform(cuts, lambda k: F.substring(F.col("text").cast("binary"), k * PIECE + 1, F.lit(PIECE)))).alias("piece"))
    first = lambda q: pieces.where(F.col("quality") == q).select("piece").orderBy(F.xxhash64("piece"), "piece").limit(FIT_PIECES)
    good, bad = (train([bytes(r.piece) for r in first(q).toLocalIterator()]) for q in (1, 0))
    seen = score(rows.where("curve"), good, bad, None, "quality").toPandas()
    if seen.quality.nunique() < 2:
        return good, bad, np.array([1.0, 0, 0, 0, 0, 0])
    seen = seen.sort_values(["contrast", "ratio", "length", "quality"])
    return good, bad, fit_curve(inputs(seen[["contrast", "ratio", "length"]].to_numpy()), seen.quality.to_numpy(float))


def score(docs: DataFrame, good: bytes, bad: bytes, curve: np.ndarray | None, keep: str = "doc_id") -> DataFrame:
    """keep, contrast, ratio, length and, with a curve, score.

    Null texts count as empty and have contrast 0; their score is the curve's value there. Repeated rows score alike;
    other columns are ignored.
    """
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches):
        by = compressors(good, bad)
        for batch in batches:
            pairs = np.array([contrast(t.as_py(), by) for t in batch.column(1)]).reshape(-1, 3)
            cols = {keep: batch.column(0), "contrast": pa.array(pairs[:, 0]), "ratio": pa.array(pairs[:, 1]), "length": pa.array(pairs[:, 2])}
            if curve is not None:
                z = inputs(pairs) @ curve
                cols["score"] = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(as_bytes(docs, keep), run, f"{keep} {kind}, contrast double, ratio double, length double" + (", score double" if curve is not None else ""))


def op6_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "contrast")
