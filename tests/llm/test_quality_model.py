"""The compression classifier against its own definition, and on odd rows."""

import numpy as np
import zstandard

from cohortwave.llm import quality_model as Q

from .common import ODD, SCHEMA


def sizes(text, content):
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=Q.LEVEL)
    c = zstandard.ZstdCompressor(dict_data=d, level=Q.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(c.compress(text[a : a + Q.PIECE])) for a in range(0, len(text), Q.PIECE))


def labelled(spark, n=300):
    """Good texts have words of their own, bad ones others; every tenth is long."""
    r = np.random.default_rng(4)
    words = {q: ["".join(r.choice(list("abcdefghij" if q else "pqrstuvwxyz"), 6)) for _ in range(60)] for q in (0, 1)}
    rows = [(i, " ".join(r.choice(words[i % 2], 20_000 if i % 10 < 2 else 40)), i % 2) for i in range(n)]
    return spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"), dict((i, (t, q)) for i, t, q in rows)


def test_scores_are_the_size_difference_of_whole_texts(spark):
    docs, labels, texts = labelled(spark)
    good, bad, curve = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.score(docs, good, bad, curve).collect()}
    for i in list(texts)[:40]:
        raw = texts[i][0].encode()
        a, b = sizes(raw, good), sizes(raw, bad)
        assert abs(got[i].contrast - (b - a) / (b + a)) < 1e-12 and abs(got[i].ratio - a / len(raw)) < 1e-12
        assert (got[i].score >= 0.5) == (texts[i][1] == 1)


def test_odd_rows_and_empty_tables(spark):
    docs, labels, _ = labelled(spark, 60)
    odd = spark.createDataFrame([(*r, 1.0, 2.0) for r in ODD], SCHEMA + ", score double, contrast double")
    got = Q.score(odd, *Q.fit(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and {r.doc_id: r.contrast for r in got}[1] == 0.0
    none = Q.fit(docs.limit(0), labels.limit(0))
    assert none[0] == none[1] == b"" and all(0 <= r.score <= 1 for r in Q.score(odd, *none).collect())
    assert Q.score(odd.limit(0), *none).collect() == []
