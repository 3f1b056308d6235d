"""Token alignment against the two libraries and plain loops."""

import collections
import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortwave.llm import alignment

from .common import D, ODD, SCHEMA

MORE = [
    (30, "a <|endoftext|> b <s> </s> <unk> <0x41>", "", "", 0, True), (31, "with the mark ▁ in it", "", "", 0, True), (32, "  two  spaces \n\n\t lines   ", "", "", 0, True), (33, "日本語のテキスト 한국어 עברית 🙂🙂", "", "", 0, True),
    (34, "1234567890 12,345.67 don't we'll", "", "", 0, True), (35, "aaaa" * 5000 + " " * 5000, "", "", 0, True),
]


@pytest.fixture(scope="module")
def coders():
    t = Tokenizer.from_file(alignment.BYTE_LEVEL)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    symbol = alignment.byte_of_symbol()
    names = {i: bytes(symbol[c] for c in x) if all(c in symbol for c in x) else b"" for x, i in t.get_vocab().items()}
    return t, sp, names


def tokens(coders, text):
    t, sp, names = coders
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    ta = [names[i] for i in a]
    tb = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    want = (" " + text).encode()
    return (a, b, ta, tb) if text and b"".join(ta) == want == b"".join(tb) else ([], [], [], [])


def brute(coders, rows):
    per, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b, ta, tb = tokens(coders, text or "")
        ea, eb = [0], [0]
        for x in ta:
            ea.append(ea[-1] + len(x))
        for x in tb:
            eb.append(eb[-1] + len(x))
        cuts = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for lo, hi in zip(cuts, cuts[1:]):
            ga = [k for k in range(i, len(a)) if ea[k] < hi] if len(a) < 400 else list(range(i, ea.index(hi)))
            gb = [k for k in range(j, len(b)) if eb[k] < hi] if len(b) < 400 else list(range(j, eb.index(hi)))
            i, j = i + len(ga), j + len(gb)
            groups.append((lo, hi, [a[k] for k in ga], [b[k] for k in gb]))
            links += [(a[x], b[y]) for x in ga for y in gb if ea[x] < eb[y + 1] and eb[y] < ea[x + 1]]
        per.append((doc_id, len(a), len(b), groups, links))
        count.update(set(links))
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, n_a, n_b, groups, links in per:
        text = ";".join(",".join(map(str, g[2])) + "|" + ",".join(map(str, g[3])) for g in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr), per


@pytest.fixture(scope="module")
def small(spark):
    rows = [r for r in ODD if r[0] not in (6, 7)] + MORE
    return rows, spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", row long, pairs long")


@pytest.mark.parametrize("common", [1 << 17, 20, 1])
def test_odd_rows_are_brute_force(coders, small, common):
    """Whether all pairs are broadcast or most meet their counts in the join."""
    rows, docs = small
    assert sorted(map(tuple, alignment.linked(docs, common=common).collect()), key=repr) == brute(coders, [r[:2] for r in rows])[0]


def test_query_is_brute_force(spark, coders):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.op11_token_alignment(spark, D).collect()), key=repr) == brute(coders, rows)[0]


def test_groups_cover_the_text(coders, small):
    rows, docs = small
    want = {i: [tuple(g) for g in groups] for i, _, _, groups, _ in brute(coders, [r[:2] for r in rows])[1]}
    got = {r.doc_id: [(g.start, g.end, g.a, g.b) for g in r.groups] for r in alignment.align(docs).collect()}
    assert got == want


def test_every_token_merges_to_itself(coders):
    """What an encoder by ranks needs: it takes a piece that is a token whole, without merging."""
    t, _, names = coders
    made = alignment.ByteLevel(open(alignment.BYTE_LEVEL, "rb").read())
    assert made.bytes == [names[i] for i in range(len(made.bytes))] and len(made.bytes) == 50_256
    texts = [b.decode() for b in made.bytes if b and b"\xef\xbf\xbd" not in b and b == b.decode("utf-8", "ignore").encode()]
    assert [x.ids for x in t.encode_batch(texts, add_special_tokens=False)] == [made.coder.encode_ordinary(x) for x in texts]


def test_long_texts_and_empty_tables(spark, small):
    long = spark.createDataFrame([r for r in ODD if r[0] in (6, 7)], SCHEMA)
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups > 1000 for r in alignment.linked(long).collect())
    assert alignment.linked(small[1].limit(0)).collect() == []
