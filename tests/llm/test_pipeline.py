"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import pytest
import sentencepiece

import corpus_pipeline
from cohortwave.llm import quality_rules
from cohortwave.llm.common import cut, read

from .common import D, ODD, SCHEMA, WORD
from .test_line_dedup import brute as brute_lines
from .test_llm import brute_components


@pytest.fixture(scope="module")
def steps(spark):
    """Documents, and what each stage makes of the one before."""
    out = [read(spark, D, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], D)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules_keep_what_the_judge_keeps(spark, steps):
    model = quality_rules.fit(steps[0], read(spark, D, "labels"))
    kept = {r.doc_id for r in quality_rules.judge(steps[0], model).where("kept").collect()}
    assert rows(steps[1]) == [r for r in rows(steps[0]) if r[0] in kept] and 0 < len(kept) < steps[0].count()


def test_line_dedup_drops_what_all_pairs_drop(steps):
    texts = [(r.doc_id, r.text) for r in steps[1].select("doc_id", "text").collect()]
    want = {(i, t) for i, t, _, dropped in brute_lines(texts) if dropped == 0 or WORD.search(t)}
    assert {(r.doc_id, r.text) for r in steps[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_document_of_each_group_stays(steps):
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    roots = {i: root for i, (_, root) in brute_components(texts, 5, 80).items()}
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(set(roots.values()))
    assert set(rows(steps[3])) <= set(rows(steps[2]))


def test_the_mix_repeats_whole_documents(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(after) <= set(before) and all(after.count(r) <= 3 for r in set(after))


def test_tokens_are_those_of_the_library(steps):
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    got = steps[5].collect()
    assert len(got) == steps[4].count() and all(r.token_ids == sp.encode(texts[r.doc_id]) for r in got)


def test_run_is_its_stages(spark, steps):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, D).collect()) == sorted((r.doc_id, r.n_tokens) for r in steps[5].collect())


def test_stages_take_odd_rows_and_empty_tables(spark):
    odd = spark.createDataFrame([r[:5] for r in ODD], SCHEMA.rsplit(",", 1)[0])
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, D)
            assert name == "sentencepiece" or out.columns == docs.columns
            assert out.count() <= 3 * docs.count()
