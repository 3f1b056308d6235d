"""Memory of the encoder, and that its results do not depend on how much text it takes up at once."""

import tracemalloc

import numpy as np

from cohortwave.llm import sentencepiece as P


def test_occurrences_are_found_in_bounded_memory_and_slices_do_not_matter():
    coder, r = P.coder_of(P.model_bytes()), np.random.default_rng(1)
    words = ["".join(map(chr, r.integers(97, 123, 9))) for _ in range(30000)]
    text = "\x00".join(words) + "\x00"
    tracemalloc.start()
    try:
        starts, pieces = coder.edges(text)
        peak = tracemalloc.get_traced_memory()[1] / len(text)
    finally:
        tracemalloc.stop()
    assert peak < 80  # bytes a character; 107 before
    assert all(text.startswith(coder.sorted[p], s) for s, p in zip(starts[::997].tolist(), pieces[::997].tolist()))
    texts = [" ".join(words[a : a + 50]) for a in range(0, 2000, 50)]
    whole = coder.encode(texts)
    coder.forget()
    assert [x for t in texts for x in coder.encode([t])] == whole
    coder.forget()
