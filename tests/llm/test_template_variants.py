"""Lines that agree with a line that recurs as it is, against a plain version in which every line goes down the tree."""

import collections
import random

from cohortwave.llm import line_dedup as T

from .test_line_dedup import enough, masked


def brute(docs):
    """Numbers of the dropped lines by document; ids are different."""
    rows = [(i, text, pos, masked(line)) for i, text in docs for pos, line in enumerate(text.split("\n")) if masked(line)]
    drops = collections.defaultdict(set)

    def drop(some):
        if len({text for _, text, _, _ in some}) >= enough(len(some[0][3])):
            keeper = min(i for i, *_ in some)
            for i, _, pos, _ in some:
                if i != keeper:
                    drops[i].add(pos)

    leaves, equal = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        equal[r[3]].append(r)
        if len(r[3]) > T.LEAST_FIXED:
            leaves[len(r[3]), r[3][: T.DEPTH]].add(r[3])
    for some in equal.values():
        drop(some)
    for (n, _), lines in leaves.items():
        rest = set(lines)
        while rest:
            group, new = set(), {rest.pop()}
            while new:
                group |= new
                new = {x for x in rest if any(sum(a == b for a, b in zip(x, y)) >= n * T.AGREE - 1e-9 for y in new)}
                rest -= new
            votes = collections.Counter((p, w) for x in group for p, w in enumerate(x))
            own = [x for x in group if sum(2 * votes[p, w] >= len(group) for p, w in enumerate(x)) >= n * T.AGREE - 1e-9]
            if own:
                drop([r for x in own for r in equal[x]])
    return {i: len(drops[i]) for i, _ in docs}


def dropped(spark, docs):
    return {r.doc_id: r.n_dropped for r in T.drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_what_agrees_with_a_recurring_line_goes_with_it(spark):
    line, other = "subscribe to our letter for news every day", "subscribe to our letter for news every week"
    docs = [(i, f"{line}\nown text {'abcdef'[i] * 5}") for i in range(1, 5)] + [(9, f"{other}\nown text z"), (10, "subscribe to our friends and enemies of old\nown text y")]
    # before, the one line that differs stayed
    assert dropped(spark, docs) == brute(docs) == {1: 0, 2: 1, 3: 1, 4: 1, 9: 1, 10: 0}
    # where it comes first, it is the one that stays
    docs = [(0, docs[4][1]), *docs[:4]]
    assert dropped(spark, docs) == brute(docs) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_random_lines_with_variants(spark):
    r = random.Random(4)
    words = ["red", "blue", "green", "pink", "grey"]
    docs = []
    for i in r.sample(range(1000), 150):
        kinds = [f"see {r.choice('ab')} for " + " ".join(r.choice(words[: 1 + (r.random() < 0.15) * 4]) for _ in range(n)) for n in r.choices((1, 2, 3, 5, 9), k=3)]
        long = " ".join(["long"] * 40 + [r.choice(words) for _ in range(15)])
        docs.append((i, "\n".join([*kinds, *([long] if r.random() < 0.2 else []), f"own {i}"])))
    want = brute(docs)
    assert dropped(spark, docs) == want and sum(want.values()) > 100


def test_documents_without_a_doc_id_keep_a_line_once(spark):
    """Before, all documents of the least doc_id kept the line, so that without ids nothing was dropped."""
    for ids in ([None] * 5, [3, 3, 3, 7, 7]):
        docs = [(i, f"all of these have this line\nthey also have {'abcde'[k]} line like this one\nown {'abcde'[k] * 4}") for k, i in enumerate(ids)]
        got = T.drop_templates(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string")).collect()
        by_text = {}
        for row in got:
            by_text.setdefault(row.text.split("\n")[-1], set()).add(row.n_dropped)
        assert sorted(map(sorted, by_text.values())) == [[0], [2], [2], [2], [2]]
