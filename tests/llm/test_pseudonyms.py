"""Pseudonyms: round trips over planted values of all kinds, windows, and long texts of numbers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cohortwave.llm import pseudonyms as P

RNG = random.Random(17)


def luhn(n):
    d = [RNG.randrange(10) for _ in range(n - 1)]
    t = sum(sum(divmod(2 * x, 10)) if k % 2 == 0 else x for k, x in enumerate(reversed(d)))
    return "".join(map(str, d)) + str((10 - t % 10) % 10)


def iban(country, n):
    body = "".join(str(RNG.randrange(10)) for _ in range(n - 4))
    number = int(body + "".join(str(ord(c) - 55) for c in country) + "00")
    return f"{country}{98 - number % 97:02d}{body}"


def planted():
    r = RNG.randrange
    date = lambda: f"{r(1900, 2100)}-{r(1, 13):02d}-{r(1, 29):02d}"
    return {
        "email": [f"{RNG.choice(['ann', 'Bob.Lee', 'x_1%'])}{r(1000)}@mail{r(9)}.example.org" for _ in range(60)],
        "iban": [iban(*RNG.choice([("ES", 24), ("DE", 22), ("BE", 16), ("NO", 15)])) for _ in range(60)],
        "date": [date() for _ in range(40)] + [f"{r(1, 13):02d}/{r(1, 29):02d}/{r(1900, 2100)}" for _ in range(40)] + [f"{r(13, 29):02d}/{r(1, 13):02d}/{r(1900, 2100)}" for _ in range(40)] + [f"{r(1, 29):02d}.{r(1, 13):02d}.{r(1900, 2100)}" for _ in range(40)] + ["29/02/2024", "2000-02-29"],
        "ssn": [f"{RNG.choice([r(1, 666), r(667, 900)]):03d}-{r(1, 100):02d}-{r(1, 10000):04d}" for _ in range(60)],
        "ip": [".".join(str(r(256)) for _ in range(4)) for _ in range(60)],
        "card": [luhn(RNG.choice([13, 15, 16, 19])) for _ in range(60)] + ["4111 1111 1111 1111", "4111-1111-1111-1111"],
        "phone": [f"+1 {r(200, 1000)}-{r(200, 1000)}-{r(10000):04d}" for _ in range(40)] + [f"({r(200, 1000)}) {r(200, 1000)}-{r(10000):04d}" for _ in range(40)] + [f"+49 {r(10, 100)} {r(10**6, 10**8)}" for _ in range(40)],
    }


@pytest.mark.parametrize("key", [P.KEY, "another key"])
def test_round_trip_of_all_kinds(spark, key):
    values = [(k, v) for k, some in planted().items() for v in dict.fromkeys(some)]
    df = spark.createDataFrame(values, "kind string, v string").withColumn("w", P.pseudonym(F.col("v"), P.kind_of(F.col("v")), key))
    rows = df.select("kind", "v", "w", P.kind_of(F.col("v")).alias("was"), P.kind_of(F.col("w")).alias("now"), P.original(F.col("w"), key).alias("back")).collect()
    assert all(r.was == r.now == r.kind for r in rows)
    assert [r for r in rows if r.back != r.v] == []
    assert len({r.w for r in rows}) == len(rows) and sum(r.v != r.w for r in rows) > 0.95 * len(rows)
    shape = lambda x: [("d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else c) for c in x]
    assert all(shape(r.v) == shape(r.w) for r in rows if r.kind != "ip")


def chain(n):
    """Numbers beside numbers, whose matches fail and overlap."""
    some = planted()
    kinds = sorted(some)
    return " ".join(RNG.choice([lambda: f"{RNG.randrange(10_000):04d}", lambda: RNG.choice(some[RNG.choice(kinds)]), lambda: RNG.choice(["word", "AB", "X9", ".", "\n"])])() for _ in range(n))


def test_windows_give_what_the_whole_text_gives(spark):
    texts = [chain(120) for _ in range(12)] + ["", "no number", "1" * 3000, "12 " * 900, "1234-5678-" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = df.select("i", P._settled(F.col("t"), 1 << 20).alias("whole"), P._settled(F.col("t"), 600).alias("parts")).collect()
    assert all(r.whole == r.parts for r in got)


def test_long_chains_take_little_time(spark):
    """64 kB of numbers; before, twice the text took four times as long, and this one several minutes."""
    text = " ".join(f"{RNG.randrange(10_000):04d}" for _ in range(12_800))
    began = time.time()
    (row,) = P.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.time() - began < 90 and len(row.text) == len(text) and len(row.pii) > 100
