"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents with one shingle set are one entity. Two entities can reach the threshold only if the prefixes of their
shingles, in an order that all share, meet. The order is: fixed parts of the hash space one after another (so that only
the parts that fill the prefix need counting), within each the shingles that fewest entities have, then the hash. Prefix entries meet in an equi join
on the shingle. Entries of a shingle first meet its leaders, the entity whose shingles are the most common and two
drawn ones; only entities that the links so far leave in different components then meet each other, so a group of many near copies gives
about as many pairs as members and yet no link between components is lost. Every pair is verified once, on whole sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, as_bytes, fresh, map_arrow, may_hold, mix, read, slices, text_buffer, window_hashes, word_hashes, word_spans

#: Cells of the hash space whose parities an entity's signature holds, 64 to a long.
CELLS = 512
SPACE_BITS = 20
#: Ends of the first parts of the hash space, as multiples of a prefix's share of a set. The first is wide, so that a prefix leaves out its commonest shingles.
PARTS = (1.3, 2.0)
#: Links that a task contracts at once.
BLOCK = 1 << 20
#: Stands for a null doc_id.
NO_ID = -(2**63)


def sets(part: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each row; of the whole sequence where it is shorter."""
    data, offsets = text_buffer(part.column(part.schema.get_field_index("text")))
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    grams = window_hashes(words, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(window_hashes(words[a:b], int(b - a)) + np.uint64(0xABCD1234 + b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def name(shingles: np.ndarray) -> int:
    """64-bit name of a set: an entity."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def signatures(docs: DataFrame, n: int, percent: int, bounds: list[int]) -> DataFrame:
    """doc_id, print, e, n_shingles, parts, head, cells of every row; print is the hash of its text.

    The bounds cut the hash space into parts; parts counts the shingles of each. head holds those of the fewest first
    parts that fill the prefix.
    """
    edges = np.array(bounds, np.uint64) << np.uint64(64 - SPACE_BITS)

    def run(batches):
        for part in slices(batches):
            rows = sets(part, n)
            heads, parts, cells = [], [], []
            for s in rows:
                ends = np.append(np.searchsorted(s, edges), len(s))
                parts.append(np.diff(ends, prepend=0).tolist())
                heads.append(s[: ends[np.searchsorted(ends, min(prefix_size(len(s), percent), len(s)))]].view(np.int64))
                cells.append(np.packbits((np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1).astype(np.uint8)).view(np.int64))
            sizes = np.array([len(h) for h in heads])
            head = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (CELLS // 64), pa.int32()), pa.array(np.concatenate(cells)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([name(s) for s in rows], pa.int64()), pa.array([len(s) for s in rows], pa.int64()), pa.array(parts, pa.list_(pa.int64())), head, cell], ["doc_id", "print", "e", "n_shingles", "parts", "head", "cells"])

    return map_arrow(as_bytes(docs.select("doc_id", F.xxhash64("text").alias("print"), "text"), "doc_id", "print"), run, "doc_id long, print long, e long, n_shingles long, parts array<long>, head array<long>, cells array<long>")


def prefixes(tables: Tables, ones: DataFrame, percent: int, bounds: list[int]) -> DataFrame:
    """h, e, n, at, rough: prefix entries that another entity has too, with their place in the common order."""
    entries = ones.select("e", F.explode("head").alias("h"))
    often = tables.cut(entries.groupBy("h").agg(F.count("*").alias("f")).where("f > 1"))
    # most shingles are in one entity only, and need not travel
    entries = may_hold(entries, F.col("h"), often, "h").where("may").drop("may")
    part = sum((F.shiftrightunsigned("h", 64 - SPACE_BITS) >= b).cast("int") for b in bounds)
    rows = entries.join(often, "h").withColumn("part", part).join(ones.select("e", F.col("n_shingles").alias("n"), "parts"), "e")
    of, line = Window.partitionBy("e"), Window.partitionBy("e").orderBy("part", "f", "h")
    # shingles that no other entity has come first in their part
    own = [F.col("parts")[k] - F.sum((F.col("part") == k).cast("long")).over(of) for k in range(len(bounds) + 1)]
    ahead = sum((F.when(F.col("part") >= k, F.col(f"own_{k}")).otherwise(0) for k in range(1, len(own))), F.col("own_0"))
    rows = rows.select("e", "n", "h", "f", "part", *[c.alias(f"own_{k}") for k, c in enumerate(own)], F.sum(F.ln("f")).over(of).alias("logs"), F.row_number().over(line).alias("i"))
    most = F.col("n") - F.floor((F.lit(percent) * F.col("n") + 99) / 100).cast("long") + 1
    # a group's base has all that its copies share: the mean log frequency of its shingles is the highest
    rough = -F.floor(1000 * F.col("logs") / F.col("n"))
    return rows.select("h", "e", "n", (F.col("i") - 1 + ahead).alias("at"), rough.alias("rough"), most.alias("most")).where("at < most").drop("most")


def may_link(percent: int):
    """Length and positional filter of a pair of prefix entries l and r of one shingle."""
    n, m = F.col("l.n"), F.col("r.n")
    length = (100 * F.least(n, m)) >= (percent * F.greatest(n, m))
    return length & (F.least("l.at", "r.at") + F.least(n - F.col("l.at"), m - F.col("r.at")) >= overlap(n, m, percent))


def overlap(n, m, percent: int):
    """The least intersection of linked sets of n and m shingles."""
    return F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))


def apart(cells_a, cells_b):
    """A lower bound of the Hamming distance of two sets: the cells that hold an odd number of one set's shingles and an
    even number of the other's, since each of them holds a shingle that is in one set only."""
    return reduce(lambda x, y: x + y, [F.bit_count(cells_a[k].bitwiseXOR(cells_b[k])) for k in range(CELLS // 64)])


def near(cells_a, cells_b, n, m, percent: int):
    """The suffix filter."""
    return apart(cells_a, cells_b) <= n + m - 2 * overlap(n, m, percent)


def pairs_of(met: DataFrame, *more) -> DataFrame:
    """a, b, n, m and more of the pair: the different pairs of met entries l and r; a is the one whose shingles are the commoner."""
    side = lambda x: F.struct(F.col(f"{x}.rough"), F.col(f"{x}.e"), F.col(f"{x}.n"))
    pairs = met.select(F.least(side("l"), side("r")).alias("p"), F.greatest(side("l"), side("r")).alias("q"), *more)
    return pairs.select(F.col("p.e").alias("a"), F.col("q.e").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m"), *pairs.columns[2:]).distinct()


def leaders(entries: DataFrame) -> DataFrame:
    """The entries that all entries of their shingle meet: of two, one; of more, the commonest and two drawn by hash.

    The drawn ones differ from shingle to shingle, so an entity that misses the commonest one's links meets many others.
    """
    row = F.struct("e", "n", "at", "rough")
    drawn = [F.min(F.struct(F.xxhash64("e", "h", F.lit(k)).alias("key"), row.alias("row")))["row"] for k in range(2)]
    first = F.min(F.struct("rough", "e", row.alias("row")))["row"]
    of = entries.groupBy("h").agg(F.count("*").alias("k"), first.alias("first"), F.array(*drawn).alias("drawn")).where("k > 1")
    chosen = F.when(F.col("k") > 2, F.array_distinct(F.concat(F.array("first"), "drawn"))).otherwise(F.array("first"))
    return of.select("h", F.explode(chosen).alias("row")).select("h", "row.*")


def verify(tables: Tables, pairs: DataFrame, ones: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold.

    Sets are computed again from the text of one document of each entity. The set of b goes where a's is, once for each
    pair; a's goes there once. A hot a is split by its b's.
    """
    wants = pairs.select(F.col("b").alias("e"), "a").unionByName(pairs.select(F.col("a").alias("e"), F.lit(None).cast("long").alias("a")).distinct())
    wants = wants.groupBy("e").agg(F.collect_set("a").alias("at"), F.max(F.col("a").isNull()).alias("leads"))
    wants = tables.cut(wants.join(ones.select("e", "id", "print"), "e").select("id", "print", "at", "leads"))
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("print"), "text")
    texts = may_hold(texts, F.xxhash64("id", "print"), wants.select(F.xxhash64("id", "print").alias("key")), "key").where("may").drop("may")
    rows = texts.dropDuplicates(["id", "print"]).join(wants, ["id", "print"]).select("at", "leads", "text")

    def run(batches):
        for part in slices(batches):
            found = sets(part, n)
            ends = np.cumsum([len(s) for s in found])
            arrays = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([name(s) for s in found], pa.int64()), arrays], ["at", "leads", "e", "s"])

    whole = tables.cut(map_arrow(as_bytes(rows, "at", "leads"), run, "at array<long>, leads boolean, e long, s array<long>"))
    a = whole.where("leads").select(F.col("e").alias("a"), F.col("s").alias("sa"))
    b = whole.select(F.explode("at").alias("a"), F.col("e").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = tables.cut(b.join(a, "a").where(both * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b"))
    tables.drop(wants, whole)
    return links


def contract(batches):
    """(e, root) of each end of a block of links (a, b): root is the least end that the block's own links reach."""

    def ends(block):
        a, b = (np.concatenate([part.column(k).to_numpy() for part in block]) for k in (0, 1))
        e, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root, was = np.arange(len(e)), None
        while was is None or (was != root).any():
            was, low = root.copy(), np.minimum(root[x], root[y])
            np.minimum.at(root, was[x], low)
            np.minimum.at(root, was[y], low)
            while (root[root] != root).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([pa.array(e), pa.array(e[root])], ["e", "root"])

    block, n = [], 0
    for part in batches:
        block, n = [*block, part], n + part.num_rows
        if n >= BLOCK:
            yield ends(block)
            block, n = [], 0
    if n:
        yield ends(block)


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """e, root: the least entity that links reach, for entities with links.

    Blocks of links are contracted where they lie. An end that several blocks have gets its least root, which is linked
    with its others; those links are contracted in turn, until no end has two roots. Entities are hashes, so a chain's
    order says nothing of their values, and each round leaves a share of the ends only.
    """
    rounds = []
    of = Window.partitionBy("e").orderBy("root")
    while True:
        local = map_arrow(links.select("a", "b"), contract, "e long, root long")
        local = tables.cut(local.withColumns({"low": F.first("root").over(of), "i": F.row_number().over(of)}))
        rounds.append(local)
        links = local.where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
        if links.isEmpty():
            break
    roots = [t.where("i = 1").select("e", F.col("low").alias("root")) for t in rounds]
    found = roots[0]
    for later in roots[1:]:
        found = found.join(later.select(F.col("e").alias("root"), F.col("root").alias("next")), "root", "left").select("e", F.coalesce("next", "root").alias("root"))
    found = tables.cut(found)
    tables.drop(*rounds)
    return found


def rooted(tables: Tables, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, print, n_shingles, e, root of every row; rows of one component have one root, null without shingles."""
    bounds = [min(2**SPACE_BITS - 1, int(more * (100 - percent) / 100 * 2**SPACE_BITS)) for more in PARTS]
    signed = tables.cut(signatures(docs, n, percent, bounds))
    ones = signed.where("n_shingles > 0").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).dropDuplicates(["e"])
    ones = tables.cut(ones.select("e", "id", "print", "n_shingles", "parts", "head", "cells"))
    named = tables.cut(signed.select("doc_id", "print", "n_shingles", "e"))
    tables.drop(signed)
    entries = tables.cut(prefixes(tables, ones, percent, bounds))
    # an entry meets three leaders at most, so cells meet the pair, not each of its entries
    cells = lambda x: ones.select(F.col("e").alias(x), F.col("cells").alias(f"cells_{x}"))
    lead = tables.cut(leaders(entries))
    met = pairs_of(entries.alias("l").join(lead.alias("r"), "h").where((F.col("l.e") != F.col("r.e")) & may_link(percent)))
    met = met.join(cells("a"), "a").join(cells("b"), "b").where(near(F.col("cells_a"), F.col("cells_b"), F.col("n"), F.col("m"), percent))
    met = tables.cut(met.select("a", "b"))
    links = verify(tables, met, ones, docs, n, percent)
    roots = components(tables, links)

    # what is still apart: entries of the shingles that several components have; leaders have met all others
    known = entries.join(lead.select("h", "e"), ["h", "e"], "left_anti").join(roots.select("e", "root"), "e", "left").withColumn("root", F.coalesce("root", "e"))
    known = tables.cut(known)
    split = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    line = Window.partitionBy("e").orderBy("at")
    known = known.join(split, "h").join(ones.select("e", "cells"), "e").withColumns({f"past_{k}": F.lag("h", k).over(line) for k in (1, 2, 3)})
    known = tables.cut(known)
    # a pair that has met in one of the last three shingles of both need not meet again
    again = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"l.past_{i}") == F.col(f"r.past_{k}"), F.lit(False)) for i in (1, 2, 3) for k in (1, 2, 3)])
    other = (F.col("l.e") < F.col("r.e")) & (F.col("l.root") != F.col("r.root")) & ~again & may_link(percent) & near(F.col("l.cells"), F.col("r.cells"), F.col("l.n"), F.col("r.n"), percent)
    rest = known.alias("l").join(known.alias("r"), (F.col("l.h") == F.col("r.h")) & other)
    gap = apart(F.col("l.cells"), F.col("r.cells")) / (F.col("l.n") + F.col("r.n"))
    rest = tables.cut(pairs_of(rest, gap.alias("gap")).select("a", "b", "gap").join(met, ["a", "b"], "left_anti"))
    # each entity's likeliest pair, and then all pairs whose components still differ
    for last in (False, True):
        pick = rest.select("a", "b")
        if not last:
            ends = rest.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "gap")
            pick = tables.cut(ends.groupBy("x").agg(F.min(F.struct("gap", "a", "b")).alias("v")).select("v.a", "v.b").distinct())
        links = links.union(verify(tables, pick, ones, docs, n, percent))
        roots = components(tables, links).select("e", "root")
        if not last:
            of = lambda x: roots.select(F.col("e").alias(x), F.col("root").alias(f"root_{x}"))
            open_ = rest.join(pick, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
            rest = tables.cut(open_.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "gap"))

    some = named.where("n_shingles > 0").join(roots, "e", "left").select(*named.columns, F.coalesce("root", "e").alias("root"))
    return some.unionByName(named.where("n_shingles = 0").withColumn("root", F.lit(None).cast("long")))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two documents link when 100 * intersection >= percent * union.

    Texts are lower-cased (A-Z) and cut into words; null and empty ones have no shingles and stay alone, with their own
    doc_id (null where that is null). Repeated rows are copies of one document. A component's id is its least doc_id.
    Other columns are ignored. Equality of shingles is that of 64-bit hashes, of whole sets that of a 64-bit digest.
    An empty table gives no rows.
    """
    with Tables(docs.sparkSession) as tables:
        named = tables.cut(rooted(tables, docs, n, percent).select("doc_id", "n_shingles", "root"), keep=True)
        # a table of its own, so that a large component is split in the join below
        lowest = tables.cut(named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), keep=True)
    some = named.where("n_shingles > 0").join(lowest, "root").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), n=3, percent=90)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one of the least doc_id (null last), then of the least hash of the text.

    Documents without words (null and empty texts among them) stay; rows that repeat both doc_id and text become one.
    All columns come back, whatever their names; an empty table gives no rows.
    """
    with Tables(spark) as tables:
        found = tables.cut(rooted(tables, docs, 5, 80).select("doc_id", "print", "root"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "print"))
        kept = found.where("root is not null").groupBy("root").agg(first.alias("v")).select("v.doc_id", "v.print")
        kept = tables.cut(kept.unionByName(found.where("root is null").select("doc_id", "print")), keep=True)
    (key,) = fresh(docs, "print")
    same = (F.col(f"d.{key}") == F.col("k.print")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    keyed = docs.withColumn(key, F.xxhash64("text")).alias("d")
    return keyed.join(kept.alias("k"), same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
