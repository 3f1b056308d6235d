"""Line dedup by a log-template tree, in DataFrame functions only.

A line descends three levels: its number of tokens; its leading tokens, with tokens that hold a digit as a wildcard, to
a leaf; and the segments of what follows, one more than places may differ, to the leaf's branches. Two lines of a leaf
that agree at enough places have a segment in common, so a branch holds all that a line can belong with. Lines of a
branch that agree at enough places are in one group, as are lines that such lines connect, and each group has a template:
at each place the token that at least half of its lines have, a wildcard elsewhere. Lines that agree with their group's template at enough places
are its members. Lines that are equal but for wildcards are a template of their own as well, whatever their group's is. A
template that recurs in `least` documents of different text (two for long lines) is dropped from all of them but the one
of the least doc_id; where a line is of two templates, both drop it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, fresh, may_hold, read

#: Documents of different text that make a template recurring; leading tokens of a leaf; share of places that must agree.
LEAST_DOCS, DEPTH, AGREE = 3, 3, 0.7
#: Places that a template has fixed at least; shorter lines recur only where they are equal but for numbers.
LEAST_FIXED = 4
#: Tokens from which on a line is long, and the documents of different text that suffice for it: chance repeats are unlikely.
LONG_TOKENS, LEAST_LONG = 50, 2
WILD = "<*>"


def lines_of(docs: DataFrame) -> DataFrame:
    """id, print, pos, n, leaf, same, line of every line with a token; docs has id, print, text.

    Runs of separators count as one space. Tokens with a digit are wildcards, by a pattern that scans a token once.
    """
    # few texts have a digit or a rare separator, and only those are looked at line by line
    docs = docs.select("id", "print", "text", F.regexp("text", F.lit(r"[0-9\t\x0B\f\r]")).alias("odd"))
    text = F.when(F.col("odd"), F.translate("text", "\t\x0b\x0c\r", "    ")).otherwise(F.col("text"))
    parts = docs.select("id", "print", "odd", F.posexplode_outer(F.split(text, "\n")).alias("pos", "raw"))
    line = F.trim(F.when(F.contains("raw", F.lit("  ")), F.regexp_replace("raw", " {2,}", " ")).otherwise(F.col("raw")))
    parts = parts.select("id", "print", "pos", "odd", line.alias("raw")).where("raw <> ''")
    wild = F.when(F.col("odd"), F.when(F.regexp("raw", F.lit("[0-9]")), F.regexp_replace("raw", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)))
    parts = parts.select("id", "print", "pos", "raw", wild.alias("wild"), F.size(F.split("raw", " ")).alias("n"))
    n_wild = (F.length("wild") - F.length(F.replace("wild", F.lit(WILD), F.lit("")))) / len(WILD)
    # numbers alone are no template
    parts = parts.select("id", "print", "pos", "n", F.when(F.col("wild").isNull(), F.col("raw")).when(n_wild == F.col("n"), F.col("raw")).otherwise(F.col("wild")).alias("line"))
    return parts.select("id", "print", "pos", "n", F.xxhash64("n", F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("same"), "line")


def _enough(n, least: int):
    """Documents of different text that make a template of n tokens recurring."""
    return F.when(n >= LONG_TOKENS, min(least, LEAST_LONG)).otherwise(least)


def _recurring(lines: DataFrame, key: str, least: int) -> DataFrame:
    """key, keeper: templates in enough documents of different text, and the first document that has it."""
    texts = lines.groupBy(key, "print").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    return texts.groupBy(key).agg(F.count("*").alias("n_docs"), F.min("id").alias("keeper"), F.max("n").alias("n")).where(F.col("n_docs") >= _enough(F.col("n"), least)).select(key, "keeper")


def branches(lines: DataFrame, agree: float) -> DataFrame:
    """e, k, h: the branches h of each line (e, leaf, n, line), one for each of its segments k."""
    differ = (F.col("n") - F.ceil(F.col("n") * F.lit(agree) - F.lit(1e-9))).cast("int")
    rest = (F.col("n") - DEPTH).cast("int")
    # where any two lines of the leaf agree at enough places, the leaf is the branch
    m = F.when(differ >= rest, 1).otherwise(differ + 1)
    rows = lines.where(F.col("n") > LEAST_FIXED).select("e", "leaf", "line", rest.alias("rest"), m.alias("m"), (differ >= rest).alias("all"), F.explode(F.sequence(F.lit(0), m - 1)).alias("k"))
    start = lambda k: F.floor(k * F.col("rest") / F.col("m")).cast("int")
    first = lambda text, count: F.call_function("substring_index", text, F.lit(" "), count)  # noqa: E731  the last tokens where count is below 0
    segment = first(first(F.col("line"), start(F.col("k") + 1) + DEPTH), start(F.col("k")) - start(F.col("k") + 1))
    return rows.select("e", "k", F.when(F.col("all"), F.col("leaf")).otherwise(F.xxhash64("leaf", "k", segment)).alias("h"))


def groups(tables: Tables, lines: DataFrame, agree: float) -> DataFrame:
    """e, root: groups of the lines (e, leaf, n, line; different e), by links of lines that agree at `agree` of their places.

    Lines of a branch first meet two of it drawn by hash; then only those of branches that hold several groups meet.
    """
    every = tables.cut(branches(lines, agree))
    often = tables.cut(every.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    # most branches hold one line only, and need not travel
    entries = tables.cut(may_hold(every, F.col("h"), often, "h").where("may").drop("may"))
    tables.drop(every, often)
    drawn = [F.min(F.struct(F.xxhash64("e", "h", F.lit(k)).alias("key"), "e"))["e"] for k in range(2)]
    leaders = entries.groupBy("h").agg(F.count("*").alias("k"), F.array_distinct(F.array(*drawn)).alias("drawn")).where("k > 1").select("h", F.explode("drawn").alias("f"))

    def verify(pairs: DataFrame) -> DataFrame:
        a = lines.select(F.col("e").alias("a"), "leaf", "n", F.col("line").alias("la"))
        b = lines.select(F.col("e").alias("b"), F.col("leaf").alias("lb"), F.col("line").alias("lb_"))
        places = F.zip_with(F.split("la", " "), F.split("lb_", " "), lambda x, y: F.when(x == y, 1).otherwise(0))
        agreeing = F.aggregate(places, F.lit(0), lambda x, y: x + y)
        return tables.cut(pairs.join(a, "a").join(b, "b").where((F.col("leaf") == F.col("lb")) & (agreeing >= F.col("n") * agree - 1e-9)).select("a", "b"))

    pair = [F.least("e", "f").alias("a"), F.greatest("e", "f").alias("b")]
    met = tables.cut(entries.join(leaders, "h").where("e <> f").select(*pair).distinct())
    links = verify(met)
    known = tables.cut(entries.join(components(tables, links).select("e", "root"), "e", "left").withColumn("root", F.coalesce("root", "e")))
    split = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    before = Window.partitionBy("e").orderBy("k")
    known = tables.cut(known.join(split, "h").select("e", "h", "root", F.array(*[F.lag("h", i).over(before) for i in (1, 2, 3)]).alias("past")))
    # a pair that has met in one of the last three branches of both need not meet again
    other = known.select("h", F.col("e").alias("f"), F.col("root").alias("of"), F.col("past").alias("theirs"))
    rest = known.join(other, "h").where((F.col("e") < F.col("f")) & (F.col("root") != F.col("of")) & ~F.coalesce(F.arrays_overlap("past", "theirs"), F.lit(False))).select(*pair).distinct().join(met, ["a", "b"], "left_anti")
    more = verify(tables.cut(rest))
    return components(tables, links.unionByName(more)).select("e", "root")


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """e, root: the least entity that links reach, for entities with links. Least labels spread and labels of labels replace them, until none changes."""
    links = tables.cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = tables.cut(links.groupBy(F.col("a").alias("e")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = links.join(labels.select(F.col("e").alias("b"), "root"), "b").groupBy(F.col("a").alias("e")).agg(F.min("root").alias("near"))
        low = labels.select("e", "root").join(near, "e").select("e", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("e").alias("low"), F.col("root").alias("next"))
        moved = tables.cut(low.join(jump, "low", "left").select("e", F.least("low", F.coalesce("next", "low")).alias("root"), F.col("root").alias("was")))
        tables.drop(labels)
        labels = moved
        if moved.where("was <> root").isEmpty():
            tables.drop(links)
            return labels


def members(lines: DataFrame, agree: float) -> DataFrame:
    """e, grp: the lines (e, grp, k, n, line; different e; k lines are in the group) that agree with the template of their group.

    The template meets its lines as one row, of two tokens a place at most.
    """
    # each token of two lines has half of the votes, so both agree at all places
    two, more = lines.where("k = 2").select("e", "grp"), lines.where("k > 2")
    places = more.select("grp", "k", F.posexplode(F.split("line", " ")).alias("place", "token")).select("grp", "k", F.xxhash64("place", "token").alias("at"))
    # a tie of two tokens fixes either
    fixed = places.groupBy("grp", "at").agg(F.count("*").alias("votes"), F.max("k").alias("k")).where(2 * F.col("votes") >= F.col("k"))
    template = fixed.groupBy("grp").agg(F.collect_set("at").alias("fixed"))
    own = F.transform(F.split("line", " "), lambda token, place: F.xxhash64(place, token))
    same = F.size(F.array_intersect(own, "fixed"))
    return two.unionByName(more.join(template, "grp").where(same >= F.col("n") * agree - 1e-9).select("e", "grp"))


def drops_of(named: DataFrame, least: int = LEAST_DOCS, agree: float = AGREE) -> DataFrame:
    """id, print, drops: the numbers of the lines to drop, for the documents that have any; named has id, print, text.

    Lines that recur as they are go down the tree too, a row each, so that what agrees with them goes with them.
    """
    with Tables(named.sparkSession) as tables:
        keys = tables.cut(lines_of(named).drop("line"))
        equal = tables.cut(_recurring(keys, "same", least))
        # most lines recur nowhere, and need not travel
        marked = may_hold(keys, F.col("same"), equal, "same")
        met = marked.where("may").drop("may").join(equal, "same", "left")
        keys, every = tables.cut(met.unionByName(marked.where("not may").drop("may").withColumn("keeper", F.lit(None).cast("long")))), keys
        tables.drop(every)
        doc = F.struct("id", "print")
        # of several documents with the least id the one of the least print keeps the line
        own = keys.where("id = keeper")
        known = tables.cut(own.groupBy("same").agg(F.min("id").alias("id"), F.min("print").alias("print"), F.max("leaf").alias("leaf"), F.max("n").alias("n")))

        # leaves of several lines, one of them recurring or so many that they can recur together, and one document of each such line
        other, whole = (df.where(F.col("n") > LEAST_FIXED) for df in (keys.where("keeper is null"), known))
        both = other.select("leaf", "same", "print", "n", F.lit(False).alias("recurs")).unionByName(whole.select("leaf", "same", "print", "n", F.lit(True).alias("recurs")))
        ends = [f(c).alias(f"{name}_{c}") for c in ("same", "print") for name, f in (("low", F.min), ("high", F.max))]
        reached = both.groupBy("leaf").agg(*ends, F.count("*").alias("k"), F.max("n").alias("n"), F.max("recurs").alias("recurs"))
        together = (F.col("low_print") != F.col("high_print")) & (F.col("k") >= _enough(F.col("n"), least))
        reached = tables.cut(reached.where((F.col("low_same") != F.col("high_same")) & (F.col("recurs") | together)).select("leaf"))
        wanted = tables.cut(may_hold(other, F.col("leaf"), reached, "leaf").where("may").join(reached, "leaf", "left_semi").select("id", "print", "pos", "n", F.col("same").alias("e")))
        whole = tables.cut(whole.join(reached, "leaf", "left_semi").select(F.col("same").alias("e"), "id", "print", "n"))
        first = tables.cut(wanted.groupBy("e").agg(F.min(doc).alias("v")).select("e", "v.*").unionByName(whole.select("e", "id", "print")))
        texts = may_hold(named, F.xxhash64("id", "print"), first.select(F.xxhash64("id", "print").alias("key")), "key").where("may")
        lines = may_hold(lines_of(texts), F.col("same"), first, "e").where("may").select(F.col("same").alias("e"), "leaf", "n", "line")
        lines = tables.cut(lines.dropDuplicates(["e"]).join(first, "e", "left_semi"))

        roots = tables.cut(groups(tables, lines, agree))
        roots = roots.join(roots.groupBy("root").agg(F.count("*").alias("k")), "root")
        grouped = tables.cut(lines.join(roots, "e").select("e", F.col("root").alias("grp"), "k", "n", "line"))
        member = tables.cut(members(grouped, agree))
        found = tables.cut(wanted.join(member, "e").select("id", "print", "pos", "n", "grp"))
        # a line that recurs as it is makes its group recur
        whole = tables.cut(whole.join(member, "e"))
        each = found.groupBy("grp", "print").agg(F.min("id").alias("id"), F.max("n").alias("n")).select("grp", doc.alias("keeper"), "n", F.lit(1).alias("k"))
        each = each.unionByName(whole.select("grp", doc.alias("keeper"), "n", _enough(F.col("n"), least).alias("k")))
        recurring = each.groupBy("grp").agg(F.sum("k").alias("k"), F.min("keeper").alias("keeper"), F.max("n").alias("n"))
        recurring = tables.cut(recurring.where(F.col("k") >= _enough(F.col("n"), least)).select("grp", "keeper"))
        alike = found.join(recurring, "grp").where(doc != F.col("keeper")).select("id", "print", "pos")

        groups_keep = whole.join(recurring, "grp").select(F.col("e").alias("same"), F.col("keeper").alias("theirs"))
        kept = known.select("same", doc.alias("holder")).join(groups_keep, "same", "left").select("same", F.coalesce("theirs", "holder").alias("holder"))
        equals = keys.where("id <> keeper").unionByName(own.join(kept, "same").where(doc != F.col("holder")).select(*keys.columns))
        return tables.cut(equals.select("id", "print", "pos").unionByName(alike).groupBy("id", "print").agg(F.collect_set("pos").alias("drops")), keep=True)


def drop_templates(docs: DataFrame, least: int = LEAST_DOCS, agree: float = AGREE) -> DataFrame:
    """All columns with the text shortened, and n_lines, n_dropped.

    Null texts have no lines and stay null; an empty text has one. Copies of one text count as one document; repeated
    rows are treated alike. A null doc_id is above all others; of documents with one doc_id, null too, one text keeps the line. Lines without tokens always stay. Lines of nothing but
    numbers recur only as they are. Short lines recur in `least` documents, those of
    LONG_TOKENS tokens and more in LEAST_LONG; lines of up to LEAST_FIXED tokens only as they are. Line breaks are \\n; the kept lines are joined by it. Columns named
    n_lines or n_dropped are replaced; other columns come back, whatever their names.
    """
    docs = docs.drop("n_lines", "n_dropped")
    number = lambda c, name: c.cast("long").alias(name)
    a, b, k = fresh(docs, "id", "print", "key")
    named = docs.withColumns({a: F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), b: F.xxhash64("text")})
    drops = drops_of(named.select(F.col(a).alias("id"), F.col(b).alias("print"), "text"), least, agree)
    marked = may_hold(named, F.xxhash64(a, b), drops.select(F.xxhash64("id", "print").alias(k)), k)
    may = marked.columns[-1]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    clear = marked.where(~F.col(may)).select(*docs.columns, number(n_lines, "n_lines"), number(F.lit(0), "n_dropped"))

    theirs, parts = fresh(marked, "drops", "parts")
    some = marked.where(F.col(may)).join(drops.select(F.col("id").alias(a), F.col("print").alias(b), F.col("drops").alias(theirs)), [a, b], "left").withColumn(parts, F.split("text", "\n"))
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(theirs))
    kept = F.array_join(F.transform(rest, lambda i: F.get(F.col(parts), i)), "\n")
    text = F.when(F.col(theirs).isNull(), F.col("text")).otherwise(kept).alias("text")
    changed = some.select(*[text if c == "text" else F.col(c) for c in docs.columns], number(n_lines, "n_lines"), number(F.coalesce(F.array_size(theirs), F.lit(0)), "n_dropped"))
    return clear.unionByName(changed)


def op10_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what is left of their text; those of which no word is left go. Null and empty texts stay. All columns come back."""
    out = drop_templates(docs).where((F.col("n_dropped") == 0) | F.regexp("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
