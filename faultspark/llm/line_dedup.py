"""Removal of repeated runs of lines, by a suffix array over the lines of all documents.

The corpus is the sequence of its lines in order of (doc_id, text hash, line); lines
without a word are no part of it, and no run crosses a document. A line is removed if it
lies in a run of consecutive lines with ``MIN_WORDS`` words or more that also occurs
earlier in the corpus. The first copy of every run stays.

Prefix doubling: after round k the suffixes that are not alone are ordered by their first
2**k lines; their ranks are the places of distinct pairs (rank, rank 2**k lines further
on) in a range-partitioned sort. A suffix that is alone at a level can start no repeated
run of that length and drops out, so only repeated lines take part at all. A run of
MIN_WORDS words is a union of shortest runs that reach MIN_WORDS words, forward from a
line or back from one, and these have MIN_WORDS lines at most. So the array is needed to
that depth only. Suffixes that share their first L lines are an interval of the array,
known by the ranks of two overlapping blocks; its earliest member keeps the lines, all
others lose them. Only DataFrame functions are used; hot lines meet in sums that combine
before the shuffle, or in joins, which adaptive execution splits.

Defined results: rows equal in doc_id and text are one document that was read twice and
get the same result; a null doc_id comes first; a null text has no line; documents that
lose every line keep their row with an empty text; an empty table gives an empty table;
columns named like the added ones are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from faultspark.functions.iterate import cut_lineage

from .quality_rules import squeezed, words_of

#: Words from which a run of lines counts as a passage.
MIN_WORDS = 50
NEW = ["n_lines", "n_removed_lines", "removed_runs", "clean_text"]


def _key() -> list[Column]:
    """Place of a document in the corpus; the hash tells apart rows that share an id."""
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")]


def worded_lines(docs: DataFrame) -> DataFrame:
    """(d, t, i, p, a, b, w): lines with a word. p is the place among all lines of the
    text, i among those with a word; a and b hash the line to 128 bits, w counts its words."""
    told = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, p: F.struct(p.alias("p"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.size(words_of(x)).alias("w")))
    return docs.select(*_key(), F.posexplode(F.filter(told, lambda x: x["w"] > 0)).alias("i", "l")).select("d", "t", "i", "l.p", "l.a", "l.b", "l.w")


def _ranked(places: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rank): values of ``by`` that occur twice or more, numbered in their order."""
    groups = places.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by)
    return cut_lineage(groups.repartitionByRange(*by).sortWithinPartitions(*by).select(*by, F.monotonically_increasing_id().alias("rank")))


def first_level(docs: DataFrame) -> DataFrame:
    """(d, t, i, p, w, rank): lines that occur twice or more, ranked by their hash."""
    lines = cut_lineage(worded_lines(docs))
    return cut_lineage(lines.join(_ranked(lines, ["a", "b"]), ["a", "b"]).select("d", "t", "i", "p", "w", "rank").dropDuplicates(["d", "t", "i"]))


def suffix_levels(first: DataFrame, depth: int) -> DataFrame:
    """(d, t, i, k, rank): the order of suffixes by their first 2**k lines.

    A suffix is there if it isn't alone with these lines. k goes up to the level of
    which two overlapping blocks span ``depth`` lines, or until all suffixes are alone.
    """
    level = first.select("d", "t", "i", "rank")
    out, k = level.withColumn("k", F.lit(0)), 0
    while 2 ** (k + 1) <= depth:
        pairs = cut_lineage(level.withColumnRenamed("rank", "prev").join(level.select("d", "t", (F.col("i") - 2**k).alias("i"), F.col("rank").alias("next")), ["d", "t", "i"]))
        k += 1
        level = cut_lineage(pairs.join(_ranked(pairs, ["prev", "next"]), ["prev", "next"]).select("d", "t", "i", "rank"))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    return out


def shortest_windows(first: DataFrame, min_words: int) -> DataFrame:
    """(d, t, i, e): for each line the shortest runs of repeated lines of ``min_words`` words
    that begin or end with it, as first and last line number."""
    s = first.select("d", "t", "i", "w", (F.col("i") - F.row_number().over(W.partitionBy("d", "t").orderBy("i"))).alias("s"))
    parts = ["d", "t", "s"]
    upto = W.partitionBy(*parts).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("upto", F.sum("w").over(upto)).withColumn("before", F.col("upto") - F.col("w")).withColumn("start", F.min("i").over(upto))
    # a line has a word, so both sums rise: the frames below end at the line that completes the words
    s = s.withColumn("g", F.max("i").over(W.partitionBy(*parts).orderBy("upto").rangeBetween(W.unboundedPreceding, -min_words)))
    down = W.partitionBy(*parts).orderBy(F.col("down"))
    s = s.withColumn("down", -F.col("before"))
    s = s.withColumn("f", F.min("i").over(down.rangeBetween(W.unboundedPreceding, -min_words)))
    to_end = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumn("end", F.max("i").over(to_end)).withColumn("end_words", F.max("upto").over(to_end))
    ahead = F.coalesce(F.col("f") - 1, F.when(F.col("end_words") - F.col("before") >= min_words, F.col("end")))
    back = F.coalesce(F.col("g") + 1, F.when(F.col("upto") >= min_words, F.col("start")))
    both = F.array(F.struct(F.col("i").alias("i"), ahead.alias("e")), F.struct(back.alias("i"), F.col("i").alias("e")))
    return s.select("d", "t", F.explode(F.array_distinct(both)).alias("x")).select("d", "t", "x.i", "x.e").filter("i IS NOT NULL AND e IS NOT NULL").distinct()


def later_copies(first: DataFrame, min_words: int) -> DataFrame:
    """(d, t, i, e): shortest windows of which an earlier copy exists."""
    windows = cut_lineage(shortest_windows(first, min_words))
    depth = windows.agg(F.max(F.col("e") - F.col("i") + 1)).first()[0] or 1
    ranks = cut_lineage(suffix_levels(first, depth))
    size = F.col("e") - F.col("i") + 1
    w = windows.withColumn("k", F.length(F.bin(size)) - 1).withColumn("j", F.col("e") + 1 - F.expr("shiftleft(1, k)"))
    w = (w.join(ranks.withColumnRenamed("rank", "r1"), ["d", "t", "i", "k"])
         .join(ranks.select("d", "t", F.col("i").alias("j"), "k", F.col("rank").alias("r2")), ["d", "t", "j", "k"]))
    w = cut_lineage(w.select("d", "t", "i", "e", size.alias("size"), "r1", "r2"))
    # an interval of the array: suffixes that share their first ``size`` lines
    found = w.groupBy("size", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "i")).alias("first")).filter("n > 1").drop("n")
    return w.join(cut_lineage(found), ["size", "r1", "r2"]).filter(F.struct("d", "t", "i") > F.col("first")).select("d", "t", "i", "e")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, n_removed_lines, runs): maximal runs of lines to remove, by place in the text."""
    first = first_level(docs)
    copies = later_copies(first, min_words)
    order = W.partitionBy("d", "t").orderBy("i", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    c = copies.withColumn("new", (F.coalesce(F.col("i") > reach + 1, F.lit(True))).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = c.groupBy("d", "t", "run").agg(F.min("i").alias("i"), F.max("e").alias("e"))
    at = first.select("d", "t", "i", "p")
    runs = runs.join(at.withColumnRenamed("p", "p1"), ["d", "t", "i"]).join(at.select("d", "t", F.col("i").alias("e"), F.col("p").alias("p2")), ["d", "t", "e"])
    return runs.groupBy("d", "t").agg(F.sum(F.col("e") - F.col("i") + 1).alias("n"), F.array_sort(F.collect_list(F.struct(F.col("p1").alias("first"), F.col("p2").alias("last")))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds n_lines (with a word), n_removed_lines, removed_runs and clean_text."""
    runs = repeated_runs(docs, min_words).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("n").alias("__n"), F.col("runs").alias("__r"))
    keep = [c for c in docs.columns if c not in NEW]
    d, t = _key()
    k = docs.select(*keep, d.alias("__kd"), t.alias("__kt"))
    j = k.join(runs, (k["__kd"] == runs["__d"]) & (k["__kt"] == runs["__t"]), "left").withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    r = F.col("__r")
    # what lies between the removed runs
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: F.slice(
        F.col("__lines"), F.coalesce(F.get(r, i - 1)["last"] + 1, F.lit(0)) + 1,
        F.coalesce(F.get(r, i)["first"], F.size("__lines")) - F.coalesce(F.get(r, i - 1)["last"] + 1, F.lit(0)))))
    return j.select(
        *keep, F.size(F.filter("__lines", lambda x: squeezed(x) != "")).cast("bigint").alias("n_lines"), F.coalesce(F.col("__n"), F.lit(0)).cast("bigint").alias("n_removed_lines"),
        F.coalesce(r, F.array().cast("array<struct<first:int,last:int>>")).alias("removed_runs"),
        F.when(r.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias("clean_text"))


#: States the rule plainly: every shortest window of lines is spelled out and looked up.
SQL = f"""
WITH l AS (SELECT coalesce(doc_id, -9223372036854775808) AS d, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l),
n AS (SELECT d, p, line, w, row_number() OVER (PARTITION BY d ORDER BY p) AS i, sum(w) OVER (PARTITION BY d ORDER BY p) AS upto FROM w WHERE w > 0),
fwd AS (SELECT a.d, a.i, min(b.i) AS e FROM n a JOIN n b ON a.d = b.d AND b.i >= a.i AND b.upto - a.upto + a.w >= {MIN_WORDS} AND b.i < a.i + {MIN_WORDS} GROUP BY ALL),
bwd AS (SELECT a.d, max(b.i) AS i, a.i AS e FROM n a JOIN n b ON a.d = b.d AND b.i <= a.i AND a.upto - b.upto + b.w >= {MIN_WORDS} AND b.i > a.i - {MIN_WORDS} GROUP BY a.d, a.i),
win AS (SELECT * FROM fwd UNION SELECT * FROM bwd),
spelt AS (SELECT w.d, w.i, w.e, string_agg(n.line, chr(10) ORDER BY n.i) AS key FROM win w JOIN n ON n.d = w.d AND n.i BETWEEN w.i AND w.e GROUP BY ALL),
later AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d, i) AS nth FROM spelt),
gone AS (SELECT DISTINCT n.d, n.i FROM later w JOIN n ON n.d = w.d AND n.i BETWEEN w.i AND w.e WHERE nth > 1),
runs AS (SELECT d, min(p) AS p1, max(p) AS p2 FROM (SELECT g.d, g.i, n.p, g.i - row_number() OVER (PARTITION BY g.d ORDER BY g.i) AS s FROM gone g JOIN n ON n.d = g.d AND n.i = g.i) GROUP BY d, s),
left_over AS (SELECT w.d, string_agg(w.line, chr(10) ORDER BY w.p) AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.d = w.d AND w.p BETWEEN r.p1 AND r.p2) GROUP BY w.d)
SELECT doc_id, (SELECT count(*) FROM n WHERE n.d = doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.d = doc_id) AS n_removed_lines,
       coalesce((SELECT string_agg(p1 || '-' || p2, ',' ORDER BY p1) FROM runs r WHERE r.d = doc_id), '') AS removed_runs, coalesce(t, '') AS clean_text
FROM documents LEFT JOIN left_over ON doc_id = d
"""
