"""Spelling variants: words one edit apart, found by comparing tiles of code-point matrices.

A tile is two blocks of words as padded matrices of code points, one aligned at the front
and one at the back. Of two different words, one edit (an inserted, deleted or replaced code
point) is all between them exactly where the lengths of their common prefix and common
suffix together reach the longer length minus one.

Blocks are compared only where such a pair can be: with m the shorter length, two words one
edit apart share their first m // 2 or their last m - m // 2 code points. So a word goes to
the groups of its own front and back half, as the shorter (or equal) and as the longer word,
and a group of any size is cut into blocks of about ``BLOCK`` words, of which every two are
one tile. A pair is counted in the group of the front half if it shares that, else in that
of the back half, so once. Tiles return the number of near words and the best of them for
each word, never pairs.

Defined results: a null text has no words; a null id counts as an empty one; repeated rows
count again; the best of several near words is that of largest n, then the smallest in
code-point order; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage

from .crc_sql import CRC, crc32, latin_bytes
from .vector_text import ranges, small

#: Words of a block, on average; code points compared at a time.
BLOCK, CELLS = 1024, 1 << 22
#: Of runs by a hash of document and run, one in so many loses a code point.
EDITED = 199
SHORTEST, LEAST, RATIO = 6, 5, 5
#: Distinct words counted in a task before it hands them on.
HELD = 200_000


def edited_words(docs: DataFrame, shortest: int = SHORTEST, one_in: int = EDITED) -> DataFrame:
    """(word, n): runs of letters of at least ``shortest`` code points, ASCII capitals
    lower-cased, where hashes choose runs that lose one code point."""
    # Latin-1 has one byte for each letter of a run; what is beyond becomes a mark
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % shortest)

    def table(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in small(batches):
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                begin = zlib.crc32(f"{'' if d is None else d}:".encode())
                for word, n in Counter(run.findall(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield table(held)
                    held = {}
        yield table(held)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def halves(words: DataFrame) -> DataFrame:
    """(m, side, key, word, n): for each word its half keys; side 0 is the front."""
    size = F.length("word")
    m = F.explode(F.when(size > 0, F.array(size, size - 1)).otherwise(F.array(size))).alias("m")
    d = words.select("word", "n", m)
    front = F.struct(F.lit(0).alias("side"), F.xxhash64(F.lit(0), "m", F.expr("substring(word, 1, m div 2)")).alias("key"))
    back = F.struct(F.lit(1).alias("side"), F.xxhash64(F.lit(1), "m", F.expr("right(word, m - m div 2)")).alias("key"))
    return d.select("m", F.explode(F.array(front, back)).alias("k"), "word", "n").select("m", "k.side", "k.key", "word", "n")


def tiles(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(m, side, key, i, j, own, word, n): each block of a group once for every tile it is in.

    A group of one word, or of longer words only, has no tile.
    """
    group = ["m", "side", "key"]
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short"))
    sizes = sizes.filter("size > 1 AND short > 0").select(*group, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    d = keyed.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "word"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


def matrices(words: list[str], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words of m or m + 1, aligned at the front and at the back, and which are longer."""
    longer = np.array([len(w) for w in words]) > m
    front, back = (np.frombuffer("".join(pad(w, m + 1) for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), m + 1).copy() for pad in (str.ljust, str.rjust))
    front[~longer, m] = back[~longer, 0] = 0xFFFFFFFF  # no code point
    return front, back[:, ::-1], longer


def compare(words: list[str], groups: np.ndarray, own: np.ndarray, tile: np.ndarray, side: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows p, q that are one edit apart, of rows in groups that stand together.

    ``tile`` is whether a group compares two different blocks, told apart by ``own``.
    """
    front, back, longer = matrices(words, m)
    ends = np.searchsorted(groups, groups, "right")
    count = ends - np.arange(len(words)) - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.concatenate([[0], np.cumsum(count)])
    at, most = 0, max(1, CELLS // (m + 1))
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        p, q = np.repeat(np.arange(at, to), count[at:to]), ranges(np.arange(at + 1, to + 1), count[at:to])
        use = ~(longer[p] & longer[q]) & (~tile[p] | (own[p] != own[q]))
        p, q = p[use], q[use]
        # words of a group differ, so there is a first difference
        prefix = (front[p] != front[q]).argmax(1)
        suffix = (back[p] != back[q]).argmax(1)
        near = (prefix + suffix >= m + (longer[p] | longer[q]) - 1) & ((prefix >= m // 2) == (side[p] == 0))
        found.append((p[near], q[near]))
        at = to
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): how many words are one edit away, and the best, as (n, word).

    ``words`` has distinct words and n.
    """

    def tile_rows(rows: pd.DataFrame) -> pa.RecordBatch:
        """For each row of whole tiles that has near words their number and the best."""
        cols: list[list] = [[], [], [], []]
        for m, part in rows.groupby("m", sort=False):
            groups = part.groupby(["side", "key", "i", "j"], sort=False).ngroup().to_numpy()
            n, texts = part["n"].to_numpy(), part["word"].to_numpy(dtype=object)
            p, q = compare(list(texts), groups, part["own"].to_numpy(), (part["i"] != part["j"]).to_numpy(), part["side"].to_numpy(), int(m))
            if not len(p):
                continue
            one, other = np.concatenate([p, q]), np.concatenate([q, p])
            met = np.unique(other)
            rank = np.empty(len(texts), np.int64)
            rank[met[np.argsort(texts[met], kind="stable")]] = np.arange(len(met))
            order = np.lexsort((rank[other], -n[other], one))
            one, other = one[order], other[order]
            at = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
            for out, new in zip(cols, (texts[one[at]], np.diff(np.r_[at, len(one)]), n[other[at]], texts[other[at]])):
                out.extend(new.tolist())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "n_near", "most", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pd.DataFrame | None = None
        for batch in batches:
            rows = batch.to_pandas()
            rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
            last = (rows[["m", "side", "key", "i", "j"]] == rows[["m", "side", "key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield tile_rows(rows[~last])
            left = rows[last]
        if left is not None and len(left):
            yield tile_rows(left)

    tile = ["m", "side", "key", "i", "j"]
    dealt = tiles(halves(words), block).repartition(*tile).sortWithinPartitions(*tile)
    part = dealt.mapInArrow(run, "word string, n_near bigint, most bigint, name string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "name")).alias("best")
    return part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.name").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word when forms are followed.

    Steps double each round; forms must not lead back to a word.
    """
    d = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = d.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = d.join(ahead, "root", "left")
        d = cut_lineage(moved.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("went")))
        if not d.agg(F.bool_or("went")).first()[0]:
            return d.select("word", "root")
        d = d.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the form of a word is its best near word, if that
    is at least ``ratio`` times as frequent; the root is the end of its forms.
    """
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words, block)
    stands = F.col("best.n") >= F.col("n") * ratio
    d = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(stands, F.col("best.word")).alias("form"), F.when(stands, F.col("best.n")).alias("form_n")))
    ends = roots(d.filter("form IS NOT NULL"))
    return d.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Variants among the words of documents that occur at least ``least`` times."""
    return variants(edited_words(docs).filter(F.col("n") >= least))


#: The same in DuckDB, by words less one code point.
SQL = rf"""WITH RECURSIVE {CRC}, r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS raw FROM documents),
  c AS (SELECT d, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r WHERE length(raw) >= {SHORTEST} GROUP BY 1, 2),
  h AS (SELECT w, n, {crc32(latin_bytes("d || ':' || w"))} AS h FROM c, crc),
  e AS (SELECT CASE WHEN h % {EDITED} = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, n FROM h),
  words AS (SELECT w, sum(n)::BIGINT AS n FROM e WHERE length(w) >= {SHORTEST} GROUP BY 1 HAVING sum(n) >= {LEAST}),
  less AS (SELECT w, i, left(w, i - 1) || substr(w, i + 1) AS k FROM words, range(1, length(w) + 1) x(i)),
  pairs AS (SELECT a.w, b.w AS o FROM less a JOIN less b ON a.i = b.i AND a.k = b.k AND a.w <> b.w UNION SELECT l.w, l.k FROM less l JOIN words ON words.w = l.k UNION SELECT l.k, l.w FROM less l JOIN words ON words.w = l.k),
  best AS (SELECT p.w, p.o, words.n AS o_n, count(*) OVER (PARTITION BY p.w) AS n_near FROM pairs p JOIN words ON words.w = p.o QUALIFY row_number() OVER (PARTITION BY p.w ORDER BY words.n DESC, p.o) = 1),
  f AS (SELECT words.w AS word, CASE WHEN o_n >= {RATIO} * n THEN o END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= {RATIO} * n THEN o_n END AS form_n FROM words LEFT JOIN best USING (w)),
  up AS (SELECT word, word AS root, form AS ahead FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.ahead)
  SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.ahead IS NULL"""
