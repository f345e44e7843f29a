"""Prefix trie of conversations by collapsing whole sequences.

A node is a distinct sequence of first turns. Equal conversations are collapsed to one
weighted sequence first, whose list of conversations that end there is kept in pieces of a
bounded number of ids. Sequences that are proper prefixes of another one drop out by an
anti-join; what is left are the leaves. Weights are then added up over the prefixes of
sequences, and what a node has below it over the paths to leaves, where each node is owned
by one leaf (the smallest that passes it), so nothing is counted twice.

Texts stay where they are: a turn is 128 bits of hash and a length, a prefix is the sum of
the hashes of its turns, each with its place, so it comes from running sums; the texts of
nodes are joined on at the end, by conversation and place (``node_turns``). Every step is a
join or an aggregate of rows of turns; a long conversation is summed in chunks, and a node
that many conversations share is combined before the shuffle.

Defined results: null roles and texts are empty; turns are in order of turn (null first),
then role, then the first 32 characters of the text, then its hash; repeated rows are turns
of their own; rows without an id are no conversation; ``c - c % 5`` of a negative id rounds
towards zero; an empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage
from faultspark.functions.ordering import with_position, with_running

from .crc_sql import CRC, crc32, latin_bytes

#: Conversations c - c % FAMILY lend their first crc32(c) % HEADS turns.
FAMILY, HEADS = 5, 9
#: Ids of a piece of an end list.
PIECE = 4096
NODE = ["depth", "s1", "s2"]


def _wide(c: Column | str) -> Column:
    """Sums of 64-bit hashes don't overflow."""
    return F.col(c).cast("decimal(30,0)") if isinstance(c, str) else c.cast("decimal(30,0)")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, bytes) of (conv_id, turn, role, text), and place by place."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    t = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 32).alias("front"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), text, role).alias("h2"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    return with_position(t, ["conv_id"], ["turn", "role", "front", "h1", "h2"], "pos").select("conv_id", "pos", "h1", "h2", "bytes")


def rebuild(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and their turns (conv_id, pos, from_conv, from_pos, h1, h2,
    bytes) when the first h of each are replaced by those of the head of its family.

    ``turns`` are numbered; h is crc32 of the id modulo ``heads``, so a head lends a few
    turns to each of a few others.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base, "h": h})
    lent = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(lent, "base").filter("pos < h").select(
        "conv_id", "pos", F.col("base").alias("from_conv"), F.col("pos").alias("from_pos"), "h1", "h2", "bytes")
    length = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = convs.join(length, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    own = turns.join(taken, "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), F.col("conv_id").alias("from_conv"), F.col("pos").alias("from_pos"), "h1", "h2", "bytes")
    return convs.select("conv_id"), first.unionByName(own)


def sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences (conv_id, depth, s1, s2, n), where conv_id is the smallest
    conversation that is one, and members (conv_id, member)."""
    place = turns.select("conv_id", _wide(F.xxhash64("pos", "h1", "h2")).alias("s1"), _wide(F.xxhash64("h2", "h1", "pos")).alias("s2"))
    whole = place.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    whole = convs.join(whole, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"), *[F.coalesce(F.col(s).cast("decimal(38,0)"), zero).alias(s) for s in ("s1", "s2")])
    whole = cut_lineage(whole)
    seq = whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    members = whole.join(seq.select(*NODE, F.col("conv_id").alias("first")), NODE).select(F.col("first").alias("conv_id"), F.col("conv_id").alias("member"))
    return cut_lineage(seq.select("conv_id", *NODE, "n")), members


def end_lists(members: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv_id, from, ids): the conversations of each sequence in ascending order, in pieces."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for batch in batches:
            for c, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c != key or len(held) == size:
                    done += [(key, held)] if held else []
                    key, held = c, []
                held.append(m)
                if len(done) == 1024:
                    yield table(done)
                    done = []
        yield table(done + ([(key, held)] if held else []))

    def table(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([h[0] for _, h in done], pa.int64()), pa.array([h for _, h in done], pa.list_(pa.int64()))], ["conv_id", "from", "ids"])

    ordered = members.repartitionByRange("conv_id", "member").sortWithinPartitions("conv_id", "member")
    return ordered.mapInArrow(pack, "conv_id bigint, from bigint, ids array<bigint>")


def ends_digest(lists: DataFrame) -> DataFrame:
    """(conv_id, ends_sha256) of the whole lists; a task sees one piece at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for batch in batches:
            out = []
            for c, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                text = ",".join(map(str, ids)).encode()
                if h is not None and c == key:
                    h.update(b"," + text)
                    continue
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = c, hashlib.sha256(text)
            yield table(out)
        if h is not None:
            yield table([(key, h.hexdigest())])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["conv_id", "ends_sha256"])

    return lists.repartition("conv_id").sortWithinPartitions("conv_id", "from").mapInArrow(digest, "conv_id bigint, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    sequence) and end lists (conv_id, from, ids).

    conv_id is the smallest conversation that begins with the node's turns; ``sequence`` is
    the conv_id of the end lists of conversations that are just these turns, else null.
    """
    seq, members = sequences(convs, turns)
    # prefixes of one conversation for each distinct sequence
    kept = turns.join(seq.select("conv_id"), "conv_id", "left_semi").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "bytes", _wide(F.xxhash64("pos", "h1", "h2")).alias("v1"), _wide(F.xxhash64("h2", "h1", "pos")).alias("v2"))
    run = with_running(kept, ["conv_id"], ["depth"], {"s1": F.col("v1"), "s2": F.col("v2")})
    run = cut_lineage(run.select("conv_id", "depth", "bytes", "v1", "v2", *[F.col(s).cast("decimal(38,0)").alias(s) for s in ("s1", "s2")]))
    inner = run.select((F.col("depth") - 1).alias("depth"), *[(F.col(s) - F.col(v)).cast("decimal(38,0)").alias(s) for s, v in (("s1", "v1"), ("s2", "v2"))]).distinct()
    leaves = seq.join(inner, NODE, "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    paths = run.join(seq.select("conv_id", "n"), "conv_id").join(leaves, "conv_id", "left").select("conv_id", *NODE, "bytes", "n", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("first"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("owner"), F.count_if("leaf").alias("n_leaves"))
    nodes = cut_lineage(nodes)
    # along each path to a leaf: what its own nodes save, from a node to the end
    d = paths.filter("leaf").select("conv_id", *NODE).join(nodes, NODE).withColumn("owns", F.col("owner") == F.col("conv_id"))
    d = d.withColumn("saves", F.when(F.col("owns"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).cast("decimal(38,0)"))
    d = with_running(d, ["conv_id"], ["depth"], {"so_far": F.col("saves")}, {"all_saved": "so_far"})
    d = cut_lineage(d.select("conv_id", *NODE, "first", "n_convs", "n_leaves", "owns", (F.col("all_saved") - F.col("so_far") + F.col("saves")).alias("below")))
    # a node's parent and whether it owns its next node come from the same path
    step = d.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent"))
    ahead = d.filter("owns").select("conv_id", (F.col("depth") - 1).alias("depth"), F.lit(1).alias("child"))
    full = d.join(step, ["conv_id", "depth"], "left").join(ahead, ["conv_id", "depth"], "left")
    got = full.groupBy(*NODE).agg(F.min("first").alias("conv_id"), F.max(F.when(F.col("owns"), F.col("parent"))).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
                                  F.count("child").alias("n_children"), F.max("n_leaves").alias("n_leaves"), F.sum("below").cast("bigint").alias("saved_tokens"))
    got = cut_lineage(got.join(seq.select(*NODE, F.col("conv_id").alias("sequence")), NODE, "left").drop("s1", "s2"))
    top = got.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    everyone = seq.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.when(F.col("depth") == 0, F.col("conv_id"))).alias("sequence")).filter("conv_id IS NOT NULL")
    nothing = F.lit(0).cast("bigint")
    root = everyone.join(top).select(  # one-row tables
        "conv_id", nothing.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).cast("bigint").alias("n_leaves"), F.coalesce("saved_tokens", nothing).alias("saved_tokens"), "sequence")
    first = root.select(F.col("conv_id").alias("root_id"))
    below = got.join(first).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_id")).otherwise(F.col("parent_conv_id")))  # one-row table
    return below.select(*root.columns).unionByName(root), end_lists(members)


def node_turns(nodes: DataFrame, rebuilt: DataFrame, numbered: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn.

    ``numbered`` is (conv_id, pos, role, text); the root has neither.
    """
    at = rebuilt.select("conv_id", (F.col("pos") + 1).alias("depth"), "from_conv", "from_pos")
    text = numbered.select(F.col("conv_id").alias("from_conv"), F.col("pos").alias("from_pos"), "role", "text")
    return nodes.join(at, ["conv_id", "depth"], "left").join(text, ["from_conv", "from_pos"], "left").drop("from_conv", "from_pos")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, with a digest of who ends at each node."""
    convs, turns = rebuild(cut_lineage(numbered_turns(conversations)))
    nodes, lists = trie(convs, cut_lineage(turns))
    ends = ends_digest(lists).withColumnRenamed("conv_id", "sequence")
    return nodes.join(ends, "sequence", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))).drop("sequence")


#: The same in DuckDB, where a node is the list of its turns.
SQL = f"""WITH {CRC}, t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
    FROM conversations WHERE conv_id IS NOT NULL),
  conv AS (SELECT c, list(turn ORDER BY pos) AS own, {crc32(latin_bytes('c::VARCHAR'))} % 9 AS h FROM t, crc GROUP BY c, crc.t),
  r AS (SELECT a.c, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) AS s FROM conv a LEFT JOIN conv b ON b.c = a.c - a.c % 5),
  p AS (SELECT c, d, s[1:d] AS node, len(s) = d AS done FROM r, range(0, len(s) + 1) x(d)),
  n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (done), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
  k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
  m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(n.node[d].text) ELSE 0 END AS saves FROM n LEFT JOIN k ON k.node = n.node),
  b AS (SELECT node[1:x.i] AS node, sum(saves)::BIGINT AS saved_tokens, count_if(n_children = 0)::BIGINT AS n_leaves FROM m, range(0, d + 1) x(i) GROUP BY 1)
  SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves, b.saved_tokens, m.ends_sha256
  FROM m JOIN b ON b.node = m.node LEFT JOIN n up ON m.d > 0 AND up.node = m.node[1:m.d - 1]"""
