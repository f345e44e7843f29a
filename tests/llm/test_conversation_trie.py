"""The prefix trie against a plain one, built turn by turn."""

import functools
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultspark.llm import conversation_trie as T
from tests.conftest import FOLDER

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    out = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + (-c) % 5  # towards zero
        out[c] = tuple(conv.get(base, [])[:h] + own[h:])
    return out


def plain(rows):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, s in sorted(rebuilt(rows).items()):
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)

    @functools.cache
    def below(n):
        own = (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0
        got = [below(k) for k in kids[n]]
        return sum(a for a, _ in got) or 1, own + sum(b for _, b in got)

    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), *below(n), hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items())


def got(frame):
    out = T.conversation_trie(frame).select(COLUMNS).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in out)


def odd_turns():
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (2, 1, "", "b"), (2, 1, "", "b"), (3, None, "user", "first"), (3, 0, "user", None), (3, 0, "user", ""),
            (4, 5, "x", "ü\U0001f600"), (4, 5, "x", "ü"), (None, 0, "user", "lost"), (None, None, None, None), (-7, 0, "user", "a"), (-7, 1, "user", "z"), (-5, 0, "u", "m"), (0, 0, None, None)]
    rows += [(c, i, "user", f"same {i}") for c in range(10, 40) for i in range(4)]  # a group of equal ones, and their heads
    rows += [(50, i, "bot", f"long {i}") for i in range(180)] + [(53, i, "bot", f"long {i}") for i in range(170)]
    rows += [(60, 0, "bot", "very long " * 20_000), (61, 0, "bot", "very long " * 20_000)]
    return rows + [(c, i, "user" if i % 2 == 0 else "bot", f"{(c // 3) % 4 if i < 3 else c % 11} {i}") for c in range(100, 160) for i in range(c % 9)]


@pytest.fixture(scope="module")
def odd_conversations(spark):
    d = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string")
    clash = ["pos", "h", "n", "base", "depth", "s1", "s2", "first", "owner", "leaf", "sequence", "member", "bytes", "h1", "__chunk"]
    return d.select("*", *[F.lit(1).alias(c) for c in clash]).repartition(3)


def test_nodes_of_the_whole_table(spark):
    d = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    assert got(d) == plain([tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()])


def test_nulls_ties_copies_and_long_conversations(odd_conversations):
    assert got(odd_conversations) == plain(odd_turns())


def test_one_conversation_is_summed_in_chunks(odd_conversations, tiny_chunks):
    assert got(odd_conversations) == plain(odd_turns())


def test_no_conversations(odd_conversations):
    assert T.conversation_trie(odd_conversations.limit(0)).count() == 0


def test_only_a_root(spark):
    # crc32 of 1 and of 2 takes more turns than they have, and there is no conversation 0
    ids = [c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 0]
    rows = [(c, 0, "user", "x") for c in ids]
    assert got(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain(rows)
    assert len(plain(rows)) == 1


def test_end_lists_in_pieces(spark):
    members = spark.range(1000).select(F.expr("id % 3 div 2").alias("conv_id"), F.col("id").alias("member")).repartition(5)
    lists = T.end_lists(members, size=7)
    assert lists.agg(F.max(F.size("ids"))).first()[0] == 7
    want = {k: hashlib.sha256(",".join(str(i) for i in range(1000) if i % 3 // 2 == k).encode()).hexdigest() for k in (0, 1)}
    assert {r["conv_id"]: r["ends_sha256"] for r in T.ends_digest(lists).collect()} == want


def test_texts_of_nodes(odd_conversations):
    d = odd_conversations.filter("conv_id >= 100")
    numbered = T.numbered_turns(d)
    convs, turns = T.rebuild(numbered)
    nodes, _ = T.trie(convs, turns)
    # places of a conversation whose turns are all different
    texts = d.select("conv_id", F.col("turn").alias("pos"), "role", "text")
    seen = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in T.node_turns(nodes, turns, texts).collect()}
    want = rebuilt([tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()])
    assert all((t == (None, None)) if depth == 0 else t == want[c][depth - 1] for (c, depth), t in seen.items()) and len(seen) > 50
