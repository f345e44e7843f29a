"""Mixing of sources and host reputation."""

import re
from collections import Counter, defaultdict

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultspark.functions.exprs import rnd
from faultspark.llm import mixing, url_reputation as ur
from tests.llm.brute import poisson_draw
from tests.llm.conftest import odd_rows


def test_every_document_draws_its_count(documents):
    rows = mixing.mix_sources(documents).collect()
    docs = {r["doc_id"]: r for r in documents.collect()}
    chars = Counter()
    for r in docs.values():
        chars[r["source"]] += len(r["text"] or "")
    total, weight = sum(chars.values()), sum(c**0.5 for c in chars.values())
    rate = {s: total * c**0.5 / weight / c for s, c in chars.items()}
    want = {d: poisson_draw(f"0|{d}|{hashlib.md5((r['text'] or '').encode()).hexdigest()}", rate[r["source"]]) for d, r in docs.items()}
    got = Counter(r["doc_id"] for r in rows)
    assert got == Counter({d: n for d, n in want.items() if n})
    assert all(r["text"] == docs[r["doc_id"]]["text"] and 1 <= r["mix_copy"] <= r["mix_copies"] for r in rows)


def test_targets_are_reached(spark):
    """Means from a tenth to several hundred; a third of the rows are of one source."""
    rows = [(i, f"text {i:06d}", "big" if i % 3 == 0 else f"s{i % 7}" if i % 40 else None) for i in range(9000)] + [(10_000 + i, f"text {i:06d}", "tiny") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("big", 1.0), ("tiny", 4.0), ("s1", 1.0), (None, 2.0)], "source string, weight double")
    got = Counter(r["source"] for r in mixing.mix_sources(docs, weights, scale=1.0).select("source").collect())
    assert set(got) == {"big", "tiny", "s1", None}
    for s, w in (("big", 1), ("tiny", 4), ("s1", 1), (None, 2)):
        assert got[s] == pytest.approx(9012 * w / 8, rel=0.15)
    order = [r["source"] for r in mixing.mix_sources(docs, weights).select("source").collect()]
    assert max(len(m.group()) for m in re.finditer("b+", "".join("b" if s == "big" else "." for s in order))) < 60


def test_odd_rows_of_mixing(odd, none):
    out = mixing.mix_sources(odd, scale=3.0)
    assert mixing.mix_sources(none).count() == 0 and set(odd.columns) <= set(out.columns)
    got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert set(got) <= {r[0] for r in odd_rows()} and got[7] % 2 == 0


def reference_host(url):
    if url is None or "://" not in url:
        return "", ""
    bare = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host = bare.split("/", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), bare[len(host):]


def reference_rule(host, path):
    best = None
    for verdict, rule in ur.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


URLS = ["http://a.example.org/es/1", "http://Example.ORG/en/12?x", "https://example.org/en/2#f", "http://x.com/fr/", "http://x.com/de/9", "http://net/", "no scheme", None, "", "://", "http://a.b.com?x=/de/",
        "http://com/fr/é", "HTTP://ÄB.example.org/es", "http://notexample.org/es/", "http://a://b/c", "x://host#/de/", "http://org"]


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    rows = ur.judge_urls(pages.selectExpr("*", "1 AS host", "2 AS good", "3 AS n", "4 AS a"), none).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = reference_host(r["url"])
        best = reference_rule(host, path)
        assert (r["host"], r["path"]) == (host, path), r["url"]
        assert (r["rule"], r["verdict"]) == ((best[1], best[0]) if best else (None, "allow")), r["url"]
    assert ur.judge_urls(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_and_unknown_ones_stay(spark):
    rng = np.random.default_rng(2)
    pages, outcomes, truth = [], [], defaultdict(lambda: 0.9)
    truth.update({f"bad{i}.spam.biz": 0.05 for i in range(8)})
    hosts = [*truth, *[f"h{i}.fine{i % 5}.net" for i in range(40)], "one.single.info"]
    for k, h in enumerate(hosts):
        for j in range(1 if h == "one.single.info" else 60):
            pages.append((len(pages), f"http://{h}/p{j}"))
            outcomes.append((len(outcomes), 0 if h == "one.single.info" else int(rng.random() < truth[h])))
    pages.append((len(pages), "http://bad99.spam.biz/new"))
    pages.append((len(pages), "http://fresh.net/new"))
    got = {r["host"]: r for r in ur.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes + [(None, 1), (3, None)], "page_id long, good int")).collect()}
    for h in hosts:
        if h != "one.single.info":
            assert got[h]["verdict"] == ("block" if truth[h] < 0.5 else "allow"), h
    assert got["one.single.info"]["verdict"] == "allow"  # one bad page proves nothing
    assert got["bad99.spam.biz"]["reputation"] < 0.3 < got["fresh.net"]["reputation"]  # from its domain and suffix


LEVELS = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.y.com": ("y.com", "com"), "y.com.": ("y.com", "com"), "user:pw@y.com:1": ("y.com", "com"),
          "me.github.io": ("me.github.io", "github.io"), "a.me.github.io": ("me.github.io", "github.io"), "github.io": ("github.io", "io"), "10.0.1.2": ("10.0.1.2", "#address"), "10.0.1.2:80": ("10.0.1.2", "#address"),
          "[::1]:80": ("[::1]", "#address"), "1.2": ("1.2", "2"), "net": ("net", "net"), "": ("", ""), "co.de.fr": ("de.fr", "fr"), "x.co.com": ("co.com", "com"), "a..b": (".b", "b")}


def test_registered_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in LEVELS], "host string")
    assert {r[0]: tuple(r[1]) for r in hosts.select("host", ur.host_levels(F.col("host"))).collect()} == LEVELS
    one = hosts.filter("host = 'a.b.co.uk'")
    assert tuple(one.select(ur.host_levels(F.col("host"), ("b.co.uk",))).first()[0]) == ("a.b.co.uk", "b.co.uk")
    assert tuple(one.select(ur.host_levels(F.col("host"), ())).first()[0]) == ("b.co.uk", "co.uk")


def test_odd_hosts_agree_with_sql(spark):
    """The same pages in SQL, with long urls, null and repeated pages."""
    rng = np.random.default_rng(5)
    urls = [f"http://{h}/p{j}" for h in LEVELS for j in range(9)] + ["http://y.com/" + "x" * 200_000, None, "none"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, "http://y.com/1"), (3, urls[3])]
    labels = [(i, int(rng.random() < 0.6)) for i in range(0, len(urls), 2)] + [(None, 1), (4, None)]
    got = ur.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int"))
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality"]).astype("Int64"))
    want = con.execute(ur.SQL).fetchall()

    def lines(rows):
        return sorted(str((r[0], r[1], len(r[2]), r[3], r[4], r[5], r[6])) for r in rows)

    assert lines(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict", rnd("reputation"), rnd("reputation_high")).collect()) == lines(want)
