import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from alembiq.llm import url_filter as U

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.ORG", "http://A.ORG/", "http://a.example.org/es/1", "http://example.org/en/12?x=1", "http://example.org/en/2", "http://notexample.org/es/",
    "http://xorg/", "http://org/a", "ftp://b.com/fr/x#y", "http://b.com/frx", "http://b.com/de/?q#z", "x://y.com?/de/", "http://c.net/a://d.org/", "http://a.org:80/", "http://ÄB.COM/de/", "http://a.com/de/\nline", "http://a.com/" + "é/" * 50000,
]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None)))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, *["clash"] * 4) for i, u in enumerate(urls)], "page_id long, url string, row string, host string, features string, suffix_rate string")


def test_rules_equal_brute_force(spark):
    df = pages(spark, ODD)
    got = U.fit(U.labelled_by_rules(df)).judge(df).select("row.*", F.col("host").alias("h"), F.col("path").alias("p"), F.col("rule").alias("r"), F.col("verdict").alias("v")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(ODD)))
    for r in got:
        host, path, rule, verdict = brute(ODD[r["page_id"]])
        assert (r["h"], r["p"], r["r"]) == (host, path, rule)
        assert r["v"] == verdict if verdict else r["v"] in ("allow", "block")
        assert r["host"] == r["features"] == "clash"


def test_features_equal_brute_force(spark):
    df = pages(spark, [u for u in ODD if u and len(u) < 100])
    host, path = U.host_and_path(F.col("url"))
    rows = df.select("url", host.alias("h"), path.alias("p")).select("url", F.struct(*[v.alias(k) for k, v in U.lexical(F.col("url"), F.col("h"), F.col("p")).items()]).alias("f")).collect()
    for r in rows:
        url, f = r["url"], r["f"]
        host, path = brute(url)[:2]
        counts = Counter(url)
        assert f["entropy"] == pytest.approx(-sum(c / len(url) * math.log2(c / len(url)) for c in counts.values()))
        assert f["url_length"] == len(url) and f["host_length"] == len(host) and f["path_length"] == len(path)
        assert f["depth"] == len([x for x in path.split("/") if x]) - (bool(path) and not path.startswith("/"))
        assert f["digit_ratio"] == pytest.approx(sum(c in "0123456789" for c in url) / len(url))
        query = re.search(r"\?([^#]*)", url)
        assert f["parameters"] == (len([x for x in re.split("[&;]", query.group(1)) if x]) if query else 0)
        assert f["longest_run"] == max(map(len, re.findall("[A-Za-z0-9]+", url)), default=0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_urls_are_judged_as_their_rules_do(spark):
    known = U.labelled_by_rules(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).dropDuplicates(["url"])
    held = F.crc32(F.col("url").cast("binary")) % 3 == 1
    model = U.fit(known.where(~held))
    got = model.score(known.where(held)).select("row.y", "score").collect()
    right = sum((r["score"] >= U.THRESHOLD) == bool(r["y"]) for r in got)
    # What is missed are paths told apart by a digit, of which no feature knows.
    majority = max(sum(r["y"] for r in got), sum(1 - r["y"] for r in got))
    assert len(got) > 300 and right / len(got) >= 0.93 and right > 1.1 * majority


def test_the_sample_is_bounded_and_copies_count_once(spark):
    rows = spark.range(20000).select(F.concat(F.lit("http://h.net/"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))).alias("url"), (F.col("id") % 2).cast("int").alias("y"))
    model = U.fit(rows, most=500)
    seen = model.statistics["suffix"].first()["suffix_seen"]
    assert 300 < math.expm1(seen) <= 600


def test_labels_of_one_kind_or_none(spark):
    urls = pages(spark, ["http://a.net/", None])
    none = spark.createDataFrame([], "url string, y int")
    assert {r["verdict"] for r in U.fit(none).judge(urls).collect()} == {"allow"}
    bad = spark.createDataFrame([("http://b.net", 1), ("http://c.net", 5), (None, 0), ("http://d.net", None)], "url string, y int")
    assert {r["verdict"] for r in U.fit(bad).judge(urls).collect()} == {"block"}


def test_both_labels_count_as_blocked_and_equal_urls_agree(spark):
    rows = spark.createDataFrame([("http://a.net/x", 0), ("http://a.net/x", 1)], "url string, y int")
    assert U.fit(rows).base == 1.0
    mixed = spark.createDataFrame([(f"http://a.{'com' if i % 2 else 'net'}/{i}", i % 2) for i in range(200)], "url string, y int")
    df = pages(spark, ["http://z.com/1"] * 3 + ["http://z.net/1"] * 3)
    found = U.fit(mixed).judge(df, rules=()).collect()
    assert [r["verdict"] for r in sorted(found, key=lambda r: r["row"]["page_id"])] == ["block"] * 3 + ["allow"] * 3


def test_empty_table(spark):
    df = pages(spark, [])
    assert U.fit(U.labelled_by_rules(df)).judge(df).collect() == []


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        U.judged_by_rules(F.lit(""), F.lit(""), [("allow", "a", "/")] * (U.MAX_RULES + 1))
