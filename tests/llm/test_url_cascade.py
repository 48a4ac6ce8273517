import pytest
from pyspark.sql import functions as F

from geocairn.llm import url_cascade as uc


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    tail = rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(r, v) for r, v in uc.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    listed = any(t in host.replace("-", ".").split(".") for t in uc.LISTED_TERMS)
    return host, path, None, "block" if listed else "allow"


URLS = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.Net/x?y", "http://anet/", "http://b.net?x=/",
        "https://www.example.net/en/1", "https://example.net/EN/1", "ftp://x.example.com/de/", "http://xexample.com/de/",
        "http://a.org/fr/#a", "http://a.org/fr", "http://a.com#/x", "http://casino-win.com/a://b/", "x://y://z/",
        "http://m.ads-track.org/en/", "http://\u00c9cole.com/\u00e9\n/x", "http://free-bets.net/", "http://pills.co/" + "p" * 50_000]


@pytest.mark.parametrize("filter_bytes", [uc.FILTER_BYTES, 64])
def test_verdicts_match_brute_force(spark, filter_bytes):
    urls = URLS + [f"http://h{i}.{'bets' if i % 9 == 0 else 'site'}.com/{i}" for i in range(600)] + URLS[:9]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = uc.judge_urls(pages, filter_bytes=filter_bytes).collect()
    assert sorted(tuple(r) for r in got) == [(i, *brute(u)) for i, u in enumerate(urls)]


def test_cascade_is_exact_with_several_levels(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = uc.Cascade(keys)
    assert len(cascade.levels) >= 3
    wrong = cascade.mark(keys.withColumnRenamed("listed", "truth"), "key", "listed").where("listed <> truth")
    assert wrong.count() == 0
    plan = wrong._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_no_pages_and_nothing_listed(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert uc.judge_urls(none).collect() == []
    pages = spark.createDataFrame([(None, "http://plain.com/"), (1, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in uc.judge_urls(pages).collect()} == {(None, "allow"), (1, "allow")}
