import re

from pyspark.sql import functions as F

from graphloom.llm.urls import filter_urls, op10_url_ratio

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def _split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def _rule(host, path):
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fit, key=len, default=None)


def test_contract(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op10_url_ratio(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path) == _split(urls[r.page_id]) and r.rule == _rule(r.host, r.path)
        assert r.verdict == RULES[r.rule] if r.rule else r.verdict in ("allow", "block")


def test_odd_urls_and_clashing_columns(spark):
    urls = [None, "", "no scheme", "://", "HTTP://EXAMPLE.com/en/7x", "http://xcom/en/", "a://b?c/d", "a://b#c", "http://É.Org/es/", "http://h://x/y?q", "http://a.com/en/\n" + "z" * 50_000]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls + urls)], "page_id long, url string, Host string, __grams int")
    got = sorted(filter_urls(pages).collect(), key=lambda r: r.page_id)
    for r, u in zip(got, urls + urls, strict=True):
        assert (r.host, r.path) == _split(u) and r.rule == _rule(r.host, r.path) and r["__grams"] == 1
    assert [r.verdict for r in got[: len(urls)]] == [r.verdict for r in got[len(urls) :]]
    assert filter_urls(pages.limit(0)).isEmpty()


def test_the_ratio_finds_urls_like_the_rejected(spark):
    good = [f"http://{w}{i % 7}.example.info/en/{i}" for i in range(250) for w in ("meadow", "river", "granite", "harbour")]
    bad = [f"http://cheap-pills{i}.example.info/en/{i}" for i in range(40)]
    new = ["http://cheeap-piills.example.info/en/1", "http://cheap-pillz.example.info/en/2", "http://graniteriver.example.info/en/3"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + new)], "page_id long, url string")
    known = F.when(F.col("page_id") < len(good + bad), F.col("page_id") >= len(good))
    verdict = {r.url: r.verdict for r in filter_urls(pages, rules=(), rejected=known).collect()}
    assert all(verdict[u] == "block" for u in bad) and sum(verdict[u] == "allow" for u in good) >= 0.96 * len(good)
    assert [verdict[u] for u in new] == ["block", "block", "allow"]


def test_the_model_decides_where_no_rule_fits(spark):
    """A rule blocks one host's pages; new URLs, no examples themselves, follow the likeness to them, and without examples of both kinds all is allowed."""
    rules = (("block", "blocked.info", "/casino-bonus/"), ("allow", "allowed.info", "/gardens/"))
    urls = [f"http://a{i}.blocked.info/casino-bonus/{i}" for i in range(60)] + [f"http://b{i}.allowed.info/gardens/{i}" for i in range(60)]
    urls += [f"http://c{i}.third.info/gardens/{i}" for i in range(1500)]
    new = [f"http://a{i}.blocked.net/casino-bonus/{i}" for i in range(5)] + [f"http://c{i}.third.net/gardens/{i}" for i in range(5)]
    pages = spark.createDataFrame([(u,) for u in urls + new], "url string")
    known = F.when(~F.col("url").isin(new), F.col("url").contains("blocked.info"))
    verdict = {r.url: r.verdict for r in filter_urls(pages, rules, rejected=known).collect()}
    assert [verdict[u] for u in new] == ["block"] * 5 + ["allow"] * 5
    for emptied in (F.lit(None).cast("boolean"), F.lit(True), F.lit(False)):
        verdict = {r.url: (r.verdict, r.score) for r in filter_urls(pages, rules, rejected=emptied).collect()}
        assert {verdict[u] for u in new} == {("allow", 0.0)} and verdict[urls[0]] == ("block", 0.0)


def test_model_against_brute_force(spark):
    """The score of a URL from counts made in Python."""
    import hashlib
    import math
    from collections import Counter

    from graphloom.llm.urls import ALPHABET, HELD_OUT

    urls = [f"http://{a}{i}.com/x1?{i}" for i in range(6) for a in ("casino-", "b", "c.d", "win.")]
    pages = spark.createDataFrame([(u, u.startswith(("http://casino", "http://win"))) for u in urls], "url string, bad boolean")
    got = {r.url: r.score for r in filter_urls(pages, rules=(), rejected=F.col("bad")).collect()}
    n, tri = len(ALPHABET), {True: Counter(), False: Counter()}
    grams = {}
    for u in urls:
        s = "^^" + re.sub("[0-9]", "0", u.split("://")[1])
        grams[u] = [s[i : i + 3] for i in range(len(s) - 2)]
        if int(hashlib.md5(_split(u)[0].encode()).hexdigest()[:8], 16) % HELD_OUT:
            tri[u.startswith(("http://casino", "http://win"))].update(grams[u])

    def p(c, g):
        count = lambda f: sum(v for k, v in c.items() if f(k))
        p1 = (count(lambda k: k[2] == g[2]) + 1) / (sum(c.values()) + n)
        b, tb = count(lambda k: k[1] == g[1]), len({k[2] for k in c if k[1] == g[1]})
        p2 = (count(lambda k: k[1:] == g[1:]) + tb * p1) / (b + tb) if b else p1
        ab, tab = count(lambda k: k[:2] == g[:2]), len([k for k in c if k[:2] == g[:2]])
        return (c[g] + tab * p2) / (ab + tab) if ab else p2

    for u in urls:
        want = sum(math.log(p(tri[True], g)) - math.log(p(tri[False], g)) for g in grams[u]) / len(grams[u])
        assert abs(got[u] - want) < 1e-6


def test_no_python_on_the_main_path(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("n", F.lit(1))
    plan = filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
