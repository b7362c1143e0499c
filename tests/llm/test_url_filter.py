import duckdb
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trimline.llm import queries, url_filter


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, cut(rest[len(host) :], "?#")


def _rule(host, path):
    fits = []
    for rule in url_filter.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append(rule)
    return max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y#z", "http://example.org/es", "https://example.org/en/12",
    "http://notexample.org/en/1", "http://org/", "http://org", "http://x.org?a", "http://x.com/fr/a", "http://x.com/de/",
    "http://com/de/1://x.org/", "x://y://z.org/", "http://x.org#/a", "http://É.org/\n/es", "http://" + "a" * 50_000 + ".com/fr/",
    "http://x.net/a/1?b=2&c=3", "http://x.net/a/1?b=2&c=3",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, length double")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = _parts(url)
        rule = _rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict in ("allow", "block")
        if rule:
            assert got[i].verdict == url_filter.RULES[rule]
    assert got[18].verdict == got[19].verdict


def test_query_over_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    pages = duckdb.sql(f"SELECT page_id, url FROM '{sf_dir}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.op5_url_filter(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in pages}
    for i, url in pages:
        assert (got[i].host, got[i].path) == _parts(url) and got[i].rule == _rule(*_parts(url))


def test_trees_learn_from_labelled_urls(spark):
    make = lambda i: f"http://shop{i}-{i}{i}9.biz/{'x/' * (i % 6)}?a=1&b=2&c=3" if i % 2 else f"https://news.info/story/{i}"
    labelled = spark.createDataFrame([(make(i), i % 2) for i in range(400)], "url string, blocked int")
    pages = spark.createDataFrame([(i, make(i)) for i in range(400, 600)], "page_id long, url string")
    got = url_filter.judge(pages, rules={}, labelled=labelled).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) >= 190
    assert all(r.rule is None for r in got)


def test_nothing_to_learn_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).collect()] == ["allow"]
    assert url_filter.judge(pages.filter(F.lit(False))).count() == 0


def test_suffix_counts_cover_all_labelled_urls(spark):
    """Against plain counting, with many more suffixes than rows of a sample."""
    rows = [(f"http://a{i}.s{i % 700}/x", i % 3 == 0) for i in range(3000)]
    frame = spark.createDataFrame([(u, u[7:-2], int(b)) for u, b in rows], "url string, host string, blocked int")
    got = {r.suffix: (r.share, r.weight) for r in url_filter.suffix_counts(frame).collect()}
    plain = {}
    for i in range(3000):
        n, b = plain.get(f"s{i % 700}", (0, 0))
        plain[f"s{i % 700}"] = n + 1, b + (i % 3 == 0)
    assert got == {s: ((b + 1) / (n + 2), n / (n + 10)) for s, (n, b) in plain.items()}


def test_verdicts_follow_the_fitted_trees(spark):
    """Verdicts of the query's URLs without a rule are those of the trees that ``fit`` returns, scored one by one."""
    sf_dir = "/root/testdata/sf0.001"
    pages = duckdb.sql(f"SELECT page_id, url FROM '{sf_dir}/pages.parquet'").fetchall()
    known = [(u, *_parts(u), int(url_filter.RULES[_rule(*_parts(u))] == "block")) for _, u in pages if _rule(*_parts(u))]
    trees, counts = url_filter.fit(spark.createDataFrame(known, "url string, host string, path string, blocked int"))
    table = {r.suffix: (r.share, r.weight) for r in counts.collect()}
    free = spark.createDataFrame([(i, u, *_parts(u)) for i, u in pages if not _rule(*_parts(u))], "page_id long, url string, host string, path string")
    got = {r.page_id: r.verdict for r in queries.op5_url_filter(spark, sf_dir).collect()}
    rows = url_filter.features(free).collect()
    assert rows
    for r in rows:
        known_suffix = table.get(r.host.rsplit(".", 1)[-1], (0.5, 0.0))
        vector = Vectors.dense([r[c] for c in url_filter.FEATURES[:-2]] + list(known_suffix))
        assert got[r.page_id] == ("block" if trees.predict(vector) == 1.0 else "allow")
