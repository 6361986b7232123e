from strataflow.llm import urls
from strataflow.llm.common import table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SCHEMA = "page_id long, url string, html string, host int, label string, suffix string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return (best[1] + best[2], best[0]) if best else (None, None)


def check(df):
    got = urls.judge(df).collect()
    assert len(got) == df.count()
    given = sorted(((str(r.page_id), *parts(r.url), *rule(*parts(r.url))) for r in df.collect()), key=str)
    assert sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=str) == given
    assert {r.verdict for r in got} <= {"allow", "block"}
    return got


def test_hosts_paths_and_rules_equal_brute_force(spark):
    check(table(spark, "/root/testdata/sf0.01", "pages"))


def odd(spark):
    given = [
        None, "", "no scheme /fr/", "http://", "HTTP://A.B.ORG/Es/x", "x://example.org/es/", "http://notexample.org/es/y", "http://org",
        "http://org/", "https://user@www.Example.ORG:80/en/1?x=http://y.com/de/#z", "http://a.com?b=1", "http://com/fr/#/de/",
        "http://a.com/de/\nnext", "http://É.example.org/es/é", "a://b://c/d", "http://a.com/fr/", "http://a.com/fr/",
    ]
    return spark.createDataFrame([(None if i == 3 else i, u, None, 1, "x", "y") for i, u in enumerate(given)], SCHEMA)


def test_odd_urls(spark):
    check(odd(spark))
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_labels_of_both_kinds(spark):
    rows = [(1, "http://a.net/de/1", "", 1, "", ""), (2, "http://b.com/de/2", "", 1, "", "")]
    assert {r.verdict for r in check(spark.createDataFrame(rows[:1], SCHEMA))} == {"allow"}
    assert {r.verdict for r in check(spark.createDataFrame(rows, SCHEMA))} == {"block"}


def test_trees_learn_what_lexical_features_show(spark):
    bad = [f"http://h{i}.example.org/es/{i}98765{i}0123?a={i}&b=2&c=3" for i in range(150)]
    good = [f"http://plain.example.org/about/page{chr(97 + i % 26)}{'x' * (i % 7)}" for i in range(150)]
    unknown = [f"http://q{i}.example.net/x/{i}98765{i}0123?a={i}&b=2&c=3" for i in range(40)]
    unknown += [f"http://plain.example.net/about/page{chr(97 + i % 26)}" for i in range(26)]
    df = spark.createDataFrame([(i, u, "", 1, "", "") for i, u in enumerate(bad + good + unknown)], SCHEMA)
    got = {r.page_id: r.verdict for r in urls.judge(df).collect()}
    assert [got[300 + i] for i in range(40)] == ["block"] * 40
    assert [got[340 + i] for i in range(26)] == ["allow"] * 26
