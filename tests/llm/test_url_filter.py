"""URL verdicts against trying every rule on every URL."""

import random

from samples import clashing, lowered

from trailworks.llm.url_filter import RULES, RULES_SCHEMA, contract_rules, expressions, judged, rule_table


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    return lowered(host), path


def plain(url, rules, default="allow"):
    host, path = split(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


URLS = [None, "", "no scheme", "http://", "http:///es/", "HTTP://WWW.Example.ORG/es/1", "https://example.org", "https://example.org/", "https://example.org/en/148.html",
        "https://notexample.org/es/x", "https://a.b.c.example.org/es/?q=/de/", "https://x.com/fr/#frag", "https://x.com/FR/", "https://com/de/", "https://.org/x", "https://org./x",
        "a://b.org/u://c.com/de/", "https://x.com?u=/de/", "https://é.org/ü", "ftp://user@x.org:21/es/", "https://" + "a." * 20_000 + "org/" + "p" * 300_000, "https://x.com/de/\nline"]


def table(spark, urls):
    return clashing(spark.createDataFrame([(None if k % 5 == 4 else k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, html string"))


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_verdicts_equal_trying_every_rule(spark):
    rng = random.Random(5)
    urls = URLS + [None] * 30 + ["https://www.example.org/en/17"] * 30
    urls += [f"{rng.choice(['http', 'https'])}://{'.'.join(rng.choice(['www', 'example', 'org', 'com', 'ORG', 'x']) for _ in range(rng.randrange(1, 5)))}"
             f"{rng.choice(['', '/', '/es/', '/es', '/en/1', '/en/2', '/fr/', '/de/a'])}{rng.choice(['', '?a=/b', '#c', 'tail'])}" for _ in range(400)]
    want = sorted(((None if k % 5 == 4 else k, *plain(u, RULES)) for k, u in enumerate(urls)), key=repr)
    assert rows(judged(table(spark, urls), contract_rules(spark))) == want


def test_many_rules_ties_and_odd_rules(spark):
    rng = random.Random(6)
    labels = ["a", "b", "c"]
    rules = list({(".".join(rng.choices(labels, k=rng.randrange(1, 4))), "/" + "".join(rng.choices("xy/", k=rng.randrange(4)))): rng.choice(["allow", "block"]) for _ in range(80)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    odd = [(None, "/", "block"), ("a", None, "block"), ("a", "/", None), ("a", "/", "maybe"), ("", "/", "block"), ("b", "", "block")]
    twice = [("c", "/twice", "allow"), ("C", "/twice", "block")]
    urls = URLS + [f"x://{'.'.join(rng.choices(labels, k=rng.randrange(1, 5)))}/{''.join(rng.choices('xy/', k=rng.randrange(6)))}" for _ in range(400)] + ["x://z.c/twice"]
    good = rules + [("b", "", "block"), ("c", "/twice", "block")]
    want = sorted(((None if k % 5 == 4 else k, *plain(u, good, "block")) for k, u in enumerate(urls)), key=repr)
    assert rows(judged(table(spark, urls), spark.createDataFrame(rules + odd + twice, RULES_SCHEMA), default="block")) == want


def test_no_rules_and_no_urls(spark):
    none = spark.createDataFrame([], RULES_SCHEMA)
    assert rows(judged(table(spark, ["https://a.org/es/"]), none)) == [(0, "a.org", "/es/", None, "allow")]
    assert judged(table(spark, []), contract_rules(spark)).count() == 0


def test_only_expressions_that_a_rule_could_be_are_made(spark):
    table_ = rule_table(contract_rules(spark))
    assert sorted(r.rule for r in table_.collect()) == sorted(h + p for h, p, _ in RULES)
    url = spark.createDataFrame([("a.b.example.org", "/en/17")], "host string, path string")
    assert expressions(url, [1, 2], [1, 4, 5]).count() == 6
