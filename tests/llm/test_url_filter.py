import re
from collections import Counter

from brute import rows

from tablewright.llm import url_filter


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def given(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_rules(labelled, support, confidence):
    """All token sets up to the longest url that imply a verdict, without those that a part explains as well."""
    least = -(-len(labelled) * support // 1)
    frequent, level = {}, {(): len(labelled)}
    tokens = sorted({t for ts, _ in labelled for t in ts})
    while level:
        found = {}
        for items in level:
            for t in tokens:
                if items and t <= items[-1]:
                    continue
                n = Counter(v for ts, v in labelled if set(items) | {t} <= set(ts))
                if sum(n.values()) >= least and max(n.values()) >= least:
                    found[(*items, t)] = n
        frequent |= found
        level = found
    rules = {(items, v): k / sum(n.values()) for items, n in frequent.items() for v, k in n.items() if k >= least and k / sum(n.values()) >= confidence}
    return {r: c for r, c in rules.items() if not any(w == r[1] and set(i) < set(r[0]) and d >= c for (i, w), d in rules.items())}


def test_query_follows_the_given_rules(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in url_filter.op3_url_rules(spark, sf_dir).collect()}
    pages = rows(sf_dir, "pages", "page_id, url")
    assert len(found) == len(pages)
    for page, url in pages:
        r = found[page]
        assert (r.host, r.path) == parts(url)
        rule, verdict = given(*parts(url))
        assert r.rule == rule and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == verdict
    assert any(r.mined_rule for r in found.values())


def test_mining_and_matching_equal_brute_force(spark):
    urls = ["http://a.net/es/1", "http://b.net/es/2", "http://b.net/fr/x", "http://www.example.com/en/1", "http://q.example.com/en/2", "http://z.com/a", "http://a.net/es/7", "http://k.com/fr/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = url_filter.host_of(df.url), url_filter.path_of(df.url)
    labelled = df.select(url_filter.tokens(host, path, df.url).alias("tokens"), url_filter.matched_rule(host, path).verdict.alias("verdict")).filter("verdict is not null")
    got = {(tuple(r["items"]), r.verdict): r.confidence for r in url_filter.mine(labelled, 0.3, 0.7, 1).collect()}
    plain = plain_rules([(r.tokens, r.verdict) for r in labelled.collect()], 0.3, 0.7)
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-9 for k in got)
    others = [["path=es", "host0=org"], ["path=fr", "host0=net", "scheme=http"], ["nothing"], []]
    urls = spark.createDataFrame(list(enumerate(others)), "k long, tokens array<string>")
    found = {r.k: r.verdict for r in url_filter.match(urls, url_filter.mine(labelled, 0.3, 0.7, 1), "k").collect()}
    fits = {k: [c for (i, v), c in plain.items() if set(i) <= set(t)] for k, t in enumerate(others)}
    assert found.keys() == {k for k, c in fits.items() if c}
    for k, verdict in found.items():
        assert max(c for (i, v), c in plain.items() if v == verdict and set(i) <= set(others[k])) == max(fits[k])


def test_odd_rows(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/?a#b", "x://", "http://net/es/1", "http://net/es/1", "http://a.b.org/" + "p/" * 5000, "://n.net/fr/\n?q", "http://xnet/es/"]
    df = spark.createDataFrame([(None if i == 2 else i, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    found = url_filter.judge(df).collect()
    assert len(found) == len(urls)
    for r in found:
        assert (r.host, r.path) == parts(r.url) and r.rule == given(r.host, r.path)[0] and r.verdict
    assert url_filter.judge(df.limit(0)).count() == 0
    assert [r.verdict for r in url_filter.judge(df.filter("page_id < 2")).collect()] == ["allow"] * 2


def test_urls_that_share_many_words(spark):
    """1,000 urls with 40 words in common: the words are one item, so that mining does not double with each."""
    shared = "/".join(f"w{i}" for i in range(40))
    urls = [f"https://{'a.com' if i % 2 else 'b.net/es'}/{shared}/n{i}" for i in range(1000)] + [f"https://c.org/{shared}/x", "https://c.org/es/w3"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(found) == len(urls) and all(found[i].verdict == ("allow" if i % 2 else "block") for i in range(1000))
    assert found[1001].verdict == "block" and found[1001].mined_rule


def test_classes_hold_tokens_of_the_same_urls(spark):
    baskets = [("u1", ["a", "b", "c"]), ("u2", ["a", "b"]), ("u3", ["c", "d"]), ("u4", ["d", "c", "e"])]
    df = spark.createDataFrame(baskets, "url string, tokens array<string>")
    classes = url_filter.token_classes(df)
    assert {r.token: r.item for r in classes.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    items = {r.url: sorted(r["items"]) for r in url_filter.with_items(df, classes, "url").collect()}
    assert items == {"u1": ["a", "c"], "u2": ["a"], "u3": ["c", "d"], "u4": ["c", "d", "e"]}
