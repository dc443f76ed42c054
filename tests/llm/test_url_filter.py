import pytest

from palisade.llm.queries import URL_RULES
from palisade.llm.url_filter import DigestArray, judge_urls

URLS = [
    "http://example.com/en/a?x=1", "https://WWW.Example.com/en/", "http://a.b.example.com/en/x", "http://x.net/es/1#q", "http://x.net/fr", "http://com/", "http://com",
    "http://notcom.org/", "no scheme", None, "", "://", "http://example.com?q=/en/", "ftp://user@example.com:80/en/", "http://a.com/\u00e9\nline?x", "a://b://c.com/en/",
    "http://WWW.EXAMPLE.COM/en/z", "http://.net/es/", "http://x.net/es/1#q",
]


def brute(url, rules, default="allow"):
    url = url or ""
    i = url.find("://")
    host = path = ""
    if i >= 0:
        rest = url[i + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("shard", [100_000, 2])
def test_rules(llm, shard):
    urls = llm.createDataFrame([(i, u, "x", 3) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule int").repartition(3)
    rules = llm.createDataFrame([*URL_RULES, URL_RULES[0], (None, "/", "block"), ("org", "", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(urls, rules, shard_rules=shard).collect()}
    listed = [*URL_RULES, ("org", "", "block")]
    assert got == {i: brute(u, listed) for i, u in enumerate(URLS)}


@pytest.mark.parametrize("shard", [100_000, 1])
def test_empty_tables(llm, shard):
    rules = llm.createDataFrame(URL_RULES, "host string, path string, verdict string")
    urls = llm.createDataFrame([(1, "http://example.com/en/")], "page_id long, url string")
    assert judge_urls(urls.limit(0), rules, shard_rules=shard).collect() == []
    assert judge_urls(urls, rules.limit(0), shard_rules=shard, default="block").first()["verdict"] == "block"


def test_colliding_digests_are_told_apart(monkeypatch):
    from palisade.llm import url_filter

    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: 7)
    index = DigestArray([("a", "/", "allow"), ("b", "/", "block")])
    found = index.find([b"b /", b"c /", b"a /"])
    assert [index.verdicts[i] if i >= 0 else None for i in found] == ["block", None, "allow"]


def test_query_equals_brute_force(llm, sf_dir):
    from palisade.llm.queries import QUERIES

    urls = {r["page_id"]: r["url"] for r in llm.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op7_url_filter"](llm, sf_dir).collect()}
    assert got == {i: brute(u, URL_RULES) for i, u in urls.items()}


@pytest.mark.parametrize("shard", [100_000, 1])
def test_hosts_of_many_labels(llm, shard):
    long = "a." * 10_050
    urls = llm.createDataFrame([(1, f"http://{long}example.com/en/x"), (2, f"http://{long}example.org/en/x"), (3, f"http://{long}net")], "page_id long, url string")
    listed = [("example.com", "/en/", "block"), ("a.a.example.org", "/", "block"), ("net", "", "block"), ("b.net", "", "allow")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(urls, llm.createDataFrame(listed, "host string, path string, verdict string"), shard_rules=shard).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("a.a.example.org/", "block"), 3: ("net", "block")}
