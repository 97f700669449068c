"""Sharding against its law, URL decisions against a plain walk."""

import random
import zlib

import pytest

from pyspark.sql import functions as F

from sessionmill.llm import sharding, urlfilter
from tests.llm.conftest import prose


def check_shards(rows, got, shards=16):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


@pytest.mark.parametrize("hot", [0, 1, 2])
def test_shards_have_near_equal_bytes(make, hot):
    rng = random.Random(hot)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(1200)]
    if hot:  # a third of all rows share a text, long or empty
        rows += [(5000 + i, "same words " * 12 if hot == 1 else None) for i in range(600)]
    got = sharding.shard_documents(make(rows)).collect()
    sizes = check_shards(rows, got)
    assert max(sizes) - min(sizes) <= max(0.02 * max(sizes), 2 * max(len((t or "").encode()) + 1 for _, t in rows))
    if hot == 0:
        assert all(len({r.shard for r in got if r.text_crc32 == c}) == 1 for c in {r.text_crc32 for r in got})


def test_equal_texts_share_a_shard_when_they_fit(make):
    rng = random.Random(7)
    rows = [(i, f"group {i % 90} " + prose(random.Random(i % 90), 20)) for i in range(900)] + [(1000 + i, prose(rng, 25)) for i in range(900)]
    got = sharding.shard_documents(make(rows)).collect()
    check_shards(rows, got)
    seen = {}
    for r in got:
        assert seen.setdefault(r.text_crc32, r.shard) == r.shard


def test_odd_rows_and_none(make, odd_rows):
    check_shards(odd_rows, sharding.shard_documents(make(odd_rows)).collect())
    assert sharding.shard_documents(make([])).count() == 0


RULES = [("allow", "org", "/"), ("block", "bad.org", "/x"), ("block", "com", "/de/"), ("allow", "good.com", "/de/ok"), ("block", "evil.net", "/")]
PAGES = "page_id long, url string, html string, host string, rule string, form string"


def page(i, url, html=None):
    return (i, url, html, "h", "r", "f")  # clashing names


def test_own_rules(spark):
    cases = {
        "http://a.org/p": ("a.org", "/p", "org/", "allow"), "http://BAD.org/xy?q#f": ("bad.org", "/xy", "bad.org/x", "block"),
        "https://w.bad.org/X": ("w.bad.org", "/X", "org/", "allow"), "http://s.com/de/1": ("s.com", "/de/1", "com/de/", "block"),
        "http://good.com/de/ok2": ("good.com", "/de/ok2", "good.com/de/ok", "allow"), "http://notgood.com/de/ok2": ("notgood.com", "/de/ok2", "com/de/", "block"),
        "http://a.org": ("a.org", "", None, "allow"), "a.org/p": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "x://y://bad.org/x": ("y:", "//bad.org/x", None, "allow"), "http://a.org?x=/../": ("a.org", "", None, "allow"), "http:///p": ("", "/p", None, "allow"),
        "http://..org/p\nq": ("..org", "/p\nq", "org/", "allow"),
    }
    pages = spark.createDataFrame([page(k, u) for k, u in enumerate(cases)] + [page(0, list(cases)[0])], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, RULES)).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urlfilter.judge(pages, urlfilter.rules_frame(spark, RULES)).count() == len(cases) + 1
    assert urlfilter.judge(pages.limit(0), urlfilter.rules_frame(spark, RULES)).count() == 0


def test_aliases_take_over_decisions(spark):
    canonical = '<head><link rel="canonical" href="{}"></head>'
    pages = [
        page(1, "http://a.net/1", canonical.format("https://evil.net/e")), page(2, "http://b.net/2?utm_source=z", '<meta http-equiv="refresh" content="0; url=http://a.net/1#top">'),
        page(3, "https://b.net/2", None), page(4, "http://c.net/3", canonical.format("/3b")), page(5, "http://c.net/3b", ""),
        page(6, "http://d.net/6", "<LINK href='http://evil.net/z' rel='canonical'>"), page(7, "http://good.com/de/ok", canonical.format("http://d.net/6")),
        page(8, "http://e.net/8", canonical.format("")), page(9, "http://f.net/9", None), page(10, "http://s.com/de/q", canonical.format("http://good.com/de/ok")),
    ]
    want = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    redirects = spark.createDataFrame([("http://f.net/9", "http://g.net/"), ("http://g.net/", "http://evil.net/"), (None, "http://x.net")], "source string, target string")
    got = urlfilter.judge(spark.createDataFrame(pages, PAGES), urlfilter.rules_frame(spark, RULES), redirects).collect()
    assert {r.page_id: r.verdict for r in got} == want


def test_forms_of_links(spark):
    """Each way to write a link leads to the same blocked address, or around it."""
    refresh, canonical = '<meta http-equiv="refresh" content="{}">', '<link rel="canonical" href="{}">'
    base, blocked = "http://a{}.net/d/e/page?q=1", "https://bad.net/x/y"
    rules = [("block", "bad.net", "/x/"), ("block", "root.net", "/"), *[("block", f"a{k}.net", "/t") for k in range(20, 40)], ("block", "a30.net", "/d/e/list")]
    cases = [
        (1, refresh.format(f"0; url='{blocked}'")), (2, f"""<meta http-equiv=refresh content='0;URL="{blocked}"'>"""), (3, refresh.format(f"0.5; url={blocked}")),
        (4, refresh.format(f".5 ; url = '{blocked}'")), (5, canonical.format("https://bad.net/z/../x/./y")), (6, canonical.format("https://root.net")),
        (20, canonical.format("../../t")), (21, canonical.format("./../.././../../t#x")), (22, canonical.format("/u/../t?v=/../")), (23, canonical.format("//a23.net/./t")),
        (24, canonical.format("../../t/..x")), (30, canonical.format("?q=2")), (31, canonical.format("../t")), (32, canonical.format("#t")),
    ]
    pages = [page(k, base.format(k), html) for k, html in cases]
    # page 30 and its other query are one page: the block of what that page leads to holds for both
    pages += [page(100, "http://a30.net/d/e/page?q=2", refresh.format("0; url='list'")), page(101, "https://root.net/"), page(102, "http://root.net", canonical.format("http://c.net/1"))]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, PAGES), urlfilter.rules_frame(spark, rules)).collect()}
    assert got == {k: "allow" if k in (31, 32) else "block" for k in got}
    urls = ["https://h/a/b/..", "https://h/..", "https://h/a/./?x=/../", "https://h", "http://h/a/.../b"]
    fixed = spark.createDataFrame([(u,) for u in urls], "u string").select(urlfilter._without_dots(F.col("u"))).collect()
    assert [r[0] for r in fixed] == ["https://h/a/", "https://h/", "https://h/a/?x=/../", "https://h", "http://h/a/.../b"]


def test_link_expressions_stay_small(spark):
    """Each step of reading a link is computed once: the plan does not grow with the number of its uses."""
    edges = urlfilter.link_edges(spark.createDataFrame([page(1, "http://a.net/1", None)], PAGES).select("url", "html"))
    assert len(edges._jdf.queryExecution().executedPlan().toString()) < 100_000
