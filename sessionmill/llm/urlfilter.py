"""URL filters over redirect-equivalent addresses.

A rule names a host and a path prefix and allows or blocks; it fits the host and all its subdomains, and the longest fitting
rule decides. Addresses without a rule of their own take over decisions from their aliases: redirects (HTML refresh,
or a table of redirects), canonical links, and the plain form of an address (no fragment, scheme or tracking parameters)
are edges; connected components over them are the aliases. In a component an explicit allow of any
alias comes before any block; a component without rules is allowed. A page's own rule always comes first.

Everything is a join: addresses are cut into their host suffixes and path prefixes only where a rule has that length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm.frames import components, store

ALLOW, BLOCK = "allow", "block"
TRACKING = r"(?:utm_[^=&#]*|ref|fbclid|gclid)=[^&#]*"  # parameters that do not change the page
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*(?:\d+(?:\.\d*)?|\.\d+)\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _lower_ascii(F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_form(url: Column) -> Column:
    """host + path (``/`` if empty) + query, without fragment and tracking parameters; null for what is no address."""
    def form(rest: Column) -> Column:
        host = _lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
        path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
        query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
        kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$")), "&")
        return F.concat(
            host, _let(path, lambda p: F.when(p == "", "/").otherwise(p)),
            _let(kept, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
    return _let(_rest(url), lambda rest: F.when(rest.isNotNull(), form(rest)))


def _joined_segments(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; ``..`` stops at the root."""
    def step(done: Column, p: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(p == ".", done).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    def joined(parts: Column) -> Column:
        whole = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
        return F.concat(whole, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return _let(F.split(path, "/", -1), joined)


def _without_dots(url: Column) -> Column:
    """A whole address with the ``.`` and ``..`` segments of its path resolved."""
    def resolved(u: Column) -> Column:
        site, tail = (F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)[^?#]*(.*)$", k) for k in (1, 2))
        return _let(path_of(u), lambda path: F.when(
            path.rlike(r"(?s)/\.\.?(/|\z)"), F.concat(site, _joined_segments(path), tail)).otherwise(u))
    return _let(url, resolved)


def _absolute(target: Column, base: Column) -> Column:
    """A link as found in a page of ``base``: whole, without scheme, from the root, relative, or a query or fragment alone."""
    parts = F.struct(
        F.regexp_extract(base, r"(?s)^(.*?)://", 1).alias("scheme"), host_of(base).alias("host"), path_of(base).alias("path"))

    def whole(b: Column) -> Column:
        site = F.concat(b["scheme"], F.lit("://"), b["host"])
        folder = _let(F.regexp_replace(b["path"], r"[^/]*$", ""), lambda f: F.when(f == "", "/").otherwise(f))
        return (
            F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(b["scheme"], F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(site, b["path"], target))
            .when(target.startswith("#"), base)
            .otherwise(F.concat(site, folder, target))
        )
    return _without_dots(_let(parts, whole))


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target) plain forms, for the canonical link and the refresh of each page.

    Links are taken out first; the outer generator stands between this and the parsing, so only pages with a link are parsed.
    """
    found = F.array(*[F.regexp_extract("html", p, 1) for p in (CANONICAL, REFRESH)])
    links = pages.where("html IS NOT NULL AND url IS NOT NULL").select("url", F.explode_outer(found).alias("link")).where("link <> ''")
    whole = _absolute(F.replace("link", F.lit("&amp;"), F.lit("&")), F.col("url"))
    pair = F.struct(plain_form(F.col("url")).alias("source"), plain_form(whole).alias("target"))
    edges = links.select(F.explode_outer(F.array(pair)).alias("e")).select("e.source", "e.target")
    return edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def own_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for every different (host, path) of ``pages`` that a rule fits.

    An address is looked up under its host suffixes and those prefixes of its path whose length some rule of that suffix
    has. Of fitting rules the one with the longest host and path together wins, of equally long ones an allow.
    """
    rules = rules.dropDuplicates()
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))  # path lengths, not rules
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = pages.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    starts = F.filter(F.col("lengths"), lambda n: n <= F.length("path"))
    tried = parts.join(lengths, "rule_host").withColumn("n", F.explode(starts)).withColumn("rule_path", F.expr("substring(path, 1, n)"))
    hit = tried.join(rules, ["rule_host", "rule_path"])
    weight = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == ALLOW, F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict"))
    best = hit.groupBy("host", "path").agg(F.max(weight).alias("w"))
    return best.select("host", "path", F.col("w.rule").alias("rule"), F.col("w.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    ``rules``: (verdict, rule_host, rule_path), paths with their leading slash; ``redirects``: (source, target) urls.
    ``rule`` is host and path of the page's own rule, or null. Null urls and urls without ``://`` have an empty host and
    path, no rule and no alias: they are allowed. Null html has no links. No rows give no rows; other columns are not looked at.
    """
    url = F.col("url")
    read = store(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), plain_form(url).alias("form")), "pages")
    own = store(own_rules(read, rules), "rules")
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        more = redirects.select(plain_form(F.col("source")).alias("source"), plain_form(F.col("target")).alias("target"))
        edges = edges.unionByName(more.where("source IS NOT NULL AND target IS NOT NULL AND source <> target"))
    alias = components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    # decisions of all known addresses of a component: of pages, and of link targets never crawled
    host = F.regexp_extract("node", r"(?s)^[^/?#]*", 0)
    nodes = alias.select("node", "root", host.alias("host"), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    ruled = nodes.join(own_rules(nodes, rules), ["host", "path"])
    decided = ruled.groupBy("root").agg(F.min("verdict").alias("alias_verdict"))  # allow sorts before block
    taken = alias.join(decided, "root").select(F.col("node").alias("form"), "alias_verdict")
    return read.join(own, ["host", "path"], "left").join(taken, "form", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "alias_verdict", F.lit(ALLOW)).alias("verdict"))
