"""URL filters whose decisions reach pages through redirects and canonical links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelfold.llm.components import connected_components
from pixelfold.llm.shared import cut_lineage, flipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A list of rules travels inside the plan, so its length is bounded; a table of rules is not.
MOST_RULES = 20_000

URL_PARTS = r"(?s)^(.*?://[^/?#]*|)(.*)$"

LINK_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH_URL = r"""(?i)\burl\s*=\s*['"]?([^"'>\s]+)"""


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def url_node(url: Column) -> Column:
    """The name of a URL among aliases: without fragment, scheme and host lower-cased."""
    return _let(F.substring_index(url, "#", 1), lambda u: F.concat(
        F.translate(F.regexp_extract(u, URL_PARTS, 1), UPPER, LOWER), F.regexp_extract(u, URL_PARTS, 2)))


def _suffixes(host: Column) -> Column:
    """The host and the hosts it lies below."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (length, host_length, allow, rule), or null.

    ``rules`` holds (verdict, host, path).  A rule fits its host and all hosts
    below it if the path starts with the rule's.  Of rules of equal length the
    longer host counts, then allow.  Only the rules of the host's own suffixes
    are looked at.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"a list holds at most {MOST_RULES} rules, give more of them as a table")
    kind = "array<struct<length:int,host_length:int,allow:boolean,rule:string,path:string>>"
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        rule = rule_host + rule_path
        by_host.setdefault(rule_host.translate(str.maketrans(UPPER, LOWER)), []).append(F.struct(
            F.lit(len(rule)).alias("length"), F.lit(len(rule_host)).alias("host_length"), F.lit(verdict == "allow").alias("allow"),
            F.lit(rule).alias("rule"), F.lit(rule_path).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<length:int,host_length:int,allow:boolean,rule:string>")
    known = F.create_map(*[c for h, r in by_host.items() for c in (F.lit(h), F.array(*r).cast(kind))])
    found = F.flatten(F.transform(_suffixes(host), lambda s: F.coalesce(F.try_element_at(known, s), F.array().cast(kind))))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        r["length"].alias("length"), r["host_length"].alias("host_length"), r["allow"].alias("allow"), r["rule"].alias("rule"))))
    return best


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, best) of a table of rules (verdict, host, path), one row per host and path.

    A rule without a host is none, a null path is empty; another verdict than
    allow or block is an error.
    """
    verdict = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict") == "allow").otherwise(
        F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("null")))).cast("boolean"))
    path = F.coalesce("path", F.lit(""))
    rule = F.concat("host", path)
    best = F.struct(F.char_length(rule).alias("length"), F.char_length("host").alias("host_length"), verdict.alias("allow"),
                    rule.alias("rule"))
    return rules.where("host is not null").groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), path.alias("rule_path")).agg(
        F.max(best).alias("best"))


def attach_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``rows`` (host, path and more) with ``best``, the rule of ``matching_rule``.

    A table of rules may have any size and any number of rules for one host:
    different hosts and paths meet the rules by host, which only tells the
    lengths of paths that rules of this host have, and then by host and that
    much of their own path.  No row is compared with more rules than can fit.
    """
    if not isinstance(rules, DataFrame):
        return rows.withColumn("best", matching_rule(F.col("host"), F.col("path"), rules))
    known = rule_table(rules)
    lengths = known.groupBy(F.reverse("rule_host").alias("s")).agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))
    asked = rows.select("host", "path").distinct()
    below = asked.withColumn("s", F.explode(F.transform(_suffixes(F.col("host")), F.reverse))).join(lengths, "s")
    heads = below.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path")))).select(
        "host", "path", "s", F.left("path", F.col("n")).alias("head"))
    fitting = heads.join(known.select(F.reverse("rule_host").alias("s"), F.col("rule_path").alias("head"), "best"), ["s", "head"])
    best = fitting.groupBy("host", "path").agg(F.max("best").alias("best"))
    keys = [F.reverse(c).alias(f"_{c}") for c in ("host", "path")]
    return rows.select("*", *keys).join(best.select(*keys, "best"), ["_host", "_path"], "left").drop("_host", "_path")


def absolute(target: Column, base: Column) -> Column:
    """A link target seen from a page; null if it leads nowhere."""
    head = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    below = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(base.contains("://"), _let(F.trim(F.regexp_replace(target, "&amp;", "&")), lambda link: (
        F.when((link == "") | F.startswith(link, F.lit("#")), F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(head, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .otherwise(F.concat(below, link)))))


def page_links(pages: DataFrame, url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(a, b): a page and the URL that its canonical link or its refresh redirect names."""
    tags = F.regexp_extract_all(F.col("body"), F.lit(LINK_TAG), F.lit(0))
    tagged = pages.select(F.col(url_col).alias("url"), F.col(body_col).alias("body")).select(
        "url", F.explode(F.filter(tags, lambda t: t.rlike(CANONICAL) | t.rlike(REFRESH))).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", HREF, i) for i in (1, 2, 3)])
    target = F.when(F.col("tag").rlike(CANONICAL), href).otherwise(F.regexp_extract("tag", REFRESH_URL, 1))
    named = tagged.select(F.explode(F.array(F.struct(url_node(F.col("url")).alias("a"), url_node(
        absolute(target, F.col("url"))).alias("b")))).alias("e"))
    return named.select("e.a", "e.b").where("a is not null and b is not null and a != b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url",
          body_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per row: (id, host, path, rule, verdict).

    ``rules`` is a list of (verdict, host, path), or a table of any size with these columns.

    A page that a rule fits has the rule's verdict.  Others take part in the
    equivalence that canonical links, refresh redirects and ``redirects``
    (from_url, to_url) span: if a rule allows any alias the page is allowed
    (explicit allow precedes), else if a rule blocks any alias it is blocked.  Pages
    without either are allowed.  A null URL, or one without ``://``, has an
    empty host and path, no rule and no aliases.  Aliases need not be pages.
    Repeated rows are judged alike; an empty table gives an empty result.
    Other columns are not looked at.
    """
    linked = page_links(pages, url_col, body_col)
    if redirects is not None:
        linked = linked.union(redirects.select(url_node(F.col("from_url")), url_node(F.col("to_url"))))
    reach = connected_components(linked, "a", "b")
    named = reach.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))})
    ruled = attach_rules(named, rules)
    decided = (ruled.groupBy("component").agg(F.max("best.allow").alias("allow")).where("allow is not null")
               .select(F.reverse("component").alias("k"), "allow"))
    reached = cut_lineage(reach.withColumn("k", F.reverse("component")).join(decided, "k").select("node", "allow"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = rows.select(
        "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.when(url_host(F.col("url")) != "", url_node(F.col("url"))).alias("node"))
    judged = attach_rules(judged, rules)
    kind = reached.schema["node"].dataType
    found = judged.withColumn("k", flipped("node", kind)).join(
        reached.select(flipped("node", kind).alias("k"), "allow"), "k", "left")
    allow = F.coalesce("best.allow", "allow", F.lit(True))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                        F.when(allow, "allow").otherwise("block").alias("verdict"))
