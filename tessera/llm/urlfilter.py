"""URL filter with redirect equivalence.

Explicit rules judge a url by host and path. Block and allow decisions spread to aliases: pages are nodes named by their
canonical form, redirects and canonical links are edges, and a distributed connected-components job finds the classes.
Within a class an allow takes precedence over any block; a page's own rule takes precedence over its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, rule); a rule is a host, then a path from its first slash on.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Up to so many rules are judged in an expression over each row; more are joined on the host's suffixes.
INLINE_RULES = 64
#: The rows of a suffix that most pages have are dealt to so many tasks, each with the rules.
SALT = 32


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first ://, else null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The name under which a url stands for its redirect class: without scheme, fragment, tracking parameters and last
    slash, with the host in lower case and no . or .. segments. Null for a url without ://."""
    rest = F.regexp_replace(after_scheme(url), r"#.*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(?:utm_[a-z]+|fbclid|gclid)=[^&]*", ""), r"^&", "")
    name = F.concat(host_of(url), F.regexp_replace(without_dots(path_of(url)), r"/$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(rest.isNotNull(), name)


def key_of(name: Column) -> Column:
    """A node's name as 16 bytes of its SHA-256: shorter than most urls, and no two are taken for one by chance or intent."""
    return F.substring(F.unhex(F.sha2(name, 256)), 1, 16)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.array_append(a, x))
    segments = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(segments, "/")).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """A link's target as an absolute url, on a page of url base. Null for a scheme without :// (mailto:), or without ://
    in base if the target needs it."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(base), r"^[^/?#]*", 0))
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.instr(base, "://") == 0, F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), target))
    )


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, without white space around it and line breaks in it; empty without one."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^"'\s>]+))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    return F.trim(F.translate(F.replace(value, F.lit("&amp;"), F.lit("&")), "\t\n\r", ""))


def first_of(tags: Column, value) -> Column:
    """The first value of the tags that isn't empty; null without one."""
    return F.get(F.filter(F.transform(tags, value), lambda v: v != ""), F.lit(0))


def refresh_of(tag: Column) -> Column:
    """The target of content="0; url=target", in quotes or not; without a whole attribute, what follows url= in the tag."""
    rest = F.regexp_extract(attribute(tag, "content"), r"(?is)^\s*[0-9.]*\s*[;,]?\s*(?:url\s*=\s*)?(.*)$", 1)
    quoted = F.concat(F.regexp_extract(rest, r"""(?s)^"([^"]*)""", 1), F.regexp_extract(rest, "(?s)^'([^']*)", 1))
    to = F.trim(F.when(rest.rlike("^[\"']"), quoted).otherwise(rest))
    loose = F.regexp_extract(tag, r"""(?is)(?<![\w-])url\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.when(to != "", to).otherwise(F.replace(loose, F.lit("&amp;"), F.lit("&")))


def links_of(html: Column) -> Column:
    """The targets of a page's canonical link and of its refresh, as they are written: the first of each that has one. A tag
    holds no other tag's start, so that one which isn't closed is read up to the next only."""
    rel = r"""(?is)(?<![\w-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|["']?canonical(?![\w-]))"""
    link = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^<>]*+>"), F.lit(0)), lambda t: t.rlike(rel))
    meta = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^<>]*+>"), F.lit(0)), lambda t: t.rlike(r"""(?is)(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b"""))
    has = F.lower(html)
    canonical = F.when(F.contains(has, F.lit("canonical")), first_of(link, lambda t: attribute(t, "href")))
    refresh = F.when(F.contains(has, F.lit("refresh")), first_of(meta, refresh_of))
    return F.filter(F.array(canonical, refresh), lambda t: t.isNotNull())


def base_of(html: Column) -> Column:
    """The href of a page's base tag; null without one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<base\b[^<>]*+>"), F.lit(0))
    return F.when(F.contains(F.lower(html), F.lit("<base")), first_of(tags, lambda t: attribute(t, "href")))


def link_edges(s: Scratch, judged: DataFrame) -> DataFrame:
    """judged(node, targets, base_url, base_href): an edge (a, b) for each target that resolves; an end is null without a
    node. Links are written before they are resolved, and named before they are filtered: pushed down, a filter on a name
    would write the expressions out once for each use of the columns that they read."""
    rows = judged.where("size(targets) > 0").select("node", F.coalesce(resolved(F.col("base_url"), F.col("base_href")), "base_url").alias("base"), F.explode("targets").alias("target"))
    rows = s.table(rows, "links").withColumn("to", resolved(F.col("base"), F.col("target")))
    return s.table(rows.select(F.col("node").alias("a"), key_of(node_of(F.col("to"))).alias("b")), "edges")


def match_rules(df: DataFrame, rules: list[tuple[str, str]], key: str) -> DataFrame:
    """df(key, host, path, ...) with rule and action: the longest rule whose host is df's host or a parent domain of it
    and whose path is a prefix of df's path; of equally long ones an allow, then the first by code points. Of equal rules
    with both actions, allow wins. Null without a rule. The result is the same for any number of rules."""
    best: dict[str, str] = {}
    for action, rule in rules:
        if best.get(rule) != "allow":
            best[rule] = action
    ordered = sorted(best.items(), key=lambda x: (-len(x[0]), x[1] != "allow", x[0]))
    parts = [(rule, action, rule.partition("/")[0], "/" + rule.partition("/")[2] if "/" in rule else "") for rule, action in ordered]
    if len(parts) <= INLINE_RULES:
        hit = F.lit(None).cast("struct<rule:string,action:string>")
        for rule, action, host, path in reversed(parts):
            fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
            hit = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(hit)
        return df.withColumn("_hit", hit).withColumns({"rule": F.col("_hit.rule"), "action": F.col("_hit.action")}).drop("_hit")
    table = df.sparkSession.createDataFrame(parts, "rule string, action string, rule_host string, rule_path string")
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    names = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.lit(1 << 20)), "."))
    found = df.select(key, "path", F.explode(suffixes).alias("rule_host")).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))
    found = found.join(table, ["rule_host", "_salt"]).where(F.col("path").startswith(F.col("rule_path")))
    found = found.groupBy(key).agg(F.min_by(F.struct("rule", "action"), F.struct((-F.length("rule")).alias("n"), (F.col("action") != "allow").alias("no"), F.col("rule"))).alias("_hit"))
    return df.join(found, key, "left").withColumns({"rule": F.col("_hit.rule"), "action": F.col("_hit.action")}).drop("_hit")


def filter_urls(spark: SparkSession, pages: DataFrame, redirects: DataFrame | None = None, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages(page_id, url, html, ...): (page_id, host, path, rule, verdict, class_id), a row for each row of pages.

    Edges are the canonical links and refreshes in html, resolved against the page's url or its base tag, and
    redirects(from_url, to_url). verdict: the rule's action; else allow if the
    class holds an allowed page, block if it holds a blocked one, allow if neither. A null url, or one without ://, has
    empty host and path, is in no class and is allowed. A null html has no link. Repeated rows are each judged. Other
    columns are ignored, so their names can't clash. An empty table gives an empty result. class_id is the smallest key
    of a node in the class, null without a node.
    """
    s = Scratch(spark)
    url, html = F.col("url"), F.col("html")
    base = pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_name"), url.alias("base_url"), html.alias("_html"), links_of(html).alias("targets"))
    some = F.size("targets") > 0
    base = base.withColumns({"node": key_of(F.col("_name")), "base_url": F.when(some, F.col("base_url")), "base_href": F.when(some, base_of(F.col("_html"))), "_row": F.monotonically_increasing_id()}).drop("_name", "_html")
    if len(rules) > INLINE_RULES:
        base = s.table(base, "numbered")  # rules are then joined by row number
    judged = s.table(match_rules(base, rules, "_row"), "judged")
    edges = link_edges(s, judged)
    if redirects is not None:
        edges = edges.union(redirects.select(key_of(node_of(F.col("from_url"))).alias("a"), key_of(node_of(F.col("to_url"))).alias("b")))
    comp = connected_components(spark, edges)
    # Only classes with a decision matter: their rows are aggregated first, so a class of any size costs a row a task.
    decided = judged.where("node is not null and action is not null").groupBy("node").agg(F.max(F.col("action") == "allow").alias("allowed"))
    decided = decided.join(comp, "node", "left").select(F.coalesce("comp", "node").alias("class_id"), "allowed").groupBy("class_id").agg(F.max("allowed").alias("allowed"))
    decided = s.table(decided, "decided")
    rows = s.table(judged.join(comp, "node", "left").withColumn("class_id", F.coalesce("comp", "node")), "classes")
    s.keep("decided", "classes")
    verdict = F.coalesce("action", F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block"), F.lit("allow"))
    return rows.join(decided, "class_id", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "class_id")
