"""URL filters over hosts and paths, with decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import UPPER, col, cut, small
from rowloom.llm.graph import components

# Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Variants of urls that sites redirect (regular expressions that Java and RE2 read alike), and entities in links.
ALIAS_HOST = r"^((www|m|mobile|amp)\.)+"
ALIAS_PATH = r"(/index\.html?|\.html?|/)+$"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_[ce]id)(=|$)"
ENTITIES = {"&(?:amp|#0*38|#[xX]0*26);": "&", "&(?:#0*47|#[xX]0*2[fF]|sol);": "/", "&(?:#0*61|#[xX]0*3[dD]|equals);": "="}


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path joined) and its verdict; both null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(r) -> Column:
        return ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])

    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        name = F.when(fits(r), F.lit(r[0] + r[1])).otherwise(name)
        verdict = F.when(fits(r), F.lit(r[2])).otherwise(verdict)
    return name, verdict


def node_of(url: Column) -> Column:
    """What makes urls the same: host, path and query, without scheme and fragment; null without a host."""
    host = host_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, path_of(url), query))


def canonical_node(node: Column) -> Column:
    """The form of a node to which sites redirect its variants: the host without leading www, m, mobile or amp, the
    path without trailing slashes, .html and index.html, the query without TRACKING parameters. It's its own form."""
    url = F.concat(F.lit("x://"), node)
    host = F.regexp_replace(host_of(url), ALIAS_HOST, "")
    path = F.regexp_replace(path_of(url), ALIAS_PATH, "")
    given = F.regexp_extract(node, r"(?s)^[^?]*\?(.*)$", 1)
    rest = F.filter(F.split(given, "&", -1), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(rest) > 0, F.concat(F.lit("?"), F.array_join(rest, "&"))).otherwise(F.lit("")))


def without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken."""
    steps = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))),
    )
    ends = F.when(path.rlike(r"(?:^|/)\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.array_join(steps, "/"), ends)).otherwise(path)


def absolute(link: Column, url: Column) -> Column:
    """A link of the page at ``url``, in full."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, without_dots(path), rest))
        .when((link == "") | link.startswith("#"), url)
        .when(link.startswith("?"), F.concat(site, path_of(url), link))
        .otherwise(F.concat(site, without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), rest))
    )


def _plain(value: Column) -> Column:
    """An attribute's value without the entities that urls need."""
    for entity, sign in ENTITIES.items():
        value = F.regexp_replace(value, entity, sign)
    return value


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): the nodes of a page and of what its canonical links and refreshes name."""
    html = F.coalesce(col(html_col).cast("string"), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    value = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"

    def attribute(tag: Column, name: str) -> Column:
        return _plain(F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}{value}", i), F.lit("")) for i in (1, 2, 3)], F.lit("")))

    def target(tag: Column) -> Column:
        to = F.regexp_extract(attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)
        return F.when(
            F.lower(attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)"), F.nullif(F.trim(attribute(tag, "href")), F.lit(""))
        ).when(F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh", F.nullif(F.trim(to), F.lit("")))

    def base(tags: Column) -> Column:
        found = F.filter(tags, lambda t: F.lower(F.substring(t, 1, 5)) == "<base")
        return F.nullif(F.trim(attribute(F.coalesce(F.get(found, F.lit(0)), F.lit("")), "href")), F.lit(""))

    # most pages have neither word, and are done
    some = pages.where(html.rlike("(?i)canonical|refresh")).select(col(url_col).cast("string").alias("page_url"), tags.alias("tags"))
    some = some.select("page_url", base(F.col("tags")).alias("base"), F.explode(F.transform("tags", target)).alias("link")).where("link is not null")
    some = some.withColumn("at", F.when(F.col("base").isNull(), F.col("page_url")).otherwise(absolute(F.col("base"), F.col("page_url"))))
    some = some.withColumn("to", absolute(F.col("link"), F.col("at")))
    return _edges(some, node_of(F.col("page_url")), node_of(F.col("to")))


def _edges(rows: DataFrame, u: Column, v: Column) -> DataFrame:
    """(u, v), made by a generator: filters on them would otherwise repeat all that they are made of."""
    return rows.select(F.inline_outer(F.array(F.struct(u.alias("u"), v.alias("v")))))


def judge(
    pages: DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules=tuple(RULES),
) -> DataFrame:
    """(id, host, path, rule, verdict, via) for each row of ``pages``.

    A url that a rule fits has the longest rule's verdict (``via`` rule). Other urls take the verdict of their aliases:
    urls tied by redirects are one class, whether they are pages or only targets. Redirects are the canonical links
    and refreshes in the HTML, the rows of ``redirects`` (columns source and target), and those that sites make from
    the usual variants of a url to its canonical form (see ``canonical_node``). In a class, an explicit allow of any
    member comes before blocks; without one, a blocked member blocks the rest (``via`` alias). All else is allowed
    (``via`` default).

    Null urls and urls without ``://`` have an empty host and path, no rule and no aliases. Null HTML has no links.
    Repeated rows stay rows; a hub that very many pages name is one class, found without gathering its members in
    one place. An empty table gives an empty table; other columns are ignored."""
    url = col(url_col).cast("string")
    rows = pages.select(col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("page_node"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", "page_node", name.alias("rule"), verdict.alias("own"))
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")))
    ends = edges.select(F.explode(F.array("u", "v")).alias("u")).unionByName(pages.select(node_of(url).alias("u")))
    edges = edges.unionByName(_edges(ends, F.col("u"), canonical_node(F.col("u"))))
    edges = cut(edges.where("u is not null and v is not null and u <> v").distinct(), "links")
    nodes = cut(components(edges), "classes")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    _, decided = rule_of(host_of(as_url), path_of(as_url), rules)
    by_root = (
        nodes.select("root", decided.alias("own"))
        .groupBy("root")
        .agg(F.when(F.max(F.col("own") == "allow"), "allow").when(F.max(F.col("own") == "block"), "block").alias("spread"))
        .where("spread is not null")
        .withColumnRenamed("root", "r")
    )
    # written first, so that the join on a hub's class is broadcast or one that adaptive execution can split
    found = cut(nodes.join(small(cut(by_root, "verdicts")), F.col("root") == F.col("r")).select("node", "spread"), "aliases")
    spread = F.when(F.col("own").isNull(), F.col("spread"))
    return rows.join(small(found), F.col("page_node") == F.col("node"), "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("own", spread, F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(spread.isNotNull(), "alias").otherwise("default").alias("via"),
    )
