"""URL filters that see through redirects.

A rule names a host, with all its subdomains, and the start of a path; the longest that fits a URL decides. URLs that redirect to one another or
name one another as canonical are aliases: connected components over those links carry a block to all aliases that have no rule of their own, unless
an alias is explicitly allowed. DataFrame functions only; pages' HTML is read once and only links go on.

Up to LITERAL rules are part of the plan, so that no row moves. More rules, or a table of them of any size, are joined: each distinct host and path
meets the rules of its host's suffixes by the starts of its path that are as long as a rule of that host, so no URL is held against all rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlog.llm.common import saved
from ordlog.llm.components import components

#: (verdict, host, path): the host and its subdomains, the start of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are part of the plan, at most; a longer list is a table.
LITERAL = 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null; of two equally long the one with the longer host."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    if not order:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    known = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in order])
    fits = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["verdict"].alias("verdict"), F.concat(first["host"], first["path"]).alias("rule")))


def with_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, host: str, path: str, out: str) -> DataFrame:
    """Adds `ruled` of the columns host and path. A table of rules has verdict, host and path."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= LITERAL:
            return df.withColumn(out, ruled(F.col(host), F.col(path), rules))
        rules = df.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = saved(rules.select("verdict", F.col("host").alias("_rh"), F.col("path").alias("_rp")).where("_rh is not null and _rp is not null").distinct())
    sizes = rules.groupBy("_rh").agg(F.collect_set(F.length("_rp")).alias("_sizes"))  # one for each length of a path, not for each rule
    urls = df.select(F.col(host).alias("_h"), F.col(path).alias("_p")).distinct()
    parts = F.split("_h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = urls.select("*", F.explode(F.array_distinct(suffixes)).alias("_rh")).join(sizes, "_rh").select("_h", "_p", "_rh", F.explode("_sizes").alias("_n"))
    met = met.where(F.col("_n") <= F.length("_p")).withColumn("_rp", F.left("_p", F.col("_n"))).join(rules, ["_rh", "_rp"])
    order = F.struct(-F.length(F.concat("_rh", "_rp")), -F.length("_rh"), "verdict", "_rh", "_rp")
    best = met.groupBy("_h", "_p").agg(F.min_by(F.struct("verdict", F.concat("_rh", "_rp").alias("rule")), order).alias(out))
    best = saved(best)
    return df.join(best, (F.col(host) == F.col("_h")) & (F.col(path) == F.col("_p")), "left").drop("_h", "_p")


def node_of(url: Column) -> Column:
    """A URL without its fragment, which names a place in the same page; scheme and host count in any case."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^[^/?]*://[^/?]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


def without_dots(path: Column) -> Column:
    """A path that begins with / without its . and .. parts."""
    parts = F.slice(F.split(path, "/", -1), 2, F.greatest(F.lit(1), F.size(F.split(path, "/", -1)) - 1))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    end = F.when(F.rlike(path, F.lit(r"/\.\.?$")) & (F.size(kept) > 0), "/").otherwise("")
    return F.when(F.rlike(path, F.lit(r"/\.\.?(/|$)")), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def absolute(base: Column, link: Column) -> Column:
    """A link's URL: absolute links as they are, //host links by the base's scheme, /path links by its host, ?query links by its path and others by
    its path's directory; null for other schemes and for bases without ://."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    link = F.regexp_replace(link, "(?s)#.*$", "")
    root = F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    own, query = F.regexp_extract(link, r"(?s)^[^?]*", 0), F.regexp_extract(link, r"(?s)\?.*$", 0)
    beside = F.concat(F.regexp_extract(path, "(?s)^(.*/)", 1), own)
    return (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link).when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), link))
        .when((root == "") | F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.startswith(link, F.lit("/")), F.concat(root, without_dots(own), query))
        .when(link == "", base).when(own == "", F.concat(root, path_of(base), query)).otherwise(F.concat(root, without_dots(beside), query))
    )


def links(pages: DataFrame) -> DataFrame:
    """(a, b): the edges that pages' HTML declares by canonical links and refreshing redirects, by all tags of either kind. Null URLs and HTML declare
    none."""
    tags = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(0))
    canonical = F.transform(
        tags(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"),
        lambda t: F.regexp_replace(F.regexp_extract(t, r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0), r"(?i)^href\s*=\s*[\"']?|[\"']$", ""),
    )
    refresh = F.transform(tags(r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1))
    told = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull() & F.rlike("html", F.lit("(?i)canonical|http-equiv")))
    got = told.select("url", F.explode(F.filter(F.concat(canonical, refresh), lambda x: x != "")).alias("to"))
    return got.select(node_of(F.col("url")).alias("a"), node_of(absolute(F.col("url"), F.col("to"))).alias("b")).where("b is not null and a != b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. rules: (verdict, host, path), or a table of these. redirects: more links, from_url and to_url.

    A page with a rule has its verdict; of rules of equal length the one with the longer host, then allow. Another page has allow if an alias is
    explicitly allowed, else block if one is blocked, else allow. Null URLs and those without :// have an empty host and path, no rule and
    no alias: allow. Repeated rows are judged each; null page_ids, null and very long HTML are fine; other columns are ignored. An empty table
    gives no rows; without rules all is allowed.
    """
    edges = links(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = edges.unionByName(more.where("a is not null and b is not null and a != b"))
    roots = components(edges).select("node", "root", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    verdict = F.col("_r.verdict")
    flags = with_rules(roots, rules, "host", "path", "_r").groupBy("root").agg(F.coalesce(F.bool_or(verdict == "allow"), F.lit(False)).alias("_allow"), F.coalesce(F.bool_or(verdict == "block"), F.lit(False)).alias("_block"))
    blocked = saved(flags.where(F.col("_block") & ~F.col("_allow")).select("root"))
    aliases = saved(roots.join(blocked, "root", "left_semi").select(F.col("node").alias("_node")))
    own = pages.select("page_id", node_of(F.col("url")).alias("_node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = with_rules(own, rules, "host", "path", "_r").join(aliases.withColumn("_hit", F.lit(True)), "_node", "left")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.when(F.col("_hit"), "block"), F.lit("allow")).alias("verdict"))


_NODE = "regexp_replace({}, '(?s)#.*$', '')"
_HREF = "regexp_replace(regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>', 0), '(?i)\\bhref\\s*=\\s*(?:\"[^\"]*\"|''[^'']*''|[^\\s>\"'']+)', 0), '(?i)^href\\s*=\\s*[\"'']?|[\"'']$', '', 'g')"
_META = "regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>', 0), '(?i)\\burl\\s*=\\s*([^\"''\\s>]+)', 1)"
_SPLIT = """translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
 coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path"""
SQL = f"""with recursive rules(v, h, p) as (values {", ".join(str(r) for r in RULES)}),
raw as (select url, t from (select url, {_HREF} t from pages where url is not null and html is not null union all
 select url, {_META} from pages where url is not null and html is not null) where t <> ''),
abs as (select url, case when contains(l, '://') then l when starts_with(l, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || l
 when starts_with(l, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || l end t from (select url, replace(trim(t), '&amp;', '&') l from raw)),
e as (select {_NODE.format("url")} a, {_NODE.format("t")} b from abs where t is not null), both_ways as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(a, b) as (select a, b from both_ways union select r.a, x.b from reach r join both_ways x on r.b = x.a),
nodes as (select distinct a, b, {_SPLIT.format("b")} from reach),
told as (select a, arg_max(v, length(h || p) * 1000 + length(h)) v from (select n.a, n.b, r.* from nodes n join rules r on (n.host = r.h or ends_with(n.host, '.' || r.h)) and starts_with(n.path, r.p)) group by a, b),
flags as (select a, bool_or(v = 'allow') al, bool_or(v = 'block') bl from told group by a),
own as (select row_number() over () id, page_id, {_NODE.format("url")} node, {_SPLIT.format("url")} from pages),
best as (select id, arg_max(h || p, length(h || p) * 1000 + length(h)) as rule, arg_max(v, length(h || p) * 1000 + length(h)) v from own join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by id)
select page_id, host, path, best.rule as rule, coalesce(best.v, case when flags.bl and not flags.al then 'block' else 'allow' end) verdict
from own left join best on best.id = own.id left join flags on flags.a = own.node"""
