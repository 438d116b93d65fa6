"""URL filters with redirect equivalence (native DataFrame operations only).

A page's own rule decides first: the longest rule (host and path) whose host is the page's or
a parent of it and whose path begins the page's. Pages without one take the decision of their
aliases: connected components over redirect edges (meta refresh) and canonical-link edges,
found in the pages' HTML or given as a table. A component that holds an explicitly allowed url
is allowed, else one that holds a blocked url is blocked, else it is allowed.

Rules are a table of any size: each url's host suffixes are looked up by an equi-join, one
small row per rule host, so no url meets a rule of another host.

Defined results: a null url, or one without "://", has an empty host and path, no rule and no
aliases, and is allowed. Repeated pages get the same answer. Without edges every component is
a single url. Hosts are compared as they stand, ports included. Links are
resolved against the page's url, or its <base href>, and &amp; in them is &; OP10_SQL, for pages
without relative links, takes only those with "://", as they stand. Html of any length is
searched whole; null html has no links. Columns of `pages` but page_id, url and html are not
read, so that their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from .components import connected_components

#: The contract's rules, in its order.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUOTED = r"""\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Columns verdict, rule, rule_host, rule_path."""
    rows = [(v, r, r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def _without_dots(path: Column) -> Column:
    """An absolute path with its . and .. segments applied."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(link: Column, base: Column) -> Column:
    """The link as an absolute url, absolute ones as they stand; null for an empty link, a mere
    fragment, a scheme without "://" and a relative link of a base without scheme and host."""
    origin = F.regexp_extract(base, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    based, path, tail = origin != "", F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when((link == "") | F.startswith(link, F.lit("#")), None)
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), link)
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), None)
        .when(based & F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), link))
        .when(based & F.startswith(link, F.lit("/")), F.concat(origin, _without_dots(path), tail))
        .when(based & F.startswith(link, F.lit("?")), F.concat(origin, path_of(base), tail))
        .when(based, F.concat(origin, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), tail))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (source, target) from canonical links, og:url and meta refreshes of the HTML,
    resolved against the page's url or its <base href>."""
    html = F.coalesce("html", F.lit(""))
    tag = lambda pattern: F.regexp_extract(html, pattern, 0)
    plain = lambda link: F.regexp_replace(link, "(?i)&amp;", "&")
    canonical = F.regexp_extract(tag(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), r"(?is)\bhref" + _QUOTED, 1)
    og = F.regexp_extract(tag(r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:url\b[^>]*>"""), r"(?is)\bcontent" + _QUOTED, 1)
    refresh = F.regexp_extract(tag(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+(?:(?<=&amp);[^"'\s>;]*)*)""", 1)
    base = F.regexp_extract(tag(r"(?is)<base\b[^>]*>"), r"(?is)\bhref" + _QUOTED, 1)
    links = pages.where("url is not null").select("url", base.alias("base"), F.explode(F.filter(F.array(canonical, og, refresh), lambda t: t != "")).alias("link"))
    own = F.coalesce(resolved(plain(F.col("base")), F.col("url")), F.col("url"))
    return links.select(F.col("url").alias("source"), resolved(plain(F.col("link")), own).alias("target")).where("target is not null")


def own_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds host, path, rule and own (the rule's verdict) to distinct urls."""
    listed = rules.groupBy("rule_host").agg(
        F.sort_array(F.collect_set(F.struct(F.length("rule").alias("n"), "rule_path", "rule", "verdict")), asc=False).alias("choices")
    )
    u = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    long = u.select("url", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host")
    fits = long.select("url", F.get(F.filter("choices", lambda c: F.startswith(F.col("path"), c["rule_path"])), F.lit(0)).alias("best")).where("best is not null")
    best = fits.groupBy("url").agg(F.max("best").alias("best"))
    return u.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and the number of aliases."""
    edges = page_edges(pages) if edges is None else edges.select("source", "target")
    # Urls themselves are the nodes: no two are ever taken for one.
    component = connected_components(edges.where("source is not null and target is not null"), "source", "target")
    known = pages.select("url").unionAll(edges.select("source")).unionAll(edges.select("target")).where("url is not null").distinct()
    judged = cut(own_rules(known, rules).join(component, F.col("node") == F.col("url"), "left").drop("node"), "judged")
    own = F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1).otherwise(0)
    linked = judged.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    decided = linked.groupBy("component", "salt").agg(F.max(own).alias("found"), F.count("*").alias("n")).groupBy("component").agg(F.max("found").alias("found"), F.sum("n").alias("n_aliases"))
    decided = decided.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))  # a component may hold a third of the urls
    told = linked.join(decided, ["component", "salt"]).select("url", "host", "path", "rule", "own", "found", "n_aliases")
    alone = judged.where("component is null").select("url", "host", "path", "rule", "own", F.lit(0).alias("found"), F.lit(1).cast("bigint").alias("n_aliases"))
    one = alone.unionAll(told).select("url", "host", "path", "rule", F.coalesce("own", F.when(F.col("found") == 1, "block").otherwise("allow")).alias("verdict"), "n_aliases")
    return pages.select("page_id", "url").join(one, "url", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("n_aliases", F.lit(1)).alias("n_aliases"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


#: Closure over the edges by recursion; rules by a join on host and path.
OP10_SQL = r"""
with recursive p as (
  select page_id, url, html from pages
), edges as (
  select url as source, unnest([
    regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bproperty\s*=\s*["'']?og:url\b[^>]*>', 0, 'is'), '\bcontent\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'is')]) as target
  from p where html is not null and url is not null
), u as (
  select distinct url,
    case when contains(coalesce(url, ''), '://') then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's') else '' end as h0,
    case when contains(coalesce(url, ''), '://') then regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') else '' end as path
  from (select url from p union all select unnest([source, target]) from edges)
), e as (
  select source as a, target as b from edges where contains(target, '://')
  union select target, source from edges where contains(target, '://')
), reach(a, b) as (
  select a, b from e union select r.a, e.b from reach r join e on r.b = e.a
), rules(verdict, rule, host, path) as (
  values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
    ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), own as (
  select url, any_value(translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as host, any_value(u.path) as path,
    max_by(r.rule, length(r.rule)) as rule, max_by(r.verdict, length(r.rule)) as verdict
  from u left join rules r on
    (translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = r.host
      or ends_with(translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.' || r.host))
    and starts_with(u.path, r.path)
  group by url
), shared as (
  select r.a as url, max(case o.verdict when 'allow' then 2 when 'block' then 1 else 0 end) as found
  from reach r join own o on r.b = o.url group by r.a
)
select p.page_id, coalesce(o.host, '') as host, coalesce(o.path, '') as path, o.rule,
  coalesce(o.verdict, case when s.found = 1 then 'block' else 'allow' end) as verdict
from p left join own o on p.url is not distinct from o.url left join shared s on p.url = s.url
"""
