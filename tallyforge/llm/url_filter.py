"""URL filtering with redirect equivalence. DataFrame functions only.

Every url is split into host and path and judged by the longest fitting rule. Urls without a rule take the decision of
their aliases: redirect and canonical-link edges join urls into components, a component with an explicit allow is
allowed, one with a block and no allow is blocked, all others are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, fresh, spread_join, stage, table

Rule = tuple[str, str, str]  # action (allow or block), host, path

#: The rules of the query.
RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Up to so many rules are held as one literal on every executor; more are joined to the urls.
MOST_RULES = 1000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased. Null or no ``://``: empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end. Null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(size, rank, action, rule) of the longest rule for the host or a domain above it whose path begins the path; else null.

    Of rules with equal length the allowing one wins, then the greater text.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,rank:int,action:string,rule:string>")
    by_host: dict[str, list[Column]] = {}
    for action, h, p in rules:
        by_host.setdefault(h, []).append(F.struct(
            F.lit(len(h + p)).alias("size"), F.lit(int(action == "allow")).alias("rank"), F.lit(action).alias("action"),
            F.lit(h + p).alias("rule"), F.lit(p).alias("path"),
        ))
    held = F.map_from_arrays(F.array(*[F.lit(h) for h in by_host]), F.array(*[F.array(*r) for r in by_host.values()]))
    parts = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    none = F.array().cast("array<struct<size:int,rank:int,action:string,rule:string,path:string>>")
    fitting = F.filter(
        F.flatten(F.transform(domains, lambda d: F.coalesce(F.try_element_at(held, d), none))), lambda r: F.startswith(path, r["path"])
    )
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["rank"], r["action"], r["rule"])))


def _domains(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_rule(rows: DataFrame, rules: DataFrame | Sequence[Rule], host: str, path: str, to: str) -> DataFrame:
    """``rows`` with the longest rule for the columns ``host`` and ``path`` as the struct ``to`` (see ``longest_rule``).

    rules: a list, or a table (action, host, path) of any size; rules with a null are ignored. Above MOST_RULES, distinct
    urls meet the rules by (domain, beginning of the path), for the lengths that the rules of that domain have; joins deal
    hot domains (a rule for ``com`` meets half of all urls) to many tasks.
    """
    spark = rows.sparkSession
    if isinstance(rules, DataFrame):
        rules = rules.select("action", "host", "path").dropna()
        few = [tuple(r) for r in rules.limit(MOST_RULES + 1).collect()]
    else:
        few = list(rules[: MOST_RULES + 1])
    if len(few) <= MOST_RULES:
        return rows.withColumn(to, longest_rule(F.col(host), F.col(path), few))
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")

    def name(a: Column, b: Column) -> Column:
        return F.md5(F.concat_ws("\n", a, b))  # neither part holds a line break that could move: hosts of rules have none

    rule = F.concat("host", "path")
    made = F.struct(F.length(rule).alias("size"), (F.col("action") == "allow").cast("int").alias("rank"), F.col("action").alias("action"), rule.alias("rule"))
    by_name = rules.groupBy(name(F.col("host"), F.col("path")).alias("name")).agg(F.max(made).alias("best"))
    lengths = rules.groupBy(F.col("host").alias("domain")).agg(F.collect_set(F.length("path")).alias("lengths"))
    known = name(F.col(host), F.col(path))
    urls = rows.select(F.col(host).alias("host"), F.col(path).alias("path")).distinct()
    near = stage(urls.withColumn("domain", F.explode(_domains(F.col("host")))), "domains")
    near = spread_join(near, lengths, "domain")
    tried = near.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("name", name(F.col("domain"), F.substring("path", F.lit(1), F.col("n"))))
    tried = stage(tried.select(name(F.col("host"), F.col("path")).alias("url"), "name"), "tried")
    url, best = (fresh(rows.columns, c) for c in ("url_name", "best_rule"))
    found = spread_join(tried, by_name, "name").groupBy("url").agg(F.max("best").alias(best)).withColumnRenamed("url", url)
    joined = spread_join(rows.withColumn(url, known), found, url, "left").withColumnRenamed(best, to)
    return joined.select(*[c for c in rows.columns if c != to], to)


def redirect_target(url: Column) -> Column:
    """Where a site sends this spelling of a url: https, host in lower case without ``www.``, no fragment, no tracking
    parameters (utm_*, ref), no slash at the end of a path. Null where the url has no ``://``."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[a-z]*|ref)(=|$)") & (p != "")), "&")
    made = F.concat(F.lit("https://"), host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), made)


def absolute(target: Column, url: Column) -> Column:
    """A link's target as an absolute url: as it is where it names a scheme and ``://``, else resolved against ``url`` (no
    dot segments are folded). Null for an empty target, one inside the page (#...) or with another kind of scheme, and a
    relative one where ``url`` has no ``://``."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | F.startswith(target, F.lit("#")) | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~F.contains(url, F.lit("://")), None)
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(url, r"(?s)^(.*?):", 1), F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, folder, target))
    )


def canonical_target(html: Column, url: Column) -> Column:
    """The absolute target of a page's canonical link, or else of its refresh, else null."""
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    href = F.regexp_extract(link, r"(?is)\bhref\s*=\s*[\"']?([^\s\"'>]+)", 1)
    to = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\s\"'>]+)", 1)
    marked = F.contains(html, F.lit("canonical")) | F.contains(html, F.lit("refresh"))
    return F.when(marked, F.coalesce(absolute(href, url), absolute(to, url)))


def filter_urls(urls: DataFrame, edges: DataFrame, rules: DataFrame | Sequence[Rule]) -> DataFrame:
    """Judge ``urls`` (url and any other columns) under ``rules`` and ``edges`` (src, dst: urls that are aliases).

    Adds host, path, rule and verdict to every row (any such columns of its own are replaced). A null url, or one
    without ``://``, has empty host and path, fits no rule unless one has an empty host, has no aliases, and is
    allowed. Edges with a null end are ignored; repeated rows and edges are harmless; no edges: no decision spreads.
    Urls enter the graph as 128-bit digests. All decisions of a component meet in one aggregation that is partial
    before its shuffle; only rows without a rule of their own ask for their component's, by a join that deals a hot url
    out, and all others stay where they are.
    """
    own = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    best, node, said = (fresh([*own, "host", "path", "rule", "verdict"], c) for c in ("best", "node", "said"))
    judged = urls.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = with_rule(judged, rules, "host", "path", best)

    linked = edges.where("src is not null and dst is not null")
    graph = stage(linked.select(F.md5("src").alias("a"), F.md5("dst").alias("b")).where("a <> b").distinct(), "links")
    member = components(graph)
    # What is known of the alias itself counts too, also where no row of ``urls`` has it.
    ends = linked.select(F.col("src").alias("url")).union(linked.select(F.col("dst").alias("url"))).distinct()
    ends = ends.select(F.md5("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    told = with_rule(ends, rules, "host", "path", "best").where("best is not null").select("node", "best")
    decided = (
        member.join(told, "node").groupBy("component")
        .agg(F.when(F.max(F.col("best.rank")) == 1, "allow").otherwise("block").alias(said))
    )
    spread = stage(member.join(decided, "component").select(F.col("node").alias(node), said), "decided")
    asks = F.col(best).isNull() & F.contains("url", F.lit("://"))
    asks = F.coalesce(asks, F.lit(False))
    told = spread_join(judged.where(asks).withColumn(node, F.md5("url")), spread, node, "left")
    whole = judged.where(~asks).select(*own, "host", "path", F.col(best).alias(best), F.lit(None).cast("string").alias(said)).unionByName(told.select(*own, "host", "path", best, said))
    return whole.select(*own, "host", "path", F.col(f"{best}.rule").alias("rule"), F.coalesce(F.col(f"{best}.action"), F.col(said), F.lit("allow")).alias("verdict"))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of ``pages`` (url, html), where they differ: its spelling's redirect, its page's canonical link, and the
    redirect of that link's spelling."""
    to = pages.select("url", canonical_target(F.col("html"), F.col("url")).alias("to"))
    edge = F.explode(F.array(*[
        F.struct(src.alias("src"), dst.alias("dst"))
        for src, dst in ((F.col("url"), redirect_target(F.col("url"))), (F.col("url"), F.col("to")), (F.col("to"), redirect_target(F.col("to"))))
    ]))
    return to.select(edge.alias("edge")).select("edge.*").where("src <> dst").distinct()


def op1_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    edges = stage(alias_edges(pages.select("url", "html")), "aliases")
    return filter_urls(pages.select("page_id", "url"), edges, RULES).select("page_id", "host", "path", "rule", "verdict")


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _redirect(url: str) -> str:
    return f"""CASE WHEN contains({url}, '://') THEN 'https://' || regexp_replace({_host(url)}, '^www\\.', '') || regexp_replace({_path(url)}, '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({url}, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)(=|$)')), '&'), ''), '') END"""


def _absolute(target: str) -> str:
    site = "regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's')"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target}
      WHEN {target} = '' OR starts_with({target}, '#') OR regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains(url, '://') THEN NULL
      WHEN starts_with({target}, '//') THEN regexp_extract(url, '^(.*?):', 1, 's') || ':' || {target}
      WHEN starts_with({target}, '/') THEN {site} || {target}
      WHEN starts_with({target}, '?') THEN {site} || {_path('url')} || {target}
      ELSE {site} || coalesce(nullif(regexp_extract({_path('url')}, '^(.*/)', 1, 's'), ''), '/') || {target} END"""


_HOST, _PATH = _host("url"), _path("url")
ORACLE_SQL = f"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {', '.join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}),
targets AS (
  SELECT url, coalesce({_absolute('href')}, {_absolute('refresh')}) AS target FROM (
    SELECT DISTINCT url, regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is'), '\\bhref\\s*=\\s*["'']?([^\\s"''>]+)', 1, 'is') AS href,
      regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is'), '\\burl\\s*=\\s*["'']?([^\\s"''>]+)', 1, 'is') AS refresh FROM pages)),
aliases AS (
  SELECT url AS src, {_redirect('url')} AS dst FROM targets UNION SELECT url, target FROM targets UNION SELECT target, {_redirect('target')} FROM targets),
both_ways AS (SELECT src AS a, dst AS b FROM aliases WHERE src <> dst UNION SELECT dst, src FROM aliases WHERE src <> dst),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM both_ways),
judged AS (
  SELECT url, max(struct_pack(size := length(r.host || r.path), rank := (r.action = 'allow')::int, action := r.action, rule := r.host || r.path)) AS best
  FROM urls JOIN rules r ON ({_HOST} = r.host OR ends_with({_HOST}, '.' || r.host)) AND starts_with({_PATH}, r.path) GROUP BY url),
spread AS (SELECT r.a AS url, CASE max(best.rank) WHEN 1 THEN 'allow' ELSE 'block' END AS verdict FROM reach r JOIN judged j ON j.url = r.b GROUP BY r.a)
SELECT page_id, {_HOST.replace('url', 'p.url')} AS host, {_PATH.replace('url', 'p.url')} AS path, best.rule AS rule,
  coalesce(best.action, s.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN judged j ON j.url = p.url LEFT JOIN spread s ON s.url = p.url
"""
