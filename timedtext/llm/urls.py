"""URL filter: rules, and trust propagated over the link graph of hosts.

A rule (host, path prefix) fits its host and all subdomains where the url's path starts with the
rule's; the longest fitting rule decides. Where none fits, the host decides: two personalised PageRanks
run over the edges between hosts, trust from hosts whose pages the rules allow along the links, and
distrust from hosts whose pages they block against the links (who links to a bad host is suspect).
A seed weighs as much as the share of its pages that the rules decide. A host is blocked where its
distrust is above both its trust and ``threshold`` times what one wholly blocked host without links gets.

Edges are one row per pair of hosts, weighted by the pages that carry the link. Ranks are tables that
are cut every ``cut_every`` steps; both ranks run in one pass, keyed by (kind, host).

Defined cases: null or malformed urls have empty host and path, fit no rule and are allowed; null html
has no links; repeated pages count again; hosts without links keep their seed; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_tables, finish, scratch, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 2000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^\s"'>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. Rules are settings, at most ``MOST_RULES``."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: give them as a table joined on host suffixes")
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    # from short to long, so that the longest is looked at first
    for verdict, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, from absolute links in the pages."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1))).alias("link"))
    ends = links.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))).alias("dst"))
    return ends.filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, steps: int = 200, damping: float = 0.85, cut_every: int = 5, settled: float = 1e-9) -> DataFrame:
    """``seeds`` (kind, host, weight) and ``edges`` (src, dst, weight) -> (kind, host, rank).

    rank = (1 - damping) * seed + damping * what the neighbours pass on, by weight; kind ``trust`` goes
    along the edges and ``distrust`` against them. Steps end when no rank moved by more than ``settled``
    over ``cut_every`` of them.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    flow = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), "url-flow")
    base = seeds.select("kind", "host", (F.col("weight") * (1 - damping)).alias("rank"))
    if flow.isEmpty():
        return base
    rank = held = cut(base, "url-rank")
    for k in range(1, steps + 1):
        passed = flow.join(rank, (flow["kind"] == rank["kind"]) & (flow["src"] == rank["host"])).select(flow["kind"], F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        new = base.unionByName(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % cut_every == 0 or k == steps:
            rank = cut(new, "url-rank")
            old = held.select("kind", "host", F.col("rank").alias("old"))
            moved = rank.join(old, ["kind", "host"], "left").agg(F.max(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))))).first()[0]
            drop_tables(held)
            held = rank
            if moved is None or moved <= settled:
                break
        else:
            rank = new
    return rank


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, steps: int = 200) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page, and its host's trust and distrust."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = cut(urls.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled")), "url-pages")
    counts = ruled.filter("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust"))
    seeds = cut(counts.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("n")).alias("weight")) for k in ("trust", "distrust")])).alias("s")).select("s.kind", "host", "s.weight").filter("weight > 0"), "url-seeds")
    edges = cut(host_edges(pages), "url-edges")
    ranks = propagate(seeds, edges, steps, damping)
    hosts = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    hosts = cut(hosts.withColumn("blocked", (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold * (1 - damping))), "url-hosts")
    by_host = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    # pages without a host, however many, need no join
    placed = ruled.filter("host != ''").join(hosts, "host", "left").unionByName(ruled.filter("host = ''"), allowMissingColumns=True)
    return placed.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op4_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        return finish(judge(table(spark, sf_dir, "pages")), "url-judged")
