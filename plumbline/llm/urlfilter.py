"""URL filter: prefix rules, and trust and distrust propagated over host edges for pages that no rule judges.

Host edges come from the links of the pages (relative links stay on their host and make no edge) and, with ``family``, from each name
to its parent name and back (``a.b.c`` and ``b.c``), because a domain answers for its subdomains. Trust is a personalised PageRank from hosts
that a rule allows; distrust runs against the edges from hosts that a rule blocks: who links to them is suspect. A host is blocked if its distrust
exceeds ``threshold`` times its trust.

Ranks are whole numbers of 1e-15, so sums do not depend on their order and reruns agree. The edge table has one row per pair of hosts;
each round is one join and one aggregate, cut by a checkpoint every few rounds.

Defined results: a url that is null or lacks "://" has an empty host and path, meets no rule and is allowed, as is any host without distrust; a null
html has no links; repeated rows are judged alike and their links count again; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
ONE = 10**15
DAMPING = 85  # hundredths that travel along edges
ROUNDS = 12
CUT = 4
THRESHOLD = 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(judged: DataFrame, html: str = "html", family: bool = True) -> DataFrame:
    """src, dst, weight: links between different hosts, counted, and name families with weight 1."""
    target = F.translate(F.regexp_extract("link", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER)
    edges = (judged.select("host", F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("link"))
             .select(F.col("host").alias("src"), target.alias("dst")).filter("src <> '' and dst <> '' and src <> dst"))
    if family:
        names = judged.select("host").union(edges.select("dst")).distinct().filter("host <> ''")
        labels = F.split("host", r"\.")
        levels = names.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda i: F.struct(
            F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("name"), F.array_join(F.slice(labels, i + 2, F.size(labels)), ".").alias("parent")))).alias("x"))
        pairs = levels.select("x.name", "x.parent").filter("name <> '' and parent <> ''").distinct()
        edges = edges.union(pairs).union(pairs.select("parent", "name"))
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``edges``: kind, src, dst, weight; ``seeds``: kind, host. Returns kind, host, rank in units of 1 / ONE."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = durable(edges.join(out, ["kind", "src"]).select(F.col("kind").alias("way"), "src", "dst", "weight", "total"))
    start = durable(seeds.join(seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind")
                    .select("kind", "host", F.expr(f"{ONE} div n").alias("seed")))
    rank = start.withColumnRenamed("seed", "rank")
    for i in range(rounds):
        sent = (rank.join(edges, (F.col("kind") == F.col("way")) & (F.col("host") == F.col("src")))
                .select("kind", F.col("dst").alias("host"), F.expr(f"(rank div total) * weight * {DAMPING} div 100").alias("rank")))
        rest = start.select("kind", "host", F.expr(f"seed * {100 - DAMPING} div 100").alias("rank"))
        rank = sent.union(rest).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % CUT == 0 or i + 1 == rounds:
            rank = durable(rank)
    return rank


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, family: bool = True, rounds: int = ROUNDS,
               threshold: int = THRESHOLD) -> DataFrame:
    """key, host, path, rule, verdict of every page, with trust and distrust of its host."""
    host, path = split_url(F.col(url))
    judged = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "says": says})
    forward = durable(host_edges(judged, "html", family))
    edges = forward.withColumn("kind", F.lit("allow")).unionByName(forward.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    seeds = judged.filter("says is not null and host <> ''").select(F.col("says").alias("kind"), "host").distinct()
    ranks = propagate(edges, seeds, rounds).groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("rank"))), F.lit(0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("rank"))), F.lit(0)).alias("distrust"))
    method = F.when(F.coalesce("distrust", F.lit(0)) > threshold * F.coalesce("trust", F.lit(0)), "block").otherwise("allow")
    return (judged.drop("html").join(ranks, "host", "left")
            .select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "trust", "distrust"))


def oracle_sql(rounds: int = ROUNDS, rules=RULES) -> str:
    """The same in DuckDB, one common table per round."""
    fits = [(t, v, f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}'))")
            for t, v in sorted(rules, key=lambda r: -len(r[0]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    steps = "".join(f"""
, r{i + 1} AS MATERIALIZED (
  SELECT kind, host, sum(rank)::BIGINT AS rank FROM (
    SELECT e.kind, e.dst AS host, ((r.rank // e.total) * e.weight * {DAMPING}) // 100 AS rank FROM r{i} r JOIN e ON r.kind = e.kind AND r.host = e.src
    UNION ALL SELECT kind, host, (rank * {100 - DAMPING}) // 100 FROM r0) GROUP BY ALL
)""" for i in range(rounds))
    link = LINK.replace("'", "''")
    return f"""
WITH u AS (
  SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, {low("regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), j AS MATERIALIZED (
  SELECT page_id, host, path, html, {case(0)} AS rule, {case(1)} AS says FROM h
), l AS MATERIALIZED (
  SELECT src, dst FROM (SELECT host AS src, {low("regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)")} AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM j)) WHERE src <> '' AND dst <> '' AND src <> dst
), f AS (
  SELECT DISTINCT array_to_string(p[i:], '.') AS name, array_to_string(p[i + 1:], '.') AS parent
  FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM (SELECT string_split(host, '.') AS p FROM (SELECT host FROM j UNION SELECT dst FROM l) WHERE host <> ''))
), g AS MATERIALIZED (
  SELECT src, dst, count(*) AS weight FROM (SELECT * FROM l UNION ALL SELECT name, parent FROM f WHERE name <> '' AND parent <> ''
    UNION ALL SELECT parent, name FROM f WHERE name <> '' AND parent <> '') GROUP BY ALL
), e AS MATERIALIZED (
  SELECT kind, src, dst, weight, sum(weight) OVER (PARTITION BY kind, src)::BIGINT AS total
  FROM (SELECT 'allow' AS kind, src, dst, weight FROM g UNION ALL SELECT 'block', dst, src, weight FROM g)
), r0 AS MATERIALIZED (
  SELECT kind, host, {ONE} // count(*) OVER (PARTITION BY kind) AS rank FROM (SELECT DISTINCT says AS kind, host FROM j WHERE says IS NOT NULL AND host <> '')
){steps}, t AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust FROM r{rounds} GROUP BY host
)
SELECT page_id, j.host, path, rule, coalesce(says, CASE WHEN coalesce(distrust, 0) > {THRESHOLD} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t ON j.host = t.host
"""
