"""URL filters: rules for hosts and paths, and trust and distrust carried along the links between hosts.

Pages that a rule fits are seeds: the share of a host's pages that rules allow is its trust, the share that they block
its distrust. Trust flows from a host to the hosts it links to (personalised PageRank), distrust from a host to the hosts
that link to it (the same on reversed links), both until they have converged. Host edges are links in pages to another
host, and both ways between a host and the nearest host above it that has pages. Pages that no rule fits get the verdict
of their host: block where distrust exceeds trust by a factor, else allow. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_trust.llm.common import UPPER, ascii_lower, broadcast_if_small, positions
from review_trust.sources.artifacts import Scratch, cut

# The rules of the query, (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# A list compiled into one expression; longer ones would need a join.
MAX_RULES = 500
DAMPING = 0.85
# Converged when a round moves less than this, summed over all hosts: what is still to come is at most
# DAMPING / (1 - DAMPING) times as much, 6e-6, far below LEAST.
TOLERANCE = 1e-6
# Every round moves at most DAMPING times what the one before moved, so this many serve 1e15 seeds.
MAX_ROUNDS = 300
# Fixed value: labels of a host name at most. A longer one is no name, and has no host above it.
MAX_LABELS = 127
# Hosts with this many times more distrust than trust are blocked; less distrust than LEAST counts as none.
FACTOR = 2.0
LEAST = 0.001

HREF = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, rule_host + rule_path).otherwise(text)
        verdict = F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts (src, dst) of ``pages`` (host, html)."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    linked = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    linked = linked.select("src", ascii_lower(F.col("dst")).alias("dst")).distinct()
    hosts = pages.filter("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    above = F.when(
        F.size(labels) <= MAX_LABELS,
        F.transform(positions(F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i + 2, F.size(labels)), ".")),
    )
    upwards = hosts.select(F.col("host").alias("src"), F.posexplode(above).alias("steps", "dst"))
    upwards = upwards.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    below = upwards.groupBy("src").agg(F.min_by("dst", "steps").alias("dst"))
    above = below.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return linked.unionByName(below).unionByName(above).filter("src <> dst").distinct()


def _links_and_seeds(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (kind, src, dst, links of src) with those of distrust reversed, and seeds above 0 (host, kind, seed)."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    out = both.groupBy("kind", "src").agg(F.count("*").alias("links"))
    both = cut(both.join(out, ["kind", "src"]), "host-links")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")))
    return both, cut(start.toDF("host", "kind", "seed").filter("seed > 0"), "host-seeds")


def _gains(both: DataFrame, rank: DataFrame) -> DataFrame:
    """What hosts are given (kind, host, gain) when every host of ``rank`` divides its value among its links."""
    moved = both.join(rank.withColumnRenamed("host", "src"), ["kind", "src"])
    moved = moved.select("kind", F.col("dst").alias("host"), (F.col("value") / F.col("links")).alias("part"))
    return moved.groupBy("kind", "host").agg(F.sum("part").alias("gain"))


def _by_host(rank: DataFrame) -> DataFrame:
    return rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("value")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("value")).otherwise(0.0)).alias("distrust"),
    )


def converged(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, limit: int = MAX_ROUNDS) -> DataFrame:
    """Trust and distrust of hosts when they have converged: host, trust, distrust.

    ``seeds`` has host, trust, distrust. Both run in one table keyed by kind, with distrust on reversed edges; a host
    divides its value among its links. Every host begins with 1 - DAMPING of its seed, and a round passes on only what
    the round before has added, until that is less than ``tolerance`` in all. Every round is stored, so none is computed
    again, and the one before it removed. More than ``limit`` rounds are an error.
    """
    both, start = _links_and_seeds(edges, seeds)
    first = (1 - DAMPING) * F.col("seed")
    rank = Scratch(start.select("kind", "host", first.alias("value"), first.alias("added")), "rank")
    for _ in range(limit):
        moving = rank.table.agg(F.sum("added")).first()[0] or 0.0
        if moving < tolerance:
            return _by_host(rank.table)
        added = rank.table.filter("added > 0").select("kind", "host", F.col("added").alias("value"))
        gain = DAMPING * F.coalesce("gain", F.lit(0.0))
        step = rank.table.join(_gains(both, added), ["kind", "host"], "full_outer")
        value = F.coalesce("value", F.lit(0.0)) + gain
        last, rank = rank, Scratch(step.select("kind", "host", value.alias("value"), gain.alias("added")), "rank")
        last.remove()
    raise RuntimeError(f"trust has not converged after {limit} rounds")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust of the host.

    A null url or one without ``://`` has an empty host and path, fits no rule, has no edges and is allowed. A null html
    has no links. Repeated rows each get a row and count each for their host. Hosts that nothing reaches are allowed.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"))
    own = F.coalesce("own", F.lit(""))
    allowed, denied = F.avg((own == "allow").cast("double")), F.avg((own == "block").cast("double"))
    seeds = judged.filter("host <> ''").groupBy("host").agg(allowed.alias("trust"), denied.alias("distrust"))
    seeds = seeds.filter("trust > 0 OR distrust > 0")
    hosts = cut(converged(host_edges(rows), seeds), "host-trust")
    joined = judged.join(broadcast_if_small(hosts, 100_000), "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    blocked = (distrust > LEAST) & (distrust > FACTOR * trust)
    verdict = F.coalesce("own", F.when(blocked, "block").otherwise("allow"))
    return joined.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" for _, h, p in rules
    ]
    rule = " ".join(f % (h + p) for f, (_, h, p) in zip(fits, rules))
    own = " ".join(f % kind for f, (kind, _, _) in zip(fits, rules))
    href = HREF.removeprefix("(?i)").replace("'", "''")
    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), j AS (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {own} END AS own FROM u),
h AS (SELECT DISTINCT host FROM j WHERE host <> ''),
e0 AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1, 'i')), '{UPPER}', '{UPPER.lower()}') AS dst
  FROM j WHERE host <> ''
), w AS (SELECT host, string_split(host, '.') AS labels FROM h),
a0 AS (
  SELECT host AS src, i, array_to_string(labels[i + 1 :], '.') AS dst
  FROM (SELECT host, labels, unnest(range(1, len(labels))) AS i FROM w WHERE len(labels) <= {MAX_LABELS})
), b AS (
  SELECT src, arg_min(dst, i) AS dst FROM a0 WHERE dst IN (SELECT host FROM h) GROUP BY src
), e AS (SELECT * FROM (SELECT * FROM e0 UNION SELECT * FROM b UNION SELECT dst, src FROM b) WHERE src <> dst),
k AS (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e),
l AS (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS links FROM k),
a AS (
  SELECT host, avg(CAST(coalesce(own, '') = 'allow' AS INT)) AS t, avg(CAST(coalesce(own, '') = 'block' AS INT)) AS d
  FROM j WHERE host <> '' GROUP BY host
),
s AS (SELECT 'trust' AS kind, host, t AS seed FROM a WHERE t > 0 UNION ALL SELECT 'distrust', host, d FROM a WHERE d > 0),
r AS (
  SELECT kind, host, {1 - DAMPING!r} * seed AS added FROM s
  UNION ALL
  SELECT kind, dst, {DAMPING} * sum(added / links)
  FROM (SELECT kind, host AS src, added, sum(added) OVER () AS moving FROM r) JOIN l USING (kind, src)
  WHERE moving >= {TOLERANCE} GROUP BY kind, dst
),
f AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN added ELSE 0 END) AS t,
    sum(CASE WHEN kind = 'distrust' THEN added ELSE 0 END) AS d FROM r GROUP BY 1
)
SELECT page_id, j.host, path, rule, coalesce(own, CASE WHEN d > {LEAST} AND d > {FACTOR} * t THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN f ON j.host = f.host
"""


SQL = _sql()
