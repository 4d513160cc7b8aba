"""URL filtering by rules and, where no rule fits, by trust and distrust that flow over links between hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block are distrusted seeds, each by the
share of its pages. Trust flows along links (a personalised PageRank), distrust against them, to those that link to
distrusted hosts. A host whose distrust exceeds its trust by more than a threshold is blocked.

Edges are summed per pair of hosts before anything is joined. A host with very many edges is split over several keys.

Defined results: a NULL url or one without `://` has an empty host and path and is allowed, as is every host that
nothing is known about. Links without a host stay on the page's host; NULL html has no links. Equal rule lengths: block
wins. A host without links keeps its mass. Repeated pages count as often as they occur; further columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import hinted, read
from shotgrove.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_PATTERN = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"

DAMPING = 0.85
ROUNDS = 20
# Rounds whose plan is built before the state is written.
ROUNDS_AT_ONCE = 4
THRESHOLD = 0.2

# Edges of a host that are joined under one key.
EDGES_PER_KEY = 100_000

# Rules that are tried row by row; longer lists are joined.
INLINE_RULES = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z lowered; empty where there is none."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def parents(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _inline(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    # From the weakest to the strongest, each taking precedence over those before.
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = (((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host))
                & F.col("path").startswith(rule.path))
        best = F.when(fits, rule.name).otherwise(best)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return pages.withColumns({"rule": best, "_ruled": verdict})


def _joined(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same for long lists: distinct addresses meet the rules of their host and of the domains above it."""
    spark = pages.sparkSession
    table = materialize(spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules],
                                              "_verdict string, _rule_host string, _rule_path string"), "rules")
    addresses = pages.select("host", "path").distinct()
    above = addresses.select("host", "path", F.explode(parents(F.col("host"))).alias("_rule_host"))
    fits = above.join(hinted(table), "_rule_host").where(F.col("path").startswith(F.col("_rule_path")))
    name = F.concat("_rule_host", "_rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.length(name).alias("l"), (F.col("_verdict") == "block").alias("b"), name.alias("rule"),
        F.col("_verdict").alias("verdict"))).alias("_best"))
    return (pages.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("_best.rule"), "_ruled": F.col("_best.verdict")}).drop("_best"))


def judge_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, inline: int = INLINE_RULES) -> DataFrame:
    """Add `rule` and `_ruled` (its verdict) to rows that have `host` and `path`."""
    return (_inline if len(rules) <= inline else _joined)(pages, rules)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links) between hosts, from `host` and `html`."""
    links = pages.where("host <> ''").select(
        "host", F.explode(F.regexp_extract_all("html", F.lit(LINK_PATTERN), F.lit(1))).alias("link"))
    address = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    target = host_of(address)
    return (links.select(F.col("host").alias("source"), F.when(target == "", F.col("host")).otherwise(target)
                         .alias("target")).groupBy("source", "target").agg(F.count("*").alias("links")))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING,
              edges_per_key: int = EDGES_PER_KEY) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (source, target, links).

    kind 0 is trust and flows from source to target, kind 1 is distrust and flows back.
    """
    def directed(kind: int, start: str, end: str) -> DataFrame:
        return edges.select(F.lit(kind).alias("kind"), F.col(start).alias("start"), F.col(end).alias("end"), "links")

    flows = directed(0, "source", "target").unionByName(directed(1, "target", "source"))
    totals = flows.groupBy("kind", "start").agg(
        F.sum("links").alias("total"), F.ceil(F.count("*") / edges_per_key).cast("int").alias("keys"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("seed")),
                              F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("seed")))).alias("s")
    seeded = seeds.select("host", kinds).select("host", "s.kind", "s.seed")
    # Every host of a page or a link; hosts without edges in a direction hold on to what they have.
    hosts = (seeded.unionByName(flows.select(F.col("end").alias("host"), "kind", F.lit(0.0).alias("seed")))
             .groupBy("host", "kind").agg(F.sum("seed").alias("seed")))
    base = materialize(
        hosts.join(totals.withColumnRenamed("start", "host"), ["kind", "host"], "left")
        .select("host", "kind", "seed", F.coalesce("keys", F.lit(0)).alias("keys")), "hosts")
    shares = flows.join(totals, ["kind", "start"]).select(
        "kind", "start", "end", (F.col("links") / F.col("total")).alias("share"),
        F.pmod(F.xxhash64("end"), F.col("keys")).cast("int").alias("key"))
    stays = base.where("keys = 0").select("kind", F.col("host").alias("start"), F.col("host").alias("end"),
                                          F.lit(1.0).alias("share"), F.lit(0).alias("key"))
    shares = materialize(shares.unionByName(stays), "shares")
    state = base.withColumn("score", F.col("seed"))
    for done in range(1, rounds + 1):
        # One row per key of the host, so that a hub's edges are many small joins.
        sent = state.select(F.col("host").alias("start"), "kind", "score", F.explode(
            F.sequence(F.lit(0), F.greatest("keys", F.lit(1)) - 1)).alias("key"))
        got = (sent.join(shares, ["kind", "start", "key"]).groupBy("kind", F.col("end").alias("host"))
               .agg(F.sum(F.col("score") * F.col("share")).alias("flow")))
        state = base.join(got, ["kind", "host"], "left").select(
            "host", "kind", "seed", "keys",
            ((1 - damping) * F.col("seed") + damping * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if done % ROUNDS_AT_ONCE == 0 or done == rounds:
            state = materialize(state, "scores")
    return state.groupBy("host").agg(
        F.round(F.sum(F.when(F.col("kind") == 0, F.col("score"))), 6).alias("trust"),
        F.round(F.sum(F.when(F.col("kind") == 1, F.col("score"))), 6).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, html) with host, path, rule, verdict, trust and distrust of the host."""
    addressed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = judge_by_rules(addressed, rules)
    share = lambda verdict: F.avg(F.when(F.col("_ruled") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        share("allow").alias("trust"), share("block").alias("distrust"))
    scores = materialize(propagate(materialize(seeds, "seeds"), materialize(host_edges(addressed), "edges")), "trust")
    found = ruled.drop("html").join(hinted(scores), "host", "left")
    blocked = F.round(F.col("distrust") - F.col("trust"), 6) > threshold
    return found.withColumn("verdict", F.coalesce("_ruled", F.when(blocked, "block").otherwise("allow")))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def sql(rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same in SQL, all rounds written out."""
    best, ruled = "NULL", "NULL"
    for r in sorted(RULES, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        best, ruled = (f"CASE WHEN {fits} THEN '{r.name}' ELSE {best} END",
                       f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {ruled} END")

    def host(url: str) -> str:
        rest = f"substr({url}, instr({url}, '://') + 3)"
        return (f"CASE WHEN instr({url}, '://') > 0 THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), "
                f"'{UPPER}', '{LOWER}') ELSE '' END")

    link = LINK_PATTERN.replace("'", "''")
    steps, last = [], "base"
    for i in range(1, rounds + 1):
        steps.append(f"""s{i} AS MATERIALIZED (
    SELECT b.host, b.kind, b.seed, {1 - damping!r} * b.seed + {damping!r} * coalesce(g.flow, 0) AS score
    FROM base b LEFT JOIN (SELECT h.kind, h."end" AS host, sum(s.score * h.share) AS flow
        FROM {last} s JOIN shares h ON s.kind = h.kind AND s.host = h.start GROUP BY ALL) g
    ON b.kind = g.kind AND b.host = g.host)""")
        last = f"s{i}"
    return f"""
WITH addressed AS MATERIALIZED (
    SELECT page_id, html, {host("url")} AS host,
           CASE WHEN instr(url, '://') > 0 THEN
               regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, {best} AS rule, {ruled} AS ruled FROM addressed),
seeds AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust,
                 avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
          FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM addressed WHERE host <> ''),
targets AS (SELECT host AS source, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")}
                AS target FROM links),
edges AS MATERIALIZED (SELECT source, CASE WHEN target = '' THEN source ELSE target END AS target, count(*) AS links
          FROM targets GROUP BY ALL),
flows AS (SELECT 0 AS kind, source AS start, target AS "end", links FROM edges
          UNION ALL SELECT 1, target, source, links FROM edges),
known AS (SELECT host, 0 AS kind, trust AS seed FROM seeds UNION ALL SELECT host, 1, distrust FROM seeds
          UNION ALL SELECT "end", kind, 0 FROM flows),
hosts AS MATERIALIZED (SELECT host, kind, sum(seed) AS seed FROM known GROUP BY ALL),
base AS MATERIALIZED (SELECT host, kind, seed, seed AS score FROM hosts),
shares AS MATERIALIZED (
    SELECT kind, start, "end", links / sum(links) OVER (PARTITION BY kind, start) AS share FROM flows
    UNION ALL SELECT kind, host, host, 1 FROM hosts h
    WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.kind = h.kind AND f.start = h.host)),
{("," + chr(10)).join(steps)},
scores AS (SELECT host, round(sum(score) FILTER (kind = 0), 6) AS trust,
                  round(sum(score) FILTER (kind = 1), 6) AS distrust FROM {last} GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.ruled, CASE WHEN round(s.distrust - s.trust, 6) > {threshold} THEN 'block' ELSE 'allow' END)
           AS verdict, s.trust, s.distrust
FROM ruled r LEFT JOIN scores s ON r.host = s.host"""
