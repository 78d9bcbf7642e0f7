"""URL filters by link-graph propagation.

Rules judge urls by host suffix and path prefix. Hosts with allowed pages are trusted seeds, hosts
with blocked pages are distrusted ones, each weighted by its number of such pages. Personalised
PageRank carries trust along the links between hosts and distrust against them: who links to
a blocked host shares its distrust. Both run in one table of (host, kind, mass), so a step is one join and
one sum. A host whose distrust is more than the threshold's share of its mass is blocked; that judges the urls that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import discarded, fits, joined, stored

DAMPING = 0.85
#: Steps of the SQL and of propagated() unless it is told otherwise; the query goes on until the masses have converged.
STEPS = 10
#: Converged: over EVERY steps, which are stored together, no mass of a host grew by more than this share of itself.
TOLERANCE = 1e-10
EVERY = 5
#: A host is blocked if its distrust is over this share of its trust and distrust.
THRESHOLD = 0.5
#: Below this a difference of masses is rounding; in verdicts, relative to the host's mass.
EPSILON = 1e-9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link.
LINK = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'<> \t\r\n]+)"""


@dataclass(frozen=True)
class Rule:
    """allow or block: `host` and its subdomains, for paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def lowered(text) -> F.Column:
    return F.translate(text, UPPER, LOWER)


def located(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with _host and _path, both empty where the url is null or has no `://`."""
    out = pages.withColumn("_rest", F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1))
    out = out.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return out.withColumn("_path", path).withColumn("_host", lowered(F.col("_host"))).drop("_rest")


def fitting(rules: list[Rule], host, path) -> tuple[F.Column, F.Column]:
    """Name and verdict of the longest rule that fits; of equally long ones that with the longer host, then the first by name."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, body_col: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of one host to another host; pages must have _host."""
    links = pages.select(F.col("_host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(pages[body_col], F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", lowered(F.col("dst"))).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = STEPS) -> DataFrame:
    """(host, kind, mass) after `steps` steps of personalised PageRank from seeds (host, kind, mass); None: when it has converged.

    Converged masses are sums over all walks from the seeds, so they only grow, and every host that a walk reaches has one, however far
    it is: about 140 steps on cycles, and as many more as the farthest host is away.

    Kind `trust` follows edges (src, dst, n) forwards and `distrust` backwards, in proportion to n.
    Mass that reaches a host without such edges ends there. Each step, or every EVERY steps, is stored, so a lost executor costs those at most.
    """
    forward = edges.select(F.col("src").alias("host"), F.lit("trust").alias("kind"), F.col("dst").alias("to"), "n")
    backward = edges.select(F.col("dst").alias("host"), F.lit("distrust").alias("kind"), F.col("src").alias("to"), "n")
    both, key = forward.unionByName(backward), ["host", "kind"]
    totals = stored(both.groupBy(*key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n")), "url-totals")
    start = seeds.select(*key, ((1 - damping) * F.col("mass")).alias("mass"))
    hosts = totals.count()
    if not hosts:
        return start
    small, n_ways = fits(hosts), 2 * edges.count()

    def along(rows: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of ways, of which a hub has many, with what right has for their host."""
        return rows.join(F.broadcast(right), key) if small else joined(rows, right, key, "to", totals.select(*key, "n"), n_ways, "inner")

    ways = stored(along(both, totals.select(*key, "total")).select(*key, "to", (damping * F.col("n") / F.col("total")).alias("share")), "url-ways")

    def step(mass: DataFrame) -> DataFrame:
        here = mass.join(totals.select(*key), key, "left_semi")
        moved = along(ways, here).select(F.col("to").alias("host"), "kind", (F.col("mass") * F.col("share")).alias("mass"))
        return start.unionByName(moved).groupBy(*key).agg(F.sum("mass").alias("mass"))

    def moves(now: DataFrame, before: DataFrame, apart) -> bool:
        both = now.join(before.withColumnRenamed("mass", "was"), ["host", "kind"], "full")
        return both.where(apart(F.coalesce("mass", F.lit(0.0)), F.coalesce("was", F.lit(0.0)))).limit(1).count() > 0

    now, left = (start, EVERY) if steps is None else (seeds, 1)
    apart = (lambda mass, was: F.abs(mass - was) > TOLERANCE * mass) if steps is None else (lambda mass, was: F.abs(mass - was) > EPSILON)
    rounds = 0
    while steps is None or rounds < steps:
        before = now
        for _ in range(left):
            now = step(now)
        now = stored(now, "url-mass")
        moving = moves(now, before, apart)
        if rounds:
            discarded(before)  # the round before the last one's: nothing reads it any more
        rounds += 1
        if not moving:
            break
    return now


def normalised(mass: DataFrame) -> DataFrame:
    """Masses (host, kind, mass) as shares of their kind: so a trusted side with many pages doesn't outvote distrust.

    Of propagated masses these are the personalised PageRank whose walks, where they end, begin again at the seeds.
    """
    whole = mass.groupBy("kind").agg(F.sum("mass").alias("whole"))
    return mass.join(F.broadcast(whole), "kind").select("host", "kind", (F.col("mass") / F.col("whole")).alias("mass"))  # two rows


def judged(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", body_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING, steps: int | None = None,
) -> DataFrame:
    """One row for each row of pages: id_col, host, path, rule, verdict (allow or block).

    The verdict is that of the longest fitting rule, else that of the host: block if its distrust
    is over `threshold` of its whole mass, converged unless `steps` are given. Hosts that no mass reaches are allowed, so are urls without a host.
    Links are absolute ones in `href` attributes, and those within a host are left out. Null urls and bodies count as
    empty. Repeated rows and null ids each get their verdict; an empty table gives no rows; other columns are not read.
    """
    rows = located(pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"), pages[body_col].alias("_body")), "_url")
    name, verdict = fitting(rules, F.col("_host"), F.col("_path"))
    rows = rows.withColumn("_rule", name).withColumn("_by_rule", verdict)
    edges = stored(host_edges(rows, "_body"), "url-edges")
    kind = F.when(F.col("_by_rule") == "allow", F.lit("trust")).otherwise(F.lit("distrust"))
    seeds = rows.where("_by_rule is not null and _host <> ''").groupBy(F.col("_host").alias("host"), kind.alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("mass"))
    mass = normalised(propagated(edges, normalised(stored(seeds, "url-seeds")), damping, steps))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0))
    scores = mass.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    bad = stored(scores.where(F.col("distrust") > threshold * (1 + EPSILON) * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("_host"), F.lit(True).alias("_bad")), "url-blocked")
    rows = rows.drop("_body")
    if fits(bad.count()):
        out = rows.join(F.broadcast(bad), "_host", "left")
    else:
        sizes = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n"))
        out = joined(rows, bad, "_host", "_url", sizes, pages.count())
    verdict = F.coalesce("_by_rule", F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"))


def url_filter_query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def _oracle() -> str:
    """DuckDB SQL with STEPS steps written out: enough for tables whose walks end within them."""
    cases = sorted(RULES, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in cases) + " END"
    link = LINK.replace("'", "''")
    sql = rf"""
WITH u AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1) AS rest FROM pages),
h AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, html, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS by_rule FROM p),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM j),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND src <> dst GROUP BY ALL),
w0 AS (SELECT src AS host, 'trust' AS kind, dst AS nxt, n FROM e UNION ALL SELECT dst, 'distrust', src, n FROM e),
w AS (SELECT host, kind, nxt, {DAMPING} * n / sum(n) OVER (PARTITION BY host, kind) AS share FROM w0),
s0 AS (SELECT host, CASE by_rule WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*)::DOUBLE AS mass FROM j WHERE by_rule IS NOT NULL AND host <> '' GROUP BY ALL),
s AS (SELECT host, kind, mass / sum(mass) OVER (PARTITION BY kind) AS mass FROM s0),
m0 AS (SELECT * FROM s)"""
    for k in range(1, STEPS + 1):
        sql += f""",
m{k} AS (SELECT host, kind, sum(mass) AS mass FROM (SELECT host, kind, (1 - {DAMPING}) * mass AS mass FROM s UNION ALL SELECT nxt, m.kind, mass * share FROM m{k - 1} m JOIN w ON w.host = m.host AND w.kind = m.kind) GROUP BY ALL)"""
    return sql + f""",
f AS (SELECT host, kind, mass / sum(mass) OVER (PARTITION BY kind) AS mass FROM m{STEPS}),
b AS (SELECT host FROM f GROUP BY host HAVING coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) > {THRESHOLD} * sum(mass) + {EPSILON})
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM j LEFT JOIN b ON j.host = b.host"""


ORACLE = _oracle()
