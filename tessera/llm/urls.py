"""URL filters by rules and by trust over the host graph, in DataFrame functions only (operator 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed values: (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
DAMPING = 0.85
#: Host blocked from this share on: of its own pages, or as much through links.
SHARE = 0.5
#: Steps of the walk, by which all ranks have settled (0.85 ** 100 is under 1e-7), and the movement of all ranks together
#: in BATCH steps under which it ends before; differences under EVEN are none.
STEPS, ENOUGH, BATCH, EVEN = 100, 1e-6, 5, 1e-4
#: Hosts with more than this share of all pages are joined as a broadcast table: there are at most a thousand.
HOT = 0.001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """(host, path) columns of a url; both empty for null or where no :// stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^([^?#]*)", 1)


def ruled(host, path, rules: list):
    """The longest rule that fits, as a struct of rule and verdict, or null. Of equal rules the last one counts."""
    fits = []
    for k, (verdict, rule) in enumerate(rules):
        domain, _, rest = rule.partition("/")
        own = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        fits.append(F.when(own, F.struct(F.lit(len(rule)).alias("size"), F.lit(k).alias("k"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def ranks(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS, enough: float = ENOUGH) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from the seeds (host, trust, distrust).

    Trust follows edges (src, dst, n), distrust goes against them; a host passes its rank on by share of its
    links, and what a host without links has is not passed on. The walk ends after `steps` or when all ranks
    together move by less than `enough` in BATCH steps; cycles and chains settle alike.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    ahead = edges.join(out, "src").select(F.lit("trust").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("share"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))
    moves = cut(ahead.unionByName(back))
    start = seeds.selectExpr("host", "stack(2, 'trust', trust, 'distrust', distrust) as (kind, seed)").filter("seed > 0")
    start = cut(start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")))
    now = start
    for step in range(0, 0 if moves.isEmpty() else steps, BATCH):
        after = now
        for _ in range(min(BATCH, steps - step)):
            passed = moves.join(after.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
            after = start.unionByName(passed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        after = cut(after)
        moved = now.select("kind", "host", (-F.col("rank")).alias("rank")).unionByName(after).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d")).agg(F.sum("d")).first()[0]
        now = after
        if (moved or 0) < enough:
            break
    return now.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judge(pages: DataFrame, rules: list = RULES, damping: float = DAMPING, share: float = SHARE, steps: int = STEPS, enough: float = ENOUGH) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; repeated rows stay, other columns are ignored.

    A null url has no host, as one without ://; a null html has no links; an empty table gives no rows.

    Seeds are the shares of a host's pages that rules allow and block. A page without a rule is blocked if
    its host's distrust is over its trust and reaches `share` of what a host with blocked pages only has, by
    more than EVEN; else it is allowed, as are pages without a host. The rules are constants of the program.
    """
    host, path = parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    read = own.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    read = read.withColumn("hit", ruled(F.col("host"), F.col("path"), rules))
    seen = read.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled"))
    hosts = cut(seen.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("fine"), F.count_if(F.col("ruled") == "block").alias("bad")))
    seeds = hosts.select("host", (F.col("fine") / F.col("pages")).alias("trust"), (F.col("bad") / F.col("pages")).alias("distrust"))
    links = read.filter("host <> ''").select("host", F.explode(F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.contains(x, F.lit("//")))).alias("href"))
    target = F.translate(F.regexp_extract("href", "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), _UPPER, _LOWER)
    edges = links.select(F.col("host").alias("src"), target.alias("dst")).filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    rank = ranks(seeds, edges, damping, steps, enough)
    even = EVEN * (1 - damping)
    bad = (F.col("distrust") > F.col("trust") + even) & (F.col("distrust") >= share * (1 - damping) - even)
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    spread = cut(hosts.join(rank, "host", "left").filter(bad | (F.col("pages") > HOT * total)).select("host", F.when(bad, F.lit("block")).otherwise("allow").alias("spread"), (F.col("pages") > HOT * total).alias("hot")))
    # rows of a hot host take their verdict from the broadcast table and go by their own ids through the join of the others
    few = F.broadcast(spread.filter("hot").select("host", F.col("spread").alias("known")))
    many = spread.filter("not hot").select(F.col("host").alias("key"), "spread")
    rows = seen.join(few, "host", "left").withColumn("key", F.when(F.col("known").isNull() & (F.col("host") != ""), F.col("host")).otherwise(F.concat(F.lit("/"), F.hash("page_id", "path").cast("string"))))
    return rows.join(many, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "known", "spread", F.lit("allow")).alias("verdict"))


def duckdb(rules: list = RULES, damping: float = DAMPING, share: float = SHARE, steps: int = STEPS) -> str:
    """judge() of pages in DuckDB SQL, with the walk written out."""
    lower = lambda s: f"translate({s}, '{_UPPER}', '{_LOWER}')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(v)}, {quote(r)}, {quote(r.partition('/')[0])}, {quote('/' + r.partition('/')[2])})" for k, (v, r) in enumerate(rules))
    walk = "".join(
        f", r{k} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, seed AS rank FROM start UNION ALL SELECT m.kind, m.dst, m.share * r.rank * {damping} FROM moves m JOIN r{k - 1} r ON m.kind = r.kind AND m.src = r.host) GROUP BY ALL)" for k in range(1, steps + 1)
    )
    return f"""
WITH rules(k, verdict, rule, domain, prefix) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT row, page_id, html, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM p),
hit AS (SELECT row, arg_max(rule, length(rule) * 1000 + k) AS rule, arg_max(verdict, length(rule) * 1000 + k) AS verdict FROM q JOIN rules ON (host = domain OR host LIKE '%.' || domain) AND starts_with(path, prefix) GROUP BY row),
seen AS (SELECT q.row, page_id, html, host, path, rule, verdict AS ruled FROM q LEFT JOIN hit USING (row)),
seeds AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS trust, count(*) FILTER (ruled = 'block') / count(*) AS distrust FROM seen WHERE host <> '' GROUP BY host),
links AS (SELECT host, unnest(regexp_extract_all(html, {quote(HREF)}, 1)) AS href FROM seen WHERE host <> ''),
edges AS (SELECT host AS src, {lower("regexp_extract(href, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)")} AS dst, count(*) AS n FROM links GROUP BY ALL HAVING dst <> '' AND dst <> src),
moves AS (SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
start AS (SELECT 'trust' AS kind, host, trust * {1 - damping} AS seed FROM seeds WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust * {1 - damping} FROM seeds WHERE distrust > 0),
r0 AS (SELECT kind, host, seed AS rank FROM start){walk},
ranks AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM r{steps} GROUP BY host),
bad AS (SELECT host FROM ranks WHERE distrust > trust + {EVEN * (1 - damping)} AND distrust >= {(share - EVEN) * (1 - damping)})
SELECT page_id, seen.host, path, rule, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM seen LEFT JOIN bad ON seen.host = bad.host"""
