"""URL filters: rules first, then the empirical-Bayes reputation of the host. DataFrame and SQL functions only.

A page is labelled when ``labels`` has a row for its page_id with a non-null quality; the outcome is bad when quality is 0 or
toxic is 1. Bad rates are shrunk down the chain all -> suffix (last label of the host; the last two where they are one of
``SECOND`` and a country's two letters, like co.uk) -> registered domain (one label more;
a host that is a suffix or of digits and dots only is its own) -> host: at each level the prior is a beta distribution whose
mean is the posterior mean of the level above, and whose strength k is fitted by the method of moments over all groups of
that level. A page is blocked when its host's posterior mean less ``z`` posterior standard deviations is above ``most``;
a host without labelled pages falls back on its domain, suffix or all.

Scale: statistics are sums per host first (map-side aggregation), then domain and suffix sums of the host sums. In the
join back to the pages a host with more than ``per_salt`` pages is salted by page_id into keys of about that many; these hosts (at most
one for ``per_salt`` pages) are all that is broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path (host '' is a group like any other, no rule fits);
labels that repeat for a page count once each; null quality and toxic: no label; no labels at all: no page is blocked by
reputation; rows that repeat a page_id are each judged by their own url; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Second labels below which countries register names.
SECOND = ["ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org"]
_PUBLIC = "(" + "|".join(SECOND) + ")[.][a-z][a-z]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def matched_rule(rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits columns host and path, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(f"/{p}"))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    named = F.when(host.rlike(f"(^|[.]){_PUBLIC}$"), F.regexp_extract(host, r"([^.]*[.])?[^.]*[.][^.]*$", 0)).otherwise(F.regexp_extract(host, r"([^.]*[.])?[^.]*$", 0))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(named)


def suffix_of(host: Column) -> Column:
    named = F.when(host.rlike(f"(^|[.]){_PUBLIC}$"), F.regexp_extract(host, r"[^.]*[.][^.]*$", 0)).otherwise(F.regexp_extract(host, r"[^.]*$", 0))
    return F.when(host.rlike(r"^[0-9.]+$"), host).otherwise(named)


def _strength(stats: DataFrame) -> Column:
    """Method of moments: k of a beta prior from columns bad, n and prior mean m of all groups, within 1 .. 10000.

    The variance of the rates beyond binomial noise is V = sum(n (r - m)^2) - sum(m (1 - m)) over sum(n - 1), and k = m (1 - m) / V - 1.
    """
    noise = F.sum(F.col("m") * (1 - F.col("m")))
    over = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)) - noise
    v = over / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    mean = F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / F.sum("n")
    return F.when(v > 0, F.least(F.greatest(mean / v - 1, F.lit(1.0)), F.lit(10000.0))).otherwise(F.lit(10000.0))


def reputation(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """From (host, bad 0/1): tables (host, a, b), (domain, a, b), (suffix, a, b) of posterior beta parameters, and (a, b) of all."""
    scratch = Scratch(labelled.sparkSession)
    hosts = scratch.keep(labelled.groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
                         .select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")))
    domains = scratch.keep(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    one = suffixes.agg(F.sum("bad"), F.sum("n")).first()
    bad, n = one[0] or 0.0, one[1] or 0.0
    top = (bad + 0.5, n - bad + 0.5)  # Jeffreys prior

    def level(groups: DataFrame, mean: Column) -> DataFrame:
        given = scratch.keep(groups.withColumn("m", mean))
        k = float(given.agg(_strength(given)).first()[0] or 1.0)
        return scratch.keep(given.withColumn("a", F.lit(k) * F.col("m") + F.col("bad")).withColumn("b", F.lit(k) * (1 - F.col("m")) + F.col("n") - F.col("bad")))

    s = level(suffixes, F.lit(top[0] / (top[0] + top[1])))
    up = lambda t, key: t.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("up"))
    d = level(domains.join(up(s, "suffix"), "suffix"), F.col("up"))
    h = level(hosts.join(up(d, "domain"), "domain"), F.col("up"))
    return h.select("host", "a", "b"), d.select("domain", "a", "b"), s.select("suffix", "a", "b"), top


def filter_urls(pages: DataFrame, labels: DataFrame, rules=tuple(RULES), z: float = 1.645, most: float = 0.5, per_salt: int = 1_000_000) -> DataFrame:
    """page_id, url, host, path, rule, verdict and the host's posterior mean and lower bound of the bad rate."""
    scratch = Scratch(pages.sparkSession)
    p = pages.select("page_id", F.col("url").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    p = scratch.keep(p.select("page_id", F.col("__url").alias("url"), host.alias("host"), path.alias("path")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    labelled = p.select("page_id", "host").join(outcomes, "page_id").select("host", "bad")
    h, d, s, top = reputation(labelled)
    # the distinct hosts of the pages, with the parameters of the deepest level that has labelled pages
    hosts = p.groupBy("host").agg(F.expr(f"(count(1) + {per_salt - 1}) div {per_salt}").cast("int").alias("salts")).select("host", "salts", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    known = hosts.join(h, "host", "left").select("host", "salts", "domain", "suffix", F.col("a").alias("ha"), F.col("b").alias("hb")) \
        .join(d, "domain", "left").select("host", "salts", "suffix", "ha", "hb", F.col("a").alias("da"), F.col("b").alias("db")) \
        .join(s, "suffix", "left").select("host", "salts", F.coalesce("ha", "da", "a", F.lit(top[0])).alias("a"), F.coalesce("hb", "db", "b", F.lit(top[1])).alias("b"))
    t = F.col("a") + F.col("b")
    mean = F.col("a") / t
    known = scratch.keep(known.select("host", "salts", mean.alias("bad_mean"), (mean - z * F.sqrt(F.col("a") * F.col("b") / (t * t * (t + 1)))).alias("bad_low")))
    salted = known.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    hot = known.where("salts > 1").select("host", "salts")  # at most one host for per_salt pages
    out = p.join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.hash("page_id"), F.coalesce("salts", F.lit(1)))).join(salted, ["host", "salt"], "left")
    rule = F.col("__rule")
    return out.withColumn("__rule", matched_rule(list(rules))).select(
        "page_id", "url", "host", "path", rule.rule.alias("rule"),
        F.coalesce(rule.verdict, F.when(F.col("bad_low") > most, "block").otherwise("allow")).alias("verdict"), "bad_mean", "bad_low")


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _sql_level(name: str, groups: str) -> str:
    return f"""{name}_k AS (SELECT CASE WHEN v > 0 THEN least(greatest(mean / v - 1, 1.0), 10000.0) ELSE 10000.0 END AS k FROM (
  SELECT (sum(n * pow(bad / n - m, 2)) - sum(m * (1 - m))) / greatest(sum(n - 1), 1) AS v, sum(n * m * (1 - m)) / sum(n) AS mean FROM {groups})),
{name} AS (SELECT g.*, k * m + bad AS a, k * (1 - m) + n - bad AS b FROM {groups} g, {name}_k)"""


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages)),
keyed AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host WHEN regexp_matches(host, '(^|[.]){_PUBLIC}$') THEN regexp_extract(host, '([^.]*[.])?[^.]*[.][^.]*$', 0) ELSE regexp_extract(host, '([^.]*[.])?[^.]*$', 0) END AS domain,
         CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host WHEN regexp_matches(host, '(^|[.]){_PUBLIC}$') THEN regexp_extract(host, '[^.]*[.][^.]*$', 0) ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix FROM p),
lab AS (SELECT keyed.*, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM keyed JOIN labels ON page_id = labels.doc_id
        WHERE quality IS NOT NULL OR toxic IS NOT NULL),
h0 AS (SELECT host, domain, suffix, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM lab GROUP BY ALL),
d0 AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d0 GROUP BY ALL),
t AS (SELECT coalesce(sum(bad), 0) + 0.5 AS a, coalesce(sum(n) - sum(bad), 0) + 0.5 AS b FROM s0),
s1 AS (SELECT s0.*, t.a / (t.a + t.b) AS m FROM s0, t), {_sql_level("s", "s1")},
d1 AS (SELECT d0.*, s.a / (s.a + s.b) AS m FROM d0 JOIN s USING (suffix)), {_sql_level("d", "d1")},
h1 AS (SELECT h0.*, d.a / (d.a + d.b) AS m FROM h0 JOIN d USING (domain)), {_sql_level("h", "h1")},
post AS (SELECT keyed.*, coalesce(h.a, d.a, s.a, t.a) AS a, coalesce(h.b, d.b, s.b, t.b) AS b
         FROM keyed LEFT JOIN h ON keyed.host = h.host LEFT JOIN d ON keyed.domain = d.domain LEFT JOIN s ON keyed.suffix = s.suffix, t),
ruled AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM post)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
