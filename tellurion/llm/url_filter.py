"""URL filters: host and path rules, and for what they leave open the ratio of two character
language models, with DataFrame operations only.

Each model is a Markov model of variable order: the chance of a character after its two
predecessors leans on that after one, which leans on that after none, each with `pull`
imaginary counts; a context seen fewer than `least` times is passed over for the shorter
one. Characters fold to 40 symbols, so a model has at most 40 ** 3 = 64,000 rows however
many URLs there are; that bound lets it be broadcast. The examples are the URLs that the rules
decide: those they block train the rejected model, those they allow the accepted one. Three
sixteenths of them, by a hash of the URL, are held out for the threshold. A URL is blocked if
the difference of its log-likelihoods (rejected minus accepted), divided by its length,
exceeds a threshold that lies as many standard deviations above the mean of the accepted
held-out URLs as below that of the rejected ones. Without held-out and other examples of both
classes everything that the rules leave open is allowed. held_out_errors() counts the held-out
URLs that fall on the wrong side.

Null URLs and URLs without :// have an empty host and path. Repeated URLs are scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.session import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SYMBOLS = 39
#: URLs whose md5 begins with a lesser digit are held out.
HELD_OUT_BELOW = "3"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


RULES = (
    Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, PARTS, 1), UPPER, LOWER), F.regexp_extract(whole, PARTS, 2)


def decided(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct of the longest fitting rule's text and verdict, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(r.fits(host, path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def folded(host: Column, path: Column) -> Column:
    """Two start marks, the host and path in 36 symbols, and an end mark."""
    text = F.translate(F.concat(host, path), UPPER + "123456789", LOWER + "0" * 9)
    return F.concat(F.lit("^^"), F.regexp_replace(text, r"[^a-z0./_%~:@=+-]", "*"), F.lit("$"))


def grams(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))


def model(counts: DataFrame, pull: float = 4.0, least: int = 3) -> DataFrame:
    """counts(gram, good, bad) -> (gram, ratio): log of the rejected model's chance over the accepted one's."""

    def total(name: str, *part: Column) -> Column:
        return F.sum(name).over(Window.partitionBy(*part))

    def chance(name: str) -> Column:
        g = F.col("gram")
        one = (total(name, F.substring(g, 3, 1)) + pull / SYMBOLS) / (total(name, F.lit(1)) + pull)
        near = total(name, F.substring(g, 2, 1))
        two = F.when(near >= least, (total(name, F.substring(g, 2, 2)) + pull * one) / (near + pull)).otherwise(one)
        far = total(name, F.substring(g, 1, 2))
        return F.when(far >= least, (F.col(name) + pull * two) / (far + pull)).otherwise(two)

    return counts.select("gram", (F.log(chance("bad")) - F.log(chance("good"))).alias("ratio"))


def scored(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, float | None]:
    """Each different URL once: (url, by, bad, held, score), stored, and the threshold, None without examples of both classes.

    by is what the rules say; bad is 1 for examples of the rejected ones, 0 for accepted ones, else null.
    """
    host, path = host_and_path(F.col(url))
    sites = pages.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    sites = sites.select("url", decided(F.col("host"), F.col("path"), rules).alias("by"), folded(F.col("host"), F.col("path")).alias("text"))
    held = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1) < HELD_OUT_BELOW
    sites = saved(sites.withColumns({"bad": F.when(F.col("by").isNotNull(), (F.col("by.verdict") == "block").cast("int")), "held": held}), "sites")
    learnt = F.when(~F.col("held"), F.col("bad"))
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    # N-grams of all URLs, those that no example has with counts of 0.
    counts = sites.select(learnt.alias("bad"), F.explode(grams(F.col("text"))).alias("gram")).groupBy("gram").agg(number(1 - F.col("bad")).alias("good"), number(F.col("bad")).alias("bad"))
    ratios = saved(model(counts), "model")
    rows = sites.select("url", "by", "bad", "held", (F.length("text") - 2).alias("n"), F.explode(grams(F.col("text"))).alias("gram")).join(F.broadcast(ratios), "gram")
    rows = rows.groupBy("url").agg(F.first("by").alias("by"), F.first("bad").alias("bad"), F.first("held").alias("held"), F.round(F.sum("ratio") / F.first("n"), 6).alias("score"))
    rows = saved(rows, "scores")
    g = {(r.held, r.bad): (r.mean, r.spread) for r in rows.filter("bad is not null").groupBy("held", "bad").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).collect()}
    if len(g) < 4 or g[True, 1][0] <= g[True, 0][0]:
        return rows, None
    (low, below), (high, above) = g[True, 0], g[True, 1]
    return rows, low + (high - low) * (below / (below + above) if below + above else 0.5)


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages(url, ...) -> (row, host, path, rule, verdict, score); row is the page's own row, score is null where a rule decides."""
    found, threshold = scored(pages, url, rules)
    blocked = F.lit(False) if threshold is None else F.col("score") > threshold
    verdicts = found.select(F.col("url").alias("_url"), F.col("by.rule").alias("rule"), F.coalesce("by.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), F.when(F.col("by").isNull(), F.col("score")).alias("score"))
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    return rows.join(verdicts, rows.url.eqNullSafe(verdicts["_url"])).select("row", "host", "path", "rule", "verdict", "score")


def held_out_errors(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> dict[str, tuple[int, int]]:
    """Of the held-out URLs that the rules allow and block: how many there are, and how many the models alone would judge otherwise."""
    found, threshold = scored(pages, url, rules)
    blocked = F.lit(False) if threshold is None else F.col("score") > threshold
    n = found.filter("held and bad is not null").groupBy("bad").agg(F.count("*").alias("n"), F.count_if(blocked.cast("int") != F.col("bad")).alias("wrong")).collect()
    return {("allow", "block")[r.bad]: (r.n, r.wrong) for r in n}


def _sql_rules(rules: tuple[Rule, ...], part: str) -> str:
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text if part == 'rule' else r.verdict}'"
        for r in sorted(rules, key=lambda r: -len(r.text))
    )
    return f"CASE {cases} END"


ORACLE = rf"""
WITH pages2 AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
sites AS (
  SELECT url, {_sql_rules(RULES, "rule")} AS rule, {_sql_rules(RULES, "verdict")} AS by_rule,
    '^^' || regexp_replace(translate(host || path, '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./_%~:@=+-]', '*', 'g') || '$' AS text,
    CASE {_sql_rules(RULES, "verdict")} WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad, substr(md5(coalesce(url, '')), 1, 1) < '{HELD_OUT_BELOW}' AS held
  FROM (SELECT DISTINCT url, host, path FROM pages2)),
placed AS (SELECT url, bad, held, length(text) - 2 AS n, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) AS gram FROM sites),
counts AS (SELECT gram, coalesce(sum(1 - bad) FILTER (NOT held), 0) AS good, coalesce(sum(bad) FILTER (NOT held), 0) AS bad FROM placed GROUP BY gram),
sums AS (
  SELECT gram, good, bad,
    sum(good) OVER (PARTITION BY substr(gram, 3, 1)) AS g1, sum(good) OVER () AS g0, sum(good) OVER (PARTITION BY substr(gram, 2, 1)) AS gn,
    sum(good) OVER (PARTITION BY substr(gram, 2, 2)) AS g2, sum(good) OVER (PARTITION BY substr(gram, 1, 2)) AS gf,
    sum(bad) OVER (PARTITION BY substr(gram, 3, 1)) AS b1, sum(bad) OVER () AS b0, sum(bad) OVER (PARTITION BY substr(gram, 2, 1)) AS bn,
    sum(bad) OVER (PARTITION BY substr(gram, 2, 2)) AS b2, sum(bad) OVER (PARTITION BY substr(gram, 1, 2)) AS bf
  FROM counts),
ones AS (SELECT *, (g1 + 4.0::DOUBLE / 39) / (g0 + 4.0::DOUBLE) AS gp1, (b1 + 4.0::DOUBLE / 39) / (b0 + 4.0::DOUBLE) AS bp1 FROM sums),
twos AS (
  SELECT *, CASE WHEN gn >= 3 THEN (g2 + 4.0::DOUBLE * gp1) / (gn + 4.0::DOUBLE) ELSE gp1 END AS gp2,
    CASE WHEN bn >= 3 THEN (b2 + 4.0::DOUBLE * bp1) / (bn + 4.0::DOUBLE) ELSE bp1 END AS bp2 FROM ones),
ratios AS (
  SELECT gram, ln(CASE WHEN bf >= 3 THEN (bad + 4.0::DOUBLE * bp2) / (bf + 4.0::DOUBLE) ELSE bp2 END)
    - ln(CASE WHEN gf >= 3 THEN (good + 4.0::DOUBLE * gp2) / (gf + 4.0::DOUBLE) ELSE gp2 END) AS ratio FROM twos),
scores AS (SELECT url, placed.bad, held, round(sum(ratio) / any_value(n), 6) AS score FROM placed JOIN ratios USING (gram) GROUP BY url, placed.bad, held),
means AS (
  SELECT avg(score) FILTER (held AND bad = 0) AS mg, avg(score) FILTER (held AND bad = 1) AS mb, stddev_pop(score) FILTER (held AND bad = 0) AS sg, stddev_pop(score) FILTER (held AND bad = 1) AS sb,
    count(*) FILTER (NOT held AND bad = 0) AS ng, count(*) FILTER (NOT held AND bad = 1) AS nb FROM scores),
limits AS (SELECT CASE WHEN mb > mg AND ng > 0 AND nb > 0 THEN mg + (mb - mg) * CASE WHEN sg + sb > 0 THEN sg / (sg + sb) ELSE 0.5 END END AS threshold FROM means)
SELECT p.page_id, p.host, p.path, s.rule, coalesce(s.by_rule, CASE WHEN c.score > l.threshold THEN 'block' ELSE 'allow' END) AS verdict
FROM pages2 p JOIN sites s ON p.url IS NOT DISTINCT FROM s.url JOIN scores c ON p.url IS NOT DISTINCT FROM c.url CROSS JOIN limits l
"""
