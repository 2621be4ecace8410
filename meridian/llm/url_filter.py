"""URL filters: host rules first, then the ratio of two character language models.

Variable-order Markov models (contexts of 0 to 3 characters, Witten-Bell interpolation) are counted from all urls that
the rules accept and all that they reject. A url's score is its log-likelihood difference for each character; the
threshold lies between the two classes' mean scores, in proportion to their deviations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.shared import fresh, written

#: (verdict, host/path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 3
BROADCAST_ROWS = 200_000
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(hosts: Column, paths: Column, rules: Sequence[tuple[str, str]], give: int) -> Column:
    """The longest fitting rule's verdict (give 0) or text (give 1); null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = r[1].partition("/")
        fits = ((hosts == name) | hosts.endswith("." + name)) & paths.startswith("/" + rest)
        out = F.when(fits, F.lit(r[give])).otherwise(out)
    return out


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """Each character of ^^^url$ after ^^^, with the three before it."""
    padded = F.concat(F.lit("^" * ORDER), F.col("url"), F.lit("$"))
    return urls.withColumn("_u", padded).select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("url") + 1), lambda i: F.substring("_u", i, F.lit(ORDER + 1)))).alias("gram"))


def _ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log P(allow) - log P(block) of the last character after the others, in 1e-9 units, from gram, n_allow, n_block."""
    out, p = counts.select("gram"), {c: F.lit(1.0 / 256) for c in ("allow", "block")}
    for k in range(ORDER + 1):
        seen = counts.groupBy(F.right("gram", F.lit(k + 1)).alias(f"g{k}")).agg(*(F.sum(f"n_{c}").alias(f"{c}{k}") for c in p))
        about = seen.groupBy(F.left(f"g{k}", F.lit(k)).alias(f"c{k}")).agg(*(F.sum(f"{c}{k}").alias(f"{c}{k}_all") for c in p), *(F.sum((F.col(f"{c}{k}") > 0).cast("long")).alias(f"{c}{k}_types") for c in p))
        both = seen.join(about, F.left(f"g{k}", F.lit(k)) == F.col(f"c{k}"))
        out = out.join(both, F.right("gram", F.lit(k + 1)) == F.col(f"g{k}"))
        for c in p:
            all_ = F.col(f"{c}{k}_all") + F.col(f"{c}{k}_types")
            p[c] = F.when(all_ > 0, (F.col(f"{c}{k}") + F.col(f"{c}{k}_types") * p[c]) / all_).otherwise(p[c])
    return out.select("gram", F.round((F.log(p["allow"]) - F.log(p["block"])) * 1e9).cast("long").alias("ratio"))


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block: the rule's, else the method's), url_score (with an underscore where pages has such a column).

    Every distinct url is scored once. Null urls count as empty ones. Without rejected urls the method allows all,
    without accepted ones it blocks all that no rule decides; without either it allows.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    urls = written(pages.select(u.alias("url")).distinct().withColumn("label", rule(host(F.col("url")), path(F.col("url")), rules, 0)))
    counts = written(_grams(urls, "label").groupBy("gram").agg(*(F.count(F.when(F.col("label") == c, 1)).alias(f"n_{c}") for c in ("allow", "block"))))
    ratios = written(_ratios(counts))
    grams = _grams(urls, "url")
    if ratios.count() <= BROADCAST_ROWS:
        found = grams.join(F.broadcast(ratios), "gram")
    else:  # a frequent gram is dealt to SALTS tasks
        salted = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = grams.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    sums = found.groupBy("url").agg((F.sum("ratio") / F.count("*") / 1e9).alias("score"))
    scores = written(urls.join(sums, "url").select("url", "label", "score"))
    m = scores.agg(*(f(F.when(F.col("label") == c, F.col("score"))).alias(f"{c}_{n}") for c in ("allow", "block") for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first()
    if m["block_mean"] is None or m["allow_mean"] is None:
        limit = float("inf") if m["allow_mean"] is None and m["block_mean"] is not None else float("-inf")
    else:
        sd = m["allow_sd"] + m["block_sd"]
        limit = round((m["allow_mean"] * m["block_sd"] + m["block_mean"] * m["allow_sd"]) / sd if sd else (m["allow_mean"] + m["block_mean"]) / 2, 6)
    # a page's own columns go as one, so that no name of theirs meets one of these
    scored = pages.select(F.struct("*").alias("row"), u.alias("u")).join(scores.select(F.col("url").alias("u"), "score"), "u")
    h, p = host(F.col("u")), path(F.col("u"))
    verdict = F.coalesce(rule(h, p, rules, 0), F.when(F.round("score", 9) >= limit, "allow").otherwise("block"))
    new = fresh(pages, "host", "path", "rule", "verdict", "url_score")
    return scored.select("row.*", *(c.alias(n) for c, n in zip((h, p, rule(h, p, rules, 1), verdict, F.col("score")), new)))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(give: int) -> str:
    whens = []
    for r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = r[1].partition("/")
        whens.append(f"WHEN (host = '{name}' OR suffix(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{r[give]}'")
    return f"CASE {' '.join(whens)} END"


def _sql() -> str:
    def orders() -> str:
        out = ""
        for k in range(ORDER + 1):
            ctx = f"left(g, {k})" if k else "''"
            out += f"""s{k} AS (SELECT right(gram, {k + 1}) AS g, sum(na) AS na, sum(nb) AS nb FROM c GROUP BY 1),
            t{k} AS (SELECT {ctx} AS x, sum(na) AS ta, sum(nb) AS tb, sum((na > 0)::INT) AS ua, sum((nb > 0)::INT) AS ub FROM s{k} GROUP BY 1),
            """
        return out

    steps = "r0 AS (SELECT gram, 1.0::DOUBLE / 256 AS pa, 1.0::DOUBLE / 256 AS pb FROM c),\n"
    for k in range(ORDER + 1):
        ctx = f"left(s.g, {k})" if k else "''"
        steps += f"""r{k + 1} AS (SELECT gram, {', '.join(f"CASE WHEN t{x} + u{x} > 0 THEN (n{x} + u{x} * p{x}) / (t{x} + u{x}) ELSE p{x} END AS p{x}" for x in 'ab')}
            FROM r{k} JOIN s{k} s ON right(gram, {k + 1}) = s.g JOIN t{k} t ON {ctx} = t.x),
            """
    return rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    u AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT url FROM p)),
    l AS (SELECT *, {_rule_sql(0)} AS label, {_rule_sql(1)} AS rule FROM u),
    e AS (SELECT url, label, unnest(list_transform(range(1, length(url)::BIGINT + 2), lambda i: substring('^^^' || url || '$', i, {ORDER + 1}))) AS gram FROM l),
    c AS (SELECT gram, count(*) FILTER (label = 'allow') AS na, count(*) FILTER (label = 'block') AS nb FROM e GROUP BY gram),
    {orders()}{steps}q AS (SELECT gram, CAST(round((ln(pa) - ln(pb)) * 1e9) AS BIGINT) AS ratio FROM r{ORDER + 1}),
    z AS (SELECT url, sum(ratio)::DOUBLE / count(*) / 1e9 AS score FROM e JOIN q USING (gram) GROUP BY url),
    y AS (SELECT l.*, z.score FROM l JOIN z USING (url)),
    m AS (SELECT avg(score) FILTER (label = 'allow') AS am, avg(score) FILTER (label = 'block') AS bm, stddev_pop(score) FILTER (label = 'allow') AS asd, stddev_pop(score) FILTER (label = 'block') AS bsd FROM y),
    v AS (SELECT CASE WHEN am IS NULL AND bm IS NOT NULL THEN 1e300 WHEN am IS NULL OR bm IS NULL THEN -1e300 WHEN asd + bsd = 0 THEN round((am + bm) / 2, 6) ELSE round((am * bsd + bm * asd) / (asd + bsd), 6) END AS lim FROM m)
    SELECT page_id, host, path, rule, coalesce(label, CASE WHEN round(score, 9) >= lim THEN 'allow' ELSE 'block' END) AS verdict FROM p JOIN y USING (url), v"""


OP6_SQL = _sql()
