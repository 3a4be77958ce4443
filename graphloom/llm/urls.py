"""Operator 10: URL filter by rules and, where no rule fits, a character language-model ratio.

Two interpolated character Markov models (contexts of 0, 1 and 2 characters, Witten-Bell smoothing)
are counted over rejected and over accepted URLs: those that a rule blocks and all others, or any examples
given. A URL is scored by its length-normalised log-likelihood difference. A quarter of the examples' hosts
is not counted; the accepted ones among them that no rule fits calibrate the threshold, so that of the
URLs the rules say nothing on few are blocked, the likest to blocked ones.

DataFrame functions only. The alphabet has 38 characters, so a model has 38**3 = 54,872 numbers
however large the input: that bound is why it may be handed to the scan as one array.

Defined cases: a null URL or one without ``://`` has empty host and path, score 0 and verdict
allow; all other characters fall on one letter of the alphabet, so any text can be scored; repeated
rows get equal verdicts; without an accepted or without a rejected example (or with an empty table) the
score is 0 and all is allowed that no rule blocks; without such an example among those held out the
threshold is 0; extra columns pass through, but those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, fresh, table

# The rules of the query (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: "^" pads the start, "0" stands for every digit and "~" for every character that isn't listed.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-_?=&%:~"
#: Share of the accepted examples held out, those that no rule fits, that the method may reject, and one in how many hosts is held out.
FALSE_REJECTS, HELD_OUT = 0.02, 4


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """host, path, and all that follows ``://``; empty where there is none."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. Ties: block before allow."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    if not order:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    rule = F.coalesce(*[F.when(ok, F.lit(h + p)) for ok, (_, h, p) in zip(fits, order, strict=True)])
    return rule, F.coalesce(*[F.when(ok, F.lit(v)) for ok, (v, _, _) in zip(fits, order, strict=True)])


def _grams(rest: Column) -> Column:
    """For every character the number of (two before it, it) in base len(ALPHABET)."""
    n, listed = len(ALPHABET), r"[^a-z0/.\-_?=&%:]"
    text = F.regexp_replace(F.regexp_replace(F.lower(rest), "[0-9]", "0"), listed, "~")
    codes = F.transform(F.filter(F.split(F.concat(F.lit("^^"), text), ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    at = lambda a, i: F.element_at(a, i)
    whole = F.transform(F.array(codes), lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 2), lambda i: at(a, i) * n * n + at(a, i + 1) * n + at(a, i + 2)))
    return F.when(F.length(rest) > 0, whole[0]).otherwise(F.array().cast("array<int>"))


def held_out(host: Column) -> Column:
    """Whether examples of this host calibrate, instead of being counted."""
    return F.conv(F.substring(F.md5(host.cast("binary")), 1, 8), 16, 10).cast("bigint") % HELD_OUT == 0


def model(urls: DataFrame, grams: str, rejected: str) -> DataFrame | None:
    """One row: ``llr``, the array of log p(c | two before) under rejected minus under accepted URLs. None if either has none."""
    n, both = len(ALPHABET), ("n0", "n1")
    counts = urls.select(F.explode(grams).alias("g"), F.col(rejected).cast("long").alias("r")).groupBy("g")
    counts = cut(counts.agg(F.sum(1 - F.col("r")).cast("double").alias("n0"), F.sum("r").cast("double").alias("n1")))  # at most n**3 rows, as all below
    abc = counts.withColumns({"c": F.col("g") % n, "b": F.floor(F.col("g") / n) % n, "ab": F.floor(F.col("g") / n)})
    bc = abc.groupBy("b", "c").agg(*[F.sum(k).alias(f"{k}_bc") for k in both])
    kinds = lambda k: F.sum(F.when(F.col(k) > 0, 1.0).otherwise(0.0))
    after_ab = abc.groupBy("ab").agg(*[f(k).alias(k + name) for k in both for f, name in ((F.sum, "_ab"), (kinds, "_tab"))])
    after_b = bc.groupBy("b").agg(*[f(f"{k}_bc").alias(k + name) for k in both for f, name in ((F.sum, "_b"), (kinds, "_tb"))])
    only_c = bc.groupBy("c").agg(*[F.sum(f"{k}_bc").alias(f"{k}_c") for k in both])
    totals = counts.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in both]).first()
    if not (totals["n0"] and totals["n1"]):
        return None
    grid = urls.sparkSession.range(n**3).select(F.col("id").cast("int").alias("g"), (F.col("id") % n).alias("c"), (F.floor(F.col("id") / n) % n).alias("b"), F.floor(F.col("id") / n).alias("ab"))
    for part, by in ((counts, ["g"]), (bc, ["b", "c"]), (after_ab, ["ab"]), (after_b, ["b"]), (only_c, ["c"])):
        grid = grid.join(F.broadcast(part), by, "left")
    grid = grid.fillna(0.0)
    p = {}
    for k in both:
        p1 = (F.col(f"{k}_c") + 1.0) / (totals[k] + float(n))
        p2 = F.when(F.col(f"{k}_b") > 0, (F.col(f"{k}_bc") + F.col(f"{k}_tb") * p1) / (F.col(f"{k}_b") + F.col(f"{k}_tb"))).otherwise(p1)
        p[k] = F.when(F.col(f"{k}_ab") > 0, (F.col(k) + F.col(f"{k}_tab") * p2) / (F.col(f"{k}_ab") + F.col(f"{k}_tab"))).otherwise(p2)
    llr = grid.select("g", (F.log(p["n1"]) - F.log(p["n0"])).alias("llr"))
    return llr.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "llr"))), lambda x: x["llr"]).alias("llr"))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", false_rejects: float = FALSE_REJECTS,
    rejected: Column | None = None,
) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, score, verdict (allow or block).

    ``rejected`` is true for rejected examples, false for accepted ones and null for all other rows; without
    it the URLs that a rule blocks are rejected and all others accepted. The threshold is the (1 - false_rejects) quantile of the scores of the accepted
    examples held out that no rule fits, and 0 at least; a URL above it that no rule fits is blocked.
    """
    n = fresh(pages, "grams", "bad", "llr")
    host, path, rest = split_url(F.col(url_col).cast("string"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    kept = [F.col(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    labelled = pages.select(host.alias("host"), path.alias("path"), rest.alias("rest"), *([] if rejected is None else [rejected.alias("bad")]))
    if rejected is None:
        labelled = labelled.withColumn("bad", F.coalesce(ruled == "block", F.lit(False)))
    labelled = labelled.where("bad IS NOT NULL AND rest <> ''")
    labelled = labelled.select(_grams(F.col("rest")).alias("grams"), "bad", held_out(F.col("host")).alias("out"), ruled.isNull().alias("unruled"))
    made = model(labelled.where("NOT out"), "grams", "bad")
    if made is None:
        out = pages.select(*kept, host.alias("host"), path.alias("path"))
        out = out.withColumns({"rule": rule, "score": F.lit(0.0)})
        return out.select(*[c for c in out.columns], F.coalesce(ruled, F.lit("allow")).alias("verdict"))
    weights = cut(made).scalar()

    def mean(grams: Column, llr: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.element_at(llr, g + 1))
        return F.when(F.size(grams) > 0, F.round(total / F.size(grams), 6)).otherwise(0.0)

    # a subquery can't stand inside a higher-order function: it is a column of the projection below
    scored = labelled.where("out AND unruled AND NOT bad").select("grams", weights.alias("llr"))
    scored = scored.select(mean(F.col("grams"), F.col("llr")).alias("score"))
    # three digits bound what the percentile has to hold: a score is a mean of logarithms within +-20
    scored = scored.select(F.round("score", 3).alias("score")).groupBy("score").count()
    threshold = scored.agg(F.expr(f"percentile(score, {1 - false_rejects}, count)").alias("t"))
    threshold = cut(threshold.select(F.greatest(F.coalesce("t", F.lit(0.0)), F.lit(0.0)).alias("t"))).scalar()
    out = pages.select(*kept, host.alias("host"), path.alias("path"), _grams(rest).alias(n["grams"]))
    out = out.select(*kept, "host", "path", rule.alias("rule"), ruled.alias(n["bad"]), n["grams"], weights.alias(n["llr"]))
    out = out.withColumn("score", mean(F.col(n["grams"]), F.col(n["llr"])))
    return out.select(*kept, "host", "path", "rule", "score", F.coalesce(n["bad"], F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"))


def op10_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _smoothed(k: str) -> str:
    count = lambda part, name=k: f"coalesce({part}.{name}, 0.0)"
    p1 = f"({count('c')} + 1.0) / (n.{k} + {len(ALPHABET)}.0)"
    p2 = f"CASE WHEN {count('b')} > 0 THEN ({count('bc')} + {count('b', 't' + k)} * {p1}) / ({count('b')} + {count('b', 't' + k)}) ELSE {p1} END"
    return f"CASE WHEN {count('ab')} > 0 THEN (g.{k} + {count('ab', 't' + k)} * ({p2})) / ({count('ab')} + {count('ab', 't' + k)}) ELSE {p2} END"


_LLR = f"ln({_smoothed('n1')}) - ln({_smoothed('n0')})"


# DuckDB: the same models from the grams as strings.
OP10_SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM u),
r AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM h, (VALUES {_RULES}) rules(v, rh, rp)
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
s AS (SELECT h.k, '^^' || regexp_replace(regexp_replace(lower(rest), '[0-9]', '0', 'g'), '[^a-z0/.\-_?=&%:]', '~', 'g') AS s,
  coalesce(r.v = 'block', false) AS bad, r.v IS NULL AS unruled, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % {HELD_OUT} = 0 AS held FROM h LEFT JOIN r ON r.k = h.k WHERE rest <> ''),
x AS (SELECT k, bad, held, unruled, substr(s, i, 3) AS g FROM (SELECT k, bad, held, unruled, s, unnest(range(1, length(s) - 1)) AS i FROM s) y),
g AS (SELECT g, CAST(count(*) FILTER (NOT bad) AS DOUBLE) AS n0, CAST(count(*) FILTER (bad) AS DOUBLE) AS n1 FROM x WHERE bad IS NOT NULL AND NOT held GROUP BY g),
bc AS (SELECT substr(g, 2) AS g, sum(n0) AS n0, sum(n1) AS n1 FROM g GROUP BY 1),
ab AS (SELECT substr(g, 1, 2) AS g, sum(n0) AS n0, sum(n1) AS n1, count(*) FILTER (n0 > 0) AS tn0, count(*) FILTER (n1 > 0) AS tn1 FROM g GROUP BY 1),
b AS (SELECT substr(g, 1, 1) AS g, sum(n0) AS n0, sum(n1) AS n1, count(*) FILTER (n0 > 0) AS tn0, count(*) FILTER (n1 > 0) AS tn1 FROM bc GROUP BY 1),
c AS (SELECT substr(g, 2) AS g, sum(n0) AS n0, sum(n1) AS n1 FROM bc GROUP BY 1),
n AS (SELECT coalesce(sum(n0), 0) AS n0, coalesce(sum(n1), 0) AS n1 FROM g),
every AS (SELECT DISTINCT g FROM x),
z AS (SELECT every.g, coalesce(g.n0, 0.0) AS n0, coalesce(g.n1, 0.0) AS n1 FROM every LEFT JOIN g ON g.g = every.g),
llr AS (SELECT g.g, {_LLR} AS llr
  FROM z g LEFT JOIN bc ON bc.g = substr(g.g, 2) LEFT JOIN ab ON ab.g = substr(g.g, 1, 2)
  LEFT JOIN b ON b.g = substr(g.g, 2, 1) LEFT JOIN c ON c.g = substr(g.g, 3), n),
score AS (SELECT k, any_value(bad) AS bad, any_value(held) AS held, any_value(unruled) AS unruled, round(avg(llr), 6) AS score FROM x JOIN llr ON llr.g = x.g GROUP BY k),
t AS (SELECT greatest(coalesce(quantile_cont(round(score, 3), {1 - FALSE_REJECTS}) FILTER (held AND unruled AND NOT bad), 0.0), 0.0) AS t FROM score)
SELECT page_id, host, path, rule, coalesce(r.v, CASE WHEN n.n0 > 0 AND n.n1 > 0 AND score.score > t.t THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN n.n0 > 0 AND n.n1 > 0 THEN coalesce(score.score, 0.0) ELSE 0.0 END AS score
FROM h LEFT JOIN score ON score.k = h.k LEFT JOIN r ON r.k = h.k, t, n
"""
