"""URL filter: host and path rules, then a character language-model ratio.

Two variable-order Markov models over characters, one of URLs that a rule allows and one
of URLs that a rule blocks, are smoothed by Witten-Bell interpolation: an unseen context
leaves the estimate to the next shorter one, down to a uniform symbol. A URL's score is
the log-likelihood difference per symbol; the threshold is calibrated on labelled URLs
that neither model has seen. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

ORDER = 4
#: Symbols of the uniform model below order 0.
SYMBOLS = 256
#: A gram with at least this share of all occurrences is scored by broadcast; there are at most 1 / HOT of these.
HOT = 0.001
#: Folds 0..CALIBRATION-1 of 16 hold the labelled URLs for the threshold.
CALIBRATION = 4
#: Scores are cut to this range for the calibration histogram, BINS bins to 1.
RANGE, BINS = 8.0, 100

# The rules (host, path, verdict) that the query applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path behind it; empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (nulls if none does)."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _grams(url: Column, order: int) -> Column:
    """All (order + 1)-grams of the padded URL, its end mark included."""
    symbols = F.concat(F.array_repeat(F.lit("\u0002"), order), F.filter(F.split(url, ""), lambda c: c != ""), F.array(F.lit("\u0003")))
    n = F.size(symbols) - order
    # shifted copies side by side: a lambda that names the whole array would build it again for each symbol
    shifted = F.arrays_zip(*[F.slice(symbols, j + 1, n).alias(f"s{j}") for j in range(order + 1)])
    return F.transform(shifted, lambda z: F.concat(*[z[f"s{j}"] for j in range(order + 1)]))


def log_ratio(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, ratio: log P(last symbol | context) by the accepted less by the rejected model.

    ``grams`` has one row per distinct gram with its counts ``accept`` and ``reject``
    (both may be 0). Every join's right side has one row per suffix or context.
    """
    classes = ("accept", "reject")
    out = grams.select("gram", *[F.lit(1.0 / SYMBOLS).alias(f"p_{c}") for c in classes])
    for k in range(order + 1):
        suffix, context = F.substr("gram", F.lit(order + 1 - k)), F.substr("gram", F.lit(order + 1 - k), F.lit(k))
        seen = grams.groupBy(suffix.alias("_s"), context.alias("_c")).agg(*[F.sum(c).alias(f"n_{c}") for c in classes])
        total = seen.groupBy("_c").agg(*[F.sum(f"n_{c}").alias(f"t_{c}") for c in classes],
                                       *[F.sum((F.col(f"n_{c}") > 0).cast("long")).alias(f"d_{c}") for c in classes])
        out = out.withColumns({"_s": suffix, "_c": context}).join(seen.drop("_c"), "_s").join(total, "_c")
        step = {f"p_{c}": F.when(F.col(f"t_{c}") > 0, (F.col(f"n_{c}") + F.col(f"d_{c}") * F.col(f"p_{c}")) / (F.col(f"t_{c}") + F.col(f"d_{c}")))
                .otherwise(F.col(f"p_{c}")) for c in classes}
        out = out.withColumns(step).select("gram", *[f"p_{c}" for c in classes])
    return out.select("gram", (F.log("p_accept") - F.log("p_reject")).alias("ratio"))


def score_urls(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """url, score for distinct urls with columns url, label (1 accepted, 0 rejected, null unknown) and weight.

    Models learn from the labelled urls outside the calibration folds, each as often as
    it occurs. The score is rounded to six decimals.
    """
    spelled = urls.select("url", F.when(F.col("fold") >= CALIBRATION, F.col("label")).alias("learn"), "weight",
                          F.explode(_grams(F.col("url"), order)).alias("gram"))
    counts = stage(spelled.groupBy("gram").agg(
        F.sum(F.when(F.col("learn") == 1, F.col("weight")).otherwise(F.lit(0))).alias("accept"),
        F.sum(F.when(F.col("learn") == 0, F.col("weight")).otherwise(F.lit(0))).alias("reject"),
        F.count(F.lit(1)).alias("n")), "url-grams")
    ratio = stage(log_ratio(counts, order).join(counts.select("gram", "n"), "gram"), "url-ratio")
    total = ratio.agg(F.sum("n")).first()[0] or 0
    hot = ratio.where(F.col("n") >= F.lit(total * HOT)).select("gram", F.col("ratio").alias("hot_ratio"))
    looked = spelled.select("url", "gram").join(F.broadcast(hot), "gram", "left")
    common = looked.where(F.col("hot_ratio").isNotNull()).groupBy("url").agg(F.sum("hot_ratio").alias("s"), F.count(F.lit(1)).alias("n"))
    rare = (looked.where(F.col("hot_ratio").isNull()).select("url", "gram").join(ratio.select("gram", "ratio"), "gram")
            .groupBy("url").agg(F.sum("ratio").alias("s"), F.count(F.lit(1)).alias("n")))
    return common.unionByName(rare).groupBy("url").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The cut at which the share of accepted URLs kept less that of rejected ones is greatest.

    ``scored`` has score, label and weight of calibration URLs. The cut lies midway
    between the best bin and the next lower one that holds a URL (ties: the lowest bin);
    it is 0 where a class is missing. The histogram that the driver reads has at most
    2 * RANGE * BINS + 1 rows.
    """
    bins = (scored.where(F.col("label").isNotNull())
            .groupBy(F.floor(F.least(F.greatest("score", F.lit(-RANGE)), F.lit(RANGE)) * BINS).alias("bin"))
            .agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(F.lit(0))).alias("a"),
                 F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(F.lit(0))).alias("r")).collect())
    accepted, rejected = sum(b.a for b in bins), sum(b.r for b in bins)
    if not accepted or not rejected:
        return 0.0
    bins = sorted(bins, key=lambda b: -b.bin)
    best, kept_a, kept_r = (-2.0, 0.0), 0, 0
    for b, below in zip(bins, [*bins[1:], None], strict=True):
        kept_a, kept_r = kept_a + b.a, kept_r + b.r
        gain = round(kept_a / accepted - kept_r / rejected, 9)
        if gain >= best[0]:
            best = (gain, (b.bin + (below.bin + 1 if below else b.bin)) / 2 / BINS)
    return best[1]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """key, host, path, rule, verdict, score of every row.

    A rule's verdict stands; other URLs are allowed if their score reaches the calibrated
    threshold. A null URL counts as the empty one. Repeated URLs have one score, repeated
    rows stay; without any rule match (or rows) scores are 0 and the threshold 0: allow.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("_url")).withColumns({"host": host, "path": path})
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_rule_verdict": verdict})
    label = F.when(F.col("_rule_verdict") == "allow", 1).when(F.col("_rule_verdict") == "block", 0)
    fold = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 1), 16, 10).cast("int")
    urls = stage(rows.groupBy(F.col("_url").alias("url")).agg(F.max(label).alias("label"), F.count(F.lit(1)).alias("weight"))
                 .withColumn("fold", fold), "urls")
    scored = stage(urls.join(score_urls(urls, order), "url"), "url-scores")
    cut = threshold(scored.where(F.col("fold") < CALIBRATION))
    judged = rows.join(scored.select(F.col("url").alias("_url"), "score"), "_url", "left")
    by_model = F.when(F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(cut), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(key, "host", "path", "rule", F.coalesce("_rule_verdict", by_model).alias("verdict"), "score")


def op2_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("score")


def _sql() -> str:
    k = ORDER
    models, prior = "", "r0"
    for i in range(k + 1):
        s, c = f"substr(gram, {k + 1 - i})", f"substr(gram, {k + 1 - i}, {i})"
        models += f""",
s{i} AS (SELECT {s} AS s, {c} AS c, sum(accept) AS na, sum(reject) AS nr FROM counts GROUP BY ALL),
t{i} AS (SELECT c, sum(na) AS ta, sum(nr) AS tr, count(*) FILTER (na > 0) AS da, count(*) FILTER (nr > 0) AS dr FROM s{i} GROUP BY c),
r{i + 1} AS (SELECT gram, CASE WHEN ta > 0 THEN (na + da * pa) / (ta + da) ELSE pa END AS pa,
    CASE WHEN tr > 0 THEN (nr + dr * pr) / (tr + dr) ELSE pr END AS pr
    FROM {prior} JOIN s{i} ON s{i}.s = {s.replace('gram', prior + '.gram')} JOIN t{i} ON t{i}.c = s{i}.c)"""
        prior = f"r{i + 1}"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""WITH rules(h, p, v) AS (VALUES {rules}),
cut_url AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT n, page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut_url),
rows_ AS (SELECT parts.n, page_id, url, host, path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS rv
    FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
urls AS (SELECT url, max(CASE rv WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END) AS label, count(*) AS weight,
    instr('0123456789abcdef', substr(md5(url), 1, 1)) - 1 AS fold FROM rows_ GROUP BY url),
spelled AS (SELECT url, label, weight, fold, unnest(list_transform(range(1, length(url) + 2),
    lambda i: substr(repeat(chr(2), {k}) || url || chr(3), i, {k + 1}))) AS gram FROM urls),
counts AS (SELECT gram, sum(CASE WHEN fold >= {CALIBRATION} AND label = 1 THEN weight ELSE 0 END) AS accept,
    sum(CASE WHEN fold >= {CALIBRATION} AND label = 0 THEN weight ELSE 0 END) AS reject FROM spelled GROUP BY gram),
r0 AS (SELECT gram, 1.0::DOUBLE / {SYMBOLS} AS pa, 1.0::DOUBLE / {SYMBOLS} AS pr FROM counts){models},
scores AS (SELECT url, round(avg(ln(pa) - ln(pr)), 6) AS score FROM spelled JOIN {prior} USING (gram) GROUP BY url),
bins AS (SELECT floor(least(greatest(score, {-RANGE}), {RANGE}) * {BINS}) AS bin, sum(weight) FILTER (label = 1) AS a, sum(weight) FILTER (label = 0) AS r
    FROM scores JOIN urls USING (url) WHERE fold < {CALIBRATION} AND label IS NOT NULL GROUP BY bin),
gains AS (SELECT bin, round(coalesce(sum(a) OVER w, 0) / sum(a) OVER () - coalesce(sum(r) OVER w, 0) / sum(r) OVER (), 9) AS gain,
    coalesce(lead(bin) OVER w + 1, bin) AS below FROM bins WINDOW w AS (ORDER BY bin DESC)),
cut AS (SELECT coalesce((SELECT (bin + below) / 2.0 / {BINS} FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, bin LIMIT 1), 0.0) AS cut)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM rows_ JOIN scores USING (url), cut"""


QUERIES = {"op2_url_ratio": op2_url_ratio}
SQL = {"op2_url_ratio": _sql()}
