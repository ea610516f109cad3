"""URL filters: rules first, then logistic regression on hashed character n-grams, with DataFrame functions only.

A rule names a host, which stands for its subdomains as well, and the beginning of a path; the longest
rule that fits decides. What no rule fits is judged by a logistic regression on the n-grams of host
and path, which a small labelled table of urls trains by full gradient steps. Weights are whole
millionths, so sums do not depend on their order and every run gives the same model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.binding import let
from dnsflow.llm import common

#: Lengths of the n-grams; buckets they are hashed to (a prime), the last is the constant term.
GRAMS, BUCKETS, BASE = (3, 4, 5), 16381, 131
#: Gradient steps, the share of the mean gradient in each, and the unit of the weights.
STEPS, RATE, UNIT = 60, 0.1, 1_000_000
#: (verdict, host, path) of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Names for the labelled urls of the query: sites nobody wants to learn from, and sites to keep.
UNWANTED = (
    "cheap-pills online-pills pills-shop cheap-meds cheap-viagra spam-farm link-farm spam-links seo-spam click-farm casino-win casino-bonus "
    "lucky-casino best-casino free-bets bets-win sports-bets win-lottery free-crack warez-crack adult-x adult-cams xxx-videos xxx-cams "
    "ads-track ads-click track-ads fast-loans payday-loans replica-watches"
)
WANTED = (
    "library archive museum weather gardening recipes history science teaching nation thering other thread therapy station weather-report "
    "the-times reading-room open-data writers readers travel cooking music theatre forestry farming-news physics letters union"
)
#: The labelled urls: every name as a domain and as a part of a larger site, with pages dealt out in turn.
LABELLED = [
    (f"http://{host}/{('en/17', 'de/205', 'fr/33', 'es/9', 'about.html', 'archive/2', 'index.html')[(3 * n + k) % 7]}", label)
    for label, names in ((1, UNWANTED), (0, WANTED))
    for n, name in enumerate(names.split())
    for k, host in enumerate((f"{name}.{('org', 'net', 'info')[n % 3]}", f"{('www.', 'm.', 'blog.', '')[n % 4]}{name}.example.{('org', 'net')[n % 2]}"))
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct with the rule and its verdict: of the rules that fit the longest, of equal ones that with the longer host; null if none fits."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    kind = "array<struct<size:int,of_host:int,rule:string,verdict:string,path:string>>"
    by_host: dict[str, list] = {}
    for verdict, of, start in rules:
        row = (len(of + start), len(of), of + start, verdict, start)
        by_host.setdefault(of, []).append(F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("size", "of_host", "rule", "verdict", "path"))]))
    table = F.create_map(*[x for of, rows in by_host.items() for x in (F.lit(of), F.array(*rows))])
    labels = max(of.count(".") + 1 for of in by_host)
    found = F.flatten(F.array(*[F.coalesce(table[F.substring_index(host, ".", -k)], F.array().cast(kind)) for k in range(1, labels + 1)]))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def grams(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of `^host$path`, and the constant term."""

    def of(codes: Column) -> Column:
        def at(n):
            def bucket(i):
                total = F.lit(n).cast("long")
                for k in range(n):
                    total = total * BASE + F.get(codes, i + k)
                return (total % BUCKETS).cast("int")

            some = F.transform(F.sequence(F.lit(0), F.size(codes) - n), bucket)
            return F.when(F.size(codes) >= n, some).otherwise(F.array().cast("array<int>"))

        return F.array_distinct(F.concat(F.array(F.lit(BUCKETS)), *[at(n) for n in GRAMS]))

    return let(F.transform(F.split(F.concat(F.lit("^"), host, F.lit("$"), path), ""), F.ascii), of)


@dataclass(frozen=True)
class Model:
    """A weight for every bucket, in units of 1 / UNIT."""

    weights: tuple[int, ...]

    def margin(self, buckets: Column) -> Column:
        """The sum of the weights, a long; its logistic function is the likelihood that the url is to be blocked."""
        held = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<bigint>")
        return F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.get(held, b))


def train(labelled: DataFrame, url: str = "url", label: str = "label", steps: int = STEPS) -> Model:
    """A model of (url, label 0 or 1). Rows without a label are left out; no rows give zero weights.

    A step sums the gradient of all rows by bucket; only the weights, of a fixed number, come to the driver.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("label"), grams(*host_and_path(F.col(url))).alias("buckets"))
    rows = common.written(rows, "labelled")
    n = rows.count()
    model = Model((0,) * (BUCKETS + 1))
    for _ in range(steps if n else 0):
        likelihood = 1 / (1 + F.exp(-model.margin(F.col("buckets")).cast("double") / UNIT))
        missing = F.floor((F.col("label") - likelihood) * UNIT + 0.5)
        gradient = rows.select(missing.alias("g"), F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("g").alias("g"))
        weights = list(model.weights)
        for r in gradient.select("bucket", F.floor(F.col("g").cast("double") * RATE / n).alias("more")).collect():
            weights[r.bucket] += r.more
        model = Model(tuple(weights))
    return model


def judged(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and margin (null where a rule decides) of every row.

    Null urls and those without `://` have empty host and path and are judged by the model, as is all that
    no rule fits: it blocks if the margin is over zero. Repeated rows and null ids are judged one by
    one; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), *[c.alias(n) for c, n in zip(host_and_path(F.col(url)), ("host", "path"))])
    rows = rows.withColumn("fits", rule_for(F.col("host"), F.col("path"), rules))
    margin = F.when(F.col("fits").isNull(), model.margin(grams(F.col("host"), F.col("path"))))
    rows = rows.withColumn("margin", margin)
    verdict = F.coalesce("fits.verdict", F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "margin")


def op11_url_filter(spark, sf_dir) -> DataFrame:
    """page_id, host, path, rule, verdict and margin of every page."""
    model = train(spark.createDataFrame(LABELLED, "url string, label int"))
    return judged(common.table(spark, sf_dir, "pages"), model, RULES)


def twin() -> str:
    """The query as SQL, training included."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    labelled = ", ".join(f"({n}, '{u}', {y})" for n, (u, y) in enumerate(LABELLED))
    split = """CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"""
    host = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"

    def gram(n):
        total = str(n)
        for k in range(n):
            total = f"({total} * {BASE} + codes[i + {k}])"
        return f"list_transform(range(1, len(codes) - {n - 2}), lambda i: {total} % {BUCKETS})"

    parts = ", ".join([f"[CAST({BUCKETS} AS BIGINT)]"] + [f"CAST({gram(n)} AS BIGINT[])" for n in GRAMS])
    buckets = f"list_distinct(flatten([{parts}]))"
    codes = "list_transform(string_split('^' || host || '$' || path, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    sql = f"""
        WITH rules(verdict, of, start) AS (VALUES {rules}),
        labelled(id, url, label) AS (VALUES {labelled}),
        lr AS (SELECT id, label, {split} AS rest FROM labelled),
        lh AS (SELECT id, label, {host} AS host, {path} AS path FROM lr),
        lc AS (SELECT id, label, {codes} AS codes FROM lh),
        f AS MATERIALIZED (SELECT id, label, unnest({buckets}) AS bucket FROM lc),
        n AS (SELECT CAST(count(DISTINCT id) AS DOUBLE) AS n FROM f),
        w0 AS (SELECT DISTINCT bucket, CAST(0 AS BIGINT) AS w FROM f)"""
    for k in range(STEPS):
        sql += f""",
        m{k} AS (SELECT id, any_value(label) AS label, CAST(sum(w) AS BIGINT) AS m FROM f JOIN w{k} USING (bucket) GROUP BY id),
        g{k} AS (SELECT id, CAST(floor((label - 1 / (1 + exp(-CAST(m AS DOUBLE) / {UNIT}))) * {UNIT} + 0.5) AS BIGINT) AS g FROM m{k}),
        w{k + 1} AS MATERIALIZED (
            SELECT bucket, any_value(w) + CAST(floor(CAST(sum(g) AS DOUBLE) * {RATE} / any_value(n)) AS BIGINT) AS w
            FROM f JOIN g{k} USING (id) JOIN w{k} USING (bucket), n GROUP BY bucket)"""
    return sql + f""",
        pr AS (SELECT page_id, {split} AS rest FROM pages),
        ph AS (SELECT page_id, {host} AS host, {path} AS path FROM pr),
        best AS (
            SELECT page_id, arg_max(of || start, length(of || start)) AS rule, arg_max(verdict, length(of || start)) AS verdict
            FROM ph JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY page_id
        ),
        pc AS (SELECT page_id, {codes} AS codes FROM ph),
        pf AS (SELECT page_id, unnest({buckets}) AS bucket FROM pc),
        pm AS (SELECT page_id, CAST(coalesce(sum(w), 0) AS BIGINT) AS m FROM pf LEFT JOIN w{STEPS} USING (bucket) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN m > 0 THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN m END AS margin
        FROM ph LEFT JOIN best USING (page_id) JOIN pm USING (page_id)
    """
