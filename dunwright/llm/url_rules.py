"""URL filters by hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into the expressions that some rule could equal: its host and the host's
suffixes after a dot, times the prefixes of its path, as far as a rule with such a length exists.  The
expressions meet the rules on the first four bytes of their SHA-256 digests, full digests confirm the
matches, and the longest rule decides (ties: the longer host, then block before allow).

Nulls: a null URL or one without ``://`` has an empty host and path, no rule and the default verdict.
Repeated rows stay; extra columns are kept (names used here: ``host path rule verdict``, which replace
columns of the input).  Any string length is allowed; the expressions of one URL number at most its host
labels times the distinct lengths of rule paths.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query

PREFIX_DIGITS = 8  # hex digits of the digest that the join uses
MAX_RULE_LENGTHS = 4096  # distinct lengths of rule hosts, and of rule paths, sent to tasks as literals
DEFAULT_VERDICT = "allow"


def host_and_path(url: str) -> dict[str, str]:
    """SQL for host and path of a URL column; both empty when null or without ``://``."""
    rest = f"substring({url}, locate('://', {url}) + 3)"
    has = f"coalesce(locate('://', {url}), 0) > 0"
    host = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return {"host": f"if({has}, translate({host}, '{upper}', '{lower}'), '')",
            "path": f"if({has}, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"}


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """Append host, path, rule (text of the deciding rule or null) and verdict to every row.

    ``rules`` has columns host, path, verdict.  Only their distinct lengths go through the driver.
    """
    hashed = rules.selectExpr("host rule_host", "path rule_path", "verdict rule_verdict",
                              "sha2(concat(host, '\\n', path), 256) rule_digest").dropDuplicates()
    lengths = {}
    for part in ("rule_host", "rule_path"):
        found = [r[0] for r in hashed.selectExpr(f"length({part}) n").distinct()
                 .limit(MAX_RULE_LENGTHS + 1).collect() if r[0] is not None]
        if len(found) > MAX_RULE_LENGTHS:
            raise ValueError(f"more than {MAX_RULE_LENGTHS} distinct lengths of {part}")
        lengths[part] = "array({})".format(", ".join(map(str, sorted(found)))) \
            if found else "cast(array() as array<int>)"
    parts = host_and_path("_url")
    expanded = (
        pages.select(F.col(url).alias("_url")).filter("_url is not null").distinct()
        .selectExpr("_url", f"{parts['host']} _host", f"{parts['path']} _path")
        .selectExpr("_url", "_path", f"""explode(transform(filter({lengths['rule_host']}, n ->
            n = length(_host) or (n < length(_host) and substring(_host, -n - 1, 1) = '.')),
            n -> if(n = 0, '', right(_host, n)))) _suffix""")
        .selectExpr("_url", "_suffix", f"""explode(transform(filter({lengths['rule_path']},
            n -> n <= length(_path)), n -> left(_path, n))) _start""")
        .selectExpr("_url", "sha2(concat(_suffix, '\\n', _start), 256) _digest"))
    # the joined side is one row per distinct URL and expression; Spark broadcasts the rules by size
    matches = expanded.join(
        hashed, F.expr(f"left(_digest, {PREFIX_DIGITS}) = left(rule_digest, {PREFIX_DIGITS})")
    ).filter("_digest = rule_digest")
    best = matches.groupBy("_url").agg(F.expr("""max(struct(
        length(rule_host) + length(rule_path) n, length(rule_host) h, rule_verdict = 'block' b,
        concat(rule_host, rule_path) rule, rule_verdict verdict)) _best"""))
    kept = ", ".join(f"`{c}`" for c in pages.columns if c not in ("host", "path", "rule", "verdict"))
    shown = host_and_path("own_url")
    # the rows travel as one struct, so their names clash with nothing; null URLs are spread over keys of their own
    own = pages.selectExpr(f"struct({kept}) page", f"`{url}` own_url",
                           f"coalesce(`{url}`, concat('\n', monotonically_increasing_id() % 10007)) _key")
    return own.join(best, F.expr("_key = _url"), "left").selectExpr(
        "page.*", f"{shown['host']} host", f"{shown['path']} path",
        "_best.rule rule", f"coalesce(_best.verdict, '{default}') verdict")


def production_rules(spark: SparkSession) -> DataFrame:
    """The four stated rules."""
    return spark.sql("""select * from values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
        ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') rules(host, path, verdict)""")


@query("op5_url_filters", sql=r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT s.page_id, s.url, s.host, s.path, r.rh || r.rp AS rule, r.v,
    row_number() OVER (PARTITION BY s.page_id, s.url ORDER BY length(r.rh || r.rp) DESC NULLS LAST) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.rh OR ends_with(s.host, '.' || r.rh))
    AND starts_with(s.path, r.rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE k = 1""")
def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, production_rules(spark)).select("page_id", "host", "path", "rule", "verdict")
