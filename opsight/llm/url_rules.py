"""URL filters from association rules.

FP-growth mines token combinations of labelled URLs together with a marker for bad pages. Rules that conclude the marker
are pruned by support and confidence, and match through an inverted index: each rule is filed under its rarest token,
a URL looks its tokens up there, and the rest of the rule is checked on the spot. Explicit host and path rules come
first. Everything is DataFrame operations; distinct URLs are judged once.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end.
A null URL, or one without `://`, has neither and no tokens: the verdict is `allow`. Ties between explicit rules: the
longer host. Ties between mined rules: the larger support, then the name. Repeated rows are all answered. Without
labels nothing is mined. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import UPPER, ascii_lower, stored

BAD = "=bad"  # no token contains "="
MIN_SUPPORT = 0.0005
MIN_ROWS = 5
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    action: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (
    HostRule("block", "net/"), HostRule("allow", "example.net/en/"),
    HostRule("block", "example.com/de/"), HostRule("allow", "org/fr/"),
)


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def split_url(urls: DataFrame) -> DataFrame:
    """Column url with host, path, tokens."""
    rest = _after_scheme(F.coalesce("url", F.lit("")))
    words = F.split(ascii_lower(F.col("rest")), r"[^\p{L}\p{N}-]+")
    return (
        urls.withColumn("rest", rest)
        .withColumn("host", ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("tokens", F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(r"^[0-9-]+$")))))
        .drop("rest")
    )


def explicit(rules: tuple[HostRule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.rule), -len(r.host), r.rule))
    rule = action = None
    for r in ordered:
        host = (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        fits = host & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.rule)) if rule is None else rule.when(fits, F.lit(r.rule))
        action = F.when(fits, F.lit(r.action)) if action is None else action.when(fits, F.lit(r.action))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, action)


def mine(
    labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS,
    min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Rules (name, rule_tokens, anchor, confidence, support) from rows of tokens and bad."""
    rows = stored(labelled.select("tokens", "bad"), "url-tokens")
    n = rows.count()
    empty = "name string, rule_tokens array<string>, anchor string, confidence double, support long"
    if not n:
        return labelled.sparkSession.createDataFrame([], empty)
    items = rows.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    # half a row less, so that a rounding error cannot ask for one row more
    mined = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_rows - 0.5) / n), minConfidence=min_confidence).fit(items)
    rules = mined.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.size("antecedent") <= max_tokens)).select(
        F.array_sort("antecedent").alias("rule_tokens"), "confidence", F.round(F.col("support") * n).cast("long").alias("support")
    ).where(F.col("support") >= min_rows)
    rules = rules.withColumn("name", F.array_join("rule_tokens", "+"))
    often = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    anchors = (
        rules.select("name", F.explode("rule_tokens").alias("token")).join(often, "token")
        .groupBy("name").agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    )
    return stored(rules.join(anchors, "name").select("name", "rule_tokens", "anchor", "confidence", "support"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined: the best rule for every distinct URL that a rule fits."""
    looked = urls.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    fits = looked.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "name"))
    return fits.groupBy("url").agg(best["name"].alias("mined"))


def judge(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", *, rules: tuple[HostRule, ...] = RULES,
    label_id: str = "doc_id", **mining: float,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined for every row. A label belongs to the page of the same number."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    bad = labels.groupBy(F.col(label_id).alias("page_id")).agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")
    )
    mined = mine(split_url(rows.join(bad, "page_id")), **mining)
    found = matched(split_url(rows.where("url IS NOT NULL").select("url").distinct()), mined)
    rule, action = explicit(rules)
    every = split_url(rows.join(found, "url", "left"))
    return every.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(action, F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "mined",
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle(rules: tuple[HostRule, ...] = RULES) -> str:
    """The same in SQL: item sets of up to three tokens are counted by self joins."""
    fits, actions = [], []
    for r in sorted(rules, key=lambda r: (-len(r.rule), -len(r.host), r.rule)):
        test = f"(host = {_quoted(r.host)} OR host LIKE {_quoted('%.' + r.host)}) AND starts_with(path, {_quoted(r.path)})"
        fits.append(f"WHEN {test} THEN {_quoted(r.rule)}")
        actions.append(f"WHEN {test} THEN {_quoted(r.action)}")
    return f"""
    WITH p AS (
      SELECT page_id, row_number() OVER () AS row_no,
        CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), s AS (
      SELECT page_id, row_no, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        list_distinct(list_filter(regexp_split_to_array(translate(rest, '{UPPER}', '{UPPER.lower()}'), '[^\\p{{L}}\\p{{N}}-]+'),
          lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9-]+$'))) AS tokens FROM p
    ), bad AS (
      SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
    ), tx AS (SELECT s.row_no, s.tokens, bad.bad FROM s JOIN bad ON bad.doc_id = s.page_id),
    t AS (SELECT row_no, bad, unnest(tokens) AS token FROM tx),
    f AS (SELECT t.* FROM t JOIN (SELECT token FROM t GROUP BY token HAVING sum(bad) >= {MIN_ROWS}) USING (token)),
    sets AS (
      SELECT [a.token] AS items, a.bad FROM f a
      UNION ALL SELECT [a.token, b.token], a.bad FROM f a JOIN f b ON a.row_no = b.row_no AND a.token < b.token
      UNION ALL SELECT [a.token, b.token, c.token], a.bad FROM f a JOIN f b ON a.row_no = b.row_no AND a.token < b.token
        JOIN f c ON a.row_no = c.row_no AND b.token < c.token
    ), rules AS (
      SELECT items, array_to_string(items, '+') AS name, sum(bad) AS support, sum(bad) / count(*) AS confidence
      FROM sets GROUP BY items
      HAVING sum(bad) >= greatest({MIN_ROWS}, {MIN_SUPPORT} * (SELECT count(*) FROM tx)) AND sum(bad) / count(*) >= {MIN_CONFIDENCE}
    ), best AS (
      SELECT s.row_no, first(rules.name ORDER BY rules.confidence DESC, rules.support DESC, rules.name) AS mined
      FROM s JOIN rules ON list_has_all(s.tokens, rules.items) GROUP BY s.row_no
    ), j AS (SELECT s.page_id, s.host, s.path, best.mined FROM s LEFT JOIN best USING (row_no))
    SELECT page_id, host, path, CASE {" ".join(fits)} END AS rule,
      coalesce(CASE {" ".join(actions)} END, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined
    FROM j"""
