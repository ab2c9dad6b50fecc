"""URL filters: a fixed rule list first, association rules mined from labelled URLs for the rest.

A URL is a basket of tokens (host labels, path segments, names of query parameters). Spark's FP-growth
mines token sets that come with a label; rules below the asked confidence or support are pruned, and so are rules that
a shorter one with the same verdict and no less confidence covers. Each rule stands in an inverted index under its
rarest token; a page looks up its tokens and keeps the rules whose other tokens it has too. The most confident rule
decides, then the better supported, then the longer, then block before allow.

What teaches are the rule list's own verdicts and the labels table.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule and the default verdict (allow)
unless a mined rule says otherwise; repeated rows are judged each; an empty table gives an empty result; if no URL is
labelled nothing is mined; other columns of the input are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import cut

# The contract's rule list (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8
MIN_PAGES = 50  # so many labelled pages are enough for a rule, however small their share
MAX_BROADCAST_RULES = 20_000
_LABEL = "label="


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, path segments (digits as one 0), names of query parameters."""
    url = F.coalesce(url, F.lit(""))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    query = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"([^&=]+)(?:=[^&]*)?"), 1)
    return F.array_distinct(
        F.concat(
            F.transform(F.filter(F.split(host_of(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
            F.transform(parts, lambda p: F.concat(F.lit("path:"), F.regexp_replace(p, r"[0-9]+", "0"))),
            F.transform(query, lambda q: F.concat(F.lit("param:"), q)),
        )
    )


def mine_rules(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, verdict, confidence, support): rules that FP-growth finds in labelled URLs, pruned.

    A token set counts as frequent with a share of ``min_support`` or on ``MIN_PAGES`` labelled pages, whichever is less,
    so what one host needs does not grow with the table.
    """
    label = F.concat(F.lit(_LABEL), F.col(label_col))
    baskets = labelled.filter(F.col(label_col).isNotNull()).select(F.concat(url_tokens(F.col(url_col)), F.array(label)).alias("items"))
    # a little less, so that the share's rounding up to a count of pages does not ask for one page more
    least = min(min_support, (MIN_PAGES - 0.5) / max(baskets.count(), 1))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(_LABEL) + 1})").alias("verdict"), "confidence", "support"
    )
    rules = cut(rules)
    # A rule is redundant if dropping one of its tokens leaves a rule with the same verdict and no less confidence.
    longer = rules.filter(F.size("tokens") > 1).withColumn("token", F.explode("tokens"))
    shorter = rules.select(F.col("tokens").alias("fewer"), F.col("verdict").alias("same"), F.col("confidence").alias("least"))
    covered = longer.join(shorter, (F.array_remove("tokens", F.col("token")) == F.col("fewer")) & (F.col("verdict") == F.col("same")) & (F.col("least") >= F.col("confidence")))
    return rules.join(covered.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")


def inverted_index(rules: DataFrame) -> DataFrame:
    """Each rule under the token that fewest rules share, so that a lookup touches few rules."""
    spread = rules.withColumn("token", F.explode("tokens"))
    common = spread.groupBy("token").agg(F.count("*").alias("n"))
    rarest = spread.join(common, "token").groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("under"))
    return rarest.select(F.col("under.token").alias("token"), F.col("tokens").alias("needs"), "verdict", "confidence", "support")


def match_rules(pages: DataFrame, rules: DataFrame, row_col: str = "row", url_col: str = "url") -> DataFrame:
    """(row, method_verdict, confidence, rule_tokens) for the rows that some mined rule fits."""
    index = cut(inverted_index(rules))
    if index.count() <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    looked = pages.select(F.col(row_col).alias("row"), url_tokens(F.col(url_col)).alias("has")).withColumn("token", F.explode("has"))
    hits = looked.join(index, "token").filter(F.size(F.array_except("needs", "has")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("needs").alias("n"), "verdict", "needs")).alias("best")
    return hits.groupBy("row").agg(best).select("row", F.col("best.verdict").alias("method_verdict"), F.col("best.confidence").alias("confidence"), F.col("best.needs").alias("rule_tokens"))


def label_pages(pages: DataFrame, labels: DataFrame, label_id_col: str = "doc_id") -> DataFrame:
    """(url, label) of the pages that teach: what the rule list says of a page (``list_verdict``), else what ``labels`` says of
    the page of that id: to block if any of its rows is toxic or of no quality, else to allow. ``pages``: ``id``, ``url``, ``list_verdict``.
    """
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    told = labels.groupBy(F.col(label_id_col).alias("id")).agg(F.max(bad).alias("bad"))
    told = told.select("id", F.when(F.col("bad"), "block").otherwise("allow").alias("told"))
    return pages.join(told, "id", "left").select("url", F.coalesce("list_verdict", "told").alias("label")).filter(F.col("label").isNotNull())


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule``, ``verdict``, and of the mined rule that decided, if one did,
    ``confidence`` and ``rule_tokens`` (comma-joined).

    The rule list's verdicts and ``labels`` (an id, ``quality``, ``toxic``) teach the mined rules, see :func:`label_pages`: a
    host whose pages the list mostly blocks is thus blocked beyond the list too. Pages without a label teach nothing.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = list_rule(F.col("host"), F.col("path"), rules)
    seen = cut(seen.withColumns({"row": F.monotonically_increasing_id(), "rule": rule, "list_verdict": verdict}))
    labelled = cut(label_pages(seen, labels, label_id_col))
    open_pages = seen.filter(F.col("rule").isNull())
    if labelled.isEmpty():
        found = open_pages.select("row", *[F.lit(None).cast(kind).alias(c) for c, kind in (("method_verdict", "string"), ("confidence", "double"), ("rule_tokens", "array<string>"))])
    else:
        found = match_rules(open_pages, mine_rules(labelled))
    return seen.join(found, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("list_verdict", "method_verdict", F.lit("allow")).alias("verdict"), "confidence", F.array_join("rule_tokens", ",").alias("rule_tokens")
    )
