"""URL filter: fixed host and path rules first, then association rules mined from labelled URLs by FP-growth.

URLs become sets of tokens (host labels, words of the path, names of query parameters; numbers are left out). FP-growth finds
token sets that are frequent together with the mark of a bad label; rules below a support or confidence are pruned. An
inverted index holds every rule under its rarest-looking (longest) token, so that a URL is compared only with the rules that
share that token; all tokens of the rule must occur.

Only DataFrame functions and Spark's FP-growth are used. Labelled URLs are counted over the whole table. The rule table is
bounded by the number of token sets above the support and is broadcast only after a count of its rows.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; equal confidences
are ordered by support and then by the token list; repeated rows are judged alike and all kept; without labels or frequent
sets there are no mined rules; other columns are dropped by `judge` and may have any name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Item that marks a labelled URL as bad; no URL token has this form.
BAD = "!bad"
#: Largest rule table that is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Mining:
    """Support as a share of the labelled URLs and as a least count, confidence, and tokens of a rule at most."""

    support: float = 0.002
    least: int = 5
    confidence: float = 0.5
    tokens: int = 3


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _named(words: Column, kind: str) -> Column:
    wanted = F.filter(words, lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    return F.transform(wanted, lambda x: F.concat(F.lit(kind), x))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens: h:label, p:word, q:name; without numbers and empty words."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    words = [
        (F.split(host_of(url), r"\."), "h:"),
        (F.split(F.translate(path_of(url), UPPER, LOWER), r"[^a-z0-9]+"), "p:"),
        (F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^[^=]*", 0)), "q:"),
    ]
    named = [_named(w, kind) for w, kind in words]
    return F.sort_array(F.array_distinct(F.concat(*named)))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, `domain/path`) whose domain is the host or above it and whose path starts the path.

    The rule list is an argument, so it becomes one expression, longest rule first."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the pages whose document number (the first number that is a whole path segment) has a label.

    A document is bad if any of its labels has quality 0 or toxic 1; null counts as neither."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.max(bad).alias("bad"))
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    urls = pages.select(number.try_cast("long").alias("doc"), tokens_of(F.col("url")).alias("tokens")).where("doc is not null")
    return urls.join(marked, "doc").select("tokens", "bad")


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Rules (tokens, support count, confidence) from token sets to the bad mark."""
    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items"))
    n = items.count()
    share = min(1.0, max(how.support, how.least / n)) if n else 1.0
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=how.confidence).fit(items)
    rules = model.associationRules.where(
        (F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.size("antecedent") <= how.tokens))
    return rules.select(
        F.sort_array("antecedent").alias("rule_tokens"), F.round(F.col("support") * n).cast("long").alias("rule_support"),
        F.col("confidence").alias("rule_confidence"))


def index_of(rules: DataFrame) -> DataFrame:
    """The rules under their longest token (the first in order among equals)."""
    longest = F.array_min(F.transform("rule_tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return rules.withColumn("anchor", longest["t"])


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """Every row's page_id, host, path, fixed rule, verdict and the best mined rule with its confidence and support."""
    url = F.col("url")
    parsed = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    index = cut_lineage(index_of(mined))
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    tokens = F.col("tokens")
    found = pages.select("page_id", "url", tokens_of(url).alias("tokens")).where("url is not null")
    found = found.select("page_id", "url", "tokens", F.explode(tokens).alias("anchor")).join(index, "anchor").where(
        F.forall("rule_tokens", lambda t: F.array_contains(tokens, t)))
    order = F.struct("rule_confidence", "rule_support", F.array_join("rule_tokens", " ").alias("mined_rule"))
    best = found.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u")).agg(F.max(order).alias("best"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.join(best, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("url") == F.col("u")), "left")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("best.mined_rule").alias("mined_rule"), F.col("best.rule_confidence").alias("confidence"),
        F.col("best.rule_support").alias("support"))
