"""URL filters: given host and path rules first, association rules mined by Spark's FP-growth for the rest.

Only DataFrame functions and the FP-growth of ``pyspark.ml`` (JVM) are used.

A url that a given rule covers gets that rule's verdict and is also a labelled
example. Each url is a transaction of at most ``len(SLOTS)`` typed tokens, one a
slot, so a long url cannot blow up the number of itemsets. FP-growth mines the
combinations of tokens and label; rules ``tokens -> label`` with enough support
and confidence are kept, without those that a more general rule of the same
label and no less confidence makes redundant. An inverted index (rarest token of
each rule -> rule) finds the rules of a url, and the most confident decides.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and the default verdict unless a mined rule fits. Repeated rows each get
their row; ties of rules go to the greater support, then the shorter, then the verdict and
tokens that are greater; long urls are read whole; extra columns are dropped; an empty table gives an empty result, as
does mining without labelled rows (default verdict everywhere).
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_SUPPORT, MIN_CONFIDENCE, DEFAULT = 0.002, 0.9, "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def given(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict, own) of the longest rule that fits, own being the tokens it is made of; null without one."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ranked]
    made = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.array(*[F.lit(t) for t in own_tokens(h, p)]).alias("own")) for v, h, p in ranked]
    return F.coalesce(*[F.when(f, m) for f, m in zip(fits, made, strict=True)]) if ranked else F.lit(None).cast("struct<rule:string,verdict:string,own:array<string>>")


def own_tokens(host: str, path: str) -> list[str]:
    """Tokens that every url of a rule has by the rule."""
    labels, folders = host.split("."), path.split("/")
    found = [f"tld={labels[-1]}", f"domain={'.'.join(labels[-2:])}" if len(labels) > 1 else "", f"name={labels[-3]}" if len(labels) > 2 else "", f"first={folders[1]}" if len(folders) > 2 else ""]
    return [t for t in found if t]


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The url's typed tokens, one a slot at most: array<string>."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    slots = {
        "scheme": F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1),
        "tld": F.regexp_extract(host, r"([^.]+)$", 1),
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "name": F.regexp_extract(host, r"([^.]+)\.[^.]+\.[^.]+$", 1),
        "front": F.regexp_extract(host, r"^([^.]+)\.[^.]+\.[^.]+\.", 1),
        "hyphen": F.when(F.regexp_extract(host, r"^[^.]*-", 0) != "", "yes").otherwise(""),
        "first": F.regexp_extract(path, r"^/([^/]+)/", 1),
        "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1),
        "slash": F.when(path.endswith("/"), "yes").otherwise(""),
        "key": F.regexp_extract(query, "^([^=&]*)", 1),
        "fragment": F.regexp_extract(u, "#(.*)$", 1),
        "depth": F.least(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), F.lit(6)).cast("string"),
    }
    made = F.array(*[F.when(value != "", F.concat(F.lit(f"{name}="), value)) for name, value in slots.items()])
    return F.array_compact(made)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from rows (toks array<string>, label string): antecedent, verdict, confidence, support, n.

    No rules from an empty table.
    """
    items = labelled.select(F.array_append("toks", F.concat(F.lit("label="), "label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = (
        model.associationRules.where(F.col("consequent")[0].startswith("label="))
        .where(~F.exists("antecedent", lambda x: x.startswith("label=")))
        .select(F.sort_array("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 7, 1000).alias("verdict"), "confidence", "support", F.size("antecedent").alias("n"))
    )
    return rules


def prune(rules: DataFrame) -> DataFrame:
    """Drops a rule if a subset of its antecedent gives the same verdict with no less confidence.

    A rule's subsets share a token with it, so candidates come from an inverted index and no cross join.
    """
    general = rules.select(F.explode("antecedent").alias("token"), F.col("antecedent").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("n").alias("m")).where(F.col("token") == F.col("less")[0])
    worse = (
        rules.withColumn("token", F.explode("antecedent"))
        .join(general, "token")
        .where("m < n and v = verdict and c >= confidence and size(array_except(less, antecedent)) = 0")
        .select("antecedent", "verdict")
        .distinct()
    )
    return rules.join(worse, ["antecedent", "verdict"], "left_anti")


def indexed(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """One map of the rules mined from rows (toks, label): each stands under the token of it that the fewest urls have."""
    found = table(prune(mine(labelled, min_support, min_confidence)), "rules")
    often = labelled.select(F.explode("toks").alias("token")).groupBy("token").count()
    ranked = found.withColumn("token", F.explode("antecedent")).join(often, "token")
    rule = F.struct("confidence", "support", F.negate("n").alias("n"), "verdict", "antecedent")
    least = ranked.groupBy(*found.columns).agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    listed = least.groupBy("token").agg(F.collect_list(rule).alias("rules"))
    return listed.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index")).scalar()


def best(seen: DataFrame, index: Column) -> DataFrame:
    """seen (toks, ...) with best: the mined rule that decides, or null."""
    none = F.array().cast("array<struct<confidence:double,support:double,n:int,verdict:string,antecedent:array<string>>>")
    near = F.flatten(F.transform("toks", lambda t: F.coalesce(F.try_element_at("index", t), none)))
    fits = F.filter(near, lambda r: F.size(F.array_except(r["antecedent"], F.col("toks"))) == 0)
    return seen.withColumn("index", index).withColumn("best", F.array_max(fits))


def tokenised(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, url, host, path, hit (the given rule that fits), toks."""
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return seen.withColumn("hit", given(F.col("host"), F.col("path"), rules)).withColumn("toks", tokens(F.col("url"), F.col("host"), F.col("path")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule), reason (its tokens) per page row."""
    seen = tokenised(pages, rules)
    labelled = seen.where("hit is not null").select(F.array_except("toks", "hit.own").alias("toks"), F.col("hit.verdict").alias("label"))
    out = best(seen, indexed(labelled, min_support, min_confidence)).withColumn("best", F.when(F.col("hit").isNull(), F.col("best")))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", "best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.confidence").alias("confidence"),
        F.array_join("best.antecedent", " ").alias("reason"),
    )


def held_out(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, folds: int = 4, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row: how mined rules judge hosts that they have not seen.

    Hosts are dealt to folds by hash. Urls that a given rule covers are judged, without the tokens that the rule is made of, by what
    is mined from the other folds. asked: such urls; told: those that a mined rule fits; right: those with the given rule's verdict.
    """
    known = tokenised(pages, rules).where("hit is not null")
    known = table(known.select(F.array_except("toks", "hit.own").alias("toks"), F.col("hit.verdict").alias("label"), F.pmod(F.xxhash64("host"), F.lit(folds)).alias("fold")), "known")
    asked = [best(known.where(F.col("fold") == k), indexed(known.where(F.col("fold") != k).select("toks", "label"), min_support, min_confidence)).select("label", "best") for k in range(folds)]
    out = reduce(DataFrame.unionByName, asked)
    return out.agg(F.count("*").alias("asked"), F.count_if(F.col("best").isNotNull()).alias("told"), F.count_if(F.col("best.verdict") == F.col("label")).alias("right"))


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the given rules, then by mined ones."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
