"""Queries: the mix of sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm.encode import encode_texts
from murmurlake.llm.mixing import MAX_LEAVES, leaf_budgets, mix
from murmurlake.session import materialise
from murmurlake.sources.tables import table

SEED = 20240607
LEAF = ["source", "lang"]
#: Domains of languages; any other language is of domain 'other'.
DOMAINS = {
    "code": ("c", "css", "go", "java", "javascript", "python", "rust", "shell", "sql"),
    "text": ("html", "markdown", "text"),
    "data": ("csv", "json", "toml", "yaml"),
}
#: Domains of a source and languages of a domain are weighted by what they hold to this power, so small ones
#: get more than their part of the tokens; 1 would be proportional, 0 equal.
TEMPERATURE = 0.5


def _targets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "mix_targets").dropDuplicates(["source"]).filter(F.col("source").isNotNull())


def sized(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of every document of a targeted source, counted once and kept in the shared folder."""
    docs = table(spark, root, "documents").join(_targets(spark, root).select("source"), "source", "left_semi")
    docs = docs.select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return materialise(encode_texts(docs, "text", ["doc_id", "source", "lang"], out="tokens", counts_only=True))


def plan_budgets(spark: SparkSession, root: str, sizes: DataFrame) -> list[tuple]:
    """(source, lang, tokens held, budget, whole epochs, tokens of the partial epoch) of every leaf.

    The tree is source, then domain, then language. A source has its target share; its domains and their
    languages are weighted by ``TEMPERATURE``. A small language is repeated until its repeats are used up;
    what it cannot take goes to the other languages of its domain, only then to the source's other domains,
    and only what a whole source cannot take to other sources. Runs jobs; its result is one row a leaf.
    """
    targets = _targets(spark, root).limit(MAX_LEAVES + 1).collect()
    held = sizes.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if max(len(held), len(targets)) > MAX_LEAVES:
        raise ValueError(f"the budget tree has more than {MAX_LEAVES} leaves")
    wanted = {t["source"]: t for t in targets}
    total = sum(r["tokens"] for r in held)
    rows = sorted(held, key=lambda r: (r["source"], r["lang"]))
    repeats = {s: max(0, t["max_repeats"] if t["max_repeats"] is not None else 1) for s, t in wanted.items()}
    domain_of = {lang: d for d, langs in DOMAINS.items() for lang in langs}
    domains = {r["lang"]: domain_of.get(r["lang"], "other") for r in rows}
    in_domain: dict[tuple[str, str], int] = {}
    for r in rows:
        key = (r["source"], domains[r["lang"]])
        in_domain[key] = in_domain.get(key, 0) + r["tokens"]
    leaves = []
    for r in rows:
        source, lang = r["source"], r["lang"]
        weights = (wanted[source]["target_share"] or 0.0, in_domain[(source, domains[lang])] ** TEMPERATURE, r["tokens"] ** TEMPERATURE)
        leaves.append(((source, domains[lang], lang), weights, float(r["tokens"] * repeats[source])))
    budgets = {(path[0], path[2]): b for path, b in leaf_budgets(leaves, float(total)).items()}
    out = []
    for r in rows:
        b = budgets[(r["source"], r["lang"])]
        full = min(repeats[r["source"]], math.floor(b / r["tokens"] + 1e-9)) if r["tokens"] else 0
        rest = max(0.0, b - full * r["tokens"]) if full < repeats[r["source"]] else 0.0
        out.append((r["source"], r["lang"], int(r["tokens"]), float(b), int(full), float(rest)))
    return out


BUDGETS = "source string, lang string, held bigint, budget double, full int, rest double"


def _mixed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sizes = sized(spark, root)
    budgets = spark.createDataFrame(plan_budgets(spark, root, sizes), BUDGETS)
    return mix(sizes, LEAF, "doc_id", "tokens", budgets.select(*LEAF, "full", "rest"), SEED), budgets


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    """Every document taken, once for each epoch that takes it."""
    return _mixed(spark, root)[0].select("doc_id", "source", "lang", "tokens", "epoch")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Per targeted source what it holds, should supply, was given after shortages, and really supplies."""
    taken, budgets = _mixed(spark, root)
    got = taken.groupBy("source").agg(F.sum("tokens").alias("taken_tokens"), F.max("epoch").alias("most_repeats"), F.count_distinct("doc_id").alias("documents"))
    plan = budgets.groupBy("source").agg(F.sum("held").alias("held_tokens"), F.sum("budget").alias("budget_tokens"))
    rows = _targets(spark, root).join(plan, "source", "left").join(got, "source", "left")
    zero = {c: 0 for c in ("held_tokens", "budget_tokens", "taken_tokens", "most_repeats", "documents")}
    rows = rows.fillna(zero)
    held, taken_all = rows.agg(F.sum("held_tokens")).scalar(), rows.agg(F.sum("taken_tokens")).scalar()
    return rows.select(
        "source",
        "target_share",
        "max_repeats",
        "held_tokens",
        (F.col("target_share") * held).alias("target_tokens"),
        "budget_tokens",
        "taken_tokens",
        F.try_divide(F.col("taken_tokens"), taken_all).alias("actual_share"),
        "documents",
        "most_repeats",
    )


def p7_leaves(spark: SparkSession, root: str) -> DataFrame:
    """Per source and language what it holds, its budget and what the mix takes of it."""
    taken, budgets = _mixed(spark, root)
    got = taken.groupBy(*LEAF).agg(F.sum("tokens").alias("taken_tokens"))
    return budgets.select(*LEAF, "held", "budget").join(got, LEAF, "left").fillna(0, ["taken_tokens"])


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_leaves": p7_leaves}
ORACLES: dict = {}
