"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget flows down the tree: children share their
parent's budget by weight, no child gets more than its subtree can give (its tokens times
``max_epochs``), and what one child cannot take goes to its siblings. A parent asks for no more
than its subtree can give, so a shortage reaches the parent's own siblings only when all
children are full. Each leaf then repeats its documents for the whole epochs in its budget and takes,
of one more epoch in seeded order, the longest prefix of documents that fits in the rest.

Scale: documents are reduced to token counts; leaves to sums. The prefix of a leaf is found in two
steps: sums of ``16**digits`` ranges of the seeded order, then the documents of the one range in which the
budget ends, so no task sees a whole leaf. ``digits`` follows the largest leaf's count. The seeded order
hashes id and text together, so different texts that share an id, or have none, spread over all ranges.

Defined cases: null domain, language or source is ``(none)``; null and empty texts have no tokens
and are taken whenever the epoch's prefix reaches them; rows alike in id and text have one order key and
count each; a weight that is absent takes the default. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwise.llm.common import packed, stored

NONE = "(none)"


@dataclass(frozen=True)
class Plan:
    """Target weights of each level, the budget as a share of all tokens, and the epochs' seed."""

    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "books": 0.25, "news": 0.25})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    default: float = 0.125
    share: float = 0.75
    max_epochs: int = 2
    seed: str = "mix-1"


PLAN = Plan()


def domain_of(source):
    """The production rule for domains: by the last digit of the source's name."""
    digit = F.right(source, F.lit(1))
    return F.when(digit.isin("0", "1", "2", "3"), "web").when(digit.isin("4", "5", "6"), "books").otherwise("news")


def word_tokens(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _weight(level, table: dict[str, float], default: float):
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(level == name, F.lit(value)).otherwise(out)
    return out.cast("double")


def water_fill(children: DataFrame, parent: list[str], child: str, budget) -> DataFrame:
    """Adds ``granted``: each child's part of its parent's ``budget``, by ``weight``, at most ``cap``."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), child) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), child)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (budget - before) / rest
    marked = children.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    line = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return marked.withColumn("granted", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(line, F.lit(0.0)) * F.col("weight"))).drop("level", "full")


def budgets(leaves: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """Leaf budgets from leaf sums (domain, lang, source, docs, tokens)."""
    caps = leaves.withColumn("cap", F.col("tokens").cast("double") * plan.max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * plan.share).cast("double").alias("budget"))
    domains = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("domain"), plan.domains, plan.default))
    domains = water_fill(domains.crossJoin(F.broadcast(total)), [], "domain", F.col("budget")).select("domain", F.col("granted").alias("budget"))
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("lang"), plan.languages, plan.default))
    langs = water_fill(langs.join(domains, "domain"), ["domain"], "lang", F.col("budget")).select("domain", "lang", F.col("granted").alias("budget"))
    sources = caps.withColumn("weight", _weight(F.col("source"), plan.sources, plan.default)).join(langs, ["domain", "lang"])
    filled = water_fill(sources, ["domain", "lang"], "source", F.col("budget"))
    return filled.select("domain", "lang", "source", "docs", "tokens", F.floor(F.col("granted") + F.lit(1e-6)).cast("long").alias("leaf_budget"))


def mix(docs: DataFrame, plan: Plan = PLAN, digits: int | None = None, docs_per_range: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """The documents taken: doc_id, domain, lang, source, n_tokens, leaf_budget, copies; and the columns ``carry``, which settle ties."""
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(domain_of(F.col("source")), F.lit(NONE)).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
            F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
            word_tokens(F.col("text")).alias("n_tokens"),
            F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5"),
            *carry,
        )
    )
    leaf = ["domain", "lang", "source"]
    plans = stored(budgets(rows.groupBy(*leaf).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), plan))
    if digits is None:
        largest = plans.agg(F.max("docs")).first()[0] or 0
        digits = 1
        while largest > docs_per_range * 16**digits:
            digits += 1
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("leaf_budget") / F.col("tokens"))).otherwise(0).cast("long")
    plans = plans.select(*leaf, "leaf_budget", whole.alias("epochs"), (F.col("leaf_budget") - whole * F.col("tokens")).alias("rest"))
    key = F.md5(F.concat_ws(":", F.lit(plan.seed), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_md5")))
    ordered = rows.join(plans, leaf).withColumn("key", key).withColumn("range", F.left("key", F.lit(digits)))
    sums = ordered.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*leaf).orderBy("range"))
    sums = stored(sums.withColumn("before", upto - F.col("held")))
    placed = ordered.join(sums, [*leaf, "range"])
    fits, beyond = F.col("before") + F.col("held") <= F.col("rest"), F.col("before") > F.col("rest")
    within = F.sum("n_tokens").over(Window.partitionBy(*leaf, "range").orderBy("key", "doc_id", "n_tokens", *carry).rowsBetween(Window.unboundedPreceding, 0))
    columns = ["doc_id", *leaf, "n_tokens", "leaf_budget", *carry]
    sure = placed.where(fits | beyond).select(*columns, (F.col("epochs") + fits.cast("long")).alias("copies"))
    edge = placed.where(~(fits | beyond)).withColumn("last", F.col("before") + within).select(*columns, (F.col("epochs") + (F.col("last") <= F.col("rest")).cast("long")).alias("copies"))
    return sure.unionByName(edge).where("copies > 0")


def mixed_documents(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, each as often as it is taken.

    A row is known by its doc_id, language, source and text, so rows that share an id, or have none,
    keep their own copies; of rows alike in all four, each gets one of the counts.
    """
    content = F.struct("doc_id", "lang", "source", F.sha2(F.col("text").cast("string"), 256).alias("text"))
    key = F.unhex(F.sha2(F.to_json(content), 256))
    taken = mix(docs.select("doc_id", "lang", "source", "text", key.alias("__key")), plan, carry=("__key",))
    taken = taken.groupBy(F.col("__key").alias("key")).agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    numbered = packed(docs, key=key).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    joined = numbered.join(taken, "key").where(F.col("n") <= F.size("copies"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.element_at("copies", F.col("n"))))).select("row.*")
