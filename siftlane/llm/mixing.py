"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of domains, languages and sources has weights at each level. The budget of tokens goes down the
tree: the children of a node share its budget by weight, none takes more than its own leaves can give
(their tokens times the most epochs), and what one can't take goes to its siblings by weight. As a
node's budget is set before its children share it, a shortage leaves a node only when all below it is
full: siblings come before ancestors.

Each leaf then reads whole epochs, each in its own seeded order, and of the last one the prefix that
fits. The order is that of a seeded hash; tokens are summed by ranges of the hash first, so that only
the range that holds the end of the prefix is put in order document by document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlane.llm.common import stage

#: Weights are whole numbers in this unit, so that shares are exact.
UNIT = 1_000_000
#: Hexadecimal digits of the hash that name its range: 4096 ranges of a leaf.
DIGITS = 3
LEVELS = ("domain", "lang", "source")
#: Production weights; children without one have OTHER.
DOMAIN_WEIGHTS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANG_WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
OTHER = 0.1


def domain_of(source: Column) -> Column:
    """Four domains, by the number at the end of the source's name; d0 where there is none."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,6})$", 1), F.lit("999999")), F.lit(0)).cast("int") % 4).cast("string"))


def weight_of(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(round(OTHER * UNIT))
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, round(w * UNIT)).otherwise(out)
    return out.cast("decimal(18,0)")


def _shared(nodes: DataFrame, parents: list[str], name: str, total: Column) -> DataFrame:
    """nodes with `given`: each child's share of its parent's total, none above its capacity.

    Children in order of capacity over weight fill up one after another while their share of what is
    left reaches their capacity; from the first that doesn't fill, the rest divide what is left by weight.
    """
    ratio = (F.col("capacity").cast("double") / F.col("weight").cast("double")).alias("x")
    ahead = Window.partitionBy(*parents).orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    amount = "decimal(20,0)"
    n = nodes.withColumn("total", total.cast(amount))
    n = n.withColumn("rest", (F.col("total") - F.coalesce(F.sum("capacity").over(ahead), F.lit(0))).cast(amount))
    n = n.withColumn("mass", (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))).cast("decimal(18,0)"))
    n = n.withColumn("full", F.col("capacity") * F.col("mass") <= F.col("weight") * F.greatest("rest", F.lit(0).cast(amount)))
    # Rest and mass at the first child that doesn't fill hold for all from there on.
    n = n.withColumn("open", F.min(F.when(~F.col("full"), F.struct(ratio, F.col(name).alias("y"), "rest", "mass"))).over(whole))
    share = F.expr("cast((weight * open.rest) div open.mass as decimal(20,0))")
    return n.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(F.least("capacity", share)).cast(amount)).drop("total", "rest", "mass", "full", "open")


def budgets(leaves: DataFrame, budget: int, epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """domain, lang, source, tokens and given (tokens to read) for leaves (domain, lang, source, tokens)."""
    leaf = leaves.where("tokens > 0").select(*LEVELS, "tokens", (F.col("tokens") * epochs).cast("decimal(20,0)").alias("capacity"), weight_of("source", weights).alias("weight"))
    lang = leaf.groupBy("domain", "lang").agg(F.sum("capacity").cast("decimal(20,0)").alias("capacity")).withColumn("weight", weight_of("lang", weights))
    top = lang.groupBy("domain").agg(F.sum("capacity").cast("decimal(20,0)").alias("capacity")).withColumn("weight", weight_of("domain", weights)).withColumn("root", F.lit(0))
    top = _shared(top, ["root"], "domain", F.lit(budget)).select("domain", F.col("given").alias("above"))
    lang = _shared(lang.join(top, "domain"), ["domain"], "lang", F.col("above")).select("domain", "lang", F.col("given").alias("above"))
    out = _shared(leaf.join(lang, ["domain", "lang"]), ["domain", "lang"], "source", F.col("above"))
    return out.select(*LEVELS, F.col("tokens").cast("long").alias("tokens"), F.col("given").cast("long").alias("given"))


def tokens_of(text: Column) -> Column:
    """Words parted by blanks, without splitting: a word begins at each non-blank that follows a blank or nothing."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def mix(df: DataFrame, share: float = 0.6, epochs: int = 2, seed: int = 17, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """A row for each reading of a row: id, domain, lang, source, n_tokens, epoch (from 0) and given (the leaf's budget).

    share: the budget as a part of all tokens. A null language or source is the leaf '' of its level; a
    null or blank text has no tokens and is never read; a null key counts as empty text in the hash.
    Rows that share a key are read in the order of their texts' crc32. A leaf's reading never exceeds
    its budget; it stops before the first row that would. An empty table, or one without words, gives
    an empty result.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("id"), col(key).alias("name"), domain_of(col(source)).alias("domain"), col(lang).alias("lang"), col(source).alias("source"), tokens_of(F.col(f"`{text}`").cast("string")).alias("n_tokens"), F.crc32(col(text)).alias("crc"))
    rows = stage(rows.where("n_tokens > 0"), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    given = stage(budgets(leaves, int(total * share), epochs, weights), "mix-budgets")
    # What each leaf reads in each epoch: all of it, or in its last one the rest.
    leaf = [*LEVELS, "epoch"]
    plan = given.select(*LEVELS, "tokens", "given", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    plan = plan.withColumn("part", F.col("given") - F.col("epoch") * F.col("tokens")).where("part > 0")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("name")).cast("binary"))
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("place", place).withColumn("range", F.substring("place", 1, DIGITS))
    # Sums by ranges come before any join, so that a leaf with most of the rows is never one task's.
    cells = each.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("n")).join(plan.where("part < tokens"), leaf)
    cells = cells.select(*leaf, "range", "n", "part", "given", F.sum("n").over(Window.partitionBy(*leaf).orderBy("range")).alias("upto"))
    # The range that holds the end of a leaf's prefix, and what it may still take.
    ends = stage(cells.where("upto > part").groupBy(*leaf).agg(F.min("range").alias("range"), F.min_by(F.col("part") - F.col("upto") + F.col("n"), "range").alias("room"), F.first("given").alias("given")), "mix-ends")
    cut = plan.select(*leaf, "given").join(ends.select(*leaf, F.col("range").alias("cut")), leaf, "left")
    chosen = ["id", *LEVELS, "n_tokens", "epoch", "given"]
    whole = each.join(cut, leaf).where("cut is null or range < cut").select(*chosen)
    run = F.sum("n_tokens").over(Window.partitionBy(*leaf, "range").orderBy("place", "name", "crc", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    partly = each.join(ends, [*leaf, "range"]).withColumn("upto", run).where("upto <= room").select(*chosen)
    return whole.unionByName(partly)
