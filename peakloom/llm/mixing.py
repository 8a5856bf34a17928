"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power alpha, normalised; alpha is found by bisection so that the
weights have a target entropy, or so that no source is repeated more than a limit times as often as the least
repeated one. The weights are realised as passes over each source: whole passes, and a last one over randomly
permuted blocks up to the source's token budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.session import materialize

#: Blocks of a source, and parts of the one block in which its budget ends: only one part's rows, some millionth of the
#: source, are put in order.
BLOCKS, PARTS = 1024, 1024
#: Bisection goes on until alpha is known to 2**-STEPS.
STEPS = 20
#: Sections that one job tries at once: four halvings.
SECTIONS = 16


def token_counts(text: Column) -> Column:
    """Tokens of a text: its runs of characters other than white space (null: 0)."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long")


def measure(shares: DataFrame, alphas: list[float], repetition: bool) -> list[float]:
    """The entropy (nats), or the largest ratio of repetitions, for each alpha, in one aggregation over the sources."""
    share = F.col("share")
    if repetition:
        # repetitions are share ** (alpha - 1); they are most for the least share and least for the largest
        cols = [F.pow(F.max(share) / F.min(share), F.lit(1.0 - a)).alias(f"m{k}") for k, a in enumerate(alphas)]
    else:
        total = [F.sum(F.pow(share, F.lit(a))) for a in alphas]
        cols = [(F.log(t) - F.lit(a) * F.sum(F.pow(share, F.lit(a)) * F.log(share)) / t).alias(f"m{k}") for k, (a, t) in enumerate(zip(alphas, total, strict=True))]
    return [float(x or 0.0) for x in shares.agg(*cols).first()]


def find_alpha(shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The largest alpha in [0, 1] that meets the target; both measures fall as alpha grows.

    A target that alpha = 0 doesn't reach gives 0, one that alpha = 1 meets already gives 1.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give one of target_entropy and max_repetition")
    repetition = max_repetition is not None

    def meets(value: float) -> bool:
        return value <= max_repetition + 1e-12 if repetition else value >= target_entropy - 1e-12

    lo, hi = 0.0, 1.0
    # repetition falls with alpha: the least alpha that meets; entropy falls with alpha: the largest that meets
    if repetition:
        first = measure(shares, [0.0, 1.0], True)
        if meets(first[0]):
            return 0.0
    else:
        first = measure(shares, [0.0, 1.0], False)
        if meets(first[1]):
            return 1.0
        if not meets(first[0]):
            return 0.0
    while hi - lo > 2.0**-STEPS:
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(1, SECTIONS)]
        got = [meets(v) for v in measure(shares, grid, repetition)]
        k = sum(not g for g in got) if repetition else sum(got)
        ends = [lo, *grid, hi]
        lo, hi = ends[k], ends[k + 1]
    return hi if repetition else lo


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repetition: float | None = None,
    budget: float | None = None,
    blocks: int = BLOCKS,
    seed: int = 11,
) -> DataFrame:
    """(id, source, tokens, pass, block, position): one row for each time that a document is used.

    budget is in tokens; None is the least budget under which every source gets at least one whole pass, so that
    no document is lost. position orders the whole mixture: blocks of all sources interleave by a hash;
    only rows with equal id and text share one.

    A null source is a source of its own; null and empty texts have no tokens and appear in every whole pass; rows
    that repeat are used each; null ids pass through; an empty table gives no rows; other columns are ignored.
    Sources without tokens get whole passes as the least repeated source does. A hot source is many blocks: only
    (block, tokens) pairs of a source, `blocks` at most, meet in one task.
    """
    rows = drawn(docs, [F.col(id_col).alias("id")], id_col, text_col, source_col, blocks, seed)
    use = used_rows(rows, planned(rows, target_entropy, max_repetition, budget, seed), seed)
    return use.select("id", "source", "tokens", "pass", "block", "position")


def mixed_documents(docs: DataFrame, max_repetition: float, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """docs with each row as often as the mixture without a budget uses it, at least once; all columns stay.

    Rows come in the mixture's order, by position: written files follow it from the first to the last.
    """
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = drawn(docs, [row.alias("__row"), docs[id_col].alias("id")], id_col, text_col, source_col, BLOCKS, seed)
    used = used_rows(rows, planned(rows, None, max_repetition, None, seed), seed)
    ordered = used.select("position", "__row").repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*[F.col("__row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])


def drawn(docs: DataFrame, keep: list[Column], id_col: str, text_col: str, source_col: str, blocks: int, seed: int) -> DataFrame:
    """The columns to keep, with source, text, a random draw of the row and its block."""
    draw = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])
    rows = docs.select(*keep, docs[source_col].alias("source"), docs[text_col].alias("__text"), draw.alias("__draw"))
    return rows.withColumn("block", F.pmod("__draw", F.lit(blocks)).cast("int"))


def planned(rows: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None, seed: int) -> DataFrame:
    sizes = materialize(rows.groupBy("source", "block").agg(F.sum(token_counts(F.col("__text"))).alias("block_tokens")), "block-tokens")
    return materialize(plan_blocks(sizes, target_entropy, max_repetition, budget, seed), "block-plan")


def plan_blocks(sizes: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None, seed: int) -> DataFrame:
    """(source, block, passes, partial): whole passes of each block, and the tokens to take from it in the last pass."""
    shares = sizes.groupBy("source").agg(F.sum("block_tokens").alias("source_tokens"))
    shares = materialize(shares, "source-tokens")
    total = shares.agg(F.sum("source_tokens")).first()[0] or 0
    shares = shares.withColumn("share", F.col("source_tokens") / F.lit(float(max(total, 1))))
    some = shares.filter(F.col("source_tokens") > 0)
    alpha = find_alpha(some, target_entropy, max_repetition) if total else 1.0
    power = F.pow(F.col("share"), F.lit(alpha))
    # tokens per unit of power: the budget over the sum of powers, or what gives the largest source one pass
    norm = some.agg(F.sum(power).alias("sum"), F.max(F.col("source_tokens") / power).alias("unit")).first()
    unit = 0.0 if not total else norm["unit"] if budget is None else budget / norm["sum"]
    epochs = F.when(F.col("source_tokens") > 0, F.round(F.lit(unit) * power / F.col("source_tokens"), 9)).otherwise(F.lit(1.0))
    per_source = shares.withColumn("epochs", epochs).withColumns({"passes": F.floor("epochs"), "rest": F.floor((F.col("epochs") - F.floor("epochs")) * F.col("source_tokens"))})
    joined = sizes.join(per_source.select("source", "passes", "rest"), sizes["source"].eqNullSafe(per_source["source"])).select(sizes["source"], "block", "block_tokens", "passes", "rest")
    turn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.col("source"), F.col("passes"), F.col("block")), "block")
    before = F.coalesce(F.sum("block_tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partial = F.greatest(F.lit(0), F.least(F.col("block_tokens"), F.col("rest") - before))
    return joined.select(F.col("source").alias("__source"), F.col("block").alias("__block"), "passes", partial.cast("long").alias("partial"), (partial >= F.col("block_tokens")).alias("whole"))


def used_rows(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Each row once for every pass that takes it.

    The block in which a source's budget ends is taken part by part, and the part in which it ends row by row, by hash.
    Tokens are counted after the join with the plan, so only where they are needed.
    """
    both = rows.join(plan, rows["source"].eqNullSafe(plan["__source"]) & (rows["block"] == plan["__block"]))
    cut = (F.col("partial") > 0) & ~F.col("whole")
    counted = lambda df: df.withColumn("tokens", token_counts(F.col("__text"))).drop("__text", "__source", "__block", "whole")
    within = counted(both.filter(cut)).withColumn("__part", F.pmod(F.shiftright("__draw", 16), F.lit(PARTS)))
    parts = within.groupBy("source", "block", "__part", "partial").agg(F.sum("tokens").alias("__of"))
    before = F.coalesce(F.sum("__of").over(Window.partitionBy("source", "block").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("__part").alias("__p"), (F.col("partial") - before).alias("__left"))
    placed = within.join(parts, within["source"].eqNullSafe(parts["__s"]) & (within["block"] == parts["__b"]) & (within["__part"] == parts["__p"]))
    order = Window.partitionBy("source", "block", "__part").orderBy("__draw", "id", "tokens")
    until = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    partly = placed.withColumn("__last", until <= F.col("__left")).drop("__part", "__left", "__s", "__b", "__p")
    others = counted(both.filter(~cut)).withColumn("__last", F.col("partial") > 0)
    times = F.col("passes") + F.col("__last").cast("int")
    used = partly.unionByName(others).filter(times > 0)
    used = used.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    place = F.xxhash64(F.lit(seed), F.col("pass"), F.col("source"), F.col("block"))
    return used.withColumn("position", F.concat_ws(":", F.lpad(F.col("pass").cast("string"), 6, "0"), F.lpad(F.hex(place), 16, "0"), F.lpad(F.hex("__draw"), 16, "0")))
