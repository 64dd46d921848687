"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected until the
weights' entropy meets a target and no source is repeated beyond a limit. The weights become token budgets, and every
source spends its budget on whole passes over its documents, each in another order: a pass is a permutation of blocks,
and a block a permutation of documents. The last pass ends where the budget does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tabulon.llm.common import stored, work_dir

#: Exponents tried in one reading of the table of sources: each reading does four steps of bisection.
TRIED = 15
ROUNDS = 12


def tokens(text: str = "text"):
    """Tokens of a text: maximal runs without white space. Null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def entropy_and_repeats(sources: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy of the weights in nats, most passes over any source) for each exponent, in one job."""
    tried = sources.where("n_tokens > 0").select("n_tokens", "share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    raised = tried.withColumn("r", F.exp(F.col("a") * F.log("share")))
    found = raised.groupBy("a").agg(F.sum("r").alias("z"), F.sum(F.col("r") * F.col("a") * F.log("share")).alias("rl"), F.max(F.col("r") / F.col("n_tokens")).alias("most"))
    return sorted((r["a"], math.log(r["z"]) - r["rl"] / r["z"], r["most"] / r["z"] * budget) for r in found.collect())


def bisect_exponent(sources: DataFrame, budget: float, entropy: float, max_passes: float) -> float:
    """The largest share of temperature that is needed and no more: the largest exponent in [0, 1] whose entropy is at
    least ``entropy`` (of the highest possible), or, where some source would then be passed over more than
    ``max_passes`` times, the smallest exponent that respects that limit (1, if none does)."""
    n = sources.where("n_tokens > 0").count()
    if n < 2:
        return 1.0
    target = entropy * math.log(n)

    def search(fits) -> float:
        """fits(H, passes): true below the exponent that is looked for, false above."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = [low + (high - low) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
            below = [a for a, h, p in entropy_and_repeats(sources, tried, budget) if fits(h, p)]
            above = [a for a in tried if a not in below]
            low, high = max([low, *below]), min([high, *above])
        return low

    ends = entropy_and_repeats(sources, [0.0, 1.0], budget)
    by_entropy = 1.0 if ends[1][1] >= target else search(lambda h, p: h >= target)
    passes = entropy_and_repeats(sources, [by_entropy], budget)[0][2]
    if passes <= max_passes:
        return by_entropy
    return search(lambda h, p: p > max_passes) + 16.0**-ROUNDS if ends[1][2] <= max_passes else 1.0


def mix(docs: DataFrame, budget: int | None = None, entropy: float = 0.97, max_passes: float = 4.0, seed: int = 17, block_rows: int = 5_000) -> DataFrame:
    """The rows of ``docs`` that the mix emits, with mix_source, mix_tokens, mix_weight, mix_pass, mix_block, mix_key.

    ``budget`` tokens are emitted in all (as many as there are, if not given). Sorted by (mix_pass, mix_block, mix_key)
    the rows of a source are its budgeted permutation. A row is emitted in a pass if the tokens before it in that pass
    are less than what is left of the source's budget, so that every source meets its budget to within a document.

    A null source is a source of its own, null texts and texts without a token weigh nothing and are emitted in whole
    passes, or before the budget ends; a source without any token gets no budget and isn't emitted. Rows
    repeated are rows of their own, next to each other in a permutation, which can end between them; an empty table gives no rows. Columns of ``docs`` of any name are kept,
    but those named mix_* are refused.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("mix_")]:
        raise ValueError(f"columns {clash} clash with those of the mix")
    spark = docs.sparkSession
    path = work_dir(spark, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    # The columns of docs go as one from here on, so that none of their names can be one of those used below.
    counted = docs.select(F.struct("*").alias("mix_row"), "doc_id", "text", key.alias("mix_source"), tokens().alias("mix_tokens"))
    sources = counted.groupBy("mix_source").agg(F.sum("mix_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))
    sources = stored(sources, f"{path}/counted")
    total = sources.agg(F.sum("n_tokens")).first()[0] or 0
    sources = sources.withColumn("share", F.col("n_tokens") / F.lit(max(1, total)))
    budget = total if budget is None else budget
    a = bisect_exponent(sources, budget, entropy, max_passes)
    raised = sources.withColumn("raised", F.when(F.col("n_tokens") > 0, F.exp(F.lit(a) * F.log("share"))).otherwise(0.0))
    z = raised.agg(F.sum("raised")).first()[0] or 1.0
    budgets = raised.withColumn("mix_weight", F.col("raised") / z).withColumn("tokens_due", F.round(F.col("mix_weight") * budget).cast("long"))
    budgets = budgets.withColumn("whole", F.when(F.col("n_tokens") > 0, F.floor(F.col("tokens_due") / F.col("n_tokens"))).otherwise(0).cast("long"))
    budgets = budgets.withColumn("rest", F.col("tokens_due") - F.col("whole") * F.col("n_tokens")).withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows))
    budgets = stored(budgets.select("mix_source", "mix_weight", "whole", "rest", "n_blocks"), f"{path}/budgets")

    # The last pass of a source: blocks that lie wholly before the end of the budget, and the one that it ends in.
    order = lambda p: F.xxhash64(F.lit(seed), p, "doc_id", "text")
    small = F.broadcast(budgets) if budgets.count() <= 100_000 else budgets
    dealt = counted.join(small, "mix_source").withColumn("mix_key", order(F.col("whole")))
    dealt = dealt.withColumn("mix_block", F.pmod("mix_key", "n_blocks"))
    blocks = dealt.groupBy("mix_source", "mix_block").agg(F.sum("mix_tokens").alias("block_tokens"))
    blocks = stored(blocks, f"{path}/blocks")
    before = block_starts(blocks)
    edges = before.join(budgets.select("mix_source", "rest"), "mix_source").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_tokens") >= F.col("rest")))
    edges = stored(edges.select("mix_source", "mix_block", "before", "rest"), f"{path}/edges")
    # Rows of one key are copies: they are summed before they are put in order, and as many as are due are emitted.
    keys = dealt.select("mix_source", "mix_block", "mix_key", "mix_tokens").join(F.broadcast(edges) if edges.count() <= 100_000 else edges, ["mix_source", "mix_block"])
    keys = keys.groupBy("mix_source", "mix_block", "mix_key", "before", "rest").agg(F.sum("mix_tokens").alias("key_tokens"), F.count("*").alias("n"))
    up_to = Window.partitionBy("mix_source", "mix_block").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    last = keys.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("key_tokens").over(up_to), F.lit(0))).where("left > 0")
    due = F.when(F.col("key_tokens") > 0, F.least(F.col("n"), F.ceil(F.col("left") * F.col("n") / F.col("key_tokens")))).otherwise(F.col("n"))
    end = F.max_by(F.struct(F.col("mix_key").alias("end_key"), due.alias("end_copies"), (due < F.col("n")).alias("cut")), "mix_key")
    ends = last.groupBy("mix_source", "mix_block").agg(end.alias("e")).select("mix_source", "mix_block", "e.*")
    whole_blocks = before.join(budgets.select("mix_source", "rest"), "mix_source").where(F.col("before") + F.col("block_tokens") < F.col("rest"))
    whole_blocks = whole_blocks.select("mix_source", "mix_block", F.lit((1 << 63) - 1).alias("end_key"), F.lit(0).cast("long").alias("end_copies"), F.lit(False).alias("cut"))
    ends = stored(ends.unionByName(whole_blocks), f"{path}/ends")
    n_ends = ends.count()

    out = ["mix_row", "mix_source", "mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_key"]
    partly = dealt.join(F.broadcast(ends) if n_ends <= 100_000 else ends, ["mix_source", "mix_block"]).withColumn("mix_pass", F.col("whole"))
    emitted = partly.where((F.col("mix_key") < F.col("end_key")) | ((F.col("mix_key") == F.col("end_key")) & ~F.col("cut"))).select(out)
    if not ends.where("cut").isEmpty():
        emitted = emitted.unionByName(some_copies(partly.where("mix_key = end_key AND cut"), out))
    passed = dealt.where("whole > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    passed = passed.withColumn("mix_key", order(F.col("mix_pass"))).withColumn("mix_block", F.pmod("mix_key", "n_blocks"))
    return passed.select(out).unionByName(emitted).select("mix_row.*", *out[1:])


def some_copies(copies: DataFrame, out: list[str]) -> DataFrame:
    """The first ``end_copies`` of the rows of each source's last key. Rows that are alike in every column are counted
    before they are shuffled, so that many copies are a few rows for the task that numbers them."""
    # As text, since maps can't be grouped by.
    alike = copies.select("mix_source", "end_copies", F.to_json(F.struct(*out)).alias("mix_text"), F.struct(*out).alias("mix_out"))
    alike = alike.groupBy("mix_source", "end_copies", "mix_text").agg(F.first("mix_out").alias("mix_out"), F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy(F.xxhash64("mix_text")).rowsBetween(Window.unboundedPreceding, -1)
    due = alike.withColumn("due", F.least(F.col("n"), F.col("end_copies") - F.coalesce(F.sum("n").over(before), F.lit(0)))).where("due > 0")
    return due.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("due")))).select("mix_out.*")


def block_starts(blocks: DataFrame) -> DataFrame:
    """Tokens before each block in its source's order of blocks. Blocks are summed by thousands first, so that no task
    holds more than a thousand blocks of a source, or the thousands of one."""
    each = Window.partitionBy("mix_source", "thousand").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("mix_source").orderBy("thousand").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("thousand", F.floor(F.col("mix_block") / 1000))
    thousands = blocks.groupBy("mix_source", "thousand").agg(F.sum("block_tokens").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(over), F.lit(0)))
    inner = blocks.withColumn("inner", F.coalesce(F.sum("block_tokens").over(each), F.lit(0)))
    return inner.join(thousands.select("mix_source", "thousand", "earlier"), ["mix_source", "thousand"]).select("mix_source", "mix_block", "block_tokens", (F.col("inner") + F.col("earlier")).alias("before"))
