"""Mixing sources to target weights by temperature, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.llm._shared import staged

#: One job evaluates the midpoints of this many bisection steps; so many jobs follow each other.
STEPS_A_JOB, JOBS = 5, 7


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _draw(*parts: str | Column) -> Column:
    """60 bits of md5 of the parts, in any engine the same."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _bisect(parts: DataFrame, wanted, low: float = 0.0, high: float = 1.0, rising: bool = True) -> float:
    """The exponent in [low, high] where ``wanted(figures)`` turns false (rising) or true, to 6 places on the side where it is true.

    Plain bisection; but as each figure is a sum over all sources, one distributed job sums for all midpoints that the
    next STEPS_A_JOB steps could ask for (31 rows come back), so 35 steps take 7 jobs however many sources there are.
    """
    p = F.col("p")
    for _ in range(JOBS):
        n = 1 << STEPS_A_JOB
        grid = [low + (high - low) * k / n for k in range(1, n)]
        rows = (
            parts.select("p", F.explode(F.array(*[F.lit(a) for a in grid])).alias("a"))
            .groupBy("a")
            .agg(F.sum(F.pow(p, F.col("a"))).alias("z"), F.sum(F.pow(p, F.col("a")) * F.log(p)).alias("zl"), F.max(F.pow(p, F.col("a") - 1)).alias("most"), F.min(F.pow(p, F.col("a") - 1)).alias("least"))
            .collect()
        )
        figures = {r["a"]: r for r in rows}
        at, step = n // 2, n // 4
        lo, hi = 0, n
        while hi - lo > 1:
            at = (lo + hi) // 2
            if wanted(figures[grid[at - 1]]) == rising:
                lo = at
            else:
                hi = at
        low, high = low + (high - low) * lo / n, low + (high - low) * hi / n
    # A thousandth of the last place is the bisection's own error.
    return math.floor(low * 1e6 + 1e-3) / 1e6 if rising else math.ceil(high * 1e6 - 1e-3) / 1e6


def entropy(r) -> float:
    """Entropy of the weights p**a / z from their sums."""
    return math.log(r["z"]) - r["a"] * r["zl"] / r["z"]


def mixing_weights(totals: DataFrame, target_entropy: float | None, max_repetition: float | None, cover: bool) -> tuple[float, DataFrame]:
    """The exponent, and ``totals`` (source, n_docs, n_tokens) with share p, weight and budget base.

    ``target_entropy`` is a part of the highest possible entropy, ln(number of sources): the largest exponent that
    reaches it is taken. ``max_repetition`` bounds how often a source may be read: the smallest exponent within it is
    taken, and it wins over the entropy. 1 leaves the shares as they are, 0 makes all sources equal.
    """
    all_ = totals.agg(F.sum("n_tokens").alias("t"), F.count(F.when(F.col("n_tokens") > 0, 1)).alias("n")).first()
    total, n = all_["t"] or 0, all_["n"]
    parts = staged(totals.where("n_tokens > 0").select((F.col("n_tokens") / F.lit(float(max(total, 1)))).alias("p")), "shares")
    exponent = 1.0
    if n > 1 and target_entropy is not None:
        exponent = _bisect(parts, lambda r: entropy(r) >= target_entropy * math.log(n))
    if n > 1 and max_repetition is not None:
        most = (lambda r: r["most"] / r["least"]) if cover else (lambda r: r["most"] / r["z"])
        least = _bisect(parts, lambda r: most(r) <= max_repetition, rising=False)
        exponent = least if target_entropy is None else max(exponent, least)
    a = F.lit(exponent)
    z = parts.agg(F.sum(F.pow("p", a)).alias("z"), F.max(F.pow("p", 1 - a)).alias("c")).first()
    p = F.col("n_tokens") / F.lit(float(max(total, 1)))
    weight = F.when(F.col("n_tokens") > 0, F.pow(p, a) / F.lit(z["z"] or 1.0)).otherwise(0.0)
    return exponent, totals.withColumns({"weight": weight, "_budget": F.lit(float(total) * ((z["z"] or 1.0) * (z["c"] or 1.0) if cover else 1.0))})


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, budget: float | None = None, target_entropy: float | None = None,
    max_repetition: float | None = None, cover: bool = False, block_docs: int = 256, seed: int = 0,
) -> DataFrame:
    """All columns of ``df`` once for each copy drawn, with _epoch, _block, _order, _place, _tokens, _weight.

    Source s with weight w and T tokens (words) gets floor(w * budget) tokens: so many whole epochs, and of one more epoch as
    many documents as fit. Each epoch of a source is a permutation of its blocks (about ``block_docs`` documents each,
    dealt by a hash of the id) and of the documents in each block, drawn anew: read by _epoch, _order (the block's draw), _block, _place
    (the document's draw) and id. The last epoch is cut where the budget ends, inside the block that crosses it. ``budget`` defaults to the tokens of the input; with ``cover`` it is the least
    at which each document is drawn at least once. Weights: see mixing_weights().

    Null sources form a source of their own. Null and empty texts have no tokens and are drawn as their epoch says;
    a source without any token is drawn once. Rows with a null id share a hash. Equal ids are drawn alike. Columns of ``df``
    with the names of the added ones are replaced. An empty table gives an empty result.

    At scale: sums per source and per block are combined before the shuffle; running sums go over 1,024 ranges of a source's draws,
    over the blocks of the one range that crosses the budget and over the documents of the one block, so a source with a third of
    all rows costs no task more than a thousandth of its list of blocks. What each document needs is a handful of figures of its source, joined by size-checked joins.
    """
    slim = staged(df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), n_words(F.col(text_col)).alias("_tok")), "words")
    totals = slim.groupBy("_src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_tok").alias("n_tokens"))
    exponent, weighted = mixing_weights(totals, target_entropy, max_repetition, cover)
    want = F.floor(F.col("weight") * (F.lit(float(budget)) if budget is not None else F.col("_budget")) + F.lit(1e-6)).cast("long")
    plan = weighted.select(
        F.col("_src").alias("_psrc"), "weight", "n_tokens",
        F.ceil(F.col("n_docs") / block_docs).cast("long").alias("_blocks"),
        F.when(F.col("n_tokens") > 0, F.floor(want / F.col("n_tokens")).cast("long")).otherwise(1).alias("_epochs"),
        F.when(F.col("n_tokens") > 0, want % F.col("n_tokens")).otherwise(0).alias("_rest"),
    )
    plan = staged(plan, "mixing-plan")

    def order(epoch: str) -> Column:
        return _draw(F.lit(seed), F.lit("order"), F.coalesce(F.col("_src"), F.lit("")), "_block", epoch)

    def place(epoch: str) -> Column:
        return _draw(F.lit(seed), F.lit("doc"), F.coalesce(F.col("_id").cast("string"), F.lit("")), epoch)

    def placed(rows: DataFrame, plan: DataFrame = plan) -> DataFrame:
        """With the document's block, and its block's and its own place in the epoch that is cut."""
        rows = rows.join(plan, F.col("_src").eqNullSafe(F.col("_psrc"))).withColumn("_block", F.pmod(_draw(F.lit(seed), F.lit("block"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), F.col("_blocks")))
        return rows.withColumns({"_at": order("_epochs"), "_in": place("_epochs")})

    range_ = F.shiftright("_at", 50)  # of 60 bits
    blocks = staged(placed(slim).where("_rest > 0").groupBy("_src", "_block", "_at").agg(F.sum("_tok").alias("_sum"), F.first("_rest").alias("_rest")).withColumn("_range", range_), "blocks")

    def crossing(rows: DataFrame, order: list[str], before: Column) -> DataFrame:
        """Of each source the row at which the running sum, from ``before`` on, passes the rest; _before is the sum up to it."""
        upto = before + F.sum("_sum").over(Window.partitionBy("_src").orderBy(*order))
        return rows.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_sum")).where("_before <= _rest and _upto > _rest")

    ranges = crossing(blocks.groupBy("_src", "_range").agg(F.sum("_sum").alias("_sum"), F.first("_rest").alias("_rest")), ["_range"], F.lit(0))
    ranges = ranges.select(F.col("_src").alias("_rsrc"), F.col("_range").alias("_rrange"), F.col("_before").alias("_rbefore"))
    crossed = crossing(blocks.join(ranges, F.col("_src").eqNullSafe(F.col("_rsrc")) & (F.col("_range") == F.col("_rrange"))), ["_at", "_block"], F.col("_rbefore"))
    crossed = staged(crossed.select(F.col("_src").alias("_csrc"), F.col("_block").alias("_cblock"), F.col("_at").alias("_cat"), (F.col("_rest") - F.col("_before")).alias("_room")), "crossed")
    inside = placed(slim).join(crossed, F.col("_src").eqNullSafe(F.col("_csrc")) & (F.col("_block") == F.col("_cblock")))
    # Documents with one id are drawn or left together: the running sum is over ids.
    inside = inside.groupBy("_src", "_in", "_id", "_room").agg(F.sum("_tok").alias("_tok"))
    upto = F.sum("_tok").over(Window.partitionBy("_src").orderBy("_in", "_id"))
    last = inside.withColumn("_upto", upto).where("_upto <= _room").groupBy("_src").agg(F.max(F.struct("_in", "_id")).alias("_last"))
    cut = crossed.join(last.withColumnRenamed("_src", "_lsrc"), F.col("_csrc").eqNullSafe(F.col("_lsrc")), "left").select("_csrc", "_cblock", "_cat", "_last")
    # Written out, the table of sources has a known size, by which Spark decides whether it can go to all executors.
    plan = staged(plan.join(cut, F.col("_psrc").eqNullSafe(F.col("_csrc")), "left"), "mixing-cuts")

    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), n_words(F.col(text_col)).alias("_tok"))
    drawn = placed(whole, plan)
    before = (F.col("_at") < F.col("_cat")) | ((F.col("_at") == F.col("_cat")) & (F.col("_block") < F.col("_cblock")))
    here = (F.col("_at") == F.col("_cat")) & (F.col("_block") == F.col("_cblock")) & (F.struct("_in", "_id") <= F.col("_last"))
    copies = F.col("_epochs") + F.when(F.col("_rest") > 0, F.coalesce(before | here, F.lit(False)).cast("long")).otherwise(0)
    drawn = drawn.where(copies > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    added = {"_epoch": F.col("_epoch"), "_block": F.col("_block"), "_order": order("_epoch"), "_place": place("_epoch"), "_tokens": F.col("_tok"), "_weight": F.col("weight")}
    return drawn.select(*[F.col("_row")[c].alias(c) for c in df.columns if c not in added], *[column.alias(name) for name, column in added.items()])
