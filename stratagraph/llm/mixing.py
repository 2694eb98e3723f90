"""Temperature mixing of sources, realised as budgeted block permutations.

Shares: source token shares p are exponentiated, w = p ** alpha / sum(p ** alpha); alpha in [0, 1] (1: as they are,
0: all alike) is bisected until the mix meets a target entropy, or, by default, until no source is repeated
more than `max_repeats` times when the budget lets every source appear whole.

Realisation: a source's budget is its weight times the token budget. Whole epochs are given to all its
documents; the rest of the budget goes to a prefix of a keyed permutation: documents fall into blocks by
a hash of the id, blocks are permuted by another hash, and documents within the block on the border by
a third. A document's running total is the total of the blocks before its own plus a sum within its
block. A block holds about BLOCK_TOKENS tokens, or a MAX_BLOCKS-th of its source, so no source, hot or
not, is ever in one task.

Defined results
- A null source is a source of its own. A null or empty text has no tokens; it gets whole epochs only.
- Rows repeated under one id are one place in the permutation: all or none of them get the partial epoch.
- One source, or no tokens at all: weight 1 (no tokens: equal weights), every row once.
- Ties: blocks or documents of equal hashes stand in order of their number or id.
- Very long texts are counted whole; a text longer than what is left of the budget is not in the partial epoch, nor is any behind it.
- Empty table: no rows. Extra columns are ignored by `mix_plan` and kept by `mix_sources`, whatever their names. Sources, and
  their token counts, come to the driver: they are names of data sets, of which there are few.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WS, materialize, text_of

MAX_REPEATS = 1.5
BLOCK_TOKENS = 250_000
#: Blocks of a source at most; beyond that they grow.
MAX_BLOCKS = 4096
SEED = 17
STEPS = 60


def temperature_weights(tokens: dict, alpha: float) -> dict:
    """Normalised p ** alpha of sources with tokens; the largest share is taken out first, so nothing over- or underflows."""
    top = max(tokens.values(), default=0)
    if not top:
        return {s: 1 / len(tokens) for s in tokens}
    raw = {s: (n / top) ** alpha if n else 0.0 for s, n in tokens.items()}
    total = sum(raw[s] for s in sorted(raw, key=repr))
    return {s: x / total for s, x in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log2(w) for w in weights.values() if w > 0)


def whole_budget(tokens: dict, weights: dict) -> float:
    """Least budget at which every source with tokens appears whole."""
    return max((n / weights[s] for s, n in tokens.items() if n), default=0.0)


def repeats(tokens: dict, weights: dict, budget: float) -> float:
    return max((budget * weights[s] / n for s, n in tokens.items() if n), default=1.0)


def bisect_alpha(tokens: dict, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> float:
    """The exponent nearest 0 whose mix has at most the target entropy or repetition; both fall as it rises."""

    def over(alpha: float) -> bool:
        w = temperature_weights(tokens, alpha)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        return repeats(tokens, w, whole_budget(tokens, w) if budget is None else budget) > max_repeats

    if not over(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return high


def count_tokens(text: str):
    """White-space words of the whole text."""
    trimmed = F.trim(text_of(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WS))).cast("long")


class Mix:
    """A fitted mix: what each source, block and border id gets. Applies to rows without moving their texts.

    sources: (source, weight, epochs, rest, blocks), a row a source. edges: (source, block, kind), kind 1 for blocks
    wholly in the partial epoch and 2 for the block on its border, at most MAX_BLOCKS rows a source.
    taken: (source, id) of the border blocks' rows that are in it.
    """

    def __init__(self, sizes: DataFrame, target_entropy: float | None, max_repeats: float, budget_tokens: float | None, seed: int):
        """sizes: (__id, __source, __n), read more than once."""
        self.seed = seed
        tokens = {r["__source"]: int(r["n"]) for r in sizes.groupBy("__source").agg(F.sum("__n").alias("n")).collect()}
        self.alpha = bisect_alpha(tokens, target_entropy, max_repeats, budget_tokens)
        self.weights = temperature_weights(tokens, self.alpha)
        self.budget = whole_budget(tokens, self.weights) if budget_tokens is None else budget_tokens
        plan = []
        for s, n in tokens.items():
            want = self.budget * self.weights[s]
            epochs = math.floor(want / n + 1e-9) if n else 1
            rest = max(0.0, want - epochs * n) if n else 0.0
            plan.append((s, self.weights[s], epochs, rest, min(MAX_BLOCKS, max(1, math.ceil(n / BLOCK_TOKENS)))))
        self.sources = sizes.sparkSession.createDataFrame(plan, "__s string, weight double, epochs long, rest double, blocks long")
        placed = self._placed(sizes)
        # The running total of blocks in permuted order is over at most MAX_BLOCKS rows a source.
        blocks = placed.groupBy("__source", "__block", "rest").agg(F.sum("__n").alias("__of_block"))
        order = Window.partitionBy("__source").orderBy(F.xxhash64("__block", F.lit(seed + 1)), "__block").rowsBetween(Window.unboundedPreceding, -1)
        before = blocks.withColumn("__before", F.coalesce(F.sum("__of_block").over(order), F.lit(0)))
        kind = F.when(F.expr("__before + __of_block <= rest"), 1).when(F.expr("__before < rest"), 2)
        edges = before.withColumn("kind", kind).where("kind is not null and rest > 0").select(F.col("__source").alias("__s"), F.col("__block").alias("__b"), "kind", "__before")
        self.edges = materialize(edges, "mix_edges")
        border = self._joined(placed, self.edges.where("kind = 2")).where("kind = 2 and __n > 0")
        by_id = border.groupBy("__source", "__block", "__before", "rest", "__id").agg(F.sum("__n").alias("__of_id"))
        within = Window.partitionBy("__source", "__block").orderBy(F.xxhash64("__id", F.lit(seed + 2)), "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        taken = by_id.withColumn("__upto", F.sum("__of_id").over(within)).where("__before + __upto <= rest")
        self.taken = materialize(taken.select(F.col("__source").alias("__s"), F.col("__id").alias("__i"), F.lit(1).alias("extra")), "mix_taken")

    def _placed(self, rows: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("__id", F.lit(self.seed)), F.col("blocks"))
        return rows.join(_small(self.sources), F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("__block", block)

    def _joined(self, placed: DataFrame, edges: DataFrame) -> DataFrame:
        return placed.join(_small(edges), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left").drop("__s", "__b")

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows(__id, __source, __n, ...) with weight, __block and copies."""
        joined = self._joined(self._placed(rows), self.edges)
        out = joined.join(_small(self.taken), F.col("__source").eqNullSafe(F.col("__s")) & F.col("__id").eqNullSafe(F.col("__i")), "left").drop("__s", "__i")
        partial = F.when(F.col("__n") == 0, 0).when(F.col("kind") == 1, 1).otherwise(F.coalesce("extra", F.lit(0)))
        return out.withColumn("copies", (F.col("epochs") + partial).cast("long")).drop("kind", "__before", "extra", "epochs", "rest", "blocks")


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast where the rows are counted to be few; beyond that a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), count_tokens(text_col).alias("__n"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float = MAX_REPEATS,
    budget_tokens: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """id_col, source, n_tokens, weight, block and copies (0 and more) of every row.

    budget_tokens: None for the least budget at which every source appears whole.
    """
    sizes = materialize(_sized(docs, id_col, text_col, source_col), "mix_sizes")
    out = Mix(sizes, target_entropy, max_repeats, budget_tokens, seed).apply(sizes)
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__n").alias("n_tokens"), "weight", F.col("__block").alias("block"), "copies")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    target_entropy: float | None = None,
    max_repeats: float = MAX_REPEATS,
    budget_tokens: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The rows of docs, each as often as the plan says, with all their columns; rows stay in their partitions."""
    sizes = materialize(_sized(docs, id_col, text_col, source_col), "mix_sizes")
    mix = Mix(sizes, target_entropy, max_repeats, budget_tokens, seed)
    cols = docs.columns
    rows = docs.select(
        F.struct(*cols).alias("__row"),
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        F.when(text_of(text_col).rlike(r"[^\x20\x09-\x0D]"), 1).otherwise(0).alias("__n"),
    )
    times = mix.apply(rows).where("copies > 0").select("__row", F.explode(F.expr("sequence(1L, copies)")).alias("__copy"))
    return times.select("__row.*")
