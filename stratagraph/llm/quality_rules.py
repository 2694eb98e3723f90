"""Quality rules: a learned decision list of threshold conjunctions, all in DataFrame functions.

Text statistics are columns over the whole text. Rules for poor documents are learned
by sequential covering: each rule grows one threshold at a time by the gain on two
thirds of the labelled rows, is pruned on the other third, and its rows are then
covered. The counts come from one Spark aggregate a step over cells (binned feature
vectors with their label counts); the driver sees at most features x bins counts.
The list is emitted as one ordered CASE expression.

Defined results
- Null text: none (all statistics 0, base_failed). A very long text is read whole.
- No labels, or labels of one kind: no rule; the base alone decides.
- Several labels for one id: their mean, 0.5 and more is good. Rows without id learn nothing.
- Repeated rows are answered each. Empty table: no rows. Extra columns are ignored, whatever their names.
- Ties: of conditions of equal gain the first by feature, direction and cut is grown; of rules that match a row the first decides.
- Repeated three-word windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize, text_of

#: Features the rules may use, as SQL over the base statistics.
FEATURES = {
    "f_words": "cast(n_words as double)",
    "f_word_len": "n_word_chars / greatest(n_words, 1)",
    "f_symbols": "n_symbols / greatest(n_words, 1)",
    "f_dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "f_repeat": "n_repeat_words / greatest(n_words, 1)",
    "f_upper": "n_upper / greatest(n_word_chars, 1)",
    "f_digit": "n_digit / greatest(n_word_chars, 1)",
    "f_loud": "n_loud / greatest(n_words, 1)",
    "f_bars": "n_bars / greatest(n_words, 1)",
    "f_short": "n_short / greatest(n_words, 1)",
    "f_stops": "n_stops / greatest(n_words, 1)",
    "f_distinct": "n_distinct / greatest(n_words, 1)",
}
BINS = 48
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must be right this often on the pruning rows, by the lower end of its 90 % interval.
MIN_PRECISION = 0.85


def _count(text: str, chars: str) -> Column:
    t = F.col(text)
    return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the counts of every whole text (long): words, characters, lines, repetition."""
    ws = r"[\\x20\\x09-\\x0D]+"
    base = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    split = base.select(
        "__id",
        "__text",
        F.trim(F.col("__text"), F.lit(" \t\n\x0b\x0c\r")).alias("__trim"),
        F.split("__text", "\n").alias("__raw"),
    )
    words = split.select(
        "__id",
        "__text",
        F.expr("filter(__raw, x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("__lines"),
        F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.expr(f"split(__trim, '{ws}')")).alias("__words"),
    )
    grams = words.select(
        "*",
        F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))").alias("__grams"),
        F.expr("size(array_distinct(__words))").cast("long").alias("n_distinct"),
        F.expr("size(filter(__words, x -> length(x) <= 3))").cast("long").alias("n_short"),
        F.expr("size(filter(__words, x -> endswith(x, '!!')))").cast("long").alias("n_loud"),
        F.expr("size(filter(__words, x -> endswith(x, '.')))").cast("long").alias("n_stops"),
        F.length(F.regexp_replace("__text", WS, "")).cast("long").alias("n_word_chars"),
    )
    marked = grams.withColumn(
        "__sorted",
        F.expr("if(size(array_distinct(__grams)) < size(__grams), sort_array(transform(__grams, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"),
    )
    found = marked.withColumn(
        "__found",
        F.expr("transform(filter(__sorted, (s, k) -> (k > 0 and __sorted[k - 1].h = s.h) or (k + 1 < size(__sorted) and __sorted[k + 1].h = s.h)), s -> s.i)"),
    )
    covered = "aggregate(array_sort(__found), struct(-3 as last, 0 as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
    return found.select(
        F.col("__id").alias(id_col),
        F.size("__words").cast("long").alias("n_words"),
        "n_word_chars",
        _count("__text", "#*$%&|<>").alias("n_symbols"),
        F.expr("size(__lines) - size(array_distinct(__lines))").cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        _count("__text", "0123456789").alias("n_digit"),
        _count("__text", "|").alias("n_bars"),
        "n_distinct",
        "n_short",
        "n_loud",
        "n_stops",
    )


@dataclass(frozen=True)
class Condition:
    """feature <= value, or feature > value; `bin` is the value's place among the feature's cuts."""

    feature: str
    above: bool
    bin: int
    value: float

    def on_bins(self) -> str:
        return f"b_{self.feature} {'>' if self.above else '<='} {self.bin}"

    def on_values(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.value!r}D"


Rule = tuple[Condition, ...]


def rules_to_column(rules: list[Rule]) -> Column:
    """The ordered list: the number of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for n in range(len(rules), 0, -1):
        out = F.when(F.expr(" and ".join(c.on_values() for c in rules[n - 1])), F.lit(n)).otherwise(out)
    return out


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Bits saved a covered poor row, times those rows."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0


def _lower(p: float, n: float) -> float:
    """Lower end of the Wilson interval for the share p / (p + n)."""
    m, z = p + n, 1.2816
    if m <= 0:
        return 0.0
    share = p / m
    return (share + z * z / (2 * m) - z * math.sqrt(share * (1 - share) / m + z * z / (4 * m * m))) / (1 + z * z / m)


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Decision list for label 0, from every labelled row of stats (which is read more than once)."""
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).alias("__good"))
    rows = stats.join(lab, id_col).select(
        "__good", (F.pmod(F.xxhash64(F.col(id_col)), F.lit(3)) < 2).alias("__grow"), *[F.expr(e).alias(f) for f, e in FEATURES.items()]
    )
    rows = materialize(rows, "quality_labelled")
    grid = [k / BINS for k in range(1, BINS)]
    # Cuts lie between the kinds as well: quantiles of all rows and of the poor ones.
    cuts_row = rows.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("__good")).alias("poor"),
        *[F.percentile_approx(f, grid, 10_000).alias(f) for f in FEATURES],
        *[F.percentile_approx(F.when(~F.col("__good"), F.col(f)), grid[:: max(1, BINS // 16)], 10_000).alias(f"p_{f}") for f in FEATURES],
    ).first()
    if not cuts_row["n"] or not cuts_row["poor"] or cuts_row["poor"] == cuts_row["n"]:
        return []
    cuts = {f: sorted({float(x) for x in [*(cuts_row[f] or []), *(cuts_row[f"p_{f}"] or [])]}) for f in FEATURES}
    place = [
        F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[f])}), c -> {f} > c))").alias(f"b_{f}") if cuts[f] else F.lit(0).alias(f"b_{f}")
        for f in FEATURES
    ]
    bins = [f"b_{f}" for f in FEATURES]
    cells = rows.select("__good", "__grow", *place).groupBy("__grow", *bins).agg(F.count_if(~F.col("__good")).alias("p"), F.count_if("__good").alias("n"))
    cells = materialize(cells, "quality_cells")
    least = max(4, round(0.002 * cuts_row["poor"]))
    names = list(FEATURES)
    rules: list[Rule] = []
    open_rows = "true"
    while len(rules) < MAX_RULES:
        rule: Rule = ()
        at = open_rows
        while len(rule) < MAX_CONDITIONS:
            found = (
                cells.where("__grow").where(at)
                .select("p", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(b).alias("b")) for k, b in enumerate(bins)])).alias("x"))
                .groupBy("x.f", "x.b")
                .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
                .collect()
            )
            best, best_gain = None, 1e-6
            p0 = sum(r["p"] for r in found if r["f"] == 0)
            n0 = sum(r["n"] for r in found if r["f"] == 0)
            if p0 < least or n0 == 0:
                break
            for k, f in enumerate(names):
                hist = {r["b"]: (r["p"], r["n"]) for r in found if r["f"] == k}
                p = n = 0
                for b in range(len(cuts[f])):
                    dp, dn = hist.get(b, (0, 0))
                    p, n = p + dp, n + dn
                    for above, (cp, cn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if cp >= least and (g := _gain(p0, n0, cp, cn)) > best_gain:
                            best, best_gain = Condition(f, above, b, cuts[f][b]), g
            if best is None:
                break
            rule += (best,)
            at = f"{at} and {best.on_bins()}"
        if not rule:
            break
        whole = [" and ".join([open_rows, *(c.on_bins() for c in rule[: k + 1])]) for k in range(len(rule))]
        held = cells.where("not __grow").agg(*[F.expr(f"sum(if({w}, {c}, 0))").alias(f"{c}{k}") for k, w in enumerate(whole) for c in ("p", "n")]).first()
        worth = [(_lower(held[f"p{k}"] or 0, held[f"n{k}"] or 0), -k) for k in range(len(rule))]
        top = max(worth)
        if top[0] < MIN_PRECISION:
            break
        rule = rule[: 1 - top[1]]
        rules.append(rule)
        open_rows += f" and not ({' and '.join(c.on_bins() for c in rule)})"
    return rules


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The statistics of every document with rule (number of the first rule met, 0 for none), base_failed and kept."""
    stats = materialize(text_statistics(docs, id_col, text_col), "quality_stats")
    rules = learn_rules(stats, labels.select(id_col, label_col), id_col, label_col)
    return stats.withColumn("rule", rules_to_column(rules)).withColumn("base_failed", base_failed()).withColumn("kept", F.expr("not base_failed and rule = 0"))
