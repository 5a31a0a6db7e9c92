"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

Text statistics are in-row expressions over the whole text, so scoring is one scan without a shuffle. The
decision list is learned by sequential covering from labelled statistics: grow a conjunction of thresholds by
information gain, prune it on held-back rows, keep it if it is precise there, drop what it covers, go on. The
list becomes one ordered ``CASE`` expression. Fitting reads at most ``max_labelled`` labelled rows (those with
the smallest hash of their id: a documented, seed-free sample), so what reaches the driver is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 10_000
MIN_WORDS = 50

# Word separators of the contract, as a trim list and as a pattern.
_SEPARATORS = " \t\n\x0b\f\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio",
            "mark_ratio", "distinct_ratio", "line_words"]
STATISTICS = {*COUNTS, *FEATURES}


def _occurrences(characters: str) -> Column:
    """How many of these (non-space) characters the words hold; byte searches are cheaper than a pattern."""
    return sum((F.col("word_chars") - F.length(F.replace(F.col("__q_joined"), F.lit(c), F.lit("")))
                for c in characters), F.lit(0)).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts in ``COUNTS`` and the ratios in ``FEATURES``; columns of these names are replaced.

    Null text counts as empty: all counts 0 and all ratios 0. Helper columns are named ``__q_*``.
    """
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.withColumn("__q_trim", F.btrim(t, F.lit(_SEPARATORS)))
    d = d.withColumn("__q_words", F.when(F.col("__q_trim") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("__q_trim", _SPLIT, -1)))
    d = d.withColumn("__q_joined", F.array_join("__q_words", ""))
    d = d.withColumn("n_words", F.size("__q_words").cast("long"))
    # 3-word windows by hash; only texts in which some window repeats look for its places.
    d = d.withColumn("__q_win", F.expr(
        "CASE WHEN n_words < 3 THEN array() ELSE transform(sequence(0, cast(n_words as int) - 3), "
        "i -> xxhash64(__q_words[i], __q_words[i + 1], __q_words[i + 2])) END").cast("array<bigint>"))
    d = d.withColumn("__q_sorted", F.expr(
        "CASE WHEN size(array_distinct(__q_win)) < size(__q_win) THEN sort_array(__q_win) ELSE array() END")
        .cast("array<bigint>"))
    d = d.withColumn("__q_twice", F.expr(
        "array_distinct(filter(__q_sorted, (h, k) -> k > 0 AND h = __q_sorted[k - 1]))"))
    # A few repeated windows are looked up; with many, places come from sorting (window, place): same result.
    d = d.withColumn("__q_order", F.expr(
        "CASE WHEN size(__q_twice) > 24 THEN sort_array(transform(__q_win, (h, i) -> struct(h, i))) "
        "ELSE array() END").cast("array<struct<h:bigint,i:int>>"))
    d = d.withColumn("__q_places", F.expr(
        "CASE WHEN size(__q_twice) = 0 THEN array() WHEN size(__q_twice) <= 24 THEN "
        "filter(sequence(0, size(__q_win) - 1), i -> array_contains(__q_twice, __q_win[i])) "
        "ELSE transform(filter(__q_order, (x, k) -> get(__q_order, k - 1).h <=> x.h "
        "OR get(__q_order, k + 1).h <=> x.h), x -> x.i) END").cast("array<int>"))
    d = d.withColumn("n_repeat_words", F.expr(
        "cast(size(array_distinct(flatten(transform(__q_places, i -> array(i, i + 1, i + 2))))) as bigint)"))
    d = d.withColumn("__q_lines", F.filter(F.split(t, "\n", -1),
                                           lambda x: F.btrim(x, F.lit(_SEPARATORS)) != ""))
    d = d.withColumn("n_lines", F.size("__q_lines").cast("long"))
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("__q_lines")))
    d = d.withColumn("word_chars", F.length("__q_joined").cast("long"))
    d = d.withColumn("n_symbols", _occurrences("#*$%&|<>"))
    d = d.withColumn("__q_mark", _occurrences("!?"))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    stats = F.struct(
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"), (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("__q_mark") / chars).alias("mark_ratio"),
        (F.size(F.array_distinct("__q_words")) / words).alias("distinct_ratio"),
        (F.col("n_words") / lines).alias("line_words"))
    # One row each: the generator keeps later filters from being rewritten into (and repeating) the work above.
    own = [F.col(f"`{c}`") for c in docs.columns if c not in STATISTICS]
    return d.select(*own, F.inline(F.array(stats)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str          # ">=" or "<"
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.op == ">=" else c < self.threshold


Rule = tuple[Condition, ...]


def _masks(rows: list[dict], thresholds: dict[str, list[float]]) -> dict[Condition, int]:
    """Rows that satisfy each condition, as bits of one integer."""
    out = {}
    for f, cuts in thresholds.items():
        for c in cuts:
            bits = int("".join("1" if r[f] >= c else "0" for r in reversed(rows)) or "0", 2)
            out[Condition(f, ">=", c)] = bits
            out[Condition(f, "<", c)] = bits ^ ((1 << len(rows)) - 1)
    return out


def sequential_covering(rows: list[dict], thresholds: dict[str, list[float]], min_precision: float = 0.97,
                        min_cover: int = 5, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Decision list for label 0 (reject) from rows of features + ``label``; every third row prunes.

    Ties between equally good conditions go to the first in feature order, so the list is deterministic.
    """
    masks = _masks(rows, thresholds)
    bad = sum(1 << i for i, r in enumerate(rows) if r["label"] == 0)
    everything = (1 << len(rows)) - 1
    prune_part = sum(1 << i for i in range(2, len(rows), 3))
    rules: list[Rule] = []
    left = everything
    while len(rules) < max_rules:
        cover, rule = left & ~prune_part, []
        pos, neg = (cover & bad).bit_count(), (cover & ~bad).bit_count()
        while neg and len(rule) < max_conditions:
            best, gain = None, 1e-9
            before = math.log2(max(pos, 1e-9) / max(pos + neg, 1))
            for cond, m in masks.items():
                c = cover & m
                p = (c & bad).bit_count()
                if p < min_cover:
                    continue
                g = p * (math.log2(p / c.bit_count()) - before)
                if g > gain:
                    best, gain = cond, g
            if best is None:
                break
            rule.append(best)
            cover &= masks[best]
            pos, neg = (cover & bad).bit_count(), (cover & ~bad).bit_count()
        best_n, best_v = 0, -2.0
        for n in range(1, len(rule) + 1):  # prune: the prefix with the best balance on held-back rows
            c = left & prune_part
            for cond in rule[:n]:
                c &= masks[cond]
            p, q = (c & bad).bit_count(), (c & ~bad).bit_count()
            v = (p - q) / (p + q) if p + q else -1.0
            if v > best_v + 1e-12:
                best_n, best_v = n, v
        rule = rule[:best_n]
        c = left
        for cond in rule:
            c &= masks[cond]
        p, q = (c & bad).bit_count(), (c & ~bad).bit_count()
        if not rule or p < min_cover or p < min_precision * (p + q) or best_v < 2 * min_precision - 1:
            break
        rules.append(tuple(rule))
        left &= ~c
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, label_col: str = "quality",
                id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Decision list from labelled documents that pass the base rules.

    Rows without a label or id are left out; without both classes the list is empty.
    """
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_labelled))
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "__id")  # at most max_labelled rows of two numbers
    stats = text_statistics(labelled).where(~base_failed()).select("__id", "label", *FEATURES)
    rows = [r.asDict() for r in stats.orderBy("__id", *FEATURES).limit(max_labelled).collect()]
    if len({r["label"] == 0 for r in rows}) < 2:
        return []
    thresholds = {}
    for f in FEATURES:
        cuts = set()
        for cls in (True, False):  # cut points from either class, so a rare class has its own
            vals = sorted(r[f] for r in rows if (r["label"] == 0) == cls)
            cuts |= {float(f"{vals[int(q * (len(vals) - 1))]:.6g}")
                     for q in (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 1.0)}
        thresholds[f] = sorted(cuts)
    return sequential_covering(rows, thresholds)


def first_rule(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that fires, else null: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` plus statistics, ``base_failed``, ``rule`` (the one that rejects, if any) and ``kept``.

    Columns of ``docs`` with a statistic's name are overwritten; use ``select`` before if they matter. Empty and
    null texts fail the base rules (no words). Repeated rows are judged alike.
    """
    d = text_statistics(docs, text_col)
    d = d.withColumn("base_failed", base_failed()).withColumn("rule", first_rule(rules))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                     "n_repeat_words", "base_failed", "kept")
