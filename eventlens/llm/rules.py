"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected, per stratum.

Every rule is a measure of a text and a grid of cutoffs. Labelled good documents of a stratum are
the holdout: for a cutoff that rejects k of n, the exact binomial test says whether the true rate of
false rejection can be above the rule's share of the risk. Cutoffs are tested from the loosest to
the strictest and the test stops at the first that fails (so a stratum and rule need one level for
all their cutoffs); the levels of strata and rules are divided by their number (Bonferroni). The
risks of the rules add up to ``RISK``, so the union of all rules is covered. A trial is a distinct
text: copies of a document, under its own or another id, are no further evidence.

Only counts per (stratum, rule, label, cutoff) leave the tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.textstats import with_counts
from eventlens.session import materialize

RISK = 0.05
CONFIDENCE = 0.95
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A certified cutoff must reject this many bad documents for each good one.
GAIN = 20
# Strata up to which the table of cutoffs is broadcast.
BROADCAST_STRATA = 10_000

# Measures (higher is worse) and their grids.
GRID = [round(0.02 * i, 2) for i in range(1, 50)]
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", GRID),
    "marks": ("n_marks / greatest(n_words, 1)", GRID),
    "capitals": ("n_upper / greatest(n_upper + n_lower, 1)", GRID),
    "digits": ("n_digits / greatest(word_chars, 1)", GRID),
    "same_lines": ("n_dup_lines / greatest(n_lines, 1)", GRID),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", GRID),
    "one_word": ("n_top_word / greatest(n_words, 1)", GRID),
    "long_words": ("word_chars / greatest(n_words, 1) / 40", GRID),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1, dtype=float)
    logs = np.concatenate(([0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(p / (1 - p))))) + n * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certify(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int:
    """Index of the chosen cutoff, or -1.

    ``good[c]`` and ``bad[c]`` count the documents with exactly ``c`` cutoffs below their measure, so
    cutoff c rejects those with more than c. The certified run starts at the loosest (last) cutoff;
    in it, the cutoff with the best ``bad - GAIN * good`` wins, the loosest of equals.
    """
    n = int(good.sum())
    best, chosen = 0, -1
    for c in range(len(good) - 2, -1, -1):
        k = int(good[c + 1 :].sum())
        if n == 0 or binomial_tail(k, n, risk) > level:
            break
        gain = int(bad[c + 1 :].sum()) - GAIN * k
        if gain > best:
            best, chosen = gain, c
    return chosen


def cutoffs(counted: DataFrame, n_strata: int) -> DataFrame:
    """``stratum, cuts`` (array in the order of ``RULES``, null: the rule rejects nothing) from
    ``stratum, rule, good, place, n``."""
    risk, level = RISK / len(RULES), (1 - CONFIDENCE) / (len(RULES) * max(n_strata, 1))
    grids = [grid for _, grid in RULES.values()]

    def of_stratum(rows: pd.DataFrame) -> pd.DataFrame:
        cuts: list[float | None] = []
        for r, grid in enumerate(grids):
            tally = np.zeros((2, len(grid) + 1), dtype=np.int64)
            mine = rows[rows["rule"] == r]
            np.add.at(tally, (mine["good"].to_numpy(int), mine["place"].to_numpy(int)), mine["n"].to_numpy(int))
            c = certify(tally[1], tally[0], risk, level)
            cuts.append(grid[c] if c >= 0 else None)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "cuts": [cuts]})

    return counted.groupBy("stratum").applyInPandas(of_stratum, "stratum string, cuts array<double>")


def judged(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
) -> DataFrame:
    """One row per document: id, stratum, the counts of its text, ``base_failed``, ``failed_rules``
    (names) and ``kept``.

    A null or empty text has no words and fails the base rule. A null stratum is a stratum of its
    own. Labels that are null, and labels of unknown documents, are not used; a text labelled both
    ways counts once for each, and however many rows hold it, once per stratum. Without enough labels no cutoff is certified and only the base
    rule rejects. Repeated rows each get their verdict. Extra columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{stratum_col}`").alias("stratum"),
        F.xxhash64(text).alias("p1"), F.xxhash64(F.lit(7), text).alias("p2"), text.alias("text"),
    )
    counts = materialize(with_counts(slim, "text", ["id", "stratum", "p1", "p2"]), "rule-counts")
    stratum = F.coalesce(F.concat(F.lit("="), F.col("k1").cast("string")), F.lit(""))
    measured = counts.withColumn("stratum", stratum).withColumn(
        "measures", F.array(*[F.expr(f"cast({m} as double)") for m, _ in RULES.values()])
    )
    truth = labels.select(F.col(f"`{id_col}`").alias("k0"), F.col(f"`{label_col}`").cast("int").alias("good"))
    truth = truth.where(F.col("good").isin(0, 1) & F.col("k0").isNotNull()).distinct()
    grids = F.array(*[F.array(*map(F.lit, grid)) for _, grid in RULES.values()])
    places = F.zip_with("measures", grids, lambda m, grid: F.size(F.filter(grid, lambda cut: cut < m)))
    trials = measured.join(truth, "k0").select("stratum", "good", "k2", "k3", places.alias("places")).distinct()
    counted = materialize(
        trials.select("stratum", "good", F.posexplode("places").alias("rule", "place"))
        .groupBy("stratum", "good", "rule", "place").agg(F.count(F.lit(1)).alias("n")),
        "rule-tallies",
    )
    strata = counted.select("stratum").distinct().count()
    table = cutoffs(counted, strata)
    table = F.broadcast(table) if strata <= BROADCAST_STRATA else table
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    names = F.array(*[F.lit(r) for r in RULES])
    broken = F.zip_with(
        F.zip_with("measures", "cuts", lambda m, c: F.coalesce(m > c, F.lit(False))), names, lambda b, name: F.when(b, name)
    )
    failed = F.when(F.col("cuts").isNull(), F.array().cast("array<string>")).otherwise(F.filter(broken, lambda x: x.isNotNull()))
    return (
        measured.join(table, "stratum", "left")
        .withColumn("base_failed", base).withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .withColumnRenamed("k0", id_col).drop("measures", "cuts", "k1", "k2", "k3")
    )
