"""Quality rules under weak supervision: rules vote or abstain, EM estimates how right each is, a posterior decides.

Everything runs as DataFrame expressions. Word statistics are array expressions over one row, so no text is shuffled.
The documents are then counted by vote pattern (at most 3**7 patterns, however many documents there are), and each EM
step is one aggregate over that table; the driver only carries the parameters, three numbers a rule, into the next step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import body, stored, words

#: Fixed values of the contract.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Rules: a share of the document, the value up to which the rule votes for quality, and the value from which it votes
#: against. Between the two, and where the share has no denominator, the rule abstains. Rules that only know a defect
#: have no value for quality: not seeing the defect is no vote.
RULES: dict[str, tuple[str, float | None, float]] = {
    "symbols": ("n_symbols / nullif(n_words, 0)", 0.05, 0.2),
    "not_letters": ("1 - n_letters / nullif(word_chars, 0)", 0.08, 0.14),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", None, 0.3),
    "same_lines": ("n_dup_lines / nullif(n_lines, 0)", None, 0.3),
    "capitals": ("n_capitals / nullif(n_letters, 0)", None, 0.6),
    "shouts": ("n_shouts / nullif(n_words, 0)", None, 0.3),
    "word_length": ("abs(word_chars / nullif(n_words, 0) - 5.5)", None, 6.0),
}

#: EM steps, and the pseudo-votes that keep a rule's accuracies off 0 and 1: (right, wrong) for either class.
STEPS = 12
PSEUDO = (8.0, 2.0)
START = 0.8


def bound_to(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice: windows are sorted with their starts, equal neighbours
    are kept, and each start adds the words that the start before it has not covered."""

    def repeated(ordered: Column) -> Column:
        found = F.filter(
            ordered, lambda a, j: (F.get(ordered, j - 1)["g"] == a["g"]) | (F.get(ordered, j + 1)["g"] == a["g"])
        )
        return F.array_sort(F.transform(found, lambda a: a["i"]))

    def covered(starts: Column) -> Column:
        new = F.transform(starts, lambda s, j: F.least(F.lit(3), s - F.coalesce(F.get(starts, j - 1), s - 3)))
        return F.aggregate(new, F.lit(0).cast("long"), lambda total, n: total + n)

    windows = F.transform(
        window_starts(w),
        lambda a, i: F.struct(F.concat_ws(" ", a, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
    )
    return bound_to(bound_to(F.sort_array(windows), repeated), covered)


def window_starts(w: Column) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document; all zero for a null or blank text.

    Window hashes tell most texts apart from those with a repeated window, and only the latter compare the windows.
    """
    text = F.col("body")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    w, hashes = F.col("w"), F.col("hashes")
    same = F.exists(F.transform(hashes, lambda h, j: h == F.get(hashes, j - 1)), lambda x: F.coalesce(x, F.lit(False)))
    return (
        docs.select("doc_id", body().alias("body"))
        .select("doc_id", "body", words(text).alias("w"))
        .select(
            "*",
            F.sort_array(
                F.transform(window_starts(w), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
            ).alias("hashes"),
        )
        .select(
            "doc_id",
            F.size(w).cast("long").alias("n_words"),
            (F.length(text) - count(r"[\x20\x09-\x0D]")).alias("word_chars"),
            count(SYMBOLS).alias("n_symbols"),
            bound_to(lines, lambda own: F.struct(F.size(own).alias("n"), F.size(F.array_distinct(own)).alias("m"))).alias("l"),
            F.when(same, repeat_words(w)).otherwise(0).alias("n_repeat_words"),
            count(r"[^\p{L}\x20\x09-\x0D]").alias("n_others"),
            count(r"\p{Lu}").alias("n_capitals"),
            count(r"!").alias("n_shouts"),
        )
        .select(
            "*",
            (F.col("word_chars") - F.col("n_others")).alias("n_letters"),
            F.col("l.n").cast("long").alias("n_lines"),
            (F.col("l.n") - F.col("l.m")).cast("long").alias("n_dup_lines"),
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def votes() -> dict[str, Column]:
    """1 for quality, 0 against, null for an abstention."""

    def vote(share: str, good: float | None, bad: float) -> Column:
        value = F.expr(share)
        return F.when(value <= F.lit(good).cast("double"), 1).when(value >= bad, 0)

    return {name: vote(*rule) for name, rule in RULES.items()}


@dataclass(frozen=True)
class Parameters:
    """Share of good documents; per rule P(vote 1 | good) and P(vote 0 | bad), abstentions left out."""

    prior: float
    good: dict[str, float]
    bad: dict[str, float]

    def posterior(self) -> Column:
        """Probability that a document is good, given its vote columns. Without a vote it is the prior."""

        def evidence(name: str) -> Column:
            g, b = self.good[name], self.bad[name]
            ratio = F.when(F.col(name) == 1, F.lit(g / (1 - b))).when(F.col(name) == 0, F.lit((1 - g) / b))
            return F.coalesce(F.log(ratio), F.lit(0.0))

        odds = reduce(lambda a, b: a + b, (evidence(n) for n in RULES), F.log(F.lit(self.prior / (1 - self.prior))))
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame) -> Parameters:
    """EM over vote patterns with their number ``n``. No documents: the starting values."""
    now = Parameters(START, dict.fromkeys(RULES, START), dict.fromkeys(RULES, START))
    right, wrong = PSEUDO
    for _ in range(STEPS):
        weighted = patterns.withColumn("p", now.posterior())
        good, bad = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(good).alias("good"), F.sum("n").alias("all")]
        for name in RULES:
            sums += [
                F.sum(F.when(F.col(name) == 1, good)).alias(f"{name}_g1"),
                F.sum(F.when(F.col(name) == 0, good)).alias(f"{name}_g0"),
                F.sum(F.when(F.col(name) == 1, bad)).alias(f"{name}_b1"),
                F.sum(F.when(F.col(name) == 0, bad)).alias(f"{name}_b0"),
            ]
        row = {k: float(v or 0.0) for k, v in weighted.agg(*sums).first().asDict().items()}
        share = lambda hit, miss: (row[hit] + right) / (row[hit] + row[miss] + right + wrong)  # noqa: B023, E731
        now = Parameters(
            (row["good"] + right) / (row["all"] + right + wrong),
            {n: share(f"{n}_g1", f"{n}_g0") for n in RULES},
            {n: share(f"{n}_b0", f"{n}_b1") for n in RULES},
        )
    return now


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts, base_failed, votes as columns vote_*, quality (posterior) and kept.

    Counts are exact; the parameters come from all documents that pass the base, as only those are decided by them.
    """
    counts = stored(statistics(docs), "statistics")
    voted = counts.select("*", base_failed().alias("base_failed"), *(v.alias(k) for k, v in votes().items()))
    patterns = stored(voted.where(~F.col("base_failed")).groupBy(*RULES).agg(F.count("*").alias("n")), "patterns")
    quality = estimate(patterns).posterior()
    return voted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (quality >= 0.5)).alias("kept"),
        quality.alias("quality"),
        *(F.col(name).alias(f"vote_{name}") for name in RULES),
    )
