"""Quality rules combined by weak supervision, in Spark's own expressions.

Each rule looks at one kind of defect and votes good (1), bad (-1) or abstains (0) in
between; measures of one defect are one rule, so that a defect is counted once. How
often each rule votes good on good documents and bad on bad ones is not known, nor is
the share of good documents. Expectation-maximisation estimates all of them from the
counts of vote patterns (3 ** rules at most, whatever the corpus) of the documents that
pass the base rules, since only these get a verdict from the votes. The estimates
are those of highest posterior probability under Beta priors (``ON_GOOD``,
``ON_BAD``, ``SHARE``), which say that a rule seldom votes bad on a good document and
that a bad document shows few of the defects; they weigh as much as so many documents
and keep rules that hardly vote from drifting. Every pattern then has a posterior
probability of being good, and a document is kept from 0.5 on. An abstention is
no evidence. One reliable rule outweighs several poor ones.

Defined cases: a null text is empty; a text without a word fails the base rules;
equal rows are judged alike, a posterior of exactly 0.5 keeps; an empty input gives
no rows, and where no document passes the base rules the priors alone judge. Three-word
windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import persist_table

WHITE = r"[\x20\x09-\x0D]+"


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # array(x) and [0] bind x once, where a lambda would work it out anew for each element
        twice = F.transform(F.array(pairs), lambda p: F.filter(p, lambda x, k: F.coalesce(
            F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))))[0]
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, i: F.struct(
            (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end")))["n"]

    return F.transform(F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))[0]


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts that the rules vote on, for every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col(key), text.alias("text")).select(
        key, "text", F.filter(F.split("text", WHITE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    return split.select(
        key, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_wordless"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaims"))


def votes() -> dict[str, Column]:
    """The rules: bad where a measure is far off, good where it is as in ordinary text, else no vote."""
    n, c = F.col("n_words"), F.col("word_chars")
    symbols, wordless, lines, upper = F.col("n_symbols"), F.col("n_wordless"), F.col("n_dup_lines"), F.col("n_upper")
    exclaims, repeats = F.col("n_exclaims"), F.col("n_repeat_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "v_length": vote(n < 50, n >= 100),
        "v_word_size": vote((c < 3 * n) | (c > 7 * n), (c >= 4 * n) & (2 * c <= 13 * n)),
        "v_symbols": vote(10 * symbols > n, 100 * symbols <= n),
        "v_wordless": vote(10 * wordless > n, 50 * wordless <= n),
        "v_lines": vote(2 * lines > F.col("n_lines"), 10 * lines <= F.col("n_lines")),
        "v_repetition": vote((3 * repeats > n) | ((n >= 50) & (10 * F.col("n_distinct") < 4 * n)), 10 * repeats <= n),
        "v_shouting": vote((10 * upper > 3 * c) | (5 * exclaims > n), (20 * upper <= 3 * c) & (20 * exclaims <= n)),
    }


#: Beta priors, as documents seen beforehand: voted right and wrong on good ones, on bad ones, and good and bad ones themselves.
ON_GOOD, ON_BAD, SHARE = (98.0, 2.0), (6.0, 14.0), (8.0, 2.0)


@dataclass
class Estimate:
    """Share of good documents; for each rule how often it votes good on good ones and bad on bad ones, given that it votes."""

    share: float
    on_good: list[float]
    on_bad: list[float]

    def ratios(self, rule: int) -> dict[int, float]:
        """What a vote adds to the log odds of being good."""
        g, b = self.on_good[rule], self.on_bad[rule]
        return {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b)}

    def log_odds(self) -> float:
        return math.log(self.share / (1 - self.share))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, turns: int = 1000) -> Estimate:
    """Expectation-maximisation over counted vote patterns, from the priors' means until nothing moves."""
    found = Estimate(SHARE[0] / sum(SHARE), [ON_GOOD[0] / sum(ON_GOOD)] * rules, [ON_BAD[0] / sum(ON_BAD)] * rules)
    for _ in range(turns):
        ratios = [found.ratios(j) for j in range(rules)]
        share, right, voted = list(SHARE), {1: [ON_GOOD[0]] * rules, -1: [ON_BAD[0]] * rules}, {1: [sum(ON_GOOD)] * rules, -1: [sum(ON_BAD)] * rules}
        for pattern, n in patterns:
            odds = found.log_odds() + sum(ratios[j][v] for j, v in enumerate(pattern) if v)
            good = n / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            share[0] += good
            share[1] += n - good
            for j, v in enumerate(pattern):
                if v:
                    voted[1][j] += good
                    voted[-1][j] += n - good
                    right[v][j] += good if v == 1 else n - good
        new = Estimate(share[0] / sum(share), *([r / m for r, m in zip(right[v], voted[v])] for v in (1, -1)))
        moved = max(abs(x - y) for x, y in zip([new.share, *new.on_good, *new.on_bad], [found.share, *found.on_good, *found.on_bad]))
        found = new
        if moved < 1e-10:
            break
    return found


def judge_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, base_failed, kept and the posterior of every document."""
    rules = votes()
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * repeated > 50 * n)
    rows = persist_table(statistics(docs, key).withColumns(rules).withColumn("base_failed", failed), "votes")
    counted = rows.where(~F.col("base_failed")).groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    found = estimate(sorted((tuple(r[v] for v in rules), r["n"]) for r in counted), len(rules))
    odds = F.lit(found.log_odds())
    for j, name in enumerate(rules):
        ratio = found.ratios(j)
        odds = odds + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0))))
    return rows.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
