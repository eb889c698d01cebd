"""Quality by weak supervision: rules vote, and their accuracies are estimated.

Each rule votes good (1), bad (-1) or abstains (0). Documents with the same votes are
counted together over the whole table. Expectation-maximisation over these counts
estimates how often good and bad documents get each vote of each rule, and the share of
good documents; no labels are used. A document's quality is the posterior probability
that it is good, so one rule alone neither keeps nor rejects it.

Everything is DataFrame code: the counts are one aggregate, and the rounds of the
estimation are a fold over the array of vote patterns, whose number is at most three
to the power of the number of rules, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.expressions import bind, neighbours, unused, window_hashes, words
from partloom.llm.storage import written

REPEAT_WINDOW = 8
ROUNDS = 40
# What a vote can weigh in log odds: one against always speaks against, one for speaks
# for, and none is certain.
AGAINST = (-6.0, -1.0)
FOR = (0.02, 2.0)
LEAST_SHARE, MOST_SHARE = 0.05, 0.95
# Where the estimation starts: log odds of a good document, and of the two votes.
START_BIAS, START_AGAINST, START_FOR = 1.4, -3.0, 0.4

# Frequent function words of the corpus languages (fixed values).
FUNCTION_WORDS = (
    "the and of to in a is that it for on with as are was this be by from "
    "der die das und ist nicht mit von zu den ein eine auf für "
    "le la les et de des que un une est pour dans sur "
    "el los las y en por con para no se su del al"
).split()


def _repeated_words(hashes: Column) -> Column:
    """Words in windows of 8 words that are found twice or more in the text."""

    def covered(starts: Column) -> Column:
        gaps = neighbours(starts, 1, lambda a, b: F.least(b - a, F.lit(REPEAT_WINDOW)))
        total = F.aggregate(gaps, F.lit(0), lambda x, y: x + y)
        return F.when(F.size(starts) > 0, total + REPEAT_WINDOW).otherwise(0)

    def starts(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = neighbours(
            placed, 1, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
        )
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))

    return bind(
        window_hashes(hashes, REPEAT_WINDOW),
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            bind(starts(w), covered)
        ),
    )


def measures(documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` and a struct ``m`` of counts over each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    of_words, of_lines, of_hashes = unused(documents.columns, "_words", "_lines", "_hashes")
    lower = F.transform(F.col(of_words), lambda w: F.lower(w))

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(of_words, test)).cast("long")

    known = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return (
        documents.withColumn(of_words, words(F.col("text")))
        .withColumn(of_lines, lines)
        .withColumn(of_hashes, F.transform(of_words, lambda w: F.xxhash64(w)))
        .withColumn(
            "m",
            F.struct(
                F.size(of_words).cast("long").alias("n_words"),
                F.length(F.array_join(of_words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(of_lines) - F.size(F.array_distinct(of_lines)))
                .cast("long")
                .alias("n_dup_lines"),
                _repeated_words(F.col(of_hashes)).cast("long").alias("n_repeat_words"),
                F.size(of_lines).cast("long").alias("n_lines"),
                F.size(F.array_distinct(of_hashes)).cast("long").alias("n_distinct"),
                F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
                F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_bangs"),
                F.size(F.array_intersect(known, lower)).cast("long").alias("n_function"),
                count(lambda w: w.rlike(r"[#*$%&|<>]")).alias("n_marked"),
                count(lambda w: ~w.rlike(r"\p{L}")).alias("n_letterless"),
                count(lambda w: F.right(w, F.lit(1)).isin(".", "?", "!")).alias("n_ends"),
            ),
        )
        .drop(of_words, of_lines, of_hashes)
    )


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the measures: a vote against, a vote for, else an abstention."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 30", "n_words >= 60"),
    Rule("symbols", "n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    Rule("lines", "n_dup_lines * 10 >= n_lines * 3", "n_dup_lines * 20 <= n_lines"),
    Rule("repeats", "n_repeat_words * 5 > n_words", "n_repeat_words * 20 <= n_words"),
    Rule(
        "word_length",
        "word_chars < n_words * 2 OR word_chars > n_words * 12",
        "word_chars >= n_words * 3 AND word_chars <= n_words * 9",
    ),
    Rule("capitals", "n_capitals * 3 > word_chars", "n_capitals * 6 <= word_chars"),
    Rule("bangs", "n_bangs * 5 > n_words", "n_bangs * 50 <= n_words"),
    Rule(
        "function_words",
        "n_function = 0 AND n_words >= 20",
        "n_function >= 3 OR n_function * 15 >= n_words AND n_function > 0",
    ),
    Rule("marked_words", "n_marked * 5 > n_words", "n_marked * 50 <= n_words"),
    Rule("letterless", "n_letterless * 5 > n_words", "n_letterless * 20 <= n_words"),
    Rule("sentences", "n_ends * 40 < n_words AND n_words >= 40", "n_ends * 30 >= n_words"),
    Rule(
        "vocabulary",
        "n_distinct * 4 < n_words AND n_words < 2000",
        "n_distinct * 3 >= n_words",
    ),
)


def _vote(rule: Rule, of: str) -> Column:
    def condition(text: str) -> Column:
        for name in sorted(MEASURES, key=len, reverse=True):
            text = text.replace(name, f"{of}.{name}")
        return F.expr(text)

    return F.when(condition(rule.bad), -1).when(condition(rule.good), 1).otherwise(0)


MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_capitals "
    "n_bangs n_function n_marked n_letterless n_ends"
).split()


def votes(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the array ``votes``, one entry a rule."""
    return measured.withColumn("votes", F.array(*[_vote(r, "m") for r in rules]))


def _posterior(cast: Column, model: Column) -> Column:
    weighed = F.zip_with(
        cast,
        model["weights"],
        lambda v, w: F.when(v < 0, w["against"]).when(v > 0, w["for"]).otherwise(0.0),
    )
    return 1 / (1 + F.exp(-F.aggregate(weighed, model["bias"], lambda x, y: x + y)))


def _between(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def estimate(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS):
    """The bias and the weights of each rule's votes, by expectation-maximisation.

    Returns a row (bias, weights). A weight is the log of how much likelier a good
    document is to get the vote than a bad one; an abstention weighs nothing. An empty
    table keeps the start.
    """
    counts = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    patterns = counts.agg(
        F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"),
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"),
    )
    first = F.struct(F.lit(START_AGAINST).alias("against"), F.lit(START_FOR).alias("for"))
    start = F.struct(
        F.lit(START_BIAS).alias("bias"), F.array_repeat(first, len(rules)).alias("weights")
    )

    def expected(model: Column) -> Column:
        return F.transform(
            "patterns",
            lambda p: F.struct(
                p["votes"].alias("votes"),
                p["n"].alias("n"),
                _posterior(p["votes"], model).alias("q"),
            ),
        )

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda x, p: x + value(p))

    def maximised(rows: Column) -> Column:
        good = total(rows, lambda p: p["n"] * p["q"])
        bad = total(rows, lambda p: p["n"] * (1 - p["q"]))

        def weigh(rule: Column, vote: int, limits: tuple[float, float]) -> Column:
            def has(p: Column) -> Column:
                return F.when(F.get(p["votes"], rule) == vote, p["n"]).otherwise(0.0)

            among_good = (total(rows, lambda p: has(p) * p["q"]) + 0.5) / (good + 1.5)
            among_bad = (total(rows, lambda p: has(p) * (1 - p["q"])) + 0.5) / (bad + 1.5)
            return _between(F.log(among_good / among_bad), *limits)

        share = _between(good / F.col("total"), LEAST_SHARE, MOST_SHARE)
        return F.struct(
            F.log(share / (1 - share)).alias("bias"),
            F.transform(
                F.sequence(F.lit(0), F.lit(len(rules) - 1)),
                lambda rule: F.struct(
                    weigh(rule, -1, AGAINST).alias("against"), weigh(rule, 1, FOR).alias("for")
                ),
            ).alias("weights"),
        )

    fitted = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        start,
        lambda model, _: bind(expected(model), maximised),
    )
    return patterns.select(
        F.when(F.col("total") > 0, fitted).otherwise(start).alias("model")
    ).first()["model"]


def judged(
    documents: DataFrame, rules: tuple[Rule, ...] = RULES, keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``documents``, by default all, the measures ``m``, base_failed,
    posterior, kept.

    Texts are measured once: what is kept, the measures and the votes are written, and both
    the estimate and the verdicts start from there.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows.
    posterior: probability, to six places, that the document is good. kept: not
    base_failed and a posterior of a half or more. Null and blank texts have no words
    and so fail. Repeated rows are counted and returned as often as they come. The
    columns m, votes, base_failed, posterior and kept replace columns of these names.
    """
    taken = ("m", "votes", "base_failed", "posterior", "kept")
    names = [c for c in (documents.columns if keep is None else keep) if c not in taken]
    measured = votes(measures(documents.drop(*taken)), rules)
    voted = written(measured.select(*names, "m", "votes"), "votes")
    model = estimate(voted, rules)
    fitted = F.struct(
        F.lit(model["bias"]).alias("bias"),
        F.array(
            *[
                F.struct(F.lit(w["against"]).alias("against"), F.lit(w["for"]).alias("for"))
                for w in model["weights"]
            ]
        ).alias("weights"),
    )
    failed = (F.col("m.n_words") < 20) | (
        F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 30
    )
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", F.round(_posterior(F.col("votes"), fitted), 6))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
    )
