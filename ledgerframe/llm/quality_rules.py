"""Quality of documents by weak supervision, in DataFrame and SQL expressions only.

Rules over counts of a whole text vote good (1) or bad (-1) or abstain (0). Most look for one
fault and have no opinion where it is missing, so that silence is no praise. The votes of all
documents are counted by pattern, at most 3^rules rows. Expectation maximisation on those counts
estimates every rule's accuracy, how often a vote of its is right, and the share of good
documents. A document's quality is its posterior probability of being good.

Defined results: a null or empty text has no words, fails the base and is not kept. Ties at the
threshold are kept. Repeated rows are judged alike. An empty table gives an empty result, and
weights that come from the starting values alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\f\r]"
MIN_WORDS = 50
#: Mean characters of a word outside of which it is bad.
WORD_CHARS = (2.0, 16.0)
RULES = ["symbols", "exclaimed", "shouted", "repeated", "same_lines", "short", "word_size", "marks", "monotonous", "plain"]
THRESHOLD = 0.5


def _bound(frame: DataFrame, **values: Column) -> DataFrame:
    """Columns that are computed once per row, however often expressions above use them."""
    return frame.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """The documents (all columns, or those to keep) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_exclaimed and n_shouted; columns of those names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaimed", "n_shouted"]
    kept = [c for c in keep or docs.columns if c.lower() not in names]
    held = docs.select(F.struct(*kept).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    trimmed = F.expr(r"btrim(_text, ' \t\n\u000B\u000C\r')")
    split = _bound(
        held,
        _words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS + "+")),
        _lines=F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]")),
    )
    sized = _bound(split, _n=F.size("_words"), _mask=F.expr("shiftleft(1L, coalesce(cast(ceil(log2(greatest(size(_words), 2))) as int), 1)) - 1"))
    # hash of each window with its place in the low bits: one sort of numbers brings equal windows together
    windows = _bound(
        sized,
        _windows=F.expr(
            """sort_array(if(_n < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(_n, 3) - 3),
               i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & ~_mask) | cast(i as bigint))))"""
        ),
    )
    found = _bound(
        windows,
        _repeats=F.expr(
            f"""sort_array(transform(filter(_windows, (x, k) ->
                coalesce(k > 0 and {_same("x", "_windows[k - 1]")}, false)
                or coalesce(k < size(_windows) - 1 and {_same("x", "_windows[k + 1]")}, false)), x -> x & _mask))"""
        ),
    )
    return found.select(
        "_doc.*",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # words that a repeated window covers and the one before it doesn't
        F.expr(
            """aggregate(_repeats, named_struct('last', -3L, 'n', 0L),
               (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)), a -> a.n)"""
        ).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclaimed"),
        F.regexp_count("_text", F.lit(r"\p{Lu}{3,}")).cast("long").alias("n_shouted"),
    )


def _same(x: str, y: str) -> str:
    """Whether two entries of ``_windows`` stand for the same three words."""
    words = " and ".join(f"_words[cast({x} & _mask as int) + {d}] = _words[cast({y} & _mask as int) + {d}]" for d in range(3))
    return f"(({x} ^ {y}) & ~_mask) = 0 and {words}"


def votes() -> dict[str, Column]:
    """Every rule's vote on a row of ``counted``, by the names in ``RULES``."""

    def share(part: Column, whole: str = "n_words") -> Column:
        return part / F.greatest(F.col(whole), F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        said = F.when(bad, -1)
        return (said if good is None else said.when(good, 1)).otherwise(0)

    marks = share(F.col("n_symbols") + F.col("n_exclaimed"))
    repeated = share(F.col("n_repeat_words"))
    return {
        "symbols": vote(share(F.col("n_symbols")) > 0.2),
        "exclaimed": vote(share(F.col("n_exclaimed")) > 0.25),
        "shouted": vote(share(F.col("n_shouted")) > 0.4),
        "repeated": vote(repeated > 0.3),
        "same_lines": vote(share(F.col("n_dup_lines"), "n_lines") > 0.5),
        "short": vote(F.col("n_words") < MIN_WORDS),
        "word_size": vote(~share(F.col("word_chars")).between(*WORD_CHARS)),
        "marks": vote(marks > 0.25),
        "monotonous": vote(repeated > 0.4),
        "plain": vote(F.lit(False), (marks <= 0.05) & (repeated <= 0.2)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Weights:
    """prior: share of good documents; accuracies: how often each rule's votes are right."""

    prior: float
    accuracies: tuple[float, ...]

    def odds(self) -> list[float]:
        """What a good vote of each rule adds to the log odds of a good document."""
        return [math.log(a / (1 - a)) for a in self.accuracies]


def posterior_of(weights: Weights, pattern: tuple[int, ...]) -> float:
    total = math.log(weights.prior / (1 - weights.prior)) + sum(o * v for o, v in zip(weights.odds(), pattern, strict=True))
    return 1 / (1 + math.exp(-total))


#: What is believed before any data, and the votes that the belief is worth; accuracies stay
#: within bounds, so that a rule can't turn into its contrary or outvote all others.
PRIOR, ACCURACY, BELIEF_VOTES, BOUNDS = 0.8, 0.9, 10.0, (0.55, 0.99)


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 60) -> Weights:
    """Expectation maximisation over vote patterns and their counts."""
    weights = Weights(PRIOR, (ACCURACY,) * rules)
    for _ in range(rounds):
        good_docs, docs = PRIOR * BELIEF_VOTES, BELIEF_VOTES
        right, given = [ACCURACY * BELIEF_VOTES] * rules, [BELIEF_VOTES] * rules
        for pattern, n in patterns.items():
            good = posterior_of(weights, pattern)
            good_docs, docs = good_docs + n * good, docs + n
            for rule, vote in enumerate(pattern):
                if vote:
                    given[rule] += n
                    right[rule] += n * (good if vote > 0 else 1 - good)
        low, high = BOUNDS
        weights = Weights(good_docs / docs, tuple(min(high, max(low, r / g)) for r, g in zip(right, given, strict=True)))
    return weights


def fit(judged: DataFrame) -> Weights:
    """Weights from a frame that has one column per rule, named as in ``RULES``."""
    rows = judged.groupBy(*RULES).count().collect()  # at most 3 ** len(RULES) rows
    return estimate({tuple(r[rule] for rule in RULES): r["count"] for r in rows}, len(RULES))


def posterior(weights: Weights) -> Column:
    """The probability of being good, from the columns of the rules."""
    total = F.lit(math.log(weights.prior / (1 - weights.prior)))
    for rule, odds in zip(RULES, weights.odds(), strict=True):
        total = total + F.col(rule) * F.lit(odds)
    return 1 / (1 + F.exp(-total))
