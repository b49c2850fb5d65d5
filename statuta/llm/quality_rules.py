"""Operator 1: quality rules by weak supervision.

Rules look at counts of a text and vote good (1), bad (0) or abstain (null). Expectation
maximisation over the histogram of vote patterns estimates the share of good documents and
each rule's accuracy; a document is kept by its posterior probability of being good, not by
passing every rule.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, staged, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
ITERATIONS = 12
KEEP_AT = 0.5


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct, n_upper, n_other
    (characters of words that are no letters) of the whole text.

    All in the row: no text and no window is shuffled. Repeated windows are looked for only in
    texts whose window hashes (64 bits) are not all different.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_text"), words(text).alias("_w"))
    df = df.select(
        *keep,
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_v"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _symbols(F.col("_text")).alias("n_symbols"),
        _dup_lines(F.col("_text")).alias("n_dup_lines"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_text", rf"[\p{{L}}\p{{M}}{WS}]+", "")).cast("long").alias("n_other"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("_v") - WINDOW), lambda i: F.xxhash64(*[F.get("_v", i + k) for k in range(WINDOW)]))
    df = df.select(
        *keep, F.size("_v").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.size(F.array_distinct("_v")).cast("long").alias("n_distinct"), "n_upper", "n_other",
        F.when(F.size("_v") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_distinct", "n_upper", "n_other"]
    pairs = F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), F.size("_h") - 1).alias("i")))
    df = df.select(*names, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).alias("_s"))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(F.get("_s", a)["h"] == F.get("_s", b)["h"], F.lit(False))

    hit = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    at = F.flatten(F.transform(hit, lambda j: F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.get("_s", j)["i"] + k)))
    return df.select(*names, F.when(F.col("_s").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(at))).cast("long").alias("n_repeat_words"))


def _symbols(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS]).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WS}]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _vote(bad: Column, good: Column | None = None) -> Column:
    v = F.when(bad, 0)
    return v if good is None else v.when(good, 1)


def rules() -> dict[str, Column]:
    """Each rule's vote from the columns of counts(): 1 good, 0 bad, null abstains. A rule that looks for
    one kind of junk does not speak for the texts without it, unless it sees what junk of another
    kind lacks."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = {c: F.col(c) / n for c in ("n_symbols", "n_repeat_words", "n_distinct", "word_chars")}
    some = F.col("n_words") >= 10
    other = F.col("n_other") / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": _vote(F.col("n_words") < 10),
        "repeats": _vote(share["n_repeat_words"] > 0.15, some & (share["n_repeat_words"] < 0.02)),
        "symbols": _vote(share["n_symbols"] > 0.1, some & (F.col("n_symbols") == 0)),
        "letters": _vote(some & (other > OTHER_BAD), some & (other < OTHER_GOOD)),
        "upper": _vote(some & (F.col("n_upper") > 0.5 * F.col("word_chars"))),
        "word_length": _vote((share["word_chars"] < 2.5) | (share["word_chars"] > 15)),
        "variety": _vote(F.col("n_words").between(20, 500) & (share["n_distinct"] < 0.2), F.col("n_words").between(20, 500) & (share["n_distinct"] > 0.3)),
        "dup_lines": _vote(F.col("n_dup_lines") * 8 > F.col("n_words")),
    }


#: Shares of characters that are no letters, above and below which a text looks poor or good.
OTHER_BAD, OTHER_GOOD = 0.12, 0.05
#: (P(votes bad | bad), P(votes bad | good), P(votes good | good), P(votes good | bad)) of every
#: rule before the data are seen, and how many documents that belief weighs. Nothing else bounds
#: what the data say: a rule may turn out to be wrong more often than right.
START, BELIEF = (0.3, 0.01, 0.8, 0.4), 10.0
Rates = dict[str, tuple[float, float, float, float]]


def posterior(votes: list[str], prior: float, rates: Rates) -> Column:
    """P(good | votes); an abstention says nothing."""

    def side(good: bool) -> Column:
        p = F.lit(prior if good else 1 - prior)
        for v in votes:
            bad_bad, bad_good, good_good, good_bad = rates[v]
            p = p * F.when(F.col(v).isNull(), 1.0).when(F.col(v) == 1, good_good if good else good_bad).otherwise(bad_good if good else bad_bad)
        return p

    return side(True) / (side(True) + side(False))


def fit(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[float, Rates]:
    """Share of good documents and each rule's rates of right and wrong votes, by expectation
    maximisation.

    Works on the histogram of vote patterns, at most 3 ** rules rows whatever the input; each
    step is one aggregation of it by rule and vote. What the last step found stands in the plan
    as one array a side, so all steps have the same small plan, whose code is made once. No
    votes at all give the starting values.
    """
    hist = staged(votes.groupBy(*names).count().coalesce(1), "votes").coalesce(1)
    # place 3 * rule + (0 abstains, 1 bad, 2 good) of each vote; the last place stands for the pattern itself
    every = 3 * len(names)
    hist = hist.select("count", F.array(*[F.coalesce(F.col(f"`{v}`") + 1, F.lit(0)).cast("int") + 3 * k for k, v in enumerate(names)]).alias("at"))
    prior, rates = 0.8, dict.fromkeys(names, START)
    for _ in range(iterations):

        def side(good: bool, prior: float = prior, rates: Rates = rates) -> Column:
            factors = F.lit([x for v in names for x in (1.0, rates[v][1 if good else 0], rates[v][2 if good else 3])])
            return F.aggregate("at", F.lit([prior if good else 1 - prior])[0], lambda p, i: p * F.get(factors, i))

        rows = hist.select("count", "at", side(True).alias("g"), side(False).alias("b"))
        rows = rows.select("count", (F.col("g") / (F.col("g") + F.col("b")) * F.col("count")).alias("good"), F.explode(F.concat("at", F.array(F.lit(every)))).alias("at"))
        sums = {r["at"]: (r["n"], r["good"]) for r in rows.groupBy("at").agg(F.sum("count").alias("n"), F.sum("good").alias("good")).collect()}  # one row a place
        if every not in sums:
            break
        n, good = sums[every]
        was, bad = prior, n - good
        prior, rates = min(0.98, max(0.02, good / n)), {}
        for k, v in enumerate(names):
            (n0, g0), (n1, g1) = (sums.get(3 * k + vote, (0, 0.0)) for vote in (1, 2))
            rate = lambda x, of, start: (x + BELIEF * start) / (of + BELIEF)
            rates[v] = (rate(n0 - g0, bad, START[0]), rate(g0, good, START[1]), rate(g1, good, START[2]), rate(n1 - g1, bad, START[3]))
        if abs(was - prior) < 1e-6:
            break
    return prior, rates


def accuracy(prior: float, rates: Rates) -> dict[str, float]:
    """The share of each rule's votes that are right, by the model."""
    out = {}
    for v, (bb, bg, gg, gb) in rates.items():
        right, wrong = (1 - prior) * bb + prior * gg, prior * bg + (1 - prior) * gb
        out[v] = right / (right + wrong)
    return out


def report(docs: DataFrame, make_rules: Callable[[], dict[str, Column]] = rules) -> tuple[float, dict[str, float]]:
    """The estimated share of good documents, and the accuracy of each rule: what the model found
    about the rules themselves."""
    made = make_rules()
    prior, rates = fit(counts(docs.select("text"), []).select(*[v.alias(k) for k, v in made.items()]), list(made))
    return prior, accuracy(prior, rates)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, keep: list[str], make_rules: Callable[[], dict[str, Column]] = rules) -> DataFrame:
    """keep, the counts, base_failed, quality (posterior) and kept for each row.

    Null and empty texts have no words: they fail the base rule. Repeated rows get equal
    verdicts. An empty table gives an empty result.
    """
    made = make_rules()
    df = staged(counts(docs, keep).withColumns({f"vote_{k}": v for k, v in made.items()}), "rule-counts")
    names = [f"vote_{k}" for k in made]
    df = df.withColumn("quality", posterior(names, *fit(df, names))).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def keep_good(docs: DataFrame, make_rules: Callable[[], dict[str, Column]] = rules) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns, whatever their names.

    Two passes over the texts and no join: the first fits the model on the histogram of votes,
    the second judges every row where it is. Null and empty texts go, as they fail the base
    rule; repeated rows share a verdict; an empty table stays empty.
    """
    made = {f"vote_{k}": v for k, v in make_rules().items()}
    fitted = fit(counts(docs.select("text"), []).select(*[v.alias(k) for k, v in made.items()]), list(made))
    rows = counts(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), ["row"])
    rows = rows.withColumns(made).select("row", (~base_failed() & (posterior(list(made), *fitted) >= KEEP_AT)).alias("good"))
    # a generator, as a filter would be pushed below the counts and compute them once a mention
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("good").cast("int")))).select("row.*")
