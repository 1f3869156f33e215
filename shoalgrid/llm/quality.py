"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import words, written

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: name: (metric, good at or below, bad above); otherwise, or where the limit is None, the rule abstains.
RULES: Mapping[str, tuple[str, float | None, float | None]] = {
    "prose": ("far_from_prose", 1.0, None),
    "symbols": ("symbol_rate", None, 0.15),
    "shouting": ("upper_rate", None, 0.4),
    "exclaiming": ("exclaim_rate", None, 0.2),
    "stuttering": ("stutter_rate", None, 0.15),
    "repeating": ("repeat_rate", None, 0.5),
    "lines": ("dup_line_rate", None, 0.5),
    "word_length": ("word_length", None, 16.0),
    "unpunctuated": ("words_per_stop", None, 250.0),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sorted_windows(w: Column, width: int) -> Column:
    """Sorted longs of all windows of ``width`` words: the window's hash above its place in as many bits as places need."""
    n = F.size(w)
    places = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    bits = F.length(F.bin(n.cast("long")))
    return F.sort_array(
        F.transform(
            places,
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
            .bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), bits))
            .bitwiseOR(i.cast("long")),
        )
    )


def _covered(places: Column, width: int) -> Column:
    """How many words the windows at ``places`` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (width - 1))))))


def _repeated_words(w: Column, sorted_windows: Column, width: int) -> Column:
    """Number of words in windows that ``w`` has twice or more.

    Windows of one hash stand side by side in ``sorted_windows``; their words are compared. Where two neighbours of
    one hash have different words, the windows themselves are sorted instead.
    """
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def one_hash(x: Column, y: Column) -> Column:
        return F.coalesce(F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0, F.lit(False))

    def one_text(x: Column, y: Column) -> Column:
        p, q = (z.bitwiseAND(low).cast("int") for z in (x, y))
        return reduce(lambda a, b: a & b, [F.get(w, p + k) == F.get(w, q + k) for k in range(width)])

    def by_hash(s: Column) -> Column:
        hits = F.filter(s, lambda x, i: one_hash(x, F.get(s, i + 1)) | one_hash(x, F.get(s, i - 1)))
        return F.when(
            F.exists(F.filter(s, lambda x, i: one_hash(x, F.get(s, i + 1)) & ~one_text(x, F.get(s, i + 1))), lambda x: F.lit(True)),
            _let(F.sort_array(F.transform(F.sequence(F.lit(0), n - width), window)), by_words),
        ).otherwise(_covered(F.transform(hits, lambda x: x.bitwiseAND(low)), width))

    def window(i: Column) -> Column:
        return F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("words"), i.cast("long").alias("at"))

    def by_words(s: Column) -> Column:
        def twin(x: Column, y: Column) -> Column:
            return F.coalesce(x["words"] == y["words"], F.lit(False))

        hits = F.filter(s, lambda x, i: twin(x, F.get(s, i + 1)) | twin(x, F.get(s, i - 1)))
        return _covered(F.transform(hits, lambda x: x["at"]), width)

    return F.when(n < width + 1, F.lit(0)).otherwise(_let(sorted_windows, by_hash)).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per document the base columns and the counts behind the rules, from the whole text (null: none).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_upper, n_letters,
    n_exclaim, n_stutter (words equal to the one before), n_stops (words that end in . ! or ?), n_lines (with a word).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.withColumn("w", words(F.col("text")))
    base = base.withColumn("sorted_windows", _sorted_windows(F.col("w"), width))
    w, n = F.col("w"), F.size("w")

    def chars(pattern_less: str) -> Column:
        return F.length("text") - F.length(F.translate("text", pattern_less, ""))

    blank = r"^[\x20\x09-\x0D]*\z"
    lines = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(blank))
    upper = F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))
    lower = F.length("text") - F.length(F.regexp_replace("text", r"\p{Ll}+", ""))
    rows = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        chars("#*$%&|<>").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(w, F.col("sorted_windows"), width).alias("n_repeat_words"),
        upper.alias("n_upper"),
        (upper + lower).alias("n_letters"),
        F.regexp_count("text", F.lit("!+")).alias("n_exclaim"),
        F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).alias("n_stutter"),
        F.regexp_count("text", F.lit(r"[.!?](?=\s|$)")).alias("n_stops"),
        F.size(lines).alias("n_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _votes(rules: Mapping[str, tuple[str, float | None, float | None]]) -> list[Column]:
    """A column per rule: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    metrics = {
        "symbol_rate": F.col("n_symbols") / n,
        "upper_rate": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "exclaim_rate": F.col("n_exclaim") / n,
        "stutter_rate": F.col("n_stutter") / n,
        "repeat_rate": F.col("n_repeat_words") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "word_length": F.col("word_chars") / n,
        "words_per_stop": n / F.greatest(F.col("n_stops"), F.lit(1)),
    }
    prose = {"symbol_rate": 0.05, "upper_rate": 0.15, "exclaim_rate": 0.05, "stutter_rate": 0.05, "repeat_rate": 0.3, "words_per_stop": 60.0}
    metrics["far_from_prose"] = F.greatest(*[metrics[m] / F.lit(most) for m, most in prose.items()])
    none = F.lit(False)
    return [
        F.when(F.col("n_words") == 0, 0)
        .when(none if bad is None else metrics[m] > bad, -1)
        .when(none if good is None else metrics[m] <= good, 1)
        .otherwise(0)
        .alias(name)
        for name, (m, good, bad) in rules.items()
    ]


def fit_rules(
    patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 1000, prior: float = 0.85, trust: float = 20.0, settled: float = 1e-7
) -> tuple[float, list[dict[int, float]]]:
    """EM for a two-class model with independent rules, from counts of vote patterns, until no estimate moves by ``settled``.

    A class has its probability, and each rule its probabilities of voting good, bad or abstaining in each class. The
    estimates are the most probable ones under a Dirichlet prior that counts as ``trust`` documents of rules that
    seldom vote against the truth; without it the two classes could change places. Returns the log odds of the prior
    and, per rule, the log likelihood ratio of each vote and of abstaining.
    """
    if not patterns:
        return math.log(prior / (1 - prior)), []
    k = len(patterns[0][0])
    votes = (-1, 0, 1)
    start = {
        1: [{-1: 0.01, 0: 0.14, 1: 0.85}, {-1: 0.01, 0: 0.84, 1: 0.15}],
        -1: [{-1: 0.02, 0: 0.97, 1: 0.01}, {-1: 0.25, 0: 0.74, 1: 0.01}],
        0: [{-1: 0.02, 0: 0.38, 1: 0.6}, {-1: 0.25, 0: 0.6, 1: 0.15}],
    }
    begin = [start[sum({v[j] for v, _ in patterns} - {0})] for j in range(k)]

    def ratios(like: list) -> list[dict[int, float]]:
        return [{v: math.log(g[v] / b[v]) for v in votes} for g, b in like]

    found = ratios(begin)
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        sums = [[{v: trust * p for v, p in side.items()} for side in pair] for pair in begin]
        good = 0.0
        for vote, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(found[j][v] for j, v in enumerate(vote))
            p = 1 / (1 + math.exp(-max(-500, min(500, odds))))
            good += p * n
            for j, v in enumerate(vote):
                sums[j][0][v] += p * n
                sums[j][1][v] += (1 - p) * n
        old = [math.log(prior / (1 - prior)), *(x for r in found for x in r.values())]
        prior = min(0.999, max(0.5, (good + 1) / (total + 2)))
        found = ratios([[{v: s[v] / sum(s.values()) for v in votes} for s in pair] for pair in sums])
        new = [math.log(prior / (1 - prior)), *(x for r in found for x in r.values())]
        if max(abs(x - y) for x, y in zip(old, new)) < settled:
            break
    return math.log(prior / (1 - prior)), found


def judge(
    docs: DataFrame,
    rules: Mapping[str, tuple[str, float | None, float | None]] = RULES,
    least: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base columns of ``measured``, the rules' posterior probability of good quality, and ``kept``.

    Rules vote on measured rates or abstain. How often each vote comes with good and with bad documents is
    estimated by expectation-maximisation over the counts of all vote patterns (3 to the number of rules at most,
    however many documents there are). The posterior is that given the votes cast: what a rule that abstains might have
    said is summed out, so a document on which all abstain has the prior. ``kept`` needs a posterior of ``least`` and no ``base_failed``.

    Null and empty texts have no words and fail; equal rows are judged alike; null ids and other columns make no
    difference; an empty table gives no rows.
    """
    rows = written(measured(docs, id_col, text_col).select("*", *_votes(rules)), "quality")
    names = list(rules)
    counts = rows.filter("n_words > 0").groupBy(*names).count().collect()
    prior, ratios = fit_rules([(tuple(r[x] for x in names), r["count"]) for r in counts])
    odds = F.lit(prior)
    for name, r in zip(names, ratios, strict=False):
        odds = odds + F.when(F.col(name) == 1, r[1]).when(F.col(name) == -1, r[-1]).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-odds))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        p.alias("quality"), (~F.col("base_failed") & (p >= least)).alias("kept"),
    )
