"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a text's features and votes good (1), bad (-1), or abstains (0). How often a rule votes which way on good
and on bad texts isn't given but estimated: expectation-maximisation over the counts of vote patterns (at most ``3 ** rules``
of them, whatever the corpus) alternates between the posterior of each pattern and the rules' vote rates. A text is kept when
its posterior probability of being good is 0.5 or more, so that one stray rule doesn't reject it.

Base features, on words ``[^\\x20\\x09-\\x0D]+`` of the whole text: n_words; word_chars; n_symbols; n_dup_lines; and
n_repeat_words, the words inside 8-word windows that occur twice or more in the text.

Defined results: a null or empty text has no words, every count is 0, and it fails the base rules; repeated rows get equal
results; a table without rows gives none; other columns pass through, and a clashing name of theirs stays as it is while the
added column takes an underscore at its end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import free_name, saved, words

#: Words of a window in which repetition counts.
WINDOW = 8
#: Rounds of expectation-maximisation, and the start: the share of good texts, and how often a rule votes bad, abstains and
#: votes good on texts of either class. Each rule sees one kind of bad text, so on bad texts most rules still vote good; what
#: tells the classes apart at first is that a bad vote is rare on good texts.
ROUNDS, GOOD_SHARE = 12, 0.8
START = {"good": (0.01, 0.14, 0.85), "bad": (0.2, 0.1, 0.7)}
#: Pseudo-counts in each rate, which keep rates off 0 and 1 and tie them to the start while a corpus is small.
PRIOR = 20.0

#: Each rule: name, when it votes bad, when it votes good, over the features f; a rule whose two conditions fail abstains.
RULES = (
    ("symbols", lambda f: f["n_symbols"] * 10 > f["n_words"], lambda f: f["n_symbols"] * 50 <= f["n_words"]),
    ("many_symbols", lambda f: f["n_symbols"] * 4 > f["n_words"], lambda f: f["n_symbols"] * 100 <= f["n_words"]),
    ("repeats", lambda f: f["n_repeat_words"] * 5 > f["n_words"], lambda f: f["n_repeat_words"] * 20 <= f["n_words"]),
    ("capitals", lambda f: f["n_upper"] * 2 > f["n_letters"], lambda f: f["n_upper"] * 5 <= f["n_letters"]),
    ("marks", lambda f: f["n_exclaims"] * 5 > f["n_words"], lambda f: f["n_exclaims"] * 20 <= f["n_words"]),
    ("dup_lines", lambda f: f["n_dup_lines"] * 2 > f["n_lines"], lambda f: f["n_dup_lines"] == 0),
    ("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"]), lambda f: f["word_chars"].between(3 * f["n_words"], 12 * f["n_words"])),
    ("letters", lambda f: f["n_letters"] * 2 < f["word_chars"], lambda f: f["n_letters"] * 10 >= f["word_chars"] * 8),
)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: it is the only element of an array that a lambda goes over."""
    return F.transform(F.array(value), use)[0]


def _removed(text: Column, pattern: str) -> Column:
    """How many code points of ``text`` match ``pattern``, a set of single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(found: Column) -> Column:
    """Words inside windows that occur twice or more among the words of one text.

    The hashes of the windows are sorted with their positions; equal neighbours mark repeats, and the marked positions in
    order add the words that each covers first.
    """
    n = F.size(found) - WINDOW + 1

    def covered(pairs: Column) -> Column:
        def same(p: Column, j: Column) -> Column:
            return F.coalesce(p["h"] == F.get(pairs, j)["h"], F.lit(False))

        marked = F.filter(pairs, lambda p, i: same(p, i - 1) | same(p, i + 1))
        starts = F.array_sort(F.transform(marked, lambda p: p["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    def counted(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_bound(pairs, covered))

    hashes = _bound(found, lambda w: F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    return F.when(n < 2, F.lit(0)).otherwise(_bound(hashes, counted)).cast("long")


def features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base features and those that only the rules use, and the name that each feature has."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    found = free_name(docs, "found_words")
    out = docs.withColumn(found, words(F.col(text)))
    names: dict[str, str] = {}
    made = {
        "n_words": F.size(found).cast("long"),
        "word_chars": (F.length(body) - _removed(body, r"[\x20\x09-\x0D]")).cast("long"),
        "n_symbols": _removed(body, r"[#*$%&|<>]").cast("long"),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col(found)),
        "n_lines": F.size(lines).cast("long"),
        "n_letters": _removed(body, r"\p{L}").cast("long"),
        "n_upper": _removed(body, r"\p{Lu}").cast("long"),
        "n_exclaims": _removed(body, "!").cast("long"),
    }
    columns = []
    for name, column in made.items():
        names[name] = free_name(docs, name)
        columns.append(column.alias(names[name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *columns), names


def votes(featured: DataFrame, names: dict[str, str]) -> Column:
    """The pattern of a row: a digit for each rule, 0 bad, 1 abstains, 2 good."""
    f = {name: featured[own] for name, own in names.items()}
    return F.concat(*[F.when(bad(f), "0").when(good(f), "2").otherwise("1") for _, bad, good in RULES])


def posterior(pattern: Column, model: dict) -> Column:
    """The probability that a row with this vote pattern is good."""
    def log_likelihood(kind: str) -> Column:
        total = F.lit(0.0)
        for k, rates in enumerate(model[kind]):
            vote = F.substring(pattern, k + 1, 1)
            total = total + F.when(vote == "0", F.lit(math.log(rates[0]))).when(vote == "1", F.lit(math.log(rates[1]))).otherwise(F.lit(math.log(rates[2])))
        return total

    odds = F.lit(math.log((1 - model["share"]) / model["share"])) + log_likelihood("bad") - log_likelihood("good")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(odds))


def fit(patterns: DataFrame) -> dict:
    """The model that expectation-maximisation finds over (pattern, n): counts of vote patterns over the whole corpus.

    There are at most ``3 ** len(RULES)`` patterns however large the corpus, so they fit one array; the rounds go over it inside
    one expression, and only the model (a share and the vote rates) comes to the driver.
    """
    digits = F.transform(F.sequence(F.lit(1), F.lit(len(RULES))), lambda i: F.col("pattern").substr(i, F.lit(1)).cast("int"))
    counted = patterns.select(digits.alias("v"), F.col("n").cast("double").alias("n"))
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    rates = lambda first: F.array(*[array(first)] * len(RULES))
    start = F.struct(F.lit(float(GOOD_SHARE)).alias("share"), *[rates(first).alias(kind) for kind, first in START.items()])
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))

    def likelihood(rates: Column, v: Column) -> Column:
        return total(F.transform(v, lambda d, k: F.ln(F.get(F.get(rates, k), d))), lambda x: x)

    def weighed(model: Column, p: Column) -> Column:
        odds = F.ln((F.lit(1.0) - model["share"]) / model["share"]) + likelihood(model["bad"], p["v"]) - likelihood(model["good"], p["v"])
        return _bound(F.lit(1.0) / (F.lit(1.0) + F.exp(odds)), lambda good: F.struct(p["v"].alias("v"), (good * p["n"]).alias("good"), ((F.lit(1.0) - good) * p["n"]).alias("bad")))

    def estimated(found: Column, kind: str) -> Column:
        def rate(k: Column, vote: int) -> Column:
            return total(found, lambda x: F.when(F.get(x["v"], k) == vote, x[kind]).otherwise(0.0)) + F.lit(PRIOR * START[kind][vote])

        every = F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda k: F.array(*[rate(k, vote) for vote in range(3)]))
        return _bound(total(found, lambda x: x[kind]), lambda n: F.transform(every, lambda r: F.transform(r, lambda x: x / (n + F.lit(PRIOR)))))

    def step(model: Column) -> Column:
        def again(found: Column) -> Column:
            good, bad = (total(found, lambda x, kind=kind: x[kind]) for kind in ("good", "bad"))
            share = (good + F.lit(PRIOR * GOOD_SHARE)) / (good + bad + F.lit(PRIOR))
            return F.struct(share.alias("share"), *[estimated(found, kind).alias(kind) for kind in START])

        return _bound(F.transform(F.col("patterns"), lambda p: weighed(model, p)), again)

    gathered = counted.agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("patterns"))
    rounds = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda model, i: step(model))
    got = gathered.select(rounds.alias("model")).first()["model"]
    return {"share": got["share"]} | {kind: [tuple(r) for r in got[kind]] for kind in START}


def base_failed(names: dict[str, str]) -> Column:
    n, repeated = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (n < 20) | (F.lit(100) * repeated > F.lit(30) * n)


def judged(featured: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows with features, plus p_good, base_failed and kept. The vote patterns are counted over all rows first."""
    p, failed, kept, pattern = (free_name(featured, c) for c in ("p_good", "base_failed", "kept", "pattern"))
    voted = featured.withColumn(pattern, votes(featured, names))
    counts = saved(voted.groupBy(F.col(pattern).alias("pattern")).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    # A pattern's posterior is worked out once, and found by the pattern: the table has 3 ** len(RULES) rows at most.
    graded = counts.select(F.col("pattern").alias(pattern), posterior(F.col("pattern"), fit(counts)).alias(p))
    out = voted.join(F.broadcast(graded), pattern).drop(pattern).withColumn(failed, base_failed(names))
    return out.withColumn(kept, ~F.col(failed) & (F.col(p) >= 0.5))
