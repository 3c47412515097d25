"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language: features of the word (its affixes of up to three letters, its padded letter trigrams, its
length class, and the languages in whose lexicon it stands) score every language, learned transitions score neighbours, and
forward-backward gives each word its probabilities, so a text that switches languages is labelled piece by piece. The text's
language is the one with the largest mean probability over its words.

Fitting takes a bounded sample: for each language ``SALTS * PER_SALT`` documents, the first by a hash, and of those its equal
share of ``RUNS`` runs of ``RUN`` words (``LEAST_RUNS`` at least), ``PER_DOC`` of one document at most, so that neither a large
language nor a long text crowds out the others. Every other pair of runs trades its second halves, so that the sample holds
switches of language too. The fit follows the gradient of the log-likelihood: observed less expected features and, from the
pairwise probabilities of forward-backward, observed less expected transitions. The lexicon holds words that the sample has
often and nearly always in one language. Only the texts and languages of the rows that the caller passes are learned from.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no pieces, and so is every text when nothing
was learned; rows with a null language teach nothing; repeated rows get equal results; an empty table gives no rows; other
columns pass through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shared import free_name, words

#: The sample: documents of a language, runs in all and of a language at least, runs of a document at most, words of a run.
SALTS, PER_SALT, RUNS, LEAST_RUNS, PER_DOC, RUN = 32, 16, 12_000, 128, 64, 40
#: Buckets of the hashed features; rounds and step of the fit; the penalty on weights.
BUCKETS, ROUNDS, STEP, RIDGE = 1 << 16, 40, 0.3, 1e-6
#: Times and share of a word in one language that put it into the lexicon.
LEXICON_N, LEXICON_SHARE = 5, 0.95
#: Words whose probabilities are computed at a time, and words whose scores a worker keeps; both bound memory only.
AT_ONCE, KEPT = 1_000_000, 300_000
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]


def letters(token: str) -> str:
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def feature_ids(word: str, lexicon: dict[str, int]) -> list[int]:
    """The buckets of a word's features."""
    padded, n = f"^{word}$", len(word)
    found = [f"p{word[:k]}" for k in (1, 2, 3) if k <= n] + [f"s{word[-k:]}" for k in (1, 2, 3) if k <= n]
    found += [padded[i : i + 3] for i in range(n)]
    found.append(f"n{min(n, 12) // 3}")
    if (language := lexicon.get(word)) is not None:
        found.append(f"lexicon {language}")
    return [zlib.crc32(f.encode()) & (BUCKETS - 1) for f in found]


def marginals(scores: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of each word's labels by forward-backward, many texts side by side.

    ``scores``: words x labels, text after text; ``lengths`` never increase, so the texts that still go on at a step are the
    first ones. ``steps``, labels x labels, gains the expected number of each transition.
    """
    step = np.exp(transitions - transitions.max())
    word = np.exp(scores - scores.max(axis=1, keepdims=True))
    ahead = np.empty_like(word)
    going = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    state = None
    for t, n in enumerate(going):
        at = offsets[:n] + t
        state = word[at] if t == 0 else word[at] * (state[:n] @ step)
        state = state / state.sum(axis=1, keepdims=True)
        ahead[at] = state
    behind = None
    for t in range(len(going) - 1, -1, -1):
        n = going[t]
        at = offsets[:n] + t
        now = np.ones((n, word.shape[1]))
        if behind is not None:
            m = len(behind)
            after = word[at[:m] + 1] * behind
            if steps is not None:
                both = ahead[at[:m]][:, :, None] * step[None] * after[:, None, :]
                steps += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now[:m] = after @ step.T
            now[:m] /= now[:m].sum(axis=1, keepdims=True)
        behind = now
        both = ahead[at] * now
        ahead[at] = both / both.sum(axis=1, keepdims=True)
    return ahead


def switched(runs: list[list[tuple[int, str]]]) -> list[list[tuple[int, str]]]:
    """The runs of (label, word), of which every other pair has traded its second halves."""
    out = list(runs)
    for i in range(0, len(out) - 1, 4):
        a, b = out[i], out[i + 1]
        out[i], out[i + 1] = a[: len(a) // 2] + b[len(b) // 2 :], b[: len(b) // 2] + a[len(a) // 2 :]
    return out


def trained(runs: list[tuple[str, list[str]]]) -> Model:
    """The model of (language, words) runs, by full-batch gradient steps on the log-likelihood."""
    languages = tuple(sorted({language for language, _ in runs}))
    number = {x: i for i, x in enumerate(languages)}
    worded = [[(number[x], w) for w in (letters(t.lower()) for t in ts) if w] for x, ts in runs]
    cleaned = sorted((r for r in switched([r for r in worded if r]) if r), key=lambda r: -len(r))
    if not cleaned:
        return Model((), np.zeros((0, 0)), np.zeros((0, 0)), {})
    k = len(languages)
    seen: dict[str, Counter] = {}
    for run in cleaned:
        for label, w in run:
            seen.setdefault(w, Counter())[label] += 1
    # Half of the eligible words enter, so that the other features learn from words outside the lexicon too.
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if c.total() >= LEXICON_N and c.most_common(1)[0][1] >= LEXICON_SHARE * c.total()}
    fitted = {w: x for w, x in lexicon.items() if zlib.crc32(w.encode()) % 2}
    place = {w: i for i, w in enumerate(seen)}
    ids = [feature_ids(w, fitted) for w in seen]
    flat, starts = np.array([i for x in ids for i in x]), np.cumsum([0, *map(len, ids)])[:-1]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    index = np.array([place[w] for run in cleaned for _, w in run])
    lengths = np.array([len(run) for run in cleaned])
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    truth = np.array([label for run in cleaned for label, _ in run])
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    squares, step_squares = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    inside = np.ones(len(index), dtype=bool)
    inside[offsets] = False
    after = np.flatnonzero(inside)
    gold_steps = np.bincount(truth[after - 1] * k + truth[after], minlength=k * k).reshape(k, k)
    for _ in range(ROUNDS):
        emitted = np.add.reduceat(weights[flat], starts, axis=0)
        scores = emitted[index]
        expected = np.zeros((k, k))
        gap = marginals(scores, offsets, lengths, transitions, expected)
        gap[np.arange(len(truth)), truth] -= 1
        by_word = np.stack([np.bincount(index, gap[:, j], len(ids)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], axis=1) / len(truth) + RIDGE * weights
        step_gradient = (expected - gold_steps) / len(truth) + 1e-3 * transitions
        squares += gradient**2
        step_squares += step_gradient**2
        weights -= STEP * gradient / np.sqrt(squares)
        transitions -= STEP * step_gradient / np.sqrt(step_squares)
    return Model(languages, weights.astype(np.float32), transitions, lexicon)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> Model:
    """A model of the bounded sample of ``docs`` that the module's docstring states."""
    from pyspark.sql import Window as W

    h = F.xxhash64(F.col(key), F.col(text))
    known = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    hashed = known.select(F.col(language).alias("language"), h.alias("h"), F.pmod(h, F.lit(SALTS)).alias("salt")).dropDuplicates(["language", "h"])
    rank = F.row_number().over(W.partitionBy("language", "salt").orderBy("h"))
    chosen = hashed.withColumn("rank", rank).filter(F.col("rank") <= PER_SALT).select("h").distinct()
    texts = known.select(F.col(language).alias("language"), h.alias("h"), F.col(text).alias("text")).join(F.broadcast(chosen), "h")
    texts = texts.groupBy("h").agg(F.min("language").alias("language"), F.min("text").alias("text"))  # a repeated row teaches once
    found = texts.select("language", "h", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / RUN)), lambda i: F.slice(F.col("w"), (i * RUN + 1).cast("int"), RUN))
    runs = found.select("language", "h", F.posexplode(cut).alias("i", "run")).withColumn("order", F.xxhash64("h", "i"))
    runs = runs.withColumn("nth", F.row_number().over(W.partitionBy("h").orderBy("order", "i"))).filter(F.col("nth") <= PER_DOC)
    most = max(LEAST_RUNS, RUNS // max(1, known.select(language).distinct().count()))
    rows = runs.withColumn("rank", F.row_number().over(W.partitionBy("language").orderBy("order", "h", "i"))).filter(F.col("rank") <= most)
    return trained([(r["language"], list(r["run"])) for r in rows.orderBy("order", "h", "i").select("language", "run").collect()])


class Labeller:
    """Scores words with a model, and keeps the scores of the words it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.pending = model, {}, []
        self.scores = np.zeros((0, len(model.languages)))

    def index(self, text: str) -> np.ndarray:
        """For each word with a letter its row of scores."""
        known, out = self.known, []
        for token in text.lower().split():
            if (i := known.get(token)) is None:
                word = letters(token)
                if not word:
                    i = -1
                elif (i := known.get(word)) is None:
                    i = known[word] = len(self.scores) + len(self.pending)
                    self.pending.append(feature_ids(word, self.model.lexicon))
                known[token] = i
            if i >= 0:
                out.append(i)
        return np.array(out, dtype=np.int64)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray]]:
        """Language, mean probability, and mean probabilities of all languages for each text."""
        if len(self.known) > KEPT:
            self.__init__(self.model)
        rows = [self.index(t or "") for t in texts]
        if self.pending:
            starts = np.cumsum([0, *map(len, self.pending)])[:-1]
            new = np.add.reduceat(self.model.weights[[i for x in self.pending for i in x]], starts, axis=0)
            self.scores, self.pending = np.concatenate([self.scores, new]), []
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        order, out = np.argsort(-lengths, kind="stable"), [(UNDETERMINED, 0.0, np.zeros(len(self.model.languages)))] * len(texts)
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            stop = at + max(1, int(np.searchsorted(np.cumsum(lengths[order[at:]]), AT_ONCE)))
            some = order[at:stop]
            n = lengths[some]
            offsets = np.concatenate(([0], np.cumsum(n)[:-1]))
            p = marginals(self.scores[np.concatenate([rows[i] for i in some])], offsets, n, self.model.transitions)
            means = np.add.reduceat(p, offsets, axis=0) / n[:, None]
            for i, mean in zip(some.tolist(), means):
                best = int(mean.argmax())
                out[i] = (self.model.languages[best], float(min(1.0, mean[best])), mean)
            at = stop
        return out


def labelled(docs: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and its probability, in Arrow batches and without a shuffle."""
    language, score, both = free_name(docs, language), free_name(docs, score), free_name(docs, "labelled")
    if not model.languages:
        return docs.withColumn(language, F.lit(UNDETERMINED)).withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for part in texts:
            found = []
            for at in range(0, len(part), 2000):
                found += [(x, s) for x, s, _ in labeller.label(list(part[at : at + 2000]))]
            yield pd.DataFrame(found, columns=["language", "score"])

    out = docs.withColumn(both, F.pandas_udf(of, "struct<language: string, score: double>")(F.col(text)))
    return out.withColumn(language, F.col(both)["language"]).withColumn(score, F.col(both)["score"]).drop(both)
