"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model over their
votes, and a linear classifier trained on the posterior labels.

1. Patterns are whole words and word beginnings of PREFIXES letters. Those that stand in toxic texts
   much more often than chance allows are kept: the lexicon. What counts is in how many different
   places, told apart by the word before, so that copies of a text count once. Learning reads at most
   LABELLED_ROWS labelled rows, chosen by a hash of doc_id; that bounds the lexicon, nothing else does.
2. Each kind of pattern is dealt into VOTERS_PER_KIND voters. A voter votes "toxic" for a text in which
   one of its patterns occurs and abstains otherwise.
3. The label model takes the voters' agreement from all texts that may be learned from (a matrix of
   co-occurrence counts, whose size doesn't follow the input). Given the label, votes of uncorrelated
   voters are independent, so their covariances are a product of one strength per voter; strengths
   come from the three-way products of covariances, pairs that stray from the product are correlated,
   are left out, and the strengths are taken anew. A voter's weight in the posterior is divided by how
   many voters it repeats.
4. A logistic regression on the patterns' presence learns the posterior labels of a bounded sample of
   SAMPLE_ROWS texts with votes, chosen by hash, and of all texts without votes (which are alike: one
   weighted row).

Only labels of rows with crc32(doc_id as text) mod 3 other than 1 are learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import Scratch, broadcast_if_small, scratch_released

#: Bound on the labelled rows that the lexicon is learned from.
LABELLED_ROWS = 200_000
#: Bound on the texts with votes that the classifier is fitted to.
SAMPLE_ROWS = 20_000
#: Patterns in this many toxic labelled texts, with this share of toxic ones, are looked at more closely.
LEAST_TOXIC_TEXTS = 3
LEAST_SHARE = 0.7
#: Log of how unlikely a pattern's places must be by chance: fifty in a million patterns. This and
#: LEAST_SHARE are chosen on rows that may be learned from alone, those of remainder 0 against those of 2.
LEAST_SURPRISE = float(np.log(1e6 / 50))
PREFIXES = (4, 5, 6)
VOTERS_PER_KIND = 8
THRESHOLD = 0.7
_SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = re.compile(_SEPARATOR)


@dataclass(frozen=True)
class Model:
    patterns: tuple[str, ...]  # "=word" for a whole word, "^begin" for a beginning
    weights: tuple[float, ...]
    intercept: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _patterns_of(word: Column) -> Column:
    """Patterns of one word; a beginning is shorter than its word."""
    begins = [F.when(F.length(word) > n, F.concat(F.lit("^"), F.substring(word, 1, n))) for n in PREFIXES]
    return F.array_compact(F.array(F.concat(F.lit("="), word), *begins))


class Finder:
    """Patterns that occur in a text, by one automaton for all of them."""

    def __init__(self, patterns: tuple[str, ...] | list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(patterns):
            self.automaton.add_word(f" {p[1:]} " if p[0] == "=" else f" {p[1:]}", (k, p[0] == "^"))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[int]:
        """Their numbers, in order."""
        spaced = f" {_GAP.sub(' ', (text or '').lower())} "
        return sorted({k for end, (k, begin) in self.automaton.iter(spaced) if not begin or spaced[end + 1] != " "})


def learn_lexicon(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[list[str], float]:
    """Patterns, and the share of toxic texts among the labelled ones."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS)  # the bound lets it be broadcast
    known = scratch.save(known, "labels")
    share = min(max(known.agg(F.avg("toxic")).first()[0] or 0.0, 1e-6), 1 - 1e-6)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    worded = texts.select("toxic", F.explode(F.array(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _SEPARATOR), lambda w: w != ""))).alias("w"))

    words = worded.select("toxic", F.explode(F.array_distinct("w")).alias("word"))
    # a beginning that several words of a text share counts once for each: as good for a ratio
    counts = words.select("toxic", F.explode(_patterns_of(F.col("word"))).alias("pattern")).groupBy("pattern").agg(F.sum("toxic").alias("x"), F.count(F.lit(1)).alias("n"))
    candidates = scratch.save(counts.where((F.col("x") >= LEAST_TOXIC_TEXTS) & (F.col("x") >= LEAST_SHARE * F.col("n"))).select("pattern"), "candidates")

    before = F.concat(F.array(F.lit("")), "w")
    each = worded.select("toxic", F.explode(F.arrays_zip(F.col("w").alias("word"), F.slice(before, 1, F.greatest(F.lit(1), F.size("w"))).alias("before"))).alias("z")).where("z.word IS NOT NULL")
    places = each.select("toxic", F.xxhash64("z.before").alias("place"), F.explode(_patterns_of(F.col("z.word"))).alias("pattern"))
    places = places.join(broadcast_if_small(candidates), "pattern").distinct()
    counts = places.groupBy("pattern").agg(F.sum("toxic").alias("x"), F.count(F.lit(1)).alias("n"))
    x, n = F.col("x"), F.col("n")
    clean = F.when(n > x, (n - x) * F.log((n - x) / n / (1 - share))).otherwise(0.0)
    # minus the log of the chance bound of x toxic places or more among n
    surprising = counts.where((x > LEAST_SHARE * n) & (x * F.log(x / n / share) + clean >= LEAST_SURPRISE))
    return sorted(r["pattern"] for r in surprising.select("pattern").collect()), share


def voters_of(patterns: list[str]) -> np.ndarray:
    """The voter of each pattern: words and the beginnings of each length in VOTERS_PER_KIND voters."""
    seen: dict[int, int] = {}
    out = []
    for p in patterns:
        kind = 0 if p[0] == "=" else 1 + PREFIXES.index(len(p) - 1)
        seen[kind] = seen.get(kind, -1) + 1
        out.append(kind * VOTERS_PER_KIND + seen[kind] % VOTERS_PER_KIND)
    return np.array(out, dtype=np.int64)


def _found(patterns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(patterns)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "found": [find(t) for t in batch["text"]]})

    return run


def _agreement(voters: np.ndarray, n_voters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((n_voters, n_voters), dtype=np.int64), 0
        for batch in batches:
            votes = np.zeros((len(batch), n_voters), dtype=np.int64)
            for k, found in enumerate(batch["found"]):
                votes[k, voters[np.asarray(found, dtype=np.int64)]] = 1
            total += votes.T @ votes
            rows += len(batch)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(total[i, j], rows)})

    return run


@dataclass(frozen=True)
class LabelModel:
    """P(vote | toxic), P(vote | not), and what a voter's evidence is divided by."""

    toxic: np.ndarray
    clean: np.ndarray
    repeats: np.ndarray
    balance: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes). A voter that abstains says nothing, but where all abstain that is evidence."""
        yes = np.log(self.toxic / self.clean) / self.repeats
        no = np.log((1 - self.toxic) / (1 - self.clean)) / self.repeats
        odds = np.log(self.balance / (1 - self.balance)) + np.where(votes.any(axis=1), votes @ yes, no.sum())
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(together: np.ndarray, rows: int, balance: float, stray: float = 0.3, rounds: int = 3) -> LabelModel:
    """together: counts of texts in which both voters vote, single votes on the diagonal."""
    n = len(together)
    balance = float(np.clip(balance, 1e-3, 1 - 1e-3))
    mean = np.diag(together) / max(rows, 1)
    covariance = together / max(rows, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.clip(mean * (1 - mean), 1e-12, None))
    usable = ~np.eye(n, dtype=bool) & (mean > 0)[:, None] & (mean > 0)[None, :]
    strength = np.zeros(n)
    for _ in range(rounds):
        for i in range(n):
            if mean[i] <= 0:
                continue
            j, k = np.nonzero(np.triu(usable & usable[i][:, None] & usable[i][None, :], 1))
            good = covariance[j, k] > 1e-12
            ratios = covariance[i, j[good]] * covariance[i, k[good]] / covariance[j[good], k[good]]
            ratios = ratios[np.isfinite(ratios) & (ratios > 0)]
            strength[i] = np.sqrt(np.median(ratios)) if len(ratios) else spread[i] * 0.5
        strength = np.minimum(strength, spread)
        rest = (covariance - np.outer(strength, strength)) / np.outer(spread, spread)
        correlated = (np.abs(rest) > stray) & ~np.eye(n, dtype=bool) & (mean > 0)[:, None] & (mean > 0)[None, :]
        after = ~np.eye(n, dtype=bool) & ~correlated & (mean > 0)[:, None] & (mean > 0)[None, :]
        if (after == usable).all():
            break
        usable = after
    gap = strength / np.sqrt(balance * (1 - balance))
    clip = lambda x: np.clip(x, 1e-4, 1 - 1e-4)
    repeats = 1 + np.where(correlated, np.clip(np.abs(rest), 0, 1), 0).sum(axis=1)
    return LabelModel(clip(mean + (1 - balance) * gap), clip(mean - balance * gap), repeats, balance)


def fit_classifier(found: list[list[int]], target: np.ndarray, weight: np.ndarray, n: int, rounds: int = 400, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels on pattern presence: weights and intercept."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    column = np.array([c for f in found for c in f], dtype=np.int64)
    w, b = np.zeros(n), 0.0
    seen_w, seen_b, total = np.full(n, 1e-8), 1e-8, weight.sum()
    for _ in range(rounds):
        odds = np.bincount(row, weights=w[column], minlength=len(found)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target)
        gradient = (np.bincount(column, weights=error[row], minlength=n) + l2 * 1e-3 * w) / total
        slope = error.sum() / total
        seen_w += gradient**2
        seen_b += slope**2
        w -= 0.5 * gradient / np.sqrt(seen_w)
        b -= 0.5 * slope / np.sqrt(seen_b)
    return w, float(b)


def _learn(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame | None]:
    """Model, and doc_id, held_out, found (numbers of the patterns) of every row; None without a lexicon."""
    patterns, balance = learn_lexicon(documents, labels, scratch)
    if not patterns:
        return Model((), (), -1e9), None
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    every = scratch.save(rows.mapInPandas(_found(patterns), "doc_id long, held_out boolean, found array<int>"), "found")
    found = every.where("NOT held_out")

    voters = voters_of(patterns)
    n_voters = (1 + len(PREFIXES)) * VOTERS_PER_KIND
    pairs = found.select("found").mapInPandas(_agreement(voters, n_voters), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together, n_rows = np.zeros((n_voters, n_voters)), 0
    for r in pairs:  # at most one for each pair of voters
        if r["i"] < 0:
            n_rows = r["n"]
        else:
            together[r["i"], r["j"]] = r["n"]
    model = fit_label_model(together, n_rows, balance)

    # the rest of the work on these is the driver's: a bounded sample
    with_votes = found.where("size(found) > 0")
    n_with = with_votes.count()
    sample = with_votes.orderBy(F.xxhash64("doc_id", "found"), "doc_id").limit(SAMPLE_ROWS).select("found").toPandas()
    sets = [np.asarray(f, dtype=np.int64) for f in sample["found"]] + [np.empty(0, dtype=np.int64)]
    votes = np.zeros((len(sets), n_voters))
    for k, f in enumerate(sets):
        votes[k, voters[f]] = 1
    weight = np.ones(len(sets)) * n_with / max(1, len(sample))
    weight[-1] = n_rows - n_with
    w, b = fit_classifier([f.tolist() for f in sets], model.posterior(votes), weight, len(patterns))
    return Model(tuple(patterns), tuple(float(x) for x in w), b), every


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Model from documents (doc_id, text, ...) and labels (doc_id, toxic, ...), held-out rows unread.

    Without any usable toxic label there is no lexicon, and the model gives every text 0.
    """
    with scratch_released():
        return _learn(documents, labels, Scratch(documents.sparkSession, "toxicity"))[0]


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def scorer(model: Model):
    """Column function: text -> score from 0 to 1."""
    patterns, weights, intercept = model.patterns, np.array(model.weights), model.intercept

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Finder(patterns) if patterns else None
        for texts in batches:
            if find is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(_probability(np.array([intercept + weights[find(t)].sum() for t in texts], dtype=np.float64)))

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, held_out, score, predicted, one row for each row.

    Null and empty texts have no pattern and get the score of such texts; very long texts are read
    whole. A null doc_id counts as not held out and stays null. Labels are read by doc_id; of labels
    that differ for one doc_id the toxic one counts. Rows that repeat a doc_id are scored each on its
    own text. Other columns are ignored; an empty table gives no rows.
    """
    model, found = _learn(documents, labels, Scratch(documents.sparkSession, "toxicity"))
    if found is None:
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
        return rows.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    weights, intercept = np.array(model.weights), model.intercept

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        return pd.Series(_probability(np.array([intercept + weights[np.asarray(f, dtype=np.int64)].sum() for f in found], dtype=np.float64)))

    out = found.select("doc_id", "held_out", score("found").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below THRESHOLD, all columns as they are."""
    score = scorer(fit(documents, labels))
    return documents.where(score(F.col("text").cast("string")) < THRESHOLD)
