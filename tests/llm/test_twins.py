"""Plain loops beside the learned operators: lexicon, votes and scores of toxicity, links of planted vectors."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kerbline.llm.embedding_dedup import near_vectors
from kerbline.llm.toxicity import (
    LEAST_SHARE,
    LEAST_SURPRISE,
    LEAST_TOXIC_TEXTS,
    PREFIXES,
    THRESHOLD,
    VOTERS_PER_KIND,
    Finder,
    fit,
    fit_classifier,
    fit_label_model,
    score_toxicity,
    voters_of,
)

BAD = ["vexil", "vexiled", "groltar", "groltish", "snarvo", "snarvos", "plimfer", "plimferous"]


def corpus(n, seed):
    """Rows of doc_id, text, and labels of most of them; toxic texts have a few of the bad words."""
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "wo", "xé") for b in ("dan", "fer", "gus", "lim", "pat", "rov", "sil", "tox")]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 60))]
        toxic = k % 5 == 0
        for _ in range(rng.randrange(1, 5) * toxic + (rng.random() < 0.02)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(BAD))
        rows.append((k, rng.choice([" ", ", ", "\n", " 7-"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
        if rng.random() < 0.8:
            labels.append((k, int(toxic)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "?! 12"), (3, rows[3][1])], labels


def words_of(text):
    return [w for w in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def patterns_of(word):
    return ["=" + word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def lexicon(rows, labels):
    """Patterns that stand in more toxic places than chance allows, and the share of toxic labels."""
    known = {d: t for d, t in labels if not held_out(d)}
    share = sum(known.values()) / len(known)
    texts, places = defaultdict(lambda: [0, 0]), defaultdict(set)
    for doc_id, text in rows:
        if doc_id not in known:
            continue
        words = words_of(text)
        for word in set(words):
            for p in patterns_of(word):
                texts[p][0] += known[doc_id]
                texts[p][1] += 1
        for before, word in zip(["", *words], words, strict=False):
            for p in patterns_of(word):
                places[p].add((known[doc_id], before))
    out = []
    for p, (x, n) in texts.items():
        if x < LEAST_TOXIC_TEXTS or x < LEAST_SHARE * n:
            continue
        x, n = sum(t for t, _ in places[p]), len(places[p])
        if x <= LEAST_SHARE * n:
            continue
        clean = (n - x) * math.log((n - x) / n / (1 - share)) if n > x else 0.0
        if x * math.log(x / n / share) + clean >= LEAST_SURPRISE:
            out.append(p)
    return sorted(out), share


def test_toxicity_as_plain_loops(spark):
    rows, labels = corpus(900, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    patterns, share = lexicon(rows, labels)
    model = fit(docs, known)
    assert list(model.patterns) == patterns and len(patterns) >= len(BAD)

    number = {p: k for k, p in enumerate(patterns)}
    found = [sorted({number[p] for w in words_of(t) for p in patterns_of(w) if p in number}) for _, t in rows]
    find = Finder(patterns)
    assert [find(t) for _, t in rows] == found

    voters, n_voters = voters_of(patterns), (1 + len(PREFIXES)) * VOTERS_PER_KIND
    open_rows = [f for (d, _), f in zip(rows, found, strict=True) if not held_out(d)]
    votes = np.zeros((len(open_rows), n_voters))
    for k, f in enumerate(open_rows):
        votes[k, voters[f]] = 1
    label_model = fit_label_model(votes.T @ votes, len(open_rows), share)
    voted = [k for k, f in enumerate(open_rows) if f]
    sets = [open_rows[k] for k in voted] + [[]]
    target = label_model.posterior(np.vstack([votes[voted], np.zeros(n_voters)]))
    weights, intercept = fit_classifier(sets, target, np.append(np.ones(len(voted)), len(open_rows) - len(voted)), len(patterns))
    assert model.weights == pytest.approx(weights.tolist(), abs=1e-6) and model.intercept == pytest.approx(intercept, abs=1e-6)

    expected = defaultdict(list)
    for (doc_id, _), f in zip(rows, found, strict=True):
        expected[doc_id].append(1 / (1 + math.exp(-(intercept + sum(weights[k] for k in f)))))
    got = defaultdict(list)
    for r in score_toxicity(docs, known).collect():
        assert r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= THRESHOLD)
        got[r["doc_id"]].append(r["score"])
    assert got.keys() == expected.keys()
    for doc_id, scores in expected.items():
        assert sorted(got[doc_id]) == pytest.approx(sorted(scores), abs=1e-6)


def test_label_model_finds_rates_and_repeats():
    """Rates of independent voters from agreement alone; a voter that repeats another one counts less."""
    rng = np.random.default_rng(3)
    rows, balance = 400_000, 0.2
    toxic = rng.random(rows) < balance
    high, low = np.array([0.7, 0.6, 0.5, 0.65, 0.55, 0.75]), np.array([0.05, 0.02, 0.04, 0.03, 0.06, 0.01])
    votes = rng.random((rows, len(high))) < np.where(toxic[:, None], high, low)
    model = fit_label_model((votes.T.astype(float) @ votes), rows, balance)
    assert np.abs(model.toxic - high).max() < 0.03 and np.abs(model.clean - low).max() < 0.02 and (model.repeats == 1).all()

    again = np.where(rng.random(rows) < 0.95, votes[:, 0], rng.random(rows) < 0.2)
    votes = np.column_stack([votes, again])
    model = fit_label_model((votes.T.astype(float) @ votes), rows, balance)
    assert model.repeats[0] > 1.3 and model.repeats[-1] > 1.3 and (model.repeats[1:-1] == 1).all()
    assert np.abs(model.toxic[:-1] - high).max() < 0.05


def test_planted_vectors_through_the_whole_search(spark):
    """Pairs on both sides of the threshold among unrelated vectors, against all cosines."""
    rng = np.random.default_rng(9)
    n, width = 1500, 64
    x = rng.standard_normal((n, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((n, width))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    cosine = rng.uniform(0.94, 0.97, n)[:, None]
    vectors = np.vstack([x, cosine * x + np.sqrt(1 - cosine**2) * z]) * rng.uniform(0.1, 10, (2 * n, 1))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_vectors(table).collect()}
    assert len(got) == 2 * n
    links = np.array([got[k]["n_links"] for k in range(2 * n)])
    assert (links <= linked.sum(axis=1)).all() and links.sum() >= 0.999 * linked.sum() > n
    for k in range(n):
        joined = got[k]["component_id"] == got[n + k]["component_id"]
        assert joined == bool(links[k] and links[n + k])
