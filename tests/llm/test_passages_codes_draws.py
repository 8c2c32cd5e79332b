"""Passage removal, vector codes and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from kerbline.llm import substring_dedup as sub
from kerbline.llm.common import Scratch
from kerbline.llm.importance import hashed_features, resample
from kerbline.llm.substring_dedup import remove_repeats, removal_intervals, repeat_digests
from kerbline.llm.vector_codes import compress, fit_codebooks, nearest, whole_vectors

ODD = [None, "", "  \n ", "one", "\x0b\x0c"]


def passages(seed=3):
    """Texts with shared passages, repeats inside a text, near and exact copies, and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Aa", "aa", "b", "ü", "c d", "x1", "yy", f"w{rng.randrange(50)}"])
    shared = [[word() for _ in range(n)] for n in (4, 5, 6, 9, 30)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice([" ", "\t", " \n"]).join(parts))
    return texts + [texts[5]] * 4 + ["a " * 40] + ODD


def kept_words(rows, window):
    """(doc_id, text) of different ids -> the words that stay."""
    first, out = {}, {}
    words = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    gone = {d: set() for d in words}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            w = tuple(words[d][k : k + window])
            if w in first:
                gone[d] |= set(range(k, k + window))
            first.setdefault(w, (d, k))
    for d, w in words.items():
        out[d] = (len(w), len(gone[d]), " ".join(x for k, x in enumerate(w) if k not in gone[d]))
    return out


@pytest.mark.parametrize("window", [1, 5])
def test_repeats(spark, window):
    rows = list(enumerate(passages()))
    random.Random(1).shuffle(rows)
    odd = "doc_id long, text string, part int, spans int, h int, bucket int"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], odd).repartition(5)
    want = kept_words(rows, window)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in remove_repeats(docs, window).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 100
    digests = {r["doc_id"]: r["kept_sha256"] for r in repeat_digests(docs, window).collect()}
    assert digests == {d: hashlib.sha256(t.encode()).hexdigest() for d, (_, _, t) in want.items()}


def test_repeats_of_one_id_and_without_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(7, a), (7, a), (8, a), (8, b), (9, b), (None, a), (None, b), (10, f"x {a} y {b} z"), (-5, " ".join(a.split()[:25]))]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(-5, 25, 0), (7, 30, 30), (7, 30, 30), (8, 30, 30), (8, 30, 0), (9, 30, 30), (None, 30, 0), (None, 30, 0), (10, 63, 60)]
    # of a, all windows but those of -5 and the ones after it first stand in 7
    want = [(i, n, 25 if i == 7 else gone) for i, n, gone in want]
    assert got == sorted((str(i), n, gone) for i, n, gone in want)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeats_of_very_long_texts(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 1_500_000))
    words = long.split()
    rows = [(1, long), (2, " ".join(words[1_400_000:1_400_100])), (3, "q " * 10 + " ".join(words[1_048_570:1_048_600])), (4, "z" * (3 << 20))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1_500_000, 0), 2: (100, 100), 3: (40, 30), 4: (1, 0)}


def test_chunks_do_not_change_repeats(monkeypatch):
    """Chunks cut within texts: the repeats found inside them, and all other windows, are each there once."""
    monkeypatch.setattr(sub, "_CHUNK_WINDOWS", 37)
    docs = [(k, 0, t or "") for k, t in enumerate(passages(8))]
    rows = list(sub._chunk_rows(docs + docs[:3], 3, 8, 9))
    seen = {}
    for bucket, _, places, repeats, first, gaps, tails, g in rows:
        assert 0 <= bucket < 256
        if places is not None:
            table = np.frombuffer(places, "<i8").reshape(4, -1)
            for doc_id, _, start, n in np.frombuffer(repeats, "<i8").reshape(4, -1).T.tolist():
                for k in range(n):
                    assert seen.setdefault((doc_id, start + k), "inside") == "inside"
        else:
            assert len(tails) // 7 == len(g) // 2 == len(gaps) // 2 > 0
            for k in (first + np.cumsum(np.frombuffer(gaps, "<u2"))).tolist():
                d = np.searchsorted(table[2], k, side="right") - 1
                assert seen.setdefault((int(table[0][d]), int(k - table[2][d] + table[3][d])), "left") == "left"
    want = {(d, k) for d, _, t in docs for k in range(len(re.findall("[^\x20\x09-\x0d]+", t)) - 2)}
    assert set(seen) == want and 0 < sum(x == "inside" for x in seen.values()) < len(seen)


def test_removal_intervals():
    spans = [(s << 32) + n for s, n in ((50, 1), (3, 2), (4, 1), (24, 1), (100, 5), (51, 1), (3, 2))]
    assert removal_intervals(np.array(spans), 20).tolist() == [[3, 44], [50, 71], [100, 124]]


# ---------------------------------------------------------------------------------------------


def coded(rows, parts, entries, rounds, scale):
    """(vec_id, vector, label) in order of vec_id -> code and error of each, final entries."""
    v = [[math.floor(scale * x) for x in r[1]] for r in rows]
    d = len(v[0]) // parts
    cut = [[x[k * d : (k + 1) * d] for k in range(parts)] for x in v]
    books = [[cut[i][k] for i in range(min(entries, len(v)))] for k in range(parts)]

    def assign():
        out = []
        for x in cut:
            gaps = [[sum((a - b) ** 2 for a, b in zip(x[k], e, strict=True)) for e in books[k]] for k in range(parts)]
            out.append([(g.index(min(g)), min(g)) for g in gaps])
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(parts):
            for e in range(len(books[k])):
                own = [cut[i][k] for i in range(len(v)) if found[i][k][0] == e]
                if own:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{a:02x}" for a, _ in f), sum(g for _, g in f)) for f in found], digest


@pytest.mark.parametrize("n, entries", [(90, 12), (5, 12)])
def test_vector_codes(spark, n, entries):
    rng = np.random.default_rng(n)
    vectors = np.round(rng.standard_normal((n, 8)), 1)  # coarse, so distances tie
    vectors[-3:] = vectors[0]
    rows = [(int(k) - 4, [float(x) for x in v], None if k % 5 == 0 else int(k % 3)) for k, v in enumerate(vectors)]
    bad = [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [float("nan")] + [1.0] * 7, 1), (1003, [float("-inf")] + [1.0] * 7, None), (1004, [1.0] * 4, 1)]
    shuffled = rows + bad
    random.Random(2).shuffle(shuffled)
    table = spark.createDataFrame([(*r, 1, 1) for r in shuffled], "vec_id long, embedding array<double>, label int, code int, part int").repartition(4)
    want, digest = coded(rows, 2, entries, 3, 64)
    got = {r["vec_id"]: r for r in compress(table, parts=2, entries=entries, rounds=3, scale=64).collect()}
    by_label = {}
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    assert {i: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for i, r in got.items()} == {r[0]: (*w, by_label[r[2]], digest) for r, w in zip(rows, want, strict=True)}
    scratch = Scratch(spark, "t")
    whole = whole_vectors(table, scratch, 2, 64)
    books = fit_codebooks(whole, 2, entries, 3, 64)
    back = books.decode(np.array([[int(want[0][0][k : k + 2], 16) for k in (0, 2)]]))
    assert round(float(((np.floor(vectors[0] * 64) - back[0] * 64) ** 2).sum())) == want[0][1]


def test_vector_codes_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert compress(spark.createDataFrame([], schema)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    twice = spark.createDataFrame([(1, [1.0] * 4, 1), (1, [2.0] * 4, 1), (None, [2.0] * 4, None)], schema)
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in compress(twice).collect()) == [(0, "01" * 4, 0, 0), (1, "00" * 4, 0, 0), (1, "01" * 4, 0, 0)]
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))
    with pytest.raises(Exception, match="a component is"):
        compress(spark.createDataFrame([(1, [1e30] * 4, 1)], schema))
    at, gap = nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 4]]))
    assert at.tolist() == [0, 2] and gap.tolist() == [1, 1]


# ---------------------------------------------------------------------------------------------


def features_of(text, n=2, buckets=10_000):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    runs = [" ".join(words[k : k + m]) for m in range(1, n + 1) for k in range(len(words) - m + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def drawn(rows, target, percent, least):
    hashed = [(i, *features_of(t)) for i, t in rows]
    s, t = {}, {}
    for counts, lists in ((s, [f for _, _, f in hashed]), (t, [features_of(x)[1] for x in target])):
        for b in (b for f in lists for b in f):
            counts[b] = counts.get(b, 0) + 1
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, n, f in hashed:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(order[: len(order) * percent // 100])}
    return {r[0]: (*r[2:], rank.get(r[0])) for r in out}


def test_resample(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Ab", "ab", "ß-é", "x_y", "K9", f"w{rng.randrange(80)}"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts + [texts[0]] * 3 + ODD))
    target = [*texts[:9], None, "", "new words here"]
    odd = "doc_id long, text string, number int, bucket int, gain int, rank int, score int, features int, w int"
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, 1, 1) for r in rows], odd).repartition(3)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, number int")
    got = {r["doc_id"]: tuple(r)[1:] for r in resample(docs, aims).collect()}
    assert got == drawn(rows, target, 25, 20) and sum(r[3] is not None for r in got.values()) > 20


def test_resample_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (1, "a b " * 20), (None, "c d " * 20), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = sorted(((r["doc_id"] or 0), r["n_features"], r["score"] is None, r["rank"] or 0) for r in resample(docs, none, percent=50).collect())
    assert [g[:3] for g in got] == [(0, 79, True), (1, 79, False), (1, 79, False), (2, 0, False)] and [g[3] for g in got] == [0, 0, 1, 0]
    assert resample(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_chunks_own_their_features(spark, monkeypatch, n):
    from kerbline.llm import importance

    monkeypatch.setattr(importance, "CHUNK_WORDS", 4)
    texts = [" ".join(f"w{k % 5}" for k in range(m)) for m in range(14)]
    found = {}
    for r in hashed_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, 10_000).collect():
        size, all_ = found.get(r["doc_id"], (0, []))
        found[r["doc_id"]] = (size + r["n_words"], all_ + r["features"])
    assert {d: (m, sorted(f)) for d, (m, f) in found.items()} == {d: (features_of(t, n)[0], sorted(features_of(t, n)[1])) for d, t in enumerate(texts)}


def test_resample_very_long_text(spark):
    text = " ".join(f"w{k}" for k in np.random.default_rng(1).integers(0, 10**5, 400_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_features"] for r in resample(docs, docs.select("text")).collect()} == {1: 799_999, 2: 1}
