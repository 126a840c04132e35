"""Periodic runs, repetition rules and whitening against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidewell.llm import periodic_runs, queries as q, repetition, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_runs(words, min_length=24, min_exponent=3):
    """By the definition: smallest period of every maximal stretch, each lag on its own."""
    n, out = len(words), {}
    for lag in range(1, n // min_exponent + 1):
        i = 0
        while i < n - lag:
            if words[i] != words[i + lag]:
                i += 1
                continue
            j = i
            while j < n - lag and words[j] == words[j + lag]:
                j += 1
            if j - i + lag >= max(min_length, min_exponent * lag):
                out.setdefault((i, j - i + lag), lag)  # a smaller lag came first
            i = j
    return sorted((s, length, lag) for (s, length), lag in out.items())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_op11(doc_id, text):
    words = WORDS(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_registered_periodic_runs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in q.op11_periodic_runs(spark, sf).collect()}
    want = {k: brute_op11(k, t) for k, t in docs.items()}
    assert got == want and sum(w[0] > 0 for w in want.values()) > 5


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(400):
        words = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
        if rng.random() < .5:
            words += (words[-rng.randint(1, 9):] or ["x"]) * rng.randint(2, 9)
        for least, exponent in ((24, 3), (4, 2), (16, 2)):
            got = periodic_runs.primitive(periodic_runs.stretches(periodic_runs.word_ids(words), 1, len(words) // exponent, least, exponent))
            assert sorted(map(tuple, got.tolist())) == brute_runs(words, least, exponent)


def test_long_texts_are_scanned_by_ranges(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["ab", "c", "déf"]) for _ in range(60)) + " " + "x y z " * 20 + "tail", "one " * 300, "", None, " \n ", "u v w " * 50, "u v w " * 50]
    docs = spark.createDataFrame([(k % 6 if k != 3 else None, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    plain = periodic_runs.find_runs(docs).collect()
    cut = periodic_runs.find_runs(docs, long_chars=20, range_work=400).collect()
    order = lambda rows: sorted(map(repr, rows))
    assert order(plain) == order(cut) and len(plain) == len(texts)
    assert sorted(r.n_words for r in plain)[:3] == [0, 0, 0] and [r.best.period for r in plain if r.n_words == 150] == [3, 3]
    assert [r.collapsed for r in plain if r.n_words == 300] == ["one"]
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []


def brute_repeats(words, least):
    places = {}
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            places.setdefault(tuple(words[i:j]), []).append(i)
    out = []
    for piece, at in places.items():
        before = {words[i - 1] if i else ("none", i) for i in at}
        after = {words[i + len(piece)] if i + len(piece) < len(words) else ("none", i) for i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out.append((at[0], len(piece), len(at)))
    return sorted(out)


def in_windows(words, k):
    places = {}
    for i in range(len(words) - k + 1):
        places.setdefault(tuple(words[i:i + k]), []).append(i)
    return {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + k)}


def test_maximal_repeats(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", " \t", "a " * 30, "a " * 30]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_covered int")
    for least in (1, 2, 5):
        got = repetition.measure_repetition(docs, min_repeat=least, repeats=True).collect()
        assert [r.doc_id for r in got] == [r.doc_id for r in docs.collect()]
        for r, t in zip(got, texts, strict=True):
            words = WORDS(t or "")
            want = brute_repeats(words, least)
            assert sorted(map(tuple, r.repeats)) == want
            assert r.n_covered == len(in_windows(words, least)) and r.n_repeat_words == len(in_windows(words, 8)) and r.longest_repeat == max([0, *(x[1] for x in want)])
    assert repetition.measure_repetition(docs.limit(0)).collect() == []


def test_long_common_prefixes_step_through_the_last_level(monkeypatch):
    monkeypatch.setattr(repetition, "LEVELS", 3)
    words = [f"w{i}" for i in range(150)] * 2 + ["a"] * 70
    laid = repetition.lay_out([words, ["a"] * 40])
    found = repetition.suffixes(laid.codes, 2)
    assert found.longest[0] == 150 and found.longest[300] == 69 and found.longest[laid.starts[1]] == 39


def test_registered_repetition_rules(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in q.op12_repetition_rules(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        words, r = WORDS(text), got[k]
        lines = [x for x in text.split("\n") if WORDS(x)]
        repeated = len(in_windows(words, 8))
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        kept = not failed and 100 * len(in_windows(words, repetition.MIN_REPEAT)) <= repetition.COVERED_PERCENT * len(words) and not in_windows(words, repetition.LONGEST + 1)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed, kept)
    plain = [r for r in got.values() if r.n_words >= 20 and not r.n_repeat_words and not r.n_covered]
    assert len(plain) > 100 and all(r.kept for r in plain)


def brute_whitened(vectors):
    """Exact fit over distinct vectors, eigenvectors by another library routine."""
    x = {k: tuple(int(np.floor(256 * float(c))) for c in v) for k, v in vectors.items()}
    fit = np.array(sorted(set(x.values())), object)
    n, s = len(fit), fit.sum(axis=0)
    y = {k: [n * a - b for a, b in zip(v, s, strict=True)] for k, v in x.items()}
    centred = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(v, s, strict=True)] for v in fit])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return n, {k: sum(int(a) ** 2 for a in v) for k, v in y.items()}, {k: np.array([a / n for a in map(int, v)]) for k, v in y.items()}, values[::-1], columns[:, ::-1]


def test_registered_whitening(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    n, deviation, centred, values, columns = brute_whitened(vectors)
    got = q.op13_whitening(spark, sf).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((k, c) for k in vectors for c in (1, 2, 3, 4))
    signs = {}
    for r in got:
        want = centred[r.vec_id] @ columns[:, r.component - 1] / np.sqrt(values[r.component - 1])
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.whitened - sign * want) < 1e-9
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 33):
        a = rng.normal(size=(n, 2 * n)) * np.logspace(0, -5, n)[:, None]
        a = a @ a.T
        values, v = whitening.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(n), atol=1e-13) and np.allclose(a @ v, v * values, atol=1e-13 * max([1, *values])) and (np.diff(values) <= 0).all()
    scaled = np.diag([1.0, 1e-9]) @ np.array([[2.0, 1.0], [1.0, 2.0]]) @ np.diag([1.0, 1e-9])
    exact = Fraction(3) * Fraction(1e-18) / Fraction(2)  # determinant over the large one, but for 1e-18
    assert abs(whitening.jacobi(scaled)[0][1] / float(exact) - 1) < 1e-12


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, [0.5, 0.7]), (3, None), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [3.0]), (9, [0.25, -2.0]), (10, [-0.001, 0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(vectors).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (8, 1), (9, 1), (9, 2), (10, 1), (10, 2)]
    alone = next(r for r in got if r.vec_id == 8)
    assert alone.whitened is None and alone.n == 1 and alone.deviation == 0 and alone.explained == 0 and alone.identity_error is None
    usual = {k: v for k, v in rows if k in (1, 2, 9, 10)} | {0: [0.0, 1.0]}
    n, deviation, centred, values, columns = brute_whitened(usual)
    for r in got:
        if r.vec_id != 8:
            k = r.vec_id or 0
            assert r.n == n == 5 and r.deviation == deviation[k] and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - abs(centred[k] @ columns[:, r.component - 1] / np.sqrt(values[r.component - 1]))) < 1e-9
    assert whitening.whiten(vectors.limit(0)).collect() == []
    flat = spark.createDataFrame([(k, [1.0 * k, 2.0 * k, 7.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in whitening.whiten(flat).collect()} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}


@pytest.mark.parametrize("size", [2.0 ** 20, 2.0 ** 36])
def test_large_entries_are_summed_exactly(spark, size):
    rng = np.random.default_rng(4)
    table = {k: (rng.normal(size=3) * size + 5 * size).tolist() for k in range(50)}
    got = whitening.whiten(spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>")).collect()
    n, deviation, centred, values, columns = brute_whitened(table)
    for r in got:
        assert r.n == n and int(r.deviation) == deviation[r.vec_id] and abs(abs(r.whitened) - abs(centred[r.vec_id] @ columns[:, r.component - 1] / np.sqrt(values[r.component - 1]))) < 1e-8
