import random
import re
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cambium.llm import spelling_variants as sv
from cambium.llm.fm_index import Index
from cambium.llm.spelling_variants import near_words, roots, spelling_variants, word_counts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def near(a, b):
    """Exactly one inserted, deleted or replaced letter apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute_counts(rows, modulus=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6}


def brute(rows, modulus=199):
    n = {w: c for w, c in brute_counts(rows, modulus).items() if c >= 5}
    form, n_near = {}, {}
    for w in n:
        others = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        n_near[w] = len(others)
        form[w] = others[0] if others and n[others[0]] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], n_near[w], n.get(form[w])) for w in n)


def typos(seed, words, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = words[min(int(rng.expovariate(0.4)), len(words) - 1)]
        if rng.random() < 0.2:
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé") + w[i:], w[:i] + rng.choice("abÉ") + w[i + 1 :]])
        out.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sv, "HELD", 3)
    monkeypatch.setattr(sv, "KEY_WORDS", 3)
    monkeypatch.setattr(sv, "BLOCK_LETTERS", 20)
    monkeypatch.setattr(sv, "BLOCK_QUERIES", 2)


WORDS = ["aabbaa", "aabbab", "banana", "bananas", "élevées", "mississippi", "aaaaaa", "aaaaaaa"]


def corpus():
    texts = [" ".join(typos(i, WORDS, 80)) for i in range(12)] + [None, "", "12 34", "bananaX7bananax", "ﬁnancé́", "×÷ÀÁÂÃÄÅ" * 3, "a" * 30_000 + " " + "a" * 29_999]
    texts += [texts[-1]] * 5 + ["ǅabcdef ıstanbul"] * 5 + [texts[0]] * 2
    texts += ["abcdefg " * 6, "abcdef " * 40, "abcdéf " * 300]  # each the form of the one before
    ids = [None, None, 3, 3, *range(4, len(texts))]
    return ids, texts


@pytest.mark.parametrize("modulus", [199, 7])
def test_equals_brute_force(spark, docs, modulus):
    ids, texts = corpus()
    rows = spelling_variants(docs(texts, ids=ids), modulus=modulus).collect()
    want = brute(list(zip(ids, texts, strict=True)), modulus)
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows) == want
    assert any(w[1] and w[1] != w[2] for w in want)


def test_indexes_of_bounded_size_find_the_same(spark, docs, small_blocks):
    ids, texts = corpus()
    df = docs(texts, ids=ids)
    assert {r.word: r.n for r in word_counts(df, modulus=7).collect()} == brute_counts(list(zip(ids, texts, strict=True)), 7)
    rows = spelling_variants(df, modulus=7).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows) == brute(list(zip(ids, texts, strict=True)), 7)


def test_empty_table_and_long_chains(spark, docs):
    assert spelling_variants(docs([])).collect() == []
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w20")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w20" for w, _ in chain}


@pytest.mark.parametrize("most", [2, 10, 30_000])
def test_common_half(spark, monkeypatch, most):
    """A third of all words begin alike, and ties go to the least word; keys of many words are halved again and again."""
    monkeypatch.setattr(sv, "KEY_WORDS", most)
    words = [f"prefix{a}{b}" for a in "abcdefgh" for b in "abcdefgh"] + [f"{a}{b}{a}{b}x{c}" for a in "mno" for b in "pqr" for c in "stu"]
    words += ["a" * i + "b" * j for i in range(1, 9) for j in range(4)]
    held = {r["held"] for r in sv.postings(spark.createDataFrame([(w, 7) for w in words], "word string, n long")).where("role = 0 and open > 1").groupBy("key").agg(F.count("*").alias("held")).collect()}
    assert max(held) <= most
    rows = {r.word: r for r in near_words(spark.createDataFrame([(w, 7) for w in words], "word string, n long")).collect()}
    for w in words:
        others = sorted(v for v in words if near(w, v))
        assert (rows[w].n_near, rows[w].form) == (len(others), others[0]) if others else w not in rows


def test_index_against_brute_force():
    rng = random.Random(1)
    for trial in range(24):
        letters = "ab" if trial % 2 else "abcé\U0001f600"
        words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 120))})
        rng.shuffle(words)
        sought = words + ["".join(rng.choices(letters + "z", k=rng.randint(1, 9))) for _ in range(20)]
        half = np.array([len(q) // 2 for q in sought])
        rest = np.array([len(q) for q in sought]) - half
        for index, exact in ((Index(words, backwards=True), half), (Index(words), rest)):
            pairs = list(zip(*(x.tolist() for x in index.one_error(sought, exact)), strict=True))
            agree = (lambda q, w, k: w[:k] == q[:k]) if index.backwards else (lambda q, w, k: len(w) >= k and w[len(w) - k :] == q[len(q) - k :])
            assert sorted(pairs) == [(i, j) for i, q in enumerate(sought) for j, w in enumerate(words) if near(q, w) and agree(q, w, exact[i])]
