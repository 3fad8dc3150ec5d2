import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparrowmill.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """Whether one code point inserted, deleted or replaced turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def groups(counts, ratio=5):
    """(word, form, root, n, n_near, form_n), all pairs."""
    form, links = {}, {w: [v for v in counts if near(w, v)] for w in counts}
    for w, found in links.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted(((w, form[w], root(w), n, len(links[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()), key=str)


def variants(seed, n):
    draw = np.random.default_rng(seed)
    letters = list("abcéÿ")
    out = Counter()
    for _ in range(n):
        word = list("abcabcab"[: draw.integers(6, 9)])
        for _ in range(draw.integers(0, 4)):
            k = int(draw.integers(0, len(word)))
            word[k : k + int(draw.integers(0, 2))] = [str(draw.choice(letters))] * int(draw.integers(0, 2))
        if len(word) >= 6:
            out["".join(word)] += int(draw.integers(1, 400))
    return out


@pytest.mark.parametrize("most", [20_000, 3, 1])
def test_groups_against_all_pairs(spark, most):
    """Every way to cut frames finer gives the pairs that comparing all with all gives."""
    counts = variants(most, 160)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.grouped(words, most=most).collect()]
    assert sorted(got, key=str) == groups(counts)
    assert any(r[4] > 5 for r in got) and any(r[1] for r in got)


def test_frames_are_cut_until_none_is_large(spark):
    words = spark.createDataFrame([(f"prefix{a}{b}{c}{d}", 5) for a in "abcdef" for b in "abcdef" for c in "abc" for d in "ab"], "word string, n long")
    rows, _ = spelling.framed(words, 40)
    assert rows.where("p - a - b > 1").groupBy("key").count().agg({"count": "max"}).first()[0] <= 40
    counts = {r.word: r.n for r in words.collect()}
    assert {(r.word, r.near) for r in spelling.near_words(words, most=40).collect()} == {(a, b) for a in counts for b in counts if near(a, b)}


@pytest.mark.parametrize("noise", [0, 3])
def test_counts_against_single_runs(spark, table, noise):
    texts = ["Éclair éclair ECLAIR straße×÷ a1bcdefgh", None, "", "naïveté " * 7 + "abcdefg漢abcdefg", "x" * 200 + " " + "é" * 90, "abcdefg-Abcdefg_ABCDEFG"] * 2
    want = Counter()
    for i, text in enumerate(texts):
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                want[run] += 1
    got = spelling.word_counts(table(texts).repartition(3), noise=noise, least_count=2)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if n >= 2}


def test_long_texts_are_read_in_pieces():
    text = "wörter und Buchstaben œuvre " * 30_000
    found = Counter()
    for _, counts, words in spelling._runs(pa.array([text, text[:100]]), pa.array(["1", "2"]), 0, 6):
        for word, n in zip(words.to_pylist(), counts.tolist(), strict=True):
            found[word] += n
    assert found == Counter(lower(r) for t in (text, text[:100]) for r in RUN.findall(t) if len(r) >= 6)


def test_awkward(spark, awkward, empty):
    counts = {r.word: r.n for r in spelling.word_counts(awkward, noise=199).collect()}
    assert all(len(w) >= 6 and n >= 5 for w, n in counts.items())
    words = spelling.written(spelling.word_counts(empty), "words")
    assert spelling.grouped(words).count() == 0
    assert spelling.grouped(words).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_have_one_root(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 7}
    got = {r.word: (r.form, r.root) for r in spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert {w: r for w, (_, r) in got.items()} == {w: "zzzzzz" if w == "zzzzzz" else "abbbbb" for w in counts}
    assert got["abbbbb"] == (None, "abbbbb") and got["aaaaaa"] == ("aaaaab", "abbbbb")
