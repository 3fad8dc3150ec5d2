import math
import re
from collections import Counter

import numpy as np
import pytest

from sparrowmill.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item_id, rank, id, score) by scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_documents, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df, out = Counter(t for _, c in held for t in c), []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_documents) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def collection(seed, n):
    draw = np.random.default_rng(seed)
    word = lambda: f"w{int(draw.zipf(1.3)) % 60}"
    docs = [(int(i), " ".join(word() for _ in range(draw.integers(1, 30)))) for i in draw.permutation(n)]
    return [*docs, (None, "w1 w2 w3"), (7, "w1 w2 w3"), (3, None), (4, ""), (5, "?!")], [(k, " ".join(word() for _ in range(draw.integers(1, 12)))) for k in range(12)]


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("item_bytes", [20, 1 << 20])
def test_against_scoring_everything(spark, k, item_bytes):
    docs, items = collection(k, 80)
    items += [(100, "no such thing"), (101, None), (102, "…"), (5, items[5][1])]
    got = lexical_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=k, item_bytes=item_bytes)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(docs, dict.fromkeys(items), k)


@pytest.mark.parametrize("seed", range(20))
def test_best_of_a_portion(seed):
    """Stopping early leaves out no document of the best k and none that ties with the last, and scores are complete."""
    draw = np.random.default_rng(seed)
    n_docs, n_terms = 300, 12
    pairs = np.unique(draw.integers(0, n_docs * n_terms, 1500))
    doc, term = np.divmod(pairs, n_terms)
    tf, n, weight = draw.integers(1, 4, len(pairs)), draw.integers(4, 9, n_docs), draw.integers(0, 3, n_terms) * 400
    portion = lexical_search.Portion(n, doc, term, tf, weight, n_docs, int(n.sum()))
    places = draw.permutation(n_terms)[:5]
    m = 50 + (50 * n * n_docs) // n.sum()
    want = np.zeros(n_docs, np.int64)
    for d, t, f in zip(doc, term, tf, strict=True):
        want[d] += weight[t] * (10**9 * f // (1000 * f + 20 * m[d])) * (t in places)
    for k in (1, 10, 299, 400):
        found, score = portion.best(places, k)
        least = max(np.sort(want)[::-1][: k][-1], 1)
        assert set(np.flatnonzero(want >= least)) <= set(found.tolist())
        assert (score == want[found]).all()


def test_stops_before_the_end():
    """A rare term decides, so the list of the common one is completed for few documents only."""
    n = 5000
    doc, term = np.concatenate([np.arange(n), np.arange(60)]), np.concatenate([np.zeros(n, int), np.ones(60, int)])
    portion = lexical_search.Portion(np.full(n, 10), doc, term, np.ones(len(doc), int), np.array([5, 9000]), n, 10 * n)
    found, score = portion.best(np.array([0, 1]), 50)
    assert sorted(found.tolist()) == list(range(60)) and len(set(score.tolist())) == 1


def test_awkward(spark, awkward, empty):
    items = spark.createDataFrame([(1, "The cat, the MAT"), (2, "漢字"), (3, None)], "item_id long, text string")
    got = lexical_search.ranked(awkward, items).collect()
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in got], key=str) == plain(docs, [(r.item_id, r.text) for r in items.collect()], 50)
    assert lexical_search.ranked(empty, items).count() == 0
    assert lexical_search.ranked(awkward, items.limit(0)).count() == 0
    assert lexical_search.ranked(awkward, items.where("item_id = 3")).columns == ["item_id", "rank", "id", "score"]
