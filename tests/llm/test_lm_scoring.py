import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import lm_scoring


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s> "]


class Plain:
    """The same model by nested formulas over whole dictionaries."""

    def __init__(self, texts, order, weight=lm_scoring.WEIGHT):
        self.order, self.weight, self.counts, self.contexts = order, weight, Counter(), Counter()
        for text in texts:
            stream = ["<s> ", *words(text)]
            for k in range(1, len(stream)):
                for n in range(1, min(order, k + 1) + 1):
                    self.counts[tuple(stream[k - n + 1 : k + 1])] += 1
                    self.contexts[tuple(stream[k - n + 1 : k])] += 1
        self.known = {g[0] for g in self.counts if len(g) == 1}
        self.n = self.contexts[()]

    def chance(self, context, word):
        if not context:
            return (self.counts[word,] + 0.1) / (self.n + 0.1 * (len(self.known) + 1))
        lower = self.chance(context[1:], word)
        return (self.counts[*context, word] + self.weight * lower) / (self.contexts[context] + self.weight)

    def score(self, text, order=None):
        stream, order = ["<s> ", *words(text)], order or self.order
        return sum(math.log10(self.chance(tuple(stream[max(0, k - order + 1) : k]), stream[k])) for k in range(1, len(stream)))


TEXTS = ["a b a c", "A b a b", None, "", "a b a c", "x　y é É b", "c b a b a c x", "a", "never seen words", "a b  new\ta b"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block_bytes", [10, 1 << 20])
def test_scores_against_nested_formulas(spark, table, order, block_bytes):
    """The walk through a part of the automaton, failure arcs and all, gives the interpolated probabilities of the whole model."""
    train = F.col("doc_id") < 8
    got = {r.id: r for r in lm_scoring.scored(table(TEXTS).repartition(3), train, order=order, block_bytes=block_bytes).collect()}
    plain = Plain(TEXTS[:8], order)
    for i, text in enumerate(TEXTS):
        tokens = words(text)
        assert (got[i].train, got[i].n_tokens, got[i].train_tokens) == (i < 8, len(tokens), plain.n)
        assert got[i].n_known == sum(t in plain.known for t in tokens)
        assert got[i].base_score == pytest.approx(plain.score(text, 1))
        assert got[i].score == pytest.approx(plain.score(text))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_every_state_is_a_distribution(order):
    plain = Plain(TEXTS[:8], order)
    for context in {c for c in plain.contexts if len(c) < order} | {("b", "never")[: order - 1]}:
        assert sum(plain.chance(context, w) for w in [*plain.known, "a word that no text holds"]) == pytest.approx(1)


def test_state_is_carried():
    """Nodes after a walk's steps: the state is the longest suffix that the training texts hold."""
    stream, starts = lm_scoring.tokens(pa.array(["a b a c", "b a z"]))
    train = np.repeat([True, False], np.diff(starts))
    sums = Counter()
    for key, at in lm_scoring.grams(stream, starts, 3):
        sums.update(key[at][train[at]].tolist())
    automaton = lm_scoring.Automaton(stream, starts, lambda asked: np.array([sums[k] for k in asked.tolist()]), 3, 1.0, 5, 4)
    depth = lambda node: int(automaton.depth[node])
    state, seen = automaton.start_state, []
    for arcs in zip(*[a[starts[1] + 1 : starts[2]].tolist() for a in automaton.arcs], strict=True):
        while arcs[depth(state)] < 0:
            state = automaton.fail[state]
        state = int(automaton.after[arcs[depth(state)]])
        seen.append(depth(state))
    assert seen == [1, 2, 0, 1]  # b (no text begins with it), b a, an unknown word, the end


def test_counts_above_a_byte(spark, table):
    texts = ["often " * 300, "often often", "rare"]
    got = {r.id: r for r in lm_scoring.scored(table(texts), F.lit(True), order=2, block_bytes=8).collect()}
    plain = Plain(texts, 2)
    assert [got[k].score for k in range(3)] == pytest.approx([plain.score(t) for t in texts])


def test_held_out_texts_teach_nothing(spark, table):
    score = lambda texts: {r.id: (r.score, r.base_score) for r in lm_scoring.scored(table(texts), F.col("doc_id") < 8).collect() if r.id < 8}
    assert score(TEXTS) == score([*TEXTS[:8], "a b a c " * 50, "quite different"])


def test_awkward(spark, awkward, empty):
    out = lm_scoring.scored(awkward, F.col("doc_id") < 9)
    got = out.collect()
    assert out.columns == ["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and len(got) == awkward.count()
    assert {r.id: r.n_tokens for r in got if r.id in (0, 1, 2, 6)} == {0: 1, 1: 1, 2: 1, 6: 60_001}
    assert [r.train for r in got if r.id is None] == [False]
    assert len({(r.n_tokens, r.score) for r in got if r.id == 5}) == 1 and sum(r.id == 5 for r in got) == 2
    assert lm_scoring.scored(empty, F.lit(True)).count() == 0
    none = lm_scoring.scored(awkward, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in none} == {(0, 0, 0.0, 0.0)}
