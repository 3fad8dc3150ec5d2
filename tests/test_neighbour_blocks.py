"""How often rows are sent in the neighbour join, and its candidates against sorting everything."""

import numpy as np
import pytest

from sparrowmill.operators import neighbours


def test_cells_with_few_queries_share_a_block(spark, monkeypatch):
    """In many dimensions every cell needs nearly every row; 40 queries in a block of their own cell each would have the rows sent some 20 times."""
    x = np.random.default_rng(1).normal(size=(600, 16))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, vector array<double>")
    plain, sent = neighbours.streamed, []

    def counted(asked, rows, *rest):
        sent.append(rows.count())
        return plain(asked, rows, *rest)

    monkeypatch.setattr(neighbours, "streamed", counted)
    got = sorted((r.query, r.place, r.id) for r in neighbours.nearest(df, df.where("id % 15 = 0"), 5, exclude_self=True).collect())
    want = [(q, p + 1, int(i)) for q in range(0, 600, 15) for p, i in enumerate(np.argsort([np.inf if i == q else np.linalg.norm(x[i] - x[q]) for i in range(600)])[:5])]
    assert got == want and sent[0] <= 600


@pytest.mark.parametrize("seed", range(3))
def test_nearest_so_far_against_sorting(seed):
    """Ties, batches of any size, and far-off coordinates where products lose most places."""
    draw = np.random.default_rng(seed)
    x, q = np.round(draw.normal(size=(3000, 3)), 1) + [0, 0, 1e5 * seed], np.round(draw.normal(size=(40, 3)), 1) + [0, 0, 1e5 * seed]
    ids, best, at = draw.permutation(3000), neighbours._Nearest(40, 7), 0
    while at < 3000:
        rows, names = x[at : at + 1 + 300 * seed], ids[at : at + 1 + 300 * seed]
        squares, square = (q**2).sum(1), (rows**2).sum(1)
        measured = lambda i, c, rows=rows, names=names: [d := np.sqrt(((rows[c] - q[i]) ** 2).sum(1)), names[c], d]
        best.offer(np.arange(40), squares[:, None] + square - 2 * q @ rows.T, 1e-12 * (squares.max() + square.max()), measured)
        at += len(rows)
    best.merge()
    query, distance, found, _ = best.kept
    for i in range(40):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        order = np.lexsort((ids, d))[:7]
        assert found[query == i].tolist() == ids[order].tolist() and distance[query == i].tolist() == d[order].tolist()
