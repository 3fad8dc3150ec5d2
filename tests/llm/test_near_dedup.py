import random
import re
from itertools import combinations

import numpy as np
import pytest

from sparrowmill.llm import components, near_dedup


def sets_of(texts, size):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(ids, texts, size, percent):
    sets, root = sets_of(texts, size), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def corpus(seed=1):
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randrange(400)
    texts = []
    for _ in range(60):
        base = [word() for _ in range(draw.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 3, 8])):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                own[draw.randrange(len(own))] = word()
            texts.append(" ".join(own).upper() if draw.random() < 0.3 else "\t".join(own))
    return texts


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (2, 90)])
def test_components_against_all_pairs(spark, table, size, percent):
    texts = corpus()
    ids = [3 * k + 1 for k in range(len(texts))]
    random.Random(2).shuffle(ids)
    want = brute(ids, texts, size, percent)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(texts, ids).repartition(5), size=size, percent=percent).collect()}
    assert got == want


def test_a_bucket_of_many_groups(spark, table):
    """Documents that share most of their text fall in the same buckets; groups inside still have to be told apart."""
    draw = random.Random(3)
    shared = [f"s{k}" for k in range(150)]
    texts = []
    for g in range(12):
        own = [f"g{g}x{k}" for k in range(60)]
        for _ in range(6):
            tail = list(own)
            tail[draw.randrange(60)] = "odd%d" % draw.randrange(10**6)
            texts.append(" ".join(shared + tail))
    ids = list(range(len(texts)))
    got = {r.id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(texts, ids), size=4).collect()}
    assert got == brute(ids, texts, 4, 80)


def test_densified_sketches():
    draw = np.random.default_rng(5)
    hashes = np.sort(draw.integers(0, 1 << 63, 7, dtype=np.uint64) * np.uint64(2))
    sketch = near_dedup.one_permutation(hashes, np.zeros(7, np.int64), 2, 64)
    assert set(sketch[0]) <= set(hashes) and (sketch[1] == 0).all()
    # equal sets have equal sketches, and the share of equal bins is near the resemblance
    a = np.unique(draw.integers(0, 1 << 62, 400, dtype=np.uint64) * np.uint64(4))
    b = np.sort(np.concatenate([a[:300], np.unique(draw.integers(0, 1 << 62, 100, dtype=np.uint64) * np.uint64(4))]))
    both = near_dedup.one_permutation(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 2048)
    assert abs((both[0] == both[1]).mean() - 300 / 500) < 0.08


def test_awkward(spark, awkward, empty):
    got = near_dedup.near_duplicates(awkward, size=4).collect()
    assert len(got) == awkward.count()
    by = {r.id: r for r in got}
    assert all(by[k].n_shingles == 0 and by[k].component_id == k for k in (0, 1, 2))
    assert by[3].n_shingles == 1 and by[4].component_id == by[5].component_id == 4
    assert by[None].component_id is None
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicated(awkward, size=4)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [(False, k) for k in (0, 1, 2, 3, 4, 6, 7, 8, 11)]


def test_only_repeats_of_one_row(spark, table):
    same = near_dedup.deduplicated(table(["a b c d e f"] * 4, [9, 9, 9, 9]))
    assert same.count() == 1
    copies = near_dedup.near_duplicates(table(["a b c d e f"] * 300)).collect()
    assert {r.component_id for r in copies} == {0} and sum(r.kept for r in copies) == 1


def test_repeated_ids_are_judged_by_their_own_text(spark, table):
    a, b, c = ("one two three four five six seven", "some quite different words stand in here", "again another text with words of its own")
    rows = [(1, a), (7, a), (7, b), (7, b.upper()), (7, b), (7, ""), (7, None), (8, c), (9, c)]
    kept = near_dedup.deduplicated(table([t for _, t in rows], [k for k, _ in rows]).repartition(3)).select("doc_id", "text").collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in kept) == [(1, a), (7, ""), (7, b), (8, c)]


def test_boilerplate_below_the_threshold_makes_no_pairs(spark):
    """Sets that share 85 % of their shingles (likeness 0.74) don't meet in the exact pass, however many there are; those alike do."""
    rows = [(bytes([k]), bytes([k]), [*range(85), *range(1000 * k + 1000, 1000 * k + 1015)]) for k in range(60)]
    rows += [(bytes([100 + k]), bytes([100 + k]), [*range(5000, 5092), *range(900_000 + 10 * k, 900_008 + 10 * k)]) for k in range(2)]
    df = spark.createDataFrame(rows, "node binary, root binary, shingles array<long>")
    got = near_dedup._rest(df.select("node", "shingles"), df.select("node", "root"), 80).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in got] == [(bytes([100]), bytes([101]))]


def test_exact_pass_is_linear_in_a_text(spark, monkeypatch):
    """Rows of the exact pass have a fixed size: long texts that share most shingles write no arrays."""
    written = []
    plain = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: written.append((name, df.schema)) or plain(df, name))
    shared = list(range(20_000))
    rows = [(bytes([k]), bytes([k]), [*shared, *range(10**6 * (k + 1), 10**6 * (k + 1) + 2000)]) for k in range(5)]
    df = spark.createDataFrame(rows, "node binary, root binary, shingles array<long>")
    assert near_dedup._rest(df.select("node", "shingles"), df.select("node", "root"), 80).count() == 10
    assert not [name for name, schema in written if any(f.dataType.typeName() == "array" for f in schema)]


def test_components(spark):
    draw = random.Random(7)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + draw.randrange(30), 100 + draw.randrange(30)) for _ in range(25)] + [(200, 200 + k) for k in range(1, 50)] + [(300, 300)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {i: find(i) for i in root}
