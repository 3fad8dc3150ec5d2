import hashlib

import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import fingerprints


def prints(spark, df):
    return {(r.doc_id, r.n_chars, r.edited_sha256): (r.fingerprint, r.edited_fingerprint, r.next_fingerprint) for r in fingerprints.edited(df).collect()}


def simhash(spark, text):
    """The same votes, one by one."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").lower()).split(" ") if w]
    pairs = list(zip(words, [*words[1:], None], strict=False))
    if not pairs:
        return 0
    hashed = [r.h & (1 << 64) - 1 for r in spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()]
    bits = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashed) > len(hashed))
    return bits - (1 << 64) if bits >> 63 else bits


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_against_brute_force(spark, table, partitions):
    texts = ["alpha beta gamma delta " * 5, None, "é😀 x y z", "one two three four five six seven eight", "", "the same text here", "the same text here", "abc"]
    ids = [40, 3, 17, 5, 90, 61, 62, 7]
    got = prints(spark, table(texts, ids).repartition(partitions))
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        key = (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[key] == (simhash(spark, text), simhash(spark, edited), simhash(spark, after))
    assert len(got) == len(order)


def test_ranges_join_up(spark):
    """Many ranges, so that most next rows lie in another one."""
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        df = spark.range(500).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" with more words")).alias("text")).repartition(4)
        got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    text = lambda k: f"text number {k % 500} with more words"
    for k in range(500):
        n = len(text(k))
        assert got[k * 7] == hashlib.sha256((text(k)[: n - n // 4] + text(k + 1)[: n // 4]).encode()).hexdigest()


def test_awkward(spark, awkward, empty, table):
    got = fingerprints.edited(awkward).collect()
    assert len(got) == awkward.count()
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert fingerprints.edited(empty).count() == 0
    lone = fingerprints.edited(table(["a b c d e f g h"])).first()
    assert lone.edited_sha256 == hashlib.sha256(b"a b c d e f" + b" "[:1] + b"a b").hexdigest()
    assert lone.next_fingerprint == lone.fingerprint


def test_neighbours_against_all_pairs(spark):
    base = [0x0123456789ABCDEF, -1, 0, 0x7FFF0000FFFF0000]
    flips = [(), (0,), (63,), (5, 40), (1, 30, 62), (2, 3, 4), (7, 20, 33, 50)]
    signed = lambda x: x - (1 << 64) if x >> 63 & 1 else x
    points = sorted({signed((b & (1 << 64) - 1) ^ sum(1 << k for k in f)) for b in base for f in flips})
    df = spark.createDataFrame([(p,) for p in points] * 2, "fingerprint long")
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for radius in (1, 3):
        want = {(a, b, distance(a, b)) for a in points for b in points if a != b and distance(a, b) <= radius}
        assert {tuple(r) for r in fingerprints.neighbours(df, df, radius, radius + 3).collect()} == want
    with pytest.raises(ValueError, match="more blocks"):
        fingerprints.neighbours(df, df, 3, 3)


def test_neighbours_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), ["doc_id"]).collect()}
    others = set(prints.values())
    near = lambda a: sum(1 for b in others if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= fingerprints.RADIUS)
    got = {r.doc_id: r.n_near for r in fingerprints.fingerprint_neighbours(spark, sf).collect()}
    assert got == {i: near(p) for i, p in prints.items() if i % 50 == 0}


def test_neighbours_broadcast_no_exploded_side(spark):
    """Twenty keys a fingerprint aren't counted in Spark's estimate, so a broadcast would take the whole index to the driver."""
    df = spark.range(1000).select(F.xxhash64("id").alias("fingerprint"))
    plan = fingerprints.neighbours(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
