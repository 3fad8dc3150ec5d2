r"""SimHash document fingerprints, natively in Spark.

Terms are pairs of neighbouring words (`[^\x20\x09-\x0D]+`, lower-cased; the last word alone ends the list), each weighted by how
often it occurs. Every occurrence votes with its 64 hash bits; a bit is set if more than half of the votes set it. Votes are
plain sums: two bits are counted in the halves of one long, so 32 sums hold all votes, in code-generated partial aggregates.

`neighbours` finds all fingerprints within a Hamming radius by permuted block tables: the bits are cut into blocks, and in
every choice of radius blocks at least one leaves all differing bits out, so equality on the other blocks finds each pair.

Defined results: a null text counts as empty; a text without words has the zero fingerprint; equal texts have equal
fingerprints; likeness is 1 - distance / 64, so 1 for two empty texts. In `edited`, rows with the same id follow in order of
their text, and a null id comes first; a single row is its own next row; an empty table gives an empty result. A text of any length is split
into words whole, in one row, and its votes are sums; rows of one repeated id, or without id, are put in order in one task. Only the
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import documents, written

BITS = 64
RADIUS = 3
BLOCKS = 6
_HALVES = 0x0000000100000001
_SPACES = r"[\x20\x09-\x0D]+"
#: Ranges of ids for each shuffle partition; more make the partitions even.
RANGES = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPACES), lambda w: w != "")


def terms(name: str) -> Column:
    """Hashes of the pairs of neighbouring words and of the last word, from a column of words (a column, lest the split be repeated)."""
    return F.zip_with(name, F.slice(name, 2, F.greatest(F.size(name), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def votes() -> list[Column]:
    """Aggregates over a column `term`: set bits k and k + 32 in the halves of sum k, and the number of terms."""
    sums = [F.coalesce(F.sum(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(_HALVES))), F.lit(0)).alias(f"v{k}") for k in range(32)]
    return [*sums, F.count("term").alias("n_terms")]


def from_votes() -> Column:
    bits = []
    for k in range(32):
        for half, count in ((0, F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(f"v{k}", 32))):
            bits.append(F.when(count * 2 > F.col("n_terms"), F.shiftleft(F.lit(1).cast("long"), k + half)).otherwise(F.lit(0).cast("long")))
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def as_hex(fingerprint: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def fingerprints(df: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(*key, fingerprint) as a long for each distinct key; the terms of rows with the same key vote together."""
    split = df.select(*key, words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    exploded = split.select(*key, F.explode_outer(terms("words")).alias("term"))
    return exploded.groupBy(*key).agg(*votes()).select(*key, from_votes().alias("fingerprint"))


def neighbours(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, other, distance): for each distinct query fingerprint all others of the index within the radius.

    Rows are distinct fingerprints, so copies of a text cost nothing here: join back to list the documents of a fingerprint.
    """
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = []
    for left_out in combinations(range(blocks), radius):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in range(blocks) if b not in left_out)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keys = lambda name: F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(mask)) for mask in masks])).alias("table", "bits")
    asked = queries.select("fingerprint").distinct().select("fingerprint", keys("fingerprint"))
    there = index.select(F.col("fingerprint").alias("other")).distinct().select("other", keys("other"))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other")))
    # Spark takes a table with its keys for as small as the table it comes from, and would broadcast all of it; so both sides are sorted
    return asked.join(there.hint("merge"), ["table", "bits"]).where((distance <= radius) & (F.col("fingerprint") != F.col("other"))).select("fingerprint", "other", distance.alias("distance")).distinct()


def _ranges(df: DataFrame, key: Column) -> list[int]:
    """Ids that begin ranges of about equally many rows, the least id first; ids in the data, at most RANGES a partition."""
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.min(key).alias("least"), F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n).alias("bounds")).first()
    return sorted({found["least"], *found["bounds"]}) if found["least"] is not None else []


def edited(df: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint).

    The next row is found within ranges of ids, never in one global window. The first row of each range is copied to the end
    of the range before it (the very first row to the last range), so that one shuffle of the texts serves everything.
    """
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = _ranges(df, order)
    rows = df.select("doc_id", order.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    starts = F.array(*[F.lit(b).cast("long") for b in bounds or [0]])
    last = max(len(bounds) - 1, 0)
    # the range of a key by two short searches, among every `step`th start and then between two of these
    step = max(1, int(len(bounds) ** 0.5))
    upto = lambda part: F.size(F.filter(part, lambda b: b <= F.col("key")))
    rows = rows.withColumn("coarse", (upto(F.array(*[F.lit(b).cast("long") for b in (bounds or [0])[::step]])) - 1) * step)
    rows = rows.withColumn("own", F.col("coarse") + upto(F.slice(starts, F.col("coarse") + 1, F.lit(step))) - 1)
    own = F.col("own")
    before = F.when(own == 0, F.struct(F.lit(last).alias("range"), F.lit(2).alias("part"))).otherwise(F.struct((own - 1).alias("range"), F.lit(1).alias("part")))
    at = F.struct(own.alias("range"), F.lit(0).alias("part"))
    placed = rows.select("*", F.inline(F.when(F.get(starts, own) == F.col("key"), F.array(at, before)).otherwise(F.array(at))))

    follows = Window.partitionBy("range").orderBy("part", "key", "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    paired = placed.select("range", "part", "doc_id", "text", F.row_number().over(follows).alias("position"), F.lead("text").over(follows).alias("next"))
    change = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    both = paired.select("range", "part", "position", "doc_id", n.cast("long").alias("n_chars"), "text", change.alias("change"))
    both = both.select("range", "part", "position", "doc_id", "n_chars", F.sha2(F.col("change").cast("binary"), 256).alias("edited_sha256"), words(F.col("text")).alias("own"), words(F.col("change")).alias("other"))
    key = ["range", "part", "position", "doc_id", "n_chars", "edited_sha256"]
    sides = both.select(*key, F.inline(F.array(*[F.struct(F.lit(k).alias("side"), terms(side).alias("terms")) for k, side in enumerate(("own", "other"))])))
    printed = sides.select(*key, "side", F.explode_outer("terms").alias("term")).groupBy(*key, "side").agg(*votes()).select(*key, "side", from_votes().alias("fingerprint"))
    joined = printed.groupBy(*key).agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    ahead = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("position"))
    return joined.select("*", ahead.alias("next_fingerprint")).where("part = 0").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    prints = edited(documents(spark, sf_dir).select("doc_id", "text"))
    return prints.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("fingerprint").alias("fingerprint"),
        as_hex("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def fingerprint_neighbours(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, n_near) for every document whose id is divisible by 50: other fingerprints of all documents within RADIUS."""
    prints = written(fingerprints(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"]), "fingerprints")
    asked = prints.where("doc_id % 50 = 0")
    near = neighbours(asked, prints).groupBy("fingerprint").agg(F.count("*").alias("n_near"))
    return asked.join(near, "fingerprint", "left").select("doc_id", as_hex("fingerprint").alias("fingerprint"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
