r"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words: a share of all words by weight, held at a cap times the source's own words, the
excess shared again by weight until no source is above its cap. A source whose target is r times its words wants r copies of a
document on average; each document's own number lies around r by its weight (its length in bits, or a column), within SPREAD of
the room that 0 and the cap leave, so that the source's words still add up to the target. The whole part of that
number are certain copies; for the rest p a sample of fixed size, in words, is drawn in Pareto order: documents rank by random
odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), u from a hash of seed and id. Ranks are taken while the words still
fit, then the one document that comes closest to the rest.

The cut in Pareto order isn't found by sorting a source in one task: words are summed in BINS bins of rank, the running
sum over bins shows the bin that holds the cut, and only that bin's distinct (rank, id, size) are sorted. Rows that tie there, repeats
of one id, are counted by the partition of the table that they are in.

Defined results: a null text has size 0, and a document of size 0 takes 0 words; a null source is a source of its own,
last in order; a null id draws as the text `null`; repeated rows are separate documents with the same rank; null and negative weights
count as 0, others to three places; an empty table gives an empty result. Only the id, text, source and weight columns are read, so
others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, documents, keyed_join, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 17
SPREAD = 0.5
BINS = 4096


def word_count(text: str | Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of seed and id, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Water filling: with sources in order of cap / weight, the level is found at the first source that it doesn't drown.
    The windows run over one row a source, not over documents.
    """
    every = Window.partitionBy(F.lit(0))
    position = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int")).alias("weight"))
    ratio = F.col("source_size") * cap / F.col("weight")
    up = every.orderBy("ratio", F.col("source").asc_nulls_last())
    level = (F.col("total") * share - F.col("below")) / F.col("ahead")
    filled = (
        weighed.withColumn("ratio", ratio)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("below", F.coalesce(F.sum(F.col("source_size") * cap).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ahead", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    )
    return filled.select("source", "source_size", F.coalesce(F.least(F.col("source_size") * cap, F.col("water") * F.col("weight")), F.col("source_size") * cap).alias("target"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED,
    weight_col: str | None = None, spread: float = SPREAD,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each document; taken = copies * size."""
    size = word_count(F.col(text_col))
    # weights are whole numbers, so that sums are exact and the same in every order
    weight = F.length(F.bin(size)) if weight_col is None else F.coalesce(F.greatest(F.round(F.col(weight_col) * 1000), F.lit(0)), F.lit(0))
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), weight.cast("long").alias("weight"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    some = F.when(F.col("size") > 0, F.col("weight"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("weight") * F.col("size")).alias("weighed"), F.min(some).alias("least"), F.max(some).alias("most"))
    sums = written(sums, "mix-sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    of = lambda left, right: left.join(right, same(left, right), "left").drop(right["source"])  # noqa: E731; one row a source on the right
    level = targets(sums.select("source", "source_size"), weights, share, cap).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("weighed") / F.col("source_size"))
    plan = of(level, sums.drop("source_size")).withColumn("mean", mean).withColumn("reach", F.greatest(F.col("most") - F.col("mean"), F.col("mean") - F.col("least")))
    plan = written(plan.select("source", "source_size", "target", "ratio", "mean", "reach", (F.least("ratio", cap - F.col("ratio")) * spread).alias("room")), "mix-plan")
    own = F.when(F.col("reach") > 0, F.col("ratio") + F.col("room") * ((F.col("weight") - F.col("mean")) / F.col("reach"))).otherwise(F.col("ratio"))
    own = F.when(F.col("size") > 0, own).otherwise(0.0)
    u, p = uniform(F.col("id"), seed), F.col("chance")
    odds = F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))
    ranked = of(sized, plan).withColumn("own", own).withColumn("whole", F.floor("own")).withColumn("chance", F.col("own") - F.col("whole")).withColumn("rank", odds)
    ranked = ranked.select("id", "source", "size", "source_size", "target", "whole", "rank", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).alias("bin"), "row")
    ranked = written(ranked, "mix-ranks")

    rest = written(ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest")), "mix-rest")
    drawn = ranked.where(F.col("rank").isNotNull())
    running = lambda *order: Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *order: F.coalesce(F.sum("words").over(running(*order)), F.lit(0))
    bins = of(drawn.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("before", before("bin")), rest)
    cut = written(bins.where(F.col("before") + F.col("words") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bin", "before", "rest")).alias("at")).select("source", "at.*"), "mix-cuts")
    inside = of(drawn, cut.withColumnsRenamed({"bin": "cut", "before": "below"})).where(F.col("bin") == F.col("cut"))
    alike = inside.groupBy("source", "rank", "id", "size").agg(F.count("*").alias("n"), F.first("below").alias("below"), F.first("rest").alias("rest")).withColumn("words", F.col("n") * F.col("size"))
    left = F.col("rest") - F.col("below") - before("rank", "id", "size")
    alike = alike.withColumn("fit", F.when(F.col("size") > 0, F.floor(F.greatest(left, F.lit(0.0)) / F.col("size"))).otherwise(F.col("n"))).where(F.col("fit") < F.col("n"))
    edge = written(alike.groupBy("source").agg(F.min(F.struct("rank", "id", "size", "fit")).alias("edge")), "mix-edges")
    # a source without a cut takes all that is drawn
    place = F.struct("rank", "id", "size")
    end = F.struct(F.col("edge.rank").alias("rank"), F.col("edge.id").alias("id"), F.col("edge.size").alias("size"))
    at = of(ranked, edge).withColumn("extra", F.col("rank").isNotNull() & (F.col("edge").isNull() | (place < end)))
    at = at.withColumn("tied", F.coalesce((place == end) & (F.col("edge.fit") > 0), F.lit(False)))
    tied = at.where("tied").select("source", "row", F.shiftright("row", 33).alias("part"), F.col("edge.fit").alias("fit"))
    counts = tied.groupBy("source", "part").agg(F.count("*").alias("words"))
    if not counts.isEmpty():
        earlier = counts.select("source", "part", before("part").alias("earlier"))
        position = F.row_number().over(Window.partitionBy("source", "part").orderBy("row"))
        taken = tied.withColumn("position", position).join(earlier.withColumnsRenamed({"source": "of", "part": "own"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("own")))
        taken = taken.where(F.col("position") + F.col("earlier") <= F.col("fit")).select("row", F.lit(True).alias("fits"))
        at = at.join(taken, "row", "left").withColumn("extra", F.col("extra") | F.coalesce("fits", F.lit(False)))
    placed = written(at.select("id", "source", "size", "source_size", "target", "whole", "rank", "row", "extra"), "mix-drawn")
    some = F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))
    gap = of(placed.groupBy("source").agg(some.alias("some")), rest).select("source", (F.col("rest") - F.col("some")).alias("gap"))
    miss = F.abs(F.col("gap") - F.col("size"))
    gaps = written(gap, "mix-gaps")
    open_ = of(placed.where(~F.col("extra") & F.col("rank").isNotNull() & (F.col("size") > 0)), gaps).where(miss < F.col("gap"))
    last = written(open_.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "id", "size", "row"))["row"].alias("last")), "mix-last")
    discard(sized, sums, plan, ranked, rest, cut, edge, gaps)
    copies = F.col("whole") + (F.col("extra") | F.coalesce(F.col("row") == F.col("last"), F.lit(False))).cast("long")
    return of(placed, last).select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `df` that the mix takes, with `copies`, how often it takes each; repeated rows of an id count as the mean of theirs, rounded up."""
    taken = mix(df, id_col, **options).where("copies > 0").groupBy(F.col("id").alias(id_col)).agg(F.ceil(F.avg("copies")).alias("copies"))
    return keyed_join(df.drop("copies"), written(taken, "mix-taken"), id_col, "inner").select(*df.drop("copies").columns, "copies")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, with production weights."""
    return as_contract(mix(documents(spark, sf_dir)))


def as_contract(mixed: DataFrame) -> DataFrame:
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mix_sql(relation: str = "documents") -> str:
    """DuckDB SQL for the rows of `op9_mixing` over a relation."""
    weight = f"(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} " + " ".join(f"WHEN {k} THEN {float(w)}::DOUBLE" for k, w in enumerate(WEIGHTS)) + " END)"
    return f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, length(bin(size)) AS weight, row_number() OVER () AS row
      FROM {relation}),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, {weight} AS weight FROM sizes),
    ratios AS (SELECT *, source_size * {CAP}::DOUBLE / weight AS ratio, sum(source_size) OVER ()::BIGINT AS total FROM weighed),
    levels AS (
      SELECT *, (total * {SHARE}::DOUBLE - coalesce(sum(source_size * {CAP}::DOUBLE) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
    water AS (SELECT arg_min(level, ratio) AS water FROM levels WHERE level <= ratio),
    targets AS (SELECT source, source_size, coalesce(least(source_size * {CAP}::DOUBLE, water * weight), source_size * {CAP}::DOUBLE) AS target FROM levels, water),
    sums AS (SELECT source, sum(weight * size)::BIGINT AS weighed, min(weight) FILTER (size > 0) AS least, max(weight) FILTER (size > 0) AS most FROM sized GROUP BY source),
    means AS (
      SELECT t.*, s.least, s.most, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio, CASE WHEN source_size > 0 THEN weighed::DOUBLE / source_size::DOUBLE END AS mean
      FROM targets t JOIN sums s ON t.source IS NOT DISTINCT FROM s.source),
    plan AS (SELECT *, greatest(most - mean, mean - least) AS reach, least(ratio, {CAP}::DOUBLE - ratio) * {SPREAD}::DOUBLE AS room FROM means),
    owned AS (
      SELECT s.*, p.source_size, p.target,
        CASE WHEN s.size = 0 THEN 0.0::DOUBLE WHEN reach > 0 THEN ratio + room * ((weight - mean) / reach) ELSE ratio END AS own,
        (('0x' || substr(md5('{SEED}:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(16**13)}::DOUBLE AS u
      FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
    drawn AS (SELECT *, floor(own)::BIGINT AS whole, own - floor(own) AS chance FROM owned),
    ranked AS (
      SELECT *, CASE WHEN chance > 0 AND chance < 1 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank,
        target - sum(whole * size) OVER (PARTITION BY source)::BIGINT AS rest FROM drawn),
    upto AS (
      SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size, row ROWS UNBOUNDED PRECEDING) <= rest AS extra FROM ranked),
    gaps AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (extra), 0) AS gap FROM upto WHERE rank IS NOT NULL GROUP BY source),
    last AS (
      SELECT row FROM (
        SELECT u.row, row_number() OVER (PARTITION BY u.source ORDER BY abs(gap - size), rank, doc_id NULLS FIRST, size, u.row) AS k
        FROM upto u JOIN gaps g ON u.source IS NOT DISTINCT FROM g.source WHERE rank IS NOT NULL AND NOT extra AND size > 0 AND abs(gap - size) < gap) WHERE k = 1)
    SELECT doc_id, size, source_size, target, ((whole + (extra OR row IN (SELECT row FROM last))::INT) * size)::BIGINT AS taken FROM upto"""


ORACLE = mix_sql()
