"""Cohorts: which stays are studied, their time window, their outcome and their split.

Defined results: rows without an id or a start are dropped; unknown death and discharge times count as not having happened;
rows that tie in time are ordered by their id. The joins carry no hints: Spark measures both sides and picks the strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

ADULT = 18


def later(at: Column, hours: float) -> Column:
    return at + F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(round(hours % 1 * 60))))


def joined_stays(stays: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Stays with their admission and patient; columns of a patient that clash get `_pat`."""
    both = stays.join(admissions, ["subject_id", "hadm_id"], "left")
    clash = {c: f"{c}_pat" for c in patients.columns if c in both.columns and c != "subject_id"}
    return both.join(patients.withColumnsRenamed(clash), "subject_id", "left")


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group; ties beyond `order` are the caller's to break."""
    place = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def died_within(death: Column, start: Column, stop: Column) -> Column:
    """1 if death falls in [start, stop]; a missing stop is open."""
    return F.coalesce(death.isNotNull() & (death >= start) & (stop.isNull() | (death <= stop)), F.lit(False)).cast("int")


def died_in_hospital(death: Column, start: Column, discharge: Column, flag: Column, strictly_after: bool = False) -> Column:
    """1 for a death from `start` on (after it, if `strictly_after`) and before discharge; without a death time, the flag decides."""
    begun = death > start if strictly_after else death >= start
    seen = begun & (discharge.isNull() | (death <= discharge))
    return F.when(death.isNotNull(), F.coalesce(seen, F.lit(False)).cast("int")).otherwise(F.coalesce(flag.cast("int"), F.lit(0)))


def at_risk(death: Column, discharge: Column, landmark: Column) -> Column:
    """Whether a stay is neither dead nor discharged at its landmark."""
    return (death.isNull() | (death > landmark)) & (discharge.isNull() | (discharge > landmark))


def earlier_transfers(cohort: DataFrame, transfers: DataFrame, key: str = "hadm_id", stay: str = "stay_id", start: str = "intime", moved: str = "moved", unit: str = "careunit", tie: str = "careunit") -> DataFrame:
    """The cohort with `n_before`, the transfers that began before the stay, and `last_before`, the unit of the last of them."""
    before = transfers.join(cohort.select(key, stay, F.col(start).alias("_start")), key).where(F.col(moved) < F.col("_start"))
    # one aggregate gives both: max_by over (time, tie) instead of a sort for each stay
    counts = before.groupBy(stay).agg(F.count("*").alias("n_before"), F.max_by(unit, F.struct(moved, tie)).alias("last_before"))
    out = cohort.join(counts, stay, "left")
    return out.withColumn("n_before", F.coalesce("n_before", F.lit(0))).withColumn("last_before", F.coalesce("last_before", F.lit(scalars.UNKNOWN)))


def build(stays: DataFrame, admissions: DataFrame, patients: DataFrame, transfers: DataFrame | None = None, hours: int = 48, require_at_risk: bool = True) -> DataFrame:
    """Adult first stays of each admission with window [intime, feature_end], outcomes and what happened before."""
    df = joined_stays(stays, admissions, patients)
    for name, kind in (("dod", "timestamp_ntz"), ("deathtime", "timestamp_ntz"), ("hospital_expire_flag", "int"), ("outtime", "timestamp_ntz"), ("dischtime", "timestamp_ntz")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    df = df.withColumn("age", scalars.age(F.col("anchor_age"), F.col("anchor_year"), F.col("intime"))).where(F.col("age") >= ADULT)
    df = df.dropna(subset=["stay_id", "hadm_id", "subject_id", "intime"])
    df = first_per_group(df, ["hadm_id"], ["intime", "stay_id"]).withColumn("feature_end", later(F.col("intime"), hours)).withColumn("observed_hours", F.lit(hours))
    death, end = F.coalesce("deathtime", "dod"), F.col("feature_end")
    df = df.withColumn("icu_mortality", died_within(death, F.col("intime"), F.col("outtime")))
    df = df.withColumn("hospital_mortality", died_in_hospital(death, F.col("intime"), F.col("dischtime"), F.col("hospital_expire_flag")))
    if require_at_risk:
        df = df.where(at_risk(death, F.col("dischtime"), end))
        df = df.withColumn("hospital_mortality", died_in_hospital(death, end, F.col("dischtime"), F.col("hospital_expire_flag"), strictly_after=True))
    if transfers is not None:
        df = earlier_transfers(df, transfers.withColumnRenamed("intime", "moved"))
        df = df.withColumnsRenamed({"n_before": "n_transfers_before_icu", "last_before": "last_pre_icu_careunit"})
    return df


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    """A random order that any engine can repeat: md5 of the seed and the values."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).cast("binary"))


def stratified_split(df: DataFrame, subject: str, label: str, test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """(subject, label, split): one row a subject, label the greatest of its rows, each label split by the same shares.

    Subjects of a label are put in buckets of their hash; only counts of buckets are summed up in order, and only a
    subject's place within its bucket needs a sort, so no task sorts a whole label.
    """
    subjects = df.groupBy(subject).agg(F.max(label).alias(label)).withColumn("_order", hash_order(subject, seed=seed))
    bucketed = subjects.withColumn("_bucket", F.substring("_order", 1, 3))
    counts = bucketed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(label).orderBy("_bucket")
    counts = counts.select(label, "_bucket", (F.sum("_n").over(running) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    inside = Window.partitionBy(label, "_bucket").orderBy("_order", subject)
    placed = bucketed.withColumn("_place", F.row_number().over(inside)).join(counts, [label, "_bucket"]).withColumn("_place", F.col("_place") + F.col("_before"))
    n_test, n_val = F.ceil(F.col("_all") * test), F.ceil(F.col("_all") * val)
    split = F.when(F.col("_place") <= n_test, "test").when(F.col("_place") <= n_test + n_val, "val").otherwise("train")
    return placed.select(subject, label, split.alias("split"))
