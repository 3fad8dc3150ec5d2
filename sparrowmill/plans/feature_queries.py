"""Queries from raw tables to features: windows, summaries, exposures, cohorts, splits, encoders, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cohort, events, features
from .registry import query
from .tables import COUNTS, DENSE_SQL, FEATURES, HOURS, MEANS, STATS, TOY, TYPES, WINDOWED_SQL, dense, summaries, table, wide, windowed

SUMMARY_SQL = f"""{WINDOWED_SQL},
summary AS (
  SELECT user_id, event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS first, arg_min(value, (-epoch_us(ts), event_id)) AS last,
    min(value) AS min, max(value) AS max, sum(value::DECIMAL(28,6))::DOUBLE / count(*) AS mean
  FROM windowed WHERE value IS NOT NULL GROUP BY user_id, event_type)"""


@query(f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def event_window_summary(spark, sf_dir):
    """First, last, least, greatest and mean value of each user and type in the user's window."""
    return summaries(spark, sf_dir)


@query(f"WITH {SUMMARY_SQL} SELECT user_id, " + ", ".join(f"max({s}) FILTER (event_type = '{t}') AS chart_{s}_item_{t}" for s in STATS for t in TYPES) + " FROM summary GROUP BY user_id")
def event_window_pivot(spark, sf_dir):
    long = features.to_long(summaries(spark, sf_dir), "user_id", "event_type", {s: f"chart_{s}" for s in STATS})
    return features.to_wide(long, "user_id", [f"chart_{s}_item_{t}" for s in STATS for t in TYPES])


@query(f"""WITH {WINDOWED_SQL}, counts AS (SELECT event_type, count(DISTINCT user_id) AS n_entities FROM windowed GROUP BY event_type)
SELECT event_type, n_entities FROM counts WHERE n_entities >= greatest(ceil(0.5 * (SELECT count(DISTINCT user_id) FROM windowed)), 1) ORDER BY n_entities DESC, event_type LIMIT 4""")
def concept_prevalence(spark, sf_dir):
    """Types that half of the users have in their window, the four most frequent at most (a top-k report)."""
    return events.prevalence(windowed(spark, sf_dir), "user_id", "event_type", 0.5, most=4)


@query("""SELECT 'events' AS source, event_type AS concept, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM events GROUP BY event_type
UNION ALL SELECT 'lineitem', l_returnflag, quantile_cont(l_extendedprice, 0.01), quantile_cont(l_extendedprice, 0.99) FROM lineitem GROUP BY l_returnflag""")
def clip_bounds(spark, sf_dir):
    a = events.quantile_bounds(table(spark, sf_dir, "events"), "event_type", "value")
    b = events.quantile_bounds(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return a.select(F.lit("events").alias("source"), F.col("event_type").alias("concept"), "low", "high").unionByName(b.select(F.lit("lineitem").alias("source"), F.col("l_returnflag").alias("concept"), "low", "high"))


SAMPLE = 150


@query(f"""WITH drawn AS (SELECT event_type, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('3|' || event_id), event_id) <= {SAMPLE})
SELECT event_type, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM drawn GROUP BY event_type""")
def sampled_bounds(spark, sf_dir):
    """Quantiles of a uniform sample of SAMPLE values of each type (a sampling operator)."""
    return events.quantile_bounds(table(spark, sf_dir, "events"), "event_type", "value", sample=SAMPLE, ids=["event_id"], seed=3)


@query(f"""WITH {WINDOWED_SQL}, bounds AS (SELECT event_type, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM windowed GROUP BY event_type),
clipped AS (SELECT user_id, w.event_type, ts, event_id, least(greatest(value, low), high) AS value FROM windowed w JOIN bounds b ON w.event_type = b.event_type)
SELECT user_id, event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS first, arg_min(value, (-epoch_us(ts), event_id)) AS last, min(value) AS min, max(value) AS max,
  sum(value::DECIMAL(28,6))::DOUBLE / count(*) AS mean FROM clipped GROUP BY user_id, event_type""")
def clipped_summary(spark, sf_dir):
    w = windowed(spark, sf_dir)
    return events.summary(events.clipped(w, events.quantile_bounds(w, "event_type", "value", 0.05, 0.95), "event_type", "value"), ["user_id", "event_type"], "ts", "value", ["event_id"])


@query("""WITH b AS (SELECT event_type, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM events GROUP BY event_type)
SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN greatest(low, 1.0::DOUBLE) ELSE low END AS low, CASE WHEN event_type IN ('click', 'view') THEN least(high, 200.0::DOUBLE) ELSE high END AS high FROM b""")
def hard_ranges(spark, sf_dir):
    """Quantile bounds cut down to fixed ranges of two types."""
    hard = spark.createDataFrame([("click", 1.0, 200.0), ("view", 1.0, 200.0)], "event_type string, hard_low double, hard_high double")
    return events.within(events.quantile_bounds(table(spark, sf_dir, "events"), "event_type", "value"), hard, "event_type")


@query("""SELECT l_orderkey, l_suppkey, count(*) AS cnt, sum(l_quantity::DECIMAL(28,6))::DOUBLE AS sum, sum(l_quantity::DECIMAL(28,6))::DOUBLE / count(l_quantity) AS mean, max(l_quantity) AS max,
sum(l_extendedprice::DECIMAL(28,6))::DOUBLE AS sum_second FROM lineitem GROUP BY ALL""")
def exposure_agg(spark, sf_dir):
    return events.exposure(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], "l_quantity", "l_extendedprice")


INTERVALS_SQL = """intervals AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN l_shipdate END AS start, CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate + to_days(l_linenumber) END AS stop FROM lineitem)"""


def _intervals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    stop = F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_linenumber"))
    return lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 4 != 0, F.col("l_shipdate")).alias("start"), F.when(F.col("l_linenumber") % 3 != 0, stop).alias("stop"))


def _order_windows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("intime"), cohort.later(F.col("o_orderdate"), 365 * 24).alias("feature_end"))


@query(f"""WITH {INTERVALS_SQL}, whole AS (SELECT l_orderkey, l_linenumber, coalesce(start, stop) AS start, coalesce(stop, start) AS stop FROM intervals)
SELECT l_orderkey, l_linenumber, start, stop FROM whole JOIN orders ON l_orderkey = o_orderkey WHERE start <= o_orderdate + INTERVAL 365 DAY AND stop >= o_orderdate""")
def interval_overlap(spark, sf_dir):
    """Lines whose interval touches the year after their order; one end stands in for the other."""
    return events.overlapping(_intervals(spark, sf_dir), _order_windows(spark, sf_dir), "l_orderkey", "start", "stop").select("l_orderkey", "l_linenumber", "start", "stop")


@query("""WITH m AS (SELECT o_orderpriority, greatest(date_diff('minute', o_orderdate, l_shipdate), 0)::DOUBLE AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderpriority, count(*) AS cnt, sum(minutes) AS sum, sum(minutes) / count(minutes) AS mean, max(minutes) AS max FROM m GROUP BY o_orderpriority""")
def interval_duration(spark, sf_dir):
    """Minutes from order to shipment, floored at 0, by priority."""
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority"), "l_orderkey")
    return events.exposure(both.select("o_orderpriority", scalars.minutes(F.col("o_orderdate"), F.col("l_shipdate")).alias("minutes")), ["o_orderpriority"], "minutes")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_group(spark, sf_dir):
    return cohort.first_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


LATEST_SQL = "latest AS (SELECT o_custkey, max(o_orderdate) AS intime FROM orders GROUP BY o_custkey)"


def _latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    stays = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("intime"))
    return cohort.earlier_transfers(stays, orders, "o_custkey", "o_custkey", "intime", "o_orderdate", "o_orderpriority", "o_orderkey")


@query(f"""WITH {LATEST_SQL} SELECT l.o_custkey, coalesce(arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderdate < intime), 'UNKNOWN') AS last_before
FROM latest l JOIN orders o ON l.o_custkey = o.o_custkey GROUP BY l.o_custkey""")
def last_before(spark, sf_dir):
    """The priority of each customer's last order before the day of the latest."""
    return _latest(spark, sf_dir).select("o_custkey", "last_before")


@query(f"WITH {LATEST_SQL} SELECT l.o_custkey, count(*) FILTER (o_orderdate < intime) AS n_before FROM latest l JOIN orders o ON l.o_custkey = o.o_custkey GROUP BY l.o_custkey")
def prior_count(spark, sf_dir):
    return _latest(spark, sf_dir).select("o_custkey", "n_before")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


OUTCOME_SQL = f"""stays AS (
  SELECT user_id, min(ts) AS intime, min(ts) + INTERVAL {HOURS} HOUR AS landmark, min(ts) FILTER (event_type = 'error' AND value > 60) AS death, max(ts) AS discharge FROM events GROUP BY user_id)"""


def _outcomes(spark, sf_dir):
    terminal = F.when((F.col("event_type") == "error") & (F.col("value") > 60), F.col("ts"))
    stays = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("intime"), F.min(terminal).alias("death"), F.max("ts").alias("discharge"))
    return stays.withColumn("landmark", cohort.later(F.col("intime"), HOURS))


@query(f"""WITH {OUTCOME_SQL} SELECT user_id, (death IS NOT NULL AND death >= intime AND death <= landmark)::INT AS died_in_window, (death IS NOT NULL AND death > landmark AND death <= discharge)::INT AS died_after FROM stays""")
def landmark_label(spark, sf_dir):
    """Whether a user's first large error falls in the window, and whether after it."""
    s = _outcomes(spark, sf_dir)
    after = cohort.died_in_hospital(F.col("death"), F.col("landmark"), F.col("discharge"), F.lit(0), strictly_after=True)
    return s.select("user_id", cohort.died_within(F.col("death"), F.col("intime"), F.col("landmark")).alias("died_in_window"), after.alias("died_after"))


@query(f"WITH {OUTCOME_SQL} SELECT user_id, landmark FROM stays WHERE (death IS NULL OR death > landmark) AND (discharge IS NULL OR discharge > landmark)")
def at_risk_filter(spark, sf_dir):
    return _outcomes(spark, sf_dir).where(cohort.at_risk(F.col("death"), F.col("discharge"), F.col("landmark"))).select("user_id", "landmark")


@query("""WITH s AS (SELECT o_custkey, max((o_orderstatus = 'F' AND o_totalprice > 400000)::INT) AS label FROM orders GROUP BY o_custkey),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || o_custkey), o_custkey) AS k, count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT o_custkey, label, CASE WHEN k <= ceil(n * 0.15) THEN 'test' WHEN k <= ceil(n * 0.15) + ceil(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM p""")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).cast("int").alias("label"))
    return cohort.stratified_split(rows, "o_custkey", "label")


@query("SELECT o_orderkey, (10 + o_custkey % 60 + year(o_orderdate) - 1995)::BIGINT AS age FROM orders WHERE 10 + o_custkey % 60 + year(o_orderdate) - 1995 >= 18")
def age_projection(spark, sf_dir):
    age = scalars.age(10 + F.col("o_custkey") % 60, F.lit(1995), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.cast("long").alias("age")).where(F.col("age") >= cohort.ADULT)


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS bad_number, try_cast(CASE WHEN event_id % 2 = 0 THEN '2024-01-02 03:04:05' ELSE props END AS TIMESTAMP) AS time FROM events""")
def safe_cast(spark, sf_dir):
    time = F.when(F.col("event_id") % 2 == 0, F.lit("2024-01-02 03:04:05")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", scalars.number(F.get_json_object("props", "$.k")).alias("k"), scalars.number(F.col("event_type")).alias("bad_number"), scalars.timestamp(time).alias("time"))


KEY_SQL = "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '  ' WHEN p_size % 7 = 2 THEN 'nan' ELSE ' ' || lower(p_type) || ' ' END"


def _keyed_parts(spark, sf_dir):
    r = F.col("p_size") % 7
    drug = F.when(r == 0, F.lit(None)).when(r == 1, F.lit("  ")).when(r == 2, F.lit("nan")).otherwise(F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.item_key(drug, F.col("p_brand")).alias("key"))


@query(f"SELECT p_partkey, nullif(nullif(upper(trim(coalesce({KEY_SQL}, p_brand))), ''), 'NAN') AS key FROM part")
def key_normalise(spark, sf_dir):
    return _keyed_parts(spark, sf_dir)


@query(f"""WITH k AS (SELECT p_partkey, nullif(nullif(upper(trim(coalesce({KEY_SQL}, p_brand))), ''), 'NAN') AS key FROM part),
c AS (SELECT key FROM k WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT p_partkey) >= greatest(ceil(0.05 * (SELECT count(DISTINCT p_partkey) FROM k)), 1))
SELECT CASE WHEN c.key IS NULL THEN 'OTHER_RARE_DRUG' ELSE k.key END AS key, count(*) AS n FROM k LEFT JOIN c ON k.key = c.key WHERE k.key IS NOT NULL GROUP BY 1""")
def rare_bucket(spark, sf_dir):
    parts = _keyed_parts(spark, sf_dir)
    return events.rare_bucket(parts, events.prevalence(parts, "p_partkey", "key", 0.05), "key", "OTHER_RARE_DRUG").groupBy("key").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT s_suppkey AS k, upper(trim(n_name)) AS category FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0)
SELECT coalesce(category, 'UNKNOWN') AS category, count(*) AS n, sum(l_quantity::DECIMAL(28,6))::DOUBLE AS sum FROM lineitem LEFT JOIN d ON l_suppkey = k GROUP BY 1""")
def item_categories(spark, sf_dir):
    """Quantities by the category of a dictionary that lacks a third of the items."""
    items = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("category"))
    return events.with_category(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), items, "l_suppkey").groupBy("category").agg(F.count("*").alias("n"), events.exact_sum(F.col("l_quantity")).alias("sum"))


@query("""WITH train AS (SELECT o_orderpriority FROM orders WHERE o_orderkey % 10 < 7),
c AS (SELECT o_orderpriority AS level, count(*) AS n FROM train GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, level LIMIT 3),
b AS (SELECT coalesce(level, 'RARE') AS level, count(*)::DOUBLE / (SELECT count(*) FROM train) AS share FROM train LEFT JOIN c ON o_orderpriority = level GROUP BY 1)
SELECT o_orderkey, coalesce(share, 0.0::DOUBLE) AS priority_freq FROM orders LEFT JOIN c ON o_orderpriority = c.level LEFT JOIN b ON b.level = coalesce(c.level, 'RARE')""")
def frequency_encode(spark, sf_dir):
    """Order priorities as their training frequency, three levels kept."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return features.frequency_encoded(orders, orders.where("o_orderkey % 10 < 7"), "o_orderpriority", 5, 3, "priority_freq").select("o_orderkey", "priority_freq")


PIVOT_SQL = f"""{DENSE_SQL}, more AS (
  SELECT * FROM dense UNION ALL SELECT user_id, 'lab_flag', 1.0::DOUBLE FROM wide UNION ALL SELECT user_id, 'lab_empty', NULL FROM wide UNION ALL SELECT user_id, 'drug_cnt_rare', (user_id = 3)::INT::DOUBLE FROM wide)"""


def _more(spark, sf_dir):
    """Dense features with a constant, an empty and a rare one."""
    users = wide(spark, sf_dir)
    extra = users.select("user_id", F.inline(F.array(
        F.struct(F.lit("lab_flag").alias("feature"), F.lit(1.0).alias("value")), F.struct(F.lit("lab_empty").alias("feature"), F.lit(None).cast("double").alias("value")),
        F.struct(F.lit("drug_cnt_rare").alias("feature"), (F.col("user_id") == 3).cast("double").alias("value")))))
    return features.melted(users, ["user_id"]).unionByName(extra)


@query(f"WITH {PIVOT_SQL} SELECT feature, count(DISTINCT value) + max((value IS NULL)::INT) AS n_distinct FROM more GROUP BY feature HAVING count(DISTINCT value) + max((value IS NULL)::INT) <= 1")
def constant_columns(spark, sf_dir):
    return features.constant_features(_more(spark, sf_dir))


@query(f"WITH {PIVOT_SQL} SELECT feature, avg((coalesce(value, 0) <> 0)::INT)::DOUBLE AS prevalence FROM more GROUP BY feature HAVING avg((coalesce(value, 0) <> 0)::INT) < 0.02")
def sparse_columns(spark, sf_dir):
    return features.sparse_features(_more(spark, sf_dir), 0.02)


@query(f"""WITH {PIVOT_SQL}, gone AS (
  SELECT feature FROM more GROUP BY feature HAVING count(DISTINCT value) + max((value IS NULL)::INT) <= 1 OR (regexp_matches(feature, '^(input_|output_|proc_|drug_cnt_)') AND avg((coalesce(value, 0) <> 0)::INT) < 0.02))
SELECT * FROM more WHERE feature NOT IN (SELECT feature FROM gone)""")
def pruned_features(spark, sf_dir):
    m = _more(spark, sf_dir)
    return features.pruned(m, m, 0.02)


CATALOGUE_SQL = f"""{PIVOT_SQL}, catalogue AS (
  SELECT feature, CASE WHEN feature[:6] = 'chart_' OR feature[:4] = 'lab_' THEN 'clinical_measurement' ELSE 'treatment_response' END AS "group",
    CASE WHEN feature[:6] = 'chart_' OR feature[:4] = 'lab_' THEN 'mutable_with_clinical_constraints' ELSE 'non_actionable_by_default' END AS mutability,
    min(value) AS train_min, max(value) AS train_max, quantile_cont(value, 0.5) AS train_median, avg((value IS NULL)::INT)::DOUBLE AS train_missing_rate FROM more GROUP BY feature)"""


@query(f"WITH {CATALOGUE_SQL} SELECT * FROM catalogue")
def feature_catalog(spark, sf_dir):
    return features.catalogue(_more(spark, sf_dir))


@query(f"WITH {CATALOGUE_SQL} SELECT * FROM catalogue WHERE feature IN ({', '.join(f"'{f}'" for f in TOY.features())})")
def model_catalogue(spark, sf_dir):
    """The catalogue's rows of the features that the model uses."""
    own = TOY.table(spark).where("feature is not null").select("feature")
    return features.catalogue(_more(spark, sf_dir)).join(own, "feature", "left_semi")


@query("SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def static_frame(spark, sf_dir):
    """Static columns of all customers: of those wanted one doesn't exist, and one counts as a leak."""
    return features.static_columns(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_mktsegment", "c_region", "c_acctbal", "c_nationkey"], leaks=("c_acctbal",))


@query(f"WITH {CATALOGUE_SQL} SELECT feature, train_min AS low, train_max AS high FROM catalogue WHERE train_min < train_max AND mutability = 'mutable_with_clinical_constraints'")
def permitted_ranges(spark, sf_dir):
    c = features.catalogue(_more(spark, sf_dir))
    return features.permitted_ranges(c.where(features.is_mutable(F.col("mutability"), F.col("feature"))))


@query(f"WITH {DENSE_SQL} SELECT user_id, feature, value FROM dense")
def zero_fill(spark, sf_dir):
    """Absent exposures are 0, absent measurements missing, from a long table that lacks both."""
    absent = F.col("value").isNull() | features.is_exposure(F.col("feature")) & (F.col("value") == 0)  # a mean of 0 is a measurement
    have = dense(spark, sf_dir).where(~absent)
    return features.densified(have, wide(spark, sf_dir), spark.createDataFrame([(f,) for f in FEATURES], "feature string"), "user_id")


STAYS_SQL = """stays AS (SELECT l_orderkey * 10 + l_linenumber AS stay_id, l_orderkey AS hadm_id, o_custkey AS subject_id, l_shipdate AS intime, l_shipdate + INTERVAL 3 DAY AS outtime,
    o_orderdate + INTERVAL 900 DAY AS dischtime, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 700 DAY END AS death, 10 + c_nationkey * 3 + year(l_shipdate) - 1996 AS age
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
firsts AS (SELECT *, intime + INTERVAL 48 HOUR AS feature_end FROM stays WHERE age >= 18 QUALIFY row_number() OVER (PARTITION BY hadm_id ORDER BY intime, stay_id) = 1)"""


@query(f"""WITH {STAYS_SQL} SELECT stay_id, subject_id, hadm_id, age::BIGINT AS age, feature_end, (death IS NOT NULL AND death >= intime AND death <= outtime)::INT AS icu_mortality,
  (death IS NOT NULL AND death > feature_end AND death <= dischtime)::INT AS hospital_mortality FROM firsts WHERE (death IS NULL OR death > feature_end) AND dischtime > feature_end""")
def cohort_build(spark, sf_dir):
    """The first shipment of each order by an adult customer that is still at risk after 48 hours."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    stays = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stay_id"), F.col("l_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").alias("intime"), (F.col("l_shipdate") + days(3)).alias("outtime"))
    admissions = orders.select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), (F.col("o_orderdate") + days(900)).alias("dischtime"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + days(700)).alias("deathtime"))
    patients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), (10 + F.col("c_nationkey") * 3).alias("anchor_age"), F.lit(1996).alias("anchor_year"))
    return cohort.build(stays, admissions, patients).select("stay_id", "subject_id", "hadm_id", F.col("age").cast("long").alias("age"), "feature_end", "icu_mortality", "hospital_mortality")


@query(f"""WITH {DENSE_SQL}, ranks AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {k + 1})" for k, f in enumerate([*reversed(MEANS), *COUNTS]))}) r(feature, rank))
SELECT user_id, feature, place::INT AS place FROM (SELECT user_id, d.feature, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS place FROM dense d JOIN ranks r ON d.feature = r.feature WHERE value IS NOT NULL) WHERE place <= 3""")
def cap_observed(spark, sf_dir):
    """The three best ranked features that each user has."""
    ranks = spark.createDataFrame([(f, k + 1) for k, f in enumerate([*reversed(MEANS), *COUNTS])], "feature string, rank int")
    return features.capped(dense(spark, sf_dir), ranks, "user_id", 3)
