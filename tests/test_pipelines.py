"""The whole way on small clinical-shaped tables: files, features, model, counterfactuals; and the stream form of the summaries."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import boosting, ensemble, evaluate, search
from sparrowmill.plans import explanations, pipelines, run
from sparrowmill.plans.tables import FEATURES, TOY
from sparrowmill.sources import files
from sparrowmill.streaming import summaries

T = dt.datetime(2020, 1, 1)
H = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def raw(spark):
    draw = np.random.default_rng(9)
    n = 240
    sick = draw.random(n) < 0.35
    stays, admissions, patients, transfers, chart, inputs, drugs, outputs, procedures = [], [], [], [], [], [], [], [], []
    for k in range(n):
        start = T + int(draw.integers(1000)) * H
        stays.append((k, 1000 + k, k, start, start + 90 * H))
        death = start + 72 * H if sick[k] and draw.random() < 0.85 else None
        admissions.append((1000 + k, k, start + 100 * H, death, int(death is not None)))
        patients.append((k, 15.0 if k == 0 else float(30 + k % 50), 2020, "F" if k % 2 else "M"))
        transfers += [(1000 + k, start - 2 * H, "ED")] * (k % 3)
        for j in range(6):
            chart.append((k, 1, start + j * H, float(round(draw.normal(100 + 40 * sick[k], 15), 1)), j))
            if draw.random() < 0.7:
                chart.append((k, 2, start + j * H, float(round(draw.normal(5, 1), 2)), j))
        chart.append((k, 1, start + 60 * H, 999.0, 9))  # after the window
        inputs.append((k, 7, start + H, None if k % 4 else start + 3 * H, 2.0, 0.5))
        outputs.append((k, 8, start + 2 * H, None if k % 5 == 0 else 3.0))
        procedures.append((k, 9 + k % 2, start, start + H))
        drugs.append((k, " aspirin " if k % 2 else None, "C/1" if k % 3 else "rare", start, None))
        drugs += [(k, "c 1", None, start, None)] * (k % 3 == 0)  # another drug whose name becomes the same
    make = spark.createDataFrame
    return {
        "stays": make(stays, "stay_id long, hadm_id long, subject_id long, intime timestamp_ntz, outtime timestamp_ntz"),
        "admissions": make(admissions, "hadm_id long, subject_id long, dischtime timestamp_ntz, deathtime timestamp_ntz, hospital_expire_flag int"),
        "patients": make(patients, "subject_id long, anchor_age double, anchor_year int, gender string"),
        "transfers": make(transfers, "hadm_id long, intime timestamp_ntz, careunit string"),
        "chart": make(chart, "stay_id long, itemid long, time timestamp_ntz, value double, tie int"),
        "input": make(inputs, "stay_id long, itemid long, start timestamp_ntz, stop timestamp_ntz, value double, rate double"),
        "output": make(outputs, "stay_id long, itemid long, time timestamp_ntz, value double"),
        "procedure": make(procedures, "stay_id long, itemid long, start timestamp_ntz, stop timestamp_ntz"),
        "drugs": make(drugs, "stay_id long, drug string, code string, start timestamp_ntz, stop timestamp_ntz"),
        "items": make([(9, " dialysis "), (10, None)], "itemid long, category string"),
    }


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("job")
    return {name: f"file://{top}/{name}" for name in ("data", "model", "out")} | {"path": top}


def test_features_model_counterfactuals(spark, raw, folders):
    config = pipelines.overridden(pipelines.FeatureConfig(), {"share": 0.05, "procedure_categories": True, "seed": None})
    made = pipelines.build_features(raw, config)
    who = made["cohort"].collect()
    assert len(who) == 239 and all(r.age >= 18 for r in who)  # the child isn't in the cohort
    names = pipelines.write_features(made, folders["data"], config=config)
    assert {"chart_mean_item_1", "chart_first_item_2", "drug_cnt_ASPIRIN", "n_transfers_before_icu", "proc_cnt_DIALYSIS"} <= set(names)
    drugs = {r.feature: r.n for r in made["long"].where("feature like 'drug_cnt_C%'").groupBy("feature").agg(F.sum("value").alias("n")).collect()}
    assert drugs == {"drug_cnt_C_1": sum(k % 3 == 0 for k in range(1, 240)), "drug_cnt_C_1_1": sum(k % 2 == 0 and k % 3 > 0 for k in range(1, 240))}
    x = files.read_split(spark, folders["data"], "train")
    assert x.agg(F.max("chart_max_item_1")).first()[0] < 900
    subjects = [set(r.subject_id for r in files.read_table(spark, folders["data"], f"X_{s}").select("subject_id").collect()) for s in files.SPLITS]
    assert sum(map(len, subjects)) == len(set.union(*subjects)) == 239

    report = pipelines.train_model(spark, folders["data"], folders["model"], boosting.Settings(rounds=5, rate=0.4, depth=2, least_weight=2.0, patience=3))
    assert report["val"]["auc"] > 0.7
    assert files.load_model(spark, folders["model"])[1] == report["threshold_selection"]["best_threshold"]
    scored = files.read_predictions(spark, f"{folders['model']}/predictions_test")
    assert set(scored.columns) == {"stay_id", "row_id", "label", "pred_proba", "pred_label"}

    runs = {"exact": ("exact", "median", {}), "beam": ("beam", None, {"steps": 2, "width": 5}), "genetic": ("genetic", "knn", {"generations": 2, "population": 16})}
    for name, (method, fill, options) in runs.items():
        out = f"{folders['out']}/{name}"
        config = explanations.ExplainConfig(method, fill, most=6, vary=3 if method == "beam" else 0, cache=f"{folders['out']}/cache" if fill == "knn" else None, options=options)
        summary = explanations.explain(spark, folders["data"], folders["model"], out, config)
        cfs = files.read_table(spark, out, "counterfactuals").collect()
        assert len(cfs) == summary["n_counterfactuals"]
        assert all(r.valid and r.all_mutable and r.n_changed == len(json.loads(r.changed)) for r in cfs)
        failed = files.read_table(spark, out, "failed_queries").collect()
        factuals = {r.row_id: r for r in files.read_table(spark, out, "selected_factuals").collect()}
        assert {r.row_id for r in cfs} | {r.row_id for r in failed} == set(factuals) and len({r.row_id for r in cfs}) + len(failed) == len(factuals) == summary["n_asked"] == 6
        assert sum(summary["failures"].values()) == len(failed) and all(r.error_type and r.n_missing == len(r.missing) for r in failed)
        assert spark.read.json(f"{out}/attempts").count() >= len(factuals) - summary["failures"].get("NoMutableObservedFeatures", 0)
        assert files.read_json(spark, f"{out}/run_config.json")["method"] == method
        names = files.read_json(spark, f"{folders['data']}/feature_spec.json")["features"]
        for r in cfs:
            own = factuals[r.row_id]
            changed = set(json.loads(r.changed))
            assert changed <= set(own.search) and all((a is None) == (b is None) for a, b in zip(own.vector, r.counterfactual, strict=True))
            assert not changed & {f for f, v in zip(names, own.vector, strict=True) if v is None}
            assert method != "beam" or len(own.search) <= 3
        if fill:
            assert all(v is not None for r in factuals.values() for v in r.filled)
        if cfs:
            assert {f"{s}_{m}" for s in ("mean", "median") for m in evaluate.MEASURES} <= set(summary)
    (tmp := folders["path"] / "ids.csv").write_text("row_id\n" + "\n".join(str(k) for k in [*factuals][:3]) + "\n")
    again = explanations.ExplainConfig("genetic", "knn", most=2, offset=1, ids=f"file://{tmp}", cache=f"{folders['out']}/cache", options={"generations": 1, "population": 16})
    assert explanations.explain(spark, folders["data"], folders["model"], f"{folders['out']}/ids", again)["n_asked"] == 2
    assert {r.row_id for r in files.read_table(spark, f"{folders['out']}/ids", "selected_factuals").collect()} == set([*factuals][1:3])
    with pytest.raises(ValueError, match="unknown search"):
        explanations.explain(spark, folders["data"], folders["model"], folders["out"], explanations.ExplainConfig("guess"))
    assert files.read_json(spark, f"{folders['data']}/config_used.json")["share"] == 0.05 and set(files.read_json(spark, f"{folders['data']}/preprocessing_spec.json")) == {"hours", "clipped_to", "zero_filled", "groups"}


def test_rows_without_a_feature_to_change_fail_with_a_reason(spark):
    made = explanations.Artefacts(TOY, 0.5, FEATURES, {}, None, {})
    rows = spark.createDataFrame([(1, [1.0] * 10), (2, [None] * 5 + [1.0] * 5), (3, [None, 2.0, None, None, None] + [1.0] * 5)], "row_id long, vector array<double>")
    mutable = spark.createDataFrame([(f,) for f in FEATURES[:5]], "feature string")
    got = {r.row_id: r.search for r in explanations.searchable(made, rows, mutable, 2).collect()}
    assert len(got[1]) == 2 and got[2] == [] and got[3] == [FEATURES[1]]


def test_a_killed_search_goes_on_from_its_log(spark, tmp_path, monkeypatch):
    """A run that dies after two batches has committed them; the next one searches only the rest, with the same end as a run at once."""
    draw = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, [float(round(v, 2)) for v in draw.uniform(0, 90, 10)], FEATURES[:5]) for k in range(12)], "row_id long, vector array<double>, search array<string>")
    made = explanations.Artefacts(TOY, 0.45, FEATURES, {}, None, {})
    space = search.Space(FEATURES, [0.0] * 10, [90.0] * 5 + [4.0] * 5, set(FEATURES[:5]))
    config = explanations.ExplainConfig("exact", batch=3, options={"gap": 0.0})
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = order(explanations.attempted(made, rows, space, config, f"file://{tmp_path}/whole"))
    assert len({r[0] for r in want}) == 12
    plain, seen = explanations.searched, []

    def dying(made, own, space, config):
        if len(seen) == 2:
            raise KeyboardInterrupt
        seen.append({r.row_id for r in own.collect()})
        return plain(made, own, space, config)

    monkeypatch.setattr(explanations, "searched", dying)
    out = f"file://{tmp_path}/killed"
    with pytest.raises(KeyboardInterrupt):
        explanations.attempted(made, rows, space, config, out)
    assert len(files.committed_batches(spark, f"{out}/attempts")) == 2
    later = []
    monkeypatch.setattr(explanations, "searched", lambda made, own, space, config: later.append({r.row_id for r in own.collect()}) or plain(made, own, space, config))
    again = explanations.ExplainConfig("exact", batch=3, resume=True, options={"gap": 0.0})
    assert order(explanations.attempted(made, rows, space, again, out)) == want
    assert set().union(*seen).isdisjoint(set().union(*later)) and len(set().union(*seen, *later)) == 12
    # another search doesn't take these batches for its own
    later.clear()
    explanations.attempted(made, rows, space, explanations.ExplainConfig("exact", batch=3, resume=True, options={"gap": 0.5}), out)
    assert len(set().union(*later)) == 12


def test_audit_finds_a_margin_that_is_not_the_leaves(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, [30.0] * 10), (2, 1, [None] * 10)], "row_id long, cf_rank int, counterfactual array<double>")
    assert all(r.error_type is None and r.n_leaves == 3 for r in search.audited(rows, TOY, FEATURES).collect())
    other = ensemble.Ensemble(TOY.nodes, TOY.base_margin + 1e-6)
    monkeypatch.setattr(search, "leaf_join_scores", lambda long, key, _: ensemble.leaf_join_scores(long, key, other))
    assert {r.error_type for r in search.audited(rows, TOY, FEATURES).collect()} == {"SelectedLeafAudit"}


def test_the_stages_of_a_run(spark, raw, tmp_path, capsys):
    """Raw files to counterfactuals by the command line, in one session."""
    top = f"file://{tmp_path}"
    old = {new: name for name, new in run.NEW_NAMES.items()}
    for role, (stem, columns) in run.RAW.items():
        if role == "lab":
            continue
        df = raw[role].drop("tie") if role != "drugs" else raw[role].join(raw["stays"].select("stay_id", "hadm_id"), "stay_id").drop("stay_id")
        back = {c: next((o for o, n in run.NEW_NAMES.items() if n == c and o in columns), c) for c in df.columns}
        assert set(back.values()) <= set(columns) and old
        df.withColumnsRenamed(back).coalesce(1).write.csv(f"{top}/raw/{stem}.csv", header=True)
    arguments = [x for name in ("raw", "data", "model", "query-ids", "results") for x in (f"--{name}", f"{top}/{name}")]
    settings = ["preprocess.share=0.05", "train.rounds=4", "train.depth=2", "train.rate=0.4", "train.least_weight=2.0", "query_ids.size=3", "query_ids.true_only=false", "cf.most=3", 'ocean.options={"solutions": 1}']
    wanted = ["--stages", "preprocess,train,query_ids,ocean", *[x for s in settings for x in ("--set", s)]]
    assert run.main([*arguments, *wanted, "--dry-run"], spark) == 0 and capsys.readouterr().out.count("planned") == 4
    assert run.main([*arguments, *wanted], spark) == 0
    assert files.read_json(spark, f"{top}/results/ocean/summary.json")["n_asked"] == 3
    assert spark.read.csv(f"{top}/query-ids/row_ids", header=True).count() == 3
    assert run.main(["--list"], spark) == 0 and "preprocess (core)" in capsys.readouterr().out
    with pytest.raises(ValueError, match="stage.option"):
        run.parsed(["nothing"])


def test_stages():
    ran = []
    fail = lambda: 1 / 0
    stages = [pipelines.Stage("a", lambda: ran.append("a"), core=True), pipelines.Stage("b", fail), pipelines.Stage("c", lambda: ran.append("c"))]
    assert [r["status"] for r in pipelines.run_stages(stages)] == ["done", "failed", "done"]
    assert [r["status"] for r in pipelines.run_stages(stages, strict=True)] == ["done", "failed"]
    assert [r["stage"] for r in pipelines.run_stages(stages, ["c", "a"], dry_run=True)] == ["c", "a"]
    assert [r["status"] for r in pipelines.run_stages([pipelines.Stage("x", fail, core=True), *stages])] == ["failed"]
    with pytest.raises(ValueError, match="unknown stages"):
        pipelines.run_stages(stages, ["z"])
    assert ran == ["a", "c", "a"]


def test_csv_and_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("itemid,label,value,when\n1, x ,1.5,2020-01-01 00:00:00\n2,NA,bad,soon\n3,,NaN,\n")
    path = f"file://{tmp_path}"
    got = files.read_csv(spark, f"{path}/t.csv", {"itemid": "long", "value": "double", "when": "timestamp_ntz", "unit": "string"}, ("unit",)).orderBy("itemid").collect()
    assert [tuple(r) for r in got] == [(1, 1.5, T, None), (2, None, None, None), (3, None, None, None)]
    with pytest.raises(ValueError, match="lacks other"):
        files.read_csv(spark, f"{path}/t.csv", {"other": "long"})
    ids = spark.createDataFrame([(1,), (2,)], "itemid long")
    assert [tuple(r) for r in files.item_metadata(spark, f"{path}/t.csv", ids).orderBy("itemid").collect()] == [(1, " x ", None, None, None), (2, None, None, None, None)]
    assert files.item_metadata(spark, f"{path}/none.csv", ids).count() == 0
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    files.write_table(df, path, "one")
    files.write_table(df, path, "two", "csv")
    assert files.read_table(spark, path, "one").collect() == files.read_table(spark, path, "two").collect() == df.collect()
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, path, "three")
    files.write_json(spark, {"a": [1, None]}, f"{path}/doc.json")
    assert files.read_json(spark, f"{path}/doc.json") == {"a": [1, None]}
    assert files.read_json(spark, f"{path}/no.json", 5) == 5
    (tmp_path / "ids.csv").write_text("row_id\n5\n\n3\nx\n5\n")
    assert [r.row_id for r in files.read_query_ids(spark, f"{path}/ids.csv").orderBy("position").collect()] == [5, 3, 5]


def test_imputed_frames_and_log(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.range(5).withColumnRenamed("id", "row_id")
    files.write_imputed({"train": df, "test": df.limit(2)}, {"k": 5}, path)
    assert {k: v.count() for k, v in files.read_imputed(spark, {"k": 5}, path).items()} == {"train": 5, "test": 2}
    with pytest.raises(ValueError, match="other values of k"):
        files.read_imputed(spark, {"k": 6}, path)
    files.write_table(df.limit(1), path, "test")
    with pytest.raises(ValueError, match="test"):
        files.read_imputed(spark, {"k": 5}, path)
    files.log_attempts(df.limit(2), f"{path}/log", restart=True)
    files.log_attempts(df.limit(1), f"{path}/log")
    assert spark.read.json(f"{path}/log").count() == 3


def test_batches_on_disk(spark, tmp_path):
    from sparrowmill.operators import selection

    predicted = spark.createDataFrame([(k, k % 2, 0.9, 1) for k in range(12)], "row_id long, y_true int, pred_proba double, pred_label int")
    batches = selection.batches(predicted, 4, 2, seed=3)
    files.write_batches(batches, predicted, f"file://{tmp_path}")
    back = spark.read.csv(f"file://{tmp_path}/row_ids", header=True, inferSchema=True)
    assert sorted(map(tuple, back.select("batch", "row_id").collect())) == sorted((r.batch, r.row_id) for r in batches.collect())
    assert sum(r["n"] for r in files.read_json(spark, f"file://{tmp_path}/manifest.json")) == 8


def test_model_json(spark, tmp_path):
    tree = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [2.0, 0.0, 0.0], "default_left": [1, 0, 0], "base_weights": [0.0, -1.0, 1.0]}
    learner = {"feature_names": ["a"], "gradient_booster": {"model": {"trees": [tree]}}, "learner_model_param": {"base_score": "[5E-1]"}}
    (tmp_path / "model.json").write_text(json.dumps({"learner": learner}))
    e, threshold = files.load_model(spark, f"file://{tmp_path}")
    assert threshold == files.DEFAULT_THRESHOLD
    assert e.base_margin == pytest.approx(0.0) and [n.leaf for n in e.nodes] == [None, -1.0, 1.0] and e.features() == ["a"]


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "ts", "value")
    ev.repartition(3).write.parquet(f"file://{tmp_path}/in")
    args = (["user_id", "event_type"], "ts", "value")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 3).parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    summaries.to_table(summaries.windowed_summary(stream, *args), out, f"file://{tmp_path}/state").awaitTermination()
    batch = {tuple(r) for r in summaries.windowed_summary(ev, *args).collect()}
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got and got <= batch  # windows that the watermark hasn't passed are still open
    assert {r for r in batch if r[0] < max(b[0] for b in batch) - dt.timedelta(hours=48)} <= got
