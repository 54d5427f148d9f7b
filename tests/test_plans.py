"""Whole jobs: sections, invariants, plans, sources."""

import json

import pytest
from pyspark.sql import functions as F

from checks.catalog import QUERIES, Inputs
from jobmeter.plans import analyze, features as feature_plans, forecast, insights, model
from jobmeter.sources import readers, writers
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF_DIR)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_agree(inputs):
    sections = insights.insights(inputs.features, inputs.predictions)
    jobs = sections["dataset"].first().job_count
    for name in insights.ROLLUPS:
        assert sections[name].agg(F.sum("job_count")).first()[0] == jobs, name
    assert sections["missingness"].where("`table` = 'features'").count() > 0
    top = sections["top_users_by_energy"].collect()
    assert len(top) == 10 and top[0].energy_total_kwh >= top[-1].energy_total_kwh


def test_shares_sum_to_hundred(inputs):
    flat = inputs.flat.where("hashed_user is not null")
    total = analyze.user_counts(flat).agg(F.sum("percentage")).first()[0]
    assert total == pytest.approx(100.0)


def test_no_python_and_no_cross_join(inputs):
    for df in (
        inputs.features, inputs.directives, forecast.forecast_batch(inputs.requests, inputs.readings),
        forecast.job_emissions(inputs.zoned, inputs.readings), analyze.state_counts(inputs.flat),
    ):
        text = plan(df)
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_job_columns_need_no_shuffle(inputs):
    assert "Exchange" not in plan(inputs.jobs)
    assert "Exchange" not in plan(inputs.directives)


def test_daily_scan_reads_few_columns(inputs, spark, tmp_path):
    path = str(tmp_path / "features")
    inputs.features.write.parquet(path)
    from jobmeter.operators import usage

    text = usage.by_day(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<Start:timestamp,energy_kWh:double>" in text


@pytest.fixture
def splitting(spark):
    """No broadcast by Spark itself, and partitions that count as skewed while they are small."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_job_key_is_split(spark, splitting):
    """A key with a third of the jobs is spread over tasks by adaptive execution."""
    from jobmeter.operators import energy

    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id")))
    jobs = spark.range(0, 300000, 1, 16).select(key.alias("job_key"), F.md5(F.col("id").cast("string")).alias("x"))
    metered = spark.range(0, 300000, 1, 8).select(key.alias("job_key"), F.lit(1.0).alias("energy_kWh"))
    out = energy.join_features(jobs, energy.energy_per_job(metered)).agg(F.count("*"), F.sum("energy_kWh"), F.max("x"))
    rows, total, _ = out.collect()[0]
    assert rows == 300000 and total == 100000 * 100000.0 + 200000
    assert "skew=true" in plan(out)


@pytest.mark.parametrize("kind", ["folds", "codes"])
def test_hot_user_is_split_where_tables_are_too_large_to_broadcast(spark, splitting, monkeypatch, kind):
    from jobmeter.operators import lookups, sampling

    monkeypatch.setattr(lookups, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(sampling, "small_side", lambda df: df)
    user = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("u"), F.col("id") % 5000))
    jobs = spark.range(0, 300000, 1, 16).select(user.alias("User"), F.md5(F.col("id").cast("string")).alias("x"))
    made = sampling.group_folds(jobs, 5) if kind == "folds" else lookups.label_encode(jobs, ["User"])
    out = made.agg(F.count("*"), F.max("x"), F.countDistinct("fold" if kind == "folds" else "User"))
    rows, _, values = out.collect()[0]
    assert rows == 300000 and values == (5 if kind == "folds" else 5002)
    assert "skew=true" in plan(out)


def test_sections_follow_columns(inputs):
    both = analyze.analyze_jobs(inputs.flat)
    assert {"cpu_hours", "runtime_analysis", "gpu_jobs", "date_range"} <= set(both)
    elapsed = analyze.analyze_jobs(inputs.elapsed)
    assert "cpu_hours" not in elapsed and "daily_patterns" in elapsed
    assert elapsed["runtime_analysis"].first().method == "Elapsed"
    only_state = analyze.analyze_jobs(inputs.flat.select("State"))
    assert set(only_state) == {"metadata", "job_states"}
    lower = analyze.analyze_jobs(inputs.flat.withColumnRenamed("START", "Start").select("Start", "End"))
    assert set(lower) == {"metadata"}


def test_bad_submit_empties_its_section_only(spark):
    rows = [(3600.0, "2024-01-01"), (7200.0, "never")]
    df = spark.createDataFrame(rows, "Elapsed double, Submit string")
    assert analyze.jobs_per_day(df).collect() == [] and analyze.date_range(df).collect() == []
    assert analyze.runtime_describe(df).first().mean == 1.5
    good = df.where("Elapsed < 4000")
    assert analyze.jobs_per_day(good).first().average_jobs_per_day == 1.0


def test_bad_start_fails(spark):
    df = spark.createDataFrame([("2024-01-01", "never", 1)], "START string, End string, NCPUS int")
    with pytest.raises(Exception, match="unreadable timestamp"):
        analyze.cpu_hours_total(df).collect()


def test_average_counts_undated_rows(spark):
    rows = [("2024-01-01", "2024-01-02", 1), (None, None, 1), ("2024-01-03", "2024-01-03", 2)]
    df = spark.createDataFrame(rows, "START string, End string, NCPUS int")
    assert {r.average_jobs_per_day for r in analyze.jobs_per_day(df).collect()} == {1.5}
    total = analyze.cpu_hours_total(df).first()
    assert total.total == 24.0 and total.average_per_job == 8.0


def request(spark, text=None, zone=None, **given):
    schema = (
        "sbatchText string, parameters struct<partitionName:string,nodeCount:bigint,cpuCores:bigint,"
        "gpuCount:bigint,memoryGigabytes:double,walltimeHours:double>, zone string"
    )
    names = ("partitionName", "nodeCount", "cpuCores", "gpuCount", "memoryGigabytes", "walltimeHours")
    values = tuple(given.get(n) for n in names) if given else None
    return spark.createDataFrame([(text, values, zone)], schema)


def test_request_defaults_and_overrides(spark, inputs):
    empty = forecast.resolve_request(request(spark)).first()
    assert tuple(empty) == (1, 0, None, None, 0.0, 1.0, "US-CAL-CISO")
    script = "#SBATCH --cpus-per-task=8\n#SBATCH --ntasks=2\n#SBATCH --mem-per-cpu=4G"
    assert forecast.resolve_request(request(spark, script)).first().cpu_cores == 16
    assert forecast.resolve_request(request(spark, script)).first().memory_gigabytes == 4.0
    fixed = forecast.resolve_request(request(spark, script), mem_per_cpu_fix=True).first()
    assert fixed.memory_gigabytes == 64.0
    assert forecast.resolve_request(request(spark, script, cpuCores=0)).first().cpu_cores == 0
    assert forecast.resolve_request(request(spark, zone="")).first().zone == "US-CAL-CISO"
    example = request(spark, cpuCores=4, walltimeHours=1.0, memoryGigabytes=8.0, zone="US-CAL-CISO")
    none = inputs.readings.where("false")
    out = forecast.forecast_batch(example, none).first()
    assert out.power_watts == pytest.approx(42.976) and out.emissions_kgco2e == pytest.approx(0.010744)
    assert out.notes == [] and out.inputs.cpu_cores == 4


def test_model_inputs(inputs):
    table = feature_plans.model_inputs(inputs.features.withColumn("ConsumedEnergyRaw", F.lit(1)))
    assert "ConsumedEnergyRaw" not in table.columns
    assert {t for c, t in table.dtypes if c not in ("job_key",)} == {"double"}


def test_cross_validation(inputs):
    from pyspark.ml.regression import DecisionTreeRegressor

    tree = DecisionTreeRegressor(featuresCol="features", labelCol="energy_kWh", predictionCol="y_pred", maxDepth=4)
    out = model.cross_validate(inputs.features, max_samples=400, regressor=tree).persist()
    rows = inputs.features.count()  # the bound limits what is fitted, not what is predicted
    assert out.count() == rows > 400 and out.where("y_pred is null or isnan(y_pred)").count() == 0
    per_user = out.groupBy("user").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0]
    assert per_user == 1
    metrics = {r.fold: r for r in model.fold_metrics(out).collect()}
    assert set(metrics) == {-1, 0, 1, 2, 3, 4} and metrics[-1]["rows"] == rows
    spread = out.agg(F.stddev("y_true")).first()[0]
    assert metrics[-1].rmse < spread * 1.2
    out.unpersist()


def test_cross_validation_without_a_known_feature(inputs):
    from pyspark.ml.regression import DecisionTreeRegressor

    tree = DecisionTreeRegressor(featuresCol="features", labelCol="energy_kWh", predictionCol="y_pred", maxDepth=2)
    table = feature_plans.feature_table(inputs.sacct.drop("Submit"), inputs.emissions)
    out = model.cross_validate(table, k=2, max_samples=200, regressor=tree)
    assert out.where("y_pred is null").count() == 0 and out.count() == inputs.features.count()


def test_headers_of_many_files_take_a_fixed_number_of_jobs(spark, tmp_path):
    for i in range(200):
        header = ("JobID|User", "User|JobID", "JobID|User|NCPUS")[i % 3]
        (tmp_path / f"part {i}+x.csv").write_text(header + "\n1|2" + ("|2.5" if i % 3 == 2 else "") + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    out = readers.read_sacct_dir(spark, str(tmp_path))
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8
    assert out.count() == 200 and out.agg(F.sum("NCPUS")).first()[0] == 66 * 2.5


def test_requests_that_are_wrong_keep_their_row(spark, tmp_path):
    lines = [
        '{"parameters": {"cpuCores": "8", "nodeCount": 2.0, "memoryGigabytes": "1e1"}, "zone": "z"}',
        '{"parameters": {"cpuCores": "x", "partitionName": 5}}', '{"parameters": [1]}', "{broken", "7", "",
        '{"parameters": null, "sbatchText": null}', '{"parameters": {"cpuCores": true, "walltimeHours": false}}',
        '{"zone": 3, "parameters": {"memoryGigabytes": "inf"}}',
    ]
    (tmp_path / "r.json").write_text("\n".join(lines) + "\n")
    rows = readers.read_forecast_requests(spark, str(tmp_path / "r.json")).collect()
    good = [r.parameters for r in rows if r.error is None]
    assert [(p.cpuCores, p.nodeCount, p.memoryGigabytes, p.walltimeHours) for p in good] == [
        (8, 2, 10.0, None), (None, None, None, None), (1, None, None, 0.0),
    ]
    assert [r.error for r in rows if r.error] == [
        "parameters.partitionName is not a text; parameters.cpuCores is not a whole number",
        "parameters is not an object", "not JSON", "not an object",
        "parameters.memoryGigabytes is not a number; zone is not a text",
    ]
    forecasts = forecast.forecast_batch(
        readers.read_forecast_requests(spark, str(tmp_path / "r.json")),
        spark.createDataFrame([], "zone string, reading_ts timestamp, carbon_intensity double"),
    )
    assert forecasts.where("(error is null) = (energy_kwh is not null)").count() == 8


def test_sacct_folder_with_two_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" JobID | User|NCPUS\n1|ann|4\n2|NA|x\n")
    (tmp_path / "b.csv").write_text("User|JobID|Extra\nbob|3|z\n")
    (tmp_path / "notes.txt").write_text("skip me\n")
    out = readers.read_sacct_dir(spark, str(tmp_path))
    assert set(out.columns) == {"JobID", "User", "NCPUS", "Extra"}
    rows = {r.JobID: (r.User, r.NCPUS, r.Extra) for r in out.collect()}
    assert rows == {"1": ("ann", 4, None), "2": (None, None, None), "3": ("bob", None, "z")}
    with pytest.raises(Exception):
        readers.read_sacct_dir(spark, str(tmp_path), same_header=True).collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_sacct_dir(spark, str(empty))


def test_reader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_jobs_csv(spark, str(tmp_path / "absent.csv"))
    path = tmp_path / "e.csv"
    path.write_text("job_key,watts\na,1\n")
    with pytest.raises(ValueError, match="energy_kWh"):
        readers.read_emissions(spark, str(path))


def test_insights_document_with_bad_numbers(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(
        '{"dataset": {"energy_kwh": {"mean": NaN, "max": 2.0}}, "distributions": {"numeric": {"a": {"min": -Infinity}}},'
        ' "aggregations": {"by_user": [{"user": "a", "job_count": 2,\n "energy_total_kwh": NaN, "energy_mean_kwh": -Infinity},'
        ' {"user": "b", "job_count": 1, "energy_total_kwh": 2.5, "energy_mean_kwh": Infinity}]}}'
    )
    document = readers.read_insights_json(spark, str(path))
    assert document.first().dataset.energy_kwh.mean is None and document.first().dataset.energy_kwh.max == 2.0
    assert document.first().distributions.numeric["a"].min is None
    rows = {r.user: (r.energy_total_kwh, r.energy_mean_kwh) for r in readers.insight_rows(document, "aggregations.by_user").collect()}
    assert rows == {"a": (None, None), "b": (2.5, None)}


def test_analysis_lines_have_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "a int, b double")
    path = str(tmp_path / "out")
    writers.write_analysis_json({"s": df}, path)
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert [json.loads(x) for x in lines] == [
        {"section": "s", "row": {"a": 1, "b": None}}, {"section": "s", "row": {"a": 2, "b": 1.5}},
    ]


def test_every_query_has_rows(spark):
    assert len(QUERIES) >= 100


def test_scratch_tables_go_with_their_block(spark):
    from pathlib import Path

    from jobmeter.session import materialize, scratch_tables

    folder = lambda df: Path(df.inputFiles()[0].removeprefix("file:")).parent
    with scratch_tables(spark):
        inside = folder(materialize(spark.range(3).toDF("n"), "block"))
        assert inside.exists()
    outside = folder(materialize(spark.range(3).toDF("n"), "stays"))
    assert not inside.exists() and outside.exists()


def test_sources_are_read_once(spark):
    """Quantiles and as-of lookups read their input once, samples twice, however many passes follow."""
    from jobmeter.operators import carbon, describe, sampling

    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("job_key"), F.col("id").alias("JobID"), (F.col("id") % 977 / 7).alias("v")
    )
    describe.describe(counted(rows), {"v": F.col("v")}).collect()
    assert seen.value == 4000
    sampling.sample_cap(counted(rows), 300).collect()
    assert seen.value == 12000  # once for the hashes of the keys, once for the sample
    readings = spark.range(500).select(
        F.lit("z").alias("zone"), F.timestamp_seconds(F.col("id") * 1800).alias("reading_ts"), F.col("id").cast("double").alias("carbon_intensity")
    )
    jobs = spark.createDataFrame([("z", 5000)], "zone string, at long").select("zone", F.timestamp_seconds("at").alias("Start"))
    assert carbon.intensity_asof(jobs, counted(readings)).collect()[0][carbon.INTENSITY] == 2.0
    assert seen.value == 12500
