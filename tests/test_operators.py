"""Operators on small tables, against values worked out by hand or by brute force."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

import jobmeter.operators.describe as describe_module
from jobmeter.operators import carbon, daily, energy, lookups, ranking, reports, sampling, scripts
from jobmeter.operators.describe import describe, summary_stats


def days(spark, rows):
    return spark.createDataFrame(
        rows, "start_day string, job_count bigint, energy_total_kwh double, energy_mean_kwh double"
    )


def test_energy_per_job(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", None), ("b", None), (None, 5.0), ("c", float("nan"))]
    out = energy.energy_per_job(spark.createDataFrame(rows, "job_key string, energy_kWh double"))
    assert {r.job_key: r.energy_kWh for r in out.collect()} == {"a": 3.0, "b": 0.0, "c": 0.0}


def test_join_keeps_copies_and_suffixes(spark):
    jobs = spark.createDataFrame(
        [("a", 1, 9.0), ("a", 2, 9.0), ("z", 3, 9.0), (None, 4, 9.0)], "job_key string, id int, energy_kWh double"
    )
    out = energy.join_features(jobs, spark.createDataFrame([("a", 5.0)], "job_key string, energy_kWh double"))
    assert sorted((r.id, r.energy_kWh, r.energy_kWh_em) for r in out.collect()) == [(1, 9.0, 5.0), (2, 9.0, 5.0)]
    assert [tuple(r) for r in energy.repeated_job_keys(jobs).collect()] == [("a", 2)]


@pytest.mark.parametrize("sortable", [5, 1_000_000])
def test_exact_quantiles(spark, monkeypatch, sortable):
    monkeypatch.setattr(describe_module, "SORTABLE_ROWS", sortable)
    rng = random.Random(5)
    columns = {
        "spread": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(999)],
        "hot": [7.25] * 400 + [7.25 + rng.random() * 1e-9 for _ in range(599)],
        "whole": [float(rng.randrange(5)) for _ in range(999)],
        "gaps": [rng.gauss(0, 1) if i % 3 else None for i in range(999)],
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    out = {r.metric: r for r in describe(df, {c: F.col(c) for c in columns}).collect()}
    for name, values in columns.items():
        known = sorted(v for v in values if v is not None)

        def at(p):
            place = p * (len(known) - 1)
            low, high = known[math.floor(place)], known[math.ceil(place)]
            return low + (high - low) * (place - math.floor(place))

        row = out[name]
        assert row["count"] == len(known)
        assert (row.min, row.max) == (known[0], known[-1])
        assert row.mean == pytest.approx(statistics.fmean(known), rel=1e-9, abs=1e-12)
        assert row["std"] == pytest.approx(statistics.stdev(known), rel=1e-6, abs=1e-15)
        assert [row.p25, row.p50, row.p75] == [at(0.25), at(0.5), at(0.75)]


def test_describe_one_row_and_none(spark):
    df = spark.createDataFrame([(4.0, None)], "x double, y double")
    out = describe(df, {"x": F.col("x"), "y": F.col("y")}).collect()
    assert len(out) == 1 and out[0]["std"] is None and out[0].p50 == 4.0


def test_summary_approximate_is_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    exact = summary_stats(df, {"x": F.col("x")}).first()
    rough = summary_stats(df, {"x": F.col("x")}, exact=False).first()
    assert (exact.median, exact.p95) == (500.0, 950.0)
    assert abs(rough.median - 500) <= 1 and abs(rough.p95 - 950) <= 1


def test_value_counts_share(spark):
    df = spark.range(800).select(F.when(F.col("id") == 0, "rare").when(F.col("id") < 700, "usual").alias("s"))
    out = {r.s: r for r in ranking.value_counts(df, "s", 2).collect()}
    assert out["rare"].percentage == 0.12 and out["usual"].job_count == 699
    assert out["usual"].distinct_values == 2 and len(out) == 2


def test_value_counts_reads_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select((F.col("id") % 7).cast("string").alias("s")).write.parquet(path)
    out = ranking.value_counts(spark.read.parquet(path), "s")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_global_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    out = ranking.with_position(df, [F.desc("v")]).collect()
    assert sorted((r.position, r.v) for r in out) == [(i, 999 - i) for i in range(1000)]


def test_label_encode(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("B", 4)], "User string, n int")
    out = {r.n: r.User for r in lookups.label_encode(df, ["User", "absent"]).collect()}
    assert out == {1: 2, 2: -1, 3: 1, 4: 0}


def test_zone_lookup(spark):
    df = spark.createDataFrame([("sh",), ("SH",), ("xyz",), (None,), ("aa",), ("AA",), ("",)], "node_prefix string")
    assert {r.zone for r in lookups.zone_lookup(df).collect()} == {"US-CAL-CISO"}
    custom = {"AA": "Z1", "Aa": "Z2", "sh": "Z3"}
    table = spark.createDataFrame(list(custom.items()), "prefix string, zone string")
    want = {"sh": "Z3", "SH": "Z3", "xyz": "US-CAL-CISO", None: "US-CAL-CISO", "aa": "Z1", "AA": "Z1", "": "US-CAL-CISO"}
    for mapping in (custom, table):
        out = lookups.zone_lookup(df, mapping=mapping)
        assert out.columns == ["node_prefix", "zone"]
        assert {r.node_prefix: r.zone for r in out.collect()} == want


def test_small_side_is_checked(spark):
    assert "ResolvedHint" in lookups.small_side(spark.range(5))._jdf.queryExecution().analyzed().toString()
    big = lookups.small_side(spark.range(50), max_rows=10)
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()


def readings(spark):
    rows = [
        ("A", "2024-01-01 00:00:00", 10.0), ("A", "2024-01-01 00:30:00", 20.0),
        ("A", "2024-01-03 05:00:00", None), ("A", "2024-01-03 06:00:00", 40.0),
        ("B", "2024-01-01 00:00:00", None), ("US-PJM", "2024-02-01 00:00:00", 1.0),
    ]
    df = spark.createDataFrame(rows, "zone string, reading_ts string, carbon_intensity double")
    return df.withColumn("reading_ts", F.col("reading_ts").cast("timestamp"))


def test_intensity_lookup(spark):
    df = spark.createDataFrame([("A",), ("B",), ("US-NY-ISONE",), ("nowhere",)], "zone string")
    out = {r.zone: r[carbon.INTENSITY] for r in carbon.intensity_lookup(df, readings(spark)).collect()}
    assert out == {"A": 40.0, "B": 0.0, "US-NY-ISONE": 200.0, "nowhere": 300.0}


def test_intensity_asof(spark):
    rows = [
        ("A", "2023-12-31 23:59:59", 300.0), ("A", "2024-01-01 00:00:00", 10.0), ("A", "2024-01-01 00:29:59.9", 10.0),
        ("A", "2024-01-01 00:30:00", 20.0), ("A", "2024-01-02 12:00:00", 20.0), ("A", "2024-01-03 05:10:00", 0.0),
        ("A", "2024-01-03 06:00:00", 40.0), ("A", "2030-01-01 00:00:00", 40.0), ("B", "2024-01-05 00:00:00", 0.0),
        ("US-PJM", "2024-01-01 00:00:00", 350.0), ("US-PJM", "2024-02-02 00:00:00", 1.0), ("C", "2024-01-01 00:00:00", 300.0),
        ("A", None, 300.0), (None, "2024-01-01 00:00:00", 300.0),
    ]
    jobs = spark.createDataFrame(rows, "zone string, s string, want double").withColumn("Start", F.col("s").cast("timestamp"))
    out = carbon.intensity_asof(jobs, readings(spark)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r[carbon.INTENSITY] == r.want, r


def test_rolling_and_peaks(spark):
    table = days(spark, [(f"2024-01-0{i + 1}", n, float(n), 1.0) for i, n in enumerate([1, 5, 2])])
    rows = daily.enrich_by_day(table).collect()
    assert [r.rolling7_job_count for r in rows] == [1.0, 3.0, 8 / 3]
    assert [r.peakVolume for r in rows] == [False, True, False]
    assert [r.efficiencyAnomaly for r in rows] == [False] * 3
    two = daily.peak_flags(days(spark, [("2024-01-01", 9, 9.0, 1.0), ("2024-01-02", 1, 1.0, 1.0)]))
    assert [r.peakVolume for r in two.orderBy("start_day").collect()] == [True, False]


def test_anomaly_needs_calm_volume(spark):
    base = [(f"2024-01-{i + 1:02d}", 10, 10.0 + i % 2, 1.0) for i in range(9)]
    high = daily.enrich_by_day(days(spark, base + [("2024-01-10", 10, 90.0, 9.0)])).collect()
    assert [r.efficiencyAnomaly for r in high] == [False] * 9 + [True]
    surge = daily.enrich_by_day(days(spark, base + [("2024-01-10", 30, 270.0, 9.0)])).collect()
    assert not any(r.efficiencyAnomaly for r in surge)


def test_rolling_means_take_seven_rows(spark):
    table = days(spark, [(f"2024-01-{i + 1:02d}", i, float(i), 1.0) for i in range(10)])
    rows = daily.rolling7(table).orderBy("start_day").collect()
    assert rows[9].rolling7_job_count == statistics.fmean(range(3, 10))


def test_empty_tables(spark):
    empty = days(spark, [])
    assert daily.enrich_by_day(empty).collect() == []
    assert tuple(daily.median_mad(empty).first()) == (0.0, 0.0)
    hours = spark.createDataFrame([], "start_hour int, job_count bigint, energy_total_kwh double, energy_mean_kwh double")
    assert daily.low_energy_hour_share(hours).first()[0] == 0.0


def test_weeks(spark):
    table = spark.createDataFrame([(f"2024-01-{i + 1:02d}", i) for i in range(9)], "start_day string, job_count bigint")
    assert {r.week: r.average_jobs for r in daily.weekly_average(table).collect()} == {"Week 1": 3.0, "Week 2": 7.5}
    assert [r.start_day for r in daily.every_7th_day(table).orderBy("start_day").collect()] == ["2024-01-01", "2024-01-08"]


def test_peak_days_first_of_ties(spark):
    table = spark.createDataFrame([("d1", 3), ("d2", 9), ("d3", 3), ("d4", 9)], "start_day string, job_count bigint")
    assert tuple(daily.peak_days(table).first()) == ("d2", 9, "d1", 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(h,) for h in (-1.0, 0.0, 0.1, 1.0, 6.0, 24.0, 168.0, None)], "h double")
    out = reports.runtime_histogram(df, F.col("h")).orderBy("position").collect()
    assert [r.job_count for r in out] == [1] * 7
    classes = reports.duration_classes(df, F.col("h")).orderBy("position").collect()
    assert [r.job_count for r in classes] == [3, 3, 1]


def test_missingness_counts_nan(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "a", 1.0)], "a int, b string, c double")
    assert {r.field: r.missing for r in reports.missingness(df, "t").collect()} == {"b": 1, "c": 1}


def parsed(spark, script):
    df = spark.createDataFrame([(1, script)], "id int, sbatchText string")
    return scripts.parse_sbatch(df).first()


def test_script_rules(spark):
    assert parsed(spark, "#SBATCH --time=02:00:00\n#SBATCH --time=bad").walltime_hours == 2.0
    both = parsed(spark, "#SBATCH --mem-per-cpu=4G")
    assert (both.memory_gigabytes_per_cpu, both.memory_gigabytes_total) == (4.0, 4.0)
    odd = parsed(spark, "#SBATCH --ntasks-per-node=8\n#SBATCH --nodes=2-4\n#SBATCH --mem=32G # note\n#SBATCH -c 8")
    assert (odd.task_count, odd.node_count, odd.memory_gigabytes_total, odd.cpu_cores_per_task) == (8, None, None, None)
    spaced = parsed(spark, "  #SBATCH --partition  gpu extra\r\n#SBATCH --partition=\r\n#SBATCH --time-min=5")
    assert (spaced.partition_name, spaced.walltime_hours) == ("gpu", 5.0)
    later = parsed(spark, "#SBATCH --nodes=2\n#SBATCH --nodes=7\necho #SBATCH --nodes=9")
    assert later.node_count == 7
    for nothing in (None, "", "   ", "echo hi"):
        assert all(v is None for v in parsed(spark, nothing)[2:])


def test_script_totals(spark):
    df = spark.createDataFrame(
        [(1, 8, 0, None, 2.0), (2, None, 3, 5.0, 2.0), (3, 8, 2, 5.0, 2.0)],
        "id int, cpu_cores_per_task bigint, task_count bigint, memory_gigabytes_total double, memory_gigabytes_per_cpu double",
    )
    cores = F.coalesce(scripts.total_cores(), F.lit(0))
    out = df.select(
        scripts.total_cores().alias("c"), scripts.total_memory_gb(cores).alias("m"),
        scripts.total_memory_gb(cores, mem_per_cpu_fix=True).alias("f"),
    ).collect()
    assert [tuple(r) for r in out] == [(8, 16.0, 16.0), (None, 5.0, 2.0), (16, 5.0, 32.0)]


def test_sample_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("job_key"), F.col("id").alias("JobID"))
    first = {r.JobID for r in sampling.sample_cap(df, 700).collect()}
    again = {r.JobID for r in sampling.sample_cap(df.repartition(13), 700).collect()}
    assert len(first) == 700 and first == again
    assert first != {r.JobID for r in sampling.sample_cap(df, 700, seed=1).collect()}
    assert sampling.sample_cap(df, 9000).count() == 5000
    assert sampling.sample_cap(df, 10, ignore_limits=True).count() == 5000


def test_folds_keep_users_together(spark):
    rows = [(f"u{i % 11}" if i % 13 else None, i) for i in range(600)] + [("big", i) for i in range(300)]
    df = spark.createDataFrame(rows, "User string, n int")
    for mode in ("greedy", "snake", "hash"):
        out = sampling.group_folds(df, 5, mode=mode)
        assert out.count() == 900
        per_user = out.groupBy("User").agg(F.countDistinct("fold").alias("f")).collect()
        assert {r.f for r in per_user} == {1}
    sizes = sorted(r["count"] for r in sampling.group_folds(df, 5).groupBy("fold").count().collect())
    assert sizes == [150, 150, 150, 150, 300] or (sizes[-1] == 300 and len(sizes) == 5 and sizes[0] >= 100)
    with pytest.raises(ValueError, match="mode"):
        sampling.group_folds(df, 5, mode="balanced")
    with pytest.raises(ValueError, match="folds"):
        sampling.group_folds(df.where("User = 'big'"), 5)


def test_equal_groups_are_dealt_as_one_by_one():
    rng = random.Random(3)
    for _ in range(1500):
        k = rng.randint(1, 6)
        sizes = {rng.randint(1, rng.choice([3, 30, 300])): rng.randint(1, 40) for _ in range(rng.randint(1, 6))}
        loads, expected_loads = [0] * k, [0] * k
        for size, count in sorted(sizes.items(), reverse=True):
            expected = []
            for _ in range(count):
                lightest = min(range(k), key=lambda f: (expected_loads[f], f))
                expected_loads[lightest] += size
                expected.append(lightest)
            found = list(sampling._deal_equal(loads, size, count))
            ends = [at for at, _ in found[1:]] + [count]
            dealt = [turn[(p - at) % len(turn)] for (at, turn), end in zip(found, ends) for p in range(at, end)]
            assert dealt == expected and loads == expected_loads and len(found) <= 2 * k + 2


def test_one_heavy_user_has_a_fold_of_its_own(spark):
    rows = [("half", i) for i in range(500)] + [("tenth", i) for i in range(100)] + [(f"u{i % 40}", i) for i in range(400)]
    folds = sampling.group_folds(spark.createDataFrame(rows, "User string, n int"), 5)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [120, 120, 130, 130, 500]


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Joins without any broadcast, as for sides beyond the bound."""
    for module in (carbon, lookups, sampling):
        monkeypatch.setattr(module, "small_side", lambda df: df)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_lookups_without_broadcast(spark, shuffled):
    test_intensity_asof(spark)
    test_intensity_lookup(spark)
    test_label_encode(spark)
    test_zone_lookup(spark)
    test_folds_keep_users_together(spark)


def test_asof_against_brute_force(spark):
    rng = random.Random(11)
    zones = ["A", "A", "A", "B", "C"]
    noted = {(rng.choice(zones), rng.randrange(0, 9 * 86400)): float(rng.randrange(100)) for _ in range(300)}
    base = 1_704_067_200
    table = spark.createDataFrame(
        [(z, base + s, v) for (z, s), v in noted.items()], "zone string, s bigint, carbon_intensity double"
    ).select("zone", F.timestamp_seconds("s").alias("reading_ts"), "carbon_intensity")
    jobs = [(i, rng.choice(zones), rng.randrange(-86400, 12 * 86400)) for i in range(500)]
    df = spark.createDataFrame([(i, z, base + s) for i, z, s in jobs], "i int, zone string, s bigint").select(
        "i", "zone", F.timestamp_seconds("s").alias("Start")
    )
    for bucket in (3600, 700):
        out = {r.i: r[carbon.INTENSITY] for r in carbon.intensity_asof(df, table, bucket_seconds=bucket).collect()}
        for i, zone, s in jobs:
            before = [(t, v) for (z, t), v in noted.items() if z == zone and t <= s]
            assert out[i] == (max(before)[1] if before else 300.0)


def test_materialized_table_keeps_schema(spark):
    from jobmeter.session import materialize

    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "n int, day string, x double")
    out = materialize(df, "t", partition_by="day")
    assert sorted(tuple(r) for r in out.select(*df.columns).collect()) == [(1, "a", 2.0), (2, "b", None)]
