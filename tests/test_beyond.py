"""Runs over changing intensity, sketches, unmatched rows, changes between exports, sessions, SQL functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobmeter import sql
from jobmeter.functions import text
from jobmeter.operators import carbon, reconcile, scripts, sessions, sketches, snapshots

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def overlap_mean(readings, zone, start, end, hold=None):
    """Mean intensity of a run by laying it over every interval."""
    fallback = {"US-CAL-CISO": 250.0, "US-NY-ISONE": 200.0, "US-TX-ERCOT": 400.0, "US-PJM": 350.0}.get(zone, 300.0)
    if start is None and end is None:
        return fallback
    begin = start or end
    finish = max(begin, end or begin)
    points = sorted((t, v or 0.0) for z, t, v in readings if z == zone and t is not None)
    pieces = [(dt.datetime.min, points[0][0] if points else dt.datetime.max, fallback)]
    for i, (t, v) in enumerate(points):
        until = points[i + 1][0] if i + 1 < len(points) else dt.datetime.max
        stop = min(until, t + hold * HOUR) if hold is not None else until
        pieces += [(t, stop, v), (stop, until, fallback)]
    if begin == finish:
        return next(v for a, b, v in pieces if a <= begin < b)
    overlap = [(max((min(b, finish) - max(a, begin)).total_seconds(), 0), v) for a, b, v in pieces]
    return sum(s * v for s, v in overlap) / sum(s for s, _ in overlap)


@pytest.mark.parametrize("hold", [None, 2.0])
def test_intensity_over_run(spark, hold):
    rng = random.Random(4)
    readings = [("US-PJM", T0 + i * HOUR, rng.choice([None, float(rng.randint(100, 500))])) for i in range(60) if i % 9 < 6]
    readings += [("here", T0 + 30 * i * HOUR, 100.0 * i) for i in range(4)] + [("once", T0 + 5 * HOUR, 77.0)]
    readings += [("US-PJM", T0, 50.0), (None, T0, 1.0), ("here", None, 1.0)]
    single = {}
    for z, t, v in readings:
        if z and t:
            single[z, t] = max((x for x in (single.get((z, t)), v) if x is not None), default=None)
    runs = []
    for i in range(150):
        start = T0 + rng.uniform(-30, 140) * HOUR
        runs.append((i, rng.choice(["US-PJM", "here", "once", "US-TX-ERCOT", None]), start, start + rng.choice([0, 0.1, 3, 20, 90]) * HOUR))
    runs += [(200, "here", T0, None), (201, "here", None, T0 + 31 * HOUR), (202, "here", None, None), (203, "here", T0 + 61 * HOUR, T0)]
    runs += [(204, "here", T0, T0 + 30 * HOUR), (205, "here", T0 - 9 * HOUR, T0), (206, "once", T0 + 5 * HOUR, T0 + 9 * HOUR)]
    jobs = spark.createDataFrame(runs, "i int, zone string, Start timestamp, `End` timestamp")
    table = spark.createDataFrame(readings, "zone string, reading_ts timestamp, carbon_intensity double")
    found = carbon.intensity_over_run(jobs, table, max_hold_hours=hold)
    assert found.columns == [*jobs.columns, carbon.INTENSITY]
    got = {r["i"]: r[carbon.INTENSITY] for r in found.collect()}
    assert len(got) == len(runs)
    flat = [(z, t, v) for (z, t), v in single.items()]
    for i, zone, start, end in runs:
        assert got[i] == pytest.approx(overlap_mean(flat, zone, start, end, hold), abs=1e-6), (i, zone, start, end)
    empty = carbon.intensity_over_run(jobs, table.limit(0)).where("zone = 'here'").first()
    assert empty[carbon.INTENSITY] == 300.0


def test_a_run_is_never_spelled_out_into_hours(spark):
    jobs = spark.createDataFrame([("z", T0, T0 + 10_000 * HOUR)] * 3, "zone string, Start timestamp, `End` timestamp")
    readings = spark.createDataFrame([("z", T0 + i * HOUR, 1.0 * (i % 5)) for i in range(0, 500)], "zone string, reading_ts timestamp, carbon_intensity double")
    found = carbon.intensity_over_run(jobs, readings)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3


@pytest.fixture(scope="module")
def dated(spark):
    rng = random.Random(1)
    rows = [(f"u{int(rng.paretovariate(0.6)) % 3000}", T0 + rng.uniform(0, 40 * 24) * HOUR, rng.lognormvariate(0, 2)) for _ in range(20_000)]
    rows += [(None, T0, 1.0), ("x", None, 1.0), ("x", T0, None), ("x", T0, float("nan"))]
    return rows, spark.createDataFrame(rows, "User string, Start timestamp, energy_kWh double")


RANGES = [("one", "2024-01-03", "2024-01-03"), ("month", "2024-01-01", "2024-01-31"), ("all", "2023-01-01", "2025-01-01"), ("none", "2030-01-01", "2030-01-05"), ("back", "2024-02-01", "2024-01-01")]


def in_range(rows, name):
    first, last = next((a, b) for n, a, b in RANGES if n == name)
    return [r for r in rows if r[1] is not None and first <= r[1].strftime("%Y-%m-%d") <= last]


def test_quantiles_from_sketches(spark, dated):
    rows, jobs = dated
    daily = sketches.daily_quantile_sketches(jobs, ["energy_kWh"], k=200)
    ranges = spark.createDataFrame(RANGES, "name string, first_day string, last_day string")
    found = {r.name: r for r in sketches.quantiles(daily, ranges, [0.01, 0.5, 0.95]).collect()}
    assert set(found) == {"one", "month", "all"}
    for name, r in found.items():
        values = sorted(e for _, _, e in in_range(rows, name) if e is not None and e == e)
        assert r.known == len(values)
        for share, q in zip((0.01, 0.5, 0.95), r.quantiles):
            rank = sum(v <= q for v in values) / len(values)
            assert abs(rank - share) <= 3 * sketches.rank_error(200) + 1 / len(values)
    assert sketches.rank_error(800) < sketches.rank_error(200) < 0.014


def test_sketches_of_days_do_not_grow_with_jobs(spark, dated):
    _, jobs = dated
    daily = sketches.daily_quantile_sketches(jobs, ["energy_kWh"], k=200)
    assert daily.agg(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    assert sketches.daily_quantile_sketches(jobs.limit(0), ["energy_kWh"]).count() == 0


def test_distinct_users_from_sketches(spark, dated):
    rows, jobs = dated
    daily = sketches.daily_user_sketches(jobs)
    ranges = spark.createDataFrame(RANGES, "name string, first_day string, last_day string")
    users = {n: {u for u, _, _ in in_range(rows, n) if u is not None} for n, _, _ in RANGES}
    found = {r.name: r.users for r in sketches.distinct_users(daily, ranges).collect()}
    assert set(found) == {"one", "month", "all"}
    assert all(abs(found[n] / len(users[n]) - 1) <= 4 * sketches.hll_error() + 1e-9 for n in found)
    pairs = [("one", "month"), ("month", "all"), ("one", "none"), ("none", "none"), ("one", "one")]
    shared = sketches.shared_users(daily, ranges, spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {(r.a, r.b): r.shared for r in shared} == {(a, b): len(users[a] & users[b]) for a, b in pairs}


@pytest.mark.parametrize("swapped", [False, True])
def test_unmatched_rows(spark, swapped):
    rng = random.Random(2)
    few = [(rng.choice([None, f"k{rng.randrange(300)}"]), i) for i in range(200)]
    many = [(rng.choice([None, f"k{rng.randrange(200, 3000)}"]), i) for i in range(3000)]
    left, right = (many, few) if swapped else (few, many)
    a, b = (spark.createDataFrame(rows, "job_key string, i int") for rows in (left, right))
    found = reconcile.unmatched(a, b)
    for df, mine, other in zip(found, (left, right), (right, left)):
        keys = {k for k, _ in other}
        assert sorted(map(tuple, df.collect()), key=str) == sorted(((k, i) for k, i in mine if k is None or k not in keys), key=str)


def test_unmatched_tables_may_be_empty(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "job_key string, i int")
    left, right = reconcile.unmatched(a, a.limit(0))
    assert left.count() == 2 and right.count() == 0
    left, right = reconcile.unmatched(a.limit(0), a)
    assert left.count() == 0 and right.count() == 2


def test_the_filter_works_below_the_shuffle(spark):
    small = spark.range(500).selectExpr("'k' || id as job_key")
    large = spark.range(50_000).selectExpr("'k' || id * 7 as job_key")
    _, alone = reconcile.unmatched(small, large)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan
    bits = reconcile.bloom_bits(small, "job_key", 1 << 13).first()["bits"]
    assert len(bits) == 128 and sum(bin(w & (2**64 - 1)).count("1") for w in bits) > 1500
    held = large.where(reconcile.may_contain(F.lit(bits), F.col("job_key"), 1 << 13)).count()
    exact = large.join(small, "job_key").count()
    assert exact <= held < exact + 0.05 * 50_000


def multiset(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_difference_of_exports(spark):
    schema = "id int, a string, b string"
    old = [(1, "x", None), (1, "x", None), (2, None, "y"), (3, "p", "q"), (3, "p", "q"), (4, "s", "t"), (None, "n", "n"), (6, "", None)]
    new = [(1, "x", None), (2, "y", None), (3, "p", "q"), (3, "p", "Q"), (3, "p", "R"), (5, "new", "new"), (None, "n", "m"), (6, None, "")]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    found = snapshots.difference(a, b, "id")
    plain = lambda r: None if r is None else tuple(r)
    rows = sorted(((r.change, r.key, r.copies, plain(r.old), plain(r.new)) for r in found.collect()), key=str)
    # One (3, p, q) became one of the two new rows, by digest; the other is inserted.
    third = [r for r in rows if r[1] == 3]
    assert [r[0] for r in third] == ["changed", "inserted"] and all(r[2] == 1 for r in third)
    assert {r[4] for r in third} == {(3, "p", "Q"), (3, "p", "R")} and third[0][3] == (3, "p", "q")
    assert [r for r in rows if r[1] != 3] == sorted(
        [
            ("deleted", 1, 1, (1, "x", None), None), ("changed", 2, 1, (2, None, "y"), (2, "y", None)),
            ("deleted", 4, 1, (4, "s", "t"), None), ("inserted", 5, 1, None, (5, "new", "new")),
            ("deleted", None, 1, (None, "n", "n"), None), ("inserted", None, 1, None, (None, "n", "m")),
            ("changed", 6, 1, (6, "", None), (6, None, "")),
        ],
        key=str,
    )
    # Put together again, it is EXCEPT ALL both ways.
    for side, (x, y) in (("old", (a, b)), ("new", (b, a))):
        there = found.where(f"{side} is not null").select(F.explode(F.sequence(F.lit(1), "copies")), f"{side}.*")
        assert multiset(there, "id", "a", "b") == multiset(x.exceptAll(y), "id", "a", "b")
    assert snapshots.difference(a, a, "id").count() == 0 and snapshots.difference(a.limit(0), a.limit(0), "id").count() == 0


def test_history_of_row_versions(spark):
    rows = [
        ("d1", 1, "a"), ("d2", 1, "a"), ("d2", 1, "a"), ("d3", 1, "b"), ("d4", 1, "a"),
        ("d1", 2, None), ("d3", 2, None), ("d4", 2, None), ("d2", 3, "z"),
    ]
    found = snapshots.history(spark.createDataFrame(rows, "snapshot string, id int, v string"), "id")
    assert sorted(((r.key, r.row.v, r.valid_from, r.valid_to) for r in found.collect()), key=str) == sorted(
        [(1, "a", "d1", "d3"), (1, "b", "d3", "d4"), (1, "a", "d4", None), (2, None, "d1", "d2"), (2, None, "d3", None), (3, "z", "d2", "d3")],
        key=str,
    )


def test_sessions_equal_session_windows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b"]), T0 + dt.timedelta(seconds=rng.randrange(40 * 86400))) for _ in range(3000)]
    rows += [(None, T0), ("a", None), ("edge", T0), ("edge", T0 + 0.5 * HOUR), ("edge", T0 + 1.25 * HOUR), ("edge", T0)]
    jobs = spark.createDataFrame(rows, "User string, Submit timestamp")
    found = sessions.submit_sessions(jobs).collect()
    window = F.session_window("Submit", "30 minutes")
    known = jobs.where("User is not null and Submit is not null")
    expected = known.groupBy("User", window).agg(F.min("Submit").alias("a"), F.max("Submit").alias("b"), F.count("*").alias("n")).collect()
    mine = {(r.user, r.session_start, r.session_end, r.job_count) for r in found}
    # A pause of exactly the gap keeps a session together here.
    assert {x for x in mine if x[0] == "edge"} == {("edge", T0, T0 + 0.5 * HOUR, 3), ("edge", T0 + 1.25 * HOUR, T0 + 1.25 * HOUR, 1)}
    theirs = {(r.User, r.a, r.b, r.n) for r in expected}
    exact_gap = {x for x in theirs ^ mine if x[0] != "edge"}
    assert not exact_gap


def test_sql_functions_agree_with_the_columns(spark):
    sql.register(spark)
    sql.register(spark)  # may be called again
    samples = [
        None, "", " ", "4000Mc", "1T", "12G", "3.5K", "1.2.3", "8GB", "1G2", "5x", "90", "1-02:30:00", "02:00", "12:", "a:b", "-1:-2",
        "--1:3", "1-2-3", "UNLIMITED", "2-03:04:05", "03:04:05", "sh01-12", "node[001-010]", "node007", "123", "gpu:V100:4", "--gres=gpu:4,ssd:1",
        "--gres gpu:2", "gpu", "1e2", " 7 ", "\t8M\n", "9223372036854775808", "#SBATCH", "12 GB", "1P",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    columns = {
        "req_mem_gb": text.requested_memory_gb, "walltime_hours": text.walltime_hours, "script_mem_gb": text.script_memory_gb,
        "gres_gpu_count": text.gpu_request_count, "runtime_string_hours": text.runtime_hours_text, "node_prefix": text.node_prefix,
    }
    expected = df.select("i", *[f(F.col("t")).alias(n) for n, f in columns.items()])
    found = spark.sql("SELECT i, " + ", ".join(f"{n}(t) AS {n}" for n in columns) + " FROM {df}", df=df)
    assert found.schema.simpleString() == expected.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_sql_script_parser_agrees_and_has_no_python(spark):
    sql.register(spark)
    bodies = [
        None, "", "#!/bin/bash\n#SBATCH --partition=a\n#SBATCH --time=bad\r\n  #SBATCH --time 02:00\n#SBATCH --mem-per-cpu=4G\nsrun",
        "#SBATCH --gres gpu:2\n#SBATCH --gres=x\n#SBATCH --nodes=x\n#SBATCH\t--nodes=3\x0b#SBATCH --ntasks-per-node=7", "#SBATCH --nodelist=", "#SBATCH",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bodies)], "i int, sbatchText string")
    expected = scripts.parse_sbatch(df).drop("sbatchText")
    found = spark.sql("SELECT i, p.* FROM {df}, LATERAL parse_sbatch(sbatchText) AS p", df=df)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan


def test_mixed_headers_in_a_constant_number_of_jobs(spark, tmp_path):
    from jobmeter.sources import readers

    for i in range(60):
        header, row = (("JobID|User", f"{i}|u"), (" User |Extra|JobID", f'u|"a|b"|{i}'), ("JobID", f"{i}"))[i % 3]
        (tmp_path / f"part {i}+%.csv").write_text(f"{header}\n{row}\n{row}\n")
    (tmp_path / "header only.csv").write_text("JobID|Other\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("mixed", "mixed")
    out = readers.read_sacct_dir(spark, str(tmp_path))
    jobs = len(tracker.getJobIdsForGroup("mixed"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 8 and set(out.columns) == {"JobID", "User", "Extra", "Other"}
    rows = sorted((int(r.JobID), r.User, r.Extra) for r in out.collect())
    assert rows == sorted((i, (None if i % 3 == 2 else "u"), ("a|b" if i % 3 == 1 else None)) for i in range(60) for _ in range(2))


def test_insights_document_is_one_json_object(spark, tmp_path):
    import json

    from jobmeter.sources import readers, writers

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    waits = "job_count long, energy_total_kwh double, energy_mean_kwh double, queue_wait_time_hours_mean double, requested_walltime_hours_mean double"
    stats = [("energy_kWh", 3, 0.5, 2.0, 1.0, 0.9, float("nan")), ("requested_walltime_hours", 1, 1.0, 1.0, 1.0, 1.0, None), ("queue_wait_time_hours", 0, None, None, None, None, None)]
    sections = {
        "by_user": frame([(f'u"{i}\\\n', i, 0.5 * i, float("inf"), None, 1.0) for i in range(40)], f"user string, {waits}"),
        "by_account": frame([], f"account string, {waits}"), "by_state": frame([("é", 1, 1.0, 1.0, 1.0, 1.0)], f"state string, {waits}"),
        "by_job_type": frame([("CPU", 1, 1.0, 1.0, 1.0, 1.0)], f"job_type string, {waits}"),
        "by_day": frame([("2024-01-02", 1, 1.0, 1.0), ("2024-01-01", 2, 1.0, 0.5)], "start_day string, job_count long, energy_total_kwh double, energy_mean_kwh double"),
        "by_hour_of_day": frame([(h, 1, 1.0, 1.0) for h in (23, 3, 11)], "start_hour int, job_count long, energy_total_kwh double, energy_mean_kwh double"),
        "by_day_hour": frame([("2024-01-01", h, 1, 1.0) for h in (10, 9)], "start_day string, start_hour int, job_count long, energy_total_kwh double"),
        "job_type_breakdown": frame([("CPU", 1, 1.0, 1.0)], "job_type string, job_count long, energy_total_kwh double, energy_mean_kwh double"),
        "top_users_by_energy": frame([("a", 1.5)], "user string, energy_total_kwh double"),
        "dataset": frame([(3, 2, "2024-01-01T00:00:00Z", None, 1)], "job_count long, unique_users long, range_start string, range_end string, total_days long"),
        "summary_stats": frame(stats, "metric string, count long, min double, max double, mean double, median double, p95 double"),
        "categorical": frame([("User", "x", 3), ("User", "y", 1), ("State", "", 2)], "column string, value string, job_count long"),
        "schema": frame([("features", "a", "int", 3), ("predictions", "b", "double", 1)], "table string, field string, type string, known long"),
        "missingness": frame([("features", "a", 1), ("merged_records", "b", 2)], "table string, field string, missing long"),
    }
    path = str(tmp_path / "doc")
    writers.write_insights_json(sections, path, "2024-02-01T00:00:00Z")
    files = list((tmp_path / "doc").glob("*.txt"))
    assert len(files) == 1
    document = json.loads(files[0].read_text())
    assert document["generated_at_utc"] == "2024-02-01T00:00:00Z" and document["units"]["energy"] == "kWh"
    assert len(document["aggregations"]["by_user"]) == 40 and document["aggregations"]["by_account"] == []
    assert {r["user"] for r in document["aggregations"]["by_user"]} == {f'u"{i}\\\n' for i in range(40)}
    assert all(r["energy_mean_kwh"] is None for r in document["aggregations"]["by_user"])
    assert [r["start_hour"] for r in document["aggregations"]["by_hour_of_day"]] == [3, 11, 23]
    assert [r["start_day"] for r in document["aggregations"]["by_day"]] == ["2024-01-01", "2024-01-02"]
    assert document["dataset"]["time_range"] == {"start": "2024-01-01T00:00:00Z", "end": None}
    assert document["dataset"]["energy_kwh"] == {"count": 3, "min": 0.5, "max": 2.0, "mean": 1.0, "median": 0.9, "p95": None}
    assert set(document["distributions"]["numeric"]) == {"energy_kWh", "requested_walltime_hours", "queue_wait_time_hours"}
    assert document["distributions"]["categorical"] == {"User": {"x": 3, "y": 1}, "Account": {}, "State": {"": 2}, "job_type": {}}
    assert document["schema"] == {"features": {"a": "int"}, "predictions": {"b": "double"}, "merged_records": {}}
    assert document["missingness"] == {"features": {"a": 1}, "predictions": {}, "merged_records": {"b": 2}}
    assert document["model_performance"] is None
    read = readers.read_insights_json(spark, path)
    assert readers.insight_rows(read, "aggregations.by_user").count() == 40


def test_sql_script_parser_splits_a_script_once(spark):
    sql.register(spark)
    df = spark.createDataFrame([("#SBATCH --nodes=2",)], "sbatchText string")
    found = spark.sql("SELECT p.* FROM {df}, LATERAL parse_sbatch(sbatchText) AS p", df=df)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.expressions().size() == len(scripts.DIRECTIVES)
    # Every column is a field of one common expression, which is evaluated once a row.
    children = {plan.expressions().apply(i).child().child().canonicalized().toString() for i in range(len(scripts.DIRECTIVES))}
    assert len(children) == 1


def test_shared_users_of_large_ranges_are_exact(spark):
    # 6,000 users, more than a sketch of the default size of a union; then 20,000, more than a day's sketch holds.
    people = spark.range(46_000).selectExpr(
        "concat('u', if(id < 12000, id % 6000, (id - 12000) % 20000)) as User",
        "case when id < 6000 then timestamp'2024-01-01' when id < 12000 then timestamp'2024-01-02' "
        "when id < 32000 then timestamp'2024-01-03' else timestamp'2024-01-04' end as Start",
    )
    daily = sketches.daily_user_sketches(people)
    ranges = spark.createDataFrame([(str(d), f"2024-01-0{d}", f"2024-01-0{d}") for d in range(1, 5)], "name string, first_day string, last_day string")
    pairs = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("3", "3"), ("4", "x")], "a string, b string")
    small = {(r.a, r.b): r.shared for r in sketches.shared_users(daily, ranges, pairs).collect()}
    assert small["1", "2"] == 6_000
    found = {(r.a, r.b): r.shared for r in sketches.shared_users(daily, ranges, pairs, sketches.daily_members(people)).collect()}
    assert found == {("1", "2"): 6_000, ("2", "3"): 6_000, ("3", "4"): 14_000, ("3", "3"): 20_000, ("4", "x"): 0}
