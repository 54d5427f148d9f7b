"""Usage tables kept up to date from files, against one batch over all of them."""

from pathlib import Path

import pytest

from jobmeter.operators import energy, usage
from jobmeter.plans import features
from jobmeter.streaming import usage as live

JOBS = ["JobID", "User", "Start"]
READINGS = ["job_key", "energy_kWh"]


def deliver(folder, name, columns, rows):
    folder.mkdir(exist_ok=True)
    lines = ["|".join(columns)] + ["|".join("" if c is None else str(c) for c in row) for row in rows]
    (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture
def feed(spark, tmp_path):
    jobs, readings, table = tmp_path / "jobs", tmp_path / "readings", str(tmp_path / "table")
    jobs.mkdir(), readings.mkdir()
    count = iter(range(100))

    def run(new_jobs=(), new_readings=(), **options):
        name = next(count)
        if new_jobs:
            deliver(jobs, name, JOBS, new_jobs)
        if new_readings:
            deliver(readings, name, READINGS, new_readings)
        return live.refresh(
            live.stream_csv(spark, str(jobs), JOBS), live.stream_csv(spark, str(readings), READINGS), table,
            partitions=2, **options,
        )

    run.table = table
    return run


def key(job):
    return f"{job[1]}_{job[2]}"


def cells(spark, table):
    return {(r.start_day, r.start_hour): (r.job_count, round(r.energy_total_kwh, 9)) for r in live.day_hours(spark, table).collect()}


def batch(spark, jobs, readings):
    """The same cells from one batch over the distinct jobs and all readings."""
    table = spark.createDataFrame([(*j, None) for j in sorted(set(jobs), key=str)], "JobID string, User string, Start string, x string")
    parsed = features.parse_times(table.selectExpr("*", "Start as Submit", "Start as `End`"))
    keyed = parsed.selectExpr("*", "case when User <> '' and Start is not null then User || '_' || date_format(Start, 'yyyy-MM-dd HH:mm:ss') end as job_key")
    metered = energy.energy_per_job(spark.createDataFrame(readings, "job_key string, energy_kWh double"))
    rows = usage.by_day_hour(energy.join_features(keyed, metered)).collect()
    return {(r.start_day, r.start_hour): (r.job_count, round(r.energy_total_kwh, 9)) for r in rows}


def test_three_deliveries_equal_one_batch(spark, feed):
    jobs = [(str(i), f"u{i % 3}", f"2024-03-{1 + i % 5:02d} {i % 24:02d}:{i % 60:02d}:00") for i in range(40)]
    twins = [(f"t{i}", jobs[i][1], jobs[i][2]) for i in range(4)]  # same key as another job
    odd = [("n1", None, "2024-03-01 00:00:00"), ("n2", "u1", "Unknown"), (None, "u9", "2024-03-02 10:00:00")]
    readings = [(key(j), 0.5 + i) for i, j in enumerate(jobs[:30]) for _ in range(1 + i % 3)]
    readings += [(key(jobs[3]), None), (None, 7.0), ("stranger_2024-03-01 00:00:00", 1.0), ("u9_2024-03-02 10:00:00", 2.0)]
    # The newest come first; readings come before and after their jobs; jobs are repeated in every delivery.
    rows = sorted(jobs + twins + odd, key=lambda j: str(j[2]), reverse=True)
    parts = [rows[:15], rows[10:30] + rows[:5], rows[30:] + rows[:20] + rows[:20]]
    for i, part in enumerate(parts):
        feed(part, readings[i::3])
    assert cells(spark, feed.table) == batch(spark, jobs + twins + odd, readings)
    assert feed() == 0  # nothing new, nothing read
    before = cells(spark, feed.table)
    feed(rows)  # an export of everything again changes nothing
    assert cells(spark, feed.table) == before
    days = {r.start_day: r for r in live.by_day(spark, feed.table).collect()}
    assert sum(r.job_count for r in days.values()) == sum(n for n, _ in before.values())
    assert days["2024-03-02"].energy_mean_kwh == pytest.approx(days["2024-03-02"].energy_total_kwh / days["2024-03-02"].job_count)
    assert sum(r.job_count for r in live.by_hour_of_day(spark, feed.table).collect()) == sum(n for n, _ in before.values())


def test_a_micro_batch_that_runs_again_counts_once(spark, feed):
    feed([("1", "a", "2024-01-01 05:30:00")], [("a_2024-01-01 05:30:00", 2.5)])
    rows = spark.createDataFrame([(None, 1, 2.5)], "at timestamp, job_count long, energy_total_kwh double")
    rows = rows.selectExpr("timestamp'2024-01-01 05:30:00' as at", "job_count", "energy_total_kwh")
    live._write(feed.table)(rows, 0)  # the same batch once more
    assert cells(spark, feed.table) == {("2024-01-01", 5): (1, 2.5)}


def test_rows_later_than_the_delay_are_reported(spark, feed):
    late = [("2", "a", "2024-01-01 00:00:00")]
    feed([("1", "a", "2024-02-01 00:00:00")], [("a_2024-02-01 00:00:00", 1.0)], delay="10 days")
    feed([("3", "a", "2024-01-30 00:00:00")], [("a_2024-01-30 00:00:00", 2.0)], delay="10 days")  # late, but in time
    with pytest.raises(live.LateRows):
        feed(late, [("a_2024-01-01 00:00:00", 1.0)], delay="10 days")
    assert cells(spark, feed.table) == {("2024-02-01", 0): (1, 1.0), ("2024-01-30", 0): (1, 2.0)}


@pytest.mark.parametrize("delay", [None, "10 days"])
def test_each_job_is_in_the_state_of_one_join(spark, tmp_path, delay):
    streams = [live.stream_csv(spark, str(tmp_path), columns) for columns in (JOBS, READINGS)]
    plan = live.changes(*streams, delay)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join Inner") == 1
    assert plan.count("Deduplicate") == 2  # of the jobs and of the keys with a reading


def test_state_on_disk_gives_the_same_tables(spark, feed):
    names = [*live.ON_DISK, "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(name, None) for name in names]
    jobs = [(str(i), f"u{i % 3}", f"2024-03-{1 + i % 5:02d} {i % 24:02d}:{i % 60:02d}:00") for i in range(30)]
    readings = [(key(j), 0.5 + i) for i, j in enumerate(jobs[:25]) for _ in range(1 + i % 3)]
    feed(jobs[:20], readings[::2], delay="400 days", on_disk=True)
    feed(jobs[10:], readings[1::2], delay="400 days", on_disk=True)
    assert cells(spark, feed.table) == batch(spark, jobs, readings)
    assert feed(delay="400 days", on_disk=True) == 0
    feed(jobs, delay="400 days", on_disk=True)  # repeats in a later refresh
    assert cells(spark, feed.table) == batch(spark, jobs, readings)
    assert list(Path(feed.table).rglob("*.sst")) or list(Path(feed.table).rglob("*.zip"))  # RocksDB's files
    assert [spark.conf.get(name, None) for name in names] == before
