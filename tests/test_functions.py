"""Edge values of the column functions."""

import pytest
from pyspark.sql import functions as F

from jobmeter.functions import power, text, times


def close(values, expected):
    assert len(values) == len(expected)
    for got, want in zip(values, expected):
        assert got == want if want is None else got == pytest.approx(want, rel=1e-12), (got, want)


def test_requested_memory(evaluate):
    texts = ["12000M", "256G", "4000Mc", "512", "1T", "2048K", None, "abc", "", "1.2.3", " 4 g", "8GB", "64B"]
    close(
        evaluate(text.requested_memory_gb, texts),
        [11.71875, 256, 3.90625, 0.5, 1 / 1024, 2048 / 1048576, 0, 0, 0, 0, 4, 8, 64 / 1024],
    )


def test_allocated_resources(evaluate):
    texts = [
        "cpu=4,mem=8G,cpu=5", "cpu=4,gres/gpu:v100=2", "gres/gpu=2,gpu=9", "gpu=9", "cpu=x", None, "",
        " cpu = 3 , mem = 512M ", "cpu=8d", "gres/gpu=,gpu=3", "vcpu=7",
    ]
    close(evaluate(text.allocated_cpu, texts), [5, 4, 0, 0, 0, 0, 0, 3, 0, 0, 0])
    close(evaluate(text.allocated_memory_gb, texts), [8, 0, 0, 0, 0, 0, 0, 0.5, 0, 0, 0])
    close(evaluate(text.allocated_gpu, texts), [0, 0, 2, 9, 0, 0, 0, 0, 0, 0, 0])
    flags = [False, True, True, True, False, False, False, False, False, True, False]
    assert evaluate(text.is_gpu_job, texts) == flags
    kinds = evaluate(lambda c: text.job_type(text.is_gpu_job(c)), texts)
    assert kinds == ["GPU" if f else "CPU" for f in flags]


def test_walltime(evaluate):
    texts = ["1-02:30:00", "02:00:00", "10:30", "90", "1-12", "12:", "1-2-3", "a:b", "1:2:3:4", "", None, " 5 ", "-5", "x-1"]
    close(
        evaluate(text.walltime_hours, texts),
        [26.5, 2, 10.5, 90, 36, None, None, None, None, None, None, 5, None, None],
    )


def test_script_memory(evaluate):
    texts = ["32G", "1024M", "64", "2T", "1048576K", "1G2", "5X", "G", "-5G", "32 G", "1P", None, "1.5.2G"]
    close(
        evaluate(text.script_memory_gb, texts),
        [32, 1, 64, 2048, 1, 12, None, None, None, 32, 1048576, None, None],
    )


def test_gpu_request(evaluate):
    texts = [
        "--gres=gpu:4", "--gres=gpu:V100:4", "--gres gpu:2", "--gres=gpu", "--gres=gpu:4,ssd:1",
        "--gres=ssd:1", "--gres=gpu:4:x",
    ]
    assert evaluate(text.gpu_request_count, texts) == [4, 4, 2, None, 1, None, 4]


def test_runtime_text(evaluate):
    texts = ["00:15:30", "1-12:30:00", "UNLIMITED", "", None, "10:30", "x", "1-2-3"]
    close(evaluate(text.runtime_hours_text, texts), [15.5 / 60, 36.5, 0, 0, 0, None, None, None])
    assert evaluate(text.unreadable_runtime, texts) == [False] * 5 + [True] * 3


def test_node_prefix(evaluate):
    texts = ["sh-01-01", "node001", "sh7-2", "node[001-010]", "001", "", None, "gpu[12]"]
    assert evaluate(text.node_prefix, texts) == ["sh", "node", "sh", "node[", None, None, None, "gpu"]


def test_numbers(evaluate):
    texts = ["1", " 2.5 ", "1e3", ".5", "5.", "1d", "0x1p3", "inf", "nan", "", None, "1_000"]
    close(
        evaluate(text.to_numeric, texts),
        [1, 2.5, 1000, 0.5, 5, None, None, None, None, None, None, None],
    )


def test_times(spark, evaluate):
    texts = ["2024-01-02T03:04:05", "2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00", "Unknown", "", None]
    shown = evaluate(lambda c: times.second_text(times.utc_timestamp(c)), texts)
    assert shown == ["2024-01-02 03:04:05"] * 2 + ["2024-01-02 01:04:05", None, None, None]


def test_strict_time_fails(evaluate):
    assert evaluate(times.strict_utc_timestamp, ["", None]) == [None, None]
    with pytest.raises(Exception, match="unreadable timestamp: soon"):
        evaluate(times.strict_utc_timestamp, ["2024-01-01", "soon"])


def test_job_key(spark):
    rows = [("ann", "2024-01-01 10:00:00"), ("", "2024-01-01 10:00:00"), (None, "2024-01-01"), ("bob", None)]
    df = spark.createDataFrame(rows, "u string, s string")
    keys = df.select(times.job_key(F.col("u"), times.utc_timestamp(F.col("s"))).alias("k")).collect()
    assert [r.k for r in keys] == ["ann_2024-01-01 10:00:00", None, None, None]


def test_pacific_time(evaluate):
    texts = ["2024-01-05T20:00:00Z", "2024-07-05T20:00:00Z", "soon", None]
    assert evaluate(times.pacific_time, texts) == [
        "Jan 5, 2024, 12:00:00 PM PST", "Jul 5, 2024, 1:00:00 PM PDT", "soon", None,
    ]


def test_power(spark):
    row = spark.range(1).select(
        power.power_watts(F.lit(4), F.lit(8.0)).alias("w"),
        power.energy_kwh(F.lit(42.976), F.lit(1.0)).alias("kwh"),
        power.emissions_gco2e(F.lit(0.042976), F.lit(250.0)).alias("g"),
        power.emissions_kgco2e(F.lit(10.744)).alias("kg"),
        power.forecast_notes(F.lit(0)).alias("none"),
        power.forecast_notes(F.lit(2)).alias("some"),
    ).first()
    close([row.w, row.kwh, row.g, row.kg], [42.976, 0.042976, 10.744, 0.010744])
    assert row.none == [] and len(row.some) == 1
