"""Fixed values of the data model, kept together so that results stay comparable."""

from __future__ import annotations

# Linear power model, watts.
WATTS_PER_CORE = 10.0
WATTS_PER_GB = 0.372

# Grid zone of a node-name prefix, and the zone of every other node.
ZONE_BY_PREFIX = {
    "sh": "US-CAL-CISO",
    "node": "US-CAL-CISO",
    "compute": "US-CAL-CISO",
}
DEFAULT_ZONE = "US-CAL-CISO"

# Intensity (g CO2e per kWh) of a zone without readings, and of every other zone.
FALLBACK_INTENSITY = {
    "US-CAL-CISO": 250.0,
    "US-NY-ISONE": 200.0,
    "US-TX-ERCOT": 400.0,
    "US-PJM": 350.0,
}
DEFAULT_INTENSITY = 300.0

# Fixed value: remark attached to forecasts of jobs that ask for GPUs.
GPU_NOTE = "GPU power is not included in the current power model."

# Model inputs in their order, the text ones among them, and the leaking column.
FEATURE_COLUMNS = (
    "alloc_cpu", "alloc_mem_gb", "alloc_gpu", "NCPUS", "req_mem_gb", "is_gpu_job", "job_type",
    "requested_walltime_hours", "queue_wait_time_hours", "hour_of_day", "day_of_week",
    "User", "Account", "State",
)
CATEGORICAL_COLUMNS = ("User", "Account", "State", "job_type")
LEAK_COLUMN = "ConsumedEnergyRaw"
TARGET_COLUMN = "energy_kWh"

# Sampling and cross-validation defaults.
MAX_SAMPLES = 50_000
FOLDS = 5
SEED = 42

# Outcome classes looked for in state names, in report order.
OUTCOMES = ("COMPLETED", "FAILED", "TIMEOUT", "OUT_OF_MEMORY", "NODE_FAIL")

# Daily trend rules.
ROLLING_ROWS = 7
PEAK_PERCENTILE = 0.95
ANOMALY_MAD_FACTOR = 2.5
ANOMALY_MAD_FLOOR = 1e-9
ANOMALY_VOLUME_FACTOR = 1.15

# Fixed value: one-sided 95 % normal quantile used by the rough runtime estimate.
NORMAL_P95 = 1.645

# Cell texts that mean "missing" in the exported files.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
