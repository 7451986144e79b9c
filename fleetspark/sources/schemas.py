"""Schemas of the datasets, as DDL."""

SENSOR = "container_id long, timestamp_et timestamp_ntz, unit long, TmpRet double"
GENERATED = "timestamp_et timestamp_ntz, unit long, TmpRet double, anomaly boolean, anomaly_type string, container_id long"
PAIR_DISTANCE = "container_id long, timestamp_et timestamp_ntz, pair string, distance double"
CYCLES = "container_id long, cycle_idx int, cycle_start int, cycle_end int, peak_intensity double, baseline_offset double"
ANOMALIES = "container_id long, seq int, unit long, type string, start_day int, start_hour int, duration_hours int, lag_minutes int, scale_factor double, frequency_multiplier double"
LABELS = "system_id string, label int, failure_type string, source string, label_version string, lead_time_days int, confidence double, notes string"
METADATA = "system_id string, source string, operational_mode string, season string"
