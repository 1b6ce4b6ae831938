"""Column layouts shared by the operators."""

RAW_LINES = "source STRING, line_number BIGINT, line STRING"

EVENT_COLUMNS = (
    "source", "line_number", "ts", "raw_payload", "actor", "source_ip", "region", "event_name", "event_source",
)
EVENTS = (
    "source STRING, line_number BIGINT, ts TIMESTAMP_NTZ, raw_payload STRING, actor STRING, source_ip STRING, "
    "region STRING, event_name STRING, event_source STRING"
)
GAP_COLUMNS = (
    "source", "start_time", "end_time", "duration_us", "duration_seconds", "severity", "start_line", "end_line",
)
ALERT_COLUMNS = (
    "source", "line_number", "kind_rank", "kind", "ts", "actor", "event_name", "prev_ip", "source_ip", "delta_hours",
    "message",
)
