"""Record schemas (Spark DDL)."""

RAW = "id string, line string, source string, ts timestamp"
PARSED = (
    f"{RAW}, template string, template_id string, severity int, component string, variables map<string,array<string>>, "
    "embedding array<double>, cluster_id string, is_anomaly boolean, anomaly_reasons array<string>"
)
ROLLUP = (
    "template_id string, template string, count bigint, max_severity int, component string, anomaly_count bigint, "
    "first_seen timestamp, last_seen timestamp"
)
ANOMALY = "id string, template_id string, severity int, component string, reasons array<string>, ts timestamp"
ALERT = "id string, template_id string, severity int, title string, detail string, channels array<string>, ts timestamp"
CLUSTER = (
    "id string, label string, centroid array<double>, members bigint, dominant_component string, max_severity int, "
    "first_seen timestamp, last_seen timestamp, new_incident boolean, sample_template string"
)
MESSAGE = "line string, source string, ts double"
BATCH = "source string, lines array<string>"
