"""Turn landed JSON API payloads into metric and log tables with Spark."""

from payload_metrics.operators.dedupe import (
    dedupe,
    dedupe_stats,
    drop_orphans,
    expire,
    fingerprint,
    replay,
    touches,
    trim,
    upsert,
)
from payload_metrics.operators.extract import extract, extract_selected, selected_records, typed_records
from payload_metrics.operators.filters import apply_filters, cap
from payload_metrics.operators.logs import log_records
from payload_metrics.operators.metrics import cumulative_points, latest_gauges, metric_points
from payload_metrics.operators.windows import last_success, plan_windows, spec_table
from payload_metrics.plans.pipeline import RunResult, dry_run, run
from payload_metrics.plans.upkeep import clean_up
from payload_metrics.sources.outputs import FingerprintLog, PointLog
from payload_metrics.sources.payloads import (
    read_payload_files,
    read_payload_table,
    stream_payload_files,
    stream_payload_table,
)
from payload_metrics.sources.tables import prepare_session
from payload_metrics.spec import SourceSpec, SpecError, load_specs

__all__ = [
    "FingerprintLog",
    "PointLog",
    "RunResult",
    "SourceSpec",
    "SpecError",
    "apply_filters",
    "cap",
    "clean_up",
    "cumulative_points",
    "dedupe",
    "dedupe_stats",
    "drop_orphans",
    "dry_run",
    "expire",
    "extract",
    "extract_selected",
    "fingerprint",
    "last_success",
    "latest_gauges",
    "load_specs",
    "log_records",
    "metric_points",
    "plan_windows",
    "prepare_session",
    "read_payload_files",
    "read_payload_table",
    "replay",
    "run",
    "selected_records",
    "spec_table",
    "stream_payload_files",
    "stream_payload_table",
    "touches",
    "trim",
    "typed_records",
    "upsert",
]
