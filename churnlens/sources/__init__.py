"""Sources and sinks."""

from churnlens.sources.sinks import export_results, read_export, write_report  # noqa: F401
from churnlens.sources.subscribers import (  # noqa: F401
    csv_quarantine,
    csv_rows,
    dataset_profile,
    read_subscribers_csv,
    split_subscribers_csv,
    subscriber_view,
)
