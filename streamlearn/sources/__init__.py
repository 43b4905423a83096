"""Scans, sinks and the driver-table fixtures."""

from streamlearn.sources.tables import (
    read_table, read_datasets, canonical_datasets, csv_to_parquet, write_results,
    profile, missing_datasets, union_streams,
)
from streamlearn.sources import fixtures

__all__ = [
    "read_table", "read_datasets", "canonical_datasets", "csv_to_parquet",
    "write_results", "profile", "missing_datasets", "union_streams", "fixtures",
]
