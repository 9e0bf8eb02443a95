"""Sources and sinks."""

from duotext.sources.artifacts import (
    materialize_if_absent,
    read_artifact,
    read_recipe,
    write_artifact,
    write_recipe,
)
from duotext.sources.csv_records import read_records
from duotext.sources.readers import read_annotated_csv, read_csv_splits, read_jsonl, read_tiered
from duotext.sources.versions import materialize

__all__ = [
    "materialize", "materialize_if_absent", "read_annotated_csv", "read_artifact", "read_csv_splits", "read_jsonl",
    "read_recipe", "read_records", "read_tiered",
    "write_artifact", "write_recipe",
]
