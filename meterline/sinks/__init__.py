from .batches import BatchFailed, read_ledger, send_batches, stage_batches, to_files
from .buckets import BucketedTable
from .files import (
    compact_day,
    flat_documents,
    insert_overwrite_directory,
    keep_latest,
    read_result,
    route_columns,
    upsert,
    write_batches,
    write_docs,
    write_result,
)

__all__ = [
    "BatchFailed", "BucketedTable", "compact_day", "flat_documents", "insert_overwrite_directory", "keep_latest", "read_ledger", "read_result",
    "route_columns", "send_batches", "stage_batches", "to_files", "upsert", "write_batches", "write_docs", "write_result",
]
