"""DataFrame to DataFrame operators."""

from ledgerleaf.operators.audit import daily_audit, load_log, local_moment, table_log
from ledgerleaf.operators.keyed import latest_per_key, require_unique, split_null_keys
from ledgerleaf.operators.quality import (
    CUT,
    JOINED,
    WHOLE,
    agreement,
    file_status,
    is_complete,
    preview,
    read_in_full,
    reconcile,
    reconcile_content,
    row_counts,
    row_prints,
)

__all__ = [
    "CUT",
    "JOINED",
    "WHOLE",
    "agreement",
    "daily_audit",
    "file_status",
    "is_complete",
    "latest_per_key",
    "load_log",
    "local_moment",
    "preview",
    "read_in_full",
    "reconcile",
    "reconcile_content",
    "require_unique",
    "row_counts",
    "row_prints",
    "split_null_keys",
    "table_log",
]
