"""Writers. Output keeps the partitions of its input: nothing is forced into one task."""

from ledgerleaf.sinks.files import write_csv, write_parquet, write_partitions
from ledgerleaf.sinks.jdbc import append_jdbc
from ledgerleaf.sinks.table import append_table, drop_partitions, replace_table_partitions

__all__ = [
    "append_jdbc",
    "append_table",
    "drop_partitions",
    "replace_table_partitions",
    "write_csv",
    "write_parquet",
    "write_partitions",
]
