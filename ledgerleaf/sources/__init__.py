"""Readers. Every one takes a declared schema; none infers types."""

from ledgerleaf.sources.faults import absent_paths, is_file_fault, message, without_faulty
from ledgerleaf.sources.files import csv_headers, read_csv, read_csv_by_name, read_csv_files, read_parquet, read_table
from ledgerleaf.sources.jdbc import (
    count_by_file_sql,
    read_jdbc_query,
    read_jdbc_table,
    split_conditions,
    split_points_sql,
)
from ledgerleaf.sources.markup import hidden_spans, joined_chunks, placed_chunks, visible
from ledgerleaf.sources.names import base_name, select_settlement_files
from ledgerleaf.sources.xml import read_xml, xml_chunks, xml_records

__all__ = [
    "absent_paths",
    "base_name",
    "count_by_file_sql",
    "csv_headers",
    "hidden_spans",
    "is_file_fault",
    "joined_chunks",
    "message",
    "placed_chunks",
    "read_csv",
    "read_csv_by_name",
    "read_csv_files",
    "read_jdbc_query",
    "read_jdbc_table",
    "read_parquet",
    "read_table",
    "read_xml",
    "select_settlement_files",
    "split_conditions",
    "split_points_sql",
    "visible",
    "without_faulty",
    "xml_chunks",
    "xml_records",
]
