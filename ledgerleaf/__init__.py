"""Batch jobs for retail-banking data: bronze files to silver tables to a gold star schema."""
