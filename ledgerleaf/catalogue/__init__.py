"""Queries over the given tables, each with its check."""

from ledgerleaf.catalogue import expressions, files, star

QUERIES = {**expressions.QUERIES, **star.QUERIES, **files.QUERIES}
