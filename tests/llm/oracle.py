"""A query of the training-data operators beside its SQL."""

from ledgerleaf.llm.queries import QUERIES
from tests.compare import oracle_rows, spark_rows


def oracle_difference(spark, sf_dir, name):
    """None where both sides agree, else what differs."""
    query = QUERIES[name]
    df = query.run(spark, sf_dir)
    names, expected = oracle_rows(sf_dir, query.oracle)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    found = spark_rows(df)
    if found == expected:
        return None
    return f"only here {list(found - expected)[:3]}, only in SQL {list(expected - found)[:3]}"
