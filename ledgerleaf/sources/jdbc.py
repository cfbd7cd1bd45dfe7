"""JDBC tables and remote queries.

Connection values come in ``properties`` (user, password, driver) and are never
printed or stored.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, Row, SparkSession


def read_jdbc_query(
    spark: SparkSession, url: str, query: str, properties: dict[str, str]
) -> DataFrame:
    """A query that the database runs, such as a count: only its result travels."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    return reader.options(**properties).load()


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    split_column: str | None = None,
    partitions: int = 32,
    conditions: list[str] | None = None,
    tie_column: str | None = None,
    deal: str | None = None,
) -> DataFrame:
    """A table; with ``split_column`` (number, date or timestamp) in parallel ranges.

    The ranges span the column's minimum and maximum, which the database computes.
    Rows where it is null fall into the first range, so none are lost. For a column
    whose values crowd in one range, a ``tie_column`` whose values are unique, such as the
    primary key, gives parts of equal numbers of rows instead, whatever the split column
    repeats; a tie that is not a whole number needs ``deal`` (see ``split_points_sql``).
    ``conditions`` gives the parts as SQL conditions; every row must meet exactly one.
    """
    if split_column and tie_column:
        points_sql = split_points_sql(table, split_column, tie_column, partitions, deal)
        points = read_jdbc_query(spark, url, points_sql, properties).collect()
        conditions = split_conditions(points, split_column, tie_column)
    if conditions:
        return spark.read.jdbc(url, table, predicates=conditions, properties=properties)
    if split_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    bounds_sql = f"select min({split_column}) as lo, max({split_column}) as hi from {table}"
    low, high = read_jdbc_query(spark, url, bounds_sql, properties).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url,
        table,
        column=split_column,
        lowerBound=str(low),
        upperBound=str(high),
        numPartitions=partitions,
        properties=properties,
    )


# Rows are dealt into so many groups, and of each group's order every so many-th row is a pivot.
_GROUPS = 256
_EVERY = 512


def _in_order(key: str, tie: str) -> str:
    return f"CASE WHEN {key} IS NULL THEN 0 ELSE 1 END, {key}, {tie}"


def _not_after(key: str, tie: str, low_key: str, low_tie: str) -> str:
    """1 where a row stands at another one or before it, else 0."""
    return (
        f"CASE WHEN ({key} IS NULL AND ({low_key} IS NOT NULL OR {tie} <= {low_tie})) "
        f"OR {key} < {low_key} OR ({key} = {low_key} AND {tie} <= {low_tie}) THEN 1 ELSE 0 END"
    )


def _pivots_sql(table: str, column: str, tie: str, deal: str, every: int) -> str:
    """Every ``every``-th row of each group in its order, as K and T, with its place C among all of these."""
    numbered = (
        f"SELECT {column} AS K, {tie} AS T, ROW_NUMBER() OVER (PARTITION BY {deal} "
        f"ORDER BY {_in_order(column, tie)}) AS I FROM {table}"
    )
    return (
        f"SELECT K, T, ROW_NUMBER() OVER (ORDER BY {_in_order('K', 'T')}) AS C "
        f"FROM ({numbered}) D WHERE MOD(I, {every}) = 0"
    )


def split_points_sql(
    table: str, column: str, tie: str, parts: int, deal: str | None = None, every: int = _EVERY
) -> str:
    """The first row of each of ``parts`` parts of equal size, as SQL text that a database runs.

    Rows are in the order of the column, null first, and then of ``tie``; parts are those of
    ``NTILE``, without a sort of the whole table in one place. Rows are dealt into groups by
    ``deal``, an expression that is not null; the tie's remainder by default, which has to be a
    whole number then. Each group is put in order for itself. Its every ``every``-th row is a
    pivot, and a pivot's place in the table is known from that among the pivots up to ``every``
    rows a group. So two pivots enclose each point closely; the rows up to the first one are
    counted, and those between are put in order.
    """
    deal = deal or f"MOD({tie}, {_GROUPS})"
    place = (
        f"(J - 1) * FLOOR((N - MOD(N, {parts})) / {parts}) "
        f"+ CASE WHEN J - 1 < MOD(N, {parts}) THEN J - 1 ELSE MOD(N, {parts}) END + 1"
    )
    numbers = " UNION ALL ".join(f"SELECT {number} AS J" for number in range(1, parts + 1))
    sizes = f"SELECT COUNT(*) AS N, COUNT(DISTINCT {deal}) AS G FROM {table}"
    goals = f"SELECT J, G, {place} AS R FROM ({numbers}) U CROSS JOIN ({sizes}) A WHERE J <= N"
    # The pivot in place C is the table's row C * every at least, and (every - 1) * G rows later at most.
    ranges = (
        f"SELECT J, R, FLOOR((R - 1 - {every - 1} * G) / {every}) AS LO, "
        f"FLOOR((R + {every - 1}) / {every}) AS HI FROM ({goals}) V"
    )
    bounds = (
        "SELECT W.J, W.R, L.K AS LK, L.T AS LT, H.K AS HK, H.T AS HT FROM "
        f"({ranges}) W LEFT JOIN PIVOTS L ON L.C = W.LO LEFT JOIN PIVOTS H ON H.C = W.HI"
    )
    low = _not_after("S.K", "S.T", "B.LK", "B.LT")
    high = _not_after("S.K", "S.T", "B.HK", "B.HT")
    rows = f"(SELECT {column} AS K, {tie} AS T FROM {table}) S CROSS JOIN BOUNDS B"
    ahead = f"SELECT B.J, SUM(CASE WHEN B.LT IS NULL THEN 0 ELSE {low} END) AS N FROM {rows} GROUP BY B.J"
    between = (
        f"SELECT B.J, B.R, S.K, S.T, ROW_NUMBER() OVER (PARTITION BY B.J ORDER BY {_in_order('S.K', 'S.T')}) AS I "
        f"FROM {rows} WHERE (B.LT IS NULL OR {low} = 0) AND (B.HT IS NULL OR {high} = 1)"
    )
    return (
        f"WITH PIVOTS AS ({_pivots_sql(table, column, tie, deal, every)}), BOUNDS AS ({bounds}) "
        f"SELECT M.J AS N, M.K, M.T FROM ({between}) M JOIN ({ahead}) E ON E.J = M.J WHERE M.I = M.R - E.N"
    )


def _literal(value: object) -> str:
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def split_conditions(points: Sequence[Row], column: str, tie: str) -> list[str]:
    """SQL conditions of the parts that begin at the points; a row meets exactly one."""
    points = sorted(points, key=lambda row: row[0])

    def reached(key: object, low: object) -> str:
        if key is None:
            return f"({column} IS NOT NULL OR {tie} >= {_literal(low)})"
        key = _literal(key)
        return f"({column} > {key} OR ({column} = {key} AND {tie} >= {_literal(low)}))"

    def ahead(key: object, low: object) -> str:
        if key is None:
            return f"({column} IS NULL AND {tie} < {_literal(low)})"
        key = _literal(key)
        return f"({column} IS NULL OR {column} < {key} OR ({column} = {key} AND {tie} < {_literal(low)}))"

    conditions = []
    for number, (_, key, low) in enumerate(points):
        parts = [reached(key, low)] if number else []
        parts += [ahead(*points[number + 1][1:])] if number + 1 < len(points) else []
        conditions.append(" AND ".join(parts) or "1 = 1")
    return conditions


def count_by_file_sql(table: str, file_dates: list[str] = ()) -> str:
    """Row counts per file as SQL text that any database runs."""
    where = ""
    if file_dates:
        dates = ", ".join(f"DATE '{day}'" for day in file_dates)
        where = f" WHERE FILE_DATE IN ({dates})"
    return (
        "SELECT FILE_NAME, FILE_DATE, COUNT(1) AS ROW_CNT "
        f"FROM {table}{where} GROUP BY FILE_NAME, FILE_DATE"
    )
