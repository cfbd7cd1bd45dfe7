"""Selection of settlement files from the list a job is given.

The list is the job's argument, so it is on the driver already.
"""

from __future__ import annotations

from collections.abc import Callable

from ledgerleaf.schemas import SETTLEMENT_PREFIX, SETTLEMENT_SUFFIX


def base_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def select_settlement_files(
    paths: str | list[str], name_of: Callable[[str], str] = base_name
) -> list[str]:
    """Paths whose file name has the prefix (any case) and the suffix (lower case).

    Takes a list or one comma-separated text. A path given twice is kept once.
    """
    if isinstance(paths, str):
        paths = paths.split(",")
    chosen = [
        path
        for path in paths
        if name_of(path).upper().startswith(SETTLEMENT_PREFIX)
        and name_of(path).endswith(SETTLEMENT_SUFFIX)
    ]
    return list(dict.fromkeys(chosen))
