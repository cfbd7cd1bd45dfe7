"""Files that cannot be read, told from all other failures by what Spark reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TypeVar
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession

Result = TypeVar("Result")

# Error conditions that blame a file.
_UNREADABLE = ("FAILED_READ_FILE", "CANNOT_LOAD_", "FILE_NOT_EXIST")
_ABSENT = "PATH_NOT_FOUND"


def _reported(problem: Exception) -> Iterator[tuple[str, dict[str, str]]]:
    """Condition and parameters of the error and of its causes."""
    if isinstance(problem, PySparkException):
        yield problem.getCondition() or "", problem.getMessageParameters() or {}
    cause, seen = getattr(problem, "java_exception", None), 0
    while cause is not None and seen < 20:
        try:
            yield cause.getCondition() or "", dict(cause.getMessageParameters() or {})
        except Py4JError:
            # Not an error of Spark's own; its cause may be one.
            pass
        cause, seen = cause.getCause(), seen + 1


def _plain_path(path: str) -> str:
    """A path without its scheme, in which a URL's escapes are read."""
    parts = urlsplit(path)
    return unquote(f"{parts.netloc}{parts.path}") if parts.scheme else path


def is_file_fault(problem: Exception) -> bool:
    """Whether a file could not be read; a failure of a target or of the code is none."""
    return any(condition.startswith((*_UNREADABLE, _ABSENT)) for condition, _ in _reported(problem))


def faulty_paths(problem: Exception, paths: Sequence[str]) -> list[str]:
    """Those of the paths that the error blames; a path may be a folder of files."""
    blamed = set()
    for condition, parameters in _reported(problem):
        if condition.startswith((*_UNREADABLE, _ABSENT)):
            blamed |= {_plain_path(parameters[key]) for key in ("path", "fileName") if key in parameters}
    found = []
    for path in paths:
        own = _plain_path(path).rstrip("/")
        if any(name == own or name.startswith(f"{own}/") for name in blamed):
            found.append(path)
    return found


def absent_paths(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Paths that do not exist, with the error; each is looked up, none is read."""
    found = {}
    for path in paths:
        try:
            spark.read.text(path)
        except AnalysisException as problem:
            if problem.getCondition() != _ABSENT:
                raise
            found[path] = str(problem)
    return found


def message(problem: Exception) -> str:
    """The error's text without the calls that led to it."""
    return str(problem).split("\n\tat ", 1)[0]


def without_faulty(
    paths: Sequence[str], work: Callable[[list[str]], Result]
) -> tuple[Result | None, dict[str, str]]:
    """``work`` on the paths, and again without those that an error of it blames.

    Returns its result, None if no path is left, and the error of each path left out. An error
    that blames none of the paths is raised at once.
    """
    left, faults = list(paths), {}
    while left:
        try:
            return work(left), faults
        except Exception as problem:
            bad = faulty_paths(problem, left)
            if not bad:
                raise
            faults |= dict.fromkeys(bad, message(problem))
            left = [path for path in left if path not in faults]
    return None, faults
