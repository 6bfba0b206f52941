"""Conditions on file paths."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories a scan should not be pointed at.
SENSITIVE_ROOTS = ("/etc", "/boot", "/sys", "/proc", "/dev")
MAX_NAME_LENGTH = 255


def depth(path: Column) -> Column:
    """Directories between the root and the file; files in the root have depth 0."""
    return F.size(F.split(path, "/")) - 1


def is_skipped(path: Column, fragments: tuple[str, ...]) -> Column:
    """The path, seen from its root, holds one of the fragments."""
    if not fragments:
        return F.lit(False)
    rooted = F.concat(F.lit("/"), path)
    return functools.reduce(operator.or_, [rooted.contains(f) for f in fragments])


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def policy_flags(path: Column) -> dict[str, Column]:
    """What is wrong with a path, one condition per rule."""
    name = file_name(path)
    under_root = [(path == root) | path.startswith(root + "/") for root in SENSITIVE_ROOTS]
    return {
        "is_absolute": path.startswith("/"),
        "has_traversal": F.concat(F.lit("/"), path, F.lit("/")).contains("/../"),
        "is_sensitive": functools.reduce(operator.or_, under_root),
        "has_odd_name": ~name.rlike("^[a-zA-Z0-9_.-]+$"),
        "has_long_name": F.length(name) > MAX_NAME_LENGTH,
        "has_shell_syntax": path.rlike(r"[;`]|&&|\$\("),
    }
