"""Patterns written for ECMAScript as patterns for Spark (Java)."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_GROUP = re.compile(r"\(\?<([A-Za-z_$][\w$]*)>")


def java_pattern(pattern: str) -> tuple[str, dict[str, str]]:
    """The pattern and its groups' new names: Java takes letters and digits only, and its ``$`` also matches before a last line feed."""
    names: dict[str, str] = {}
    for name in _GROUP.findall(pattern):
        plain = re.sub("[^A-Za-z0-9]", "", name) or "g"
        while plain in names.values() or plain[0].isdigit():
            plain = f"g{len(names)}{plain}"
        names[name] = plain
    pattern = _GROUP.sub(lambda m: f"(?<{names[m[1]]}>", pattern)
    pattern = re.sub(r"\\k<([^>]+)>", lambda m: rf"\k<{names.get(m[1], m[1])}>", pattern)
    return _ends_at_the_end(pattern), names


_TOKEN = re.compile(r"\\Q.*?(?:\\E|\Z)|\\.|[\[\]$]|[^\\\[\]$]+", re.DOTALL)


def _ends_at_the_end(pattern: str) -> str:
    """Every ``$`` outside of classes as ``\\z``; a pattern that asks for line mode keeps them."""
    if re.search(r"\(\?[a-z]*m", pattern):
        return pattern
    out, depth = [], 0
    for part in _TOKEN.findall(pattern):
        depth += (part == "[") - (part == "]" and depth > 0)
        out.append(r"\z" if part == "$" and not depth else part)
    return "".join(out)


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def search_pattern(text: str, case_sensitive: bool) -> str:
    pattern, _ = java_pattern(text)
    return pattern if case_sensitive else "(?iu)" + pattern


def is_valid(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark takes the pattern."""
    try:
        spark.range(1).select(F.rlike(F.lit(""), F.lit(pattern))).collect()
    except PySparkException:
        return False
    return True
