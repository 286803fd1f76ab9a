"""What a job is given: selections, parser configurations and filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from logweft.functions.regex import java_pattern

# The data model's levels, kinds of files, tiers and the default pattern of a line.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
FILE_KINDS = ("serveur", "fwk", "ui")
TIERS = ("back", "front")
DEFAULT_PATTERN = r"^(?<timestamp>\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[,.]\d{3})?)\s+(?<level>TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+(?:\[(?<thread>[^\]]+)\]\s+)?(?:(?<logger>[\w.$-]+)\s+-\s+)?(?<message>.*)$"  # noqa: E501
DEFAULT_PAGE, OLDER_PAGE, LARGEST_PAGE = 50, 200, 1000

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Selection:
    environment: str
    country: str
    tier: str
    project: str
    date: str

    @property
    def name(self) -> str:
        return self.project.strip()

    @property
    def valid(self) -> bool:
        """A project and a date of the right shape; anything else selects nothing."""
        return bool(self.name) and _DATE.fullmatch(self.date) is not None


@dataclass(frozen=True)
class ParserConfig:
    """A line pattern and, by attribute, the name of the group that captures it; with ``sources``, for the lines of these alone."""

    pattern: str = DEFAULT_PATTERN
    groups: dict[str, str] = field(default_factory=lambda: {x: x for x in ("timestamp", "level", "thread", "logger", "message")})
    sources: tuple[str, ...] = ()

    @property
    def extra_fields(self) -> list[str]:
        return [f for f in self.groups if f not in ("timestamp", "level", "message")]

    def java(self) -> tuple[str, dict[str, str]]:
        """The pattern for Spark, and by attribute the group's name in it (attributes without a group are left out)."""
        pattern, names = java_pattern(self.pattern)
        wanted = {a: self.groups.get(a, a) for a in ("timestamp", "level", "message", *self.groups)}
        return pattern, {a: names[g] for a, g in wanted.items() if g in names}

    @classmethod
    def from_json(cls, data: dict) -> ParserConfig:
        return cls(data["linePattern"], dict(data["groups"]), tuple(data.get("sources", ())))


@dataclass(frozen=True)
class LogFilter:
    levels: tuple[str, ...] = ()
    text: str = ""
    regex: bool = False
    case_sensitive: bool = False

    def merged(self, **changes) -> LogFilter:
        """With the changes; levels that aren't given are reset, other settings stay."""
        return replace(self, **{"levels": (), **changes, **({"levels": tuple(changes["levels"] or ())} if "levels" in changes else {})})


def toggled(levels: tuple[str, ...], level: str) -> tuple[str, ...]:
    return tuple(x for x in levels if x != level) if level in levels else (*levels, level)


def page_size(limit: float | None) -> int:
    return max(1, min(LARGEST_PAGE, int(DEFAULT_PAGE if limit is None else limit)))


def until_input(value: str) -> str | None:
    """A typed time, to the minute or second, as a timestamp with milliseconds."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?", value):
        return None
    return value + (":00.000" if len(value) == 16 else ".000")
