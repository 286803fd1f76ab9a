"""Scalar expressions on log attributes, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweft.plans.config import LEVELS


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def level_of(value: Column) -> Column:
    return F.when(F.upper(value).isin(*LEVELS), F.upper(value)).otherwise("UNKNOWN")


def timestamp_text(value: Column) -> Column:
    """The first comma as a point, the first space as T."""
    return F.regexp_replace(F.regexp_replace(value, "^([^,]*),", "$1."), "^([^ ]*) ", "$1T")


def event_time(value: Column) -> Column:
    """Time without a zone; null if there is no such time."""
    return F.to_timestamp_ntz(F.when(F.try_to_timestamp(value).isNotNull(), value))


def event_id(source_id: Column, file_path: Column, generation: Column, line_no: Column) -> Column:
    """The same for the same line of the same file, in batch, in a stream and after a retry."""
    return F.sha2(F.concat_ws("|", source_id, file_path, generation.cast("string"), line_no.cast("string")), 256)


def plain_path(uri: Column) -> Column:
    """A path from the encoded URI of a file; other schemes than file keep theirs."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def label(name: Column) -> Column:
    """A column's title: words split at capitals, underscores and hyphens, each with a capital first; id is ID."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.lower(w) == "id", "ID").otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))), " ")
