"""Names, identifiers and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def creature_id(run_id: Column, seed: Column) -> Column:
    return F.concat_ws("-", run_id.cast("string"), seed.cast("string"))


def safe_name(name: Column) -> Column:
    """A name that can be a file name: other characters become underscores."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def run_of(creature: Column) -> Column:
    """Everything before the last hyphen of a creature id."""
    return F.regexp_replace(creature, "-[^-]*$", "")


def frame_path(folder: Column, number: Column, width: int = 5) -> Column:
    return F.concat(folder, F.lit("/"), F.lpad(number.cast("string"), width, "0"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def number_or_null(value: Column, kind: str = "double") -> Column:
    """A number; null for placeholders such as [N/A]."""
    return F.trim(value).try_cast(kind)


def finite_or_null(value: Column) -> Column:
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def data_url(raw: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(raw))


def cluster_address(address: str | None, port: int = 6379) -> str | None:
    """host -> host:port; an address with a scheme or a port stays."""
    if not address or "://" in address or address == "auto":
        return address
    return address if ":" in address else f"{address}:{port}"


def unit(*parts: Column) -> Column:
    """A number in [0, 1) drawn by an MD5 of the parts: the same in every engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
