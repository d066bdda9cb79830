"""Safe conversions, digests, identifiers and times as column expressions; nulls and bad values have a defined result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(text: Column, default: int = 0) -> Column:
    """Whole numbers with blanks about them; all else, fractions and nulls too, is the default."""
    t = F.trim(text.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")), F.lit(default).cast("long"))


def to_float(text: Column, default: float = 0.0) -> Column:
    t = F.trim(text.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")), F.lit(default))


def to_bool(text: Column) -> Column:
    """true, 1, yes and on in either case are true; all else is false, null too."""
    return F.coalesce(F.lower(text.cast("string")).isin("true", "1", "yes", "on"), F.lit(False))


def to_list(text: Column, sep: str = ",") -> Column:
    """The parts of a text; null and the empty text have none."""
    parts = F.split(text, "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in sep), -1)
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))


def from_list(items: Column, sep: str = ",") -> Column:
    return F.array_join(items, sep)


def to_base64(data: Column) -> Column:
    return F.base64(data.cast("binary"))


def from_base64(text: Column) -> Column:
    """The bytes as text; null if they are no base64."""
    return F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8")


def fixed(number: Column, digits: int = 2) -> Column:
    """With so many digits; halves go to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(number.cast("double"), digits))


def to_json(row: Column) -> Column:
    return F.to_json(row)


def from_json(text: Column, schema: str) -> Column:
    """Null for what is no JSON."""
    return F.from_json(text, schema)


def digest(data: Column, algorithm: str = "sha256") -> Column:
    raw = data.cast("binary")
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha512": lambda x: F.sha2(x, 512)}[algorithm](raw)


def has_digest(data: Column, value: Column, algorithm: str = "sha256") -> Column:
    return digest(data, algorithm) == F.lower(value)


def _short(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 16)


def file_vid(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("code_file_"), _short(repository, path))


def symbol_vid(repository: Column, name: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("code_symbol_"), _short(repository, name, path, line))


def entity_vid(number: Column) -> Column:
    return F.concat(F.lit("entity_"), number.cast("string"))


def vid_entity(vid: Column) -> Column:
    """The number of ``entity_<number>``; null for any other text."""
    return F.when(vid.rlike(r"^entity_\d+$"), F.substring(vid, 8, 20).try_cast("long"))


def format_time(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.coalesce(F.date_format(ts, pattern), F.lit(""))


def parse_time(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Null for what doesn't match."""
    return F.try_to_timestamp(text, F.lit(pattern))


def shifted(ts: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def expired(ts: Column, hours: int, now: datetime | Column) -> Column:
    """Whether more than so many hours have passed; never for null."""
    now = now if isinstance(now, Column) else F.lit(now)
    return F.coalesce(now.cast("timestamp") > shifted(ts, hours=hours).cast("timestamp"), F.lit(False))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def scaled_box(box: list[Column], width: Column, height: Column) -> list[Column]:
    """A box (x, y, width, height) in shares of the page; boxes that already are stay, without a page all is 0."""
    is_share = F.greatest(box[0] + box[2], box[1] + box[3], box[2], box[3]) <= 1.0
    known = (width > 0) & (height > 0)
    return [F.when(is_share, b).when(known, b / by).otherwise(0.0) for b, by in zip(box, (width, height, width, height))]
