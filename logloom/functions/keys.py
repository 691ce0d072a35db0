"""Keys of parts and sessions: composition, parsing, slugs, and the predicates that guard them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_relpath(p: Column) -> Column:
    """Relative, no empty, dot-leading or parent steps, no control characters. Null is not safe."""
    steps = F.split(p, "/")
    return F.coalesce((F.length(p) > 0) & F.forall(steps, lambda s: (s != "") & ~s.startswith(".")) & ~p.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def under_root(root: str, path: Column) -> Column:
    """Whether an absolute path lies strictly below ``root``, judged by its letters: no parent steps, no links resolved."""
    return F.coalesce(path.startswith(root.rstrip("/") + "/") & ~F.exists(F.split(path, "/"), lambda s: s == "..") & (F.length(path) > len(root.rstrip("/")) + 1), F.lit(False))


def safe_device(d: Column, forbidden: str = "/") -> Column:
    return F.coalesce((F.length(d) > 0) & ~d.rlike(f"[{forbidden}]") & ~d.startswith("."), F.lit(False))


def part_key(device: Column, relpath: Column) -> Column:
    """Device and path joined by a slash; null if either is not safe."""
    return F.when(safe_device(device) & safe_relpath(relpath), F.concat_ws("/", device, relpath))


def session_key(device: Column, day: Column, overflow: Column) -> Column:
    """device:YYYYMMDD, with #n from the second on; null if the device can't be part of a key or overflow is below 1."""
    tail = F.when(overflow == 1, F.lit("")).otherwise(F.concat(F.lit("#"), overflow.cast("string")))
    return F.when(safe_device(device, "/:") & (overflow >= 1), F.concat(device, F.lit(":"), F.date_format(day, "yyyyMMdd"), tail))


def day_of(instant: Column, zone: str) -> Column:
    """The calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def session_parts(key: Column) -> Column:
    """Struct of device, day and overflow, split at the last colon; null where the key is not one (#1 is not)."""
    device = F.regexp_extract(key, r"^(.*):([^:]*)$", 1)
    tail = F.regexp_extract(key, r"^(.*):([^:]*)$", 2)
    day = F.try_to_timestamp(F.regexp_extract(tail, r"^([0-9]{8})(?:#[0-9]+)?$", 1), F.lit("yyyyMMdd")).cast("date")
    n = F.when(tail.contains("#"), F.regexp_extract(tail, "#([0-9]+)$", 1).try_cast("int")).otherwise(F.lit(1))
    good = key.contains(":") & day.isNotNull() & n.isNotNull() & ((n >= 2) | ~tail.contains("#"))
    return F.when(good, F.struct(device.alias("device_id"), day.alias("day"), n.alias("overflow")))


def device_of_part(key: Column) -> Column:
    return F.when(key.contains("/"), F.substring_index(key, "/", 1))


def relpath_of_part(key: Column) -> Column:
    return F.when(key.contains("/"), F.regexp_extract(key, "(?s)^[^/]*/(.*)$", 1))


def slug(key: Column) -> Column:
    """First sixteen hex digits of the key's SHA-256."""
    return F.substring(F.sha2(key, 256), 1, 16)
