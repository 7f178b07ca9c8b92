"""Dates and durations; now is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def lifecycle_status(eol: Column, support: Column, today: Column, soon: int = 365, ended: Column | None = None) -> Column:
    """(status, security_only): ended, ending or supported. The last day itself is supported; ended flags an end without a date."""
    over = F.coalesce(F.lit(False) if ended is None else ended, F.lit(False)) | F.coalesce(eol < today, F.lit(False))
    status = F.when(over, "ended").when(eol <= F.date_add(today, soon), "ending").otherwise("supported")
    return F.struct(status.alias("status"), (~over & F.coalesce(support < today, F.lit(False))).alias("security_only"))


def backoff(now: Column, attempts: Column, most: int = 3600) -> Column:
    """When to try again: 2^attempts seconds on, most at most."""
    return now + F.make_dt_interval(secs=F.least(F.lit(most).cast("double"), F.pow(F.lit(2.0), attempts)).cast("decimal(18,6)"))


def backoff_seconds(attempts: int, most: int = 3600) -> float:
    """As backoff(), for keyed state."""
    return float(min(most, 2**attempts))


def lease_state(state: Column, lease_until: Column, attempts: Column, now: Column) -> Column:
    """queued, retrying, running, stalled, or the final state."""
    return F.when((state == "leased") & (lease_until < now), "stalled").when(state == "leased", "running").when((state == "queued") & (attempts > 0), "retrying").otherwise(state)


def readable(created: Column, now: Column, days: int) -> Column:
    """Whether a cached row may still be read; the exact complement of expired()."""
    return created > now - F.make_dt_interval(days=F.lit(days))


def expired(created: Column, now: Column, days: int) -> Column:
    return created <= now - F.make_dt_interval(days=F.lit(days))


def upgrade_target(releases: Column) -> Column:
    """Of releases (version, lts, released) the newest with long support, else the newest."""
    newest = F.reverse(F.array_sort(F.transform(releases, lambda r: F.struct(r["released"], r["version"], r["lts"]))))
    return F.coalesce(F.get(F.filter(newest, lambda r: r["lts"]), F.lit(0)), F.get(newest, F.lit(0)))["version"]
