"""Column functions shared by all models."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which referrers and campaign names mean what, tested in this order.
REFERRERS = (("facebook", "meta"), ("instagram", "meta"), ("google", "google"), ("youtube", "google"), ("tiktok", "tiktok"))
FUNNEL = (
    ("prospecting", "prospecting"), ("retargeting", "retargeting"), ("dpa", "catalogue"), ("brand", "brand"),
    ("non-brand", "non_brand"), ("shopping", "shopping"), ("pmax", "pmax"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimal(c: Column | str, precision: int = 12, scale: int = 2) -> Column:
    """A double as DECIMAL, rounded on the scaled double (half away from zero); decimals are cast exactly."""
    c = col(c).cast("double")
    return (F.round(c * 10**scale, 0) / 10**scale).cast(f"decimal({precision},{scale})")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double; null where b is null or zero."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def micros_to_money(c: Column | str) -> Column:
    """Millionths of a unit as money: whole cents, half away from zero."""
    return (col(c) / 1000000.0).cast("decimal(12,2)")


def cents(c: Column | str) -> Column:
    """Money of two decimals as a bigint of cents: 8 bytes in sums and exchanges, where the sum of a decimal(12,2) takes 24."""
    return (col(c) * 100).cast("long")


def of_cents(c: Column | str) -> Column:
    """Sums of cents as the sum of decimal(12,2) is typed."""
    return (col(c).cast("decimal(19,0)") / 100).cast("decimal(22,2)")


def visible(available: Column | str, event: Column | str, as_of) -> Column:
    """Availability filter: the sync day, or the event day where there is none, is not after the cursor."""
    return F.coalesce(col(available).try_cast("timestamp_ntz"), col(event).cast("timestamp_ntz")).cast("date") <= F.lit(as_of)


def channel(referrer: Column | str) -> Column:
    found, text = F.lit("unattributed"), F.lower(F.coalesce(col(referrer), F.lit("")))
    for part, name in reversed(REFERRERS):
        found = F.when(text.contains(part), name).otherwise(found)
    return found


def funnel_stage(campaign: Column | str) -> Column:
    found, text = F.lit("other"), F.lower(col(campaign))
    for prefix, name in reversed(FUNNEL):
        found = F.when(text.startswith(prefix), name).otherwise(found)
    return found


def month_start(day: Column | str) -> Column:
    return F.trunc(col(day), "MM")


def week_start(day: Column | str) -> Column:
    return F.date_trunc("week", col(day)).cast("date")


def iso_dow(day: Column | str) -> Column:
    return (F.weekday(col(day)) + 1).cast("long")


def months_apart(a: Column | str, b: Column | str) -> Column:
    """Month boundaries between two days."""
    a, b = col(a), col(b)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("long")


def planned_share(profile: Column | str, day: Column | str, days: Column | str) -> Column:
    """Share of a month's budget planned to be spent by the end of a day; null for a profile that isn't known.

    Linear: d / n. Front-loaded: half linear, half with daily weights falling in a straight line, whose sums are
    (2nd - d^2) / n^2. The last day is exactly 1.
    """
    profile, d, n = col(profile), col(day).cast("double"), col(days).cast("double")
    falling = (n * d * 2.0 - d * d) / (n * n)
    return (
        F.when(profile.isin("linear", "front_loaded") & (d >= n), 1.0)
        .when(profile == "linear", d / n)
        .when(profile == "front_loaded", d * 0.5 / n + falling * 0.5)
    )


def share_positive(c: Column | str) -> Column:
    return F.avg((col(c) > 0).cast("double"))
