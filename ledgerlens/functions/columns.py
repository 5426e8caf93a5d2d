"""Scalar column expressions. Everything here is a built-in JVM-side expression."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DAY, DEFAULT, Params

# Device models too generic to identify hardware.
GENERIC_MODELS = ["UNK", "Windows", "MacOS", "iOS Device", "Trident/7.0"]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp (or zone-less timestamp) column."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def code_text(c: Column) -> Column:
    """Null to empty, trimmed, with a trailing ``.0`` dropped."""
    return F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\.0$", "")


def device_key(*parts: Column) -> Column:
    """Pipe-joined profile with ``UNK`` for blanks; null when every part is unknown."""
    known = [F.coalesce(F.nullif(F.trim(p), F.lit("")), F.lit("UNK")) for p in parts]
    nothing = "|".join(["UNK"] * len(parts))
    return F.nullif(F.concat_ws("|", *known), F.lit(nothing))


def device_label(profile: Column) -> Column:
    return F.replace(F.coalesce(profile, F.lit("")), F.lit("|"), F.lit(" | "))


def device_digest(profile: Column) -> Column:
    """Short device id: ``D`` and six upper-case hex digits of the profile's md5."""
    return F.concat(F.lit("D"), F.upper(F.substring(F.md5(profile), 1, 6)))


def is_specific_device(profile: Column) -> Column:
    """True when model, OS and screen are all known and the model is not a generic one."""
    p = F.split(profile, r"\|")
    ok = ((F.size(p) == 4) & ~F.get(p, F.lit(0)).isin(GENERIC_MODELS)
          & (F.get(p, F.lit(1)) != "UNK") & (F.get(p, F.lit(3)) != "UNK"))
    return F.coalesce(ok, F.lit(False))


def safe_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def region_id(addr: Column) -> Column:
    """Whole-number text of a region code; ``UNKNOWN`` for null, zero or unreadable codes."""
    v = safe_double(addr)
    return F.when(v != 0, v.cast("long").cast("string")).otherwise(F.lit("UNKNOWN"))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def logit(p: Column) -> Column:
    q = clip(p.cast("double"), 1e-6, 1 - 1e-6)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bayes(p: Column, ratio: Column, params: Params = DEFAULT) -> Column:
    """One likelihood-ratio update, clipped so the result never reaches 0 or 1."""
    return clip(sigmoid(logit(p) + F.log(ratio)), params.p_floor, params.p_ceil)


def prior_shift(raw: Column, params: Params = DEFAULT) -> Column:
    """Move a calibrated probability from the training base rate to the target one."""
    z = logit(raw) - logit(F.lit(params.train_prior)) + logit(F.lit(params.target_prior))
    return clip(sigmoid(z), params.p_floor, params.p_ceil)


def calibrated(p_flag: Column, p_max: Column, n: Column, known: Column, params: Params = DEFAULT) -> Column:
    a, b, c, d = params.cal_weights
    z = (F.lit(params.cal_intercept) + F.lit(a) * logit(p_flag) + F.lit(b) * logit(p_max)
         + F.lit(c) * F.log1p(n.cast("double")) + F.lit(d) * (known > 0).cast("double"))
    return prior_shift(sigmoid(z), params)


def money(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


def exposure_band(x: Column) -> Column:
    return F.when(x >= 500, "large").when(x >= 100, "medium").otherwise("small")


def span_text(first_us: Column, last_us: Column) -> Column:
    a, b = from_micros(first_us), from_micros(last_us)
    day, clock = "yyyy-MM-dd", "HH:mm"
    return (F.when(first_us == last_us,
                   F.concat(F.lit("on "), F.date_format(a, day), F.lit(" at "), F.date_format(a, clock)))
            .when(F.to_date(a) == F.to_date(b),
                  F.concat(F.lit("on "), F.date_format(a, day), F.lit(" between "), F.date_format(a, clock),
                           F.lit(" and "), F.date_format(b, clock)))
            .otherwise(F.concat(F.lit("between "), F.date_format(a, day), F.lit(" and "),
                                F.date_format(b, day))))


def channel_mix(n_online: Column, n_person: Column) -> Column:
    return F.concat_ws(" and ",
                       F.when(n_online > 0, F.concat(n_online.cast("string"), F.lit(" online"))),
                       F.when(n_person > 0, F.concat(n_person.cast("string"), F.lit(" in-person"))))


def region_text(regions: Column) -> Column:
    """``regions``: sorted array of region texts."""
    return F.when(F.size(regions) > 0, F.concat(F.lit("billing region "), F.array_join(regions, ", "))) \
            .otherwise(F.lit("no billing region recorded"))


def flag(cond: Column) -> Column:
    """1/0 with null counted as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def share(cond: Column) -> Column:
    """Aggregate: share of rows meeting ``cond`` (null counts as not met)."""
    return F.avg(flag(cond).cast("double"))


def day_no(us: Column) -> Column:
    return F.floor(us / F.lit(DAY)).cast("long")
