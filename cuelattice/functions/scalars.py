"""Scalar laws as column expressions; everything here stays inside generated JVM code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def clip(x: Column, lo, hi) -> Column:
    """Limit to a range; null stays null (``least`` and ``greatest`` alone would skip it)."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def ratio(a: float, x: Column) -> Column:
    """``a / x`` as IEEE division: a zero gives an infinity of its sign."""
    return F.when(x == 0, F.lit(a) * F.pow(x, F.lit(-1.0))).otherwise(F.lit(a) / F.nullif(x, F.lit(0.0)))


def r6(x: Column) -> Column:
    """Six printed decimals without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


# ── sound ───────────────────────────────────────────────────────────────

def db_to_lin(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def quantise(x: Column, bits: int, mix: float = 1.0, dither: Column | None = None) -> Column:
    """Round to 2**(bits-1)-1 levels, clipped to +-1, mixed with the dry value; optional triangular dither."""
    q = float(2 ** (bits - 1) - 1)
    wet = x if dither is None else x + dither / q
    return x * (1.0 - mix) + F.rint(clip(wet, -1.0, 1.0) * q) / q * mix


def mulaw_round_trip(x: Column, bits: int = 8, mu: float = 255.0) -> Column:
    """Compress with the mu law, keep ``bits`` of it, expand again."""
    c = F.signum(x) * F.log1p(F.abs(clip(x, -1.0, 1.0)) * mu) / math.log1p(mu)
    levels = float(2 ** (bits - 1) - 1)
    c = F.rint(c * levels) / levels
    return F.signum(c) * (F.pow(F.lit(1.0 + mu), F.abs(c)) - 1.0) / mu


def drive(x: Column, peak: Column, law: str, d: float) -> Column:
    """Clip laws on the peak-normalised value, scaled back by the peak."""
    n = x / (peak + 1e-9)
    if law == "soft":
        y = F.tanh(n * d)
    elif law == "hard":
        y = clip(n * d, -1.0, 1.0)
    elif law == "fuzz":
        y = F.tanh((n + 0.08) * (2.0 * d)) - math.tanh(2.0 * d * 0.08)
        y = y - F.tanh(y * 30.0) / 30.0 * (0.3 * d)
    elif law == "asym":
        y = F.when(n >= 0, F.tanh(n * d)).otherwise(F.tanh(n * (2.2 * d)) / 1.4)
    else:
        raise ValueError(f"unknown clip law {law!r}")
    return y * (peak + 1e-9)


def knee_reduction_db(level_db: Column, threshold: float, ratio: float, knee: float) -> Column:
    """Gain reduction of a compressor with a quadratic soft knee."""
    over = level_db - threshold
    slope = 1.0 - 1.0 / ratio
    if knee <= 0:
        return F.greatest(over, F.lit(0.0)) * slope
    inside = (over + knee / 2) * (over + knee / 2) * (slope / (2 * knee))
    return F.when(over <= -knee / 2, 0.0).when(over < knee / 2, inside).otherwise(over * slope)


# ── picture values ──────────────────────────────────────────────────────

def smoothstep(e0: float, e1: float, x: Column) -> Column:
    t = clip((x - e0) / max(e1 - e0, 1e-9), 0.0, 1.0)
    return t * t * (F.lit(3.0) - t * 2.0)


def soft_clip(x: Column, knee: float) -> Column:
    span = 1.0 - knee
    return F.when(x > knee, F.tanh((x - knee) / max(span, 1e-6)) * span + knee).otherwise(x)


def tone_curve(
    x: Column, exposure: float = 0.0, contrast: float = 1.0, pivot: float = 0.5,
    gamma: float = 1.0, lift: float = 0.0, knee: float = 1.0,
) -> Column:
    """Exposure, contrast, gamma, lift, shoulder: in that order, neutral steps left out of the plan."""
    if exposure:
        x = x * (2.0**exposure)
    if contrast != 1.0:
        x = (x - pivot) * contrast + pivot
    if gamma != 1.0:
        x = F.pow(F.greatest(x, F.lit(0.0)), F.lit(1.0 / gamma))
    if lift > 0:
        x = x * (1.0 - lift) + lift
    elif lift < 0:
        x = x + (F.lit(1.0) - x) * lift
    if knee < 1.0:
        x = soft_clip(clip(x, 0.0, 1.2), knee)
    return clip(x, 0.0, 1.0)


# Luma weights and the two chroma rows of the NTSC colour space.
LUMA = (0.299, 0.587, 0.114)
YIQ_ROWS = (
    (0.299, 0.587, 0.114),
    (0.5959, -0.2746, -0.3213),
    (0.2115, -0.5227, 0.3112),
)


def dot(vec: list[Column], weights) -> Column:
    total = vec[0] * weights[0]
    for v, w in zip(vec[1:], weights[1:]):
        total = total + v * w
    return total


def linear_map(vec: list[Column], rows) -> list[Column]:
    return [dot(vec, row) for row in rows]


def saturate(vec: list[Column], amount: float) -> list[Column]:
    y = dot(vec, LUMA)
    return [y + (v - y) * amount for v in vec]


def lift_gamma_gain(x: Column, lift: float, gamma: float, gain: float) -> Column:
    x = clip(x, 0.0, 1.0)
    x = x * gain + (F.lit(1.0) - x) * lift
    return F.pow(clip(x, 0.0, 1.0), F.lit(1.0 / max(gamma, 1e-3)))


def temperature_gains(warmth: float, tint: float = 0.0) -> tuple[float, float, float]:
    return (1.0 + 0.20 * warmth + 0.05 * tint, 1.0 - 0.10 * tint, 1.0 - 0.20 * warmth + 0.05 * tint)


def bell_weight(row: Column, rows: Column, pos: Column, height: Column) -> Column:
    """Cosine bell over the rows of a band that stays on screen: 1 at its centre, 0 outside."""
    band = F.greatest(height * rows, F.lit(3.0))
    centre = band / 2.0 + pos * F.greatest(rows - band, F.lit(0.0))
    d = clip((row - centre) / (band * 0.5), -1.0, 1.0)
    return F.cos(d * math.pi) * 0.5 + 0.5


def edge_profile(k: Column, dur: Column, amp: Column) -> Column:
    """Trapezoid over an interval: rises from 0.3, falls to 0.25; the fall wins where both apply."""
    edge = F.greatest(F.least(F.lit(3), F.floor(dur / 2)), F.lit(1))
    span = F.greatest(edge - 1, F.lit(1))
    up = F.when(edge == 1, F.lit(0.3)).otherwise(k / span * 0.7 + 0.3)
    j = k - (dur - edge)
    down = F.when(edge == 1, F.lit(1.0)).otherwise(F.lit(1.0) - j / span * 0.75)
    return amp * F.when(j >= 0, down).when(k < edge, up).otherwise(F.lit(1.0))


def fade_gain(t_in: Column, t_out: Column, ramp: float) -> Column:
    return clip(t_in / ramp, 0.0, 1.0) * clip(t_out / ramp, 0.0, 1.0)


def reveal_count(t_in: Column, cps: float) -> Column:
    return F.floor(t_in * cps).cast("long") + 1


# ── timing and geometry ─────────────────────────────────────────────────

def trimmed_duration(total: Column, t0: Column, requested: Column) -> Column:
    rest = F.greatest(total - t0, F.lit(0.1))
    return F.least(F.coalesce(requested, rest), rest)


def frames_of(duration: Column, fps: Column) -> Column:
    return F.greatest(F.rint(duration * fps), F.lit(1.0)).cast("long")


def preview_start(total: Column, at: Column, length: float = 3.0) -> Column:
    return F.coalesce(at, F.greatest((total - length) / 2.0, F.lit(0.0)))


def even(x: Column) -> Column:
    return F.greatest(F.rint(x / 2.0) * 2.0, F.lit(2.0)).cast("long")


def abs_frame(t0: Column, fps: Column, i: Column) -> Column:
    return F.rint(t0 * fps).cast("long") + i


def frame_of(t: Column, t0: Column, fps: Column) -> Column:
    return F.rint((t - t0) * fps).cast("long")


def overlaps(t: Column, dur: Column, w0: Column, w1: Column) -> Column:
    """Half-open overlap: touching does not count."""
    return (t < w1) & (t + dur > w0)


# Probe colour tags and the matrix each one names.
COLOUR_TAGS = (
    ("bt709", "bt709"),
    ("bt601", "bt601"),
    ("bt470bg", "bt601"),
    ("smpte170m", "bt601"),
    ("smpte240m", "smpte240m"),
    ("fcc", "fcc"),
    ("bt2020nc", "bt2020"),
    ("bt2020c", "bt2020"),
)


def colour_matrix(tag: Column, width: Column, height: Column) -> Column:
    """A usable colour tag by name, anything else by picture size."""
    named = F.create_map(*[F.lit(v) for pair in COLOUR_TAGS for v in pair])
    guess = F.when((height >= 720) | (width >= 1280), F.lit("bt709")).otherwise(F.lit("bt601"))
    return F.coalesce(F.try_element_at(named, F.lower(F.coalesce(tag, F.lit("")))), guess)


# ── printed values ──────────────────────────────────────────────────────

def decimals_for(kind: Column, lo: Column, hi: Column, v: Column) -> Column:
    return F.when(kind == "int", 0).when(F.abs(hi - lo) < 0.5, 3).when(F.abs(v) >= 100, 0).otherwise(2)


def printed(v: Column, places: Column) -> Column:
    """The value the row prints: rounded to 0, 2 or 3 places, so rounding again changes nothing."""
    return F.when(places == 0, F.round(v, 0)).when(places == 2, F.round(v, 2)).otherwise(F.round(v, 3))


def with_unit(v: Column, places: Column, unit: Column) -> Column:
    text = (
        F.when(places == 0, F.format_string("%.0f", v))
        .when(places == 2, F.format_string("%.2f", v))
        .otherwise(F.format_string("%.3f", v))
    )
    return F.when(unit == "", text).when(unit == "°", F.concat(text, unit)).otherwise(F.concat_ws(" ", text, unit))


def download_size(n: Column) -> Column:
    """Whole megabytes, or gigabytes with two decimals from one gigabyte up."""
    mb = n / float(1 << 20)
    return F.when(mb >= 1024, F.format_string("%.2f GB", mb / 1024)).otherwise(F.format_string("%.0f MB", mb))


def file_size(n: Column) -> Column:
    """Whole kilobytes, or megabytes with one decimal from one megabyte up."""
    return F.when(n < (1 << 20), F.format_string("%.0f KB", n / 1024.0)).otherwise(
        F.format_string("%.1f MB", n / float(1 << 20))
    )


def timecode(t: Column) -> Column:
    """``m:ss.s`` from a minute up, plain seconds below."""
    m = F.floor(t / 60).cast("long")
    sec = t - m * 60
    return F.when(m > 0, F.concat(m.cast("string"), F.lit(":"), F.lpad(F.format_string("%.1f", sec), 4, "0"))).otherwise(
        F.format_string("%.1f", sec)
    )


def parse_timecode(text: Column) -> Column:
    s = F.trim(text)
    pat = r"^(?:(\d+):)?(\d+(?:\.\d+)?)$"
    mins = F.coalesce(F.nullif(F.regexp_extract(s, pat, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    secs = F.nullif(F.regexp_extract(s, pat, 2), F.lit("")).try_cast("double")
    return F.when(s.rlike(pat), mins * 60 + secs)


def counter(total_s: Column) -> Column:
    s = F.floor(total_s).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def parse_clock_start(raw: Column) -> Column:
    """Three formats in order; null when none fits."""
    s = F.trim(raw)
    return F.coalesce(
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )


def clock_text(t: Column, style: str) -> Column:
    """Burnt-in clock in one of six layouts; lines are joined by a newline."""
    layouts = {
        "mon_d_yyyy": F.concat(F.upper(F.date_format(t, "MMM")), F.date_format(t, " d yyyy"), F.lit("\n"), F.date_format(t, "h:mm a")),
        "dd-mm-yyyy": F.date_format(t, "dd-MM-yyyy"),
        "yyyy-mm-dd": F.date_format(t, "yyyy-MM-dd"),
        "mdy_time": F.date_format(t, "MM/dd/yyyy h:mm a"),
        "dow_dmy_hms": F.concat(F.upper(F.date_format(t, "EEE")), F.date_format(t, " dd-MM-yy HH:mm:ss")),
        "hms": F.date_format(t, "HH:mm:ss"),
    }
    return layouts[style]


def version_parts(raw: Column) -> Column:
    """``(major, minor, patch)`` or null; a leading v and any suffix are ignored."""
    s = F.trim(raw)
    pat = r"^v?(\d+)\.(\d+)\.(\d+)(?:[-+].*)?$"
    part = [F.nullif(F.regexp_extract(s, pat, i), F.lit("")).try_cast("long") for i in (1, 2, 3)]
    return F.when(s.rlike(pat), F.struct(part[0].alias("major"), part[1].alias("minor"), part[2].alias("patch")))


def version_direction(tag: Column, current: Column) -> Column:
    a, b = version_parts(tag), version_parts(current)
    return (
        F.when(a.isNull() | b.isNull(), "unknown").when(a > b, "newer").when(a < b, "older").otherwise("current")
    )


def hex_channel(text: Column, which: int, fallback: float = 1.0) -> Column:
    """One of the three channels of ``#rgb`` or ``#rrggbb`` as 0..1; unreadable text gives the fallback."""
    s = F.regexp_replace(F.trim(text), "^#+", "")
    full = F.when(F.length(s) == 3, F.regexp_replace(s, "(.)", "$1$1")).otherwise(s)
    value = F.conv(F.substring(full, 1 + 2 * which, 2), 16, 10).try_cast("double") / 255.0
    return F.when(full.rlike("^[0-9a-fA-F]{6}$"), value).otherwise(F.lit(fallback))


def clock_at(start: Column, frame: Column, fps: Column) -> Column:
    """Wall-clock time of a frame."""
    micros = F.floor(frame / F.greatest(fps, F.lit(1.0)) * 1e6).cast("long")
    return F.timestamp_micros(F.unix_micros(start) + micros)


def geometry(width: Column, height: Column, scale: Column, era_height: Column) -> dict[str, Column]:
    """Delivery size, and the smaller era size when the look asks for fewer lines."""
    out_w, out_h = even(F.floor(width * scale)), even(F.floor(height * scale))
    small = F.coalesce((era_height > 0) & (era_height < out_h), F.lit(False))
    proc_h = F.when(small, even(era_height)).otherwise(out_h)
    proc_w = F.when(small, even(out_w * proc_h / out_h)).otherwise(out_w)
    return {"out_w": out_w, "out_h": out_h, "proc_w": proc_w, "proc_h": proc_h}


def place(pos: Column, extent: Column, size: Column, margin: float) -> Column:
    """Leading edge of a block centred on ``pos``, kept inside the safe area when it fits there."""
    m = F.rint(size * margin)
    want = pos * size - extent / 2.0
    lo, hi = m, size - m - extent
    return F.rint(F.when(hi < lo, want).otherwise(F.least(F.greatest(want, lo), hi))).cast("long")
