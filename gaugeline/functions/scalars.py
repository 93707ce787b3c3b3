"""Column helpers without any grouping: casts, names, formats, lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeline import constants as K

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def norm_side(raw: Column) -> Column:
    """Any alias of a side to 151 / 152; unknown values become null for quarantine."""
    key = F.lower(F.trim(raw.cast("string")))
    return F.when(key.isin(K.LEFT_ALIASES), "151").when(key.isin(K.RIGHT_ALIASES), "152")


def lenient_double(raw: Column) -> Column:
    """Text to double; bad text and values that are not finite become null."""
    text = F.trim(raw.cast("string"))
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def lenient_int(raw: Column) -> Column:
    """Text to bigint with half-even rounding."""
    return F.rint(lenient_double(raw)).try_cast("bigint")


def safe_name(raw: Column, fallback: str) -> Column:
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.btrim(text, F.lit("_")), F.lit("")), F.lit(fallback))


def token_name(raw: Column, fallback: str) -> Column:
    """As safe_name, plain ASCII, with runs of other characters collapsed."""
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[^a-zA-Z0-9_-]+", "_")
    return F.coalesce(F.nullif(F.btrim(text, F.lit("_")), F.lit("")), F.lit(fallback))


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def positive(value: Column) -> Column:
    """The value when it counts for a positive median, else null."""
    return F.when(value > 1e-6, value)


def residual_left(distance: Column) -> Column:
    return distance - K.LEFT_REFERENCE_IN


def residual_right(distance: Column, position: Column) -> Column:
    sign = F.when(F.lower(F.trim(position)) == "before", F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.lit(K.RIGHT_REFERENCE_IN) + sign * distance


def total_length(left_residual: Column, right_residual: Column) -> Column:
    return F.lit(K.BASE_CENTRAL_IN) + left_residual + right_residual


def observations(status: Column, left_notes: Column, right_notes: Column) -> Column:
    """Notes of both sides and the text of the status, joined by a bar."""
    text = F.lit(None).cast("string")
    for key, words in K.OBSERVATION_TEXT.items():
        text = F.when(status == key, words).otherwise(text)
    left = F.when(F.length(left_notes) > 0, F.concat(F.lit("151: "), left_notes))
    right = F.when(F.length(right_notes) > 0, F.concat(F.lit("152: "), right_notes))
    return F.concat_ws(" | ", left, right, text)


def format_feet(inches: Column) -> Column:
    """Feet - inches & eighths, with carry into the next inch and foot."""
    feet = F.floor(inches / 12.0)
    rest = F.greatest(F.lit(0.0), inches - feet * F.lit(12.0))
    whole = F.floor(rest + 1e-9)
    eighths = F.rint(F.greatest(F.lit(0.0), rest - whole) * 8).cast("bigint")
    whole = whole + F.when(eighths >= 8, 1).otherwise(0)
    eighths = F.when(eighths >= 8, F.lit(0)).otherwise(eighths)
    feet = feet + F.floor(whole / F.lit(12.0))
    whole = whole % 12
    fraction = (
        F.when(eighths == 0, F.lit(None).cast("string"))
        .when(eighths == 4, "1/2")
        .when(eighths % 2 == 0, F.concat((eighths / F.lit(2.0)).cast("bigint").cast("string"), F.lit("/4")))
        .otherwise(F.concat(eighths.cast("string"), F.lit("/8")))
    )
    shown = F.concat_ws(" & ", F.when((whole > 0) | fraction.isNull(), whole.cast("string")), fraction)
    return F.when(inches.isNull(), "-").otherwise(F.concat_ws(" - ", feet.cast("string"), shown))


def length_group(status: Column, length: Column, top: float = 493.0, middle: float = 491.0) -> Column:
    usable = (F.coalesce(F.nullif(status, F.lit("")), F.lit("matched")) == "matched") & length.isNotNull()
    return (
        F.when(~usable | F.isnan(length), "X")
        .when(length >= top, "A")
        .when(length >= middle, "B")
        .otherwise("C")
    )


def marker_color(status: Column) -> Column:
    return F.when(status.isin(list(K.OBSERVATION_TEXT)), K.COLOR_UNMATCHED).otherwise(K.COLOR_DEFAULT)


def movement_sequence(raw: Column) -> Column:
    """Alias of a movement sequence to its name; unknown aliases become null."""
    key = F.lower(F.trim(F.coalesce(F.nullif(raw, F.lit("")), F.lit(K.SEQUENCE_DEFAULT))))
    return F.when(key.isin(K.DEFAULT_SEQUENCE_ALIASES), K.SEQUENCE_DEFAULT).when(
        key.isin(K.PRE_ZOOM_SEQUENCE_ALIASES), K.SEQUENCE_PRE_ZOOM
    )


def parse_iso_utc(text: Column) -> Column:
    """ISO text to a UTC timestamp; text without an offset is UTC; bad text is null."""
    clean = F.trim(text)
    zoned = (
        F.when(F.length(clean) == 10, F.concat(clean, F.lit("T00:00:00Z")))
        .when(clean.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), clean)
        .otherwise(F.concat(clean, F.lit("Z")))
    )
    return F.when(clean != "", F.try_to_timestamp(zoned))


def hour_label(text: Column) -> Column:
    """The hour on the clock of the text itself, so the offset is not applied."""
    clock = F.try_to_timestamp(F.regexp_replace(F.trim(text), r"(Z|[+-]\d{2}:?\d{2})$", ""))
    return F.coalesce(F.date_format(clock, "yyyy-MM-dd HH:00"), F.lit("No time"))


def captured_date(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 10)


def file_stamp(name: Column) -> tuple[Column, Column]:
    """Side and UTC stamp out of an export name."""
    pattern = r"(?i)cam(151|152)_tube_measurements_(\d{8}_\d{6})\.json$"
    side = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")), F.lit("yyyyMMdd_HHmmss"))
    return side, stamp


def run_id_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"cam_?(?:151|152)_(\d{8}_\d{6})", 1), F.lit(""))
