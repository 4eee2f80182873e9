"""Scalar functions as column expressions: they stay in the JVM and in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilgrid.functions import fixed

NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


#: All white space of Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trims white space of any script, not only blanks."""
    return F.trim(c, F.lit(BLANKS))


def once(frame: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds or replaces columns that are worked out once for each row, however often later expressions and filters name them: by
    a generator of one row. Spark would write a projection's expressions out in each place where they are used."""
    names = [c for c in frame.columns if c not in columns]
    made = frame.select(*(F.col(f"`{c}`") for c in frame.columns), F.inline(F.array(F.struct(*(v.alias(f"_once_{n}") for n, v in columns.items())))))
    return made.select(*(F.col(f"`{c}`") for c in names), *(F.col(f"_once_{n}").alias(n) for n in columns))


def bare(c: Column) -> Column:
    """A number's text without white space around, thousands separators and quotes. It is worth a projection of its own where
    both ``number_of`` and ``number_reason`` follow."""
    return F.translate(strip(c), ',"', "")


def number_of(text: Column) -> Column:
    """A number from a bare text; null if it isn't one."""
    text = strip(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_reason(text: Column, number: Column, missing: str, not_numeric: str) -> Column:
    """Why a bare text gives no number; null if it does."""
    return F.when(text.isNull() | (text == ""), missing).when(number.isNull(), not_numeric)


def numeric(c: Column) -> Column:
    """A number from text with blanks, thousands separators and quotes around; null if it isn't one."""
    return number_of(bare(c))


def numeric_reason(c: Column, missing: str, not_numeric: str) -> Column:
    """Why a text gives no number; null if it does."""
    return number_reason(bare(c), numeric(c), missing, not_numeric)


#: What dates look like, their digits written as 0, after dots and slashes have become hyphens: those that a cast reads, and those
#: whose parts are put in its order first.
_DAYS = ("0000-00-00", "0000-0-00", "0000-00-0", "0000-0-0")
PLAIN_DATES = tuple(day + clock for clock in ("", " 00:00:00", " 00:00") for day in _DAYS)
AMERICAN_DATES = ("00-00-0000", "0-00-0000", "00-0-0000", "0-0-0000")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def date_text(c: Column) -> Column:
    """A date's text with hyphens between its parts. It is worth a projection of its own before ``date_of``."""
    text = F.translate(strip(c), "./", "--")
    text = F.when(text.contains("T"), F.regexp_replace(text, r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")).otherwise(text)
    seven = (F.length(text) == 7) & text.rlike(r"^\d{7}$")
    return F.when(seven, F.concat(F.substring(text, 1, 6), F.lit("0"), F.substring(text, 7, 1))).otherwise(text)


def date_of(text: Column) -> Column:
    """A time stamp without zone from a ``date_text``; null if it is in none of the notations, or no day of the calendar. The parts
    are put in order and cast, whatever the session's time zone; the commonest notations come first."""
    looks = F.translate(text, "123456789", "000000000")
    cut = lambda *places: F.concat(*(x for at, n, before in places for x in ((F.lit(before), F.substring(text, at, n)) if before else (F.substring(text, at, n),))))
    year, day = F.substring_index(text, "-", -1), F.substring_index(text, "-", 2)
    named = text.rlike(r"^[A-Za-z]{3} \d{1,2} \d{4}$")
    month = F.instr(F.lit(MONTHS), F.lower(F.substring(text, 1, 3)))
    parts = (
        F.when(looks.isin(*PLAIN_DATES), text)
        .when(looks == "0" * 8, cut((1, 4, ""), (5, 2, "-"), (7, 2, "-")))
        .when(looks == "0" * 14, cut((1, 4, ""), (5, 2, "-"), (7, 2, "-"), (9, 2, " "), (11, 2, ":"), (13, 2, ":")))
        .when(looks.isin(*AMERICAN_DATES), F.concat(year, F.lit("-"), day))
        .when(looks.isin("0000-00", "0000-0"), F.concat(text, F.lit("-1")))
        .when(looks == "0000", F.concat(text, F.lit("-1-1")))
        .when(
            named & (month % 3 == 1),
            F.concat(F.substring_index(text, " ", -1), F.lit("-"), ((month + 2) / 3).cast("int").cast("string"), F.lit("-"), F.substring_index(F.substring(text, 5, 2), " ", 1)),
        )
    )
    return parts.try_cast("timestamp_ntz")


def parse_date(c: Column) -> Column:
    """A time stamp without zone from the date notations in use; null if it is none of them. Two-digit years and fractions
    of seconds aren't read."""
    return date_of(date_text(c))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * fixed.EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def clamp(c: Column) -> Column:
    """Cuts to 0..100; NaN gives 0, null stays null."""
    return F.when(F.isnan(c), 0.0).otherwise(F.when(c.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))))


def _rounded_down(digits: int) -> str:
    """For k from 0 to 1000, 1 if the number nearest to (10 k + 5) / 10**(digits + 1) lies below that tie or rounds to even there."""
    scale = 10 ** (digits + 1)
    return "".join("1" if round(float(f"{(10 * k + 5) / scale:.{digits}f}") * scale) < 10 * k + 5 else "0" for k in range(1001))


def rounded(c: Column, digits: int) -> Column:
    """Scaled, rounded half up and scaled back, as SQL engines round doubles. Spark's own rounding of a double works on its shortest
    text, which puts 45.714999999999996, whose hundredfold is 4571.5, at 45.71 instead of 45.72."""
    return F.round(c * F.lit(float(10**digits))) / F.lit(float(10**digits))


def printed(c: Column, digits: int) -> Column:
    """The text with so many decimals of a number from 0 to 100 (or 0 to 1 with three) that has one decimal more. Ties go where the
    number's binary value lies, as in C and Python, and not up, as in Java."""
    n = F.round(c * 10 ** (digits + 1)).cast("long")
    tie_down = F.substring(F.lit(_rounded_down(digits)), (F.floor(n / 10) + 1).cast("int"), F.lit(1)) == "1"
    up = (n % 10 > 5) | ((n % 10 == 5) & ~tie_down)
    return F.format_string(f"%.{digits}f", (F.floor(n / 10) + up.cast("long")) / F.lit(float(10**digits)))


def density_score(count: Column, reference: float = fixed.REFERENCE_COUNT) -> Column:
    return F.lit(0.0) if reference <= 0 else clamp(count / F.lit(float(reference)) * 100)


def zone_score(distance: Column, limit: float | None = None) -> Column:
    """100 at a zone, falling to 0 at the limit (a limit of none or 0 means the default); null without a distance."""
    limit = float(limit or fixed.ZONE_LIMIT_M)
    near = F.lit(0.0) if limit <= 0 else F.when(distance >= limit, 0.0).otherwise(clamp((1 - distance / limit) * 100))
    return F.when(distance.isNotNull(), near)


def rain_score(mm: Column, full: float = fixed.RAIN_FULL_MM) -> Column:
    return F.when(mm.isNotNull(), F.lit(0.0) if full <= 0 else clamp(mm / float(full) * 100))


def road_score(key: Column, count: Column, most: Column) -> Column:
    """Null without a table or a key, 0 for a key that the table hasn't, else the share of the largest count."""
    none = most.isNull() | key.isNull() | (key == "")
    return F.when(none, None).otherwise(F.when(count.isNull() | (most <= 0), 0.0).otherwise(F.least(F.lit(100.0), count / most * 100)))


def rain_of_text(c: Column) -> Column:
    """Millimetres from a forecast's text."""
    text = F.coalesce(strip(c), F.lit(""))
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)
    return (
        F.when(text.isin(fixed.NO_RAIN), 0.0)
        .when(text.contains(fixed.BELOW), 0.5)
        .when(number != "", number.try_cast("double"))
        .otherwise(0.0)
    )


def forecast_base(now: Column) -> Column:
    """The last forecast issue (every three hours from 02) at least 45 minutes ago: struct of date and time texts."""
    at = now - F.expr("INTERVAL 45 MINUTES")
    hour = F.hour(at)
    slot = F.floor((hour - 2) / 3) * 3 + 2
    day = F.when(hour >= 2, at).otherwise(at - F.expr("INTERVAL 1 DAY"))
    time = F.when(hour >= 2, F.concat(F.lpad(slot.cast("string"), 2, "0"), F.lit("00"))).otherwise("2300")
    return F.struct(F.date_format(day, "yyyyMMdd").alias("base_date"), time.alias("base_time"))


def distance_text(m: Column) -> Column:
    return F.when(m < 1000, F.concat(F.format_number(m, 0), F.lit(" m"))).otherwise(F.concat(F.format_number(m / 1000, 2), F.lit(" km")))


def dms_degrees(d: Column, m: Column, s: Column, negative: Column, most: float) -> Column:
    """Degrees from degrees, minutes and seconds; null out of range."""
    value = (d + m / 60 + s / 3600) * F.when(negative, -1.0).otherwise(1.0)
    return F.when(value.between(-most, most), value)


def flag_text(flag: Column, labels: tuple[str, str] = fixed.DONE_LABELS) -> Column:
    n = flag.cast("int")
    return F.when(n == 1, labels[0]).when(n == 0, labels[1])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, structs with x1, y1, x2, y2; 0 if the union is empty."""

    def area(x1, y1, x2, y2):
        return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)

    both = area(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    union = area(a.x1, a.y1, a.x2, a.y2) + area(b.x1, b.y1, b.x2, b.y2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def letterbox(width: Column, height: Column, size: int = 640) -> Column:
    """Scale, new size and padding that fit an image into a square."""
    scale = F.least(F.lit(float(size)) / height, F.lit(float(size)) / width)
    new_w, new_h = F.rint(width * scale).cast("int"), F.rint(height * scale).cast("int")
    return F.struct(
        scale.alias("scale"),
        new_w.alias("new_w"),
        new_h.alias("new_h"),
        F.floor((size - new_w) / 2).cast("int").alias("pad_x"),
        F.floor((size - new_h) / 2).cast("int").alias("pad_y"),
    )


def class_weight(name: Column, weights: Mapping[str, float] | None = None) -> Column:
    weights = weights or fixed.CLASS_WEIGHTS
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), F.lit(fixed.OTHER_CLASS))


def severity(peak: Column, count: Column, ratio: Column) -> Column:
    """Photo severity: 60 for the type, 20 for the count (full at 5), 20 for the area (full at 0.3)."""
    area = F.least(F.greatest(F.coalesce(ratio, F.lit(0.0)), F.lit(0.0)), F.lit(0.3)) / 0.3 * 20
    some = clamp(F.greatest(F.lit(0.0), peak) * 60 + F.least(count, F.lit(5)) / 5.0 * 20 + area)
    return F.when(count.isNotNull(), F.when(count == 0, 0.0).otherwise(some))


def photo_severity(detections: Column, ratio: Column) -> Column:
    """The same from an array of detections (class_name, confidence): null for null, 0 for none."""
    peak = F.aggregate(
        detections,
        F.lit(0.0),
        lambda best, d: F.greatest(best, class_weight(F.coalesce(d.class_name, F.lit(""))) * F.coalesce(d.confidence, F.lit(0.0))),
    )
    return severity(peak, F.when(detections.isNotNull(), F.size(detections)), ratio)
