"""Scalar column functions: dates, codes, booleans, safe division, flag lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAIN_BOARD = ("000", "001", "002", "003", "600", "601", "603", "605")
FALSE_WORDS = ("", "0", "false", "f", "no", "n", "none", "nan")
TRUE_WORDS = ("1", "true", "t", "yes", "y")
NULL_WORDS = ("", "nan", "none", "null")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Double, null where the text is no finite number."""
    x = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """0 where the divisor is 0, null where either side is null."""
    a, b = col(a), col(b)
    return F.when(b == 0, F.when(a.isNotNull(), 0.0)).otherwise(F.try_divide(a, b))


def holds(condition: Column) -> Column:
    """A comparison in which unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def to_bool(c: Column | str) -> Column:
    word = F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.when(word.isin(*FALSE_WORDS), False).otherwise(True)


def normalize_date(c: Column | str) -> Column:
    """Date from YYYYMMDD, YYYY-MM-DD or any text Spark reads as a date; null if none."""
    text = F.trim(col(c).cast("string"))
    digits = F.regexp_replace(text, r"\D", "")
    eight = F.when(F.length(digits) == 8, F.try_to_timestamp(digits, F.lit("yyyyMMdd")))
    return F.coalesce(eight, F.try_to_timestamp(text)).cast("date")


def normalize_code(c: Column | str, mode: str = "first_run") -> Column:
    """Six-digit code.

    first_run: the first run of one to six digits; six_run: the first run of six, else the last six of all digits;
    joined: all digits, the first six.  Shorter results are filled with zeros; without digits: null.
    """
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    digits = F.regexp_replace(text, r"\D", "")
    if mode == "first_run":
        code = F.regexp_extract(text, r"(\d{1,6})", 1)
    elif mode == "six_run":
        run = F.regexp_extract(text, r"(\d{6})", 1)
        code = F.when(run != "", run).otherwise(F.substring(F.lpad(digits, 64, "0"), 59, 6))
        code = F.when(digits == "", F.lit("")).otherwise(code)
    elif mode == "joined":
        code = F.substring(digits, 1, 6)
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.when(code != "", F.lpad(code, 6, "0"))


def exchange_suffix(code: Column | str) -> Column:
    c = col(code)
    return F.when(c.startswith("6"), F.concat(c, F.lit(".SH"))).when(c.startswith("8") | c.startswith("4"), F.concat(c, F.lit(".BJ"))).otherwise(F.concat(c, F.lit(".SZ")))


def market_of(code: Column | str) -> Column:
    c = col(code)
    return F.when(c.startswith("6"), "SH").when(c.startswith("0") | c.startswith("3"), "SZ").when(c.startswith("4") | c.startswith("8"), "BJ")


def board_of(code: Column | str) -> Column:
    """Board by code prefix: STAR 688/689, ChiNext 300/301, Beijing 4 and 8, else main."""
    head = F.substring(col(code), 1, 3)
    return F.when(head.isin("688", "689"), "STAR").when(head.isin("300", "301"), "ChiNext").when(F.substring(col(code), 1, 1).isin("4", "8"), "BJ").when(head.isin(*MAIN_BOARD), "main").otherwise("other")


def flags(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, as an array in the given order."""
    return F.array_compact(F.array(*[F.when(holds(c), F.lit(name)) for c, name in pairs]))


def flag_text(array: Column | str) -> Column:
    return F.array_join(col(array), ",")


def split_flags(c: Column | str) -> Column:
    """Trimmed, non-empty members of a comma list."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def contains_flag(c: Column | str, flag: str) -> Column:
    return F.array_contains(F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), " ", ""), ","), flag)


def append_flags(text: Column | str, *pairs: tuple[Column, str]) -> Column:
    """Comma list with the names whose condition holds put behind, unless already in it."""
    return flag_text(F.array_distinct(F.concat(split_flags(text), flags(*pairs))))


def dimension_list(c: Column | str) -> Column:
    """Distinct names of a composite text: comma, bar, semicolon or plus separated, or a JSON list."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    listed = F.from_json(text, "array<string>")
    plain = F.split(text, r"\s*[,|;+]\s*")
    items = F.transform(F.when(text.startswith("[") & listed.isNotNull(), listed).otherwise(plain), lambda x: F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & ~F.lower(x).isin(*NULL_WORDS)))


def nearest(x: Column, digits: int) -> Column:
    """Rounded to some decimals as DuckDB rounds: the product with the power of ten, itself a double, to the nearest whole number.

    round() of Spark goes by the shortest decimal that reads back as the same double: 128.11 for 128.105, whose product is below 12810.5."""
    return F.round(x * 10.0**digits) / 10.0**digits


def price(x: Column) -> Column:
    return nearest(x, 2)


def fixed(x: Column | str) -> Column:
    """Text with two decimals, rounded by the double's exact value, a half to even, as printf of C, DuckDB and Python do.

    format_string rounds the shortest decimal that reads back as the same double, a half up: 1.03 for 1.025, which as a double is less.
    Here a double is split in two halves whose multiples are exact, so the sign of its distance from a half is.  Values from 1e13
    on, infinite ones and NaN are left to format_string."""
    x = col(x)
    size, plain = F.abs(x), F.format_string("%.2f", x)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    down = F.floor(size * 100)
    past = (high * 100 - (down + 0.5)) + (size - high) * 100
    cents = F.when(past > 0, down + 1).when(past < 0, down).otherwise(down + down % 2)
    return F.when(size < 1e13, F.concat(F.when(plain.startswith("-"), "-").otherwise(""), F.format_string("%.2f", cents / 100))).when(x.isNotNull(), plain)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null."""
    y = x if low is None else F.when(x < low, F.lit(float(low))).otherwise(x)
    return y if high is None else F.when(y > high, F.lit(float(high))).otherwise(y)


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))
