"""Views of stored values as logical ones and back: built-in column expressions throughout, nulls stay null.

What a view takes is the stored value (an integer, bytes) unless its name says otherwise. Integers that do not fit a
narrow view raise, as a checked cast does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_SPAN = "18446744073709551616"
#: The Julian day number of 1970-01-01, from which INT96 counts days.
EPOCH_JULIAN = 2440588


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_days(c):
    """Days since the epoch, of a date."""
    return F.unix_date(_col(c))


def timestamp_millis(c):
    """Milliseconds since the epoch, of a timestamp with or without zone (the session's zone is UTC)."""
    return F.unix_millis(_col(c).cast("timestamp"))


def timestamp_micros(c):
    return F.unix_micros(_col(c).cast("timestamp"))


def timestamp_nanos(c):
    """Nanoseconds as stored: such columns are read as integers."""
    return _col(c).cast("bigint")


def nanos_as_timestamp(c):
    """A timestamp without zone of stored nanoseconds, cut to microseconds."""
    return F.timestamp_micros(F.floor(_col(c) / 1000).cast("bigint")).cast("timestamp_ntz")


def time_millis(c):
    return _col(c).cast("int")


def time_micros(c):
    return _col(c).cast("bigint")


def time_nanos(c):
    return _col(c).cast("bigint")


def uuid_text(c):
    """The hyphenated lower-case form of 16 bytes."""
    return F.regexp_replace(F.lower(F.hex(_col(c))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def text(c):
    """STRING, ENUM and JSON as text; nothing is validated or parsed."""
    return _col(c).cast("string")


def _checked(c: Column, low: int, high: int, kind: str) -> Column:
    fits = c.isNull() | c.between(low, high)
    return F.when(fits, c.cast(kind)).otherwise(F.raise_error(F.concat(F.lit("out of range: "), c.cast("string"))).cast(kind))


def int8(c):
    return _checked(_col(c), -128, 127, "tinyint")


def uint8(c):
    return _checked(_col(c), 0, 255, "smallint")


def int16(c):
    return _checked(_col(c), -32768, 32767, "smallint")


def uint16(c):
    return _checked(_col(c), 0, 65535, "int")


def uint32(c):
    """Stored 32 bits, read as unsigned."""
    return _col(c).cast("bigint").bitwiseAND(F.lit(4294967295))


def uint64(c):
    """Stored 64 bits, read as unsigned."""
    wide = _col(c).cast("decimal(20,0)")
    return F.when(wide < 0, (wide + F.lit(INT64_SPAN).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def uint32_as_int(c):
    """The stored signed value of an unsigned one."""
    c = _col(c)
    return F.when(c > 2147483647, c - 4294967296).otherwise(c).cast("int")


def uint64_as_long(c):
    c = _col(c)
    return F.when(c > F.lit("9223372036854775807").cast("decimal(20,0)"), c - F.lit(INT64_SPAN).cast("decimal(20,0)")).otherwise(c).cast("bigint")


def float16(c):
    """A half-precision number from two little-endian bytes: sign, 5 bits of exponent, 10 bits of fraction."""
    c = _col(c)
    bits = F.conv(F.concat(F.hex(F.substring(c, 2, 1)), F.hex(F.substring(c, 1, 1))), 16, 10).cast("int")
    sign = F.when(bits >= 32768, -1.0).otherwise(1.0)
    power, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)).cast("double")
    infinite = F.when(fraction == 0, sign * float("inf")).otherwise(float("nan"))
    normal = sign * (1 + fraction / 1024) * F.pow(F.lit(2.0), (power - 15).cast("double"))
    return F.when(power == 0, sign * fraction * 2.0**-24).when(power == 31, infinite).otherwise(normal).cast("float")


def decimal_of_int(c, precision: int, scale: int):
    """A decimal from its unscaled integer."""
    unscaled = _col(c).cast(f"decimal({min(38, precision + scale)},0)")
    return (unscaled / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal({precision},{scale})")


def unscaled(c, scale: int):
    """The unscaled integer of a decimal."""
    return (_col(c) * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("bigint")


def decimal_of_bytes(c, precision: int, scale: int):
    """A decimal from big-endian two's complement bytes, 16 at most; no bytes are 0."""
    digits = F.lpad(F.hex(_col(c)), 32, "0")
    negative = F.conv(F.substring(F.hex(_col(c)), 1, 1), 16, 10).cast("int") >= 8
    # Eight hexadecimal digits at a time stay exact in decimal arithmetic.
    value = F.lit(0).cast("decimal(38,0)")
    for i in range(4):
        word = F.coalesce(F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10), F.lit("0")).cast("decimal(38,0)")
        value = (value * F.lit(4294967296).cast("decimal(10,0)") + word).cast("decimal(38,0)")
    width = F.octet_length(_col(c))
    # A negative number is -(not(x) + 1), of its own width: no power of two has to be held.
    inverted = F.translate(F.hex(_col(c)), "0123456789ABCDEF", "FEDCBA9876543210")
    flipped, digits_ = F.lit(0).cast("decimal(38,0)"), F.lpad(inverted, 32, "0")
    for i in range(4):
        word = F.coalesce(F.conv(F.substring(digits_, 8 * i + 1, 8), 16, 10), F.lit("0")).cast("decimal(38,0)")
        flipped = (flipped * F.lit(4294967296).cast("decimal(10,0)") + word).cast("decimal(38,0)")
    exact = F.when(width == 0, F.lit(0).cast("decimal(38,0)")).when(negative, (-flipped - 1).cast("decimal(38,0)")).otherwise(value)
    scaled = F.concat(exact.cast("string"), F.lit(f"E-{scale}")).cast(f"decimal({precision},{scale})")
    return F.when(_col(c).isNotNull(), scaled)


def int96(c):
    """Julian day * 2^64 + nanoseconds of the day, of a timestamp (which has microseconds; see the row-group source)."""
    micros = timestamp_micros(c)
    day = ((micros - F.pmod(micros, F.lit(86400000000))) / 86400000000).cast("bigint")
    nanos = (F.pmod(micros, F.lit(86400000000)) * 1000).cast("decimal(20,0)")
    return ((day + EPOCH_JULIAN).cast("decimal(9,0)") * F.lit(INT64_SPAN).cast("decimal(20,0)") + nanos).cast("decimal(29,0)")
