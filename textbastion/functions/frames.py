"""Binary scan requests: one byte of kind, four of threshold (float, little-endian), four of length, then the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER, MOST = 9, 16 << 20
FULL, PING = 0, 2


def _byte(b: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(b, at + 1, 1)), 16, 10).cast("long")


def _number(b: Column, at: int) -> Column:
    return _byte(b, at) + _byte(b, at + 1) * 256 + _byte(b, at + 2) * 65536 + _byte(b, at + 3) * 16777216


def _float(bits: Column) -> Column:
    """The single-precision number of 32 bits; infinities and NaN are null."""
    sign = F.when(bits >= 1 << 31, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23) % 256
    fraction = (bits % (1 << 23)).cast("double") / (1 << 23)
    value = F.when(exponent == 0, fraction * 2.0**-126).when(exponent < 255, (fraction + 1) * F.pow(F.lit(2.0), exponent - 127))
    return (sign * value).cast("float")


def decode(frame: Column) -> Column:
    """Struct of status (ok, partial or error), kind, threshold and text. What follows a whole frame is not looked at.

    A frame that has not come in full is partial; an unknown kind, a length over 16 MB and text that is no UTF-8 are errors.
    """
    n, kind, size = F.octet_length(frame), _byte(frame, 0), _number(frame, 5)
    body = F.try_validate_utf8(F.substring(frame, F.lit(HEADER + 1), F.greatest(size, F.lit(0)).cast("int")).cast("string"))
    status = F.when(n < HEADER, "partial").when(~kind.isin(FULL, PING) | (size > MOST), "error").when(n < HEADER + size, "partial").when(body.isNull(), "error").otherwise("ok")
    name = F.when(kind == FULL, "full").when(kind == PING, "ping")
    ok = status == "ok"
    return F.when(frame.isNotNull(), F.struct(status.alias("status"), F.when(ok, name).alias("kind"), F.when(ok, _float(_number(frame, 1))).alias("threshold"), F.when(ok, body).alias("text")))


def encode(kind: Column, threshold_hex: Column, text: Column) -> Column:
    """A frame from its kind, the threshold's bytes in hex, and the text."""
    n = F.octet_length(text)
    sizes = [F.lpad(F.hex(F.shiftright(n, 8 * i) % 256), 2, "0") for i in range(4)]
    return F.unhex(F.concat(F.lpad(F.hex(kind), 2, "0"), threshold_hex, *sizes, F.hex(F.encode(text, "UTF-8"))))
