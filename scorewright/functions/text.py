"""Text helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a general text strip removes, and the characters
# that end a line.  Spark's own trim removes the plain space only.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = r"\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x85\x{2028}\x{2029}]"

# A plain decimal number.  Spark's own cast also takes suffixes such as 0.9d.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    """Remove blanks, line ends and other spacing at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def to_number(text: Column) -> Column:
    """Text to double; anything but a plain decimal number gives null."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def float_text(number: Column) -> Column:
    """A double as its shortest text: plain from 1e-4 to 1e16 (``10000000.0``), else ``1e-05``.

    The digits are the JVM's, which has a digit too many for a few numbers.
    """
    size = F.abs(number)
    plain = F.regexp_replace(number.cast("decimal(38,20)").cast("string"), "0+$", "")
    return (
        F.when((number == 0) | ((size >= 1e-3) & (size < 1e7)), number.cast("string"))
        .when(
            (size >= 1e-4) & (size < 1e16),
            F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain),
        )
        .when(size < float("inf"), _with_exponent(number.cast("string")))
        .otherwise(number.cast("string"))
    )


def _with_exponent(text: Column) -> Column:
    """``1.0E-5`` as ``1e-05``, ``2.5E16`` as ``2.5e+16``."""
    power = F.regexp_extract(text, "E(-?[0-9]+)$", 1).cast("int")
    digits = F.abs(power).cast("string")
    return F.concat(
        F.regexp_replace(F.split(text, "E")[0], r"[.]0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
