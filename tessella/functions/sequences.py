"""Scalar functions on names, sequences and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(name: Column) -> Column:
    """What follows the last underscore; the whole name where there is none."""
    return F.substring_index(name, "_", -1)


def stem(endpoint: Column) -> Column:
    """What stands before the last underscore."""
    return F.regexp_extract(endpoint, r"^(.*)_([^_]*)$", 1)


def digit_segment(name: Column) -> Column:
    """The last segment between underscores that is all digits; an error where there is none."""
    found = F.element_at(F.filter(F.split(name, "_"), lambda s: s.rlike("^[0-9]+$")), -1)
    return F.when(F.exists(F.split(name, "_"), lambda s: s.rlike("^[0-9]+$")), found.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("no number in contig name "), name)).cast("long")
    )


def reverse_complement(seq: Column) -> Column:
    """Complement of A, C, G and T in upper case, anything else as N, in reverse."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def wrap(seq: Column, width: int = 80) -> Column:
    """The sequence in lines of ``width``; empty stays empty."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: F.substring(seq, i, F.lit(width))), "\n")


def gap(weight: Column, alpha: float, beta: float, max_gap: float = 100, min_gap: float = 1) -> Column:
    """Gap by the power law (10**beta / w) ** (1/alpha), within bounds; no weight: the largest."""
    raw = F.pow(F.lit(10.0**beta) / F.when(weight > 0, weight), F.lit(1 / alpha))
    return F.when(weight > 0, F.greatest(F.lit(float(min_gap)), F.least(F.lit(float(max_gap)), raw))).otherwise(F.lit(float(max_gap)))


def gap_length(weight: Column, alpha: float, beta: float, max_gap: float = 100, min_gap: float = 1) -> Column:
    """Whole bases of a gap: rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.rint(gap(weight, alpha, beta, max_gap, min_gap)).cast("int"))


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a dot product and two squared norms, 0 for a zero norm, never negative."""
    return F.when((norm_a > 0) & (norm_b > 0), F.greatest(F.lit(0.0), dot / (F.sqrt(norm_a) * F.sqrt(norm_b)))).otherwise(F.lit(0.0))


def two_decimals(x: Column) -> Column:
    """``x`` with two decimals, half to even on its exact binary value.

    Infinities and no number are written as ``inf``, ``-inf`` and ``nan``; from 2**63 on digits
    behind the seventeenth are zeros. The fraction times 100 is rounded as a double; what that rounding cut off, exactly (the
    factor is split in two halves of 26 bits), decides where it ended halfway.
    """
    near_zero = F.abs(x) < 2.0**63
    size = F.abs(F.when(near_zero, x))
    whole = F.floor(size)
    part = size - whole.cast("double")
    near = part * 100.0
    high = part * 134217729.0 - (part * 134217729.0 - part)
    cut = (high * 100.0 - near) + (part - high) * 100.0
    cents = F.rint(near)
    half = near - cents
    cents = (cents + F.when((half == 0.5) & (cut > 0), 1.0).when((half == -0.5) & (cut < 0), -1.0).otherwise(0.0)).cast("long")
    units = whole + F.when(cents == 100, 1).otherwise(0)
    known = F.concat(F.when(x < 0, "-").otherwise(""), units.cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).when(near_zero, known).otherwise(F.format_string("%.2f", x))


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def float_text(x: Column) -> Column:
    """A double as its shortest text: plain from 0.0001 to under 10**16, else as in 1.5e+20.

    Of a number with up to four decimals, and fifteen digits in all, the digits are those of a whole
    number of ten-thousandths, as no other text of so few digits gives it back. For others fifteen
    digits where these give the number back, else sixteen, else seventeen; numbers
    under 1e-307 in size may get a digit too many.
    """
    size = F.abs(x)
    # Null beyond, so that no cast overflows.
    parts = F.rint(F.when(size < 1e11, size) * 10000.0)
    whole, rest = F.floor(parts / 10000.0), F.pmod(parts.cast("long"), F.lit(10000))
    behind = F.rtrim(F.lpad(rest.cast("string"), 4, "0"), F.lit("0"))
    short = F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.when(rest == 0, "0").otherwise(behind))
    known = F.when(x == 0, x.cast("string")).when(parts / 10000.0 == size, short).otherwise(_digits_text(x))
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).otherwise(known)


def _digits_text(x: Column) -> Column:
    """The text of any finite double."""
    text = F.format_string("%.16e", x)
    for digits in (15, 14):
        short = F.format_string(f"%.{digits}e", x)
        text = F.when(short.try_cast("double") == x, short).otherwise(text)

    def taken(t: Column) -> Column:
        sign, size = F.when(F.startswith(t, F.lit("-")), "-").otherwise(""), F.ltrim(t, F.lit("-"))
        more = F.rtrim(F.substr(F.substring_index(size, "e", 1), F.lit(3)), F.lit("0"))
        power = F.substring_index(size, "e", -1)
        return F.struct(sign.alias("sign"), F.left(size, F.lit(1)).alias("first"), more.alias("more"), power.alias("power"), power.try_cast("int").alias("e"))

    def put(p: Column) -> Column:
        sign, first, more, power, e = (p[k] for k in ("sign", "first", "more", "power", "e"))
        digits = F.concat(first, more)
        padded = F.when(F.length(digits) <= e, F.rpad(digits, e + 1, "0")).otherwise(digits)
        tail = F.substr(padded, e + 2)
        large = F.concat(F.left(padded, e + 1), F.lit("."), F.when(tail == "", "0").otherwise(tail))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        scientific = F.concat(first, F.when(more == "", "").otherwise(F.concat(F.lit("."), more)), F.lit("e"), power)
        return F.concat(sign, F.when((e >= 0) & (e < 16), large).when((e < 0) & (e >= -4), small).otherwise(scientific))

    return _bound(_bound(text, taken), put)
