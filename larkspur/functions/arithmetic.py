"""Integer, float and exact numeric arithmetic with PostgreSQL's results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 38
#: Scale of quotients and of numerics without a declared one.
OPEN_SCALE = 16


def int_div(a: Column, b: Column, kind: str = "int") -> Column:
    """Integer division towards zero, in the operands' type; a zero divisor is an error, and so is the least integer by -1."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(kind)


def shift_left(a: Column, n: Column | int, kind: str = "int") -> Column:
    """a << n in 64 bits, then in the operand's type."""
    return F.call_function("shiftleft", a.cast("bigint"), F.lit(n) if isinstance(n, int) else n).cast(kind)


def shift_right(a: Column, n: Column | int, kind: str = "int") -> Column:
    return F.call_function("shiftright", a.cast("bigint"), F.lit(n) if isinstance(n, int) else n).cast(kind)


def round_float(x: Column) -> Column:
    """round(float8): halves go to the even neighbour."""
    return F.rint(x)


def trunc_float(x: Column) -> Column:
    return F.when(x < 0, -F.floor(-x).cast("double")).otherwise(F.floor(x).cast("double"))


def round_numeric(x: Column, places: int = 0) -> Column:
    """round(numeric, places): halves go away from zero; as numeric(38, places kept within 0 and 16)."""
    return F.round(x, places).cast(f"decimal({MOST},{min(max(places, 0), OPEN_SCALE)})")


def trunc_numeric(x: Column, places: int = 0) -> Column:
    """trunc(numeric, places): towards zero; negative places clear digits before the point."""
    scale = min(max(places, 0), OPEN_SCALE)
    # rounding at the place after subtracting half a unit there is truncation, without scaling by powers of ten
    digits = F.abs(x)
    rounded = F.round(digits, places)
    unit = F.lit(str(10**-places if places <= 0 else "0." + "0" * (places - 1) + "1")).cast(f"decimal({MOST - 8 if places <= 0 else places + 2},{max(places, 0)})")
    cut = F.when(rounded > digits, rounded - unit).otherwise(rounded)
    return (F.when(x < 0, -cut).otherwise(cut)).cast(f"decimal({MOST},{scale})")


@dataclass(frozen=True)
class Numeric:
    """A numeric operand: a column of precision p and scale s. Operators give the scale that PostgreSQL's planner fixes:
    the larger for sums, differences and remainders, the sum for products, OPEN_SCALE for quotients.

    Operands stay as narrow as declared, so that Spark does not cut a result's scale to make room for digits that
    cannot occur; a result too large for 38 digits is an error.
    """

    column: Column
    precision: int = MOST - OPEN_SCALE
    scale: int = OPEN_SCALE

    @classmethod
    def of(cls, column: Column, precision: int, scale: int) -> Numeric:
        return cls(column.cast(f"decimal({precision},{scale})"), precision, scale)

    @classmethod
    def literal(cls, text: str) -> Numeric:
        """A literal's scale is the number of digits after its point."""
        _, _, after = text.partition(".")
        digits = sum(c.isdigit() for c in text)
        return cls.of(F.lit(text), max(digits, len(after) + 1), len(after))

    @classmethod
    def integer(cls, column: Column) -> Numeric:
        return cls.of(column, 19, 0)

    def _fit(self, precision: int, scale: int) -> Column:
        return self.column.cast(f"decimal({min(precision, MOST)},{scale})")

    def _same(self, other: Numeric, made) -> Numeric:
        scale = max(self.scale, other.scale)
        whole = min(max(self.precision - self.scale, other.precision - other.scale), MOST - 1 - scale)
        p = whole + scale
        return Numeric(made(self._fit(p, scale), other._fit(p, scale)).cast(f"decimal({MOST},{scale})"), min(p + 1, MOST), scale)

    def __add__(self, other: Numeric) -> Numeric:
        return self._same(other, lambda a, b: a + b)

    def __sub__(self, other: Numeric) -> Numeric:
        return self._same(other, lambda a, b: a - b)

    def __mod__(self, other: Numeric) -> Numeric:
        return self._same(other, lambda a, b: a % b)

    def __mul__(self, other: Numeric) -> Numeric:
        scale = self.scale + other.scale
        if scale > MOST:
            raise ValueError(f"a product of scale {scale} has more than {MOST} digits")
        p, q = self.precision, other.precision
        over = max(0, p + q + 1 - MOST)
        # what does not fit is taken from the wider operand's whole digits first
        cut = min(over, max(0, max(p, q) - max(self.scale, other.scale) - 1))
        p, q = (p - cut, q - (over - cut)) if p >= q else (p - (over - cut), q - cut)
        made = self._fit(max(p, self.scale + 1), self.scale) * other._fit(max(q, other.scale + 1), other.scale)
        return Numeric(made.cast(f"decimal({MOST},{scale})"), min(p + q + 1, MOST), scale)

    def __truediv__(self, other: Numeric) -> Numeric:
        left = self._fit(min(self.precision, 20 + self.scale), self.scale)
        right = other._fit(min(other.precision, 14 + other.scale), other.scale)
        return Numeric(_quotient(left, self.scale, right, other.scale), MOST, OPEN_SCALE)


def _quotient(left: Column, s: int, right: Column, r: int) -> Column:
    """A quotient at scale 16 from a whole part and the quotient of what is left, each within 38 digits."""
    whole = F.floor(F.abs(left) / F.abs(right)).cast("decimal(20,0)")
    rest = (F.abs(left).cast(f"decimal({20 + s},{s})") - (whole * F.abs(right).cast(f"decimal({14 + r},{r})"))).cast(f"decimal({17 + max(s, r)},{max(s, r) + 3})")
    fraction = F.round(rest / F.abs(right).cast(f"decimal({14 + r},{r})"), OPEN_SCALE).cast(f"decimal({OPEN_SCALE + 2},{OPEN_SCALE})")
    made = (whole.cast("decimal(21,0)") + fraction).cast(f"decimal({MOST},{OPEN_SCALE})")
    return F.when((left < 0) != (right < 0), -made).otherwise(made)


def compare_numeric(x: Column) -> Column:
    """A numeric operand of a comparison between different scales."""
    return x.cast(f"decimal({MOST},{OPEN_SCALE})")
