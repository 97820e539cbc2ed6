"""Key orders: a store keeps each key in a form whose byte order is the order wanted, and gives back the key itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Comparator:
    """A named order. stored and given, each other's inverse, turn a key into its stored form and back; stored_column and given_column do so for
    columns. The name is kept in the manifest: a store opens only with the order that it was made with."""

    name: str
    stored: Callable[[str | bytes], str | bytes] = lambda k: k
    given: Callable[[str | bytes], str | bytes] = lambda k: k
    stored_column: Callable[[Column], Column] = lambda c: c
    given_column: Callable[[Column], Column] = lambda c: c


#: Unsigned bytes, a shorter key before the longer ones that it begins.
BYTEWISE = Comparator("bytewise")


def decimal(width: int = 20) -> Comparator:
    """Text keys that write whole numbers without leading zeros, in the order of the numbers."""
    return Comparator(
        f"decimal-{width}", lambda k: k.rjust(width, "0"), lambda k: k.lstrip("0") or "0", lambda c: F.lpad(c, width, "0"),
        lambda c: F.when(F.rlike(c, F.lit("^0+$")), "0").otherwise(F.ltrim(c, F.lit("0"))),
    )


_HEX = "0123456789ABCDEF"


def reverse() -> Comparator:
    """Keys of bytes from the last to the first: each byte is taken from 255, and a mark above all bytes ends the key, so that a longer key comes before
    those that it begins with. The stored form has two bytes for each."""
    flip = lambda k: bytes(x for b in k for x in (0, 255 - b)) + b"\x01"

    def flipped(c: Column) -> Column:
        digits = F.translate(F.hex(c), _HEX, _HEX[::-1])
        return F.unhex(F.concat(F.regexp_replace(digits, "(..)", "00$1"), F.lit("01")))

    def back(c: Column) -> Column:
        digits = F.regexp_replace(F.substr(F.hex(c), F.lit(1), 2 * F.octet_length(c) - 2), "..(..)", "$1")
        return F.unhex(F.translate(digits, _HEX, _HEX[::-1]))

    return Comparator("reverse", flip, lambda k: bytes(255 - b for b in k[1:-1:2]), flipped, back)


COMPARATORS = {c.name: c for c in (BYTEWISE, decimal(), reverse())}
