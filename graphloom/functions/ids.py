"""Node ids: texts that denote unsigned 64-bit numbers in hexadecimal, in many spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(c: Column) -> Column:
    """The 16 lower-case hex digits of the id.

    Blanks around it, upper case, a ``0x`` prefix and missing or extra leading zeros don't matter. A text that is no
    such number keeps its trimmed lower-case form, so that it equals only itself. Null stays null.
    """
    digits = F.regexp_replace(F.lower(F.trim(c)), r"^(0x)?0*(?=[0-9a-f])", "")
    plain = F.length(c) == 16
    return (
        F.when(plain & c.rlike("^[0-9a-f]{16}$"), c)
        .when(digits.rlike("^[0-9a-f]{1,16}$"), F.lpad(digits, 16, "0"))
        .otherwise(F.lower(F.trim(c)))
    )
