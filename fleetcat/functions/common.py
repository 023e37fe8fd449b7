"""Small Column helpers shared by the scalar modules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# The code points that count as white space, as a character class for both engines.
WHITE_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


# the same code points as characters, for trimming without a pattern
_SPACES = "".join(chr(c) for first, last in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", WHITE_SPACE) for c in range(int(first, 16), int(last or first, 16) + 1))


def py_strip(c) -> Column:
    """Strip leading and trailing white space of every kind, Unicode's included."""
    return F.btrim(col_of(c), F.lit(_SPACES))


def contains_any(c, needles) -> Column:
    c = col_of(c)
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return F.coalesce(out, F.lit(False))


def let(value, fn) -> Column:
    """Bind ``value`` once and build ``fn(value)`` from it.

    Multi-step string rules reuse each intermediate result several times; as a
    plain Column tree every reuse copies the whole subtree, so the tree (and
    its generated code) grows exponentially with the number of steps.  A
    one-element ``transform`` binds the value to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(col_of(value)), fn), 1)
