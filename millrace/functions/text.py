"""Text expressions: trimming, folding, searching, lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed

_WHITE_SPACE = "".join(chr(point) for point in range(0x3001) if chr(point).isspace())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` evaluates it only once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(col: Column) -> Column:
    """Trim every Unicode space; plain ``trim`` removes U+0020 only."""
    return F.btrim(col, F.lit(_WHITE_SPACE))


def is_missing(col: Column) -> Column:
    return col.isNull() | (clean(col) == "")


def raw_text(col: Column) -> Column:
    return F.substring(col, 1, fixed.RAW_TEXT_LIMIT)


def fold(col: Column) -> Column:
    """Case folding: lower case, and letters like ``ß`` in full (``ss``).

    Upper case spells such letters out, and lower case then folds them. The dotless i has
    an ASCII upper case but no folding, so it steps aside in between, which also keeps the
    optimizer from dropping the upper case. ASCII text skips all this.
    """
    spelled = F.upper(F.translate(F.lower(col), "ı", "\ue000"))
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.lower(F.translate(spelled, "\ue000", "ı"))
    )


def contains_either(needle: str, *cols: Column) -> Column:
    """Case-insensitive contains on any column; ``%`` and ``_`` stay wildcards."""
    hit = F.lit(False)
    for col in cols:
        hit = hit | col.ilike(f"%{needle}%")
    return hit


def contains_literal(needle: str, *cols: Column) -> Column:
    """Case-sensitive literal contains on any column; empty text matches all."""
    hit = F.lit(needle == "")
    for col in cols:
        hit = hit | F.contains(col, F.lit(needle))
    return hit


def contains_folded(needle: str, *cols: Column) -> Column:
    """Case-folded search over the columns joined with a space."""
    return F.contains(fold(F.concat_ws(" ", *cols)), F.lit(needle.strip().casefold()))


def lookup(table: Mapping[str, str], key: Column, default: Column | None = None) -> Column:
    """Literal map lookup, null (or ``default``) when the key is absent."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def json_text(col: Column) -> Column:
    """One string as a JSON scalar."""
    wrapped = F.to_json(F.array(col))
    return F.when(col.isNotNull(), F.substr(wrapped, F.lit(2), F.length(wrapped) - 2))


def canonical_row(*names: str) -> Column:
    """A row as JSON text with sorted field names, for comparisons."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def is_code(col: Column) -> Column:
    return col.rlike(fixed.CODE_PATTERN)
