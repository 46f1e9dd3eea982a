"""Text normal forms as Column expressions.  They stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script (the class Python's ``str.split`` uses).
WHITE = r"[\s\u001c-\u001f\u0085\p{Z}]+"


def blank(col: Column) -> Column:
    """Null and ``""`` mean the same: null becomes ``""``."""
    return F.coalesce(col, F.lit(""))


def letters_digits(col: Column) -> Column:
    """Letters and digits of any script, case folded; everything else removed.  Null gives ``""``.

    Upper-casing before lower-casing maps letters whose upper form is longer (sharp s, ligatures) on one form; the
    removal stands between the two because the optimiser would drop the inner one of two case changes.
    """
    return F.lower(F.regexp_replace(F.upper(blank(col)), r"[^\p{L}\p{N}]", ""))


def squash(col: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(blank(col), WHITE, "")


def strip(col: Column) -> Column:
    """White space of any script removed at both ends."""
    return F.regexp_replace(blank(col), rf"^{WHITE}|{WHITE}$", "")


def canonical_fields(col: Column) -> Column:
    """The fields of a description (divided by ``,`` ``;`` ``|``) in normal form and sorted, so their order is lost.

    Fields without any letter or digit are left out.
    """
    return F.array_sort(F.filter(F.transform(F.split(blank(col), r"[,;|]"), letters_digits), lambda x: x != ""))


def canonical_entries(col: Column) -> Column:
    """The entries of a map as sorted ``label=value`` texts in normal form; a null map is an empty one."""
    entries = F.coalesce(F.map_entries(col), F.array().cast("array<struct<key:string,value:string>>"))
    return F.array_sort(
        F.filter(
            F.transform(entries, lambda e: F.concat(letters_digits(e["key"]), F.lit("="), letters_digits(e["value"]))),
            lambda x: x != "=",
        )
    )
