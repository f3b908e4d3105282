"""Normal forms of the manifest's dirty fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, the information separators included.
SPACE = r"[\s\x1c-\x1f]"

# Spellings of the splits.
SPLIT_NAMES = {
    "training": "train",
    "valid": "val",
    "validation": "val",
    "dev": "val",
    "testing": "test",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind (``trim`` alone takes blanks only)."""
    return F.regexp_replace(col(c), f"(?U)^{SPACE}+|{SPACE}+$", "")


def spaceless(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"(?U){SPACE}+", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def hash_value(c: Column | str, digits: int) -> Column:
    """A hexadecimal hash by value: ``digits`` lower-case digits.

    Case, white space, a prefix that names the hash or the base (``sha256:``, ``0x``) and lost leading
    zeros don't matter. NULL for null, blank, non-hexadecimal or too long values.
    """
    bare = F.regexp_replace(F.lower(spaceless(c)), r"^(?:[a-z][a-z0-9_-]*[:=])?(?:0x)?", "")
    short = F.regexp_replace(bare, "^0+(?=.)", "")
    return F.when(short.rlike(f"^[0-9a-f]{{1,{digits}}}$"), F.lpad(short, digits, "0"))


def hash_long(c: Column) -> Column:
    """16 hexadecimal digits as the signed BIGINT with the same 64 bits."""
    return F.conv(c, 16, -10).cast("bigint")


def normal_group_key(group_key: Column | str = "group_key", doc_id: Column | str = "doc_id", pixel: Column | str = "pixel_sha256") -> Column:
    """``group_key`` without white space in lower case; else ``doc:`` and the document; else ``image:`` and the pixel hash; else NULL."""
    return F.coalesce(
        blank_to_null(F.lower(spaceless(group_key))),
        F.concat(F.lit("doc:"), blank_to_null(trimmed(doc_id))),
        F.concat(F.lit("image:"), hash_value(pixel, 64)),
    )


def normal_split(c: Column | str = "split") -> Column:
    """Trimmed, lower case, spellings unified; NULL for none."""
    low = F.lower(trimmed(c))
    out = blank_to_null(low)
    for spelling, name in SPLIT_NAMES.items():
        out = F.when(low == spelling, F.lit(name)).otherwise(out)
    return out


def normal_flag(c: Column | str) -> Column:
    """``true``/``1`` and ``false``/``0``, trimmed and in any case; NULL for everything else."""
    low = F.lower(trimmed(c))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
