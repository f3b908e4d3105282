"""Stratum functions: question family and area bucket (SCL12, SCL26, PRJ19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of each question family, in the order in which they are tried.
FAMILY_WORDS = {
    "table": ["table", "row", "column", "cell"],
    "chart": ["chart", "graph", "plot", "axis", "axes", "legend", "bar chart", "line graph"],
    "text": ["read", "written", "word", "text", "label", "title", "caption", "spell", "name"],
    "count": ["how many", "count", "number of"],
    "math": ["percent", "percentage", "ratio", "probability", "average", "sum", "total", "difference", "measure", "length"],
}
# Largest area in pixels of each bucket.
AREA_LIMITS = {"small": 65_536, "medium": 262_144, "large": 1_048_576}
LARGEST = "very_large"

# Letters whose full case folding differs from lower case and can spell a family word.
FOLDED = {"ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: A word character: letter, digit, numeral or underscore.
WORD = r"\p{L}\p{N}_"


def question_family(question: Column | str) -> Column:
    """The first family with a whole word in the case-folded text, else ``other``; NULL for NULL."""
    text = F.lower(F.col(question) if isinstance(question, str) else question)
    for letter, folded in FOLDED.items():
        text = F.replace(text, F.lit(letter), F.lit(folded))
    family = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, words in FAMILY_WORDS.items():
        family = family.when(text.rlike(f"(?<![{WORD}])(?:{'|'.join(words)})(?![{WORD}])"), name)
    return family.otherwise("other")


def area_bucket(size: Column | str) -> Column:
    """Bucket of width times height, limits included; NULL unless the size is two positive numbers."""
    size = F.col(size) if isinstance(size, str) else size
    area = F.get(size, F.lit(0)) * F.get(size, F.lit(1))
    bucket = F.when(~positive_size(size), F.lit(None).cast("string"))
    for name, limit in AREA_LIMITS.items():
        bucket = bucket.when(area <= limit, name)
    return bucket.otherwise(LARGEST)


def positive_size(size: Column | str) -> Column:
    """True if the array is exactly two positive numbers, else False."""
    size = F.col(size) if isinstance(size, str) else size
    return F.coalesce((F.size(size) == 2) & (F.get(size, F.lit(0)) > 0) & (F.get(size, F.lit(1)) > 0), F.lit(False))
