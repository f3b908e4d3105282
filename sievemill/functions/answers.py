"""Answer semantics (SCL01-07, JOI19): normal text, numbers, matching and partial credit.

Unicode folding and numbers with any exponent have no Spark expression, so these run as Arrow-batched
pandas UDFs; everything else about them is plain Python that tests call directly.
"""

from __future__ import annotations

import decimal
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Grammars of a plain number, and of a benchmark's number (commas gone).
PLAIN_NUMBER = re.compile(r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:e[+-]?\d+)?")
LOOSE_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?")
# Names of the ways in which an answer matches.
EXACT, NUMERIC, NONE = "normalized_exact", "numeric_exact", "unmatched_requires_review"
#: Partial credit of an answer that isn't exact stays at or below this.
MOST_PARTIAL = 0.9999
#: Relative error that chart questions allow.
CHART_TOLERANCE = Decimal("0.05")
CHOICES = "ABCDE"


def normal_text(text: str) -> str:
    """NFKC, case-folded, white space collapsed, without final full stops."""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return " ".join(folded.split()).rstrip(".。")


def _decimal(text: str) -> Decimal | None:
    try:
        return Decimal(text)
    except decimal.InvalidOperation:
        return None


def plain_number(text: str) -> Decimal | None:
    """The number that the text is, thousands grouped or not; None for units, signs of percent and the like."""
    normal = normal_text(text)
    return _decimal(normal.replace(",", "")) if PLAIN_NUMBER.fullmatch(normal) else None


def loose_number(text: str, chart: bool = False) -> Decimal | None:
    """The benchmark grammar: any commas, a final degree sign, for charts dollar and percent signs around it."""
    bare = normal_text(text).strip().replace(",", "")
    bare = (bare.strip("$% ") if chart else bare).rstrip("°")
    return _decimal(bare) if LOOSE_NUMBER.fullmatch(bare) else None


def match(prediction: str | None, answers: list[str]) -> tuple[bool, str]:
    """(matches, method); a missing prediction matches nothing, missing answers are no answers."""
    if prediction is None:
        return False, NONE
    answers = [a for a in answers if a is not None]
    own = normal_text(prediction)
    if own in {normal_text(a) for a in answers}:
        return True, EXACT
    number = plain_number(prediction)
    if number is not None and number in [n for n in map(plain_number, answers) if n is not None]:
        return True, NUMERIC
    return False, NONE


def partial_credit(prediction: str | None, answers: list[str]) -> float:
    """1 for a match; for numbers of equal sign 1 minus the relative error to the best answer; else 0."""
    if prediction is None:
        return 0.0
    if match(prediction, answers)[0]:
        return 1.0
    own, best = plain_number(prediction), 0.0
    for other in (plain_number(a) for a in answers if a is not None) if own is not None else ():
        if other is None or own.is_signed() != other.is_signed():
            continue
        try:
            best = max(best, 1.0 - float(abs(own - other) / max(abs(own), abs(other))))
        except decimal.DecimalException:  # beyond what decimals can divide
            pass
    return min(MOST_PARTIAL, best)


def benchmark_score(dataset: str | None, question_type: str | None, prediction: str | None, answers: list[str]) -> tuple[bool, str]:
    """(correct, method) by the rules of the data set; a missing prediction has method ``invalid_format``."""
    if prediction is None:
        return False, "invalid_format"
    hit, method = match(prediction, answers)
    if hit:
        return True, method
    answers = [a for a in answers if a is not None]
    own = normal_text(prediction).strip()
    if dataset == "ChartQA" and (number := loose_number(prediction, chart=True)) is not None:
        goals = [g for g in (loose_number(a, chart=True) for a in answers) if g is not None]
        if any(abs(number - g) <= abs(g) * CHART_TOLERANCE for g in goals):
            return True, "chartqa_numeric_5pct"
    elif dataset == "OCRBench":
        squeezed = "".join(own.split())
        if any(s and s in squeezed for s in ("".join(normal_text(a).split()) for a in answers)):
            return True, "ocrbench_substring"
    elif dataset == "MathVerse":
        letters = [c for c in (normal_text(a).strip().upper() for a in answers) if len(c) == 1 and c in CHOICES]
        if question_type == "multi-choice" and any(re.fullmatch(rf"(?:option|choice|answer(?: is)?)\s*[:\uff1a]?\s*{c}", own, re.I) for c in letters):
            return True, "mathverse_choice_letter"
        number = loose_number(prediction)
        if number is not None and number in [loose_number(a) for a in answers]:
            return True, "mathverse_numeric_exact"
    return False, "unmatched"


def _verdict(name: str) -> T.StructType:
    """A type object, as a DDL string could be read on the driver only."""
    return T.StructType([T.StructField(name, T.BooleanType()), T.StructField("method", T.StringType())])


def _list(values) -> list:
    return [] if values is None else list(values)


@F.pandas_udf(T.StringType())
def normal_text_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else normal_text(t))


@F.pandas_udf(T.StringType())
def plain_number_of(text: pd.Series) -> pd.Series:
    """The number as text, since its exponent may exceed every numeric type; NULL if the text is none."""
    return text.map(lambda t: None if t is None or (n := plain_number(t)) is None else str(n))


@F.pandas_udf(T.StringType())
def benchmark_text_of(text: pd.Series) -> pd.Series:
    """SCL05: the normal text without outer white space."""
    return text.map(lambda t: None if t is None else normal_text(t).strip())


@F.pandas_udf(T.StringType())
def loose_number_of(text: pd.Series) -> pd.Series:
    """SCL06: a number of the benchmark's grammar, as text; NULL if the text is none."""
    return text.map(lambda t: None if t is None or (n := loose_number(t)) is None else str(n))


@F.pandas_udf(_verdict("match"))
def _match_of(prediction: pd.Series, answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([match(p, _list(a)) for p, a in zip(prediction, answers, strict=True)], columns=["match", "method"])


@F.pandas_udf(T.DoubleType())
def _credit_of(prediction: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([partial_credit(p, _list(a)) for p, a in zip(prediction, answers, strict=True)], dtype="float64")


@F.pandas_udf(_verdict("correct"))
def _score_of(dataset: pd.Series, kind: pd.Series, prediction: pd.Series, answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([benchmark_score(d, k, p, _list(a)) for d, k, p, a in zip(dataset, kind, prediction, answers, strict=True)], columns=["correct", "method"])


def match_of(prediction: Column | str, answers: Column | str) -> Column:
    return _match_of(prediction, answers)


def credit_of(prediction: Column | str, answers: Column | str) -> Column:
    return _credit_of(prediction, answers)


def score_of(dataset: Column | str, question_type: Column | str, prediction: Column | str, answers: Column | str) -> Column:
    return _score_of(dataset, question_type, prediction, answers)
