"""The tagged action grammar (SCL08-11, SCL14, SCL56, SCL57, PRJ10, PRJ11).

One turn is a think block followed by an answer or by a tool call with a box in 0-1000 coordinates. Tags are
told apart by Spark expressions; the JSON of a call is read in Python, where a boolean is no number and a
number may have any length.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags, the tool's name and its argument, box coordinates' range, wrappers of an answer.
THINK, ANSWER, CALL = ("<think>", "</think>"), ("<answer>", "</answer>"), ("<tool_call>", "</tool_call>")
TOOL, ARGUMENT, SPAN = "request_local_region", "bbox_2d", 1000
WRAPPERS = ["\\boxed{", "\\fbox{"]
TURN = re.compile(r"<think>(?P<think>.*?)</think>\s*(?:<answer>(?P<answer>.*?)</answer>|<tool_call>(?P<call>.*?)</tool_call>)\s*", re.S)

_TYPES = {"kind": T.StringType(), "valid": T.BooleanType(), "has_think": T.BooleanType(), "answer": T.StringType(), "bbox": T.ArrayType(T.DoubleType()), "error": T.StringType()}
RESULT = T.StructType([T.StructField(n, t) for n, t in _TYPES.items()])


def says_something(text: str | None) -> bool:
    """More than blanks, dots and ellipses."""
    return bool(text) and any(not c.isspace() and c not in ".…" for c in text)


def unwrapped(text: str) -> str:
    """The content of a boxed answer."""
    bare = text.strip()
    for opening in WRAPPERS:
        if bare.startswith(opening) and bare.endswith("}"):
            return bare[len(opening) : -1].strip()
    return bare


def candidate(text: str | None) -> str | None:
    """The content of the only answer block anywhere in the text."""
    found = re.findall(r"<answer>(.*?)</answer>", text or "", re.S)
    return (unwrapped(found[0]) or None) if len(found) == 1 else None


def _invalid(error: str) -> dict:
    return {"kind": "invalid", "valid": False, "has_think": False, "answer": None, "bbox": None, "error": error}


def _box(call: str, width: float, height: float) -> list[float] | str:
    """The box in pixels, or what is wrong with the call."""
    try:
        payload = json.loads(call)
    except (ValueError, RecursionError) as e:
        return f"invalid tool JSON: {e}"
    if not isinstance(payload, dict) or payload.get("name") != TOOL:
        return "unexpected tool name"
    arguments = payload.get("arguments")
    if not isinstance(arguments, dict) or list(arguments) != [ARGUMENT]:
        return "tool arguments must contain only bbox_2d"
    box = arguments[ARGUMENT]
    if not isinstance(box, list) or len(box) != 4:
        return "bbox_2d must contain four coordinates"
    if not all(type(v) in (int, float) for v in box):
        return "bbox coordinates must be numeric"
    try:
        left, top, right, bottom = map(float, box)
    except (OverflowError, ValueError):
        return "bbox coordinates are out of range"
    if not (0 <= left < right <= SPAN and 0 <= top < bottom <= SPAN):
        return "bbox is outside the 0-1000 coordinate space"
    return [left * width / SPAN, top * height / SPAN, right * width / SPAN, bottom * height / SPAN]


def parse(text: str | None, tool_allowed: bool = True, width: float = SPAN, height: float = SPAN) -> dict:
    """The action of one turn; an invalid one says what is wrong with it first."""
    if text is None:
        return _invalid("response is not text")
    if not text.startswith(THINK[0]):
        return _invalid("response must start with <think>")
    if [text.count(t) for t in THINK] != [1, 1]:
        return _invalid("response must contain one think block")
    turn = TURN.fullmatch(text)
    if not turn:
        return _invalid("response does not match answer or tool schema")
    is_answer = turn["answer"] is not None
    wanted, other = (ANSWER, CALL) if is_answer else (CALL, ANSWER)
    if [text.count(t) for t in (*wanted, *other)] != [1, 1, 0, 0]:
        return _invalid(f"response must contain one {'answer' if is_answer else 'tool'} action")
    if not is_answer and not tool_allowed:
        return _invalid("a second tool call is not allowed")
    if not says_something(turn["think"]):
        return _invalid("empty think block")
    valid = {"valid": True, "has_think": True, "error": None}
    if is_answer:
        answer = unwrapped(turn["answer"])
        return valid | {"kind": "answer", "answer": answer, "bbox": None} if answer else _invalid("empty answer block")
    box = _box(turn["call"], width, height)
    return _invalid(box) if isinstance(box, str) else valid | {"kind": "tool", "answer": None, "bbox": box}


@F.pandas_udf(RESULT)
def _parsed(text: pd.Series, allowed: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    rows = [parse(t, bool(a), w, h) for t, a, w, h in zip(text, allowed, width, height, strict=True)]
    return pd.DataFrame(rows, columns=list(_TYPES))


def parsed(text: Column | str, tool_allowed: Column | bool = True, width: Column | float = SPAN, height: Column | float = SPAN) -> Column:
    lit = lambda x, t: x if isinstance(x, Column) else F.lit(x).cast(t)
    return _parsed(text, lit(tool_allowed, "boolean"), lit(width, "double"), lit(height, "double"))


def unwrapped_of(text: Column | str) -> Column:
    """SCL10: a boxed answer's content, else the text, without outer white space."""
    inner = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)^\s+|\s+$", "")
    bare = inner
    for opening in reversed(WRAPPERS):
        content = F.regexp_replace(F.substring(inner, F.lit(len(opening) + 1), F.length(inner) - len(opening) - 1), r"(?U)^\s+|\s+$", "")
        bare = F.when(F.startswith(inner, F.lit(opening)) & F.endswith(inner, F.lit("}")), content).otherwise(bare)
    return bare


def answer_candidate(text: Column | str) -> Column:
    """SCL11 without Python: the only answer block anywhere, unwrapped; NULL for none or several."""
    text = F.col(text) if isinstance(text, str) else text
    bare = unwrapped_of(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1))
    return F.when((F.regexp_count(text, F.lit(r"(?s)<answer>.*?</answer>")) == 1) & (bare != ""), bare)


def says_something_of(text: Column | str) -> Column:
    """SCL09: NULL and blanks, dots or ellipses alone are nothing."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)[\s.…]", "")) > 0, F.lit(False))


def placeholders(text: Column | str) -> Column:
    """SCL14: image placeholders in a prompt."""
    return F.regexp_count(text, F.lit("<image>"))


def call_text(box: Column) -> Column:
    """PRJ11: a tool call as compact JSON."""
    return F.to_json(F.struct(F.lit(TOOL).alias("name"), F.struct(box.alias(ARGUMENT)).alias("arguments")))


def tagged(think: Column, content: Column, tags: tuple[str, str] = ANSWER) -> Column:
    """PRJ10: think block, blank line, tagged content."""
    return F.concat(F.lit(THINK[0]), think, F.lit(THINK[1] + "\n\n" + tags[0]), content, F.lit(tags[1]))

