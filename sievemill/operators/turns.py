"""Turns of trajectories for supervised tuning (PRJ08, PRJ09, PRJ12, SCL13, SCL57, AGG10, FLT10, SRC17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import actions, geometry

#: Prompts of the first and second turn; a project's own are parameters of ``turns``.
FIRST = "<image>\nQuestion: {question}\nSize of the picture: {width} by {height} pixels.\nThink, then answer or ask for one region."
SECOND = "<image>\n<image>\nThe second picture is the region asked for.\nQuestion: {question}\nThink, then answer."
# The stages of a route's turns.
STAGES = {"direct": ["decision"], "tool": ["decision", "answer_after_tool"]}
# Words in a question and the thought that goes with them; the thought without any; what is rewritten in thoughts.
THOUGHTS = {
    "The relevant table entry and its row or column context are small in the overview, so I should inspect the marked region.": ["table", "row", "column", "season", "player", "designation"],
    "The measurement marks need a closer look; I should inspect the marked region before reading the value.": ["measure", "length", "centimeter", "centimetre", "ruler", "diameter"],
    "The exact value needed for this question is a fine detail, so I should read it in the marked high-resolution region.": ["percentage", "percent", "share", "score", "how many", "number", "value", "total", "average", "attendance", "cost", "price", "amount"],
}
OTHER_THOUGHT = "The identifying text or detail is small in the overview, so I should inspect the marked high-resolution region."
REWRITTEN = ("marked region", "relevant region")


def prompt(template: str, question: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """PRJ09: the template with its fields; the question goes in last, so what looks like a field in it stays. NULL if a field is."""
    text = F.lit(template)
    for name, value in (("{width}", width), ("{height}", height), ("{question}", question)):
        if value is not None:
            text = F.replace(text, F.lit(name), value.cast("string"))
    return text


def thought(question: Column) -> Column:
    """SCL13: the thought for a question, by words anywhere in it."""
    text, out = F.lower(question), F.lit(OTHER_THOUGHT)
    for sentence, words in reversed(THOUGHTS.items()):
        has = F.lit(False)
        for w in words:
            has |= F.contains(text, F.lit(w))
        out = F.when(has, sentence).otherwise(out)
    return out


def rewritten(text: Column, pair: tuple[str, str] = REWRITTEN) -> tuple[Column, Column]:
    """PRJ12: the text with ``pair[0]`` replaced, and the log of edits: one entry if anything changed."""
    new = F.replace(text, F.lit(pair[0]), F.lit(pair[1]))
    note = F.lit(f"Replaced '{pair[0]}' with '{pair[1]}'.")
    none = F.array().cast("array<string>")
    return new, F.when(F.contains(text, F.lit(pair[0])), F.array(note)).otherwise(none)


def turns(trajectories: DataFrame, key: str, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """PRJ08: (key, route, turn_index, stage, prompt, images, target) of each turn.

    ``trajectories`` holds key, route (``tool`` or ``direct``), question, answer, low_path, crop_path, low_width, low_height, box (pixels),
    width and height. A missing answer is an empty one; a missing question has no prompt.
    """
    q, answer = F.col("question"), F.coalesce("answer", F.lit(""))
    call = actions.call_text(geometry.to_span(F.col("box"), F.col("width"), F.col("height")))
    think = rewritten(thought(F.coalesce("question", F.lit(""))))[0]
    decision = F.when(F.col("route") == "tool", actions.tagged(think, call, actions.CALL)).otherwise(actions.tagged(F.lit("The picture shows the answer."), answer))
    turn = lambda stage, text, images, target: F.struct(F.lit(stage).alias("stage"), text.alias("prompt"), images.alias("images"), target.alias("target"))
    one = turn(STAGES["tool"][0], prompt(first, q, F.col("low_width"), F.col("low_height")), F.array("low_path"), decision)
    two = turn(STAGES["tool"][1], prompt(second, q), F.array("low_path", "crop_path"), actions.tagged(F.lit("The region shows the answer."), answer))
    both = F.when(F.col("route") == "tool", F.array(one, two)).otherwise(F.array(one))
    return trajectories.select(key, "route", F.posexplode(both).alias("turn_index", "t")).select(key, "route", "turn_index", "t.*")


def loader_checks(rows: DataFrame, key: str) -> DataFrame:
    """SRC17: (rule, violations) over turns: unknown (route, turn, stage), repeated (key, turn), prompts whose placeholders aren't as many as their images, tool routes without a second turn."""
    known = F.lit(False)
    for route, stages in STAGES.items():
        for i, stage in enumerate(stages):
            known |= (F.col("route") == route) & (F.col("turn_index") == i) & (F.col("stage") == stage)
    n = lambda c: F.count(F.when(c, 1))
    one = rows.agg(n(~F.coalesce(known, F.lit(False))).alias("unknown turn"), n(~F.coalesce(actions.placeholders(F.col("prompt")) == F.size("images"), F.lit(False))).alias("placeholders"), (n((F.col("route") == "tool") & (F.col("turn_index") == 0)) - n((F.col("route") == "tool") & (F.col("turn_index") == 1))).alias("lone first turn"))
    twice = rows.groupBy(key, "turn_index").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("repeated turn"))
    table = one.join(twice)  # one row by one row
    return table.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("violations")) for c in table.columns])))


def drift() -> Column:
    """FLT10: the first way in which a trajectory differs from its source (s_question, s_answer, s_low_size, s_width, s_height, s_split, s_flag, s_eligible, s_box); NULL if it doesn't."""
    other = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    tool = F.col("route") == "tool"
    span = geometry.to_span(F.col("box"), F.col("width"), F.col("height"))
    executed = geometry.from_span(span, F.col("width"), F.col("height"))
    inside = (F.get(executed, F.lit(0)) <= F.get("box", F.lit(0))) & (F.get(executed, F.lit(1)) <= F.get("box", F.lit(1))) & (F.get(executed, F.lit(2)) >= F.get("box", F.lit(2))) & (F.get(executed, F.lit(3)) >= F.get("box", F.lit(3)))
    return (
        F.when(F.coalesce(F.col("s_split") != "train", F.lit(True)), "not a training source")
        .when(other("answer", "s_answer") | F.col("answer").isNull(), "gold answer")
        .when(other("question", "s_question"), "question")
        .when(other("low_size", "s_low_size") | other("width", "s_width") | other("height", "s_height"), "picture size")
        .when(tool & ~F.coalesce("s_flag", F.lit(False)), "no tool hint")
        .when(tool & ~F.coalesce("s_eligible", F.lit(False)), "no verified region")
        .when(tool & (F.col("box").isNull() | other("box", "s_box")), "source box")
        .when(tool & ~geometry.is_pixel_box(F.col("box"), F.col("width"), F.col("height")), "malformed box")
        .when(tool & ~F.coalesce(inside, F.lit(False)), "executed crop")
        .when(~tool & F.coalesce("s_flag", F.lit(True)), "unexpected tool hint")
    )


def inspected(text: str, finish: Column, tokens: Column, first: Column) -> list[Column]:
    """SCL57: the nine fields of a generation, of which ``parsed`` (column ``a``) gives three."""
    t = F.col(text)
    return [
        t.alias("raw_completion"),
        finish.alias("finish_reason"),
        tokens.alias("generated_tokens"),
        first.alias("first_token"),
        F.coalesce(F.startswith(t, F.lit("<think>")), F.lit(False)).alias("starts_with_think"),
        F.coalesce(F.contains(t, F.lit("</think>")), F.lit(False)).alias("has_closing_think"),
        F.col("a.valid").alias("valid_action"),
        F.col("a.kind").alias("action_kind"),
        F.col("a.error").alias("parse_error"),
    ]


def turn_summary(rows: DataFrame, key: str) -> DataFrame:
    """AGG10: count, five rates and means, and three histograms (JSON by name) of inspected turns, by ``key``.

    Counts by name first, so that a histogram is made of few rows.
    """
    names = ["action_kind", "finish_reason", "parse_error"]
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    plain = rows.groupBy(key).agg(
        F.count("*").alias("count"),
        rate(F.col("starts_with_think")).alias("starts_with_think_rate"),
        rate(F.col("has_closing_think")).alias("has_closing_think_rate"),
        rate(F.col("valid_action")).alias("valid_action_rate"),
        rate(F.col("finish_reason") == "length").alias("length_truncation_rate"),
        rate(F.col("generated_tokens")).alias("mean_generated_tokens"),
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("name")) for n in names])
    counted = rows.select(key, F.inline(pairs)).filter("name IS NOT NULL").groupBy(key, "what", "name").agg(F.count("*").alias("n"))
    entry = F.struct("name", "n")
    text = lambda n: F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("what") == n, entry)))))
    maps = counted.groupBy(F.col(key).alias("__key")).agg(*[text(n).alias(n + "s") for n in names])
    return plain.join(maps, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
