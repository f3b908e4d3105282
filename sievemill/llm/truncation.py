"""Problem 8: texts that were cut off, and how often each source cuts.

Word trigrams are counted inside texts (with what follows them) and at their ends, over all distinct
texts. The final trigram of each text is joined to these counts: it shows a cut if it is frequent inside
texts, almost never followed by the end of a sentence or line, and almost never final; or if its last word
is a beginning of words that are frequent after the two before it. Rare trigrams fall back to the last two
words, then to the last one. Numbers count as one word, punctuation marks and line breaks as words, and in
Chinese each character.

An exact check follows on the text's own structure (open tags, fences, brackets, JSON; always the whole text)
and on lengths at which texts of a source pile up: at such a limit weaker trigram evidence is enough.
Everything is Spark SQL; no text leaves the JVM, and none is shuffled unless copies are so many that the
list of them can't be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import Workspace

# A word of the trigrams: a Chinese character, a number, letters, line breaks with the blanks after them, any other mark.
LETTER = r"(?:[A-Za-z']++|[\p{L}\p{M}&&[^\p{IsHan}]])"
WORD = rf"{LETTER}++|\p{{Nd}}+(?:[.,:]\p{{Nd}}+)*|\n\s*|\S"
# Characters that end a sentence or line; white space; what a cut may leave behind.
STOPS = [".", "!", "?", "\u3002", "\uff01", "\uff1f", "\n"]
BLANKS = " \t\r\n\f\v\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200C))
MARKS = ["[...]", "[…]", "...", "…"]
LOST = "\ufffd"
TAGS = ["think", "answer", "tool_call"]

#: Occurrences from which a trigram's counts are believed, and those that make it frequent.
KNOWN, FREQUENT = 6, 20
#: Part of the occurrences inside texts that may be followed by a stop, and that may be final, for a cut.
RARELY = 0.02
#: Part that may be final if the last two words decide alone, since the trigram is rare.
RARELY_PAIR = 0.005
#: Final occurrences for each one before a stop from which on a text may as well end there without it.
UNSTOPPED = 0.003
#: Part of the occurrences that are final for an ending of its own.
ENDING = 0.15
#: A final word counts as cut if so many times more longer words begin with it.
LONGER = 5
#: Shortest length limit looked for, texts that must have it, and times the usual number for a length.
LIMIT_FROM, LIMIT_TEXTS, LIMIT_TIMES = 100, 6, 8.0
#: Characters by which a text may stay below a limit that cuts between words.
LIMIT_SLACK = 12
#: Characters at the end of a text in which its last words are looked for first, and of its end as it is taken apart first.
TAIL, END = 240, 400
#: Letters up to which the beginnings of words are counted; of longer ones only those with the same first ones are compared.
HEAD = 24
#: Copies whose doc_ids, 8 bytes each, are broadcast; more are left out by a shuffle.
BROADCAST_COPIES = 1 << 20


def words(text: Column) -> Column:
    """The words of a text; numbers as 0, line breaks as one."""
    number = lambda w: ((w >= "0") & (w < ":")) | ((w >= "\u0660") & w.rlike(r"^\p{Nd}"))
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(F.startswith(w, F.lit("\n")), "\n").when(number(w), "0").otherwise(w))


def _ends(text: Column, size: int) -> Column:
    return F.substring(text, -size, size)


def _not_blank(text: Column) -> Column:
    return text.rlike(f"[^{BLANKS}]")


def _parts(text: Column) -> tuple[Column, Column]:
    """(text without white space at its end, and that without an ellipsis and lost characters)."""
    whole = body = F.rtrim(text, F.lit(BLANKS))
    for mark in ("[...]", "[…]"):
        body = F.when(F.endswith(body, F.lit(mark)), F.left(body, F.length(body) - len(mark))).otherwise(body)
    dots = F.when(F.endswith(body, F.lit("...")), F.rtrim(body, F.lit("."))).otherwise(body)
    return whole, F.rtrim(dots, F.lit(BLANKS + "…" + LOST))


def _with_body(df: DataFrame) -> DataFrame:
    """Add end (the text's last characters without outer white space), last (that without an ellipsis and lost characters), marked and body (the text down to there).

    What is taken off is looked for in the last END characters; if nothing is left of these, in the whole text.
    """
    df = df.withColumn("tail", _ends(F.col("text"), END))
    df = df.withColumn("tail", F.when((_parts(F.col("tail"))[1] == "") & (F.length("text") > END), F.col("text")).otherwise(F.col("tail")))
    whole, last = _parts(F.col("tail"))
    marked = F.lit(False)
    for mark in MARKS:
        marked |= F.endswith("end", F.lit(mark))
    # One step after the other, so that none is evaluated again within the next.
    df = df.withColumns({"end": whole, "last": last})
    return df.withColumns({"marked": marked, "body": F.left("text", F.length("text") - F.length("tail") + F.length("last"))}).drop("tail")


def trigrams(texts: DataFrame) -> DataFrame:
    """(w1, w2, w3, inner, stopped, final) over ``texts`` (text), each counted once: occurrences inside texts, those before a stop, and at ends."""
    # White space before the first word would make line breaks there words.
    spoken = _with_body(texts.select("text")).select(F.concat(F.array(F.lit("^"), F.lit("^")), words(F.ltrim("body", F.lit(BLANKS)))).alias("w"))
    # An outer explode, since for another one the optimizer adds a filter that takes the words apart once more.
    place = F.explode_outer(F.when(F.size("w") > 2, F.sequence(F.lit(0), F.size("w") - 3))).alias("i")
    at = spoken.select("w", place).filter("i IS NOT NULL").select(F.get("w", F.col("i")).alias("w1"), F.get("w", F.col("i") + 1).alias("w2"), F.get("w", F.col("i") + 2).alias("w3"), F.get("w", F.col("i") + 3).alias("after"))
    inside = F.col("after").isNotNull()
    return at.groupBy("w1", "w2", "w3").agg(
        F.count("after").alias("inner"),
        F.count(F.when(inside & F.col("after").isin(STOPS), 1)).alias("stopped"),
        F.count(F.when(~inside, 1)).alias("final"),
    )


def _longer(own: DataFrame, wanted: DataFrame, context: list[str]) -> DataFrame:
    """(context, w3, longer): how often words occur inside texts that begin with w3 and are longer, after the same ``context``.

    Words are counted under each of their beginnings, so a join is of equal ones; no word meets all of its initial.
    """
    words_ = own.filter(F.col("w3").rlike(r"^\p{L}.") & (F.col("inner") > 0)).select(*context, F.col("w3").alias("word"), "inner")
    if context:
        words_ = words_.join(wanted.select(*context).distinct(), context, "left_semi")
    begins = F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("word") - 1)), lambda i: F.left(F.col("word"), i))
    short = words_.select(*context, F.explode(begins).alias("w3"), "inner").groupBy(*context, "w3").agg(F.sum("inner").alias("longer"))
    head = F.left("w3", F.lit(HEAD)).alias("head")
    long = wanted.filter(F.length("w3") > HEAD).select(*context, "w3", head)
    rest = words_.filter(F.length("word") > HEAD).select(*context, "word", "inner", F.left("word", F.lit(HEAD)).alias("head"))
    beyond = long.join(rest, [*context, "head"]).filter(F.startswith("word", F.col("w3")) & (F.length("word") > F.length("w3"))).groupBy(*context, "w3").agg(F.sum("inner").alias("longer"))
    return short.filter(F.length("w3") <= HEAD).unionByName(beyond)


def _counts(grams: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """For each of ``keys`` (w1, w2, w3): its counts in the last ``n`` words, and those of longer last words as ``longer``."""
    context = ["w1", "w2"][3 - n :]
    own = grams.groupBy(*context, "w3").agg(*[F.sum(c).alias(c) for c in ("inner", "stopped", "final")]) if n < 3 else grams
    wanted = keys.select(*context, "w3").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(f"{c}{n}") for c in ("inner", "stopped", "final", "longer")]
    return wanted.join(own, [*context, "w3"], "left").join(_longer(own, wanted, context), [*context, "w3"], "left").select(*context, "w3", *zero)


def _chosen(name: str) -> Column:
    """The count on the most words that are known together, else on the last one."""
    known = lambda n: F.col(f"inner{n}") + F.col(f"final{n}") + F.col(f"longer{n}") >= KNOWN
    return F.when(known(3), F.col(f"{name}3")).when(known(2), F.col(f"{name}2")).otherwise(F.col(f"{name}1"))


def verdicts(grams: DataFrame, keys: DataFrame) -> DataFrame:
    """(w1, w2, w3, mid_word, mid_sentence, ending, stopping) of the distinct final trigrams.

    mid_word: the last word is the beginning of longer ones. mid_sentence: frequent inside, hardly ever before
    a stop or at an end. ending: often at an end. stopping: often before a stop, and sometimes at an end instead.
    """
    keys = keys.select("w1", "w2", "w3").distinct()
    all_counts = keys
    for n in (3, 2, 1):
        all_counts = all_counts.join(_counts(grams, keys, n), ["w1", "w2", "w3"][3 - n :], "left")
    inner, stopped, final, longer = (_chosen(c) for c in ("inner", "stopped", "final", "longer"))
    together = F.col("inner3") + F.col("final3") + F.col("longer3") >= KNOWN
    several = together | (F.col("inner2") + F.col("final2") + F.col("longer2") >= KNOWN)
    ending = several & (final >= 2) & (final >= ENDING * (inner + final + longer))
    own = {3: 1, 2: 0}  # the text's own end says nothing about its trigram, but two words alone need more proof
    inside = lambda n, part: (F.col(f"inner{n}") >= FREQUENT) & (F.col(f"stopped{n}") < RARELY * F.col(f"inner{n}")) & (F.col(f"final{n}") - own[n] < part * F.col(f"inner{n}"))
    rare = (F.col("inner3") < FREQUENT) & (F.col("final3") <= 1)
    stopping = several & (stopped >= 0.3 * (inner + 1)) & (final >= 2) & (final >= UNSTOPPED * stopped)
    return all_counts.select(
        "w1",
        "w2",
        "w3",
        ending.alias("ending"),
        (~ending & (longer >= LONGER * (inner + 1)) & (longer > 3 * final)).alias("mid_word"),
        (~ending & (inside(3, RARELY) | (rare & inside(2, RARELY_PAIR)))).alias("mid_sentence"),
        stopping.alias("stopping"),
    )


def _structure() -> Column:
    """Whether the text stops inside its own structure: JSON, tags, a fence or a bracket."""
    text, end = F.col("text"), F.col("end")
    count = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))
    cut = F.startswith(F.ltrim(text, F.lit(BLANKS)), F.lit("{")) & ~F.endswith(end, F.lit("}"))
    tags = _ends(end, 20).rlike("<[/a-z_]*$")
    for tag in TAGS:
        opens, closes = f"<{tag}>", f"</{tag}>"
        tags |= (count(opens) / len(opens) > count(closes) / len(closes)) & ~F.endswith(end, F.lit(opens))
    cut |= F.contains(text, F.lit("<")) & tags
    cut |= F.contains(text, F.lit("```")) & (count("```") % 6 != 0)
    for opens, closes in ("()", "[]"):  # of the text's brackets of a kind, the last is an opening one
        cut |= F.contains(text, F.lit(opens)) & F.contains(F.substring_index("body", closes, -1), F.lit(opens))
    return cut


def limits(last: DataFrame) -> DataFrame:
    """(source, unit, size) of the lengths, in characters (unit c) or bytes (b), at which distinct texts of a source pile up.

    ``last`` holds (source, h1, h2, chars, bytes): two hashes of a text and its lengths.
    """
    sizes = F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("size")))
    each = last.select("source", "h1", "h2", "chars", "bytes").distinct().select("source", F.inline(sizes)).filter(F.col("size") >= LIMIT_FROM)
    counted = each.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    # Rows of a source here are its distinct lengths.
    beyond = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(3, 22)
    usual = F.coalesce(F.sum("n").over(beyond), F.lit(0)) / 20
    return counted.withColumn("usual", usual).filter((F.col("n") >= LIMIT_TEXTS) & (F.col("n") > LIMIT_TIMES * (F.col("usual") + 0.3))).select("source", "unit", "size")


def endings(documents: DataFrame) -> DataFrame:
    """One row a document whose text isn't blank: two hashes of the text, its lengths, its last three words and what its structure shows."""
    texts = _with_body(documents.select("doc_id", "source", "text").filter(_not_blank(F.col("text"))))
    texts = texts.withColumn("near", words(_ends(F.col("last"), TAIL)))  # five words of the tail, or else all, hold the last four in full
    texts = texts.withColumn("w", F.when((F.size("near") >= 5) | ((F.length("last") <= TAIL) & (F.length("last") == F.length("body"))), F.col("near")).otherwise(words(F.col("body"))))
    word = lambda i: F.coalesce(F.try_element_at("w", F.lit(-i)), F.lit("^"))
    return texts.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(1), "text").alias("h2"),
        word(3).alias("w1"),
        word(2).alias("w2"),
        word(1).alias("w3"),
        (F.size("w") >= 5).alias("enough"),
        "marked",
        F.endswith("end", F.lit(LOST)).alias("lost"),
        _structure().alias("structure"),
        F.length("text").alias("chars"),
        F.octet_length("text").alias("bytes"),
    )


def without_copies(documents: DataFrame, last: DataFrame, work: Workspace) -> DataFrame:
    """``documents`` with one of each text that isn't blank, that of the smallest doc_id; texts are equal if both hashes are."""
    first = last.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    n = Observation()
    copies = last.join(first, ["h1", "h2"]).filter(F.col("doc_id") > F.col("first")).select("doc_id")
    copies = work.save(copies.observe(n, F.count("*").alias("n")), "copies")
    listed = F.broadcast(copies) if n.get["n"] <= BROADCAST_COPIES else copies
    return documents.select("doc_id", "text").filter(_not_blank(F.col("text"))).join(listed, "doc_id", "left_anti")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, evidence, by_trigrams) of every document with a text that isn't blank.

    evidence is the first that holds of mid_word, mid_sentence, lost_character, structure, limit; NULL if none. by_trigrams tells
    of the first two. Texts of fewer than five words are judged by structure and lost characters only: their final trigram
    is the whole text. A NULL source is a source of its own. Copies of a text are judged alike within a source.
    """
    work = Workspace(documents.sparkSession, "truncation")
    last = work.save(endings(documents), "last")
    grams = work.save(trigrams(without_copies(documents, last, work)), "trigrams")
    size = work.save(limits(last), "limits")
    chars = size.filter("unit = 'c'").select(F.col("source").alias("s"), F.explode(F.sequence(F.col("size") - LIMIT_SLACK, "size")).alias("chars"), F.lit(True).alias("at_chars")).distinct()
    # A byte limit may drop the rest of a character of up to four bytes.
    bytes_ = size.filter("unit = 'b'").select(F.col("source").alias("s"), F.explode(F.sequence(F.col("size") - 3, "size")).alias("bytes"), F.lit(True).alias("at_bytes")).distinct()
    joined = last.join(verdicts(grams, last), ["w1", "w2", "w3"], "left")
    joined = joined.join(chars, joined["source"].eqNullSafe(chars["s"]) & (joined["chars"] == chars["chars"]), "left").drop("s", chars["chars"])
    joined = joined.join(bytes_, joined["source"].eqNullSafe(bytes_["s"]) & (joined["bytes"] == bytes_["bytes"]), "left").drop("s", bytes_["bytes"])
    at_limit = F.coalesce("at_chars", "at_bytes", F.lit(False))
    stops = F.col("w3").isin(STOPS)
    by_words = F.col("enough") & ~stops
    at_end = F.coalesce("ending", F.lit(False)) | (F.coalesce("stopping", F.lit(False)) & ~F.col("marked"))
    evidence = (
        F.when(by_words & F.col("mid_word"), "mid_word")
        .when(by_words & F.col("mid_sentence"), "mid_sentence")
        .when(F.col("lost"), "lost_character")
        .when(F.col("structure"), "structure")
        .when(F.col("enough") & at_limit & ((~stops & ~at_end) | (stops & F.col("marked"))), "limit")
    )
    return joined.select("doc_id", "source", evidence.alias("evidence")).select("doc_id", "source", F.col("evidence").isNotNull().alias("cut"), "evidence", F.coalesce(F.col("evidence").isin("mid_word", "mid_sentence"), F.lit(False)).alias("by_trigrams"))


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text was cut off."""
    return judged(documents).filter("cut").select("doc_id")


def by_source(documents: DataFrame) -> DataFrame:
    """(source, texts, cut, share) of each source."""
    return judged(documents).groupBy("source").agg(F.count("*").alias("texts"), F.count(F.when(F.col("cut"), 1)).alias("cut")).withColumn("share", F.col("cut") / F.col("texts"))


def by_evidence(documents: DataFrame) -> DataFrame:
    """(evidence, texts) of the cut texts: what found them first."""
    return judged(documents).filter("cut").groupBy("evidence").agg(F.count("*").alias("texts"))
