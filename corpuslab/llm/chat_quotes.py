"""Chat formatting [DataFrame functions only]: quotation linking.

Lines that start with one or more > are quotes; their number is the level. A passage is a run of lines of one level
without a blank line. It is normalised (lower case, one space between words) and hashed, and so are its lines of
three words or more if it has several. Quoted hashes are joined to what messages of the same conversation
wrote themselves (level 0), texts compared; the first message that wrote it is the source, if it is an earlier one.

A quoted passage is linked to the source of the whole passage, else to the source of most words of its lines (ties: the
latest). A message replies to the source of its passages of the lowest linked level; of several, to that of which all
its linked passages have most words (ties: the latest). Following replies to their start gives the thread, their number
the level. Reply order is (thread, level, turn): a message stands before its replies, a thread in one
piece, threads by their first turn. Quotes and the lines that introduce them are removed.

What messages wrote is reduced to one turn a passage before the join, so a line that many messages share joins once, not in pairs.

Defined results
  null text            the empty text
  null conv_id or turn carried; never linked
  repeated rows        rows that share conv_id and turn are one message: each is returned, with the links of all
  ties                 as above
  empty table          empty result
  extra columns        ignored
  very long texts      whole; a text of many lines stays linear a level
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.shared import materialise, maybe_broadcast

QUOTE = r"^(?:[ \t]*>)+"
#: Lines that introduce a quote.
ATTRIBUTION = r"^(?:On|Am|Le|El) .*(?:wrote|schrieb|a écrit|escribió)\s*:?\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(text: Column) -> Column:
    """Array of (level, body)."""
    prefix = lambda x: F.regexp_extract(x, QUOTE, 0)
    level = lambda x: F.length(F.regexp_replace(prefix(x), r"[ \t]", ""))
    body = lambda x: F.substring(x, F.length(prefix(x)) + 1, F.length(x))
    return F.transform(F.split(text, r"\r?\n", -1), lambda x: F.struct(level(x).alias("level"), body(x).alias("body")))


def _passages(lines: Column, level: Column) -> Column:
    joined = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, F.trim(x["body"])).otherwise("")), "\n")
    return F.filter(F.split(joined, r"\n\s*\n"), lambda p: F.trim(p) != "")


def _units(messages: DataFrame, levels: Column) -> DataFrame:
    """(conv_id, turn, k, level, p, line, unit, h, words): each passage p of the given levels (line 0) and its lines."""
    at_level = messages.select("conv_id", "turn", "k", "lines", F.explode(levels).alias("level"))
    passages = at_level.select("conv_id", "turn", "k", "level", F.posexplode(_passages(F.col("lines"), F.col("level"))).alias("p", "passage"))
    rows = F.filter(F.split(F.trim("passage"), "\n"), lambda x: F.trim(x) != "")
    long = lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 3
    unit = lambda line, x: F.struct(line.alias("line"), _normal(x).alias("unit"))
    lines = F.transform(F.when(F.size(rows) > 1, F.filter(rows, long)).otherwise(F.array().cast("array<string>")), lambda x, i: unit(i + 1, x))
    units = passages.select("conv_id", "turn", "k", "level", "p", F.inline(F.concat(F.array(unit(F.lit(0), F.col("passage"))), lines)))
    return units.select("*", F.unhex(F.md5("unit")).alias("h"), F.size(F.split("unit", " ")).alias("words"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per input row: conv_id, turn, role, text (without quotes), n_quotes (quoted passages of the row), n_linked (of them
    with a source), reply_to (turn or null), thread (turn that the chain of replies starts from), level (replies up to it)."""
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("raw"))
    known = base.select("*", F.col("raw").rlike(r"(?m)^[ \t]*>").alias("quoted"), _parsed(F.col("raw")).alias("lines"), F.unhex(F.md5("raw")).alias("k"))
    out = known.select("conv_id", "turn", "role", F.when(F.col("quoted"), _without(F.col("lines"))).otherwise(F.col("raw")).alias("text"), _count_quotes().alias("n_quotes"), "k")
    placed = known.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    deeper = F.filter(F.array_distinct(F.transform("lines", lambda x: x["level"])), lambda v: v > 0)
    quotes = materialise(_units(placed.filter("quoted"), deeper).distinct(), "quotes")
    convs = materialise(quotes.select("conv_id").distinct(), "convs")
    wrote = placed.join(maybe_broadcast(convs, convs.count()), "conv_id", "left_semi")
    first = _units(wrote, F.array(F.lit(0))).groupBy("conv_id", "h", "unit").agg(F.min("turn").alias("source"))
    hits = quotes.join(materialise(first, "originals"), ["conv_id", "h", "unit"]).filter("source < turn")

    message, passage = ["conv_id", "turn"], ["conv_id", "turn", "k", "level", "p"]
    whole, in_lines = F.max(F.when(F.col("line") == 0, F.col("words"))), F.sum(F.when(F.col("line") > 0, F.col("words")))
    by_source = hits.groupBy(*passage, "source").agg(whole.alias("whole"), in_lines.alias("in_lines"))
    by_source = by_source.select(*passage, "source", F.col("whole").isNotNull().alias("is_whole"), F.coalesce("whole", "in_lines").alias("words"))
    best = by_source.groupBy(*passage).agg(F.max(F.struct("is_whole", "words", "source")).alias("best"))
    linked = materialise(best.select(*passage, "best.words", "best.source"), "linked")
    counts = linked.groupBy(*message, "k").agg(F.count("*").alias("n_linked"))
    sources = linked.groupBy(*message, "source").agg(F.min("level").alias("low"), F.sum("words").alias("words"))
    replies = materialise(sources.groupBy(*message).agg(F.max_by("source", F.struct(-F.col("low"), "words", "source")).alias("reply_to")), "replies")
    chains = _threads(replies).join(replies, message)
    joined = out.join(materialise(chains, "chains"), message, "left").join(counts, [*message, "k"], "left")
    return joined.select(
        "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("level", F.lit(0)).alias("level"),
    )


def _without(lines: Column) -> Column:
    """Level 0 lines, without lines that introduce a quote; blank runs become one blank line."""
    quoted_next = lambda i: F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(quoted_next(i) & x["body"].rlike(ATTRIBUTION)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"\n\s*\n(\s*\n)+", "\n\n"), r"^\s+|\s+$", ""))


def _count_quotes() -> Column:
    """Quoted passages, over all levels."""
    levels = F.filter(F.array_distinct(F.transform("lines", lambda x: x["level"])), lambda v: v > 0)
    return F.when(F.col("quoted"), F.aggregate(levels, F.lit(0), lambda a, v: a + F.size(_passages(F.col("lines"), v)))).otherwise(0).cast("bigint")


def _threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread, level) by doubling: each round a link jumps as far again as before."""
    now = links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).alias("level"))
    for _ in range(max_rounds):
        now = materialise(now, "threads")
        on = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("level").alias("more"))
        stepped = now.join(on, ["conv_id", "thread"], "left")
        if not stepped.filter("next is not null").limit(1).count():
            return now
        now = stepped.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
    raise RuntimeError("threads: not settled")


def chat_format(linked: DataFrame, start: str = "<|", end: str = "|>") -> DataFrame:
    """The rows of `link_quotes` with `message`, one turn of a chat template; in the order of conv_id, thread, level, turn they are the conversation."""
    return linked.withColumn("message", F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit(end + "\n"), F.col("text")))
