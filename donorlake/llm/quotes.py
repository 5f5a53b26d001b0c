"""Conversations in reply order without quotes, by quotation linking.

Lines that start with ``>`` are quotes; the number of marks is the quote's
level. Consecutive lines of one level are a passage. A passage is linked through
the hashes of its normalised units (its lines, and the passage as a whole) to
the message of the conversation that first wrote such a unit itself, unquoted
(its lines, and its own words as a whole), in an earlier turn. A message replies
to the source with the most matched characters at the shallowest linked level
(ties: the later turn). Following replies to their end gives the root, and a
conversation is ordered by (turn of the root, turn): every reply stands in the
thread it answers. Content is what a message wrote itself; a line ending in
"wrote:" right before a quote goes with it.

All steps are DataFrame functions: lines and passages stay arrays inside their
row, the first author of a unit is a partial aggregate with one row per unit,
so a unit quoted by a third of all messages meets one row, and positions come
from range partitions, not from one window per conversation.

Rows: equal rows count once; messages with NULL conv_id or turn have no links
and are their own roots; NULL texts have empty content; a NULL role is written
as "unknown"; of messages that share conv_id and turn (ties) none is the other's
reply, each has links of its own, a unit that two of them wrote is the one's with the
smaller hash of role and text, and they are ordered by role and text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorlake.llm.text import written
from donorlake.operators.ordering import global_rank
from donorlake.session import durable


def _normal(body: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(body, r"[ \t\r\f\x0B]+", " ")))


def _line(line: Column) -> Column:
    level = F.length(F.regexp_replace(F.regexp_extract(line, r"^(?:[ \t]*>)*", 0), "[^>]", ""))
    body = F.regexp_replace(line, r"^(?:[ \t]*>)+[ \t]?", "")
    return F.struct(level.cast("int").alias("level"), body.alias("body"), _normal(body).alias("norm"))


def parsed(messages: DataFrame) -> DataFrame:
    """Every message once, with its lines (level, body, normalised body) and what it wrote itself."""
    rows = messages.select("conv_id", "turn", "role", "text").distinct()
    who = F.coalesce(F.concat(F.length("role").cast("string"), F.lit(":"), "role"), F.lit("-"))
    rows = rows.withColumn("mid", F.md5(F.concat(who, F.coalesce(F.concat(F.lit(":"), "text"), F.lit("-")))))  # tells messages of one turn apart
    lines = rows.withColumn("lines", F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), _line))
    after = lambda i: F.try_element_at("lines", i + 2)["level"]
    credit = lambda x, i: x["norm"].endswith("wrote:") & (F.coalesce(after(i), F.lit(0)) > 0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~credit(x, i))
    return lines.withColumn("own", own).withColumn("content", F.trim(F.array_join(F.transform("own", lambda x: x["body"]), "\n"), F.lit(" \t\r\n")))


def own_units(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, hash`` of the units that a message wrote itself."""
    norms = F.transform("own", lambda x: x["norm"])
    units = F.array_append(norms, _joined(norms))
    units = rows.select("conv_id", "turn", "mid", F.explode(F.array_distinct(units)).alias("unit")).where("unit <> ''")
    return units.select("conv_id", "turn", "mid", F.md5("unit").alias("hash"))


def _joined(norms: Column) -> Column:
    return F.array_join(F.filter(norms, lambda x: x != ""), " ")


def quoted_units(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, mid, level, hash, size`` of the units of quoted passages."""
    # A passage starts where the level changes; its lines are those up to the next change.
    n = F.size("lines")
    level = lambda i: F.element_at("lines", i)["level"]
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (level(i) > 0) & ((i == 1) | (level(F.greatest(i - 1, F.lit(1))) != level(i))))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (level(i) > 0) & ((i == n) | (level(F.least(i + 1, n)) != level(i))))
    passages = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.slice("lines", p["a"], p["b"] - p["a"] + 1))
    some = rows.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id", "turn", "mid", "lines", F.explode(passages).alias("passage"))
    norms = F.transform("passage", lambda x: x["norm"])
    units = some.select("conv_id", "turn", "mid", F.element_at("passage", 1)["level"].alias("level"), F.explode(F.array_distinct(F.array_append(norms, _joined(norms)))).alias("unit"))
    return units.where("unit <> ''").select("conv_id", "turn", "mid", "level", F.md5("unit").alias("hash"), F.length("unit").alias("size"))


def reply_links(rows: DataFrame) -> DataFrame:
    """``conv_id, mid, parent_turn, parent``: the message that each quoting message replies to."""
    first = F.min(F.struct(F.col("turn").alias("source"), F.col("mid").alias("parent"))).alias("a")
    authors = own_units(rows).where("turn IS NOT NULL").groupBy("conv_id", "hash").agg(first)
    authors = written(authors.select("conv_id", "hash", "a.source", "a.parent"), "quote-authors")
    found = quoted_units(rows).join(authors, ["conv_id", "hash"]).where("source < turn")
    weights = found.groupBy("conv_id", "mid", "turn", "level", "source", "parent").agg(F.sum("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "size", "source", "parent")).alias("b")
    links = weights.groupBy("conv_id", "turn", "mid").agg(best)
    return links.select("conv_id", "turn", "mid", F.col("b.source").alias("parent_turn"), "b.parent")


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Add ``root_turn``: the end of the chain of replies. Every round doubles the steps that are taken."""
    state = durable(links.select("*", F.col("parent_turn").alias("root_turn"), F.col("parent").alias("root")))
    for _ in range(max_rounds):
        onward = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("mid").alias("root"), F.col("root_turn").alias("further_turn"), F.col("root").alias("further"))
        stepped = durable(state.join(onward, ["conv_id", "root_turn", "root"], "left"))
        moved = not stepped.where("further IS NOT NULL").isEmpty()
        state = stepped.select("conv_id", "turn", "mid", "parent_turn", F.coalesce("further_turn", "root_turn").alias("root_turn"), F.coalesce("further", "root").alias("root"))
        if not moved:
            return state.drop("root")
    raise RuntimeError("chains of replies are longer than 2 ** 64")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``conv_id, position, turn, role, parent_turn, root_turn, quote_level, content, chat`` of every message."""
    rows = parsed(messages)
    placed = rows.join(roots(reply_links(rows)), ["conv_id", "turn", "mid"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn"))
    deepest = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))
    role = F.coalesce("role", F.lit("unknown"))
    chat = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("content"))
    slim = placed.select("conv_id", "turn", "role", "text", "parent_turn", "root_turn", deepest.alias("quote_level"), "content", chat.alias("chat"))
    known = slim.where("conv_id IS NOT NULL")
    ranked = global_rank(known, ["root_turn", "turn", "role", "text"], by=["conv_id"], name="position")
    alone = slim.where("conv_id IS NULL").withColumn("position", F.lit(1).cast("bigint"))
    names = ["conv_id", "position", "turn", "role", "parent_turn", "root_turn", "quote_level", "content", "chat"]
    return ranked.select(*names).unionByName(alone.select(*names))
