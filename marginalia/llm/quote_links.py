"""Chat formatting: quotations are linked to their messages and taken out.

Each message is split into lines with a quote level (the number of ``>`` marks
before the text). Runs of lines of one level, with nothing blank between, are
its passages, normalised so that case, white space and wrapping don't matter. A
quoted passage is hashed and joined to the earliest message of the conversation
that wrote it itself. One that nobody wrote as a whole is tried by its pairs of
adjacent lines, so a part of a paragraph finds its writer, and a passage of one
line by that line. A message replies to the message that its outermost passages
match in most lines (the later one on ties); without a match to the message
before it, and the first of a conversation to none. Threads and depths follow
from these links by runs in blocks of turns and pointer doubling over their
heads, so a conversation as long as the table takes logarithmic rounds and no
single task. (thread, turn) orders a conversation so that replies follow what
they answer.

Defined cases: null text is empty; messages of a null conv_id or turn are kept
and answer nothing; repeated (conv_id, turn) rows share their links and are each
returned; quotes of nothing known are taken out and counted; a passage that a
message quotes twice at a level links once; lines of white space never link; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Turns in a window at most.
BLOCK = 1024
#: One class and no repeated group: Java's matcher recurses a level for each turn of a group.
MARKS = r"^[ \t>]*>"
#: A line that introduces a quotation, dropped with it.
ATTRIBUTION = r"(?i)^[ \t]*(on\b.{1,200}\bwrote|[^>]{1,80} (wrote|said)):[ \t]*$"


def normal_line(line):
    """Lower case, white space collapsed, quote marks removed."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def split_lines(text):
    """Array of (level, line) of a message."""
    level = lambda x: F.char_length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    return F.transform(F.split(text, "\r?\n", -1), lambda x: F.struct(level(x).alias("level"), x.alias("line")))


def unquoted(lines):
    """The message's own text: no quotes, and no attribution right before one."""
    last = F.size(lines) - 1

    def own(x, i):
        leads = (i < last) & x["line"].rlike(ATTRIBUTION) & (F.get(lines, F.least(i + 1, last))["level"] > 0)
        return (x["level"] == 0) & ~leads

    return F.btrim(F.array_join(F.transform(F.filter(lines, own), lambda x: x["line"]), "\n"), F.lit("\n"))


#: What a link rests on, best first: the whole passage, two adjacent lines, one line.
PASSAGE, PAIR, LINE = 0, 1, 2


def passages(text):
    """Array of (level, keys): runs of adjacent lines of one level that aren't blank, normalised."""
    lines = F.transform(split_lines(text), lambda x: F.struct(x["level"].alias("level"), normal_line(x["line"]).alias("key")))

    def cut(own):
        before = lambda i: F.get(own, F.greatest(i - 1, F.lit(0)))
        opens = lambda i: (F.get(own, i)["key"] != "") & ((i == 0) | (before(i)["key"] == "") | (before(i)["level"] != F.get(own, i)["level"]))
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), opens)

        def runs(at):
            keys = lambda s, j: F.transform(F.filter(F.slice(own, s + 1, F.coalesce(F.get(at, j + 1), F.size(own)) - s), lambda x: x["key"] != ""), lambda x: x["key"])
            return F.transform(at, lambda s, j: F.struct(F.get(own, s)["level"].alias("level"), keys(s, j).alias("keys")))

        return F.flatten(F.transform(F.array(starts), runs))

    return F.flatten(F.transform(F.array(lines), cut))


def _units(level, keys):
    """Array of (kind, key) that a passage can link by; quotes of one line alone go by lines."""
    whole = F.array(F.struct(F.lit(PASSAGE).alias("kind"), F.array_join(keys, " ").alias("key")))
    pairs = F.transform(F.slice(keys, 2, F.size(keys)), lambda k, i: F.struct(F.lit(PAIR).alias("kind"), F.concat(F.get(keys, i), F.lit("\n"), k).alias("key")))
    lines = F.transform(F.when((level == 0) | (F.size(keys) == 1), keys).otherwise(F.slice(keys, 1, 0)), lambda k: F.struct(F.lit(LINE).alias("kind"), k.alias("key")))
    return F.concat(whole, pairs, lines)


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, source, level, lines): quoted passages by the earlier message that wrote them."""
    runs = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(passages(F.coalesce("text", F.lit("")))).alias("r"))
    whole = F.array_join("r.keys", "\n")
    hashed = runs.select("conv_id", "turn", "r.level", F.size("r.keys").alias("size"), F.xxhash64(whole).alias("run1"), F.xxhash64(F.lit(3), whole).alias("run2"), F.explode(_units(F.col("r.level"), F.col("r.keys"))).alias("u"))
    hashed = hashed.select("conv_id", "turn", "level", "size", "run1", "run2", "u.kind", F.xxhash64("u.key").alias("h1"), F.xxhash64(F.lit(5), "u.key").alias("h2"))
    quoted = settle(hashed.where("level > 0").distinct(), "quoted")
    # Only keys that someone quotes, each once with its earliest writer.
    key = ["conv_id", "kind", "h1", "h2"]
    wanted = quoted.select(*key).distinct()
    first = hashed.where("level = 0").join(wanted, key, "left_semi").groupBy(*key).agg(F.min("turn").alias("source"))
    linked = quoted.join(settle(first, "quoted-first"), key).where("source < turn")
    run = ["conv_id", "turn", "level", "run1", "run2"]
    counted = linked.groupBy(*run, "size", "kind", "source").agg(F.count("*").alias("n"))
    # What a whole passage links to outdoes its parts.
    best = counted.groupBy(*run).agg(F.min("kind").alias("kind"))
    lines = F.when(F.col("kind") == PASSAGE, F.col("size")).when(F.col("kind") == PAIR, F.least(F.col("n") + 1, F.col("size"))).otherwise(1)
    return counted.join(best, [*run, "kind"]).groupBy("conv_id", "turn", "source", "level").agg(F.sum(lines.cast("long")).alias("lines"))


def threads(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) from (conv_id, turn, at, before, reply_to).

    Messages that answer the one before them hang in runs; a window over a block
    of ``BLOCK`` places finds the head of each run, so only heads (answers by
    quote, first messages, one a block) look further up. Each round doubles how
    far a head looks, until all have reached a message that answers nothing.
    """
    within = Window.partitionBy("conv_id", "block").orderBy("at")
    free = F.col("reply_to").isNull() | (F.col("reply_to") != F.col("before")) | (F.col("place") == 1)
    rows = parents.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("place", F.row_number().over(within))
    last = F.last(F.when(free, F.struct("turn", "place")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("h", last).select("conv_id", "turn", "reply_to", F.col("h.turn").alias("head"), (F.col("place") - F.col("h.place")).cast("long").alias("below"))
    rows = settle(rows, "runs")
    upper = rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("head").alias("jump"), (F.col("below") + 1).alias("depth"))
    heads = rows.where("turn = head").select("conv_id", "head", "reply_to")
    # jump: the head reached so far, null once the root is passed.
    now = heads.join(upper, (F.col("conv_id") == F.col("c")) & (F.col("reply_to") == F.col("t")), "left")
    now = settle(now.select("conv_id", "head", "jump", F.coalesce("jump", "head").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")), "heads")
    for _ in range(rounds):
        open_ = now.where("jump is not null")
        if not open_.limit(1).count():
            break
        up = now.select(F.col("conv_id").alias("c"), F.col("head").alias("t"), F.col("jump").alias("j"), F.col("thread").alias("r"), F.col("depth").alias("d"))
        on = open_.join(up, (F.col("conv_id") == F.col("c")) & (F.col("jump") == F.col("t")))
        moved = on.select("conv_id", "head", F.col("j").alias("jump"), F.col("r").alias("thread"), (F.col("depth") + F.col("d")).alias("depth"))
        now = settle(moved.unionByName(now.where("jump is null")), "heads")
    else:
        raise RuntimeError("threads did not settle")
    tops = now.select(F.col("conv_id").alias("c"), F.col("head").alias("t"), "thread", "depth")
    out = rows.join(tops, (F.col("conv_id") == F.col("c")) & (F.col("head") == F.col("t")))
    return out.select("conv_id", "turn", "reply_to", "thread", (F.col("depth") + F.col("below")).alias("depth"))


def previous(turns: DataFrame, top: int) -> DataFrame:
    """(conv_id, at, value, before) from distinct (conv_id, at, value), 0 <= at <= top.

    ``before`` is the value at the greatest smaller ``at`` of the conversation.
    Windows hold one block of ``BLOCK`` places; the first of a block asks the
    blocks' last values in the same way, so no window grows with a conversation.
    """
    within = Window.partitionBy("conv_id", "block").orderBy("at")
    ranked = turns.withColumn("block", F.floor(F.col("at") / BLOCK)).select("*", F.lag("value").over(within).alias("before"), F.lead("value").over(within).isNull().alias("last"))
    if top < BLOCK:
        return ranked.select("conv_id", "at", "value", "before")
    ranked = settle(ranked, "turn-blocks")
    above = previous(ranked.where("last").select("conv_id", F.col("block").alias("at"), "value"), top // BLOCK)
    above = above.select(F.col("conv_id").alias("c"), F.col("at").alias("b"), F.col("before").alias("lower"))
    firsts = ranked.where("before is null").join(above, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")), "left")
    out = ranked.where("before is not null").select("conv_id", "at", "value", "before")
    return out.unionByName(firsts.select("conv_id", "at", "value", F.col("lower").alias("before")))


def format_chat(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, thread, depth, quoted_lines, linked_lines, text)."""
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    links = link_quotes(own)
    replies = links.groupBy("conv_id", "turn").agg(F.max_by("source", F.struct(-F.col("level"), "lines", "source")).alias("quoted_turn"), F.sum("lines").alias("linked_lines"))
    keys = own.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    low, high = keys.agg(F.min("turn"), F.max("turn")).first()
    low = low or 0
    order = previous(keys.select("conv_id", (F.col("turn") - low).alias("at"), F.col("turn").alias("value")), (high or 0) - low)
    order = order.select("conv_id", "at", F.col("value").alias("turn"), "before")
    parents = settle(order.join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", "at", "before", F.coalesce("quoted_turn", "before").alias("reply_to"), F.coalesce("linked_lines", F.lit(0)).alias("linked_lines")), "parents")
    linked = threads(parents).join(parents.select("conv_id", "turn", "linked_lines"), ["conv_id", "turn"])
    lines = split_lines(F.col("text"))
    quoted = F.size(F.filter(lines, lambda x: x["level"] > 0)).cast("long")
    # Messages without a conversation or a turn answer nothing and meet in no join.
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    alone = own.where(~known).withColumns({c: F.lit(None).cast("long") for c in ("reply_to", "thread", "depth", "linked_lines")})
    out = own.where(known).join(linked, ["conv_id", "turn"], "left").unionByName(alone)
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        quoted.alias("quoted_lines"), F.coalesce("linked_lines", F.lit(0)).alias("linked_lines"), unquoted(lines).alias("text"),
    )
