"""Chat formatting by linking quotations to the messages they quote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import durable

#: Turns of a conversation are put in order in stretches of so many, so that no sort holds a whole conversation.
STRETCH = 4096
QUOTE = r"^[ \t]*(?:>[ \t]?)+"
#: The line that mail programs put before a quotation.
ATTRIBUTION = r"^[ \t]*(On\b.*\bwrote:|Am\b.*\bschrieb.*:|Le\b.*\ba écrit ?:|El\b.*\bescribió:)[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds ``_lines``: per line its quote level and its text without marks."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, QUOTE, 0)
        level = F.length(marks) - F.length(F.translate(marks, ">", ""))
        return F.struct(level.alias("level"), F.regexp_replace(line, QUOTE, "").alias("text"))

    return messages.withColumn("_lines", F.transform(lines, parse))


def _own_text(parsed: Column) -> Column:
    """The lines without quote marks, less attributions directly before a quotation, blank runs folded."""
    keep = F.filter(parsed, lambda x, i: (x["level"] == 0) & ~(x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(parsed, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(keep, lambda x: x["text"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _passages(parsed: DataFrame) -> DataFrame:
    """Every passage of every message: ``conv_id, turn, level, whole, hash``.

    Lines are passages, and so are runs of lines of one level between blank lines or other levels, and the whole text of
    each level (``whole``: 0 line, 1 run, 2 all). Level 0 is a message's own text.
    """
    rows = parsed.select("conv_id", "turn", F.posexplode_outer("_lines").alias("no", "line"))
    rows = rows.select("conv_id", "turn", "no", "line.level", normalised(F.col("line.text")).alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("no")
    broken = (F.col("level") != F.lag("level", 1, -1).over(order)) | (F.col("text") == "") | (F.lag("text", 1, "").over(order) == "")
    rows = rows.withColumn("run", F.sum(broken.cast("int")).over(order)).where("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), " ").alias("text")
    runs = rows.groupBy("conv_id", "turn", "level", "run").agg(joined).select("conv_id", "turn", "level", F.lit(1).alias("whole"), "text")
    every = rows.groupBy("conv_id", "turn", "level").agg(joined).select("conv_id", "turn", "level", F.lit(2).alias("whole"), "text")
    lines = rows.select("conv_id", "turn", "level", F.lit(0).alias("whole"), "text")
    hashed = lines.unionByName(runs).unionByName(every)
    return hashed.select("conv_id", "turn", "level", "whole", F.md5("text").alias("hash")).distinct()


def _previous(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, previous`` of distinct messages: the next smaller turn of the conversation."""
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    lasts = turns.groupBy("conv_id", "stretch").agg(F.max("turn").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("carried", F.max("last").over(before)).drop("last")
    within = Window.partitionBy("conv_id", "stretch").orderBy("turn")
    turns = turns.withColumn("own", F.lag("turn").over(within))
    return turns.join(lasts, ["conv_id", "stretch"]).select("conv_id", "turn", F.coalesce("own", "carried").alias("previous"))


def link_quotations(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """Reply structure of conversations: the rows of ``messages`` without quotations, and what each replies to.

    ``messages``: ``conv_id, turn, role, text``. Lines are parsed into nested quote levels by their ``>`` marks. Passages
    (lines, runs, whole texts) are normalised (lower case, white space folded) and hashed; a quoted passage is joined to the
    latest earlier message of its conversation that has it in its own text. A message replies to the one that its outermost
    quotation leads to (of several, the one linked by the largest passage, then the latest); one without a linked
    quotation replies to the message before it. Adds ``parent_turn``, ``root_turn``, ``depth``, ``n_quoted`` (quoted lines) and ``linked`` (by
    quotation) and replaces ``text`` by the message's own words; ordered by (conv_id, root_turn, depth, turn) every reply
    comes after what it answers.

    The latest earlier message is found along each passage's own rows, never by pairing quotations with originals; chains of replies are
    followed by pointer doubling with a written table for each round. A null text counts as empty; rows without
    conv_id or turn stay, without links; rows repeated for one turn share its links, which come from all of their texts.
    Other columns stay, those named like a result are replaced. An empty table gives no rows.
    """
    base = messages.drop("parent_turn", "root_turn", "depth", "n_quoted", "linked")
    parsed = _parsed(base)
    known = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "_lines")
    turns = known.select("conv_id", "turn").distinct()
    passages = durable(_passages(known.where(F.exists("_lines", lambda x: F.trim(x["text"]) != ""))), "chat-passages")
    # only what some message of the conversation quotes can be an original
    quoted = passages.where("level > 0")
    asked = quoted.select("conv_id", "hash").distinct()
    originals = passages.where("level = 0").join(asked, ["conv_id", "hash"], "left_semi")
    # along stretches of turns, so that a passage that fills a conversation is in no single window
    both = quoted.unionByName(originals).withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    own = F.when(F.col("level") == 0, F.col("turn"))
    stretches = Window.partitionBy("conv_id", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy("conv_id", "hash", "stretch").agg(F.max(own).alias("last")).withColumn("before", F.max("last").over(stretches)).where("before is not null").drop("last")
    along = Window.partitionBy("conv_id", "hash", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("here", F.max(own).over(along)).join(before, ["conv_id", "hash", "stretch"], "left").withColumn("source", F.coalesce("here", "before"))
    hits = both.where("level > 0 and source is not null")
    best = hits.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "whole", "source")).alias("best"))
    links = best.select("conv_id", "turn", F.col("best.source").alias("quoted_turn"))
    tree = _previous(turns).join(links, ["conv_id", "turn"], "left")
    tree = tree.select("conv_id", "turn", F.coalesce("quoted_turn", "previous").alias("parent"), F.col("quoted_turn").isNotNull().alias("linked"))
    tree = durable(tree, "chat-tree")
    # up: the ancestor reached so far, as far away as steps; rows that have reached a root settle and take no further part
    root = F.col("parent").isNull()
    state = durable(tree.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), (~root).cast("bigint").alias("steps"), root.alias("done")), "chat-jump")
    jump, moving = state.where("done"), state.where("not done")
    for _ in range(rounds):
        far = jump.unionByName(moving).select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("done").alias("there"))
        step = moving.join(far, ["conv_id", "up"])
        step = durable(step.select("conv_id", "turn", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done")), "chat-jump")
        jump, moving = jump.unionByName(step.where("done")), step.where("not done")
        if not moving.limit(1).count():
            break
    placed = tree.join(jump, ["conv_id", "turn"]).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("parent").alias("parent_turn"), F.col("up").alias("root_turn"), F.col("steps").alias("depth"), "linked")
    out = parsed.withColumns({"text": _own_text(F.col("_lines")), "n_quoted": F.size(F.filter("_lines", lambda x: x["level"] > 0))})
    out = out.join(placed, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t", "_lines")
    return out.withColumn("linked", F.coalesce("linked", F.lit(False)))
