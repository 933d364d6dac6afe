"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct runs of SHINGLE words. The join goes through these steps, none of which loses a pair:

1. Lines of equal words form a class, told apart by 128 bits; only its first line joins on.
2. In the order of their hashes, of a line's n tokens the first ``n - ceil(NUM n / DEN) + EXTRA`` are emitted: similar lines
   have EXTRA of these in common. Tokens are counted exactly over all classes, and those of a single one are dropped.
3. A line's emitted tokens are put in order of rarity by these counts, and the commonest EXTRA - 1 are left out: with
   EXTRA in common, one of the others is still shared (the prefix filter). Length filter, positional filter and a
   bound on the symmetric difference from 256 parity bits are checked as two lines meet at a token.
4. Each line is first compared with two lines of each of its tokens, the earliest and one that a hash picks; that settles
   families of copies without their pairs. Lines left are compared with all earlier ones. Pairs that pass are verified by their
   whole token sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch, filter_frame, maybe_in

SHINGLE = 5
#: Lines match at a Jaccard similarity of NUM / DEN or more; kept as integers so that every bound is exact.
NUM, DEN = 4, 5
#: Common tokens that similar lines have among those emitted (or all tokens, if a line has fewer).
EXTRA = 3
#: Words of 64 parity bits.
WORDS = 4
#: Runs of words in a block, and blocks at most, that are written out instead of looped over.
BLOCK, BLOCKS = 16, 16


def _odd(text: Column) -> Column:
    """Whether the text has other white space than line breaks and single spaces within lines."""
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for mark in ("  ", "\t", "\x0b", "\x0c", "\r", " \n", "\n "):
        odd = odd | F.contains(text, F.lit(mark))
    return odd


def _evened(text: Column) -> Column:
    """Text with single spaces between the words of a line and none around it; line breaks stay."""
    folded = F.regexp_replace(text, r"[ \t\x0B-\r]+", " ")
    return F.trim(F.regexp_replace(folded, " ?\n ?", "\n"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def text_lines(texts: DataFrame, even: bool = False) -> DataFrame:
    """``doc_id, key, odd, line_no, line`` of every line that has a word, lower-cased and made even: equal words give equal lines.

    ``odd`` tells whether its text had to be made even, which texts without odd white space, mostly, need no pattern for. ``even`` says
    that no text has to be; then none is looked through.
    """
    texts = texts.withColumn("odd", F.lit(False) if even else _odd(F.col("text")))
    text = F.col("text") if even else F.when(F.col("odd"), _evened(F.col("text"))).otherwise(F.col("text"))
    lines = texts.select("doc_id", "key", "odd", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where("line <> ''").withColumn("line", F.lower("line"))


def _ids() -> dict[str, Column]:
    """128 bits that tell classes of equal lines apart."""
    return {"id": F.xxhash64("line"), "more": F.xxhash64(F.lit(1), "line")}


def _no_tokens() -> Column:
    """An empty array that, as the arrays of hashes do, holds no null by its type, so that these are sorted as plain numbers."""
    return F.slice(F.array(F.lit(0).cast("bigint")), 1, 0)


def with_tokens(lines: DataFrame) -> DataFrame:
    """Replaces ``line`` by ``tokens``: sorted hashes of the distinct runs of SHINGLE words, none for a shorter line.

    The runs of a line with at most BLOCK * BLOCKS are written out one by one, in blocks of which it makes those it needs: Spark compiles
    these, while it interprets the function of ``transform``, which longer lines take, word by word.
    """
    hashed = lines.withColumn("words", F.split("line", " ")).drop("line").withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words") - (SHINGLE - 1)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("xxhash64", *[F.get(F.col("words"), i + k) for k in range(SHINGLE)]))
    block = lambda first: F.array(*[F.xxhash64(F.slice("words", first + i + 1, SHINGLE)) for i in range(BLOCK)])
    blocks = [F.when(n > first, block(first)).otherwise(_no_tokens()) for first in range(0, BLOCK * BLOCKS, BLOCK)]
    runs = F.when(n <= 0, _no_tokens()).when(n > BLOCK * BLOCKS, each).otherwise(F.slice(F.concat(*blocks), F.lit(1), n))
    made = hashed.withColumn("tokens", runs).drop("words")
    return made.withColumn("tokens", F.sort_array(F.array_distinct("tokens")))


def _parities(sets: DataFrame) -> DataFrame:
    """``id`` and 256 bits as WORDS columns: whether the number of tokens whose hash ends in each of 256 values is odd."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    bit, word = F.call_function("shiftleft", one, F.col("t").bitwiseAND(F.lit(63)).cast("int")), F.shiftright("t", 6).bitwiseAND(F.lit(WORDS - 1))
    tokens = sets.select("id", F.explode("tokens").alias("t"))
    return tokens.groupBy("id").agg(*[F.bit_xor(F.when(word == k, bit).otherwise(none)).alias(f"p{k}") for k in range(WORDS)])


def _classes(docs: DataFrame) -> DataFrame:
    """One row for each class of equal lines: ``id, more`` (128 bits), its number ``n`` of tokens, those emitted, its first place, how many lines it has and whether any text of these was odd."""
    made = with_tokens(text_lines(_keyed(docs)).withColumns(_ids()))
    n = F.size("tokens")
    emitted = F.slice("tokens", F.lit(1), n - F.ceil(n * NUM / DEN).cast("int") + F.least(n, F.lit(EXTRA)))
    made = made.select("id", "more", n.alias("n"), emitted.alias("emitted"), F.struct("doc_id", "key", "line_no").alias("place"), "odd")
    # all that depends on the words is a key, so that nothing but the place is aggregated
    return made.groupBy("id", "more", "n", "emitted").agg(F.min("place").alias("place"), F.count("*").alias("lines"), F.max("odd").alias("odd"))


def _candidates(docs: DataFrame, classes: DataFrame, even: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Tokens that lines may meet at, ``t, mine``, and the token sets of these lines, ``id, tokens``.

    ``mine.pos`` is the token's place in the line's order of rarity, in which tokens of a single class come first; these
    meet no other line and have no row.
    """
    token = Window.partitionBy("t")
    emitted = classes.where("n > 0").select("id", F.explode("emitted").alias("t"))
    counted = emitted.withColumns({"lo": F.min("id").over(token), "hi": F.max("id").over(token), "held": F.count("*").over(token)})
    shared = scratch.keep(counted.where("lo <> hi").select("t", "id", "held"), "line-shared")
    info = classes.where("n > 0").select("id", "n", "place", F.size("emitted").alias("emits"))
    lines = shared.groupBy("id").agg(F.count("*").alias("shared")).join(info, "id").where(F.col("shared") >= F.least(F.col("n"), F.lit(EXTRA)))
    lines = scratch.keep(lines.withColumns({"key": F.col("place.key"), "spot": F.xxhash64("place.key", "place.line_no")}), "line-places")
    count = lines.count()
    texts = maybe_in(_keyed(docs), F.col("key"), filter_frame(lines.select("key"), count), count)
    own = maybe_in(text_lines(texts, even).drop("doc_id", "odd"), F.xxhash64("key", "line_no"), filter_frame(lines.select(F.col("spot").alias("key")), count), count)
    own = own.join(lines.select("id", "key", F.col("place.line_no").alias("line_no")), ["key", "line_no"]).dropDuplicates(["id"])
    sets = scratch.keep(with_tokens(own).select("id", "tokens"), "line-sets")
    ranked = shared.join(lines.select("id", "n", "place", "emits", "shared").join(_parities(sets), "id"), "id")
    pos = F.col("emits") - F.col("shared") + F.row_number().over(Window.partitionBy("id").orderBy("held", "t")) - 1
    ranked = ranked.withColumn("pos", pos.cast("int")).where(F.col("pos") <= F.col("emits") - F.least(F.col("n"), F.lit(EXTRA)))
    whole = F.struct("place", "id", "n", "pos", "emits", *[f"p{k}" for k in range(WORDS)])
    return scratch.keep(ranked.select("t", whole.alias("mine")), "line-candidates"), sets


def _fits(a: str, b: str) -> Column:
    """Length, positional and parity filters for two lines that share a token; true for the rarest one that similar lines share."""
    both = lambda name: (F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    (n, m), (i, j), (e, f) = map(both, ("n", "pos", "emits"))
    length = (n * DEN >= m * NUM) & (m * DEN >= n * NUM)
    left = F.least(e - i, f - j) >= F.least(n, m, F.lit(EXTRA))
    apart = sum((F.bit_count(p.bitwiseXOR(q)) for p, q in (both(f"p{k}") for k in range(WORDS))), F.lit(0))
    return length & left & (apart * (NUM + DEN) <= (n + m) * (DEN - NUM))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ids ``late`` of those of ``pairs`` (``early, late``) whose token sets are similar enough."""
    a = sets.select(F.col("id").alias("early"), F.col("tokens").alias("a"))
    b = sets.select(F.col("id").alias("late"), F.col("tokens").alias("b"))
    both = pairs.join(a, "early").join(b, "late")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common * DEN >= (F.size("a") + F.size("b") - common) * NUM).select(F.col("late").alias("id")).distinct()


def matched_lines(docs: DataFrame, short_lines: bool, scratch: Scratch) -> DataFrame:
    """``key, removed``: for each text with lines that match earlier ones, their numbers.

    Lines come in the order of document id (null first), document and line number. A line is removed if any earlier
    line has the same words or, by tokens, a Jaccard similarity of NUM / DEN or more, whether that line is removed or not.
    """
    classes = scratch.keep(_classes(docs), "line-classes")
    even = not classes.agg(F.max("odd")).first()[0]  # the first pass has looked through every text that has lines
    met, sets = _candidates(docs, classes, even, scratch)
    earliest, picked = F.min("mine"), F.min(F.struct(F.xxhash64("t", "mine.id").alias("by"), F.col("mine").alias("hub")))
    hubs = met.groupBy("t").agg(F.array(earliest, picked["hub"]).alias("hubs")).select("t", F.explode("hubs").alias("hub"))
    star = met.join(hubs, "t").where((F.col("hub.place") < F.col("mine.place")) & _fits("hub", "mine"))
    star = scratch.keep(star.select(F.col("hub.id").alias("early"), F.col("mine.id").alias("late")).distinct(), "line-star")
    first = scratch.keep(_verified(star, sets), "line-first")
    later = met.join(first, F.col("mine.id") == first["id"], "left_anti")
    pairs = later.join(met.select("t", F.col("mine").alias("other")), "t").where((F.col("other.place") < F.col("mine.place")) & _fits("other", "mine"))
    pairs = pairs.select(F.col("other.id").alias("early"), F.col("mine.id").alias("late")).distinct()
    second = _verified(scratch.keep(pairs.join(star, ["early", "late"], "left_anti"), "line-pairs"), sets)
    gone = first.unionByName(second).withColumn("gone", F.lit(True))

    whose = classes.join(gone, "id", "left").where(F.col("gone") | (F.col("lines") > 1))
    whose = whose if short_lines else whose.where("n > 0")
    whose = whose.select("id", "more", "place", "gone")
    whose = scratch.keep(whose, "line-whose")
    count = whose.count()
    lines = maybe_in(text_lines(_keyed(docs), even).withColumn("id", F.xxhash64("line")), F.col("id"), filter_frame(whose.select(F.col("id").alias("key")), count), count)
    lines = lines.select("id", _ids()["more"].alias("more"), F.struct("doc_id", "key", "line_no").alias("here"))
    found = lines.join(whose.hint("shuffle_hash"), ["id", "more"]).where((F.col("here") != F.col("place")) | F.col("gone"))
    return found.groupBy("here.key").agg(F.collect_set("here.line_no").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = False) -> DataFrame:
    """Remove every line that repeats an earlier one, exactly or nearly: adds ``n_lines`` and ``n_removed``, changes the text.

    Two lines match if their sets of 5-word shingles (words between ASCII white space, lower-cased) have a
    Jaccard similarity of 0.8 or more. Lines of one to four words have no shingle: with ``short_lines`` they match if their words
    are the same, without it they always stay. Lines without words always stay. Earlier means a smaller document id, or the
    same document and a smaller line number; null ids come first. A null text stays null and has no lines to
    remove; an empty one has one empty line. Rows equal in id and text are one document listed twice and keep the same lines.
    Other columns stay; those named like a result are replaced. An empty table gives no rows.
    """
    base = docs.drop("n_lines", "n_removed")
    scratch = Scratch(docs.sparkSession, "lines")
    slim = base.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    removed = matched_lines(slim, short_lines, scratch).select(F.col("key").alias("_dedup_of"), F.col("removed").alias("_dedup_gone"))
    removed = scratch.keep(removed, "line-removed", last=True).hint("shuffle_hash")
    wide = base.withColumn("_dedup_key", F.xxhash64(F.col(id_col), F.col(text_col)))
    wide = wide.join(removed, F.col("_dedup_key") == F.col("_dedup_of"), "left").withColumn("_dedup_lines", F.split(F.col(text_col), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_dedup_lines") - 1), F.col("_dedup_gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("_dedup_lines"), i)), "\n")
    text = F.when(F.col("_dedup_gone").isNull(), F.col(text_col)).otherwise(rest)
    columns = [text.alias(c) if c == text_col else F.col(c) for c in base.columns]
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_dedup_lines"))
    return wide.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("_dedup_gone"), F.lit(0)).cast("bigint").alias("n_removed"))
