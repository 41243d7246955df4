"""Lines that occur in several documents, kept in the first one only, as DataFrame expressions.

Lines travel as hashes of their keys with their document and position, dealt out by ranges of the
hash. Inside a range they are sorted by hash, then document, then position, and a window that runs
along this order knows the first document of each key: every line of a later document is dropped.
What comes back is one compressed bitmap per document that loses lines, never text.

A key with a large part of all lines is spread over slots by document. A slot finds its own first
document; the least of them, one row per such key, is then broadcast. Which keys these are is
estimated from the documents that a hash picks; it only balances the work, all lines are used.

A keep bitmap is an array of (gap, keep): `gap` words of 64 kept lines each, then one word whose bit i
tells whether line i of the 64 stays. Lines after the last word stay.

Defined results. A null text is an empty one, with one empty line. Rows without a key come after all
others and count as one document, as do rows with equal keys; equal rows get equal results. Keys are
compared by 128 bits of hash, and rows are found again by 128 bits over key and text. Columns other
than key and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_health.llm.common import lower_ascii

#: The six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
#: Code points of text in one partition, about, and hash ranges in a partition.
CHARS_EACH = 48_000_000
RANGES_EACH = 64
#: One document in so many estimates the hot keys.
PICKED = 64
#: A key is hot above this share of the lines, or above so many lines.
HOT_SHARE = 1 / 512
HOT_LINES = 500_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    # Only in a text of ASCII alone is `lower` the lowering of A-Z; it is much the faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and a 128-bit identity of both."""
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.select("*", *[F.xxhash64(F.lit(i), F.col("_key").isNull(), "_key", "_text").alias(f"_r{i}")
                              for i in (1, 2)])


def _lines(rows: DataFrame, least: int) -> DataFrame:
    """Document, identity, position and key hashes of every line whose key is long enough."""
    cut = rows.select("_key", "_r1", "_r2", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    keyed = cut.select("_key", "_r1", "_r2", "_pos", line_key(F.col("_line")).alias("_k"))
    return keyed.where(F.length("_k") >= least).select(
        "_key", "_r1", "_r2", "_pos", *[F.xxhash64(F.lit(i), "_k").alias(f"_h{i}") for i in (3, 4)])


def _plan(rows: DataFrame) -> tuple[int, float]:
    """Number of partitions, and the picked lines above which a key is hot."""
    picked = F.pmod("_r2", F.lit(PICKED)) == 0
    chars, lines = rows.agg(F.sum(F.length("_text")), F.sum(F.when(picked, F.size(F.split("_text", "\n"))))).first()
    hot = min((lines or 0) * HOT_SHARE, HOT_LINES / PICKED)
    return max(4, math.ceil((chars or 0) / CHARS_EACH)), max(4.0, hot)


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """`_r1`, `_r2`, `n_dropped` and `keep` of every row that loses lines.

    A line goes if its key has at least `least` code points and occurs in a document of smaller `key`.
    """
    rows = _rows(df, key, text)
    parts, above = _plan(rows)
    lines = _lines(rows, least)
    # At most about 1 / HOT_SHARE keys, or one in HOT_LINES lines.
    hot = (_lines(rows.where(F.pmod("_r2", F.lit(PICKED)) == 0), least).groupBy("_h3", "_h4")
           .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > above)
           .select("_h3", "_h4", F.ceil(F.col("_n") / above).cast("int").alias("_slots")))
    spread = lines.join(F.broadcast(hot), ["_h3", "_h4"], "left")
    ranges = parts * RANGES_EACH
    spread = spread.select(
        "_key", "_r1", "_r2", "_pos", "_h3", "_h4", F.col("_slots").isNotNull().alias("_hot"),
        F.when(F.col("_slots").isNull(), F.lit(0)).otherwise(F.pmod("_r1", F.col("_slots"))).alias("_slot"),
        F.shiftrightunsigned(F.shiftrightunsigned("_h3", 32) * F.lit(ranges), 32).alias("_range"))
    dealt = spread.repartition(parts, "_range", "_slot")
    order = (Window.partitionBy("_range", "_slot", "_h3", "_h4")
             .orderBy(F.col("_key").asc_nulls_last(), "_r1", "_r2", "_pos"))
    streamed = dealt.withColumn("_first", F.first("_key").over(order))
    of_hot = streamed.where("_hot").groupBy("_h3", "_h4").agg(F.min("_first").alias("_least"))
    first = F.coalesce("_least", "_first")
    later = (streamed.join(F.broadcast(of_hot), ["_h3", "_h4"], "left")
             .where(first.isNotNull() & (F.col("_key").isNull() | (F.col("_key") > first))))
    words = (later.select("_r1", "_r2", F.floor(F.col("_pos") / 64).cast("int").alias("_word"),
                          F.expr("shiftleft(1L, _pos % 64)").alias("_bit"))
             .repartition(parts, "_r1", "_r2")
             .groupBy("_r1", "_r2", "_word").agg(F.bit_or("_bit").alias("_drop")))
    packed = words.groupBy("_r1", "_r2").agg(
        F.sum(F.bit_count("_drop")).cast("bigint").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("_word", F.bitwise_not("_drop").alias("keep")))).alias("_words"))
    before = lambda i: F.coalesce(F.get("_words", i - 1)["_word"], F.lit(-1))
    return packed.select("_r1", "_r2", "n_dropped", F.transform("_words", lambda w, i: F.struct(
        (w["_word"] - before(i) - 1).alias("gap"), w["keep"].alias("keep"))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a keep bitmap leaves; all for a null bitmap."""
    flags = F.flatten(F.transform(keep, lambda w: F.concat(
        F.array_repeat(F.lit(True), w["gap"] * 64),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function(
            "shiftrightunsigned", w["keep"], i).bitwiseAND(F.lit(1)) == 1))))
    lines = F.zip_with(F.split(text, "\n"), flags, lambda line, stays: F.when(
        F.coalesce(stays, F.lit(True)), line))
    return F.when(keep.isNull(), text).otherwise(F.array_join(lines, "\n"))


def remove_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """Key, `n_lines`, `n_dropped`, `keep` and the text that is left, `kept`, of every row."""
    rows = _rows(df, key, text)
    parts, _ = _plan(rows)
    # The bitmaps of a partition fit in memory; hashing them spares sorting the texts.
    joined = (rows.repartition(parts, "_r1", "_r2")
              .join(keep_bitmaps(df, key, text, least).hint("shuffle_hash"), ["_r1", "_r2"], "left"))
    breaks = F.octet_length("_text") - F.octet_length(F.replace("_text", F.lit("\n"), F.lit("")))
    return joined.select(
        F.col("_key").alias(key), (breaks + 1).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "keep",
        kept_text(F.col("_text"), F.col("keep")).alias("kept"))
