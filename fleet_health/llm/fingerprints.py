"""Document fingerprints by consistent weighted sampling, as DataFrame expressions.

A document is a weighted set: its words (A-Z lowered) and how often each occurs. For term k with
weight w and draws r, c ~ Gamma(2, 1), b ~ Uniform(0, 1) that depend on k alone:

    t = floor(ln w / r + b),   y = exp(r (t - b)),   a = c / (y exp(r))

The term with the least a, together with its t, is the sample. Two sets have the same sample with a
probability equal to their generalised Jaccard similarity, sum of min over sum of max of the weights.

A fingerprint has SAMPLES samples, each among all terms of its text. Likeness is the share of equal ones.

A Gamma(2, 1) draw is -ln(u v) for two uniforms of 32 bits. Draws come from 64-bit hashes of the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleet_health.llm.common import lower_ascii

SAMPLES = 32
#: Bits of a sample that are its identity; the upper 32 order it.
ID_BITS = 32
#: Code points of text in one ordered segment, about, and segments in a partition.
SEGMENT_CHARS = 500_000
SEGMENTS_EACH = 16
#: Segments at most, about; beyond that many their size grows. A hash picks EVERY rows a segment, and
#: every EVERY-th of these in order is a cut, so that segments are of similar size.
MAX_CUTS = 100_000
EVERY = 8


def _uniforms(bits: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1), from the halves of 64 bits."""
    halves = F.shiftrightunsigned(bits, 32), bits.bitwiseAND(F.lit(2**32 - 1))
    return tuple((half + F.lit(0.5)) / F.lit(float(2**32)) for half in halves)


def _sampled(each: DataFrame, keep: list[Column], weights: list[str], names: list[str]) -> DataFrame:
    """A number per text whose order is that of ln a, with the identity of (term, t) in its lower bits.

    Draws are columns of selects of their own, so that all texts share them.
    """
    term = F.col("_term")
    bits = [F.xxhash64(F.lit(i), "_sample", term).alias(f"_h{i}") for i in (1, 2, 3)]
    drawn = each.select("*", *bits)
    (r1, r2), (c1, c2), (b, _) = (_uniforms(F.col(f"_h{i}")) for i in (1, 2, 3))
    drawn = drawn.select(*each.columns, (-F.log(r1 * r2)).alias("_r"), F.log(-F.log(c1 * c2)).alias("_lnc"), b.alias("_b"))
    drawn = drawn.select("*", *[F.floor(F.col(w) / F.col("_r") + F.col("_b")).alias(f"_t{i}")
                                for i, w in enumerate(weights)])

    def packed(i):
        t = F.col(f"_t{i}")
        ln_a = F.col("_lnc") - F.col("_r") * (t - F.col("_b")) - F.col("_r")
        scaled = F.greatest(F.least(F.floor((ln_a + 512.0) * float(2**21) + 0.5), F.lit(2**31 - 1)), F.lit(0))
        identity = F.shiftrightunsigned(F.xxhash64(F.lit(6), term, t), 64 - ID_BITS)
        return F.when(t.isNotNull(), F.shiftleft(scaled.cast("bigint"), ID_BITS).bitwiseOR(identity))

    return drawn.select(*keep, *[packed(i).alias(n) for i, n in enumerate(names)])


def fingerprints(df: DataFrame, key: list[str], texts: list[str]) -> DataFrame:
    """`key` and one string per text column: hex numbers, comma-joined, '' where there is no term.

    `df` must already be dealt out by (some of) the key columns, which must identify its rows;
    then nothing here shuffles. Null and empty texts, and such of white space only, have no term.
    """
    word_lists = F.array(*[F.split(lower_ascii(F.coalesce(F.col(t), F.lit(""))), r"[\x20\x09-\x0D]+")
                           for t in texts])
    terms = (df.select(*key, F.posexplode(word_lists).alias("_which", "_list"))
             .select(*key, "_which", F.explode("_list").alias("_word"))
             .select(*key, F.when(F.col("_word") != "", F.xxhash64("_word")).alias("_term"), "_which"))
    counted = terms.groupBy(*key, "_term").agg(
        *[F.sum((F.col("_which") == i).cast("bigint")).alias(f"_n{i}") for i in range(len(texts))])
    # ln of the weight; null where a text lacks the term.
    counted = counted.select(*key, "_term", *[
        F.when(F.col("_term").isNotNull() & (F.col(f"_n{i}") > 0), F.log(F.col(f"_n{i}").cast("double")))
        .alias(f"_w{i}") for i in range(len(texts))])
    each = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("_sample"))
    sampled = _sampled(each, [*[F.col(k) for k in key], F.col("_sample").alias("_slot")],
                       [f"_w{i}" for i in range(len(texts))], [f"_s{i}" for i in range(len(texts))])
    best = sampled.groupBy(*key, "_slot").agg(*[F.min(f"_s{i}").alias(f"_s{i}")
                                                for i in range(len(texts))])
    made = best.groupBy(*key).agg(*[
        F.map_from_entries(F.collect_list(F.when(
            F.col("_slot").isNotNull() & F.col(f"_s{i}").isNotNull(),
            F.struct("_slot", F.lower(F.substring(F.lpad(F.hex(f"_s{i}"), 16, "0"), 9, 8)))))
        ).alias(f"_m{i}") for i in range(len(texts))])
    slots = F.sequence(F.lit(0), F.lit(SAMPLES - 1))

    def filled(column):
        return F.array_join(F.transform(slots, lambda s: F.coalesce(
            F.try_element_at(F.col(column), s), F.lit(""))), ",")

    return made.select(*key, *[filled(f"_m{i}").alias(t) for i, t in enumerate(texts)])


def likeness(a: Column, b: Column) -> Column:
    """Agreeing samples among those that either has; 1 for two sets without words."""
    pairs = F.zip_with(F.split(a, ",", -1), F.split(b, ",", -1), lambda x, y: F.when((x == "") & (y == ""), 0).when(x == y, 2).otherwise(1))
    used = F.size(F.filter(pairs, lambda p: p > 0))
    same = F.size(F.filter(pairs, lambda p: p == 2))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def _place(at: Column) -> Column:
    """How many cuts are at or below `at`, by two levels of comparisons."""
    group = F.size(F.filter("_heads", lambda head: head <= at))
    inside = F.size(F.filter(F.get("_groups", group - 1), lambda cut: cut <= at))
    return F.when(group > 0, (group - 1) * F.col("_width") + inside).otherwise(F.lit(0))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_seg`, `_pos`, `_copy`, key, text and the next row's text, `_next`, in ascending key order.

    After the last comes the first. Rows with a null key come last; rows with equal keys follow each
    other by a hash of the text, then by text, nulls first. The rows are cut into segments at places
    (key and hash) that exist, and each segment also gets the rows at the start of the next
    (`_copy`), so that no window spans the whole table, null keys included. The cuts are rows that a
    hash picks, at most about MAX_CUTS, so the table of them, which is broadcast, has a bound.
    """
    docs = df.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"),
                              F.xxhash64(text).alias("hash")).alias("_at"), F.col(text).alias("_text"))
    total, rows, least = docs.agg(F.sum(F.length("_text")), F.count(F.lit(1)), F.min("_at")).first()
    each = max(1, -(-SEGMENT_CHARS * rows // max(1, total or 0)), -(-rows // MAX_CUTS))
    thin = max(1, each // EVERY)
    kinds = [f.dataType for f in docs.schema["_at"].dataType.fields]
    first = F.struct(*[F.lit(x).cast(kind) for x, kind in zip(least or [None] * 3, kinds)])
    picked = docs.where(F.pmod(F.xxhash64(F.lit(7), "_at"), F.lit(thin)) == 0).where(F.col("_at") > first)
    nth = each // thin
    cuts = picked.agg(F.filter(F.array_sort(F.collect_set("_at")), lambda _, i: i % nth == nth - 1).alias("_cuts"))
    cuts = cuts.withColumn("_width", F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_cuts")))).cast("int"))
    starts_at = F.when(F.size("_cuts") > 0, F.sequence(F.lit(1), F.size("_cuts"), F.col("_width"))).otherwise(
        F.array().cast("array<int>"))
    cuts = cuts.withColumn("_groups", F.transform(starts_at, lambda i: F.slice("_cuts", i, F.col("_width"))))
    cuts = cuts.withColumn("_heads", F.transform("_groups", lambda g: F.element_at(g, 1)))
    placed = docs.crossJoin(F.broadcast(cuts)).withColumn("_seg", _place(F.col("_at")))
    opens = F.get(F.get("_groups", F.floor((F.col("_seg") - 1) / F.col("_width")).cast("int")),
                  (F.col("_seg") - 1) % F.col("_width"))
    placed = placed.select("_text", "_at", "_seg", F.size("_cuts").alias("_last"), F.when(
        F.col("_seg") > 0, F.col("_at").eqNullSafe(opens)).otherwise(F.col("_at").eqNullSafe(first)).alias("_opens"))
    after = placed.where("_opens").withColumn(
        "_seg", F.when(F.col("_seg") == 0, F.col("_last")).otherwise(F.col("_seg") - 1))
    both = placed.withColumn("_copy", F.lit(False)).unionByName(after.withColumn("_copy", F.lit(True)))
    window = Window.partitionBy("_seg").orderBy("_copy", "_at", F.col("_text").asc_nulls_first())
    # Several segments a partition, so that their different sizes even out.
    parts = max(1, rows // (each * SEGMENTS_EACH) + 1)
    return both.repartition(parts, "_seg").select(
        "_seg", "_copy", F.col("_at.key").alias("_key"), "_text", F.row_number().over(window).alias("_pos"),
        F.lead("_text").over(window).alias("_next"))


def shifted(text: Column, following: Column) -> Column:
    """The last quarter of the text's code points replaced by the start of the following text."""
    t, f = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    n = F.floor(F.length(t) / 4).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.length(t) - n), F.substring(f, F.lit(1), n))


def compare_with_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: its and its edited text's fingerprint, and their and the next row's likeness.

    The order is that of `with_next`. An empty table gives no rows.
    """
    rows = with_next(df, key, text).select(
        "_seg", "_pos", "_copy", "_key", "_text", shifted(F.col("_text"), F.col("_next")).alias("_edited"))
    window = Window.partitionBy("_seg").orderBy("_pos")
    prints = fingerprints(rows, ["_seg", "_pos"], ["_text", "_edited"])
    scored = prints.select("_seg", "_pos", F.col("_text").alias("fingerprint"),
                           F.col("_edited").alias("edited_fingerprint"),
                           F.lead("_text").over(window).alias("_follower"))
    scored = scored.select(
        "_seg", "_pos", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_follower")).alias("near_next"))
    side = rows.where(~F.col("_copy")).select(
        "_seg", "_pos", F.col("_key").alias(key),
        F.length(F.coalesce("_text", F.lit(""))).cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"))
    return side.join(scored, ["_seg", "_pos"]).drop("_seg", "_pos")
