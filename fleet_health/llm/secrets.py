"""Secrets in texts: fixed rules, and character Markov models of random strings and identifiers.

Everything is a DataFrame expression. A rule's matches and the pieces between them come from
`regexp_extract_all` and `split` with one pattern; the running sum of their lengths gives the
positions, in code points.

The rules label the training samples: long enough values that a rule finds are random strings; long
runs elsewhere that keep to letters of one case (but a word's first) or to digits are ordinary
identifiers. Other runs are only judged. Both models are first-order, over
the alphabet below with a start state, smoothed by `SMOOTH` per next character. A run is reported
when its log2 likelihood ratio exceeds the log2 odds of ordinary to random among the samples by
`MARGIN_BITS`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules' patterns and least lengths.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# End of fixed values.
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
RUN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_SAMPLE = 16
ORDINARY = r"^([A-Z]?[a-z]+([_/=+-][A-Z]?[a-z]*)*|[A-Z_/=+-]+|[0-9_/=+-]+)$"
SMOOTH = 0.5
MARGIN_BITS = 13.0
SPANS = "array<struct<start:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, sought: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's matches whose value has `least` characters; `sought` must be inside."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), value_group)
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(between.alias("gap"), found.alias("hit"), values.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], span))
                        .otherwise(acc["out"]).alias("out"))

    made = F.aggregate(zipped, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(sought), made).otherwise(F.array().cast(SPANS))


def with_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `_assign`, `_access`, `_hex`: spans by the rules, and `_runs`: long runs outside them."""
    t = F.coalesce(F.col(text), F.lit(""))
    ruled = df.select(
        "*",
        _spans(t, ASSIGN, ASSIGN, 2, LEAST["assign"]).alias("_assign"),
        _spans(t, ACCESS, r"AKIA[A-Z0-9]{16}", 0, LEAST["access"]).alias("_access"),
        # of runs of hex digits only long enough ones count, so shorter need not be matched
        _spans(t, r"[0-9a-f]{24,}", r"[0-9a-f]{24}").alias("_hex"),
        _spans(t, RUN, RUN).alias("_all_runs"))
    base = F.concat("_assign", "_access", "_hex")
    return ruled.withColumn("_runs", F.filter("_all_runs", lambda r: ~F.exists(
        base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))).drop("_all_runs")


def _states(value: Column) -> Column:
    """The characters' numbers in the alphabet; 0 for any other."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(df: DataFrame, text: str = "text") -> dict:
    """Both models from all rows: at most 2 x STATES x STATES counts reach the driver.

    Without samples of either kind the tables are uniform, and no run is reported.
    """
    ruled = with_rules(df.select(F.col(text).alias("text")))
    spans = F.concat(
        F.transform(F.concat("_assign", "_access", "_hex"),
                    lambda s: F.struct(F.lit(1).alias("random"), s["value"].alias("value"))),
        F.transform(F.filter("_runs", lambda s: s["value"].rlike(ORDINARY)), lambda s: F.struct(F.lit(0).alias("random"), s["value"].alias("value"))))
    samples = (ruled.select(F.explode(spans).alias("s")).select("s.*")
               .where(F.length("value") >= LEAST_SAMPLE)
               .select("random", _states(F.col("value")).alias("to")))
    steps = samples.select("random", F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.slice("to", 1, F.size("to") - 1)).alias("a"),
        F.col("to").alias("b"))).alias("p"))
    counts = {tuple(r): n for *r, n in
              steps.groupBy("random", "p.a", "p.b").count().collect()}
    # each sample is one step from the start state
    starts = [sum(n for (kind, a, _), n in counts.items() if kind == k and a == 0) for k in (0, 1)]
    ratios = []
    for a in range(STATES):
        rows = [[counts.get((kind, a, b), 0) + SMOOTH for b in range(STATES)] for kind in (0, 1)]
        sums = [sum(row) for row in rows]
        ratios += [math.log2(rows[1][b] / sums[1]) - math.log2(rows[0][b] / sums[0])
                   for b in range(STATES)]
    odds = math.log2((starts[0] + 1) / (starts[1] + 1))
    return {"ratios": ratios, "least": max(odds, 0.0) + MARGIN_BITS if starts[1] else math.inf}


def _ratio(value: Column, model: dict) -> Column:
    """log2 likelihood ratio, random to ordinary, of one run."""
    table = F.expr("cast(split('" + ",".join(map(repr, model["ratios"])) + "', ',') as array<double>)")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        _states(value), zero,
        lambda acc, s: F.struct(s.alias("at"), (
            acc["sum"] + F.get(table, acc["at"] * STATES + s)).alias("sum")),
        lambda acc: acc["sum"])


def scan(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds `spans`: array of (start, end, kind), by start, then kind as in KINDS.

    Positions are code points, the end is exclusive. Null and empty texts have no spans. Texts of
    any length are read whole; rows, ties and other columns stay as they are, but for a column
    `spans`, which is replaced. A run that the models add never overlaps a rule's span.
    """
    found = with_rules(df.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), "_text")

    def numbered(column, i):
        return F.transform(column, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end")))

    kinds = [numbered(c, i) for i, c in enumerate(["_assign", "_access", "_hex"])]
    if math.isfinite(model["least"]):
        kinds.append(numbered(
            F.filter("_runs", lambda s: _ratio(s["value"], model) >= model["least"]), 3))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat(*kinds)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.get(names, s["order"]).alias("kind")))
    return found.select(*[F.col(f"_row.`{c}`") for c in df.columns if c != "spans"], spans.alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """`kind:start:end`, comma-joined; of some kinds only, if given."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
                        ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans replaced by the mask."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        piece = F.when(s["start"] > acc["at"], F.array(gap, F.lit(mask))).when(
            F.size(acc["out"]) == 0, F.array(F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.concat(acc["out"], piece).alias("out"))

    made = F.aggregate(spans, zero, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, made).otherwise(text)
