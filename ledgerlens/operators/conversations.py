"""Conversation and grounding jobs (T1-T12) as batch table operators.

Input: a turns table (conv_id, turn, role, text).  A single conversation
may hold a large share of all turns, so nothing here relies on one
partition per conversation:

* T1 (last 8 per conversation) is a salted two-stage top-k;
* T2 (merge consecutive same-role turns) is a two-level scan: range
  partitions on (conv_id, turn), a window inside each range, and one carry
  row per (conversation, range) -- bounded by the partition count;
* T6 (number grounding) is a band join on (conv_id, value bucket), so only
  numbers within the tolerance are paired, never all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import exprs, rules
from ..session import stage

SALTS = 64


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_on: str, salts: int = SALTS) -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (rank column ``rn``).

    Stage 1 ranks inside (group, salt) so a hot group is split over
    ``salts`` tasks; stage 2 ranks the at most k*salts survivors per group.
    """
    salted = df.withColumn("_salt", F.pmod(F.hash(F.col(salt_on)), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    s1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return s1.withColumn("rn", F.row_number().over(w2)).where(F.col("rn") <= k).drop("_salt", "_r1")


def recent_history(turns: DataFrame, k: int = rules.HISTORY_TURNS) -> DataFrame:
    """The last ``k`` messages of each conversation, oldest first.

    Output: conv_id, turn, role, text, position (1 = oldest kept).
    """
    top = top_k_per_group(turns, ["conv_id"], [F.col("turn").desc()], k, salt_on="turn")
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))  # <= k rows per conversation
    return top.select("conv_id", "turn", "role", "text", (n - F.col("rn") + 1).cast("int").alias("position"))


def merge_turns(turns: DataFrame) -> DataFrame:
    """Consecutive turns of the same role become one message.

    Output: conv_id, block, first_turn, last_turn, role, text (joined by
    newline in turn order).
    """
    # written once with its range number: both readers below see the same ranges
    # (two range exchanges would each sample and coalesce their own)
    r = stage(turns.select("conv_id", "turn", "role", "text")
                   .repartitionByRange("conv_id", "turn")
                   .withColumn("_rng", F.spark_partition_id()), "turn-ranges")
    w = Window.partitionBy("_rng", "conv_id").orderBy("turn")
    prev = F.lag("role").over(w)
    r = r.withColumn("_chg", (prev.isNotNull() & (F.col("role") != prev)).cast("int"))
    r = r.withColumn("_loc", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = r.groupBy("conv_id", "_rng").agg(
        F.min_by("role", "turn").alias("_first_role"), F.max_by("role", "turn").alias("_last_role"),
        F.sum("_chg").alias("_changes"))
    # one row per (conversation, range it spans): bounded by partitions
    w2 = Window.partitionBy("conv_id").orderBy("_rng")
    prev_last = F.lag("_last_role").over(w2)
    seg = seg.withColumn("_bnd", (prev_last.isNotNull() & (prev_last != F.col("_first_role"))).cast("int"))
    cum = F.sum(F.col("_changes") + F.col("_bnd")).over(w2.rowsBetween(Window.unboundedPreceding, 0))
    seg = seg.select("conv_id", "_rng", (cum - F.col("_changes")).alias("_base"))
    blocks = r.join(seg, ["conv_id", "_rng"]).withColumn("block", (F.col("_base") + F.col("_loc")).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return blocks.groupBy("conv_id", "block").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.first("role").alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def session_activity(turns: DataFrame) -> DataFrame:
    """One row per conversation, latest activity first.

    Output: conv_id, messages, last_turn (ordering: last_turn desc, conv_id).
    """
    return (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"),
                                         F.max("turn").alias("last_turn"))
                 .orderBy(F.desc("last_turn"), "conv_id"))


def ordered_messages(turns: DataFrame) -> DataFrame:
    """T4: messages by conversation and time (a distributed range sort)."""
    return turns.orderBy("conv_id", "turn")


def extract_numbers(text: Column) -> Column:
    """T5: distinct numbers in a text (thousands commas dropped), sorted."""
    clean = F.regexp_replace(text, ",", "")
    found = F.regexp_extract_all(clean, F.lit("(?U)" + rules.NUMBER_PATTERN), 0)
    # the pattern takes digits of any script; Spark's cast reads ASCII ones
    read = F.transform(found, lambda s: exprs.ascii_digits(s).try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(read, lambda v: v.isNotNull())))


def _bucket(value: Column) -> Column:
    """Band number as a double: floor(value / tolerance) of any size, without
    a cast to long.  Beyond 2**53 neighbours round to the same number, and so
    do the values within the tolerance."""
    q = value / F.lit(rules.GROUNDING_TOLERANCE)
    return q - F.pmod(q, F.lit(1.0))


def is_fallback(text: Column) -> Column:
    """The text contains the fixed refusal sentence (any case)."""
    return F.lower(text).contains(rules.FALLBACK_TEXT.lower())


def grounding_check(responses: DataFrame, context: DataFrame) -> DataFrame:
    """T6 + T7: keep a response only if each of its numbers is a generic
    one or lies within the tolerance of a number of its context.

    ``responses``: key columns ``conv_id``, ``turn`` and ``text``;
    ``context``: ``conv_id``, ``value`` (one row per context number) and
    ``from_turn`` (the context counts for responses with turn > from_turn).
    Output: conv_id, turn, grounded, text (the refusal text when rejected).
    """
    tol = rules.GROUNDING_TOLERANCE
    nums = responses.select("conv_id", "turn", F.explode(extract_numbers(F.col("text"))).alias("value"))
    nums = nums.where(~F.col("value").isin(*[float(x) for x in rules.GENERIC_NUMBERS]))
    # band join: bucket width = tolerance, probe the 3 neighbouring buckets
    around = F.array_distinct(F.array(*[_bucket(F.col("value")) + d for d in (-1.0, 0.0, 1.0)]))
    nb = nums.withColumn("_b", F.explode(around))
    cb = context.select("conv_id", F.col("value").alias("cval"), "from_turn", _bucket(F.col("value")).alias("_b"))
    matched = nb.join(cb, ["conv_id", "_b"]).where(
        (F.abs(F.col("value") - F.col("cval")) < tol) & (F.col("from_turn") < F.col("turn"))
    ).select("conv_id", "turn", "value").distinct()
    bad = nums.join(matched, ["conv_id", "turn", "value"], "left_anti").select("conv_id", "turn").distinct()
    out = responses.join(bad.withColumn("_bad", F.lit(True)), ["conv_id", "turn"], "left")
    grounded = F.coalesce(~F.col("_bad"), F.lit(True)) & ~is_fallback(F.col("text"))
    return out.select("conv_id", "turn", grounded.alias("grounded"),
                      F.when(grounded, F.col("text")).otherwise(F.lit(rules.FALLBACK_TEXT)).alias("text"))


def conversation_context(turns: DataFrame) -> DataFrame:
    """Context numbers of each conversation: every number of a turn, with
    the first turn it appeared in (one row per conversation and value)."""
    return (turns.select("conv_id", "turn", F.explode(extract_numbers(F.col("text"))).alias("value"))
                 .groupBy("conv_id", "value").agg(F.min("turn").alias("from_turn")))


def intent(text: Column) -> Column:
    """First keyword list with a substring hit, else 'fallback'."""
    low = F.lower(text)
    out = None
    for name, words in rules.INTENTS:
        hit = None
        for w_ in words:
            h = low.contains(w_)
            hit = h if hit is None else (hit | h)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(rules.FALLBACK_INTENT))


def sections(doc: DataFrame, doc_col: str = "document") -> DataFrame:
    """Lines of each '=== X' section (up to the next '===' line).

    Output: <other columns>, section (header text), line_no, line.
    """
    keep = [c for c in doc.columns if c != doc_col]
    lines = doc.select(*keep, F.posexplode(F.split(F.col(doc_col), "\n")).alias("line_no", "line"))
    hdr = F.when(F.col("line").startswith("==="), F.col("line"))
    w = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # a document is one bounded row (a dataset's digest), so a window per document is fine
    lines = lines.withColumn("section", F.last(hdr, ignorenulls=True).over(w))
    return lines.where(F.col("section").isNotNull() & ~F.col("line").startswith("===")
                       & (F.length(F.trim(F.col("line"))) > 0))
