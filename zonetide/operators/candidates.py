"""Which names to probe next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.fixed import LABEL_ALPHABET, MAX_LENGTH, TRACKED_TLDS
from ..functions.numbers import index_to_label, label_space
from ..functions.text import col

# Rows one cursor step is unrolled into at a time; bounds the arrays built by explode.
_CHUNK = 10_000


def scan_position(ordinal: Column | str, tlds: list[str] = TRACKED_TLDS) -> dict[str, Column]:
    """Length, TLD and label index of the ``ordinal``-th name of the whole scan.

    The scan takes every label of one TLD, then the next TLD, then the next length, so a
    place in it is plain arithmetic and any stretch of it can be computed in parallel.
    """
    ordinal = col(ordinal)
    starts, start = [], 0
    for length in range(1, MAX_LENGTH + 1):
        starts.append((length, start))
        start += len(LABEL_ALPHABET) ** length * len(tlds)
    length = reduce(lambda done, s: F.when(ordinal >= s[1], F.lit(s[0])).otherwise(done), starts, F.lit(None).cast("int"))
    length = F.when(ordinal < start, length)
    offset = ordinal - reduce(
        lambda done, s: F.when(ordinal >= s[1], F.lit(s[1]).cast("bigint")).otherwise(done), starts, F.lit(0).cast("bigint")
    )
    per_tld = label_space(length)
    names = F.array(*[F.lit(t) for t in tlds])
    # offset - index is a whole multiple of the label space, so the quotient is exact.
    index = F.pmod(offset, per_tld)
    tld_pos = ((offset - index) / per_tld).cast("int")
    return {"length": length, "tld": F.get(names, tld_pos), "idx": index}


def _named(df: DataFrame) -> DataFrame:
    domain = F.concat_ws(".", "label", "tld")
    return df.withColumn("label", index_to_label("idx", F.col("length"))).withColumn("domain", domain)


def enumerate_at(df: DataFrame, ordinal: Column | str, tlds: list[str] = TRACKED_TLDS) -> DataFrame:
    """Add length, tld, idx, label and domain of a scan ordinal; past the end gives no row."""
    return _named(df.withColumns(scan_position(ordinal, tlds)).filter(F.col("length").isNotNull()))


def scan_ordinal(length: int, tld_index: int, index: int, tlds: list[str] = TRACKED_TLDS) -> int:
    """Ordinal of a (length, TLD, index) cursor."""
    base = len(LABEL_ALPHABET)
    return sum(base**k for k in range(1, length)) * len(tlds) + tld_index * base**length + index


def enumerate_batch(
    spark: SparkSession, length: int, tld_index: int, index: int, n: int, tlds: list[str] = TRACKED_TLDS
) -> DataFrame:
    """The next ``n`` names of the scan from a cursor; a range, so no sort and no shuffle."""
    start = scan_ordinal(length, tld_index, index, tlds)
    return enumerate_at(spark.range(start, start + n).withColumnRenamed("id", "ordinal"), "ordinal", tlds)


# ---- fair batches over per-TLD cursors ----------------------------------------


def sync_cursors(cursors: DataFrame, tlds: DataFrame, lengths: list[int]) -> DataFrame:
    """One cursor per (length, TLD): new TLDs start at 0, TLDs no longer listed are dropped."""
    wanted = tlds.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    known = cursors.select(F.col("length").cast("int").alias("length"), "tld", "next_index")
    return wanted.join(known, ["length", "tld"], "left").withColumn(
        "next_index", F.coalesce(F.col("next_index"), F.lit(0)).cast("bigint")
    )


def batch_shares(cursors: DataFrame, n: int) -> DataFrame:
    """How many labels each TLD contributes to the next ``n`` names of its length.

    The furthest-behind TLDs are served first, round by round, as if ``n`` names were taken
    in (index, TLD position) order. The resulting level has a closed form over the sorted
    cursors, so only cursor rows (lengths x TLDs) are ordered, never the names themselves.
    """
    by_need = Window.partitionBy("length").orderBy("next_index", "tld_pos")
    upto = by_need.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("length")
    in_turn = Window.partitionBy("length").orderBy("tld_pos").rowsBetween(Window.unboundedPreceding, 0)
    space = label_space(F.col("length"))
    c = F.least(F.col("next_index"), space)
    ranked = cursors.withColumns(
        {"space": space, "c": c, "j": F.row_number().over(by_need).cast("bigint"), "prefix": F.sum(c).over(upto)}
    )
    reached = (F.col("j") * F.col("c") - F.col("prefix")) <= n
    best = F.max(F.when(reached, F.struct("j", "prefix"))).over(whole)
    level = F.expr(f"least(space, ({n} + best.prefix) div best.j)")
    levelled = ranked.withColumn("best", best).withColumn("level", level)
    below = F.greatest(F.lit(0), F.col("level") - F.col("c"))
    left = F.lit(n) - F.sum(below).over(whole)
    # One more name each, in TLD order, for those that stand exactly at the level.
    open_here = (F.col("c") <= F.col("level")) & (F.col("level") < F.col("space"))
    turn = F.sum(open_here.cast("bigint")).over(in_turn)
    extra = (open_here & (turn <= left)).cast("bigint")
    return levelled.select("length", "tld", "tld_pos", F.col("c").alias("next_index"), (below + extra).alias("take"))


def fair_batch(cursors: DataFrame, n: int) -> DataFrame:
    """The next ``n`` names per length, spread over the TLDs by need.

    ``cursors`` has (length, tld, tld_pos, next_index). Names are unrolled in bounded chunks
    that are spread over the cluster first, so a large ``n`` is no large array anywhere.
    """
    shares = batch_shares(cursors, n).filter("take > 0")
    chunks = shares.withColumn("chunk", F.explode(F.expr(f"sequence(0, (take - 1) div {_CHUNK})")))
    chunks = chunks.repartition("length", "tld", "chunk")
    low = f"next_index + chunk * {_CHUNK}"
    high = f"next_index + least(take, (chunk + 1) * {_CHUNK}) - 1"
    rows = chunks.withColumn("idx", F.explode(F.expr(f"sequence({low}, {high})")))
    return _named(rows.select("length", "tld", "tld_pos", "idx"))


def advance_cursors(cursors: DataFrame, batch: DataFrame) -> DataFrame:
    """Cursors after the names of ``batch`` were probed."""
    done = batch.groupBy("length", "tld").agg((F.max("idx") + 1).alias("_done"))
    return cursors.join(done, ["length", "tld"], "left").withColumn(
        "next_index", F.greatest(F.col("next_index"), F.col("_done"))
    ).drop("_done")


def exhausted_lengths(cursors: DataFrame) -> DataFrame:
    """Per length: ``done`` when every TLD's label space is used up."""
    return cursors.groupBy("length").agg(
        F.bool_and(F.col("next_index") >= label_space(F.col("length"))).alias("done")
    )


def cursor_lag(cursors: DataFrame) -> DataFrame:
    """TLDs behind the mean cursor of their length, and by how much."""
    stats = cursors.groupBy("length").agg(F.sum("next_index").alias("_sum"), F.count("*").alias("_n"))
    mean = F.col("_sum") / F.col("_n")
    return (
        cursors.join(stats, "length")
        .withColumn("mean_index", mean)
        .filter(F.col("next_index") < F.col("mean_index"))
        .select("length", "tld", "next_index", "mean_index", (F.col("mean_index") - F.col("next_index")).alias("lag"))
    )


# ---- words --------------------------------------------------------------------


def word_batch(words: DataFrame, cursor: int, n: int, tlds: list[str] = TRACKED_TLDS, n_words: int | None = None) -> DataFrame:
    """The next ``n`` (word, TLD) pairs from a pair cursor, wrapping at the end.

    ``words`` has dense positions (pos, word). A pair number splits into word position and
    TLD, so the batch is a range joined on the position: no product, no global sort. ``n_words`` is how many words
    there are if ``words`` has only those at the positions of the batch.
    """
    spark = words.sparkSession
    total = words.agg(F.count("*")).scalar() if n_words is None else F.lit(n_words).cast("bigint")
    width = len(tlds)
    pair = F.col("pair")
    names = F.array(*[F.lit(t) for t in tlds])
    pairs = (
        spark.range(cursor, cursor + n)
        .withColumnRenamed("id", "pair")
        .withColumn("pos", F.when(total > 0, F.pmod(F.floor(pair / width).cast("bigint"), total)))
        .withColumn("tld", F.get(names, F.pmod(pair, F.lit(width)).cast("int")))
    )
    return pairs.join(words, "pos").select(
        "pair", "word", "tld", F.concat_ws(".", "word", "tld").alias("domain")
    )
