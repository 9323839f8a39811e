"""Benchmark decontamination by a prefix-filtered set join, in DataFrame expressions only.

A benchmark item is cut into windows of 13 words (a shorter item is one window), a window into shingles of up to five
words. A document holds a window only if it holds all its shingles, so one of them is a sufficient prefix: the rarest, by
count over the benchmark's windows, an order that is known before a document is read. Documents meet prefixes alone; the position of a
prefix in its window says where the window has to start and that it has to end inside the text, and the document's shingles from there on,
which its row brings along, have to be a window's, one by one and in its order.

A bitmap of a fixed size has all prefixes, so that most other shingles of a document are left out inside its own row; what it lets through is
joined with the prefixes. That join has no hint: what a benchmark needs is stored first, so Spark
broadcasts it when its true size is under the session's threshold and shuffles otherwise. The larger a benchmark, the more shingles the
bitmap lets through; the result is the same. A shingle that very many
documents hold costs rows in proportion to its occurrences, never pairs of documents; all grouping is within one text.

Defined results: null and empty texts have no words, hit nothing and are not contaminated; null or empty items have no
windows. Documents are told apart by id and text, so repeated rows get the same result and different texts under one id
their own. Items are told apart likewise; an item id counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stored import stored

WINDOW_WORDS = 13
SHINGLE_WORDS = 5

# A word: any run of digits, letters and characters beyond ASCII, after A-Z have been lower-cased. This is
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ by what it holds, which Java matches about ten times as fast.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _places(n: Column, size: int) -> Column:
    return F.greatest(n - size + 1, F.lit(0))


def _hashes(words: Column, size: int) -> Column:
    """Hash of the shingle at each position."""

    def shingle(i: Column) -> Column:
        return F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)])

    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), shingle)).otherwise(F.array().cast("array<bigint>"))


def _placed(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """(keys, n, place, shingle): shingles of all sizes, one size after the other, from rows with ``_words``."""
    hashes = F.concat(*[_hashes(F.col("_words"), s) for s in sizes]) if sizes else F.array().cast("array<bigint>")
    return rows.select(*keys, F.size("_words").alias("n"), F.posexplode(hashes).alias("place", "shingle"))


def _position(sizes: list[int]) -> Column:
    """Position in the text from the place among the shingles of all sizes."""
    before, out = F.lit(0), F.lit(0)
    for s in sizes:
        out = F.when(F.col("size") == s, before).otherwise(out)
        before = before + _places(F.col("n"), s)
    return F.col("place") - out


def _windows(items: DataFrame, sizes: list[int], window: int, shingle: int) -> DataFrame:
    """(item_id, length, size, shingles): the distinct windows of each item as arrays of shingle hashes."""
    length, size = F.least(F.col("n"), F.lit(window)), F.least(F.col("n"), F.lit(shingle))
    placed = _placed(items.filter(F.size("_words") > 0), ["item_id", "_item_text"], sizes)
    placed = placed.withColumns({"length": length, "size": size}).withColumn("position", _position(sizes))
    placed = placed.filter(F.col("position").between(0, F.col("n") - F.col("size")))
    ahead = Window.partitionBy("item_id", "_item_text").orderBy("position").rowsBetween(0, window - shingle)
    runs = placed.withColumn("shingles", F.collect_list("shingle").over(ahead))
    full = runs.withColumn("shingles", F.slice("shingles", F.lit(1), F.col("length") - F.col("size") + 1)).filter(F.size("shingles") == F.col("length") - F.col("size") + 1)
    return full.select("item_id", "length", "size", "shingles").distinct()


def _prefixes(windows: DataFrame) -> DataFrame:
    """(size, length, shingle, offset): the rarest shingle of each window and where in it that is."""
    counts = windows.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("count"))
    each = windows.select("size", "length", "shingles").distinct().select("*", F.posexplode("shingles").alias("offset", "shingle"))
    rarest = F.min(F.struct("count", "shingle", "offset")).alias("rarest")
    chosen = each.join(counts, "shingle").groupBy("size", "length", "shingles").agg(rarest)
    return chosen.select("size", "length", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")).distinct()


def _bitmap(prefixes: DataFrame) -> Column:
    """Prefix shingles as a bitmap of a fixed size: an array of 2**16 numbers, whatever the benchmark's size."""
    place = F.pmod(F.col("shingle"), F.lit(64 << 16))
    rows = prefixes.groupBy(F.floor(place / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits"))
    known = {r["at"]: r["bits"] for r in rows.collect()}  # at most 2**16 rows
    return F.split(F.lit(",".join(str(known.get(i, 0)) for i in range(1 << 16))), ",").cast("array<bigint>")


def _marked(bitmap: Column, shingle: Column) -> Column:
    place = F.pmod(shingle, F.lit(64 << 16))
    return F.getbit(F.get(bitmap, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1


def _candidates(documents: DataFrame, bitmap: Column, sizes: list[int], reach: int) -> DataFrame:
    """(doc_id, _text, n, size, position, shingle, first, near): shingles that may be prefixes, each with those around it from ``first`` on."""
    texts = documents.select("doc_id", F.xxhash64("text").alias("_text"), words(F.col("text")).alias("_words"))
    cut = texts.select("doc_id", "_text", F.size("_words").alias("n"), *[_hashes(F.col("_words"), s).alias(f"_of{s}") for s in sizes])

    def of(size: int) -> Column:
        own, ahead = F.col(f"_of{size}"), reach if size == max(sizes) else 0
        numbered = F.transform(own, lambda x, i: F.struct(i.alias("position"), x.alias("shingle")))

        def around(x: Column) -> Column:
            first = F.greatest(x["position"] - ahead, F.lit(0))
            near = F.slice(own, first + 1, F.lit(2 * ahead + 1))
            return F.struct(F.lit(size).alias("size"), x["position"].alias("position"), x["shingle"].alias("shingle"), first.alias("first"), near.alias("near"))

        return F.transform(F.filter(numbered, lambda x: _marked(bitmap, x["shingle"])), around)

    return cut.select("doc_id", "_text", "n", F.inline(F.concat(*[of(s) for s in sizes])))


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _text, start, length, item_id): every occurrence of a window in a document; ``_text`` is a hash of the text."""
    items = benchmark.select("item_id", F.xxhash64("text").alias("_item_text"), words(F.col("text")).alias("_words")).distinct()
    sizes = sorted(r.s for r in items.select(F.least(F.size("_words"), F.lit(shingle)).alias("s")).filter("s > 0").distinct().collect())  # at most ``shingle`` numbers
    windows = stored(_windows(items, sizes, window, shingle), "benchmark-windows")
    prefixes = stored(_prefixes(windows), "benchmark-prefixes")

    # without an item that has words there is nothing to meet
    met = _candidates(documents, _bitmap(prefixes), sizes or [shingle], window - shingle).join(prefixes, ["shingle", "size"])
    start = F.col("position") - F.col("offset")
    inside = met.filter((start >= 0) & (start + F.col("length") <= F.col("n")))
    # Spark may take the slice before the filter, so it has to stand for texts that begin inside a window, too
    span = F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("length") - F.col("size") + 1)
    spans = inside.select("doc_id", "_text", start.alias("start"), "length", "size", span.alias("shingles"))
    return spans.join(windows, ["size", "length", "shingles"]).select("doc_id", "_text", "start", "length", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with ``n_words``, ``n_hit`` (words inside any window's occurrence), ``items`` (ids, sorted as text)
    and ``contaminated`` (at least one word in 20 is hit)."""
    found = hits(documents, benchmark)
    order = Window.partitionBy("doc_id", "_text").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    spans = found.groupBy("doc_id", "_text", "start", "length").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    reached = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("fresh", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)))
    marks = spans.groupBy("doc_id", "_text").agg(
        F.sum("fresh").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"),
    )
    marks = marks.select(F.col("doc_id").alias("_marked_id"), F.col("_text").alias("_marked_text"), "n_hit", "items")
    known = [c for c in documents.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    out = documents.select(*known, F.xxhash64("text").alias("_text"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(marks, F.col("doc_id").eqNullSafe(F.col("_marked_id")) & (F.col("_text") == F.col("_marked_text")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *known,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
