"""N-gram Jaccard join: documents whose sets of word shingles are alike, and the groups these links make.

The filter is a prefix filter under several global token orders. A shingle's rank is its document frequency first (rounded
on a log scale, so shingles of one set alone come first and can be left out), then a hash of its own for each order. Two sets
of the wanted similarity share a shingle among the first few of both under every such order; candidates are found under the first order,
with size and position bounds, must share prefix shingles under the others too, and are then verified on all shared shingles.

How the work is laid out, in four steps:

1. Python tasks hash shingles and pack them by hash range, a few bytes each, with the key of their set. Equal sets have one key.
2. A task per hash range counts in how many sets each shingle is; only those in two sets or more go on, to their sets.
3. A task per key range knows how many shingles of a set are shared at all. Most sets have too few for any link and end here;
   the rest keep their shared shingles, which hold every intersection they can have.
4. Spark joins prefixes. A large group of near copies first links to hubs (in each prefix list the set with the smallest share
   of unshared shingles) and is contracted; only pairs of different components are then joined, so no group gives all its pairs.
   Links are complete across components, which is what the groups need.

Shingle identities have 40 bits more than the number of ranges takes, so chance collisions inside a pair stay as rare at any size
(about 1e-9 a pair); sets are told apart by 64 bits of a digest and their size.

Defined results: null, empty and blank texts have no shingles and are alone; a text of fewer than five words has one, the whole of
it. Repeated rows fall in one group; the smallest id names the group (a null id never does, unless it is alone). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .shipped import ship
from .stored import stored

SHINGLE_WORDS = 5
# 100 * intersection >= 80 * union, as the fraction 4 / 5
ALIKE = (4, 5)
CHUNK_CHARS = 8_000_000
ORDERS = 3
# Width of a size class in the join of candidates: sizes within about 2 %.
SIZE_CLASSES = 50

_PACKED = "part int, doc_id bigint, mark bigint, key bigint, n int, keys binary, counts binary, shingles binary, grades binary"
_SETS = "doc_id bigint, mark bigint, key bigint, n int, shingles array<bigint>, second array<bigint>, third array<bigint>, prefix int"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("keys", "counts", "shingles", "grades")])
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("key", pa.int64()), ("n", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("shingles", "second", "third")] + [("prefix", pa.int32())])


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=n)
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(3) + each[k : n - size + 1 + k])
    return np.unique(out)


def text_hash(text: str | None) -> int | None:
    """What Spark's ``xxhash64`` gives for a text; null for null."""
    return None if text is None else int(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64))


def _key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    n = len(sorted_columns[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _packed(part: np.ndarray, key: np.ndarray, shingles: np.ndarray, grades: np.ndarray | None = None) -> list[dict]:
    """One row per part, from columns sorted by part and key: keys, how many shingles each has, and these."""
    rows = []
    starts = np.append(_runs(part, key), len(key)).astype(np.int64)
    edges = np.searchsorted(part[starts[:-1]], np.unique(part)).tolist() + [len(starts) - 1]
    for low, high in zip(edges, edges[1:]):
        a, b = starts[low], starts[high]
        row = {"part": int(part[a]), "keys": key[starts[low:high]].tobytes(), "counts": np.diff(starts[low : high + 1]).astype(np.uint32).tobytes()}
        row["shingles"] = shingles[a:b].tobytes()
        if grades is not None:
            row["grades"] = grades[a:b].tobytes()
        rows.append(row)
    return rows


def _pack_texts(size: int, bits: int):
    """Step 1: rows of documents, and shingles by hash range."""

    def flush(ids: list, sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        rows = [{"part": k & ((1 << bits) - 1) if n else 0, "doc_id": d, "mark": m, "key": k if n else None, "n": n} for d, m, k, n in ids]
        if sets:
            hashes = np.concatenate(list(sets.values()))
            keys = np.repeat(np.fromiter(sets, dtype=np.int64, count=len(sets)), [len(s) for s in sets.values()])
            part = (hashes >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            five = ((hashes[order] << np.uint64(bits)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
            rows += _packed(part[order], keys[order], np.ascontiguousarray(five))
        return pa.RecordBatch.from_pylist(rows, schema=_PACKED_ARROW)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, chars = [], {}, 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                hashes = shingle_hashes(text, size)
                key = _key(hashes)
                ids.append((doc_id, text_hash(text), key, len(hashes)))
                if len(hashes):
                    sets[key] = hashes
                chars += len(text or "")
                if chars >= CHUNK_CHARS:
                    yield flush(ids, sets)
                    ids, sets, chars = [], {}, 0
            yield flush(ids, sets)

    return pack


def _unpack(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, shingles and grades of all packed rows."""
    table = table.filter(table["keys"].is_valid())
    joined = {c: b"".join(x.as_py() or b"" for x in table[c]) for c in ("keys", "counts", "shingles", "grades")}
    keys = np.repeat(np.frombuffer(joined["keys"], dtype=np.int64), np.frombuffer(joined["counts"], dtype=np.uint32))
    raw = np.frombuffer(joined["shingles"], dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :width] = raw
    return keys, wide.view(np.uint64).ravel(), np.frombuffer(joined["grades"], dtype=np.uint8)


def _count_shared(bits: int):
    """Step 2: shingles in two sets or more, with a grade of their frequency, packed by the range of their sets' keys."""

    def count(table: pa.Table) -> pa.Table:
        docs = table.filter(table["keys"].is_null())
        keys, shingles, _ = _unpack(table, 5)
        if not len(keys):
            return docs
        part = next(x.as_py() for x in table["part"])
        order = np.argsort(shingles, kind="stable")
        keys, shingles = keys[order], shingles[order]
        starts = np.append(_runs(shingles), len(shingles))
        several = np.repeat(np.diff(starts) > 1, np.diff(starts))
        keys, shingles = keys[several], shingles[several]
        order = np.lexsort((keys, shingles))
        keys, shingles = keys[order], shingles[order]
        once = _runs(shingles, keys)  # a set may come from several tasks
        keys, shingles = keys[once], shingles[once]
        starts = np.append(_runs(shingles), len(shingles)).astype(np.int64)
        sets = np.repeat(np.diff(starts), np.diff(starts))
        keys, shingles, sets = keys[sets > 1], shingles[sets > 1], sets[sets > 1]
        grades = np.minimum(np.log2(sets) * 8, 255).astype(np.uint8)
        target = (keys & ((1 << bits) - 1)).astype(np.int32)
        order = np.lexsort((keys, target))
        whole = np.uint64(part << 40) | shingles[order]
        rows = _packed(target[order], keys[order], whole, grades[order]) if len(order) else []
        return pa.concat_tables([docs, pa.Table.from_pylist(rows, schema=_PACKED_ARROW)])

    return count


def _sets(alike: tuple[int, int]):
    """Step 3: rows of documents, and the sets that have enough shared shingles for a link."""
    over, under = alike

    def sets(table: pa.Table) -> pa.Table:
        docs = table.filter(table["keys"].is_null())
        size = {k: n for k, n in zip(docs["key"].to_pylist(), docs["n"].to_pylist(), strict=True) if k is not None}
        keys, shingles, grades = _unpack(table, 8)
        order = np.argsort(keys, kind="stable")
        keys, shingles, grades = keys[order], shingles[order], grades[order]
        starts = np.append(_runs(keys), len(keys)).astype(np.int64)
        rows = docs.select(["doc_id", "mark", "key", "n"]).to_pylist()
        for a, b in zip(starts.tolist(), starts[1:].tolist()):
            key = int(keys[a])
            n = size[key]
            least = -(-over * n // under)
            if b - a < least:
                continue
            own, grade = shingles[a:b], grades[a:b]
            prefix = b - a - least + 1
            orders = [own[np.lexsort((mixed(own + np.uint64(k)), grade))] for k in range(ORDERS)]
            first, second, third = orders[0], *(o[:prefix] for o in orders[1:])
            rows.append({"key": key, "n": n, "shingles": first.view(np.int64), "second": second.view(np.int64), "third": third.view(np.int64), "prefix": prefix})
        return pa.Table.from_pylist(rows, schema=_SETS_ARROW)

    return sets


def _verified(pairs: DataFrame, sets: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets share prefix shingles under the other orders too and are alike."""
    over, under = alike
    left, right = (sets.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "shingles", "second", "third")]) for k in "ab")
    met = pairs.join(left, "a").join(right, "b")
    near = F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return met.filter(near).filter((over + under) * common >= over * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * SIZE_CLASSES).cast("int")


def _across(lists: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """Candidate pairs of different roots in the same prefix list, by size and position bounds.

    ``room`` is how many shared shingles a set has from this one on; a common set of that size at most bounds the partner's size.
    """
    over, under = alike
    several = lists.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle")
    lists = lists.join(several, "shingle")
    least = F.ceil(over * F.col("n") / under)
    most = F.least(F.col("n"), F.floor((over + under) * F.col("room") / over - F.col("n")))
    large = lists.withColumns({"least": least, "most": most}).filter("most >= least")
    classes = F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most"))))
    large = large.select("shingle", classes.alias("class"), *[F.col(c).alias(f"{c}_a") for c in ("key", "root", "n", "room")])
    small = lists.select("shingle", _size_class(F.col("n")).alias("class"), *[F.col(c).alias(f"{c}_b") for c in ("key", "root", "n", "room")])
    bound = (over + under) * F.least("room_a", "room_b") >= over * (F.col("n_a") + F.col("n_b"))
    order = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") > F.col("key_b")))
    on = [large[c] == small[c] for c in ("shingle", "class")] + [F.col("root_a") != F.col("root_b"), order, bound]
    return large.join(small, on).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def groups(documents: DataFrame, shingle: int = SHINGLE_WORDS, alike: tuple[int, int] = ALIKE, doc_id: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents``.

    Where ids repeat, ``mark`` names a further column that has the text's ``xxhash64``, so a row can be told from others of its id."""
    spark = documents.sparkSession
    ship(spark)
    # as many ranges as the session has shuffle partitions, up to a power of two: partitions are what users size to the data
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    packed = documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_pack_texts(shingle, bits), _PACKED)
    shared = packed.groupBy("part").applyInArrow(_count_shared(bits), _PACKED)
    found = stored(shared.groupBy("part").applyInArrow(_sets(alike), _SETS), "shingle-sets")
    rows = found.filter("shingles IS NULL").select("doc_id", "mark", "key", F.col("n").cast("long").alias("n_shingles"))
    sets = found.filter("shingles IS NOT NULL")

    lists = sets.select("key", "n", F.size("shingles").alias("m"), F.posexplode(F.slice("shingles", F.lit(1), F.col("prefix"))).alias("at", "shingle"))
    lists = lists.select("shingle", "key", "n", (F.col("m") - F.col("at")).alias("room"), ((F.col("n") - F.col("m")) / F.col("n")).alias("own"))
    lists = stored(lists, "prefix-lists")
    hubs = lists.groupBy("shingle").agg(F.min(F.struct("own", "key")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    votes = lists.join(hubs, "shingle").select("key", F.col("hub.key").alias("hub")).filter("key <> hub").groupBy("key", "hub").count()
    chosen = votes.groupBy("key").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    near = stored(_verified(chosen, sets, alike), "hub-links")
    rooted = components(near)

    lists = lists.join(rooted.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rest = stored(_verified(_across(lists, alike), sets, alike), "other-links")
    roots = components(near.union(rest)).withColumnRenamed("node", "key")

    rows = rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    rows = rows.join(names, "root", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"), *([] if mark is None else [F.col("mark").alias(mark)]), *([] if mark is None else [F.col("root").alias("component_key")]))


def kept_rows(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text and other columns) with one row of each group of near duplicates: that of the smallest id.

    A null id comes last; among different texts of the smallest id, the smallest ``xxhash64`` of a text stays, and of rows with equal id and
    text the one whose columns are the smallest. Rows without shingles are in no group and all stay.
    """
    marks = stored(groups(documents, mark="mark"), "near-duplicates").filter("component_key IS NOT NULL")
    marks = marks.groupBy("component_key", "doc_id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    best = marks.groupBy("component_key").agg(F.min(order).alias("best"))
    judged = stored(marks.join(best, "component_key").select("doc_id", "mark", "copies", (order != F.col("best")).alias("dropped")), "near-duplicates")
    # the rows that go or that have equals are the smaller side: most documents are in no group
    named = documents.withColumns({"_near_id": F.col("doc_id").cast("long"), "_near_mark": F.xxhash64("text")})

    def same(some: DataFrame):
        return named["_near_id"].eqNullSafe(some["doc_id"]) & (named["_near_mark"] == some["mark"])

    copied = judged.filter("copies > 1 AND NOT dropped")
    changed = judged.filter("copies > 1 OR dropped")
    alone = named.join(changed, same(changed), "left_anti").select(*documents.columns)
    equal = named.join(copied, same(copied), "left_semi").groupBy("_near_id", "_near_mark").agg(F.min(F.struct(*documents.columns)).alias("_row"))
    return alone.union(equal.select("_row.*"))
