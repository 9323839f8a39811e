"""Substring dedup by content-defined chunking.

A gear hash rolls over the last 16 bytes of a text and cuts where it is small, so cuts depend on what stands there and
not on where it stands: text that is shifted by an insertion is cut the same a few bytes later. Chunks are compared by a 64-bit digest
over all documents; neighbouring chunks that other documents have too make up a repeated passage.

Layout: Python tasks cut texts and pack chunks by digest range; a task per range finds the digests of two documents or more and
the first place of each, and sends only these on, by ranges of document ids; a task per id range joins neighbours to passages.
A passage that very many documents share is one row per document and chunk in every step, never pairs.

A passage of w words is found whole but for its ends, about 5 words on either side (up to the first and from the last cut), so the
bound on words is set lower than the passages that matter are long.

Defined results: null, empty and short texts have no passages; rows without an id name no document and are left out; rows of one id are one
document, so repeats inside a document, or repeated rows, don't count as repeats across documents. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shipped import ship
from .stored import stored

# Words of whole chunks a passage has at least. Passages of more than 50 words lose about 10 at their ends.
LEAST_WORDS = 28
# One byte in so many ends a chunk, and the bytes after which a chunk ends in any case.
RATE = 14
LONGEST = 1024
CHUNK_BYTES = 8_000_000

_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_FOUND = np.dtype([("doc", "<i8"), ("digest", "<u8"), ("start", "<u4"), ("size", "<u2"), ("words", "<u2")])
_SHARED = np.dtype([("doc", "<i8"), ("start", "<u4"), ("size", "<u2"), ("words", "<u2"), ("first", "<i8"), ("first_start", "<u4")])
_PACKED = pa.schema([("part", pa.int32()), ("rows", pa.binary())])
_PASSAGES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# Random values of bytes for the rolling hash and for digests, from a rule.
_GEAR = (_mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(40)).astype(np.uint16)
_VALUES = _mixed(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes."""
    rolling = _GEAR[data]
    for step in (1, 2, 4, 8):  # the hash of 2, 4, 8 and at last 16 bytes
        longer = rolling.copy()
        longer[step:] += rolling[:-step] << np.uint16(step)
        rolling = longer
    ends = np.flatnonzero(rolling < 65536 // RATE) + 1
    ends = np.unique(np.append(ends, len(data)))
    gaps = np.diff(ends, prepend=0)
    if gaps.max(initial=0) > LONGEST:
        more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends, digests and words that begin in them, of a text's chunks."""
    data = np.frombuffer(text, dtype=np.uint8)
    ends = cuts(data)
    starts = np.append(0, ends[:-1])
    total = np.append(np.uint64(0), np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), dtype=np.uint64))
    # the digest is that of the chunk's bytes alone: its first one always counts with power 0
    digests = _mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    space = _SPACES[data]
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.append(0, np.cumsum(begins))
    return ends, digests, words[ends] - words[starts]


def _split(rows: np.ndarray, part: np.ndarray) -> list[dict]:
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    found, starts = np.unique(part, return_index=True)
    bounds = np.append(starts, len(rows)).tolist()
    return [{"part": int(p), "rows": rows[a:b].tobytes()} for p, a, b in zip(found, bounds, bounds[1:])]


def _cut(bits: int):
    def flush(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found) if found else np.zeros(0, dtype=_FOUND)
        return pa.RecordBatch.from_pylist(_split(rows, (rows["digest"] >> np.uint64(64 - bits)).astype(np.int32)), schema=_PACKED)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").encode()
                if not text:
                    continue
                ends, digests, words = chunks(text)
                own = np.zeros(len(ends), dtype=_FOUND)
                own["doc"], own["digest"], own["words"] = doc_id, digests, words
                own["start"] = np.append(0, ends[:-1])
                own["size"] = ends - own["start"]
                found.append(own)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield flush(found)
                    found, size = [], 0
            yield flush(found)

    return cut


def _rows(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table["rows"]), dtype=kind)


def _begins(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _share(bits: int):
    def share(table: pa.Table) -> pa.Table:
        rows = _rows(table, _FOUND)
        order = np.argsort(rows["digest"], kind="stable")
        group = np.cumsum(_begins(rows["digest"][order])) - 1
        rows = rows[order[np.bincount(group)[group] > 1]]
        order = np.lexsort((rows["start"], rows["doc"], rows["digest"]))
        rows = rows[order]
        new = _begins(rows["digest"]) if len(rows) else np.zeros(0, dtype=bool)
        group = np.cumsum(new) - 1
        first = rows[np.flatnonzero(new)][group]
        documents = np.bincount(group, _begins(rows["digest"], rows["doc"]) if len(rows) else None)
        several = documents[group] > 1 if len(rows) else new
        out = np.zeros(int(several.sum()), dtype=_SHARED)
        for name in ("doc", "start", "size", "words"):
            out[name] = rows[name][several]
        out["first"], out["first_start"] = first["doc"][several], first["start"][several]
        return pa.Table.from_pylist(_split(out, (out["doc"] & ((1 << bits) - 1)).astype(np.int32)), schema=_PACKED)

    return share


def _passages(least_words: int):
    def passages(table: pa.Table) -> pa.Table:
        rows = _rows(table, _SHARED)
        rows = rows[np.lexsort((rows["size"], rows["start"], rows["doc"]))]
        new = _begins(rows["doc"])
        new[1:] |= rows["start"][1:] > rows["start"][:-1] + rows["size"][:-1]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        fresh = _begins(rows["doc"], rows["start"])  # repeated rows give the same chunk again
        words = np.bincount(group, rows["words"] * fresh, len(at)).astype(np.int64)
        last = np.append(at[1:], len(rows)) - 1
        end = rows["start"][last].astype(np.int64) + rows["size"][last]
        # the place most chunks of the passage were first seen: the document with the most bytes
        by = np.lexsort((rows["first"], group))
        run = _begins(group[by], rows["first"][by])
        share = np.bincount(np.cumsum(run) - 1, rows["size"][by])
        heads = by[np.flatnonzero(run)]
        best = np.lexsort((rows["first"][heads], -share, group[heads]))
        first = rows["first"][heads[best[_begins(group[heads[best]])]]]
        keep = words >= least_words
        start = rows["start"][at].astype(np.int64)
        columns = [rows["doc"][at], start, end - start, words, first]
        return pa.table([pa.array(c[keep], type=pa.int64()) for c in columns], schema=_PASSAGES)

    return passages


def repeated_passages(documents: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_bytes, n_words, first_doc_id): passages of a document that other documents have too.

    ``start`` counts bytes of the UTF-8 text. ``first_doc_id`` is the smallest id that has (most of) the passage: there it stays.
    """
    spark = documents.sparkSession
    ship(spark)
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    packed = texts.mapInArrow(_cut(bits), "part int, rows binary")
    shared = packed.groupBy("part").applyInArrow(_share(bits), "part int, rows binary")
    kinds = "doc_id bigint, start bigint, n_bytes bigint, n_words bigint, first_doc_id bigint"
    return shared.groupBy("part").applyInArrow(_passages(least_words), kinds)


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``documents`` with each repeated passage left only in the first document that has it."""
    found = stored(repeated_passages(documents, least_words, doc_id, text).filter("doc_id <> first_doc_id"), "repeats")
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "n_bytes"))).alias("_spans"))
    joined = documents.join(spans, F.col(doc_id).cast("long") == F.col("_id"), "left")
    data = F.col(text).cast("binary")

    def step(done: Column, span: Column) -> Column:
        piece = F.substring(data, done["at"] + 1, F.greatest(span["start"].cast("int") - done["at"], F.lit(0)))
        return F.struct(F.concat(done["out"], piece).alias("out"), F.greatest(done["at"], (span["start"] + span["n_bytes"]).cast("int")).alias("at"))

    begin = F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at"))
    rest = F.aggregate("_spans", begin, step, lambda done: F.concat(done["out"], F.substring(data, done["at"] + 1, F.octet_length(data))))
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(rest.cast("string"))).select(*documents.columns)
