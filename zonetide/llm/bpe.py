"""Byte-level BPE encoding and decoding, driven by a hierarchical-bitmap rank queue.

Text is cut into pre-tokens by a pattern; each pre-token's bytes are merged on their own. Adjacent pairs
wait in one bucket per merge rank; a two-level bitmap says which buckets hold something, so find-first-set
gives the next rank in constant time. Buckets hold positions of a linked list of tokens; entries whose pair
has changed since are skipped when they come up. A pre-token of n bytes costs O(n log n) however long it is.

Defined results: a null text encodes to no ids, and null ids decode to no bytes; so do empty ones. Repeated
rows are encoded each on its own. Bytes that are no valid UTF-8 survive decoding as they are.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .shipped import ship

# Entries of each of the two generations of a task's cache; the oldest generation goes when the younger is full.
CACHE_ENTRIES = 300_000
# Characters of texts that are merged together: bounds what a task holds besides one text.
TOGETHER = 8_000_000


class Merges:
    """The vocabulary as merges: the rank of the token that two adjacent tokens make, by both their ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.table = PairTable(self.pairs)


def merge(piece: bytes, merges: Merges) -> list[int]:
    """Ids of one pre-token: always merge the pair of lowest rank, the leftmost first.

    ``buckets`` holds the position of each rank's pair, or a heap of them; ``leaves`` a bitmap of the filled buckets among
    256 ranks, ``top`` a bitmap of the filled leaves. The queue is part of this function, as calls cost more than its work.
    """
    whole = merges.ranks.get(piece)
    if whole is not None:
        return [whole]
    get = merges.pairs.get
    n = len(piece)
    single = merges.single
    token = [single[b] for b in piece]
    if n == 1:
        return token
    after = list(range(1, n + 1))  # where the next token starts
    before = list(range(-1, n))
    waiting = [get(a << 32 | b, -1) for a, b in zip(token, token[1:])]  # rank of the pair that starts here; -1: none
    waiting.append(-1)
    buckets: dict = {}
    leaves: dict[int, int] = {}
    top = 0
    live = 0  # pairs that wait; entries beyond these are stale

    for i, rank in enumerate(waiting):
        if rank >= 0:
            live += 1
            if rank in buckets:
                held = buckets[rank]
                if held.__class__ is int:
                    buckets[rank] = [held, i]
                else:
                    held.append(i)
            else:
                buckets[rank] = i
                high = rank >> 8
                leaves[high] = leaves.get(high, 0) | 1 << (rank & 255)
                top |= 1 << high
    while live:
        high = (top & -top).bit_length() - 1
        leaf = leaves[high]
        rank = (high << 8) + (leaf & -leaf).bit_length() - 1
        i = buckets[rank]
        if i.__class__ is int:
            held = None
        else:
            held = i
            i = heappop(held)
        if not held:
            del buckets[rank]
            leaf &= leaf - 1
            leaves[high] = leaf
            if not leaf:
                top &= top - 1
        if waiting[i] != rank:
            continue
        gone = after[i]
        end = after[gone]
        after[i] = end
        token[i] = own = rank
        if waiting[gone] >= 0:
            waiting[gone] = -1
            live -= 1
        live -= 1
        waiting[i] = -1
        if end < n:
            before[end] = i
            rank = get(own << 32 | token[end])
            if rank is not None:
                waiting[i] = rank
                live += 1
                if rank in buckets:
                    held = buckets[rank]
                    if held.__class__ is int:
                        buckets[rank] = [held, i] if held < i else [i, held]
                    else:
                        heappush(held, i)
                else:
                    buckets[rank] = i
                    high = rank >> 8
                    leaves[high] = leaves.get(high, 0) | 1 << (rank & 255)
                    top |= 1 << high
        left = before[i]
        if left >= 0:
            if waiting[left] >= 0:
                live -= 1
                waiting[left] = -1
            rank = get(token[left] << 32 | own)
            if rank is not None:
                waiting[left] = rank
                live += 1
                if rank in buckets:
                    held = buckets[rank]
                    if held.__class__ is int:
                        buckets[rank] = [held, left] if held < left else [left, held]
                    else:
                        heappush(held, left)
                else:
                    buckets[rank] = left
                    high = rank >> 8
                    leaves[high] = leaves.get(high, 0) | 1 << (rank & 255)
                    top |= 1 << high
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: a token in base 64, a blank, its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class PairTable:
    """The merges as a hash table in arrays: ranks of many pairs at a time."""

    NONE = (1 << 31) - 1  # the token between two pre-tokens, which merges with nothing

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(4, (2 * len(pairs)).bit_length())
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.ranks[slots] < 0
            self.keys[slots[free]], self.ranks[slots[free]] = keys[free], ranks[free]
            lost = self.keys[slots] != keys  # another pair took the slot
            keys, ranks, slots = keys[lost], ranks[lost], (slots[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 for none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slot(keys)
        ranks = self.ranks[slots]
        on = np.flatnonzero((self.keys[slots] != keys) & (ranks >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) & ((1 << self.bits) - 1)
            ranks[on] = self.ranks[slots[on]]
            on = on[(self.keys[slots[on]] != keys[on]) & (ranks[on] >= 0)]
        return ranks


class RankQueue:
    """Buckets of list positions by merge rank, under a two-level bitmap that tells which buckets hold something."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        """Put each position into the bucket of its rank; a rank below 0 is none."""
        order = np.argsort(ranks, kind="stable")
        ranks = ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        ends = [*starts[1:], len(order)]
        positions = positions[order]
        for rank, start, end in zip(ranks[starts].tolist(), starts, ends):
            if rank < 0:
                continue
            held = self.buckets.get(rank)
            if held is not None:
                held.append(positions[start:end])
                continue
            self.buckets[rank] = [positions[start:end]]
            high = rank >> 8
            self.leaves[high] = self.leaves.get(high, 0) | 1 << (rank & 255)
            self.top |= 1 << high

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank that has positions, and these, ascending; some may be stale."""
        high = (self.top & -self.top).bit_length() - 1
        leaf = self.leaves[high]
        rank = (high << 8) + (leaf & -leaf).bit_length() - 1
        self.leaves[high] = leaf & (leaf - 1)
        if not self.leaves[high]:
            self.top &= self.top - 1
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


def merge_all(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of many pre-tokens, merged through one rank queue.

    All of them stand in one linked list, with a token that merges with nothing between two. A bucket is merged as a whole: among
    pairs of one rank, the leftmost of those that overlap. That is what merging one pair at a time comes to, unless a
    merge makes a pair of a lower rank than its own; pre-tokens where that happens are merged again, one pair at a time.
    """
    table = merges.table
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.cumsum(sizes + 1) - sizes
    raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
    token = np.array(merges.single, np.int32)[raw]
    n = len(token)
    token[0] = PairTable.NONE
    token[starts + sizes] = PairTable.NONE
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    waiting = np.full(n, -1, np.int32)
    waiting[:-1] = table.rank(token[:-1], token[1:])
    gone, chosen = np.zeros(n, bool), np.zeros(n, bool)
    gone[0] = True
    gone[starts + sizes] = True
    queue, odd = RankQueue(), []
    queue.push(np.arange(n, dtype=np.int32), waiting)
    while queue.top:
        rank, left = queue.pop()
        left = left[waiting[left] == rank]
        if not len(left):
            continue
        right = after[left]
        joined = right[:-1] == left[1:]
        if joined.any():  # x x x: take every other one of a run of overlapping pairs
            at = np.arange(len(left))
            run = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), at, 0))
            left = left[(at - run) % 2 == 0]
            right = after[left]
        end = after[right]
        chosen[left] = True
        beside = chosen[end]  # another pair of this rank follows; it is merged later than this one
        if beside.any():
            lower = table.rank(np.full(beside.sum(), rank, np.int32), token[end[beside]])
            odd.append(left[beside][(lower >= 0) & (lower < rank)])
        token[left] = rank
        gone[right] = True
        waiting[right] = -1
        after[left] = end
        before[end] = left
        ahead = before[left]
        ahead = ahead[~chosen[ahead]]
        chosen[left] = False
        changed = np.concatenate([left, ahead])
        ranks = table.rank(token[changed], token[after[changed]])
        waiting[changed] = ranks
        lower = (ranks >= 0) & (ranks < rank)
        if lower.any():
            odd.append(changed[lower])
        queue.push(changed, ranks)
    kept = ~gone
    ids = token[kept]
    # how many tokens are kept before each piece
    through = np.concatenate([[0], np.cumsum(kept)])
    offsets = np.append(through[starts], through[n])
    again = np.unique(np.searchsorted(starts, np.concatenate([np.zeros(0, np.int32), *odd]), side="right") - 1)
    if not len(again):
        return ids, offsets
    out = [ids[offsets[i] : offsets[i + 1]] for i in range(len(pieces))]
    for i in again.tolist():
        out[i] = np.array(merge(pieces[i], merges), np.int32)
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])


class Encoder:
    """Encodes and decodes texts by given ranks; keeps what it has merged, up to a bound.

    The cache is keyed by what stands between two single blanks. Such a part, with the blank before it, is cut
    into the same pre-tokens wherever it stands, unless it borders on more white space; a text with that is cut as a whole.
    What many texts lack in the cache is merged together.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merges = Merges(ranks)
        self.cut = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        self.tokens = {i: token for token, i in ranks.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pieces(self, part: str) -> list[str] | None:
        """The pre-tokens of the part after a blank; None if they depend on what stands around it."""
        if part.isalpha():
            return [" " + part]
        return None if not part or self.space(part[0]) or self.space(part[-1]) else self.cut(" " + part)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        known = self.young
        heads, missing, entire = [], set(), []
        for text in texts:  # the parts are not kept but split off again below: as objects they take many times the room of the text
            head, *rest = text.split(" ")
            alone = not rest or (head and not self.space(head[-1]))
            heads.append(self.cut(head if alone else text))
            entire.append(not alone)
            if alone:
                missing.update(rest)
        missing -= known.keys()
        known.update((part, self.old[part]) for part in missing & self.old.keys())
        cut = {part: self._pieces(part) for part in missing - known.keys()}
        loose = {part for part, own in cut.items() if own is None}
        if loose:
            for i, text in enumerate(texts):
                if not entire[i] and not loose.isdisjoint(text.split(" ")[1:]):
                    heads[i], entire[i] = self.cut(text), True
            cut = {part: own for part, own in cut.items() if own is not None}
        pieces: dict[str, bytes] = dict.fromkeys(piece for own in (*cut.values(), *heads) for piece in own)
        todo = []
        for piece in pieces:
            raw = piece.encode()
            whole = self.merges.ranks.get(raw)
            if whole is None:
                todo.append((piece, raw))
            else:
                pieces[piece] = whole.to_bytes(4, "little")
        if todo:
            ids, offsets = merge_all([raw for _, raw in todo], self.merges)
            data, at = ids.astype("<i4").tobytes(), (4 * offsets).tolist()
            for (piece, _), start, end in zip(todo, at, at[1:]):
                pieces[piece] = data[start:end]
        get = pieces.__getitem__
        for part, own in cut.items():
            known[part] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))
        ids = known.__getitem__
        return [b"".join(map(get, head)) + (b"" if done else b"".join(map(ids, text.split(" ")[1:]))) for head, text, done in zip(heads, texts, entire)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_parts(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """Ids of each text, in parts that are merged together: as many texts as have ``TOGETHER`` characters, or one."""
        some, size = [], 0
        for value in texts:
            text = value.as_py() or ""
            if some and size + len(text) > TOGETHER:
                yield self.encode_all(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        yield self.encode_all(some)

    def forget(self) -> None:
        """Give the room of the cache back; a worker outlives its task and would keep it through other stages."""
        self.young, self.old = {}, {}

    def decode(self, ids: bytes) -> bytes:
        """Bytes that 32-bit ids stand for."""
        return b"".join(map(self.tokens.__getitem__, array("i", ids)))


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(parse_ranks(data), pattern)


class Tokenizer:
    """Column functions for one vocabulary.

    ``path`` names a rank file that the driver can read; its bytes (under 1 MB for 50,000 ranks) are sent
    to the executors once. ``pattern`` cuts text into pre-tokens.
    """

    def __init__(self, df: DataFrame, path: str, pattern: str) -> None:
        ship(df.sparkSession)
        with open(path, "rb") as file:
            self._data = df.sparkSession.sparkContext.broadcast(file.read())
        self._pattern = pattern

    def encode(self, text: Column, decoded: bool = False) -> Column:
        """A struct with the ``ids`` of each text, an array of int, and their bytes again as ``decoded`` if asked for."""
        data, pattern = self._data, self._pattern
        fields = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())][: 1 + decoded]

        @F.arrow_udf(StructType(fields))
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(data.value, pattern)
            for rows in (part for texts in batches for part in encoder.encode_parts(texts)):
                columns = [_lists(rows)]
                if decoded:
                    columns.append(pa.array([encoder.decode(r) for r in rows], type=pa.binary()))
                yield pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, c.type) for f, c in zip(fields, columns, strict=True)])
            encoder.forget()

        return encoded(text)

    def count(self, text: Column) -> Column:
        """How many ids each text has, without sending them back."""
        data, pattern = self._data, self._pattern

        @F.arrow_udf(LongType())
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = _encoder(data.value, pattern)
            for rows in (part for texts in batches for part in encoder.encode_parts(texts)):
                yield pa.array([len(ids) // 4 for ids in rows], type=pa.int64())
            encoder.forget()

        return counted(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of each array of ids."""
        data, pattern = self._data, self._pattern

        @F.arrow_udf(BinaryType())
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            decode = _encoder(data.value, pattern).decode
            for rows in batches:
                yield pa.array([decode(r.values.to_numpy().astype(np.int32).tobytes() if r.is_valid else b"") for r in rows], type=pa.binary())

        return decoded(ids)


def _lists(rows: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))


def tokenize(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text`` in column ``ids`` and, if named, the bytes these stand for in ``decoded``."""
    coded = Tokenizer(df, path, pattern).encode(F.col(text), decoded is not None)
    out = df.withColumn("_coded", coded)
    out = out.withColumn(ids, F.col("_coded.ids"))
    return (out if decoded is None else out.withColumn(decoded, F.col("_coded.decoded"))).drop("_coded")
