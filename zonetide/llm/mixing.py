"""Mixing sources to target weights: exact quotas split down a tree of output shards.

Every source is a stream of its documents' words, cut into blocks of ``BLOCK`` words. Its target says how many blocks
the mix takes of it: all of them once or more, then some once more. Those quotas are split among the output shards by a binary
tree: a node holds the exact number of blocks of each source that its shards get, and a multivariate hypergeometric draw
decides how many of them go to its left half, as if the blocks had been dealt out at random. So every shard is
a random sample of the mix of exactly its size, and nothing is lost or doubled. A node's draw is seeded by its place in
the tree alone, so nodes are split in parallel, in any order, and again after a lost executor, with the same result.

A shard then draws its blocks: a keyed permutation of each source's blocks, a new one for every pass through the source, is cut
into the shards' quotas, so shards never share a block of a pass. Another keyed permutation gives the blocks' order inside
the shard. The block at which a source's target is met is cut there, so the words taken are the target, rounded.

Defined results: a null text has no words, documents without words are never drawn. The null source is a source, and the last.
Rows with the same id stand in the order of their sizes; a row is drawn by its place, not by its id. Equal rows have equal sizes and may
change places. If no document has words, targets are 0 and nothing is drawn. An empty table gives no rows. A document
of any length is spread over as many blocks as it needs. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .running import running
from .shipped import ship
from .stored import stored

BLOCK = 128  # words
SHARD_WORDS = 1 << 20
DRAWN_TOGETHER = 1 << 17  # blocks that a task draws, on average
LEVELS = 6  # of the splitting tree, that one job takes
ROUNDS = 32  # of the permutation
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """How many words a text has, 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- targets ---------------------------------------------------------------


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """``sources`` (number, weight, words) with the ``target`` of each: ``share`` of all words by weight, at most ``cap`` of its own.

    What a source can't take is dealt to the others by weight, until none is above its cap. A round is one aggregate over the
    sources, of which one row comes to the driver; there are as many rounds as it takes for no further source to reach its cap."""
    total = sources.agg(F.sum("words")).head()[0] or 0
    # The level is what a unit of weight gets. It only rises, so a source that has reached its cap stays there.
    level, full = 0.0, -1
    while True:
        reached = F.col("words") * cap <= F.col("weight") * F.lit(level)
        state = sources.agg(F.count_if(reached).alias("n"), F.coalesce(F.sum(F.when(reached, F.col("words"))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(~reached, F.col("weight"))), F.lit(0)).alias("weight")).head()
        if state.n == full or not state.weight:
            break
        full, rest, weight = state.n, share * total - cap * state.words, state.weight
        level = rest / weight
    if not total or full < 0:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.when(reached, F.col("words") * cap).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(weight))).cast("double"))


# ---- numpy parts -----------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers whose bits each depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(*parts: int) -> np.uint64:
    key = np.zeros(1, np.uint64)
    for part in parts:
        key = _mixed(key + np.array([part & (2**64 - 1)], np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return key[0]


def permuted(x: np.ndarray, n: int, *key: int, inverse: bool = False) -> np.ndarray:
    """Where a keyed permutation of ``range(n)`` puts each of ``x``.

    In every round an element changes places with its mirror image about a keyed point, if a keyed bit of the larger of both says
    so. A round undoes itself; the inverse takes them backwards."""
    x = np.asarray(x, np.int64)
    for step in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        own = _key(*key, step)
        other = (int(own) % n - x) % n
        bit = _mixed(np.maximum(x, other).astype(np.uint64) + own) & np.uint64(1)
        x = np.where(bit == 1, other, x)
    return x


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good, by inversion of the distribution about its mode; for any number of balls.

    Values more than 12 standard deviations away, of a probability below 1e-30, are left out."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    n = good + bad
    mean = drawn * (good / n)
    deviation = (mean * (bad / n) * ((n - drawn) / max(1, n - 1))) ** 0.5
    reach = 12 * deviation + 12
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach) + 1)
    x = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - x) * (drawn - x)) - np.log((x + 1) * (bad - drawn + x + 1)))])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(chances, rng.random() * chances[-1], side="right")), len(chances) - 1)


def _dealt(quotas: np.ndarray, drawn: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many blocks of each source are among ``drawn`` of all ``quotas``."""
    rng = np.random.Generator(np.random.PCG64(int(_key(*seed))))
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, good in enumerate(map(int, quotas)):
        rest -= good
        out[i] = hypergeometric(rng, good, rest, drawn)
        drawn -= int(out[i])
    return out


def _first_block(shard: int, shards: int, blocks: int) -> int:
    return shard * blocks // shards


def _split(node: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The nodes up to ``LEVELS`` below one, over its shards [low, high); a row for each with blocks of a source.

    ``offset`` counts the source's blocks in shards before, ``place`` the blocks of other sources before it in the node."""
    node = node.sort_values("source")
    low, high, shards, blocks = (int(node[c].iloc[0]) for c in ("low", "high", "shards", "blocks"))
    todo = [(low, high, node.quota.to_numpy(np.int64), node.offset.to_numpy(np.int64), 0)]
    rows = []
    while todo:
        low, high, quotas, offsets, level = todo.pop()
        if high - low == 1 or level == LEVELS:
            places = np.cumsum(quotas) - quotas
            rows.append(pd.DataFrame({"low": low, "high": high, "source": node.source.to_numpy(), "quota": quotas, "offset": offsets, "place": places, "shards": shards, "blocks": blocks})[quotas > 0])
            continue
        middle = (low + high) // 2
        left = _dealt(quotas, _first_block(middle, shards, blocks) - _first_block(low, shards, blocks), (seed, low, high))
        todo += [(low, middle, left, offsets, level + 1), (middle, high, quotas - left, offsets + left, level + 1)]
    return pd.concat(rows, ignore_index=True)


_NODE = "low long, high long, source long, quota long, offset long, place long, shards long, blocks long"


def split(quotas: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """``quotas`` (source, quota), ``blocks`` in all, dealt to ``shards`` shards: as ``_split`` has it, with high = low + 1."""
    nodes = quotas.filter("quota > 0").selectExpr("0L AS low", f"{shards}L AS high", "source", "quota", "0L AS offset", "0L AS place", f"{shards}L AS shards", f"{blocks}L AS blocks")
    while True:
        nodes = stored(nodes.groupBy("low", "high").applyInPandas(lambda node: _split(node, seed), _NODE), "mix-tree")
        if nodes.filter("high - low > 1").isEmpty():
            return nodes


def _cut(words: int, target: int, source: int, seed: int) -> tuple[int, int, int, int]:
    """(blocks, passes, quota, last) for a source: its blocks, whole passes through them, blocks to draw, words of the last one drawn."""
    n = -(-words // BLOCK)
    passes, rest = divmod(target, words)
    if not rest:
        return n, passes, passes * n, 0
    short = n * BLOCK - words  # words that the last block lacks, and when the next pass comes to it
    turn = int(permuted(np.array([n - 1]), n, seed, source, passes, inverse=True)[0])
    some = -(-rest // BLOCK)
    if turn < some and some * BLOCK - short < rest:
        some += 1
    through = some * BLOCK - (short if turn < some else 0)
    length = BLOCK - (short if turn == some - 1 else 0)
    return n, passes, passes * n + some, length - (through - rest)


def mix(documents: DataFrame, size: Column, source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 12, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, draws): what is mixed, and what of it each output shard takes, in which order.

    Sources by code point take ``weights`` in turn. The first has ``place`` (a number for each row), key, source, size, source_size and
    target; the second shard, turn (the order in the shard), place, pass, first_word and n_words: a run of words of a document.
    A block holds runs of several documents; they share its turn and are told apart by ``place``. A shard has about
    ``shard_words`` words."""
    spark = documents.sparkSession
    ship(spark)
    sized = documents.select(F.col(key).alias("_key"), F.col(source).alias("_source"), size.cast("long").alias("_size"))
    sized = sized.withColumn("_last", F.col("_source").isNull())
    sized = running(sized, ["_last", "_source", "_key", "_size"], {"before": "_size"}, row="place", name="mix-documents")
    sources = sized.groupBy("_last", F.col("_source").alias("name")).agg(F.sum("_size").alias("words"), F.min("before").alias("start"))
    sources = running(sources, ["_last", "name"], row="number", name="mix-sources")
    turns = F.array(*[F.lit(w) for w in weights])
    sources = sources.withColumn("weight", F.get(turns, (F.col("number") % len(weights)).cast("int")))
    sources = stored(targets(sources, share, cap), "mix-targets")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [_cut(w, int(t + 0.5), n, seed) for w, t, n in zip(rows.words, rows.target, rows.number)]
            yield pd.DataFrame({"number": rows.number} | {c: [f[i] for f in found] for i, c in enumerate(("n", "passes", "quota", "last"))})

    plan = sources.filter("words > 0").select("number", "words", "target").mapInPandas(cut, "number long, n long, passes long, quota long, last long")
    plan = stored(plan, "mix-quotas")
    blocks = plan.agg(F.sum("quota")).head()[0] or 0
    shards = max(1, -(-blocks * BLOCK // shard_words))
    leaves = split(plan.select(F.col("number").alias("source"), "quota"), shards, blocks, seed)
    facts = plan.join(sources.select("number", "words"), "number").select(F.col("number").alias("source"), "n", "passes", F.col("quota").alias("drawn"), "last", "words")
    # few rows that each make many: they are dealt out by the number of blocks, not by their own size
    draws = leaves.join(facts, "source").repartition(-(-max(1, blocks) // DRAWN_TOGETHER))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                yield _drawn(r, seed)

    # a leaf of the tree is a row, its blocks are at most a shard's
    draws = draws.mapInPandas(draw, "shard long, turn long, source long, pass long, block long, takes long")
    draws = stored(draws, "mix-draws")  # its true size decides how it is joined, not that of the rows it is made from
    joined = sized.join(sources.select("name", F.col("_last").alias("last_name"), "words", "target", "number", "start"), F.col("_source").eqNullSafe(F.col("name")))
    first = F.col("before") - F.col("start")
    out = joined.select("place", F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), F.col("words").alias("source_size"), "target")
    pieces = joined.filter("_size > 0").select("place", F.col("number").alias("source"), first.alias("from"), (first + F.col("_size")).alias("to"))
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.expr(f"`from` div {BLOCK}"), F.expr(f"(`to` - 1) div {BLOCK}"))))
    start = F.col("block") * BLOCK
    runs = draws.join(pieces, ["source", "block"])
    begin, end = F.greatest("from", start), F.least("to", start + F.col("takes"))
    runs = runs.withColumn("n_words", end - begin).filter("n_words > 0")
    return out, runs.select("shard", "turn", "place", "pass", (begin - F.col("from")).alias("first_word"), "n_words")


def _drawn(leaf, seed: int) -> pd.DataFrame:
    """The blocks of one source in one shard."""
    rank = np.arange(leaf.offset, leaf.offset + leaf.quota, dtype=np.int64)
    passes, turn = rank // leaf.n, rank % leaf.n
    block = np.empty_like(rank)
    for p in np.unique(passes):
        own = passes == p
        block[own] = permuted(turn[own], leaf.n, seed, leaf.source, int(p))
    takes = np.where(block == leaf.n - 1, leaf.words - (leaf.n - 1) * BLOCK, BLOCK)
    if leaf.last:
        takes = np.where(rank == leaf.drawn - 1, leaf.last, takes)
    size = _first_block(leaf.low + 1, leaf.shards, leaf.blocks) - _first_block(leaf.low, leaf.shards, leaf.blocks)
    places = permuted(leaf.place + np.arange(leaf.quota), size, seed, -1 - leaf.low)
    return pd.DataFrame({"shard": leaf.low, "turn": places, "source": leaf.source, "pass": passes, "block": block, "takes": takes})


def taken(documents: DataFrame, draws: DataFrame) -> DataFrame:
    """``documents`` with the words that ``draws`` takes of each row, repeats counted."""
    named = [c for c in documents.columns if c != "place"]
    blank = [F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in named]
    both = documents.select("place", *named, F.lit(0).cast("long").alias("taken"), F.lit(True).alias("_row"))
    both = both.union(draws.select("place", *blank, "n_words", F.lit(False)))
    kept = F.max_by(F.struct(*named), F.when(F.col("_row"), 1)).alias("_d")
    return both.groupBy("place").agg(kept, F.sum("taken").alias("taken")).select(*[F.col(f"_d.{c}").alias(c) for c in named], "taken")
