"""The prefix trie of conversations, by ROLLUP over the positions of their turns.

A conversation's turns are dealt to blocks of ``WIDTH`` columns, one column a position. ROLLUP over these columns counts all
prefixes that end inside a block together, and ``grouping_id`` tells how deep each one is. A block is keyed by the node that
the block before it ended at, so a long conversation is a few more rows of the same aggregate and not another job: the key of a
node is the exclusive or of two 64-bit hashes of (position, turn) over its path, a running total that needs no order of work.
A turn is known by 128 bits of the SHA-256 of its role and text.

Sums over subtrees are sums over conversations. The smallest member of a node stands for it, and of all nodes below it on its
own path; so each conversation c stands for its nodes from one depth f on. Of a node u at depth d, a member c with f > d shares
with others the texts from d to f - 1, which is what it saves; c adds a child if f <= d + 1 <= its length; and c adds
a leaf if its last node is one that it stands for and where no member goes on. A first ROLLUP finds f, a second one sums.

No list of a node's members is ever held: the ids that end at a node are joined to texts in runs of ``RUN`` ids, and a hash
streams over those texts in order.

Defined results: rows without a conversation id belong to no conversation. Turns ascend, null first; equal ones stand in the order
of the digest of role and text, so repeated rows are turns each. A null role or text is empty. A conversation without turns is a member of
the root only. An empty table has no nodes. Other columns don't matter, whatever their names. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .running import running
from .shipped import ship
from .stored import stored

WIDTH = 8
RUN = 4096
SHARED = 8  # the most first turns that a conversation takes from another one


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_bytes) of every row; the text itself is needed no more."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 32))
    rows = conversations.filter(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def _shared(conv: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % (SHARED + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each took its first turns from the conversation ``conv_id - conv_id % 5``.

    The first has conv_id and length, the second conv_id, pos, digest and n_bytes; positions count from 0. A base gives at most
    ``SHARED`` turns to the few conversations around it, so copies are bounded."""
    placed = running(turns, ["conv_id", "turn", "digest"], row="at", name="turns")
    convs = placed.groupBy("conv_id").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    convs = stored(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = F.col("conv_id") - F.col("conv_id") % 5
    known = convs.withColumn("base", own).join(bases, "base", "left").withColumn("h", _shared(F.col("conv_id")))
    known = known.withColumns({"kept": F.least("h", F.coalesce("n_base", F.lit(0))), "rest": F.greatest(F.col("n") - F.col("h"), F.lit(0))})
    known = known.select("conv_id", "start", "h", "kept", (F.col("kept") + F.col("rest")).alias("length"))
    at = F.col("at") - F.col("start")
    kept = placed.join(known, "conv_id").filter(at >= F.col("h")).select("conv_id", (F.col("kept") + at - F.col("h")).alias("pos"), "digest", "n_bytes")
    heads = placed.filter("conv_id % 5 = 0").join(convs, "conv_id").withColumn("pos", at).filter(F.col("pos") < SHARED)
    near = heads.select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes", F.explode(F.array(*[F.lit(k) for k in range(-4, 5)])).alias("k"))
    near = near.withColumn("conv_id", F.col("base") + F.col("k")).filter((own == F.col("base")) & (F.col("pos") < _shared(F.col("conv_id"))))
    copied = near.join(convs.select("conv_id"), "conv_id", "left_semi").select("conv_id", "pos", "digest", "n_bytes")
    return known.select("conv_id", "length"), kept.unionByName(copied)


def _hash(seed: int, pos: Column, digest: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("long"), digest)


def column_blocks(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each ``WIDTH`` turns of a conversation: the turns as columns t0, t1, .., the bytes up to each, and the node before.

    That node is (ka, kb) at depth ``WIDTH * block``; ``before`` are the bytes of all texts up to it, ``total`` those of the
    conversation, ``enda`` and ``endb`` the key of its last node. A conversation without turns has one row, of nulls."""
    at = F.col("pos") % WIDTH
    columns = [F.max(F.when(at == k, F.col("digest"))).alias(f"t{k}") for k in range(WIDTH)]
    sizes = [F.coalesce(F.sum(F.when(at == k, F.col("n_bytes"))), F.lit(0)).alias(f"b{k}") for k in range(WIDTH)]
    both = [F.bit_xor(_hash(seed, F.col("pos"), F.col("digest"))).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    blocks = turns.groupBy("conv_id", F.expr(f"pos div {WIDTH}").alias("block")).agg(*columns, *sizes, *both, F.sum("n_bytes").alias("bytes"))
    blank = conversations.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"))
    blocks = blocks.unionByName(blank, allowMissingColumns=True)
    blocks = running(blocks, ["conv_id", "block"], {"sofar": "bytes"}, {"xa": "a", "xb": "b"}, row="at", name="turn-blocks")
    first = F.min_by(F.struct("xa", "xb", "sofar"), "block")
    ends = [F.coalesce(F.bit_xor(c), F.lit(0)).alias(f"end{c}") for c in ("a", "b")]
    whole = blocks.groupBy("conv_id").agg(first.alias("s"), *ends, F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    whole = whole.join(conversations, "conv_id")
    out = blocks.join(whole, "conv_id")
    key = [F.col("xa").bitwiseXOR(F.col("s.xa")).alias("ka"), F.col("xb").bitwiseXOR(F.col("s.xb")).alias("kb")]
    kept = [f"t{k}" for k in range(WIDTH)] + [F.coalesce(f"b{k}", F.lit(0)).alias(f"b{k}") for k in range(WIDTH)]
    return out.select("conv_id", "block", *key, *kept, (F.col("sofar") - F.col("s.sofar")).alias("before"), "total", "length", "enda", "endb")


def _rolled(blocks: DataFrame, sums: dict[str, str]) -> DataFrame:
    """A row for each node, from one ROLLUP; ``depth`` and ``up`` (bytes of the texts before its last one) may stand in ``sums``.

    Columns: block, level, depth, the node's key (na, nb), its parent's (pa, pb), rep (its smallest member) and ``sums``."""
    names = [f"t{k}" for k in range(WIDTH)]
    # each rolled-up column sets a bit, the last column the lowest
    level = f"({WIDTH} - CAST(bit_count(grouping_id({', '.join(['block', 'ka', 'kb', *names])})) AS INT))"
    ups = ["0", "before", *["before + " + " + ".join(f"b{i}" for i in range(k)) for k in range(1, WIDTH)]]
    words = {"depth": f"(block * {WIDTH} + {level})", "up": f"element_at(array({', '.join(ups)}), {level} + 1)"}
    chosen = ", ".join(f"{expr.format(**words)} AS {name}" for name, expr in sums.items())
    rolled = blocks.sparkSession.sql(
        f"SELECT block, ka, kb, {', '.join(names)}, {level} AS level, {words['depth']} AS depth, min(conv_id) AS rep, {chosen} FROM {{blocks}} GROUP BY block, ka, kb, ROLLUP({', '.join(names)})",
        blocks=blocks,
    )
    last = F.get(F.array(*names), F.col("level") - 1)
    rolled = rolled.filter(((F.col("level") == 0) & (F.col("block") == 0)) | ((F.col("level") > 0) & last.isNotNull()))

    def key(seed: int, start: str, upto: Column) -> Column:
        out = F.col(start)
        for k, name in enumerate(names):
            own = _hash(seed, F.col("block") * WIDTH + k, F.col(name))
            out = out.bitwiseXOR(F.when(F.lit(k) < upto, own).otherwise(F.lit(0)))
        return out

    keys = [key(seed, start, F.col("level") - gone).alias(p + c) for p, gone in (("n", 0), ("p", 1)) for seed, start, c in ((1, "ka", "a"), (2, "kb", "b"))]
    return rolled.select("block", "level", "depth", *keys, "rep", *sums)


def ends_digests(conversations: DataFrame) -> DataFrame:
    """(depth, na, nb, ends): SHA-256 of the ids of the conversations that end at a node, ascending, with commas between.

    ``conversations``: conv_id, depth, na, nb. Ids are joined in runs of ``RUN``; a task streams over its nodes' runs in order and keeps
    one hash, however many ids a node has."""
    ship(conversations.sparkSession)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    runs = conversations.groupBy("depth", "na", "nb", F.expr(f"shiftright(conv_id, {RUN.bit_length() - 1})").alias("run")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            rows = []
            for depth, a, b, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "na", "nb", "ids")]):
                if (depth, a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    rows.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(ids.encode())
            yield _batch(rows)
        if node is not None:
            yield _batch([(*node, state.hexdigest())])

    dealt = runs.repartition("depth", "na", "nb").sortWithinPartitions("depth", "na", "nb", "run").select("depth", "na", "nb", "ids")
    return dealt.mapInArrow(hashed, "depth long, na long, nb long, ends string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names=["depth", "na", "nb", "ends"])


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends.

    ``conversations`` has conv_id and length, ``turns`` conv_id, pos, digest and n_bytes. ``ends`` is null where no conversation ends."""
    blocks = stored(column_blocks(conversations, turns), "turn-columns")
    nodes = _rolled(blocks, {"up": "max({up})", "longest": "max(length)"})
    stands = nodes.groupBy(F.col("rep").alias("conv_id")).agg(F.min("depth").alias("f"), F.min_by("up", "depth").alias("upto"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    told = blocks.join(stands, "conv_id", "left").withColumns({"upto": F.coalesce("upto", "total"), "leaf": F.coalesce("leaf", F.lit(False))})
    alone = "(f IS NULL OR f > {depth})"
    sums = {
        "n_convs": "count(1)",
        "n_children": "count_if(f <= {depth} + 1 AND {depth} < length)",
        "n_leaves": "count_if(leaf)",
        "saved_tokens": f"coalesce(sum(CASE WHEN {alone} THEN upto - {{up}} END), 0)",
        "begins": "min_by(f, conv_id)",
    }
    nodes = stored(_rolled(told, sums), "trie-nodes")
    # a node's smallest member mostly stands for the parent too; only where it doesn't, the parent is looked up
    own = F.when(F.col("begins") < F.col("depth"), F.col("rep"))
    first = nodes.filter("begins = depth AND depth > 0").select("depth", "na", "nb", (F.col("depth") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    above = nodes.select(F.col("depth").alias("d"), F.col("na").alias("a"), F.col("nb").alias("b"), F.col("rep").alias("parent"))
    parents = first.join(above, ["d", "a", "b"]).select("depth", "na", "nb", "parent")
    last = blocks.filter("block = 0").select("conv_id", F.col("length").alias("depth"), F.col("enda").alias("na"), F.col("endb").alias("nb"))
    out = nodes.join(parents, ["depth", "na", "nb"], "left").join(ends_digests(last), ["depth", "na", "nb"], "left")
    return out.select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.coalesce(own, "parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"), "ends",
    )
