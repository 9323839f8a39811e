"""A Merkle manifest of a dataset, climbed by a recursive query.

Every row is a leaf: the SHA-256 of its values, each written with its length. Rows of a group (a language) ascend by id and
are hashed together, ``FAN`` consecutive nodes at a time, until one node is left, the group's root; the group roots
are hashed together in the same way. Digests enter a hash as lowercase hexadecimal text.

Built levels are stored as node rows linked to their parents. To touch storage a few times and not once a level, a node row
stands for ``DEPTH`` levels: it has the siblings on the way to its ancestor ``DEPTH`` levels above, and links to that. All
levels inside such a subtree are built together from its at most ``FAN ** DEPTH`` nodes, so no task or group is larger.
The climb is a recursive common table expression: it starts at every leaf, joins the node row it has reached, appends
its siblings to the proof and folds them into the hash. Nodes near the root have very many leaves below; they are
stored in copies, one for every ``SPREAD`` leaves, so no join key has more rows than that.

Defined results: a null value is hashed as ``-`` and an empty one as ``0:``. Null groups and null ids come first. Rows with the
same id stand in the order of their leaves' digests, so repeated rows are leaves of their own beside each other. A group of
one row has its leaf as root, and one group's root is the root of all. An empty table has no rows. Columns that aren't
asked for don't matter, whatever their names. Texts enter a hash whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path
from .running import running
from .stored import stored

FAN = 2
DEPTH = 10
SPREAD = 1 << 18
ALL = -1  # the tree of the groups' roots; groups are numbered from 0


def leaf_digest(values: list[Column]) -> Column:
    """The hash of a row: each value's UTF-8 length, a colon and the value; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _height(size: Column, fan: int) -> Column:
    """Levels above the leaves of a tree of so many."""
    powers = [fan**k for k in range(63) if fan**k < 1 << 62]
    return sum((F.when(size > F.lit(p), 1).otherwise(0) for p in powers), F.lit(0))


def _above(level: Column, fan: int) -> Column:
    """The hashes of every ``fan`` consecutive digests."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / fan).cast("int") - 1)
    return F.transform(runs, lambda i: _hash(F.array_join(F.slice(level, i * fan + 1, F.lit(fan)), "")))


def _tier(nodes: DataFrame, tier: int, fan: int, depth: int) -> DataFrame:
    """Subtrees of ``fan ** depth`` nodes, each with its ``top`` and with the ``path`` from each of its nodes to that.

    ``nodes``: tree, height, pos, digest, lo, hi, payload. What a subtree at the right edge lacks is no node; the climb
    inside stops at the root of the tree."""
    block = fan**depth
    item = F.struct("pos", "digest", "lo", "hi", "payload")
    out = nodes.groupBy("tree", "height", F.expr(f"pos div {block}").alias("above")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = out.withColumn("steps", F.least(F.lit(depth), F.col("height") - tier * depth))
    out = out.withColumn("l0", F.transform("items", lambda x: _hex(x.digest)))
    for k in range(1, depth + 1):
        out = out.withColumn(f"l{k}", _above(F.col(f"l{k - 1}"), fan))
    out = out.withColumn("levels", F.array(*[F.col(f"l{k}") for k in range(depth + 1)]))
    powers = F.array(*[F.lit(fan**k) for k in range(depth)])

    def siblings(i: Column, j: Column) -> Column:
        level, at = F.get("levels", j), F.floor(i / F.get(powers, j)).cast("int")
        first = F.floor(at / fan).cast("int") * fan
        left = F.array_join(F.slice(level, first + 1, at - first), "")
        right = F.array_join(F.slice(level, at + 2, first + (fan - 1) - at), "")
        return F.struct(F.unhex(left).alias("left"), F.unhex(right).alias("right"))

    steps = F.slice(F.array(*[F.lit(k) for k in range(depth)]), F.lit(1), F.col("steps"))
    paths = F.transform("items", lambda x, i: x.withField("path", F.transform(steps, lambda j: siblings(i, j))))
    top = F.unhex(F.get(F.get("levels", F.col("steps")), F.lit(0)))
    return out.select("tree", "height", F.lit(tier).alias("tier"), "above", top.alias("top"), F.array_min("items.lo").alias("lo"), F.array_max("items.hi").alias("hi"), paths.alias("items"))


def _build(leaves: DataFrame, max_height: int, fan: int, depth: int, name: str) -> list[DataFrame]:
    """All tiers of all trees, each stored: a row for every subtree."""
    tiers, nodes = [], leaves
    for tier in range(max(1, -(-max_height // depth))):
        tiers.append(stored(_tier(nodes, tier, fan, depth), f"{name}-{tier}"))
        going_on = tiers[-1].filter(F.col("height") > (tier + 1) * depth)
        nodes = going_on.select("tree", "height", F.col("above").alias("pos"), F.col("top").alias("digest"), "lo", "hi", F.lit(None).cast("int").alias("payload"))
    return tiers


def _finished(tiers: list[DataFrame], depth: int) -> DataFrame:
    """(tree, digest, lo, hi): the root of each tree, from the tier that reaches it."""
    out = None
    for tier, built in enumerate(tiers):
        some = built.filter(F.col("height") <= (tier + 1) * depth).select("tree", F.col("top").alias("digest"), "lo", "hi")
        out = some if out is None else out.union(some)
    return out


def _linked(built: DataFrame, depth: int) -> DataFrame:
    """Node rows of one tier: what a node passes on the way up, and which node row comes next; none above the root of all."""
    rows = built.select("tree", "height", "tier", "above", F.inline("items"))
    inside = F.col("height") > (F.col("tier") + 1) * depth
    group = F.col("tree") != ALL
    link = {
        "next_tree": F.when(inside, F.col("tree")).when(group, F.lit(ALL)),
        "next_tier": F.when(inside, F.col("tier") + 1).when(group, F.lit(0)),
        "next_pos": F.when(inside, F.col("above")).when(group, F.col("tree")),
    }
    return rows.select("tree", "tier", "pos", "lo", "hi", "payload", "path", *[c.cast("long").alias(n) for n, c in link.items()])


_FOLD = "unhex(aggregate({path}, lower(hex({start})), (h, s) -> sha2(CAST(concat(lower(hex(s.left)), h, lower(hex(s.right))) AS BINARY), 256)))"
_SIBLINGS = "aggregate({path}, {start}, (p, s) -> concat(p, s.left, s.right))"

_CLIMB = f"""WITH RECURSIVE climb(row, tree, tier, pos, folded, proof, payload, own) AS (
    SELECT lo, next_tree, next_tier, next_pos, {_FOLD.format(path="path", start="payload.start")}, {_SIBLINGS.format(path="path", start="X''")}, payload, tree FROM {{leaves}}
    UNION ALL
    SELECT c.row, n.next_tree, n.next_tier, n.next_pos, {_FOLD.format(path="n.path", start="c.folded")}, {_SIBLINGS.format(path="n.path", start="c.proof")}, c.payload, c.own
    FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.tier = c.tier AND n.pos = c.pos AND n.copy = c.row div {{spread}})
  SELECT own, payload, folded, proof FROM climb WHERE tree IS NULL"""  # fmt: skip


def manifest(documents: DataFrame, values: list[str], group: str, key: str, tampered: Column | None = None, fan: int = FAN, depth: int = DEPTH, spread: int = SPREAD) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded_root): a leaf for every row of ``documents``, over the columns ``values``.

    ``proof`` has the siblings from the leaf up to the root, level by level and from left to right, 32 bytes each.
    ``folded_root`` is the root recomputed from them and from the leaf, or from ``tampered`` where that gives another digest
    for a row. ``leaf``, ``subroot`` and ``root`` are of the rows as they are. All digests are binary.
    """
    spark = documents.sparkSession
    leaf = leaf_digest([F.col(v) for v in values])
    other = F.lit(None).cast("binary") if tampered is None else tampered
    rows = documents.select(F.col(group).alias("grp"), F.col(key).alias("id"), leaf.alias("leaf"), other.alias("other"))
    rows = running(rows, ["grp", "id", "leaf"], row="place", name="leaves")
    groups = rows.groupBy(F.col("grp").alias("tree_grp")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = running(groups, ["tree_grp"], row="tree", name="trees").withColumn("height", _height(F.col("size"), fan))
    tallest, n_trees = trees.agg(F.max("height"), F.count(F.lit(1))).head()
    same = F.col("grp").eqNullSafe(F.col("tree_grp"))
    payload = F.struct("id", "grp", "leaf", F.coalesce("other", "leaf").alias("start"))
    leaves = rows.join(trees, same).select("tree", "height", (F.col("place") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), F.col("place").alias("lo"), (F.col("place") + 1).alias("hi"), payload.alias("payload"))
    tiers = _build(leaves, tallest or 0, fan, depth, "merkle")
    subroots = stored(_finished(tiers, depth), "merkle-roots")
    top = subroots.select(F.lit(ALL).cast("long").alias("tree"), _height(F.lit(n_trees), fan).alias("height"), F.col("tree").alias("pos"), "digest", "lo", "hi", F.lit(None).cast("int").alias("payload"))
    above = _build(top, next((h for h in range(63) if fan**h >= n_trees), 0), fan, depth, "merkle-top")
    root = _finished(above, depth).select("digest").head()
    nodes = None
    for built in [*tiers[1:], *above]:
        linked = _linked(built, depth).drop("payload")
        nodes = linked if nodes is None else nodes.union(linked)
    copies = F.sequence(F.expr(f"lo div {spread}"), F.expr(f"(hi - 1) div {spread}"))
    nodes = stored(nodes.withColumn("copy", F.explode(copies)).drop("lo", "hi"), "merkle-nodes")
    # the loop's own limit on rows is meant for runaway recursion; this one ends at the root
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        climbed = spark.sql(_CLIMB, leaves=_linked(tiers[0], depth), nodes=nodes, spread=spread)
        path = scratch_path(spark, "merkle-climb")
        climbed.write.parquet(path)
        climbed = spark.read.parquet(path)
    finally:
        spark.conf.set(limit, before)
    out = climbed.join(subroots.select(F.col("tree").alias("own"), F.col("digest").alias("subroot")), "own")
    known = F.lit(None if root is None else bytes(root[0])).cast("binary")
    return out.select(F.col("payload.id").alias(key), F.col("payload.grp").alias(group), "payload.leaf", "subroot", known.alias("root"), "proof", F.col("folded").alias("folded_root"))
