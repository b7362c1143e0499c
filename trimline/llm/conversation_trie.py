"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations are rebuilt first: the first ``h`` turns of conversation c - c % 20 (all if fewer, none if it is
absent), then the conversation's own turns after its first ``h``, with h = crc32(decimal c) % 4. A node is a
distinct sequence of the first turns (role, text) of rebuilt conversations; the root is the empty one.

Turns are numbered by ordering ranges of (conversation, turn) and adding up the counts of the ranges before,
and sequences are named by digests of aligned blocks of 2, 4, 8, ... turns, so a conversation of any length is
spread over tasks. A node is known by its smallest member and its depth; that member's path names its ancestors.

Leaves and saved tokens are summed over subtrees by centroid decomposition of the parent edges. In each round
every component with more than ``SMALL`` nodes is split at its centroid, the deepest node with at least half
of the component below it: the parts under its children become components, and so does what lies above.
The total of the centroid's subtree is added to all nodes on the path from the centroid to the component's
top, so what remains to be summed lies within the new components, of at most half the size each. After
log2(nodes / SMALL) rounds, whatever the trie's height, small components are summed within tasks.

Defined results: rows without a conv_id take no part; null roles and texts are empty; turns are ordered null
first, equal ones by the SHA-256 of role length, role and text; rows that repeat are turns of their own; a
conversation may have no turn left and then belongs to the root only; an empty table has no root; other
columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trimline.llm.batches import bound_batches
from trimline.scratch import written

#: Conversations that may share the first turns of one of them, and turns shared at most, plus one.
FAMILY, HEADS = 20, 4
#: Nodes of a component that is summed within a task, and nodes that one task sums together.
SMALL, TOGETHER = 256, 1 << 16

_COMPONENT = ["top", "top_depth"]


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, i, digest, words) of all turns, numbered from 0."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").alias("turn"),
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).filter("conv is not null")
    slim = written(slim, "turns")
    order = ["conv", "turn", "digest"]
    # equal rows are spread by a further column
    ranges = slim.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "spread")
    numbered = written(ranges.drop("spread").sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()), "ranges")
    numbered = numbered.withColumn("part", F.shiftright("n", 33))
    starts = numbered.groupBy("conv", "part").agg(F.min("n").alias("low"), F.count("*").alias("k"))
    # one row per conversation and range that holds some of it
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    return numbered.join(starts, ["conv", "part"]).select("conv", (F.col("before") + F.col("n") - F.col("low")).alias("i"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, length) of all rebuilt conversations, and their steps (conv, length, depth, digest, words)."""
    own = turns.groupBy("conv").agg(F.count("*").alias("m"))
    own = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS)
    own = own.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    bases = own.select(F.col("conv").alias("base"), F.col("m").alias("base_m"))
    shared = F.least("h", F.coalesce("base_m", F.lit(0).cast("long")))
    convs = own.join(bases, "base", "left").withColumn("q", shared)
    convs = convs.withColumn("length", F.col("q") + F.greatest(F.col("m") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "base", "h", "q", "length"), "conversations")
    rest = turns.join(convs, "conv").filter("i >= h").select("conv", "length", (F.col("q") + F.col("i") - F.col("h") + 1).alias("depth"), "digest", "words")
    first = turns.filter(F.col("i") < HEADS - 1).withColumnRenamed("conv", "base")
    heads = convs.filter("q > 0").join(first, "base").filter("i < q")
    heads = heads.select("conv", "length", (F.col("i") + 1).alias("depth"), "digest", "words")
    return convs.select("conv", "length"), written(rest.unionByName(heads), "steps")


def _named(steps: DataFrame) -> DataFrame:
    """The steps with ``p``, a digest of all turns up to each: equal for equal sequences of the same length."""
    longest = steps.agg(F.max("depth")).first()[0] or 0
    blocks = [steps.select("conv", (F.col("depth") - 1).alias("i"), "digest")]
    for _ in range(max(0, longest.bit_length() - 1)):
        side = lambda s: F.max(F.when(F.col("i") % 2 == s, F.col("digest")))
        pairs = blocks[-1].groupBy("conv", F.shiftright("i", 1).alias("j")).agg(side(0).alias("x"), side(1).alias("y"))
        pairs = pairs.filter("x is not null and y is not null").select("conv", F.col("j").alias("i"), _digest(F.col("x"), F.col("y")).alias("digest"))
        blocks.append(written(pairs, "blocks"))
    # d blocks of a level are d // 2 of the next one and, if d is odd, one more
    prefixes = blocks.pop().filter("i = 0").select("conv", F.lit(1).cast("long").alias("d"), F.col("digest").alias("p"))
    for level in reversed(blocks):
        odd = level.filter("i % 2 = 0").select("conv", F.shiftright("i", 1).alias("e"), "digest")
        both = prefixes.withColumnRenamed("d", "e").join(odd, ["conv", "e"], "full")
        one_more = F.when(F.col("digest").isNotNull(), _digest(F.coalesce("p", F.lit(b"")), F.col("digest")))
        pair = F.array(F.struct((F.col("e") * 2).alias("d"), "p"), F.struct((F.col("e") * 2 + 1).alias("d"), one_more.alias("p")))
        prefixes = both.select("conv", F.explode(pair).alias("x")).select("conv", "x.d", "x.p").filter("p is not null")
    return written(steps.join(prefixes.withColumnRenamed("d", "depth"), ["conv", "depth"]), "prefixes")


def _sums(group: pd.DataFrame, values: list[str]) -> pd.DataFrame:
    """Subtree sums within the components of ``group``, added to what ancestors have so far."""
    group = group.sort_values("depth", kind="stable").reset_index(drop=True)
    owner, depth = group["owner"].to_numpy(np.int64), group["depth"].to_numpy(np.int64)
    top = (owner == group["top"].to_numpy(np.int64)) & (depth == group["top_depth"].to_numpy(np.int64))
    place = pd.MultiIndex.from_arrays([owner, depth])
    inner = np.flatnonzero(~top)
    above = place.get_indexer(pd.MultiIndex.from_arrays([group["parent"].to_numpy()[inner].astype(np.int64), depth[inner] - 1]))
    ends = np.searchsorted(depth[inner], np.unique(depth[inner]), "right")
    starts = np.r_[0, ends[:-1]]
    for v in values:
        total = group[v].to_numpy(np.int64).copy()
        for a, b in zip(starts[::-1], ends[::-1]):  # deepest first
            np.add.at(total, above[a:b], total[inner[a:b]])
        group[f"sum_{v}"] = total + group[f"sum_{v}"].to_numpy(np.int64)
    return group[["owner", "depth", *[f"sum_{v}" for v in values]]]


def subtree_sums(nodes: DataFrame, path: DataFrame, values: list[str], small: int = SMALL) -> DataFrame:
    """(owner, depth, sum_v for each value v): sums of ``values`` over the subtree of each node.

    ``nodes``: owner, depth, parent (owner of the parent, null at the root), size (nodes of the subtree) and the
    values. ``path``: conv, depth, at, parent: owners of the node at each depth of an owner's path and of the one above.
    """
    root = nodes.filter("depth = 0").first()["owner"]  # one row
    sums = {f"sum_{v}": F.lit(0).cast("long") for v in values}
    columns = ["owner", "depth", "parent", "size", *_COMPONENT, *values, *sums]
    rows = nodes.withColumns({"top": F.lit(root).cast("long"), "top_depth": F.lit(0).cast("long"), **sums}).select(*columns)
    look = path.select(F.col("conv").alias("look"), F.col("depth").alias("look_depth"), "at", F.col("parent").alias("at_parent"))
    small_ones = []
    while True:
        totals = rows.groupBy(*_COMPONENT).agg(F.max("size").alias("total"))
        rows = written(rows.join(totals, _COMPONENT), "components")
        small_ones.append(rows.filter(F.col("total") <= small).drop("total"))
        live = rows.filter(F.col("total") > small)
        centroid = F.max_by(F.struct(F.col("owner").alias("c"), F.col("size").alias("c_size")), "depth").alias("m")
        centroids = live.filter(F.col("size") * 2 >= F.col("total")).groupBy(*_COMPONENT).agg(centroid, F.max("depth").alias("c_depth"))
        centroids = written(centroids.select(*_COMPONENT, "c_depth", "m.c", "m.c_size"), "centroids")
        if not centroids.limit(1).count():
            break
        # a deeper node asks who is above it just below the centroid; the others ask who is on the centroid's path
        deeper = F.col("depth") > F.col("c_depth")
        asks = live.drop("total").join(centroids, _COMPONENT).withColumns(
            {"look": F.when(deeper, F.col("owner")).otherwise(F.col("c")), "look_depth": F.when(deeper, F.col("c_depth") + 1).otherwise(F.col("depth"))}
        )
        known = asks.join(look, ["look", "look_depth"])
        known = known.withColumns(
            {
                "is_c": (F.col("owner") == F.col("c")) & (F.col("depth") == F.col("c_depth")),
                "below": deeper & (F.col("at_parent") == F.col("c")),
                "on_path": ~deeper & (F.col("at") == F.col("owner")),
            }
        )
        known = written(known.drop("look", "look_depth", "at_parent"), "split")
        totals = known.filter("below or is_c").groupBy(*_COMPONENT).agg(*[F.sum(v).alias(f"t_{v}") for v in values])
        split = known.join(totals, _COMPONENT)
        added = {f"sum_{v}": F.col(f"sum_{v}") + F.when(F.col("on_path"), F.col(f"t_{v}")).otherwise(0) for v in values}
        counted = {v: F.when(F.col("is_c"), 0).otherwise(F.col(v)).cast("long") for v in values}
        size = F.when(F.col("is_c"), 1).when(F.col("on_path"), F.col("size") - F.col("c_size")).otherwise(F.col("size")).cast("long")
        top = F.when(F.col("is_c"), F.col("owner")).when(F.col("below"), F.col("at")).otherwise(F.col("top"))
        top_depth = F.when(F.col("is_c"), F.col("depth")).when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth"))
        split = split.withColumns({**added, **counted, "size": size, "new_top": top, "new_depth": top_depth})
        rows = split.drop(*_COMPONENT).withColumnsRenamed({"new_top": "top", "new_depth": "top_depth"}).select(*columns)

    rest = small_ones[0]
    for more in small_ones[1:]:
        rest = rest.unionByName(more)
    tasks = max(1, -(-nodes.count() // TOGETHER))
    together = F.pmod(F.xxhash64(*_COMPONENT), F.lit(tasks)).alias("task")
    schema = "owner long, depth long, " + ", ".join(f"sum_{v} long" for v in values)
    return rest.groupBy(together).applyInPandas(lambda group: _sums(group, values), schema)


def _joined_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) over the comma-joined ``conv`` of each node, in bounded pieces of text."""
    key = ["owner", "depth"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs = batch.groupby(key, sort=False)["conv"]
            text = runs.agg(lambda ids: ",".join(map(str, ids)))
            yield pd.DataFrame({"text": text, "first": runs.first()}).reset_index()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            out = []
            for owner, depth, text in zip(batch["owner"].tolist(), batch["depth"].tolist(), batch["text"]):
                if node == (owner, depth):
                    digest.update(b"," + text.encode())
                    continue
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (owner, depth), hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*key, "ends_sha256"])

    ranges = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    texts = bound_batches(ranges).mapInPandas(pieces, "owner long, depth long, text string, first long")
    return texts.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(hashed, "owner long, depth long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    small: int = SMALL,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, steps = rebuilt(_turns(conversations, id_col, turn_col, role_col, text_col))
    steps = _named(steps)
    first = convs.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs")).filter("owner is not null")
    nodes = steps.groupBy("depth", "p").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    nodes = written(nodes, "named")
    root = written(first, "root")
    root_owner = root.select("owner").first()
    if root_owner is None:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        )
    root_id = F.lit(root_owner[0]).cast("long")

    # paths of conversations that own a node; the parent of a step is the owner one step before
    begins = nodes.groupBy("owner").agg(F.min("depth").alias("own_from")).withColumnRenamed("owner", "conv")
    owned = steps.join(begins, "conv").join(nodes.select("depth", "p", F.col("owner").alias("at")), ["depth", "p"])
    owned = written(owned.select("conv", "depth", "at", "length", "own_from"), "paths")
    above = owned.select("conv", (F.col("depth") + 1).alias("depth"), F.col("at").alias("parent"))
    path = owned.join(above, ["conv", "depth"], "left").withColumn("parent", F.coalesce("parent", root_id))
    start = begins.select("conv", F.lit(0).cast("long").alias("depth"), root_id.alias("at"), F.lit(None).cast("long").alias("parent"))
    # the root's owner may own no other node, yet its path is asked for
    start = start.unionByName(root.select(F.col("owner").alias("conv"), F.lit(0).cast("long").alias("depth"), F.col("owner").alias("at"), F.lit(None).cast("long").alias("parent"))).distinct()
    path = written(path.select("conv", "depth", "at", "parent").unionByName(start), "paths")

    # nodes of a subtree: each owner on a path counts the nodes that it owns from there on
    share = F.col("length") - F.greatest("own_from", "depth") + 1
    sizes = owned.groupBy(F.col("at").alias("owner"), "depth").agg(F.sum(share).alias("size"))
    links = path.filter("depth > 0 and conv = at").select(F.col("conv").alias("owner"), "depth", "parent")
    tree = nodes.drop("p").join(sizes, ["owner", "depth"]).join(links, ["owner", "depth"])
    plain = {"depth": F.lit(0), "words": F.lit(0), "size": F.lit(nodes.count() + 1), "parent": F.lit(None)}
    top = root.select("owner", "n_convs", *[c.cast("long").alias(name) for name, c in plain.items()])
    tree = written(tree.unionByName(top), "tree")
    children = tree.filter("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tree = tree.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    tree = tree.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    tree = written(tree, "tree")
    sums = subtree_sums(tree.select("owner", "depth", "parent", "size", "leaf", "saved"), path, ["leaf", "saved"], small)

    last = steps.filter("depth = length").select("conv", "depth", "p").join(nodes.select("depth", "p", "owner"), ["depth", "p"])
    ends = last.select("owner", "depth", "conv").unionByName(
        convs.filter("length = 0").select(root_id.alias("owner"), F.lit(0).cast("long").alias("depth"), "conv")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    found = tree.join(sums, ["owner", "depth"]).join(_joined_digests(ends), ["owner", "depth"], "left")
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("sum_leaf").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
