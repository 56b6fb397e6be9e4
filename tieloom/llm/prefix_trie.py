"""Trie of conversation prefixes.

1. Turns (role, text) are dictionary-encoded: distinct turns get numbers, conversations become
   sequences of numbers. Equal sequences are merged before they are dealt out, so a group of copies of
   any size is one row with a count.
2. Distinct sequences are range-partitioned in lexicographic order. A shard, ``SHARD`` turns of a
   partition at most, becomes a ternary search tree: each node has a turn id, links to smaller and
   larger ids at the same place, and a link to the ids that follow. The sorted sequences are inserted
   median first, so the trees of smaller and larger ids are balanced.
3. An iterative traversal lists the nodes, each after its parent; backwards over that list, members, children,
   leaves and savings are added to the parents.
4. Nodes on the path of a shard's first or last sequence may go on in the neighbouring shard. They leave as
   partial sums without each other, are merged by the digest of their path, and then added up along their paths.

Sequences are cut into layers of ``LAYER`` turns, so no array is longer. What hangs below a node at the
end of a layer is a trie of its own, with that node's digest as first symbol of its sequences; layers are built
from the deepest up. Most conversations stop in the first layer: from the end of a layer on, a conversation that is
alone there is a chain, whose nodes come from its rows without a tree. Rows of a conversation get their
positions from a global sort, so one of any length is dealt out like others. Layers beyond the first cost a
round of jobs each, as many as the longest shared prefix has.

Digests of paths are 128-bit. A null id is no conversation, and its rows are left out. Null roles and
texts are empty, null turns come first, rows of one turn are ordered by role and text; repeated rows
are repeated turns. Further columns are ignored, whatever their names. An empty table has no
conversation, hence no root and no row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.llm.positions import placed
from tieloom.llm.tables import small
from tieloom.llm.words import word_count
from tieloom.staging import staged

LAYER = 64
SHARD = 65_536
#: Ids of conversations that are joined to one piece of a digest's text.
PIECE = 4_096
_NOTHING = hashlib.sha256().hexdigest()


def path_key(root: str, ids: list[int]) -> str:
    return hashlib.md5(f"{root}|{','.join(map(str, ids))}".encode()).hexdigest()


def _path_key(root: Column, ids: Column) -> Column:
    return F.md5(F.concat(root, F.lit("|"), F.array_join(ids.cast("array<string>"), ",")).cast("binary"))


class SearchTree:
    """A ternary search tree whose nodes count what passes through them."""

    def __init__(self):
        self.symbol, self.smaller, self.larger, self.follows, self.parent = [], [], [], [], []
        self.level, self.words, self.members, self.least, self.end = [], [], [], [], []
        self.top = -1

    def _new(self, symbol, parent: int, words: int) -> int:
        for column, value in (
            (self.symbol, symbol), (self.smaller, -1), (self.larger, -1), (self.follows, -1), (self.parent, parent),
            (self.level, self.level[parent] + 1 if parent >= 0 else 0), (self.words, words), (self.members, 0), (self.least, None), (self.end, None),
        ):
            column.append(value)
        return len(self.symbol) - 1

    def _child(self, parent: int, symbol, words: int) -> int:
        """The node of ``symbol`` below ``parent``, made if missing (``words`` below 0: only looked up)."""
        at = self.follows[parent] if parent >= 0 else self.top
        if at < 0:
            at = self._new(symbol, parent, words)
            if parent >= 0:
                self.follows[parent] = at
            else:
                self.top = at
            return at
        while symbol != self.symbol[at]:
            links = self.smaller if symbol < self.symbol[at] else self.larger
            if links[at] < 0:
                links[at] = self._new(symbol, parent, words)
            at = links[at]
        return at

    def insert(self, symbols: list, words: list[int], members: int, least, end) -> None:
        at = -1
        for symbol, w in zip(symbols, words, strict=True):
            at = self._child(at, symbol, w)
            self.members[at] += members
            if self.least[at] is None or least < self.least[at]:
                self.least[at] = least
        self.end[at] = end

    def path(self, symbols: list) -> list[int]:
        out, at = [], -1
        for symbol in symbols:
            at = self._child(at, symbol, -1)
            out.append(at)
        return out

    def listed(self) -> list[int]:
        """All nodes, parents before children."""
        order, stack = [], [self.top]
        while stack:
            at = stack.pop()
            if at >= 0:
                order.append(at)
                stack += (self.larger[at], self.smaller[at], self.follows[at])
        return order


def balanced(rows: list[tuple]) -> SearchTree:
    """The tree of sorted rows (root, ids, words, members, least, end), inserted median first."""
    tree, ranges = SearchTree(), [(0, len(rows))]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            root, ids, words, members, least, end = rows[middle]
            tree.insert([root, *ids], [0, *words], members, least, end)
            ranges += ((low, middle), (middle + 1, high))
    return tree


def shard_nodes(rows: list[tuple]):
    """Nodes of a shard: ``key, parent_key, least, parent_least, level, words, members, children, leaves, saved,
    path``. ``path`` holds the keys from the root to a node that may go on elsewhere, else it is null; such a node's
    sums leave out the others of its kind. ``key`` is set where sequences end or the sums are partial, ``parent_key``
    where the parent's are."""
    tree = balanced(rows)
    open_nodes = set()
    for row in (rows[0], rows[-1]):
        open_nodes.update(tree.path([row[0], *row[1]]))
    order = tree.listed()
    open_nodes.update(at for at in order if tree.level[at] == 0)
    count = len(tree.symbol)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for at in reversed(order):
        if tree.end[at]:
            more, below, spared = tree.end[at]
            children[at] += more
            leaves[at] += below
            saved[at] += spared
        if at in open_nodes:
            continue
        leaves[at] += not children[at]
        saved[at] += (tree.members[at] - 1) * tree.words[at]
        up = tree.parent[at]
        children[up] += 1
        leaves[up] += leaves[at]
        saved[up] += saved[at]

    keys: dict[int, str] = {}

    def key(at: int) -> str:
        if at not in keys:
            ids, up = [], at
            while tree.level[up]:
                ids.append(tree.symbol[up])
                up = tree.parent[up]
            keys[at] = path_key(tree.symbol[up], ids[::-1]) if ids else tree.symbol[up]
        return keys[at]

    for at in order:
        up, path = tree.parent[at], None
        if at in open_nodes:
            path, step = [], at
            while step >= 0:
                path.append(key(step))
                step = tree.parent[step]
        yield (
            key(at) if path or tree.end[at] else None, key(up) if up >= 0 and up in open_nodes else None, tree.least[at],
            tree.least[up] if up >= 0 and up not in open_nodes else None, tree.level[at], tree.words[at], tree.members[at], children[at], leaves[at], saved[at], path,
        )


def _forest(groups: DataFrame) -> DataFrame:
    """Nodes of all shards of ``groups`` (``root, ids, words, members, least, more, below, spared``)."""
    names = ["key", "parent_key", "least", "parent_least", "level", "words", "members", "children", "leaves", "saved", "path"]
    long = pa.int64()
    kinds = [pa.string(), pa.string(), long, long, long, long, long, long, long, long, pa.list_(pa.string())]

    def run(batches):
        def shards():
            held, turns = [], 0
            for batch in batches:
                for root, ids, words, members, least, more, below, spared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append((root, ids, words, members, least, (more, below, spared)))
                    turns += len(ids) + 1
                    if turns >= SHARD:
                        yield held
                        held, turns = [], 0
            if held:
                yield held

        for rows in shards():
            nodes = list(shard_nodes(rows))
            for i in range(0, len(nodes), 10_000):
                columns = zip(*nodes[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    longs = ", ".join(f"{n} long" for n in names[2:-1])
    ordered = groups.repartitionByRange("root", "ids").sortWithinPartitions("root", "ids")
    return ordered.select("root", "ids", "words", "members", "least", "more", "below", "spared").mapInArrow(run, f"key string, parent_key string, {longs}, path array<string>")


def _merged(nodes: DataFrame, root_least: DataFrame | None) -> DataFrame:
    """Nodes with whole sums: ``key, least, parent_least, level, members, children, leaves, saved``.

    ``root_least`` has the least member of the roots where it is known from the layer above.
    """
    parts = nodes.where("path IS NOT NULL").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("least").alias("least"), F.max("level").alias("level"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("members", "children", "leaves", "saved")], F.max("path").alias("path"),
    )
    if root_least is not None:
        parts = parts.join(root_least.withColumnRenamed("least", "known"), "key", "left").withColumn("least", F.coalesce("known", "least")).drop("known")
    parts = staged(parts, "open_nodes")
    kin = parts.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kin"))
    own = parts.join(kin, "key", "left").withColumn("children", F.col("children") + F.coalesce("kin", F.lit(0)))
    own = staged(
        own.withColumns(
            {
                "leaves": F.col("leaves") + (F.col("children") == 0).cast("long"),
                "saved": F.col("saved") + F.when(F.col("level") > 0, (F.col("members") - 1) * F.col("words")).otherwise(0),
            }
        ).drop("kin"),
        "open_nodes",
    )
    totals = own.select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    known = small(parts.select(F.col("key").alias("parent_key"), F.col("least").alias("above")))
    columns = ["key", "level", "least", "members", "children", "leaves", "saved"]
    whole = own.drop("leaves", "saved").join(totals, "key").join(known, "parent_key", "left").select(*columns, F.col("above").alias("parent_least"))
    closed = nodes.where("path IS NULL")
    below = closed.join(known, "parent_key", "left").select(*columns, F.coalesce("parent_least", "above").alias("parent_least"))
    return whole.unionByName(below)


def _ends(ending: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``ending`` (``key, conv_id``): ids in order, joined in pieces that are hashed as a stream."""
    pieces = (
        placed(ending, "key", "conv_id", name="ending").groupBy("key", F.floor(F.col("at") / PIECE).alias("piece"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    )

    def run(batches):
        current, digest = None, None
        for batch in batches:
            done = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(f",{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "text").mapInArrow(run, "key string, ends_sha256 string")


def encoded(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, id, words``: turns of ``turns`` (``conv_id, turn, role, text``) as numbers, by position."""
    spoken = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    ordered = placed(
        spoken.withColumns({"digest": digest, "words": word_count(F.col("text"))}), "conv_id", "turn", "role", "text", drop=("turn", "role", "text"), name="turns"
    )
    numbers = placed(ordered.select("digest").distinct(), "digest", name="dictionary").withColumnRenamed("at", "id")
    starts = ordered.groupBy("conv_id").agg(F.min("at").alias("start"))
    return ordered.join(numbers, "digest").join(starts, "conv_id").select("conv_id", (F.col("at") - F.col("start")).alias("pos"), "id", "words")


def rebuilt(coded: DataFrame, borrowed: Column, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``conv_id, depth, id, words`` and ``conv_id, turns``.

    Conversation c takes its first ``borrowed`` turns (an expression of ``conv_id``, at most 3) from
    conversation c - c % ``family``, then its own turns from there on.
    """
    own = coded.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("take", borrowed.cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    found = own.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").withColumn("taken", F.least("take", F.coalesce("there", F.lit(0))))
    found = staged(found.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("take"), F.lit(0))), "conversations")
    first = found.where("taken > 0").join(coded.where("pos < 3").withColumnRenamed("conv_id", "base"), "base").where("pos < taken")
    later = coded.join(found.select("conv_id", "take", "taken"), "conv_id").where("pos >= take")
    steps = first.select("conv_id", (F.col("pos") + 1).alias("depth"), "id", "words").unionByName(
        later.select("conv_id", (F.col("taken") + F.col("pos") - F.col("take") + 1).alias("depth"), "id", "words")
    )
    return staged(steps, "steps"), found.select("conv_id", "turns")


def _layer(steps: DataFrame, who: DataFrame, number: int) -> DataFrame:
    """``who`` (``conv_id, turns, root``) with ``ids`` and ``words`` of their turns in a layer."""
    inside = steps.where((F.col("depth") > number * LAYER) & (F.col("depth") <= (number + 1) * LAYER))
    if number:
        inside = inside.join(who.select("conv_id"), "conv_id", "left_semi")
    listed = inside.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "id", "words"))).alias("list"))
    empty = F.array().cast("array<bigint>")
    return who.join(listed, "conv_id", "left").select(
        "conv_id", "turns", "root", F.coalesce("list.id", empty).alias("ids"), F.coalesce("list.words", empty).alias("words")
    )


def nodes(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``steps`` (``conv_id, depth, id, words``), for ``conversations`` (``conv_id, turns``)."""
    layers, who, number = [], conversations.withColumn("root", F.lit("")), 0
    while True:
        further = F.col("turns") > (number + 1) * LAYER
        members = staged(_layer(steps, who, number).withColumn("key", _path_key(F.col("root"), F.col("ids"))).withColumn("further", further), "members")
        groups = staged(
            members.groupBy("root", "ids").agg(
                F.first("key").alias("key"), F.first("words").alias("words"), F.count("*").alias("members"), F.min("conv_id").alias("least"), F.count_if("further").alias("going")
            ),
            "groups",
        )
        layers.append((members, groups))
        joint = groups.where("going > 1").select("key")
        who = members.where("further").join(joint, "key", "left_semi").select("conv_id", "turns", F.col("key").alias("root"))
        if groups.where("going > 1").isEmpty():
            break
        number += 1

    out, tails, ending = [], None, []
    for number in reversed(range(len(layers))):
        members, groups = layers[number]
        lone = F.col("going") == 1
        if tails is None:
            groups = groups.withColumns({"t_children": F.lit(0), "t_leaves": F.lit(0), "t_saved": F.lit(0)})
        else:
            groups = groups.join(tails, "key", "left")
        groups = groups.withColumns(
            {
                "more": F.when(lone, 1).otherwise(F.coalesce("t_children", F.lit(0))).cast("long"),
                "below": F.when(lone, 1).otherwise(F.coalesce("t_leaves", F.lit(0))).cast("long"),
                "spared": F.when(lone, 0).otherwise(F.coalesce("t_saved", F.lit(0))).cast("long"),
            }
        )
        above = layers[number - 1][1].select("key", "least") if number else None
        whole = staged(_merged(staged(_forest(groups), "shard_nodes"), above), "nodes")
        tails = whole.where("level = 0").select("key", F.col("children").alias("t_children"), F.col("leaves").alias("t_leaves"), F.col("saved").alias("t_saved"))
        ending.append(members.where(~F.col("further")).select(F.when((F.col("root") == "") & (F.size("ids") == 0), F.lit("")).otherwise(F.col("key")).alias("key"), "conv_id"))
        out.append((whole if number == 0 else whole.where("level > 0")).withColumn("depth", F.col("level") + number * LAYER).drop("level"))
        chains = members.where("further").select("conv_id", "turns", "key").join(groups.where(lone).select("key", "least"), "key").select("conv_id", "turns", "least")
        tail = steps.where(F.col("depth") > (number + 1) * LAYER).join(chains, "conv_id")
        out.append(
            tail.select(
                F.lit(None).cast("string").alias("key"), F.col("conv_id").alias("least"), F.lit(1).cast("long").alias("members"), (F.col("depth") < F.col("turns")).cast("long").alias("children"),
                F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.when(F.col("depth") > (number + 1) * LAYER + 1, F.col("conv_id")).otherwise(F.col("least")).alias("parent_least"), "depth",
            )
        )
    table, ended = out[0], ending[0]
    for other in out[1:]:
        table = table.unionByName(other)
    for other in ending[1:]:
        ended = ended.unionByName(other)
    alone = F.when(F.col("key").isNull() & (F.col("members") == 1) & (F.col("children") == 0), F.sha2(F.col("least").cast("string").cast("binary"), 256))
    return table.join(_ends(ended), "key", "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("parent_least").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", alone, F.lit(_NOTHING)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, borrowed: Column) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node of
    the trie of rebuilt conversations (see ``rebuilt``)."""
    coded = staged(encoded(turns.select("conv_id", "turn", "role", "text")), "coded")
    return nodes(*rebuilt(coded, borrowed))
