"""Conversation prefix trie (11): an LCP-aware mergesort whose output closes trie nodes.

A conversation's path is one 16-byte digest for each turn. Equal paths are one class, with the number of its conversations.
1. Tasks sort bounded runs of paths; each path carries its LCP (in turns) with the one before it. Runs are written to the
   shared folder.
2. A range partitioning by path gives each task a piece of every run. It merges the pieces with a loser tree: of two heads
   that are both compared with the last path that came out, the one with the longer LCP is the lesser, and only heads of equal
   LCP are compared, from there on. So shared turns are not compared again.
3. The merged stream goes over a stack of open nodes. A path whose LCP with the one before it is d closes all that are deeper
   than d; a closed node is finished and goes out once its parent is closed too, which knows its own conv_id then.
Only the nodes on the first and on the last path of a range can go on in a neighbouring range. They are added up by their
prefix's digest; in preorder (first range end, depth) the subtree of such a node is a run of rows, so that two running sums,
one within each range end and one over the ends, give its totals. No node's subtree meets in one task, however large.

A range holds about RANGE_TURNS turns, at 24 bytes each; a conversation has to fit in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm.common import Scratch, cut

DIGEST = 16
#: Turns of a sorted run, and of a range, about.
RUN_TURNS, RANGE_TURNS = 200_000, 20_000
#: Ranges are told apart by so many first turns.
RANGE_DEPTH = 256
#: Ids are joined to strings in blocks of so many before they are hashed.
ID_BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (place, digest, bytes), in order: by turn, nulls first, ties by role and digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    return rows.withColumn("place", place).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("turns"))


def fork_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c rebuilt: the first h turns of conversation c - c % family, then its own behind its first h.

    h is crc32 of c in decimal, modulo heads; turns that are missing are left out.
    """
    first = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    with_head = turns.join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("_base"), "left")
    none = F.array().cast(turns.schema["turns"].dataType)
    head = F.slice(F.coalesce("_head", none), F.lit(1), h)
    return with_head.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _sha_of_ids(ids: DataFrame) -> DataFrame:
    """class, sha of ids (class, conv_id): SHA-256 of a class's ids in order, joined by commas, read as a stream of blocks."""
    block = F.shiftright("conv_id", ID_BLOCK.bit_length() - 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ids.groupBy("class", block.alias("block")).agg(joined.alias("ids"))

    def run(batches):
        import pyarrow as pa

        name, digest = None, None
        for batch in batches:
            done: list[tuple[str, bytes]] = []
            for of, text in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if of != name:
                    if digest:
                        done.append((name, digest.digest()))
                    name, digest = of, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.binary())], names=["class", "sha"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([digest.digest()], pa.binary())], names=["class", "sha"])

    return blocks.repartition("class").sortWithinPartitions("class", "block").mapInArrow(run, "class string, sha binary")


def path_classes(paths: DataFrame) -> DataFrame:
    """path, bytes (of each turn), n, conv_id (smallest), sha (of all ids) of each different path of paths (conv_id, turns)."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = cut(paths.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("bytes")).withColumn("class", F.md5("path")))
    classes = rows.groupBy("class").agg(F.first("path").alias("path"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    several = rows.select("class", "conv_id").join(classes.where("n > 1").select("class"), "class", "left_semi")
    shas = _sha_of_ids(several)
    alone = F.unhex(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    return classes.join(shas, "class", "left").select("path", "bytes", "n", "conv_id", F.coalesce("sha", alone).alias("sha"))


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that two paths begin with, if the first `start` are known to be the same."""
    n = min(len(a), len(b)) // DIGEST
    while start < n and a[start * DIGEST : (start + 1) * DIGEST] == b[start * DIGEST : (start + 1) * DIGEST]:
        start += 1
    return start


def sorted_runs(classes: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """classes in runs: run, place in it, lcp with the row before."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names, number = ["path", "bytes", "n", "conv_id", "sha"], TaskContext.get().partitionId() << 32

        def close(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            lcps = [0, *(common(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))][: len(rows)]
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(lcps, pa.int64()), *columns], names=["run", "place", "lcp", *names])

        held, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                held.append(row)
                turns += 1 + len(row[1])
                if turns >= run_turns:
                    yield close(held)
                    held, turns, number = [], 0, number + 1
        yield close(held)

    return classes.mapInArrow(run, "run long, place long, lcp long, path binary, bytes array<long>, n long, conv_id long, sha binary")


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(LCP with the row before, row) of sorted runs of rows (lcp, path, ...), merged by a loser tree.

    losers[i] is the run that lost the match at node i; the runs are the leaves behind the inner nodes. lcps[r] is the LCP of
    run r's head with the last row that came out, as far as it matters: that of a loser with the run that beat it, which on the
    way of the winner up is the winner itself.
    """
    k = len(runs)
    at, lcps = [0] * k, [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that with the winner."""
        if at[a] >= len(runs[a]) or at[b] >= len(runs[b]):
            return (b, a) if at[a] >= len(runs[a]) else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        x, y = runs[a][at[a]][1], runs[b][at[b]][1]
        h = common(x, y, lcps[a])
        a, b = (a, b) if x[h * DIGEST :] <= y[h * DIGEST :] else (b, a)
        lcps[b] = h
        return a, b

    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = match(play(2 * node), play(2 * node + 1))
        return winner

    best = play(1) if k > 1 else 0
    while k and at[best] < len(runs[best]):
        yield lcps[best], runs[best][at[best]]
        at[best] += 1
        if at[best] < len(runs[best]):
            lcps[best] = runs[best][at[best]][0]
        node = (best + k) // 2
        while node >= 1 and k > 1:
            best, losers[node] = match(best, losers[node])
            node //= 2


class Node:
    """An open node: what is known of it so far in this range."""

    __slots__ = ("bytes", "children", "conv_id", "depth", "edge", "hash", "leaves", "n", "name", "saved", "sha", "waiting")

    def __init__(self, depth: int, name, size: int) -> None:
        self.depth, self.hash, self.bytes, self.edge = depth, name, size, None
        self.n = self.children = self.leaves = self.saved = 0
        self.conv_id: int | None = None
        self.sha: bytes | None = None
        self.waiting: list[list] = []


NODE_SCHEMA = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha binary"
_RANGE_SCHEMA = f"{NODE_SCHEMA}, name binary, parent binary, first_end long, last_end long, bytes long"


def range_nodes(merged: Iterator[tuple[int, tuple]], part: int) -> Iterator[list]:
    """Rows of _RANGE_SCHEMA for the nodes of a merged range of paths.

    Finished nodes have no name; those whose parent is on an outer path have the parent's name, as its conv_id is not known.
    Nodes on the first or last path have a name and, as ends, 2 * part for the first path and 2 * part + 1 for the last; their
    numbers are of what was finished below them, but conv_id and n_convs are of all that this range has of them.
    """
    stack: list[Node] = []
    outer = 0  # nodes of the stack that are on the first path

    def close(last: bool) -> list[list]:
        node, out = stack.pop(), []
        parent = stack[-1] if stack else None
        if parent:
            parent.n += node.n
            parent.conv_id = node.conv_id if parent.conv_id is None else min(parent.conv_id, node.conv_id)
        on_first = len(stack) < outer
        if on_first or last:
            for row in node.waiting:
                row[9] = node.hash.digest()
            out += node.waiting
            ends = (2 * part if on_first else 2 * part + 1, 2 * part + 1 if last else 2 * part)
            out.append([node.depth, node.conv_id, None, node.n, node.children, node.leaves, node.saved, node.sha, node.hash.digest(), parent.hash.digest() if parent else None, *ends, node.bytes])
            return out
        for row in node.waiting:
            row[2] = node.conv_id
        out += node.waiting
        leaves, saved = node.leaves + (node.children == 0), node.saved + (node.n - 1) * node.bytes
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        parent.waiting.append([node.depth, node.conv_id, None, node.n, node.children, leaves, saved, node.sha, None, None, None, None, None])
        return out

    for lcp, (_, path, sizes, n, conv_id, sha) in merged:
        first = not stack
        while len(stack) > lcp + 1:
            yield from close(False)
            outer = min(outer, len(stack))
        for depth in range(len(stack), len(sizes) + 1):
            name = stack[-1].hash.copy() if depth else hashlib.md5()
            if depth:
                name.update(path[(depth - 1) * DIGEST : depth * DIGEST])
            stack.append(Node(depth, name, sizes[depth - 1] if depth else 0))
        if first:
            outer = len(stack)
        top = stack[-1]
        top.n, top.sha, top.conv_id = top.n + n, sha, conv_id if top.conv_id is None else min(top.conv_id, conv_id)
    while stack:
        yield from close(True)


def prefix_trie(paths: DataFrame, range_turns: int = RANGE_TURNS, run_turns: int = RUN_TURNS) -> DataFrame:
    """Nodes of the trie of paths (conv_id, turns: array of (place, digest, bytes)); a conv_id has one row.

    Returns for each node conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, the SHA-256 of the ids that end there. The root has depth 0, and every path as a member,
    also one without turns. No paths make no nodes.
    """
    spark = paths.sparkSession
    scratch = Scratch(spark)
    runs = scratch.write(sorted_runs(path_classes(paths), run_turns), "runs")
    turns = runs.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    ranges = max(1, -(-turns // range_turns))

    def merge(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        pieces: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "path", "bytes", "n", "conv_id", "sha")), strict=True):
                pieces.setdefault(row[0], []).append(row[1:])
        for piece in pieces.values():
            piece[0] = (0, *piece[0][1:])  # what it shares with a row of another range says nothing here
        kinds = [pa.int64()] * 7 + [pa.binary()] * 3 + [pa.int64()] * 3
        names = [x.split()[0] for x in _RANGE_SCHEMA.split(", ")]
        rows: list[list] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 13, kinds, strict=True)], names=names)

        for row in range_nodes(merge_runs(list(pieces.values())), TaskContext.get().partitionId()):
            rows.append(row)
            if len(rows) == 10_000:
                yield out()
                rows = []
        yield out()

    dealt = runs.repartitionByRange(ranges, F.substring("path", 1, RANGE_DEPTH * DIGEST)).sortWithinPartitions("run", "place")
    nodes = cut(dealt.mapInArrow(merge, _RANGE_SCHEMA))
    scratch.drop()
    outer = _outer_totals(nodes.where("name is not null"))
    inner = nodes.where("name is null and parent is null").select(*_NAMES)
    # A node like the root may have a large part of all nodes as children: its conv_id is looked up under 32 keys.
    salts = 32
    lookup = outer.select(F.col("name").alias("_name"), F.col("conv_id").alias("_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    below = nodes.where("name is null and parent is not null").withColumn("_own", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(salts)).cast("int"))
    below = below.join(lookup, (F.col("parent") == F.col("_name")) & (F.col("_own") == F.col("_salt"))).withColumn("parent_conv_id", F.col("_conv_id")).select(*_NAMES)
    return inner.unionByName(below).unionByName(outer.select(*_NAMES)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("sha")), F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )


_NAMES = [x.split()[0] for x in NODE_SCHEMA.split(", ")]


def _outer_totals(parts: DataFrame) -> DataFrame:
    """The nodes that several ranges may share, added up; parts: their rows of each range."""
    total = lambda c: F.sum(c).alias(c)
    nodes = parts.groupBy("name").agg(
        *[F.first(c).alias(c) for c in ("depth", "parent", "bytes")], F.min("conv_id").alias("conv_id"), F.max("sha").alias("sha"), F.min("first_end").alias("first_end"),
        F.max("last_end").alias("last_end"), *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count(F.lit(1)).alias("_more"))
    children = F.col("n_children") + F.coalesce("_more", F.lit(0))
    own = cut(
        nodes.join(below, F.col("name") == F.col("_of"), "left")
        .withColumn("n_children", children)
        .withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"))
        .drop("_of", "_more")
    )
    sums = ("n_leaves", "saved_tokens")
    deeper = W.partitionBy("first_end").orderBy(F.desc("depth"))
    # One row for each end of a range, also for those where no node is new.
    no_sums = own.select(F.col("last_end").alias("first_end"), *[F.lit(0).cast("long").alias(c) for c in sums])
    ends = own.select("first_end", *sums).unionByName(no_sums).groupBy("first_end").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    running = cut(ends.select("first_end", *[F.sum(f"_{c}").over(W.orderBy("first_end")).alias(f"_{c}") for c in sums]))
    within = own.select("*", *[F.sum(c).over(deeper).alias(f"_deep_{c}") for c in sums])
    upto = _running_at(within, "last_end", running, sums, "_to_")
    both = _running_at(upto, "first_end", running, sums, "_from_")
    parents = own.select(F.col("name").alias("_name"), F.col("conv_id").alias("parent_conv_id"))
    for c in sums:
        both = both.withColumn(c, F.col(f"_deep_{c}") + F.col(f"_to_{c}") - F.col(f"_from_{c}"))
    return both.join(parents, F.col("parent") == F.col("_name"), "left").select("name", *_NAMES)


def _running_at(rows: DataFrame, end: str, running: DataFrame, sums: tuple[str, ...], prefix: str) -> DataFrame:
    """rows with the running sums up to the range end that a column names."""
    return rows.join(running.select(F.col("first_end").alias("_end"), *[F.col(f"_{c}").alias(f"{prefix}{c}") for c in sums]), F.col(end) == F.col("_end"), "left").drop("_end")


def conversation_trie(conversations: DataFrame, rebuild=fork_heads) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text), each rebuilt by `rebuild` (None: as it is).

    Turns are ordered by turn, nulls first, ties by role and then by digest. Null roles and texts are empty. Rows of a null
    conv_id are left out. Other columns are ignored. An empty table has no nodes, not even a root.
    """
    turns = ordered_turns(conversations)
    return prefix_trie(rebuild(turns) if rebuild else turns)
