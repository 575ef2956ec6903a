"""N-gram Jaccard join (13): sets in one global order, joined by traversing a trie of them.

The global order puts frequent shingles first. Sets of n shingles that are linked at t percent share at least t * n / 100 of
either, so they have one of the n - ceil(t * n / 100) + 1 rarest shingles of both in common.
1. Documents of equal sets are one class, represented by its smallest doc_id.
2. Which documents may be linked at all: of the shingles of least hash, half as many again as such a prefix has, a linked
   document shares a third at least. That takes a sixth of all shingles through the shuffle, and rules out what shares less.
3. Of those that are left, all shingles are counted: the order. Shingles of one document alone can't be shared and are only
   counted. A document whose rarest shingles are its own has no link.
4. Documents that share a rare shingle follow the least of them. Each is verified against that leader; the links make
   components, and followers of a leader that are in different ones are verified too, block by block, also in the trie.
A task puts the sets of one block into a trie and sends another block through it. At a node it holds, for all documents of
the other block at once, how many shingles of the path they share (partial overlaps, which all sets below have in common),
and drops those that no set below can be linked with: too different in size, or too few shingles left, in the subtree or
of the document behind that place of the order. A subtree without documents is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import Scratch, byte_texts, cut
from loomtext.llm.components import components
from loomtext.llm.neardup import is_linked, same_id_links, shingle_set

#: Size of a block: shingles of its documents, and DOC_COST more for each, so that a block has 500 documents at most.
BLOCK = 200_000
DOC_COST = 400


def least_shared(n, percent: int):
    """Shingles that a set of n shares at least with any that it is linked with."""
    return -(-n * percent // 100)


def least_hashes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), least: the shingles of least hash that step 2 looks at."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            sizes, digests, least = [], [], []
            for text in byte_texts(batch):
                s = shingle_set(text, width)
                spare = len(s) - least_shared(len(s), percent)
                sizes.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                least.append(s[: spare + 1 + (spare + 1) // 2].astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "least"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, least array<long>")


def may_link(classes: DataFrame, percent: int) -> DataFrame:
    """_id of the representatives (rep, n, least) whose shingles of least hash are shared often enough for a link.

    If sets of n and m have least_shared(n) in common at least, those looked at share as many as the smaller one has behind its
    spare ones, and m is least_shared(n) at least. A rep of several sets counts the shingles of all, so none is lost.
    """
    each = classes.select("rep", F.explode("least").alias("gram"))
    again = each.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col("gram").alias("_gram"))
    shared = each.join(again, F.col("gram") == F.col("_gram")).groupBy(F.col("rep").alias("_id")).agg(F.count(F.lit(1)).alias("_shared"))
    m = F.ceil(F.col("n") * percent / 100)
    needed = F.least(m, 1 + F.floor((m - F.ceil(m * percent / 100) + 1) / 2))
    return classes.select("rep", needed.alias("_needed")).join(shared, F.col("rep") == F.col("_id")).where("_shared >= _needed").select("_id").distinct()


def shingles_of(texts: DataFrame, width: int) -> DataFrame:
    """rep (doc_id), tag (of the set), n, grams: the shingles of texts (doc_id, text)."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            sets = [shingle_set(t, width).astype(np.int64) for t in byte_texts(batch)]
            tags = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tags), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "tag", "n", "grams"]
            )

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, tag long, n long, grams array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, usable: DataFrame, width: int) -> DataFrame:
    """rep, tag, n, grams of the documents whose ids are wanted, each set once; only a doc_id of several rows needs its tag."""
    repeated = cut(usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col("doc_id").alias("_again")))
    rows = docs.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi")
    if repeated.isEmpty():
        return shingles_of(rows, width).withColumn("tag", F.lit(0).cast("long"))
    same = F.col("doc_id") == F.col("_again")
    once = shingles_of(rows.join(repeated, same, "left_anti"), width).withColumn("tag", F.lit(0).cast("long"))
    return once.unionByName(shingles_of(rows.join(repeated, same, "left_semi"), width).where("n > 0").dropDuplicates(["rep", "tag"]))


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """rep, n, counts, grams: the shared shingles of sets (rep, tag, n, grams) in the global order, frequent ones first.

    Only of sets that share enough for a link.
    """
    each = sets.select("rep", "tag", "n", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select(F.col("gram").alias("_gram"), "count")
    in_order = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("place"), "gram")))
    shared = each.join(counts, F.col("gram") == F.col("_gram")).groupBy("rep", "tag", "n").agg(in_order.alias("_in_order"))
    return shared.where(F.size("_in_order") >= F.ceil(F.col("n") * percent / 100)).select(
        "rep", "n", F.transform("_in_order", lambda x: -x["place"]).alias("counts"), F.transform("_in_order", lambda x: x["gram"]).alias("grams")
    )


def followers(sets: DataFrame, percent: int) -> DataFrame:
    """lead, rep: each set with the least rep of those that share one of its rarest shingles."""
    own = F.col("n") - F.size("grams")
    rare = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own).cast("int")
    each = sets.where(rare > 0).select("rep", F.explode(F.slice("grams", -rare, rare)).alias("gram"))
    leads = each.groupBy("gram").agg(F.min("rep").alias("lead"), F.max("rep").alias("_last")).where("lead < _last").select(F.col("gram").alias("_gram"), "lead")
    return each.join(leads, F.col("gram") == F.col("_gram")).where("lead < rep").select("lead", "rep").distinct()


class Sets:
    """Sets of one block: reps, sizes, components, and their shingles as places in an order that two blocks share."""

    def __init__(self, rows: list[tuple]) -> None:
        self.reps, self.sizes, self.parts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        self.counts, self.grams = [r[3] for r in rows], [r[4] for r in rows]
        self.places: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.reps)


def place_in_order(*blocks: Sets) -> int:
    """Replace shingles by their places in the global order, from 0, among those of some blocks; returns how many there are."""
    grams = np.concatenate([g for b in blocks for g in b.grams])
    counts = np.concatenate([c for b in blocks for c in b.counts])
    values, first, which = np.unique(grams, return_index=True, return_inverse=True)
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, -counts[first]))] = np.arange(len(values))
    which = place[which]
    done = 0
    for b in blocks:
        b.places = []
        for g in b.grams:
            b.places.append(which[done : done + len(g)])
            done += len(g)
    return len(values)


def trie_links(left: Sets, right: Sets, n_places: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of left (its index), the indexes of those of right that it is linked with; equal parts may be left out.

    left becomes a trie: sets sorted by their places, in which a node is a range of sets and the places that they begin with.
    """
    order = sorted(range(len(left)), key=lambda i: left.places[i].astype(">i8").tobytes())
    paths = [left.places[i] for i in order]
    sizes, parts = left.sizes[order], left.parts[order]
    lengths = np.array([len(p) for p in paths])
    lcp = np.zeros(len(paths) + 1, np.int64)
    for i in range(1, len(paths)):
        k = min(lengths[i - 1], lengths[i])
        unlike = paths[i - 1][:k] != paths[i][:k]
        lcp[i] = unlike.argmax() if unlike.any() else k
    # Which documents of right have a place, and where each one's places lie.
    owner = np.repeat(np.arange(len(right)), [len(p) for p in right.places])
    flat = np.concatenate(right.places)
    by_place = np.argsort(flat, kind="stable")
    has, starts = owner[by_place], np.searchsorted(flat[by_place], np.arange(n_places + 1))
    keys = owner * n_places + flat
    begins = np.searchsorted(owner, np.arange(len(right)))
    shared_all = np.array([len(p) for p in right.places])

    stack = [(0, len(paths), 0, np.arange(len(right)), np.zeros(len(right), np.int64))] if len(paths) else []
    while stack:
        lo, hi, depth, docs, overlap = stack.pop()
        inner = lcp[lo + 1 : hi]
        end = int(inner.min()) if hi - lo > 1 else int(lengths[lo])
        edge = paths[lo][depth:end]
        if len(edge):
            runs = starts[edge + 1] - starts[edge]
            at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(starts[edge], runs)
            overlap = overlap + np.bincount(has[at], minlength=len(right))[docs]
        smallest, largest, longest = sizes[lo:hi].min(), sizes[lo:hi].max(), lengths[lo:hi].max()
        n = right.sizes[docs]
        passed = np.searchsorted(keys, docs * n_places + edge[-1], "right") - begins[docs] if len(edge) else 0
        most = overlap + np.minimum(longest - end, shared_all[docs] - passed)
        alive = (100 * n >= percent * smallest) & (100 * largest >= percent * n) & ((100 + percent) * most >= percent * (smallest + n))
        if hi - lo == 1 or parts[lo:hi].min() == parts[lo:hi].max():
            alive &= right.parts[docs] != parts[lo]
        if not alive.any():
            continue
        docs, overlap = docs[alive], overlap[alive]
        while lo < hi and lengths[lo] == end:
            found = docs[is_linked(overlap, sizes[lo], right.sizes[docs], percent)]
            if len(found):
                yield order[lo], found
            lo += 1
        bounds = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == end)), hi] if lo < hi else []
        stack += [(int(a), int(b), end, docs, overlap) for a, b in zip(bounds, bounds[1:], strict=False)]


def spanning_links(left: Sets, right: Sets | None, percent: int) -> list[tuple[int, int]]:
    """Of the links between left and right (or within left), those that first connect two parts."""
    other = left if right is None else right
    n_places = place_in_order(left) if right is None else place_in_order(left, right)
    part = {int(c): int(c) for c in np.concatenate([left.parts, other.parts])}

    def root(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    found = []
    for i, linked in trie_links(left, other, n_places, percent):
        for j in linked:
            a, b = root(int(left.parts[i])), root(int(other.parts[j]))
            if a != b:
                part[a] = b
                found.append((int(left.reps[i]), int(other.reps[j])))
    return found


_UNIT = ("lead", "u", "v")


def verified(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect parts, of units (lead, u, v, side, rep, part): side 0 against 1, or within 0 where u = v."""
    rows = units.join(sets.select(F.col("rep").alias("_r"), "n", "counts", "grams"), F.col("rep") == F.col("_r")).drop("_r")

    def run(batches):
        import pyarrow as pa

        def close() -> list[tuple[int, int]]:
            if unit is None or not sides[0] or unit[1] != unit[2] and not sides[1]:
                return []
            return spanning_links(Sets(sides[0]), None if unit[1] == unit[2] else Sets(sides[1]), percent)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        unit, sides = None, ([], [])
        for batch in batches:
            found: list[tuple[int, int]] = []
            counts, grams = (batch.column(c) for c in ("counts", "grams"))
            plain = [batch.column(c).to_pylist() for c in (*_UNIT, "side", "rep", "n", "part")]
            for i, (lead, u, v, side, rep, n, part) in enumerate(zip(*plain, strict=True)):
                if (lead, u, v) != unit:
                    found += close()
                    unit, sides = (lead, u, v), ([], [])
                sides[side].append((rep, n, part, counts[i].values.to_numpy(zero_copy_only=False), grams[i].values.to_numpy(zero_copy_only=False)))
            yield out(found)
        yield out(close())

    return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(run, "a long, b long")


def _cost(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("rep").alias("_w"), (F.size("grams") + DOC_COST).alias("_cost"))


def _spot(n: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), n).cast("int")


def star_links(follow: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of followers to their leaders: blocks of followers as tries, through which the leader goes."""
    costs = follow.join(_cost(sets), F.col("rep") == F.col("_w"))
    blocks = cut(costs.groupBy("lead").agg(F.ceil(F.sum("_cost") / BLOCK).cast("int").alias("_n")).withColumnRenamed("lead", "_lead"))
    dealt = follow.join(blocks, F.col("lead") == F.col("_lead")).select("lead", _spot(F.col("_n")).alias("u"), F.lit(0).alias("side"), "rep")
    leads = blocks.select(F.col("_lead").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("u"), F.lit(1).alias("side"), F.col("_lead").alias("rep"))
    return verified(dealt.union(leads).select("lead", "u", F.lit(-1).alias("v"), "side", "rep", F.col("rep").alias("part")), sets, percent)


def stray_links(follow: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect followers of one leader that are in different components so far. label: node, component.

    Those outside the leader's largest component have the blocks 0 to ns - 1, the rest ns and on. A unit is two blocks, of
    which one at least is of the former.
    """
    named = follow.join(label, F.col("rep") == F.col("node"), "left").select("lead", "rep", F.coalesce("component", "rep").alias("part")).join(_cost(sets), F.col("rep") == F.col("_w")).drop("_w")
    parts = named.groupBy("lead", "part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_cost"))
    mixed = parts.groupBy("lead").agg(F.max(F.struct("_n", "part", "_cost")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_cost").alias("_all")).where("_parts > 1")
    n_blocks = lambda cost: F.ceil(cost / BLOCK).cast("int")
    of_lead = mixed.select(F.col("lead").alias("_lead"), F.col("_top.part").alias("_largest"), n_blocks(F.col("_all") - F.col("_top._cost")).alias("_ns"), n_blocks(F.col("_top._cost")).alias("_nm"))
    rows = cut(named.join(of_lead, F.col("lead") == F.col("_lead")).withColumn("_stray", F.col("part") != F.col("_largest")).select("lead", "rep", "part", "_stray", "_ns", "_nm"))
    strays = rows.where("_stray").withColumn("_s", _spot(F.col("_ns"))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_ns") + F.col("_nm") - 1)))
    rest = rows.where("not _stray").withColumn("_s", F.col("_ns") + _spot(F.col("_nm"))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)))
    units = strays.unionByName(rest).select("lead", F.least("_s", "_t").alias("u"), F.greatest("_s", "_t").alias("v"), (F.col("_s") > F.col("_t")).cast("int").alias("side"), "rep", "part")
    return verified(units, sets, percent)


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Components of documents (doc_id, text) whose sets of word n-grams have a Jaccard similarity of percent / 100 or more.

    Returns doc_id, n_shingles and component_id, the smallest doc_id that links lead to, itself included. Words are lowered
    (A-Z); a text of fewer words than width is one n-gram, one without words, or null, has none and no link. No link is lost,
    but for collisions of 64-bit hashes. Rows that repeat a doc_id each get a row; what one is linked with, all are. A null
    doc_id has no link and a null component_id. Other columns are ignored; an empty table gives no rows. percent is 1 to 100.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is 1 to 100, not {percent}")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    try:
        sketch = scratch.write(least_hashes(docs, width, percent), "sketch")
        known = sketch.where("doc_id is not null").select("doc_id", F.coalesce("digest", F.lit(b"")).alias("digest"))
        usable = sketch.where("doc_id is not null and digest is not null")
        classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("least").alias("least"))
        classes = scratch.write(classes, "classes")
        wanted = cut(may_link(classes, percent))
        sets = scratch.write(sets_of(docs, wanted, usable, width), "grams")
        sets = scratch.write(ordered_sets(sets, percent), "sets")
        follow = cut(followers(sets, percent))
        links = star_links(follow, sets, percent).union(same_id_links(known, classes))
        label = components(links)
        more = cut(stray_links(follow, label, sets, percent))
        if not more.isEmpty():
            label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        label = label.select(F.col("node").alias("_node"), "component")
        several = classes.where("copies > 1").select(F.col("digest").alias("_digest"), "rep")
        of_doc = sketch.select("doc_id", "n_shingles", "digest").join(several, F.col("digest") == F.col("_digest"), "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
        return cut(of_doc.join(label, F.col("rep") == F.col("_node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    finally:
        scratch.drop()
