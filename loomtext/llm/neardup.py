"""MinHash near-dedup (2): tensored banding.

Plain banding makes L table keys of K minhashes each, K x L in all. Here two small collections A and B hold n half-keys
of K / 2 minhashes each, and table (i, j) is keyed by the pair (A_i, B_j): n x n tables from K x n minhashes. Two sets of
Jaccard similarity s share a table unless no half-key of A agrees or none of B does, so a pair is missed with a
probability under 2 (1 - s^(K/2))^n. banding() chooses K and n from the similarity that is asked for, so that this is at
most MISS there; for 0.8 it takes K = 4, n = 9, which miss 2e-4 of the pairs at 0.8 and 3e-6 of those at 0.9.

Candidates are verified on whole shingle sets, without any other filter, and no pair of them is ever a row:
1. Documents of equal sets are one class, represented by its smallest doc_id.
2. Each representative is verified against the leaders (smallest members) of its buckets. A leader's followers, from all
   the buckets that it leads, are dealt to blocks of bounded size, and the leader's set goes to each block once.
3. Links so far make components. Two followers of one leader that are in different components are verified too: those
   outside the leader's largest component (strays) against each other and against the rest, block by block. A task
   holds two blocks, counts what their documents share by one sparse product, and returns links that span what it
   found connected, at most one for each document.
Any two members of a bucket are followers of its leader or the leader, so after that every pair that shares a bucket was
verified or is connected already. Step 2 is linear in a group of copies. Step 3 takes time (not rows) by strays x
followers of one leader, which is what it takes to rule out links among documents that are alike but not enough.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtext.llm.common import Scratch, byte_texts, cut, gram_hashes, hash_words
from loomtext.llm.components import components

#: Probability at most with which a pair at the threshold shares no table.
MISS = 2.1e-4
#: Size of a block: shingles of its documents, and DOC_COST more for each, so that a block has 1,000 documents at most.
BLOCK = 400_000
DOC_COST = 400


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Half-keys of each collection and minhashes of a half-key for a similarity of percent / 100."""
    s = min(percent / 100, 0.99)
    width = min(8, max(1, round(math.log(0.64) / math.log(s))))
    return math.ceil(math.log(miss / 2) / math.log(1 - s**width)), width


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle ids; A-Z are lowered. Two sets of 1,000 collide with a probability under 1e-12."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = hash_words(words, len(words))
    if len(words) < width:
        from xxhash import xxh3_64_intdigest

        return np.array([xxh3_64_intdigest(b" ".join(words), seed=width)], np.uint64)
    return np.unique(gram_hashes(hashed, width))


def minhashes(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Least hash of the set under each seed; in blocks, so that a long text's table of hashes stays small."""
    found = []
    for i in range(0, len(shingles), 16384):
        with np.errstate(over="ignore"):
            x = (shingles[None, i : i + 16384] ^ seeds[:, None]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        found.append(x.min(axis=1))
    return np.min(found, axis=0)


def sketches(docs: DataFrame, width: int, half_keys: int, half_width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), keys: the half-keys of A and then those of B."""
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>"

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        seeds = np.random.default_rng(20).integers(1, 2**63, 2 * half_keys * half_width, np.uint64)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in byte_texts(batch):
                s = shingle_set(text, width)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(xxh3_128_digest(s.tobytes()))
                m = minhashes(s, seeds).reshape(2 * half_keys, half_width)
                key = m[:, 0]
                for k in range(1, half_width):
                    with np.errstate(over="ignore"):
                        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + m[:, k]
                keys.append(key.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """rep (doc_id), n (shingles), shingles (sorted 64-bit ids, as bytes) of texts (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t, width) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "shingles"]
            )

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, n long, shingles binary")


def followers(classes: DataFrame, half_keys: int) -> DataFrame:
    """lead, rep: each representative with the smallest member of each bucket that it shares. classes: rep, keys.

    Table keys are made only of half-keys that some other representative has too: most documents have none.
    """
    half = classes.select("rep", F.posexplode("keys").alias("at", "half"))
    again = half.groupBy("at", "half").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo < _hi").select(F.col("at").alias("_at"), F.col("half").alias("_half"))
    shared = half.join(again, (F.col("at") == F.col("_at")) & (F.col("half") == F.col("_half"))).groupBy("rep").agg(F.collect_list(F.struct("at", "half")).alias("_h"))
    of_a, of_b = F.filter("_h", lambda x: x["at"] < half_keys), F.filter("_h", lambda x: x["at"] >= half_keys)
    keys = F.flatten(F.transform(of_a, lambda a: F.transform(of_b, lambda b: F.xxhash64(a["at"], a["half"], b["at"], b["half"]))))
    keyed = cut(shared.select("rep", F.explode(keys).alias("key")))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("_last")).where("lead < _last").select(F.col("key").alias("_key"), "lead")
    return keyed.join(buckets, F.col("key") == F.col("_key")).where("lead < rep").select("lead", "rep").distinct()


def is_linked(shared, n, m, percent: int):
    """Whether sets of n and m shingles, of which they share some, are linked; also for arrays."""
    return (shared > 0) & (100 * shared >= percent * (n + m - shared))


def star_links(follow: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of followers to their leaders."""
    weights = sets.select(F.col("rep").alias("_w"), (F.col("n") + DOC_COST).alias("_cost"))
    blocks = follow.join(weights, F.col("rep") == F.col("_w")).groupBy("lead").agg(F.ceil(F.sum("_cost") / BLOCK).cast("int").alias("blocks"))
    blocks = cut(blocks.select(F.col("lead").alias("_lead"), "blocks"))
    payload = sets.select(F.col("rep").alias("_r"), "shingles")
    dealt = follow.join(blocks, F.col("lead") == F.col("_lead")).select("lead", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(1).alias("role"), "rep")
    leads = blocks.select(F.col("_lead").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), F.col("_lead").alias("rep"))
    rows = dealt.union(leads).join(payload, F.col("rep") == F.col("_r")).select("lead", "block", "role", "rep", "shingles")

    def run(batches):
        import pyarrow as pa

        unit, heads = None, []
        for batch in batches:
            a, b = [], []
            for lead, block, role, rep, raw in zip(*(batch.column(c).to_pylist() for c in ("lead", "block", "role", "rep", "shingles")), strict=True):
                if (lead, block) != unit:
                    unit, heads = (lead, block), []
                own = np.frombuffer(raw, np.uint64)
                if role == 0:
                    heads.append(own)
                    continue
                for head in heads:
                    if len(own) and len(head) and 100 * min(len(own), len(head)) >= percent * max(len(own), len(head)):
                        where = np.minimum(np.searchsorted(head, own), len(head) - 1)
                        if is_linked(int((head[where] == own).sum()), len(own), len(head), percent):
                            a.append(lead)
                            b.append(rep)
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("lead", "block").sortWithinPartitions("lead", "block", "role").mapInArrow(run, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right: a sparse matrix product.

    A shingle that many documents of both sides have is a column of a dense product; the pairs that share one of the
    others are counted one by one, some millions at a time.
    """
    n, m = len(left), len(right)
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(map(len, left))
    docs_l, docs_r = np.repeat(np.arange(n), [len(x) for x in left]), np.repeat(np.arange(m), [len(x) for x in right])
    of_l, of_r = np.bincount(codes[:split], minlength=len(values)), np.bincount(codes[split:], minlength=len(values))
    dense = of_l * of_r >= max(16, n * m // 64)
    counts = np.zeros((n, m))
    columns = np.flatnonzero(dense)
    place = np.full(len(values), -1)
    for i in range(0, len(columns), 2048):
        some = columns[i : i + 2048]
        place[:] = -1
        place[some] = np.arange(len(some))
        x, y = np.zeros((n, len(some)), np.float32), np.zeros((m, len(some)), np.float32)
        for table, docs, own in ((x, docs_l, codes[:split]), (y, docs_r, codes[split:])):
            at = place[own]
            table[docs[at >= 0], at[at >= 0]] = 1
        counts += x @ y.T
    # Rows of both sides in order of their shingle; each of the left meets the run of the right that has the same.
    keep_l, keep_r = ~dense[codes[:split]] & (of_r[codes[:split]] > 0), ~dense[codes[split:]]
    code_l, doc_l = codes[:split][keep_l], docs_l[keep_l]
    order = np.argsort(codes[split:][keep_r], kind="stable")
    code_r, doc_r = codes[split:][keep_r][order], docs_r[keep_r][order]
    first, runs = np.searchsorted(code_r, code_l), of_r[code_l]
    ends = np.cumsum(runs)
    flat = np.zeros(n * m)
    begin = 0
    while begin < len(runs):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 4_000_000, "right")))
        k = runs[begin:stop]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        flat += np.bincount(np.repeat(doc_l[begin:stop], k) * m + doc_r[np.repeat(first[begin:stop], k) + inside], minlength=n * m)
        begin = stop
    return (counts + flat.reshape(n, m)).astype(np.int64)


def spanning_links(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked between left and right (or within left), of sides (rep, component, set).

    Rows of one component are connected already; of the links found, those are returned that connect two parts first.
    """
    other = left if right is None else right
    counts = shared_counts([x[2] for x in left], [x[2] for x in other])
    n, m = np.array([len(x[2]) for x in left]), np.array([len(x[2]) for x in other])
    parts_l, parts_r = np.array([x[1] for x in left]), np.array([x[1] for x in other])
    linked = is_linked(counts, n[:, None], m[None, :], percent) & (parts_l[:, None] != parts_r[None, :])
    part = {int(c): int(c) for c in np.concatenate([parts_l, parts_r])}

    def root(x: int) -> int:
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    found = []
    for i, j in np.argwhere(linked):
        a, b = root(int(parts_l[i])), root(int(parts_r[j]))
        if a != b:
            part[a] = b
            found.append((left[i][0], other[j][0]))
    return found


def stray_links(follow: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect followers of one leader that are in different components so far. label: node, component."""
    weights = sets.groupBy("rep").agg(F.sum(F.col("n") + DOC_COST).alias("_cost")).select(F.col("rep").alias("_w"), "_cost")
    named = follow.join(label, F.col("rep") == F.col("node"), "left").select("lead", "rep", F.coalesce("component", "rep").alias("component"))
    named = named.join(weights, F.col("rep") == F.col("_w")).drop("_w")
    parts = named.groupBy("lead", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_cost"))
    mixed = parts.groupBy("lead").agg(F.max(F.struct("_n", "component", "_cost")).alias("_top"), F.count(F.lit(1)).alias("_parts"), F.sum("_cost").alias("_all")).where("_parts > 1")
    of_lead = mixed.select(
        F.col("lead").alias("_lead"),
        F.col("_top.component").alias("_largest"),
        F.ceil((F.col("_all") - F.col("_top._cost")) / BLOCK).cast("int").alias("_ns"),
        F.ceil(F.col("_top._cost") / BLOCK).cast("int").alias("_nm"),
    )
    rows = cut(named.join(of_lead, F.col("lead") == F.col("_lead")).select("lead", "rep", "component", F.col("component") != F.col("_largest"), "_ns", "_nm").toDF("lead", "rep", "component", "stray", "_ns", "_nm"))
    spot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    # Strays have the blocks 0 to ns - 1, the rest ns and on. A unit is two blocks u <= v, of which u is of strays.
    strays = rows.where("stray").withColumn("_s", spot(F.col("_ns"))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_ns") + F.col("_nm") - 1)))
    rest = rows.where("not stray").withColumn("_s", F.col("_ns") + spot(F.col("_nm"))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)))
    units = strays.unionByName(rest).select("lead", F.least("_s", "_t").alias("u"), F.greatest("_s", "_t").alias("v"), (F.col("_s") > F.col("_t")).cast("int").alias("side"), "rep", "component")
    loaded = units.join(sets.select(F.col("rep").alias("_r"), "shingles"), F.col("rep") == F.col("_r")).drop("_r")

    def run(batches):
        import pyarrow as pa

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        def close() -> list[tuple[int, int]]:
            if unit is None or not sides[0] or unit[1] != unit[2] and not sides[1]:
                return []
            return spanning_links(sides[0], None if unit[1] == unit[2] else sides[1], percent)

        unit, sides = None, ([], [])
        for batch in batches:
            found: list[tuple[int, int]] = []
            for lead, u, v, side, rep, component, raw in zip(*(batch.column(c).to_pylist() for c in ("lead", "u", "v", "side", "rep", "component", "shingles")), strict=True):
                if (lead, u, v) != unit:
                    found += close()
                    unit, sides = (lead, u, v), ([], [])
                sides[side].append((rep, component, np.frombuffer(raw, np.uint64)))
            yield out(found)
        yield out(close())

    return loaded.repartition("lead", "u", "v").sortWithinPartitions("lead", "u", "v").mapInArrow(run, "a long, b long")


def same_id_links(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of a doc_id that several rows have, with different sets, to the representatives of those sets."""
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).where("_lo < _hi").select(F.col("doc_id").alias("_id"))
    rows = usable.select("doc_id", "digest").join(several, F.col("doc_id") == F.col("_id"))
    reps = classes.select(F.col("digest").alias("_digest"), "rep")
    return rows.join(reps, F.col("digest") == F.col("_digest")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents (doc_id, text) whose word-shingle sets have a Jaccard similarity of percent / 100 or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), in which
    component_id is doc_id where nothing is linked. A text without words, or null, has an empty set and no link. Rows
    that repeat a doc_id each get a row; what one is linked with, all are. A null doc_id has no link, a null
    component_id and is kept. Other columns are ignored; an empty table gives no rows. percent is 1 to 100.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent is 1 to 100, not {percent}")
    half_keys, half_width = banding(percent)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(sketches(docs, width, half_keys, half_width))
    usable = sketch.where("doc_id is not null and digest is not null")
    classes = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("keys").alias("keys")))
    follow = cut(followers(classes, half_keys))
    # Only representatives that share a bucket are ever compared; their sets are made once.
    wanted = follow.select(F.col("lead").alias("_id")).union(follow.select("rep")).distinct()
    try:
        sets = scratch.write(with_sets(docs.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi"), width), "sets")
        links = star_links(follow, sets, percent).union(same_id_links(usable, classes))
        label = components(links)
        more = cut(stray_links(follow, label, sets, percent))
    finally:
        scratch.drop()
    if not more.isEmpty():
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    label = label.select(F.col("node").alias("_node"), "component")
    # The class of each document: only those of several documents need to be looked up.
    several = classes.where("copies > 1").select(F.col("digest").alias("_digest"), F.col("rep"))
    of_doc = sketch.join(several, F.col("digest") == F.col("_digest"), "left").withColumn("rep", F.when(F.expr("doc_id is not null and digest is not null"), F.coalesce("rep", "doc_id")))
    component = F.coalesce("component", "rep", "doc_id")
    return of_doc.join(label, F.col("rep") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest doc_id, whose text sorts first.

    Rows with a null doc_id are linked with nothing and stay.
    """
    kept = near_duplicates(docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.where("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")
    first = rows.withColumn("_row", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).where("_row = 1").drop("_row")
    return first.unionByName(docs.where("doc_id is null"))
