"""Packing, mixing and token attribution: exact round trips and invariants."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtext.llm import mixing, packing, queries, tokens

from .conftest import edge_rows


def brute_pieces(rows, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def assert_packed(found, rows):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == brute_pieces(rows)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins)


def test_packing(small, edge, nothing):
    df, rows = small
    found = packing.pack(df).collect()
    used = assert_packed(found, rows)
    assert used <= -(-sum(r["length"] for r in found) // packing.CAPACITY) * 1.02 + 1
    assert_packed(packing.pack(edge).collect(), [(r[0], r[1]) for r in edge_rows()])
    assert packing.pack(nothing).count() == 0


def test_words_give_the_ids_of_their_text():
    from tokenizers import Tokenizer

    encoder, whole = packing.WordEncoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = ["It's 3rd-rate, isn't it?", "ÄÖÜ ß é é İ ΑΣ ς", "a b　c \x0b\x0c d", "<|endoftext|> x<|startoftext|>y <|EndOfText|>", "!!! ... ,.; word%%% 漢字かな 😀👍🏽", "", "don't 'tis we'll $5.00"]
    rng = random.Random(5)
    texts += ["".join(rng.choice("abcXYZ é'ß.,!<|>\n\t0189漢😀́") for _ in range(60)) for _ in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.ids([t.encode() for t in texts])]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_fullest_is_fullest(seed):
    rng = random.Random(seed)
    left = Counter(rng.randint(1, 30) for _ in range(12))
    lengths, counts = packing.fullest(dict(left), 40)
    reach = {max(left)}
    items = list((left - Counter([max(left)])).elements())
    for n in items:
        reach |= {x + n for x in reach if x + n <= 40}
    assert sum(n * c for n, c in zip(lengths, counts, strict=True)) == max(reach)
    assert all(c <= left[n] for n, c in zip(lengths, counts, strict=True))


def water_fill(sizes, weights, repeats=3):
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        share = (total - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > repeats * sizes[s]}
        if not full:
            return target | {s: share * weights[s] for s in open_}
        target |= {s: repeats * sizes[s] for s in full}
        open_ -= full
    return target


def test_mixing(small, edge, nothing):
    df, rows = small
    found = mixing.mix(df).collect()
    by = {r["doc_id"]: r for r in found}
    assert {i: r["size"] for i, r in by.items()} == {i: len(t.encode().split()) for i, t in rows}
    sizes = Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    want = water_fill(sizes, weights)
    taken, longest = Counter(), Counter()
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in want)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert mixing.mix(edge).count() == len(edge_rows())
    assert mixing.mix(nothing).count() == 0
    order = mixing.curriculum(df, ["doc_id"]).count()
    assert order == sum(r["copies"] for r in found)


def test_capped_targets(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 5)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    want = water_fill(dict(sizes), {"a": 5, "b": 2, "c": 1, None: 5})
    assert got == pytest.approx(want)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_adds_up(small, edge, nothing, rule):
    for df, n in ((small[0], len(small[1])), (edge, None)):
        found = tokens.section_tokens(df, rule).collect()
        per = defaultdict(float)
        for r in found:
            per[r["doc_id"], r["doc_tokens"]] += r["n_tokens"]
        if n:
            assert len(per) == n
            assert all(total == pytest.approx(k[1]) for k, total in per.items())
    assert tokens.section_tokens(nothing, rule).count() == 0


def test_attribution_against_offsets():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    text = "First line.\n\n\n  Second, ßé 漢字\n\tthird 😀 x\n"
    encoder, other = tokens.ByteEncoder(tokens.tokenizer_path()), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    starts, ends = encoder.spans(text.encode())
    assert ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()
    assert len(starts) == len(other.encode(text, add_special_tokens=False).ids)
    s0, s1 = tokens.line_spans(text.encode())
    assert b"".join(text.encode()[a:b] for a, b in zip(s0, s1, strict=True)) == text.encode()
    counts, crossing = tokens.attribute(starts, ends, s0, s1, "first")
    owner = [next(k for k in range(len(s0)) if s0[k] <= a < s1[k]) for a in starts]
    assert counts.tolist() == [owner.count(k) for k in range(len(s0))]
    assert crossing.sum() > 0 and tokens.attribute(starts, ends, s0, s1, "share")[0].sum() == pytest.approx(len(starts))


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
