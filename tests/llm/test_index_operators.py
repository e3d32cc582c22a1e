"""Byte-wise dedup, the dataset manifest and the prefix trie against brute force, on odd rows and small blocks."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.llm import manifest, prefixtrie, queries, runindex


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# run-length index

def flat(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(s) for s in strings])).astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6),
       st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 4 for x in b)), min_size=1, max_size=4), st.sampled_from([3, 5, 12]))
def test_matching_statistics(strings, patterns, cap):
    patterns = patterns + strings[:2]
    index, got = runindex.RunIndex(*flat(strings), cap), {}
    data, offsets = flat(patterns)
    for who, place, length, row in index.match(data, offsets):
        for w, p, n, r in zip(who.tolist(), place.tolist(), length.tolist(), row.tolist()):
            got[w, p] = n
            at = index.members[r]
            assert index.text[at: at + n].tolist() == [index.code[c] for c in patterns[w][p: p + n]]
    for w, pattern in enumerate(patterns):
        for p in range(len(pattern)):
            n = 0
            while n < min(cap, len(pattern) - p) and any(pattern[p: p + n + 1] in s for s in strings):
                n += 1
            assert got[w, p] == n


def left_by_brute_force(rows, least):
    """What is kept of each (id, text), by looking every window up."""
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - least + 1) if i is not None else ():
            w = raw[p: p + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - least + 1) if i is not None else ():
            if first[raw[p: p + least]] < i:
                gone[p: p + least] = [True] * least
        out.append((i, t, None if t is None else bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def order(row):
    return str(row[0]), row[1] or "", row[2] or b""


@pytest.mark.parametrize("target", [runindex.TARGET, 2000, 1])
def test_bytes_removed_equal_brute_force(spark, docs_of, target):
    """With small targets every name is too hot for a task."""
    draw = random.Random(3)
    words = ["alpha", "bé", "gamma ray", "ab" * 9, "delta", "😀", "kappa", "x"]
    passages = [" ".join(draw.choice(words) for _ in range(12)) for _ in range(6)]
    rows = [(draw.choice([None, *range(40)]), " ".join(draw.choice(passages)[draw.randint(0, 9):] for _ in range(draw.randint(0, 5)))) for _ in range(60)]
    rows += [(50, None), (51, ""), (52, "a" * 9000), (53, "a" * 700), (54, rows[3][1]), (55, rows[3][1]), (55, rows[3][1]), (None, "a" * 99), (56, "é" * 40)]
    found = runindex.deduplicate(docs_of(rows), least=20, gram=6, target=target).collect()
    got = [(r.doc_id, r.text, None if r.kept is None else bytes(r.kept)) for r in found]
    assert sorted(got, key=order) == sorted(left_by_brute_force(rows, 20), key=order)
    for r in found:
        raw = (r.text or "").encode()
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
        assert len(raw) - sum(s.end - s.start for s in r.removed) == len(r.kept or b"")


def test_bytes_removed_on_odd_rows(spark, odd, docs_of):
    own = odd.withColumns({c: F.lit("mine") for c in ("doc", "hash", "own", "name", "piece", "text_", "spans", "packed", "row", "at")})
    found = runindex.deduplicate(own)
    assert set(found.columns) == {*own.columns, "removed", "kept"}
    kept = {(r.doc_id, r.text): r.kept for r in found.collect()}
    assert {r.at for r in found.collect()} == {"mine"} and found.count() == odd.count()
    want = {(i, t): k for i, t, k in left_by_brute_force([(r.doc_id, r.text) for r in odd.collect()], runindex.LEAST)}
    assert {k: None if v is None else bytes(v) for k, v in kept.items()} == want
    assert runindex.deduplicate(docs_of([])).count() == 0
    assert runindex.deduplicate(docs_of([(1, None), (2, "short")])).count() == 2


def test_pieces_of_long_texts_cover_every_window():
    raw = np.frombuffer(bytes(random.Random(1).choice(b"abc") for _ in range(3 * runindex.STRETCH // 2)), np.uint8)
    offsets = np.array([0, 30, 30, 90, 70_000, len(raw)])
    seen = np.zeros(len(raw), int)
    for _, start, count in runindex.pieces(raw, offsets, 50, 16):
        np.add.at(seen, np.concatenate([np.arange(s, s + n) for s, n in zip(start, count)]), 1)
    want = np.concatenate([np.r_[np.ones(max(b - a - 49, 0), int), np.zeros(min(b - a, 49), int)] for a, b in zip(offsets, offsets[1:])])
    assert (seen == want).all()


def test_parcels_are_as_many_as_buckets_however_many_shards(docs_of, monkeypatch):
    """Small targets make many shards; a task sent a parcel to each of them, often of a single piece."""
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(200)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[draw.randint(0, 400):][:700] + "x" * (i % 3)) for i, t in enumerate(texts)]
    seen, by_parcels = [], runindex._by_parcels
    monkeypatch.setattr(runindex, "BUCKET", 1)
    monkeypatch.setattr(runindex, "BUCKETS", 7)
    monkeypatch.setattr(runindex, "_by_parcels", lambda emitted, **how: seen.append(emitted.where("bucket is not null").select("bucket").collect()) or by_parcels(emitted, **how))
    found = runindex.deduplicate(docs_of(rows).repartition(3), target=1000).collect()
    assert sorted(((r.doc_id, r.text, bytes(r.kept)) for r in found), key=order) == sorted(left_by_brute_force(rows, runindex.LEAST), key=order)
    (parcels,) = seen
    assert {r.bucket for r in parcels} == set(range(7)) and len(parcels) <= 3 * 7


@pytest.mark.parametrize("kind", ["string", "decimal(9,2)", "date", "timestamp", "binary"])
def test_ids_of_other_kinds_keep_their_order(spark, docs_of, kind):
    """Ids are 10 to 21; casts to these kinds keep their order."""
    draw = random.Random(9)
    texts = [" ".join("".join(draw.choices("abcé", k=6)) for _ in range(30)) for _ in range(4)]
    rows = [(10 + i, texts[i % 4][draw.randint(0, 60):] + texts[(i + 1) % 4][:80]) for i in range(12)]
    ids = F.col("doc_id").cast("string")
    ids = F.concat(F.lit("2001-01-"), ids).cast(kind) if kind in ("date", "timestamp") else ids.cast(kind)
    found = runindex.deduplicate(docs_of(rows).withColumns({"mine": F.col("doc_id"), "doc_id": ids})).collect()
    assert sorted(((r.mine, r.text, bytes(r.kept)) for r in found), key=order) == sorted(left_by_brute_force(rows, runindex.LEAST), key=order)


def test_bitmap_of_repeated_names_grows_with_them():
    """One of fixed size let a tenth of the other names pass here, and all of them on larger tables."""
    draw, n, top = np.random.default_rng(4), 24_000_000, 4
    name, others = np.sort(draw.integers(0, 2 ** 64, n, np.uint64)), draw.integers(0, 2 ** 64, 200_000, np.uint64)
    bits = runindex.filter_bits(n, top)
    parts = np.split(name, np.searchsorted(name, np.arange(1, 1 << top).astype(np.uint64) << np.uint64(64 - top)))
    bitmap = np.concatenate([runindex.part_of_bitmap(x, bits, top) for x in parts])
    assert runindex.among(bitmap, name[::9], bits, top).all()
    assert runindex.among(bitmap, others, bits, top).mean() < 0.05
    assert runindex.filter_bits(10 ** 12, top) == runindex.MOST and runindex.filter_bits(0, 12) >= 12 + 6


# manifest

def tree(hashes):
    """Levels of a tree, lowest first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i: i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof_in(levels, place):
    out = []
    for level in levels[:-1]:
        low = place - place % 16
        out.append(("".join(level[low:place]), "".join(level[place + 1: low + 16])))
        place //= 16
    return out


def proved_by_brute_force(rows):
    groups = {}
    for i, g, leaf, claim in rows:
        groups.setdefault("-" if g is None else "=" + g, []).append((i is not None, i or 0, leaf, claim, i))
    trees = {}
    for g in sorted(groups, key=str.encode):
        groups[g].sort(key=lambda r: r[:3])
        trees[g] = tree([r[2] for r in groups[g]])
    top = tree([t[-1][0] for t in trees.values()])
    out = []
    for k, (g, levels) in enumerate(trees.items()):
        for place, (_, _, leaf, claim, i) in enumerate(groups[g]):
            steps = proof_in(levels, place) + proof_in(top, k)
            folded = claim or leaf
            for a, b in steps:
                folded = sha(a + folded + b)
            out.append((i, leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("block", [manifest.BLOCK, 16])
def test_proofs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(manifest, "BLOCK", block)  # several rounds of sweeps
    draw = random.Random(5)
    rows = [(i, g, sha(f"{g}{i}"), sha("x") if i % 5 == 0 else None) for g, n in ((None, 1), ("hot", 700), ("a", 17), ("é", 16), ("", 3)) for i in range(n)]
    rows += [(None, "a", sha("n"), None), (3, "a", sha("a3"), None), (3, "a", sha("twin"), sha("y")), *((0, f"s{k}", sha(f"s{k}"), None) for k in range(30))]
    draw.shuffle(rows)
    found = manifest.prove(spark.createDataFrame(rows, "doc_id long, source string, leaf string, claim string"))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=str) == sorted(proved_by_brute_force(rows), key=str)


def test_manifest_of_few_rows(spark):
    kind = "doc_id long, source string, leaf string, claim string"
    assert manifest.prove(spark.createDataFrame([], kind)).count() == 0
    leaf = sha("one")
    (row,) = manifest.prove(spark.createDataFrame([(1, None, leaf, None)], kind)).collect()
    assert tuple(row) == (1, leaf, leaf, leaf, sha(""), leaf, True)


def test_leaf_of_nulls_and_wide_characters(spark):
    df = spark.createDataFrame([(7, None, "é😀"), (None, "", "")], "a long, b string, c string")
    got = [r[0] for r in df.select(manifest.leaf_hash(*[F.col(c) for c in "abc"])).collect()]
    assert got == [sha("1:7-6:é😀"), sha("-0:0:")]


# prefix trie

def crc(i, by):
    return zlib.crc32(str(i).encode()) % by


def nodes_by_brute_force(rows):
    """Nodes of the trie of (conv, turn, role, text) rows whose turns do not tie."""
    talks = {}
    for c, t, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    talks = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in talks.items()}
    built = {c: tuple(talks.get(c - c % 100, [])[: crc(c, 6)] + own[crc(c, 6):]) for c, own in talks.items()}
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for seq, own in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = sum(all(t[: len(s)] != s or t == s for t in below) for s in below)
        saved = sum((len(members[s]) - 1) * len(s[-1][1]) for s in below if s)
        ends = sha(",".join(str(c) for c in sorted(own) if built[c] == seq))
        out.append((min(own), len(seq), min(members[seq[:-1]]) if seq else None, len(own), len(children), leaves, saved, ends))
    return out


def talks(n, turns, seed):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", None, "bot"]), draw.choice(["hi", "", None, "é😀", "go on"])) for c in n for t in range(draw.randint(1, turns))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment, shard", [(prefixtrie.SEGMENT, prefixtrie.SHARD), (4, 50), (1, 5)])
def test_trie_equals_brute_force(spark, monkeypatch, segment, shard):
    """Also where conversations fall into many segments and shards."""
    monkeypatch.setattr(prefixtrie, "SEGMENT", segment)
    monkeypatch.setattr(prefixtrie, "SHARD", shard)
    monkeypatch.setattr(prefixtrie, "PIECE", 2)
    rows = talks([*range(0, 12), *range(100, 112), *range(305, 309)], 9, 2)
    rows += [(400, t, "user", "same") for t in range(30)] + [(500 + k, t, "user", "same") for k in (0, 1, 2) for t in range(30)]
    rows += [(None, 1, "user", "x"), (7, None, "bot", "first"), (399, 5, None, None)]
    got = [tuple(r) for r in prefixtrie.trie(prefixtrie.rebuilt(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert sorted(got, key=str) == sorted(nodes_by_brute_force(rows), key=str)


def test_trie_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.trie(prefixtrie.rebuilt(empty)).count() == 0
    twice = [(100, 0, "user", "a")] * 2 + [(100, 1, "user", "b" * 20000)]
    table = spark.createDataFrame(twice, SCHEMA).withColumns({c: F.lit("mine") for c in ("i", "j", "h", "h1", "d1", "part", "shard", "one", "kind")})
    assert sorted(r.depth for r in prefixtrie.trie(prefixtrie.rebuilt(table)).collect()) == [0, 1, 2, 3]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(-2 ** 63, 2 ** 63 - 1), st.integers(-3, 3)), max_size=300))
def test_slots_are_minimal_and_verified(pairs):
    a, b = (np.array(x, np.int64) for x in (list(zip(*pairs)) or [(), ()]))
    table = prefixtrie.Slots(a, b)
    assert sorted(table.slot(a, b).tolist()) == list(range(len(pairs)))
    other = [p for p in ((5, 9), (0, 4), (-1, 7)) if p not in pairs]
    assert (table.slot(*(np.array(x, np.int64) for x in zip(*other))) == -1).all()


def test_values_without_a_node_are_an_error(spark):
    rows = pa.table({"conv": [1], "part": [0], "i": [0], "d1": [0], "d2": [0], "size": [0], "end": [True], "mine": [True]})
    values = pa.table({"conv": [1], "part": [0], "d1": [5], "d2": [5], "v": [1], "leaf": [1], "later": [False]})
    with pytest.raises(ValueError, match="missing"):
        prefixtrie._shares(rows, values)


def test_new_queries_have_sql():
    assert {n for n in queries.ORACLES if n.startswith(("op11", "op12", "op13"))} == {"op11_run_index", "op12_time_forward_manifest", "op13_prefix_slots"}
