"""Ranked search, SimHash near-duplicates and the prefix trie against brute force and their SQL, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from modalens.llm import prefix_trie, queries, search, simhash

LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [(1, "Alpha beta, ALPHA gamma-delta"), (2, "beta beta_gamma é été É 漢字"), (3, None), (4, ""), (5, " \t. "), (6, "alpha beta, alpha gamma-delta"), (7, "w" * 100 + " " + "long " * 30000 + "alpha"), (7, "gamma"), (None, "alpha alpha alpha")]
CLASH = "doc_id long, text string, id string, score int, term string, terms int, n int, rank int, fp string, node int, conv string, rows int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "t", 2, 3, 4, "f", 5, "c", 6) for i, t in rows], CLASH).repartition(3)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c and i is not None]
    n, length, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n // length
            s = sum(u * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, u in Counter(terms(text)).items() if c[t])
            scored += [(-s, i)] if s else []
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ITEMS = [(1, "alpha gamma"), (2, None), (3, ""), (4, "unknown"), (5, "ÉTÉ été 漢字 beta beta"), (6, "long " * 40 + "alpha")]


@pytest.mark.parametrize("tile", [(128, 4096, 512), (2, 3, 2)])
def test_search_equals_brute_force(spark, monkeypatch, tile):
    for name, n in zip(("TILE_ITEMS", "TILE_TERMS", "TILE_DOCS"), tile, strict=True):
        monkeypatch.setattr(search, name, n)
    monkeypatch.setattr(search, "BLOCK_ROWS", 1 << 18 if tile[0] > 2 else 3)
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, term string")
    for rows in (ODD, real + ODD, [(i, "alpha") for i in range(30, 0, -1)]):
        got = search.search(table(spark, rows), items)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute_search(rows, ITEMS)
    assert search.search(table(spark, ODD).limit(0), items).count() == search.search(table(spark, ODD), items.limit(0)).count() == 0


def test_products_stay_exact_under_huge_weights():
    rng = np.random.default_rng(3)
    item, term = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 1, 3])
    weight = np.array([search.LIMIT * 3 + 1, search.LIMIT - 1, 5, 7, search.LIMIT])
    dense = rng.integers(0, search.IMPACT, (6, 4))
    total = np.zeros((6, 2), np.int64)
    for names, parts in search.tiles(item, term, weight):
        for cut, w in parts:
            assert w.sum(axis=0).max() < search.LIMIT
            total[:, names] += (dense[:, cut].astype(float) @ w).astype(np.int64)
    want = np.zeros((4, 2), object)
    for i, t, w in zip(item, term, weight, strict=True):
        want[t, i] = int(w)
    assert (total == (dense.astype(object) @ want)).all()


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_labels(fps, radius=2):
    """The first of each fingerprint's component, by number."""
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    while True:
        new = np.where(near, label[None], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("sizes", [(4096, 512, 32), (24, 6, 2)])
def test_simhash_equals_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("SHARD", "BLOCK", "LEAST"), sizes, strict=True):
        monkeypatch.setattr(simhash, name, n)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    words = random.Random(1).choices([f"w{i}" for i in range(300)], k=400)
    edits = [(100 + i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(0, 400, 3)]  # many are within two bits of each other
    rows = [(i, t) for i, t in ODD if i != 7] + edits + [(900 + i, f"{i} short text") for i in range(40)] + [(2000, " ".join(words)), (2001, " ".join(words).upper())]
    kept = sorted((i, fingerprint(t)) for i, t in rows if i is not None)
    label = brute_labels(np.array([f for _, f in kept], np.uint64))
    want = {i: (f"{f:016x}", kept[k][0]) for (i, f), k in zip(kept, label, strict=True)}
    got = simhash.simhash_duplicates(table(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want and len(got) == len(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert len({c for _, c in want.values()}) < len({f for f, _ in want.values()})
    assert simhash.simhash_duplicates(table(spark, rows).limit(0)).count() == 0


def test_vantage_point_trees_lose_no_pair(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SHARD", 64)
    rng = np.random.default_rng(9)
    spread = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (600, 2)).astype(np.uint64)
    dense = np.arange(512, dtype=np.uint64)  # a cube: neighbours everywhere, few distances
    for fps in (np.unique(np.concatenate([spread, spread[:600] ^ flips[:, 0] ^ flips[:, 1]])), dense, spread[:1], spread[:0]):
        tree = simhash.Tree(fps[::2], 2.0, 2)
        at, shard = tree.routed(fps)
        homes = defaultdict(set)
        for r, s in zip(at.tolist(), shard.tolist(), strict=True):
            homes[r].add(s)
        for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2), strict=True):
            assert homes[i] & homes[j]
        root = list(range(len(fps)))

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in simhash.linked(fps, 2):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = top(x), top(y)
                root[max(x, y)] = min(x, y)
        if len(fps):
            assert [top(i) for i in range(len(fps))] == brute_labels(fps).tolist()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    if not built:
        return []
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def trie_rows(spark, rows):
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, n int").repartition(3)
    out = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(t)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


TURNS = [(0, 1, "user", "hello there"), (0, None, None, "first of all"), (0, 2, "bot", None), (1, 1, "user", "hello there"), (1, 1, "user", "a tie"), (2, 5, "user", ""), (2, 6, "", "x y z"), (None, 1, "user", "no one's"), (23, 1, "user", "no base"), (23, 2, "user", "more"), (-5, 1, "user", "hello there"), (40, 1, "u", "a b"), (40, 1, "u", "a b")]


@pytest.mark.parametrize("block", [1, 4])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "ID_RANGE", 2)
    monkeypatch.setattr(prefix_trie.prefix_trie, "__defaults__", (block,))
    rng = random.Random(4)
    shared = [(c, t, "user", rng.choice(["yes", "no"])) for c in range(60, 110) for t in range(rng.randint(0, 9))]
    long = [(c, t, "user", f"turn {t} of a long one") for c in (200, 201, 205) for t in range(150 + c)]
    for rows in (TURNS, TURNS + shared, shared + long, [(c, 1, "user", "the same") for c in range(100)]):
        assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_blocks_without_siblings_are_not_refined(spark):
    rows = spark.createDataFrame([(c, [f"d{i}" for i in range(9)] + [f"end{c}"], [1] * 10) for c in range(3)], "conv long, digests array<string>, words array<int>")
    found = prefix_trie.turns_of(prefix_trie.blocks_of(prefix_trie.with_blocks(rows, 4), 4)).groupBy(F.contains("node", F.lit("-")).alias("plain"), "depth").agg(F.countDistinct("node").alias("n")).collect()
    assert {(r.plain, r.depth): r.n for r in found} == {(d % 4 > 0 and d <= 8, d): 3 if d == 10 else 1 for d in range(1, 11)}


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    spark.createDataFrame([r for r in ODD if r[0] is not None][:6], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    as_rows = lambda d: sorted(tuple(str(-1 if pd.isna(x) else int(x) if not isinstance(x, str) else x) for x in r) for r in d.itertuples(index=False))
    assert as_rows(got) == as_rows(want) and len(want)
