"""Near duplicates, of vectors and of texts, against all pairs."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from palimpsest.llm import embedding, graph, simhash
from palimpsest.llm.common import text_bytes


def groups(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("n,m,seed", [(1, 0, 0), (40, 30, 1), (200, 160, 2), (60, 400, 3)])
def test_components(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(0, n // 3)]
    rows = spark.createDataFrame(pairs + [(None, 1), (2, 2)], "a long, b long")
    got = {r.id: r.component for r in graph.components(rows).collect()}
    want = groups(n, pairs)
    assert got == {x: want[x] for x in {y for a, b in pairs if a != b for y in (a, b)}}


def expected(rows, cosine=0.98):
    """Links and least reachable id of (id, vector, label) rows, from all pairs."""
    ok = [v is not None and len(v) > 0 and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v, lab in rows]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    pairs.append((b, a))
    links = np.zeros(len(rows), int)
    for a, b in pairs:
        links[[a, b]] += 1
    root = groups(len(rows), pairs)
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    return sorted((rows[k][0], int(links[k]), least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))


def clustered(seed, n=400, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c, size = rng.standard_normal(dim), int(rng.choice([1, 1, 1, 2, 5, 60]))
        for _ in range(size):
            v = c + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.1, 0.14])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if size < 60 else 1))
    return rows


@pytest.mark.parametrize("seed,crowd", [(1, 1500), (2, 7)])
def test_vectors_against_all_pairs(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(embedding, "CROWD", crowd)
    rows = clustered(seed)
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embedding.op3_embedding_dedup(table).collect())
    want = expected(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    if sum(g[1] for g in got) == sum(w[1] for w in want):
        assert got == want


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(0, v, 1), (1, v, 1), (2, [2 * x for x in v], 1), (3, None, 1), (4, [], 1), (5, [0.0] * 5, 1), (6, [*v[:4], None], 1), (7, [*v[:4], nan], 1), (8, [*v[:4], inf], 1), (9, v, None), (10, v, 2), (11, [1.0], 1), (12, [3.0], 1), (13, [1e-200] * 5, 1), (14, [1e200] * 5, 1), (15, [-0.0, 1.0, 0.0, 0.0, 0.0], 1), (16, [0.0, 1.0, 0.0, 0.0, 0.0], 1), (20, v, 1), (20, v, 1)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, id int")
    clean = [(i, [x * 1e200 if i == 13 else x / 1e200 if i == 14 else x for x in e] if i in (13, 14) else e, lab) for i, e, lab in rows]
    assert sorted(tuple(r) for r in embedding.op3_embedding_dedup(table).collect()) == expected(clean)
    assert embedding.op3_embedding_dedup(table.limit(0)).count() == 0


def test_vector_sql_on_links():
    rows = clustered(5, 120)
    embeddings = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": [r[2] for r in rows]})  # noqa: F841
    assert sorted(duckdb.sql(embedding.ORACLE).fetchall()) == expected(rows)


def test_filters_are_decoded_in_full():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = embedding.Codes(64, 500)
    rows, found = made.decode(x)
    w = made.words
    for k in range(20):
        turned = x[k] @ made.turn
        parts = [turned[a:b] @ book.T for (a, b), book in zip(zip(made.cuts, made.cuts[1:]), made.books)]
        score = (parts[0][:, None, None, None] + parts[1][:, None, None] + parts[2][:, None] + parts[3]).ravel()
        assert len(score) == w**4
        mine = found[rows == k]
        assert len(set(mine.tolist())) == len(mine) >= embedding.LEAST
        # the filters are those with the highest scores, at one threshold
        assert score[mine].min() > np.delete(score, mine).max()


def make_docs(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    while len(rows) < n:
        words = [word() for _ in range(rng.randint(5, 200))]
        for _ in range(rng.choice([1, 1, 1, 2, 4, 25])):
            copy = [w if rng.random() > 0.04 else word() for w in words] if rng.random() < 0.8 else words
            rows.append((len(rows), " ".join(copy) if rng.random() < 0.9 else " ".join(copy).upper()))
    return rows


def text_links(rows):
    code, some = simhash.codes(*text_bytes(pa.array([t for _, t in rows], pa.string())))
    near = (simhash.distances(code, code) <= simhash.RADIUS) & some[:, None] & some
    np.fill_diagonal(near, False)
    root = groups(len(rows), zip(*np.nonzero(near)))
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    return sorted((rows[k][0], int(near[k].sum()), least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))


@pytest.mark.parametrize("search", ["scan", "graph"])
@pytest.mark.parametrize("shard", [4096, 40])
def test_texts_against_all_pairs(spark, monkeypatch, search, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rows = make_docs(7)
    random.Random(1).shuffle(rows)
    got = sorted(tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), search=search).collect())
    want = text_links(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= (1 if shard == 4096 else 0.98) * sum(w[1] for w in want)


def test_text_edges(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].n_links == by[6].n_links == 2 and by[6].class_id == 5 and not by[6].kept
    assert all(by[i].n_links == 0 and by[i].kept for i in (0, 1, 2, 3, 17))
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    names = lambda found: sorted((r.doc_id for r in found), key=lambda i: (i is None, i))
    assert kept.columns == odd_docs.columns and names(kept.select("doc_id").collect()) == names(r for r in got if r.kept)
    assert simhash.keep_one(no_docs).count() == 0


def test_equal_and_null_ids_are_told_apart(spark):
    """One row of each class stays, whatever the ids: as multisets of whole rows."""
    rng = random.Random(11)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(4))
    near = b + " x"
    rows = [(1, a), (2, a), (2, b), (3, near), (7, c), (7, c), (None, d), (None, d), (None, a), (9, None), (9, None), (None, ""), (12, a.upper())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(table).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (7, c), (None, d), (9, None), (9, None), (None, "")], key=str)
    found = simhash.near_duplicates(table).collect()
    by = sorted(((r.doc_id, r.n_links, r.class_id, r.kept) for r in found), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 1, 2, True), (3, 1, 2, False), (7, 1, 7, True), (7, 1, 7, False), (None, 1, None, True), (None, 1, None, False), (None, 3, 1, False), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, True), (12, 3, 1, False)]
    assert by == sorted(want, key=str)
    # rows that differ in other columns only: one of them, in one piece
    other = spark.createDataFrame([(5, a, "u"), (5, a, "v"), (4, b, "w")], "doc_id long, text string, row string")
    assert sorted((r.doc_id, r.row in ("u", "v")) for r in simhash.keep_one(other).collect()) == [(4, False), (5, True)]


def test_hot_keys_join_in_full(spark, monkeypatch):
    """A key of half of the rows, null keys, and keys on both sides of the bound."""
    from palimpsest.llm import common

    rows = spark.createDataFrame([(k, 0 if k % 2 else k % 50 if k % 3 else None) for k in range(2000)], "row long, key long")
    facts = rows.where("key is not null").groupBy("key").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    for share in (0.0, 0.01, 2.0):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        monkeypatch.setattr(common, "HOT_ROWS", 0)
        got = common.spread_join(rows, facts, "key", "n", 2000).collect()
        assert sorted(r.row for r in got) == [k for k in range(2000) if k % 2 or k % 3]
        assert all(r.n == sum(g.key == r.key for g in got) for r in got[::97])


@pytest.mark.parametrize("hot", [0.01, 2.0])
def test_components_of_a_hub(spark, monkeypatch, hot):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", hot)
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    pairs = [(5, 10 + k) for k in range(3000)] + [(10 + k, 11 + k) for k in range(0, 3000, 7)] + [(4000, 4001)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 5 for p in pairs[:-1] for k in p}, 4000: 4000, 4001: 4000}


def test_small_world_finds_clusters():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, (40, 4), np.uint64)
    points = np.repeat(centres, 20, axis=0)
    flips = rng.random((800, 256)) < 0.04
    points = points ^ np.packbits(flips, axis=1).view(np.uint64).reshape(800, 4)
    world = simhash.SmallWorld(points)
    ids, dist = world.search(points, 32)
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() for r in ids)
    exact = (simhash.distances(points, points) <= simhash.RADIUS).sum()
    assert (dist <= simhash.RADIUS).sum() >= 0.8 * exact
    a, b = simhash.graph_pairs(points, np.zeros(800, int), simhash.RADIUS)
    assert 2 * len(a) + 800 >= 0.995 * exact


def test_small_world_of_whole_texts(monkeypatch):
    """Over 4,096 codes of real texts: the graph is searched, and finds its share."""
    import pyarrow.parquet as pq

    from palimpsest.llm.common import slices

    text = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).combine_chunks()
    made = [simhash.codes(*text_bytes(text.slice(a, b - a))) for a, b in slices(text)]
    x = np.unique(np.concatenate([c[s] for c, s in made]), axis=0)[:6000]
    x = x[np.random.default_rng(0).permutation(len(x))]
    none = np.zeros(len(x), int)
    want = set(zip(*(c.tolist() for c in simhash.scan_pairs(x, none, simhash.RADIUS))))
    monkeypatch.setattr(simhash, "scan_pairs", lambda *a: pytest.fail("no graph was searched"))
    got = set(zip(*(c.tolist() for c in simhash.graph_pairs(x, none, simhash.RADIUS, simhash.RECALL))))
    assert len(want) > 100 and got <= {(min(p), max(p)) for p in want} and len(got) >= 0.85 * len(want)


def test_codes_of_odd_texts():
    code, some = simhash.codes(*text_bytes(pa.array(["!!! ???", "??? !!!", "a b", "A, b!", None, "", " \n", "x"])))
    assert some.tolist() == [True] * 4 + [False] * 3 + [True]
    assert (code[0] == code[1]).all() and (code[2] == code[3]).all() and (code[0] != code[2]).any()
    alone, _ = simhash.codes(*text_bytes(pa.array(["x"])))
    assert (alone[0] == code[7]).all()


def test_samples_reach_close_pairs():
    rng = np.random.default_rng(0)
    masks = simhash.samples(500_000)
    x = rng.integers(0, 2**63, (4000, 4), np.uint64)
    y = x ^ np.packbits(rng.random((4000, 256)) < 0.12, axis=1).view(np.uint64).reshape(-1, 4)
    met = np.zeros(4000, bool)
    for m in masks:
        met |= (((x ^ y) & m) == 0).all(1)
    assert met.mean() > 0.998


@pytest.mark.parametrize("nodes", [9_293, 200_000, 500_000, 14_000_000, 1_000_000_000])
def test_pairs_at_the_radius_all_meet(nodes):
    rng = np.random.default_rng(nodes)
    unlike = rng.random((20_000, 256)).argsort(1) < simhash.RADIUS
    unlike = np.packbits(unlike, axis=1).view(np.uint64).reshape(-1, 4)
    met = np.zeros(len(unlike), bool)
    for m in simhash.samples(nodes):
        met |= ((unlike & m) == 0).all(1)
    assert met.all()


@pytest.mark.parametrize("sent,masks", [(1.0, 1), (1e-12, 100)])
def test_no_link_at_the_radius_is_lost(spark, monkeypatch, sent, masks):
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "SENT", sent)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, (1000, 4), np.uint64)
    y = x ^ np.packbits(rng.random((1000, 256)).argsort(1) < simhash.RADIUS, axis=1).view(np.uint64).reshape(-1, 4)
    z = x[:200] ^ np.packbits(rng.random((200, 256)).argsort(1) < simhash.RADIUS + 1, axis=1).view(np.uint64).reshape(-1, 4)
    code = np.concatenate([x, y, z])
    assert masks == 1 and len(simhash.samples(len(code))) == 1 or len(simhash.samples(len(code))) >= masks
    table = spark.createDataFrame([(k, c.tobytes()) for k, c in enumerate(code)], "doc_id long, code binary")
    monkeypatch.setattr(simhash, "code_table", lambda docs: table)
    got = {r.doc_id: (r.n_links, r.class_id) for r in simhash.near_duplicates(table).collect()}
    near = simhash.distances(code, code) <= simhash.RADIUS
    assert near[np.arange(1000), np.arange(1000, 2000)].all() and not near[np.arange(200), np.arange(2000, 2200)].any()
    root = groups(len(code), zip(*np.nonzero(near)))
    assert got == {k: (int(near[k].sum()) - 1, root[k]) for k in range(len(code))}


def near_codes(seed, n):
    """Codes with copies within the radius of each other, and a crowd of close ones."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, (n, 4), np.uint64)
    y = x[: n // 4] ^ np.packbits(rng.random((n // 4, 256)).argsort(1) < rng.integers(1, 50, n // 4)[:, None], axis=1).view(np.uint64).reshape(-1, 4)
    z = x[:1] ^ np.packbits(rng.random((n // 20, 256)) < 0.08, axis=1).view(np.uint64).reshape(-1, 4)
    return rng.permutation(np.concatenate([x, y, z]))


@pytest.mark.parametrize("parts,radius", [(24, 46), (16, 46), (12, 46), (10, 46), (8, 46), (7, 46), (12, 5), (7, 0)])
def test_pairs_of_masks_are_all_pairs_once(monkeypatch, parts, radius):
    monkeypatch.setattr(simhash, "CROWD", 20)
    x = near_codes(parts, 2000)
    masks = simhash.cover_parts(parts, radius)
    for side in (np.zeros(len(x), int), np.random.default_rng(1).integers(1, 3, len(x))):
        want = sorted((min(p), max(p)) for p in zip(*(c.tolist() for c in simhash.scan_pairs(x, side, radius))))
        got = [(min(p), max(p)) for share in range(3) for a, b in simhash.block_pairs(x, side, masks, radius, share, 3, 500) for p in zip(a.tolist(), b.tolist())]
        assert sorted(got) == want and (radius < 46 or len(want) > 1000)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_at_the_radius_meet_under_each_cover(seed):
    rng = np.random.default_rng(seed)
    for parts in (24, 16, 12, 10, 8, 7):
        for radius in (46, 45, 40):
            # as even over the parts as it can be, the worst case, and at random
            spread = np.concatenate([rng.permutation(bits)[: radius // parts + 1] for bits in np.array_split(np.arange(256), parts)])
            unlike = np.zeros((2000, 256), bool)
            for row in unlike[:1000]:
                row[rng.permutation(spread)[:radius]] = True
            unlike[1000:] = rng.random((1000, 256)).argsort(1) < radius
            unlike = np.packbits(unlike, axis=1).view(np.uint64).reshape(-1, 4)
            met = np.zeros(len(unlike), bool)
            for m in simhash.cover(parts, radius):
                met |= ((unlike & m) == 0).all(1)
            assert met.all()


@pytest.mark.parametrize("sort,tasks", [(1e-12, 20_000), (1e-12, 5), (1.0, 20_000)])
def test_links_of_many_blocks(spark, monkeypatch, sort, tasks):
    """Many blocks, with masks and without, several tasks to a partition; against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 700)
    monkeypatch.setattr(simhash, "SHARD", 200)
    monkeypatch.setattr(simhash, "SORTED", sort)
    monkeypatch.setattr(simhash, "TASKS", tasks)
    code = near_codes(3, 2000)
    assert (len(simhash.block_masks(code, 700)) > 1) == (sort < 1)
    table = spark.createDataFrame([(k, c.tobytes()) for k, c in enumerate(code)], "doc_id long, code binary")
    monkeypatch.setattr(simhash, "code_table", lambda docs: table)
    got = {r.doc_id: (r.n_links, r.class_id) for r in simhash.near_duplicates(table).collect()}
    near = simhash.distances(code, code) <= simhash.RADIUS
    root = groups(len(code), zip(*np.nonzero(near)))
    assert got == {k: (int(near[k].sum()) - 1, root[k]) for k in range(len(code))}


def test_masks_compare_few_pairs_of_large_tables():
    """At 6 GB a scan of all pairs, or a copy of each node for each mask, ran out of time."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, (100_000, 4), np.uint64)
    for nodes in (250_000, 2_800_000):
        masks = simhash.block_masks(x[:20_000], min(nodes, simhash.BLOCK))
        pairs = [(c * (c - 1.0)).sum() for m in np.concatenate(masks) for c in [np.bincount(simhash._buckets(x.T, m), minlength=1 << 16)]]
        assert sum(pairs) < 0.04 * len(x) ** 2
    # codes of which a third lie close together meet under most masks: these don't pay
    x[:30_000] = x[:1] ^ np.packbits(rng.random((30_000, 256)) < 0.02, axis=1).view(np.uint64).reshape(-1, 4)
    assert len(simhash.block_masks(x[::5], simhash.BLOCK)) == 1


def test_codes_are_signs_of_sums_of_bits():
    """Word by word, around the 255 rows that a byte can sum, in texts that share a batch."""
    from palimpsest.llm.words import hash_word, mix

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) for n in (1, 2, 254, 255, 256, 0, 510, 511, 766, 21_000, 3)] + ["a b a b a c", None]
    code, some = simhash.codes(*text_bytes(pa.array(texts, pa.string())))
    for text, own, has in zip(texts, code, some):
        words = sorted({hash_word(w) for w in (text or "").split()})
        assert has == bool(words)
        if words:
            h = np.unique(np.array(words, np.uint64) >> np.uint64(24))
            bits = np.unpackbits(mix(mix(h)[:, None] ^ simhash._SEEDS).view(np.uint8), axis=1)
            assert own.tobytes() == np.packbits(2 * bits.sum(0, dtype=int) > len(h)).tobytes()


def test_codes_take_little_time():
    """Less than summing bits a byte at a time, which took most of near_duplicates' time."""
    import time

    text = " ".join(f"w{k}" for k in range(200_000))
    parts = pa.array([text[k : k + 4000] for k in range(0, len(text), 4000)], pa.string())
    words = [w for t in parts.to_pylist() for w in set(t.split())]
    bits = np.unpackbits(np.random.default_rng(0).integers(0, 256, (20_000, 32), np.uint8), axis=1)
    began = time.process_time()
    np.add.reduceat(bits, np.arange(0, 20_000, 400), axis=0, dtype=np.int32)
    bytewise = (time.process_time() - began) * len(words) / 20_000
    began = time.process_time()
    simhash.codes(*text_bytes(parts))
    assert time.process_time() - began < bytewise
