"""Small literal cases, invariants and plans."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import codes, snippets, text
from palimpsest.functions.paths import DirFilter, normalise, relative_to
from palimpsest.operators import chunking, indexing, layers, search, snapshot
from palimpsest.streaming import ingest


def plan(df):
    return df._jdf.queryExecution().toString()


# -- codes


def test_quantise(spark):
    v = [1.0, -0.5, 0.1, 0.0, 0.01, -1.0, 0.5, -0.1] + [0.0] * 56
    rows = spark.createDataFrame([(0, v), (1, [1.0] * 64), (2, [-1.0] * 64), (3, [float("nan")] * 64), (4, [1.0] * 100), (5, None)], "i int, v array<float>")
    got = {r.i: r.c for r in rows.select("i", codes.spell(codes.quantise("v", 64)).alias("c")).collect()}
    assert got == {0: "AA" + "0" * 14, 1: "F" * 16, 2: "0" * 16, 3: "0" * 16, 4: None, 5: None}
    with pytest.raises(ValueError):
        codes.quantise("v", 100)
    wide = rows.where("i = 1").select(codes.quantise(F.concat("v", "v"), 128).alias("c")).head().c
    assert list(wide) == [-1, -1]


def test_hamming_agrees_in_both_forms(spark):
    rng = random.Random(0)
    rows = [(rng.getrandbits(63), rng.getrandbits(63) - 2**62) for _ in range(50)]
    df = spark.createDataFrame([([a, b],) for a, b in rows], "code array<long>")
    q = [5, -7]
    got = df.select("code", codes.hamming_to(F.col("code"), q).alias("x"), codes.hamming(F.col("code"), F.array(*(F.lit(w).cast("long") for w in q))).alias("y"), codes.popcount(F.col("code")).alias("p")).collect()
    m = (1 << 64) - 1
    for r in got:
        assert r.x == r.y == sum(((a ^ b) & m).bit_count() for a, b in zip(r.code, q))
        assert r.p == sum((a & m).bit_count() for a in r.code)


def test_topk_skips_unfilled_slots_and_is_planned_as_one_cut(spark):
    df = spark.createDataFrame([(0, [0]), (1, [1]), (2, [3]), (3, None), (4, [1])], "vec_id long, code array<long>")
    top = search.topk(df, [0], 3)
    assert [(r.vec_id, r.dist) for r in top.collect()] == [(1, 1), (4, 1), (2, 2)]
    assert "TakeOrderedAndProject" in plan(top)


def test_per_layer_cut_comes_before_filters(spark):
    chunks = spark.createDataFrame([("b", 0, p, 0, [p + 1]) for p in range(4)] + [("a", 1, p, 0, [1]) for p in range(3)], "commit string, seq long, pos long, chunk_index int, code array<long>")
    listing = spark.createDataFrame([("b", p, f"x/{p}") for p in range(4)] + [("a", p, f"x/{p}") for p in range(2)] + [("a", 2, "y/2")], "commit string, pos long, path string")
    changes = spark.createDataFrame([("x/0", 0), ("x/1", 1)], "path string, seq long")
    hits = search.topk_per_layer(chunks, [0], 2)
    assert "WindowGroupLimit" in plan(hits) and "CartesianProduct" not in plan(hits)
    post = search.chain_search(chunks, listing, changes, [0], 2, 10, DirFilter.of(["x"], []))
    assert [(r.commit, r.path, r.dist) for r in post.collect()] == [("b", "x/0", 1), ("b", "x/1", 1), ("a", "x/1", 1)]
    pre = search.chain_search(chunks, listing, changes, [0], 2, 10, DirFilter.of(["y"], []), "pre")
    assert [(r.commit, r.path) for r in pre.collect()] == [("a", "y/2")]
    assert search.chain_search(chunks, listing, changes, [0], 2, 10, DirFilter.of(["y"], [])).count() == 0
    assert "LeftAnti" in plan(post)


def test_search_table_has_a_bound(spark):
    many = spark.range(10_001).select(F.col("id").alias("query_id"), F.array("id").alias("query"))
    with pytest.raises(ValueError):
        search.search_table(many, many, 1)


def test_search_blocks_takes_any_number_of_queries(spark):
    codes = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id")).alias("code"))
    asked = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.col("id") % 40).alias("query"))
    got = search.search_blocks(asked, codes, 1).select("query_id", "vec_id", "dist", "rank").collect()
    # code 0 is unfilled: its queries find the least code that is one bit away
    assert sorted(tuple(r) for r in got) == [(k, k % 40 or 1, int(k % 40 == 0), 1) for k in range(10_001)]
    few = asked.where("query_id < 100")
    key = lambda t: sorted(tuple(r) for r in t.select("query_id", "vec_id", "dist", "rank").collect())
    assert key(search.search_blocks(few, codes, 3, 30)) == key(search.search_table(few, codes, 3))


@pytest.mark.parametrize("width", [1, 3])
def test_search_table_is_exact_with_ties_and_never_sorts_all_pairs(spark, monkeypatch, width):
    rng = random.Random(width)
    monkeypatch.setattr(search, "TILE", 3000, raising=False)
    # few set bits, so that most distances tie; ids in no order, one code unfilled
    code = lambda: [rng.getrandbits(64) & rng.getrandbits(64) & 0xFFF0000000000000 | 1 for _ in range(width)]
    signed = lambda c: [w - (w >> 63 << 64) for w in c]
    rows = [(f"v{rng.random()}", code()) for _ in range(2500)]
    asked = [(q, code()) for q in range(40)] + [(40, None)]
    vectors = spark.createDataFrame([(v, signed(c)) for v, c in rows] + [("u", [0] * width), ("w", None)], "vec_id string, code array<long>").repartition(3)
    queries = spark.createDataFrame([(q, c and signed(c)) for q, c in asked], "query_id long, query array<long>")
    want = []
    for q, c in asked:
        near = sorted((sum((x ^ y).bit_count() for x, y in zip(c, v)) if c else 0, name) for name, v in rows)[:7]
        want += [(q, name, d if c else None, k + 1) for k, (d, name) in enumerate(near)]
    for found in (search.search_table(queries, vectors, 7), search.search_blocks(queries, vectors, 7, 20)):
        assert sorted(map(tuple, found.select("query_id", "vec_id", "dist", "rank").collect()), key=lambda r: (r[0], r[3])) == want
        assert "NestedLoopJoin" not in plan(found) and "CartesianProduct" not in plan(found)
    assert search.search_table(queries, vectors.limit(0), 7).count() == 0 and search.search_table(queries.limit(0), vectors, 7).count() == 0
    assert search.search_table(queries, vectors, 9999).count() == 41 * 2500


# -- paths


def test_dir_filter(spark):
    paths = spark.createDataFrame([("src/app/a",), ("src/apple",), ("src/app",), ("src/app/x/b",), ("c",)], "path string")
    take = lambda f: {r.path for r in paths.where(f.column(F.col("path"))).collect()}
    assert take(DirFilter.of(["src/app"], [])) == {"src/app/a", "src/app", "src/app/x/b"}
    assert take(DirFilter.of(["src/app"], ["src/app/x"])) == {"src/app/a", "src/app"}
    assert take(DirFilter.of(["/src/app/"], [], "/", "/")) == {"src/app/a", "src/app", "src/app/x/b"}
    assert take(DirFilter.of([".", ""], [])) == take(DirFilter()) and len(take(DirFilter())) == 5
    assert take(DirFilter.of(["/etc"], [], "/home/me/proj", "/home/me/proj")) == set()


def test_relative_directories():
    root, cwd = "/home/me/proj", "/home/me/proj/src"
    assert relative_to("../docs", root, cwd) == "docs"
    assert relative_to("app", root, cwd) == "src/app"
    assert relative_to("/home/me/proj/x/./y", root, cwd) == "x/y"
    assert relative_to("/etc/passwd", root, cwd) is None
    assert relative_to("docs", root, "/tmp") == "docs"
    assert relative_to("/home/me/project", root, cwd) is None
    assert normalise("/src/search/") == "src/search" and normalise(".") is None and normalise("") is None


# -- snapshots


def test_positions_are_ranks_by_bytes(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abZ/é_") for _ in range(6)) for _ in range(300)}, key=str.encode)
    rows = [(c, p) for c in ("c1", "c2") for p in (names if c == "c1" else names[::3])]
    rng.shuffle(rows)
    got = {(r.commit, r.path): r.pos for r in snapshot.positions(spark.createDataFrame(rows, "commit string, path string")).collect()}
    assert got == {("c1", p): k for k, p in enumerate(names)} | {("c2", p): k for k, p in enumerate(names[::3])}
    assert snapshot.positions(spark.createDataFrame([], "commit string, path string")).count() == 0


def test_text_files(spark):
    rows = spark.createDataFrame([(0, "a"), (1, ""), (2, None), (3, "a\0b"), (4, "é" * 4096 + "\0"), (5, "é" * 4095 + "x\0")], "i int, text string")
    assert {r.i for r in snapshot.text_files(rows).collect()} == {0, 4}


def test_tree_diff_with_nulls(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "x")], "path string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "x")], "path string, text string")
    assert sorted(map(tuple, snapshot.tree_diff(old, new).collect())) == [("b", "changed"), ("d", "deleted"), ("e", "changed")]


# -- snippets


@pytest.mark.parametrize("body,first,want", [("a\nb\nc\n", 98, " 98 | a\n 99 | b\n100 | c\n"), ("", 1, "1 | "), ("x", 9, "9 | x"), ("a\n\nb", 9, " 9 | a\n10 | \n11 | b"), ("\n", 1, "1 | \n")])
def test_numbered(spark, body, first, want):
    df = spark.createDataFrame([(body, first)], "t string, n int")
    assert df.select(snippets.numbered(F.col("t"), F.col("n")).alias("x")).head().x == want


def test_start_line(spark):
    df = spark.createDataFrame([(o,) for o in (0, 5, 6, 12, 99)], "o int").withColumn("c", F.lit("line1\nline2\nline3\n").cast("binary"))
    assert [r.x for r in df.orderBy("o").select(snippets.start_line(F.col("c"), F.col("o")).alias("x")).collect()] == [1, 1, 2, 3, 4]


def test_staleness_and_slices(spark):
    rows = [("bbb", 3, "aaabbbccc", "current"), ("bbb", 3, "XXXaaabbbccc", "moved"), ("bbb", 3, "zzz", "modified"), ("bbb", 3, None, "missing"), ("é", 1, "xé", "current")]
    df = spark.createDataFrame(rows, "chunk string, o int, disk string, want string")
    got = df.select("want", snippets.staleness(F.col("chunk").cast("binary"), F.col("o"), F.col("disk").cast("binary")).alias("x")).collect()
    assert all(r.want == r.x for r in got)
    cut = df.limit(1).select(*(snippets.as_text(snippets.byte_slice(F.lit("aé").cast("binary"), F.lit(a), F.lit(n))).alias(f"c{k}") for k, (a, n) in enumerate([(0, 3), (1, 9), (5, 2), (0, 2)]))).head()
    assert list(cut)[:3] == ["aé", "é", ""] and cut.c3 == "a�"


def test_format_bytes(spark):
    df = spark.createDataFrame([(5,), (1023,), (1536,), (5 << 20,), (5 << 30,)], "n long")
    assert [r.x for r in df.select(snippets.format_bytes(F.col("n")).alias("x")).collect()] == ["5 B", "1023 B", "1.5 KB", "5.0 MB", "5120.0 MB"]


# -- chunks


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \t\n\r1.é"), max_size=400), st.integers(1, 40))
def test_line_chunks_cover_the_file(body, budget):
    data = body.encode()
    at = 0
    ends = {0, len(data), *(k + 1 for k, b in enumerate(data) if b == 10)}
    for offset, n in chunking.chunk_lines(data, budget):
        assert offset == at and n > 0 and offset in ends
        at += n
    assert at == len(data)


def test_line_chunk_choices():
    assert chunking.chunk_lines(b"") == []
    assert chunking.chunk_lines(b"x" * 4096 + b" y" * 900, 10) == [(0, 5896)]
    prose = b"a b\nc d\n\ne f\ng h\ni j\n"
    assert chunking.chunk_lines(prose, 6)[0] == (0, 9)  # next to the blank line, the later of equals
    assert chunking.chunk_lines(b"x\n" * 100, 10)[0] == (0, 18)  # the line before the one that passes the budget is still open


def test_ranges_and_code():
    # of an overlap the earlier range keeps what it has, the later one the rest
    assert chunking.from_ranges([(2, 5), (4, 6), (8, 9)], 12) == [(0, 5), (5, 3), (8, 4)]
    assert chunking.from_ranges([(2, 5), (3, 4)], 12) == [(0, 12)]
    assert chunking.from_ranges([], 0) == []
    data = b"fn a() {}\nfn b() {}\nfn c() {}\n"
    assert chunking.chunk_code("m.rs", data, 1000) == [(0, len(data))]
    assert chunking.chunk_code("m.rs", data, 7) == [(0, 10), (10, 10), (20, 10)]
    assert chunking.chunk_code("m.rs", data, 7, {}) == chunking.chunk_code("m.txt", data, 7) == chunking.chunk_lines(data, 7)


def test_language(spark):
    df = spark.createDataFrame([("a.rs",), ("src/go",), ("go",), ("x.HH",), ("n",)], "p string")
    assert [r.x for r in df.select(text.language_of(F.col("p")).alias("x")).collect()] == ["rust", None, "go", None, None]


# -- layers


def test_publishing(spark, tmp_path):
    path = f"file://{tmp_path}/layers"
    rows = spark.createDataFrame([(1, 0, [5]), (1, 1, None)], "doc_id long, chunk_index int, code array<long>")
    layers.write_layer(rows, path, "c0")
    layers.write_layer(rows.limit(0), path, "c1")
    layers.write_layer(rows, path, "c0")
    assert spark.read.parquet(path + "/commit=c0").count() == 2
    with pytest.raises(ValueError):
        layers.write_layer(rows.unionAll(rows), path, "c2")
    assert layers.drop_layers(spark, path, ["c0"]) == 1 and layers.drop_layers(spark, path) == 1 and layers.drop_layers(spark, path + "/none") == 0


def test_chain_walks(spark):
    table = spark.createDataFrame([("aaaa", None, 2), ("bbbb", "aaaa", 2), ("cccc", "gone", 2), ("dddd", "bbbb", 1), ("eeee", "dddd", 2)], "commit string, parent string, version int")
    walk = lambda c: [r.commit for r in layers.chain_walk(table, c).orderBy("seq").collect()]
    assert walk("bbbb") == ["bbbb", "aaaa"] and walk("cccc") == ["cccc"] and walk("eeee") == ["eeee"] and walk("zzzz") == []
    assert layers.walk_on_driver({"b": "a", "a": None}, "b") == ["b", "a"] and layers.walk_on_driver({"x": "x"}, "x") == ["x"]


def test_request_batches():
    assert list(indexing.batches([(k, 1) for k in range(300)])) == [list(range(128)), list(range(128, 256)), list(range(256, 300))]
    assert list(indexing.batches([(0, 5), (1, 200), (2, 5), (3, 6)], 10, 10)) == [[0], [1], [2], [3]]
    assert list(indexing.batches([])) == []


def test_streamed_layers(spark, tmp_path):
    rows = spark.createDataFrame([("c0", 1), ("c1", 2), ("c1", 3)], "commit string, doc_id long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.append_layers(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    events = spark.createDataFrame([("2024-01-01 00:00:01", 5), ("2024-01-01 00:00:59", 6), ("2024-01-01 00:01:00", 7)], "ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events"))
    rates = ingest.minute_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.tokens for r in spark.table("rates").collect()) == [7, 11]


def test_rate_window_edges(spark):
    rows = [(0, "2024-01-01 00:00:00", 1), (1, "2024-01-01 00:00:00", 2), (2, "2024-01-01 00:00:59.999999", 4), (3, "2024-01-01 00:01:00", 8), (4, "2024-01-01 00:02:30", 16)]
    df = spark.createDataFrame(rows, "event_id long, ts string, tokens long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r.event_id: r.tokens_60s for r in ingest.rate_window(df).collect()} == {0: 3, 1: 3, 2: 7, 3: 12, 4: 16}
    assert ingest.rate_window(df.limit(0)).count() == 0


def test_scans_read_only_what_is_used(spark):
    from palimpsest import catalog

    text_plan = plan(catalog.QUERIES["token_count"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text_plan


def history(rows):
    """Steps to each ancestor, level by level."""
    def depths(start):
        parents, out, level = {}, {}, {start}
        for commit, parent in rows:
            parents.setdefault(commit, set()).add(parent)
        k = 0
        while level := {c for c in level if c in parents and c not in out}:
            out |= dict.fromkeys(level, k)
            level, k = {p for c in level for p in parents[c]}, k + 1
        return out

    return depths


def names(k):
    return f"it's {k}"


SHAPES = {
    "line": [(names(k), names(k - 1) if k else None) for k in range(10_000)],
    "diamonds": [(names(k), names(k - d)) for k in range(2, 3000) for d in (1, 2)] + [(names(1), names(0)), (names(0), None)],
    "circle": [(names(k), names((k - 1) % 50)) for k in range(50)],
    "gap": [(names(9), names(8)), (names(8), names(7)), (names(6), None)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_ancestors_of_any_depth_and_shape(spark, monkeypatch, shape):
    rows = SHAPES[shape]
    table = spark.createDataFrame(rows, "commit string, parent string")
    start = rows[-3 if shape == "diamonds" else 0 if shape == "gap" else -1][0]
    want = history(rows)(start)
    assert dict(layers.ancestors(table, start).collect()) == want
    assert layers.ancestors(table, "none").count() == 0
    far = max(want, key=lambda c: (want[c], c))
    found = layers.chain_start(table, spark.createDataFrame([(far,), ("none",)], "commit string"), start).collect()
    assert [tuple(r) for r in found] == [(far, want[far])]
    if shape != "line":
        # the way by joins, on the part of the history near the start
        near = [(c, p) for c, p in rows if want.get(c, 99) <= 6]
        monkeypatch.setattr(layers, "DRIVER_ROWS", 0)
        small = spark.createDataFrame(near, "commit string, parent string")
        assert dict(layers.ancestors(small, start).collect()) == history(near)(start)


@pytest.mark.parametrize("shape", SHAPES)
def test_long_histories_take_as_many_jobs_as_short_ones(spark, monkeypatch, shape):
    monkeypatch.setattr(layers, "DRIVER_ROWS", 0)
    # a deep history is cut short, so that a walk that takes a job for each step ends too
    rows = [(c, p) for c, p in SHAPES[shape] if int(c[5:]) < 60] + [(None, names(1)), (names(3), None)]
    start = max((c for c, _ in rows if c), key=lambda c: int(c[5:]))
    table = spark.createDataFrame(rows, "commit string, parent string")
    spark.sparkContext.setJobGroup(f"walk-{shape}", "")
    try:
        found = dict(layers.ancestors(table, start).collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == history([(c, p) for c, p in rows if c])(start)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk-{shape}")) < 40
    root = spark.createDataFrame([("a", None), ("b", None)], "commit string, parent string")
    assert [tuple(r) for r in layers.ancestors(root, "a").collect()] == [("a", 0)] and layers.ancestors(root, "c").count() == 0


def test_boundary_scores():
    assert chunking.blank_lines(b" \n\t\r\nx\n\n") == 3 and chunking.blank_lines(b"") == 0
    gap = lambda s: chunking.boundary_score(b"a;" + s + b"b;", 2, 2 + len(s))
    assert gap(b"\n") == gap(b" ") == gap(b"") == 0 and gap(b"\n\n") == 101 and gap(b"\n \n\n") == 102
    assert chunking.boundary_score(b"abc", 2, 1) == 0


RUST = b"""// head
use a::b;

/* doc */
fn f(x: [u8; 3]) -> i32 {
    let a = "}{"; // c
    if x { y(); } else { z(); }
    g(|v| { v; w; });
}

impl T {
  fn a() {}

  fn b() { 1 }
}
const C: char = '{';
"""


def test_code_is_cut_at_its_items():
    text = lambda path, data, budget: [data[a : a + n] for a, n in chunking.chunk_code(path, data, budget)]
    assert text("a.rs", RUST, 1000) == [RUST]
    parts = text("a.rs", RUST, 60)
    assert [p[:9] for p in parts] == [b"// head\nu", b"/* doc */", b"impl T {\n"] and b"".join(parts) == RUST
    # too large a function is cut at its statements, its head is a part of its own
    small = text("a.rs", RUST, 14)
    assert b"".join(small) == RUST and small[2:7] == [b"fn f(x: [u8; 3]) -> i32 {\n    ", b'let a = "}{"; ', b"// c\n    if x { y(); } ", b"else { z(); }\n    ", b"g(|v| { v; w; });\n}\n\n"]
    python = b"import x\n\n\n@dec(1)\ndef f():\n    a = 1\n    return a\n\n\nclass A:\n    def g(self):\n        return 2\n"
    assert [p[:7] for p in text("m.py", python, 20)] == [b"import ", b"@dec(1)", b"class A"]
    assert chunking.chunk_code("m.py", b"def (:\n  x\n", 3) == chunking.chunk_lines(b"def (:\n  x\n", 3)
    ruby = b"class A\n  def b\n    1\n  end\n\n\n  def c\n    2\n  end\nend\n"
    assert text("a.rb", ruby, 6) == [b"class A\n", b"  def b\n    1\n  end\n\n\n", b"  def c\n    2\n  end\nend\n"]


def test_siblings_gather_and_part_at_the_best_boundary():
    from palimpsest.functions.syntax import Node

    data = b"a a\n\n\nb b\nc c\nd d d d d d d\ne"
    at = [(0, 3), (6, 9), (10, 13), (14, 27), (28, 29)]
    tree = Node(0, len(data), [Node(a, b) for a, b in at])
    cut = lambda budget: chunking.node_ranges(tree, data, budget)
    assert cut(99) == [(0, len(data))]
    assert cut(5) == [(0, 3), (6, 13), (14, 27), (28, 29)]  # by the blank lines first
    assert cut(13) == [(0, 3), (6, 29)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["fn a() {", "}", "{", "(", ")", "x;", "\n", "\n\n", "// c\n", '"', "'", "/*", "*/", "é ", "def f():\n    ", "class A\n", "  end\n", "if x:\n", "return 1\n", "@d\n", "\t"]), max_size=60), st.sampled_from(["rs", "py", "rb", "js", "c"]), st.integers(1, 30))
def test_code_chunks_cover_any_file(parts, ext, budget):
    data = "".join(parts).encode()
    at = 0
    for offset, n in chunking.chunk_code(f"f.{ext}", data, budget):
        assert offset == at and n > 0
        at += n
    assert at == len(data)


def test_requests_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k, "w " * (k % 7 + 1)) for k in range(600)] + [(None, "x y"), (None, None)], "doc_id long, text string")
    got = [sorted(tuple(r) for r in indexing.embed_batches(rows.repartition(n), 16, 40).collect()) for n in (1, 5)]
    assert got[0] == got[1] and sum(r[2] for r in got[0]) == 602 and all(r[2] <= 16 and (r[3] <= 40 or r[2] == 1) for r in got[0])
    assert sum(r[2] for r in got[0] if r[0] < 0) == 2 and indexing.embed_batches(rows.limit(0)).count() == 0


def test_rate_limiter_by_a_made_clock():
    clock = [0.0]
    passed = []
    limiter = indexing.RateLimiter(10, 60, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    rng = random.Random(2)
    for _ in range(200):
        clock[0] += rng.random() * 9
        n = rng.choice([1, 2, 5, 10, 25])
        limiter.take(n)
        passed.append((clock[0], n))
    for t, _ in passed:
        window = [n for s, n in passed if t - 60 + 1e-6 < s <= t]
        assert sum(window) <= 10 or len(window) == 1
    import pickle

    limited = pickle.loads(pickle.dumps(indexing.LimitedEmbedder(indexing.HashingEmbedder(8), 80, 8)))
    assert limited.share == 10 and limited.embed_documents(["a b", "c"]).shape == (2, 8) and limited.limiter.held == 3


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from palimpsest import storage

    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        conf = Conf

        class sparkContext:
            applicationId, master = "app-x", "spark://host:7077"

    with pytest.raises(RuntimeError):
        storage.scratch(Cluster, "x")
    assert storage.scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
