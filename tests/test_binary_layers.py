import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import codes
from palimpsest.operators.layers import gc_plan
from palimpsest.sources import binary_layers as layers


@pytest.mark.parametrize("positions,runs", [([0, 1, 2], [3, 0]), ([0, 1, 5, 6, 10], [2, -3, 2, -3, 1, 0]), ([5, 6], [-5, 2, 0]), ([0, 40_000], [1, -32_767, -7232, 1, 0]), ([], [0])])
def test_runs(positions, runs):
    assert layers.runs_of(positions) == runs and layers.positions_of(runs) == positions


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 70_000), st.lists(st.tuples(st.integers(0, 65_535), st.one_of(st.none(), st.binary(min_size=256, max_size=256).filter(any))), max_size=4), max_size=12))
def test_round_trip(files):
    entries = sorted(files.items())
    data = layers.write_layer("ab" * 20, None, entries)
    version, commit, parent, rows = layers.read_layer(data)
    assert (version, commit, parent) == (2, "ab" * 20, None) and (len(data) - 256 * len(rows)) % 32 == 0
    assert [(p, n, c) for p, _, _, n, c in rows] == [(p, n, c) for p, chunks in entries for n, c in chunks]
    if rows:
        with pytest.raises(ValueError):
            layers.read_layer(data[:-1])


def test_offsets_and_errors():
    data = layers.write_layer("c", "p", [(0, [(100, None), (200, b"\1" * 256)]), (5, [(300, None)]), (7, [])])
    assert [r[:4] for r in layers.read_layer(data)[3]] == [(0, 0, 0, 100), (0, 1, 100, 200), (5, 0, 0, 300)]
    for bad in ([(1, []), (1, [])], [(0, [(70_000, None)])]):
        with pytest.raises(ValueError):
            layers.write_layer("c", None, bad)
    for bad in (b"", b"\1" + data[1:], data[:140]):
        with pytest.raises(ValueError):
            layers.read_layer(bad)


def test_folder(spark, tmp_path):
    (tmp_path / "a").write_bytes(layers.write_layer("a", None, [(3, [(9, b"\x80" + b"\0" * 255), (1, None)])]))
    (tmp_path / "old").write_bytes(b"\1" * 200)
    rows = layers.read_layers(spark, str(tmp_path)).orderBy("chunk_index").withColumn("filled", codes.filled(codes.F.col("code"))).collect()
    assert [(r.commit, r.parent, r.pos, r.byte_offset, r.chunk_len, r.filled) for r in rows] == [("a", None, 3, 0, 9, True), ("a", None, 3, 9, 1, False)]
    (tmp_path / "cut").write_bytes(layers.write_layer("c", "a", [(3, [(9, b"\1" * 256)])])[:-1])
    (tmp_path / "none").write_bytes(b"")
    heads = {r.path.rsplit("/", 1)[-1]: r for r in layers.read_headers(spark, str(tmp_path)).collect()}
    assert {k: (r.commit, r.version, r.error is None) for k, r in heads.items()} == {"a": ("a", 2, True), "old": ("old", 1, False), "cut": ("cut", None, False)}
    plan = gc_plan(layers.read_headers(spark, str(tmp_path)), spark.createDataFrame([("a",)], "commit string"))
    assert {(r.commit, r.reason) for r in plan.collect()} == {("old", "obsolete_version"), ("cut", "unreadable")}
    assert rows[0].code[0] == -(2**63) and len(rows[0].code) == 32
