"""The engine's queries over the driver's tables (see ``sources.virtual_repo``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, snippets, text
from ..functions.paths import DirFilter
from ..operators import chunking, indexing, layers, search, snapshot
from ..sources import virtual_repo as repo
from ..storage import stored
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHAIN = [("c1", "c0"), ("c2", "c1")]
SEQ = {"c2": 0, "c1": 1, "c0": 2}
PER_LAYER, TOP = 50, 40
DIRS = DirFilter.of(["docs/en", "docs/fr"], ["docs/en/src3"])
QUERY_WORDS = ["the", "and", "of", "with"]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# -- codes


def _query_code(vectors: DataFrame) -> list[int]:
    row = vectors.where("vec_id = 0").select("code").head()
    return list(row.code) if row else [0]


@query
def binary_quantize(spark, d):
    return repo.vectors(spark, d).select("vec_id", codes.spell(F.col("code")).alias("code"))


@query
def code_popcount(spark, d):
    return repo.vectors(spark, d).select("vec_id", codes.popcount(F.col("code")).alias("bits"))


@query
def hamming_distance(spark, d):
    v = repo.vectors(spark, d)
    return v.select("vec_id", codes.hamming_to(F.col("code"), _query_code(v)).alias("dist"))


@query
def hamming_topk(spark, d):
    v = repo.vectors(spark, d)
    return search.topk(v, _query_code(v), 10)


@query
def hamming_topk_batch(spark, d):
    """The ten nearest for every vector whose id is divisible by 50: a stated query set."""
    v = repo.vectors(spark, d)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    return search.search_blocks(asked, v, 10).select("query_id", "vec_id", "dist", F.col("rank").cast("long").alias("rank"))


# -- snapshots


@query
def file_listing(spark, d):
    return snapshot.positions(repo.files(spark, d).select("commit", "path"))


@query
def text_files(spark, d):
    return snapshot.text_files(repo.files(spark, d)).groupBy("commit").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@query
def debug_files(spark, d):
    content = F.col("text").cast("binary")
    ok = F.coalesce(snapshot.is_text(content) & (F.octet_length(content) > 0), F.lit(False))
    return repo.files(spark, d).groupBy("commit").agg(F.count(F.lit(1)).alias("tracked"), F.count_if(ok).alias("passing"), F.count_if(~ok & F.col("text").isNotNull()).alias("skipped"), F.count_if(F.col("text").isNull()).alias("unreadable"), F.sum(F.when(ok, F.octet_length(content)).otherwise(0)).cast("long").alias("bytes"))


def _changes(spark, d) -> DataFrame:
    return snapshot.changes(repo.files(spark, d), CHAIN)


@query
def tree_diff(spark, d):
    return _changes(spark, d)


@query
def delta_changed_files(spark, d):
    files = repo.files(spark, d).where("commit = 'c1'").select("commit", "doc_id", "path")
    return indexing.delta_files(files, _changes(spark, d).where("commit = 'c1'"))


@query
def delta_index(spark, d):
    return indexing.delta_plan(repo.files(spark, d).where("commit = 'c2'"), _changes(spark, d).where("commit = 'c2'"))


@query
def dir_filter(spark, d):
    return repo.base_files(spark, d).where(DIRS.column(F.col("path"))).select("doc_id", "path")


@query
def read_chunk_text(spark, d):
    """The 64 bytes from byte 100 of every file of the newest snapshot."""
    files = repo.files(spark, d).where("commit = 'c2'")
    refs = files.select("commit", "path", F.lit(100).alias("offset"), F.lit(64).alias("length"))
    # bytes are compared as hexadecimal digits, since a range may cut a character
    content = F.col("text").cast("binary")
    return refs.join(files.select("commit", "path", "text"), ["commit", "path"]).select("path", F.hex(snippets.byte_slice(content, F.col("offset"), F.col("length"))).alias("bytes_hex"))


# -- chains


@query
def resolve_commit(spark, d):
    """Names of known commits; those of lost ones resolve to nothing."""
    return repo.refs(spark, d).join(repo.commits(spark, d).select("commit").distinct(), "commit").select("name", "commit")


@query
def indexed_commits(spark, d):
    return layers.current(repo.layers(spark, d)).select("commit", "parent")


def _named(spark, k: int) -> str:
    return spark.range(1).select(repo.commit_name(F.lit(k))).head()[0]


@query
def chain_start(spark, d):
    """The nearest indexed ancestor of the newest commit."""
    return layers.chain_start(repo.commits(spark, d), layers.current(repo.layers(spark, d)), _named(spark, repo.newest(spark, d)))


@query
def delta_parent(spark, d):
    """The nearest indexed ancestor of an indexed commit, not itself."""
    return layers.chain_start(repo.commits(spark, d), layers.current(repo.layers(spark, d)), _named(spark, _top(spark, d)), strict=True)


def _top(spark, d) -> int:
    """The newest commit that has a layer: every third has, of the older seven tenths."""
    return (repo.newest(spark, d) * 7 // 10 - 1) // 3 * 3 + 1


@query
def chain_walk(spark, d):
    """From the newest layer to one that can't be read."""
    return layers.chain_walk(repo.layers(spark, d), _named(spark, _top(spark, d)))


# -- search


def _seq(column: str = "commit"):
    return F.create_map(*[F.lit(x) for kv in SEQ.items() for x in kv])[F.col(column)].cast("long")


def _listing(spark, d) -> DataFrame:
    return snapshot.positions(repo.files(spark, d).select("commit", "doc_id", "path"))


def _slots(spark, d, changed: DataFrame | None = None) -> DataFrame:
    """All slots of the layers: commit, doc_id, chunk_index, code."""
    changed = _changes(spark, d).where("kind = 'changed'") if changed is None else changed
    held = repo.files(spark, d).select("commit", "doc_id", "path").join(changed.select("commit", "path"), ["commit", "path"], "left_semi")
    return repo.chunks(spark, d, held)


def _placed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks with seq and pos, the listing, and the changes with seq."""
    changes = stored(_changes(spark, d), "changes")
    listing = stored(_listing(spark, d), "listing")
    chunks = _slots(spark, d, changes.where("kind = 'changed'")).join(listing.select("commit", "doc_id", "pos"), ["commit", "doc_id"])
    return chunks.withColumn("seq", _seq()), listing, changes.select("path", _seq().alias("seq"))


@query
def topk_per_layer(spark, d):
    chunks, _, _ = _placed(spark, d)
    return search.topk_per_layer(chunks, _query_code(repo.vectors(spark, d)), PER_LAYER)


@query
def resolve_paths(spark, d):
    chunks, listing, _ = _placed(spark, d)
    hits = search.topk_per_layer(chunks, _query_code(repo.vectors(spark, d)), PER_LAYER)
    return search.resolve_paths(hits, listing).select("commit", "pos", "chunk_index", "path", "dist")


@query
def shadowed_search(spark, d):
    chunks, listing, changes = _placed(spark, d)
    hits = search.resolve_paths(search.topk_per_layer(chunks, _query_code(repo.vectors(spark, d)), PER_LAYER), listing)
    return search.shadowed(hits, changes).select("commit", "seq", "pos", "chunk_index", "path", "dist")


@query
def chain_search(spark, d):
    chunks, listing, changes = _placed(spark, d)
    return search.chain_search(chunks, listing, changes, _query_code(repo.vectors(spark, d)), PER_LAYER, TOP, DIRS).select("commit", "seq", "pos", "chunk_index", "path", "dist")


@query
def chain_search_prefilter(spark, d):
    chunks, listing, changes = _placed(spark, d)
    return search.chain_search(chunks, listing, changes, _query_code(repo.vectors(spark, d)), PER_LAYER, TOP, DIRS, "pre").select("commit", "seq", "pos", "chunk_index", "path", "dist")


@query
def incomplete_commits(spark, d):
    return search.incomplete_commits(_slots(spark, d))


@query
def incomplete_files(spark, d):
    return search.incomplete_files(_slots(spark, d))


# -- increments


@query
def pending_slots(spark, d):
    slots = stored(_slots(spark, d), "slots")
    done = slots.where("code is not null and chunk_index > 0").select("commit", "doc_id", "chunk_index")
    skeleton = slots.withColumn("code", F.lit(None).cast("array<long>"))
    return indexing.pending_slots(skeleton, done)


@query
def fill_merge(spark, d):
    slots = stored(_slots(spark, d), "slots")
    skeleton = slots.withColumn("code", F.lit(None).cast("array<long>"))
    return layers.fill_merge(skeleton, slots.where("code is not null")).select("commit", "doc_id", "chunk_index", codes.spell(F.col("code")).alias("code"))


@query
def compact(spark, d):
    chunks, _, changes = _placed(spark, d)
    files = repo.files(spark, d).where("commit = 'c2'").select("doc_id", "path")
    return indexing.compact(chunks, files, changes).select("doc_id", "path", "chunk_index", "seq", codes.spell(F.col("code")).alias("code"))


@query
def reuse_embeddings(spark, d):
    """Codes of c0's chunks for those of c2 with equal path and bytes."""
    vectors = repo.vectors(spark, d).select(F.expr("vec_id div 5").alias("doc_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), "code")
    found = repo.pieces(repo.files(spark, d)).select("commit", "doc_id", "path", "chunk_index", F.col("piece").alias("text"))
    old = found.where("commit = 'c0'").join(vectors, ["doc_id", "chunk_index"]).select("path", "chunk_index", "text", "code")
    new = found.where("commit = 'c2'").select("path", "chunk_index", "text")
    return indexing.reuse_codes(old, new).select("path", "chunk_index", codes.spell(F.col("code")).alias("code"))


def _lengths(spark, d) -> DataFrame:
    """Line lengths as chunk lengths: files cut at every line end."""
    rows = text.lines(repo.table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("line_no").alias("chunk_index"), (F.col("end_byte") - F.col("start_byte")).alias("chunk_len"))


@query
def resolve_chunk_ref(spark, d):
    return indexing.layout(_lengths(spark, d))


@query
def layout_prefix(spark, d):
    """Flat positions of each file's chunks: counts of the files before it."""
    per_file = _lengths(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("chunk_len").alias("bytes"))
    parts = stored(snapshot.positions(per_file.withColumn("commit", F.lit("all")), order="doc_id"), "layout")
    width = 1024  # ranks to a stretch: prefix sums run within stretches, and over their totals
    from pyspark.sql import Window

    stretch = (F.col("pos") / width).cast("long")
    totals = parts.groupBy(stretch.alias("stretch")).agg(F.sum("chunks").alias("n"))
    before = totals.select("stretch", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("chunks").over(Window.partitionBy("stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("stretch", stretch).withColumn("inner", inner).join(before, "stretch").select("doc_id", "pos", "chunks", "bytes", (F.col("before") + F.col("inner")).alias("first_chunk"))


@query
def index_totals(spark, d):
    slots = _slots(spark, d)
    return slots.groupBy("commit").agg(F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("chunks"), F.count("code").alias("embedded"))


@query
def embed_batches(spark, d):
    """Requests of 16 inputs or 4000 tokens at most, with their totals."""
    return indexing.embed_batches(repo.table(spark, d, "documents"), 16, 4000)


@query
def embed_query(spark, d):
    """Benchmark texts through the offline embedder, as sign codes."""
    items = repo.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return indexing.embed(items, indexing.HashingEmbedder(64)).select(F.col("doc_id").alias("item_id"), codes.spell(codes.quantise("embedding", 64)).alias("code"))


# -- text


def _docs(spark, d) -> DataFrame:
    return repo.table(spark, d, "documents").select("doc_id", "text")


@query
def token_count(spark, d):
    return _docs(spark, d).select("doc_id", text.count_tokens(F.col("text")).alias("tokens"))


@query
def line_info(spark, d):
    return text.lines(_docs(spark, d)).drop("line")


@query
def break_score(spark, d):
    return text.break_scores(text.lines(_docs(spark, d)))


@query
def chunk_lines(spark, d):
    return chunking.chunk_files(_docs(spark, d))


@query
def chunk_invariants(spark, d):
    """Chunks of each file: their bytes, and whether they follow without gaps."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    found = chunking.chunk_files(_docs(spark, d)).withColumn("at", F.coalesce(F.sum("chunk_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return found.groupBy("doc_id").agg(F.sum("chunk_len").alias("bytes"), F.bool_and(F.col("at") == F.col("byte_offset")).alias("contiguous"))


def _code_files(spark, d) -> DataFrame:
    """Documents as sources of three kinds: doc_id, path and text."""
    body = F.split("text", "\n", -1)
    rust = F.array_join(F.transform(body, lambda s, i: F.concat(F.when(i % 6 == 0, F.lit("\n\n")).otherwise(F.lit("")), F.lit("fn f"), i.cast("string"), F.lit("() {\n    // "), s, F.lit("\n}\n"))), "")
    python = F.array_join(F.transform(body, lambda s, i: F.concat(F.when(i % 6 == 0, F.lit("\n\n")).otherwise(F.lit("")), F.lit("def f"), i.cast("string"), F.lit("():\n    # "), s, F.lit("\n    return 1\n"))), "")
    k = F.col("doc_id") % 3
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.when(k == 0, ".rs").when(k == 1, ".py").otherwise(".txt"))
    return repo.table(spark, d, "documents").select("doc_id", path.alias("path"), F.when(k == 0, rust).when(k == 1, python).otherwise(F.col("text")).alias("text"))


@query
def chunk_code(spark, d):
    """Sources cut by their syntax, prose by lines: chunks of each file follow without
    gaps, and how many bytes they hold."""
    files = _code_files(spark, d)
    found = chunking.chunk_code_files(files, 200)
    per = found.groupBy("doc_id").agg(F.min("byte_offset").alias("first"), F.sum("chunk_len").alias("bytes"), F.max(F.col("byte_offset") + F.col("chunk_len")).alias("last"), F.count_distinct("byte_offset").alias("starts"), F.count(F.lit(1)).alias("chunks"), F.min("chunk_len").alias("least"))
    whole = (F.col("first") == 0) & (F.col("bytes") == F.col("last")) & (F.col("starts") == F.col("chunks")) & (F.col("least") > 0)
    return per.join(files.select("doc_id", text.language_of(F.col("path")).alias("language")), "doc_id").select("doc_id", "language", "bytes", whole.alias("contiguous"))


@query
def detect_language(spark, d):
    literal = spark.createDataFrame([(p,) for p in ("src/a.rs", "b.py", "c.pyi", "d.tar.mjs", "e.TS", "x.tsx", "go", "src/go", "h.hh", "i.java", "j.rb", "k.txt", ".c", "l.")], "path string")
    pages = repo.table(spark, d, "pages").select(F.col("url").alias("path"))
    return literal.unionByName(pages).select("path", text.language_of(F.col("path")).alias("language"))


@query
def snippet_start_line(spark, d):
    """The line on which the middle byte of each document lies."""
    content = F.col("text").cast("binary")
    return _docs(spark, d).select("doc_id", snippets.start_line(content, F.floor(F.octet_length(content) / 2)).alias("line"))


@query
def snippet_numbered(spark, d):
    return _docs(spark, d).select("doc_id", snippets.numbered(F.col("text"), F.lit(98)).alias("numbered"))


@query
def snippet_staleness(spark, d):
    """How c1's chunks fare in c2 as the working tree, where every 13th file has a new
    first line."""
    files = repo.files(spark, d)
    moved = F.when(F.col("doc_id") % 13 == 2, F.concat(F.lit("# moved\n"), "text")).otherwise(F.col("text"))
    disk = files.where("commit = 'c2'").select("path", moved.cast("binary").alias("disk"))
    found = repo.pieces(files.where("commit = 'c1'")).join(disk, "path", "left")
    return found.select("path", "chunk_index", snippets.staleness(F.col("piece").cast("binary"), F.col("offset"), F.col("disk")).alias("state"))


# -- administration


@query
def status(spark, d):
    found = layers.current(repo.layers(spark, d)).agg(F.count(F.lit(1)).alias("layers"), F.sum("bytes").alias("bytes"), F.max_by(F.substring("commit", 1, 12), "mtime").alias("latest"))
    return found.select("layers", "bytes", snippets.format_bytes(F.col("bytes")).alias("size"), "latest")


@query
def gc_plan(spark, d):
    return layers.gc_plan(repo.layers(spark, d), repo.commits(spark, d)).select("commit", "reason", "bytes")


@query
def gc_orphans(spark, d):
    return layers.gc_orphans(repo.layers(spark, d), repo.commits(spark, d))


@query
def expand_alias(spark, d):
    names = spark.createDataFrame([("both",), ("none",), ("gamma",)], "name string")
    return layers.expand_alias(names, spark.createDataFrame(repo.ALIASES, "alias string, repos array<string>"))


# -- ranking


@query
def rerank_topk(spark, d):
    return search.rerank(_docs(spark, d).withColumnRenamed("doc_id", "idx"), QUERY_WORDS, 10)


@query
def render_results(spark, d):
    """Header lines of the ten best files; paths are joined after the cut."""
    best = search.rerank(_docs(spark, d).withColumnRenamed("doc_id", "idx"), QUERY_WORDS, 10)
    files = repo.base_files(spark, d).select(F.col("doc_id").alias("idx"), "path", F.octet_length("text").alias("len"))
    from pyspark.sql import Window

    # ten rows at most: one task may rank them
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "idx"))
    return best.join(files, "idx").withColumn("rank", rank.cast("long")).select("rank", F.format_string("Result %d · %s (0, %d) [score %.4f]", F.col("rank"), F.col("path"), F.col("len"), F.col("score")).alias("header"))


@query
def rate_window(spark, d):
    events = repo.table(spark, d, "events").select("event_id", "ts", F.greatest(F.lit(1), F.floor(F.octet_length("props") / 4)).cast("long").alias("tokens"))
    return ingest.rate_window(events)
