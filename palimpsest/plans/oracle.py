"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from ..functions.text import GRAMMARS, TOKEN
from ..operators.indexing import GROUP_IDS
from ..sources.virtual_repo import ALIASES, PIECE
from .queries import PER_LAYER, QUERY_WORDS, TOP


def _lit(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)})"


_HISTORY = """h AS (SELECT p_partkey AS k FROM part), newest AS (SELECT coalesce(max(k), 0) AS n FROM h),
commits AS (SELECT md5(k::VARCHAR) AS commit, CASE WHEN k > 1 THEN md5((k - 1)::VARCHAR) END AS parent FROM h
  UNION ALL SELECT md5(k::VARCHAR), md5((k - 13)::VARCHAR) FROM h WHERE k % 10 = 0 AND k > 13),
layers AS (SELECT md5(k::VARCHAR) AS commit, CASE WHEN k % 50 = 4 AND k <= 160 THEN md5('gone' || (k - 1)::VARCHAR) WHEN k > 3 THEN md5((k - 3)::VARCHAR) END AS parent,
    CASE WHEN k % 61 = 0 AND k < 400 THEN 1 WHEN k % 67 <> 0 OR k >= 400 THEN 2 END AS version, k * 1000 + 7 AS bytes, k AS mtime
  FROM h, newest WHERE k % 3 = 1 AND k <= n * 7 // 10
  UNION ALL SELECT md5('gone' || k::VARCHAR), NULL, 2, k, k FROM h, newest WHERE k % 50 = 3 AND k <= n // 2),
refs AS (SELECT 'v' || k::VARCHAR AS name, md5(k::VARCHAR) AS commit FROM h WHERE k % 100 = 0
  UNION ALL SELECT 'HEAD', md5(k::VARCHAR) FROM h, newest WHERE k = n
  UNION ALL SELECT 'lost' || k::VARCHAR, md5('gone' || k::VARCHAR) FROM h WHERE k % 150 = 3)"""
_VEC = "vec AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND NOT isnan(x) THEN 1::HUGEINT << (64 - i)::INTEGER ELSE 0::HUGEINT END))::UBIGINT AS w FROM embeddings)"
_HEX = "lpad(upper(to_hex(w)), 16, '0')"
_BASE = "base AS (SELECT doc_id, 'docs/' || lang || '/' || source || '/' || printf('%06d', doc_id) || '.txt' AS path, text FROM documents)"
_FILES = _BASE + """, files AS (
  SELECT 'c0' AS commit, doc_id, path, text FROM base WHERE doc_id % 10 <> 9
  UNION ALL SELECT 'c1', doc_id, path, CASE WHEN doc_id % 7 = 3 THEN text || chr(10) || 'rev c1' ELSE text END FROM base
    WHERE (doc_id % 10 <> 9 OR doc_id % 20 = 9) AND doc_id % 31 <> 5
  UNION ALL SELECT 'c2', doc_id, path, CASE WHEN doc_id % 11 = 4 THEN text || chr(10) || 'rev c2' WHEN doc_id % 7 = 3 THEN text || chr(10) || 'rev c1' ELSE text END FROM base
    WHERE doc_id % 31 <> 5 AND doc_id % 29 <> 8
), listing AS (SELECT commit, doc_id, path, row_number() OVER (PARTITION BY commit ORDER BY path) - 1 AS pos FROM files)"""
_CHANGES = _FILES + ", changes AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS commit, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS kind FROM (SELECT path, text FROM files WHERE commit = '{p}') a FULL JOIN (SELECT path, text FROM files WHERE commit = '{c}') b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text"
    for c, p in (("c1", "c0"), ("c2", "c1"))
) + ")"
_SLOTS = _CHANGES + ", " + _VEC + """, n AS (SELECT count(*) AS n FROM embeddings), held AS (
  SELECT commit, doc_id FROM files WHERE commit = 'c0'
  UNION ALL SELECT f.commit, f.doc_id FROM files f JOIN changes c ON c.commit = f.commit AND c.path = f.path AND c.kind = 'changed'
), slots AS (
  SELECT h.commit, h.doc_id, (v.vec_id % 5)::INTEGER AS chunk_index,
    CASE WHEN h.commit = 'c1' AND v.vec_id % 97 = 0 THEN NULL ELSE s.w END AS w
  FROM held h JOIN vec v ON v.vec_id // 5 = h.doc_id, n
  JOIN vec s ON s.vec_id = CASE h.commit WHEN 'c0' THEN v.vec_id WHEN 'c1' THEN (v.vec_id * 7 + 13) % n.n ELSE (v.vec_id * 11 + 29) % n.n END
)"""
_SEQ = "CASE commit WHEN 'c2' THEN 0 WHEN 'c1' THEN 1 ELSE 2 END::BIGINT"
_Q = "q AS (SELECT w AS qw FROM vec WHERE vec_id = 0)"
_PLACED = _SLOTS + f", {_Q}, placed AS (SELECT s.commit, s.doc_id, s.chunk_index, s.w, l.pos, l.path FROM slots s JOIN listing l ON l.commit = s.commit AND l.doc_id = s.doc_id), scored AS (SELECT commit, {_SEQ} AS seq, pos, chunk_index, path, bit_count(xor(w, qw))::BIGINT AS dist FROM placed, q WHERE w IS NOT NULL AND w <> 0)"
_TOPS = _PLACED + f", tops AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY commit ORDER BY dist, pos, chunk_index) <= {PER_LAYER})"
_SEQ_CHANGES = f"shadow AS (SELECT path, {_SEQ} AS seq FROM changes)"
_NOT_SHADOWED = "NOT EXISTS (SELECT 1 FROM shadow s WHERE s.path = t.path AND s.seq < t.seq)"
_DIRS = "(starts_with(path, 'docs/en/') OR path = 'docs/en' OR starts_with(path, 'docs/fr/') OR path = 'docs/fr') AND NOT (path = 'docs/en/src3' OR starts_with(path, 'docs/en/src3/'))"
_HIT = "commit, seq, pos, chunk_index, path, dist"
_LINES = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n FROM documents WHERE strlen(text) > 0),
sized AS (SELECT *, strlen(line) + CASE WHEN line_no < n - 1 THEN 1 ELSE 0 END AS size, regexp_extract(line, '^[ \\t]*') AS lead FROM raw WHERE line_no < n - 1 OR strlen(line) > 0),
lines AS (SELECT doc_id, line_no::BIGINT AS line_no, (sum(size) OVER w - size)::BIGINT AS start_byte, (sum(size) OVER w)::BIGINT AS end_byte,
  (len(lead) + 3 * (len(lead) - len(replace(lead, chr(9), ''))))::BIGINT AS indent, regexp_full_match(line, '[ \\t\\r]*') AS is_blank
  FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
_LANG = "CASE " + " ".join(f"WHEN ext IN ({', '.join(map(_lit, ends))}) THEN '{name}'" for name, ends in GRAMMARS.items()) + " END"
_PATHS = ("src/a.rs", "b.py", "c.pyi", "d.tar.mjs", "e.TS", "x.tsx", "go", "src/go", "h.hh", "i.java", "j.rb", "k.txt", ".c", "l.")
_GC = "plan AS (SELECT l.commit, CASE WHEN version IS NULL THEN 'unreadable' WHEN version <> 2 THEN 'obsolete_version' ELSE 'commit_gone' END AS reason, bytes::BIGINT AS bytes FROM layers l WHERE version IS NULL OR version <> 2 OR commit NOT IN (SELECT commit FROM commits))"
_WALK = "walk AS (SELECT DISTINCT commit, 0 AS depth FROM commits, newest WHERE commit = md5(({0})::VARCHAR) UNION SELECT c.parent, w.depth + 1 FROM walk w JOIN commits c ON c.commit = w.commit AND c.parent IS NOT NULL)"
_START = f"WITH RECURSIVE {_HISTORY}, {_WALK} SELECT w.commit, min(depth)::BIGINT AS commits_behind FROM walk w JOIN layers l ON l.commit = w.commit AND l.version = 2 WHERE depth >= {{1}} GROUP BY w.commit ORDER BY commits_behind, w.commit LIMIT 1"
_TOP = "(n * 7 // 10 - 1) // 3 * 3 + 1"
_PIECES = f"pieces AS (SELECT commit, doc_id, path, text, i::INTEGER AS chunk_index, strlen(substr(text, 1, i * {PIECE})) AS off, substr(text, i * {PIECE} + 1, CASE WHEN i < 4 THEN {PIECE} ELSE 1073741824 END) AS piece FROM files, range(5) AS r(i) WHERE piece <> '')"
_CUT = f"""{_LINES}, costs AS (SELECT doc_id, line_no::BIGINT AS i, (sum(size) OVER w - size)::BIGINT AS s, (sum(size) OVER w)::BIGINT AS e, len(regexp_extract_all(line, '{TOKEN}')) AS t,
  regexp_full_match(line, '[ \\t\\r]*') AS is_blank, len(lead) + 3 * (len(lead) - len(replace(lead, chr(9), ''))) AS indent FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
_MD5 = "('0x' || substr(md5(word), 1, 8))::BIGINT"
_RANKED = f"ranked AS (SELECT doc_id AS idx, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), {QUERY_WORDS!r}))::DOUBLE / {len(QUERY_WORDS)}.0 AS score FROM documents ORDER BY score DESC, idx LIMIT 10)"

ORACLE_SQL: dict[str, str] = {
    "binary_quantize": f"WITH {_VEC} SELECT vec_id, {_HEX} AS code FROM vec",
    "code_popcount": f"WITH {_VEC} SELECT vec_id, bit_count(w)::BIGINT AS bits FROM vec",
    "hamming_distance": f"WITH {_VEC}, {_Q} SELECT vec_id, bit_count(xor(w, qw))::BIGINT AS dist FROM vec, q",
    "hamming_topk": f"WITH {_VEC}, {_Q} SELECT vec_id, bit_count(xor(w, qw))::BIGINT AS dist FROM vec, q WHERE w <> 0 ORDER BY dist, vec_id LIMIT 10",
    "hamming_topk_batch": f"WITH {_VEC}, met AS (SELECT q.vec_id AS query_id, v.vec_id, bit_count(xor(v.w, q.w))::BIGINT AS dist FROM vec v JOIN vec q ON q.vec_id % 50 = 0 WHERE v.w <> 0) SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM met QUALIFY rank <= 10",
    "file_listing": f"WITH {_FILES} SELECT commit, path, pos FROM listing",
    "text_files": f"WITH {_FILES} SELECT commit, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM files WHERE text IS NOT NULL AND strlen(text) > 0 AND strpos(text[1:8192], chr(0)) = 0 GROUP BY commit",
    "debug_files": f"WITH {_FILES}, m AS (SELECT commit, text, coalesce(strlen(text) > 0 AND strpos(text[1:8192], chr(0)) = 0, false) AS ok FROM files) SELECT commit, count(*) AS tracked, count(*) FILTER (ok) AS passing, count(*) FILTER (NOT ok AND text IS NOT NULL) AS skipped, count(*) FILTER (text IS NULL) AS unreadable, sum(CASE WHEN ok THEN strlen(text) ELSE 0 END)::BIGINT AS bytes FROM m GROUP BY commit",
    "tree_diff": f"WITH {_CHANGES} SELECT commit, path, kind FROM changes",
    "delta_changed_files": f"WITH {_CHANGES} SELECT f.commit, f.doc_id, f.path FROM files f WHERE f.commit = 'c1' AND f.path IN (SELECT path FROM changes WHERE commit = 'c1' AND kind = 'changed')",
    "delta_index": f"WITH {_CHANGES} SELECT c.path, CASE WHEN c.kind = 'changed' AND strlen(f.text) > 0 AND strpos(f.text[1:8192], chr(0)) = 0 THEN 'chunk' ELSE 'tombstone' END AS action FROM changes c LEFT JOIN files f ON f.commit = 'c2' AND f.path = c.path WHERE c.commit = 'c2'",
    "dir_filter": f"WITH {_BASE} SELECT doc_id, path FROM base WHERE {_DIRS}",
    "read_chunk_text": f"WITH {_FILES} SELECT path, substr(hex(encode(text)), 201, 128) AS bytes_hex FROM files WHERE commit = 'c2'",
    "resolve_commit": f"WITH {_HISTORY} SELECT name, commit FROM refs WHERE commit IN (SELECT commit FROM commits)",
    "indexed_commits": f"WITH {_HISTORY} SELECT commit, parent FROM layers WHERE version = 2",
    "chain_start": _START.format("n", 0),
    "delta_parent": _START.format(_TOP, 1),
    "chain_walk": f"WITH RECURSIVE {_HISTORY}, chain AS (SELECT commit, parent, 0 AS seq FROM layers, newest WHERE commit = md5(({_TOP})::VARCHAR) AND version = 2 UNION ALL SELECT l.commit, l.parent, c.seq + 1 FROM chain c JOIN layers l ON l.commit = c.parent AND l.version = 2) SELECT commit, seq::BIGINT AS seq FROM chain",
    "topk_per_layer": f"WITH {_TOPS} SELECT commit, seq, pos, chunk_index, dist FROM tops",
    "resolve_paths": f"WITH {_TOPS} SELECT commit, pos, chunk_index, path, dist FROM tops",
    "shadowed_search": f"WITH {_TOPS}, {_SEQ_CHANGES} SELECT {_HIT} FROM tops t WHERE {_NOT_SHADOWED}",
    "chain_search": f"WITH {_TOPS}, {_SEQ_CHANGES} SELECT {_HIT} FROM tops t WHERE {_NOT_SHADOWED} AND {_DIRS} ORDER BY dist, seq, pos, chunk_index LIMIT {TOP}",
    "chain_search_prefilter": f"WITH {_PLACED}, {_SEQ_CHANGES}, open AS (SELECT * FROM scored t WHERE {_NOT_SHADOWED} AND {_DIRS} QUALIFY row_number() OVER (PARTITION BY commit ORDER BY dist, pos, chunk_index) <= {PER_LAYER}) SELECT {_HIT} FROM open ORDER BY dist, seq, pos, chunk_index LIMIT {TOP}",
    "incomplete_commits": f"WITH {_SLOTS} SELECT commit, count(*) FILTER (w IS NULL OR w = 0) AS unfilled FROM slots GROUP BY commit HAVING unfilled > 0",
    "incomplete_files": f"WITH {_SLOTS} SELECT commit, doc_id FROM slots GROUP BY commit, doc_id HAVING bool_or(w IS NULL OR w = 0)",
    "pending_slots": f"WITH {_SLOTS} SELECT commit, doc_id, chunk_index FROM slots WHERE NOT (w IS NOT NULL AND chunk_index > 0)",
    "fill_merge": f"WITH {_SLOTS} SELECT commit, doc_id, chunk_index, {_HEX} AS code FROM slots",
    "compact": f"WITH {_PLACED}, {_SEQ_CHANGES}, there AS (SELECT p.doc_id, f.path, p.chunk_index, CASE p.commit WHEN 'c2' THEN 0 WHEN 'c1' THEN 1 ELSE 2 END::BIGINT AS seq, p.w FROM placed p JOIN files f ON f.commit = 'c2' AND f.doc_id = p.doc_id) SELECT doc_id, path, chunk_index, seq, {_HEX} AS code FROM there t WHERE seq = (SELECT min(seq) FROM there u WHERE u.doc_id = t.doc_id) AND {_NOT_SHADOWED}",
    "reuse_embeddings": f"WITH {_FILES}, {_VEC}, {_PIECES}, old AS (SELECT path, piece, arg_max(w, chunk_index) AS w FROM pieces p JOIN vec v ON v.vec_id = p.doc_id * 5 + p.chunk_index WHERE commit = 'c0' AND w <> 0 GROUP BY path, piece) SELECT p.path, p.chunk_index, {_HEX} AS code FROM pieces p JOIN old o ON o.path = p.path AND o.piece = p.piece WHERE p.commit = 'c2'",
    "resolve_chunk_ref": f"WITH {_LINES} SELECT doc_id, line_no AS chunk_index, start_byte AS byte_offset, end_byte - start_byte AS chunk_len FROM lines",
    "layout_prefix": f"WITH {_LINES}, per AS (SELECT doc_id, count(*) AS chunks, sum(end_byte - start_byte)::BIGINT AS bytes FROM lines GROUP BY doc_id) SELECT doc_id, row_number() OVER w - 1 AS pos, chunks, bytes, (sum(chunks) OVER w - chunks)::BIGINT AS first_chunk FROM per WINDOW w AS (ORDER BY doc_id)",
    "index_totals": f"WITH {_SLOTS} SELECT commit, count(DISTINCT doc_id) AS files, count(*) AS chunks, count(w) AS embedded FROM slots GROUP BY commit",
    "token_count": f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS tokens FROM documents",
    "line_info": f"WITH {_LINES} SELECT * FROM lines",
    "break_score": f"WITH {_LINES}, m AS (SELECT doc_id, line_no, is_blank, lead(is_blank) OVER w AS nb, lead(indent) OVER w AS ni FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) SELECT doc_id, line_no, (CASE WHEN is_blank OR nb THEN 100 ELSE 0 END + greatest(0, 50 - 5 * ni))::BIGINT AS score FROM m WHERE nb IS NOT NULL",
    "chunk_invariants": "SELECT doc_id, strlen(text) AS bytes, true AS contiguous FROM documents WHERE strlen(text) > 0",
    "chunk_lines": f"""WITH RECURSIVE {_CUT}, steps AS MATERIALIZED (
        SELECT doc_id, i, s, e, sum(t) OVER w AS cum, lag(s, 1, 0) OVER w AS ps, sum(t) OVER w - t AS before, (sum(t) OVER w - t - lag(t, 1, 0) OVER w) AS before_last,
          CASE WHEN is_blank OR lag(is_blank) OVER w THEN 100 ELSE 0 END + greatest(0, 50 - 5 * indent) AS score FROM costs WINDOW w AS (PARTITION BY doc_id ORDER BY i)
      ), walk AS (
        SELECT doc_id, i, 0::BIGINT AS first, 0::BIGINT AS begin, 0::HUGEINT AS base, -1::BIGINT AS best, -1::BIGINT AS best_score, 0::BIGINT AS best_end, 0::HUGEINT AS best_cum, -1::BIGINT AS cut_at, 0::HUGEINT AS cut_cum FROM steps WHERE i = 0
        UNION ALL
        SELECT doc_id, i, CASE WHEN cut < 0 THEN first WHEN best >= 0 THEN best + 1 ELSE i - 1 END, CASE WHEN cut < 0 THEN begin ELSE cut END, CASE WHEN cut < 0 THEN base WHEN best >= 0 THEN best_cum ELSE before_last END,
          CASE WHEN cut >= 0 THEN -1 WHEN take THEN i - 1 ELSE best END, CASE WHEN cut >= 0 THEN -1 WHEN take THEN score ELSE best_score END, CASE WHEN cut >= 0 THEN 0 WHEN take THEN s ELSE best_end END, CASE WHEN cut >= 0 THEN 0 WHEN take THEN before ELSE best_cum END,
          cut, CASE WHEN cut < 0 THEN cut_cum WHEN best >= 0 THEN best_cum ELSE before_last END
        FROM (SELECT w.*, n.i AS i, n.s, n.before, n.before_last, n.score::BIGINT AS score, n.i > first AND (best < 0 OR n.score >= best_score) AS take,
            CASE WHEN n.cum - base <= 430 THEN -1 WHEN best >= 0 AND best_end > begin THEN best_end WHEN best < 0 AND n.i > first AND n.ps > begin THEN n.ps ELSE -1 END AS cut
          FROM (SELECT doc_id, i AS at, first, begin, base, best, best_score, best_end, best_cum, cut_cum FROM walk) w JOIN steps n ON n.doc_id = w.doc_id AND n.i = w.at + 1)
      ), starts AS (SELECT doc_id, 0::BIGINT AS a, 0::HUGEINT AS c FROM steps WHERE i = 0 UNION ALL SELECT doc_id, cut_at, cut_cum FROM walk WHERE cut_at >= 0),
      ends AS (SELECT doc_id, max(e) AS size, max(cum) AS total FROM steps GROUP BY doc_id)
      SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS chunk_index, a AS byte_offset, (lead(a, 1, size) OVER w - a)::BIGINT AS chunk_len, (lead(c, 1, total) OVER w - c)::BIGINT AS n_tokens FROM starts JOIN ends USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY a)""",
    "chunk_code": """WITH b AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), code AS (SELECT doc_id, CASE doc_id % 3
        WHEN 0 THEN array_to_string(list_transform(l, lambda s, i: CASE WHEN (i - 1) % 6 = 0 THEN chr(10) || chr(10) ELSE '' END || 'fn f' || (i - 1) || '() {' || chr(10) || '    // ' || s || chr(10) || '}' || chr(10)), '')
        WHEN 1 THEN array_to_string(list_transform(l, lambda s, i: CASE WHEN (i - 1) % 6 = 0 THEN chr(10) || chr(10) ELSE '' END || 'def f' || (i - 1) || '():' || chr(10) || '    # ' || s || chr(10) || '    return 1' || chr(10)), '')
        ELSE text END AS c FROM b) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' END AS language, strlen(c) AS bytes, true AS contiguous FROM code WHERE strlen(c) > 0""",
    "embed_batches": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id // {GROUP_IDS} AS grp, row_number() OVER (PARTITION BY doc_id // {GROUP_IDS} ORDER BY doc_id) AS i, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS t FROM documents),
      walk AS (SELECT grp, i, 0::BIGINT AS batch, 1::BIGINT AS held, t AS size, t FROM r WHERE i = 1
        UNION ALL SELECT r.grp, r.i, batch + CASE WHEN held < 16 AND size + r.t <= 4000 THEN 0 ELSE 1 END, CASE WHEN held < 16 AND size + r.t <= 4000 THEN held + 1 ELSE 1 END, CASE WHEN held < 16 AND size + r.t <= 4000 THEN size + r.t ELSE r.t END, r.t FROM walk w JOIN r ON r.grp = w.grp AND r.i = w.i + 1)
      SELECT grp, batch, count(*) AS n_inputs, sum(t)::BIGINT AS n_tokens FROM walk GROUP BY grp, batch""",
    "embed_query": f"WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM benchmark), h AS (SELECT item_id, {_MD5} AS h FROM w WHERE word <> ''), u AS (SELECT item_id, h % 64 AS place, 1 AS v FROM h UNION ALL SELECT item_id, (h // 65536) % 64, -1 FROM h), s AS (SELECT item_id, place, sum(v) AS v FROM u GROUP BY item_id, place), c AS (SELECT b.item_id, coalesce(sum(CASE WHEN v > 0 THEN 1::HUGEINT << (63 - place)::INTEGER ELSE 0 END), 0)::UBIGINT AS w FROM benchmark b LEFT JOIN s ON s.item_id = b.item_id GROUP BY b.item_id) SELECT item_id, {_HEX} AS code FROM c",
    "detect_language": f"WITH p AS (SELECT unnest({list(_PATHS)!r}) AS path UNION ALL SELECT url FROM pages), e AS (SELECT path, string_split(path, '.')[-1] AS ext FROM p) SELECT path, {_LANG} AS language FROM e",
    "snippet_start_line": "WITH h AS (SELECT doc_id, substr(hex(encode(text)), 1, 2 * (strlen(text) // 2)) AS h FROM documents) SELECT doc_id, len(list_filter(range(1, len(h) // 2 + 1), lambda i: substr(h, (2 * i - 1)::BIGINT, 2) = '0A'))::BIGINT + 1 AS line FROM h",
    "snippet_numbered": "WITH s AS (SELECT doc_id, ends_with(text, chr(10)) AS e, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(list_transform(l, lambda x, i: lpad((97 + i)::VARCHAR, len((97 + len(l))::VARCHAR)::INTEGER, ' ') || ' | ' || x), chr(10)) || CASE WHEN e THEN chr(10) ELSE '' END AS numbered FROM s",
    "snippet_staleness": f"WITH {_FILES}, {_PIECES}, disk AS (SELECT path, CASE WHEN doc_id % 13 = 2 THEN '# moved' || chr(10) || text ELSE text END AS t FROM files WHERE commit = 'c2') SELECT p.path, p.chunk_index, CASE WHEN t IS NULL THEN 'missing' WHEN substr(hex(encode(t)), 2 * off + 1, 2 * strlen(piece)) = hex(encode(piece)) THEN 'current' WHEN contains(t, piece) THEN 'moved' ELSE 'modified' END AS state FROM pieces p LEFT JOIN disk d ON d.path = p.path WHERE p.commit = 'c1'",
    "status": f"WITH {_HISTORY}, s AS (SELECT count(*) AS layers, sum(bytes)::BIGINT AS bytes, arg_max(substr(commit, 1, 12), mtime) AS latest FROM layers WHERE version = 2) SELECT layers, bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024.0) ELSE printf('%.1f MB', bytes / 1048576.0) END AS size, latest FROM s",
    "gc_plan": f"WITH {_HISTORY}, {_GC} SELECT * FROM plan",
    "gc_orphans": f"WITH {_HISTORY}, {_GC} SELECT l.commit, l.parent FROM layers l JOIN plan p ON p.commit = l.parent AND p.reason = 'commit_gone' WHERE l.commit NOT IN (SELECT commit FROM plan)",
    "expand_alias": f"WITH names(name) AS (VALUES ('both'), ('none'), ('gamma')), {_values('aliases', 'alias, repo', [(a, r) for a, rs in ALIASES for r in rs or [None]])} SELECT name, CASE WHEN alias IS NULL THEN name ELSE repo END AS repo FROM names LEFT JOIN aliases ON alias = name WHERE CASE WHEN alias IS NULL THEN name ELSE repo END IS NOT NULL",
    "rerank_topk": f"WITH {_RANKED} SELECT idx, score FROM ranked",
    "render_results": f"WITH {_RANKED}, {_BASE} SELECT row_number() OVER (ORDER BY score DESC, idx) AS rank, printf('Result %d · %s (0, %d) [score %.4f]', row_number() OVER (ORDER BY score DESC, idx), path, strlen(text), score) AS header FROM ranked JOIN base ON doc_id = idx",
    "rate_window": "WITH e AS (SELECT event_id, epoch_us(ts) AS t, greatest(1, strlen(props) // 4) AS k FROM events) SELECT event_id, (sum(k) OVER w)::BIGINT AS tokens_60s, sum(k) OVER w <= 2800000 AS within_rate FROM e WINDOW w AS (ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)",
}
