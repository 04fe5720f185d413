"""Every query of the core operators over the tables of a data folder, with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import after_first_line, ascii_strip, base_name, chunk_id, extension, folder, line_array, norm, project_id, tokens_about, unit, white_strip
from corvane.operators import cache, changes, context, incremental, ranges, search
from corvane.operators.chunking import chunk_files
from corvane.session import cut_lineage, ensure_checkpoint_dir, table
from corvane.tokens import token_count

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- shared inputs --------------------------------------------------------------------------------

_CHUNK_COLUMNS = ["position", "index_prefix", "repo_path", "text", "level", "file", "folder", "start_line", "end_line", "type", "function_name", "docstring", "chunk_id", "full_code_path"]
CHUNKS_SQL = f"ch as (select distinct {', '.join(_CHUNK_COLUMNS)} from chunks)"
CURRENT_SQL = (
    "cur as (select index_prefix, file_path as file, ext, lang, sha256, code from source_files"
    " qualify row_number() over (partition by index_prefix, file_path order by scanned_at desc nulls last, sha256 desc) = 1)"
)
USABLE_SQL = (
    "v as (select vec_id, chunk_id, e::DOUBLE[] as e, sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])) as n from"
    " (select vec_id, chunk_id, embedding as e from index_vectors where len(embedding) = 64 and list_count(embedding) = 64"
    " and not isnan(list_max(embedding)) and not isinf(list_max(embedding)) and not isinf(list_min(embedding)) and (list_max(embedding) > 0 or list_min(embedding) < 0)))"
)
FULL_SQL = "fc as (select chunk_id, max(content) as content from full_chunks group by chunk_id)"
LAST_SQL = (
    "last as (select index_prefix, file_hashes as h from index_meta where run_status = 'success'"
    " qualify row_number() over (partition by index_prefix order by run_no desc, finished_at desc nulls last) = 1)"
)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").select(*_CHUNK_COLUMNS).distinct()


def _current(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of every file; its text is found by a join, not carried through the aggregation."""
    files = table(spark, sf, "source_files")
    top = files.groupBy("index_prefix", "file_path").agg(F.max(F.struct("scanned_at", "sha256")).alias("top")).select("index_prefix", "file_path", "top.scanned_at", "top.sha256")
    rows = files.join(top, ["index_prefix", "file_path", "scanned_at", "sha256"]).dropDuplicates(["index_prefix", "file_path"])
    return rows.select("index_prefix", F.col("file_path").alias("file"), "ext", "lang", "sha256", "code")


def _query_vector(spark: SparkSession, sf: str) -> DataFrame:
    first = search.usable(table(spark, sf, "index_vectors")).orderBy("vec_id").limit(1)
    return first.select(unit(F.col("embedding")).alias("q"))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(table(spark, sf, "index_vectors"), _query_vector(spark, sf))


def _positioned(df: DataFrame, *order) -> DataFrame:
    """A bounded result (at most the search's k rows) with positions from 0."""
    return df.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    best = search.above(_ranked(spark, sf)).withColumn("score", F.round("raw", 6)).select("vec_id", "score")
    # only the chunks at the at most k positions are compared for copies
    near = table(spark, sf, "chunks").join(F.broadcast(best.select("vec_id")), F.col("vec_id") == F.col("position"), "left_semi")
    rows = F.broadcast(best).join(near.select(*_CHUNK_COLUMNS).distinct(), F.col("vec_id") == F.col("position"))
    return _positioned(rows, F.desc("score"), "vec_id").where(F.col("pos") < context.CANDIDATES)


TOP_SQL = f"""{USABLE_SQL}, q as (select e, n from v order by vec_id limit 1),
top as (select v.vec_id, list_inner_product(v.e, q.e) / (v.n * q.n) as raw from v, q order by round(raw, 6) desc, vec_id limit 20)"""
CAND_SQL = f"""{TOP_SQL}, {CHUNKS_SQL},
cand as (select *, (row_number() over (order by score desc, vec_id) - 1)::INT as pos from
 (select top.vec_id, round(raw, 6) as score, ch.* from top join ch on ch.position = top.vec_id where raw > 0.3) qualify pos < 25)"""


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


# --- vectors --------------------------------------------------------------------------------------

@query("search_topk", f"with {TOP_SQL} select vec_id, round(raw, 6) as score from top")
def _(s, d):
    return _ranked(s, d).select("vec_id", F.round("raw", 6).alias("score"))


@query("index_search", f"with {TOP_SQL} select vec_id, round(raw, 6) as score from top")
def _(s, d):
    """The same from an index that is written and read again."""
    index = search.FlatIndex.build(table(s, d, "index_vectors"), f"{ensure_checkpoint_dir(s).rstrip('/')}/index-{uuid.uuid4().hex}")
    return index.search(_query_vector(s, d)).select("vec_id", F.round("raw", 6).alias("score"))


@query("search_threshold", f"with {TOP_SQL} select vec_id, round(raw, 6) as score from top where raw > 0.3")
def _(s, d):
    return search.above(_ranked(s, d)).select("vec_id", F.round("raw", 6).alias("score"))


@query(
    "search_batch_topk",
    f"""with {USABLE_SQL}, s as (select a.vec_id as query_id, b.vec_id, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) as score
from v a, v b where a.vec_id % 100 = 0) select query_id, vec_id, score, "rank"::INT as "rank" from
(select *, row_number() over (partition by query_id order by score desc, vec_id) as "rank" from s) where "rank" <= 10""",
)
def _(s, d):
    v = table(s, d, "index_vectors")
    queries = search.usable(v).where("pmod(vec_id, 100) = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.batch_top_k(v, queries)


@query("l2_normalize", f"with {USABLE_SQL} select vec_id, round(n, 6) as length, round(e[1] / n, 6) as first, round(e[64] / n, 6) as last from v")
def _(s, d):
    v = search.usable(table(s, d, "index_vectors")).withColumn("u", unit(F.col("embedding")))
    return v.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query("embedding_dim", f"with {USABLE_SQL} select max(len(e))::INT as dim, count(*) as n_vectors, min(len(e)) = max(len(e)) as one_dim from v")
def _(s, d):
    v = search.usable(table(s, d, "index_vectors"))
    return v.agg(F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n_vectors"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("one_dim"))


@query("embedded_only", "select vec_id, chunk_id, len(embedding)::INT as dim from index_vectors where embedding is not null")
def _(s, d):
    return table(s, d, "index_vectors").where("embedding is not null").select("vec_id", "chunk_id", F.size("embedding").alias("dim"))


@query("needs_embedding", f"with {USABLE_SQL}, {CHUNKS_SQL} select position, level, sha256(text) as text_hash from ch where position not in (select vec_id from v)")
def _(s, d):
    return incremental.needs_embedding(_chunks(s, d), search.usable(table(s, d, "index_vectors"))).select("position", "level", F.sha2("text", 256).alias("text_hash"))


@query(
    "embed_hash",
    f"""with {CHUNKS_SQL}, t as (select position, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from ch)
select position, (('0x' || substr(sha256(w), 1, 4))::INT % 64)::INT as bucket, count(*) as n from t group by all""",
)
def _(s, d):
    t = _chunks(s, d).select("position", F.explode(F.expr("regexp_extract_all(lower(text), '[a-z0-9]+', 0)")).alias("w"))
    bucket = F.conv(F.substring(F.sha2("w", 256), 1, 4), 16, 10).cast("int") % 64
    return t.groupBy("position", bucket.alias("bucket")).agg(F.count("*").alias("n"))


# --- scan -----------------------------------------------------------------------------------------

SCAN_SQL = """cfg as (select ignored_dirs, ignored_files, supported_languages from index_config limit 1),
p as (select distinct index_prefix, repo_path, file_path, string_split(file_path, '/') as parts, regexp_extract(file_path, '[^/](\\.[^./]+)$', 1) as suffix from source_files)"""


def _scan(s, d):
    cfg = table(s, d, "index_config").limit(1).select("ignored_dirs", "ignored_files", "supported_languages")
    p = table(s, d, "source_files").select("index_prefix", "repo_path", "file_path").distinct()
    p = p.withColumn("parts", F.split("file_path", "/")).withColumn("suffix", extension(F.col("file_path")))
    return p.crossJoin(F.broadcast(cfg))  # one row of settings


@query(
    "scan_supported",
    f"""with {SCAN_SQL} select index_prefix, file_path, suffix from p, cfg where not list_has_any(parts[:-2], ignored_dirs)
and not list_contains(ignored_files, parts[-1]) and list_contains(map_keys(supported_languages), suffix)""",
)
def _(s, d):
    p = _scan(s, d)
    keep = (
        ~F.arrays_overlap(F.expr("slice(parts, 1, size(parts) - 1)"), "ignored_dirs")
        & ~F.array_contains(F.col("ignored_files"), F.element_at("parts", -1))
        & F.array_contains(F.map_keys("supported_languages"), F.col("suffix"))
    )
    return p.where(keep).select("index_prefix", "file_path", "suffix")


@query("lang_lookup", f"with {SCAN_SQL} select index_prefix, file_path, supported_languages[suffix] as language from p, cfg")
def _(s, d):
    return _scan(s, d).select("index_prefix", "file_path", F.try_element_at("supported_languages", F.col("suffix")).alias("language"))


@query("relative_path", "select distinct index_prefix, file_path, regexp_replace(repo_path || '/' || file_path, '^' || regexp_escape(repo_path) || '/', '') as relative from source_files")
def _(s, d):
    full = F.concat("repo_path", F.lit("/"), "file_path")
    return table(s, d, "source_files").select("index_prefix", "file_path", F.when(F.startswith(full, F.concat("repo_path", F.lit("/"))), F.expr("substring(concat(repo_path, '/', file_path), length(repo_path) + 2)")).alias("relative")).distinct()


@query("content_hash", "select index_prefix, file_path, sha256(code) as hash, sha256(code) = sha256 as recorded, count(*) as n_scans from source_files group by all")
def _(s, d):
    h = F.sha2(F.col("code"), 256)
    return table(s, d, "source_files").groupBy("index_prefix", "file_path", h.alias("hash"), (h == F.col("sha256")).alias("recorded")).agg(F.count("*").alias("n_scans"))


# --- lines and ranges -----------------------------------------------------------------------------

RANGES_SQL = f"""{CURRENT_SQL}, tot as (select index_prefix, file, len(string_split(code, chr(10)))::INT as total_lines from cur where code is not null),
r as (select distinct index_prefix, file_path as file, start_line, end_line from function_metadata where node_type <> 'gap_window'),
isl as (select *, sum(case when prev is null or start_line > prev + 1 then 1 else 0 end) over (partition by index_prefix, file order by start_line, end_line) as island from
 (select *, max(end_line) over (partition by index_prefix, file order by start_line, end_line rows between unbounded preceding and 1 preceding) as prev from r)),
m as (select index_prefix, file, min(start_line) as start_line, max(end_line) as end_line from isl group by index_prefix, file, island),
g as (select index_prefix, file, coalesce(max(end_line) over (partition by index_prefix, file order by start_line, end_line rows between unbounded preceding and 1 preceding), 0) + 1 as gap_start, start_line - 1 as gap_end from
 (select index_prefix, file, start_line, end_line from m join tot using (index_prefix, file) where start_line <= total_lines union all select index_prefix, file, total_lines + 1, total_lines + 1 from tot)
 qualify gap_start <= gap_end),
w as (select index_prefix, file, s::INT as start_line, least(s + 49, gap_end)::INT as end_line from (select *, unnest(generate_series(gap_start, gap_end, 50)) as s from g))"""
_KEYS = ["index_prefix", "file"]


def _function_ranges(s, d):
    return table(s, d, "function_metadata").where("node_type <> 'gap_window'").select("index_prefix", F.col("file_path").alias("file"), "start_line", "end_line")


def _totals(s, d):
    return _current(s, d).where("code is not null").select(*_KEYS, F.size(line_array(F.col("code"))).alias("total_lines"))


def _gaps(s, d):
    return ranges.complement(ranges.merged(_function_ranges(s, d), _KEYS), _totals(s, d), _KEYS)


@query("doc_lines", "select doc_id, (i - 1)::INT as line_no, l[i] as line from (select doc_id, string_split(text, chr(10)) as l, unnest(generate_series(1, len(string_split(text, chr(10))))) as i from documents)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(line_array(F.col("text"))).alias("line_no", "line"))


@query("merge_ranges", f"with {RANGES_SQL} select index_prefix, file, start_line, end_line from m")
def _(s, d):
    return ranges.merged(_function_ranges(s, d), _KEYS)


@query("gap_ranges", f"with {RANGES_SQL} select index_prefix, file, gap_start::INT as gap_start, gap_end::INT as gap_end from g")
def _(s, d):
    return _gaps(s, d)


@query(
    "gap_windows",
    f"""with {RANGES_SQL}, t as (select w.*, array_to_string(string_split(code, chr(10))[start_line:end_line], chr(10)) as text from w join cur using (index_prefix, file))
select index_prefix, file, start_line, end_line, sha256(text) as text_hash from t
where length(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')) > 0""",
)
def _(s, d):
    spans = ranges.windows(_gaps(s, d), _KEYS)
    return ranges.window_text(spans, _current(s, d), _KEYS).select(*_KEYS, "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))


W_SQL = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query("min_chunk_filter", f"select distinct chunk_id, sha256(content) as content_hash from full_chunks where length(regexp_replace(content, '^{W_SQL}+|{W_SQL}+$', '', 'g')) >= 20")
def _(s, d):
    return table(s, d, "full_chunks").where(F.length(white_strip(F.col("content"))) >= 20).select("chunk_id", F.sha2("content", 256).alias("content_hash")).distinct()


@query("chunk_source")
def _(s, d):
    cur = _current(s, d).where("code is not null")
    return chunk_files(cur.select("index_prefix", "file", "lang", "code"))


# --- derivations ----------------------------------------------------------------------------------

@query(
    "chunk_ids",
    f"""with {CHUNKS_SQL} select position, substr(sha256(concat_ws(':', file, start_line::VARCHAR, end_line::VARCHAR)), 1, 16) as made_id, substr(sha256(repo_path), 1, 16) as project,
'full_chunks/' || substr(sha256(concat_ws(':', file, start_line::VARCHAR, end_line::VARCHAR)), 1, 16) || regexp_extract(file, '[^/](\\.[^./]+)$', 1) as made_path from ch where level = 'code_chunk'""",
)
def _(s, d):
    c = _chunks(s, d).where("level = 'code_chunk'")
    made = chunk_id(F.col("file"), F.col("start_line"), F.col("end_line"))
    return c.select("position", made.alias("made_id"), project_id(F.col("repo_path")).alias("project"), F.concat(F.lit("full_chunks/"), made, extension(F.col("file"))).alias("made_path"))


@query(
    "metadata_text",
    f"""with {CHUNKS_SQL} select position, concat_ws(chr(10), case when function_name is not null and function_name <> 'unknown' then 'Function: ' || function_name end, 'File: ' || file,
'Lines: ' || start_line || '-' || end_line, case when type <> '' then 'Type: ' || type end, case when docstring <> '' then 'Documentation: ' || docstring end) as made from ch where level = 'code_chunk'""",
)
def _(s, d):
    return _chunks(s, d).where("level = 'code_chunk'").select("position", context.metadata_text().alias("made"))


@query(
    "doc_chunks",
    f"""with {CURRENT_SQL}, m as (select *, substr(sha256(concat_ws(':', file, '1', len(string_split(code, chr(10)))::VARCHAR)), 1, 16) as cid from cur where lang = 'markdown' and code is not null)
select index_prefix, file, cid as chunk_id, 'full_chunks/' || cid || '.md' as full_code_path, sha256('DOCUMENT: ' || file || chr(10) || chr(10) || code) as text_hash from m""",
)
def _(s, d):
    m = context.document_chunks(_current(s, d).where("lang = 'markdown' and code is not null"))
    return m.select("index_prefix", "file", "chunk_id", "full_code_path", F.sha2("text", 256).alias("text_hash"))


# --- summaries ------------------------------------------------------------------------------------

@query("file_summary_candidates", f"with {CURRENT_SQL} select index_prefix, file, length(code)::INT as n_chars from cur where length(code) > 100")
def _(s, d):
    return context.summary_inputs(_current(s, d)).select("index_prefix", "file", F.length("code").alias("n_chars"))


@query("file_summary_input", f"with {CURRENT_SQL} select index_prefix, file, ext, sha256(substr(code, 1, 3500)) as input_hash from cur where length(code) > 100")
def _(s, d):
    return context.summary_inputs(_current(s, d)).select("index_prefix", "file", "ext", F.sha2("prompt_text", 256).alias("input_hash"))


SUMMARIES_SQL = f"{CHUNKS_SQL}, sm as (select index_prefix, file, min(substr(text, instr(text, chr(10)) + 1)) as summary from ch where level = 'file_summary' group by all)"


def _summaries(s, d):
    c = _chunks(s, d).where("level = 'file_summary'")
    return c.groupBy("index_prefix", "file").agg(F.min(F.expr("substring(text, instr(text, '\\n') + 1)")).alias("summary"))


@query("file_summaries", f"with {SUMMARIES_SQL} select index_prefix, file, 'FILE: ' || file || chr(10) || summary as text from sm")
def _(s, d):
    return _summaries(s, d).select("index_prefix", "file", F.concat(F.lit("FILE: "), "file", F.lit("\n"), "summary").alias("text"))


FOLDER_SQL = "coalesce(nullif(regexp_extract(file, '^(.*)/[^/]+$', 1), ''), '.')"


@query("folder_groups", f"with {SUMMARIES_SQL} select index_prefix, folder, count(*) as n_files from (select index_prefix, {FOLDER_SQL} as folder from sm) where folder <> '.' group by all")
def _(s, d):
    f = _summaries(s, d).withColumn("folder", folder(F.col("file"))).where("folder <> '.'")
    return f.groupBy("index_prefix", "folder").agg(F.count("*").alias("n_files"))


FOLDERS_SQL = f"""{SUMMARIES_SQL}, fl as (select index_prefix, folder, string_agg('- ' || regexp_extract(file, '[^/]+$') || ': ' || coalesce(summary, ''), chr(10) order by file) as lines, count(*)::INT as n_used from
 (select *, {FOLDER_SQL} as folder from sm qualify row_number() over (partition by index_prefix, folder order by file) <= 8) where folder <> '.' group by all)"""


@query("folder_summary_input", f"with {FOLDERS_SQL} select index_prefix, folder, n_used, lines from fl")
def _(s, d):
    return context.folder_lines(_summaries(s, d), ["index_prefix"])


@query("folder_summaries", f"with {FOLDERS_SQL} select index_prefix, folder, 'FOLDER: ' || folder || chr(10) || substr(lines, 1, 200) as text from fl")
def _(s, d):
    f = context.folder_lines(_summaries(s, d), ["index_prefix"])
    return f.select("index_prefix", "folder", F.concat(F.lit("FOLDER: "), "folder", F.lit("\n"), F.substring("lines", 1, 200)).alias("text"))


# --- incremental ----------------------------------------------------------------------------------

PLAIN_SQL = "trim(regexp_replace(regexp_replace(replace({}, '\\', '/'), '/{{2,}}', '/', 'g'), '(^|/)(?:\\./)+', '\\1', 'g'))"
DIFF_SQL = f"""{CURRENT_SQL}, {LAST_SQL}, o as (select index_prefix, {PLAIN_SQL.format("k")} as file, max(lower(trim(hv))) as hash from
 (select index_prefix, unnest(map_keys(h)) as k, unnest(map_values(h)) as hv from last) group by all),
n as (select index_prefix, {PLAIN_SQL.format("file")} as file, max(lower(trim(sha256))) as hash from cur group by all),
df as (select coalesce(o.index_prefix, n.index_prefix) as index_prefix, coalesce(o.file, n.file) as file,
 case when o.file is null then 'added' when n.file is null then 'deleted' when o.hash = n.hash then 'unchanged' else 'modified' end as status from o full join n on o.index_prefix = n.index_prefix and o.file = n.file)"""


def _diff(s, d):
    old = changes.last_manifest(table(s, d, "index_meta")).groupBy("index_prefix", F.col("path").alias("file")).agg(F.max("hash").alias("hash"))
    new = changes.current_scan(table(s, d, "source_files"))
    new = new.groupBy("index_prefix", changes.plain_path(F.col("file_path")).alias("file")).agg(F.max(changes.plain_hash(F.col("sha256"))).alias("hash"))
    return incremental.classified(old, new)


@query(
    "p4_found",
    f"""with {CURRENT_SQL}, {LAST_SQL}, o as (select distinct index_prefix, {PLAIN_SQL.format("k")} as path, lower(trim(hv)) as hash from
 (select index_prefix, unnest(map_keys(h)) as k, unnest(map_values(h)) as hv from last)),
n as (select index_prefix, file as file_path, {PLAIN_SQL.format("file")} as path, lower(trim(sha256)) as hash from cur)
select index_prefix, file_path from n where not list_has_any(string_split(path, '/')[:-2], (select ignored_dirs from index_config limit 1))
and not exists (select 1 from o where o.index_prefix = n.index_prefix and o.path = n.path and o.hash = n.hash)""",
)
def _(s, d):
    return changes.changed_files(table(s, d, "source_files"), table(s, d, "index_meta"), table(s, d, "index_config"))


ENTRIES_SQL = f"""{CURRENT_SQL}, {LAST_SQL}, o as (select distinct index_prefix, {PLAIN_SQL.format("k")} as path, lower(trim(hv)) as hash from
 (select index_prefix, unnest(map_keys(h)) as k, unnest(map_values(h)) as hv from last)),
n as (select * from (select index_prefix, {PLAIN_SQL.format("file")} as path, lower(trim(sha256)) as hash from cur)
 where not list_has_any(string_split(path, '/')[:-2], (select ignored_dirs from index_config limit 1)))"""


@query(
    "p4_delta",
    f"""with {ENTRIES_SQL} select index_prefix, 'insert' as change, count(*) as n_entries from n where not exists
 (select 1 from o where o.index_prefix = n.index_prefix and o.path = n.path and o.hash = n.hash) group by index_prefix
union all select index_prefix, 'delete', count(*) from o where not exists
 (select 1 from n where o.index_prefix = n.index_prefix and o.path = n.path and o.hash = n.hash) group by index_prefix""",
)
def _(s, d):
    return changes.entry_delta(table(s, d, "source_files"), table(s, d, "index_meta"), table(s, d, "index_config"))


@query("p4_processed", f"with {ENTRIES_SQL} select index_prefix, path, hash from n")
def _(s, d):
    return changes.processed_entries(table(s, d, "source_files"), table(s, d, "index_meta"), table(s, d, "index_config"))


@query("incr_diff", f"with {DIFF_SQL} select index_prefix, file, status from df")
def _(s, d):
    return _diff(s, d)


@query("diff_counts", f"with {DIFF_SQL} select status, count(*) as n_files from df group by status")
def _(s, d):
    return _diff(s, d).groupBy("status").agg(F.count("*").alias("n_files"))


KEPT_SQL = f"""{DIFF_SQL}, {CHUNKS_SQL}, kept as (select * from ch where level <> 'folder_summary' and not exists
 (select 1 from df where status in ('modified', 'deleted') and df.index_prefix = ch.index_prefix and df.file = ch.file))"""


@query("kept_chunks", f"with {KEPT_SQL} select position, level from kept")
def _(s, d):
    return incremental.kept_chunks(_chunks(s, d), _diff(s, d)).select("position", "level")


KEPT_SUMMARIES_SQL = f"{KEPT_SQL}, ks as (select index_prefix, file, min(case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end) as summary from kept where level = 'file_summary' group by all)"


def _kept_summaries(s, d):
    k = incremental.kept_summaries(incremental.kept_chunks(_chunks(s, d), _diff(s, d)))
    return k.groupBy("index_prefix", "file").agg(F.min("summary").alias("summary"))


@query("kept_summaries", f"with {KEPT_SUMMARIES_SQL} select index_prefix, file, summary from ks")
def _(s, d):
    return _kept_summaries(s, d)


NEW_SQL = f"""{KEPT_SUMMARIES_SQL}, ns as (select df.index_prefix, df.file, min(substr(cur.code, 1, 80)) as summary from df join cur on cur.index_prefix = df.index_prefix and {PLAIN_SQL.format("cur.file")} = df.file
 where status in ('added', 'modified') and length(cur.code) > 100 group by all)"""


def _new_summaries(s, d):
    todo = _diff(s, d).where("status in ('added', 'modified')").select("index_prefix", "file")
    cur = _current(s, d).withColumn("file", changes.plain_path(F.col("file")))
    made = context.summary_inputs(cur).join(todo, ["index_prefix", "file"])
    return made.groupBy("index_prefix", "file").agg(F.min(F.substring("code", 1, 80)).alias("summary"))


@query("merge_summaries", f"with {NEW_SQL} select * from ns union all select * from ks where not exists (select 1 from ns where ns.index_prefix = ks.index_prefix and ns.file = ks.file)")
def _(s, d):
    return incremental.merged_summaries(_kept_summaries(s, d), _new_summaries(s, d))


@query(
    "combined_index",
    f"""with {NEW_SQL} select index_prefix, level, file, count(*) as n from (select index_prefix, level, file from kept union all select index_prefix, 'file_summary', file from ns) group by all""",
)
def _(s, d):
    kept = incremental.kept_chunks(_chunks(s, d), _diff(s, d))
    new = _new_summaries(s, d).select("index_prefix", F.lit("file_summary").alias("level"), "file")
    return incremental.combined(kept, new).groupBy("index_prefix", "level", "file").agg(F.count("*").alias("n"))


# --- reranking, budgets, rendering ----------------------------------------------------------------

HEADER_SQL = """case level when 'code_chunk' then 'Code ' || coalesce(function_name, 'unknown') || ' in ' || file || ':' || start_line || '-' || end_line
 when 'file_summary' then 'File ' || file when 'folder_summary' then 'Folder ' || folder when 'document' then 'Document ' || file else 'Chunk' end"""


@query("rerank_candidates", f"with {CAND_SQL} select pos, vec_id, score, level from cand")
def _(s, d):
    return _candidates(s, d).select("pos", "vec_id", "score", "level")


@query("rerank_headers", f"with {CAND_SQL} select pos, {HEADER_SQL} as header from cand")
def _(s, d):
    return _candidates(s, d).select("pos", context.rerank_header().alias("header"))


RANKING_SQL = f"{CAND_SQL}, rk as (select (length(text) % 23)::INT as response_pos, pos, round(length(text) % 11 / 2.0, 1)::DOUBLE as given from cand where pos % 3 <> 2)"


def _scored(cand: DataFrame) -> DataFrame:
    """Candidates beside a stand-in for a model's partial reply: scores by length, a third of the candidates left out."""
    return cand.where("pos % 3 <> 2").withColumn("response_pos", F.length("text") % 23).withColumn("given", F.round((F.length("text") % 11) / 2.0, 1))


def _ranking(cand: DataFrame) -> DataFrame:
    return _scored(cand).select("response_pos", "pos", F.col("given").alias("score"))


@query("rerank_apply", f"with {RANKING_SQL} select cand.pos, vec_id, given as score from cand join rk using (pos)")
def _(s, d):
    c = _candidates(s, d)
    return c.drop("score").join(_ranking(c), "pos").select("pos", "vec_id", "score")


@query("rerank_default", f"with {CAND_SQL} select pos as response_pos, pos, 5.0::DOUBLE as score from cand")
def _(s, d):
    return context.default_ranking(_candidates(s, d))


@query("rerank_topk", f"with {RANKING_SQL} select cand.pos, vec_id, given as score from cand join rk using (pos) order by given desc, response_pos, cand.pos limit 5")
def _(s, d):
    c = _candidates(s, d)
    joined = c.drop("score").join(_ranking(c), "pos")
    return joined.orderBy(F.desc("score"), "response_pos", "pos").limit(5).select("pos", "vec_id", "score")


@query("token_counts_bpe")
def _(s, d):
    """Tokens under the public vocabulary; SQL has no byte-pair encoding, a test compares with another library's encoder."""
    return table(s, d, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))


@query("token_counts", "select doc_id, ceil(length(text) / 4.0)::BIGINT as n_tokens from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tokens_about(F.col("text")).alias("n_tokens"))


CUT_SQL = "case when length(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g')) > 1500 then substr(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'), 1, 1500) || chr(10) || '... (truncated)' else regexp_replace(content, '[^\\x00-\\x7F]', '', 'g') end"
BLOCK_SQL = f"""case level when 'code_chunk' then {HEADER_SQL} || chr(10) || coalesce({CUT_SQL}, '(Code not available)')
 when 'document' then {HEADER_SQL} || chr(10) || coalesce({CUT_SQL}, substr(text, 1, 500)) when 'file_summary' then {HEADER_SQL} || chr(10) || text
 when 'folder_summary' then {HEADER_SQL} || chr(10) || text else substr(text, 1, 200) || '...' end"""


@query("refine_blocks", f"with {CHUNKS_SQL}, {FULL_SQL} select position, sha256({BLOCK_SQL}) as block_hash from ch left join fc using (chunk_id)")
def _(s, d):
    return context.with_code(_chunks(s, d), table(s, d, "full_chunks")).select("position", F.sha2(context.refinement_block(), 256).alias("block_hash"))


BUDGET_SQL = f"""{CHUNKS_SQL}, {FULL_SQL}, bl as (select index_prefix, file, position as pos, ceil(length({BLOCK_SQL}) / 4.0)::BIGINT as n_tokens from ch left join fc using (chunk_id) where file is not null)"""


def _blocks(s, d):
    b = context.with_code(_chunks(s, d).where("file is not null"), table(s, d, "full_chunks"))
    return context.block_tokens(b.withColumn("block", context.refinement_block())).select("index_prefix", "file", F.col("position").alias("pos"), "n_tokens")


@query("prompt_budget", f"with {BUDGET_SQL} select index_prefix, file, pos, used::BIGINT as used from (select *, sum(n_tokens) over (partition by index_prefix, file order by pos) as used from bl) where used <= 1000")
def _(s, d):
    return context.prefix_within(_blocks(s, d), _KEYS, 1000).select("index_prefix", "file", "pos", "used")


@query("output_budget", f"with {BUDGET_SQL} select index_prefix, file, max(pos) as last_pos, count(*) as n_sections from (select *, sum(n_tokens) over (partition by index_prefix, file order by pos) as used from bl) where used <= 300 group by all")
def _(s, d):
    fit = context.prefix_within(_blocks(s, d), _KEYS, 300)
    return fit.groupBy("index_prefix", "file").agg(F.max("pos").alias("last_pos"), F.count("*").alias("n_sections"))


LATE_SQL = "case when chunk_id is null then '[Content not available]' else coalesce(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g'), '[Chunk ' || chunk_id || ' not found]') end"
SECTION_SQL = f"""case level when 'code_chunk' then '### ' || file || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || chr(10) || '```' || chr(10) || {LATE_SQL} || chr(10) || '```'
 when 'document' then '### ' || file || chr(10) || chr(10) || {LATE_SQL} when 'file_summary' then '### ' || file || chr(10) || chr(10) || text
 when 'folder_summary' then '### ' || folder || '/' || chr(10) || chr(10) || text else '**' || text || '**' end"""


@query("late_code_lookup", f"with {CHUNKS_SQL}, {FULL_SQL} select position, sha256({LATE_SQL}) as content_hash from ch left join fc using (chunk_id)")
def _(s, d):
    return context.with_code(_chunks(s, d), table(s, d, "full_chunks")).select("position", F.sha2(context.late_content(), 256).alias("content_hash"))


@query("render_sections", f"with {CAND_SQL}, {FULL_SQL} select string_agg({SECTION_SQL}, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos) as context from cand left join fc using (chunk_id)")
def _(s, d):
    rows = context.with_code(_candidates(s, d), table(s, d, "full_chunks"))
    return context.joined_sections(rows.select("pos", context.section().alias("section")), [])


@query(
    "retrieve_context",
    f"""with {RANKING_SQL}, {FULL_SQL}, five as (select cand.*, given, (row_number() over (order by given desc, response_pos, cand.pos) - 1)::INT as place from cand join rk using (pos) qualify place < 5),
se as (select place, vec_id, score, given, {SECTION_SQL} as section from five left join fc using (chunk_id)),
fit as (select *, sum(ceil(length(section) / 4.0)) over (order by place) as used from se)
select place as pos, vec_id, score, given, section from fit where used <= 4000""",
)
def _(s, d):
    """Search, threshold, 25 candidates, ranking, the best five, code behind their ids, the longest prefix within the budget."""
    c = _candidates(s, d)
    ranked = _scored(c).orderBy(F.desc("given"), "response_pos", "pos").limit(5)
    five = cut_lineage(ranked).withColumn("place", (F.row_number().over(Window.orderBy(F.desc("given"), "response_pos", "pos")) - 1).cast("int")).drop("pos", "response_pos")
    full = table(s, d, "full_chunks").join(F.broadcast(five.select("chunk_id").where("chunk_id is not null").distinct()), "chunk_id", "left_semi")  # at most five ids
    rows = context.with_code(five, full).withColumn("block", context.section()).withColumnRenamed("place", "pos")
    fit = context.prefix_within(context.block_tokens(rows), [], 4000)
    return fit.select("pos", "vec_id", "score", "given", F.col("block").alias("section"))


# --- cache ----------------------------------------------------------------------------------------

OPS_SQL = "ops as (select user_id as key, epoch(date_trunc('second', ts))::BIGINT as at_s, event_id as seq, event_type = 'purchase' as is_set, event_id::VARCHAR as value from events where event_type in ('purchase', 'view'))"


def _ops(s, d):
    e = table(s, d, "events").where("event_type in ('purchase', 'view')")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("key"), at.alias("at_s"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_set"), F.col("event_id").cast("string").alias("value"))


def _entries(s, d):
    sets = _ops(s, d).where("is_set").select("key", "value", F.col("at_s").alias("set_at"), (F.col("at_s") + cache.TTL).alias("expires_at"), "seq")
    return cache.latest(sets, "seq")


LATEST_SQL = f"{OPS_SQL}, le as (select key, value, at_s + 86400 as expires_at from ops where is_set qualify row_number() over (partition by key order by at_s desc, seq desc) = 1)"


@query("cache_latest", f"with {LATEST_SQL} select key, value, expires_at from le")
def _(s, d):
    return _entries(s, d)


@query("cache_live", f"with {LATEST_SQL} select key, value, expires_at from le where expires_at >= (select max(at_s) from ops)")
def _(s, d):
    now = _ops(s, d).agg(F.max("at_s").alias("now"))
    return cache.live(_entries(s, d).crossJoin(F.broadcast(now)), F.col("now")).drop("now")  # one row


@query(
    "cache_asof",
    f"""with {OPS_SQL}, a as (select *, last_value(case when is_set then struct_pack(at_s := at_s, value := value, seq := seq) end ignore nulls) over
 (partition by key order by at_s, seq rows between unbounded preceding and 1 preceding) as l from ops)
select key, at_s, seq, case when at_s <= l.at_s + 86400 then l.value end as value, l.seq as set_seq from a where not is_set""",
)
def _(s, d):
    return cache.as_of(_ops(s, d))


@query("cache_key", f"with {CAND_SQL} select 'context_cache:' || sha256('where is the lock taken' || (select string_agg(substr(text, 1, 100), '|' order by pos) from cand where pos < 5)) as key")
def _(s, d):
    texts = _candidates(s, d).where("pos < 5").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return texts.select(cache.context_key(F.lit("where is the lock taken"), F.col("t.text")).alias("key"))


# --- inspection -----------------------------------------------------------------------------------

@query("inspect_levels", f"with {CHUNKS_SQL} select coalesce(level, 'unknown') as level, count(*) as n_chunks, count(distinct file) as n_files from ch group by 1")
def _(s, d):
    return _chunks(s, d).groupBy(F.coalesce("level", F.lit("unknown")).alias("level")).agg(F.count("*").alias("n_chunks"), F.countDistinct("file").alias("n_files"))


@query("ascii_strip", "select doc_id, sha256(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) as text_hash from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(ascii_strip(F.col("text")), 256).alias("text_hash"))


@query("basename_and_summary", f"with {CHUNKS_SQL} select position, regexp_extract(file, '[^/]+$') as name, case when instr(text, chr(10)) > 0 then substr(text, instr(text, chr(10)) + 1) else '' end as summary from ch where level = 'file_summary'")
def _(s, d):
    return _chunks(s, d).where("level = 'file_summary'").select("position", base_name(F.col("file")).alias("name"), after_first_line(F.col("text")).alias("summary"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
