"""Queries of extraction, change detection, graph building and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.scalars import norm_path
from ..operators import build as B
from ..operators import export, incremental
from ..operators import graph as G
from ..sources import extraction
from ..sources.code import EXTENSIONS
from ..sources.tables import table
from . import graph as GP
from .records import _ms
from .registry import Registry

R = Registry()

BS = "chr(92)"
_PATHS = f"p AS (SELECT DISTINCT replace(file_path, {BS}, '/') file_path FROM file_manifest)"
_EXT = r"lower(regexp_extract(file_path, '[^/]\.([^./]+)$', 1))"


def _list(xs):
    return ", ".join(f"'{x}'" for x in xs)


_TYPE = "CASE " + " ".join(f"WHEN {_EXT} IN ({_list(v)}) THEN '{k}'" for k, v in X.FILE_TYPES.items()) + " END"
_LANG = "CASE " + " ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " END"


def _paths(spark, d):
    return table(spark, d, "file_manifest", "file_path").select(norm_path("file_path").alias("file_path")).distinct()


@R.query("classify_files", f"WITH {_PATHS} SELECT file_path, {_TYPE} AS file_type FROM p")
def classify_files(spark, d):
    return _paths(spark, d).select("file_path", X.file_type("file_path").alias("file_type"))


@R.query("language_map", f"WITH {_PATHS} SELECT file_path, {_LANG} AS language FROM p")
def language_map(spark, d):
    return _paths(spark, d).select("file_path", X.language("file_path").alias("language"))


@R.query("content_hash", "SELECT DISTINCT file_path, sha256(content) AS sha, sha256(content) = lower(content_hash) AS same FROM file_contents")
def content_hash(spark, d):
    c = table(spark, d, "file_contents", "file_path", "content", "content_hash")
    sha = F.sha2(F.col("content").cast("binary"), 256)
    return c.select("file_path", sha.alias("sha"), (sha == F.lower("content_hash")).alias("same")).distinct()


@R.query(
    "size_guard",
    f"""WITH p AS (SELECT replace(file_path, {BS}, '/') file_path, size_bytes FROM file_manifest)
SELECT DISTINCT file_path, size_bytes, CASE WHEN size_bytes > {X.MAX_BINARY} OR ({_TYPE} IN ('code', 'document') AND size_bytes > {X.MAX_TEXT}) THEN 'too_large' ELSE 'ok' END AS verdict FROM p""",
)
def size_guard(spark, d):
    m = table(spark, d, "file_manifest", "file_path", "size_bytes").select(norm_path("file_path").alias("file_path"), "size_bytes")
    return m.select("file_path", "size_bytes", X.size_verdict("file_path", "size_bytes").alias("verdict")).distinct()


_NOW = f"""cur AS (SELECT replace(file_path, {BS}, '/') file_path, lower(trim(content_hash)) content_hash, file_type FROM file_manifest
    QUALIFY row_number() OVER (PARTITION BY replace(file_path, {BS}, '/') ORDER BY coalesce({_ms('last_seen_at')}, -1) DESC, lower(trim(content_hash)) DESC, file_type DESC) = 1),
  old AS (SELECT replace(file_path, {BS}, '/') file_path, lower(trim(content_hash)) content_hash, nodes FROM extraction_cache
    QUALIFY row_number() OVER (PARTITION BY replace(file_path, {BS}, '/') ORDER BY {_ms('extracted_at')} DESC, lower(trim(content_hash)) DESC, nodes DESC) = 1)"""


def _now(spark, d):
    return incremental.current_files(table(spark, d, "file_manifest", "file_path", "content_hash", "file_type", "last_seen_at")).select("file_path", "content_hash", "file_type")


def _cached(spark, d):
    from ..functions.scalars import instant_ms

    c = table(spark, d, "extraction_cache", "file_path", "content_hash", "nodes", "extracted_at").select(
        norm_path("file_path").alias("file_path"), F.lower(F.trim("content_hash")).alias("content_hash"), "nodes", instant_ms("extracted_at").alias("t")
    )
    return incremental.latest(c, "file_path", F.col("t"), "content_hash", "nodes").drop("_o")


@R.query(
    "manifest_cdc",
    f"""WITH {_NOW} SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'new' WHEN b.file_path IS NULL THEN 'removed'
  WHEN a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM old a FULL JOIN cur b ON a.file_path = b.file_path""",
)
def manifest_cdc(spark, d):
    return B.changes(_cached(spark, d), _now(spark, d))


@R.query(
    "manifest_upsert",
    f"WITH {_NOW} SELECT file_path, content_hash FROM cur UNION ALL SELECT file_path, content_hash FROM old WHERE file_path NOT IN (SELECT file_path FROM cur)",
)
def manifest_upsert(spark, d):
    return B.upsert(_cached(spark, d).drop("nodes"), _now(spark, d).drop("file_type"), "file_path")


@R.query(
    "cache_hits_misses",
    f"WITH {_NOW} SELECT file_path, content_hash, (file_path, content_hash) IN (SELECT file_path, content_hash FROM old) AS hit FROM cur",
)
def cache_hits_misses(spark, d):
    return B.cache_probe(_now(spark, d).drop("file_type"), _cached(spark, d))


_GONE = f"gone AS (SELECT DISTINCT source_file file_path FROM n WHERE source_file <> '' AND source_file NOT IN (SELECT replace(file_path, {BS}, '/') FROM file_manifest WHERE file_path IS NOT NULL))"


@R.query(
    "removed_cleanup",
    f"""WITH {GP.N}, {GP.E}, {_GONE}, x AS (SELECT * REPLACE (replace(source_file, {BS}, '/') AS source_file) FROM e),
  l AS (SELECT id FROM n WHERE source_file IN (SELECT file_path FROM gone))
SELECT 'node' AS kind, id FROM n WHERE source_file NOT IN (SELECT file_path FROM gone)
UNION ALL SELECT 'edge', id::VARCHAR FROM x WHERE source_file NOT IN (SELECT file_path FROM gone) AND source NOT IN (SELECT id FROM l) AND target NOT IN (SELECT id FROM l)""",
)
def removed_cleanup(spark, d):
    """What stays after the files that the manifest no longer knows are removed."""
    n, e = GP.nodes(spark, d), GP.edges(spark, d).withColumn("source_file", norm_path("source_file"))
    gone = n.where("source_file <> ''").select(F.col("source_file").alias("file_path")).distinct().join(_paths(spark, d), "file_path", "left_anti")
    n, e = B.drop_files(n, e, gone)
    return n.select(F.lit("node").alias("kind"), "id").unionByName(e.select(F.lit("edge").alias("kind"), F.col("id").cast("string").alias("id")))


_ITEM = "array<struct<id:string,label:string,source_line:int>>"


@R.query(
    "replace_by_file",
    f"""WITH {GP.N}, {_NOW}, j AS (SELECT file_path, unnest(from_json(nodes, '[{{"id":"VARCHAR","label":"VARCHAR","source_line":"INTEGER"}}]')) x FROM old),
  b AS (SELECT x.id id, x.label label, file_path source_file, x.source_line source_line FROM j),
  keep AS (SELECT id, label, source_file, source_line, file_type FROM n WHERE source_file NOT IN (SELECT source_file FROM b)),
  fresh AS (SELECT id, label, source_file, source_line, 'code' file_type FROM b WHERE id NOT IN (SELECT id FROM keep WHERE file_type <> 'stub')
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_file, source_line NULLS FIRST, label) = 1)
SELECT * FROM keep WHERE file_type <> 'stub' UNION ALL SELECT * FROM keep WHERE file_type = 'stub' AND id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def replace_by_file(spark, d):
    batch = _cached(spark, d).select("file_path", F.explode(F.from_json("nodes", _ITEM)).alias("x")).select("x.id", "x.label", F.col("file_path").alias("source_file"), "x.source_line")
    return B.replace_by_file(GP.nodes(spark, d), batch)


@R.query(
    "dedup_first_wins",
    "SELECT id, label, file_type FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at, label, file_type) = 1",
)
def dedup_first_wins(spark, d):
    n = table(spark, d, "nodes", "id", "label", "file_type", "loaded_at").where("id is not null")
    return B.first_wins(n, "id", "loaded_at", "label", "file_type").select("id", "label", "file_type")


_NODE_TYPE = "CASE WHEN file_type = 'rationale' THEN 'rationale' WHEN label LIKE '%()' THEN 'function' WHEN file_type = 'stub' THEN 'concept' ELSE 'file' END"


@R.query(
    "file_type_case",
    f"""WITH x AS (SELECT DISTINCT id, {_NODE_TYPE} t, CASE WHEN lower(source_file) LIKE '%.md' OR lower(source_file) LIKE '%.mdx' THEN 'markdown' ELSE 'other' END l FROM nodes)
SELECT id, CASE WHEN t IN ('rationale', 'concept', 'entity', 'pattern', 'module') THEN t WHEN l = 'markdown' THEN 'document' ELSE 'code' END AS stored_type FROM x""",
)
def file_type_case(spark, d):
    n = table(spark, d, "nodes", "id", "label", "file_type", "source_file")
    t = F.expr(_NODE_TYPE)
    lang = F.when(F.lower("source_file").rlike(r"\.mdx?$"), "markdown").otherwise("other")
    return n.select("id", t.alias("t"), lang.alias("l")).distinct().select("id", X.stored_type("t", "l").alias("stored_type"))


_P = f"replace(source_file, {BS}, '/')"
_STEM = f"(CASE WHEN regexp_extract({_P}, '([^/]+)/[^/]*$', 1) = '' THEN '' ELSE regexp_extract({_P}, '([^/]+)/[^/]*$', 1) || '_' END || regexp_extract({_P}, '([^/]*?)(?:\\.[^./]*)?$', 1))"


@R.query(
    "node_ids",
    f"SELECT DISTINCT id, translate(trim({_STEM}), chr(92) || '/', '__') || '::' || translate(trim(label), chr(92) || '/', '__') AS made_id FROM nodes WHERE source_file <> ''",
)
def node_ids(spark, d):
    n = table(spark, d, "nodes", "id", "label", "source_file").where("source_file <> ''")
    return n.select("id", X.node_id(X.file_stem("source_file"), "label").alias("made_id")).distinct()


@R.query("target_ids", r"SELECT DISTINCT label, regexp_replace(regexp_replace(lower(label), '[^\p{L}\p{N}_]', '_', 'g'), '_+$', '') AS target_id FROM nodes")
def target_ids(spark, d):
    return table(spark, d, "nodes", "label").distinct().select("label", X.target_id("label").alias("target_id"))


@R.query("sanitize", r"SELECT doc_id, substring(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g'), 1, 4096) AS clean FROM documents")
def sanitize(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.sanitize("text", X.MAX_DOCSTRING).alias("clean"))


_T = r"regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]', '_', 'g'), '_+$', '')"
_DICT = f"""rows AS (SELECT {_T.format(x='label')} k, (source_file, coalesce(source_line, 0), id) l, NULL s FROM n WHERE file_type <> 'stub' AND instr(label, '(') = 0
    UNION ALL SELECT {_T.format(x="string_split(id, '::')[-1]")}, NULL, (source_file, coalesce(source_line, 0), id) FROM n WHERE file_type <> 'stub'),
  dict AS (SELECT k, coalesce(max(l)[3], min(s)[3]) real_id FROM rows WHERE k <> '' GROUP BY k)"""
_DICT = _DICT.replace("(source_file, coalesce(source_line, 0), id)", "{'f': source_file, 'n': coalesce(source_line, 0), 'id': id}").replace("max(l)[3], min(s)[3]", "max(l).id, min(s).id")


@R.query("symbol_dictionary", f"WITH {GP.N}, {_DICT} SELECT k AS key, real_id AS id FROM dict")
def symbol_dictionary(spark, d):
    return B.symbol_dictionary(GP.nodes(spark, d))


@R.query(
    "resolve_edges",
    f"""WITH {GP.N}, {GP.E}, {_DICT}, j AS (SELECT e.*, CASE WHEN relation IN ('calls', 'imports') AND n.id IS NULL THEN real_id END hit
    FROM e LEFT JOIN n ON n.id = e.target LEFT JOIN dict ON k = {_T.format(x="string_split(target, '::')[-1]")})
SELECT id, source, coalesce(hit, target) AS target, relation, CASE WHEN hit IS NOT NULL AND confidence = 'INFERRED' THEN 'EXTRACTED' ELSE confidence END AS confidence,
  CASE WHEN hit IS NOT NULL AND confidence = 'INFERRED' THEN 0.9 ELSE confidence_score END AS confidence_score FROM j""",
)
def resolve_edges(spark, d):
    return B.resolve(GP.edges(spark, d), GP.nodes(spark, d))


# Text extraction -------------------------------------------------------------------------------------------------

_L = r"""f AS (SELECT DISTINCT file_path, content FROM file_contents WHERE content IS NOT NULL AND {w}),
  s AS (SELECT file_path, string_split({c}, chr(10)) a FROM f),
  l AS (SELECT file_path, unnest(a) line, generate_subscripts(a, 1) line_no FROM s)"""


def _lines(spark, d, pattern, change=None):
    c = table(spark, d, "file_contents", "file_path", "content").where(F.col("file_path").rlike(pattern)).distinct()
    if change:
        c = c.withColumn("content", F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), change[0], change[1].replace("\\", "$")))
    return X.lines(c, "file_path", "content")


def _where(pattern, change=None):
    text = "replace(content, chr(13) || chr(10), chr(10))"
    if change:
        text = f"regexp_replace({text}, '{change[0]}', '{change[1]}', 'g')"
    return _L.format(w=f"regexp_matches(file_path, '{pattern}')", c=text)


#: The files have neither links nor underlined headings; these queries read them with code spans written as links, and
#: with headings underlined.
_AS_LINKS = (r"`([\w.]+)`", r"[\1](\1)")
_UNDERLINED = (r"(?m)^#{1,6}[ \t]+(.+)$", "\\1\n" + "=" * 90)


_MD, _TXT, _RST = r"\.mdx?$", r"\.txt$", r"\.rst$"
_CODE = r"\.(" + "|".join(EXTENSIONS) + ")$"
_H = r"h AS (SELECT file_path, line_no, length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(.+)$', 2)) AS title FROM l WHERE regexp_matches(line, '^#{1,6}\s+.+$'))"


@R.query("markdown_headings", f"WITH {_where(_MD)}, {_H} SELECT * FROM h")
def markdown_headings(spark, d):
    return X.headings(_lines(spark, d, _MD), "file_path")


@R.query(
    "markdown_nesting",
    f"WITH {_where(_MD)}, {_H} SELECT a.*, (SELECT max(b.line_no) FROM h b WHERE b.file_path = a.file_path AND b.line_no < a.line_no AND b.level < a.level) AS parent_line FROM h a",
)
def markdown_nesting(spark, d):
    return X.nesting(X.headings(_lines(spark, d, _MD), "file_path"), "file_path")


@R.query(
    "markdown_links",
    f"WITH {_where(_MD, _AS_LINKS)}, x AS (SELECT file_path, line_no, unnest(regexp_extract_all(line, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM l) SELECT * FROM x WHERE NOT starts_with(target, 'http') AND NOT starts_with(target, '#')",
)
def markdown_links(spark, d):
    return X.markdown_links(_lines(spark, d, _MD, _AS_LINKS), "file_path")


@R.query(
    "text_paragraphs",
    f"""WITH {_where(_TXT)}, b AS (SELECT file_path, line_no, trim(line) line, trim(line) <> '' AND NOT coalesce(lag(trim(line) <> '') OVER (PARTITION BY file_path ORDER BY line_no), false) f FROM l)
SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY line_no) - 1 AS p, line_no, CASE WHEN length(line) > 80 THEN substring(line, 1, 77) || '...' ELSE line END AS label FROM b WHERE f""",
)
def text_paragraphs(spark, d):
    return X.paragraphs(_lines(spark, d, _TXT), "file_path")


@R.query(
    "rst_headings",
    f"""WITH {_where(_RST, _UNDERLINED)}, u AS (SELECT file_path, line_no, trim(line) title, rtrim(lead(line) OVER (PARTITION BY file_path ORDER BY line_no)) un FROM l)
SELECT file_path, line_no, title, substring(un, 1, 1) AS mark FROM u WHERE title <> '' AND NOT regexp_matches(title, '^[=\\-~^"]+$') AND regexp_matches(un, '^[=\\-~^"]+$') AND length(un) >= length(title)""",
)
def rst_headings(spark, d):
    return X.rst_headings(_lines(spark, d, _RST, _UNDERLINED), "file_path")


_TAGS = r"^\s*(#|//|--|;|%)\s*(" + "|".join(X.TAGS) + r"):\s*(.*)$"
_RT = f"t AS (SELECT file_path, line_no, regexp_extract(line, '{_TAGS}', 2) AS tag, trim(regexp_extract(line, '{_TAGS}', 3)) AS text FROM l WHERE regexp_matches(line, '{_TAGS}'))"


@R.query("rationale_tags", f"WITH {_where(_CODE)}, {_RT} SELECT * FROM t")
def rationale_tags(spark, d):
    return X.rationale(_lines(spark, d, _CODE), "file_path")


@R.query(
    "rationale_parent_asof",
    f"""WITH {GP.N}, {_where(_CODE)}, {_RT}, k AS (SELECT source_file, source_line, max(id) id FROM n WHERE source_line IS NOT NULL AND file_type = 'code' GROUP BY ALL)
SELECT t.*, k.id AS parent_id FROM t ASOF LEFT JOIN k ON k.source_file = t.file_path AND k.source_line <= t.line_no""",
)
def rationale_parent_asof(spark, d):
    n = GP.nodes(spark, d).where("source_line is not null and file_type = 'code'").select(F.col("source_file").alias("file_path"), F.col("source_line").alias("line_no"), "id")
    return X.preceding_node(X.rationale(_lines(spark, d, _CODE), "file_path"), n, "file_path")


#: What an import line of the test data looks like, as SQL sees it line by line.
_IMPORT_LINES = {
    "python": r"^\s*(?:from|import)\s+([\w.]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "c": r"^#include\s*[<\"]([^>\"]+)", "cpp": r"^#include\s*[<\"]([^>\"]+)",
    "javascript": r"^(?:import\b.*\bfrom\s*|(?:const|let|var)\b.*=\s*require\()[\"\']([^\"\']+)", "typescript": r"^(?:import\b.*\bfrom\s*|(?:const|let|var)\b.*=\s*require\()[\"\']([^\"\']+)",
    "rust": r"^use\s+([\w:]+)\s*;", "go": r"^\s*(?:import\s+)?\"([\w./-]+)\"$",
}
_IMPORT_CASE = " ".join("WHEN language = '{}' THEN regexp_extract(line, '{}', 1)".format(k, v.replace("'", "''")) for k, v in _IMPORT_LINES.items())


@R.query(
    "import_modules",
    f"WITH {_where(_CODE)}, m AS (SELECT DISTINCT file_path, line_no, CASE {_IMPORT_CASE} ELSE '' END AS module FROM (SELECT *, {_LANG} AS language FROM l)) SELECT * FROM m WHERE module <> ''",
)
def import_modules(spark, d):
    return extraction.import_rows(table(spark, d, "file_contents", "file_path", "content").distinct())


@R.query(
    "callee_names",
    rf"""WITH {_where(_CODE)}, c AS (SELECT file_path, unnest(regexp_extract_all(line, '([A-Za-z_][\w.]*)\(', 1)) AS x FROM l)
SELECT regexp_extract(x, '([^.:]*)$', 1) AS callee, count(*) AS n, count(DISTINCT file_path) AS files FROM c GROUP BY 1""",
)
def callee_names(spark, d):
    names = _lines(spark, d, _CODE).select("file_path", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][\w.]*)\("), 1)).alias("x"))
    return names.select("file_path", X.callee("x").alias("callee")).groupBy("callee").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@R.query("extract_code")
def extract_code(spark, d):
    """Nodes and edges of every source file."""
    return extraction.extract_code(table(spark, d, "file_contents", "file_path", "content").distinct())


@R.query(
    "language_configs",
    "SELECT language, count(*) AS extensions FROM (VALUES " + ", ".join(f"('{e}', '{x}')" for e, x in EXTENSIONS.items()) + ") t(e, language) GROUP BY language",
)
def language_configs(spark, d):
    return extraction.languages(spark).select("language", F.size("extensions").cast("long").alias("extensions"))


@R.query("parse_code_udtf")
def parse_code_udtf(spark, d):
    """The extractor as an SQL table function: nodes per type and language."""
    extraction.register(spark)
    table(spark, d, "file_contents", "file_path", "content").distinct().createOrReplaceTempView("_files_to_parse")
    return spark.sql("SELECT node_type, count(*) AS n FROM _files_to_parse f, LATERAL parse_code(f.file_path, f.content) t WHERE t.kind = 'node' GROUP BY node_type")


_TEXT = r"trim(regexp_replace(regexp_replace(text, '<[^>]*>|<[^>]*$|>', ' ', 'g'), '(\s)\s+', '\1', 'g'))"


@R.query("html_to_text", f"SELECT doc_id, CASE WHEN {_TEXT} = '' THEN '(empty page)' ELSE {_TEXT} END AS page FROM documents")
def html_to_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", X.html_to_text("text").alias("page"))


_HEAD = "lower(substring(content, 1, 512))"


@R.query("looks_like_html", f"SELECT DISTINCT file_path, contains({_HEAD}, '<html') OR contains({_HEAD}, '<!doctype html') OR contains({_HEAD}, '<head') AS is_html FROM file_contents")
def looks_like_html(spark, d):
    return table(spark, d, "file_contents", "file_path", "content").select("file_path", X.looks_like_html("content").alias("is_html")).distinct()


#: URLs under which the files of the manifest would be served.
_URL = f"'https://' || (CASE WHEN size_bytes % 2 = 0 THEN repo || '.example.org' ELSE (size_bytes % 256) || '.' || (size_bytes % 89 + 100) || '.1.2' END) || ':8443/' || replace(file_path, {BS}, '/') || '?v=' || size_bytes"
_URLS = f"u AS (SELECT DISTINCT {_URL} AS url FROM file_manifest)"


def _urls(spark, d):
    m = table(spark, d, "file_manifest", "file_path", "repo", "size_bytes")
    size = F.col("size_bytes")
    host = F.when(size % 2 == 0, F.concat("repo", F.lit(".example.org"))).otherwise(F.concat((size % 256).cast("string"), F.lit("."), (size % 89 + 100).cast("string"), F.lit(".1.2")))
    return m.select(F.concat(F.lit("https://"), host, F.lit(":8443/"), norm_path("file_path"), F.lit("?v="), size.cast("string")).alias("url")).distinct()


@R.query("pdf_urls", rf"WITH {_URLS} SELECT regexp_replace(url, '\?.*$', '') AS url, regexp_matches(lower(regexp_replace(url, '\?.*$', '')), '\.pdf$') OR regexp_matches(lower(url), 'arxiv\.org/(pdf|abs)/') AS is_pdf FROM u")
def pdf_urls(spark, d):
    bare = F.regexp_replace("url", r"\?.*$", "")
    return _urls(spark, d).select(bare.alias("url"), X.is_pdf_url(bare).alias("is_pdf"))


@R.query("url_filename", rf"WITH {_URLS} SELECT url, regexp_extract(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '\?.*$', ''), '([^/]*)$', 1) AS file_name FROM u")
def url_filename(spark, d):
    return _urls(spark, d).select("url", X.url_filename("url").alias("file_name"))


_HOST = "lower(regexp_extract(url, '://([^/:?#]*)', 1))"


@R.query("url_host", f"WITH {_URLS} SELECT url, {_HOST} AS host FROM u")
def url_host(spark, d):
    return _urls(spark, d).select("url", X.url_host("url").alias("host"))


@R.query(
    "private_hosts",
    rf"""WITH {_URLS}, h AS (SELECT DISTINCT {_HOST} AS host FROM u), q AS (SELECT host, TRY_CAST(regexp_extract(host, '^(\d+)\.(\d+)\.\d+\.\d+$', 1) AS INT) a, TRY_CAST(regexp_extract(host, '^(\d+)\.(\d+)\.\d+\.\d+$', 2) AS INT) b FROM h)
SELECT host, coalesce(a IN (0, 10, 127) OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 169 AND b = 254 OR a = 100 AND b BETWEEN 64 AND 127, false) OR host = 'localhost' AS private FROM q""",
)
def private_hosts(spark, d):
    return _urls(spark, d).select(X.url_host("url").alias("host")).distinct().select("host", X.is_private_host("host").alias("private"))


@R.query(
    "pdf_text_markdown",
    r"""WITH s AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n\n+') a FROM documents),
  p AS (SELECT doc_id, unnest(a) part0, generate_subscripts(a, 1) - 1 p FROM s), q AS (SELECT doc_id, p, trim(regexp_replace(part0, '^\n+|\n+$', '', 'g')) part FROM p)
SELECT doc_id, p, CASE WHEN strlen(part) < 80 AND NOT regexp_matches(part, '[.?!]$') AND p > 0 THEN '## ' ELSE '' END || replace(part, chr(10), ' ') AS line FROM q WHERE part <> ''""",
)
def pdf_text_markdown(spark, d):
    return X.pdf_markdown(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@R.query(
    "llm_json_salvage",
    """SELECT DISTINCT file_path, extracted_at, '{"nodes": ' || nodes || '}' AS json, json_array_length(nodes)::INT AS n_nodes FROM extraction_cache""",
)
def llm_json_salvage(spark, d):
    """Answers with prose around their JSON: the object is cut out and read with a fixed schema."""
    c = table(spark, d, "extraction_cache", "file_path", "extracted_at", "nodes").distinct()
    answer = F.concat(F.lit('Here you are:\n{"nodes": '), "nodes", F.lit("}\nDone."))
    j = c.select("file_path", "extracted_at", X.salvage_json(answer).alias("json"))
    return j.withColumn("n_nodes", F.size(F.from_json("json", f"nodes {_ITEM}").getField("nodes")))


# Exports, logs, streams ------------------------------------------------------------------------------------------

_XML = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def _data(k):
    return f"CASE WHEN {k} IS NOT NULL THEN '<data key=\"{k}\">' || {_XML.format(x=k + '::VARCHAR')} || '</data>' ELSE '' END"


@R.query(
    "graphml_elements",
    f"""{GP.BASE} SELECT 'node' AS kind, id, '<node id="' || {_XML.format(x='id')} || '">' || {' || '.join(map(_data, ('label', 'file_type', 'source_file', 'source_line', 'community')))} || '</node>' AS xml FROM n
UNION ALL SELECT 'edge', id::VARCHAR, '<edge source="' || {_XML.format(x='source')} || '" target="' || {_XML.format(x='target')} || '">' || {_data('relation')} || {_data('confidence')} || {_data('confidence_score')} || '</edge>' FROM c""",
)
def graphml_elements(spark, d):
    return export.graphml_elements(*GP.graph(spark, d))


def _object(fields):
    return "to_json({" + ", ".join(f"'{k}': {k}" for k in fields) + "})::VARCHAR"


@R.query(
    "export_json_rows",
    f"{GP.BASE} SELECT 'node' AS kind, id, {_object(export.NODE_FIELDS)} AS json FROM n UNION ALL SELECT 'edge', id::VARCHAR, {_object(export.EDGE_FIELDS)} FROM c",
)
def export_json_rows(spark, d):
    return export.json_rows(*GP.graph(spark, d))


@R.query(
    "html_groups_colors",
    f"""WITH {GP.N}, g AS (SELECT community, min(id) f, count(*) members FROM n WHERE community IS NOT NULL GROUP BY 1),
  o AS (SELECT community, members, row_number() OVER (ORDER BY f) - 1 AS position, count(*) OVER () k FROM g)
SELECT community, position, members, 'hsl(' || floor(position * 360 / k)::INT || ', 70%, 60%)' AS colour FROM o""",
)
def html_groups_colors(spark, d):
    return export.group_colours(GP.nodes(spark, d))


@R.query(
    "report_lines",
    f"""{GP.BASE}, {GP.D}, h AS (SELECT *, row_number() OVER (ORDER BY degree DESC, id) - 1 AS rk FROM d),
  x AS (SELECT row_number() OVER (ORDER BY c.id) - 1 AS rk, a.label la, b.label lb, relation FROM c JOIN n a ON a.id = c.source JOIN n b ON b.id = c.target WHERE a.community <> b.community),
  k AS (SELECT count(DISTINCT community) k FROM n),
  s AS (SELECT unnest(['**Nodes:** ' || (SELECT count(*) FROM n), '**Edges:** ' || (SELECT count(*) FROM c), '**Communities:** ' || (SELECT k FROM k),
    '**Files:** ' || (SELECT count(DISTINCT replace(file_path, {BS}, '/')) FROM file_manifest)]) line, unnest([0, 1, 2, 3]) pos)
SELECT 0 AS section, pos, line FROM s
UNION ALL SELECT 1, rk, '- **' || label || '** (' || degree || ' connections)' FROM h WHERE rk < 10
UNION ALL SELECT 2, rk, '- **' || la || '** -> **' || lb || '** (' || relation || ')' FROM x WHERE rk < 20
UNION ALL SELECT 3, rk, '- What role does ' || label || ' play, with its ' || degree || ' connections?' FROM h WHERE rk < 5
UNION ALL SELECT 3, 5, '- How do the ' || k || ' communities relate to each other?' FROM k WHERE k > 1""",
)
def report_lines(spark, d):
    n, e = GP.graph(spark, d)
    hubs = G.hubs(e, n)
    return export.report_lines(G.stats(n, e, table(spark, d, "file_manifest", "file_path")), hubs, G.cross_community(e, n), G.questions(hubs, n))


@R.query(
    "history_recent",
    "SELECT item_id AS id, string_split(text, chr(10))[1] AS question, substring(answer, 1, 500) AS answer FROM eval_items ORDER BY item_id DESC LIMIT 20",
)
def history_recent(spark, d):
    h = table(spark, d, "eval_items", "item_id", "text", "answer")
    return h.orderBy(F.desc("item_id")).limit(20).select(F.col("item_id").alias("id"), F.split("text", "\n")[0].alias("question"), F.substring("answer", 1, 500).alias("answer"))


@R.query(
    "run_log",
    "SELECT DISTINCT id, status, CAST(started_at AS BIGINT) AS started, CAST(finished_at AS BIGINT) - CAST(started_at AS BIGINT) AS seconds, coalesce(files_processed, 0) AS files FROM pipeline_runs",
)
def run_log(spark, d):
    r = table(spark, d, "pipeline_runs", "id", "status", "started_at", "finished_at", "files_processed").distinct()
    a, b = F.col("started_at").cast("bigint"), F.col("finished_at").cast("bigint")
    return r.select("id", "status", a.alias("started"), (b - a).alias("seconds"), F.coalesce("files_processed", F.lit(0)).alias("files"))


@R.query(
    "watch_debounce_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 3600000000 THEN 0 ELSE 1 END nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(nw) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM g)
SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2""",
)
def watch_debounce_sessions(spark, d):
    return B.debounce(table(spark, d, "events", "user_id", "ts"), "user_id", "ts", 3600)
