"""Text extraction as column expressions: ids, file classes, markdown, paragraphs, headings, imports, pages, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.code import EXTENSIONS
from .scalars import col, norm_path

#: Extensions per file type.
FILE_TYPES = {
    "code": list(EXTENSIONS),
    "document": ["md", "mdx", "txt", "rst"],
    "paper": ["pdf"],
    "image": ["png", "jpg", "jpeg", "gif", "svg", "webp"],
    "video": ["mp4", "mov", "avi", "webm", "mkv"],
}
#: Largest text file and largest other file in bytes.
MAX_TEXT, MAX_BINARY = 10 * 1024 * 1024, 50 * 1024 * 1024
#: Most characters of a label and of a docstring.
MAX_LABEL, MAX_DOCSTRING = 256, 4096
#: Tags of comments that give a rationale.
TAGS = ("NOTE", "WHY", "HACK", "IMPORTANT", "TODO", "FIXME")
CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]"


def extension(path: Column | str) -> Column:
    """Lower-case extension of the file name, '' if it has none."""
    return F.lower(F.regexp_extract(norm_path(path), r"[^/]\.([^./]+)$", 1))


def file_type(path: Column | str) -> Column:
    """code, document, paper, image or video by extension; null for anything else."""
    e, out = extension(path), F.lit(None).cast("string")
    for kind, names in FILE_TYPES.items():
        out = F.when(e.isin(names), kind).otherwise(out)
    return out


def language(path: Column | str) -> Column:
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.create_map(*pairs)[extension(path)]


def size_verdict(path: Column | str, size: Column | str) -> Column:
    """ok or too_large: text beyond MAX_TEXT, anything beyond MAX_BINARY."""
    text = file_type(path).isin("code", "document")
    return F.when((col(size) > MAX_BINARY) | (text & (col(size) > MAX_TEXT)), "too_large").otherwise("ok")


def file_stem(path: Column | str) -> Column:
    """<parent folder>_<name without extension>, or the name alone at the root."""
    p = norm_path(path)
    stem = F.regexp_extract(p, r"([^/]*?)(?:\.[^./]*)?$", 1)
    parent = F.regexp_extract(p, r"([^/]+)/[^/]*$", 1)
    return F.when(parent == "", stem).otherwise(F.concat(parent, F.lit("_"), stem))


def node_id(*parts: Column | str) -> Column:
    """Parts trimmed, slashes of either kind as underscores, joined by `::`; the case is kept."""
    return F.concat_ws("::", *[F.translate(F.trim(col(p)), "\\/", "__") for p in parts])


def target_id(name: Column | str) -> Column:
    """Lower case, everything but letters, digits and `_` as `_`, trailing `_` cut."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), r"[^\p{L}\p{N}_]", "_"), "_+$", "")


def sanitize(text: Column | str, most: int = MAX_LABEL) -> Column:
    """Without control characters except line end and tab, cut after `most` characters."""
    return F.substring(F.regexp_replace(col(text), CONTROLS, ""), 1, most)


def stored_type(node_type: Column | str, lang: Column | str) -> Column:
    """file_type of a stored node: rationale and concepts stay, else document for markdown and code for the rest."""
    t = col(node_type)
    return F.when(t.isin("rationale", "concept", "entity", "pattern", "module"), t).when(col(lang) == "markdown", "document").otherwise("code")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) of a text column; line ends of either kind; null texts have no lines."""
    return df.select(key, F.posexplode(F.split(F.regexp_replace(col(text), "\r\n", "\n"), "\n")).alias("p", "line")).select(
        key, (F.col("p") + 1).alias("line_no"), "line"
    )


def headings(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, level, title) of markdown headings among numbered lines."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1))
    return rows.where(F.col("line").rlike(r"^#{1,6}\s+.+$")).select(key, "line_no", level.alias("level"), F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)).alias("title"))


def nesting(heads: DataFrame, key: str) -> DataFrame:
    """Adds parent_line: the nearest earlier heading of a smaller level (null at the top).

    Levels are 1 to 6, so the stack of open headings is five running maxima; a document is the window.
    """
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    out = heads
    for k in range(1, 6):
        out = out.withColumn(f"_l{k}", F.max(F.when(F.col("level") == k, F.col("line_no"))).over(w))
    parent = F.lit(None).cast("int")
    for level in range(6, 1, -1):
        parent = F.when(F.col("level") == level, F.greatest(*[F.col(f"_l{k}") for k in range(1, level)]) if level > 2 else F.col("_l1")).otherwise(parent)
    return out.withColumn("parent_line", parent).drop(*[f"_l{k}" for k in range(1, 6)])


def markdown_links(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, target) of local links: neither with a scheme http nor to an anchor."""
    found = rows.select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), 1)).alias("target"))
    return found.where(~F.startswith("target", F.lit("http")) & ~F.startswith("target", F.lit("#")))


def paragraphs(rows: DataFrame, key: str) -> DataFrame:
    """(key, p from 0, line_no, label): runs of non-blank lines; the label is the first line, cut to 77 characters
    and `...` beyond 80."""
    w = W.partitionBy(key).orderBy("line_no")
    full = F.trim("line") != ""
    first = rows.select(key, "line_no", F.trim("line").alias("line"), (full & ~F.coalesce(F.lag(full).over(w), F.lit(False))).alias("first")).where("first")
    label = F.when(F.length("line") > 80, F.concat(F.substring("line", 1, 77), F.lit("..."))).otherwise(F.col("line"))
    return first.select(key, (F.row_number().over(w) - 1).alias("p"), "line_no", label.alias("label"))


def rst_headings(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, title, mark): a line over an underline at least as long, which is no underline itself."""
    w = W.partitionBy(key).orderBy("line_no")
    rule = r"^[=\-~^\"]+$"
    under = F.rtrim(F.lead("line").over(w))
    return (
        rows.select(key, "line_no", F.trim("line").alias("title"), under.alias("under"))
        .where((F.col("title") != "") & ~F.col("title").rlike(rule) & F.col("under").rlike(rule) & (F.length("under") >= F.length("title")))
        .select(key, "line_no", "title", F.substring("under", 1, 1).alias("mark"))
    )


def rationale(rows: DataFrame, key: str) -> DataFrame:
    """(key, line_no, tag, text) of comment lines that begin with a tag."""
    pattern = r"^\s*(#|//|--|;|%)\s*(" + "|".join(TAGS) + r"):\s*(.*)$"
    return rows.where(F.col("line").rlike(pattern)).select(key, "line_no", F.regexp_extract("line", pattern, 2).alias("tag"), F.trim(F.regexp_extract("line", pattern, 3)).alias("text"))


def preceding_node(tags: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """As-of join: each tagged line gets the id of the nearest node of its file at or before its line (null if none).

    nodes: (key, line_no, id). Both sides go through one window per file; ties go to the greatest id.
    """
    both = nodes.select(key, "line_no", F.lit(0).alias("side"), "id", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("text")).unionByName(
        tags.select(key, "line_no", F.lit(1).alias("side"), F.lit(None).cast("string").alias("id"), "tag", "text")
    )
    w = W.partitionBy(key).orderBy("line_no", "side", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("parent_id", F.last("id", ignorenulls=True).over(w)).where("side = 1").select(key, "line_no", "tag", "text", "parent_id")


def html_to_text(html: Column | str) -> Column:
    """Tags become one blank, runs of white space keep their first character; nothing left gives `(empty page)`."""
    t = F.trim(F.regexp_replace(F.regexp_replace(col(html), r"<[^>]*>|<[^>]*$|>", " "), r"(\s)\s+", "$1"))
    return F.when(t == "", "(empty page)").otherwise(t)


def looks_like_html(text: Column | str) -> Column:
    head = F.lower(F.substring(col(text), 1, 512))
    return F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html")) | F.contains(head, F.lit("<head"))


def is_pdf_url(url: Column | str) -> Column:
    u = F.lower(col(url))
    return u.rlike(r"\.pdf$") | u.rlike(r"arxiv\.org/(pdf|abs)/")


def url_filename(url: Column | str) -> Column:
    """Last segment of the path without the query, else index.html."""
    path = F.regexp_replace(F.regexp_replace(col(url), "^[a-zA-Z]+://", ""), r"\?.*$", "")
    name = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"([^/]*)$", 1)).otherwise("")
    return F.when(name == "", "index.html").otherwise(name)


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"://([^/:?#]*)", 1))


def is_private_host(host: Column | str) -> Column:
    """Loopback, private, link-local and shared IPv4 ranges, and names of the local host."""
    h = F.lower(col(host))
    n = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", k).try_cast("int") for k in (1, 2)]
    inside = (
        n[0].isin(0, 10, 127) | ((n[0] == 172) & n[1].between(16, 31)) | ((n[0] == 192) & (n[1] == 168))
        | ((n[0] == 169) & (n[1] == 254)) | ((n[0] == 100) & n[1].between(64, 127))
    )
    return F.coalesce(inside, F.lit(False)) | (h == "localhost") | F.endswith(h, F.lit(".localhost")) | (h == "")


def pdf_markdown(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, p, line): paragraphs of extracted text as markdown; a short one without final stop becomes a heading."""
    parts = df.select(key, F.posexplode(F.split(F.regexp_replace(col(text), "\r\n", "\n"), r"\n\n+")).alias("p", "part")).withColumn("part", F.trim(F.regexp_replace("part", r"^\n+|\n+$", "")))
    short = (F.octet_length("part") < 80) & ~F.col("part").rlike(r"[.?!]$") & (F.col("p") > 0)
    flat = F.regexp_replace("part", "\n", " ")
    return parts.where("part <> ''").select(key, "p", F.when(short, F.concat(F.lit("## "), flat)).otherwise(flat).alias("line"))


def salvage_json(text: Column | str) -> Column:
    """What lies between the first `{` or `[` bracket pair of an answer: from the first `{` to the last `}`."""
    return F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)


def callee(name: Column | str) -> Column:
    """The part after the last `.` or `::`."""
    return F.regexp_extract(col(name), r"([^.:]*)$", 1)
