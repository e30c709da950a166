"""Functions paired with their documentation.

Candidate comments of a file are matched to its functions by bipartite assignment: the cost of a link grows with
what stands between the two and with parameter tags that the function does not have, and falls with tags that it
has and when the comment names the function. Implausible links are rejected; what is left decides the documentation
of functions whose record has none, and uninformative documentation is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank, norm_path
from ..sources import code
from .arrow import map_rows

#: Cost of leaving a function without documentation; links that cost more are implausible.
REJECT = 1.0
#: Blank lines and other comments between a comment and a function up to which a link is considered at all.
REACH = 3
#: Cost of the first blank line or comment in between, and of each further one. The first alone is implausible: a
#: comment apart from the function belongs to it only if tags say so.
APART, FURTHER = 1.2, 0.4
#: Tags: all of them name parameters of the function; none does; none does and the text names another function.
TAGS_FIT, TAGS_MISS, OTHERS = -0.9, 0.8, 0.4
#: The text names the function.
NAMED = -0.15

_MARK_OPEN = re.compile(r"\A\s*(?:(?i:[rubf]{0,2})(?:\"\"\"|''')|/\*[*!]?|<!--|\{-\|?|--\[\[)")
_MARK_CLOSE = re.compile(r"(?:\"\"\"|'''|\*+/|-->|-\}|\]\])\s*\Z")
_MARK_LINE = re.compile(r"^[ \t]*(?://[/!]*|#+!?(?!\[)|\*+(?!/)|--+\|?|;+)[ \t]?", re.M)
_QUOTED = re.compile(r"\A([\"'])(.*)\1\Z", re.S)
_TAGS = re.compile(r"(?:[@\\]param(?:eter)?|:param(?:eter)?)\s+(?:\{[^}]*\}\s*)?(?:\w+\s+(?=\w+:))?\[?(\w+)")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_NAME = re.compile(r"[\w$]+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")

#: Words of placeholders, of pointers to other places, of remarks to tools, and fillers beside a name.
PLACEHOLDER = set(
    "todo tbd tba fixme xxx hack na n a none nil null doc docs docstring docstrings documentation documented undocumented describe described"
    " description desc goes here no not provided missing add added write written fill in auto autogenerated generated method function stub"
    " this the placeholder empty comment comments available yet team me needed needs need summary text lorem ipsum insert your please is to be"
    " done later coming soon wip".split()
)
POINTER = set(
    "see above below same as also refer to inheritdoc inherit inherited inherits from parent base super class superclass interface method function"
    " the for details more docs documentation doc info information overridden overrides override other ditto previous next".split()
)
FILLER = set("default function method func fn procedure routine constructor getter setter helper implementation the a an this that of for def sub class member".split())
_TOOL = re.compile(
    r"(?i)^\W*(?:noqa|type:\s*ignore|pylint|flake8|mypy|pragma|nolint|nosec|nosonar|eslint|tslint|jshint|jslint|prettier|@ts-|ts-|istanbul|c8\s+ignore|biome-|clang-format|clang-tidy|iwyu"
    r"|rustfmt|clippy|go:|\+build|checkstyle|spotless|fmt:\s*(?:off|on)|yapf|isort|coverage|cspell|codespell|spell-?check|@formatter|region\b|endregion\b|vim:|-\*-|spdx|@?suppress|noinspection|lint|black:|ruff)"
)
_TAG_LINE = re.compile(
    r"^[ \t]*(?:[@\\:]\w+:?|\{@\w+[^}]*\}|(?:args|arguments|parameters|params|returns?|yields?|raises|throws|example|examples|notes?|attributes|keyword args)\s*:)", re.I
)
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|keyword args)\s*:?\s*$")
_PARAM_LINE = re.compile(r"^\s*(?:[@\\](?:param|arg|argument|tparam|returns?|return|throws|exception|type|rtype)|:(?:param|arg|returns?|return|rtype|type|raises)\b)")


def strip_marks(text: str) -> str:
    """The text of a comment or docstring without comment marks, also when only some lines carry them."""
    text = text.replace("\r\n", "\n").strip()
    quoted = _QUOTED.match(text) if text[:3] not in ('"""', "'''") and text[:1] in "\"'" else None
    if quoted and quoted[1] not in quoted[2]:
        text = quoted[2]
    text = _MARK_OPEN.sub("", text, count=1)
    text = _MARK_CLOSE.sub("", text)
    text = "\n".join(re.sub(r"\A\s*/\*[*!]?|\*/\s*\Z", "", x) for x in text.split("\n")) if "/*" in text else text
    return _MARK_LINE.sub("", text).strip()


def _stem(w: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name)]


def informative(text: str, name: str) -> bool:
    """Whether a documentation says anything: not so if, without comment marks, markup and bare parameter lists,
    it is empty, a placeholder, a remark to tools or editors, a pointer elsewhere, or the function's name in words."""
    text = strip_marks(text)
    kept, bare_name = [], re.compile(r"^\s*[\w$]+\s*(?:\([^)]*\))?\s*:?\s*$")
    in_section = False
    for row in text.split("\n"):
        if _SECTION.match(row):
            in_section = True
            continue
        if not row.strip():
            in_section = False
            continue
        if in_section and bare_name.match(row):
            continue
        if _PARAM_LINE.match(row):
            rest = re.sub(r"^\s*[@\\:]\w+\s*(?:\{[^}]*\}\s*)?", "", row)
            rest = re.sub(r"^\s*(?:\w+\s+)?[\w.$\[\]]*\s*:?\s*-?\s*", "", rest, count=1)
            if len(_WORD.findall(rest)) < 2:
                continue
            row = rest
        kept.append(row)
    if all(_TOOL.match(row) for row in kept):
        return False
    text = "\n".join(row for row in kept if not _TOOL.match(row))
    text = re.sub(r"<[^<>\n]*>|&\w+;", " ", text)
    text = re.sub(r"\{@(?:link|code|see)[^}]*\}|\{@\w+\}", " see ", text)
    pointer_to = re.match(r"(?is)^\W*(?:see|cf\.?|refer to|same as|like|as in|@see|defined in|documented in)\s+[`'\"]?[\w.:#/()-]+[`'\"]?[.!]?\s*$", text)
    if pointer_to:
        return False
    text = re.sub(r"(?m)^\s*[@\\](\w+)", r"\1", text)
    if re.fullmatch(r"(?is)\W*(?:override|overrides|deprecated|inheritdoc|internal|private|public|protected|hidden|ignore|static|final|abstract|test|nodoc|api|since|version|author|async)\W*", text):
        return False
    words = [w.lower() for w in _WORD.findall(text.replace(name, " " + " ".join(name_words(name)) + " ") if name else text)]
    words = [x for w in words for x in ([w] if w.isascii() and len(w) > 2 else [w])]
    letters = [w for w in words if any(c.isalpha() for c in w)]
    if not letters:
        return False
    for vocabulary in (PLACEHOLDER, POINTER):
        if all(w in vocabulary for w in letters):
            return False
    own = {_stem(w) for w in name_words(name)}
    rest = [w for w in letters if w not in FILLER]
    if all(_stem(w) in own for w in rest):
        return False
    own |= {_stem(w) for w in PLACEHOLDER if len(w) > 4}
    joined = "".join(name_words(name))
    return not all(_stem(w) in own or w == joined for w in rest)


def _blocks(comments: list[code.Comment]) -> list[tuple[int, int, str, int]]:
    """Runs of comments on consecutive lines: (first line, last line, text, offset)."""
    out: list[list] = []
    for c in comments:
        if not c.own_line:
            continue
        if out and out[-1][1] == c.first - 1 and c.text[:2] == out[-1][3][:2] and c.text[:2] != "/*":
            out[-1][1] = c.last
            out[-1][2] += "\n" + c.text
        else:
            out.append([c.first, c.last, c.text, c.text[:2], c.begin])
    return [(a, b, t, o) for a, b, t, _, o in out]


def _without_remarks(comments: list[code.Comment], functions: list[code.Function]) -> tuple[list[code.Comment], list[code.Function]]:
    """The candidates: remarks to tools between a function and what stands above it are no comments, and no distance."""
    at = {c.last: c for c in comments if c.own_line}
    dropped, out = set(), []
    for f in functions:
        first = f.first
        while (c := at.get(first - 1)) and all(_TOOL.match(row) for row in strip_marks(c.text).split("\n")):
            dropped.add(c.begin)
            first = c.first
        out.append(replace(f, first=first) if first < f.first else f)
    return [c for c in comments if c.begin not in dropped], out


def link_cost(block: tuple[int, int, str, int], f: code.Function, between: int = 0, others: frozenset[str] = frozenset()) -> float:
    """Cost of a comment block as the documentation of f with so many blank lines and comments between the two.

    others: names of the functions of the file. Tags outweigh distance, and distance outweighs a mere mention.
    """
    cost = APART + FURTHER * (between - 1) if between else 0.0
    text = block[2]
    tags = set(_TAGS.findall(text)) if "param" in text else set()
    if tags:
        fit = len(tags & set(f.params)) / len(tags)
        cost += TAGS_FIT * fit if fit else TAGS_MISS
        if not fit and others and f.name not in text and others & set(_NAME.findall(text)):
            cost += OTHERS
    if f.name in text and re.search(rf"(?<![\w$]){re.escape(f.name)}(?![\w$])", text):
        cost += NAMED
    return cost


def candidates(blocks: list[tuple[int, int, str, int]], functions: list[code.Function], lines: list[str]) -> dict[int, dict[int, float]]:
    """function index -> block index -> cost of the plausible links. Only blank lines and other comments may lie
    between the two (lines: the masked lines of the file; annotations and remarks to tools belong to the function)."""
    ends = {b[1]: j for j, b in enumerate(blocks)}
    others = frozenset(f.name for f in functions)
    links: dict[int, dict[int, float]] = {}
    for i, f in enumerate(functions):
        between, at = 0, f.first - 1  # the line above, from 1
        while at > 0 and between <= REACH:
            j = ends.get(at)
            if j is not None:
                cost = link_cost(blocks[j], f, between, others)
                if cost <= REJECT:
                    links.setdefault(i, {})[j] = cost
                at = blocks[j][0] - 1
            elif lines[at - 1].strip():
                break
            else:
                at -= 1
            between += 1
    return links


def assign(links: dict[int, dict[int, float]]) -> dict[int, int]:
    """function index -> block index of the cheapest matching; functions may stay single at the cost REJECT.

    Links form small components (a comment reaches few functions), each solved by shortest augmenting paths over
    its own links only.
    """
    match: dict[int, int] = {}  # block -> function
    of: dict[int, int] = {}
    for i in links:  # augment along the path of least added cost (Bellman-Ford over alternating links)
        best: dict[int, tuple[float, int]] = {}  # block -> (cost, function before it)
        queue, cost_at = [(i, 0.0)], {i: 0.0}
        while queue:
            f, base = queue.pop()
            if base > cost_at.get(f, 1e9):
                continue
            for j, c in links[f].items():
                if of.get(f) != j and base + c < best.get(j, (1e9, 0))[0] - 1e-12:
                    best[j] = (base + c, f)
                    owner = match.get(j)
                    if owner is not None and owner != i:
                        lower = base + c - links[owner][j]
                        if lower < cost_at.get(owner, 1e9) - 1e-12:
                            cost_at[owner] = lower
                            queue.append((owner, lower))
        ends = [(c, j) for j, (c, _) in best.items() if j not in match]
        drops = [(best[j][0] - links[match[j]][j] + REJECT, j) for j in best if j in match]
        choice = min([(c, 0, j) for c, j in ends] + [(c, 1, j) for c, j in drops], default=None)
        if choice is None or choice[0] > REJECT:
            continue
        _, dropped, j = choice
        if dropped:
            of.pop(match[j], None)
        while True:
            f = best[j][1]
            before = of.get(f)
            match[j], of[f] = f, j
            if f == i or before is None:
                break
            j = before
    return of


def pairs_of(path: str, text: str) -> Iterator[tuple[code.Function, str | None, str]]:
    """(function, documentation or None, code) of every function of a file."""
    language = code.language_of(path)
    if not language:
        return
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    p = code.parse(text, language)
    comments, functions = _without_remarks(p.comments, p.functions)
    blocks = _blocks(comments)
    linked = assign(candidates(blocks, functions, p.masked.split("\n"))) if blocks else {}
    for i, f in enumerate(p.functions):
        doc = f.docstring
        if doc is None and i in linked:
            doc = blocks[linked[i]][2]
        yield f, doc, text[f.begin : f.end]


def function_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, file_path, name, owner, source_line, docstring): one row per id of a function or method.

    Of the rows of an id that was loaded again one counts as a whole: the last one with a docstring that is not
    blank, else the last one (ties: the greatest docstring, file, label and line).
    """
    own = F.when(~blank("docstring"), F.col("docstring")).alias("docstring")
    n = nodes.where("file_type = 'code' and label like '%()' and id is not null").select(
        F.col("id").alias("node_id"),
        F.struct(own.isNotNull().alias("has"), "loaded_at", own, norm_path("source_file").alias("file_path"), "label", "source_line").alias("x"),
    )
    parts = F.split("node_id", "::")
    return n.groupBy("node_id").agg(F.max("x").alias("x")).select(
        "node_id", "x.file_path", F.expr("substring(x.label, 1, length(x.label) - 2)").alias("name"),
        F.when(F.size(parts) > 2, F.element_at(parts, -2)).otherwise("").alias("owner"), "x.source_line", "x.docstring",
    )


def _wanted(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_path, content, fns): each text of a file with the functions asked of it.

    The functions of a file are gathered under its path before the texts are joined, so that each text is moved
    at most once; a file's functions are a bounded group, as the file itself is. Functions without a file are left out.
    """
    at_file = nodes.where("file_path <> ''")
    asked = at_file.groupBy("file_path").agg(F.collect_list(F.struct("node_id", "name", "owner", "source_line", "docstring")).alias("fns"))
    text = (
        contents.select(norm_path("file_path").alias("file_path"), "content").where("file_path is not null and content is not null")
    )
    return text.join(asked, "file_path")


def _by_name(found: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for x in found:
        out.setdefault(x[0].name, []).append(x)
    return out


def _pick(found: dict[str, list], name: str, owner: str, line: int | None):
    same = found.get(name, [])
    exact = [x for x in same if x[0].owner == owner] or same
    return min(exact, key=lambda x: abs(x[0].line - line) if line is not None else 0, default=None)


def pairs(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(node_id, file_path, doc, code, from_source): every function with an informative documentation, once.

    The record's docstring counts where it is not blank, else the documentation comment or docstring that the
    matching gives. Functions whose file or declaration is missing have a null code. Extra columns are pruned;
    repeated rows of nodes and files count once; null labels, ids and texts are ignored.
    """
    asked = function_nodes(nodes)
    documented = _informative(asked.where("docstring is not null"))

    def make():
        def one(path, text, fns):
            found = _by_name(pairs_of(path, text))
            for x in fns:
                hit = _pick(found, x["name"], x["owner"], x["source_line"])
                doc = x["docstring"] if x["docstring"] is not None else hit and hit[1]
                if doc and informative(doc, x["name"]):
                    yield x["node_id"], path, strip_marks(doc), hit and hit[2], x["docstring"] is None

        return one

    schema = "node_id string, file_path string, doc string, code string, from_source boolean"
    values = ("file_path", "doc", "code", "from_source")
    at_file = map_rows(_wanted(asked, contents), schema, make).groupBy("node_id").agg(F.max(F.struct(*values)).alias("x"))
    at_file = at_file.select("node_id", *[f"x.{c}" for c in values])  # of texts delivered twice one counts as a whole
    rest = documented.join(at_file.select("node_id"), "node_id", "left_anti").select(
        "node_id", "file_path", "doc", F.lit(None).cast("string").alias("code"), F.lit(False).alias("from_source")
    )
    return at_file.unionByName(rest)


def _informative(asked: DataFrame) -> DataFrame:
    """(node_id, file_path, doc) of records whose own docstring is informative."""

    def make():
        def one(node_id, path, name, docstring):
            if informative(docstring, name):
                yield node_id, path, strip_marks(docstring)

        return one

    return map_rows(asked.select("node_id", "file_path", "name", "docstring"), "node_id string, file_path string, doc string", make)


def documented_ids(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(node_id) of functions with informative documentation.

    Only functions without a docstring of their own need the text of their file; the others are judged where they
    are. Nulls and repeats as in `pairs`.
    """
    asked = function_nodes(nodes)
    own = _informative(asked.where("docstring is not null")).select("node_id")

    def make():
        def one(path, text, fns):
            found = _by_name(pairs_of(path, text))
            for x in fns:
                hit = _pick(found, x["name"], x["owner"], x["source_line"])
                if hit and hit[1] and informative(hit[1], x["name"]):
                    yield (x["node_id"],)

        return one

    from_source = map_rows(_wanted(asked.where("docstring is null"), contents), "node_id string", make)
    return own.unionByName(from_source.distinct())
