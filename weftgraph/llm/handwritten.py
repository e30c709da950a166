"""Generated, minified or vendored source files, and data saved as code.

Two models are trained per language on all code files: character n-grams of identifiers, and how often the leading
word of a function's name comes again within a file. Each file is then measured: the cross-entropy of its
identifiers (mangled names are short and unlike the language's names), the share of functions whose leading words are
those of templates, its naming style against that of its language, how much of it is literal data, what its header
says about itself, and where it lies. Measures become evidence for one of four kinds; code that several repositories
hold, or that equals a file known to be third-party, is third-party too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_path
from ..session import materialize
from ..sources import code
from . import lexers
from .arrow import map_rows

ORDER = 3  # characters of an n-gram
#: A leading word is one of templates if files that have it have it this many times on average, if at least so many
#: files have it, and not more than this share of the files of its language (else it is how the language names things).
REPEATS, TEMPLATE_FILES, COMMON = 1.35, 5, 0.2
#: Share of functions with such a word from which a file is the output of a template.
TEMPLATED = 0.8
#: Repositories with the same code from which it is a copy.
COPIES = 2
#: Bits per n-gram above which a name is unlike the names of its language.
STRANGE = 3.6
#: Distinct identifiers a task counts before it hands its n-gram counts on.
FLUSH = 200_000

_IDENT = re.compile(r"[^\W\d][\w$]*")
_KEYWORDS = frozenset(
    "if else for while return in is not and or def class import from as try except finally with pass break continue lambda yield async await"
    " function const let var new this null true false undefined typeof void export default extends static public private protected package"
    " func type struct interface map chan go defer range select switch case fallthrough fn pub use mod impl trait enum match loop mut ref self Self"
    " super crate where move int long char float double bool boolean string number short unsigned signed include define ifdef endif namespace using"
    " template typename virtual override final throws throw catch do goto sizeof extern auto None True False i64 i32 u8 usize str".split()
)
_LEADING = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


_DIGITS, _FOREIGN = re.compile(r"\d+"), re.compile(r"[^\x00-\x7f]")


def grams(name: str) -> Iterator[str]:
    """n-grams of a name in lower case with its borders marked. Runs of digits count as one sign and letters beyond
    ASCII as another, so there are 31 signs, and a language has fewer than 31**3 n-grams however much is read."""
    name = _DIGITS.sub("0", name.lower())
    name = "^" + (name if name.isascii() else _FOREIGN.sub("\x7f", name)) + "$"
    for i in range(len(name) - ORDER + 1):
        yield name[i : i + ORDER]


class Model:
    """Bits per n-gram of the names of one language, smoothed: an unseen n-gram has a tenth of one occurrence; and the
    leading words of its templates."""

    def __init__(self, counts: dict[str, int], templates: frozenset[str] = frozenset()):
        self.counts, self.templates = counts, templates
        self.prefix: Counter = Counter()
        for g, n in counts.items():
            self.prefix[g[:-1]] += n
        self._known: dict[str, float] = {}

    def entropy(self, name: str) -> float:
        """Mean bits per n-gram of a name."""
        out = self._known.get(name)
        if out is None:
            gs = list(grams(name))
            out = sum(math.log2((self.prefix[g[:-1]] + 4.0) / (self.counts.get(g, 0) + 0.1)) for g in gs) / len(gs)
            if len(self._known) < FLUSH:
                self._known[name] = out
        return out


def identifiers(masked: str) -> list[str]:
    return [w for w in _IDENT.findall(masked) if w not in _KEYWORDS]


def mask(text: str, language: str) -> tuple[str, str, int]:
    """(code without comments and with strings emptied, header comments, characters inside strings)."""
    out, header, at, inside, code_seen = [], [], 0, 0, False
    for m in code._lexer(language).finditer(text):
        gap = text[at : m.start()]
        out.append(gap)
        code_seen = code_seen or bool(gap.strip())
        if m.lastgroup == "c":
            out.append(" ")
            if not code_seen:
                header.append("\n" * (gap.count("\n") > 1 or m[0].startswith("/*")) + m[0])
        elif language == "python" and m[0].lstrip("rRuUbB")[:3] in ('"""', "'''") and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            out.append('""')  # a string that stands for itself documents
            if not code_seen:
                header.append(m[0])
            code_seen = True
        else:
            out.append('""')
            inside += m.end() - m.start() - 2
            code_seen = True
        at = m.end()
    out.append(text[at:])
    return "".join(out), "\n".join(header), inside


def dense(text: str) -> bool:
    """Whether a text lacks the line breaks that a person sets; it would teach the models mangled names."""
    return sum(len(x) for x in text.split("\n") if len(x) > 300) > 0.3 * len(text)


def function_names(masked: str) -> list[str]:
    return [n for a, b in _FUNCTION.findall(masked) if (n := a or b) not in _NOT]


def leading_words(functions: list[str]) -> Counter:
    """How often each leading word of at least two letters begins a function's name."""
    return Counter(w for n in functions if (x := _LEADING.findall(n)) and len(w := x[0].lower()) > 1)


def train(contents: DataFrame) -> dict[str, Model]:
    """language -> model over all its files.

    Tasks count names first and n-grams second, so that a few thousand rows per task are shuffled. n-grams are
    bounded by their signs (see `grams`). An identifier counts once per file, so that repetitive files have no more
    say than others. Of the leading words only those of templates reach the driver: words that come again and again
    in few files are a small part of any language's words.
    """

    def stage(batches):
        names: Counter = Counter()
        words: Counter = Counter()
        files: Counter = Counter()

        def flush():
            counts: Counter = Counter()
            for (language, name), n in names.items():
                for g in grams(name):
                    counts[(language, g)] += n
            names.clear()
            rows = [(*k, n, 0) for k, n in counts.items()] + [(*k, n, files[k]) for k, n in words.items()]
            words.clear()
            files.clear()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["language", "item", "n", "files"]
                )

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                language = code.language_of(path)
                words[(language, "/")] += 1
                files[(language, "/")] += 1
                if not dense(text):
                    masked = mask(text, language)[0]
                    names.update((language, w) for w in set(identifiers(masked)))
                    for w, n in leading_words(function_names(masked)).items():
                        words[(language, f"/{w}")] += n  # no n-gram has a slash
                        files[(language, f"/{w}")] += 1
            if len(names) + len(words) > FLUSH:
                yield from flush()
        yield from flush()

    counts = contents.mapInArrow(stage, "language string, item string, n long, files long").groupBy("language", "item").agg(F.sum("n").alias("n"), F.sum("files").alias("files"))
    template = (F.col("n") >= REPEATS * F.col("files")) & (F.col("files") >= TEMPLATE_FILES)
    rows = counts.where(~F.startswith("item", F.lit("/")) | (F.col("item") == "/") | template).toLocalIterator()
    by: dict[str, dict[str, int]] = {}
    words: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["item"][0] == "/":
            words.setdefault(r["language"], {})[r["item"][1:]] = r["files"]
        else:
            by.setdefault(r["language"], {})[r["item"]] = r["n"]
    out = {}
    for k in words:
        every = words[k].pop("")
        out[k] = Model(by.get(k, {}), frozenset(w for w, n in words[k].items() if n <= max(COMMON * every, TEMPLATE_FILES)))
    return out


#: How a header says that its own file is the output of a tool. It must begin with these words.
GENERATED = re.compile(
    r"(?i)^(?:@generated\b|<auto-?generated\b|auto-?(?:matically)?[- ]?generated\b|generated (?:code|file|by|from|with|automatically|using)\b|code generated\b"
    r"|machine[- ](?:written|generated|made)\b|(?:this|the) (?:file|code|class|module|source)(?: here)? (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:produced|generated|created|written|built|emitted|compiled)\b(?! by hand)"
    r"|output of \S+|(?:produced|created|emitted|built|compiled) (?:automatically )?(?:by|from|with) \S+|do not (?:edit|modify|change)\b|source: \S+\.proto\b)"
)
_HAND = re.compile(r"(?i)\b(?:by hand|hand-?written|unlike|whether|loader for|maintained in this|emits?)\b")
#: How a header says that its file was taken from elsewhere.
VENDORED = re.compile(
    r"(?i)^(?:copied from\b|vendored (?:from|copy)\b|(?:taken|imported|adapted|borrowed) (?:verbatim )?from\b|third[- ]party\b|upstream:|bundled (?:copy )?of\b"
    r"|(?!since\b|version\b|as of\b|in\b|from\b|until\b|before\b|after\b|python\b|java\b|go\b)@?[\w./-]+(?: js)? v?\d+\.\d+(?:\.\d+)?[\w.-]*\s*(?:$|[|(,*-]|\s-\s))"
)
_TERMS = re.compile(r"(?i)licen[cs]e|\(c\)|copyright|upstream|released under|distributed under")
#: Characters of literals per function or declaration from which a file that is nine tenths literal is a table.
PART = 1000
_TAKEN = re.compile(r"(?i)(copied|vendored|taken|imported|adapted|borrowed|bundled|third)")
#: Lines of a header that are read whatever stands before them; further down (below a licence) a line must begin a
#: sentence, a bare name with its version a paragraph, since wrapped prose begins lines with any words.
TOP = 6
#: How functions of several words are usually written.
USUAL_STYLE = {"python": "snake", "rust": "snake", "c": "snake", "go": "camel", "java": "camel", "javascript": "camel", "typescript": "camel"}
#: Folders that hold packages of others; those of the second list only with a package name behind.
PACKAGES = {"node_modules", "bower_components", "site-packages", "dist-packages", "jspm_packages", "godeps", "pods", ".yarn", ".cargo"}
MAYBE_PACKAGES = {"vendor", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "extern", "vendored", "contrib"}
_VERSIONED = re.compile(r"[A-Za-z][\w.]*-v?\d+(?:\.\d+)+$")
_GENERATED_NAME = re.compile(r"(?i)(?:_pb2(?:_grpc)?|\.pb|_pb|[._]gen|\.g|\.generated|_generated|[._]grpc|grpc|_string|\.designer)\.\w+$")
_MINIFIED_NAME = re.compile(r"(?i)[.-](?:min|bundle|packed|prod)\.\w+$")
_NUMBER = re.compile(r"\b(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*\b")
_FUNCTION = re.compile(r"\b(?:def|fn|func|function)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_]\w*)|\b([A-Za-z_]\w*)\s*\([^(){};]*\)\s*(?::\s*\w+\s*)?\{")
_DECLARED = re.compile(r"^[ \t]*(?:async +)?(?:def|class|func|fn|function|impl|interface) +\w", re.M)
_NOT = {"if", "for", "while", "switch", "catch", "function", "return"}


def header_lines(header: str) -> list[tuple[str, bool, bool]]:
    """Lines with letters, each with whether it begins a paragraph and whether it begins a sentence."""
    out, before = [], ""
    for row in header.split("\n"):
        row = re.sub(r"^[\s/*#!;\"'<>-]*(?=[\w@(<])", lambda m: "<" if m[0].endswith("<") else "", row).strip()
        row = re.sub(r"\s*\*+/\s*$", "", row)
        if any(c.isalpha() for c in row):
            out.append((row, not before, not before or before[-1] in ".!?:;>" or not row[0].islower()))
            before = row
        else:
            before = ""
    return out


def sure_share(share: float, n: int) -> float:
    """The least that a share among n names is with near certainty (Wilson's bound)."""
    z = 3.0
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def style(name: str) -> str:
    """snake, camel, pascal, upper or plain."""
    if "_" in name.strip("_"):
        return "upper" if name.isupper() else "snake"
    if name[:1].isupper():
        return "upper" if name.isupper() and len(name) > 1 else "pascal"
    return "camel" if any(c.isupper() for c in name) else "plain"


def measure(path: str, text: str, models: dict[str, Model]) -> dict:
    """The measures of one file."""
    language = code.language_of(path)
    masked, header, inside = mask(text, language)
    names = identifiers(masked)
    model = models.get(language)
    distinct = set(names)
    body = len(re.sub(r"\s+", "", masked)) + inside
    numbers = sum(len(x) + 1 for x in _NUMBER.findall(masked))
    functions = function_names(masked)
    leading = leading_words(functions)
    lines = text.split("\n")
    long_share = sum(len(x) for x in lines if len(x) > 500) / max(1, len(text))
    bits = {n: model.entropy(n) for n in distinct} if model else {}
    strange = sum(1 for n in names if bits.get(n, 0.0) > STRANGE)
    code_only = re.sub(r"\s+", " ", masked).strip()
    return {
        "language": language,
        "entropy": sum(map(bits.get, names)) / len(names) if bits else 0.0,
        "mangled": strange / len(names) if names else 0.0,
        "names": len(names),
        "functions": len(functions),
        "diversity": len(leading) / leading.total() if leading else 1.0,
        "templated": sum(n for w, n in leading.items() if w in model.templates) / len(functions) if model and functions else 0.0,
        "data": (inside + numbers) / body if body else 0.0,
        "body": body,
        "declared": len(_DECLARED.findall(masked)),
        "long": long_share,
        "spaces": 1 - len(re.sub(r"\s", "", masked)) / max(1, len(masked)),
        "header": header_lines(header),
        "styles": Counter(style(n) for n in functions),
        "print": hashlib.md5(code_only.encode(), usedforsecurity=False).hexdigest() if len(code_only) >= 120 else None,
    }


def kind_of(path: str, m: dict) -> tuple[str | None, float]:
    """(generated | minified | vendored | data, weight of the evidence), or (None, weight) for a file written here.

    Evidence of at least 1 decides. Mangled names in dense text decide, and so do functions that are named after a
    template; a header that calls the file generated decides too, a generator's file name supports.
    """
    header = m["header"]
    says_generated = any(GENERATED.match(x) and not _HAND.search(x) for i, (x, _, sentence) in enumerate(header) if i < TOP or sentence)
    taken = [
        x for i, (x, paragraph, sentence) in enumerate(header)
        if VENDORED.match(x) and not _HAND.search(x) and (i < TOP or (sentence if _TAKEN.match(x) else paragraph))
    ]
    parts = path.split("/")[1:-1]
    lower = [p.lower() for p in parts]

    data = 0.0
    code_parts = max(m["functions"], m["declared"])
    if m["body"] >= 400 and m["data"] >= (0.9 if code_parts else 0.55) and m["data"] * m["body"] >= PART * code_parts:
        data = 1.0

    minified = 0.0
    if m["names"]:
        minified = 1.2 * min(1.0, sure_share(m["mangled"], m["names"]) / 0.4) * (1.0 if m["long"] > 0.3 or m["spaces"] < 0.09 else 0.4)
        minified += 0.3 * bool(_MINIFIED_NAME.search(path))
        minified *= m["mangled"] > 0.2

    generated = 1.0 * says_generated + 0.5 * bool(_GENERATED_NAME.search(path))
    if m["templated"] >= TEMPLATED and m["functions"] > 1:
        generated += 1.0

    vendored = 0.0
    if taken:
        vendored += 1.0 if any(map(_TAKEN.match, taken)) or any(_TERMS.search(x) for x, _, _ in header) else 0.4
    if any(p in PACKAGES for p in lower):
        vendored += 1.0
    for p, q in zip(lower, [*lower[1:], ""]):
        if p in MAYBE_PACKAGES and q:
            vendored += 1.0 if re.search(r"\d", q) or p in ("third_party", "third-party", "thirdparty", "3rdparty", "vendor", "vendored") else 0.4
        elif p in ("vendors", "lib", "libs", "src") and _VERSIONED.match(q):
            vendored += 1.0
    usual = USUAL_STYLE.get(m["language"])
    marked = sum(m["styles"][x] for x in ("snake", "camel"))
    if usual and marked >= 3 and m["styles"][usual] / marked < 0.3:  # names in a style foreign to the language
        vendored += 0.3
    found = [(data, "data"), (minified, "minified"), (generated, "generated"), (vendored, "vendored")]
    weight, kind = max(found, key=lambda x: x[0])
    return (kind, weight) if weight >= 1.0 else (None, weight)


_KNOWN = "(?i)\\.(" + "|".join(lexers.EXTENSIONS) + ")$"


def measured(contents: DataFrame) -> DataFrame:
    """(file_path, kind, weight, entropy, mangled, diversity, templated, data_share, print) of every code file with a text."""
    spark = contents.sparkSession
    files = contents.select(norm_path("file_path").alias("file_path"), "content").where(
        F.col("file_path").rlike(_KNOWN) & F.col("content").isNotNull()
    )
    models = spark.sparkContext.broadcast(train(files))  # at most 31**3 n-grams per language

    def make():
        m = models.value

        def one(path, text):
            x = measure(path, text, m)
            kind, weight = kind_of(path, x)
            yield path, kind, round(weight, 3), round(x["entropy"], 4), round(x["mangled"], 4), round(x["diversity"], 4), round(x["templated"], 4), round(x["data"], 4), x["print"]

        return one

    schema = "file_path string, kind string, weight double, entropy double, mangled double, diversity double, templated double, data_share double, print string"
    return map_rows(files, schema, make)


def not_handwritten(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, kind) of code files of the manifest that were not written by hand in their repository, each once.

    Files in doubt are vendored if other repositories hold the same code (fingerprint of the code without comments
    and blanks; a repository is the first part of the path), or if a file known as vendored does. Fingerprints are
    counted down to one row each before they meet the files. Null texts and paths are ignored, empty files are no cases.
    """
    from .syntax import code_paths

    m = measured(contents).groupBy("file_path").agg(F.max("kind").alias("kind"), F.max("print").alias("print"))
    m = materialize(m.join(code_paths(manifest).select("file_path"), "file_path", "left_semi"))  # measured once, read three times
    places = m.where("print is not null").select("print", F.substring_index("file_path", "/", 1).alias("repo"), (F.col("kind") == "vendored").alias("known"))
    places = places.groupBy("print", "repo").agg(F.max("known").alias("known")).groupBy("print").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    copied = places.where((F.col("n") >= COPIES) | F.col("known")).select("print")
    copies = m.where("kind is null and print is not null").join(copied, "print", "left_semi").select("file_path", F.lit("vendored").alias("kind"))
    return m.where("kind is not null").select("file_path", "kind").unionByName(copies)
