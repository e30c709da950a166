"""Lexical reader of source code: comments, classes, functions, imports and calls of a file, without a compiler.

Comments and strings are masked by blanks of the same length first; declarations are then found by one pattern
per language family and closed by their matching bracket (Python: by indentation). Lines count from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Extension -> language, as the extractor knows them.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "rake": "ruby",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "php": "php", "cs": "c_sharp", "lua": "lua", "hs": "haskell",
    "ex": "elixir", "exs": "elixir", "sh": "shell", "bash": "shell", "dart": "dart", "zig": "zig", "css": "css", "scss": "css",
}


def language_of(path: str) -> str | None:
    name = path.replace("\\", "/").rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None


@dataclass
class Comment:
    first: int
    last: int
    text: str
    begin: int
    own_line: bool  # nothing but blanks before it


@dataclass
class Function:
    name: str
    owner: str  # name of the class around it, or ""
    line: int  # of the name
    first: int  # of the first annotation or modifier
    last: int
    begin: int
    end: int
    params: list[str]
    docstring: str | None = None
    calls: list[str] = field(default_factory=list)


@dataclass
class Class:
    name: str
    line: int
    begin: int
    end: int
    docstring: str | None = None


@dataclass
class Parsed:
    language: str
    comments: list[Comment]
    functions: list[Function]
    classes: list[Class]
    masked: str
    text: str = ""


_STR2, _STR1 = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"
_HASH = r"#[^\n]*"
_SKIP = {  # comment pattern, string pattern
    "python": (_HASH, r"(?i:[rbuf]{0,2})(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*(?:\"\"\"|\Z)|'''(?:[^'\\]|\\.|'(?!''))*(?:'''|\Z)|" + f"{_STR2}|{_STR1})"),
    "rust": (_C_COMMENT, r'r#+"[\s\S]*?"#+|' + r'"(?:[^"\\]|\\.)*"' + r"|'(?:[^'\\\n]|\\[^\n]{1,8}?)'"),
    "go": (_C_COMMENT, rf"`[^`]*`|{_STR2}|{_STR1}"),
    "javascript": (_C_COMMENT, rf"`(?:[^`\\]|\\.)*`|{_STR2}|{_STR1}|(?<=[=(,:] )/(?![*/])(?:[^/\\\n\[]|\\.|\[[^\]\n]*\])+/"),
    "lua": (r"--\[\[[\s\S]*?\]\]|--[^\n]*", rf"{_STR2}|{_STR1}"),
    "haskell": (r"\{-[\s\S]*?-\}|--[^\n]*", _STR2),
    "shell": (r"(?:(?<=\s)|^)#[^\n]*", rf"{_STR2}|'[^']*'"),
    "css": (r"/\*[\s\S]*?\*/", rf"{_STR2}|{_STR1}"),
}
_SKIP["typescript"] = _SKIP["javascript"]
for _l in ("ruby", "elixir"):
    _SKIP[_l] = (_HASH, _SKIP["python"][1])
_DEFAULT = (_C_COMMENT, rf"{_STR2}|{_STR1}")
_SKIP["php"] = (_C_COMMENT + "|" + _HASH, _DEFAULT[1])
_compiled: dict[str, re.Pattern] = {}


def comment_marks(language: str) -> str:
    return _SKIP.get(language, _DEFAULT)[0]


def _lexer(language: str) -> re.Pattern:
    if language not in _compiled:
        c, s = _SKIP.get(language, _DEFAULT)
        _compiled[language] = re.compile(f"(?P<c>{c})|(?P<s>{s})", re.S | re.M)
    return _compiled[language]


_MOD = r"(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|override|virtual|inline|constexpr|extern|unsafe|const|synchronized|native|open|suspend|explicit|friend|readonly|get|set|declare|function|local)\s+"
#: language -> patterns with the groups `name`; `(` must follow the name where a parameter list exists.
_FUNCTIONS = {
    "python": r"^[ \t]*+(?:async[ \t]+)?def[ \t]+(?P<name>\w+)",
    "ruby": r"^[ \t]*+def[ \t]+(?:self\.)?(?P<name>\w+[?!=]?)",
    "elixir": r"^[ \t]*+(?:defp?|defmacrop?)[ \t]+(?P<name>\w+[?!]?)",
    "go": r"^func[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<name>\w+)(?=[ \t]*[(\[])",
    "rust": r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+|async\s+|const\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?|default\s+)*fn\s+(?P<name>\w+)",
    "swift": rf"^[ \t]*+(?:{_MOD})*func\s+(?P<name>\w+)", "kotlin": rf"^[ \t]*+(?:{_MOD})*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>\w+)(?=\s*\()",
    "scala": rf"^[ \t]*+(?:{_MOD})*def\s+(?P<name>\w+)", "php": rf"^[ \t]*+(?:{_MOD})*function\s+&?(?P<name>\w+)",
    "lua": r"^[ \t]*+(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<name>\w+)", "shell": r"^[ \t]*+(?:function\s+)?(?P<name>[\w-]+)\s*\(\s*\)\s*(?=\{)",
    "haskell": r"^(?P<name>[a-z_][\w']*)\s*::", "zig": r"^[ \t]*+(?:pub\s+|export\s+|inline\s+)*fn\s+(?P<name>\w+)",
    "javascript": r"^[ \t]*+(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)(?=\s*[(<])"
    r"|^[ \t]*+(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)[ \t]+)*(?:\*[ \t]*)?(?P<name2>#?[\w$]+)(?=\s*[(<])"
    r"|^[ \t]*+(?:export\s+)?(?:const|let|var)\s+(?P<name3>[\w$]+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?=\(|[\w$]+\s*=>|function\b)",
    "java": r"^[ \t]*+(?:@\w+(?:\([^)\n]*\))?\s+)*(?:[\w.$]+(?:<[^;(){}=]*>)?(?:\[\])*\s+|<[^;(){}=]*>\s+)*(?P<name>[\w$]+)(?=\s*\([^;{}=]*\)\s*(?:throws\s+[\w., ]+\s*)?\{)",
    "c": r"^[ \t]*+(?:template\s*<[^;{}()]*>\s*)?(?:(?!(?:return|else|case|goto|throw|new|delete|public|private|protected)\b)[\w:~]+(?:<[^;(){}=]*>)?[\s*&]+)*(?P<name>~?(?:\w+::)*~?\w+|(?:\w+::)*operator\s*[^\s(]+)(?=\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|volatile|&|\s|->\s*[\w:<>*&]+)*(?::[^;{}]*(?:\{[^{}]*\}[^;{}]*)*)?\{)",
}
_FUNCTIONS |= {"typescript": _FUNCTIONS["javascript"], "cpp": _FUNCTIONS["c"], "c_sharp": _FUNCTIONS["java"], "dart": _FUNCTIONS["java"]}
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "new", "with", "sizeof", "match", "when", "synchronized", "using", "lock", "foreach", "constructor_"}
_CLASSES = {
    "python": r"^[ \t]*+class[ \t]+(?P<name>\w+)", "ruby": r"^[ \t]*+(?:class|module)\s+(?P<name>[A-Z]\w*)", "elixir": r"^[ \t]*+defmodule\s+(?P<name>[\w.]+)",
    "go": r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\b", "rust": r"^[ \t]*+(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union)\s+(?P<name>\w+)",
    "haskell": r"^(?:class|data|newtype|type)\s+(?P<name>[A-Z]\w*)", "css": r"^[ \t]*+(?P<name>[.#]?[\w-]+)(?=[^{};]*\{)", "zig": r"\bconst\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union|opaque)\b",
}
_CLASS = r"^[ \t]*+(?:[\w@]+\s+)*?(?:class|struct|interface|enum|trait|protocol|object|record|mixin|extension)\s+(?P<name>\w+)(?=[^;(){}=]*[({]|[^;(){}=]*$)"
_IMPL = re.compile(r"^[ \t]*impl\b(?:<[^>]*>)?\s*(?:[\w:<>', ]+\s+for\s+)?(?P<name>\w+)", re.M)
_RECEIVER = re.compile(r"func[ \t]*\(\s*(?:\w+\s+)?\*?(\w+)")
_patterns: dict[tuple[str, str], re.Pattern] = {}


def _pattern(kind: str, language: str) -> re.Pattern | None:
    key = (kind, language)
    if key not in _patterns:
        source = (_FUNCTIONS.get(language) if kind == "f" else _CLASSES.get(language, _CLASS if language not in ("lua", "shell") else None))
        _patterns[key] = re.compile(source, re.M) if source else None
    return _patterns[key]


_METHOD, _ARROW = re.compile(r"\s*(?::[^{};=\n]+)?\{"), re.compile(r"\s*(?::[^{};=\n]+)?=>")
_OPEN, _CLOSE = "([{", ")]}"
_BRACKET = re.compile(r"[(){}\[\]]")
_PARAM = re.compile(r"[\w$]+")


class _Brackets:
    """Matching brackets of a masked text."""

    def __init__(self, text: str):
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for m in _BRACKET.finditer(text):
            c, i = m[0], m.start()
            if c in _OPEN:
                stack.append(i)
            elif stack and _OPEN.index(text[stack[-1]]) == _CLOSE.index(c):
                self.match[stack.pop()] = i
            elif c == "}":  # recover: drop what was left open inside
                while stack and text[stack[-1]] != "{":
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = i


def _params(text: str, language: str) -> list[str]:
    """Names in a parameter list, cut at commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in text + ",":
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        if c == "," and depth <= 0:
            part = part.split("=")[0].strip()
            if part:
                if ":" in part or language in ("python", "javascript", "go", "rust", "kotlin", "swift", "scala", "php", "ruby", "lua", "elixir"):
                    names = _PARAM.findall(part.split(":")[0])
                    names = [n for n in names if n not in ("mut", "ref", "readonly", "public", "private", "val", "var")]
                    name = names[0] if names else ""
                else:
                    names = _PARAM.findall(part)
                    name = names[-1] if names else ""
                if name and name not in ("self", "cls", "this", "void"):
                    out.append(name)
            part = ""
        else:
            part += c
    return out


def _docstring(text: str, language: str, body: int) -> str | None:
    """The string literal that a Python body begins with."""
    m = re.compile(r"[ \t]*(?:#[^\n]*)?\r?\n(?:[ \t]*\r?\n)*[ \t]*((?i:[ru]{0,2})(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|[ \t]*((?i:r?)(\"\"\"[\s\S]*?\"\"\"))").match(text, body)
    if not m:
        return None
    return m[2] or m[4]


_ANNOTATION = re.compile(r"\s*(?:@[\w.]+(?:\(.*\))?|#!?\[.*\]|\[\[?\w+.*\]|__attribute__\s*\(.*\)|template\s*<.*>|[A-Z_]+\(\w*\))\s*$")
_ANNOTATION_HEAD = re.compile(r"\s*(?:@[\w.]+\s*\(|#!?\[|\[(?=\[?[A-Za-z_])|__attribute__\s*\(|[A-Z_]+\()")


def _annotation(n: int, lines: list[str], masked: str, opens: dict[int, int], starts: list[int]) -> int | None:
    """Line (from 0) on which the annotation begins that ends on line n, if one does; opens: closing -> opening bracket."""
    if _ANNOTATION.match(lines[n]):
        return n
    end = starts[n] + len(masked[starts[n] : starts[n] + len(lines[n])].rstrip()) - 1
    if end < starts[n]:
        return None
    if masked[end] in ")]" and end in opens:
        at = bisect_right(starts, opens[end]) - 1
        head = _ANNOTATION_HEAD.match(masked, starts[at])
        return at if head and head.end() == opens[end] + 1 else None
    if masked[end] == ">":
        begin = masked.rfind("template", 0, end)
        at = bisect_right(starts, begin) - 1
        if begin >= 0 and re.fullmatch(r"template\s*<[^;{}]*>", masked[begin : end + 1]) and not masked[starts[at] : begin].strip():
            return at
    return None


def parse(text: str, language: str) -> Parsed:
    """Comments, functions and classes of a text. Unbalanced code is read as far as its brackets match."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line = lambda i: bisect_right(starts, i)
    comments, parts, at = [], [], 0
    for m in _lexer(language).finditer(text):
        parts += [text[at : m.start()], re.sub(r"[^\n]", " ", m[0]) if m.lastgroup == "c" or len(m[0]) < 2 else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]]
        at = m.end()
        if m.lastgroup == "c":
            head = text[starts[line(m.start()) - 1] : m.start()]
            comments.append(Comment(line(m.start()), line(m.end() - 1), m[0], m.start(), not head.strip()))
    masked = "".join(parts) + text[at:]
    if language == "python":
        masked = re.sub(r"[\"']", " ", masked)
    classes, functions = [], []
    brackets = _Brackets(masked) if language not in ("python", "haskell") else None
    opens = {b: a for a, b in brackets.match.items()} if brackets else {}
    lines = masked.split("\n")
    indented = language in ("python",)

    def block_end(n: int, begin: int, after: int) -> int:
        """Offset of the end of the declaration that begins on line n."""
        if indented:
            depth = len(lines[n - 1]) - len(lines[n - 1].lstrip())
            k = line(after)
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
                k += 1
            while k > n and not lines[k - 1].strip():
                k -= 1
            return starts[k] if k < len(starts) else len(text)
        if brackets is None:
            return starts[n] if n < len(starts) else len(text)
        m = re.compile(r"[{;]").search(masked, after)
        if language in ("ruby", "elixir", "lua"):
            depth = len(lines[n - 1]) - len(lines[n - 1].lstrip())
            for k in range(n, len(lines)):
                if lines[k].strip().startswith("end") and len(lines[k]) - len(lines[k].lstrip()) == depth:
                    return starts[k + 1] if k + 1 < len(starts) else len(text)
            return len(text)
        if not m or m[0] == ";":
            return m.end() if m else len(text)
        return brackets.match.get(m.start(), len(text) - 1) + 1

    pattern = _pattern("c", language)
    for m in pattern.finditer(masked) if pattern else ():
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        n = line(m.start("name"))
        end = block_end(n, begin, m.end())
        doc = None
        if language == "python":
            colon = masked.find(":", m.end())
            doc = _docstring(text, language, colon + 1) if colon >= 0 else None
        classes.append(Class(m["name"], n, begin, end, doc))
    spans = [(c.begin, c.end, c.name) for c in classes]
    if language == "rust":
        spans += [(m.start(), block_end(line(m.start()), m.start(), m.end()), m["name"]) for m in _IMPL.finditer(masked)]
    pattern = _pattern("f", language)
    for m in pattern.finditer(masked) if pattern else ():
        name = next(g for g in m.groups() if g)
        if name in _NOT_NAMES:
            continue
        at = m.start(m.lastgroup) if m.lastgroup else m.start()
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        open_ = re.compile(r"\s*(?:<[^(){}]*>|\[[^\]]*\])?\s*\(").match(masked, m.end())
        params, after = [], m.end()
        if open_:
            if brackets is None or language == "python":
                depth, k = 0, open_.end() - 1
                while k < len(masked):
                    depth += (masked[k] in _OPEN) - (masked[k] in _CLOSE)
                    if depth == 0:
                        break
                    k += 1
                close = k
            else:
                close = brackets.match.get(open_.end() - 1, open_.end())
            params, after = _params(masked[open_.end() : close], "javascript" if language == "typescript" else language), close
        if m.lastgroup == "name2" and not (open_ and _METHOD.match(masked, after + 1)):
            continue
        if m.lastgroup == "name3" and open_ and not _ARROW.match(masked, after + 1):
            continue
        n = line(at)
        end = block_end(n, begin, after)
        owner = next((c for a, b, c in reversed(spans) if a < begin and end <= b), "")
        if language == "go" and (r := _RECEIVER.match(masked, begin)):
            owner = r[1]
        if language == "cpp" and "::" in name:
            owner, _, name = name.rpartition("::")
        doc = None
        if language == "python":
            colon = re.compile(r"[^:\n]*:").match(masked, after)
            doc = _docstring(text, language, colon.end()) if colon else None
        first = line(begin)
        while first > 1 and (above := _annotation(first - 2, lines, masked, opens, starts)) is not None:
            first = above + 1
        functions.append(Function(name, owner, n, first, line(max(begin, end - 1)), begin, end, params, doc))
    return Parsed(language, comments, functions, classes, masked, text)


_CALL = re.compile(r"(?:[\w$]+(?:\.|::|->))*([\w$]+)(?:!?)\s*\(")
_KEYWORDS = _NOT_NAMES | {"def", "func", "fn", "fun", "class", "struct", "lambda", "yield", "await", "assert", "print_", "and", "or", "not", "in", "is", "elif", "except", "raise", "del", "case", "throw", "super_"}


def calls(p: Parsed, f: Function) -> list[str]:
    """Callee names in the body of a function, in order, repeated ones once; `f` itself is a call only if it recurs."""
    body = p.masked[f.begin : f.end]
    head = body.find(f.name)
    return list(dict.fromkeys(m[1] for m in _CALL.finditer(body, head + len(f.name)) if m[1] not in _KEYWORDS))


_STRING = r"[\"'`](?P<s>)"  # a module name begins behind this quote
#: language -> patterns of whole import statements over masked text. `s` marks the begin of a quoted name, which is
#: read from the text itself; `m` is a name or a list of names, `from` what the names of the list are relative to.
_IMPORTS = {
    "python": (r"(?:^|[;:])[ \t]*from[ \t]+(?P<from>\.*[ \t]*[\w.]*)[ \t\\\n]+import\b[ \t]*(?P<m>\([^)]*\)|(?:[^\n;\\]|\\\n)+)|(?:^|[;:])[ \t]*import[ \t]+(?P<m2>(?:[^\n;\\]|\\\n)+)",),
    "javascript": (
        rf"\bimport\b\s*(?:type\s+)?(?:[\w$*{{}},\s]*?\bfrom\s*)?{_STRING}", rf"\bexport\s+(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{{[^}}]*\}})\s*from\s*{_STRING}",
        rf"(?<![\w$.])(?:require|import)\s*\(\s*{_STRING}",
    ),
    "rust": (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<m>[^;]+);", r"^[ \t]*(?:pub\s+)?extern\s+crate\s+(?P<m>\w+)"),
    "go": (rf"^import[ \t]+(?:[\w.]+[ \t]+)?{_STRING}", r"^import[ \t]*\((?P<block>[^)]*)\)"),
    "java": (r"^[ \t]*import\s+(?:static\s+)?(?P<m>[\w.$*]+)",),
    "scala": (r"^[ \t]*import\s+(?P<m>[\w.$*_]+(?:\.?\{[^}]*\})?(?:\s*,\s*[\w.$*_]+(?:\.?\{[^}]*\})?)*)",),
    "c": (r"^[ \t]*#[ \t]*(?:include|include_next|import)[ \t]*(?:<(?P<m>[^>\n]+)>|\"(?P<s>))",),
    "swift": (r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:class|struct|enum|protocol|func|var|let|typealias)[ \t]+)?(?P<m>[\w.]+)",),
    "css": (rf"@(?:import|use|forward)\s+(?:url\(\s*)?{_STRING}", r"@import\s+url\(\s*(?P<m>[^\"'\s)]+)"),
    "elixir": (r"^[ \t]*(?:import|alias|use|require)[ \t]+(?P<m>[A-Z][\w.]*(?:\{[^}]*\})?)",),
    "ruby": (rf"^[ \t]*(?:require|require_relative|load)\b[ \t(]*{_STRING}", rf"^[ \t]*autoload[ \t(]+:\w+,[ \t]*{_STRING}"),
    "php": (r"^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?(?P<m>\\?[A-Za-z][\w\\]*(?:\{[^}]*\})?[^;({]*);", rf"\b(?:require|include)(?:_once)?\b[ \t(]*{_STRING}"),
    "c_sharp": (r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?(?P<m>[A-Za-z_][\w.]*)[ \t]*(?:<[^;]*>)?;",),
    "haskell": (r"^import[ \t]+(?:safe[ \t]+)?(?:qualified[ \t]+)?(?P<m>[A-Z][\w.]*)",),
    "lua": (rf"\brequire\b[ \t(]*{_STRING}",), "dart": (rf"^[ \t]*(?:import|export|part)[ \t]+{_STRING}",), "shell": (r"^[ \t]*(?:source|\.)[ \t]+(?P<m>[\w./-]+)",),
    "zig": (rf"@import\s*\(\s*{_STRING}",),
}
_IMPORTS |= {"typescript": _IMPORTS["javascript"], "cpp": _IMPORTS["c"], "kotlin": _IMPORTS["java"]}
_QUOTE = re.compile(r"[\"`]")
_GROUP = re.compile(r"[{},]")


def _leaves(tree: str, joint: str) -> list[str]:
    """The paths of a grouped import such as `a::{b, c::{d, e as f}}`; other names (`as`, `=>`) are left out, and `self`,
    `_` and `*` stand for the path before them."""
    out, stack, part = [], [""], ""

    def close():
        name = re.split(r"\s+as\s+|\s*=>\s*", part.strip())[0].strip()
        if name:
            path = (stack[-1] + name).removesuffix("*").removesuffix(joint)
            for end in ("self", "_"):
                if path == end or path.endswith(joint + end):
                    path = path[: -len(end)].removesuffix(joint)
            out.append(path)

    at = 0
    for m in _GROUP.finditer(tree):
        part += tree[at : m.start()]
        at = m.end()
        if m[0] == "{":
            stack.append(stack[-1] + part.strip())
        else:
            close()
            if m[0] == "}" and len(stack) > 1:
                stack.pop()
        part = ""
    part += tree[at:]
    close()
    return [x for x in out if x]


def imports(p: Parsed) -> list[tuple[int, str]]:
    """(line, module) of the import statements of a text, in order, each once per line.

    Statements are read whole, over line ends, groups and lists, and only outside of comments and strings. Relative
    modules lose their dots; `from . import a` imports a.
    """
    found: list[tuple[int, str]] = []
    starts = [0] + [m.end() for m in re.finditer("\n", p.masked)]

    def quoted(at: int) -> str:
        quote = p.text[at - 1]
        return p.text[at : end] if 0 <= (end := p.text.find(quote, at)) else ""

    for source in _IMPORTS.get(p.language, ()):
        key = ("i", source)
        if key not in _patterns:
            _patterns[key] = re.compile(source, re.M)
        for m in _patterns[key].finditer(p.masked):
            groups, where = m.groupdict(), m.start() + len(m[0]) - len(m[0].lstrip(" \t\n;:"))
            line = bisect_right(starts, where)
            if groups.get("block") is not None:
                at = m.start("block")
                while q := _QUOTE.search(p.masked, at, m.end("block")):
                    name = quoted(q.end())
                    found.append((bisect_right(starts, q.start()), name))
                    at = q.end() + len(name) + 1
            elif groups.get("s") is not None:
                found.append((line, quoted(m.start("s"))))
            elif p.language == "python":
                base = re.sub(r"\s", "", groups["from"] or "").lstrip(".")
                names = [base] if base else [re.split(r"\s+as\s+", x.strip(" \t\n\\()"))[0] for x in (groups["m"] or groups["m2"]).split(",")]
                found += [(line, x) for x in names if re.fullmatch(r"[\w.]+", x)]
            else:
                joint = {"rust": "::", "php": "\\"}.get(p.language, ".")
                grouped = p.language in ("rust", "scala", "elixir", "php")
                found += [(line, x.strip("\\")) for x in (_leaves(groups["m"], joint) if grouped else [groups["m"].strip()])]
    return sorted({(n, x) for n, x in found if x})
