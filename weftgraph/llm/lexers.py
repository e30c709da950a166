"""Token rules per language and the walk from a text to the verdict of the parser.

Tokens are found by one compiled pattern per language; each distinct token string is classified once and
remembered, so that a file becomes a string of one-character terminals almost without Python code per token.
"""

from __future__ import annotations

import re

from . import grammars as G
from .glr import END, LIMIT, Grammar, Parser

BAD = "\x01"  # a terminal that no grammar has
NL = "\n"

_WORD = r"[^\W\d]\w*"
_NUMBER = r"\.?\d(?:[eEpP][+-](?=[\d_])|[\w.])*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"


class Lexer(dict):
    """Maps token strings to terminals; a missing one is classified by `classify` and kept."""

    def __init__(self, pattern: str, fixed: dict[str, str], classify):
        super().__init__(fixed)
        self._fixed, self._classify = fixed, classify
        self.find = re.compile(rf"[ \t\r\f\v ﻿]*+({pattern}|(?s:.)|\Z)", re.M)

    def __missing__(self, token: str) -> str:
        if len(self) > LIMIT:
            self.clear()
            self.update(self._fixed)
        out = self[token] = self._classify(token)
        return out

    def chars(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.find.findall(text)))


class Language:
    """A grammar with its lexer; `check` gives None or the line of the first error that cannot be recovered."""

    only_comments = True  # whether a text without any token parses
    word, number, newline_ends = "ID", re.compile(r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?"), ""

    def __init__(self, name: str, text: str, start: str, pattern: str, groups: dict[str, str] | None = None):
        self.name = name
        grammar = Grammar(text, start)
        kinds = sorted(grammar.terminals | {"ID", END})
        self.char = {t: chr(0x100 + i) for i, t in enumerate(kinds)}
        fixed = {t[1:-1]: c for t, c in self.char.items() if t[0] == "'"}
        for kind, members in (groups or {}).items():
            if kind in self.char:
                fixed.update((m, self.char[kind]) for m in members.split() if m not in fixed)
        symbols = sorted((x for x in fixed if not x[0].isalnum() and x[0] != "_"), key=len, reverse=True)
        pattern = pattern + "|" + "|".join(map(re.escape, symbols)) + "|\n"
        fixed |= {"\n": NL, "": ""}
        self.fixed = fixed
        self.parser = Parser(grammar, self.char)
        self.lexer = Lexer(pattern, fixed, self.classify)
        self.semi = self.char.get("';'", "")
        self.ends = frozenset(fixed[x] if x in fixed else self.char[x] for x in self.newline_ends.split() if x in fixed or x in self.char)

    def classify(self, t: str) -> str:
        c = t[0]
        if c.isalpha() or c in "_$":
            return self.char[self.word]
        if c.isdigit() or c == "." and len(t) > 1:
            return self.char["NUM"] if self.number.fullmatch(t) else BAD
        return self.other(t)

    def other(self, t: str) -> str:
        if t.startswith("//") or t.startswith("/*"):
            return NL * (NL in t)
        if t[0] == '"' and len(t) > 1:
            return self.char["STR"]
        if t[0] == "'" and len(t) > 1:
            return self.char["CHR"]
        return BAD

    def chars(self, text: str) -> str:
        return self.lexer.chars(text)

    def lines(self, text: str) -> list[str]:
        """Lines of terminals, after the language's rules for line ends."""
        return self.chars(text).split(NL)

    def place(self, text: str, n: int) -> int:
        """The line of the text in which the n-th line of terminals (from 0) begins; tokens may span lines."""
        at = 1
        for token in self.lexer.find.findall(text):
            n -= self.lexer[token].count(NL)
            if n < 0:
                break
            at += token.count("\n")
        return at

    def check(self, text: str) -> int | None:
        """None if the text parses, else the number (from 1) of the line of the first unrecoverable error.

        A text of white space only parses in every language.
        """
        p = self.parser
        if p.crowded():
            p.forget()
        if not text.strip():
            return None
        config, run, known = p.start, p.run, p.lines
        for n, line in enumerate(self.lines(text)):
            if line:
                nxt = known.get((config, line))
                config = run(config, line) if nxt is None else nxt
                if config < 0:
                    return self.place(text, n)
        return None if p.accepts(config) or config == p.start and self.only_comments else text.count("\n") + 1


class Go(Language):
    only_comments = False
    newline_ends = "ID NUM STR CHR break continue fallthrough return INC ) ] }"
    number = re.compile(r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?)i?")

    def __init__(self):
        super().__init__(
            "Go", G.GO, "file", rf"//[^\n]*|{_BLOCK}|`[^`]*`|{_DQ}|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'|{_WORD}|{_NUMBER}",
            {"BIN": "/ % == != < <= > >= && || ^ << >> &^ &", "ASG": "+= -= *= /= %= &= |= ^= <<= >>= &^=", "INC": "++ --"},
        )

    def other(self, t):
        return self.char["STR"] if t[0] == "`" and len(t) > 1 else super().other(t)

    def lines(self, text):
        ends, semi = self.ends, self.semi
        return [x + semi if x and x[-1] in ends else x for x in super().lines(text + "\n")]


class Java(Language):
    number = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?)[lLfFdD]?")

    def __init__(self):
        text_block, char = r'"""(?:[^"\\]|\\(?s:.)|"(?!""))*"""|""(?!")', r"'(?:[^'\\\n]|\\[^\n]{1,6}?)'"
        super().__init__(
            "Java", G.JAVA, "file", rf"//[^\n]*|{_BLOCK}|{text_block}|{_DQ}|{char}|(?:[^\W\d]|\$)[\w$]*|{_NUMBER}",
            {
                "BIN": "% == != <= && || ^ <<", "CMP": ">=", "ASG": "+= -= *= /= %= &= |= ^= <<=", "INC": "++ --",
                "PRIM": "int long short byte char boolean float double void",
                "MODIFIER": "public private protected native transient volatile strictfp",
            },
        )
        self.lexer.update(dict.fromkeys(("goto", "const"), BAD))  # reserved without a use


class CFamily(Language):
    number = re.compile(r"(?:0[xX][\da-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|[\d']*\.?[\d']*(?:[eE][+-]?\d+)?)[uUlLfFzZ]{0,3}")

    #: Other spellings of a word.
    aliases = {
        "__attribute__": "attribute", "__asm__": "asm", "__asm": "asm", "_Static_assert": "static_assert", "__typeof__": "typeof",
        "_Generic": "generic", "consteval": "constexpr", "constinit": "constexpr", "and": "&&", "not": "!", "or": "||", "xor": "^", "bitand": "&", "bitor": "|",
    }

    def __init__(self, cpp: bool):
        types = "void char short int long float double signed unsigned bool _Bool _Complex __int128"
        qualifiers = "const volatile static register extern typedef inline restrict __inline __restrict __extension__ __volatile__"
        if cpp:
            types += " wchar_t char8_t char16_t char32_t"
        else:
            qualifiers += " auto _Noreturn _Thread_local _Atomic"
        prefix = r"(?:u8|[uUL])?"
        comment = rf"//(?:[^\n\\]|\\(?s:.))*|{_BLOCK}"
        directive = rf"^[ \t]*#(?:[^\n\\/]|\\(?s:.)|/(?!\*)|{_BLOCK})*"
        raw = rf'{prefix}R"\((?s:.)*?\)"|{prefix}R"[^()\s\\"]{{1,16}}\((?s:.)*?\)[^()\s\\"]{{1,16}}"|' if cpp else ""
        char = rf"{prefix}'(?:[^'\\\n]|\\[^\n]{{1,10}}?)+'"
        number = r"\d(?:[eEpP][+-](?=\d)|'(?=\w)|[\w.])*|\.\d(?:[eE][+-]|\w)*"
        super().__init__(
            "C++" if cpp else "C", G.c_family(cpp), "unit", rf"{comment}|{directive}|{raw}{prefix}{_DQ}|{char}|[^\W\d][\w$]*|{number}",
            {
                "BIN": "/ % == != <= || | ^ <<" + (" .* ->*" if cpp else " >>"), "CMP": ">=", "INC": "++ --",
                "ASG": "+= -= *= /= %= &= |= ^= <<= >>=", "PRIM": types, "QUAL": qualifiers,
                "CAST": "static_cast dynamic_cast const_cast reinterpret_cast",
            },
        )
        for word, same in self.aliases.items():
            if same in self.fixed and (cpp or not word.isalpha()):
                self.fixed[word] = self.lexer[word] = self.fixed[same]
        for word in ("attribute", "generic"):  # only spelled with underscores are they special
            self.fixed[word] = self.lexer[word] = self.char["ID"]
        self.directive = re.compile(r"[ \t]*#[ \t]*(?:(?:include|include_next|import)[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_])|(?:define|undef|ifdef|ifndef)[ \t]+[A-Za-z_$]|(?:if|elif)\b|(?:else|endif|pragma|error|warning|line|elifdef|elifndef|embed)\b|(?:\d+\b)|$|/)")
        self.conditional = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b", re.M)

    def other(self, t):
        if t.lstrip()[:1] == "#":
            return "" if self.directive.match(t) else BAD
        return super().other(t)

    def classify(self, t):
        if t[-1] in "\"'" and len(t) > 1 and (t[0].isalpha()):
            return self.char["STR" if t[-1] == '"' else "CHR"]
        return super().classify(t)

    def plain(self, text):
        return super().check(text)

    def check(self, text, plain=None):
        plain = plain or self.plain
        bad = plain(text)
        if "#" not in text:
            return bad
        depth, branches = 0, False
        for m in self.conditional.finditer(text):
            k = m[1]
            if k.startswith("if"):
                depth += 1
            elif depth == 0:
                return text.count("\n", 0, m.start()) + 1
            elif k == "endif":
                depth -= 1
            branches |= k.startswith("el")
        if depth:
            return bad or text.count("\n") + 1
        if bad is None or not branches:
            return bad
        return self.selections(text, plain)

    def selections(self, text, plain):
        """The first error of a branch that parses in no selection of branches; the first branches go first."""
        spans, up, keys, stack = [], [], [], []  # of each conditional: its branches, (conditional, branch) around it, conditions
        end_of_line = re.compile(r"[^\n]*")
        for m in self.conditional.finditer(text):
            if m[1].startswith("if"):
                up.append((stack[-1], len(spans[stack[-1]]) - 1) if stack else None)
                stack.append(len(spans))
                spans.append([])
                keys.append([])
            else:
                spans[stack[-1]][-1][1] = m.start()
            if m[1] == "endif":
                stack.pop()
            else:
                spans[stack[-1]].append([m.start(), 0])
                keys[stack[-1]].append(self.condition(m[1], end_of_line.match(text, m.end())[0]))
        every = range(len(spans))
        last = [len(x) - (k[-1] is None) for x, k in zip(spans, keys)]  # the #else, or behind all branches the empty one
        left = {(i, b) for i in every for b in range(len(spans[i]))}

        def fails(choice, plain=plain):
            cuts = sorted((a, b) for i in every for j, (a, b) in enumerate(spans[i]) if j != choice[i])
            out, at = [], 0
            for a, b in cuts:
                if b > at:
                    out += [text[at : max(a, at)], "\n" * text.count("\n", max(a, at), b)]
                    at = b
            bad = plain("".join(out) + text[at:])
            if bad is None:
                for i, b in list(left):
                    x = (i, b)
                    while x and choice[x[0]] == x[1]:
                        x = up[x[0]]
                    if not x:
                        left.discard((i, b))
            return bad

        def around(x):
            out = {}
            while x:
                out[x[0]] = x[1]
                x = up[x[0]]
            return out

        def settle(some):
            forced = {}
            for x in some:
                forced |= around(x)
            bad = fails([forced.get(i, 0) for i in every])
            if bad is None:
                return None
            if len(some) > 1:
                half = len(some) // 2
                return settle(some[:half]) or settle(some[half:])
            b = some[0][1]
            tries = [[forced.get(i, min(b, last[i])) for i in every]]
            truth = {}  # conditions that hold or fail where the branch is read
            for i, j in forced.items():
                for k in keys[i][:j]:
                    truth[k[0]] = not k[1]
                if keys[i][j]:
                    truth[keys[i][j][0]] = keys[i][j][1]
            for unknown in (True, False):
                holds = lambda k: k is None or (truth[k[0]] == k[1] if k[0] in truth else unknown)  # noqa: B023, E731
                tries.append([forced.get(i, next((j for j, k in enumerate(keys[i]) if holds(k)), last[i])) for i in every])
            if any(fails(t) is None for t in tries):
                return None
            if any(k and "__cplusplus" in k[0] for i in forced for k in keys[i]):  # text for the other language
                other = language("C" if self.name == "C++" else "C++").plain
                if any(fails(t, other) is None for t in tries):
                    return None
            return bad

        bad = fails([0] * len(spans))
        for r in range(1, max(map(len, spans))):
            if bad is not None:
                return bad
            if left:
                fails([min(r, x) for x in last])
        while left and bad is None:
            forced, some = {}, []
            for x in sorted(left, key=lambda x: spans[x[0]][x[1]]):
                if all(forced.get(i, b) == b for i, b in around(x).items()):
                    forced |= around(x)
                    some.append(x)
            bad = settle(some)
        return bad

    @staticmethod
    def condition(word, rest):
        """(condition, whether it must hold) of a branch; None for #else."""
        rest = re.sub(r"\s+", " ", re.sub(r"//.*|/\*.*?\*/", "", rest)).strip()
        if word == "else":
            return None
        if word.endswith("def"):
            return rest, not word.endswith("ndef")
        m = re.fullmatch(r"(!?) ?defined ?\(? ?(\w+) ?\)?", rest)
        return (m[2], not m[1]) if m else (rest, True)


class CHeader:
    """A .h file may be C or C++; it is wrong only if it is neither."""

    name = "C"

    def __init__(self, c: CFamily, cpp: CFamily):
        self.c, self.cpp = c, cpp

    def plain(self, text):
        bad = self.c.plain(text)
        return bad and self.cpp.plain(text) and bad

    def check(self, text):
        return self.c.check(text, self.plain)


class Rust(Language):
    number = re.compile(r"(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|[\d][\d_]*(?:\.[\d][\d_]*)?\.?(?:[eE][+-]?[\d_]+)?)(?:_?[iu](?:8|16|32|64|128|size)|_?f(?:32|64))?")

    def __init__(self):
        names = {"BIN": "/ % == != <= ^ <<", "CMP": ">=", "ASG": "+= -= *= /= %= &= |= ^= <<=", "RANGE": "..="}
        every = sorted(set(re.findall(r"'[^']+'", G.RUST)) - {"'('", "')'", "'['", "']'", "'{'", "'}'"})
        tokens = " | ".join([*every, "ID", "NUM", "STR", "CHR", "LIFE", "BIN", "CMP", "ASG", "RANGE", "'$'", "'@'", "'~'"])
        nested = r"/\*(?:[^*]|\*(?!/))*\*/"
        comment = rf"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|{nested})*\*/"
        raw = "|".join(rf'(?:br|cr|r){h}"(?s:.)*?"{h}' for h in (r"\#\#\#", r"\#\#", r"\#"))
        string = r'(?:b|c)?"(?:[^"\\]|\\(?s:.))*"|(?:br|cr|r)"[^"]*"'
        char = r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]*\}|x[0-9a-fA-F]{2}|.))'"
        number = r"\d(?:[eE][+-](?=\d)|\w|\.(?=\d)|\.(?![.\w]))*"
        super().__init__(
            "Rust", G.RUST.replace("tree: TOKEN", "tree: " + tokens), "file",
            rf"{comment}|{raw}|{string}|{char}|'{_WORD}|r\#{_WORD}|{_WORD}|{number}",
            names,
        )
        self.lexer.update(dict.fromkeys(("abstract", "become", "final", "override", "priv", "typeof", "unsized", "virtual"), BAD))

    def classify(self, t):
        if t[-1] == '"' and len(t) > 1 or t[-1] == "#" and len(t) > 1:
            return self.char["STR"]
        if t[-1] == "'" and len(t) > 2:
            return self.char["CHR"]
        if t[0] == "'":
            return self.char["LIFE"] if len(t) > 1 else BAD
        return super().classify(t)


class Python(Language):
    _D = r"\d(?:_?\d)*"
    number = re.compile(
        r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?\d)*"
        rf"|(?:(?:{_D})?\.{_D}|{_D}\.)(?:[eE][+-]?{_D})?[jJ]?|{_D}[eE][+-]?{_D}[jJ]?|{_D}[jJ]"
    )
    _formatted = re.compile(r"(?i)(r?)[ft](r?)(\"{3}|'{3}|[\"'])")
    _conversion = re.compile(r"\s*![A-Za-z]\s*(?=[:}])")

    def __init__(self):
        p = r"(?i:[rub]|br|rb|[ft]|fr|rf|tr|rt)?"
        # a field of a formatted string may hold strings with the quotes of the whole
        field = r"\{(?:[^{}Q\n]|Q[^Q{}\n]*Q|\{[^{}]*\})*\}"
        nested = "|".join((rf"(?i:[ft]|[ft]r|r[ft])Q(?!QQ)(?:[^Q\\\n{{]|\\(?s:.)|\{{\{{|{field})*Q").replace("Q", q) for q in "\"'")
        super().__init__(
            "Python", G.PYTHON, "file",
            rf'\n[ \t\f]*|\#[^\n]*|\\\r?\n|{p}"""(?:[^"\\]|\\(?s:.)|"(?!""))*"""|{p}\'\'\'(?:[^\'\\]|\\(?s:.)|\'(?!\'\'))*\'\'\'|"""|\'\'\'|{nested}|{p}{_DQ}|{p}{_SQ}|{_WORD}|{_NUMBER}',
            {"CMP": "<= >= == !=", "BIN": "// % | & ^ << >>", "ASG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **="},
        )
        del self.fixed["\n"], self.lexer["\n"]
        c = self.char
        self.nl, self.indent, self.dedent = c["NEWLINE"], c["INDENT"], c["DEDENT"]
        self.open = {c[f"'{x}'"]: 1 for x in "([{"} | {c[f"'{x}'"]: -1 for x in ")]}"}
        self._delta: dict[str, int] = {}

    def classify(self, t):
        if t[0] == "\n":
            width = 0
            for x in t[1:]:
                width = width + 1 if x == " " else (width // 8 + 1) * 8 if x == "\t" else 0
            return NL + chr(0x4000 + min(width, 5000))
        if t[-1] in "\"'" and len(t) > 1 and t[0] not in "#\\" and t not in ('"""', "'''"):
            m = self._formatted.match(t)
            return self.char["STR"] if not m or self._fields(t, m.end(), len(t) - len(m[3]), bool(m[1] or m[2])) == len(t) - len(m[3]) else BAD
        return super().classify(t)

    def _fields(self, t: str, i: int, end: int, raw: bool, spec: bool = False) -> int:
        """Reads the text of a formatted string from i; its end, the index of the `}` behind a format, or -1 on an error."""
        while i < end:
            c = t[i]
            if c == "\\" and not raw:
                i = t.find("}", i) if t.startswith("N{", i + 1) else i + 1
                if i < 0:
                    return -1
            elif c == "}":
                if spec:
                    return i
                if not t.startswith("}}", i):
                    return -1
                i += 1
            elif c == "{":
                if not spec and t.startswith("{{", i):
                    i += 1
                else:
                    i = self._field(t, i + 1, end, raw)
                    if i < 0:
                        return -1
            i += 1
        return -1 if spec else i

    def _field(self, t: str, i: int, end: int, raw: bool) -> int:
        """The index of the `}` that ends the replacement field which begins at i; -1 if its expression does not parse."""
        depth, begin, quote = 0, i, ""
        while i < end:
            c = t[i]
            if quote:
                if c == "\\":
                    i += 1
                elif t.startswith(quote, i):
                    i += len(quote) - 1
                    quote = ""
            elif c in "\"'":
                quote = c * 3 if t.startswith(c * 3, i) else c
                i += len(quote) - 1
            elif c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            elif not depth and (c in "}:" or c == "!" and t[i + 1 : i + 2] != "="):
                break
            i += 1
        source = re.sub(r"(?<![=!<>])=\s*\Z", "", t[begin:i])  # `{x=}` shows the expression too
        if i >= end or not source.strip() or self.check(f"({source}\n)\n") is not None:
            return -1
        if t[i] == "!":
            m = self._conversion.match(t, i)
            if not m:
                return -1
            i = m.end()
        return self._fields(t, i + 1, end, raw, True) if t[i] == ":" else i

    def other(self, t):
        if t[0] == "#" or t[0] == "\\":
            return "" if t[0] == "#" or len(t) > 1 else BAD
        if t in ('"""', "'''"):
            return BAD
        return self.char["STR"] if len(t) > 1 and t[-1] in "\"'" else BAD

    def check(self, text):
        p = self.parser
        if p.crowded():
            p.forget()
            self._delta.clear()
        if not text.strip():
            return None
        text = "\n" + text.replace("\r\n", "\n").replace("\r", "\n")
        chars = self.chars(text)
        config, known, delta, run = p.start, p.lines, self._delta, p.run
        stack, depth, nl = [0], 0, self.nl
        n = 0
        for line in chars.split(NL)[1:]:
            n += 1
            if len(line) < 2:
                continue
            body = line[1:]
            if depth == 0:
                width = ord(line[0]) - 0x4000
                if width != stack[-1]:
                    if width > stack[-1]:
                        stack.append(width)
                        body = self.indent + body
                    else:
                        while width < stack[-1]:
                            stack.pop()
                            body = self.dedent + body
                        if width != stack[-1]:
                            return self.place(text, n)
            d = delta.get(body)
            if d is None:
                if len(delta) > LIMIT:
                    delta.clear()
                d = delta[body] = sum(map(self.open.get, body, [0] * len(body)))
            depth += d
            if depth <= 0:
                depth = 0
                body += nl
            nxt = known.get((config, body))
            config = run(config, body) if nxt is None else nxt
            if config < 0:
                return self.place(text, n) - 1
        if config == p.start:
            return None
        if not depth:
            config = run(config, self.dedent * (len(stack) - 1)) if len(stack) > 1 else config
            if p.accepts(config):
                return None
        return text.count("\n")


class JavaScript(Language):
    number = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?)n?")
    regex = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*"
    template = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{)|\$\{(?:[^{}`'\"]|\{[^{}`]*\}|'[^'\n]*'|\"[^\"\n]*\"|`[^`{}]*`)*\})*`"

    def __init__(self, typescript: bool):
        before = r"(?<=[(,=:\[!&|?{;+*%~^<>\-]){r}|(?<=[(,=:\[!&|?{;+*%~^<>\-] ){r}|^{r}|(?<=return ){r}|(?<=typeof ){r}|(?<=case ){r}".replace("{r}", self.regex)
        self.typescript = typescript
        super().__init__(
            "TypeScript" if typescript else "JavaScript", G.javascript(typescript), "program",
            rf"//[^\n]*|{_BLOCK}|\A\#![^\n]*|{before}|{self.template}|{_DQ}|{_SQ}|\#[\w$]+|(?:[^\W\d]|\$)[\w$]*|{_NUMBER}",
            {
                "BIN": "% ** == != === !== <= && || ?? ^ << " + ("" if typescript else "| & >> >>>"), "CMP": ">=",
                "ASG": "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=" + ("" if typescript else " >>= >>>="), "INC": "++ --",
            },
        )
        c = self.char
        self.after = frozenset(self.fixed[x] for x in ("return", "break", "continue"))
        self.close = self.fixed["}"]
        self.inc = c["INC"]

    def other(self, t):
        if t[:2] in ("//", "/*") or t.startswith("#!"):
            return NL * (NL in t)
        c = t[0]
        if c == "/" and len(t) > 2:
            return self.char["REGEX"]
        if c == "#" and len(t) > 1:
            return self.char["PRIVATE"]
        if c == "`" and len(t) > 1:
            inner = re.findall(r"\$\{((?:[^{}`'\"]|\{[^{}`]*\}|'[^'\n]*'|\"[^\"\n]*\"|`[^`{}]*`)*)\}", re.sub(r"\\.", "", t))
            return self.char["TPL"] if all(self.expression(x) for x in inner) else BAD
        if c in "\"'" and len(t) > 1:
            return self.char["STR"]
        return BAD

    def expression(self, text: str) -> bool:
        chars = "".join(map(self.lexer.__getitem__, self.lexer.find.findall(text))).replace(NL, "")
        return self.parser.accepts(self._finish(self.parser.run(self.parser.start, self.fixed["("] + chars + self.fixed[")"])))

    def _finish(self, config: int) -> int:
        if config >= 0 and not self.parser.accepts(config):
            config = self.parser.step(config, self.semi)
        return config

    def line(self, config: int, line: str) -> int:
        """A line with semicolons put in where the grammar does not allow the next token (start of line or `}`)."""
        step, semi, close = self.parser.step, self.semi, self.close
        for i, c in enumerate(line):
            nxt = step(config, c)
            if nxt < 0 and (i == 0 or c == close):
                nxt = step(config, semi)
                nxt = step(nxt, c) if nxt >= 0 else -1
            if nxt < 0:
                return -1
            if i == 0 and c == self.inc and line != c:  # no line end before a postfix operator
                split = step(config, semi)
                nxt = step(split, c) if split >= 0 and step(split, c) >= 0 else nxt
            config = nxt
        if line[-1] in self.after:
            end = step(config, semi)
            config = end if end >= 0 else config
        return config

    def check(self, text):
        p = self.parser
        if p.crowded():
            p.forget()
        if not text.strip():
            return None
        bad = self._check(self.chars(text).split(NL))
        return None if bad is None or not self._again(text) else self.place(text, bad - 1)

    def _check(self, lines: list[str]) -> int | None:
        config, known = self.parser.start, self.parser.lines
        for n, line in enumerate(lines):
            if line:
                nxt = known.get((config, line))
                if nxt is None:
                    nxt = known[(config, line)] = self.line(config, line)
                config = nxt
                if config < 0:
                    return n + 1
        return None if config == self.parser.start or self.parser.accepts(self._finish(config)) else len(lines)

    def _again(self, text: str) -> bool:
        """Whether a careful tokenisation (nested templates, expressions before a slash, JSX) has an error too."""
        try:
            return self._check("".join(self._careful(text)).split(NL)) is not None
        except SyntaxError:
            return True

    def _careful(self, text: str, i: int = 0, stop: str = "") -> list[str]:
        out, prev, depth = [], "", 0
        value = {self.char[x] for x in ("ID", "NUM", "STR", "TPL", "REGEX", "PRIVATE", "INC")} | {self.fixed[x] for x in (")", "]", "}", "this", "super", "true", "false", "null")}
        value |= {self.fixed[x] for x in G._JS_SOFT + G._TS_SOFT if x in self.fixed}
        regex, end = re.compile(self.regex), len(text)
        while i < end:
            c = text[i]
            if c in " \t\r\f\v":
                i += 1
                continue
            if c == "`":
                i, t = self._template(text, i), self.char["TPL"]
            elif c == "/" and text[i + 1 : i + 2] not in ("/", "*") and prev not in value and (m := regex.match(text, i)):
                i, t = m.end(), self.char["REGEX"]
            elif c == "<" and prev not in value and (text[i + 1 : i + 2].isalpha() or text[i + 1 : i + 2] == ">") and (j := self._jsx(text, i)):
                i, t = j, self.char["ID"]
            else:
                m = self.lexer.find.match(text, i)
                if not m[1]:
                    break
                i = m.end()
                t = self.lexer[m[1]]
                if stop and c in "{}" and m[1] == c:
                    depth += 1 if c == "{" else -1
                    if depth < 0:
                        self._at = i
                        return out
            out.append(t)
            prev = t[-1:] if t and t != NL else prev
        if stop:
            raise SyntaxError
        return out

    def _braces(self, text: str, i: int) -> int:
        """The index after the `}` that ends the expression that begins at i, which must parse."""
        chars = "".join(self._careful(text, i, "}")).replace(NL, "")
        end = self._at
        if chars and not self.parser.accepts(self._finish(self.parser.run(self.parser.start, self.fixed["("] + chars + self.fixed[")"]))) and not chars.startswith(self.fixed["..."]):
            raise SyntaxError
        return end

    def _template(self, text: str, i: int) -> int:
        i += 1
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                i = self._braces(text, i + 2)
            else:
                i += 1
        raise SyntaxError

    _tag = re.compile(r"<([\w.:$-]*)(?:<[\w., ]*>)?")
    _attribute = re.compile(r"\s*([\w:$-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|\{))?|\s*(\{)|\s*(/?>)|\s*/\*(?:[^*]|\*(?!/))*\*/")

    def _jsx(self, text: str, i: int) -> int:
        """The index after the JSX element at i, 0 if there is none."""
        m = self._tag.match(text, i)
        if not m:
            return 0
        name, i = m[1], m.end()
        while True:
            m = self._attribute.match(text, i)
            if not m or m.end() == i:
                return 0
            i = m.end()
            if m[2] == "{" or m[3]:
                i = self._braces(text, i)
            elif m[4] == "/>":
                return i
            elif m[4]:
                break
        while i < len(text):
            if text.startswith("</", i):
                m = re.compile(r"</\s*([\w.:$-]*)\s*>").match(text, i)
                return m.end() if m and m[1] == name else 0
            if text[i] == "<":
                i = self._jsx(text, i)
                if not i:
                    return 0
            elif text[i] == "{":
                i = self._braces(text, i + 1)
            else:
                i += 1
        return 0


#: Extensions of the languages with a bundled grammar.
EXTENSIONS = {
    "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "go": "Go",
    "java": "Java", "rs": "Rust", "c": "C", "h": "header", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++",
}
_made: dict[str, object] = {}


def language(name: str):
    """The parser of a language, built on first use in each process; None if no grammar is bundled."""
    if name not in _made:
        make = {
            "Python": Python, "JavaScript": lambda: JavaScript(False), "TypeScript": lambda: JavaScript(True), "Go": Go, "Java": Java,
            "Rust": Rust, "C": lambda: CFamily(False), "C++": lambda: CFamily(True), "header": lambda: CHeader(language("C"), language("C++")),
        }.get(name)
        _made[name] = make() if make else None
    return _made[name]


def for_path(path: str):
    """The parser for a file name, by its extension."""
    return language(EXTENSIONS.get(path.rpartition("/")[2].rpartition(".")[2].lower(), ""))
