"""A generalised LR recogniser whose automaton is built lazily and memoised.

A grammar is given as text (see `Grammar`). States are LR(0) item sets with SLR look-ahead, made on first use.
Parse stacks are interned: a stack is a number that stands for (state, rest of the stack). A configuration is
the set of stacks that are alive after a prefix of the input; it is interned too, so that the step
(configuration, token) -> configuration, and likewise (configuration, line of tokens) -> configuration, are
dictionary look-ups once seen. Because lists are left-recursive, the stack at the start of a statement depends
only on the nesting around it, and most lines of a large collection are look-ups. The memo never changes a
result; it is dropped when it grows beyond `LIMIT`.
"""

from __future__ import annotations

import re
from collections import defaultdict

#: Memo entries and interned stacks after which a parser forgets what it has learnt (bounds the memory).
LIMIT = 200_000

_SYMBOL = re.compile(r"'[^']+'|[A-Za-z_]\w*|[|\[\]{}()]")
END = "$end"


class Grammar:
    """Rules `name: alternatives` with 'literal' and UPPERCASE terminals, [optional], {repeated} and (grouped)
    parts; a rule goes on over indented lines. Options are expanded and repetitions become left-recursive lists,
    so no production is empty."""

    def __init__(self, text: str, start: str):
        self.rules: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        self._made: dict[tuple, str] = {}
        source: dict[str, str] = {}
        name = ""
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = re.match(r"(\w+):\s*(.*)", line)
            if m and not line[0].isspace():
                name = m[1]
                source[name] = source[name] + " | " + m[2] if name in source else m[2]
            else:
                source[name] += " " + line.strip()
        for name, body in source.items():
            tokens = _SYMBOL.findall(body)
            tree, rest = self._alternatives(tokens, 0)
            if rest != len(tokens):
                raise ValueError(f"unbalanced rule {name}")
            self._emit(name, tree)
        top = "$start"
        self.rules[top] = [(start, END)]
        self.nonterminals = set(self.rules)
        for name, alternatives in self.rules.items():
            for alternative in alternatives:
                for x in alternative:
                    if x[0] not in "'$" and not x.isupper() and x not in self.rules:
                        raise ValueError(f"{name} uses {x}, which has no rule")
        self.productions: list[tuple[str, tuple[str, ...]]] = []
        self.of: dict[str, list[int]] = defaultdict(list)
        for name, alternatives in self.rules.items():
            for alternative in dict.fromkeys(alternatives):
                self.of[name].append(len(self.productions))
                self.productions.append((name, alternative))
        self.top = self.of[top][0]
        self.terminals = {x for _, r in self.productions for x in r if x not in self.nonterminals}
        self._follow()

    def _alternatives(self, tokens: list[str], i: int) -> tuple[tuple, int]:
        out, seq = [], []
        while i < len(tokens):
            t = tokens[i]
            if t == "|":
                out.append(tuple(seq))
                seq = []
            elif t in "[{(":
                inner, i = self._alternatives(tokens, i + 1)
                seq.append((t, inner))
            elif t in "]})":
                break
            else:
                seq.append(t)
            i += 1
        out.append(tuple(seq))
        return tuple(out), i

    def _emit(self, name: str, tree: tuple) -> None:
        for seq in tree:
            for flat in self._expand(seq):
                if flat:
                    self.rules[name].append(flat)

    def _named(self, kind: str, tree: tuple) -> str:
        key = (kind, tree)
        if key not in self._made:
            name = self._made[key] = f"${kind}{len(self._made)}"
            if kind == "(":
                self._emit(name, tree)
            else:
                item = self._named("(", tree) if len(tree) > 1 or len(tree[0]) != 1 or isinstance(tree[0][0], tuple) else tree[0][0]
                self.rules[name] = [(item,), (name, item)]
        return self._made[key]

    def _expand(self, seq: tuple) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [()]
        for x in seq:
            if isinstance(x, str):
                choices: list[tuple[str, ...]] = [(x,)]
            elif x[0] == "[":
                choices = [(), *(f for s in x[1] for f in self._expand(s))] if len(x[1]) == 1 else [(), (self._named("(", x[1]),)]
            elif x[0] == "{":
                choices = [(), (self._named("{", x[1]),)]
            else:
                choices = [(self._named("(", x[1]),)]
            out = [a + b for a in out for b in choices]
        return out

    def _follow(self) -> None:
        first: dict[str, set[str]] = defaultdict(set)
        for t in self.terminals:
            first[t].add(t)
        changed = True
        while changed:
            changed = False
            for name, r in self.productions:
                n = len(first[name])
                first[name] |= first[r[0]]
                changed |= len(first[name]) != n
        self.follow: dict[str, set[str]] = defaultdict(set)
        changed = True
        while changed:
            changed = False
            for name, r in self.productions:
                for i, x in enumerate(r):
                    if x in self.nonterminals:
                        n = len(self.follow[x])
                        self.follow[x] |= first[r[i + 1]] if i + 1 < len(r) else self.follow[name]
                        changed |= len(self.follow[x]) != n


class Parser:
    """Runs a grammar over strings of one-character terminals; `chars` maps each terminal to its character."""

    def __init__(self, grammar: Grammar, chars: dict[str, str]):
        self.g = grammar
        self.char = chars
        self.terminal = {c: t for t, c in chars.items()}
        self._kernels: dict[frozenset, int] = {}
        self._goto: list[dict[str, int]] = []
        self._actions: list[dict[str, tuple[int | None, tuple[tuple[int, str], ...]]]] = []
        self._reduce: list[dict[str, list[tuple[int, str]]]] = []
        self._start = self._state(frozenset({(grammar.top, 0)}))
        self.forget()

    def forget(self) -> None:
        """Drop interned stacks and memos; configurations obtained before are void."""
        self.state, self.parent = [self._start], [-1]
        self._node: dict[tuple[int, int], int] = {}
        self._config: dict[frozenset, int] = {frozenset({0}): 0}
        self._members: list[frozenset] = [frozenset({0})]
        self._step: dict[tuple[int, str], int] = {}
        self.lines: dict[tuple[int, str], int] = {}
        self.start = 0

    def crowded(self) -> bool:
        return len(self.state) + len(self._step) + len(self.lines) > LIMIT

    def _state(self, kernel: frozenset) -> int:
        if kernel in self._kernels:
            return self._kernels[kernel]
        n = self._kernels[kernel] = len(self._goto)
        items, todo = set(kernel), list(kernel)
        while todo:
            p, dot = todo.pop()
            r = self.g.productions[p][1]
            if dot < len(r) and r[dot] in self.g.nonterminals:
                for q in self.g.of[r[dot]]:
                    if (q, 0) not in items:
                        items.add((q, 0))
                        todo.append((q, 0))
        moves, reduce = defaultdict(set), defaultdict(list)
        for p, dot in items:
            name, r = self.g.productions[p]
            if dot < len(r):
                moves[r[dot]].add((p, dot + 1))
            else:
                for t in self.g.follow[name]:
                    reduce[t].append((len(r), name))
        self._goto.append({x: frozenset(k) for x, k in moves.items()})
        self._reduce.append(reduce)
        self._actions.append({})
        return n

    def _go(self, state: int, symbol: str) -> int | None:
        k = self._goto[state].get(symbol)
        if isinstance(k, frozenset):
            k = self._goto[state][symbol] = self._state(k)
        return k

    def _push(self, parent: int, state: int) -> int:
        n = self._node.get((parent, state))
        if n is None:
            n = self._node[(parent, state)] = len(self.state)
            self.state.append(state)
            self.parent.append(parent)
        return n

    def step(self, config: int, char: str) -> int:
        """The configuration after one more token; -1 if no stack survives."""
        out = self._step.get((config, char))
        if out is None:
            out = self._step[(config, char)] = self._advance(config, char)
        return out

    def _advance(self, config: int, char: str) -> int:
        t = self.terminal.get(char)
        if t is None:
            return -1
        state, parent = self.state, self.parent
        seen = set(self._members[config])
        todo, alive = list(seen), set()
        while todo:
            n = todo.pop()
            s = state[n]
            action = self._actions[s].get(t)
            if action is None:
                action = self._actions[s][t] = (self._go(s, t), tuple(self._reduce[s].get(t, ())))
            if action[0] is not None:
                alive.add(self._push(n, action[0]))
            for length, name in action[1]:
                m = n
                for _ in range(length):
                    m = parent[m]
                g = self._go(state[m], name)
                if g is not None:
                    k = self._push(m, g)
                    if k not in seen:
                        seen.add(k)
                        todo.append(k)
        if not alive:
            return -1
        key = frozenset(alive)
        c = self._config.get(key)
        if c is None:
            c = self._config[key] = len(self._members)
            self._members.append(key)
        return c

    def run(self, config: int, chars: str) -> int:
        """Step through a line of tokens, remembered as a whole."""
        key = (config, chars)
        out = self.lines.get(key)
        if out is None:
            out = config
            for c in chars:
                out = self.step(out, c)
                if out < 0:
                    break
            self.lines[key] = out
        return out

    def accepts(self, config: int) -> bool:
        return config >= 0 and self.step(config, self.char[END]) >= 0
