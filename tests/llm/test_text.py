import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import docpairs, handwritten, leaks, mixing, repetition


# repetition ------------------------------------------------------------------------------------------------------

def brute_repeated(ws):
    covered = set()
    for i in range(len(ws) - 4):
        if any(ws[j : j + 5] == ws[i : i + 5] for j in range(i)):
            covered |= set(range(i, i + 5))
    return len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words_against_brute_force(ws):
    assert repetition.repeated(ws) == brute_repeated(ws)


def sentences(n, seed=0):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(900)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def test_bands_keep_every_repetitive_text():
    """Texts of any length of which just 30 % of the words are repeated must be candidates."""
    b = repetition.Bands()
    for n in (20, 60, 100, 200, 500, 2000, 20000):
        for seed in range(4):
            base = sentences(int(n * 0.69), seed).split()
            ws, k = list(base), 0
            while repetition.repeated(ws) < 0.3 * len(ws):
                ws += base[k : k + 7]
                k += 11
                if k + 7 > len(base):
                    ws += base[:n]
            data = " ".join(ws).encode()
            assert b.verdict(len(data), *b.ratios(data)) == "repetitive", (n, seed)


@given(st.lists(st.sampled_from("abc"), min_size=5, max_size=60))
def test_bound_never_misses(ws):
    assert repetition.may_repeat(ws) or repetition.repeated(ws) < repetition.SHARE * len(ws)


def test_repetitive_texts_of_dense_words(spark):
    rng = random.Random(9)
    rows, b = [], repetition.Bands()
    for i, (n, letters) in enumerate([(20000, "abcdefghijklmnopqrstuvwxyz"), (2000, [chr(0x4E00 + x) for x in range(3000)])]):
        base = ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)]
        text = " ".join(base + [w for k in rng.sample(range(n - 5), n // 11) for w in base[k : k + 5]])
        rows.append((i, text))
        assert b.verdict(len(text.encode()), *b.ratios(text.encode())) != "repetitive"
    got = {r["doc_id"]: r["repeated_share"] for r in repetition.repetitive(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got) == [0, 1] and all(0.3 <= x < 0.4 for x in got.values()), got


def test_repetitive_documents(spark):
    half = sentences(40)
    rows = [(1, half + " " + half), (2, half), (3, None), (4, ""), (5, "a b c d"), (6, "x " * 10), (7, half.upper() + " 12 - " + half), (7, half), (8, "é ü ß " * 9), (9, sentences(200_000) + " spam and ham and eggs" * 60_000)]
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, repeated_share string, n_words int")
    assert {r["doc_id"] for r in repetition.repetitive(d).collect()} == {1, 6, 7, 8, 9}
    s = {r["doc_id"]: r["repeated_share"] for r in repetition.shares(d.where("doc_id <> 7")).collect()}
    assert s[1] == 0.5 and s[2] == s[3] == s[4] == s[5] == 0.0 and s[6] == 0.9
    assert {r["doc_id"]: r["band"] for r in repetition.bands(d).collect()}[9] == "repetitive"
    assert repetition.repetitive(d.limit(0)).count() == 0


# mixing ----------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 1), st.integers(1, 5), st.integers(0, 1000)), min_size=1, max_size=8), st.integers(1, 5000))
def test_water_filling(parts, total):
    shares = mixing.water_fill([mixing.Share(str(i), t, r, n) for i, (t, r, n) in enumerate(parts)], total)
    caps = sum(s.max_repeats * s.available for s in shares)
    assert sum(s.tokens for s in shares) == pytest.approx(min(total, caps))
    assert all(s.tokens <= s.max_repeats * s.available + 1e-6 for s in shares)
    free = [s.tokens / s.target for s in shares if s.tokens < s.max_repeats * s.available - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(free) + 1e-9
    for s in shares:  # a clamped source would have got more
        if free and s.tokens >= s.max_repeats * s.available - 1e-6:
            assert s.tokens / s.target <= max(free) * (1 + 1e-6)


def test_mix(spark):
    docs = [(i, "Read Me" if i % 2 else "read_me ", "word " * (i % 7 + 1)) for i in range(400)] + [(1000 + i, "notes", "one two three four") for i in range(20)]
    docs += [(2000, None, "x"), (2001, "other", "y"), (2002, "notes", None), (2003, "notes", "")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, source string, text string, n_tokens int, u int")
    t = spark.createDataFrame([("read_me", 0.7, 1, "x"), ("NOTES", 0.2, 3, "x"), ("absent", 0.1, 5, "x"), (None, 0.5, 1, "x")], "source string, target_share double, max_repeats int, b string")
    m = mixing.mix(d, t, seed=3, total=600)
    rows = {r["doc_id"]: r for r in m.documents.collect()}
    assert {r["source"] for r in rows.values()} == {"read_me", "notes"} and 2000 not in rows and 2001 not in rows
    assert all(r["copies"] <= (1 if r["source"] == "read_me" else 3) for r in rows.values())
    rep = {r["source"]: r for r in m.report.collect()}
    assert rep["absent"]["mixed_tokens"] == 0 and rep["notes"]["available_tokens"] == 80
    assert rep["read_me"]["actual_share"] == pytest.approx(7 / 9, abs=0.02) and rep["notes"]["mixed_tokens"] == pytest.approx(600 * 2 / 9, abs=5)
    again = mixing.mix(d.repartition(7), t, seed=3, total=600).documents
    assert {(r["doc_id"], r["copies"]) for r in again.collect()} == {(k, r["copies"]) for k, r in rows.items()}
    other = {r["doc_id"] for r in mixing.mix(d, t, seed=4, total=600).documents.collect()}
    assert other != set(rows)
    empty = mixing.mix(d.limit(0), t)
    assert empty.documents.count() == 0 and {r["mixed_tokens"] for r in empty.report.collect()} == {0}
    assert mixing.mix(d, t.limit(0)).documents.count() == 0


# leaks -----------------------------------------------------------------------------------------------------------

def edit_within(p, t, k):
    """Plain semi-global edit distance on words."""
    row = list(range(len(p) + 1))
    for x in t:
        prev, row[0] = row[0], 0
        for i, y in enumerate(p, 1):
            prev, row[i] = row[i], min(prev + (x != y), row[i] + 1, row[i - 1] + 1)
        if row[-1] <= k:
            return True
    return False


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=8), st.lists(st.sampled_from("abcd"), max_size=16), st.integers(0, 3))
def test_bit_parallel_distance(p, t, k):
    if len(p) > k:
        assert leaks.distance(p, t, k) == edit_within(p, t, k)


def test_matcher_against_brute_force():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: [r.choice(vocabulary) for _ in range(r.randint(20, 45))] for i in range(12)}
    m = leaks.Matcher(items)
    for _ in range(120):
        item = r.choice(list(items))
        w = items[item]
        at = r.randint(0, len(w) - 20)
        part = w[at : at + 20 + r.randint(-4, 4)]
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(part))
            part = r.choice([part[:k] + ["new"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["new"] + part[k:]])
        doc = [r.choice(vocabulary) for _ in range(30)] + part + [r.choice(vocabulary) for _ in range(30)]
        want = {i for i, x in items.items() if any(edit_within(x[s : s + 20], doc, leaks.BUDGET) for s in range(len(x) - 19))}
        assert m.find(" ".join(doc)) == want


def test_matcher_looks_at_every_window_of_a_diagonal():
    item = [f"w{i}" for i in range(80)]
    for changed in range(4, 9):  # words replaced among the first 20; the first piece and the last 60 words stay
        doc = list(item)
        for i in random.Random(changed).sample(range(4, 20), changed):
            doc[i] = "zz"
        assert leaks.Matcher({1: item}).find(" ".join(["before"] * 3 + doc)) == {1}, changed
    far = item[:4] + ["zz"] * 40 + item[44:50] + ["zz"] * 8 + item[58:]  # hits that fail in between
    assert leaks.Matcher({1: item}).find(" ".join(far)) == {1}
    assert leaks.Matcher({1: item}).find(" ".join(item[:4] + ["zz"] * 4 + item[8:12] + ["zz"] * 4 + item[16:24])) == set()


def test_leaks(spark):
    p = {i: sentences(30, i) for i in range(6)}
    ask = "Read the passage and answer the question that follows with as few words as you can please do not add anything else to it"
    items = [(i, "s", f"{ask}\n\n{p[i]}\n\nQuestion {i}?") for i in range(5)] + [(9, "s", f"{ask}\n\n{p[1]}\n\nOther?"), (10, "s", None), (10, "s", None), (11, "t", "too short")]
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, suite string, text string, doc_id int")
    w = p[0].split()
    wrapped = "\n".join(" ".join(w[k : k + 5]) for k in range(0, 30, 5))
    docs = [
        (1, "before " + wrapped.upper() + " after"), (2, " ".join(w[:12])), (3, p[1]), (4, "<b>" + "</b>, <i>".join(w[:22]) + "</i>"),
        (5, " ".join([*w[3:9], "other", *w[10:17], "word", *w[18:25]])), (6, ask), (7, None), (8, ""), (9, p[5]), (10, " ".join(w[:8] + p[5].split()[:6] + w[8:16])),
        (11, " ".join(w[:10]) + "-\n".join([" " + w[10][:2], w[10][2:]]) + " " + " ".join(f"&#96;{x}&#96;" for x in w[11:21])), (3, p[1]),
    ]
    docs += [(12, " ".join(f"[{x}](https://a.org/{k})" for k, x in enumerate(w[2:25]))), (13, " ".join(x[:1] + "\u00ad" + x[1:] for x in w[:21]))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    got = sorted({tuple(r) for r in leaks.leaks(d, it).collect()})
    assert got == [(1, 0), (3, 1), (3, 9), (4, 0), (5, 0), (11, 0), (12, 0), (13, 0)]
    assert leaks.leaks(d.limit(0), it).count() == 0 and leaks.leaks(d, it.limit(0)).count() == 0
    assert leaks.report(leaks.leaks(d, it), it).where("item_id = 9").first()["n_docs"] == 2


def test_passages_that_a_small_suite_shares_and_long_tags(spark):
    ask, p = sentences(8, 50), sentences(24, 51)
    it = spark.createDataFrame([(i, "s", f"{ask}\n\n{p}\n\nQuestion {i}?") for i in range(3)] + [(7, "t", p)], "item_id long, suite string, text string")
    w = p.split()
    tag, broken = "<a href='" + "x" * 250 + "'>", "<a\nhref='x'>"
    docs = [(k, " ".join((t if i % 4 == 0 else "") + x for i, x in enumerate(w))) for k, t in enumerate(("<b>", tag, broken))]
    docs += [(3, "if a <b then\n" + p + "\n and c > d"), (4, ask)]  # no tag, though it looks like one
    got = sorted(map(tuple, leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()))
    assert got == [(d, i) for d in range(4) for i in (0, 1, 2, 7)]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 2)
    it = spark.createDataFrame([(i, f"s{i}", sentences(25, i)) for i in range(5)], "item_id long, suite string, text string")
    d = spark.createDataFrame([(i, sentences(25, i)) for i in range(5)], "doc_id long, text string")
    assert sorted(map(tuple, leaks.leaks(d, it).collect())) == [(i, i) for i in range(5)]


# documentation pairs -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize(
    "text, name",
    [
        ("", "f"), ("/** */", "f"), ('""" """', "f"), ("///", "f"), ("/**\n *\n */", "f"), ("TODO", "f"), ("// TODO: write docs", "f"), ("n/a", "f"), ("tbd.", "f"), ("...", "f"),
        ("==========", "f"), ("<p></p>", "f"), ("@param a\n@return", "f"), (":param a:\n:return:", "f"), ("Args:\n    a:\n    b:\nReturns:", "f"), ("@Override", "f"), ("{@inheritDoc}", "f"),
        ("eslint-disable-next-line no-unused-vars", "f"), ("# noqa: E501", "f"), ("nolint:errcheck", "f"), ("see above", "f"), ("Same as above.", "f"), ("See foo.bar()", "f"), ("@see Other#run", "f"),
        ("Load the cache", "load_cache"), ("loadCache()", "loadCache"), ("The loadCache function.", "loadCache"), ("Method: loads cache", "load_cache"), ("function load cache", "LoadCache"),
        ("No description provided.", "f"), ("Auto-generated method stub", "f"), ("FIXME document this", "f"), ("@deprecated", "f"), ("pylint: disable=all", "f"), ("xxx", "f"),
    ],
)
def test_trivial(text, name):
    assert not docpairs.informative(text, name)


@pytest.mark.parametrize(
    "text, name",
    [
        ("/** Opens the file and reads its header. */", "open"), ("TODO: speed this up. Every index of the table is rebuilt.", "f"), ("Load our cold cache after three retries.", "load_cache"),
        ("Der Zeiger ersetzt den Lauf.", "f"), ("La cola bloquea el módulo.", "f"), ("Le module ignore le dépôt.", "f"), ("返回列表中的第一个元素。", "first"),
        ("@param path the file that is opened first\n@return the header", "open"), ("// Returns nil if the queue is empty.", "pop"), ("# Sorts by weight", "order"), ("'''Deprecated: use the pool instead.'''", "f"),
    ],
)
def test_informative(text, name):
    assert docpairs.informative(text, name)


def docs_of(path, text):
    return {f.name: (d and docpairs.strip_marks(d)) for f, d, _ in docpairs.pairs_of(path, text)}


def test_matching():
    assert docs_of("a.go", "package a\n\n// Alpha one.\nfunc A() {}\n\n// Section.\n\nfunc B() {}\n\n// Gamma\n// two.\nfunc C() {}\n") == {"A": "Alpha one.", "B": None, "C": "Gamma\ntwo."}
    assert docs_of("a.rs", "/// Doc.\n#[inline]\npub fn f() {}\nfn g() {} // trailing\nfn h() {}\n") == {"f": "Doc.", "g": None, "h": None}
    assert docs_of("a.py", "# not a docstring\ndef f():\n    '''Doc.'''\n\n\ndef g():\n    x = 'no'\n") == {"f": "Doc.", "g": None}
    assert docs_of("A.java", "class A {\n  /** Doc. */\n  @Override\n  public int f() { return 1; }\n  int g() { return 2; }\n}\n") == {"f": "Doc.", "g": None}


def test_matching_over_annotations_of_several_lines():
    java = 'class A {\n  /** Doc. */\n  @RequestMapping(\n    value = "/x)",\n    method = GET\n  )\n  @Deprecated\n  public int f() { return 1; }\n}\n'
    assert docs_of("A.java", java) == {"f": "Doc."}
    assert docs_of("a.rs", "/// Doc.\n#[cfg(\n    any(a,\n    b)\n)]\npub fn f() {}\n// Other.\nlet x = [\n1,\n];\nfn g() {}\n") == {"f": "Doc.", "g": None}
    assert docs_of("a.cpp", "/// Doc.\ntemplate <\n  typename T,\n  typename U\n>\nint f(T a) { return 1; }\n") == {"f": "Doc."}
    ts = "class A {\n  /** Doc. */\n  @Input({\n    a: 1,\n    b: 2,\n  })\n  f() { return 1; }\n}\n"
    assert docs_of("a.ts", ts) == {"f": "Doc."}
    assert docs_of("a.js", "/** Doc. */\n// eslint-disable-next-line no-x\nfunction f() {}\n") == {"f": "Doc."}
    assert docs_of("a.js", "/** Doc. */\nrun(\n  1\n)\nfunction f() {}\n") == {"f": None}


def test_assignment_is_optimal():
    r = random.Random(2)
    from itertools import permutations

    for _ in range(200):
        n, k = r.randint(1, 4), r.randint(0, 4)
        links = {i: own for i in range(n) if (own := {j: round(r.uniform(-1, 1), 2) for j in range(k) if r.random() < 0.6})}
        got = docpairs.assign(links)
        assert len(set(got.values())) == len(got)
        cost = lambda chosen: sum(links[i][j] for i, j in chosen.items()) + docpairs.REJECT * (n - len(chosen))
        slots = [*range(k), *[None] * n]
        best = min(
            cost({i: j for i, j in enumerate(p) if j is not None})
            for p in set(permutations(slots, n))
            if all(j is None or j in links.get(i, {}) for i, j in enumerate(p))
        )
        assert cost(got) == pytest.approx(best)


def test_tags_and_names_decide_between_comments():
    tags = "/**\n * Opens the file.\n * @param path where\n * @param mode how\n */\n"
    assert docs_of("a.js", tags + "\nfunction open(path, mode) {}\n") == {"open": "Opens the file.\n@param path where\n@param mode how"}  # fits over a blank line
    assert docs_of("a.js", tags + "\nfunction shut(handle) {}\n") == {"shut": None}
    assert docs_of("a.js", "// Not about open().\n\nfunction open(path) {}\n") == {"open": None}  # a mention does not reach that far
    stale = "/**\n * Stale words here.\n * @param socket gone\n */\n"
    assert docs_of("a.js", tags + stale + "function open(path, mode) {}\n")["open"].startswith("Opens")  # tags overrule distance
    assert docs_of("a.js", stale + "function open(path, mode) {}\n")["open"].startswith("Stale")  # the only one there is
    other = "/**\n * Was moved to shut.\n * @param socket gone\n */\n"
    assert docs_of("a.js", other + "function open(path, mode) {}\nfunction shut(path) {}\n") == {"open": None, "shut": None}  # near, but about another
    assert docs_of("a.js", tags + "run();\nfunction open(path, mode) {}\n") == {"open": None}  # code in between
    assert docs_of("a.py", "# Counts the open files.\n@cached\ndef count():\n    return 1\n\n# Section.\n\ndef g():\n    pass\n") == {"count": "Counts the open files.", "g": None}


def test_pairs(spark):
    files = [("r/a.py", "def f(x):\n    '''Doubles what comes in.'''\n    return x\n\ndef g():\n    pass\n\nclass C:\n    def f(self):\n        '''Method of the class here.'''\n"), ("r/a.py", "def f(x):\n    '''Doubles what comes in.'''\n    return x\n"), ("r/n.py", None), (None, "x")]
    c = spark.createDataFrame([(*x, "z") for x in files[:1] + files[2:]] * 2, "file_path string, content string, name string")
    nodes = [
        ("a::f", "f()", "code", "r\\a.py", 1, None), ("a::f", "f()", "code", "r/a.py", None, " "), ("a::g", "g()", "code", "r/a.py", 5, None), ("a::C::f", "f()", "code", "r/a.py", None, None),
        ("b::h", "h()", "code", "r/gone.py", 1, "Closes every open handle."), ("b::i", "i()", "code", "r/gone.py", 1, "TODO"), ("b::j", "j()", "code", None, None, "Keeps the oldest entry."),
        ("a::C", "C", "code", "r/a.py", 8, "A class with words."), ("d::k", "k()", "document", "r/a.py", 1, "Some words in here."), (None, "l()", "code", "r/a.py", 1, "x y z"), ("m", None, "code", "r/a.py", 1, "x y z"),
    ]
    layout = "id string, label string, file_type string, source_file string, source_line int, docstring string, owner string, loaded_at int"
    n = spark.createDataFrame([(*x, "q", 1) for x in nodes], layout)
    assert sorted(r["node_id"] for r in docpairs.documented_ids(n, c).collect()) == ["a::C::f", "a::f", "b::h", "b::j"]
    p = {r["node_id"]: r for r in docpairs.pairs(n, c).collect()}
    assert set(p) == {"a::C::f", "a::f", "b::h", "b::j"} and p["a::f"]["doc"] == "Doubles what comes in." and p["a::f"]["code"].startswith("def f(x)")
    assert p["a::C::f"]["doc"] == "Method of the class here." and p["b::h"]["code"] is None and p["a::f"]["from_source"]
    assert docpairs.documented_ids(n.limit(0), c).count() == 0 and docpairs.documented_ids(n, c.limit(0)).count() == 2


def test_rows_of_an_id_are_not_mixed(spark):
    rows = [("a", "old()", "code", "r/old.py", 3, "Keeps the oldest entry of all.", 1), ("a", "new()", "code", "r/a.py", 9, " ", 2), ("b", "f()", "code", "z.py", 1, None, 1), ("b", "g()", "code", "a.py", 7, None, 2)]
    n = spark.createDataFrame(rows, "id string, label string, file_type string, source_file string, source_line int, docstring string, loaded_at int")
    got = {r["node_id"]: (r["file_path"], r["name"], r["source_line"]) for r in docpairs.function_nodes(n).collect()}
    assert got == {"a": ("r/old.py", "old", 3), "b": ("a.py", "g", 7)}


# written by hand ---------------------------------------------------------------------------------------------------

def test_kinds(spark):
    body = "\n".join(f"def load_{a}(path, mode):\n    result = open_{a}(path)\n    return result\n" for a in ("index", "header", "table", "record"))
    mangled = "!function(e,t){" + "".join(f"var n{i}=e{i}||{{}},r=[1,{i}];t.q=function(u){{return u+{i}}};" for i in range(90)) + "}(this,{});"
    files = {
        "r/src/a.py": "# Copyright the authors.\n\n" + body,
        "r/src/gen.py": "# Code generated by tool. DO NOT EDIT.\n\n" + body, "r/src/gen2.py": "# Copyright the authors.\n#\n# @generated by tool\n" + body,
        "r/src/talks.py": '# Emits the header "Code generated by tool" into its output.\n' + body, "r/src/hand.py": "# Written by hand, unlike the generated clients.\n" + body,
        "r/node_modules/pkg1/index.js": "function openIndex(path) {\n  return path;\n}\n", "r/vendor/lib2-1.0.3/a.py": body + "x = 1\n", "r/src/vendors/a.py": body + "y = 2\n",
        "r/src/lic.py": "# pack3 v1.2.3 | (c) the project | permissive licence\n" + body.replace("index", "place"), "q/src/copy.py": "# mine\n" + body.replace("index", "place"),
        "r/src/rules.py": "# Version 2.1.0 of the rules, maintained in this repository.\n" + body, "r/dist/x.js": mangled, "r/src/long.py": body + "NAME = '" + "readable words " * 60 + "'\n",
        "r/src/data.py": "TABLE = [\n" + "    0x1f, 0x2e, 0x3d, 0x4c,\n" * 60 + "]\n", "r/src/small.py": body + "TABLE = [1, 2, 3]\n", "r/src/empty.py": "", "r/src/null.py": None,
    }
    c = spark.createDataFrame([(p.replace("r/src/gen.py", "r\\src\\gen.py"), t, "x") for p, t in [*files.items()] * 2], "file_path string, content string, kind string")
    m = spark.createDataFrame([(p, "code", p[0], 1) for p in files], "file_path string, file_type string, repo string, print int")
    got = {r["file_path"]: r["kind"] for r in handwritten.not_handwritten(c, m).collect()}
    assert got == {
        "r/src/gen.py": "generated", "r/src/gen2.py": "generated", "r/node_modules/pkg1/index.js": "vendored", "r/vendor/lib2-1.0.3/a.py": "vendored",
        "r/src/lic.py": "vendored", "q/src/copy.py": "vendored", "r/dist/x.js": "minified", "r/src/data.py": "data",
    }
    assert handwritten.not_handwritten(c.limit(0), m).count() == 0


def test_markers_below_a_licence():
    licence = "Copyright 2020 The Authors\n" + "\n".join(f"Permission line {i} of the licence, which goes on" for i in range(50)) + "\nlimitations under the License.\n"

    def kind(mark, path="r/a.go", body="package a\nfunc Run() {}\n", lines=licence):
        text = "".join(f"// {x}\n" if x else "//\n" for x in (lines + mark).split("\n")) + body
        return handwritten.kind_of(path, handwritten.measure(path, text, {}))[0]

    assert kind("\nCode generated by protoc-gen-go. DO NOT EDIT.") == "generated"
    assert kind("Code generated by protoc-gen-go. DO NOT EDIT.") == "generated"
    assert kind("\nCopied from github.com/x/y") == "vendored"
    assert kind("\nleft-pad v1.3.0") == "vendored"
    assert kind("") is None and kind("\nThe tables of this package are\ngenerated by the tool of the same name") is None
    assert kind("\nThe tests of this package need\nnumpy 1.20") is None
    block = "/*\n * " + licence.strip().replace("\n", "\n * ") + "\n */\n\n/* Code generated by x. DO NOT EDIT. */\nint f(void) { return 1; }\n"
    assert handwritten.kind_of("r/a.c", handwritten.measure("r/a.c", block, {}))[0] == "generated"


def test_data_with_accessors_and_short_minified_files():
    model = handwritten.Model(handwritten.Counter(g for w in ["value", "result", "length", "index", "window", "document"] * 500 for g in handwritten.grams(w)))

    def kind(path, text):
        return handwritten.kind_of(path, handwritten.measure(path, text, {"javascript": model}))[0]

    table = "const T = [" + ", ".join(str(i * 7919) for i in range(2000)) + "];\n"
    assert kind("r/t.js", table + "export function get() { return T; }\n") == "data"
    assert kind("r/t.py", "class Blob:\n    data = '" + "ab12" * 2000 + "'\n    def get(self):\n        return self.data\n") == "data"
    assert kind("r/t.js", "const T = [1, 2, 3, 4];\nexport function get(index) { return T[index]; }\n" * 20) is None
    pages = "".join(f"function page{i}(value) {{ return '{'text ' * 100}' + value; }}\n" for i in range(9))
    assert kind("r/t.js", pages) is None
    assert kind("r/s.js", "!function(q,z){q.zx=z(kq);for(xj=0;xj<q;xj++)kq(zx,xj)}(qz,kx)") == "minified"
    assert kind("r/s.js", "q(z)") is None and kind("r/s.js", "window.document(value,result,length,index)") is None


def test_entropy_tells_mangled_names():
    counts = {}
    for w in ["index", "header", "load_table", "readRecord", "path", "open", "i", "result"] * 20:
        for g in handwritten.grams(w):
            counts[g] = counts.get(g, 0) + 1
    m = handwritten.Model(counts)
    assert max(m.entropy(w) for w in ("load_header", "openTable", "path")) < handwritten.STRANGE < min(m.entropy(w) for w in ("q", "x7", "zk"))


def test_templates_and_copies_without_headers_and_folders(spark):
    """Kinds that only the models and the other repositories can tell: no header, no telling path."""
    r = random.Random(4)
    noun = lambda: "_".join(r.sample(["index", "header", "table", "record", "cache", "path"], 2))
    verbs = ["load", "join", "walk", "score", "merge", "trace", "split", "verify", "decode", "publish"]
    by_hand = lambda: "".join(f"def {v}_{noun()}(x):\n    return x\n" for v in r.sample(verbs, 5))
    accessors = lambda: "".join(f"def {r.choice(['get', 'set', 'has'])}_{noun()}(x):\n    return x\n" for _ in range(6))
    files = {f"r{i % 5}/src/a{i}.py": by_hand() for i in range(60)}
    files |= {f"r{i % 5}/src/g{i}.py": accessors() for i in range(8)}
    copy = by_hand() + by_hand()
    files |= {f"r{i}/src/c.py": f"# note {i}\n" + copy for i in range(2)}
    c = spark.createDataFrame([*files.items()], "file_path string, content string")
    m = spark.createDataFrame([(p, "code", p[:2]) for p in files], "file_path string, file_type string, repo string")
    got = {r["file_path"]: r["kind"] for r in handwritten.not_handwritten(c, m).collect()}
    assert got == {f"r{i % 5}/src/g{i}.py": "generated" for i in range(8)} | {f"r{i}/src/c.py": "vendored" for i in range(2)}
