"""Evaluation texts that leak into training text.

Pigeonhole edit matching: a window of WINDOW words with at most BUDGET edits (a word changed, put in or left out)
holds at least one untouched piece of PIECE words out of the BUDGET + 1 pieces that it covers whole, wherever the
window begins. Each item is cut into such pieces; all pieces of all items go into one Aho-Corasick automaton;
documents are scanned for exact piece hits; a hit is verified with Myers' bit-parallel edit distance on words.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import Counter, defaultdict

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

WINDOW, BUDGET = 20, 3
PIECE = (WINDOW + 1) // (BUDGET + 2)  # 4: BUDGET + 1 whole pieces lie in any window, at whatever offset
#: A first or last paragraph that more than this share of the items of a suite have is an instruction of the suite;
#: what stands between is the item's own, however many items share it.
SHARED = 0.5
#: Items per pass; the automaton of a pass is sent to the executors, so its size is bounded by this number.
BLOCK = 20_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: What looks like a tag but is long or runs over lines may be text between two unrelated signs.
_SURE_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_LINK = re.compile(r"\]\([^()\s]*\)|\]\[[^\[\]\s]*\]")
_HYPHEN = re.compile(r"(?<=\w)[-­]\s*\n\s*(?=\w)")
_WORDS = re.compile(r"[^\W_]+")


def readings(text: str) -> list[list[str]]:
    """The words of a text; a second list without long tags and tags over lines too where it has such, since only
    the reader of the page knows whether they are tags."""
    first = words(text)
    if "<" in text and any("\n" in t or len(t) > 200 for t in _TAG.findall(html.unescape(text) if "&" in text else text)):
        return [first, words(text, _TAG)]
    return [first]


def words(text: str, tag: re.Pattern = _SURE_TAG) -> list[str]:
    """Lower-case words without markup: entities are read, tags and link targets dropped, words split over lines
    joined, and characters written in compatible forms (ligatures, combining accents, full width) made equal."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "](" in text or "][" in text:
        text = _LINK.sub("] ", text)
    if "<" in text:
        text = tag.sub(" ", text)
    if "-\n" in text or "- \n" in text or "-\r" in text or "­" in text:
        text = _HYPHEN.sub("", text).replace("\u00ad", "")
    return _WORDS.findall(text.lower())


def own_words(items: list[tuple[int, str, str]]) -> dict[int, list[str]]:
    """item_id -> words of its text without the instructions of its suite. items: (item_id, suite, text)."""
    seen: dict[str, Counter] = defaultdict(Counter)
    size: Counter = Counter()
    parts = {}
    for item_id, suite, text in items:
        parts[item_id] = (suite, [p for p in re.split(r"\n\s*\n", (text or "").replace("\r\n", "\n")) if p.strip()])
        size[suite] += 1
        seen[suite].update({" ".join(words(p)) for p in parts[item_id][1][:1] + parts[item_id][1][1:][-1:]})
    out = {}
    for item_id, (suite, paragraphs) in parts.items():
        many = max(2, SHARED * size[suite])
        every = list(map(words, paragraphs))
        drop = {k for k in {0, len(every) - 1} if every and size[suite] >= 3 and seen[suite][" ".join(every[k])] > many}
        out[item_id] = [w for k, p in enumerate(every) if k not in drop for w in p]
    return out


def distance(pattern: list[str], text: list[str], most: int) -> bool:
    """Whether pattern occurs in text with at most `most` edits (Myers, one bit per word of the pattern)."""
    peq: dict[str, int] = {}
    for i, x in enumerate(pattern):
        peq[x] = peq.get(x, 0) | 1 << i
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    get = peq.get
    for x in text:
        eq = get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= most:
                return True
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return False


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: dict[int, list[str]]):
        self.items = {i: w for i, w in items.items() if len(w) >= WINDOW}
        #: piece -> places: item, position of the piece, its windows, their words, distinct words that must be met
        at: dict[str, list[tuple[int, int, range, frozenset[str], int]]] = defaultdict(list)
        for i, w in self.items.items():
            distinct = [len(set(w[s : s + WINDOW])) for s in range(len(w) - WINDOW + 1)]
            for k in range(0, len(w) - PIECE + 1, PIECE):
                starts = range(max(0, k - WINDOW + PIECE), min(len(w) - WINDOW, k) + 1)
                near = frozenset(w[starts[0] : starts[-1] + WINDOW])
                place = (i, k, starts, near, min(distinct[s] for s in starts) - BUDGET)
                at[" " + " ".join(w[k : k + PIECE]) + " "].append(place)
        self.a = ahocorasick.Automaton()
        for piece, places in at.items():
            self.a.add_word(piece, (len(piece), places))
        self.empty = not at
        if at:
            self.a.make_automaton()

    def find(self, text: str) -> set[int]:
        """Ids of the items of which the text holds a window within the budget."""
        found: set[int] = set()
        for ws in readings(text):
            if len(ws) >= WINDOW - BUDGET and not self.empty:
                self._scan(ws, found)
        return found

    def _scan(self, ws: list[str], found: set[int]) -> None:
        line = " " + " ".join(ws) + " "
        #: (item, words that the text runs ahead of it) -> last of its windows that was verified there. A verdict on a
        #: window holds for every piece of it on that diagonal; later pieces bring the windows behind the last one.
        tried: dict[tuple[int, int], int] = {}
        before, spaces = 0, 0
        for end, (size, places) in self.a.iter(line):
            start = end - size + 1
            spaces += line.count(" ", before, start)  # words before the hit; hits come in order of their ends
            j = spaces
            if start < before:
                j = spaces = line.count(" ", 0, start)
            before = start
            around = None
            for item, k, starts, near, need in places:
                last = tried.get((item, j - k), -1)
                if item in found or last >= starts[-1]:
                    continue
                tried[(item, j - k)] = starts[-1]
                if around is None:
                    around = ws[max(0, j - WINDOW + PIECE - BUDGET) : j + WINDOW + BUDGET]
                    here = set(around)
                if len(near & here) < need:
                    continue
                w = self.items[item]
                if any(distance(w[s : s + WINDOW], around, BUDGET) for s in starts if s > last):
                    found.add(item)


#: The matcher that this worker built last, and for which block of items; the next tasks of the block use it again.
_built: tuple[str, Matcher | None] = ("", None)


def _matcher(key: str, items: dict[int, list[str]]) -> Matcher:
    global _built
    if _built[0] != key:
        _built = (key, Matcher(items))
    return _built[1]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold WINDOW words or more of an item's own text within the budget.

    `items` is the stated query set (item_id, suite, text); it is read in blocks of BLOCK items, each a pass over
    the documents, so that the automaton stays bounded. Items with fewer than WINDOW own words cannot leak; null
    and empty texts hold nothing; a passage that several items share counts for each of them.
    """
    rows = [tuple(r) for r in items.select("item_id", "suite", "text").distinct().where("item_id is not null").toLocalIterator()]
    own = own_words(sorted(rows, key=lambda r: (r[0], str(r[1]), str(r[2]))))
    ids = sorted(own)
    out = None
    for at in range(0, max(1, len(ids)), BLOCK):
        block = docs.sparkSession.sparkContext.broadcast({i: own[i] for i in ids[at : at + BLOCK]})

        def make(block=block, key=uuid.uuid4().hex):
            matcher = _matcher(key, block.value)

            def one(doc_id, text):
                return [(doc_id, i) for i in sorted(matcher.find(text or ""))]

            return one

        part = map_rows(docs.select("doc_id", "text"), "doc_id long, item_id long", make)
        out = part if out is None else out.unionByName(part)
    return out


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, item_id, n_docs) of the items that leaked."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "suite").distinct().join(n, "item_id").select("suite", "item_id", "n_docs")
