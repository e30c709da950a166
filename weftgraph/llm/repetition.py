"""Repetition inside a single document.

Every document is measured exactly; a bound that cannot miss a case spares the others the count of their words.
Compression bands label documents: their words are compressed with zstandard as a whole and in fixed chunks, and
limits that depend on the length say whether a document looks repetitive. The limits are those of prose, so the
label decides nothing: repeats in a denser text compress less.
"""

from __future__ import annotations

import re
import sys

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

RUN = 5  # words of a run that counts as repeated
SHARE = 0.3  # share of repeated words from which a document is a case
CHUNK = 4096  # bytes of a chunk
#: (bytes of the words up to which a limit holds, ratio compressed / plain up to which a document may be
#: repetitive). Plain prose of a length compresses to 0.40 (long) to 0.70 (short); with three tenths of its words
#: repeated in runs of five or more it loses at least a quarter of that. Below 200 bytes the frame of the format
#: outweighs the text, so everything passes.
BANDS = ((200, 9.0), (400, 0.64), (700, 0.60), (1000, 0.56), (1500, 0.53), (2500, 0.50), (5000, 0.47), (sys.maxsize, 0.45))
#: A chunk of running text below this ratio is repetitive by itself.
CHUNK_LIMIT = 0.45
#: Above this ratio a text of 200 bytes or more is incompressible (random characters, encoded data).
INCOMPRESSIBLE = 0.9
#: Distance in bytes over which repetition is found; documents longer than that are always labelled repetitive.
WINDOW_LOG = 23

_WORDS = re.compile(r"[^\W\d_]+")
_other: dict[int, str] | None = None


def words(text: str) -> list[str]:
    """Runs of letters, lower case."""
    global _other
    if not text.isascii():
        if _other is None:  # characters that \w takes though they are neither letters nor decimal digits
            _other = {c: " " for c in range(sys.maxunicode) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()}
        text = text.translate(_other)
    return _WORDS.findall(text.lower())


def repeated(ws: list[str]) -> int:
    """Words that lie in a run of RUN words which occurred, starting earlier, in the same list."""
    seen: set[tuple] = set()
    count = end = 0
    for i, gram in enumerate(zip(ws, ws[1:], ws[2:], ws[3:], ws[4:])):
        if gram in seen:
            count += i + RUN - max(i, end)
            end = i + RUN
        else:
            seen.add(gram)
    return count


def may_repeat(ws: list[str]) -> bool:
    """False only if fewer than SHARE of the words can be repeated: a run that occurred before covers RUN words at
    most. Equal hashes of unequal runs raise the bound, never lower it."""
    runs = len(ws) - RUN + 1
    distinct = len(set(map(hash, zip(ws, ws[1:], ws[2:], ws[3:], ws[4:]))))
    return RUN * (runs - distinct) >= SHARE * len(ws)


class Bands:
    def __init__(self):
        parameters = zstandard.ZstdCompressionParameters.from_level(3, window_log=WINDOW_LOG)
        self._z = zstandard.ZstdCompressor(compression_params=parameters)

    def ratios(self, data: bytes) -> tuple[float, float, float]:
        """(whole, lowest chunk, highest chunk); empty data gives 1."""
        n = len(data)
        if not n:
            return 1.0, 1.0, 1.0
        whole = len(self._z.compress(data)) / n
        if n <= CHUNK:
            return whole, whole, whole
        chunks = [len(self._z.compress(c)) / len(c) for c in (data[i : i + CHUNK] for i in range(0, n - CHUNK // 2, CHUNK))]
        return whole, min(chunks), max(chunks)

    @staticmethod
    def verdict(n: int, whole: float, low: float, high: float) -> str:
        """`repetitive` (compresses like prose of which SHARE is repeated), `incompressible` or `normal`."""
        limit = next(x for size, x in BANDS if n <= size)
        if whole <= limit or low <= CHUNK_LIMIT or n > 1 << WINDOW_LOG:
            return "repetitive"
        return "incompressible" if n >= 200 and high >= INCOMPRESSIBLE else "normal"


def bands(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, ratio, chunk_low, chunk_high, band) of every document; null texts count as empty."""

    def make():
        b = Bands()

        def one(doc_id, text):
            data = " ".join(words(text or "")).encode()
            r = b.ratios(data)
            yield doc_id, len(data), *(round(x, 4) for x in r), b.verdict(len(data), *r)

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, ratio double, chunk_low double, chunk_high double, band string", make)


def shares(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated, repeated_share) of every document, measured exactly; empty texts have share 0."""

    def make():
        def one(doc_id, text):
            ws = words(text or "")
            yield doc_id, len(ws), repeated(ws)

        return one

    counts = map_rows(docs.select("doc_id", "text"), "doc_id long, n_words long, n_repeated long", make)
    share = F.coalesce(F.round(F.col("n_repeated") / F.nullif("n_words", F.lit(0)), 6), F.lit(0.0))
    return counts.withColumn("repeated_share", share)


def repetitive(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated_share) of documents with at least SHARE of their words repeated.

    Every text is measured exactly. Null and empty texts and texts of fewer than RUN
    words are no cases. A narrow map stage: nothing is shuffled, and one document is the unit of memory.
    """

    def make():
        def one(doc_id, text):
            ws = words(text or "")
            if len(ws) >= RUN and may_repeat(ws):
                n = repeated(ws)
                if n >= SHARE * len(ws):
                    yield doc_id, n / len(ws)

        return one

    return map_rows(docs.select("doc_id", "text"), "doc_id long, repeated_share double", make)
