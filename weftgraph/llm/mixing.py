"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .arrow import map_rows

#: Folder of the public tokenizer files; a parameter of the functions below.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's own tokenizer splits text by before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges of the seeded hash per source, each cut into as many again. Only the small range that the fractional share
#: ends in is ordered, about a millionth of its source.
BUCKETS = 1024


def source_key(c) -> F.Column:
    """A source name without regard to spelling: lower case, words joined by one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) with the tokens of a public byte-level BPE; a null text has none."""

    def make():
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def one(doc_id, source, text):
            yield doc_id, source, len(encode(text)) if text else 0

        return one

    return map_rows(docs.select("doc_id", "source", "text"), "doc_id long, source string, n_tokens long", make)


@dataclass
class Share:
    source: str
    target: float
    max_repeats: int
    available: int
    tokens: float = 0.0

    @property
    def epochs(self) -> float:
        return self.tokens / self.available if self.available else 0.0


def water_fill(sources: list[Share], total: float) -> list[Share]:
    """Tokens per source: target * total, clamped at max_repeats * available; what the clamped cannot take goes to
    the others in proportion to their targets, until nothing exceeds its cap or all are clamped."""
    open_, rest = [s for s in sources if s.target > 0], float(total)
    for s in sources:
        s.tokens = 0.0
    while open_:
        weight = sum(s.target for s in open_)
        full = [s for s in open_ if s.target / weight * rest >= s.max_repeats * s.available]
        if not full:
            for s in open_:
                s.tokens = s.target / weight * rest
            break
        for s in full:
            s.tokens = float(s.max_repeats * s.available)
            rest -= s.tokens
        open_ = [s for s in open_ if s not in full]
    return sources


@dataclass
class Mix:
    documents: DataFrame  # doc_id, source, n_tokens, copies
    report: DataFrame  # source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None, folder: str = TOKENIZERS) -> Mix:
    """A training mix in which each source has its target share of the tokens, as far as the caps allow.

    Sources are compared by `source_key`; documents of a null source or of one without target are left out before
    they are tokenised, and targets without documents get nothing (their weight goes to the others). `total`
    defaults to the tokens of all documents that have a target. A document is used `floor(epochs)` times, and
    once more if its seeded hash is among the first of its source whose tokens fill the fraction: the mix is the
    same for the same seed however the data is partitioned, and misses a share by less than one document.

    Only per-source totals over BUCKETS hash ranges, and over the BUCKETS parts of the range where a fraction ends,
    reach the driver (at most targets x BUCKETS rows each); only documents in the part where it ends are ordered. Ties of the hash go by doc_id; duplicate targets of
    one spelling are added; empty tables give an empty mix.
    """
    spark = docs.sparkSession
    wanted = (
        targets.select(source_key("source").alias("source"), "target_share", "max_repeats")
        .where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .orderBy("source")
        .collect()
    )
    names = [r["source"] for r in wanted]
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    chosen = docs.select("doc_id", source_key("source").alias("source"), "text").where(F.col("source").isin(names))
    small = F.floor(F.col("u") / ((1 << 40) // BUCKETS**2))
    counted = materialize(token_counts(chosen, folder).withColumn("u", u).withColumn("b", small))

    def totals(df: DataFrame, part: Column) -> dict[str, dict[int, int]]:
        out: dict[str, dict[int, int]] = {n: {} for n in names}
        for r in df.groupBy("source", part.alias("part")).agg(F.sum("n_tokens").alias("n")).collect():
            out[r["source"]][r["part"]] = r["n"]
        return out

    def edge_of(sums: dict[int, int], left: float, edge: int = -1) -> tuple[int, float]:
        """The range in which the running sum passes `left`, and what is left at its begin; `edge` if nothing is left."""
        for b in sorted(sums) if left > 0.5 else ():
            if left < sums[b]:
                return b, left
            edge, left = b + 1, left - sums[b]
        return edge, left

    per = totals(counted, F.floor(F.col("b") / BUCKETS))
    shares = [Share(r["source"], r["target_share"], r["max_repeats"], sum(per[r["source"]].values())) for r in wanted]
    water_fill(shares, total if total is not None else sum(s.available for s in shares))
    coarse = {}
    for s in shares:
        whole = int(s.epochs + 1e-12)
        coarse[s.source] = (whole, *edge_of(per[s.source], s.tokens - whole * s.available))
    ends = F.lit(False)
    for name, (_, edge, _) in coarse.items():
        ends = ends | ((F.col("source") == name) & (F.floor(F.col("b") / BUCKETS) == edge))
    fine = totals(counted.where(ends), F.col("b"))
    plan = []
    for s in shares:
        whole, edge, left = coarse[s.source]
        if edge >= 0:
            edge, left = edge_of(fine[s.source], left, edge * BUCKETS)
        plan.append((s.source, s.target, s.max_repeats, s.available, whole, edge, float(left)))
    layout = "source string, target_share double, max_repeats int, available_tokens long, whole int, edge long, left double"
    steps = spark.createDataFrame(plan, layout) if plan else spark.createDataFrame([], layout)
    joined = counted.join(F.broadcast(steps), "source")  # at most one row per target
    upto = W.partitionBy("source").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = joined.where("b = edge").withColumn("extra", (F.sum("n_tokens").over(upto) <= F.col("left")).cast("int"))
    rest = joined.where("b <> edge").withColumn("extra", (F.col("b") < F.col("edge")).cast("int"))
    documents = (
        edge.unionByName(rest)
        .select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).alias("copies"))
        .where("copies > 0")
    )
    got = documents.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    report = (
        steps.select("source", "target_share", "max_repeats", "available_tokens")
        .join(F.broadcast(got), "source", "left")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("long"))
        .withColumn("actual_share", F.round(F.col("mixed_tokens") / F.greatest(F.lit(1), F.sum("mixed_tokens").over(W.partitionBy(F.lit(0)))), 6))
    )
    return Mix(documents, report)
