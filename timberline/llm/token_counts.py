"""Exact token length histogram.

Documents are encoded where they lie and only their lengths leave the task, summed by length before the
shuffle. The histogram is written once. Suffix sums over it answer, for every context limit, how many documents and
tokens there are, how many fit, how many tokens are left after truncation, and the quantile of the limit. They are
summed in blocks of lengths, blocks of blocks and so on, so no task orders more than `radix` of them.

Texts with a very long run of white space or of other characters don't go through the library in one piece, as its
pattern engine runs out of stack on the one and its merging is quadratic in the other: they are split by an engine that
needs no stack, and long pieces go through the streaming transducer of `bpe`.

Edge cases: a null or empty text has length 0; texts, words and runs of white space of any length are counted;
repeated rows count each time; ties share a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, Merges, WordStream, byte_symbols
from .common import small_batches, whole_text, written


class Lengths:
    """The number of tokens of a text."""

    def __init__(self, ranks: bytes, pattern: str, long_run: int = 1000):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        space = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.split = regex.compile(space)
        self.long_run, self.long = long_run, re.compile(rf"\s{{{long_run}}}")

    @functools.cached_property
    def merges(self) -> Merges:
        """The merge list behind the ranks: the last two parts of each token when only lower ranks merge."""
        shown, pairs = byte_symbols(), []
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                least, i = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if least >= rank:
                    raise ValueError(f"rank {rank} isn't made of two tokens of lower ranks")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                pairs.append(tuple("".join(shown[x] for x in p) for p in parts))
        return Merges({}, pairs)

    def of(self, text: str) -> int:
        if len(text) < self.long_run or not self.long.search(text) and max(map(len, text.split()), default=0) < self.long_run:
            return len(self.encoding.encode_ordinary(text))
        return sum(map(self.piece, (m.group().encode() for m in self.split.finditer(text))))

    def piece(self, raw: bytes, size: int = 1024) -> int:
        if len(raw) <= self.long_run:
            return len(self.encoding._encode_single_piece(raw))
        shown, stream = byte_symbols(), WordStream(self.merges)
        return sum(len(stream.feed([shown[x] for x in raw[at : at + size]])) for at in range(0, len(raw), size)) + len(stream.close())


@functools.cache
def _lengths(ranks: bytes, pattern: str) -> Lengths:
    return Lengths(ranks, pattern)


def token_lengths(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens: one row for each row of docs. vocabulary: a rank file on the driver, under 1 MB, broadcast."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        lengths = _lengths(ranks.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lengths.of(t) for t in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def _after(rows: DataFrame, key: str, within: list[str]) -> DataFrame:
    """Adds d_after, t_after: the sums of n_docs and toks over larger keys that share `within`."""
    later = Window.partitionBy(*within).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{c[0]}_after": F.coalesce(F.sum(c).over(later), F.lit(0)) for c in ("docs", "toks")})


def length_report(lengths: DataFrame, radix: int = 64, levels: int = 5) -> DataFrame:
    """A row for each length that occurs, read as a context limit.

    n_tokens, n_docs (of that length), docs_within, docs_over, tokens_total, tokens_within, tokens_truncated (sum of
    min(length, limit)), quantile (share of documents within).
    """
    hist = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths").withColumn("toks", F.col("docs") * F.col("n_tokens"))
    total = hist.agg(F.sum("docs").alias("all_docs"), F.sum("toks").alias("tokens_total"))
    # Level k has the sums of lengths that agree but for their last k digits; what comes after is summed from the top down.
    level = [hist.withColumnRenamed("n_tokens", "k0")]
    for k in range(1, levels + 1):
        level.append(level[-1].groupBy(F.expr(f"k{k - 1} div {radix}").alias(f"k{k}")).agg(F.sum("docs").alias("docs"), F.sum("toks").alias("toks")))
    after = _after(level[-1], f"k{levels}", []).select(f"k{levels}", F.col("d_after").alias("d"), F.col("t_after").alias("t"))
    for k in range(levels - 1, -1, -1):
        own = _after(level[k].withColumn(f"k{k + 1}", F.expr(f"k{k} div {radix}")), f"k{k}", [f"k{k + 1}"])
        after = own.join(after.select(f"k{k + 1}", "d", "t"), f"k{k + 1}").select(f"k{k}", "docs", (F.col("d_after") + F.col("d")).alias("d"), (F.col("t_after") + F.col("t")).alias("t"))
    full = after.join(F.broadcast(total))
    within = F.col("tokens_total") - F.col("t")
    return full.select(F.col("k0").alias("n_tokens"), F.col("docs").alias("n_docs"), (F.col("all_docs") - F.col("d")).alias("docs_within"), F.col("d").alias("docs_over"), "tokens_total", within.alias("tokens_within"), (within + F.col("d") * F.col("k0")).alias("tokens_truncated"), ((F.col("all_docs") - F.col("d")) / F.col("all_docs")).alias("quantile"))


def truncated_total(report: DataFrame, limit: int) -> DataFrame:
    """Documents within, over and tokens left for any limit, from the report alone."""
    return report.agg(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs")).otherwise(0)).alias("docs_within"), F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))).alias("tokens_truncated"))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    return length_report(token_lengths(docs, vocabulary, pattern, text_col))
