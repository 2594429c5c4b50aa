"""Exact token-length histogram of a corpus, with totals for every context limit.

Every whole text is encoded with a public byte-level BPE vocabulary (a path parameter; by
default the installed public file). Documents are aggregated by (language, encoded length),
a map-side combined sum, and only the histogram moves. Running sums over the sorted
lengths answer, for a context limit equal to each length that occurs: documents and tokens
at or above and below it, what remains of the corpus if every document is cut there, and
the quantile. `quantile()` and `truncated_total()` read any other limit off the histogram.

Scale: a language has at most as many rows as its longest document has tokens; the running
sums are windows over one language of the histogram, not of the documents.

White space of LONG_SPACE characters and more is encoded by itself: the vocabulary's pre-tokeniser looks ahead from every place of
such a run and gives up. It would take the run but for its last character as one piece, or all of it at the end of a text,
and that is what is encoded, so counts are those of the whole text.

Edge cases: a null or empty text has length 0; a null language is a group; special-token
strings inside a text are ordinary text; repeated rows count each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import table
from wayfold.llm.textnp import column, slices


#: Characters of white space from which on a run is a piece of its own.
LONG_SPACE = 4096
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_LONG_RUN = re.compile(f"(?<!{_SPACE}){_SPACE}{{{LONG_SPACE},}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """texts -> token counts, for a file of base64 token and rank per line."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def count(text: str | None) -> int:
        if not text:
            return 0
        total = at = 0
        for run in _LONG_RUN.finditer(text) if len(text) >= LONG_SPACE else ():
            # the last character goes with what follows
            end = run.end() - (run.end() < len(text))
            total += len(enc.encode_ordinary(text[at : run.start()])) + len(whole.encode_ordinary(text[run.start() : end]))
            at = end
        return total + len(enc.encode_ordinary(text[at:]))

    return lambda texts: [count(t) for t in texts]


def _lengths(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in slices(it):
            sizes = count(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), pa.array(np.array(sizes, np.int64))], names=["lang", "n_tokens"])

    return run


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """lang, n_tokens of every row."""
    return docs.select("lang", "text").mapInArrow(_lengths(path or default_vocabulary()), "lang string, n_tokens long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """lang, n_tokens, n_docs: the exact histogram of encoded lengths."""
    return lengths(docs, path).groupBy("lang", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def with_totals(hist: DataFrame) -> DataFrame:
    """The histogram with, for a context limit of n_tokens, sums over its language.

    docs_from and tokens_from count documents of at least n_tokens (suffix sums); cut_total is
    the number of tokens left if every document is cut at n_tokens; docs_over are those that
    the cut shortens; docs_share is the share of documents of at most n_tokens.
    """
    by = Window.partitionBy("lang").orderBy("n_tokens")
    onward, before, all_ = by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("lang")
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = hist.select(
        "lang",
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(onward).alias("docs_from"),
        F.sum(tokens).over(onward).alias("tokens_from"),
        F.coalesce(F.sum(tokens).over(before), F.lit(0)).alias("_below"),
        F.sum("n_docs").over(all_).alias("_docs"),
    )
    return out.select(
        "lang",
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("_below") + F.col("n_tokens") * F.col("docs_from")).alias("cut_total"),
        (F.col("docs_from") - F.col("n_docs")).alias("docs_over"),
        ((F.col("_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("_docs")).alias("docs_share"),
    )


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """lang, cut_total: tokens left if every document is cut at limit."""
    return hist.groupBy("lang").agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")).alias("cut_total"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """lang, n_tokens: the least length that a share q of the documents does not exceed."""
    share = with_totals(hist).where(F.col("docs_share") >= q)
    return share.groupBy("lang").agg(F.min("n_tokens").alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(histogram(table(spark, sf_dir, "documents")))
