"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_classes
from .licenses import license_scan
from .lm_score import lm_scores
from .main_text import extract
from .mixing import mixing_rates
from .nn_descent import search
from .token_counts import token_counts
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERIES["op2_exact_dedup"] = lambda spark, sf: exact_dedup(table(spark, sf, "documents"))
ORACLE_SQL["op2_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES["op10_bpe"] = lambda spark, sf: encode_decode(table(spark, sf, "documents"), vocabulary())

QUERIES["op1_license_scan"] = lambda spark, sf: license_scan(table(spark, sf, "documents"))


def _token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES["op7_token_counts"] = _token_counts
QUERIES["op4_toxicity"] = lambda spark, sf: toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
QUERIES["op9_main_text"] = lambda spark, sf: extract(table(spark, sf, "pages"))
QUERIES["op3_ngram_jaccard_join"] = lambda spark, sf: jaccard_classes(table(spark, sf, "documents"))
QUERIES["op5_lm_score"] = lambda spark, sf: lm_scores(table(spark, sf, "documents"))
ORACLE_SQL["op5_lm_score"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
pairs AS (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY pos) AS before FROM words),
one AS (SELECT word, count(*) AS c FROM words GROUP BY word),
own_one AS (SELECT r, word, count(*) AS n FROM words GROUP BY r, word),
two AS (SELECT before, word, count(*) AS c FROM pairs WHERE before IS NOT NULL GROUP BY before, word),
own_two AS (SELECT r, before, word, count(*) AS n FROM pairs GROUP BY r, before, word),
whole AS (SELECT count(*)::DOUBLE AS total FROM words),
sums AS (
  SELECT p.r, sum(p.n) AS n_words,
         sum(p.n * CASE WHEN p.before IS NULL THEN log10(greatest(b.c - ob.n, 0.4::DOUBLE) / l.total)
                        WHEN t.c > p.n THEN log10((t.c - p.n) / (a.c - oa.n)::DOUBLE)
                        ELSE log10(0.4::DOUBLE * greatest(b.c - ob.n, 0.4::DOUBLE) / l.total) END) AS s
  FROM own_two p JOIN one b ON b.word = p.word JOIN own_one ob ON ob.r = p.r AND ob.word = p.word CROSS JOIN whole l
  LEFT JOIN two t ON t.before = p.before AND t.word = p.word LEFT JOIN one a ON a.word = p.before LEFT JOIN own_one oa ON oa.r = p.r AND oa.word = p.before
  GROUP BY p.r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(s / n_words, 6) AS score FROM w LEFT JOIN sums USING (r)
"""
#: Shares of the tokens that each labelled domain gets.
TARGETS = {"good": 0.85, "poor": 0.1, "toxic": 0.05}
QUERIES["op6_soft_mixing"] = lambda spark, sf: mixing_rates(table(spark, sf, "documents"), table(spark, sf, "labels"), TARGETS)
QUERIES["op8_nn_descent"] = lambda spark, sf: search(table(spark, sf, "embeddings"))
