"""The registered queries of the training-data operators, and their SQL where SQL can say it.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, collocations, exact_dedup, html_main, mixing, packing, quality, secret_scan, simhash, spelling, suffix_dedup,
               toxicity, warc)
from .collocations import OP13_SQL
from .common import table
from .secret_scan import OP12_SQL
from .spelling_sql import OP11_SQL


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal target weight for every source, as many rows as the input has; whole rows come out."""
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "mix_key", "text")


OP3_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
k AS (SELECT source, rate, unnest(range(greatest(0.0, floor(rate - (12.0 * sqrt(rate) + 30.0)))::BIGINT,
                                        ceil(rate + (12.0 * sqrt(rate) + 30.0))::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
u AS (SELECT doc_id, source, text,
             ('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
m AS (SELECT source, min(k) AS low FROM c GROUP BY source),
d AS (SELECT u.doc_id, u.source, u.text, any_value(m.low) + count(c.k) AS copies
      FROM u JOIN m ON u.source IS NOT DISTINCT FROM m.source
      LEFT JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.p <= u.u GROUP BY u.doc_id, u.source, u.text),
x AS (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM d)
SELECT doc_id, source, copy, sha256('7:' || doc_id::VARCHAR || ':' || copy::VARCHAR) AS mix_key, text FROM x
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=100)


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND (first < page_id OR page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND (first < page_id OR page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM f
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, words=4)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op2_permutation_index": op2_permutation_index, "op6_toxicity": op6_toxicity, "op4_html_main": op4_html_main, "op9_warc": op9_warc, "op1_suffix_dedup": op1_suffix_dedup, "op7_quality": op7_quality, "op8_packing": op8_packing, "op3_poisson_mixing": op3_poisson_mixing, "op5_exact_dedup": op5_exact_dedup, "op10_simhash": op10_simhash,
           "op11_spelling": op11_spelling, "op12_secret_scan": op12_secret_scan,
           "op13_collocations": op13_collocations}
ORACLE = {"op11_spelling": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_collocations": OP13_SQL, "op9_warc": OP9_SQL, "op3_poisson_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL}
