"""Exact duplicates by skew-safe combining, in DataFrame functions only.

Three combines, each of which compares the whole text and not only its digest:

1. every scan task merges its own equal texts (Spark's partial aggregation on digest, salt and text);
2. the salted groups (digest, salt, text) merge across tasks, so that a text which a third of all rows
   share is dealt over ``salts`` tasks;
3. the salt winners, at most ``salts`` rows a text, merge on (digest, text).

In ``decide`` a row then finds its group's winner through the salted group it belongs to, by digest, a second
independent hash and the length, so that no text moves for that step: this last look-up alone does not compare
contents.  ``keep_rows`` carries the rows through the three combines and needs no such step.

Defined results: a null text counts as empty; a null id loses to any other; rows that repeat an id with
the same text count as rows of the group and all carry the winner's mark in ``decide`` (``keep_rows``
returns one row for each text); an empty table gives an empty result; other columns are not looked at by
``decide`` and are carried by ``keep_rows`` whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """For every row: id, keep_id (largest id with the same text), group_size, kept, text_sha256."""
    salts = salts or max(32, partitions(docs.sparkSession))
    keyed = _keyed(docs, id_col, text_col, salts)
    check = (F.xxhash64("text").alias("check"), F.octet_length("text").alias("size"))
    local = keyed.groupBy("digest", "salt", "text").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    winners = local.groupBy("digest", "text").agg(
        F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("at"))
    mine = winners.select("digest", *check, "keep_id", "group_size", F.explode("at").alias("salt"))
    members = keyed.select("id", "digest", "salt", *check)
    return members.join(mine, ["digest", "salt", "check", "size"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The row with the largest id of each text, with all its columns; the same three combines."""
    salts = salts or max(32, partitions(docs.sparkSession))
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"),
                   *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    keyed = docs.select(F.sha2(text.cast("binary"), 256).alias("digest"),
                        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
                        text.alias("text"), row.alias("row"))
    local = keyed.groupBy("digest", "salt", "text").agg(F.max("row").alias("row"))
    won = local.groupBy("digest", "text").agg(F.max("row").alias("row"))
    out = {id_col: F.col("row.id"), text_col: F.when(~F.col("row.none"), F.col("text"))}
    out |= {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    return won.select(*[out[c].alias(c) for c in docs.columns])
