"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its own characters say so, once, into a written table. Each distinct chunk goes
through one shuffle, where chunks with the same 64-bit key are compared byte by byte; keys that stand for two texts get
an ordinal. A document is then an ordered list of verified identifiers, eight bytes a chunk, and documents are
equal when the lists are. Lists are grouped by a hash and themselves; where no hash stands for two lists, which is
looked up, the documents meet their groups by hash.

Edge cases: a null text counts as empty; empty texts equal each other (their list is empty); among equal texts
the most code points, then the smallest id win, null ids last; repeated rows are copies of each other, and of repeated
rows with the id that stays all say kept; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, whole_text, written

#: Fixed value: the white space that equality ignores.
SPACES = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def chunks_of(text: Column, least: int = 256, most: int = 2048, cut: str = "kzqwxjKZQWXJ.!?") -> Column:
    """Content-defined chunks: each ends at the first cut character after `least` others, or after `most`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 1}}}?[{cut}]|.{{1,{most}}}"), F.lit(0))


def _recipes(chunked: DataFrame) -> DataFrame:
    """chunked: doc_id, n_points, sha, keys, chunks. Returns it with `recipe`, the list of verified identifiers: keys, and the ordinals of those that stand for more than one text."""
    dictionary = chunked.select(F.explode(F.arrays_zip("keys", "chunks")).alias("c")).select("c.keys", "c.chunks").distinct()
    shared = dictionary.groupBy("keys").agg(F.count("*").alias("n")).where("n > 1").select("keys")
    if shared.isEmpty():  # every key stands for one text: keys are verified identifiers
        return chunked.withColumn("recipe", F.col("keys"))
    order = Window.partitionBy("keys").orderBy("chunks")
    ordinals = dictionary.join(shared, "keys", "left_semi").withColumn("nth", F.row_number().over(order).cast("long"))
    at = chunked.select("sha", F.posexplode(F.arrays_zip("keys", "chunks")).alias("at", "c")).select("sha", "at", "c.keys", "c.chunks").distinct()
    found = at.join(ordinals, ["keys", "chunks"], "left").select("sha", "at", "keys", F.coalesce("nth", F.lit(0).cast("long")).alias("nth"))
    lists = found.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("at", "keys", "nth"))).alias("l")).select("sha", F.concat("l.keys", "l.nth").alias("recipe"))
    return chunked.join(lists, "sha", "left").withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>")))


def exact_dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs. how: see exact_groups."""
    return exact_groups(docs, **how)[0]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 256, most: int = 2048, key=F.xxhash64, list_key=F.xxhash64, hot_groups: int = 2000) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs; and the written tables that it reads.

    key, list_key: hashes of chunks and of lists, any; collisions cost time, never a result. hot_groups: groups of more than
    this share of the rows, of which there are at most so many, meet their copies by broadcast: no task gathers one of them.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")).select("doc_id", F.char_length("t").cast("long").alias("n_points"), normalised(F.col("t")).alias("norm"))
    cut = norm.select("doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), chunks_of(F.col("norm"), least, most).alias("chunks"))
    chunked = written(cut.withColumn("keys", F.transform("chunks", lambda c: key(c).cast("long"))), "chunked")
    listed = _recipes(chunked).select("doc_id", "n_points", "sha", list_key("recipe").cast("long").alias("hash"), "recipe")
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg"))).alias("best")
    groups = written(listed.groupBy("hash", "recipe").agg(best, F.count("*").alias("group_size")).select("hash", "recipe", (-F.col("best.neg")).alias("keep_id"), "group_size"), "groups")
    one_list = groups.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    on = ["hash"] if one_list else ["hash", "recipe"]
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") * hot_groups > total) if one_list else groups.limit(0)
    hot = hot.select(F.col("hash").alias("hot_hash"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size"))
    first = listed.select("doc_id", "sha", *on).join(F.broadcast(hot), F.col("hash") == F.col("hot_hash"), "left")
    met, rest = first.where("hot_size IS NOT NULL"), first.where("hot_size IS NULL")
    out = rest.join(groups.select(*on, "keep_id", "group_size"), on).select("doc_id", "sha", "keep_id", "group_size")
    out = out.unionByName(met.select("doc_id", "sha", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")), [chunked, groups]


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns; of repeated rows with one id and text, one."""
    groups, tables = exact_groups(docs)
    found = groups.where("kept").groupBy(F.col("doc_id").alias("stays_id"), F.col("text_sha256").alias("stays_sha")).agg(F.count("*").alias("stays_n"))
    stay = written(found, "stay")
    dropped(docs.sparkSession, *tables)
    rows = docs.toDF(*(f"__{c}" for c in docs.columns))  # so that no column of docs clashes
    same = F.col("__doc_id").eqNullSafe(F.col("stays_id")) & (F.sha2(normalised(whole_text("__text")).cast("binary"), 256) == F.col("stays_sha"))
    kept = rows.join(stay.where("stays_n = 1"), same, "left_semi")
    repeated = stay.where("stays_n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows.join(repeated, same).dropDuplicates(["stays_id", "stays_sha"]).select(*rows.columns))
    return kept.toDF(*docs.columns)
