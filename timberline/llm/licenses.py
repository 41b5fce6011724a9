"""License scans by diagonal voting.

Every k-gram of neighbouring words of every text is hashed and joined to the positions of license templates that
hold the same one. A match votes for its diagonal: text position less template position. Votes are gathered by
diagonal; a diagonal and those up to `slack` words beyond it are merged (words left out or put in), and a merged span
is verified: the template positions that voted, in the order in which they stand in the text, must be `least` of all
of them. A position counts once, and one that stands out of order doesn't. The join compares the words themselves
besides the hash, so votes are verified words.

Edge cases: a null or empty text has no words, no labels and score 0; repeated rows get equal results; a text
of any length is read whole; an empty table gives an empty result; other columns are ignored; a template of fewer
words than k is refused.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text

#: Phrases whose every place is reported.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: The words of common license lines and notices, by label.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "gnu lesser general public license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-release": "released under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def grams_of(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def template_positions(spark, base: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """A row for each position of each template: a few hundred rows, whatever the texts."""
    rows = []
    for exact, found in ((True, base), (False, notices)):
        for label, text in found.items():
            grams = grams_of(text.split(), k)
            if not grams:
                raise ValueError(f"{label} has fewer than {k} words")
            rows += [(label, exact, i, g, len(grams)) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "label string, exact boolean, at int, gram string, positions int").withColumn("h", F.xxhash64("gram"))


def in_order(votes: list[tuple[int, int]]) -> int:
    """Of votes (place, at) the most that rise in both: the longest rising run of `at` once places are sorted."""
    ends: list[int] = []
    for _, at in sorted(votes, key=lambda v: (v[0], -v[1])):  # of one place only one position counts
        i = bisect.bisect_left(ends, at)
        ends[i : i + 1] = [at]
    return len(ends)


def license_spans(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, k: int = 2, slack: int = 3, least: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, label, exact, first, coverage: the verified spans, first counting words from 0. Spans of one template may overlap."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"), words_of(whole_text(text_col)).alias("w"))
    last = F.greatest(F.size("w") - (k - 1), F.lit(0))
    grams = F.transform(F.slice("w", 1, last), lambda x, i: F.concat_ws(" ", x, *(F.get(F.col("w"), i + j) for j in range(1, k))))
    rolled = words.select("doc_id", "text_hash", F.posexplode(grams).alias("place", "gram")).withColumn("h", F.xxhash64("gram"))
    templates = F.broadcast(template_positions(docs.sparkSession, base, notices, k))
    by = ["doc_id", "text_hash", "label", "exact", "positions"]
    votes = rolled.join(templates, ["h", "gram"]).select(*by, "at", (F.col("place") - F.col("at")).alias("diagonal"))
    diagonals = votes.groupBy(*by, "diagonal").agg(F.collect_set("at").alias("at"))
    # A window holds slack + 1 diagonals at most, each of no more votes than the template has positions.
    near = Window.partitionBy(*by).orderBy("diagonal").rangeBetween(0, slack)
    merged = diagonals.withColumn("n", F.when(F.col("exact"), F.size("at")).otherwise(F.sum(F.size("at")).over(near)))
    merged = merged.withColumn("near", F.when(~F.col("exact"), F.collect_list(F.struct("diagonal", "at")).over(near)))
    likely = merged.where(F.col("n") >= F.when(F.col("exact"), F.col("positions")).otherwise(F.col("positions") * least))
    ats = F.when(F.col("exact"), F.array().cast("array<array<int>>")).otherwise(F.col("near.at"))

    def verified(batches):
        for b in batches:
            own = {c: b.column(c).to_pylist() for c in ("positions", "diagonal", "diagonals", "ats")}
            pairs = [[(d + a, a) for d, at in zip(ds, found) for a in at] for ds, found in zip(own["diagonals"], own["ats"])]
            first = [min(v)[0] if v else d for v, d in zip(pairs, own["diagonal"])]
            share = [in_order(v) / n if v else 1.0 for v, n in zip(pairs, own["positions"])]  # an exact phrase has no list
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by[:4]), pa.array(first, pa.int32()), pa.array(share, pa.float64())], [*by[:4], "first", "coverage"])

    rows = likely.select(*by, "diagonal", F.coalesce("near.diagonal", F.array().cast("array<int>")).alias("diagonals"), ats.alias("ats"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in likely.select(*by[:4]).schema.fields)
    return rows.mapInArrow(verified, f"{kinds}, first int, coverage double").where(F.col("coverage") >= F.lit(least))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each row of docs."""
    spans = license_spans(docs, id_col=id_col, text_col=text_col, **how)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    exact = lambda c: F.when(F.col("exact"), F.col(c))
    found = spans.groupBy("doc_id", "text_hash").agg(F.count(exact("first")).alias("n_base"), F.min(exact("first")).cast("long").alias("first_word"), F.max(exact("first")).cast("long").alias("last_word"), joined(exact("label")).alias("base_labels"), joined("label").alias("labels"), F.max("coverage").alias("score"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_hash"), F.size(words_of(whole_text(text_col))).cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    out = rows.join(found, rows.doc_id.eqNullSafe(found.found_id) & (rows.text_hash == found.found_hash), "left")
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return out.select("doc_id", "n_words", *(F.coalesce(F.col(c), filled[c]).alias(c) if c in filled else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
