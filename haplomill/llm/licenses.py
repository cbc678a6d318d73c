"""License scan by voting on diagonals, in Spark expressions only.

Texts are lower-cased (A-Z) and cut into words; every run of `K` words is a gram. The hashes of all
grams of all texts are joined to the grams of the templates, a table of fixed size, and a hit's
diagonal is its place in the text less its place in the template. Hits are counted by text,
template and diagonal; diagonals at most `GAP` apart are merged, as words put in or left out shift
the rest; what is merged is verified by its share of the template's grams and by its span. A base
phrase stands where all its grams lie on one diagonal. Joined grams are compared as words, so that
no verdict rests on a hash.

Defined cases: null or empty text has no words and no labels; a null id stays null; repeated rows
are scanned each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K = 3
GAP = 4
MIN_SHARE = 0.6
MIN_GRAMS = 4
SPAN_SLACK = 1.5
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that stand for a license, and the notices by which licenses are granted.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met""",
    "apache-2": """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at""",
    "gpl-3": "licensed under the gnu general public license version 3",
    "gpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version""",
    "lgpl": """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general
        public license as published by the free software foundation""",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]


def templates(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """Rows (template, label, base, template's words, its grams, gram, place) of fixed number."""
    out = []
    for base, texts in ((True, [(label, text) for text, label in phrases.items()]), (False, list(notices.items()))):
        for label, text in texts:
            found = grams(text.split())
            number = len({row[0] for row in out})
            out += [(number, label, base, len(text.split()), len(found), gram, place) for place, gram in enumerate(found)]
    return out


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NO_WORD), "")


def hits(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of each text (at -1) and each gram of it that a template has."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    starts = F.when(F.size("words") >= K, F.sequence(F.lit(0), F.size("words") - K)).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(K)]))
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), each)).alias("at", "gram"))
    rows = rows.withColumn("at", F.col("at") - 1).withColumn("hash", F.xxhash64("gram"))
    # the templates are constants of this module or the caller's: a table of fixed size
    same = (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))
    joined = rows.join(F.broadcast(found), same, "left").where((F.col("at") < 0) | F.col("template").isNotNull())
    return joined.select("row", "doc_id", "n_words", "at", "template", "label", "base", "t_words", "t_grams", (F.col("at") - F.col("place")).alias("diagonal"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Base places and license labels of every text."""
    spark = docs.sparkSession
    rows = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    found = spark.createDataFrame(rows, "template int, label string, base boolean, t_words int, t_grams int, t_gram string, place int")
    all_hits = materialize(hits(docs, found.withColumn("t_hash", F.xxhash64("t_gram")), id_col, text_col), "hits")

    of_template = ["row", "template", "label", "base", "t_words", "t_grams"]
    votes = all_hits.where("at >= 0").groupBy(*of_template, "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > GAP, F.lit(True))
    # a base phrase is exact: its diagonals are never merged
    spans = votes.withColumn("apart", F.when(F.col("base") | apart, 1).otherwise(0)).withColumn("span", F.sum("apart").over(by_diagonal))
    spans = spans.groupBy(*of_template, "span").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("t_grams"))
    compact = F.col("high") - F.col("low") + K <= SPAN_SLACK * F.col("t_words") + GAP
    good = F.when(F.col("base"), F.col("votes") == F.col("t_grams")).otherwise((share >= MIN_SHARE) & (F.col("votes") >= MIN_GRAMS) & compact)
    spans = spans.where(good).withColumn("share", share)
    base = F.col("base")
    labels = spans.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("share").alias("score"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    out = all_hits.where("at < 0").select("row", "doc_id", "n_words").join(labels, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
