"""License scan with a positional rare-token index, by DataFrame functions only.

Templates are short word sequences with a label and mandatory key phrases. The index holds, for every template word,
its postings (template, place in the template). A file's words are looked up by the rarest first: a template
is followed up only where the file holds that word of its key phrases that has the highest IDF. The postings of the words that
were found are intersected by relative position (place in the file minus place in the template), so words that stand as
in the template meet in one group; a group is a match if enough of the template's words and all its key phrases are
there. Base phrases are templates of which every word must stand in its place.

IDF comes from the share of documents that hold each licence word, counted over all documents. The table of templates is
fixed by the caller and small, so it is broadcast; what is counted is one row per licence word.

Defined results: null and empty texts have no words, no places and empty labels; rows that repeat an id are scanned one
by one; an empty table gives no rows; other columns are ignored. Overlapping places of a phrase all count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrase, label: every word in its place.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Template, label, mandatory key phrases: for wordings that the base phrases do not have.
TEMPLATES = (
    ("this file is licensed under the gnu general public license version 3", "gpl-3", ("gnu general public license", "version 3")),
    ("this file is licensed under the gnu general public license version 2", "gpl-2", ("gnu general public license", "version 2")),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3", ("gnu lesser general public license", "version 3")),
    ("licensed under the gnu affero general public license version 3", "agpl-3", ("gnu affero general public license", "version 3")),
    ("licensed under the apache license version 2 0", "apache-2", ("apache license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ("permission is hereby granted free of charge",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("redistribution and use in source and binary forms",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("mozilla public license",)),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("cc by nc",)),
    ("licensed under cc by sa 4 0", "cc-by-sa", ("cc by sa",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("released into the public domain",)),
    ("all rights reserved", "all-rights-reserved", ("all rights reserved",)),
)
#: Share of a template's words that must stand in their places.
COVERAGE = 0.7


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then the maximal runs of other characters than the separators."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)
    # Separators at an end leave an empty string there and nowhere else.
    return F.filter(parts, lambda w: w != "")


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    spark = docs.sparkSession
    entries = [(i, phrase.split(), label, True, [phrase]) for i, (phrase, label) in enumerate(base)]
    entries += [(len(base) + i, t.split(), label, False, list(keys)) for i, (t, label, keys) in enumerate(templates)]
    vocabulary = sorted({w for e in entries for w in e[1]})
    last = max(len(e[1]) for e in entries)

    # Licence words of each document with their places; words that are none never leave the row.
    words = words_of(F.col("text"))
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
        .select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"),
                F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.cast("long").alias("at"))), lambda x: x["word"].isin(*vocabulary)).alias("hits"))
    )
    found = staged(found, "license-words")

    # IDF of licence words over all documents: one row per word.
    total = F.lit(float(found.count()))
    df = found.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = {r.word: r.idf for r in df.select("word", F.log((total + 1) / (F.col("df") + 1)).alias("idf")).collect()}
    # A match holds all words of its key phrases, so the rarest of those leads to every match.
    rare = {i: max({w for k in keys for w in k.split()}, key=lambda w: (idf.get(w, float("inf")), w)) for i, _, _, _, keys in entries}
    postings = spark.createDataFrame([(w, i, p) for i, ws, _, _, _ in entries for p, w in enumerate(ws)], "word string, template int, place long")
    meta = spark.createDataFrame(
        [(i, len(ws), label, exact, [[j for j in range(s, s + len(k.split()))] for k in keys for s in range(len(ws)) if ws[s : s + len(k.split())] == k.split()], [w for w in ws]) for i, ws, label, exact, keys in entries],
        "template int, size int, label string, exact boolean, keys array<array<long>>, tokens array<string>",
    )

    # Follow up only documents that hold the rarest word of some template, and there only what stands near such a word.
    anchors = sorted(set(rare.values()))
    hits = found.filter(F.exists("hits", lambda x: x["word"].isin(*anchors))).select("row", F.explode("hits").alias("hit")).select("row", F.col("hit.word").alias("word"), F.col("hit.at").alias("at")).withColumn("part", F.floor(F.col("at") / last))
    parts = hits.filter(F.col("word").isin(*anchors)).select("row", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part")).distinct()
    near = hits.join(parts, ["row", "part"], "left_semi")
    # Intersection by relative position: the template's words that stand in the document where they should.
    spread = near.join(F.broadcast(postings), "word").select("row", "template", (F.col("at") - F.col("place")).alias("start"), "place")
    met = spread.groupBy("row", "template", "start").agg(F.array_sort(F.collect_set("place")).alias("places"))
    judged = met.join(F.broadcast(meta), "template").withColumn("share", F.size("places") / F.col("size"))
    whole = F.size("places") == F.col("size")
    all_keys = F.forall("keys", lambda k: F.size(F.array_except(k, "places")) == 0)
    matches = judged.filter(F.when(F.col("exact"), whole).otherwise((F.col("share") >= coverage) & all_keys))
    per = matches.groupBy("row").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.greatest("start", F.lit(0)))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return found.select("row", "doc_id", "n_words").join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
