"""License scans by a positional rare-token index, in DataFrame expressions only.

The mandatory key phrases of licence templates are indexed by word and position. For every
template whose key words it holds, a file looks up those of highest inverse document
frequency (counted over all files); each hit proposes that the template begins at file
position minus template position. Hits that agree on the place are intersected, and a
place stands if the key phrase is there, word for word, so that no place is lost. Only words of the templates leave a file, never its other words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import write_scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label, and the words that stand consecutively.
BASE_PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

#: Label, template, mandatory key phrase (within the template).
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

#: A file looks up so many different key words of each template, the rarest (ties: by the word).
RARE_WORDS = 3


def _spots(words: Column, phrase: str) -> Column:
    """Places (from 0) where the words of a phrase stand consecutively."""
    wanted = phrase.split()
    places = F.sequence(F.lit(0), F.size(words) - 1)

    def stands(i: Column) -> Column:
        found = F.get(words, i) == wanted[0]
        for k, w in enumerate(wanted[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return found

    # a text without the first and last word has no place; the test of bytes is cheap
    maybe = F.contains("low", F.lit(wanted[0])) & F.contains("low", F.lit(wanted[-1])) & (F.size(words) >= len(wanted))
    return F.when(maybe, F.filter(places, stands)).otherwise(F.array().cast("array<int>"))


def _words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _begin(words: list[str], wanted: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)


def _first_look(docs: DataFrame) -> DataFrame:
    """Per row: base places and labels, the template words it holds, and, if all words of
    some key phrase are among them, its words."""
    text = F.coalesce("text", F.lit(""))
    # lower() can only add letters beyond ASCII, which no phrase holds; word borders stay
    staged = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lower(text).alias("low"))
    staged = staged.withColumn("words", F.regexp_extract_all("low", F.lit(f"({WORD})"), F.lit(1)))
    for label, phrase in BASE_PHRASES:
        staged = staged.withColumn(f"at_{label}", _spots(F.col("words"), phrase))
    vocabulary = sorted({w for _, template, _ in TEMPLATES for w in template.split()})
    staged = staged.withColumn("held", F.array_intersect("words", _words_array(vocabulary)))
    hope = F.lit(False)
    for key in sorted({key for _, _, key in TEMPLATES}):
        hope = hope | (F.size(F.array_except(_words_array(key.split()), F.col("held"))) == 0)
    spots = F.flatten(F.array(*[F.col(f"at_{label}") for label, _ in BASE_PHRASES]))
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, label) for label, _ in BASE_PHRASES]))
    return staged.select(
        "row", "doc_id", F.size("words").cast("bigint").alias("n_words"), spots.alias("spots"), base.alias("base"),
        "held", F.when(hope, F.col("words")).alias("words"),
    )


def _matches(seen: DataFrame) -> DataFrame:
    """(row, label, at, share) of the templates that stand in a file."""
    spark = seen.sparkSession
    files = seen.agg(F.count("*")).first()[0]
    counts = seen.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # one row per template word at most, whatever the corpus
    idf = {r["word"]: math.log((1 + files) / (1 + r["df"])) for r in counts.collect()}
    postings = []
    for t, (_, text, key) in enumerate(TEMPLATES):
        begin, needed = _begin(text.split(), key.split()), len(set(key.split()))
        postings += [(w, t, begin + k, float(idf[w]), needed) for k, w in enumerate(key.split()) if w in idf]
    index = spark.createDataFrame(postings, "word string, template int, offset int, idf double, needed int")

    hopeful = seen.filter(F.col("words").isNotNull())
    of = Window.partitionBy("row", "template")
    looked = hopeful.select("row", F.explode("held").alias("word")).join(index.drop("offset").distinct(), "word")
    looked = looked.withColumns({"held": F.count("*").over(of), "nr": F.row_number().over(of.orderBy(F.desc("idf"), "word"))})
    looked = looked.filter((F.col("held") == F.col("needed")) & (F.col("nr") <= RARE_WORDS))
    asked = looked.select("row", "template", "word").join(index, ["template", "word"])
    full = asked.select("row", "template", "word", "idf").distinct().groupBy("row", "template").agg(F.sum("idf").alias("full"))
    hits = hopeful.select("row", F.posexplode("words").alias("pos", "word")).join(asked, ["row", "word"])
    hits = hits.withColumn("at", F.col("pos") - F.col("offset"))
    places = hits.select("row", "template", "at", "word", "idf").distinct().groupBy("row", "template", "at").agg(F.sum("idf").alias("agreed"))
    agreed = places.join(full, ["row", "template"]).filter(2 * F.col("agreed") >= F.col("full"))

    facts = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        words, wanted = text.split(), key.split()
        facts.append((t, label, words, wanted, _begin(words, wanted)))
    facts = spark.createDataFrame(facts, "template int, label string, body array<string>, key array<string>, begin int")
    met = agreed.join(facts, "template").join(hopeful.select("row", "words"), "row")
    key = F.transform("key", lambda w, k: F.coalesce(F.get("words", F.col("at") + F.col("begin") + k) == w, F.lit(False)))
    same = F.filter("body", lambda w, k: F.get("words", F.col("at") + k) == w)
    met = met.filter(F.forall(key, lambda x: x))
    return met.select("row", "label", F.col("at").cast("bigint").alias("at"), (F.size(same) / F.size("body")).alias("share"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, the base places and labels, and the method's.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    matches (array of label, at, share). A-Z is lower-cased; words are runs of other than
    ASCII non-alphanumerics. Base places are all places of ``BASE_PHRASES``. A template
    matches at every place where its key phrase stands; ``share`` is the part of the template's words found in place. score
    is the highest share, at least 0.5 with a base label, else 0. A null or empty text has
    no words and no labels. Rows that repeat a doc_id are scanned on their own.
    """
    seen, _ = write_scratch(_first_look(docs), "licence-words")
    found = _matches(seen).groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("label", "at", "share"))).alias("matches"), F.max("share").alias("best")
    )
    out = seen.drop("held", "words").join(found, "row", "left")
    own = F.coalesce(F.col("matches.label"), F.array().cast("array<string>"))
    based = F.when(F.size("base") > 0, 0.5).otherwise(0.0)
    return out.select(
        "doc_id", "n_words",
        F.size("spots").cast("bigint").alias("n_base"),
        F.array_min("spots").cast("bigint").alias("first_word"),
        F.array_max("spots").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", own)), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), based).alias("score"),
        "matches",
    )
