"""License scans by diagonal voting, in DataFrame operations only.

All rolling k-word grams of a text are hashed and joined with the grams of license templates. A match votes for a
diagonal, the difference of its places in text and template: a template that stands in a text puts all its votes on one
diagonal, with a few words put in or left out on neighbouring ones. Votes are summed by diagonal, neighbouring
diagonals are merged, and a span counts by the share of the template that its verified words cover.

Short phrases must be covered wholly and on one diagonal. The templates are a fixed list, so they are broadcast.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.text import LOWER, UPPER, lowered, whole

#: Words of a license text: letters, digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram: of phrases, of notices. How far apart merged diagonals may be; the least cover of a notice.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
NEIGHBOURS, LEAST_COVER = 3, 0.6

# The phrases and labels that every scan reports.
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
# Public license notices and the labels of this method.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mit-terms": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


class Gram(NamedTuple):
    template: int
    label: str
    base: bool
    grams: int
    place: int
    size: int
    gram: str


def template_grams() -> list[Gram]:
    """Every gram of every template."""
    texts = [(label, True, PHRASE_GRAM, text) for label, text in PHRASES.items()] + [(label, False, NOTICE_GRAM, text) for label, all_ in NOTICES.items() for text in all_]
    out = []
    for number, (label, base, size, text) in enumerate(texts):
        words = re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))
        n = len(words) - size + 1
        out += [Gram(number, label, base, n, i, size, " ".join(words[i : i + size])) for i in range(n)]
    return out


def _hash(size: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(size), *words)


#: Words of a template that one number marks, a bit each.
LANE = 32


def _lanes() -> list[str]:
    """The columns that mark a template's words."""
    longest = max(g.grams + g.size - 1 for g in template_grams())
    return [f"words_{i}" for i in range(-(-longest // LANE))]


def _marks(gram: Gram) -> list[int]:
    """For each lane, the bits of the words that a gram covers."""
    words = ((1 << gram.size) - 1) << gram.place
    return [words >> i * LANE & (1 << LANE) - 1 for i in range(len(_lanes()))]


def _templates(spark: SparkSession) -> DataFrame:
    lanes = ", ".join(f"{name} long" for name in _lanes())
    rows = spark.createDataFrame([(*g, *_marks(g)) for g in template_grams()], f"template int, label string, base boolean, grams int, tpos int, size int, gram string, {lanes}")
    terms = [F.get(F.split("gram", " "), F.lit(i)) for i in range(NOTICE_GRAM)]
    known = F.when(F.col("size") == PHRASE_GRAM, _hash(PHRASE_GRAM, terms[:PHRASE_GRAM])).otherwise(_hash(NOTICE_GRAM, terms))
    ends = spark.createDataFrame([(-1, "", False, 0, 0, 0, "", *[0] * len(_lanes()))], rows.schema).withColumn("hash", F.lit(_END))
    return rows.withColumn("hash", known).union(ends)


def _rolling(size: int) -> Column:
    """The hash of the gram that starts at each of ``words``; past the end, of the words that are left."""
    return F.transform("words", lambda word, i: _hash(size, [word, *(F.get("words", i + j) for j in range(1, size))]))


#: Stands behind the grams of each text, so that texts without a match come through the join too.
_END = -1


def votes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified matches: id, a hash of the text, its number of words, and template and place; one row more per text."""
    body = docs.select(F.col(id_column).alias("id"), lowered(whole(text)).alias("body"))
    words = body.select("id", F.xxhash64("body").alias("key"), F.regexp_extract_all("body", F.lit(TERM), F.lit(0)).alias("words"))
    hashes = [_rolling(k) for k in (PHRASE_GRAM, NOTICE_GRAM)]
    grams = words.select("id", "key", "words", F.posexplode(F.concat(*hashes, F.array(F.lit(_END).cast("long")))).alias("at", "hash"))
    found = grams.join(F.broadcast(_templates(docs.sparkSession)), "hash")
    n = F.size("words")
    pos = F.when(F.col("size") == PHRASE_GRAM, F.col("at")).otherwise(F.col("at") - n)
    found = found.withColumns({"n_words": n, "pos": pos, "seen": F.array_join(F.slice("words", pos + 1, F.col("size")), " ")})
    return found.filter((F.col("template") < 0) | (F.col("seen") == F.col("gram"))).select("id", "key", "n_words", "template", "label", "base", "grams", "tpos", "size", "pos", *_lanes())


def spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span: ``id``, ``key``, ``n_words``, ``template``, ``label``, ``base``, ``start``, ``stop``, ``cover``, ``rows``.

    Template -1 stands for the text itself, so that texts without a span have a row too; ``rows`` is how many rows have it.
    Cover is the share of the template's words that lie in verified grams. Start and stop are words from 0;
    the start is where the template begins, were it whole.
    """
    of = ["id", "key", "n_words", "template", "label", "base", "grams"]
    found = votes(docs, id_column, text).repartition("id", "key")
    found = found.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("pos") - F.col("tpos")))
    marked = [F.bit_or(lane).alias(lane) for lane in _lanes()]
    # Rows that repeat id and text come together here; the closing entry of each counts them.
    lines = found.groupBy(*of, "size", "diagonal").agg(*marked, F.max(F.col("pos") + F.col("size")).alias("stop"), F.count(F.when(F.col("template") < 0, 1)).alias("rows"))
    along = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.col("base") | step.isNull() | (step > NEIGHBOURS)
    lines = lines.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy(*of, "size", "span").agg(F.min("diagonal").alias("start"), F.max("stop").alias("stop"), *marked, F.sum("rows").alias("rows"))
    covered = reduce(Column.__add__, [F.bit_count(lane) for lane in _lanes()])
    cover = F.when(F.col("grams") > 0, covered / (F.col("grams") + F.col("size") - 1)).otherwise(0.0)
    return merged.withColumn("cover", cover).select("id", "key", "n_words", "template", "label", "base", "start", "stop", "cover", "rows")


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts the places of phrases, ``score`` is the best cover of any template. Null and empty texts have no
    words, no labels (empty strings) and score 0. Rows that repeat give a row each, whether they repeat
    the id, the text or both. A null id stays null. An empty table gives no rows. Other columns are not read.
    """
    found = spans(docs, id_column, text)
    place = F.col("base") & (F.col("cover") == 1)
    label = F.when(place | (~F.col("base") & (F.col("cover") >= LEAST_COVER)), F.when(F.col("label") != "", F.col("label")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = found.groupBy("id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"), joined(label).alias("labels"), F.max("cover").alias("score"), F.sum("rows").alias("rows"),
    )
    each = F.explode(F.sequence(F.lit(1), F.col("rows")))
    return out.withColumn("nth", each).drop("key", "rows", "nth").withColumnRenamed("id", id_column)


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    grams = ", ".join(f"({g.template}, '{g.label}', {g.base}, {g.grams}, {g.place}, {g.size}, '{g.gram}')" for g in template_grams())
    return f"""with templates(template, label, base, grams, tpos, size, gram) as (values {grams}),
    texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as w from documents),
    places as (select doc_id, w, unnest(range(len(w))) as pos from texts),
    grams as (select doc_id, pos, {PHRASE_GRAM} as size, array_to_string(w[pos + 1:pos + {PHRASE_GRAM}], ' ') as gram from places where pos + {PHRASE_GRAM} <= len(w)
        union all select doc_id, pos, {NOTICE_GRAM}, array_to_string(w[pos + 1:pos + {NOTICE_GRAM}], ' ') from places where pos + {NOTICE_GRAM} <= len(w)),
    hits as (select doc_id, template, label, base, grams, tpos, size, pos - tpos as diagonal from grams join templates using (size, gram)),
    lines as (select distinct doc_id, template, diagonal from hits),
    steps as (select *, diagonal - lag(diagonal) over along as step from lines window along as (partition by doc_id, template order by diagonal)),
    spans as (select *, sum(case when step <= {NEIGHBOURS} and template >= {len(PHRASES)} then 0 else 1 end) over (partition by doc_id, template order by diagonal) as span from steps),
    covered as (select *, tpos + unnest(range(size)) as word from hits join spans using (doc_id, template, diagonal)),
    covers as (select doc_id, template, label, base, span, min(diagonal) as start, count(distinct word) / any_value(grams + size - 1) as cover from covered group by all),
    marked as (select *, base and cover = 1 as place from covers)
    select t.doc_id, len(w) as n_words, count(start) filter (place) as n_base, min(start) filter (place) as first_word, max(start) filter (place) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (place), '') as base_labels,
    coalesce(string_agg(distinct label, ',' order by label) filter (place or (not base and cover >= {LEAST_COVER})), '') as labels,
    coalesce(max(cover), 0.0)::double as score from texts t left join marked m on t.doc_id = m.doc_id group by t.doc_id, len(w)"""
