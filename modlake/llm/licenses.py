"""License scans over a positional rare-token index. DataFrame functions only.

Templates are known sentences of licences; their words with template and place are the postings. Of each text only the
licence words and their places are kept. Each template is looked up by the highest-IDF word of its own key phrase (IDF over
all documents): as all words of the phrase are mandatory, no alignment is lost. That posting proposes the template at a
relative position, and the other words' postings at that position are intersected with it. An alignment counts if all words of the template's mandatory key phrase stand in it and the words found carry
``COVER`` of the template's IDF.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlake.functions.text import let
from modlake.llm.common import saved, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label, mandatory key phrase, sentence: fixed values, wordings of public licences and of the notices that refer to them.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission notice shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "gnu general public license is a free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "cc0 1 0 universal", "dedicated to the public domain under cc0 1 0 universal"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
)
#: Words that say nothing of a licence unless a key phrase holds them: fixed values.
COMMON = frozenset("a and any are for in is it of or the this to under use with you can".split())
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))
COVER = 0.6


def postings() -> tuple[dict[str, list[tuple[int, int]]], list[list[int]]]:
    """word -> (template, place); template -> places of its key phrase."""
    index: dict[str, list[tuple[int, int]]] = {}
    keys = []
    for t, (_, phrase, sentence) in enumerate(TEMPLATES):
        words, key = sentence.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        keys.append(list(range(at, at + len(key))))
        for i, w in enumerate(words):
            if w not in COMMON or i in keys[-1]:
                index.setdefault(w, []).append((t, i))
    return index, keys


def _base_places(hits: Column) -> Column:
    """array of (place, label) where a base phrase's words stand one after the other."""
    def at(phrase: tuple[str, ...], label: str) -> Column:
        def stands(k: Column) -> Column:
            ok = F.get(hits, k)["w"] == phrase[0]
            for d, w in enumerate(phrase[1:], 1):
                ok = ok & F.coalesce((F.get(hits, k + d)["w"] == w) & (F.get(hits, k + d)["i"] == F.get(hits, k)["i"] + d), F.lit(False))
            return ok

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(hits) - 1), stands), lambda k: F.named_struct(F.lit("i"), F.get(hits, k)["i"], F.lit("label"), F.lit(label)))

    none = F.array().cast("array<struct<i:int,label:string>>")
    return F.when(F.size(hits) < 2, none).otherwise(F.concat(*[at(p, label) for label, p in BASE]))


def _words_of(df: DataFrame, id_col: str, text_col: str, vocabulary: list[str], phrases: list[list[str]]) -> DataFrame:
    """doc_id, key (of the text), n_words, seen (its licence words), base (places), hits: licence words with their places.

    hits are kept only where all words of some key phrase occur: no other text can have a verified alignment.
    """
    none = F.array().cast("array<struct<w:string,i:int>>")

    def found(w: Column, hits: Column) -> Column:
        def with_words(seen: Column) -> Column:
            may = F.exists(F.array(*[F.array(*map(F.lit, p)) for p in phrases]), lambda p: F.size(F.array_except(p, seen)) == 0)
            return F.named_struct(F.lit("n_words"), F.size(w).cast("long"), F.lit("seen"), seen, F.lit("base"), _base_places(hits), F.lit("hits"), F.when(may, hits).otherwise(none))

        return let(F.array_distinct(F.transform(hits, lambda h: h["w"])), with_words)

    def of(w: Column) -> Column:
        some = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(vocabulary))
        hits = F.when(F.size(w) == 0, none).otherwise(F.transform(some, lambda i: F.named_struct(F.lit("w"), F.get(w, i), F.lit("i"), i)))
        return let(hits, lambda h: found(w, h))

    text = text_or_empty(text_col)
    words = F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.encode(text, "utf-8")).alias("key"), let(words, of).alias("x")).select("doc_id", "key", "x.*")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    score: the largest share of a template's IDF that a verified alignment covers, 0 without one. Null texts have no
    words. Repeated rows give repeated rows; other columns are left out.
    """
    index, keys = postings()
    docs = saved(_words_of(df, id_col, text_col, sorted(index), [p.split() for _, p, _ in TEMPLATES]), "license-words")
    # IDF of the words of the templates: as many rows as these have words
    seen = docs.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    total = docs.count()
    df_of = {r.w: r.n for r in seen}
    idf = {w: math.log((1 + total) / (1 + df_of.get(w, 0))) + 0.1 for w in index}
    full = [sum(idf[w] for w, ps in index.items() for t, _ in ps if t == n) for n in range(len(TEMPLATES))]
    spark = df.sparkSession
    words = [s.split() for _, _, s in TEMPLATES]
    rare = [max(keys[t], key=lambda p: (idf[words[t][p]], -p)) for t in range(len(TEMPLATES))]
    table = spark.createDataFrame([(w, float(idf[w]), [(t, p, p == rare[t]) for t, p in ps]) for w, ps in index.items()], "w string, idf double, at array<struct<t:int,p:int,seed:boolean>>")
    facts = spark.createDataFrame([(t, label, float(full[t]), keys[t]) for t, (label, _, _) in enumerate(TEMPLATES)], "t int, label string, total double, phrase array<int>")

    texts = docs.filter("size(hits) > 0").groupBy("key").agg(F.any_value("hits").alias("hits"))
    tokens = texts.select("key", F.explode("hits").alias("h")).select("key", "h.w", "h.i")
    aligned = tokens.join(F.broadcast(table), "w").select("key", "idf", "i", F.explode("at").alias("a"))  # the index holds the templates' words only
    aligned = aligned.groupBy("key", F.col("a.t").alias("t"), (F.col("i") - F.col("a.p")).alias("offset")).agg(F.max("a.seed").alias("seed"), F.sum("idf").alias("got"), F.collect_set("a.p").alias("places"))
    found = aligned.filter("seed").join(F.broadcast(facts), "t").withColumn("score", F.col("got") / F.col("total"))
    found = found.filter((F.size(F.array_except("phrase", "places")) == 0) & (F.col("score") >= COVER))
    found = found.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))

    names = ["doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.i").cast("long").alias("first_word"), F.array_max("base.i").cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels")]
    both = F.array_join(F.array_sort(F.array_distinct(F.concat("base.label", F.coalesce("found", F.array().cast("array<string>"))))), ",")
    return docs.join(found, "key", "left").select(*names, both.alias("labels"), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))).alias("score"))
