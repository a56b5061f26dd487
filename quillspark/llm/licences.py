"""Licence scans with a positional index of rare licence words, in DataFrame functions only.

Per text and template: the licence words of highest inverse document frequency are looked up in
the template's postings; postings that agree on one relative position make a candidate, and the
template's key phrase must stand there, every word of it. The words looked up are the rarest
of the key phrase, so no text that holds it is missed, however many notices it holds. Fixed base phrases are found besides.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

#: Phrases that always count, and the label of each.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed values: (label, notice, key phrase within it); words as the scan sees them.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "this project is licensed under the terms of the mit license", "licensed under the terms of the mit license"),
    ("mit", "released under the mit license", "under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "distributed on an as is basis without warranties or conditions of any kind either express or implied", "basis without warranties or conditions of any kind"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general public license as published by the free software foundation either version 2"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "distributed under the bsd 3 clause license", "bsd 3 clause license"),
    ("bsd", "distributed under the bsd 2 clause license", "bsd 2 clause license"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1"),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0", "eclipse public license v 2"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1"),
    ("mpl-2", "subject to the mozilla public license version 2 0", "mozilla public license version 2"),
    ("mpl-1", "subject to the mozilla public license version 1 1", "mozilla public license version 1"),
    ("lgpl", "under the terms of the gnu library general public license", "gnu library general public license"),
    ("gfdl", "under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("artistic-2", "under the terms of the artistic license 2 0", "artistic license 2"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("ofl", "licensed under the sil open font license version 1 1", "sil open font license"),
    ("psf", "under the python software foundation license", "python software foundation license"),
    ("ms-pl", "licensed under the microsoft public license", "microsoft public license"),
    ("ncsa", "university of illinois ncsa open source license", "illinois ncsa open source license"),
    ("odbl", "made available under the open database license", "open database license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without fee and without a written agreement is hereby granted"),
    ("afl-3", "licensed under the academic free license version 3 0", "academic free license version 3"),
    ("osl-3", "licensed under the open software license version 3 0", "open software license version 3"),
    ("sspl", "under the terms of the server side public license", "server side public license"),
    ("busl", "use of this software is governed by the business source license", "governed by the business source license"),
    ("elastic-2", "licensed under the elastic license 2 0", "elastic license 2"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by", "licensed under a creative commons attribution 3 0 unported license", "creative commons attribution 3"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
)
#: The words of a short identifier, after "spdx license identifier", and its label.
IDENTIFIERS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 0": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl-3", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 1 1": "mpl-1", "mpl 2 0": "mpl-2", "isc": "isc",
    "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "zlib": "zlib", "bsl 1 0": "bsl-1", "epl 1 0": "epl-1", "epl 2 0": "epl-2", "artistic 2 0": "artistic-2", "cddl 1 0": "cddl", "ofl 1 1": "ofl", "ncsa": "ncsa", "postgresql": "postgresql", "ms pl": "ms-pl", "wtfpl": "wtfpl",
}
TEMPLATES += tuple((label, f"spdx license identifier {words}", f"spdx license identifier {words}") for words, label in IDENTIFIERS.items())
STOP = frozenset("a all an and any are as by for in is it of on or that the this to use was with".split())
#: Rarest words of a key phrase that are looked up; all must agree on a position.
AGREE = 2

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ``text``: A-Z in lower case, then runs of 0-9, a-z and what isn't ASCII."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _SEPARATOR), lambda w: w != "")


def key_places(template: int) -> list[tuple[int, str]]:
    """(position in the notice, word) of every word of the template's key phrase."""
    _, notice, key = TEMPLATES[template]
    first = len(notice[: f" {notice} ".index(f" {key} ")].split())
    return [(first + k, w) for k, w in enumerate(key.split())]


def notice_places(template: int) -> list[tuple[int, str]]:
    """(position, word) of the notice's words that aren't too common."""
    return [(p, w) for p, w in enumerate(TEMPLATES[template][1].split()) if w not in STOP]


#: Common words in a row within a key phrase, at most; a text's common words further from a licence word aren't kept.
_REACH = 1 + max(len(run.split()) for _, _, key in TEMPLATES for run in " ".join(w if w in STOP else "|" for w in key.split()).split("|"))


def _anchor(phrase: str) -> tuple[int, list[str]]:
    parts = phrase.split()
    return max(range(len(parts)), key=lambda k: (parts[k] not in STOP and parts[k] not in ("license", "under", "version"), -k)), parts


def _base_starts(phrase: str) -> Column:
    """Positions where the phrase stands word by word, found from its anchor word."""
    k, parts = _anchor(phrase)
    same = F.array(*map(F.lit, parts))
    at = F.filter("hits", lambda h: (h["word"] == parts[k]) & (h["pos"] >= k))
    return F.transform(F.filter(at, lambda h: F.slice(F.col("words"), h["pos"] - k + 1, len(parts)) == same), lambda h: h["pos"] - k)


def licence_hits(docs: DataFrame) -> DataFrame:
    """Every row with a row_id: n_words, hits (licence words, common words close to them and their positions), base phrase starts."""
    every = range(len(TEMPLATES))
    vocab = {w for t in every for _, w in notice_places(t)} | {_anchor(p)[1][_anchor(p)[0]] for p in BASE}
    common = {w for t in every for _, w in key_places(t)} & STOP
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"), words(text_or_empty()).alias("words"))
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*sorted(vocab | common)), F.struct(i.alias("pos"), w.alias("word")))), lambda h: h.isNotNull())

    def near(h, i):
        """A licence word, or a common word close to one."""
        keep = ~h["word"].isin(*sorted(STOP))
        for k in (*range(-_REACH, 0), *range(1, _REACH + 1)):
            other = F.get("found", i + k)
            keep = keep | F.coalesce(~other["word"].isin(*sorted(STOP)) & (F.abs(other["pos"] - h["pos"]) <= _REACH), F.lit(False))
        return keep

    rows = rows.select("*", found.alias("found"))
    rows = rows.select("row_id", "doc_id", "words", F.filter("found", near).alias("hits"))
    return rows.select("row_id", "doc_id", F.size("words").cast("long").alias("n_words"), "hits", *(_base_starts(p).alias(f"base_{k}") for k, p in enumerate(BASE)))


def _notices(rows: DataFrame) -> DataFrame:
    """(row_id, method_labels array, method_score): templates whose words and key phrase agree."""
    spark = rows.sparkSession
    some = rows.where(F.size("hits") >= AGREE).select("row_id", "hits")
    seen = some.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count().collect()  # a row for each licence word at most
    frequency = {r["word"]: r["count"] for r in seen}
    index, keys = [], []
    for t, (label, _, _) in enumerate(TEMPLATES):
        # fewest texts first: the highest inverse document frequency
        rare = sorted((frequency.get(w, 0), p, w) for p, w in key_places(t) if w not in STOP)[:AGREE]
        index += [(t, w, p) for _, p, w in rare]
        keys.append((t, label, key_places(t), notice_places(t)))
    index = spark.createDataFrame(index, "template int, word string, place int")  # fixed and small
    looked_up = some.select("row_id", F.explode("hits").alias("h")).select("row_id", "h.pos", "h.word")
    near = looked_up.join(F.broadcast(index), "word").groupBy("row_id", "template", (F.col("pos") - F.col("place")).alias("shift")).agg(F.count_distinct("place").alias("n")).where(F.col("n") >= AGREE)
    keys = spark.createDataFrame(keys, "template int, label string, key array<struct<pos:int,word:string>>, notice array<struct<pos:int,word:string>>")
    met = near.join(F.broadcast(keys), "template").join(some, "row_id")
    placed = lambda column: F.transform(column, lambda k: F.struct((k["pos"] + F.col("shift")).alias("pos"), k["word"].alias("word")))
    sure = met.where(F.size(F.array_except(placed("key"), "hits")) == 0)
    share = F.size(F.array_intersect(placed("notice"), "hits")) / F.size("notice")
    return sure.groupBy("row_id").agg(F.collect_set("label").alias("method_labels"), F.max(share).alias("method_score"))


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row per row.

    Null texts have no words; without places first_word and last_word are null; labels are
    distinct, sorted and comma-joined; score is 1 with a base phrase, else the share of the best
    notice's words that agree, else 0. Repeated rows and null ids are rows of their own; an
    empty table gives an empty one; other columns aren't used.
    """
    rows = staged(licence_hits(docs), "licence-hits")
    starts = F.concat(*(F.col(f"base_{k}") for k in range(len(BASE))))
    by_label = F.array_compact(F.array(*(F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values()))))
    own = F.array_sort(F.array_distinct(by_label))
    out = rows.join(_notices(rows), "row_id", "left").withColumns({"starts": starts, "own": own})
    more = F.coalesce("method_labels", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("own", more)), ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("method_score", F.lit(0.0))).alias("score"),
    )
