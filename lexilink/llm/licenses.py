"""License scans over a positional rare-token index. Native: DataFrame operations only.

Templates are word sequences with a label: short phrases that must stand in full, and notices with mandatory key phrases. The index maps
each word of a template to its offsets there. Words are ranked by IDF, from the document frequencies over all documents. For each file and notice the `rare` words of highest IDF
that the file itself has are looked up; a posting at offset o of a word at position p proposes the notice at p - o, and postings of different words intersect where they propose the same place.
A place with `least_votes` words or more is then verified: all mandatory key phrases of the notice must stand in the file within its reach. A phrase can only stand where its own rarest word does, so
that word alone proposes its places, and every word is verified there; none is missed.

The dictionary of licence words holds what phrases and key phrases consist of and the notices' other words but for `COMMON` ones, which tell nothing. It and the templates are fixed lists, so what goes to every executor doesn't grow with the data.

Edge cases: null, empty and wordless texts have no words and no labels; repeated ids give one row per row; overlapping and repeated phrases all count; an
empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilink.llm.common import Scratch, alnum_words, written

#: The contract's phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of public licences as (label, words, mandatory key phrases), in short statements and in the notices that stand in files.
NOTICES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa", "4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["neighboring rights"]),
    ("mit-notice", "released under the mit license", ["released under", "mit license"]),
    (
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        ["hereby granted free", "person obtaining"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution",
        ["binary forms", "following conditions"],
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["promote products derived", "specific prior written permission"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["hereby granted provided", "permission notice appear"],
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["apache license version 2 0", "file except"],
    ),
    (
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license", "free software foundation", "version 3"],
    ),
    (
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ["gnu general public license", "free software foundation", "version 2"],
    ),
    (
        "lgpl-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ["gnu lesser general public license", "version 2 1"],
    ),
    (
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu affero general public license", "version 3"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released"]),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use "
        "this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["implied warranty", "commercial applications"],
    ),
]
#: Words that are in most texts; they are in the dictionary only where a phrase or a key phrase needs them.
COMMON = set("a an all and any are as at be can do for form from has if in into is it its kind may must name names no nor not of on one or other so that the this to use was whom will with work you your".split())


def templates() -> list[dict]:
    """Phrases first, then notices, then the notices' key phrases as inner templates without a label."""
    out = [{"id": i, "words": p.split(), "label": label, "kind": "phrase"} for i, (p, label) in enumerate(PHRASES.items())]
    inner: dict[str, int] = {" ".join(t["words"]): t["id"] for t in out}
    notices = []
    for label, text, keys in NOTICES:
        for key in keys:
            if key not in inner:
                inner[key] = len(out)
                out.append({"id": len(out), "words": key.split(), "label": None, "kind": "key"})
        notices.append((label, text, keys))
    for label, text, keys in notices:
        out.append({"id": len(out), "words": text.split(), "label": label, "kind": "notice", "keys": [inner[k] for k in keys]})
    return out


def dictionary() -> list[str]:
    """The licence words that are looked for in texts."""
    known = templates()
    exact = {w for t in known if t["kind"] != "notice" for w in t["words"]}
    return sorted(exact | {w for t in known for w in t["words"]} - COMMON)


def licence_words(docs: DataFrame, id_col: str, text_col: str, words: list[str]) -> DataFrame:
    """row, doc, n_words, found: the licence words of each text as (at: word position, w: word), ascending."""
    tokens = docs.select(F.col(id_col).alias("doc"), alnum_words(F.col(text_col)).alias("tokens"))
    places = F.filter(F.transform("tokens", lambda w, i: F.struct(i.alias("at"), F.when(w.isin(words), w).alias("w"))), lambda s: s["w"].isNotNull())
    return tokens.select(F.monotonically_increasing_id().alias("row"), "doc", F.size("tokens").cast("long").alias("n_words"), places.alias("found"))


def _index(rows: DataFrame, words: list[str]) -> tuple[list[dict], dict[str, float]]:
    """Templates with their words ranked by IDF over all documents; at most one count per licence word comes to the driver."""
    n = rows.count()
    counted = rows.select(F.explode(F.array_distinct(F.transform("found", lambda s: s["w"]))).alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in counted}
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1.0 for w in words}
    known = templates()
    for t in known:
        t["ranked"] = sorted(set(t["words"]) & idf.keys(), key=lambda w: (-idf[w], w))
        t["anchor"] = t["ranked"][0]
        t["offset"] = t["words"].index(t["anchor"])
    return known, idf


def _phrase_places(rows: DataFrame, known: list[dict]) -> DataFrame:
    """row, id, places: starts of every phrase and key phrase, from the postings of its rarest word."""
    spark = rows.sparkSession
    exact = [(t["id"], t["anchor"], t["offset"], t["words"]) for t in known if t["kind"] != "notice"]
    table = F.broadcast(spark.createDataFrame(exact, "id int, anchor string, offset int, words array<string>"))
    present = rows.withColumn("present", F.array_distinct(F.transform("found", lambda s: s["w"])))
    anchors = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(a).alias("anchor")) for i, a, _, _ in exact])
    active = F.filter(anchors, lambda t: F.array_contains(F.col("present"), t["anchor"]))
    # Licence words stand in `found` in text order, so a phrase's words are neighbours there: same relative position in both.
    def verified(s: Column, i: Column) -> Column:
        agrees = F.forall(
            F.sequence(F.lit(0), F.size("words") - 1),
            lambda k: F.coalesce(
                (F.get("found", i - F.col("offset") + k)["at"] == s["at"] - F.col("offset") + k) & (F.get("found", i - F.col("offset") + k)["w"] == F.get("words", k)),
                F.lit(False),
            ),
        )
        return F.when((s["w"] == F.col("anchor")) & agrees, s["at"] - F.col("offset"))

    joined = present.where(F.size("found") > 0).select("row", "found", F.explode(F.transform(active, lambda t: t["id"])).alias("id")).join(table, "id")
    places = F.filter(F.transform("found", verified), lambda p: p.isNotNull())
    return joined.select("row", "id", places.alias("places")).where(F.size("places") > 0)


def _notice_matches(rows: DataFrame, places: DataFrame, known: list[dict], idf: dict[str, float], rare: int, least_votes: int, slack: int) -> DataFrame:
    """row, label, score of notices: rare words looked up, postings that agree in relative position, key phrases verified within reach."""
    spark = rows.sparkSession
    notices = [(t["id"], t["label"], len(t["words"]), t["ranked"], t["keys"], [[i for i, w in enumerate(t["words"]) if w == r] for r in t["ranked"]], [idf[r] for r in t["ranked"]]) for t in known if t["kind"] == "notice"]
    schema = "id int, label string, length int, ranked array<string>, keys array<int>, offsets array<array<int>>, weights array<double>"
    table = F.broadcast(spark.createDataFrame(notices, schema))
    # The file's own rarest words of each notice; a file with fewer than least_votes of them can't propose it.
    present = F.array_distinct(F.transform("found", lambda s: s["w"]))
    wanted = F.array(*[F.struct(F.lit(t[0]).alias("id"), F.array(*map(F.lit, t[3])).alias("ranked"), F.array(*[F.array(*map(F.lit, o)) for o in t[5]]).alias("offsets")) for t in notices])
    own = F.transform(wanted, lambda t: F.struct(t["id"].alias("id"), t["ranked"].alias("ranked"), t["offsets"].alias("offsets"), F.slice(F.array_intersect(t["ranked"], "present"), 1, rare).alias("looked_up")))
    able = F.filter(own, lambda t: F.size(t["looked_up"]) >= least_votes)

    def proposed(t: Column) -> Column:
        """Where the looked-up words of a notice say that it starts."""
        looked = F.filter("found", lambda s: F.array_contains(t["looked_up"], s["w"]))
        starts = F.transform(looked, lambda s: F.transform(F.get(t["offsets"], F.array_position(t["ranked"], s["w"]).cast("int") - 1), lambda o: F.struct((s["at"] - o).alias("start"), s["w"].alias("w"))))
        return F.struct(t["id"].alias("id"), F.flatten(starts).alias("p"))

    # Each notice takes along what it proposes, not the file's words.
    base = rows.where(F.size("found") >= least_votes).select("row", "found", present.alias("present")).withColumn("able", able).where(F.size("able") > 0)
    each = base.select("row", F.explode(F.transform("able", proposed)).alias("t")).select("row", "t.id", F.explode("t.p").alias("p")).select("row", "id", "p.start", "p.w").distinct()
    votes = each.groupBy("row", "id", "start").agg(F.collect_set("w").alias("agreeing")).where(F.size("agreeing") >= least_votes).join(table, "id")
    # Key phrases within reach: places and reaches meet by blocks of words as long as the longest reach, so a reach touches two or three of them.
    block = max(t[2] for t in notices) + 2 * slack
    first, last = F.col("start") - slack, F.col("start") + F.col("length") + slack
    asked = votes.select("row", "id", "start", first.alias("first"), last.alias("last"), F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    there = places.select("row", F.col("id").alias("key"), F.explode("places").alias("place")).withColumn("block", F.floor(F.col("place") / block))
    met = asked.join(there, ["row", "key", "block"]).where(F.col("place").between(F.col("first"), F.col("last")))
    near = met.groupBy("row", "id", "start").agg(F.count_distinct("key").alias("n"), F.max("n_keys").alias("n_keys")).where("n = n_keys").select("row", "id", "start")
    weight = F.aggregate("agreeing", F.lit(0.0), lambda acc, w: acc + F.get("weights", F.array_position("ranked", w).cast("int") - 1))
    most = F.aggregate(F.slice("weights", 1, rare), F.lit(0.0), lambda acc, w: acc + w)
    return votes.join(near, ["row", "id", "start"], "left_semi").groupBy("row", "label").agg(F.max(F.least(F.lit(1.0), weight / most)).alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 6, least_votes: int = 2, slack: int = 8) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        return written(_scanned(docs, id_col, text_col, rare, least_votes, slack, scratch), "licences")


def _scanned(docs: DataFrame, id_col: str, text_col: str, rare: int, least_votes: int, slack: int, scratch: Scratch) -> DataFrame:
    words = dictionary()
    rows = scratch.written(licence_words(docs, id_col, text_col, words), "licence-words")
    known, idf = _index(rows, words)
    places = scratch.written(_phrase_places(rows, known), "licence-places")
    phrase_label = F.create_map(*[x for t in known if t["kind"] == "phrase" for x in (F.lit(t["id"]), F.lit(t["label"]))])
    base = (
        places.withColumn("label", phrase_label[F.col("id")])
        .where(F.col("label").isNotNull())
        .groupBy("row")
        .agg(
            F.sum(F.size("places")).cast("long").alias("n_base"),
            F.min(F.array_min("places")).cast("long").alias("first_word"),
            F.max(F.array_max("places")).cast("long").alias("last_word"),
            F.collect_set("label").alias("of_base"),
        )
    )
    notices = _notice_matches(rows, places, known, idf, rare, least_votes, slack).groupBy("row").agg(F.collect_set("label").alias("of_notices"), F.max("score").alias("score"))
    none = F.array().cast("array<string>")
    out = rows.select("row", F.col("doc").alias(id_col), "n_words").join(base, "row", "left").join(notices, "row", "left")
    of_base, of_notices = F.coalesce("of_base", none), F.coalesce("of_notices", none)
    return out.select(
        id_col,
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(of_base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(of_base, of_notices)), ",").alias("labels"),
        F.when(F.size(of_base) > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
