import math
import random
import re
from collections import Counter

import pytest

from lexilink.llm import licenses
from lexilink.llm.licenses import NOTICES, PHRASES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


TEXTS = [
    None, "", "...", "MIT License", "mit\nLICENSE mit-license", "the gnu general public public license", "GNU General Public License GNU General Public License v3",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.", "cc by cc by cc", "ccby", "éMIT license", "mit éLicense", "apache license mit license cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "license " * 3000 + "mit license",
]


def test_base_columns_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int").repartition(3)
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[7].labels == "gpl,gpl-3.0" and got[8].labels == "cc-by,cc-by-nc-4.0" and got[9].labels == "apache,apache-2.0"
    assert got[10].labels == "mit,mit-notice" and got[16].labels == "mit-grant" and got[2].score == 0 and got[3].score == 1


def test_sf_documents_equal_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(df).collect()}
    assert got == {r.doc_id: brute(r.text) for r in df.collect()}
    assert sum(v[1] for v in got.values()) > 0


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "x")], "doc_id long, text string")
    assert len(scan_licenses(df).collect()) == 3
    assert scan_licenses(df.limit(0)).count() == 0


def holds(text, key):
    w, k = words(text), key.split()
    return any(w[i : i + len(k)] == k for i in range(len(w)))


def test_notices_in_files_and_their_key_phrases(spark):
    """Each notice amid other text is found; with a key phrase broken it isn't; scattered words are none."""
    rows = []
    for i, (label, text, keys) in enumerate(NOTICES):
        rows.append((3 * i, f"some words before. {text.upper()} and others after", label, True))
        broken = text.replace(keys[-1], keys[-1][::-1])
        rows.append((3 * i + 1, f"other words. {broken} more", label, any(n[0] == label and all(holds(broken, k) for k in n[2]) for n in NOTICES)))
        rows.append((3 * i + 2, " x ".join(text.split()), label, False))
    df = spark.createDataFrame(rows, "doc_id long, text string, want string, is_found boolean")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for doc, text, label, found in rows:
        assert (label in got[doc].labels.split(",")) == found, (text, got[doc])
        assert not found or got[doc].score > 0.5


def brute_notices(texts, rare=6, least_votes=2, slack=8):
    """(labels of notices, score) of each text, posting by posting."""
    known, dictionary = NOTICES, set(licenses.dictionary())
    tokens = [words(t) for t in texts]
    df = Counter(w for t in tokens for w in set(t) & dictionary)
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1.0 for w in dictionary}
    out = []
    for t in tokens:
        best = {}
        for label, text, keys in known:
            n = text.split()
            ranked = sorted(set(n) & dictionary, key=lambda w: (-idf[w], w))
            looked_up = [w for w in ranked if w in t][:rare]
            votes = {}
            for at, w in enumerate(t):
                for o, x in enumerate(n):
                    if x == w and w in looked_up:
                        votes.setdefault(at - o, set()).add(w)
            most = sum(idf[w] for w in ranked[:rare])
            for start, agreeing in votes.items():
                places = [[i for i in range(len(t)) if t[i : i + len(k.split())] == k.split()] for k in keys]
                if len(agreeing) >= least_votes and all(any(start - slack <= p <= start + len(n) + slack for p in of_key) for of_key in places):
                    best[label] = max(best.get(label, 0.0), min(1.0, sum(idf[w] for w in agreeing) / most))
        out.append((set(best), max(best.values(), default=0.0)))
    return out


def test_labels_and_scores_of_the_method_equal_brute_force(spark):
    rng = random.Random(2)
    texts = list(TEXTS)
    for _ in range(60):
        a, b = rng.choice(NOTICES)[1].split(), rng.choice(NOTICES)[1].split()
        mixed = a[rng.randrange(0, 3) : rng.randrange(3, len(a) + 1)] + ["and"] * rng.randrange(0, 12) + b[rng.randrange(0, len(b)) :]
        texts.append(" ".join(w for w in mixed if rng.random() > 0.1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_notices(texts)
    for r in scan_licenses(df).collect():
        base = set(filter(None, r.base_labels.split(",")))
        labels, score = want[r.doc_id]
        assert set(filter(None, r.labels.split(","))) == labels | base, texts[r.doc_id]
        assert r.score == pytest.approx(1.0 if base else score), texts[r.doc_id]


def test_clashing_names_and_ties(spark):
    df = spark.createDataFrame([(1, "mit license", "a", "b", 3, "c")] * 2, "doc_id long, text string, row string, found string, n_base int, labels string")
    got = scan_licenses(df).collect()
    assert len(got) == 2 and all((r.n_base, r.labels) == (1, "mit") for r in got)


def test_very_many_notices_in_one_text(spark):
    import time

    notice = next(text for label, text, _ in NOTICES if label.startswith("mit"))
    one = spark.createDataFrame([(1, notice)], "doc_id long, text string")
    want = scan_licenses(one).first()
    df = spark.createDataFrame([(1, f"{notice} and then " * 5000)], "doc_id long, text string")
    began = time.time()
    got = scan_licenses(df).first()
    assert time.time() - began < 30 and got.labels == want.labels and got.score == want.score
