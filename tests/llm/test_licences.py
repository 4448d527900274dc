import math
import random
from collections import Counter

from papyra.llm import licences

from . import brute
from .conftest import prose, rows

GPL = "This work is licensed under the GNU General Public License, version 3."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


def base(docs):
    out = []
    for i, t in docs:
        w = brute.alnum(t)
        at = [(k, label) for p, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        out.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    return out


LICENSED = [
    (200, f"{prose(1, 30)} Released under the MIT License. {prose(2, 9)}"), (201, "Licensed under the Apache License, Version 2.0."), (202, "Licensed under CC BY-NC 4.0. cc by nc cc by nc"), (203, GPL), (204, f"{prose(3, 50)}\n{BSD}\n{prose(4, 50)}"),
    (205, "We like the general public. A license is version 3 of nothing under the work."), (206, "redistribution of binary forms is permitted"), (207, "MIT LICENSE under the mit license under the mit license"), (208, "cc by"), (209, GPL.replace("GNU", "GNOME")),
    (210, "under the mit"), (211, (prose(5, 200) + " " + GPL) * 20),
]


def test_base_and_labels(docs, texts, spark):
    own = docs.unionByName(spark.createDataFrame(LICENSED + LICENSED[:2], "doc_id long, text string"), allowMissingColumns=True)
    found = licences.scan(own).cache()
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(base([*texts, *LICENSED, *LICENSED[:2]]), key=repr)
    by = {r.doc_id: r for r in found.collect()}
    assert [by[i].labels for i in range(200, 212)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "bsd", "", "", "mit", "", "", "", "gpl-3"]
    assert all(by[i].labels == "" and by[i].score == 0 for i, _ in texts)
    assert all(0 <= r.score <= 1 for r in by.values()) and by[203].score > 0.9 and by[200].score == 1


def plain_labels(docs, rare=12, least=0.6, slack=12):
    """Labels and score of each document: votes of its places against each template's rarest words, one document at a time."""
    words = [brute.alnum(t) for _, t in docs]
    n = len(docs)
    df = Counter(w for own in words for w in set(own))
    index = []
    for _, text, _ in licences.TEMPLATES:
        own = text.split()
        idf = [math.log((n + 1) / (df[w] + 1)) + 1e-3 for w in own]
        top = sorted(range(len(own)), key=lambda j: (-idf[j], j))[:rare]
        index.append({j: idf[j] / sum(idf[k] for k in top) for j in top})
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        labels = {label for p, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        score = float(bool(labels))
        for (label, text, keys), own in zip(licences.TEMPLATES, index, strict=True):
            t = text.split()
            for shift in range(-len(t) + 1, len(w)):
                share = sum(x for j, x in own.items() if 0 <= shift + j < len(w) and w[shift + j] == t[j])
                if share >= least:
                    near = f" {' '.join(w[max(shift - slack, 0) : max(shift + len(t) + slack, 0)])} "
                    if any(f" {key} " in near for key in keys):
                        labels.add(label)
                        score = max(score, min(1.0, round(share, 6)))
        out.append((i, ",".join(sorted(labels)), round(score, 6)))
    return out


def scored(out):
    return sorted(((r.doc_id, r.labels, round(r.score, 6)) for r in out.select("doc_id", "labels", "score").collect()), key=repr)


def test_labels_against_plain(spark):
    """Each template whole, cut, changed, in pieces, beside the key phrase of another, and with its key phrase far away."""
    some, data = random.Random(4), []
    for k, (_, text, keys) in enumerate(licences.TEMPLATES):
        w = text.split()
        changed = [x if some.random() < 0.85 else f"other{x}" for x in w]
        far = " ".join(x for x in w if x not in keys[0].split())
        data += [(10 * k, f"{prose(k, 20)} {text}. {prose(k + 1, 9)}"), (10 * k + 1, " ".join(w[len(w) // 3 :])), (10 * k + 2, " ".join(changed)), (10 * k + 3, " ".join(w[::-1])), (10 * k + 4, f"{keys[0]} {prose(k, 40)} {far}"), (10 * k + 5, f"{text} {licences.TEMPLATES[k - 1][2][0]}"), (10 * k + 6, " ".join(w[: len(w) * 4 // 5]) + f" {prose(9, 3)} {keys[-1]}")]
    data += [(500 + i, prose(i, 30)) for i in range(20)] + LICENSED + [(900, None), (901, "")]
    assert scored(licences.scan(spark.createDataFrame(data, "doc_id long, text string"))) == sorted(plain_labels(data), key=repr)


def test_empty(nothing):
    assert licences.scan(nothing).count() == 0


def test_tables(spark, sf):
    from papyra.llm.queries import op4_licences

    read = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = op4_licences(spark, sf)
    assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(base(read), key=repr)
    assert scored(out) == sorted(plain_labels(read), key=repr)
    text = dict(read)
    assert all(("gpl-3" in r.labels) == ("GNU General Public License, version 3" in text[r.doc_id]) for r in out.collect())


def test_no_python_in_the_plan(docs):
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
