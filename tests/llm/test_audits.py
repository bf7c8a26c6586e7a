"""License scans, source divergence and periodic runs against brute force."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ROWS, key
from wordloom.llm import license_scan, periodic_runs, source_divergence
from wordloom.llm._common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Periodic runs


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s = i - q
            if j - s >= max(6, 4 * q) and not any(all(words[x] == words[x - d] for x in range(s + d, j)) for d in range(1, q)):
                out.append((s, j - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(words, a, p):
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        letters, n = rng.choice([1, 2, 2, 3, 4, 40]), rng.randrange(0, 64)
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            words = repeated(words, a, rng.randrange(1, max(2, (n - a) // 3 + 1)))
            if rng.random() < 0.5:
                words[rng.randrange(n)] = b"x"
        runs = periodic_runs.find_runs(words)
        assert runs == brute_runs(words), words
        gone = {x for s, k, q in runs for x in range(s + q, s + k)}
        assert periodic_runs.collapse(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_lyndon_array():
    rng = random.Random(6)
    for _ in range(500):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 30))]
        want = [max(k for k in range(1, len(w) - i + 1) if all(w[i : i + k] < w[j : i + k] for j in range(i + 1, i + k))) for i in range(len(w))]
        assert periodic_runs.longest_lyndon(w) == want, w


class Counted(int):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("kind", ["one letter", "Fibonacci", "powers", "two letters"])
def test_comparisons_grow_as_the_text(kind):
    a, b = [0], [0, 1]
    while len(b) < 20000:
        a, b = b, b + a
    rng = random.Random(7)
    whole = {"one letter": [0] * 20000, "Fibonacci": b, "powers": ([0] * 50 + [1]) * 400, "two letters": [rng.randrange(2) for _ in range(20000)]}[kind]
    used = []
    for n in (5000, 20000):
        Counted.seen = 0
        periodic_runs.longest_lyndon([Counted(x) for x in whole[:n]])
        used.append(Counted.seen)
    assert used[1] < 5 * used[0] and used[1] < 12 * 20000


def brute_planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    return repeated(words, g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 else words


def test_run_digests(spark, docs, empty):
    more = [(k, "Straße é " + " ".join(random.Random(k).choices("a b c d e".split(), k=30 + k)), "en", "s", 0, 1, "x", 2) for k in range(100, 160)]
    rows = docs.union(spark.createDataFrame(more, docs.schema))
    got = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(rows))).collect()
    want = []
    for i, t in [*ROWS, *((m[0], m[1]) for m in more)]:
        words = brute_planted(i, (t or "").encode().split())
        runs = brute_runs(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        gone = {x for s, k, q in runs for x in range(s + q, s + k)}
        left = b" ".join(w for x, w in enumerate(words) if x not in gone)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha256(lines).hexdigest(), sha256(left).hexdigest()))
    assert key(map(tuple, got)) == key(want) and sum(w[1] > 0 for w in want) > 3
    assert periodic_runs.periodic_runs(empty).count() == 0


# Source divergence


def brute_divergence(rows, least, top):
    split = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for lang, source, t in rows]
    groups = {(lang, s) for lang, s, _ in split}
    counts, df, whole = {g: Counter() for g in groups}, Counter(), Counter()
    for lang, s, ws in split:
        counts[lang, s].update(ws)
        whole.update((lang, w) for w in ws)
        df.update((lang, w) for w in set(ws))
    out = []
    for lang, s in groups:
        kept = sorted(w for (at, w), n in df.items() if at == lang and n >= least)

        def shares(count, kept=kept):
            n = sum(count(w) for w in kept)
            return {w: 1 + 1000000000 * (count(w) + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = shares(lambda w, g=(lang, s): counts[g][w]), shares(lambda w, lang=lang: whole[lang, w])
        terms = [("term", w, p[w] - q[w]) for w in kept if counts[lang, s][w] and p[w] > q[w]]
        pairs = []
        for at, o in groups:
            if at == lang and o != s:
                r = shares(lambda w, g=(at, o): counts[g][w])
                pairs.append(("pair", o, sum(abs(p[w] - r[w]) for w in kept)))
        for part, n in ((pairs, None), (terms, top)):
            ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:n]
            out += [(lang, s, *x, k + 1) for k, x in enumerate(ranked)]
    return out


@pytest.mark.parametrize("few,block,part_rows", [(1, 2, 7), (1000, 256, 100000)])
def test_divergence(spark, few, block, part_rows):
    rng = random.Random(8)
    vocabulary = ["a", "ab", "abc", "abcd", "abd", "B", "é", "éa", "Éa", "日本", "日", "zz", "😀", *(f"term{'x' * k}" for k in range(30))]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "ß", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(20)))) for _ in range(120)]
    rows += [("xx", "none", None), ("xx", "dots", "1 2 ..."), ("xx", "word", "once"), ("en", "bare", ""), ("one", "s0", "w " * 50), ("one", "s0", "w"), ("de", "s9", " ".join(vocabulary))] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, value int").repartition(3)
    got = source_divergence.divergence_audit(df, least=3, top=9, few=few, block=block, part_rows=part_rows).collect()
    assert key(map(tuple, got)) == key(brute_divergence(rows, 3, 9))
    assert source_divergence.divergence_audit(df.where("false")).count() == 0


def test_radix_selection_with_many_ties(spark):
    rng = random.Random(9)
    rows = [(g, "s", "".join(rng.choices("abé", k=rng.randrange(1, 6))) + str(k), rng.choice([0, 1, 1023, 1024, 2**20, 2**30 - 1])) for g in "xyz" for k in range({"x": 400, "y": 50, "z": 3}[g])]
    values, _ = written(spark.createDataFrame(rows, "lang string, source string, term string, value bigint"), "values")
    for k in (1, 5, 50):
        want = [(*r, n + 1) for g in "xyz" for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[2].encode()))[:k])]
        assert key(map(tuple, source_divergence.top_terms(values, k, few=2).collect())) == key(want)


# License scans

NOTICE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def test_licenses(spark):
    edited = NOTICE.replace("for any purpose", "for any lawful and peaceful purpose").replace("provided", "given")
    texts = {
        1: "Licensed under the Apache License, Version 2.0.", 2: "MIT license, mit LICENSE; mit-license", 3: f"{LONG} {NOTICE}", 4: edited, 5: NOTICE.replace("with or without fee", "for a fee"),
        6: "GNU general public licenses", 7: "gnu general PUBLIC licenSe version 3", 8: "cc by-nc 4.0; Licensed under CC BY-NC 4.0.", 9: None, 10: "", 11: "Apache Apache License license", 12: "mit", 13: " ".join(["license"] * 3000),
        14: "copies all in appear notice permission this and notice copyright above the that provided", 15: "ümit license mit license mitlicense",
    }
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id int, text string, _words string").repartition(2)
    index = license_scan.build_index(df)
    got = {r["doc_id"]: r for r in license_scan.scan_report(license_scan.license_scan(df, index)).collect()}
    report = {k: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for k, r in got.items()}
    assert report[1] == (1, 3, 3, "apache", "apache,apache-2.0") and report[2] == (3, 0, 4, "mit", "mit")
    assert report[3] == report[4] == (0, None, None, "", "isc") and report[5] == (0, None, None, "", "")
    assert report[6][0] == 0 and report[7][3:] == ("gpl", "gpl,gpl-3.0") and report[8][3:] == ("cc-by", "cc-by,cc-by-nc-4.0") and report[8][:3] == (2, 0, 7)
    assert report[9] == report[10] == report[12] == report[13] == report[14] == report[15] == (0, None, None, "", "") and report[11][:4] == (1, 1, 1, "apache")
    assert got[9]["n_words"] == 0 and got[13]["n_words"] == 3000 and got[3]["score"] == 1.0 and 0.6 <= got[4]["score"] < 1 and got[10]["score"] == 0
    one = {r["doc_id"]: r["matches"] for r in license_scan.license_scan(df, index).where("doc_id in (3, 4)").collect()}
    assert [(m["label"], m["kind"], m["start"], m["size"]) for m in one[3]] == [("isc", "notice", 9000, 33)] or {m["label"] for m in one[3]} == {"isc"}
    assert all(abs(m["start"]) <= license_scan.SLACK for m in one[4])


def test_license_phrases_against_brute_force(spark, docs, empty):
    rng = random.Random(10)
    bits = "gnu general public license apache cc by mit License, MIT x 4.0 CC-BY".split()
    rows = [(k, " ".join(rng.choices(bits, k=rng.randrange(60)))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in license_scan.scan_report(license_scan.license_scan(df, license_scan.build_index(df))).collect()}
    for k, text in rows:
        words, places = re.findall(license_scan.WORD, text.translate(LOWER)), []
        for label, phrase in (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")):
            own = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
        starts = [i for i, _ in places]
        assert got[k] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    found = license_scan.license_scan(docs, license_scan.build_index(docs)).collect()
    assert key((r["doc_id"], r["n_words"]) for r in found) == key((i, len(re.findall(license_scan.WORD, (t or "").translate(LOWER)))) for i, t in ROWS)
    index = license_scan.build_index(empty)
    assert license_scan.license_scan(empty, index).count() == 0 and all(index.postings)
    assert index.postings[0] == {"general": 1}  # all are as rare, so the first by name
    with pytest.raises(ValueError):
        license_scan.build_index(docs, (license_scan.Template("x", " ".join(map(str, range(license_scan.MOST_WORDS + 1)))),))


def test_rare_words_are_those_of_the_documents(spark):
    df = spark.createDataFrame([(k, "mit der Zeit, general public") for k in range(5)] + [(9, "MIT License")], "doc_id int, text string")
    index = license_scan.build_index(df)
    by_label = {t.text: p for t, p in zip(index.templates, index.postings)}
    assert by_label["mit license"] == {"license": 1} and by_label["gnu general public license"] == {"gnu": 0} and index.idf["mit"] < index.idf["license"]
    assert license_scan.scan_report(license_scan.license_scan(df, index)).where("n_base > 0").agg(F.max("doc_id")).first()[0] == 9
