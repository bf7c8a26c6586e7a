"""Operators 3, 5, 7 and 10."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ROWS, key, prose
from wordloom.llm import _blocks as B
from wordloom.llm import embedding_graph as G
from wordloom.llm import fingerprints, line_dedup, ngram_join
from wordloom.llm.components import connected_components, forest, linked_labels


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[label[k]] = min(low.get(label[k], i), i)
    return [(i, len(s), low.get(l) if s else i) for (i, _), s, l in zip(rows, sets, label)]


def test_ngram_join(docs, empty):
    got = ngram_join.jaccard_classes(docs).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(brute_classes(ROWS))
    assert ngram_join.jaccard_classes(empty).count() == 0


@pytest.mark.parametrize(("seed", "block", "broadcast"), [(1, 512, 1_000_000), (2, 8, 0)])
def test_ngram_join_of_near_copies(spark, monkeypatch, seed, block, broadcast):
    """Chains of edits around the threshold; small blocks take the way of large groups, and no broadcast that of many sets."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng, rows = random.Random(seed), []
    for g in range(8):
        words = prose(100 * seed + g, rng.choice([6, 11, 14, 40, 90])).split()
        for _ in range(14):
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words += [f"z{rng.randrange(10**6)}"] * rng.randrange(6)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = ngram_join.jaccard_classes(df, broadcast_rows=broadcast).collect()
    assert key((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == key(brute_classes(rows))


def test_overlaps_of_long_columns():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(90)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngram_join.overlaps(sets)
    np.fill_diagonal(got, 0)
    np.fill_diagonal(want := np.asarray(want), 0)
    assert np.array_equal(got, want)


def test_thinned_rows_stand_for_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = np.sort(rng.integers(10, 60, rng.integers(1, 12)))
        kept, a, b = ngram_join.thinned(np.zeros(len(size), np.uint64), size, 80, 100)
        near = lambda x, y: min(x, y) * 100 >= max(x, y) * 80
        assert all(near(size[x], size[y]) for x, y in zip(a, b))
        for other in range(8, 80):
            if any(near(other, x) for x in size):
                assert any(near(other, x) for x in size[kept])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (None, 3)]
    want = dict(zip(*forest([a for a, b in edges if a is not None], [b for a, b in edges if a is not None])))
    got = {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()}
    assert {v: r for v, r in got.items() if v != r} == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    m = np.zeros((5, 5), bool)
    m[0, 4] = m[4, 0] = m[4, 2] = m[2, 4] = True
    assert linked_labels(m).tolist() == [0, 1, 0, 3, 0]


def test_components_that_run_out_of_rounds_are_an_error(spark):
    path = spark.createDataFrame([((k * 37) % 101, ((k + 1) * 37) % 101) for k in range(100)], "a bigint, b bigint").repartition(20)
    with pytest.raises(RuntimeError):
        connected_components(path, most_rounds=1)


def brute_chunks(text, least=10):
    """Start and end of each chunk, line by line."""
    own = line_dedup.lines(text)
    hashes = [int(h) for h in B.word_hash([x for _, x in own])]
    window = [int(B.mixed(np.asarray([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
    weigh = lambda a, b: sum(max(len(x.split()), len(x) // 8) for _, x in own[a : b + 1])
    spans, n = set(), len(own)
    for i in range(n):
        a, b = i - 1, i + 1
        if i + 2 < n and window[i + 1] < window[i]:
            b = i + 2
        if i >= 2 and window[i - 2] <= window[i - 1]:
            a = i - 2
        while b < n and weigh(i, b) < least:
            b += 1
        while a >= 0 and weigh(a, i) < least:
            a -= 1
        spans |= {(x, y) for x, y in ((i, b), (a, i)) if 0 <= x and y < n}
    return [(own[a][0], own[b][0] + len(own[b][1])) for a, b in sorted(spans)]


def brute_lines(rows):
    seen, out = set(), []
    for i, t in rows:
        spans, kept, last, gone = brute_chunks(t) if t else [], [], 0, 0
        for a, b in spans:
            if t[a:b] in seen:
                kept.append(t[last:a])
                last, gone = b, gone + 1
            seen.add(t[a:b])
        text = t if not gone else "".join([*kept, t[last:]]).strip()
        out.append((i, len(spans), gone, text))
    return out


def test_line_dedup(spark, docs, empty):
    passage = ". ".join(prose(k, 9) for k in range(400, 412)) + ". "
    rows = [(k, f"{prose(500 + k, 30)}. {passage}{prose(600 + k, 30)}.") for k in range(6)] + [(20, None), (21, ""), (22, prose(700, 50)), (23, passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = line_dedup.removal_report(df).collect()
    assert key((r["doc_id"], r["n_chunks"], r["n_removed"], r["text"]) for r in got) == key(brute_lines(rows))
    assert all(r["n_removed"] >= 2 for r in got if r["doc_id"] in range(1, 6))  # shifted passages are found
    whole = line_dedup.dedup_lines(docs, block_bytes=2000)
    assert whole.columns == [*docs.columns, "n_chunks", "n_removed", "removed_chars"] and whole.count() == len(ROWS)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_keeps_the_first_of_repeated_rows(spark):
    text = "\n".join(prose(k, 8) for k in range(30))
    got = line_dedup.removal_report(spark.createDataFrame([(None, text), (5, text), (5, text), (2, text)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in got if r["doc_id"]) == [(2, False), (5, True), (5, True)]
    assert [r["n_removed"] > 0 for r in got if r["doc_id"] is None] == [True]


def test_line_dedup_keeps_ids_of_other_types(spark):
    text = "\n".join(prose(k, 8) for k in range(30))
    got = line_dedup.dedup_lines(spark.createDataFrame([("a", text), ("12", text), (None, text)], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "", r["n_removed"] > 0) for r in got) == [("", True), ("12", False), ("a", True)]


def sentences(seed, n_words, k):
    """A passage of k sentences with n_words words altogether."""
    words = [f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n_words)]
    return " ".join(" ".join(words[i * n_words // k : (i + 1) * n_words // k]) + "." for i in range(k))


def test_line_dedup_finds_whole_short_passages(spark):
    """Passages of 50-120 words in 2-6 sentences go as a whole, whatever stands around them."""
    cases = [(n, k) for n in (50, 70, 90, 120) for k in (2, 3, 4, 5, 6)]
    rows = []
    for c, (n, k) in enumerate(cases):
        for copy in (0, 1):
            around = [sentences(9000 + 4 * c + 2 * copy + e, 40, 3 + copy) for e in (0, 1)]
            rows.append((2 * c + copy, " ".join([around[0], sentences(c, n, k), around[1]]), " ".join(around)))
    got = {r["doc_id"]: r["text"] for r in line_dedup.removal_report(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(3)).collect()}
    for i, text, around in rows:
        assert got[i].split() == (text if i % 2 == 0 else around).split()


def test_line_dedup_finds_passages_of_all_kinds(spark):
    """One line without a sentence's end, inside another or alone; unspaced scripts; one string without blanks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randrange(0xE01, 0xE2E)) for _ in range(n))
    spaced = lambda n: " ".join(word() for _ in range(n))
    kinds = [
        (spaced(60), lambda: spaced(30), " ", 0.6), (spaced(150), lambda: spaced(30), " ", 0.85), (f"{spaced(14)}\n{spaced(9)}\n{spaced(14)}", lambda: spaced(12), "\n", 1.0),
        ("".join(han(18) + "。" for _ in range(5)), lambda: han(30) + "。", "", 1.0), (han(200), lambda: han(60), "", 0.8), (thai(300), lambda: thai(80), "", 0.8),
        ("".join(rng.choices("0123456789abcdef", k=400)), lambda: "".join(rng.choices("0123456789abcdef", k=90)), "\n", 1.0),
    ]
    rows = [(2 * k + c, sep.join([other(), passage, other()])) for k, (passage, other, sep, _) in enumerate(kinds) for c in (0, 1)]
    got = {r["doc_id"]: r for r in line_dedup.removal_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for k, (passage, _, _, part) in enumerate(kinds):
        assert got[2 * k]["removed_chars"] == 0 and part * len(passage) - 1 <= got[2 * k + 1]["removed_chars"] <= len(passage) + 1, k


def test_line_dedup_leaves_single_lines(spark):
    """A line of any number of words up to LONG stays wherever it stands alone, as do two lines in another order."""
    line, other = sentences(1, 13, 1), sentences(2, 15, 1)
    rows = [(k, "\n".join([sentences(100 + k, 30, 3), line, sentences(200 + k, 30, 3), other if k % 2 else line, sentences(300 + k, 30, 3)])) for k in range(8)] + [(20, line), (21, line), (22, f"{line}\n{other}"), (23, f"{other}\n{line}")]
    got = {r["doc_id"]: r for r in line_dedup.removal_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert all(got[i]["n_removed"] == 0 and got[i]["text"] == t for i, t in rows)


def test_line_dedup_boundaries_move_with_the_lines():
    rng = random.Random(4)
    passage = "\n".join(sentences(k, rng.randrange(8, 20), 1) for k in range(40, 52))
    alone = {passage[a:b] for a, b in line_dedup.chunks(passage)}
    for k in range(20):
        text = "\n".join([sentences(1000 + k, 40, 1 + k % 5), passage, sentences(2000 + k, 60, 4)])
        starts = [a for a, _ in line_dedup.lines(text)]
        assert all(sum(a <= x < b for x in starts) >= 2 for a, b in line_dedup.chunks(text))
        assert len(alone & {text[a:b] for a, b in line_dedup.chunks(text)}) >= len(alone) - 3


def weighted_jaccard(a, b):
    a, b = (collections.Counter(x.encode().lower().split()) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(docs, empty):
    rows = sorted(((i, t or "") for i, t in ROWS if i is not None), key=lambda r: -r[0])
    got = [r for r in fingerprints.edit_likeness(docs).collect() if r["doc_id"] is not None]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for k, (i, t) in enumerate(rows):
        if i in (9, 1):  # repeated, or followed by a row without an id
            continue
        after = rows[k + 1][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = by[i]
        assert r["edited_text"] == edited and r["n_chars"] == len(t)
        if t.split() and after.split():
            assert abs(r["near_edited"] - weighted_jaccard(t, edited)) < 0.17 and abs(r["near_next"] - weighted_jaccard(t, after)) < 0.17
    assert by[1]["fingerprint"] == by[3]["fingerprint"] and by[4]["fingerprint"] == by[5]["fingerprint"]
    assert {r["fingerprint"] for r in fingerprints.fingerprints(docs.where("doc_id = 1")).collect()} == {by[1]["fingerprint"]}
    assert fingerprints.edit_likeness(empty).count() == 0
    alone = fingerprints.edit_likeness(docs.where("doc_id = 2")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and fingerprints.sha256_hex("") == hashlib.sha256(b"").hexdigest()


def test_sampling_estimates_generalised_jaccard():
    s = fingerprints.Sampler.get(1024)
    a, b = "x x x x y y z " * 3 + "q", "x y y y y z z w w w"
    assert abs(fingerprints.likeness(s.codes(a), s.codes(b)) - weighted_jaccard(a, b)) < 0.06
    assert (s.codes("") == 0).all()


@pytest.mark.parametrize("n", [15_000, 60_000])
def test_sampling_of_long_texts(n):
    """Terms are words, not classes of words: disjoint texts are unlike, whatever their length; half of one is half like it."""
    s = fingerprints.Sampler.get(512)
    a, b = (" ".join(f"{c}{k}" for k in range(n)) for c in "ab")
    half = " ".join(f"a{k}" for k in range(n // 2))
    assert fingerprints.likeness(s.codes(a), s.codes(b)) < 0.02
    assert abs(fingerprints.likeness(s.codes(a), s.codes(half)) - weighted_jaccard(a, half)) < 0.09
    assert abs(fingerprints.likeness(s.codes(a), s.codes(a + " " + half)) - weighted_jaccard(a, a + " " + half)) < 0.09


def test_a_full_sampler_draws_the_same_again():
    s = fingerprints.Sampler(fingerprints.KEPT_CELLS // 256)  # room for 256 pairs
    texts = [prose(k, 150) for k in range(12)]
    assert all((a == b).all() for a, b in zip([s.codes(t) for t in texts], [s.codes(t) for t in texts]))


def test_successors_of_hot_ids(spark):
    """A third of the rows without an id and a third with one id: each row once, in the order, over several ranges."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k // 9}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = fingerprints.successors(df).collect()
    own = [(r["span"], r["doc_id"], r["k2"], r["k3"], r["text"]) for r in got if not r["ahead"]]
    assert key((i, t) for _, i, _, _, t in own) == key(rows)
    whole = sorted(own, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[3]))
    assert [r[0] for r in whole] == sorted(r[0] for r in own) and len({r[0] for r in own}) == 4
    heads = {r["span"]: (r["doc_id"], r["k2"], r["k3"], r["text"]) for r in got if r["ahead"]}
    last = max(heads)
    for span, head in heads.items():
        assert head == next(r[1:] for r in whole if r[0] == (0 if span == last else span + 1))
    assert max(sum(r[0] == s for r in own) for s in heads) < 400


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = np.concatenate([base, base[:10].repeat(8, axis=0) + rng.normal(size=(80, 16)) * 0.08, base[:3] * 2, base[10:14].repeat(5, axis=0) + rng.normal(size=(20, 16)) * 0.24])
    rows = [(int(k), [float(v) for v in x]) for k, x in enumerate(near)]
    rows += [(500, None), (501, [0.0] * 16), (502, [1.0, None]), (503, [float("nan")] * 16), (504, []), (505, [1.0, 2.0]), (None, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame([(i, x, 3, 1) for i, x in rows], "vec_id bigint, embedding array<double>, ball int, home int").repartition(3)
    units = [G.unit(x) for _, x in rows]
    link = np.zeros((len(rows), len(rows)), bool)
    for a in range(len(rows)):
        for b in range(len(rows)):
            link[a, b] = a != b and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95
    label = linked_labels(link)
    low = {l: min((rows[k][0] for k in np.flatnonzero(label == l) if rows[k][0] is not None), default=None) for l in set(label.tolist())}
    want = key((i, int(link[k].sum()), low[label[k]], i is not None and i == low[label[k]]) for k, (i, _) in enumerate(rows))
    got = key((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in G.near_duplicates(df).collect())
    assert got == want
    assert G.near_duplicates(df.where("false")).count() == 0


def clustered(seed, n, dims=24):
    """A third in one group of near and exact copies, groups around the threshold, and others alone."""
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=dims)
    x = [hot + rng.normal(size=dims) * 0.05 * rng.integers(0, 3) for _ in range(n // 3)]
    while len(x) < n:
        centre = rng.normal(size=dims)
        x += [centre + rng.normal(size=dims) * rng.choice([0.0, 0.1, 0.22]) for _ in range(rng.integers(1, 9))]
    return np.asarray(x[:n])[rng.permutation(n)]


def test_embeddings_are_audited_whatever_their_ids(spark):
    """No id is divisible by 100, or none of those that are has a link."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.22 for _ in range(8)])
    for first in (1, 100):
        rows = [(first + 2 * k if first == 1 else k * 7 + 1, v.tolist()) for k, v in enumerate(x)] + ([(100, rng.normal(size=16).tolist())] if first == 100 else [])
        out, reached = G.audited_near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3), ball_degrees=1.0)
        unit = np.stack([v for _, v in rows])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        links = ((unit @ unit.T >= 0.95).sum(axis=1) - 1).tolist()
        assert reached is not None and reached >= 0.97 and sum(links) > 0
        got = {r["vec_id"]: r["n_links"] for r in out.collect()}
        assert sum(got.values()) >= 0.95 * sum(links) and all(got[i] <= n for (i, _), n in zip(rows, links))


@pytest.mark.parametrize(("recall", "exact"), [(0.9, False), (2.0, True)])
def test_embeddings_of_many_shards(spark, monkeypatch, recall, exact):
    """Overlapping shards, homes cut into parts, blocks of members; an unreachable recall ends in the comparison of all leaders."""
    for name, value in (("SHARD", 100), ("CHUNK", 120), ("SAMPLE", 600), ("COMPARED", 16), ("QUERIES", 50)):
        monkeypatch.setattr(G, name, value)
    x = clustered(3, 1500)
    unit = np.stack([G.unit(v) for v in x])
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(5)
    out, reached = G.audited_near_duplicates(df, recall=recall, audit_every=3)
    got = {r["vec_id"]: r for r in out.collect()}
    truth, found = link.sum(axis=1), np.asarray([got[k]["n_links"] for k in range(len(x))])
    assert (found <= truth).all() and reached >= 0.9
    some = truth > 0
    assert (found[some] / truth[some]).mean() >= 0.97
    if exact:
        label = linked_labels(link)
        assert (found == truth).all() and [got[k]["component_id"] for k in range(len(x))] == label.tolist()


def test_graph_search_finds_the_range():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 12)), np.ones((40, 12)) + rng.normal(size=(40, 12)) * 0.1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = G.robust_pruned(x)
    medoid = int((x @ x.mean(axis=0)).argmax())
    found = total = 0
    for k in range(0, 340, 3):
        want = set(np.flatnonzero(x @ x[k] >= 0.9).tolist())
        found += len(want & set(G.range_search(x, graph, list({medoid, k}), x[k], 0.9)))
        total += len(want)
    assert found >= 0.97 * total


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op10_embedding_near_dedup"])
def test_against_sql(spark, name):
    import os

    from wordloom.llm.queries import ORACLES, QUERIES

    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert key(map(tuple, df.collect())) == key(want)
