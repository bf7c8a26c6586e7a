"""Operators 4, 6 and 9, and the pipeline."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS, key, prose
from tests.llm.test_similarity import brute_classes, brute_lines
from wordloom.llm import language_id, ngram_lm, sharding


def brute_base(rows):
    own = [(i, (t or "").encode().lower().split() + [b"\n"], ngram_lm.remainder(i, 7) == 2) for i, t in rows]
    c = collections.Counter(w for _, ws, held in own if not held for w in ws)
    size = sum(c.values()) + len(c) + 1
    return key((i, held, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / size) for w in ws), 6)) for i, ws, held in own)


def brute_scores(rows, prior2=1600.0, prior3=5.0):
    """The model of exact counts, rounded down to the levels' bounds, word by word."""
    own = [(i, (t or "").encode().lower().split() + [b"\n"], ngram_lm.remainder(i, 7) != 2) for i, t in rows]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for _, ws, trained in own:
        if trained:
            one.update(ws)
            two.update(zip([b"\n", *ws], ws))
            three.update(zip([b"\n", *ws], ws, ws[1:]))
    size = sum(one.values()) + len(one) + 1
    bounds = ngram_lm.level_bounds(1.5).tolist()
    down = lambda c: max([x for x in bounds if x <= c], default=0)
    up = lambda c: min(x for x in bounds if x > c) - 1
    out = []
    for i, ws, _ in own:
        total = 0.0
        for k, w in enumerate(ws):
            v = ws[k - 1] if k else b"\n"
            p = (down(two[v, w]) + prior2 * (one[w] + 1) / size) / (one[v] + prior2)
            if k:
                u = ws[k - 2] if k > 1 else b"\n"
                q = min(up(two[u, v]), one[u], one[v])
                p = (min(down(three[u, v, w]), q) + prior3 * p) / (q + prior3)
            total += math.log10(p)
        out.append((i, round(total, 4)))
    return key(out)


@pytest.mark.parametrize("block_bytes,broadcast_bytes", [(24 << 20, 1 << 30), (4000, 1 << 30), (24 << 20, -1), (4000, -1)])
def test_lm(docs, block_bytes, broadcast_bytes):
    got = ngram_lm.lm_scores(docs, bits_per_entry=200, block_bytes=block_bytes, broadcast_bytes=broadcast_bytes).collect()  # next to no false positives
    assert key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == brute_base(ROWS)
    assert key((r["doc_id"], round(r["score"], 4)) for r in got) == brute_scores(ROWS)


def test_lm_scores_are_the_same_however_the_filter_is_probed(spark):
    """Broadcast, by the segments' reducers, and where a filter turns out to be larger than was allowed; with false positives."""
    rows = [(k, prose(k % 9, 200)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [key(map(tuple, ngram_lm.lm_scores(df, bits_per_entry=4, hashes=2, broadcast_bytes=n).collect())) for n in (1 << 30, -1, 500)]
    assert got[0] == got[1] == got[2]


def test_lm_learns(spark, empty):
    rows = [(k, prose(k % 7, 80)) for k in range(60)]
    got = ngram_lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert ngram_lm.lm_scores(empty).count() == 0


def test_lm_knows_ngrams_seen_once(spark):
    """A held-out copy of a training document whose n-grams occur nowhere else scores far above the same words in another order."""
    trained = [i for i in range(200) if ngram_lm.remainder(i, 7) != 2]
    held = [i for i in range(200) if ngram_lm.remainder(i, 7) == 2]
    rows = [(i, " ".join(f"w{(37 * i + k * (i + 1)) % 1009}" for k in range(60))) for i in trained]
    copied = rows[5][1]
    rows += [(held[0], copied), (held[1], " ".join(copied.split()[::-1]))]
    got = {r["doc_id"]: r for r in ngram_lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    one, other = got[held[0]], got[held[1]]
    assert one["held_out"] and other["held_out"] and abs(one["base_score"] - other["base_score"]) < 1e-6
    assert one["score"] > other["score"] + 30


def test_probabilities_sum_to_one_at_most():
    """Over all words, whatever the counts: what is found is rounded down, what it is divided by up."""
    rng = np.random.default_rng(1)
    bounds = ngram_lm.level_bounds(1.5)
    least, most = np.concatenate([[0], bounds]), np.concatenate([[0], bounds[1:] - 1])
    c = rng.integers(1, 50, 40)
    size = c.sum() + len(c) + 1
    for _ in range(20):
        two = np.minimum(rng.geometric(0.3, 40) - 1, c)
        three = np.asarray([rng.integers(0, x + 1) for x in two])
        cv, cuv = max(two.sum(), 1), three.sum()
        level = lambda x: np.searchsorted(bounds, x, "right")
        p = ngram_lm.token_scores(c, np.full(40, cv), least[level(two)], least[level(three)], np.full(40, most[level(cuv)]), size, 40.0, 3.0)
        assert (10**p).sum() <= 1 + 1e-9


def test_filter_counts_round_down():
    bounds = ngram_lm.level_bounds(1.5)
    f = ngram_lm.LogFrequencyFilter(bounds, 8, 12.0)
    h, c = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1, 3001)
    f.fill(h, c)
    got = np.concatenate([[0], bounds])[f.levels(h)]
    assert (got <= c * 1.6).all() and np.mean(got <= c) > 0.98 and (got * 1.5 + 1 >= c).all()
    assert np.mean(f.levels(h + np.uint64(1)) > 0) < 0.02


LANGS = {"en": "the and of to in that is was house with for", "fr": "le la les des est dans que une avec pour maison", "de": "der die das und ist nicht mit ein haus für auf"}


def test_language_id(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(LANGS[lang].split(), 12)), lang) for k, lang in enumerate(list(LANGS) * 40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !?", "fr"), (None, rows[0][1], None), (503, rows[1][1], None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, score double")
    model = language_id.train(df)
    got = language_id.identify(df, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and language_id.remainder(r["doc_id"], 5) == 0]
    assert len(held) > 10 and np.mean([r["lang_pred"] == list(LANGS)[r["doc_id"] % 3] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (500, 501, 502)} == {"und"} and by[503]["lang_pred"] == "fr" and by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    kept = language_id.identify(df, model, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and kept.count() == len(rows)
    none = language_id.train(df.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.where("false"), model).count() == 0


def kernel_grams(text):
    """The n-grams of a text as strings."""
    out, before = [], False
    for c in text.lower():
        if c.isalpha() or before:
            out.append(c if c.isalpha() else " ")
        before = c.isalpha()
    line = " " + "".join(out) + " "
    return {line[i : i + n] for n in range(1, 5) for i in range(len(line) - n + 1)}


def test_language_grams_are_those_of_the_strings():
    for text in ("Straße, und Übung!", "a", "l'été  est là", "x1y2 z"):
        assert len(language_id.ngrams(text, np.zeros(language_id.BUCKETS, bool))) == len(kernel_grams(text))


@pytest.mark.parametrize("landmarks", [6, 40])
def test_language_id_is_kernel_ridge_regression(landmarks):
    """Against kernels of strings, a Nystroem map and ridge regressions written out, without hashing or weight tables."""
    rng = np.random.default_rng(5)
    text = lambda lang: " ".join(rng.choice(LANGS[lang].split(), rng.integers(2, 9)))
    names = sorted(LANGS)
    texts, labels = zip(*[(text(lang), lang) for _ in range(14) for lang in LANGS])
    tests = [text(lang) for lang in LANGS for _ in range(8)]
    model = language_id.fit(list(texts), list(labels), landmarks, 0.05)
    k = lambda a, b: np.asarray([[len(x & y) / math.sqrt(len(x) * len(y)) for y in b] for x in a])
    own = [kernel_grams(t) for t in texts]
    order = sorted(range(len(own)), key=lambda i: (labels[:i].count(labels[i]), names.index(labels[i])))[:landmarks]
    marks = [own[i] for i in order]
    values, vectors = np.linalg.eigh(k(marks, marks))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features = lambda rows: np.hstack([k(rows, marks) @ root, np.full((len(rows), 1), 0.1)])
    phi, weight = features(own), np.asarray([len(labels) / len(names) / labels.count(x) for x in labels])
    y = np.asarray([[1.0 if x == name else -1.0 for name in names] for x in labels])
    w = np.linalg.inv(phi.T @ np.diag(weight) @ phi + 0.05 * np.eye(phi.shape[1])) @ phi.T @ np.diag(weight) @ y
    f = (features([kernel_grams(t) for t in tests]) - [*[0.0] * root.shape[1], 0.1]) @ w  # texts are scored without the constant
    p = np.exp(4 * f) / np.exp(4 * f).sum(axis=1, keepdims=True)
    for (label, score), own_p in zip(model.decide(tests), p):
        # Few n-grams share a bucket, and kernels are in single precision.
        assert abs(score - own_p.max()) < 0.02 and (label == names[int(own_p.argmax())] or np.sort(own_p)[-1] - np.sort(own_p)[-2] < 0.04)


def test_language_sample_has_bounds(spark):
    known = next(k for k in range(9) if language_id.remainder(k, 5) != 0)
    rows = [(known, "the house of the garden", "en")] * 300 + [(k, f"le jardin de la maison {k}", "fr") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df, per_language=10)
    assert model.labels == ["en", "fr"]
    with pytest.raises(ValueError):
        language_id.train(df, most_languages=1)


def test_language_kernel_is_the_collapsed_product():
    texts = [f"{a} {b}" for a in LANGS.values() for b in ("x", "yy")]
    m = language_id.fit(texts, [k for k in LANGS for _ in range(2)], 4, 0.01)
    one = [m.decide([t])[0] for t in texts]
    assert [x for x, _ in one] == [x for x, _ in m.decide(texts)] and m.labels == ["de", "en", "fr"]


def brute_tiering(sizes, target, fan_out):
    """Tiers after each arrival of these sizes in bytes, one shard each: fan_out shards of a tier below the target become one."""
    tier = lambda n: max(0, math.ceil(math.log(target / n, fan_out) - 1e-9))
    live = []
    for k, n in enumerate(sizes):
        live.append(n)
        while (k + 1) % fan_out == 0 or k + 1 == len(sizes):
            full = [t for t in {tier(x) for x in live} if t > 0 and sum(tier(x) == t and x <= target // 2 for x in live) >= fan_out]
            if not full:
                break
            for t in full:
                merged = [x for x in live if tier(x) == t and x <= target // 2]
                live = [x for x in live if x not in merged] + [sum(merged)]
    return live


def test_sharding(spark, docs, empty, tmp_path):
    out = sharding.sharded(docs, f"file://{tmp_path}/s")
    rows = out.collect()
    assert key((r["doc_id"], r["text"]) for r in rows) == key(ROWS) and out.columns == [*docs.columns, *sharding._ADDED]
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", sharding.TARGET_BYTES, sharding.FAN_OUT)
    last = store.version()
    assert {r["store_version"] for r in rows} == {last} and max(r["shard_arrivals"] for r in rows) >= 4
    assert sum(s["rows"] for s in store.manifest()) == len(ROWS) and store.read(1).count() < len(ROWS)
    assert len(store.manifest()) < max(len(store.manifest(v)) for v in range(1, last))  # fewer shards after merges
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(), last - 1)
    assert store.version() == last
    store.vacuum()
    assert store.read().count() == len(ROWS)
    assert sharding.sharded(empty, f"file://{tmp_path}/e").count() == 0


def test_sharding_merges_over_two_tiers(spark, tmp_path):
    """As brute force over the arrivals' sizes says, with the query's parameters; keys of any type, and columns of clashing names."""
    body = [(f"key{k}", "".join(random.Random(k).choices("abcdefghijklmnop", k=6000)), 1, "x") for k in range(400)] + [(None, "t", 2, "y")] * 2
    df = spark.createDataFrame(body, "doc_id string, text string, arrival int, shard string").coalesce(1)
    rows = sharding.sharded(df, f"file://{tmp_path}/t").collect()
    assert key((r["doc_id"], r["text"]) for r in rows) == key(r[:2] for r in body)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", sharding.TARGET_BYTES, sharding.FAN_OUT)
    seen, arrivals = [store.manifest(v) for v in range(store.version() + 1)], []
    for before, now in zip(seen, seen[1:]):
        if len(now) > len(before):  # an arrival; a merge leaves fewer
            arrivals += [s["bytes"] for s in now if s["path"] not in {x["path"] for x in before}]
    want = brute_tiering(arrivals, sharding.TARGET_BYTES, sharding.FAN_OUT)
    assert len(arrivals) == sharding.ARRIVALS and len(want) == len(store.manifest()) < 8
    assert max(r["shard_arrivals"] for r in rows) == 16 and {s["tier"] for s in store.manifest()} == {r["shard_tier"] for r in rows}
    one = next(s for s in store.manifest() if s["rows"] == max(x["rows"] for x in store.manifest()))
    assert abs(one["bytes"] / max(want) - 1) < 0.2


def test_tiers(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/t", 1000, 4)
    assert [store.tier(n) for n in (2000, 1000, 999, 250, 249, 10)] == [0, 0, 1, 1, 2, 4]
    shards = [{"path": str(k), "bytes": b, "tier": store.tier(b)} for k, b in enumerate([300, 260, 255, 251, 900, 30, 30, 1000])]
    assert [[s["path"] for s in run] for run in store.merge_plan(shards)] == [["0", "1", "2", "3"]]


def test_pipeline_keeps_one_row_of_each_class(spark):
    """Whatever the ids: repeated, null, or shared by rows of different classes."""
    import corpus_pipeline as P

    same, other = prose(1, 60), prose(2, 60)
    rows = [(1, same), (1, same), (5, same), (None, same), (None, same), (9, same), (5, other), (None, other), (3, None), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = P.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert key((r["doc_id"], r["text"]) for r in got.collect()) == key([(1, same), (5, other), (3, None), (None, ""), (None, "")])


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline as P

    names = ["lang_pred", "score", "__row", "__class", "_found", "row", "row_", "class", "n_chunks", "id"]
    rows = [(k, prose(k % 5, 60), "en", "s", 1, *(f"{x}{k}" for x in names)) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{x} string" for x in names))
    for stage in (P.identify_language, P.drop_near_duplicates):
        got = stage(spark, df, "")
        kept = [tuple(r) for r in got.collect()]
        assert got.columns == df.columns and kept and set(kept) <= set(rows)


def test_pipeline_rejects_other_languages(spark):
    """Texts of the languages learned stay, short ones too; texts in other scripts go, and most in another language of the same script."""
    import corpus_pipeline as P

    rng = random.Random(3)
    more = {"es": "el tiempo de la casa es una cosa que no pasa para los hombres del mundo con sus palabras y las noches de una ciudad"}
    known = {k: v.split() for k, v in {**LANGS, **more}.items()}
    other = {
        "fi": "aamu aika alku asia auto ehto elämä hetki huone hyvä ihminen joki kala kaupunki kesä kirja koira koti kuva lapsi lumi mäki matka metsä nyt päivä sanoa silmä tyttö työ yö", "ru": "время год человек дело жизнь день рука раз работа слово место лицо друг глаз вопрос дом сторона",
        "el": "χρόνος άνθρωπος ζωή μέρα χέρι δουλειά λόγος τόπος πρόσωπο φίλος μάτι ερώτηση σπίτι",
    }
    rows = [(i, " ".join(rng.choices(known[k], k=rng.choice([4, 12, 40]))), k) for i, k in enumerate([*known] * 60)]
    strange = [(1000 + i, " ".join(rng.choices(other[k].split(), k=30)), None) for i, k in enumerate([*other] * 5)]
    df = spark.createDataFrame(rows + strange, "doc_id bigint, text string, lang string").repartition(3)
    got = {r["doc_id"] for r in P.identify_language(spark, df, "").collect()}
    assert {i for i, _, _ in rows} <= got
    left = [strange[i - 1000][1] for i in got if i >= 1000]
    assert all(max(t) < "\u0250" for t in left) and len(left) <= 2


def test_pipeline_without_labels_keeps_texts(spark):
    import corpus_pipeline as P

    df = spark.createDataFrame([(1, "some words here", None, "s", 1), (2, "12 !", None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in P.identify_language(spark, df, "").collect()] == [1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    passage = ". ".join(prose(k, 9) for k in range(800, 810)) + ". "
    rows = [(k, prose(900 + k, 60), "en", "s", 0) for k in range(12)] + [(20, prose(900, 60) + " tail", "en", "s", 0), (21, "123 !", "en", "s", 0), (22, None, "en", "s", 0), (23, f"{prose(990, 40)}. {passage}", "en", "s", 0), (24, f"{prose(991, 40)}. {passage}", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    letters = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    lines = [(i, t) for i, _, gone, t in brute_lines(letters) if not gone or t]
    want = {i for (i, _, c) in brute_classes(lines) if i == c}
    assert {r["doc_id"] for r in got} == want and {*range(12), 23, 24} <= want and not want & {21, 22}
    assert [len(P.STAGES), P.ORACLE_SQL] == [4, None]
    stage = P.identify_language(spark, df, "")
    assert stage.columns == df.columns and stage.where(F.col("text").isNull()).count() == 0
