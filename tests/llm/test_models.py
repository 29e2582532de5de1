import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodepool.llm import lexicon, mil

# multiple-instance learning


def bags(rng, n):
    good, texts = [], []
    for _ in range(n):
        g = rng.random() < 0.6
        clean = lambda k: " ".join(rng.choice(["river", "stone", "cloud", "light", "garden", "window"]) for _ in range(k)) + "."
        junk = lambda k: " ".join(rng.choice(["$$$", "BUY", "###", "!!!", "%%%", "&&&"]) for _ in range(k))
        texts.append(clean(rng.randint(60, 300)) if g else clean(80) + " " + junk(rng.randint(100, 200)))
        good.append(float(g))
    return texts, np.array(good, np.float32)


def features(texts):
    data = [t.encode() for t in texts]
    return mil.passages(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))


def test_held_out_accuracy():
    rng = random.Random(1)
    texts, good = bags(rng, 300)
    model = mil.fit(*features(texts), good)
    more, truth = bags(rng, 200)
    logit, kept = model.forward(*features(more))
    assert ((logit > 0) == (truth > 0)).mean() > 0.97
    starts, sizes = kept["starts"], kept["sizes"]
    assert np.allclose(np.add.reduceat(kept["a"], starts), 1, atol=1e-5) and sizes.max() > 1


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    model = mil.Model(7, 1)
    for k in model.p:
        model.p[k] = model.p[k].astype(float)
    x, begin, good = rng.standard_normal((9, 7)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.forward(x, begin)[0]
        return float(np.sum(np.logaddexp(0, z) - good * z))

    logit, kept = model.forward(x, begin)
    grads = model.gradients(kept, 1 / (1 + np.exp(-logit)) - good)
    for k, g in grads.items():
        for at in [tuple(rng.integers(0, s) for s in model.p[k].shape) for _ in range(4)]:
            model.p[k][at] += 1e-5
            up = loss()
            model.p[k][at] -= 2e-5
            down = loss()
            model.p[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_features_do_not_depend_on_the_batch():
    texts = ["", "a", "ab", "long text " * 200, "é" * 700, "x" * 512, "y" * 513]
    together, begin = features(texts)
    for i, t in enumerate(texts):
        alone, _ = features([t])
        assert np.allclose(alone, together[begin[i] : begin[i + 1]]) and len(alone) == max(1, -(-len(t.encode()) // mil.PASSAGE))


def test_documents(spark):
    rng = random.Random(2)
    texts, good = bags(rng, 120)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(900, None, "k"), (901, "", "k"), (None, "river stone.", "k"), (902, "river stone cloud. " * 20_000, "k")], "doc_id bigint, text string, keep string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)] + [(None, 1, 0), (5, None, 0), (12345, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = mil.train(docs, labels)
    rows = mil.with_quality(docs, model).collect()
    assert len(rows) == 124 and all(r.keep is not None and r.quality_score == r.quality_score for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[900].quality_score == by[901].quality_score and by[902].keep
    assert np.mean([by[i].keep for i in range(120) if good[i]]) > 0.98 and np.mean([by[i].keep for i in range(120) if not good[i]]) < 0.2
    none = mil.train(docs, labels.limit(0))
    assert all(r.keep for r in mil.with_quality(docs, none).collect()) and mil.with_quality(docs.limit(0), none).count() == 0
    one_kind = mil.train(docs, labels.filter("quality = 1"))
    assert all(r.keep for r in mil.with_quality(docs, one_kind).collect())


# toxicity lexicon

TOXIC = [a + b for a in ("vexnar", "drombal", "skirvok") for b in ("", "ish", "er", "ing")]


def corpus(rng, n=600):
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = [rng.choice(words) for _ in range(60)] + [w for w in ("mid1", "mid2", "mid3") if rng.random() < 0.08]
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(TOXIC))
        docs.append((i, " ".join(text).capitalize()))
        if i % 2 == 0 and i % 5:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_lexicon(spark):
    docs, labels = corpus(random.Random(4))
    d = spark.createDataFrame([(*r, "x") for r in docs] + [(None, "vexnar drombal skirvok vexnaring", "x"), (9000, None, "x"), (9001, "", "x"), (9002, "quiet " * 50_000, "x"), (3, docs[3][1], "x")], "doc_id bigint, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    rows = lexicon.score_documents(d, lab).collect()
    assert len(rows) == len(docs) + 5
    verdict = {r.doc_id: r.toxic for r in rows}
    truth = {i: i % 6 == 0 for i in range(len(docs))}
    assert np.mean([verdict[i] for i in truth if truth[i]]) > 0.95 and not any(verdict[i] for i in truth if not truth[i])
    assert verdict[None] and not verdict[9000] and not verdict[9001] and not verdict[9002]
    induced = lexicon.induce(d, lexicon.marked_labels(lab))
    assert all(induced.of(w) > 0.3 for w in TOXIC) and induced.of("word7") == 0
    bare = lexicon.score_documents(d, lab.limit(0)).collect()
    assert not any(r.toxic for r in bare) and {r.score for r in bare} == {0.0}
    assert lexicon.score_documents(d.limit(0), lab).count() == 0


def test_scores_by_brute_force(spark):
    """Score and verdict of every row, from the induced weights and the held-out labels."""
    docs, labels = corpus(random.Random(8))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: (r.score, r.toxic) for r in lexicon.score_documents(d, lab).collect()}
    held = {r[0] for r in spark.range(len(docs)).selectExpr("id").filter(f"pmod(xxhash64(CAST(id AS STRING)), {lexicon.HELD_OUT}) = 0").collect()}
    known = lexicon.induce(d, lexicon.marked_labels(lab.filter(~lab.doc_id.isin(*held))))
    want = {i: round(sum(known.of(w) for w in set(t.lower().split())), 6) for i, t in docs}
    assert all(abs(want[i] - rows[i][0]) < 2e-6 for i in want)
    clean = sorted(want[i] for i, _, t in labels if i in held and not t)
    cut = min(c for c in [lexicon.LEAST_SCORE, *(max(lexicon.LEAST_SCORE, x + 1e-6) for x in clean)] if sum(x >= c for x in clean) <= lexicon.MAX_FALSE * len(clean))
    assert all(rows[i][1] == (rows[i][0] >= cut) for i in want)


def neighbourhood(rng, n=2000):
    """Two labelled words and four that no label names, which stand only beside them."""
    docs, labels = [], []
    for i in range(n):
        text = [f"word{rng.randrange(400)}" for _ in range(60)]
        if i % 10 == 0:
            text[5:5] = ["seedone", "seedtwo"]
            if i % 40 == 0:
                text[9:9] = [f"hidden{k}" for k in range(4)]
            else:
                labels.append((i, 1, 1))
        elif i % 3 == 0:
            labels.append((i, 1, 0))
        docs.append((i, " ".join(text)))
    return docs, labels


def test_walk_reaches_words_without_labels(spark):
    docs, labels = neighbourhood(random.Random(9))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    known = lexicon.induce(d, lexicon.marked_labels(lab))
    assert all(known.of(f"hidden{k}") > 0.3 for k in range(4)) and known.of("seedone") > 0.3
    assert not any(known.of(f"word{k}") > 0.1 for k in range(400))
    # one in seven of the documents with a seed is labelled clean: the lexicon still stands
    mixed = [(i, q, int(t and i % 7 != 0)) for i, q, t in labels]
    known = lexicon.induce(d, lexicon.marked_labels(spark.createDataFrame(mixed, "doc_id bigint, quality int, toxic int")))
    assert known.of("seedone") > 0.3 and known.of("hidden2") > 0.3


def test_copies_are_one_witness(spark):
    docs, labels = neighbourhood(random.Random(10))
    text = next(t for i, t in docs if i == 10) + " onlyhere andhere"
    d = spark.createDataFrame([*docs, *((5000 + i, text) for i in range(200))], "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, *((5000 + i, 1, 1) for i in range(200))], "doc_id bigint, quality int, toxic int")
    known = lexicon.induce(d, lexicon.marked_labels(lab))
    assert known.of("onlyhere") == known.of("andhere") == 0 and known.of("seedone") > 0.3


def test_words_among_signs_of_other_scripts():
    text = "\u00abun\u00bb idiot\u2026 a\u00a0b \u00c9t\u00e9\u3002x \u2014y"
    data = text.lower().encode()
    got = lexicon.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
    assert got == [lexicon.word_hash(w) for w in ("un", "idiot", "a", "b", "\u00e9t\u00e9", "x", "y")]


def test_counts_against_plain_ones(spark):
    docs, labels = corpus(random.Random(5), 60)
    docs[7] = (7, docs[7][1] + " " + " ".join(f"far{k % 90} word{k % 13}" for k in range(400)))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.word: (r.n, r.toxic, r.clean) for r in lexicon.term_counts(d, lexicon.marked_labels(lab)).collect()}
    tox = {i: t for i, _, t in labels}
    segments = [(i, set(t.lower().split()[k : k + lexicon.SEGMENT])) for i, t in docs for k in range(0, len(t.split()), lexicon.SEGMENT)]
    assert got[lexicon.ALL] == (len(segments), sum(tox.values()), len(tox) - sum(tox.values()))
    for w in ["word7", "far3", "none", *TOXIC]:
        has = {i for i, s in segments if w in s}
        want = (sum(w in s for _, s in segments), sum(tox.get(i) == 1 for i in has), sum(tox.get(i) == 0 for i in has))
        assert got.get(lexicon.word_hash(w), (0, 0, 0)) == want
    near = {r.word: (r.near, r.docs) for r in lexicon.near_counts(lexicon._lowered(d), np.array([lexicon.word_hash(w) for w in TOXIC])).collect()}
    beside = [(i, s) for i, s in segments if s & set(TOXIC)]
    assert near[lexicon.ALL][0] == len(beside)
    for w in ("word7", "word8", TOXIC[0]):
        assert near.get(lexicon.word_hash(w), (0, 0)) == (sum(w in s for _, s in beside), len({i for i, s in beside if w in s}))
    words = [*TOXIC, "word1", "word2", "far3", "far4"]
    for neutral in (np.zeros(len(words), bool), np.arange(len(words)) >= len(TOXIC)):
        got = {(r.i, r.j): r.n for r in lexicon.pair_counts(d, np.array([lexicon.word_hash(w) for w in words]), neutral).collect()}
        want = {(i, j): sum(words[i] in s and words[j] in s for _, s in segments) for i in range(len(words)) for j in range(i + 1, len(words))}
        assert got == {k: n for k, n in want.items() if n}


def test_sums_stay_small():
    """two million rows of near_counts' 27 columns were held, and copied twice to add them up."""
    names = ["word", "near", "docs", *lexicon._signs, *lexicon._leasts]
    rng, sums, made = np.random.default_rng(3), lexicon.Sums(names, 1), []
    given = [(rng.integers(0, 300_000, 20_000), rng.integers(-9, 9, 20_000)) for _ in range(30)]
    taken = 0
    tracemalloc.start()
    for word, x in given:
        for b in sums.add(word, *[x] * 26):
            made.append((b.column(0).to_numpy().copy(), b.column(1).to_numpy().copy(), b.column(26).to_numpy().copy()))
        taken = max(taken, tracemalloc.get_traced_memory()[1])
    for b in sums.out():
        made.append((b.column(0).to_numpy().copy(), b.column(1).to_numpy().copy(), b.column(26).to_numpy().copy()))
    taken = max(taken, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert taken < 100e6 and len(made) > 1
    word, x = (np.concatenate(c) for c in zip(*given))
    got, total, least = (np.concatenate(c) for c in zip(*made))
    n = 300_000
    assert (np.bincount(got, total, n) == np.bincount(word, x, n)).all()
    a, b = np.full(n, 99), np.full(n, 99)
    np.minimum.at(a, got, least)
    np.minimum.at(b, word, x)
    assert (a == b).all()


def test_edges_and_walk_by_linear_algebra():
    rng = np.random.default_rng(6)
    v, total = 8, 400
    i, j = np.triu_indices(v, 1)
    n, size = rng.integers(0, 30, len(i)), rng.integers(40, 90, v)
    i, j, n = i[n > 0], j[n > 0], n[n > 0]
    a, b, w = lexicon.edges(i, j, n, size, total)
    m = np.zeros((v, v))
    m[i, j] = m[j, i] = n
    ppmi = np.maximum(np.log(np.where(m > 0, m * total / np.outer(size, size), 1)), 0) * m / (m + 1)
    kept = np.zeros((v, v))
    kept[a, b] = kept[b, a] = w
    assert np.allclose(kept, ppmi)
    a2, b2, _ = lexicon.edges(i, j, n, size, total, 2)
    strong = {(x, y) for x in range(v) for y in np.argsort(-ppmi[x], kind="stable")[:2] if ppmi[x, y] > 0}
    assert {*zip(a2.tolist(), b2.tolist())} == {(min(p), max(p)) for p in strong}
    pos, neg = np.arange(v) == 0, np.arange(v) >= 6
    out = ppmi.sum(1)
    step = np.where(out[:, None] > 0, ppmi / np.where(out > 0, out, 1)[:, None], np.eye(v))
    p, q = (np.linalg.solve(np.eye(v) - (1 - lexicon.RESTART) * step.T, lexicon.RESTART * s / s.sum()) for s in (pos.astype(float), neg.astype(float)))
    assert np.allclose(lexicon.walk(a, b, w, pos, neg), np.where(p + q > 1e-12, (p - q) / np.maximum(p + q, 1e-12), 0), atol=1e-3)
    assert not lexicon.walk(a, b, w, np.zeros(v, bool), neg).any()


def test_columns_of_any_name_and_ids_of_any_kind(spark):
    docs, labels = corpus(random.Random(11), 300)
    d = spark.createDataFrame([(f"u-{i}", t) for i, t in docs], "doc_id string, text string").selectExpr("*", "named_struct('a b', 1, 'c`d', named_struct('e.f', text)) AS `x.y`", "1 AS word", "2 AS label")
    lab = spark.createDataFrame([(f"u-{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    rows = lexicon.score_documents(d, lab)
    assert rows.columns == [*d.columns, "score", "toxic"] and rows.count() == 300
    assert {r.doc_id for r in rows.filter("toxic").collect()} <= {f"u-{i}" for i in range(0, 300, 6)}
    scored = mil.with_quality(d, mil.train(d, lab))
    assert scored.columns == [*d.columns, "quality_score", "keep"] and scored.count() == 300


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_columns_of_other_kinds(spark, name):
    df = spark.createDataFrame([("1", "a b", 1)], "doc_id string, text string, toxic int").withColumn("extra", F.lit(None).cast("array<struct<a:int>>"))
    assert name in mil.with_quality(df, mil.Model()).columns and mil.with_quality(df, mil.Model()).count() == 1
