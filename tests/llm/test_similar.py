import hashlib
import math
import random

import numpy as np
import pyarrow as pa

from nodepool.llm import common as C
from nodepool.llm import buckets, digest, graph, oddsketch, packing

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "pi", "so", "vu") for c in ("x", "rd", "lm", "nt", "q")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def changed(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def flat(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def shingle_set(text):
    w = text.lower().split()
    return set(w) | set(zip(w, w[1:]))


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def family(seed=1, groups=12, alone=20):
    rng, docs = random.Random(seed), []
    for _ in range(groups):
        base = text_of(rng, rng.randint(40, 200))
        docs += [base] + [changed(rng, base, rng.randint(0, 2)) for _ in range(rng.randint(1, 4))]
    return docs + [text_of(rng, rng.randint(5, 200)) for _ in range(alone)]


def groups_of(pairs):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500, b) for b in range(501, 560)] + [(a, a + 1) for a in range(700, 740)]
    df = spark.createDataFrame([*pairs, (None, 1), (1, None), (5, 5)], "a bigint, b bigint")
    got = graph.components(df)
    assert {r.b: r.a for r in got.collect()} == groups_of(p for p in pairs if p[0] != p[1])
    assert graph.components(df.limit(0)).count() == 0


def test_groups_of_buckets_against_brute_force(spark):
    """Any links between documents that share a bucket, chains and stars among them."""
    rng = random.Random(21)
    for blocks in (buckets.BLOCK, 3):
        held, buckets.BLOCK = buckets.BLOCK, blocks
        rows = [(1, 900), (2, 900), (3, 900)] + [(d, rng.randrange(12)) for d in range(10, 90) for _ in range(2)] + [(d, 500) for d in range(10, 60)]
        links = {(2, 3)} | {tuple(sorted(rng.sample(range(10, 90), 2))) for _ in range(60)}
        kept = spark.createDataFrame(sorted(links), "a bigint, b bigint")
        shared = {(a, b) for a, x in rows for b, y in rows if a < b and x == y}
        got = buckets.groups(spark.createDataFrame(rows, "doc_id bigint, band bigint").distinct(), lambda pairs: pairs.join(kept, ["a", "b"], "left_semi"))  # noqa: B023
        assert {r.b: r.a for r in got.collect()} == groups_of(links & shared)
        buckets.BLOCK = held


def test_a_bucket_of_strangers_and_a_crowd(spark):
    """Pairs compared: at most n for a crowd; the square where none is like another."""
    seen = []

    def check(pairs):
        seen.append(pairs.count())
        return pairs.filter("a < 5000 AND b < 5000")  # below 5000 all are alike

    crowd = spark.range(2000).selectExpr("id AS doc_id", "7 AS band").union(spark.createDataFrame([(5001, 7), (5002, 7)]))
    got = {r.b: r.a for r in buckets.groups(crowd, check).collect()}
    assert len(got) == 1999 and set(got.values()) == {0} and max(seen) <= 2 * 2002
    seen.clear()
    strangers = spark.range(6000, 6300).selectExpr("id AS doc_id", "7 AS band")
    assert buckets.groups(strangers, check).count() == 0 and sum(seen) == 300 * 299 // 2


def test_odd_sketch_estimates_high_similarities():
    rng, errors = random.Random(2), []
    for _ in range(40):
        a = text_of(rng, 150)
        b = changed(rng, a, rng.randint(0, 6))
        values, begin = oddsketch.shingles(*flat([a, b]))
        assert len(set(values[begin[0] : begin[1]].tolist())) == len(shingle_set(a))
        sketch = oddsketch.odd_sketch(oddsketch.minhash(values, begin))
        p = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
        errors.append(float(oddsketch.estimate(p)) - jaccard(a, b))
    assert np.abs(errors).mean() < 0.05 and oddsketch.estimate(0) == 1
    assert oddsketch.estimate(oddsketch.most_bits(0.6)) >= 0.6 > oddsketch.estimate(oddsketch.most_bits(0.6) + 1)


def test_duplicates_against_brute_force(spark):
    docs = family()
    rows = [(i, t, i) for i, t in enumerate(docs)] + [(1000, None, 0), (1001, "", 0), (1002, "?! --", 0), (1003, "?! --", 0), (None, docs[0], 0), (1, docs[1], 0), (2000, docs[0].upper(), 0), (3000, "word " * 100_000, 0), (3001, "word " * 90_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __gone bigint").withColumnRenamed("__gone", "band")
    got = {r.doc_id: r.duplicate_of for r in oddsketch.duplicates(df).collect()}
    sure = groups_of((i, j) for i in range(len(docs)) for j in range(i) if jaccard(docs[i], docs[j]) >= oddsketch.THRESHOLD + 0.1)
    at_most = groups_of((i, j) for i in range(len(docs)) for j in range(i) if jaccard(docs[i], docs[j]) >= oddsketch.THRESHOLD - 0.15)
    assert len(sure) > 15 and sum(i in got for i in sure) >= 0.97 * len(sure)  # what the samples show of the texts
    signed = {r.doc_id: (set(r.bands), np.array(r.sketch)) for r in oddsketch.sign(df).collect()}
    limit = oddsketch.most_bits(oddsketch.THRESHOLD)
    alike = lambda x, y: x[0] & y[0] and int(np.bitwise_count((x[1] ^ y[1]).view(np.uint64)).sum()) <= limit
    assert got == groups_of((i, j) for i in signed for j in signed if i < j and alike(signed[i], signed[j]))
    texts = oddsketch.duplicates(df.selectExpr("concat('u-', lpad(CAST(doc_id AS STRING), 5, '0')) AS doc_id", "text"))
    assert {int(r.doc_id[2:]): int(r.duplicate_of[2:]) for r in texts.collect()} == got
    assert all(at_most[i] <= got[i] for i in got if i < 1000) and got[2000] == 0 and got[3001] == 3000 and not {1000, 1001, 1002, 1003} & set(got)
    left = oddsketch.without_duplicates(df)
    kept = [r.doc_id for r in left.collect()]
    assert left.columns == df.columns and sorted(x for x in kept if x is not None) == sorted({r[0] for r in rows if r[0] is not None} - set(got)) and kept.count(None) == 1
    assert oddsketch.without_duplicates(df.limit(0)).count() == 0


def test_a_crowd_of_copies_costs_no_square(spark):
    base = text_of(random.Random(3), 100)
    df = spark.createDataFrame([(i, base if i % 2 else changed(random.Random(i), base, 1)) for i in range(1500)], "doc_id bigint, text string")
    got = {r.doc_id: r.duplicate_of for r in oddsketch.duplicates(df).collect()}
    assert len(got) == 1499 and set(got.values()) == {0}


# improbable features


def plain_levels(data):
    out = []
    for i in range(len(data) - digest.WINDOW + 1):
        w = data[i : i + digest.WINDOW]
        s = sum(int(digest._f[w.count(b)]) for b in set(w))
        out.append((digest._TOP - s) * digest.LEVELS // digest._TOP)
    return out


def plain_features(data, place):
    rank = [int(place[x]) for x in plain_levels(data)]
    points = [0] * len(rank)
    for i in range(len(rank)):
        span = [(r, k) for k, r in enumerate(rank[i : i + digest.WINDOW], i) if r <= digest.LEVELS]
        if span:
            points[min(span)[1]] += 1
    windows = [data[i : i + digest.WINDOW] for i, p in enumerate(points) if p >= digest.POINTS]
    return list(dict.fromkeys(windows))


def test_features_against_plain_ones():
    rng = random.Random(6)
    texts = [text_of(rng, n) for n in (1, 12, 90, 300)] + ["", "a" * 500, "ab" * 300, text_of(rng, 40) * 3, "é漢" * 100]
    f, at = flat(texts)
    levels = digest.levels(f)
    ok = digest.inside(at, len(levels))
    counts = np.bincount(levels[ok], minlength=digest.LEVELS + 1)
    want = np.zeros(digest.LEVELS + 1, np.int64)
    for t in texts:
        for x in plain_levels(t.encode()):
            want[x] += 1
    assert (counts == want).all()
    place = digest.ranks(counts)
    h, begin = digest.features(f, at, place)
    seen: dict = {}
    for i, t in enumerate(texts):
        plain = plain_features(t.encode(), place)
        own = h[begin[i] : begin[i + 1]].tolist()
        assert len(own) == len(plain)
        for a, b in zip(own, plain):
            assert seen.setdefault(a, b) == b
    assert len(seen) == len(set(seen.values())) > 20


def test_filters_chain_and_compare():
    h = np.array([int.from_bytes(hashlib.md5(str(i).encode()).digest()[:8], "little") for i in range(400)], np.uint64)
    rows, n = digest.filters(h, np.array([0, 0, 1, 400]))
    assert n.tolist() == [0, 1, 3] and rows.shape == (4, 256)
    bits = {int(h[0] >> np.uint64(11 * k)) & 2047 for k in range(digest.HASHES)}
    assert set(np.flatnonzero(np.unpackbits(rows[0])).tolist()) == bits
    x = [r.tobytes() for r in rows[1:]]
    assert digest.similarity(x, x) == 1 and digest.similarity(x, []) == 0 == digest.similarity([], [])
    other = digest.filters(h[::-1] ^ np.uint64(0x5555555555555555), np.array([0, 400]))[0]
    assert digest.similarity(x, [r.tobytes() for r in other]) < 0.1


def test_alike_against_brute_force(spark):
    docs = [d for d in family(5, 10, 15) if len(d) > 300]
    rng = random.Random(15)
    for k in (1, 2, 3, 5, 10):  # texts that hold others whole, and texts that share a part
        long = text_of(rng, 40 * k)
        docs += [long, text_of(rng, 40) + " " + long]
    rows = [(i, t) for i, t in enumerate(docs)] + [(1000, None), (1001, ""), (1002, "short"), (None, docs[0]), (0, docs[0]), (2000, docs[0]), (3000, " ".join(docs) * 5)]
    made = digest.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).cache()
    own = {r.doc_id: (r.digest, set(r.bands)) for r in made.collect() if r.doc_id is not None}
    assert [len(own[i][0]) for i in (1000, 1001, 1002)] == [0, 0, 0] and len(own[3000][0]) > 2
    got = {r.doc_id: r.like_id for r in digest.alike(made).collect()}
    ids = sorted(own)
    pairs = [(a, b) for a in ids for b in ids if a < b and digest.similarity(own[a][0], own[b][0]) >= digest.LIKE]
    met = [(a, b) for a, b in pairs if own[a][1] & own[b][1]]
    assert len(pairs) > 20 and len(met) >= 0.97 * len(pairs)  # what the bands find of all pairs
    assert got == groups_of(met) and got[2000] == 0
    assert digest.alike(made.limit(0)).count() == 0
    texts = digest.alike(digest.digest(spark.createDataFrame([(f"u-{i}", docs[0]) for i in range(3)], "doc_id string, text string")))
    assert {(r.doc_id, r.like_id) for r in texts.collect()} == {("u-1", "u-0"), ("u-2", "u-0")}


def test_a_bucket_of_strangers_sends_no_rows_of_pairs(spark, monkeypatch):
    """Documents that share a band and little else: digests move once a block, not once a
    pair, and those that are alike are found, whatever the tiles' size."""
    docs = [d for d in family(3, 8, 12) if len(d) > 300]
    rng = random.Random(4)
    docs += [text_of(rng, 60 * k) for k in (1, 4, 9)]
    rows = [(i, t) for i, t in enumerate(docs * 2)] + [(900 + i, text_of(rng, 30)) for i in range(120)]
    made = digest.digest(spark.createDataFrame([(i, t if i < len(docs) else changed(rng, t, 2)) for i, t in rows], "doc_id bigint, text string"))
    held = [r for r in made.filter("n_features > 0").collect()]
    same = spark.createDataFrame([(r.doc_id, r.n_features, r.digest, [7]) for r in held], made.schema).cache()  # one bucket for all
    compared = []
    plain = digest.with_similarity
    monkeypatch.setattr(digest, "with_similarity", lambda pairs: (compared.append(pairs.count()), plain(pairs))[1])
    want = groups_of((a.doc_id, b.doc_id) for a in held for b in held if a.doc_id < b.doc_id and digest.similarity(a.digest, b.digest) >= digest.LIKE)
    assert len(want) > 10
    rows = [{"few": k % 3 == 0, "doc_id": r.doc_id, "label": r.doc_id, "value": r.digest} for k, r in enumerate(held)]
    tile = pa.Table.from_pylist(rows, pa.schema({"few": pa.bool_(), "doc_id": pa.int64(), "label": pa.int64(), "value": pa.list_(pa.binary())}))
    alike = {(x["doc_id"], y["doc_id"]) for x in rows for y in rows if y["few"] and not x["few"] and digest.similarity(x["value"], y["value"]) >= digest.LIKE}
    for size in (digest._TILE, 5):
        monkeypatch.setattr(digest, "_TILE", size)
        assert set(zip(*(v.to_pylist() for v in digest.alike_within(tile)))) == alike
    for block in (buckets.BLOCK, 16):
        monkeypatch.setattr(buckets, "BLOCK", block)
        compared.clear()
        assert {r.doc_id: r.like_id for r in digest.alike(same).collect()} == want
        assert sum(compared) <= len(held)


def test_near_copies_at_the_border_of_a_filter():
    h = np.array([int.from_bytes(hashlib.md5(str(i).encode()).digest()[:8], "little") for i in range(400)], np.uint64)
    chain = lambda k: [r.tobytes() for r in digest.filters(h[:k], np.array([0, k]))[0]]
    assert digest.similarity(chain(digest.PER_FILTER), chain(digest.PER_FILTER + 5)) > 0.9
    assert digest.similarity(chain(40), chain(120)) < digest.LIKE


# packing


def plain_pack(docs, window):
    """docs: (doc_id, text) in the shard's order; BM25 and the greedy rule as they are said."""
    def words(t):
        f, at = flat([t])
        return (C.words(f, at)[0] >> np.uint64(64 - packing.TERM_BITS)).astype(int).tolist()

    bags = [words(t) for _, t in docs]
    n, mean = len(docs), sum(map(len, bags)) / len(docs)
    df: dict = {}
    for b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1

    def weight(t, i):
        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * (bags[i].count(t) * (packing.K1 + 1) / (bags[i].count(t) + packing.K1 * (1 - packing.B + packing.B * len(bags[i]) / mean)))

    rest = [len(b) % window for b in bags]
    free = {i for i in range(n) if rest[i]}
    out = [[(i, k * window, (k + 1) * window)] for i in range(n) for k in range(len(bags[i]) // window)]
    for seed in range(n):
        if seed not in free:
            continue
        pieces, room, at = [], window, seed
        while at is not None:
            free.discard(at)
            pieces.append((at, len(bags[at]) - rest[at], len(bags[at])))
            room -= rest[at]
            query = sorted((t for t in set(bags[at]) if df[t] > 1), key=lambda t: (-weight(t, at), t))
            score = {i: sum(weight(t, i) for t in query if t in bags[i]) for i in free}
            for i in sorted((i for i in free if score[i] > 0), key=lambda i: (-score[i], i)):
                if rest[i] <= room:
                    free.discard(i)
                    pieces.append((i, len(bags[i]) - rest[i], len(bags[i])))
                    room -= rest[i]
            fit = [i for i in free if rest[i] <= room]
            at = min(fit, key=lambda i: (-rest[i], i)) if fit else None
        out.append(pieces)
    return out


def test_packing_against_brute_force(spark):
    rng = random.Random(11)
    docs = [(i, text_of(rng, rng.choice([3, 20, 60, 150, 700]))) for i in range(60)]
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, " ?! ")], "doc_id bigint, text string")
    got = packing.pack_documents(df, window=256).collect()
    texts = dict(docs)
    # the shard's order, by the routes that the package gives
    f, at = flat([t for _, t in docs])
    terms, _, begin, _ = packing.doc_terms(f, at)
    count = np.bincount(terms, minlength=packing.TERMS)
    route = [min((int(count[t]) if count[t] > 1 else 1 << 40, int(t)) for t in terms[begin[i] : begin[i + 1]])[1] for i in range(len(docs))]
    order = sorted(range(len(docs)), key=lambda i: (route[i], docs[i][0]))
    want = [[(docs[order[i]][0], a, b) for i, a, b in w] for w in plain_pack([(docs[i][0], texts[docs[i][0]]) for i in order], 256)]
    assert [list(zip(r.doc_ids, r.starts, r.ends)) for r in got] == want
    whole: dict = {}
    for r in got:
        assert r.n_words == sum(b - a for a, b in zip(r.starts, r.ends)) <= 256 and r.seed_id == r.doc_ids[0]
        for d, a, b in zip(r.doc_ids, r.starts, r.ends):
            whole.setdefault(d, []).append((a, b))
    for i, t in docs:  # every word once
        spans = sorted(whole[i])
        assert spans[0][0] == 0 and spans[-1][1] == len(t.split()) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert set(whole) == set(texts)


def test_packing_odd_tables(spark):
    schema = "doc_id bigint, text string, terms int"
    rows = [(1, "alpha beta gamma", 0), (1, "alpha beta gamma", 0), (None, "alpha beta delta", 0), (2, "word " * 100_000, 0)]
    got = packing.pack_documents(spark.createDataFrame(rows, schema), window=64).collect()
    ids = [d for r in got for d in r.doc_ids]
    assert ids.count(1) == 2 and ids.count(None) == 1 and sum(r.n_words for r in got) == 100_009
    assert packing.pack_documents(spark.createDataFrame([], schema)).count() == 0
    many = packing.pack_documents(spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i}", 0) for i in range(400)], schema), window=30, shard_words=50).collect()
    assert sorted(d for r in many for d in r.doc_ids) == list(range(400))


def first_neighbours(windows):
    return {r.doc_ids[0]: r.doc_ids[1] for r in windows if len(r.doc_ids) > 1}


def test_packing_asks_all_shards(spark):
    rng = random.Random(12)
    docs = []
    for i in range(150):  # twins share 12 words of their own; what is rarest each shares with a stranger
        own = [f"w{i}x{k}" for k in range(12)]
        for j in (0, 1):
            docs.append((2 * i + j, " ".join(own + [f"rare{j}y{(i * 7 + j) % 150 // 2}", *rng.sample(WORDS, 6)])))
    for i in range(150):  # the twins' words aren't the rarest
        docs.append((1000 + i, " ".join(f"w{i}x{k}" for k in range(12))))
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), window=50, shard_words=300, every=1).collect()
    assert sorted(d for r in got for d in r.doc_ids) == sorted(d for d, _ in docs)
    family_of = lambda d: d // 2 if d < 1000 else d - 1000
    pairs = [(r.doc_ids[0], d) for r in got for d in r.doc_ids[1:2]]
    assert len(pairs) > 140 and sum(family_of(a) == family_of(b) for a, b in pairs) >= 0.9 * len(pairs)


def test_packing_ranks_by_whole_texts(spark):
    """Each of a text's 80 rarest words stands in another decoy; the twin shares the other 70."""
    own, shared = [f"ta{k}" for k in range(80)], [f"tb{k}" for k in range(70)]
    docs = [(0, " ".join(own + shared)), (1, " ".join(shared + [f"tc{k}" for k in range(80)]))]
    docs += [(10 + k, " ".join([w] + [f"d{k}x{i}" for i in range(5)])) for k, w in enumerate(own)]
    docs.append((500, " ".join(shared + [f"e{k}" for k in range(301 - len(shared))])))  # fills a window: no neighbour
    for shard_words in (10**6, 100):
        got = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), window=301, shard_words=shard_words).collect()
        near = first_neighbours(got)
        assert near.get(0) == 1 or near.get(1) == 0


def test_packing_queries_against_brute_force(spark, monkeypatch):
    """Hits of the queries, one of ten documents, against all documents, in several rounds."""
    monkeypatch.setattr(packing, "SEEDS", 7)
    monkeypatch.setattr(packing, "HITS", 5)
    rng = random.Random(15)
    docs = [(i, text_of(rng, rng.choice([5, 20, 40]))) for i in range(199)]
    docs += [(300 + i, docs[10 * i][1]) for i in range(3)]  # copies of queries tie
    got = packing.pack_documents(spark.createDataFrame([*docs, (None, "lone word")], "doc_id bigint, text string"), window=64, shard_words=100, every=10).collect()
    assert sorted((d for r in got for d in r.doc_ids), key=str) == sorted([*(d for d, _ in docs), None], key=str)
    assert all(r.n_words == sum(b - a for a, b in zip(r.starts, r.ends)) <= 64 for r in got)
    f, at = flat([*(t for _, t in docs), "lone word"])
    terms, tf, begin, words = packing.doc_terms(f, at)
    df, doc = np.bincount(terms), np.repeat(np.arange(len(words)), np.diff(np.append(begin, len(terms))[: len(words) + 1]))
    weight = packing.weights(tf.astype(float), df[terms].astype(float), words[doc].astype(float), len(words), words.mean())
    full = np.zeros((len(words), len(df)))
    full[doc, terms] = weight
    score = np.round((full > 0).astype(float) @ full.T, packing.PLACES)
    used, windows = set(), {r.doc_ids[0]: r.doc_ids for r in got}
    for q in (k for k, (d, _) in enumerate(docs) if d % 10 == 0):
        if q in used or words[q] == 0:
            continue
        room = 64 - words[q]
        best = sorted((k for k in range(len(docs)) if k != q and words[k] <= room and score[q, k] > 0), key=lambda k: (-score[q, k], docs[k][0]))[:5]
        want = [q]
        for k in best:
            if k not in used and words[k] <= room:
                want.append(k)
                room -= words[k]
        made = windows[docs[q][0]]
        assert made[: len(want)] == [docs[k][0] for k in want]
        where = {d: k for k, (d, _) in enumerate(docs)} | {None: len(docs)}
        used |= {where[d] for d in made}


def test_packing_searches_once_for_each_query(spark, monkeypatch):
    """The work is queries times documents: as many searches as rounds of queries."""
    rounds = []
    written = packing.C.written
    monkeypatch.setattr(packing.C, "written", lambda df, name, *more: rounds.append(name) or written(df, name, *more))
    rng = random.Random(16)
    docs = [(i, text_of(rng, 20)) for i in range(500)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), window=60, shard_words=100).collect()
    assert sorted(d for r in got for d in r.doc_ids) == list(range(500))
    assert rounds == ["terms", "counts", "found"]


def test_packing_keeps_words_apart():
    words = [f"{a}{i}" for a in WORDS for i in range(4000)]
    names, terms, tf, begin, n = packing.hashed_terms(*flat([" ".join(words)]))
    assert len(names) == len(terms) == len(words) == n[0] and (tf == 1).all() and begin.tolist() == [0, len(words)]
