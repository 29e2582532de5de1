import base64
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from nodepool.llm import bpe, tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.DEFAULT_VOCAB, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
    return bpe.Vocabulary(raw), tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(9)
    letters = "abcdefgh the of éüß 漢字 \n\t  123 .,!?'s <|endoftext|>"
    yield from ["\x00ab ab", "ab \x00ab", "a\tb c", "a \tb", "a\u00a0 b", "a\u2003b c\u2003", "x\n\ny z", " lead", "trail ", "a\x1cb \x1c", "_a b_ ²½ Ⅻ"]
    yield from ["", " ", "a", "aaaaaaaa", "  two  spaces \n\n", "don't we'll", "naïve 漢字 🙂", "x" * 5000, "ab" * 3000, "é" * 500]
    for _ in range(200):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))


def test_encoder_against_tiktoken(vocabulary):
    v, reference = vocabulary
    texts = list(samples())
    ids, counts = bpe.Encoder(v).encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at : at + n].tolist() == reference.encode_ordinary(text)
        at += n


def test_words_in_step_as_by_the_queue(vocabulary):
    v, reference = vocabulary
    texts = list(samples())
    ids, counts = bpe.Encoder(v, queue=False).encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[5].tolist() == reference.encode_ordinary(texts[5])
    want, n = bpe.Encoder(v).encode(texts)
    assert ids.tolist() == want.tolist() and counts.tolist() == n.tolist()
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdeilnorst \xc3\xa9") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert v.encode_short(words)[0].tolist() == v.encode_many(words)[0].tolist() and v.encode_short([b""])[1].tolist() == [0]


def test_one_long_pre_token(vocabulary):
    v, reference = vocabulary
    rng = random.Random(1)
    word = "".join(rng.choice("abcdeilnorst") for _ in range(30_000))
    assert v.encode_one(word.encode()) == v.encode_many([word.encode()])[0].tolist() == reference.encode_ordinary(word)


def test_rank_queue():
    rng, q, held = random.Random(2), bpe.RankQueue(), {}
    for _ in range(2000):
        if held and rng.random() < 0.4:
            r = q.first()
            assert r == min(held) and q.take(r) == held.pop(r)
        else:
            r = rng.randrange(64**3)
            q.push(r, len(held))
            held.setdefault(r, []).append(len(held) if r not in held else len(held))
            held[r] = list(q.buckets[r])
    assert (q.first() == -1) == (not held)


def test_table(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "hello world", "n"), (1, "hello world", "x"), (4, "long " * 50_000, "l")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "text", "token_ids", "n_tokens", "n_bytes", "round_trip"]
    out = got.collect()
    assert [r.round_trip for r in out] == [True] * 6 and [r.token_ids is None for r in out] == [False, True, False, False, False, False]
    assert [r.n_tokens for r in out[:5]] == [2, 0, 0, 2, 2] and out[5].n_bytes == 250_000
    back = bpe.decode(got).collect()
    assert [r.decoded for r in back] == [r[1] for r in rows]
    odd = spark.createDataFrame([([1, None],), ([99_999_999],), ([-1],), ([],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(odd).collect()] == [None, None, None, ""]
    assert bpe.encode(df.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("u-1", "hello world")], "doc_id string, text string").selectExpr("*", "named_struct('a b', 1, 'c`d', named_struct('e.f', text)) AS `x.y`", "'k' AS n_bytes", "1 AS c0", "2 AS ids")
    got = bpe.encode(df)
    assert got.columns == ["doc_id", "text", "x.y", "c0", "ids", "token_ids", "n_tokens", "n_bytes", "round_trip"]
    back = bpe.decode(got)
    assert back.columns == [*got.columns, "decoded"] and back.first().decoded == "hello world" and back.first()["x.y"]["a b"] == 1
    named = bpe.encode(df.select("doc_id", df.text.alias("token_ids")), "token_ids")
    assert named.columns == ["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"] and named.first().n_tokens == 2


@pytest.mark.parametrize("encoding", tokens.ENCODINGS)
def test_token_files(spark, tmp_path, encoding):
    rng = random.Random(3)
    rows = [(i, "en", "s", " ".join(rng.choice("abcdefghij") + rng.choice(["lpha", "eta", "amma ray"]) + str(rng.randrange(1000)) for _ in range(rng.randint(0, 80)))) for i in range(3000)]
    rows += [(None, "en", "s", "no id"), (5000, "en", "s", None), (7, "en", "s", "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    path = str(tmp_path / encoding)
    tokens.write_tokens(tokens.tokenise(docs, partitions=2), path, encoding, row_group=64 << 10, page=4 << 10, page_rows=100)
    back = tokens.read_tokens(spark, path)
    want = bpe.encode(docs).drop("round_trip", "text")
    assert sorted(map(str, back.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    files = sorted((tmp_path / encoding).glob("*.parquet"))
    last, groups = None, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema == "token_ids.list.element":
                    assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary") or column.total_uncompressed_size < 200
                    assert encoding == "dictionary" or "DELTA_BINARY_PACKED" in column.encodings
                if column.path_in_schema == "doc_id":
                    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_column_index and column.has_offset_index
                    if column.statistics.has_min_max:
                        assert last is None or column.statistics.min >= last
                        last = column.statistics.max
    assert groups > len(files)
    some = tokens.read_tokens(spark, path, 100, 140)
    assert sorted(r.doc_id for r in some.collect()) == list(range(100, 141))
    light = tokens.read_tokens(spark, path, 100, 140, tokens=False)
    plan = light._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,100)" in plan


def test_bad_encoding(spark):
    with pytest.raises(ValueError):
        tokens.write_tokens(spark.range(1), "x", "huffman")
