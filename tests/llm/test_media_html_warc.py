import gzip
import math
import random
from pathlib import Path

import numpy as np
import pytest

from nodepool.llm import chroma, warc, wrapper

# chroma


def tune(steps, rate=chroma.RATE):
    return np.frombuffer(chroma.melody(list(steps), rate)[44:], "<i2").astype(float) / 32768


def test_fingerprint_by_plain_sums():
    x = tune(np.random.default_rng(1).standard_normal(30))
    c = chroma.chroma(x, chroma.RATE)
    assert c.shape[1] == 12 and np.allclose((c**2).sum(1), 1)
    codes, silent = chroma.integers(c)
    assert len(codes) == len(c) - chroma.WIDTH + 1 and not silent.any()
    for t in (0, 3, len(codes) - 1):  # the same without an integral image
        want = 0
        for kind, y, h, w, cuts in chroma.FILTERS:
            area = lambda a, b, wide, high: c[t + a : t + a + wide, b : b + high].sum()  # noqa: B023, E731
            whole = area(0, y, w, h)
            if kind == 0:
                v = 1 / (1 + math.exp(-math.log((1 + whole) / (1 + area(0, 0, w, 12) - whole))))
            else:
                part = {
                    1: lambda: area(0, y + h // 2, w, h - h // 2), 2: lambda: area(w // 2, y, w - w // 2, h),  # noqa: B023
                    3: lambda: area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2),  # noqa: B023
                    4: lambda: area(0, y + h // 3, w, h // 3), 5: lambda: area(w // 3, y, w // 3, h),  # noqa: B023
                }[kind]()
                v = math.log((1 + part) / (1 + whole - part))
            want = want << 2 | [0, 1, 3, 2][sum(v >= k for k in cuts)]
        assert int(codes[t]) == want


def test_alignment_finds_the_offset():
    rng = np.random.default_rng(2)
    steps = rng.standard_normal(80)
    scale = np.sqrt((steps**2).mean())
    x = tune(steps)
    cut = x[11 * chroma.HOP :] * 0.7
    a, b = (chroma.integers(chroma.chroma(v, chroma.RATE))[0].view(np.int32) for v in (x, cut))
    offset, error, both = chroma.align(a, b)
    assert offset == 11 and error < 0.05 and both == len(b) and scale > 0
    other = chroma.integers(chroma.chroma(tune(rng.standard_normal(80)), chroma.RATE))[0].view(np.int32)
    assert chroma.align(a, other)[1] > chroma.MAX_ERROR or chroma.align(a, other)[2] < chroma.MIN_OVERLAP
    assert chroma.align(a, np.zeros(0, np.int32)) == (0, 1.0, 0)


def test_recordings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [rng.standard_normal(40) for _ in range(12)]
    noisy = [chroma.write_wav(tune(b) + rng.normal(0, 0.003, len(tune(b)))) for b in base[:6]]
    rows = [(i, chroma.melody(list(b))) for i, b in enumerate(base)] + [(20 + i, w) for i, w in enumerate(noisy)] + [(40, chroma.melody(list(base[0])))]
    rows += [(50, None), (51, b""), (52, b"RIFFjunk"), (53, chroma.write_wav(np.zeros(50_000))), (54, chroma.write_wav(np.zeros(10))), (None, rows[0][1]), (3, rows[3][1])]
    prints = chroma.fingerprint(spark.createDataFrame(rows, "id bigint, audio binary"), "id", "audio").cache()
    got = {r.rec_id: r for r in chroma.recordings_alike(prints).collect()}
    own = {r.rec_id: np.array(r.fingerprint, np.int32) for r in prints.collect() if r.rec_id is not None}
    assert all(len(own[i]) == 0 for i in (50, 51, 52, 54))
    want = {}
    for b in own:
        if b < 50:
            hits = [a for a in own if a < b and a < 50 and (e := chroma.align(own[a], own[b]))[1] <= chroma.MAX_ERROR and e[2] >= chroma.MIN_OVERLAP]
            if hits:
                want[b] = min(hits)
    assert {20, 21, 22, 23, 24, 25, 40} <= set(want)
    assert len({b for b in want if b in got and got[b].match_id <= b}) >= 0.9 * len(want) and set(got) <= set(want)
    assert got[40].match_id == 0 and got[40].offset == 0 and got[40].bit_error == 0


def test_every_aligned_pair(spark):
    rng = np.random.default_rng(7)
    x, y, z = (tune(rng.standard_normal(40)) for _ in range(3))
    sounds = {0: x, 1: y, 2: np.concatenate([x, y]), 3: np.concatenate([y, z]), 4: z, 5: x, 6: x, 7: y}
    rows = [(i, chroma.write_wav(s)) for i, s in sounds.items()]
    prints = chroma.fingerprint(spark.createDataFrame(rows, "id bigint, audio binary"), "id", "audio").cache()
    own = {r.rec_id: np.array(r.fingerprint, np.int32) for r in prints.collect()}
    want = {}
    for a in own:
        for b in own:
            if a < b and (e := chroma.align(own[a], own[b]))[1] <= chroma.MAX_ERROR and e[2] >= chroma.MIN_OVERLAP:
                want[b, a], want[a, b] = (e[0], e[1]), (-e[0], e[1])
    got = [((r.rec_id, r.match_id), (r.offset, r.bit_error)) for r in chroma.aligned_pairs(prints).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert {(0, 5), (5, 6), (0, 2), (2, 0), (2, 1), (2, 3)} <= set(want)
    near = {a: {b for x, b in want if x == a} for a in own}

    def reach(a):
        seen, new = {a}, {a}
        while new := {b for x in new for b in near[x]} - seen:
            seen |= new
        return seen

    got = {r.rec_id: (r.class_id, r.n_links) for r in chroma.classes(prints).collect()}
    assert got == {a: (min(reach(a)), len(near[a])) for a in own if near[a]}


def test_a_row_for_each_recording(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(40).tolist()
    rows = [(i, base) for i in range(12)] + [(20, rng.standard_normal(40).tolist()), (21, None), (None, base)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = chroma.op1_chroma_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.class_id, r.n_links) for r in got), key=str) == sorted([*((i, 0, 11) for i in range(12)), (20, 20, 0), (21, 21, 0), (None, None, 0)], key=str)


def test_no_recordings(spark):
    prints = chroma.fingerprint(spark.createDataFrame([], "id bigint, audio binary"), "id", "audio")
    assert chroma.recordings_alike(prints).count() == 0


# wrapper induction


def plain_weight(a, b):
    """Simple tree matching by its definition; trees are (key, children)."""
    if a[0] != b[0]:
        return 0
    x, y = a[1], b[1]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_weight(x[i], y[j]))
    return 1 + m[-1][-1]


def random_tree(rng, depth):
    return (rng.randint(2, 4), [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))] if depth else [])


def flat(tree):
    keys, sizes = [tree[0]], [1]
    for c in tree[1]:
        k, s = flat(c)
        keys += k
        sizes += s
    sizes[0] = len(keys)
    return keys, sizes


def test_tree_matching_against_its_definition():
    rng, m = random.Random(7), wrapper.Matcher()
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        (ka, sa), (kb, sb) = flat((0, [a])), flat((0, [b]))
        pairs = m.align(ka, sa, kb, sb)
        assert len(pairs) == plain_weight((0, [a]), (0, [b])) == m.weight(m.shape(ka, sa), m.shape(kb, sb))
        assert all(ka[i] == kb[j] for i, j in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        assert sorted(pairs) == sorted(pairs, key=lambda p: (p[1], p[0]))  # order is kept


def page(title, paragraphs):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body><nav><ul><li>Home<li>About us</ul></nav><!-- x -->"
            f"<div class=ad>Buy now</div><article><h1>{title}</h1>" + "".join(f"<p>{p}<br>" for p in paragraphs) + "</article><footer>&copy; Site</footer></body></html>")  # fmt: skip


def test_template_goes_and_content_stays(spark):
    rng = random.Random(1)
    body = {i: [f"text {i} {k} {rng.random()}" for k in range(rng.randint(1, 6))] for i in range(12)}
    rows = [(i, f"http://a.org:80/{i}", page(f"T{i}", body[i])) for i in body] + [(90, "https://lone.net/x", page("Only", ["one &amp; all"])), (91, "no host", None), (92, None, ""), (93, "http://a.org/93", "<<p>broken <b"), (0, "http://a.org/0", page("T0", body[0]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, content string")
    got = {}
    for r in wrapper.extract(df).collect():
        got[r.page_id] = r
    for i, paragraphs in body.items():
        assert got[i].content.split("\n") == [f"T{i}", f"T{i}", *paragraphs] and got[i].host == "a.org" and got[i].n_template == 4
    assert "Home" in got[90].content and "one & all" in got[90].content and got[90].n_template == 0
    assert got[91].content is None and got[92].content == "" and got[92].host == "" and "broken" in got[93].content
    assert wrapper.extract(df.limit(0)).count() == 0


def test_very_long_and_deep_pages(spark):
    rows = [(i, "http://b.org/", "<div>" * 3000 + f"deep {i}" + "".join(f"<p>x{i}-{k}" for k in range(3000))) for i in range(3)]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.n_content for r in got} == {3001}


def test_deep_pages_of_different_shapes(spark):
    rows = [(f"p{i}", "http://b.org/", "<div>" * (1500 + i) + f"deep {i}" + "<b>x</b>" * i) for i in range(4)]
    got = {r.page_id: r.content for r in wrapper.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert all(f"deep {i}" in got[f"p{i}"] for i in range(4))
    m = wrapper.Matcher()
    a, b = ([2] * n + [3] * k for n, k in ((3000, 1), (2900, 2)))
    chain = lambda keys, k: list(range(len(keys), k, -1)) + [1] * k
    assert len(m.align(a, chain(a, 1), b, chain(b, 2))) == 2900 - 100 + 100


def test_signs_in_attributes():
    texts = [t for t in wrapper.parse("<a title=\"x>y\" href=z>link</a><b data-x='>'>bold</b><i a=\"open>it</i> 5 > 3")[2] if t]
    assert texts[:2] == ["link", "bold"] and "y\"" not in " ".join(texts) and texts[-1].endswith("5 > 3")


def two_layouts():
    rows = []
    for i in range(30):
        rows.append((i, f"http://h.org/{i}", page(f"T{i}", [f"body {i} {k}" for k in range(i % 5 + 1)])))
        boxes = "".join(f"<section class=card><h3>item {i} {k}</h3><span class=more>Read more</span></section>" for k in range(3))
        rows.append((100 + i, f"http://h.org/list/{i}", f"<html><body><main class=list><em class=lead>All items</em><div class=grid>{boxes}</div><aside class=tip>Subscribe today</aside><small class=legal>Terms apply</small></main></body></html>"))
    rows += [(500 + i, f"http://h.org/o{i}", f"<table class=t{i}><tr><td class=u{i}>only {i}</td></tr></table>") for i in range(3)]
    rows += [(600 + i, f"http://h.org/v{i}", f"<dl class=v><dt class=w>fixed</dt><dd class=z>slot {i}</dd></dl>") for i in range(2)]
    return rows


def test_each_layout_has_a_template(spark):
    df = spark.createDataFrame(two_layouts(), "page_id bigint, url string, html string")
    got = {r.page_id: r for r in wrapper.extract(df).collect()}
    assert len(got) == 65
    for i in range(30):
        assert got[i].content.split("\n") == [f"T{i}", f"T{i}", *(f"body {i} {k}" for k in range(i % 5 + 1))]
        assert got[100 + i].content.split("\n") == [f"item {i} {k}" for k in range(3)] and got[100 + i].n_template == 6
    assert [got[500 + i].content for i in range(3)] == ["only 0", "only 1", "only 2"] and [got[600 + i].content for i in range(2)] == ["slot 0", "slot 1"]


def test_extraction_by_brute_force(spark):
    """Every page's content, by the definition: groups, seeds, plain matching, counts."""
    pages = [(i, u, h) for i, u, h in two_layouts()] + [(900 + i, "http://x.net/", f"<p>one</p><p>{i}</p>") for i in range(3)] + [(950, "http://lone.net", "<b>x</b>")]
    tree = {i: wrapper.parse(h) for i, _, h in pages}
    host = {i: u.split("/")[2] for i, u, _ in pages}

    def match(a, b):
        """Pairs of the best matching of two subtrees, leftmost where it ties."""
        (ka, sa, _), (kb, sb, _) = a, b

        def children(sizes, i):
            j = i + 1
            while j < i + sizes[i]:
                yield j
                j += sizes[j]

        memo: dict = {}

        def weight(i, j):
            if (i, j) not in memo:
                memo[i, j] = 0
                if ka[i] == kb[j]:
                    x, y = [*children(sa, i)], [*children(sb, j)]
                    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
                    for p, u in enumerate(x):
                        for q, v in enumerate(y):
                            m[p + 1][q + 1] = max(m[p][q + 1], m[p + 1][q], m[p][q] + weight(u, v))
                    memo[i, j] = 1 + m[-1][-1]
            return memo[i, j]

        return weight(0, 0)

    content, rest = {}, list(tree)
    for level, group in enumerate((lambda i: host[i], lambda i: (host[i], wrapper.marks(*tree[i][:2])[0]), lambda i: (host[i], wrapper.marks(*tree[i][:2])[1]))):
        left = []
        for g in {group(i) for i in rest}:
            own = [i for i in rest if group(i) == g]
            seed = min(own, key=lambda i: (-len(set(tree[i][0])), i))
            votes: dict = {}
            fit = {}
            for i in own:
                pairs, fits = wrapper.Matcher().fit(*tree[i][:2], *tree[seed][:2])
                assert len(pairs) == match(tree[i], tree[seed])
                kinds = wrapper.edges(*tree[i][:2])
                assert fits == (len({kinds[a] for a, _ in pairs}) >= wrapper.FITS * len(set(kinds)))
                if fits or level == 2:
                    fit[i] = pairs
                    for a, b in pairs:
                        if tree[i][2][a] is not None:
                            votes.setdefault(b, []).append(tree[i][2][a])
                else:
                    left.append(i)
            fixed = {b: t for b, ts in votes.items() for t in set(ts) if len(ts) >= wrapper.MIN_PAGES and ts.count(t) >= wrapper.CONSTANT * len(ts)}
            for i, pairs in fit.items():
                gone = {a for a, b in pairs if b in fixed and tree[i][2][a] == fixed[b]}
                content[i] = "\n".join(t for a, t in enumerate(tree[i][2]) if t is not None and a not in gone).replace("&copy;", "\u00a9")
        rest = left
    got = {r.page_id: r.content for r in wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == content


# WARC


def test_resolution_and_archives(spark, tmp_path):
    schema = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload string"
    rows = [
        ("r2", "response", "u2", "2024-01-02", "d1", "same"), ("r1", "response", "u1", "2024-01-01", "d1", "same"), ("r3", "response", "u3", "2024-01-01", "d3", "new"),
        ("v1", "revisit", "u1", "2024-01-05", "d1", None), ("v2", "revisit", "u9", "2024-01-05", "lost", None), ("v3", "revisit", "u9", "2024-01-05", None, None),
        ("n1", "response", "u5", "2024-01-01", None, None), (None, "response", None, None, "d7", "é\n"), ("r3", "response", "u3", "2024-01-01", "d3", "new"), ("w", None, None, None, None, None),
    ]
    index = warc.write_archives(spark.createDataFrame(rows, schema), str(tmp_path / "out")).collect()
    by = {r.record_id: r for r in index}
    assert len(index) == len(rows) and (by["r2"].warc_type, by["r2"].refers_to, by["r2"].refers_to_uri, by["r2"].refers_to_date) == ("revisit", "r1", "u1", "2024-01-01")
    assert by["r1"].warc_type == "response" and by["v1"].refers_to == "r1" and by["v1"].resolved and not by["v2"].resolved and not by["v3"].resolved
    assert by["n1"].warc_type == "response" and by["w"].warc_type is None
    blocks = {}
    for r in index:
        data = (Path(tmp_path / "out") / r.archive).read_bytes()[r.offset : r.offset + r.length]
        ((headers, block),) = warc.read_archive(data)
        assert headers["WARC-Record-ID"] == r.record_id and headers.get("WARC-Refers-To") == r.refers_to
        blocks[r.record_id] = block
    assert blocks["r1"] == b"same" and blocks["r2"] == b"" == blocks["v1"] and [b for b in blocks.values() if b == "é\n".encode()]
    files = [p for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")]
    assert all(p.name.startswith("part-") for p in files) and sum(len(warc.read_archive(p.read_bytes())) for p in files) == len(rows)
    assert gzip.decompress(files[0].read_bytes()).startswith(b"WARC/1.1\r\n")


def test_no_records_and_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "x"), (2, "u", "x"), (2, "u", "x")], "page_id bigint, url string, html string")
    index, _ = warc.archives_of(spark, warc.captures(pages))
    assert index.count() == 8 and index.filter("resolved").count() == 7
    index, _ = warc.archives_of(spark, warc.captures(pages.limit(0)))
    assert index.count() == 0


def test_binary_payloads_and_reading_again(spark, tmp_path):
    schema = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload binary, part int"
    blocks = [bytes([0, 255, 10, 13]) * 100, b"", "caf\u00e9".encode()]
    rows = [(f"r{i}", "response", f"u{i}", f"2024-01-0{i + 1}", f"d{i}", bytearray(b), i) for i, b in enumerate(blocks)] + [("r9", "response", "u9", "2024-01-09", "d0", bytearray(blocks[0]), 9)]
    index = warc.write_archives(spark.createDataFrame(rows, schema), str(tmp_path / "out"))
    assert "part" not in index.columns and index.count() == 4
    back = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "out")).collect()}
    assert [bytes(back[f"r{i}"].payload) for i in range(3)] == blocks and back["r9"].warc_type == "revisit" and back["r9"].payload is None
    again = warc.resolve(warc.read_archives(spark, str(tmp_path / "out"))).filter("record_id = 'r9'").first()
    assert again.refers_to == "r0" and again.resolved
    assert warc.read_archives(spark, str(tmp_path)).count() == 4
    assert warc.qualified(spark, "/x/y").startswith("file:/")


@pytest.mark.parametrize("text", ["", "no record"])
def test_broken_archive(text):
    if text:
        with pytest.raises(ValueError):
            warc.read_archive(gzip.compress(text.encode()))
    else:
        assert warc.read_archive(gzip.compress(b"")) == []
