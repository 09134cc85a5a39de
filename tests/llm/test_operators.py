"""Operators of matchloom.llm against plain versions, on small tables with the odd cases: nulls, empties, ties, repeats, clashing columns, no rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from matchloom.llm import ann, decontam, license, packing, quality, simhash, substring, tokencount, toxicity, urlfilter, words  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, ""), (4, "   \n\t "), (5, "one"), (6, "ONE"), (7, LONG), (8, LONG + " end"),
    (9, "a " + PASSAGE + " b"), (10, PASSAGE + " c d"), (11, PASSAGE), (11, PASSAGE), (None, PASSAGE), (12, "\x00odd ﻿ bytes é́ 日本語 \U0001f600 <|endoftext|> <s> ▁x"), (13, "  lead  double\n\n\nlines \n x\r\n"),
    (14, "x" * 5000), (15, "e e e e e e e e e e e e e e e e"), (16, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else "en", "s" if k % 3 else None, None if k % 4 == 0 else len(t or ""), "clash", k, 1.0, "clash") for k, (i, t) in enumerate(TEXTS)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, bucket string, block_id int, score double, fp string"
    return spark.createDataFrame(rows, kind).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_word_runs_over_part_bounds(monkeypatch):
    import pyarrow as pa

    column = pa.array([t for _, t in TEXTS])
    whole = [(t.hashes(), words.runs(t.hashes(), 3), [t.word(i) for i in range(len(t.starts))]) for _, _, t in words.slices(column, words.SPACE, False, 1 << 30)][0]
    monkeypatch.setattr(words, "PART", 50)
    part = [(t.hashes(), words.runs(t.hashes(), 3)) for _, _, t in words.slices(column, words.SPACE, False, 1 << 30)][0]
    assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    assert whole[2] == [w for _, t in TEXTS for w in (t or "").encode().split()]
    assert len(set(whole[0].tolist())) == len(set(whole[2]))


def test_words_that_collide_in_polynomial_hashes_differ():
    import pyarrow as pa

    a, b = b"a", b"b"
    for _ in range(11):  # Thue-Morse words: equal modulo 2**64 under every base
        a, b = a + b, b + a
    for column in ([a + b" " + b], [a[:200] + b" " + b[:200]], [bytes([97 + i % 7]) * i + b" " + bytes([97 + i % 7]) * (i + 1) for i in range(1, 300)]):
        for _, _, t in words.slices(pa.array(column, pa.binary()), words.SPACE, False):
            for salt in (0, substring.SECOND):
                assert len(set(t.hashes(salt).tolist())) == len({t.word(i) for i in range(len(t.starts))})
            assert not set(t.hashes().tolist()) & set(t.hashes(substring.SECOND).tolist())


# 1


def test_toxicity_on_held_out(spark):
    rng = np.random.default_rng(0)
    vocabulary, bad = [f"w{i}" for i in range(300)], ["vile", "foul"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        ws = list(rng.choice(vocabulary, 40)) + ([bad[i % 2]] * 2 if toxic else [])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.report(d, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == 1500 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) / len(held) > 0.97
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) for r in got)


def test_toxicity_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0)], "doc_id long, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.report(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.report(none, labels).count() == 0


def test_weights_against_a_plain_loop(spark):
    """FTRL-proximal coordinate by coordinate, in dictionaries, over the same shards."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(60)], 12)) + (" vile" if i % 6 == 0 else ""), i % 6 == 0) for i in range(240)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, rounds=2, passes=1)
    ready = toxicity.training_rows(d, labels, 1000).collect()
    assert {r["shard"] for r in ready} <= set(range(toxicity.SHARDS + 1)) and 5 < sum(r["shard"] == toxicity.SHARDS for r in ready) < 60
    alpha, beta, l1, l2 = 4.0, 1.0, 3.0, 0.1
    z, n, bias = collections.defaultdict(float), collections.defaultdict(float), [0.0, 0.0]

    def weight(zi, ni):
        return 0.0 if abs(zi) <= l1 else (l1 * (1 if zi > 0 else -1) - zi) / ((beta + ni**0.5) / alpha + l2)

    for _ in range(2):
        changes = []
        for shard in sorted({r["shard"] for r in ready} - {toxicity.SHARDS}):
            sz, sn, sb = collections.defaultdict(float, z), collections.defaultdict(float, n), list(bias)
            for r in sorted((r for r in ready if r["shard"] == shard), key=lambda r: (r["row_key"], r["label"])):
                at = toxicity._unpacked(bytes(r["places"])).tolist()
                w = {i: weight(sz[i], sn[i]) for i in at}
                b = -sb[0] / ((beta + sb[1] ** 0.5) / alpha)
                g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - r["label"]
                for i in at:
                    s = ((sn[i] + g * g) ** 0.5 - sn[i] ** 0.5) / alpha
                    sz[i], sn[i] = sz[i] + g - s * w[i], sn[i] + g * g
                s = ((sb[1] + g * g) ** 0.5 - sb[1] ** 0.5) / alpha
                sb = [sb[0] + g - s * b, sb[1] + g * g]
            changes.append((sz, sn, sb))
        for i in {i for sz, _, _ in changes for i in sz}:
            z[i], n[i] = z[i] + sum(c[0].get(i, z[i]) - z[i] for c in changes) / len(changes), n[i] + sum(c[1].get(i, n[i]) - n[i] for c in changes) / len(changes)
        bias = [bias[k] + sum(c[2][k] - bias[k] for c in changes) / len(changes) for k in (0, 1)]
    want = {i: weight(z[i], n[i]) for i in z if abs(abs(z[i]) - l1) > 1e-4}
    have = dict(zip(model["at"].tolist(), model["weights"].tolist(), strict=True))
    slope = next(have[i] / w for i, w in want.items() if abs(w) > 0.1)
    assert sum(w != 0 for w in want.values()) > 0
    assert all(have.get(i, 0.0) == pytest.approx(w * slope, rel=2e-3, abs=1e-4) for i, w in want.items())


def test_packed_places():
    at = np.array([0, 5, 6, 1 << 19], np.uint32)
    assert (toxicity._unpacked(toxicity._packed(at)) == at).all() and len(toxicity._unpacked(toxicity._packed(at[:0]))) == 0


# 2


@pytest.mark.parametrize("block_words", [500_000, 4])
def test_decontamination(spark, docs, block_words):
    items = [(1, "zero ONE two, three four five six seven eight nine ten eleven"), (2, "one"), (3, None), (4, ""), (5, "e e e e e e e e e e e"), (6, PASSAGE), (7, PASSAGE), (None, "one two"), (10, "nine ten eleven"), (8, "absent words here")]
    got = {}
    rows = decontam.scan(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        got[r["doc_id"]] = (r["n_words"], r["n_hit"], r["item_ids"])
        assert r["items_sha256"] == hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest() and r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["item_ids"])
    assert got == decontam.brute_force(dict(TEXTS), {i: t for i, t in items if i is not None and t is not None})


def test_decontamination_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.scan(none, items).count() == 0
    assert decontam.scan(docs, items.where("false")).where("contaminated").count() == 0


# 3


def test_packing_is_a_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), buffer=4).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids)] += len(ids)
    have = collections.Counter()
    for p in pieces:
        have[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert have == want
    for i, t in TEXTS:
        if [j for j, _ in TEXTS].count(i) == 1:
            ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
            for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
                assert p["start"] == at and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
                at += p["length"]
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_word_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in TEXTS] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t, ids in zip(texts, packing.WordIds(public_tokenizers.path("byte_bpe_50k.json")).encode(texts), strict=True):
        assert np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == ids


def test_examples_keep_three_limits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), int(m)) for i, (n, m) in enumerate(zip(rng.integers(1, 400, 300), rng.integers(0, 200, 300), strict=True))] + [(300, 5000, 10), (301, 10, 5000), (302, None, None), (303, 0, 0)]
    got = packing.pack_examples(spark.createDataFrame(rows, "example_id int, n_tokens int, n_loss int").coalesce(2), 1024, 4, 512, buffer=50).collect()
    assert sorted(r["example_id"] for r in got) == list(range(304))
    size = {i: (n or 0, m or 0) for i, n, m in rows}
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for parts in by.values():
        if parts[0]["oversize"]:
            assert len(parts) == 1 and parts[0]["example_id"] in (300, 301)
            continue
        at = 0
        for r in sorted(parts, key=lambda r: r["position"]):
            assert r["offset"] == at
            at += size[r["example_id"]][0]
        assert at <= 1024 and len(parts) <= 4 and sum(size[r["example_id"]][1] for r in parts) <= 512
    assert len(by) < 150


def test_conversations_keep_three_limits(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(c, k, "assistant" if k % 2 else "user", f"turn {k} of {c} " * (1 + (c * 7 + k) % 40)) for c in range(60) for k in range(1 + c % 9)] + [(60, 0, None, None), (61, 0, "assistant", "long " * 3000), (None, 0, "user", "x")]
    t = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, n_tokens string").repartition(3)
    got = packing.pack_conversations(t, public_tokenizers.path("byte_bpe_50k.json"), 1024, 12, 512).collect()
    size, loss, turns = collections.Counter(), collections.Counter(), collections.Counter()
    for c, _, role, text in rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        size[c], loss[c], turns[c] = size[c] + n, loss[c] + n * (role == "assistant"), turns[c] + 1
    assert {r["conv_id"]: (r["n_tokens"], r["n_loss"], r["n_turns"]) for r in got} == {c: (size[c], loss[c], turns[c]) for c in size} and len(got) == len(size)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for parts in by.values():
        if not parts[0]["oversize"]:
            assert sum(r["n_tokens"] for r in parts) <= 1024 and sum(r["n_turns"] for r in parts) <= 12 and sum(r["n_loss"] for r in parts) <= 512
        else:
            assert len(parts) == 1
    assert packing.pack_conversations(t.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# 4


def test_simhash_against_all_pairs(docs, none):
    got = counted(simhash.near_duplicates(docs).collect())
    assert got == collections.Counter(simhash.brute_force(TEXTS))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("cap", [16_384, 40])
def test_trie_links_connect_what_all_pairs_connect(spark, cap):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base[:3].repeat(80) ^ (np.uint64(1) << rng.integers(0, 64, 240).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 240).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, np.array([0, 3, (1 << 64) - 1], np.uint64)]))
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 2, cap).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    mine = simhash.forest(len(fps), iter([(np.array([at[r["u"]] for r in links]), np.array([at[r["v"]] for r in links]))]))
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert (mine == simhash.forest(len(fps), iter([(x, y)]))).all()
    assert cap < 100 or len(links) < 2 * len(fps)


def test_majority_of_long_runs():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    first = np.array([0, 0, 1, 3, 700, 2000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:z]) > z - a) if z > a else 0 for a, z in zip(first[:-1], first[1:], strict=True)]
    assert simhash.majority(h, first).tolist() == want


# 5


@pytest.mark.parametrize("tile_bytes", [32 << 20, 2000])
def test_neighbours_against_brute_force(spark, tile_bytes):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (None, [1.0] * 24), (1020, [1.0, 2.0]), (1021, [3.0, 1.0]), (1040, [1.0] * 5), (3, [-9.0] + [0.0] * 23), (20, [float(c) for c in x[20]])]
    v = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, ids string, block int").repartition(5)
    got = collections.defaultdict(list)
    for r in ann.nearest(v, F.col("vec_id") % 20 == 0, 7, query_block=8, row_block=50, tile_bytes=tile_bytes).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x[3] = [-9.0] + [0.0] * 23 if x[3][0] > -9 else x[3]
    y = x.astype(np.float64)
    for q in range(0, 400, 20):
        s = [(-sum(float(a) * float(b) for a, b in zip(y[q], y[j], strict=True)), j) for j in range(400) if j != q]
        assert [(k + 1, j) for k, (_, j) in enumerate(sorted(s)[:7])] == [(a, b) for a, b, _ in sorted(got[q])]
    assert got[1020] == [(1, 1021, 5.0)] and 1040 not in got and 1000 not in got
    assert ann.nearest(v.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_extreme_vectors(spark):
    rows = [(20, [1e-323, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (40, [1e300, -1e300]), (4, [-1e300, 1e300]), (5, [1e-300, 5e-324]), (60, [1e-200, 1e-200])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, x in rows:
        if q % 20 == 0:
            want = sorted(((-s, i) for i, y in rows if i != q and (s := x[0] * y[0] + x[1] * y[1]) == s))[:2]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


# 6


def test_token_counts_of_every_prefix(docs, none):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp, counter = sentencepiece.SentencePieceProcessor(model_file=model), tokencount.PrefixCounts(model)
    for _, t in TEXTS:
        t = (t or "")[:400]
        assert counter.every_prefix(t).tolist() == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        for budget in (0, 1, 7, 100):
            n = counter.cut(t, budget)
            assert len(sp.encode(t[:n])) <= budget and all(len(sp.encode(t[:k])) > budget for k in range(n + 1, len(t) + 1))
    got = counted(tokencount.report(docs, model, 20).collect())
    assert got == collections.Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 20) for i, t in TEXTS)
    assert tokencount.report(none, model).count() == 0
    full = tokencount.token_counts(docs, model, budgets=(5,), prefixes=True).where("doc_id = 1").first()
    assert full["prefix_tokens"][-1] == full["n_tokens"] and full["prefix_tokens"][full["cut_5"]] <= 5


def test_token_counts_of_real_texts(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert tokencount.PrefixCounts(model).counts(texts) == [len(e) for e in sp.encode(texts)]


# 7


def test_url_parts_and_rules(spark):
    urls = ["http://Www.Example.COM/en/7x?q#f", "https://a.net", "ftp://x.org#z", "no scheme", None, "", "://", "http://example.net/de/81", "http://notnet/de/", "http://b.net/de/?x=://c", "http://EXAMPLE.com/en/8"]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.RULES).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[1:] if fits else (None, "allow")))
    joined = urlfilter.judge(pages, spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string"))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in joined.collect()} == got


def test_blocks_reach_aliases_and_allow_wins(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.io/x", link.format("http://b.io/y")), (2, "http://b.io/y", '<meta http-equiv="refresh" content="0; url=https://bad.com/en/1">'), (3, "http://c.io/", "<link href='/z' rel='canonical'>"),
        (4, "http://c.io/z", None), (5, "http://d.io/", link.format("http://bad.com/en/2")), (6, "http://e.io/", link.format("http://d.io/")), (7, "http://d.io/", link.format("http://example.com/en/7")), (8, "http://bad.com/en/1", ""), (9, None, link.format("http://bad.com/en/3")),
    ]
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), urlfilter.RULES).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default"), 4: ("allow", "default"), 5: ("allow", "alias"), 6: ("allow", "alias"), 7: ("allow", "alias"), 8: ("block", "rule"), 9: ("allow", "default")}
    log = spark.createDataFrame([("http://f.io/", "http://bad.com/en/9"), ("junk", None)], "from_url string, to_url string")
    more = urlfilter.judge(spark.createDataFrame([(1, "http://f.io/", None)], "page_id long, url string, html string"), urlfilter.RULES, log)
    assert more.first()["verdict"] == "block"
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string"), urlfilter.RULES).count() == 0


def test_targets_are_resolved_and_nodes_are_whole_urls(spark, tmp_path):
    import duckdb

    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.io/d/x.html", canonical.format("y.html")), (2, "http://a.io/d/y.html", canonical.format("../e/./z.html")), (3, "http://A.io/e/z.html", canonical.format("https://bad.com/en/1")),
        (4, "http://b.io/p?id=1", canonical.format("http://bad.com/en/2")), (5, "http://b.io/p?id=2", None), (6, "http://b.io/p", None), (7, "http://c.io/p?a=1&b=2#top", None),
        (8, "http://c.io/q", '<meta content="0; url=/p?a=1&amp;b=2" http-equiv="refresh">' + canonical.format("http://bad.com/en/3") + canonical.format("mailto:x@y")), (9, "http://d.io", "<link href='?v=1' rel=canonical>"),
        (10, "http://d.io/?v=1", canonical.format("//bad.com/en/4")), (11, "http://e.io/k/", canonical.format("#part")), (12, "http://f.io/a/b", canonical.format("../../../..")), (13, "http://f.io/", canonical.format("http://bad.com/x/../en/5")),
        (14, "http://g.io/a/../b", None), (15, "http://g.io/b", canonical.format("http://bad.com/en/6")), (16, "http://h.io/s", canonical.format("http://h.io/t") + canonical.format("http://bad.com/en/7")), (17, "http://h.io/t", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in urlfilter.judge(pages, urlfilter.RULES).collect()}
    aliases = {1, 2, 3, 4, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17}
    assert got == {i: (("block", "alias") if i in aliases else ("allow", "default")) for i, *_ in rows}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {r[0]: (r[4], r[5]) for r in con.execute("select page_id, host, path, rule, verdict, via from (" + urlfilter.oracle() + ")").fetchall()} == got


# 8


def test_quality_on_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 != 0"))
    got = quality.scored(docs, model, ["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert all(0 <= r[c] <= 1 for r in got for c in ("quality_score", "content_score", "metadata_score"))
    good, bad = ([r["quality_score"] for r in got if r["quality"] == q] for q in (1, 0))
    assert np.mean(np.array(good) >= 0.5) > 0.97 and np.mean(np.array(bad) < 0.5) > 0.7


def test_quality_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (7, 1), (15, 0), (None, 0), (9, None)], "doc_id long, quality int")
    assert quality.report(docs, labels).count() == len(TEXTS)
    assert {r["quality_score"] for r in quality.report(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.report(none, labels).count() == 0


# 9


def test_licence_forms(spark):
    mit = dict(license.KNOWN)["MIT"]
    whole = next(t for i, t in license.KNOWN if i == "MIT" and t.startswith("Permission"))
    rows = [
        (1, "Copyright (c) 2020 A. Author\n\n" + whole), (2, whole.upper().replace(",", " ;")), (3, whole.replace("sublicense", "sub-license") + "\n© 1999 B\nAll rights reserved."), (4, "some text\n  released under the MIT LICENCE!\nmore"),
        (5, None), (6, ""), (7, "..."), (8, whole + " extra"), (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (None, mit),
    ]
    got = license.scan(spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, digest string, line string"), license.known_digests(spark))
    found = collections.Counter((r["doc_id"], r["license_id"], r["line_licenses"]) for r in got.collect())
    one = "MIT" if "\n" not in mit else ""
    want = [(1, "MIT", "MIT"), (2, "MIT", "MIT"), (3, "MIT", "MIT"), (4, None, "MIT"), (5, None, ""), (6, None, ""), (7, None, ""), (8, None, ""), (9, None, "CC-BY-NC-4.0,MIT"), (9, None, "CC-BY-NC-4.0,MIT"), (None, "MIT", one)]
    assert found == collections.Counter(want)
    assert license.scan(spark.createDataFrame([], "doc_id long, text string"), license.known_digests(spark)).count() == 0


def plain_form(text):
    """The canonical form by plain loops, or None without words."""
    lines = []
    for line in (text or "").lower().split("\n"):
        ws = re.findall(r"[^\W_]+", line)
        gaps = re.split(r"[^\W_]+", line)
        year = lambda w: w[:4].isdigit() and len(w) >= 4
        second = ws[1] if len(ws) > 1 else ""
        states = len(line) <= 200 and bool(ws) and (
            (ws[0] == "copyright" and (second in ("c", "by") or year(second) or any(c in gaps[1] for c in "©<[")))
            or (ws[0] == "c" and gaps[0].endswith("(") and gaps[1].startswith(")") and (second == "copyright" or year(second)))
            or "©" in gaps[0] or ws == ["all", "rights", "reserved"]
        )
        if ws and not states:
            lines.append(ws)
    out = " ".join(w for ws in lines for w in ws)
    for old, new in license.SPELLINGS:
        out = re.sub(rf"(?<!\S){old}(?!\S)", new, out)
    return out or None


def test_licence_digests_against_plain_loops(spark):
    whole = dict(license.KNOWN)["BSD-2-Clause"]
    clause = "do x\n{}\nend"
    texts = [
        None, "", "©", "Copyright 2020 A\nbody", "copyright holder says\nbody", "(c) you must retain the notices\nbody", "(c) 2021 B\nbody", "(C) Copyright 2021 B\nbody", "c) 2020 things\nbody",
        clause.format("(c) you must retain the source form notices"), clause.format("(c) you need not retain them"), clause.format("(b) x"), "All rights reserved.\nbody", "All rights reserved by law to A\nbody",
        "Copyright (c) 2020 X. " + whole, "* Copyright © The Authors\nbody", "copyright <year> <holder>\nbody", "copyright by A\nbody", "copyright byte\nbody", "sub-\nlicence in the centre, whilst non-commercial", "copyright\nowner", "a https://x",
    ]
    got = {r["i"]: r["d"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", license.digest(F.col("t")).alias("d")).collect()}
    forms = [plain_form(t) for t in texts]
    for i, a in enumerate(forms):
        assert (got[i] is None) == (a is None)
        if a is not None:
            assert got[i] == hashlib.sha256((" " + a.replace(" ", "  ") + " ").encode()).hexdigest(), texts[i]
    assert len({got[9], got[10], got[11]}) == 3


def test_known_texts_from_a_table(spark):
    known = license.known_digests(spark, spark.createDataFrame([("X", "The text of X.\nTwo lines"), ("Y", None), ("W", "the TEXT of x two lines")], "license_id string, text string"))
    docs = spark.createDataFrame([(1, "the text of x\n\ntwo lines!"), (2, "other")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in license.scan(docs, known).collect()} == {1: "W", 2: None}


# 10


@pytest.mark.parametrize("block_bytes", [1 << 22, 200])
def test_substrings_against_plain_search(docs, none, block_bytes, monkeypatch):
    monkeypatch.setattr(substring.blocks_of, "__defaults__", (block_bytes,))
    monkeypatch.setattr(substring.dedup, "__defaults__", (13, "doc_id", block_bytes))
    got = counted(substring.report(docs).collect())
    assert got == collections.Counter((i, n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in substring.brute_force(TEXTS))
    assert substring.report(none).count() == 0


def test_passages_of_colliding_words_are_apart(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_cleaned_texts_stay_as_they_are_without_repeats(docs):
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r["doc_id"]: r for r in substring.cleaned(docs, keep).collect()}
    assert got[13]["text"] == dict(TEXTS)[13] and got[2]["text"] is None and got[10]["text"] == "c d" and got[10]["n_chars"] == 3


def test_cover_holds_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
