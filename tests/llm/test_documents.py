"""Operators on documents against brute force, exact round trips and held-out labels, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from seekwell.llm import decontaminate, graph, kernels, mixing, near_dup, packing, quality, token_counts  # noqa: E402

LONG = "wort " * 30000
ODD = ["", None, " ", "a", "É́ ß x", "<|endoftext|> hi <|startoftext|>", "x" * 70000, LONG, "tab\tfeed\x0bformfeed\x0c", "日本語 テキスト", "a\x00b"]
SCHEMA = "doc_id long, text string, source string, n_words string, score string"


def docs(spark, texts, source=None):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, source(i) if source else "s", "own", "own") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# --- kernels


def test_words_equal_regular_expressions():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aZ9é \t\n.\x7f-日") for _ in range(rng.randrange(50))) for _ in range(300)]
    for table, of in ((kernels.SPACED, lambda t: spaced(lower(t))), (kernels.ALNUM, alnum)):
        w = kernels.words(pa.array(texts, pa.string()), table)
        want = [of(t) for t in texts]
        assert np.diff(w.bounds).tolist() == [len(x) for x in want]
        flat = [x for y in want for x in y]
        assert len(set(flat)) == len(set(w.hash.tolist())) == len(set(zip(flat, w.hash.tolist())))


def test_chunks_never_cut_words(monkeypatch):
    texts = pa.array(["ab cd efghijklmnop q", "", "xyz " * 40, "z"])
    whole = kernels.words(texts, kernels.SPACED)
    monkeypatch.setattr(kernels, "_CHUNK", 7)
    cut = kernels.words(texts, kernels.SPACED)
    assert (whole.start == cut.start).all() and (whole.end == cut.end).all() and (whole.hash == cut.hash).all()


def test_winnowing_keeps_a_print_of_every_long_span():
    rng = np.random.default_rng(2)
    for _ in range(200):
        shared = rng.integers(0, 50, 13).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 50, 20).astype(np.uint64), shared, rng.integers(0, 50, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 50, 3).astype(np.uint64), shared, rng.integers(0, 50, 30).astype(np.uint64)])
        ga, gb = kernels.grams(a, 5), kernels.grams(b, 5)
        assert set(ga[decontaminate.winnow(ga, 9)].tolist()) & set(gb[decontaminate.winnow(gb, 9)].tolist())


# --- 1: token counts


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, ODD), public_tokenizers.path(name), chunk_chars=2000, overlap_chars=64).collect()}
    for i, text in enumerate(ODD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 2048), i
    assert token_counts.count_tokens(docs(spark, ODD).filter("false"), public_tokenizers.path(name)).count() == 0


def test_spliced_ids_equal_whole_ids():
    c = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), 200, 16)
    assert c.by_space and not token_counts.TokenCounter(public_tokenizers.path("byte_bpe_50k.json")).by_space
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "É", "é", " ", "\n", "  ", "'ll", "123", "!!", "日", "<|endoftext|>", " ", "q" * 40]) for _ in range(rng.randrange(500)))
        assert c.spliced(text).tolist() == c.tok.encode(text, add_special_tokens=False).ids
    assert c.widened  # some overlaps had no proven boundary


# --- 5: packing


def test_best_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 65, rng.integers(0, 60))
        got = packing.best_fit_decreasing(n, 64)
        assert sorted(i for b in got for i in b) == list(range(len(n))) and all(sum(n[b]) <= 64 for b in got)
        rooms = []
        for x in sorted(n.tolist(), reverse=True):
            fit = [i for i, r in enumerate(rooms) if r >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(64 - x)
        assert sorted(64 - sum(n[b]) for b in got) == sorted(rooms)


def test_packing_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = packing.pack(docs(spark, ODD), path, capacity=128, block_tokens=5000).collect()
    enc = packing.encoding(path)
    found = packing.unpack(rows, 128)
    assert {k: v for k, v in found.items()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    for r in rows:
        pos, cu = np.frombuffer(bytes(r.position_ids), "<u2"), r.cu_seqlens
        assert len(pos) == 128 and cu[0] == 0 and cu[-1] == r.n_tokens <= 128
        want = np.concatenate([np.arange(b - a) for a, b in zip(cu, [*cu[1:], 128])])
        assert (pos == want).all()
    assert len({(r.shard, r.row) for r in rows}) == len(rows)
    assert packing.pack(docs(spark, ODD).filter("false"), path).count() == 0


# --- 6: decontamination


def brute_contamination(texts, items, window=13):
    wins = {}
    for i, t in items:
        w = alnum(t)
        m = min(window, len(w))
        for a in range(len(w) - m + 1 if w else 0):
            wins.setdefault((m, tuple(w[a : a + m])), set()).add(i)
    sizes = {m for m, _ in wins}
    out = {}
    for k, t in enumerate(texts):
        w, hit, ids = alnum(t), set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                if (m, tuple(w[a : a + m])) in wins:
                    hit.update(range(a, a + m))
                    ids |= wins[m, tuple(w[a : a + m])]
        ids = sorted(str(i) for i in ids if i is not None)
        out[k] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 600])
def test_contamination_equals_brute_force(spark, limit):
    rng = random.Random(5)
    items = [(i, words(rng, rng.choice([1, 3, 12, 13, 14, 40]), 12)) for i in range(30)] + [(7, "w1 w2"), (99, None), (98, ""), (97, "!!"), (96, "Only-Here")]
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    texts = [words(rng, rng.randrange(80), 12) for _ in range(60)] + [f"zz {items[3][1].upper()}. {words(rng, 5)} " + (items[5][1] or "") for _ in range(5)] + ODD + [LONG + items[4][1], "only here"]
    df = docs(spark, texts)
    rows = decontaminate.contamination(df, bench, max_broadcast_bytes=limit).collect()
    names = [c for c in rows[0].asDict() if c not in df.columns]
    assert names == ["n_words_", "n_hit", "n_items", "items_sha256", "contaminated"]  # the document's own n_words stays
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows} == brute_contamination(texts, items)
    none = decontaminate.contamination(df, bench.filter("false")).collect()
    assert len(none) == len(texts) and not any(r.contaminated or r.n_hit for r in none)
    assert decontaminate.contamination(df.filter("false"), bench).count() == 0


# --- 8: near duplicates


def brute_components(texts, shingle, percent=80):
    sets = []
    for t in texts:
        w = spaced(lower(t))
        k = min(shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}


def families(rng, shingle):
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(20, 120), 500).split()
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    shared = words(rng, 40, 500)  # a passage in many documents that are not alike
    texts += [shared + " " + words(rng, rng.randrange(15, 40), 500) for _ in range(40)]
    return texts + ODD + ["a", "A", "a b", "A  b"]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    texts = families(random.Random(shingle), shingle)
    rows = near_dup.near_duplicates(docs(spark, texts), shingle=shingle, block_bytes=20000, block_rows=6).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_components(texts, shingle)


def test_near_duplicates_chain_and_edges(spark):
    rng = random.Random(9)
    w = words(rng, 100, 2000).split()
    chain = []
    for i in range(30):  # each like the next, the ends unlike each other
        chain.append(" ".join(w))
        for _ in range(4):
            w[rng.randrange(len(w))] = f"c{i}{rng.randrange(99)}"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, chain), shingle=2).collect()}
    assert got == brute_components(chain, 2)
    df = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z"), (None, "q r s"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (2, 2, True)], key=repr)
    assert near_dup.near_duplicates(df.filter("false")).count() == 0


def test_chains_connect_what_pairs_connect():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, (6, 400), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.integers(6)][: rng.integers(200, 400)], rng.integers(0, 1 << 62, rng.integers(0, 80), dtype=np.uint64)])) for _ in range(120)]
    sig = np.stack([near_dup.packed(near_dup.minima(x)) for x in sets])
    size, comp, block = np.array([len(x) for x in sets]), rng.integers(0, 60, 120), rng.integers(-1, 1, 120)
    key = np.sort(rng.integers(0, 9, 120))
    got = near_dup.chained(key, block, comp, size, sig, 80)
    want = list(range(120))
    for i in range(120):
        for j in range(i):
            alike = near_dup.estimate(sig[i : i + 1], sig[j : j + 1])[0] >= near_dup.LOW and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])
            if key[i] == key[j] and comp[i] != comp[j] and (block[i] != block[j] or block[i] < 0) and alike and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert got.tolist() == want and len(set(want)) < 120


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        base = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        a, b = base[:n], base[n - both : 2 * n - both]
        got = near_dup.estimate(near_dup.packed(near_dup.minima(a)), near_dup.packed(near_dup.minima(b)))
        assert abs(got - j) < 0.12


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {x: x for e in edges for x in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    first, rest = edges[:30], edges[30:]
    step = graph.joined(graph.components(spark.createDataFrame(first, "a long, b long")), spark.createDataFrame(rest, "a long, b long"))
    assert {r.node: r.comp for r in step.collect()} == got
    up = {i: rng.randrange(i) for i in range(1, 80) if rng.random() < 0.9}
    root = lambda x: root(up[x]) if x in up else x
    trees = graph.forest(spark.createDataFrame(list(up.items()), "node long, parent long"))
    assert {r.node: r.comp for r in trees.collect()} == {x: root(x) for x in {*up, *up.values()}}
    assert got == {k: v for k, v in comp.items() if k in got} and all(a in got and b in got for a, b in edges if a != b)


# --- 9: quality


def test_quality_learns_held_out_labels(spark):
    rng = random.Random(7)
    texts = [words(rng, 40, 60) if i % 3 else " ".join(f"{w}$$$" for w in words(rng, 40, 60).split()) for i in range(400)] + ODD
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(3, None), (9999, 1), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, max_rows=300)
    rows = quality.score(df, model, out="p").collect()
    assert len(rows) == len(texts) and all(0 <= r.p <= 1 for r in rows)
    held = [(r.p >= 0.3, r.doc_id % 3 > 0) for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    empty = {r.p for r in rows if r.doc_id in (400, 401, 402)}
    assert len(empty) == 1
    again = quality.score(df.repartition(7), quality.train(df, labels, max_rows=300), out="p")
    assert {r.doc_id: r.p for r in again.collect()} == {r.doc_id: r.p for r in rows}
    flat = quality.train(df, labels.filter("false"))
    assert {r.p for r in quality.score(df, flat, out="p").collect()} == {0.5}
    assert quality.score(df.filter("false"), model, out="p").count() == 0


def test_scoring_equals_one_text_at_a_time(monkeypatch):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(60)) for _ in range(50)] + [t for t in ODD if t]
    weight = np.random.default_rng(1).normal(size=(1 << 10) + quality.MARKS).astype(np.float32)
    together = quality.mean_weights(pa.array(texts), weight)
    alone = np.array([quality.mean_weights(pa.array([t]), weight)[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-12)
    f = quality.counted(pa.array(texts), 1 << 10)
    assert np.allclose([s @ weight[i] for i, s in f], together, atol=1e-4)
    monkeypatch.setattr(quality, "_SEGMENT", 100)
    assert quality.mean_weights(pa.array([LONG]), weight).shape == (1,)


def test_ngrams_are_of_characters():
    for text, n in (("abcde", 4 + 3 + 2), ("日本語テ", 3 + 2 + 1), ("é a", 2 + 0 + 0), ("𝄞ßx", 2 + 1)):
        found = quality._features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 1 << 18)
        assert sum(len(f) for f, _ in found[2:]) == n, text
    texts = ["日本", "語本", "ab", ""]
    data, offsets = kernels.bytes_of(pa.array(texts))
    code, space, first = quality._characters(data, offsets)
    assert first.tolist() == [0, 2, 4, 6, 6] and code[1] == code[3] and len(set(code.tolist())) == 5 and not space.any()


def test_quality_of_real_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    docs_, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    scored = quality.score(docs_, quality.train(docs_, labels), out="p").join(labels, "doc_id").filter(~quality.learnable(F.col("doc_id"))).select("p", "quality").collect()
    good, bad = [r.p for r in scored if r.quality == 1], [r.p for r in scored if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert len(good) > 20 and len(bad) > 5 and auc > 0.97 and sum((r.p >= 0.3) == (r.quality == 1) for r in scored) >= 0.93 * len(scored)


def test_quality_of_repeated_labelled_ids(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "sgd", lambda examples, labels, **_: seen.update(n=len(examples)))
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(spark.createDataFrame([(8, None)], "doc_id long, text string"))
    quality.train(rows, spark.createDataFrame([(7, 1), (7, 0), (8, 1)], "doc_id long, quality int"), may_learn=lambda k: F.lit(True))
    assert seen["n"] == 2


def test_quality_learns_from_4096_rows_packed_small(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "sgd", lambda examples, labels, **_: seen.update(examples=examples, labels=labels))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    quality.train(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert len(seen["examples"]) == len(seen["labels"]) == 4096
    texts = [words(random.Random(11), 3000, 900), "", "ß"]
    for at, share in quality.counted(pa.array(texts), 1 << 18):
        data = quality.packed(at, share)
        assert [x.tolist() for x in quality.unpacked(data)] == [at.tolist(), share.tolist()]
        assert len(at) < 1000 or 2 * len(data) < at.nbytes + share.nbytes


# --- 10: mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(10)
    names = ["b", "a", None, "é", "z", "B"]
    texts = [words(rng, rng.randrange(40)) for _ in range(300)] + ODD
    of = lambda i: names[min(len(names) - 1, int(rng.random() ** 2 * 6))] if i % 2 else "a"
    df = docs(spark, texts, of).cache()
    source = {r.doc_id: r.source for r in df.collect()}
    rows = mixing.mix(df, per_bucket=16).collect()
    sizes = {}
    for i, t in enumerate(texts):
        sizes[source[i]] = sizes.get(source[i], 0) + len(spaced(t))
    want = brute_targets(sizes)
    taken = {}
    for r in rows:
        s = source[r.doc_id]
        assert r["size"] == len(spaced(texts[r.doc_id])) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert len(rows) == len(texts) and all(abs(taken[s] - want[s]) < 1.01 for s in sizes)
    assert sorted(map(tuple, mixing.mix(df.repartition(5), per_bucket=1000).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    mixed = mixing.apply_mix(df, per_bucket=16)
    assert mixed.columns == df.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(spaced(r.text))
        assert (texts[r.doc_id] or "").startswith(r.text)
    assert got == {r.doc_id: r.taken for r in rows if r.taken}
    assert mixing.mix(df.filter("false")).count() == 0
    zero = mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).collect()
    assert all(r.taken == 0 and r.target == 0 for r in zero)


def test_mixture_cuts_equal_rows_one_after_another(spark):
    """Rows equal in source, id and text at the cut, null ids, a null source and the operator's own column names."""
    schema = "doc_id long, text string, source string, sw_doc_id string, sw_mix string, sw_size string, rnd string, taken long"
    rows = [(None, "a b c d e", None), *[(5, "v w x y z", "s")] * 40, *[(None, "p q r", "t")] * 30, (7, " k l m ", "t"), (8, None, "t"), (8, "", "s")]
    df = spark.createDataFrame([(*r, "own", "own", "own", "own", 1) for r in rows], schema).repartition(3)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(spaced(t))
    got = {}
    for r in mixing.apply_mix(df, per_bucket=4).collect():
        assert (r.sw_doc_id, r.sw_mix, r.sw_size, r.taken) == ("own", "own", "own", 1) and r.text
        got[r.source] = got.get(r.source, 0) + len(spaced(r.text))
    want = brute_targets(sizes)
    assert got.keys() <= want.keys() and all(abs(got.get(s, 0) - want[s]) < 1.01 for s in want)
