"""URL lists, nearest neighbours, chat formatting, WARC, the pipeline and the registered SQL."""

import hashlib
import io
import os
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from seekwell.llm import ann, chat, url_lists, warc  # noqa: E402
from seekwell.llm import queries as Q  # noqa: E402
from seekwell.llm.shared import new_folder  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- 2: URL lists


def covers(entry_, host, path):
    whole = host if path is None else f"{host}/{path}"
    return host == entry_ or host.endswith("." + entry_) or whole == entry_ or whole.startswith(entry_ + "/")


def test_lists_as_of_fetch_time(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "b.example.com", "x.b.example.com", "Example.org", "h.net"]
    urls = [f"https://u:p@{rng.choice(hosts)}:8080/{'/'.join(rng.choice('pqr') for _ in range(rng.randrange(4)))}?x#y" for _ in range(150)] + ["http://h.net", "nonsense", None, ""]
    caps = [(i, u, rng.randrange(30)) for i, u in enumerate(urls)]
    entries = ["example.com", "b.example.com", "example.org", "h.net/p", "a.example.com/p/q", "net", "COM"]
    events = [(rng.choice(["l1", "l2"]), rng.choice(entries), rng.choice(["add", "add", "remove"]), rng.randrange(30)) for _ in range(60)] + [("l1", None, "add", 1), ("l1", "net", "add", None)]
    got = {r.page_id: r for r in url_lists.active_entries(spark.createDataFrame(caps + [(500, "http://h.net", None)], "page_id long, url string, fetched int"), spark.createDataFrame(events, "list string, entry string, action string, effective int")).collect()}
    assert len(got) == len(caps) + 1 and got[500].n_active == 0
    for i, u, at in caps:
        host = path = None
        if u and "://" in u:
            rest = u.split("://")[1].split("?")[0]
            host = rest.split("/")[0].split("@")[-1].split(":")[0].lower()
            path = "/".join(s for s in rest.split("/")[1:] if s) or None
        active = set()
        for lst in ("l1", "l2"):
            for e in entries:
                past = [(t, a == "add") for x, y, a, t in events if x == lst and y == e and t is not None and t <= at]
                if past and max(past)[1] and host and covers(e.lower(), host, path):
                    active.add(f"{lst}:{e.lower()}")
        assert (got[i].entries, got[i].n_active, got[i].blocked, got[i].host) == (",".join(sorted(active)), len(active), bool(active), host), (u, at)


def test_lists_keep_the_case_of_paths(spark):
    urls = ["http://h.net/News", "http://H.net/News/x", "http://h.net/news", "http://h.net/News2", "http://h.net"]
    entries = ["H.NET/News", "h.net/news", "h.net/News/X", "NET"]
    caps = spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)], "page_id long, url string, fetched int")
    events = spark.createDataFrame([("l", e, "add", 1) for e in entries], "list string, entry string, action string, effective int")
    got = {r.page_id: r.entries for r in url_lists.active_entries(caps, events).collect()}
    for i, u in enumerate(urls):
        host, _, path = u.split("://")[1].partition("/")
        want = [h.lower() + slash + p for h, slash, p in (e.partition("/") for e in entries) if covers(h.lower() + slash + p, host.lower(), path or None)]
        assert got[i] == ",".join(sorted(f"l:{e}" for e in want)), u


def test_lists_of_nothing(spark):
    caps = spark.createDataFrame([(1, "http://a.b/c", 3)], "page_id long, url string, fetched int")
    events = spark.createDataFrame([], "list string, entry string, action string, effective int")
    assert [r.blocked for r in url_lists.active_entries(caps, events).collect()] == [False]
    assert url_lists.active_entries(caps.filter("false"), events).count() == 0


# --- 3: nearest neighbours


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 16)).astype(np.float32)
    x[100:400] = x[100]  # a third are one vector
    x[401] = 0
    rows = [(i, v.tolist(), 9, "own") for i, v in enumerate(x)] + [(800, None, 9, ""), (801, [1.0, None] + [0.0] * 14, 9, ""), (802, [float("nan")] * 16, 9, ""), (803, [float("inf")] * 16, 9, ""), (804, [1.0, 2.0], 9, ""), (None, x[0].tolist(), 9, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string").repartition(4)
    got = {}
    for r in ann.nearest(df, block=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.array([i for i in range(800) if i != 401])
    d = x.astype(np.float64)
    found = total = 0
    for q in ids[ids % 20 == 0]:
        s = d @ d[q]
        others = ids[ids != q]
        want = others[np.lexsort((others, -s[others].round(12)))][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and len({m[1] for m in mine}) == 20 and q not in {m[1] for m in mine}
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine) and all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        found += len({m[1] for m in mine} & set(want.tolist()))
        total += 20
    assert set(got) == {int(i) for i in ids[ids % 20 == 0]} and found >= 0.9 * total


def test_nearest_keeps_ties_whole(spark):
    """Six thousand rows that all score 0: the least ids win."""
    rng = np.random.default_rng(3)
    x = np.zeros((6000, 8), np.float32)
    x[0, 0] = 1
    x[1:, 1:] = rng.normal(size=(5999, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in ann.nearest(df, query_filter="id = 0", recall=1.0).collect())
    assert got == [(i, i, 0.0) for i in range(1, 21)]
    q, c, score = ann.top(np.ones((2, 3)), np.ones((9, 3)), np.arange(90, 0, -10), 4, np.full(2, -np.inf))
    assert (q.tolist(), c.tolist(), score.tolist()) == ([0] * 4 + [1] * 4, [10, 20, 30, 40] * 2, [3.0] * 8)


def test_queue_opens_leaves_by_margin():
    rng = np.random.default_rng(4)
    f = ann.Forest(rng.normal(size=(500, 8)), 3, 64)
    for q in rng.normal(size=(20, 8)).astype(np.float32):
        order = list(f.queue(q))
        depth = f.depths(q)[order]
        assert sorted(order) == list(range(3 * (f.inner + 1))) and (np.diff(depth[3:]) >= -1e-5).all() and np.isinf(depth[:3]).all()


def test_nearest_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few).collect()) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert ann.nearest(few.filter("false")).count() == 0 and ann.nearest(few.filter("vec_id = 0")).count() == 0


# --- 4: chat


def test_preference_pairs(spark):
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "and?")]
    rows = []
    for side, last in (("chosen", "good"), ("rejected", "bad")):
        rows += [(1, side, i, r, t) for i, (r, t) in enumerate([*turns, ("assistant", last)])]
        rows += [(2, side, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(3, "chosen", 0, None, None), (4, "other", 0, "user", "x"), (None, "chosen", 1, "user", "u")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")
    got = {r.pair_id: r for r in chat.preference_pairs(df).collect()}
    r = got[1]
    assert r.n_prompt_turns == 4 and r.prompt.startswith("<|system|>\nbe kind<|end|>\n") and r.chosen == "<|assistant|>\ngood<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n"
    assert r.chosen_mask == "0:14,1:12" and sum(int(x.split(":")[1]) for x in r.rejected_mask.split(",")) == len(r.rejected)
    assert got[2].n_prompt_turns == 4 and got[2].chosen == got[2].rejected == got[2].chosen_mask == ""
    assert got[3].n_prompt_turns == 0 and got[3].chosen == "<|unknown|>\n<|end|>\n" and got[3].rejected == "" and 4 not in got and got[None].chosen
    assert chat.preference_pairs(df.filter("false")).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, "chosen", 0, "user", "x")], "pair_id long, side string, turn int, role string, text string")
    plan = chat.preference_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


# --- 7: WARC


def test_warc_round_trip(spark):
    big, tied = "x" * 5000, "é" * 500
    pages = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\r\nb c é", "small"), (4, "", "small"), (5, "u", None), (6, "u", ""), (7, "u", tied), (8, "u", tied), (8, "u", tied), (None, "u", big), (9, "u", "<a>\r\n\r\nWARC/1.1\0")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, path int").repartition(3)
    rows = warc.archive_and_read(df).collect()
    best = {big: 2, tied: 8}
    want = []
    for k, u, h in pages:
        data = (h or "").encode()
        ref = best.get(h) if len(data) >= 1000 else None
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if ref is not None and ref != k else "response", ref if ref != k else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == sorted(want, key=repr)
    assert {r.url for r in rows if r.page_id == 3} == {"http://a/%0D%0Ab%20c%20%C3%A9"} and {r.url for r in rows if r.page_id == 2} == {None}
    assert warc.archive_and_read(df.filter("false")).count() == 0


def test_archive_is_validated(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    folder = new_folder(spark, "warc-test")
    listed = warc.write_archives(warc.marked(df), folder, samples=20, max_records=25).collect()
    assert sum(r.records for r in listed) == 60 and all(r.records <= 25 for r in listed)
    data = open(listed[0].path.removeprefix("file://"), "rb").read()
    assert struct.unpack("<I", data[:4])[0] == warc.MAGIC
    records = list(warc.read_archive(io.BytesIO(data)))
    assert len(records) == listed[0].records and all(warc.parse(r)["payload"] for _, r in records)
    for bad in (data[:-5], data[8:], data[:200]):
        with pytest.raises(Exception):
            list(warc.read_archive(io.BytesIO(bad)))
    good = records[0][1]
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: ", b"Content-Length: 1"), (b"<p>", b"<q>"), (b"WARC-Date: ", b"X-Date: ")):
        with pytest.raises(warc.WarcError):
            warc.parse(good.replace(a, b, 1))
    with pytest.raises(warc.WarcError):
        warc.parse(good + good)


# --- registered queries and pipeline


@needs_data
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    res = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols and sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@needs_data
def test_pipeline_stages(spark):
    from tests.llm.test_documents import brute_components, brute_contamination, spaced

    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert sum(q == (i in ids) for i, q in labels.items()) >= 0.95 * len(labels)

    extra = docs.limit(40).union(docs.limit(1)).withColumn("doc_id", F.col("doc_id") + 10000).union(docs).union(docs.limit(2))
    texts = {r.doc_id: r.text for r in extra.collect()}
    order = sorted(texts)
    want = brute_components([texts[i] for i in order], 5)
    got = [r.doc_id for r in step["MinHash near-dedup"](spark, extra, SF).collect()]
    assert sorted(got) == [i for n, i in enumerate(order) if want[n][2]]

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = " ".join(f"filler{i}" for i in range(5000))
    planted = spark.createDataFrame([(70001, f"{long} {items[0][1]} {long}", "en", "s", 0), (70002, long, "en", "s", 0)], docs.schema)
    brute = brute_contamination([texts[i] for i in order], items)
    got = {r.doc_id for r in step["benchmark decontamination"](spark, extra.union(planted), SF).collect()}
    assert got == {i for n, i in enumerate(order) if not brute[n][1]} | {70002}

    mixed = step["mixing sources"](spark, docs, SF)
    assert mixed.columns == docs.columns
    total = sum(len(spaced(r.text)) for r in docs.collect())
    assert abs(sum(len(spaced(r.text)) for r in mixed.collect()) - 1.5 * total) < 25

    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and packed.agg(F.max("n_tokens")).first()[0] <= 2048
    assert all(f(spark, docs.filter("false"), SF).count() == 0 for _, f in corpus_pipeline.STAGES)


@needs_data
def test_stages_handle_odd_rows(spark):
    """Null ids, repeated ids with different texts, null, empty and very long texts, ties, and columns with the stages' own names."""
    names = "sw_row sw_gone sw_n_hit sw_n_words sw_score sw_doc_id sw_part sw_size sw_taken n_hit kept doc rnd size taken class bucket".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    base = " ".join(f"word{i}" for i in range(60))
    near = base + " tail"
    texts = [(1, base), (None, base), (None, near), (None, None), (2, ""), (2, base + " " + " ".join(f"other{i}" for i in range(70))), (3, " ".join(f"q{i % 977}x{i}" for i in range(40000))), (3, near), (None, "alone in the rows"), (4, None), (5, " \t ")]
    df = spark.createDataFrame([(i, t, "en", s, 0, *names) for (i, t), s in zip(texts, ["a", None] * 6)], schema).repartition(3)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        seen[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert all(r.kept == "kept" and r.sw_row == "sw_row" for r in out.collect())
    rest = [t for t in texts if t not in [(1, base), (None, base), (None, near), (3, near)]]
    assert seen["MinHash near-dedup"] == sorted([(1, base), *rest], key=repr)
    assert seen["benchmark decontamination"] == sorted(texts, key=repr)
    assert all(t for _, t in seen["mixing sources"])
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() > 0
