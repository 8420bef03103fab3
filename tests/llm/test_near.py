"""Near-duplicates of texts and vectors, components, and the pipeline, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftlink.llm import decontaminate, graph, hnsw, minhash


def united(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    w = decontaminate.words_of(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows.items()}
    ids = [i for i in rows if sets[i]]
    close = lambda a, b: sum((sets[a] & sets[b]).values()) * 5 >= sum((sets[a] | sets[b]).values()) * 4
    return united(rows, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if close(a, b)])


def variants(n=120, seed=3):
    """A family of copies with more and more changes, an exact family, and strangers."""
    rng = random.Random(seed)
    base = [f"word{rng.randrange(500)}" for _ in range(150)]
    rows, now = {}, list(base)
    for i in range(n):
        if i % 3 == 0:
            now = list(base)
        for _ in range(rng.randrange(4)):
            now[rng.randrange(len(now))] = f"new{rng.randrange(900)}"
        rows[i] = " ".join(now)
    rows |= {1000 + i: "One two three four five six seven." for i in range(20)}
    rows |= {2000 + i: " ".join(f"s{i}x{k}" for k in range(30)) for i in range(30)}
    rows |= {3000: "short text", 3001: "Short, text", 3002: "short", 3003: None, 3004: "", 3005: "!!"}
    return rows


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = united({x for p in links if p[0] != p[1] for x in p}, links)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signatures():
    a = (np.zeros(3, int), np.array([1, 2, 3], "uint64"), np.array([4, 1, 2]))
    b = (np.ones(3, int), np.array([1, 2, 9], "uint64"), np.array([2, 1, 5]))
    sig = minhash.signatures(2, *(np.concatenate(x) for x in zip(a, b)), registers=6000)
    assert abs((sig[0] == sig[1]).mean() - 3 / 12) < 0.025


def test_groups(spark, monkeypatch):
    rows = variants()
    monkeypatch.setattr(minhash, "BLOCK", 16)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows.items()] + [(5, rows[5], "x", 1)], "doc_id bigint, text string, component string, k1 int")
    got = minhash.groups(df).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows) + 1 and {r["doc_id"]: r["group_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got)
    left = [r["doc_id"] for r in minhash.first_of_groups(df).collect()]
    assert sorted(left) == sorted(set(want.values()))
    null = minhash.groups(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in null) == [(0, True), (1, True)]
    assert minhash.groups(df.limit(0)).count() == 0


def test_blocks_of_large_buckets(spark):
    """Copies of a bucket's members stay in proportion to them, and every query meets every member once."""
    df = spark.range(6000).selectExpr("1L AS bucket", "id", "IF(id < 4500, 0L, id) AS component")
    rows = minhash.cross_blocks(df).select("qb", "tb", "id", "query").toPandas()
    assert len(rows) < 5 * 6000
    met = rows[rows["query"]].merge(rows, on=["qb", "tb"])
    assert len(met[["id_x", "id_y"]].drop_duplicates()) == 1500 * 6000
    long = df.filter("id < 3000 OR id >= 5500").withColumn("text", F.repeat(F.lit("x"), 20_000))
    assert minhash.cross_blocks(long, 64).groupBy("qb", "tb").count().agg(F.max("count")).first()[0] < 3 * minhash.BLOCK_TEXT / 20_000


def test_blocks_compare_as_pairs_do():
    texts = [t for t in variants().values() if t and t != "!!"]
    sets, block = minhash.multisets(texts), minhash.Multisets(texts)
    every = np.arange(len(texts))
    for q in every:
        assert block.similar(q, every).tolist() == [minhash.similar(sets[q], s) for s in sets]
    assert block.similar(0, every[:0]).tolist() == []
    values = minhash.signatures(len(texts), *minhash.weighed(*minhash.shingles(*minhash.word_hashes(texts))))
    short = (minhash.mix(values) >> np.uint64(32)).astype("<u4")
    found = minhash.Signatures([x.tobytes() for x in short])
    for q in every:
        same = short == short[q]
        bands = same.reshape(len(texts), minhash.BANDS, minhash.ROWS).all(axis=2)
        for band in (0, 3, 23):
            want = (same.sum(axis=1) >= minhash.AGREE) & bands[:, band] & (bands.argmax(axis=1) == band)
            assert found.near(q, band).tolist() == np.flatnonzero(want).tolist()


def test_groups_of_documents(docs, rows):
    assert {r["doc_id"]: r["group_id"] for r in minhash.groups(docs).collect()} == brute_groups(rows)


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = [rng.normal(size=16) for _ in range(150)]
    x += [x[3] + 0.1 * rng.normal(size=16) for _ in range(40)] + [x[0], 2 * x[0], x[1], -x[1]]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    rows += [(1000 + i, v, "x") for i, v in enumerate(odd)] + [rows[5]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string")
    got = hnsw.linked(df).collect()
    unit = np.array([v / np.linalg.norm(v) for v in x])
    near = unit @ unit.T >= 0.9
    want = united(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near))])
    count = near.sum(axis=1) - 1 + near[:, 5]  # 5 is there twice
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["component_id"] == want[i] and by[i]["n_links"] == count[i] and by[i]["kept"] == (i == want[i]) for i in range(len(x)))
    assert all(by[1000 + i]["n_links"] == 0 and by[1000 + i]["kept"] for i in range(len(odd)))
    assert hnsw.linked(df.limit(0)).count() == 0


def test_vectors_counted(spark, monkeypatch):
    """Hits that are counted and not listed, and classes whose ids are all null."""
    monkeypatch.setattr(hnsw, "LISTED", 3)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    x = [centre + 0.02 * rng.normal(size=16) for _ in range(60)] + [rng.normal(size=16) for _ in range(60)]
    x += [x[70] + 0.05 * rng.normal(size=16), x[70] + 0.05 * rng.normal(size=16)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, x[80].tolist())] * 2 + [(None, rng.normal(size=16).tolist())] * 2 + [(None, (x[0] * 3).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = hnsw.linked(df).collect()
    v = np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows])
    near = v @ v.T >= 0.9
    want = sorted((r[0] if r[0] is not None else -1, int(n) - 1) for r, n in zip(rows, near.sum(axis=1)))
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"]) for r in got) == want
    by = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    assert all(by[i]["component_id"] == 0 for i in range(60)) and by[120]["component_id"] == by[121]["component_id"] == 70
    assert all(r["component_id"] is None and r["kept"] for r in got if r["vec_id"] is None)


def test_vectors_of_many_shards(spark, caplog):
    """Queries ask few of many shards and find their links; a cell over a shard's size is split, other lengths stay apart."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x = np.concatenate([x, x + 0.1 * rng.normal(size=x.shape), x[5] + 0.02 * rng.normal(size=(200, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [1.0, 2.1])]
    with caplog.at_level("INFO", logger=hnsw.LOG.name):
        got = {r["vec_id"]: r for r in hnsw.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), shard=60).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want, count = united(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near))]), near.sum(axis=1) - 1
    assert len(got) == len(rows) and got[5001]["component_id"] == 5000 and got[5000]["n_links"] == 1
    assert all(got[i]["n_links"] <= count[i] for i in range(len(x)))
    assert np.mean([got[i]["n_links"] / count[i] for i in range(len(x)) if count[i]]) >= 0.99
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(x))]) >= 0.98
    said = [r.args[1] for r in caplog.records if r.msg.startswith("beam")]
    assert len(said) == 1 and set(said[0]) == {256} and 1 <= said[0][256] <= 20  # of 54 centres


def test_vectors_of_shards_that_are_not_asked(spark, monkeypatch):
    """Links into shards whose graphs a query doesn't ask are found all the same, listed and counted ones."""
    monkeypatch.setattr(hnsw, "asked_centres", lambda tallies, whole: 1)
    monkeypatch.setattr(hnsw, "LISTED", 3)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(250, 32))
    x = np.concatenate([x, x + 0.25 * rng.normal(size=x.shape), x[5] + 0.25 * rng.normal(size=(100, 32))])
    got = {r["vec_id"]: r for r in hnsw.linked(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), shard=30).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = united(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near))])
    assert all(got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == want[i] for i in range(len(x)))


def test_vectors_of_one_centre_without_graphs(spark, monkeypatch, caplog):
    """Where the audit can't tell what graphs miss, none is asked, and all pairs are compared once, within a centre's shards as well; long lists are counted both ways."""
    monkeypatch.setattr(hnsw, "AUDITED", 300)
    rng = np.random.default_rng(10)
    x = rng.normal(size=(800, 32)) * np.linspace(2, 0.5, 32)
    x = np.concatenate([x, x[:40] + 0.2 * rng.normal(size=(40, 32)), x[7] + 0.25 * rng.normal(size=(150, 32))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, x[7].tolist()), (2001, x[900].tolist())]
    with caplog.at_level("INFO", logger=hnsw.LOG.name):
        got = {r["vec_id"]: r for r in hnsw.linked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), shard=100).collect()}
    x = np.concatenate([x, x[[7, 900]]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    ids = [*range(len(rows) - 2), 2000, 2001]
    want = united(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in ids] == [(int(n) - 1, want[i]) for i, n in zip(ids, near.sum(axis=1))]
    assert [r.args[1] for r in caplog.records if r.msg.startswith("beam")] == [{256: 0}]


def test_products():
    """Bounds miss no pair, whether leading coordinates hold much or little, and hits are those of brute force in both directions."""
    rng = np.random.default_rng(11)
    for scale in (np.ones(64), np.linspace(3, 0.1, 64), np.r_[np.full(2, 9.0), np.ones(62)]):
        x = rng.normal(size=(1500, 64)) * scale
        x = np.concatenate([x, x[:600] + 0.2 * scale * rng.normal(size=(600, 64)), x[9] + 0.1 * scale * rng.normal(size=(90, 64))])
        x = (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(len(x))]
        axes, k = hnsw.leading(x, 0.9)
        a, b = (hnsw.Compared(n, np.arange(len(x))[at], np.ones(at.sum(), int), x[at].tobytes(), axes, k) for n, at in enumerate((np.arange(len(x)) < 900, np.arange(len(x)) >= 900)))
        truth = np.argwhere((a.x @ b.x.T) >= 0.9)
        pairs, counted = set(), {}
        for r in [r for part in hnsw.compared(a, b, 0.9) for r in part.to_pylist()]:
            if r["listed"]:
                pairs |= {(r["id"], r["other"]), (r["other"], r["id"])}
            elif r["m"]:
                counted[r["id"]] = counted.get(r["id"], 0) + r["m"]
        want = np.bincount(np.concatenate([truth[:, 0], truth[:, 1] + 900]), minlength=len(x))
        assert len(truth) > 300 and [counted.get(i, sum(p[0] == i for p in pairs)) for i in range(len(x))] == want.tolist()
        few = sum(len(row) for row, _ in hnsw.products(a, b, 0.9))
        assert few <= 2 * len(truth) + len(a.ids) * len(b.ids) // 100


def test_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype("float32")
    x[1500:] = x[:1500] + 0.15 * rng.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(3000)]
    g, q = hnsw.Graph.build(x), x[:400]
    truth = q @ x.T >= 0.9
    row, node = hnsw.wide(g, q, hnsw.audited_beam(g, q[:200], 0.9), 0.9)
    assert truth[row, node].all() and len(row) >= 0.97 * truth.sum()


def test_audit(monkeypatch):
    """A hot cluster and self-hits don't hide that the links of small groups are missed, and an audit without links doesn't pass."""
    rng = np.random.default_rng(6)
    hot = rng.normal(size=32) + 0.02 * rng.normal(size=(300, 32))
    small = np.repeat(rng.normal(size=(100, 32)), 2, axis=0) + 0.02 * rng.normal(size=(200, 32))
    x = np.concatenate([hot, small]).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, own = hnsw.Graph(x, None, len(x)), [[k] for k in range(len(x))]

    def blind(graph, q, beam, least):  # finds the cluster's links and self-hits, and with wide beams all
        row, node = np.nonzero(q @ graph.x.T >= least)
        at = (node < 300) | (q[row] == graph.x[node]).all(axis=1) | (beam > 100)
        return row[at], node[at]

    monkeypatch.setattr(hnsw, "wide", blind)
    narrow = hnsw.tally(g, x, own, hnsw.BEAM, 0.9)
    assert sum(t[2] for t in narrow) == 300 * 299 + 200 and sum(t[1] for t in narrow) == 500
    assert hnsw.passed(narrow, True) == (False, True)
    assert hnsw.passed(hnsw.tally(g, x, own, 200, 0.9), False) == (True, True)
    assert hnsw.audited_beam(g, x, 0.9) > 100
    assert hnsw.passed([], False) == (True, False) and hnsw.passed([(True, 300, 90000, 300.0)], False) == (True, False)


@pytest.fixture(scope="module")
def stages(spark, sf, docs):
    out, df = [], docs
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, sf)
        df = df.persist()
        out.append({r["doc_id"]: r for r in df.collect()})
    return out


def test_pipeline(stages, rows, spark, sf):
    language, near, bench, personal, tokens = stages
    assert set(language) == set(rows)  # nothing in these documents is in no language
    groups = brute_groups({i: rows[i] for i in language})
    assert set(near) == set(groups.values())
    items = {r["item_id"]: r["text"].lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    gone = set(near) - set(bench)
    assert {i for i in near if any(t in near[i]["text"].lower() for t in items.values())} <= gone and len(gone) < 20
    assert set(personal) == set(bench) == set(tokens)
    assert all("@mail" not in r["text"] and r["n_chars"] == len(r["text"]) for r in personal.values())
    assert all(len(r["ids_sha256"]) == 64 and r["n_tokens"] > 0 for r in tokens.values())


def test_language_stage_rejects(spark, edges, sf):
    train = spark.createDataFrame([(100 + i, "the words of a language that is learned here", "en", "s", 1) for i in range(20)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, edges.select(*corpus_pipeline.COLUMNS).unionByName(train), sf).collect()}
    assert not left & {0, 1, 2, 8, 10} and set(range(100, 120)) <= left


def test_run(spark, edges, sf, tmp_path):
    """The whole pipeline over empty, null, repeated and clashing rows."""
    train = spark.createDataFrame([(100 + i, f"the words of a language that is learned here, text {i} of many others {i * i}", "en", "s", 1, "x", 0.5) for i in range(20)], edges.schema)
    null = spark.createDataFrame([(None, "a text without an id, written in the language that is learned here", None, None, None, None, None)], edges.schema)
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    edges.unionByName(train).unionByName(null).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert None in got and not {0, 1, 2, 10} & set(got) and len(got) == len(set(got)) and 3 in got
    edges.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
