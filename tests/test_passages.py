"""Passages of skewed benchmarks against brute force."""

from weftlink.plans import tasks


def test_shared_and_short_passages(spark, tmp_path):
    template = [f"t{i}" for i in range(12)]
    items = {i: [f"same{k}" for k in range(9)] for i in range(25)}  # one text under 25 ids
    items |= {100 + i: [*template, f"own{i}"] for i in range(25)}  # a template in 25 items
    items |= {200: ["three", "short", "words"], 201: ["single"], 202: [], 203: [f"u{i}" for i in range(8)]}
    docs = {1: ["x", *items[0], "y"], 2: ["x", *template, "y"], 3: ["has", "three", "short", "words", "in"], 4: ["a", "single", "one"], 5: ["three", "short"], 6: items[203][:6], 7: [], 8: ["z", *items[103]]}
    text = lambda rows: [(i, " ".join(w)) for i, w in rows.items()]
    spark.createDataFrame(text(docs), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*text(items), (204, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = []
    for d, w in docs.items():
        for i, item in items.items():
            n = min(5, len(item))
            if n and 2 * (nk := len(grams(w, n) & grams(item, n))) >= (of := len(grams(item, n))):
                want.append((d, i, nk, round(nk / of, 6)))
    got = sorted(tuple(r) for r in tasks.passages(spark, str(tmp_path)).collect())
    assert got == sorted(want) and len(want) == 25 + 25 + 1 + 1 + 1 + 25
