"""Cases that operators once left out."""

import numpy as np
from pyspark.sql import functions as F

from urlwarden.llm import decontaminate, near_dups, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = []
    for group in range(30):  # near copies by one word, an exact copy in capitals, a text of its own
        words = [f"g{group}w{x}" for x in rng.integers(0, 500, 60)]
        near = [*words[:30], "changed", *words[31:]]
        texts = [" ".join(words), " ".join(near), " ".join(words).upper(), " ".join(f"own{x}" for x in rng.integers(0, 9000, 60))]
        rows += [(group * 10 + i, t, "en", f"s{group}-{i}", 0) for i, t in enumerate(texts)]
        if group < 5:
            rows += [(None, texts[1], "en", f"n{group}", 0), (None, texts[2], "en", None, 0)]
    rows += [(900, "É " * 4 + "eins", "de", "x1", 0), (901, "é  " * 4 + "EINS", "de", "x2", 0), (902, None, None, None, None),
             (903, "", "en", "x3", 0), (None, None, None, None, None), (3, "twice", "en", "x4", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_packing(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and got["n_tokens"].sum() == sum(len((t or "").split()) for _, t, *_ in rows)
    cluster = {int(i): c for i, c, n in zip(got["doc_id"].fillna(-1), got["cluster"], got["n_tokens"]) if n}
    for group in range(30):
        a = group * 10
        assert cluster[a] == cluster[a + 1] == cluster[a + 2] == str(a) and cluster[a + 3] == str(a + 3)
    assert cluster[900] == cluster[901] == "900"
    assert got[got["n_tokens"] == 0]["cluster"].isna().all() and (got["n_tokens"] == 0).sum() == 3
    assert set(got[got["doc_id"].isna() & (got["n_tokens"] > 0)]["cluster"]) == {str(g * 10) for g in range(5)}
    for _, b in got.groupby("bin_id"):
        assert b["cluster"].dropna().is_unique and b["source"].dropna().is_unique
    assert got.groupby("cluster").size().max() == 5


def test_packing_clusters_are_components(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = near_dups.Params()
    want = {r["doc_id"]: str(r["component_id"]) for r in near_dups.near_duplicates(docs, near).where("n_shingles > 0").collect()}
    got = packing.packed(docs, near=near).where("n_tokens > 0")
    assert {r["doc_id"]: r["cluster"] for r in got.collect()} == want
    assert got.groupBy("bin_id", "cluster").count().where(F.col("count") > 1).count() == 0


def test_small_items_are_found_wherever_they_stand():
    rng = np.random.default_rng(13)
    prose = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    items = [(j, prose(5 + j % 8)) for j in range(320)]
    index = decontaminate.Index(items, decontaminate.Params())
    texts = [f"{prose(int(rng.integers(1, 40)))} {t} {prose(int(rng.integers(1, 40)))}" for _, t in items]
    for (j, t), text, found in zip(items, texts, index.matches(texts)):
        assert [(i, s, text[a:b]) for i, s, a, b in found if i == j] == [(j, 1.0, t)]


def test_small_items_in_texts_one_word_short():
    rng = np.random.default_rng(17)
    items = [(j, " ".join(f"v{x}" for x in rng.integers(0, 5000, 6 + j % 6))) for j in range(300)]
    index = decontaminate.Index(items, decontaminate.Params())
    for (j, t), found in zip(items, index.matches([t.rpartition(" ")[0] for _, t in items])):
        n = len(t.split()) - 4
        assert [i for i, *_ in found] == ([j] if (n - 1) / n >= 0.8 else [])
