"""Packing, archives, vectors, URLs, components and the pipeline against brute force."""

import gzip
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from urlwarden.llm import decontaminate, fixity, near_dups, packing, pii, toxicity, url_filter, vector_dups
from urlwarden.llm.components import connected_components
from urlwarden.llm.hnsw import Graph

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- components --------------------------------------------------------------------------------

def test_components_against_search(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)]
    pairs += [(1000, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for start in sorted(near):
        stack = [] if start in want else [start]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += near[x]
    got = connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 5 -----------------------------------------------------------------------------------------

def brute_pack(pieces, capacity):
    """Best fit over all open bins, one by one; of equal rooms the bin filled last."""
    bins, out = [], []
    for row in sorted(pieces, key=lambda r: (-r[2], r[0], r[1])):
        doc, piece, n, source, cluster = row
        fit = [b for b in bins if b["room"] >= n and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            b = min(fit, key=lambda b: (b["room"], -b["at"]))
        else:
            b = {"room": capacity, "s": set(), "c": set(), "name": len(bins)}
            bins.append(b)
        b["at"] = len(out)
        out.append((doc, b["name"], capacity - b["room"]))
        b["room"] -= n
        b["s"].add(source)
        b["c"].add(cluster)
    return out


def test_pack_against_all_bins():
    rng = np.random.default_rng(4)
    for trial in range(12):
        rows = [(i, 0, int(rng.integers(0, 60)), f"s{rng.integers(6)}" if i % 7 else None, f"c{rng.integers(40)}" if i % 3 else None)
                for i in range(150)]
        got = packing.pack(pd.DataFrame(rows, columns=["doc_id", "piece", "n", "source", "cluster"]), 60)
        assert list(zip(got["doc_id"], got["bin"], got["offset"])) == brute_pack(rows, 60)


def test_successor_skips_conflicts():
    rows = [(1, 0, 50, "a", None), (2, 0, 40, "b", None), (3, 0, 10, "a", None), (4, 0, 10, "a", None), (5, 0, 10, None, "x"), (6, 0, 10, None, "x")]
    got = packing.pack(pd.DataFrame(rows, columns=["doc_id", "piece", "n", "source", "cluster"]), 60)
    assert dict(zip(got["doc_id"], got["bin"])) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 1, 6: 0}


def test_rows_of_one_id_fill_many_packs(spark):
    """A third of the rows have one doc_id, a third no doc_id and one text; no pack gets many more than its share."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "some words here" if i % 3 < 2 else f"text {i}", "en", f"s{i % 5}", 10)
            for i in range(6000)]
    got = packing.packed(spark.createDataFrame(rows, DOCS), packing.Params(capacity=256, pack_docs=256)).toPandas()
    assert len(got) == 6000
    assert got["n_tokens"].sum() == sum(len(r[1].split()) for r in rows)
    assert got["bin_id"].str.split(":").str[0].value_counts().max() < 2 * 256


def test_packed_holds_every_token(spark):
    rows = [(i, "w " * (i * 37 % 400), "en", f"s{i % 3}" if i % 4 else None, i) for i in range(300)]
    rows += [(900, "long " * 5000, "en", "s1", None), (901, None, None, None, None), (902, "", "en", "s0", 0), (None, "no id here", "en", "s0", 3),
             (3, "twice", "en", "s0", 1), (3, "twice", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS pack", "2 AS piece", "'x' AS bin", "0 AS words")
    p = packing.Params(capacity=256, pack_docs=64)
    got = packing.packed(docs, p).toPandas()
    want = Counter()
    for r in rows:
        want[r[0]] += len((r[1] or "").split())
    have = {None if pd.isna(k) else k: v for k, v in got.groupby("doc_id", dropna=False)["n_tokens"].sum().items()}
    assert have == dict(want)
    for _, b in got.groupby("bin_id"):
        b = b.sort_values(["slot", "n_tokens"])
        assert b["n_tokens"].sum() <= 256 and (b["slot"].to_numpy() == b["n_tokens"].cumsum().shift(fill_value=0).to_numpy()).all()
        assert b["source"].dropna().is_unique and b["cluster"].dropna().is_unique
    assert (got[got["doc_id"] == 900].sort_values("piece")["first_token"].diff().dropna() == 256).all()
    assert len(got[got["doc_id"] == 3]) == 3
    bins = packing.bins(packing.packed(docs, p)).collect()
    assert sum(len(b["pieces"]) for b in bins) == len(got) and all(b["n_tokens"] <= 256 for b in bins)
    assert packing.packed(docs.limit(0), p).count() == 0


# --- 6 -----------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages(spark, n=200):
    rows = [(i * 3, f"http://h{i}.example/\r\n{i}", f"<p>é{i}\r\n\r\nWARC/1.0\r\n</p>" * (i % 5 + 1)) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (6, "again", ""), (6, "again", "")], PAGES)


def test_archives_without_files(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert fixity.drill(none, lambda record, text: text).collect() == []
    a, b, c = (str(tmp_path / x) for x in "abc")
    fixity.write_archive(pages(spark), a, shard_pages=40)
    fixity.copy_archive(spark, a, b, lambda record, text: None)  # loses every record and so every shard
    lost = fixity.audit(spark, a, b).collect()
    assert {r["kind"] for r in lost} == {"missing"} and len(lost) == pages(spark).count()
    assert {r["kind"] for r in fixity.audit(spark, b, a).collect()} == {"extra"}
    fixity.copy_archive(spark, b, c)
    assert fixity.audit(spark, b, c).collect() == []


def test_copy_of_a_record_without_an_id(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    record = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi"
    fixity._write(spark.createDataFrame([(0, 0, record)], "shard long, pos long, value string"), a)
    fixity.copy_archive(spark, a, b, lambda name, text: text if name == "" else None)
    assert fixity.audit(spark, a, b).collect() == []


def test_archive_holds_the_pages(spark, tmp_path):
    path = str(tmp_path / "a")
    fixity.write_archive(pages(spark), path, shard_pages=16)
    found = Counter()
    for f in tmp_path.glob("a/shard=*/*.gz"):
        data = gzip.decompress(f.read_bytes())
        assert data.startswith(fixity.MAGIC)
        for a, b in fixity.split_records(data):
            head, _, body = data[a : b - 4].partition(b"\r\n\r\n")
            found[head.split(b"<urn:page:")[1].split(b">")[0].decode(), body.decode()] += 1
    assert found == Counter((str(r["page_id"]) if r["page_id"] is not None else "none", r["html"] or "") for r in pages(spark).collect())


@pytest.mark.parametrize("case", ["same", "flip", "header", "lost"])
def test_audit_against_all_records(spark, tmp_path, case):
    def damage(name, text):
        number = int(name.rpartition(":")[2]) if name[-1].isdigit() else -1
        if case == "flip" and number % 60 == 0:
            return text[:-1] + "~"
        if case == "header" and number == 30:
            return text.replace("Content-Length: ", "Content-Length: 9")
        if case == "lost" and number == 303:
            return None
        return text

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    fixity.write_archive(pages(spark), a, shard_pages=40)
    fixity.copy_archive(spark, a, b, damage)
    got = {(r["shard"], r["idx"]): (r["kind"], r["first"], r["last"]) for r in fixity.audit(spark, a, b).collect()}
    read = lambda p: {int(f.parent.name[6:]): gzip.decompress(f.read_bytes()) for f in tmp_path.glob(f"{p}/shard=*/*.gz")}
    want = {}
    one, two = read("a"), read("b")
    for shard in one:
        x, y = fixity.split_records(one[shard]), fixity.split_records(two.get(shard, b""))
        for i in range(max(len(x), len(y))):
            p = one[shard][slice(*x[i])] if i < len(x) else None
            q = two[shard][slice(*y[i])] if i < len(y) else None
            if p != q:
                want[shard, i] = ("missing" if q is None else "extra" if p is None else "damaged", *(x[i] if p is not None else y[i]))
    assert got == want and bool(want) == (case != "same")


def test_tree_is_a_merkle_tree():
    import hashlib

    data = b"".join(b"WARC/1.0\r\nWARC-Record-ID: <r%d>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" % i for i in range(40))
    nodes = fixity.shard_tree(data)
    leaves = [n[4] for n in nodes if n[0] == 0]
    assert len(leaves) == 40 and [n[5] for n in nodes[:2]] == ["r0", "r1"]
    middle = [hashlib.sha256("".join(leaves[i : i + 16]).encode()).hexdigest() for i in (0, 16, 32)]
    assert nodes[-1][:5] == (2, 0, 0, len(data), hashlib.sha256("".join(middle).encode()).hexdigest())


# --- 8 -----------------------------------------------------------------------------------------

def test_graph_recall_in_one_dense_group():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 32))
    x[:400] = x[0] + 0.05 * rng.normal(size=(400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x)
    found = vector_dups.audited(g, x, vector_dups.Params())
    true = [np.flatnonzero(r) for r in x @ x.T >= 0.9]
    assert sum(np.isin(t, f).sum() for t, f in zip(true, found)) >= 0.99 * sum(map(len, true))
    assert all(np.isin(f, t).all() for t, f in zip(true, found))


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + (i % 3) * 0.12 * rng.normal(size=16)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(400, [2 * v for v in rows[0][1]])]
    odd = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None]), (505, [float("inf")] * 16), (506, [1.0, 2.0]),
           (507, [1e300] * 16), (508, [1e-300] * 16), (None, rows[0][1])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS v", "2 AS copies")
    got = {r["vec_id"]: r for r in vector_dups.near_duplicates(table, vector_dups.Params(shards=3)).collect()}
    assert len(got) == len(rows) + len(odd)
    whole = rows + [(507, [1.0] * 16), (508, [1.0] * 16)]
    x = np.array([v for _, v in whole])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [i for i, _ in whole]
    for i, row in zip(ids, near):
        assert got[i]["n_links"] == row.sum() - 1, i
    for start in range(len(ids)):
        seen, stack = {start}, [start]
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    stack.append(int(j))
        assert got[ids[start]]["component_id"] == min(ids[j] for j in seen)
    for i in (500, 501, 502, 503, 504, 505, 506):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None
    assert vector_dups.near_duplicates(table.limit(0)).count() == 0


# --- 10 ----------------------------------------------------------------------------------------

URLS = ["http://a.example.org/es/1", "HTTP://A.Example.ORG/en/12?x=/es/", "https://blog.theand.example.com/fr/9#top", "http://example.com/de/4",
        "http://x.net/en/5", "http://theand.net", "no url", None, "", "http://", "ftp://org?/de/", "http://org/de/", "http://notexample.org/es/",
        "http://com/fr/", "http://xcom/fr/", "http://andthe.net/en/77/", "http://a.b@c.com:80/de/x", "http://é.com/fr/\nx"]


def plain_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_against_plain_code(spark):
    rows = [(i, u, "<script>no such words</script><p>the the and The blog and example</p>") for i, u in enumerate(URLS * 2)]
    table = spark.createDataFrame([*rows, (None, "http://x.net/en/5", None)], PAGES).selectExpr("*", "'h' AS host", "1 AS n", "2 AS words")
    got = url_filter.judge(table).collect()
    assert len(got) == len(rows) + 1
    by_id = {r["page_id"]: r for r in got}
    for i, u, _ in rows:
        host, path, rule, verdict = plain_judge(u)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert by_id[4]["verdict"] == by_id[22]["verdict"] == by_id[None]["verdict"]
    assert by_id[5]["words"] == ["net", "the", "and"] or sorted(by_id[5]["words"]) == ["and", "n", "e", "t", "the"] or set(by_id[5]["words"]) >= {"the", "and"}
    assert url_filter.judge(table.limit(0)).count() == 0


def test_viterbi_against_all_splits():
    p = url_filter.Params()
    counts, total = {"the": 50, "then": 4, "end": 20, "nend": 1, "a": 30, "and": 40, "dand": 1}, 200
    from math import log

    def cost(word):
        return log(counts[word] / total) if word in counts else -log(total) - len(word) * log(p.unseen)

    def every(s):
        return [[]] if not s else [[s[:i], *rest] for i in range(1, len(s) + 1) for rest in every(s[i:])]

    for label in ("thenend", "theandthe", "xthey", "dandand", "a"):
        best = url_filter.best_split(label, counts, total, p)
        assert "".join(best) == label
        assert sum(map(cost, best)) == pytest.approx(max(sum(map(cost, s)) for s in every(label)))


def test_long_words_stay_whole(spark):
    """A counted word of 27 letters, an unseen label of 70 and one of 3,000."""
    word, odd = "internationalisierungswoche", "q" * 70
    urls = [f"http://{word}.net/x", f"http://the{word}.net/x", f"http://{odd}.net/x", f"http://{'the' * 1000}.net/"]
    rows = [(i, u, f"<p>the {word} net</p>") for i, u in enumerate(urls)]
    got = {r["page_id"]: r["words"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert sorted(got[0]) == [word, "net"] and sorted(got[1]) == [word, "net", "the"] and sorted(got[2]) == ["net", odd]
    assert Counter(got[3]) == {"the": 1000, "net": 1}


def test_bayes_against_counts(spark):
    from math import log

    rows = [(1, "http://good.org/x/1", "<p>good bad day</p>"), (2, "http://good.org/x/2", ""), (3, "http://bad.com/de/7", ""),
            (4, "http://badday.net/de/8", ""), (5, "http://goodday.net/x/9", "")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect()}
    allow = Counter("h:good h:org p:x p:#1".split() * 2)
    block = Counter("h:bad h:com p:de p:#1".split())
    for w in list(allow):  # org, com and net are no words of the pages: they split as the model says
        assert allow[w]
    words = {i: [f"h:{w}" for w in got[i]["words"]] for i in got}
    allow = Counter(words[1] + words[2] + ["p:x", "p:#1"] * 2)
    block = Counter(words[3] + ["p:de", "p:#1"])
    size = len(set(allow) | set(block))
    for i, path in ((4, ["p:de", "p:#1"]), (5, ["p:x", "p:#1"])):
        odds = log(1 / 2)
        for t in words[i] + path:
            if t in allow or t in block:
                odds += log((block[t] + 1) / (sum(block.values()) + size)) - log((allow[t] + 1) / (sum(allow.values()) + size))
        assert got[i]["odds"] == pytest.approx(odds) and got[i]["verdict"] == ("block" if odds > 0 else "allow")
    assert {"bad", "day"} <= set(got[4]["words"]) and got[4]["verdict"] == "block" and got[5]["verdict"] == "allow"


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dups", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, sf_dir)
    judged = toxicity.score(docs, toxicity.train(docs, labels))
    assert clean.columns == docs.columns and ids(clean) == ids(judged.where("predicted = 0")) <= ids(docs)
    one = stage["near_dups"](spark, clean, sf_dir)
    assert one.columns == docs.columns and ids(one) == ids(near_dups.near_duplicates(clean).where("kept")) < ids(clean)
    safe = stage["decontamination"](spark, one, sf_dir)
    assert safe.columns == docs.columns and ids(one) - ids(safe) == ids(decontaminate.passages(one, bench)) != set()
    masked = stage["pii"](spark, safe, sf_dir)
    assert masked.columns == docs.columns and ids(masked) == ids(safe)
    assert all(not pii.base_spans(r["text"]) for r in masked.collect())
    assert ids(stage["packing"](spark, masked, sf_dir)) == ids(masked)


def test_stages_of_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "same row", "en", "s", 8), (3, "same row", "en", "s", 8)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOCS)
        for name, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, sf_dir)
        assert docs.count() == (4 if data else 0)
