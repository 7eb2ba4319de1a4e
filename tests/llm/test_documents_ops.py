"""Operators on documents against brute force, held-out labels, and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlwarden.llm import decontaminate, language, near_dups, pii, toxicity, wavelet, words
from urlwarden.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Odd rows: null and empty texts, null ids, repeated rows, a very long text, other scripts.
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "one two three"), (4, "Ab cd"), (4, "Ab cd"), (5, "x" * 70_000 + " " + "word " * 30_000),
       (6, "日本語 テキスト é"), (7, "\x1c a\x1db  c\n\n d")]


# --- words -------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB éß\t\n\x0b日.", max_size=40)), max_size=6), st.integers(3, 50))
def test_words_as_regex(texts, segment):
    w = words.words_of(texts, segment=segment)
    whole = words.words_of(texts)
    assert (w.hash == whole.hash).all()
    for d, t in enumerate(texts):
        raw = lower(t or "").encode()
        found = [w.buf[a:b].tobytes() for a, b in zip(w.start[w.bounds[d] : w.bounds[d + 1]], w.end[w.bounds[d] : w.bounds[d + 1]])]
        assert found == [x.encode() for x in SPLIT.findall(raw.decode())]
    seen = {}
    for h, a, b in zip(w.hash, w.start, w.end):
        assert seen.setdefault(int(h), w.buf[a:b].tobytes()) == w.buf[a:b].tobytes()


def test_fewer_words_than_a_shingle():
    h = words.words_of(["a b", "a b c d", ""]).hash
    assert len(words.shingle_hashes(h[:2], 4)) == 1 and len(words.shingle_hashes(h[:0], 4)) == 0
    assert words.shingle_hashes(h[:2], 4)[0] != words.shingle_hashes(h[:2], 2)[0]


# --- 1 -----------------------------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.text("abT' .,<|endoftext|>éÀ×÷āŸ\n\t\r \x1c\xa0日1st", max_size=60))
def test_pieces_encode_as_the_whole_text(text):
    e = wavelet.PieceEncoder.of(tokenizer_path())
    assert e.encode(text) == e._ids(text)
    texts = [text, None, "", text[::-1], text.replace("日", "").replace("\xa0", "")]
    assert [x.tobytes() for x in e.encode_batch(texts)] == [e._ids(t or "") for t in texts]


def test_held_pieces_survive_full_slots_and_a_full_cache(monkeypatch):
    """Few slots, so that pieces share them, and a cache that overflows give the ids of whole texts."""
    monkeypatch.setattr(wavelet, "SLOT_BITS", 3)
    e = wavelet.PieceEncoder(tokenizer_path())
    texts = [" ".join(f"word{'abcdefghij'[i % 10]}é{i % 37} and{'xyz'[i % 3]}" for i in range(n)) for n in range(1, 60)]
    want = [e._ids(t) for t in texts]
    for pieces in (10**6, 20):
        monkeypatch.setattr(wavelet, "CACHE_PIECES", pieces)
        for _ in range(2):
            assert [x.tobytes() for i in range(0, 59, 7) for x in e.encode_batch(texts[i : i + 7])] == want
    assert len(e.held) < 500


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=1500), st.integers(0, 3))
def test_wavelet_against_lists(ids, pool):
    ids = [i % (5**pool + 1) for i in ids] if pool else ids
    m = wavelet.WaveletMatrix.build(np.array(ids, dtype=np.uint16))
    assert m.decode().tolist() == ids
    for token in set(ids[:5]) | {7, 70_000}:
        where = [i for i, x in enumerate(ids) if x == token]
        assert m.count(token) == len(where) and m.positions(token) == where
        assert m.rank(token, len(ids) // 2) == sum(i < len(ids) // 2 for i in where)
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]


def test_shards_round_trip(spark, tmp_path):
    docs = table(spark, [*ODD, *[(100 + i, f"some words {i} the end") for i in range(50)]])
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs, path, tokenizer_path(), shard_tokens=64)
    got = sorted(wavelet.decode_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    e, start = wavelet.PieceEncoder(tokenizer_path()), 0
    texts = {}
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        texts.setdefault(i, []).append(t)
    want = Counter()
    for i, ts in texts.items():
        for t in ts:
            ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    the = e.tokenizer.encode(" the", add_special_tokens=False).ids[0]
    counts = {r["token"]: r["n"] for r in wavelet.count_tokens(spark, path, [the, 2]).collect()}
    assert counts[the] == 50 and counts[2] >= len(got)
    places = wavelet.find_token(spark, path, the).collect()
    assert len(places) == 50 and len({r["position"] for r in places}) <= 3


def test_shards_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    wavelet.write_shards(table(spark, []), path, tokenizer_path())
    assert wavelet.decode_documents(spark, path).count() == 0


# --- 2 -----------------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.predict(docs, language.train(docs)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    held = found.where(language.held_out("doc_id") & (F.col("n_chars") > 200)).toPandas()
    assert len(held) > 30 and (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert held["score"].between(0, 1).all()


def test_language_kernel_against_sets():
    texts = ["Ab äb c", "abba", ""]
    flags, letters = language.presences(texts)
    assert letters.tolist() == [True, True, False]
    symbols = [[int(language._symbol_table()[ord(c)]) for c in t] for t in texts]
    for row, s in zip(flags, symbols):
        grams = {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
        assert row.sum() == len(grams)


def test_language_of_odd_rows(spark):
    docs = table(spark, [*ODD, (8, "1234 !!")])
    got = {r["doc_id"]: r for r in language.predict(docs, language.train(docs)).collect()}
    assert len(got) == 9 and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert got[4]["lang_pred"] == "en"
    none = language.train(table(spark, []))
    assert none is None and language.predict(docs, none).where("lang_pred != 'und'").count() == 0


# --- 3 -----------------------------------------------------------------------------------------

def test_toxicity_finds_documents_and_sentences(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n, bad):
        s = [" ".join(rng.choice(vocabulary, 8)) for _ in range(n)]
        for _ in range(bad):
            s[rng.integers(n)] += " " + rng.choice(["vile", "rotten", "foul"])
        return ". ".join(s) + "."

    rows = [(i, prose(int(rng.integers(2, 40)), int(i % 5 == 0) * 2)) for i in range(1200)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r["doc_id"] for r in docs.where(toxicity.held_out("doc_id")).collect()]
    assert len(held) > 200
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.98
    for i in held[:60]:
        told = [rows[i][1][s["start"] : s["end"]] for s in got[i]["sentences"]]
        assert {t for t in told} == {s.strip(" .") for s in rows[i][1].split(".") if re.search("vile|rotten|foul", s)}
    assert set(r["doc_id"] for r in toxicity.keep_clean(docs, labels).collect()) == {i for i in got if not got[i]["predicted"]}


def test_noisy_or_against_sentences(spark):
    p = toxicity.Params()
    slots = toxicity._bags(["bad good worse"], p.bits)[0][:, 0]
    names = dict(zip(slots.tolist(), ["bad", "good", "worse"]))
    slots = np.sort(slots)
    model = toxicity.Model(slots, np.array([1.0, 2.0, 3.0]), -2.0, 0.05)
    text = "Good bad! worse\nplain plain. bad worse bad"
    by_word = {names[s]: x for s, x in zip(slots.tolist(), model.weights)}
    none = 0.95
    for s in re.split(r"[.!?\n|]", text):
        ws = lower(s).split()
        if ws:
            none *= 1 - 1 / (1 + np.exp(-(-2 + sum(by_word.get(x, 0) for x in ws))))
    got = toxicity.Scorer(model, p)([text, None, ""])[0]
    assert got == pytest.approx([1 - none, 0.05, 0.05])


def test_stems_count_where_words_are_longer():
    slots = toxicity._bags(["lowest lowester low"], 20)[0]
    assert (slots[0, 1:3] == slots[1, 1:3]).all() and slots[0, 3] == 0 and slots[1, 3] > 0 and (slots[2, 1:] == 0).all()


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, ODD)
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == len(ODD)
    none = toxicity.train(docs, labels.limit(0))
    assert all(r["score"] < 1e-12 for r in toxicity.score(docs, none).collect())
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


# --- 4 -----------------------------------------------------------------------------------------

def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = SPLIT.findall(lower(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    ids = [i for i, _ in rows]
    group = {i: i for i in ids if i is not None}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(ids[a]), root(ids[b])))
                    group[y] = x
    return {i: root(i) for i in group}, [len(s) for s in sets]


def family(seed=1):
    """Copies, near copies at all distances, and texts that share a passage."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**6, n)]
    rows, base, passage = [], fresh(60), fresh(40)
    for i in range(70):
        text = list(base)
        for j in rng.integers(0, len(text), int(rng.integers(0, 4))):
            text[j] = fresh(1)[0]
        rows.append(text)
    rows += [passage + fresh(int(n)) for n in rng.integers(2, 30, 70)]
    rows += [base] * 20 + [fresh(3), fresh(3)] + [["only", "three", "words"]] * 2
    return [(1000 - 3 * i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    rows = family()
    got = near_dups.near_duplicates(table(spark, rows), near_dups.Params(k=k, block=8)).collect()
    group, sizes = brute_components(rows, k)
    assert {r["doc_id"]: r["component_id"] for r in got} == group
    assert {r["doc_id"]: r["n_shingles"] for r in got} == dict(zip((i for i, _ in rows), sizes))
    kept = near_dups.keep_one(table(spark, rows), near_dups.Params(k=k))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in group.items() if i == c}


def test_near_duplicates_of_odd_rows(spark):
    rows = [*ODD, (20, "a b c d e f"), (21, "q r s t u v"), (22, "a b c d e f"), (22, "q r s t u v")]
    got = near_dups.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    one = {r["doc_id"]: r["component_id"] for r in got}
    assert one[20] == one[21] == one[22] == 20 and one[None] is None and one[1] == 1 and one[4] == 4
    kept = near_dups.keep_one(table(spark, rows))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, None, 4, 5, 6, 7, 20])
    assert kept.columns == table(spark, rows).columns
    assert near_dups.near_duplicates(table(spark, [])).count() == 0 == near_dups.keep_one(table(spark, [])).count()


# --- 7 -----------------------------------------------------------------------------------------

def brute_passages(rows, items, k=5, least=0.8):
    """Best similarity of each document and item over all windows of the item's size."""
    cut = lambda t: re.findall(r"[^\s!-&(-,./:-@\[-^`{-~]+", lower(t))
    shingles = lambda w: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    out = {}
    for i, t in rows:
        doc = shingles(cut(t or ""))
        for j, u in items:
            item = Counter(shingles(cut(u or "")))
            n = sum(item.values())
            for s in range(max(1, len(doc) - n + 1)) if n and doc else []:
                window = Counter(doc[s : s + n])
                similarity = sum((item & window).values()) / sum((item | window).values())
                if similarity >= least:
                    out[i, j] = max(out.get((i, j), 0), similarity)
    return out


def test_passages_against_all_windows(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    items = [(j, " ".join(prose(int(n)))) for j, n in enumerate(rng.integers(3, 90, 25))]
    rows = []
    for i in range(120):
        text = prose(int(rng.integers(0, 200)))
        if i % 2:
            passage = items[int(rng.integers(len(items)))][1].split()
            for _ in range(int(rng.integers(0, 2))):
                passage[int(rng.integers(len(passage)))] = "changed"
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = passage
        rows.append((i, " ".join(text).capitalize() + "."))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "v1 v2 v3 v4 v5 v6"), (0, items[0][1])], "item_id long, text string")
    docs = table(spark, rows)
    got = decontaminate.passages(docs, bench).collect()
    best = {}
    for r in got:
        best[r["doc_id"], r["item_id"]] = max(best.get((r["doc_id"], r["item_id"]), 0), r["similarity"])
    want = brute_passages(rows, items)
    assert best == pytest.approx(want) and len(want) > 30
    exact = next(r for r in got if r["similarity"] == 1 and len(items[r["item_id"]][1]) > 30)
    assert lower(rows[exact["doc_id"]][1][exact["start"] : exact["end"]]).strip(".") == items[exact["item_id"]][1]
    clean = decontaminate.keep_clean(docs, bench).collect()
    assert {r["doc_id"] for r in clean} == {i for i, _ in rows} - {i for i, _ in want}


def test_passages_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word word word word word word"), (2, "one two three")], "item_id long, text string")
    got = decontaminate.passages(table(spark, ODD), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(5, 1), (None, 2)}
    assert decontaminate.passages(table(spark, []), bench).count() == 0
    assert decontaminate.passages(table(spark, ODD), bench.limit(0)).count() == 0
    assert decontaminate.keep_clean(table(spark, ODD), bench.limit(0)).count() == len(ODD)


# --- 9 -----------------------------------------------------------------------------------------

PLAIN = [re.compile(x) for x in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(x * 2 // 10 + x * 2 % 10 for x in d[1::2])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 1 and any(int(x) > 255 for x in m[0].split(".")) or kind == 3 and not 9 <= len(digits) <= 15
                    or kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("a.@-+ 012594()é\n", max_size=60))
def test_base_spans_as_regex(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["4111 1111-1111 1111 and 4111111111111112", "x@y.z@w.v a@b@c.d", "1.2.3.4.5.6.7.8 0001.2.3.256",
                                  "+1 (743) 555-3824, +44 20 7946 0958+1 2", "9" * 5000 + ".1.1.1", "a" * 50_000 + "@b"])
def test_base_spans_by_hand(text):
    if len(text) < 100:
        assert pii.base_spans(text) == plain_spans(text)
    else:
        assert pii.base_spans(text) == []


def test_field_carries_labels_to_repeats(spark):
    text = "Write to anna.berg@mail.example.com now. Ask anna.berg about 555-3824 or +1 (743) 555-3824 today, not 12-34 or annabel."
    spans = pii.base_spans(text)
    model = pii.train(table(spark, [(1, text)]))
    added = pii.added_spans(text, spans, model, pii.Params())
    assert [(text[a:b], pii.KINDS[k]) for a, k, b in added] == [("anna.berg", "email"), ("555-3824", "phone")]
    number = "Call +1 (743) 755-3824 or +17437553824, else 743-755-3824."
    more = pii.added_spans(number, pii.base_spans(number), model, pii.Params())
    assert [(number[a:b], pii.KINDS[k]) for a, k, b in more] == [("743-755-3824", "phone")]
    assert pii.masked(text, spans + added) == "Write to <EMAIL> now. Ask <EMAIL> about <PHONE> or <PHONE> today, not 12-34 or annabel."


def test_messages_are_exact_on_a_chain():
    f = pii.Field([(0, 1, "ab@c"), (2, 3, "12345"), (4, 5, "q9q9q")], [1, -1, -1], [(0, 1)], [(1, 2)])
    rng = np.random.default_rng(2)
    model = pii.Model(rng.normal(size=(pii.LABELS, pii.SHAPES)), 0.7, 1.9)
    got = pii.marginals(f, model, 200)
    own = np.array([pii._shape(w[2]) for w in f.words]) @ model.shape.T
    total = np.zeros((3, pii.LABELS))
    for b in range(pii.LABELS):
        for c in range(pii.LABELS):
            weight = np.exp(own[1, b] + own[2, c] + 0.7 * (b == 1) + 1.9 * (b == c))
            total[1, b] += weight
            total[2, c] += weight
    assert np.allclose(got[1:], total[1:] / total[1:].sum(axis=1, keepdims=True), atol=1e-3)


def test_field_reaches_over_chains_of_links():
    """A word that is like a word like a base word is hidden too; one like neither is not."""
    text = "Write to anna.berg@example.org or anna.berg@intern today, ask anna.berg.intern but not clara.stein."
    spans = pii.base_spans(text)
    f = pii.document_field(text, spans)
    assert [w[2] for w, o in zip(f.words, f.observed) if o < 0] == ["anna.berg@intern", "anna.berg.intern"]
    added = pii.added_spans(text, spans, pii.Model(np.zeros((pii.LABELS, pii.SHAPES)), 0.5, 6.0), pii.Params())
    assert [text[a:b] for a, _, b in added] == ["anna.berg@intern", "anna.berg.intern"]


def test_reached_keys_against_all_rounds():
    rng = np.random.default_rng(4)
    for _ in range(50):
        words = [[str(k) for k in set(rng.integers(0, 30, rng.integers(0, 4)))] for _ in range(25)]
        known, more = {"0", "1"}, True
        while more:
            grown = known.union(*(w for w in words if known.intersection(w)))
            known, more = grown, grown != known
        assert pii.reached(["0", "1"], words) == known


def test_pii_of_odd_rows(spark):
    docs = table(spark, [*ODD, (9, "mail a.b@c.de and a.b@c.de")])
    model = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    assert got[9]["n_email"] == 2 and got[9]["spans"] == "email:5:13,email:18:26"
    assert got[9]["base_sha256"] == hashlib.sha256(b"email:5:13,email:18:26").hexdigest()
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""
    masked = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert masked[9]["text"] == "mail <EMAIL> and <EMAIL>" and masked[9]["n_chars"] == 24 and masked[1]["text"] is None
    assert pii.find(table(spark, []), model).count() == 0
