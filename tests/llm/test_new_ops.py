"""Periodic runs, chat formatting and divergence of sources against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlwarden.llm import chat, divergence, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 ----------------------------------------------------------------------------------------

def brute_runs(words, least=24):
    """Every maximal stretch of every period, the smallest period of each."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    t = np.array([names[w] for w in words])
    found = {}
    for q in range(1, len(t) // 3 + 1):
        same = np.concatenate(([False], t[q:] == t[:-q], [False])).astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[0::2], edge[1::2]):
            length = int(b - a) + q
            if length >= max(least, 3 * q):
                found.setdefault((int(a), length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def words_with_runs(rng, n):
    """Prose of few words with stretches that repeat, some inside others."""
    out = []
    while len(out) < n:
        unit = [f"w{x}" for x in rng.integers(0, 6, int(rng.integers(1, 1 + max(1, n // 8))))]
        if rng.random() < 0.3:
            unit = unit[: max(1, len(unit) // 4)] * 4
        out += unit * int(rng.integers(1, 6)) + unit[: int(rng.integers(0, len(unit) + 1))]
        out += [f"w{x}" for x in rng.integers(0, 2000, int(rng.integers(0, 9)))]
    return out[:n]


def tiled_runs(docs):
    numbers = periodic.number_words([" ".join(d).encode() for d in docs])
    out = []
    for tiles in periodic.tiles_of(numbers, 24):
        parts = defaultdict(list)
        for tile in tiles:
            for q, a, b in periodic.fragments_of(tile):
                parts[q].append((a, b))
        runs = []
        for q, own in parts.items():
            own.sort()
            a, b = own[0]
            for c, d in own[1:]:
                if b - c >= q:
                    b = max(b, d)
                else:
                    runs.append((a, b - a, q))
                    a, b = c, d
            runs.append((a, b - a, q))
        out.append(sorted((s, n, q) for s, n, q in runs if n >= max(24, 3 * q)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tiles_find_all_runs(seed):
    rng = np.random.default_rng(seed)
    docs = [words_with_runs(rng, int(rng.integers(0, 60 if i % 2 else 900))) for i in range(60)]
    docs += [["a"] * 300, ["a", "b"] * 200, [], ["x"] * 23, ["x"] * 24, (["a"] * 5 + ["b"]) * 50, ["a"] * 100 + ["b"] + ["a"] * 100]
    assert tiled_runs(docs) == [brute_runs(d) for d in docs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=120), max_size=4))
def test_tiles_on_two_words(docs):
    assert tiled_runs(docs) == [brute_runs(d) for d in docs]


def test_small_periods_fill_one_octave():
    tiles = periodic.tiles_of(periodic.number_words([b"a b c " * 5000]), 24)[0]
    assert {t.octave for t in tiles} == {periodic.GRAM}
    assert sum(len(t.words) for t in tiles) < 2 * 15000


def test_z_function():
    rng = np.random.default_rng(2)
    for _ in range(50):
        w = rng.integers(0, 2, int(rng.integers(1, 40))).tolist()
        want = [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(1, len(w))]
        assert periodic.z_function(w, len(w))[1:] == want


def test_runs_of_all_kinds_of_documents(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(words_with_runs(rng, int(rng.integers(1, 700)))), "en", "s", 0) for i in range(150)]
    rows += [(900 + i, text, None, None, None) for i, text in enumerate((
        None, "", " \n\t", "one", "Ä ä " * 30, "A a " * 30, "a b\x1cc " * 40, "x\v\f\ry " * 30, "same " * 4000))]
    rows += [(7, "twice " * 30, "en", "s", 0)] * 40 + [(None, "b c " * 40, "en", "s", 0), (None, None, "en", "s", 0)]
    rows += [(950, " ".join(words_with_runs(rng, 9000)), "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("k")).withColumn("words", F.lit(1)).repartition(5)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted((brute_row(r[0], r[1]) for r in rows), key=order)


def test_runs_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert got == {d["doc_id"]: brute_row(d["doc_id"], d["text"]) for d in docs}
    assert sum(r[1] > 0 for r in got.values()) > len(docs) // 20


def test_no_documents(spark):
    assert periodic.collapse(spark.createDataFrame([], DOCS)).collect() == []


# --- 12 ----------------------------------------------------------------------------------------

ODD = ["", "\\", "\\\\", "[INST]", "[\\INST]", "[\\\\INST]", "</s>", "<\\/s>", "</s", "[ROLE]x[/ROLE]", "[[INST]]", "</s></s>",
       "a</s>[INST] ok [/INST]", "\\[INST]\\", "[SYS]\n[/INST]", "é\U0001F600</s>", "[", "<", "[/ROLE]"]
ROLES = ["system", "user", "assistant", "tool", "", "[/ROLE]", "us\\er", "</s>"]


def brute_valid(roles):
    state, fault = "begin", None
    moves = {(s, r): to for s, r, to in chat.Template().moves}
    for i, r in enumerate(roles):
        if (state, r) in moves:
            state = moves[state, r]
        elif fault is None:
            fault = i
    return fault is None and state in ("asked", "answered"), fault


def test_chats_come_back(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for c in range(200):
        turns = [(str(rng.choice(ROLES[:3] if c % 2 else ROLES)), "".join(rng.choice(ODD, int(rng.integers(0, 5)))))
                 for _ in range(int(rng.integers(1, 9)))]
        if c % 3 == 0:
            turns = [(("user", "assistant")[i % 2], t) for i, (_, t) in enumerate(turns)]
        want[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    for r in chat.read_chats(chat.format_chats(df)).collect():
        turns = want[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns and r["n_turns"] == len(turns)
        assert r["learnt"] == [t for role, t in turns if role == "assistant"]
        assert (r["valid"], r["fault"]) == brute_valid([role for role, _ in turns])
        assert sum(r["formatted"].count(m) for m in chat.Template().marks) == sum(
            2 if role in ("system", "user", "assistant") else 3 for role, _ in turns)


def test_chats_with_nulls_ties_and_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", None), (1, 0, None, "x"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"),
            (None, 0, "user", "free"), (None, 1, "assistant", None), (3, 0, "assistant", "long " * 50000)]
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    turns = {c: [tuple(t) for t in r["turns"]] for c, r in got.items()}
    assert turns == {1: [("user", ""), ("", "x")], 2: [("user", "a"), ("user", "a"), ("user", "b")],
                     None: [("user", "free"), ("assistant", "")], 3: [("assistant", "long " * 50000)]}
    assert (got[2]["valid"], got[2]["fault"]) == (False, 1) and got[None]["valid"]
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_other_templates(spark):
    t = chat.Template(opens=(("user", "<|u|>"), ("assistant", "<|a|>")), other=("<|r|>", "<|t|>"), close="<|end|>",
                      moves=(("begin", "user", "asked"), ("asked", "assistant", "done")), ends=("done",))
    df = spark.createDataFrame([(1, 0, "user", "<|a|>"), (1, 1, "assistant", "<\\|end|>"), (2, 0, "user", "")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df, t), t).collect()}
    assert got[1]["formatted"] == "<|u|><\\|a|><|end|><|a|><\\\\|end|><|end|>"
    assert [tuple(x) for x in got[1]["turns"]] == [("user", "<|a|>"), ("assistant", "<\\|end|>")]
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["fault"] is None
    for bad in ({"close": "a\\b"}, {"close": "["}, {"close": "[INST]x"}, {"close": "x[y"}):
        with pytest.raises(ValueError):
            chat.check_template(chat.Template(**bad))


def test_chat_query_has_no_python_in_its_plan(spark, sf_dir):
    got = queries.op12_chat_format(spark, sf_dir)
    row = got.where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(text), sha(text))
    assert row["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n") and row["valid"]
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    for df in (got, chat.format_chats(turns)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# --- 13 ----------------------------------------------------------------------------------------

def brute_audit(rows, min_docs=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        found = Counter(term.findall((text or "").translate(lower)))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = sorted((-sum(map(f, p[s], p[o])), o) for o in groups if o != s)
            terms = sorted((-f(a, b), t) for t, a, b in zip(kept, p[s], q) if groups[s][t] and a > b)[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_terms_are_those_of_the_pattern():
    rng = np.random.default_rng(1)
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _ in range(300):
        text = "".join(map(chr, rng.choice([*range(0, 0x180), 0x2028, 0x3000, 0x1F600], 60)))
        assert [t.decode() for t in divergence.terms_of(text.encode())] == pattern.findall(text.translate(lower))


def test_smoothed_is_exact():
    rng = np.random.default_rng(8)
    total = rng.integers(2, 1 << 53, 2000)
    count = (rng.random(2000) * (total - 1)).astype(np.int64)
    want = [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total)]
    assert divergence.smoothed(count, total).tolist() == want


def odd_documents(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(900):
        lang = [None, "", "en", "de", "few"][int(rng.choice(5, p=[0.05, 0.05, 0.5, 0.38, 0.02]))]
        source = [None, "", "a", "Z", "é", "lone"][int(rng.choice(6, p=[0.1, 0.1, 0.4, 0.2, 0.195, 0.005]))]
        words = [f"{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.zipf(1.5, int(rng.integers(0, 40))) % 300]
        text = " ".join(w.upper() if rng.random() < 0.2 else w for w in words) + " é1Ü_x"
        rows.append((i if i % 50 else None, [None, "", "12 34"][i % 3] if i % 19 == 0 else text, lang, source, 0))
    return rows + rows[:60] + [(5, "word " * 40000, "en", "a", 0), (6, "alone", "one", "only", 0), (7, None, "no", "t1", 0), (8, "", "no", "t2", 0)]


@pytest.mark.parametrize("params", [divergence.Params(), divergence.Params(min_docs=3, top=4, held=50, block=100)])
def test_audit_against_plain_counts(spark, params):
    rows = odd_documents(4)
    docs = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("x")).withColumn("block", F.lit(1)).repartition(7)
    got = sorted(map(tuple, divergence.audit(docs, params).collect()))
    assert got == brute_audit(rows, params.min_docs, params.top)
    assert ("no", "t1", "pair", "t2", 0, 1) in got and not any(r[0] == "one" and r[2] == "pair" for r in got)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
