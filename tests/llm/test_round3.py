import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from websilo.llm import fim, ppm, whiten

DOC = "doc_id long, text string, lang string, source string, n_chars long"
MARKS = ("<P>", "<S>", "<M>")


def docs_of(spark, texts, lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOC)


# ---- fill in the middle

def plain_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "\n", "\n\n\n", "a", "a\n", "é\né", "\r\n\r\n", "x<P>y", "<<<S>", "<P", "<\nP>", "<M", "𝄞\n𝄞𝄞", "< P>\n" * 9, "same\ntext", "same\ntext", "\x00\n\x01"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="a\n<PSM>é中𝄞 ", max_size=40)), max_size=8))
def test_units_and_output(texts):
    got = fim.transformed(pa.array(texts, pa.string()), [str(i) for i in range(len(texts))], 7, 100, 50, MARKS)
    assert list(zip(*(x.to_pylist() for x in got))) == [plain_fim(i, t) for i, t in enumerate(texts)]


def test_codes_from_any_lane(monkeypatch):
    data = np.frombuffer(("é中𝄞\n<P<S><M>>\nab" * 50).encode(), np.uint8)
    whole = fim.codes(data, MARKS)
    for window, lanes in ((64, 7), (1000, 1000), (17, 3), (1 << 20, 1)):
        monkeypatch.setattr(fim, "WINDOW", window)
        monkeypatch.setattr(fim, "LANES", lanes)
        assert (fim.codes(data, MARKS) == whole).all()


@pytest.mark.parametrize("rate, spm", [(100, 50), (30, 50), (0, 0), (100, 100)])
def test_fill_in_middle(spark, rate, spm):
    r = random.Random(5)
    texts = [*ODD, "line of text\n" * 90_000, "é" * 1_200_000, *("".join(r.choices("ab \n", k=r.randint(1, 300))) for _ in range(80))]
    df = docs_of(spark, texts).withColumn("n", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    out = fim.fill_in_middle(df, rate=rate, spm=spm)
    assert out.columns == [*df.columns, *fim.NEW]
    again = fim.restored(F.col("output"), F.col("form")).alias("again")
    plain = out.toDF(*df.columns[:5], "clash", "dots", *fim.NEW).select("doc_id", *fim.NEW, again, "clash", "dots").collect()
    assert len(plain) == len(texts)
    for row in plain:
        assert tuple(row[1:6]) == plain_fim(row["doc_id"], texts[row["doc_id"]], 7, rate, spm)
        assert row["again"] == (texts[row["doc_id"]] or "") and (row["clash"], row["dots"]) == ("clash", 1)


def test_fill_in_middle_edges(spark):
    df = docs_of(spark, ["a\nb\n"] * 3).withColumn("doc_id", F.lit(None).cast("long"))
    assert {tuple(r) for r in fim.fill_in_middle(df).select("n", "form", "prefix_chars", "middle_chars", "output").collect()} == {plain_fim(None, "a\nb\n")}
    assert fim.digests(df.limit(0)).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, sentinels=marks).count()


# ---- languages

def counts_of(texts):
    """By order, context and byte."""
    out = [defaultdict(Counter) for _ in range(5)]
    for t in texts:
        b = b"\xff" * 4 + re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode()
        for i in range(4, len(b)):
            for k in range(5):
                out[k][b[i - k : i]][b[i]] += 1
    return out


def plain_bits(counts, text):
    b, total = b"\xff" * 4 + re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode(), 0.0
    for i in range(4, len(b)):
        excluded, p = set(), Fraction(1)
        for k in range(4, -1, -1):
            here = {s: n for s, n in counts[k].get(b[i - k : i], {}).items() if s not in excluded}
            if not here:
                continue
            size = sum(here.values()) + len(here)
            if b[i] in here:
                p *= Fraction(here[b[i]], size)
                break
            p *= Fraction(len(here), size)
            excluded |= set(here)
        else:
            p *= Fraction(1, 256 - len(excluded))
        total -= math.log2(p)
    return total


def spoken(r, letters, n):
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n)).capitalize() + "."


def test_code_lengths(spark, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE", 1 << 7)  # texts lie in several pieces
    r = random.Random(3)
    texts = [spoken(r, "abcdeé", 12) for _ in range(30)] + ["", None, "ZZZ zzz", "\x00\n" * 40]
    model = ppm.learn(spark.createDataFrame([("x", t) for t in texts[:20]] + [("x", None), (None, "q")], "lang string, text string").repartition(3))
    counts = counts_of(texts[:20])
    assert model.languages == ["x"]
    got = model.code_lengths(pa.array(texts, pa.string()))[:, 0] / ppm.UNIT
    assert np.allclose(got, [plain_bits(counts, t) for t in texts], atol=1e-3)
    # the bytes of each context share a probability of one
    for context in (b"abcd", b"\xff\xff\xffa", b"zzzz", b" a", b""):
        base = int.from_bytes(context.rjust(4, b"\xfe"), "big") << 8
        bits = model.trees[0].lengths(np.arange(256, dtype=np.uint64) + np.uint64(base))
        assert math.isclose(np.exp2(-bits).sum(), 1.0, rel_tol=1e-9)


def test_trees_stay_bounded(spark):
    r = random.Random(4)
    df = spark.createDataFrame([("a" if i % 3 else "b", spoken(r, "abcdefghij", 40)) for i in range(60)], "lang string, text string")
    model = ppm.learn(df, entries=400)
    for k in range(5):
        assert sum(len(t.entries[k]) for t in model.trees) <= 400
    for t in model.trees:
        for k in range(1, 5):
            assert np.isin(t.entries[k] & np.uint64((1 << 8 * k) - 1), t.entries[k - 1]).all()
        assert math.isclose(np.exp2(-t.lengths(np.arange(256, dtype=np.uint64) + np.uint64(int.from_bytes(b"abca", "big") << 8))).sum(), 1.0, rel_tol=1e-9)


def test_languages(spark):
    r = random.Random(2)
    speech = {"aa": "abcdeo", "bb": "éèàstu", "cc": "中文字母大小"}
    rows = [(i, spoken(r, speech[k], 20), k) for i, k in enumerate(sorted(speech) * 60)]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    rows += [(i, t, None) for i, t in enumerate([None, "", "12 34 !?", "\n\t", "É", spoken(r, speech["bb"], 30_000)], 1000)]
    rows += [(None, spoken(r, speech["aa"], 9), None)] * 2
    df = spark.createDataFrame([(i, t, k) for i, t, k in rows], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(3)).repartition(4)
    out = ppm.predict_languages(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = defaultdict(list)
    for row in out.collect():
        got[row["doc_id"]].append(tuple(row)[1:])
        assert 0 <= row["score"] <= 1
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0][:2] == (i in held, k) for i, _, k in rows[:180])
    assert [got[i][0][1] for i in range(1000, 1006)] == ["und", "und", "und", "und", "bb", "bb"]
    assert got[None] == [(False, "aa", got[None][0][2])] * 2
    kept = ppm.with_language(df, ppm.learn(df))
    assert kept.columns == [*df.columns, "lang_pred", "score"] and kept.count() == len(rows)
    assert ppm.predict_languages(df.limit(0)).count() == 0
    nothing = ppm.predict_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(x) for x in nothing.select("lang_pred", "score").distinct().collect()} == {("und", 0.0)}


def test_tied_languages(spark):
    df = spark.createDataFrame([(0, "same words", "y"), (1, "same words", "x"), (4, "same words", "x")][:2], "doc_id long, text string, lang string")
    model = ppm.learn(df)
    assert {r["lang_pred"] for r in ppm.with_language(df, model).select("lang_pred").collect()} == {"x"}


# ---- whitening

def plain_whitening(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    off = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in off), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum(a * a for a in r) for r in off], v


@pytest.mark.parametrize("shift", [0.0, 1e9, -3e11])
def test_whitening(spark, shift):
    r = np.random.default_rng(1)
    x = (r.normal(size=(300, 7)) * [9, 5, 3, 2, 1, 0.5, 0.2]).astype(float) + shift * np.array([1, 0, 0, 1, 0, 0, 0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).repartition(5)
    got = whiten.whitened_long(df).toPandas()
    n, deviations, v = plain_whitening(x.tolist())
    e, axes = np.linalg.eigh(v)
    assert (got.n == n).all() and len(got) == 300 * 7
    assert got.drop_duplicates("vec_id").set_index("vec_id").deviation.astype(object).sort_index().tolist() == deviations
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, e[::-1] / np.trace(v), rtol=1e-9)
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / n - np.eye(7)).max() < 1e-8 and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8
    mean = np.array([float(Fraction(sum(math.floor(64 * c) for c in col), n)) for col in x.T.tolist()])
    expected = (np.floor(64 * x) - mean) @ axes[:, ::-1] / np.sqrt(e[::-1])
    assert np.allclose(np.abs(w), np.abs(expected), atol=1e-4 if shift else 1e-8)


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [2.0]), (7, [])]
    got = whiten.whitened_long(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 10 and {r["n"] for r in got} == {5} and sum(r["vec_id"] == 1 for r in got) == 4
    assert whiten.whitened_long(spark.createDataFrame([], kind)).count() == 0
    assert whiten.whitened_long(spark.createDataFrame([(2, None)], kind)).count() == 0
    one = whiten.whitened_long(spark.createDataFrame([(2, [1.0, 2.0, 3.0])] * 2, kind)).collect()
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one} == {(0.0, 0.0, 1.0, 0)}
    wide = whiten.whiten(spark.createDataFrame([(i, [float(i), 2.0e15 * (-1) ** i]) for i in range(4)], "vec_id long, embedding array<double>"))
    deviation = {r["vec_id"]: r["deviation"] for r in wide.collect()}
    x = [(64 * i + 10**6, int(64 * 2e15) * (-1) ** i + 10**6) for i in range(4)]
    assert {i: int(v) for i, v in deviation.items()} == {i: sum((4 * r[j] - sum(q[j] for q in x)) ** 2 for j in range(2)) for i, r in enumerate(x)}
    assert {r["deviation"] for r in whiten.whitened_long(spark.createDataFrame([(i, [2.0e15 * (-1) ** i]) for i in range(4)], "vec_id long, embedding array<double>")).collect()} == {None}


@settings(max_examples=50, deadline=None)
@given(st.integers(-10**30, 10**30))
def test_chinese_remainders(x):
    moduli = whiten.primes(6)
    assert whiten.residues_joined([x % p for p in moduli], moduli) == x


# ---- top inner products of very long vectors

def test_one_long_vector(spark):
    from websilo.llm import topk

    vectors = {0: [1.0, 2.0], 1: [3.0, 1.0], 2: [1e8, 0.0], 20: [2e7, 1.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * c) for c in v] for i, v in vectors.items()}
    want = []
    for q in (0, 20):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert max(abs(w[3]) for w in want) < 2**63
    assert sorted(map(tuple, topk.top_inner_products(df).collect())) == sorted(want)
    with pytest.raises(ValueError):
        topk.top_inner_products(df.union(spark.createDataFrame([(4, [1e9, 0.0])], df.schema))).count()


# ---- toxicity against a plain version

def plain_toxicity(docs, labels, terms, neutral="person", penalty=4.0, ridge=0.02, steps=300, rate=0.1):
    """Scores by text id, computed a row and a word at a time."""
    from websilo.llm.toxicity import word_hash

    words = {i: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs}
    label = {}
    for i, y in labels:
        if y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    train = sorted((i for i in words if i in label), key=str)
    n, t = len(train), sum(label[i] for i in train)
    counts = Counter(w for i in train for w in words[i])
    toxic = Counter(w for i in train if label[i] for w in words[i])
    part = lambda x, of, by: x * math.log(x * n / (of * by)) if x > 0 else 0.0
    gain = {w: part(toxic[w], c, max(t, 1)) + part(c - toxic[w], c, max(n - t, 1)) + part(t - toxic[w], n - c, max(t, 1)) + part(n - c - t + toxic[w], n - c, max(n - t, 1)) for w, c in counts.items() if c >= 5}
    assert len(gain) <= 4096
    names = {w for group in terms for w in group} | {neutral}
    swaps = {a: [b for b in (*group, neutral) if b != a] for group in terms for a in group}
    known = set(gain) | names
    order = sorted(swaps, key=lambda w: int(word_hash([w])[0]))
    rows = [(label[i], words[i] & known) for i in train]
    copies = []
    for k, (_, x) in enumerate(rows):
        mine = [w for w in x if w in swaps]
        copies += [(k, a, b) for a in mine for b in swaps[a]] or [(k, None, order[k % len(order)])]
    w, m, v = ({x: 0.0 for x in [*known, "(bias)"]} for _ in range(3))
    w["(bias)"] = math.log((t + 0.5) / (n - t + 0.5))
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for step in range(1, steps + 1):
        g = {x: ridge * w[x] / n**0.5 if x != "(bias)" else 0.0 for x in w}
        z = [w["(bias)"] + sum(w[x] for x in xs) for _, xs in rows]
        for (y, xs), s in zip(rows, z):
            for x in [*xs, "(bias)"]:
                g[x] += (sigmoid(s) - y) / n
        for k, out, into in copies:
            change = w[into] - (w[out] if out else 0.0)
            off = (sigmoid(z[k] + change) - rows[k][0]) / len(copies)
            for x in [*rows[k][1], "(bias)"]:
                g[x] += off
            g[into] += off + 2 * penalty * change / len(copies)
            if out:
                g[out] -= off + 2 * penalty * change / len(copies)
        for x in w:
            m[x] = 0.9 * m[x] + 0.1 * g[x]
            v[x] = 0.999 * v[x] + 0.001 * g[x] ** 2
            w[x] -= rate * (m[x] / (1 - 0.9**step)) / ((v[x] / (1 - 0.999**step)) ** 0.5 + 1e-8)
    return {i: sigmoid(w["(bias)"] + sum(w[x] for x in xs & known)) for i, xs in words.items()}


def test_toxicity_equals_a_plain_version(spark):
    from websilo.llm import toxicity

    r = random.Random(8)
    terms = (("women", "men"), ("deaf", "blind", "old"))
    texts = []
    for i in range(70):
        bad = i % 3 == 0
        xs = r.choices(["scum", "trash", "vile"] if bad else ["nice", "tea", "walk"], k=2) + r.choices("abcdefg", k=4) + r.choices(["women", "deaf", "old", "q"], k=1)
        texts.append((i, " ".join(xs).title(), int(bad)))
    texts += [(200, None, 0), (201, "", 1), (202, "word " * 5000, 0), (203, "scum women", 1), (203, "scum women", 1)]
    labels = [(i, y) for i, _, y in texts if i % 7] + [(5, 1), (8, None), (9, 7)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string").repartition(3)
    model = toxicity.train(docs.dropDuplicates(["doc_id"]), spark.createDataFrame(labels, "doc_id long, toxic int"), terms=terms)
    got = {x["doc_id"]: x["score"] for x in toxicity.with_scores(docs, model).collect()}
    want = plain_toxicity({i: t for i, t, _ in texts}.items(), labels, terms)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert got[203] > 0.5 > got[202]


def test_a_score_of_a_half_is_toxic(spark):
    from websilo.llm import toxicity

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = toxicity.Model(toxicity.word_hash(["b"]), np.array([-1e-9]), 0.0)
    assert {x["doc_id"]: x["score"] >= 0.5 for x in toxicity.with_scores(docs, model).collect()} == {1: True, 2: False}


def test_scans_without_rows_and_with_other_columns(spark):
    from websilo.llm import licences, urlfilter

    docs = spark.createDataFrame([(1, "MIT License " + "word " * 900_000 + "Apache license", "x", 1.0), (None, None, "y", 2.0), (1, "mit license", None, None)],
                                 "doc_id long, text string, labels string, score double").withColumn("n_words", F.lit("clash"))
    got = sorted(((r["n_words"], r["n_base"], r["base_labels"]) for r in licences.scan_licences(docs).collect()), key=str)
    assert got == sorted([(900_004, 2, "apache,mit"), (0, 0, ""), (2, 1, "mit")], key=str)
    assert licences.scan_licences(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a.example.net/" + "a" * 500_000, "x"), (None, None, "y")], "page_id long, url string, host string").withColumn("verdict", F.lit(3))
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()} == {(1, "net/", "block"), (None, None, "allow")}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
