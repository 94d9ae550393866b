"""Periodic runs, source divergence and fingerprints against brute force, with their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from cairn.llm import divergence, fingerprints, periodic, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute_runs(w, least=12):
    out, n = set(), len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least and smallest_period(w[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made_text(r):
    words = r.choice([["a", "b"], ["a", "b", "c"], list("abcdefgh"), ["é", "日本", "x y", " "]])
    out = []
    while len(out) < r.randrange(1, 60):
        part = [r.choice(words) for _ in range(r.randrange(1, 9))]
        out += part * r.randrange(1, 7)
    return r.choice([" ", "\t", "\n \x0b"]).join(out)


def test_extensions_against_plain_comparison():
    r = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 1), (40, 1), (200, 2), (400, 3), (700, 40)):
        w = r.integers(0, kinds, n)
        _, w = np.unique(w, return_inverse=True)
        common = periodic.CommonExtension(w)
        a, b = r.integers(0, n, 300), r.integers(0, n, 300)
        a, b = a[a != b], b[a != b]
        want = [next((k for k in range(n) if max(x, y) + k == n or w[x + k] != w[y + k]), 0) for x, y in zip(a, b)]
        assert len(a) == 0 or common(a, b).tolist() == want


def test_runs_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    texts = [made_text(r) for _ in range(150)] + ["x " * 500, "a b " * 200 + "a", ("u v w x y z " * 30 + "q ") * 3, "one two", "", "  \n\t ", None]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, "a " * 13, 2), (None, "b c " * 7, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    want = Counter()
    for i, t, _ in rows:
        w = WORDS.findall(t or "")
        runs = brute_runs(w)
        want[(i, tuple(runs), brute_collapsed(w, runs))] += 1
    for group, places in ((1 << 17, 1 << 20), (64, 50)):  # in one worker's memory, and in many groups and parts of the grid
        monkeypatch.setattr(periodic, "GROUP", group)
        monkeypatch.setattr(periodic, "PLACES", places)
        batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t, _ in rows])
        got = [x for b in periodic._find(12)(iter([batch])) for x in b.to_pylist()]
        assert Counter((x["doc_id"], tuple((s["start"], s["length"], s["period"]) for s in x["runs"]), x["collapsed"]) for x in got) == want
    got = periodic.find_runs(spark, docs).collect()
    assert Counter((x.doc_id, tuple(tuple(s) for s in x.runs), x.collapsed) for x in got) == want
    assert periodic.find_runs(spark, docs.where("false")).count() == 0


def test_one_very_long_periodic_text(spark):
    unit = [f"w{i}" for i in range(977)]
    w = ["head"] * 5 + unit * 150 + ["tail"]
    x = periodic.find_runs(spark, spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(r) for r in x.runs] == [(5, 977 * 150, 977)]
    assert x.collapsed == " ".join(["head"] * 5 + unit + ["tail"])


def test_planted_periods(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(0, 90)))) for i in range(300)] + [(300, None), (None, "a b c"), (-7, " \n x\ty ")]
    got = {x.doc_id: x.text for x in queries.planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    edited = 0
    for i, text in rows:
        w, h = WORDS.findall(text or ""), zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            assert got[i] == text
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert WORDS.findall(got[i]) == [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        edited += 1
    assert edited > 15


TERMS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least, top):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [w.decode() for w in TERMS.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least]
        groups = {s: c for (l, s), c in counts.items() if l == lang}

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = share(sum(groups.values(), Counter())), {s: share(c) for s, c in groups.items()}
        for s in groups:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s], "term": [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                for rank, (v, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item.decode(), -v, rank))
    return out


def made_documents(r, n):
    vocabulary = ["the", "The", "STRASSE", "straße", "É", "é", "don't", "日本語", "a1b", "x", " ", "z" * 300] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for _ in range(n):
        lang = r.choice(["en", "en", "en", "de", None])
        source = r.choice(["hot", "hot", None, "s1", "s2", "sä", "S"])
        rows.append((lang, source, " ".join(r.choice(vocabulary[: r.choice([5, 40, len(vocabulary)])]) for _ in range(r.randrange(0, 40)))))
    return rows + [("xx", "only", None), ("yy", "a", "1 2 3"), ("yy", "b", "")]


@pytest.mark.parametrize("block,tile", [(1 << 15, 256), (40, 2)])
def test_divergence_against_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = made_documents(random.Random(8), 260)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "lang string, source string, text string, n int").repartition(3)
    got = {(x.lang, x.source, x.part, x.item, x["value"], x["rank"]) for x in divergence.audit(spark, docs, min_docs=12, top=6).collect()}
    assert got == brute_audit(rows, 12, 6)


def test_divergence_without_terms_or_rows(spark):
    docs = spark.createDataFrame([("en", "a", "one two"), ("en", "b", None)], "lang string, source string, text string")
    assert {tuple(x) for x in divergence.audit(spark, docs).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert divergence.audit(spark, docs.where("false")).count() == 0


def test_pair_sums_of_tiles():
    r = np.random.default_rng(4)
    dense = np.where(r.random((9, 30)) < 0.3, r.integers(50, 90, (9, 30)), 0)
    dense[0, :] = np.maximum(dense[0, :], 60)
    dense[5] = 0
    zero = r.integers(1, 70, 9)
    row, col = np.nonzero(dense)
    p = dense[row, col]
    full = np.where(dense == 0, zero[:, None], dense)
    got = {}
    for of in (range(0, 4), range(4, 9)):
        got |= {(a, b): v for a, b, v in zip(*[x.tolist() for x in divergence.pair_sums(row, col, p, zero, of)])}
    assert got == {(a, b): np.abs(full[a] - full[b]).sum() for a in range(9) for b in range(a + 1, 9)}


def test_slices_of_equal_hash_are_told_apart():
    text = b"one two one six ten two one a bb bb a"
    data = np.frombuffer(text, np.uint8)
    starts, ends = divergence.slices(data, np.array([0, 5, len(text)]))  # a cut within "two"
    words = [text[s:e] for s, e in zip(starts, ends)]
    assert words == [b"one", b"t", b"wo"] + text.split()[2:]
    for digest in (lambda b: len(b), lambda b: 7):
        ids, names = divergence.grouped(data, starts, ends, digest)
        assert [names[i] for i in ids] == words and len(set(names)) == len(names)


def shingled(text, k=5):
    w = [x.lower() if x.isascii() else x for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_fingerprints_estimate_similarity():
    r = random.Random(9)
    errors = []
    for n in (1, 3, 8, 30, 120, 700, 4000):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            words = [f"w{r.randrange(10**6)}" for _ in range(n)]
            other = words[: int(n * share)] + [f"v{r.randrange(10**6)}" for _ in range(n - int(n * share))]
            a, b = " ".join(words), " ".join(other)
            x, y = shingled(a), shingled(b)
            prints = fingerprints.fingerprints(pa.array([a, b, a.upper()]))
            assert prints[0] == prints[2]
            errors.append(fingerprints.likenesses(prints[:1], prints[1:2])[0].as_py() - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.1 and abs(np.mean(errors)) < 0.02


def test_densification_is_the_first_filled_bin_of_an_order():
    r = np.random.default_rng(2)
    for filled in (1, 2, 20, 300, 512):
        mask = np.zeros(fingerprints.BINS, bool)
        mask[r.choice(fingerprints.BINS, filled, replace=False)] = True
        want = [b if mask[b] else next(o for o in fingerprints.orders()[b] if mask[o]) for b in range(fingerprints.BINS)]
        assert fingerprints.densified(mask).tolist() == want


def test_edited_texts_against_brute_force(spark):
    r = random.Random(10)
    texts = ["".join(r.choice("aé日 \n") + r.choice(" bcd") for _ in range(r.randrange(0, 120))) for _ in range(90)] + [None, "", "x", "one two three four"]
    rows = [(r.randrange(-10**9, 10**9), t, 0) for t in texts]
    rows += [(rows[0][0], "again", 0), (rows[5][0], rows[5][1], 0), (None, "no id at all, but words enough to cut", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(4)
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter()
    for j, (i, t) in enumerate(ordered):
        after = ordered[(j + 1) % len(ordered)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = fingerprints.fingerprints(pa.array([t, edited, after]))
        near = fingerprints.likenesses(pa.array([a, a]), pa.array([b, c])).to_pylist()
        want[(i, len(t), edited, a.as_py(), b.as_py(), *near)] += 1
    got = Counter(tuple(x) for x in fingerprints.edited_likeness(spark, docs).collect())
    assert got == want
    one = fingerprints.edited_likeness(spark, docs.where("text = 'again'")).first()
    assert one.edited == "again"[:4] + "a" and one.near_next == 1.0
    assert fingerprints.edited_likeness(spark, docs.where("false")).count() == 0
    assert fingerprints.edited_likeness(spark, spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("near_edited", "near_next").distinct().collect() == [Row(1.0, 1.0)]


def test_fingerprints_as_columns(spark):
    texts = [None, "", "one two", "One  two", "a b c d e f g", "a b c d e f h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    prints = fingerprints.fingerprints(pa.array(texts, pa.string()))
    signed = docs.withColumn("f", fingerprints.fingerprint(docs.text))
    assert [x.f for x in signed.orderBy("i").collect()] == prints.to_pylist()
    pairs = signed.alias("a").join(signed.alias("b")).selectExpr("a.i", "b.i AS j", "a.f AS f", "b.f AS g").withColumn("near", fingerprints.likeness("f", "g"))
    for x in pairs.collect():
        assert x.near == fingerprints.likenesses(pa.array([x.f]), pa.array([x.g]))[0].as_py()
        assert (x.near == 1.0) == (shingled(texts[x.i]) == shingled(texts[x.j]))
