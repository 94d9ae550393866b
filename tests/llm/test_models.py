import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cairn.llm import chat, contamination, html, language, quality, toxicity
from cairn.llm import queries as Q
from cairn.llm.store import Store, read

SF = "/root/testdata/sf0.01"


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(8, 40)))) for i in range(12)] + [(90, None), (91, "too short"), (92, None), (93, "!!")]
    items.append((50, items[0][1].upper()))
    docs, planted = [], {}
    for d in range(120):
        w = r.choices(vocab, k=60)
        if d % 3 == 0:
            i, text = items[r.randrange(12)]
            own = text.split()
            for _ in range(r.randint(0, int(0.15 * len(own)))):
                own[r.randrange(len(own))] = "zz"
            w[30:30] = own
            planted[d] = i
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (202, items[3][1] + "."), (203, "x " * 3000 + items[4][1])]
    got = {(x.doc_id, x.item_id): x for x in contamination.find_leaks(spark, spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = {i: contamination.words_of(pa.array([t]))[0] for i, t in items[:12]}
    want = {}
    for d, t in docs:
        if not t:
            continue
        h, _ = contamination.words_of(pa.array([t]))
        for i, w in words.items():
            most = int(0.2 * len(w))
            best = min((contamination.edit_distance(h[s : s + len(w)], w, most) for s in range(max(1, len(h) - len(w) + 1))), default=most + 1)
            if best <= most:
                want[d, i] = best
    assert set(want) <= set(got) | set() and len(set(want) - set(got)) == 0
    assert {k: got[k].edits for k in want} == want and set(planted.items()) <= set(got)
    assert contamination.find_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_short_items_and_passes(spark, monkeypatch):
    items = [(5, "lone"), (3, "two words"), (4, "Two, WORDS"), (7, "a b c d"), (8, "one two three four five six seven eight nine ten"), (2, "One two three four five six seven eight nine ten!"), (None, "x")]
    docs = [(1, "the lone wolf"), (2, "two words, two words"), (3, "two other words"), (4, "a b x d a b c d"), (5, "a b c e"), (6, "one two three four five six seven eight nine zzz"), (7, "Lone"), (8, None), (8, "lone lone")]
    docs = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, name string")
    items = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 5, 1, 0), (2, 3, 0, 0), (4, 7, 4, 0), (6, 2, 0, 1), (7, 5, 0, 0), (8, 5, 0, 0)]
    for words in (contamination.PASS_WORDS, 3):
        monkeypatch.setattr(contamination, "PASS_WORDS", words)
        got = contamination.find_leaks(spark, docs, items).collect()
        assert sorted((x.doc_id, x.item_id, x.first_word, x.edits) for x in got) == want
        left = contamination.decontaminate(spark, docs, items)
        assert left.columns == docs.columns and sorted((x.doc_id, x.text is None) for x in left.collect()) == [(3, False), (5, False), (8, True)]


def test_edit_distance():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = (r.integers(0, 4, r.integers(0, 9)).astype(np.uint64) for _ in range(2))
        d = full(a.tolist(), b.tolist())
        assert contamination.edit_distance(a, b, 10) == d
        assert contamination.edit_distance(a, b, 2) == min(d, 3)


def test_language_held_out(spark):
    docs = read(spark, SF, "documents")
    truth = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    rows = Q.op2_language_id(spark, SF).collect()
    held = [x for x in rows if x.held_out]
    assert len(rows) == len(truth) and len(held) > 200
    assert sum(truth[x.doc_id] == x.lang_pred for x in held) / len(held) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é")], "doc_id long, text string")
    got = {x.doc_id: x for x in language.identify(spark, odd, docs.where("doc_id < 200")).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred != "und" and all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language.identify(spark, odd, docs.limit(0)).collect()} == {"und"}


def test_toxicity_is_ordinal(spark):
    r = random.Random(1)
    bad = ["vile", "awful", "rotten"]

    def text(n):
        w = [f"w{r.randrange(500)}" for _ in range(60)]
        for _ in range(n):
            w[r.randrange(60)] = r.choice(bad)
        return " ".join(w)

    rows = [(i, text(g * 3), g) for i, g in enumerate([r.choice([0, 0, 0, 1, 2, 3]) for _ in range(900)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    test = spark.createDataFrame([(10_000 + g, text(g * 3)) for g in range(4)] + [(1, None), (2, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.grade_texts(spark, test, df).collect()}
    s = [got[10_000 + g].severity for g in range(4)]
    assert s == sorted(s) and s[0] < 0.5 and s[3] > 2 and got[10_003].toxic and not got[10_000].toxic and not got[1].toxic and not got[2].toxic
    assert not any(x.toxic for x in toxicity.grade_texts(spark, test, df.where("grade = 0")).collect())


def test_toxicity_on_labels(spark):
    labels = {x.doc_id: x.toxic for x in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    got = {x.doc_id: x.toxic for x in Q.op3_toxicity(spark, "/root/testdata/sf0.1").collect()}
    clean = [got[d] for d, t in labels.items() if not t]
    toxic = [got[d] for d, t in labels.items() if t]
    assert sum(clean) / len(clean) < 0.01 and sum(toxic) / len(toxic) > 0.85


def test_quality(spark):
    labels = {x.doc_id: x.quality for x in read(spark, SF, "labels").collect()}
    rows = {x.doc_id: x for x in Q.op10_quality_classifier(spark, SF).collect()}
    assert sum(rows[d].kept == bool(q) for d, q in labels.items()) / len(labels) > 0.95
    odd = quality.rate(spark, spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string")).collect()
    assert all(x.quality == 0 and not x.kept for x in odd)


ODD = "doc_id long, text string, score double, lang_pred string, quality string, severity int, toxic string, kept string"


def odd_rows(spark):
    """Null, empty, very long, repeated and tied rows under clashing columns."""
    texts = [(1, None), (2, ""), (3, "word and word " * 60_000), (4, "plain words here."), (4, "plain words here."), (None, "plain words here."), (5, "PLAIN!!! *** ###")]
    return spark.createDataFrame([(*t, 0.5, "x", "y", 7, "z", "w") for t in texts], ODD)


def test_learned_operators_on_odd_and_empty_tables(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 0), (5, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    rated = quality.rate(spark, docs)
    assert rated.columns == ["doc_id", "quality", "kept"] and rated.count() == 7 and len({x.quality for x in rated.collect() if x.doc_id in (4, None)}) == 1
    graded = toxicity.grade_texts(spark, docs, toxicity.labelled_texts(docs, labels, "toxic"))
    assert graded.columns == ["doc_id", "severity", "p_toxic", "toxic"] and graded.count() == 7
    kept = toxicity.drop_toxic(spark, docs, toxicity.labelled_texts(docs, labels, "toxic"))
    assert kept.columns == docs.columns
    told = language.identify(spark, docs, docs.selectExpr("doc_id", "text", "'en' AS lang").where("text <> ''"))
    assert told.columns == ["doc_id", "lang_pred", "score"] and sorted(x.lang_pred for x in told.collect()) == ["en"] * 5 + ["und"] * 2
    none = docs.limit(0)
    assert quality.rate(spark, none).count() == 0 and language.identify(spark, none, none.selectExpr("doc_id", "text", "text AS lang")).count() == 0
    assert toxicity.grade_texts(spark, none, toxicity.labelled_texts(none, labels, "toxic")).count() == 0
    assert contamination.decontaminate(spark, none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_language_kernel_is_that_of_sets():
    r = random.Random(4)
    texts = ["".join(r.choice("abcdé ") for _ in range(r.randint(1, 60))) for _ in range(40)]
    grams = [language.features(t) for t in texts]
    sets = [{f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)} for t in texts]
    assert [len(g) for g in grams] == [len(s) for s in sets]
    model = language.Model(["a", "b"] * 20, grams)
    marks = [i for lang in (0, 1) for i in range(lang, 40, 2)][:40]
    want = np.array([[len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])) for j in marks] for i in range(40)])
    assert np.abs(model.kernel(grams) - want).max() < 1e-5


def test_ordinal_is_the_least_of_its_loss():
    r = np.random.default_rng(1)
    x = r.random((400, 5)) < 0.4
    y = np.clip((x @ np.array([2.0, 1.0, 0.0, -1.0, 0.0]) + r.logistic(size=400)).round().astype(int), 0, 3)
    rows, cols = np.nonzero(x)
    fit = toxicity.Ordinal(rows, cols, y, 5)
    weight = np.where(y > 0, toxicity.WEIGHT, 1.0) / np.where(y > 0, toxicity.WEIGHT, 1.0).sum()

    def loss(w, cuts):
        edge = np.concatenate([[-40.0], cuts, [40.0]])
        side = lambda k: 1 / (1 + np.exp(x @ w - edge[k]))
        return -(weight * np.log(side(y + 1) - side(y))).sum() + toxicity.RIDGE * (w @ w) / 2

    least = loss(fit.w, fit.cuts)
    for _ in range(200):
        assert loss(fit.w + 0.1 * r.standard_normal(5), np.sort(fit.cuts + 0.1 * r.standard_normal(3))) > least - 1e-6
    assert (np.diff(fit.cuts) >= 0).all()
    words = [np.array([3, 5, 5, 9], np.uint64), np.array([], np.uint64), np.array([9, 1], np.uint64)]
    model = toxicity.Model(np.array([3, 9], np.uint64), np.array([True, False]), np.array([1, 0, 1, 0]), np.array([0, 1, 2]), np.array([0, 1, 0]))
    model.fit.w = np.array([2.0, 0.5])
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    assert model.score(np.concatenate(words), at).tolist() == [2.5, 0.0, 0.5]


def test_em_finds_accuracies():
    r = np.random.default_rng(2)
    k = len(quality.LABELLERS)
    counts = {}
    for _ in range(6000):
        good = r.random() < 0.8
        fires = np.where(r.random(k) < (0.01 if good else 0.4), 0, 1)
        fires[-1] = 2 if r.random() < (0.9 if good else 0.05) else 1
        p = int(fires @ 3 ** np.arange(k))
        counts[p] = counts.get(p, 0) + 1
    labels = quality.Labels(counts)
    assert abs(labels.prior - 0.8) < 0.05 and labels.table[1, -1, 2] > 0.8 and labels.table[0, -1, 2] < 0.2


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy &amp; save now.</div><article><h1>A &lt;head&gt;</h1><p>First   words\n of it &amp; more.<br>Same block.<p>Second paragraph, of some length, with words.</article><section class="comments"><p>I like it.</p></section><footer>&copy; us</footer><script>var x = "</p>";</script></body></html>'
    df = spark.createDataFrame([(1, "u", page, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = sorted((x.page_id, x.text) for x in html.extract(spark, df).collect())
    want = "A <head>\n\nFirst words of it & more. Same block.\n\nSecond paragraph, of some length, with words."
    assert got == [(1, want), (1, want), (2, ""), (3, "")]


def test_html_labels_unseen_layouts():
    g = html.Generator(4321)
    made = [p for p in (g.page() for _ in range(150)) if p[0]]
    q = html.labeller().label(html.inputs([b for b, _ in made]))
    assert np.mean(np.concatenate([(a >= 0.5) == y for a, (_, y) in zip(q, made, strict=True)])) > 0.97


def test_html_inference_is_the_forward_pass_in_bounded_memory():
    import tracemalloc

    g, net = html.Generator(9), html.Labeller(3)
    x = html.inputs([p[0] for p in (g.page() for _ in range(40)) if p[0]])
    for part in (x[:7], x):
        padded, mask = html._padded(part)
        assert np.abs(net.infer(padded, mask) - net.forward(padded, mask)[0])[mask > 0].max() < 1e-4
    # A page of very many blocks, and one of very deep ones with very many names.
    page = "<body>" + "<p>one two three" * 100_000
    deep = "".join(f'<div class="{"a b c " * 9}d{i}">w{i} ' for i in range(3000))
    tracemalloc.start()
    blocks = [html.Blocks.of(page), html.Blocks.of(deep), html.Blocks.of("")]
    q = net.label(html.inputs(blocks))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(p) for p in q] == [100_000, 3000, 0] and most < 600e6, most


def test_html_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, n_chars string")
    assert html.extract(spark, none).count() == 0


def test_html_gradient():
    net = html.Labeller(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, mask = r.standard_normal((2, 4, 2 * html.PATH + html.WORD + html.MORE)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    y = r.integers(0, 2, (2, 4)).astype(float)

    def loss():
        q, _ = net.forward(x, mask)
        return -((y * np.log(q) + (1 - y) * np.log(1 - q)) * mask).sum() / mask.sum()

    g = net.gradient(x, mask, y)
    for k in ("wf", "wb", "v"):
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-5
        up = loss()
        net.p[k][at] = keep - 1e-5
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4


@pytest.mark.parametrize("text", ["", "plain", "<|end|>\n", "a\\", "\\<|", "</s>[INST] ok [/INST]", "<", "|>\nx", "<\\|"])
def test_escape_round_trip(text):
    out = "".join(t for t, _ in chat.compile_template(chat.TEMPLATE)([{"role": "user", "text": text}, {"role": "assistant", "text": text}]))
    assert list(chat.read_back(out)) == [("user", text), ("assistant", text)]
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_templates():
    def render(source, **scope):
        return "".join(t for t, _ in chat._emit(chat.fold_body(chat.parse(source)))(scope, False))

    assert render("{% if not false and 'a' == 'a' %}x{% else %}y{% endif %}{{ 'a' ~ 1 | upper }}") == "xa1"
    assert chat.fold_body(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}n{% elif true %}d{% endif %}e")) == [("text", "abcde")]
    assert render("{% for m in xs %}{{ m.a }}{% if loop.first %}!{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2}]) == "1!2"
    for bad in ("{% for %}", "{% if x %}", "{{ x | nope }}", "{{ (x }}", "{% what %}", "{{ f() }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 40)
    rows = [(1, 1, "assistant", "b" * 30, 1), (1, 0, "user", "a", 1), (1, 2, "assistant", None, 1), (1, 3, "assistant", "d<|e", 1), (2, 0, None, None, 1), (None, 0, "user", "x", 1), (3, 0, "user", "t", 1), (3, 0, "user", "t", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    formatted = chat.format_conversations(spark, df)
    assert formatted.where("conv_id = 1").count() > 1
    got = {x.conv_id: x for x in chat.digests(formatted).collect()}

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    one = [("user", "a"), ("assistant", "b" * 30), ("assistant", ""), ("assistant", "d<|e")]
    assert got[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in one)) and got[1].loss_sha256 == sha("b" * 30 + "d<|e") and got[1].loss_chars == 34
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1 and got[3].n_turns == 2
    assert chat.digests(chat.format_conversations(spark, df.limit(0))).count() == 0


def test_pipeline(spark):
    store, docs = Store(spark, "test"), read(spark, SF, "documents")
    names = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.put(stage(spark, docs, SF), name.replace(" ", "-"))
        seen.append(docs.count())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == names
    assert seen[0] > seen[1] == seen[2] > seen[3] > seen[4] > 0.6 * seen[0]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    r = random.Random(3)
    names = "doc_id long, text string, lang string, source string, n_chars long"
    words = [f"w{i}" for i in range(300)]
    item = " ".join(r.choices(words, k=20))
    copy = " ".join(r.choices(words, k=200))
    line = "a line that many documents share, long enough to count"
    texts = {i: " ".join(r.choices(words, k=80)) + f"\n{line}" for i in range(10, 20)}
    texts |= {1: None, 2: "", 3: copy, 4: copy, 5: copy + " more", 6: f"{item} at its start", 7: "short"}
    rows = [(i, t, None, "s", len(t or "")) for i, t in texts.items()] + [(None, "no id", None, None, None)]
    for case, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, names).write.parquet(f"{tmp_path}/{case}/documents.parquet")
        spark.createDataFrame([(i, 0, 0) for i in (3, 10, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{case}/labels.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/{case}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted({x.doc_id for x in out if x.doc_id is not None}) == sorted(set(texts) - {4, 5, 6})
    assert sum(x.doc_id is None for x in out) == 1 and len({x.sequence_id for x in out}) == -(-sum(x.length for x in out) // 2048)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
