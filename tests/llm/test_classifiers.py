import zlib

import numpy as np
import pytest

from strandline.llm import langid, queries, toxicity
from strandline.llm.convnet import TextConv

from .odd import no_docs, odd_docs

D = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_gradients_match_differences():
    net = TextConv([20], 3, (1, 2), 4, [2], seed=3)
    for t in net.tables:
        t += 0.0
    r = np.random.default_rng(0)
    texts, classes = [r.integers(0, 20, (n, 1)) for n in (5, 9, 3)], np.array([[0], [1], [1]])

    def loss():
        ids = np.full((3, 9 + net.reach, 1), 20)
        for i, s in enumerate(texts):
            ids[i, : len(s)] = s
        z = net.logits(net._pooled(ids, np.array([5, 9, 3]))[0])[0].astype(float)
        return -np.mean([z[i, c] - np.log(np.exp(z[i]).sum()) for i, c in enumerate(classes[:, 0])])

    grads, tables = net._gradients(texts, classes, [1.0], 0.0, r)
    for p, g in [(net.kernels[1], grads[1]), (net.heads[0], grads[3]), (net.tables[0], None)]:
        at = (0, 0, 1) if p.ndim == 3 else (int(tables[0][0][0]), 1) if g is None else (1, 1)
        want = tables[0][1][0, 1] if g is None else g[at]
        was = p[at]
        p[at] = was + 1e-2
        up = loss()
        p[at] = was - 1e-2
        down = loss()
        p[at] = was
        assert abs((up - down) / 2e-2 - want) < 2e-2


def test_toxicity_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op8_toxicity(spark, D).collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{D}/labels.parquet").collect() if held(r.doc_id)]
    hit = sum(rows[r.doc_id].predicted and r.toxic for r in labels)
    assert hit / sum(r.toxic for r in labels) > 0.7 and hit / sum(rows[r.doc_id].predicted for r in labels) > 0.9


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op7_language_id(spark, d).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) / len(own) > 0.95


def test_odd_rows(spark):
    docs = odd_docs(spark, ["12 34 !?"])
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 9 and all(0 <= r.toxicity <= 1 for r in rows) and rows[0].score == "q"
    rows = langid.predict(docs, langid.fit(docs)).collect()
    assert len(rows) == 9
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 100))
        assert r.lang_pred in ("und", "en", "fr", "de") and (r.lang_score > 0) == (r.lang_pred != "und")
    empty = no_docs(spark)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_scoring_in_a_batch_equals_scoring_alone():
    net = TextConv([1 << 10] * toxicity.TABLES, 4, (1, 2, 3), 4, [2, 1])
    model = toxicity.Model(net, 10, np.array([0.5]), 0.1)
    texts = [b"", b"one", b"two words here and more", b"x" * 50, "déjà VU".encode(), b" "]
    together = model.scores(*toxicity._words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 10))
    alone = [model.scores(*toxicity._words(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 10))[0] for t in texts]
    assert np.allclose(together, alone)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_windows_hold_the_whole_text(n):
    data = np.arange(n, dtype=np.uint8) | 32
    windows, counts = langid.cut(data, np.array([0, n]), 128)
    assert counts.tolist() == [-(-n // 128)] and (windows.ravel()[:n] == langid.LOWER[data]).all() and (windows.ravel()[n:] == 32).all()


def test_long_texts_are_learned_from_whole(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "kind ") * (1600 + i), "en") for i in range(60)] * 2, "doc_id long, text string, lang string")
    known = toxicity.labelled_ids(spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"), key="doc_id", label="toxic")
    names = {"text": "text", "key": "doc_id", "lang": "lang"}

    def words(how):
        rows = toxicity.sample(docs, known, known.count(), how, **names)[0].collect()
        return sorted(len(r.words) // 4 // toxicity.TABLES for r in rows)

    assert words(toxicity.Fit(hold=10**9)) == [1600 + i for i in range(60) if not held(i)]
    few = words(toxicity.Fit(documents=100, words=100, hold=10**9))
    assert len(few) in (5, 6) and min(few) >= 1600 and sum(few) <= 10_000
    assert 20 < len(words(toxicity.Fit())) < 40  # a fifth is left out


def test_pooling_equals_the_plain_convolution():
    """Scoring's running maxima and training's parts against a loop over every window."""
    r = np.random.default_rng(8)
    net = TextConv([30] * toxicity.TABLES, 3, (1, 2, 3), 5, [2, 2], seed=2)
    texts = [r.integers(0, 31, (n, toxicity.TABLES)).astype(np.int32) for n in (0, 1, 2, 3, 40, 41)]

    def plain(s):
        rows = np.concatenate([s, np.full((3, toxicity.TABLES), 30)])
        e = np.concatenate([t[rows[:, i]] for i, t in enumerate(net.tables)], 1)
        return np.concatenate([np.max([sum(e[at + j] @ k[j] for j in range(w)) for at in range(max(1, len(s)))], 0) for w, k in zip(net.widths, net.kernels)])

    want = np.array([plain(s) for s in texts])
    model = toxicity.Model(net, 5, np.array([0.5]), 0.1)
    assert np.allclose(model.pooled(np.concatenate(texts), np.array([len(s) for s in texts])), want, atol=1e-5)
    long, toxicity.LONG = toxicity.LONG, 7
    try:
        assert np.allclose(model.pooled(np.concatenate(texts), np.array([len(s) for s in texts])), want, atol=1e-5)
    finally:
        toxicity.LONG = long
    whole = net._pooled_in_parts(texts)
    assert np.allclose(whole[0], want, atol=1e-5)
    from strandline.llm import convnet

    cells, convnet.CELLS = convnet.CELLS, 8
    try:
        parts = net._pooled_in_parts(texts)
    finally:
        convnet.CELLS = cells
    assert np.allclose(parts[0], whole[0]) and all(np.allclose(x[0], y[0]) and (x[1] == y[1]).all() for a, b in zip(parts[1], whole[1]) for x, y in zip(a, b))


def test_threshold_has_the_best_f1():
    r = np.random.default_rng(3)
    for _ in range(20):
        clean, toxic = r.poisson(1, 50) * (r.random(50) < 0.5), r.poisson(1, 50) * (r.random(50) < 0.5)
        clean[0], toxic[-1] = 3, 1
        t, f1 = toxicity.best_threshold(clean, toxic)

        def f1_at(t):
            hit, wrong = toxic[np.arange(50) >= t * 50 - 1e-9].sum(), clean[np.arange(50) >= t * 50 - 1e-9].sum()
            return 2 * hit / (hit + wrong + toxic.sum())

        assert abs(f1 - max(f1_at(k / 50) for k in range(51))) < 1e-9
        assert 0.05 <= t <= 0.95 and (t in (0.05, 0.95) or abs(f1_at(t) - f1) < 1e-9)


def test_thresholds_by_language_count_all_labelled_rows(spark):
    """Two languages whose raw scores part at different places, and a third with too few toxic rows."""

    class Net:
        def probabilities(self, words, counts):
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            return (words[first + 1, 0] % 997) / 1000, words[first, 0] % 3

    def word(want, mod):
        return next(w for w in (f"v{i}" for i in range(100_000)) if toxicity._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), 17)[0][0, 0] % mod == want)

    langs = [word(k, 3) for k in range(3)]
    rows, ids = [], iter(i for i in range(10_000) if not held(i))
    for k, (low, high) in enumerate([(200, 400), (600, 800), (100, 900)]):
        for p, y, n in ((low, 0, 40), (high, 1, 3 if k == 2 else 20)):
            rows += [(next(ids), f"{langs[k]} {word(p, 997)}", y) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    known = toxicity.labelled_ids(docs, key="doc_id", label="toxic")
    got = []
    for sent in (1 << 20, 0):
        model = toxicity.Model(None, 17, np.full(3, 0.5), 0.1)
        model.probabilities = Net().probabilities
        best = toxicity.calibrated([model], docs, known, len(rows), -1.0, toxicity.Fit(sent=sent), text="text", key="doc_id")
        got.append(best.thresholds.tolist())
    assert got[0] == got[1] and 0.2 < got[0][0] < 0.4 and 0.6 < got[0][1] < 0.8


def test_clashing_names_in_any_case(spark):
    docs = spark.createDataFrame([(1, "some words here", "en", 5, 6, 7)], "doc_id long, text string, lang string, Toxicity int, Lang_Pred int, Body int")
    rows = toxicity.score(docs, toxicity.Model(None, 17, np.array([0.7]), 0.25))
    assert rows.select("toxicity").first()[0] == 0.25 and len(rows.columns) == 6
    assert langid.predict(docs, langid.Constant(["en"], 128)).select("lang_pred").first()[0] == "en"


def test_byte_pair_tables_equal_the_plain_convolution(spark):
    """The prediction of a text against the trained net's filters, window by window."""
    r = np.random.default_rng(12)
    net = TextConv([256], 5, langid.WIDTHS, 6, [3], seed=4)
    net.bias += r.normal(0, 0.2, len(net.bias)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], net, 32)
    for n in (1, 5, 32, 33, 100, 700):
        data = r.integers(32, 255, n).astype(np.uint8)
        windows, counts = langid.cut(data, np.array([0, n]), 32)
        logs = []
        for w in windows:
            e = net.tables[0][w.astype(int)]
            pooled = [np.max([sum(e[at + j] @ k[j] for j in range(width)) for at in range(32 - 3)], 0) for width, k in zip(net.widths, net.kernels)]
            logs.append(np.log(langid.softmax(net.logits(np.concatenate(pooled)[None])[0])[0]))
        mean = langid.softmax(np.mean(logs, 0))
        best, score = model.predict(windows, counts)
        assert best[0] == mean.argmax() and abs(score[0] - mean.max()) < 1e-4


def test_all_languages_are_learned(spark):
    """More languages than the total of windows is meant for: each gives one text at least, and repeats count once."""
    rows = [(i, f"{chr(97 + i % 12) * 40} text {i}", f"l{i % 12}") for i in range(400)] * 2 + [(1000, None, "x"), (1001, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, how=langid.Fit(documents=5, windows=4, languages=2))
    assert model.languages == sorted(f"l{i}" for i in range(12))
