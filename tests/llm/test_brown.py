import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strandline.llm import brown, queries
from strandline.llm.bytewords import Lookup, slices
from strandline.llm.shelf import Shelf

from .odd import no_docs, odd_docs


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_base(rows, docs):
    """rows against the formula of the contract, by plain counting."""
    c = Counter()
    for k, t in docs:
        if not held(k):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    want = []
    for k, t in docs:
        own = [*words(t), None]
        want.append((str(k), held(k), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == sorted(want)


def test_query_against_counting(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op1_brown_lm(spark, sf_dir).collect()
    check_base(rows, docs)
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_rare_words_are_joined(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    full = {r.doc_id: r for r in brown.score_held_out(docs).collect()}
    few = brown.score_held_out(docs, how=brown.Classes(sent=900)).collect()
    assert all(abs(r.score - full[r.doc_id].score) < 1e-6 and abs(r.base_score - full[r.doc_id].base_score) < 1e-6 and r.n_known == full[r.doc_id].n_known for r in few)


def test_probabilities_sum_to_one(spark, sf_dir):
    how = brown.Classes(classes=12, own=40, endings=16)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    model, counts = brown.fit(texts, Shelf(spark, "test"), how)
    rows = counts.collect()
    h = np.array([r.h for r in rows]).view(np.uint64)
    unit = model.units(model.place(h), np.array([r.ending for r in rows]))
    c = np.array([r.c for r in rows])
    every = 10 ** (np.log10(c + 1) - model.log_room[model.classes[unit]])
    unseen = 10 ** -model.log_room[model.classes[1 + model.own :]]
    of = np.concatenate([model.classes[unit], model.classes[1 + model.own :]])
    sums = np.bincount(of, np.concatenate([every, unseen]))
    assert np.allclose(sums[np.unique(of)], 1)
    used = np.unique(of)
    assert (10**model.log_steps[:, used]).sum(1).max() <= 1 + 1e-9 and np.allclose((10**model.log_steps).sum(1), 1)
    assert (model.classes[0], (model.classes[1:] == 0).any()) == (0, False)


def likelihood(bigrams, at):
    k = at.max() + 1
    m = np.eye(k)[at]
    pairs = m.T @ bigrams @ m
    x = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1)), 0).sum()
    return x(pairs) - x(m.T @ bigrams.sum(1)) - x(m.T @ bigrams.sum(0))


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(4)
    kind = np.concatenate([[0], 1 + np.arange(30) % 3])
    chain = np.array([[0, 0.8, 0.1, 0.1], [0.1, 0, 0.9, 0], [0.1, 0, 0, 0.9], [0.2, 0.7, 0.1, 0]])
    bigrams = r.poisson(2000 * chain[kind][:, kind] / 10)
    at = brown.exchange(bigrams, 4)
    assert all(len(set(at[kind == k])) == 1 for k in range(4))
    rough = r.poisson(3, (40, 40))
    at = brown.exchange(rough, 6)
    best = likelihood(rough, at)
    for u in range(1, 40):  # no single move is better
        for k in range(1, 6):
            other = at.copy()
            other[u] = k
            if other.max() == at.max():
                assert likelihood(rough, other) <= best + 1e-6


def test_lookup():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64))
    found = Lookup(keys).find(np.concatenate([keys, keys + np.uint64(1)]))
    assert (found[: len(keys)] == np.arange(len(keys))).all() and (found[len(keys) :][~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert Lookup(np.zeros(0, np.uint64)).find(keys[:3]).tolist() == [-1] * 3


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    from strandline.llm import bytewords

    data = np.frombuffer(b" ".join([b"one", b"two", b"x" * 40, b"one", b"two", b"y", b"one"] * 30), np.uint8)
    offsets = np.array([0, 60, len(data)])
    want = bytewords.lower_words(data, offsets)[4]
    assert want[0] == want[3] and want[1] == want[4] and len({int(want[i]) for i in (0, 1, 2, 5)}) == 4
    monkeypatch.setattr(bytewords, "BLOCK", 16)
    monkeypatch.setattr(bytewords, "_powers", {})
    assert (bytewords.lower_words(data, offsets)[4] == want).all()


def test_slices_cover_all_rows():
    texts = ["a", None, "", "bcd" * 10, "é"]
    got = [bytes(d[o[i] : o[i + 1]]).decode() for _, _, d, o in slices(pa.array(texts)[0:], 8) for i in range(len(o) - 1)]
    assert got == [t or "" for t in texts]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    check_base(brown.score_held_out(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert brown.score_held_out(no_docs(spark)).count() == 0
    only = odd_docs(spark).where("doc_id = 11")
    assert brown.score_held_out(only).count() == 0
    k = next(i for i in range(100) if held(i))
    rows = brown.score_held_out(spark.createDataFrame([(k, "all of it is held out")], "doc_id long, text string")).collect()
    assert (rows[0].n_tokens, rows[0].n_known, rows[0].train_tokens, rows[0].base_score, rows[0].score) == (7, 0, 0, 0.0, 0.0)


def test_the_best_class_of_a_word_alone():
    """Against the likelihood of every single move, by full counts."""
    r = np.random.default_rng(11)
    n, k = 60, 7
    bigrams = r.poisson(0.7, (n, n)).astype(float)
    at = np.concatenate([[0], r.integers(1, k, n - 1)])
    at[1 : k] = np.arange(1, k)
    member = np.eye(k)[at]
    pairs = member.T @ bigrams @ member
    new = brown.best_classes((bigrams @ member)[1:], (member.T @ bigrams).T[1:], np.diag(bigrams)[1:], at[1:], pairs)

    def after(u, c):
        other = at.copy()
        other[u] = c
        m = np.eye(k)[other]
        return brown.likelihood(m.T @ bigrams @ m)

    for u in range(1, n):
        every = [after(u, c) for c in range(1, k)]
        assert abs(every[new[u - 1] - 1] - max(every)) < 1e-6


def test_contexts_of_words_outside_the_core(spark, monkeypatch):
    """Packed counts, in many flushes and parts, against plain counting; and the classes of the whole vocabulary."""
    r = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(r.choice(vocabulary, r.integers(0, 40))) for _ in range(120)] + ["dal dal dal", "", None]
    how = brown.Classes(classes=6, own=10, endings=4, least=3)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    shelf = Shelf(spark, "test")
    monkeypatch.setattr(brown, "FLUSH", 150)
    monkeypatch.setattr(brown, "PART", 16)
    model, counts = brown.fit(df, shelf, how)
    assert 10 < model.own == sum(x.c >= 3 for x in counts.collect()) - 1
    place = {bytes(w.encode()): i for w in vocabulary for i in model.place(brown.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), how)[0])[:1]}
    ending = {w: brown.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), how)[1][0] for w in vocabulary}
    unit = lambda w: 0 if w is None else int(model.units(np.array([place[w.encode()]]), np.array([ending[w]]))[0])
    k = int(model.classes.max()) + 1
    want, pairs = Counter(), Counter()
    for t in texts:
        u = [0, *(unit(w) for w in words(t)), 0]
        for x, y in zip(u, u[1:]):
            c, d = int(model.classes[x]), int(model.classes[y])
            pairs[c, d] += 1
            if 10 < x <= model.own:
                want[x, d] += 1
            if 10 < y <= model.own:
                want[y, c + k] += 1
            if x == y and 10 < x <= model.own:
                want[x, 2 * k] += 1
    packed = shelf.put(brown.contexts(df, model))
    many = packed.collect()
    monkeypatch.setattr(brown, "FAN", 2)
    few = brown.summed(packed, k, shelf).collect()
    assert len(few) < len(many) and max(Counter(x.part for x in few).values()) <= 2
    check_packed(many, want, pairs, k)
    check_packed(few, want, pairs, k)


def check_packed(rows, want, pairs, k):
    got, got_pairs = Counter(), Counter()
    for row in rows:
        if row.part < 0:
            got_pairs.update({(i // k, i % k): n for i, n in enumerate(np.frombuffer(row.counts, np.int64).tolist()) if n})
            continue
        slots, n = np.frombuffer(row.slots, np.uint16), np.frombuffer(row.counts, np.uint32)
        w = np.repeat(np.frombuffer(row.words, np.int32), np.frombuffer(row.sizes, np.uint32))
        assert (w // 16 == row.part).all()
        for x, s, c in zip(w.tolist(), slots.tolist(), n.tolist()):
            got[x + 11, s] += c
    assert got == want and got_pairs == pairs


def test_score_is_a_sum_over_class_tables(spark, sf_dir):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    how = brown.Classes(classes=20, own=60, endings=32, least=12)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    train = frame.where((brown.remainder(brown.F.col("doc_id"), 7) != 2)).select("text")
    model, _ = brown.fit(train, Shelf(spark, "test"), how)
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*words(t), None])
    rows = {x.doc_id: x.score for x in brown.score_held_out(frame, how=how).collect()}
    assert model.own > how.own

    def unit(w):
        if w is None:
            return 0
        h, e, _ = brown.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), how)
        return int(model.units(model.place(h[:1]), e[:1])[0])

    room, tokens_of = Counter(), Counter()
    for w, n in c.items():
        k = int(model.classes[unit(w)])
        room[k] += n + 1
        tokens_of[k] += n
    for u in range(1 + model.own, len(model.classes)):
        room[int(model.classes[u])] += 1  # one unseen word for each ending
    pairs, follow = Counter(), Counter()
    for i, t in docs:
        if not held(i):
            k = [int(model.classes[unit(w)]) for w in [None, *words(t), None]]
            pairs.update(zip(k, k[1:]))
    before = Counter()
    for (x, y), n in pairs.items():
        before[x] += n
        follow[x] += 1
    every = {k: (tokens_of[k] + 1) / (sum(c.values()) + len(model.log_steps)) for k in range(len(model.log_steps))}
    for i, t in docs[:80]:
        want, last = 0.0, 0
        for w in [*words(t), None]:
            k = int(model.classes[unit(w)])
            step = (pairs[last, k] + follow[last] * every[k]) / (before[last] + follow[last]) if before[last] else every[k]
            want += math.log10(step) + math.log10((c[w] + 1) / room[k])
            last = k
        assert abs(want - rows[i]) < 1e-6 * max(1, abs(want))
