import random
import zlib

import numpy as np
import pytest
from llm_data import DOC_SCHEMA, doc_rows, docs, empty

from leadloom.llm import langid as L

PARTS = {"en": ["the", "ing", "wh", "tion", "er"], "fr": ["eau", "é", "ou", "ê", "que"], "de": ["sch", "ü", "ung", "ß", "pf"]}


def rows(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        text = " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 300)))
        out.append((i, text, lang, "s", 1))
    return out


def test_held_out_accuracy_on_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.predict(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == d.count()
    own = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in own) / len(own) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    data = rows()
    other = [(*r[:2], "xx" if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], "other", r[4]) for r in data]
    a = {r["doc_id"]: tuple(r) for r in L.predict(docs(spark, data)).collect()}
    b = {r["doc_id"]: tuple(r) for r in L.predict(docs(spark, other).repartition(5)).collect()}
    assert a == b
    assert sum(a[r[0]][2] == r[2] for r in data) / len(data) > 0.97


def test_compiled_tables_equal_the_trained_filters():
    net = L.ByteCNN(["a", "b", "c"])
    net.compile()
    x = np.concatenate([L.windows_of(t) for t in (b"Some text, 12 \xc3\xa9", b"x" * 700, b"")])
    z = net._forward(x)[3]
    z = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probs(x), z, atol=1e-4)


def test_windows_cover_the_whole_text():
    t = bytes(range(97, 123)) * 100
    w = L.windows_of(t)
    assert w.shape == (11, L.WINDOW) and (w.reshape(-1)[:len(t)] == L.SYMBOL[list(t)]).all() and not w.reshape(-1)[len(t):].any()


def test_long_texts_are_judged_whole(spark):
    data = rows(200)
    r = random.Random(5)
    fr = " ".join(r.choice(PARTS["fr"]) + r.choice(PARTS["fr"]) for _ in range(20_000))
    en = "the whing tion er " * 30
    got = {x["doc_id"]: x for x in L.predict(docs(spark, [*data, (900, en + fr, None, None, 1)])).collect()}
    assert got[900]["lang_pred"] == "fr"


def test_unknown_and_edge_rows(spark):
    got = {r["doc_id"]: r for r in L.predict(docs(spark, rows() + doc_rows()[-12:])).collect()}
    for i in (1000, 1001, 1002, 1007):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["lang_pred"] != "und"
    kept = L.keep_identified(docs(spark, rows() + doc_rows()[-12:]))
    assert kept.columns == [c.split()[0] for c in DOC_SCHEMA.split(", ")]
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {r[0] for r in rows()} and not ids & {1000, 1001, 1002, 1007}


@pytest.mark.parametrize("langs", [[], ["en"]])
def test_no_label_or_one(spark, langs):
    data = [(i, "some text", langs[0] if langs else None, "s", 1) for i in range(6)]
    got = L.predict(docs(spark, data)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == ({("en", 1.0)} if langs else {("und", 0.0)})


def test_empty_table(spark):
    assert L.predict(empty(spark)).collect() == [] and L.keep_identified(empty(spark)).collect() == []


def test_training_steps_equal_finite_differences():
    """Two steps of the training against the same steps from numeric gradients of a
    loss written out window by window."""
    g = np.random.default_rng(4)
    x, y = g.integers(0, 64, (16, L.WINDOW)), g.integers(0, 3, 16)

    def net(params=None):
        out = L.ByteCNN(["a", "b", "c"])
        out.w, out.out, out.bias = [w.astype(float) for w in out.w], out.out.astype(float), out.bias.astype(float)
        for own, given in zip(out.params(), params or out.params()):
            own[...] = given
        return out

    def loss(n, xb, yb):
        total = 0.0
        for row, lang in zip(xb, yb):
            feats = []
            for w in n.w:
                k = len(w)
                feats.append(np.max([sum(w[j][row[i + j]] for j in range(k)) for i in range(L.WINDOW - k + 1)], axis=0))
            z = np.maximum(np.concatenate(feats), 0) @ n.out + n.bias
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[lang]
        return total / len(xb)

    order = np.random.default_rng(11).permutation(16)
    (xa, ya), (xb, yb) = ((x[order[lo:lo + 8]], y[order[lo:lo + 8]]) for lo in (0, 8))
    start, one, two = net(), net(), net()
    one.train(xa, ya, epochs=1, batch=8, seed=11)
    two.train(x, y, epochs=1, batch=8, seed=11)
    moved = [np.flatnonzero((a != b).ravel()) for a, b in zip(start.params(), two.params())]
    assert all(len(m) for m in moved)
    for k, m in enumerate(moved):
        for i in g.choice(m, min(4, len(m)), replace=False):
            grads = []
            for at, xs, ys in ((start, xa, ya), (one, xb, yb)):
                side = []
                for e in (1e-6, -1e-6):
                    n = net(at.params())
                    n.params()[k].ravel()[i] += e
                    side.append(loss(n, xs, ys))
                grads.append((side[0] - side[1]) / 2e-6)
            (g1, g2), rate = grads, 0.01
            q1 = start.params()[k].ravel()[i] - rate * g1 / (abs(g1) + 1e-8)
            mean, var = (0.09 * g1 + 0.1 * g2) / 0.19, (0.000999 * g1 * g1 + 0.001 * g2 * g2) / 0.001999
            assert abs(q1 - rate * mean / (np.sqrt(var) + 1e-8) - two.params()[k].ravel()[i]) < 2e-5, (k, i, g1, g2)
