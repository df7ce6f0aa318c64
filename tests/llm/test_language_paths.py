"""Language ID: the two forward passes agree, the fold is CRC-32's, and a table's predictions are those of a plain loop."""

import zlib

import numpy as np
import pytest
from itemloom.llm import langid

from .conftest import SF


def test_pooled_is_the_sum_of_labels():
    net, rng = langid.Network(5, 8, 3), np.random.default_rng(1)
    x = rng.integers(1, 256, (40, langid.WINDOW)).astype(np.uint8)
    x[::3, 50:] = 0
    states, _, _ = net.states(x)
    want = (np.exp(net.labels(states)) * (x.T != 0)[..., None]).sum(axis=0)
    assert np.allclose(net.pooled(x), want, atol=1e-3)


def plain(net, data):
    """Mean label probabilities of a text, position by position."""
    w, hid, total = net.w, net.hidden, np.zeros(len(net.w["bias"]))
    for at in range(0, len(data), langid.WINDOW):
        piece = data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        sides = []
        for k, seq in enumerate((piece, piece[::-1])):
            h, out = np.zeros(hid), []
            for byte in seq:
                g, a = w["table"][k][byte], h @ w["u"][k]
                z, r = np.clip((g[:hid] + a[:hid]) / 4 + 0.5, 0, 1), np.clip((g[hid : 2 * hid] + a[hid : 2 * hid]) / 4 + 0.5, 0, 1)
                h = h + z * (np.clip(g[2 * hid :] + r * a[2 * hid :], -1, 1) - h)
                out.append(h)
            sides.append(out if k == 0 else out[::-1])
        for i in range(min(langid.WINDOW, len(data) - at)):
            y = np.concatenate([sides[0][i], sides[1][i]]) @ w["out"] + w["bias"]
            p = np.exp(y - y.max())
            total += p / p.sum()
    return total / total.sum()


def test_predictions_against_a_plain_loop(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.held_out(langid.F.col("doc_id")))
    net, langs = langid.train(docs.filter("not held_out"))
    got = {r.doc_id: r for r in langid.predict(docs.drop("lang", "source", "n_chars"), net, langs).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items()) and len(got) == len(texts)
    for d, t, *_ in [x for x in texts if x[1] and any(c.isalpha() for c in x[1]) and len(x[1]) < 1500]:
        p = plain(net, t.encode())
        assert got[d].score == pytest.approx(p.max(), abs=1e-3)
        assert got[d].lang_pred == langs[int(p.argmax())] or np.sort(p)[-2] > p.max() - 2e-3
