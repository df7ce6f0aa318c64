"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, named

#: Bytes of a window; a text is cut into windows of which every byte gets a label.
WINDOW = 64
HIDDEN = 8
#: Bound of the training sample: documents per language (drawn by hash), windows in all.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 12_000
#: Training steps, of 256 windows each, however small the sample.
STEPS = 200
UNKNOWN = "und"


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) bytes of a text, the last padded by zeros."""
    n = -(-len(data) // size)
    return np.frombuffer(data.ljust(n * size, b"\0"), np.uint8).reshape(n, size)


class Network:
    """Per direction: x_t = table[byte] (3H), z, r = clip((x + h U) / 4 + 1/2, 0, 1), c = clip(x + r * (h V), -1, 1),
    h = h + z * (c - h), with piecewise linear gates as they cost a tenth of smooth ones here; a softmax over both
    directions' states labels every position. Arrays have the direction first."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.w = {"table": f(2, 256, 3 * hidden, s=0.5), "u": f(2, hidden, 3 * hidden, s=hidden**-0.5), "out": f(2 * hidden, classes, s=0.3), "bias": np.zeros(classes, np.float32)}
        self.hidden = hidden

    def states(self, x: np.ndarray, keep: bool = False):
        """(2, T, n, H): the states of both directions, at the positions as the direction meets them."""
        w, hid, (n, size) = self.w, self.hidden, x.shape
        both = np.stack([x.T, x.T[::-1]]).astype(np.intp)
        h, out, kept = np.zeros((2, n, hid), np.float32), np.empty((2, size, n, hid), np.float32), []
        for t in range(size):
            g = np.stack([w["table"][0].take(both[0, t], axis=0), w["table"][1].take(both[1, t], axis=0)])
            a = h @ w["u"]
            zr = np.clip(0.25 * (g[..., : 2 * hid] + a[..., : 2 * hid]) + np.float32(0.5), 0, 1)
            z, r = zr[..., :hid], zr[..., hid:]
            c = np.clip(g[..., 2 * hid :] + r * a[..., 2 * hid :], -1, 1)
            if keep:
                kept.append((h, z, r, c, a[..., 2 * hid :]))
            h = h + z * (c - h)
            out[:, t] = h
        return out, both, kept

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(n, classes): the sums of the label probabilities of each window's positions. As states() and labels(), with
        features first, so that every operation runs over the windows."""
        w, hid, (n, size) = self.w, self.hidden, x.shape
        table, u = np.ascontiguousarray(w["table"].swapaxes(1, 2)), np.ascontiguousarray(w["u"].swapaxes(1, 2))
        out = np.ascontiguousarray(w["out"].reshape(2, hid, -1).swapaxes(1, 2))
        table[:, : 2 * hid] = table[:, : 2 * hid] * 0.25 + 0.5
        u[:, : 2 * hid] *= 0.25
        bytes_ = np.ascontiguousarray(x.T)
        h, g, a = np.zeros((2, hid, n), np.float32), np.empty((2, 3 * hid, n), np.float32), np.empty((2, 3 * hid, n), np.float32)
        y = np.empty((2, size, out.shape[1], n), np.float32)
        zr, c = g[:, : 2 * hid], g[:, 2 * hid :]
        z, r = zr[:, :hid], zr[:, hid:]
        for t in range(size):
            table[0].take(bytes_[t], axis=1, out=g[0], mode="clip")
            table[1].take(bytes_[size - 1 - t], axis=1, out=g[1], mode="clip")
            np.matmul(u, h, out=a)
            zr += a[:, : 2 * hid]
            np.clip(zr, 0, 1, out=zr)
            r *= a[:, 2 * hid :]
            c += r
            np.clip(c, -1, 1, out=c)
            c -= h
            c *= z
            h += c
            np.matmul(out[0], h[0], out=y[0, t])
            np.matmul(out[1], h[1], out=y[1, size - 1 - t])
        p = y[0]
        p += y[1]
        p += w["bias"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        if not bytes_.all():
            p *= (bytes_ != 0)[:, None, :]
        return p.sum(axis=0, dtype=np.float32).T

    def labels(self, s: np.ndarray) -> np.ndarray:
        hid = self.hidden
        y = s[0] @ self.w["out"][:hid] + s[1][::-1] @ self.w["out"][hid:] + self.w["bias"]
        y -= y.max(axis=-1, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=-1, keepdims=True))

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time; padding has no label."""
        w, hid, (n, size) = self.w, self.hidden, x.shape
        s, both, kept = self.states(x, keep=True)
        lp = self.labels(s)
        real = (x.T != 0).astype(np.float32)
        scale = 1 / max(1.0, float(real.sum()))
        loss = -float((np.take_along_axis(lp, np.broadcast_to(label[None, :, None], (size, n, 1)), 2)[..., 0] * real).sum()) * scale
        dy = np.exp(lp)
        dy[:, np.arange(n), label] -= 1
        dy *= real[..., None] * np.float32(scale)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        back = s[1][::-1]
        flat = dy.reshape(-1, dy.shape[-1])
        g["out"][:hid], g["out"][hid:] = s[0].reshape(-1, hid).T @ flat, np.ascontiguousarray(back).reshape(-1, hid).T @ flat
        g["bias"] = flat.sum(axis=0)
        ds = np.stack([dy @ w["out"][:hid].T, (dy @ w["out"][hid:].T)[::-1]])
        dh, ut = np.zeros((2, n, hid), np.float32), np.swapaxes(w["u"], 1, 2)
        dx_all = np.empty((2, size, n, 3 * hid), np.float32)
        for t in reversed(range(size)):
            h, z, r, c, a = kept[t]
            dh = dh + ds[:, t]
            dz, dc = dh * (c - h) * 0.25 * ((z > 0) & (z < 1)), dh * z * (np.abs(c) < 1)
            dr = dc * a * 0.25 * ((r > 0) & (r < 1))
            dx = np.concatenate([dz, dr, dc], axis=-1)
            da = np.concatenate([dz, dr, dc * r], axis=-1)
            g["u"] += np.swapaxes(h, 1, 2) @ da
            dh = dh * (1 - z) + da @ ut
            dx_all[:, t] = dx
        for k in range(2):
            np.add.at(g["table"][k], both[k].reshape(-1), dx_all[k].reshape(-1, 3 * hid))
        return loss, g

    def fit(self, x: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = 256, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over shuffled batches."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        while step < steps:
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                _, g = self.gradients(x[order[i : i + batch]], label[order[i : i + batch]])
                size = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
                for k, a in g.items():
                    a = a * min(1.0, 1.0 / (size + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * a
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * a * a
                    at = rate * max(0.1, min(1.0, 1.2 - step / steps))
                    self.w[k] -= (at * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(as_text(key)) % folds == fold


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[Network | None, list[str]]:
    """A network fit on a bounded sample of labelled rows: of each language at most SAMPLE_DOCS, and of their texts windows
    anywhere, at most SAMPLE_WINDOWS in all or one for each language, if that is more. Rows are drawn one by one, whether
    they repeat or have no key. Fewer than two languages need no network. Of equally probable labels the first in
    code-point order wins; an empty table learns nothing."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if len(langs) < 2:
        return None, langs
    c, share, d, n = named(known, "sample_lang", "sample_share", "sample_draw", "sample_rank")
    most = max(1, min(SAMPLE_DOCS, SAMPLE_WINDOWS // len(langs)))
    shares = docs.sparkSession.createDataFrame([(x, most / counts[x]) for x in langs], f"{c} string, {share} double")
    draw = F.pmod(F.xxhash64(as_text(F.col(key)), text, F.monotonically_increasing_id()), F.lit(1 << 40)) / float(1 << 40)
    # Windows are cut where the documents are, so the driver gets no more of them than the bound.
    per_doc = max(1, SAMPLE_WINDOWS // sum(min(most, n_) for n_ in counts.values()))
    ids = {x: i for i, x in enumerate(langs)}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = [], []
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = windows(t.encode())
                if len(w):
                    pick = np.random.default_rng(len(t)).permutation(len(w))[:per_doc]
                    x += [w[i].tobytes() for i in sorted(pick)]
                    y += [ids[l]] * min(per_doc, len(w))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32())], ["w", "y"])

    # Three times as many rows as are wanted pass a first draw, then the least draws of each language stay.
    drawn = known.withColumn(d, draw).join(F.broadcast(shares), F.col(lang) == F.col(c)).filter(F.col(d) < 3 * F.col(share))
    drawn = drawn.select(text, lang, d).withColumn(n, F.row_number().over(Window.partitionBy(lang).orderBy(d, F.xxhash64(text)))).filter(F.col(n) <= most)
    rows = drawn.select(text, lang).mapInArrow(sample, "w binary, y int")
    rows = sorted((bytes(r.w), r.y) for r in rows.collect())
    net = Network(len(langs))
    if rows:
        net.fit(np.stack([np.frombuffer(w, np.uint8) for w, _ in rows]), np.array([y for _, y in rows]))
    return net, langs


def predict(docs: DataFrame, net: Network | None, langs: list[str], text: str = "text", block: int = 2048) -> DataFrame:
    """docs without the text, with lang_pred and score.

    Every byte of the whole text is labelled; a document's score for a language is the mean probability of its
    positions, pooled over all windows. Null text and text without a letter: und, score 0. Without a learned language
    all are und; with one, all texts with letters are that one. Extra columns pass through.
    """
    cols = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    slim = docs.select(*cols, text)
    # A window's label probabilities take room for every language.
    block = max(1, block * 64 // max(64, len(langs)))
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ok = b.column(len(cols)).to_pylist(), b.column(len(cols) + 1).to_pylist()
            n = len(texts)
            sums, best, score = np.zeros((n, max(1, len(langs)))), [UNKNOWN] * n, np.zeros(n)
            if net is None:
                sums[:, 0] = 1
            else:
                for doc, x in blocks(texts, ok, block):
                    np.add.at(sums, doc, net.pooled(x))
            for i in np.flatnonzero(ok).tolist() if langs else []:
                total = sums[i].sum()
                k = int(sums[i].argmax())
                best[i], score[i] = langs[k], sums[i, k] / total if total else 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(best), pa.array(np.clip(score, 0, 1))], names=[*cols, "lang_pred", "score"])

    schema = slim.drop(text).schema.add("lang_pred", "string").add("score", "double")
    return slim.withColumn(named(slim, "letter")[0], letter).mapInArrow(run, schema)


def blocks(texts: list[str | None], ok: list[bool], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, window) of all texts, some windows at a time."""
    doc, held, n = [], [], 0
    for i, t in enumerate(texts):
        if not ok[i]:
            continue
        w = windows(t.encode())
        for a in range(0, len(w), size):
            doc.append(np.full(len(w[a : a + size]), i))
            held.append(w[a : a + size])
            n += len(held[-1])
            if n >= size:
                yield np.concatenate(doc), np.concatenate(held)
                doc, held, n = [], [], 0
    if held:
        yield np.concatenate(doc), np.concatenate(held)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out, label all: the other columns but lang, with held_out, lang_pred, score.

    Repeated rows get the same label and are all returned; rows of null key count as the empty string; input columns with
    the names of the added ones are replaced; an empty table gives an empty result.
    """
    docs = docs.withColumn("held_out", held_out(F.col(key)))
    net, langs = train(docs.filter(~F.col("held_out")), text, lang, key)
    return predict(docs.drop(lang), net, langs, text)
