"""Every stage of the pipeline against brute force, on its own input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from itemloom.llm import queries, quality
from itemloom.llm.common import written

from .conftest import SF
from .test_queries import brute_base

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def outs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF), name)
    return [[r.asDict() for r in df.collect()] for df in [*out, docs]]


def test_columns(outs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "mask_personal_data", "mix_to_weights", "pack_sequences"]
    for rows in outs[:-1]:
        assert set(rows[0]) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_quality_rules(duck, outs):
    want = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({queries.OP5_SQL}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in outs[1]} == want
    bad = set(duck.execute(f"WITH {queries._QUALITY} SELECT source, line FROM bad").fetchall())
    texts = {r["doc_id"]: r for r in outs[0]}
    for r in outs[1]:
        normal = lambda x: " ".join(WORD.findall(x.lower()))
        lines = [x for x in texts[r["doc_id"]]["text"].split("\n") if not WORD.search(x) or (r["source"], normal(x)) not in bad]
        assert r["text"] == "\n".join(lines) and r["n_chars"] == len(r["text"])
    assert quality.MAX_DOCS == 20


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_dedup(outs):
    docs = {r["doc_id"]: r["text"] for r in outs[1]}
    kept = {r["doc_id"] for r in outs[2]}
    sets, where = {d: shingles(t) for d, t in docs.items()}, defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    likeness = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    near = defaultdict(float)
    for (a, b), j in likeness.items():
        near[a], near[b] = max(near[a], j), max(near[b], j)
        assert j < 0.8 or not (a in kept and b in kept)
    assert all(near[d] >= 0.8 for d in docs.keys() - kept) and kept <= docs.keys()
    assert all(r["text"] == docs[r["doc_id"]] for r in outs[2])
    first = {}
    for d in sorted(docs):
        first.setdefault(docs[d], d)
    assert all(first[docs[d]] == d for d in kept)


def test_personal_data(outs):
    before = {r["doc_id"]: r["text"] for r in outs[2]}
    assert {r["doc_id"] for r in outs[3]} == before.keys()
    for r in outs[3]:
        spans, text, at = sorted((a, -b, k) for k, a, b in brute_base(before[r["doc_id"]])), "", 0
        for a, b, k in spans:
            if a >= at:
                text, at = text + before[r["doc_id"]][at:a] + f"[{k.upper()}]", -b
        # The added kinds may mark more; none occurs in these texts.
        assert r["text"] == text + before[r["doc_id"]][at:]


def test_mixing(outs):
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in outs[3]}
    source = {r["doc_id"]: r["source"] for r in outs[3]}
    total, per = sum(size.values()), Counter()
    for d, n in size.items():
        per[source[d]] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}
    capped = {}
    while True:
        free = [s for s in per if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * per[s] for s in free if share[s] > 3 * per[s]}
        if not over:
            break
        capped |= over
    rate = {s: x / per[s] for s, x in (capped | share).items()}
    want = Counter()
    for s, r in rate.items():
        mine = [d for d in size if source[d] == s]
        take = lambda seed: {d: int(r) + (int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) / 2**52 < r - int(r)) for d in mine}  # noqa: B023, E731
        off = lambda seed: abs(sum(size[d] * n for d, n in take(seed).items()) - r * per[s])  # noqa: B023, E731
        want.update({d: n for d, n in take(min(range(64), key=off)).items() if n})
        # The words taken come near the target where there are documents enough to choose from.
        assert len(mine) < 50 or sum(size[d] * want[d] for d in mine) == pytest.approx(r * per[s], rel=0.03)
    assert Counter(r["doc_id"] for r in outs[4]) == want


def test_packing(outs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, known = Counter(), {}
    for r in outs[4]:
        if r["doc_id"] not in known:
            ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
            known[r["doc_id"]] = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
        want.update((r["doc_id"], *p) for p in known[r["doc_id"]])
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in outs[5]) == want
    full = defaultdict(list)
    for r in outs[5]:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in full.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096


def test_run_is_the_chain(spark, outs):
    got = Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in outs[5])


def test_odd_and_empty_tables(spark, odd, none):
    """Every stage on its predecessor's rows, nulls, ties, repeated rows and clashing names among them."""
    for df in (odd, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
            assert name == "pack_sequences" or docs.columns == corpus_pipeline.COLUMNS
        assert bool(docs.count()) == bool(df.count() and corpus_pipeline.STAGES[0][1](spark, df, SF).count())
        # The later stages on the odd rows themselves, as the first rejects most of them.
        for _, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, df, SF).collect()
