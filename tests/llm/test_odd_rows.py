"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names; and each operator's own cases."""

import random
import time

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from itemloom.llm import chat, langid, mixing, packing, pii, quality, sharding, simhash, token_files, topk
from itemloom.llm.tokens import Encoder
from pyspark.sql import functions as F

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_sharding(spark, odd, none):
    out = sharding.shard_documents(odd.withColumn("shard_docs", F.lit("x")), 1000)
    rows = out.collect()
    assert len(rows) == odd.count() and {"size", "n_chars"} <= set(out.columns)
    for r in rows:
        assert r.shard_bytes <= 1000 or r.shard_docs == 1
    assert sharding.shard_documents(none, 1000).count() == 0
    # One key for many rows: its bits can't split them, the second hash does, and every row is kept.
    same = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text"))
    out = sharding.shard_documents(same, 1000)
    assert out.count() == 300
    assert all(r.n * 100 <= 1000 for r in out.groupBy("shard_depth", "shard_prefix", "shard_copy").agg(F.count("*").alias("n")).collect())


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(sharding.shard_documents(odd, 1000), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_mixing(spark, odd, none):
    out = mixing.mix_copies(odd, size=None)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 3 for r in rows)
    assert {r.source for r in rows} == {"a", "b", "c", "z", "é", None}
    assert mixing.mix(odd).count() == sum(r.copies for r in rows) and mixing.mix(none).count() == 0
    sizes = [("a", 100.0), ("b", 5.0), ("c", 50.0), (None, 7.0), ("d", 0.0)]
    plan = {r.source: r for r in mixing.source_plan(spark.createDataFrame(sizes, "source string, size double")).collect()}
    # Reshare by hand until none is above its cap.
    order, weight, total = ["a", "b", "c", "d", None], dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), 162.0
    size, capped = dict(sizes), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * size[s] for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s, x in (capped | share).items():
        assert plan[s].target == pytest.approx(x)


def test_quality(spark, odd, none):
    out = quality.quality(odd)
    assert out.count() == odd.count() and quality.quality(none).count() == 0 and "size" in out.columns
    line = "shared boilerplate line of some words here"
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{own(i, 60 * (1 + i % 5))}\n{line.upper()}", "h") for i in range(30)]
    rows += [(100, "\n".join([own(100, 3), *[line] * 20]), "h"), (101, f"{line}\n{own(101, 60)}", "other")]
    rows += [(200 + i, f"{own(200, 80)}\n{own(200 + i, 4)}", "h") for i in range(40)] + [(300 + i, f"{own(300, 80)}\nend", "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for bound in (quality.BROADCAST_LINES, 0):
        got = {r.doc_id: r for r in quality.quality(df, broadcast_lines=bound).collect()}
        assert len(got) == len(rows)
        assert all(got[i].kept and got[i].removed_words == 7 and line.upper() not in got[i].clean_text for i in range(30))
        assert not got[100].kept and got[101].kept and got[101].removed_words == 0
        # Near copies count each: they lose the line they share, and with it too much.
        assert all(not got[200 + i].kept and got[200 + i].removed_words == 80 for i in range(40))
        # Exact copies under ids of their own are as many documents; where texts are counted, they are one.
        assert all(not got[300 + i].kept and got[300 + i].removed_words == 81 for i in range(40))
        by_text = {r.doc_id: r for r in quality.quality(df, broadcast_lines=bound, document=F.xxhash64("text")).collect()}
        assert all(by_text[300 + i].kept and by_text[300 + i].removed_words == 0 for i in range(40))


def test_personal_data(spark, odd, none):
    out = pii.find_spans(odd.withColumn("spans", F.lit(1)))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and pii.find_spans(none).count() == 0
    assert [s.kind for s in got[10].spans] == ["email", "ip", "card", "phone"]
    texts = ["pay to bank account GB82 WEST 1234 5698 7654 32 now", "GB82 WEST 1234 5698 7654 33", "my ssn is 123-45-6789.", "part 123-45-6789", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    red = {r.doc_id: r.text for r in pii.redact(pii.find_spans(df)).collect()}
    assert red == {0: "pay to bank account [IBAN] now", 1: texts[1], 2: "my ssn is [SSN].", 3: texts[3], 4: None}
    # Work follows the number of matches, not its square.
    took = []
    for n in (100, 16_000):
        many = spark.createDataFrame([(1, " ".join(f"user{i}@mail{i}.example.com" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.redact(pii.find_spans(many)).first().text == " ".join(["[EMAIL]"] * n)
        took.append(time.time() - began)
    assert took[1] < took[0] + 3
    both = spark.createDataFrame([(1, "é +49 (30) 4111 1111 x@y.zz 10.0.0.1")], "doc_id long, text string")
    assert pii.redact(pii.find_spans(both)).first().text == "é [PHONE] [EMAIL] [IP]"


def test_chat_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "bad"), ("t", 3, 1, 5.0, "assistant", "good"), ("t", 4, 3, 0.0, "user", "next"), ("t", 5, 4, 1.0, "assistant", "end"), ("t", 6, 2, 2.0, "user", "x"), ("u", 1, None, None, None, None), ("c", 1, 2, 0.0, "user", "loop"), ("c", 2, 1, 0.0, "user", "loop")]
    df = spark.createDataFrame(rows, "tree_id string, node long, parent long, score double, role string, text string")
    paths = {(r.tree_id, r.path, r.step): r.node for r in chat.choose_paths(df, best=2).collect()}
    assert paths == {("t", 1, 0): 1, ("t", 1, 1): 3, ("t", 1, 2): 4, ("t", 1, 3): 5, ("t", 2, 0): 1, ("t", 2, 1): 2, ("t", 2, 2): 6, ("u", 1, 0): 1}
    out = {r.tree_id: r for r in chat.read_back(chat.format_paths(df, chat.choose_paths(df))).collect()}
    assert out["t"].formatted == "<s>[TURN]user[TEXT]q[/TURN][TURN]assistant[TEXT]good[/TURN][TURN]user[TEXT]next[/TURN][TURN]assistant[TEXT]end[/TURN]</s>"
    assert out["t"].learned_text == "goodend" and out["u"].turns == [("", "")]
    # Repeated nodes don't multiply paths, nor turns; a null node is on none.
    more = df.unionByName(df).unionByName(spark.createDataFrame([("t", None, 1, 9.0, "user", "z"), ("t", 3, 1, 5.0, "assistant", "worse")], df.schema))
    assert {(r.tree_id, r.path, r.step): r.node for r in chat.choose_paths(more, best=2).collect()} == paths
    again = {r.tree_id: r for r in chat.read_back(chat.format_paths(more, chat.choose_paths(more))).collect()}
    assert again["t"].formatted == out["t"].formatted and again["t"].loss == out["t"].loss


def test_chat_escapes(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[\\\\TURN]", "[/TURN][TEXT]", "<<SYS>>", "<\\<SYS>>", "[", "<", "", None, "$1 \\1", "a[/TUR"]
    rows = [(k, i, "assistant" if i % 2 else "[TEXT]", t) for k in range(2) for i, t in enumerate(odd)] + [(9, None, None, None), (9, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.tree_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in out[0].turns] == [("assistant" if i % 2 else "[TEXT]", t or "") for i, t in enumerate(odd)]
    assert out[0].learned_text == "".join(t or "" for t in odd[1::2]) and out[9].n_turns == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize(("path", "drops"), [(WORDS, True), (BYTES, False)])
def test_encoder(path, drops, texts):
    from tokenizers import Tokenizer

    own, library = Encoder(path, drops), Tokenizer.from_file(path)

    def ids(batch):
        out = []
        for got, ends in own.texts(pa.array(batch, pa.string())):
            out += [x.tolist() for x in np.split(got, ends[:-1])]
        return out

    rng = random.Random(1)
    odd = ["a  b", "a   b", "\n", " x", "x ", "it's  \n\n x\ty", "Σας ΣΑΣ", "é é", "a\xa0b c　d", "1,2. 3.", "<|endoftext|>.", " . ,", "a.", "a,.", "x\x1cy", "’s", "İß ſ.", "don't.", "ªº µ²", "漢字 kana かな", "\x00 a", "a\r\nb", "ﬁ ﬂ"]
    odd += ["".join(rng.choice(" \n.,aZé'1Σ\t") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    known = [*odd, *[x[1] for x in texts[:100]]]
    assert ids(known) == [library.encode(t, add_special_tokens=False).ids for t in known] and ids([None, ""]) == [[], []]
    # The ids of a text don't depend on what was asked before it.
    assert ids(["İ"]) + ids(["İ,"]) == [library.encode(t, add_special_tokens=False).ids for t in ("İ", "İ,")]
    parts = [*"abcXYZéüßÑİÎक़́,.;:!?'\"#$%&*()[]<>|-_019\t\x1c\x85字Ωςﬁ", *" \n" * 8, "'s", "'t", "<|endoftext|>", "  ", "\n\n", "ll", "don't"]
    for _ in range(8):
        batch = ["".join(rng.choices(parts, k=rng.choice((1, 2, 3, 8, 40)))) for _ in range(3000)]
        assert ids(batch) == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_packing(spark, odd, none):
    out = packing.pack_documents(odd.withColumn("sequence_id", F.lit("x")), WORDS, capacity=64)
    rows = out.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and packing.pack_documents(none, WORDS).count() == 0
    assert sum(r.length for r in rows if r.doc_id == 9) == 30001 and sum(r.doc_id == 4 for r in rows) == 2
    for seed in range(60):
        rng = random.Random(seed)
        cap = rng.choice([7, 30, 100])
        counts = {rng.randint(1, cap): rng.randint(1, 20) for _ in range(12)}
        bins = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = min((b for b in bins if b >= n), default=None)
                if fit is None:
                    bins.append(cap - n)
                else:
                    bins.remove(fit)
                    bins.append(fit - n)
        used = {p[3] + i // p[4] for p in packing.plan(counts, cap) for i in range(p[2] - p[1])}
        assert len(used) == len(bins)


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    for name, df in (("odd", odd), ("none", none)):
        token_files.write_documents(df, BYTES, str(tmp_path / name))
        got = sorted((r.doc_id or 0, r.start, bytes(r.ids)) for r in token_files.read_files(spark, str(tmp_path / name)).collect())
        want = sorted((r.doc_id or 0, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in df.collect())
        assert [(a, c) for a, _, c in got] == want
        at = 0
        for _, start, ids in sorted(got, key=lambda x: x[1]):
            assert start == at
            at += len(ids) // 4


def test_codes():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 4), (2, 4), (16, 4), (300, 10), (5000, 14)):
        counts = np.bincount(np.minimum(rng.zipf(1.3, 200_000), n) - 1, minlength=n)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        ids = rng.permutation(np.repeat(np.arange(n), counts))[:70_000]
        codes, table = token_files.canonical(lengths), token_files.decoding_table(lengths, limit)
        for k in (1, 63, 64, 65, len(ids)):
            block, _ = token_files.encode(ids[:k], codes, lengths)
            assert (token_files.decode(block, k, table, limit) == ids[:k]).all()


def test_simhash(spark, odd, none):
    got = simhash.near_components(odd)
    assert got.count() == odd.count() and simhash.near_components(none).count() == 0
    rows = {r.doc_id: r for r in got.collect()}
    assert bytes(rows[1].fp) == bytes(rows[3].fp) == bytes(8) and rows[2].component_id == rows[3].component_id == 1
    # Hot keys are split into trees that query each other; chains of links are one component.
    rng = random.Random(0)
    points = {0: 0}
    for i in range(1, 400):
        points[i] = points[rng.randrange(i)] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
    for i in range(400, 500):
        points[i] = rng.getrandbits(64)
    df = spark.createDataFrame([(i, bytearray(x.to_bytes(8, "big"))) for i, x in points.items()], "id long, fp binary")
    roots = {r.node: r.root for r in simhash.components(simhash.near_edges(df, simhash.block_keys(df, 64, 2, 4), 2, shard=16)).collect()}
    up = {i: i for i in points}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in points:
        for b in range(a):
            if (points[a] ^ points[b]).bit_count() <= 2 and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert all(roots.get(i, i) == top(i) for i in points)


def test_near_dedup(spark, odd, none):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(5000)}" for _ in range(300)] for _ in range(6)]
    rows = []
    for b in base:
        for k in range(5):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(300)] = "edit"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(df).collect()) == [0, 5, 10, 15, 20, 25]
    out = simhash.near_dedup(odd)
    assert out.columns == odd.columns and out.count() == 10 and simhash.near_dedup(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = {i: (rng.integers(-40, 40, 8) / 64).tolist() for i in range(300)}
    v |= {300 + i: v[0] for i in range(60)}
    rows = [(i, x) for i, x in v.items()] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [0.5] * 8), (1004, [0.5]), (1005, [])]
    rows += [(20, v[20]), (20, v[40]), (21, v[21])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, shard=64).collect()
    ok = [(i, np.floor(64 * np.pad(np.array(x, float), (0, 8 - len(x)))).astype(int)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    # A repeated query row has a list of its own, and the other row is a candidate.
    want = []
    for at, (q, x) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for k, (i, y) in enumerate(ok) if k != at)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_language_gradients():
    net, rng = langid.Network(3, 4, 1), np.random.default_rng(2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(1, 255, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(x, y)
    for k in net.w:
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in net.w[k].shape)
            if k == "table":
                at = (at[0], int(x[at[1] % 5, at[2] % 7]), at[2])
            e = 1e-3
            net.w[k][at] += e
            up = net.gradients(x, y)[0]
            net.w[k][at] -= 2 * e
            down = net.gradients(x, y)[0]
            net.w[k][at] += e
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-4


def test_languages(spark, odd, none, texts):
    out = langid.identify(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and "lang" not in out.columns and langid.identify(none).count() == 0
    assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 11)) and 0 <= r.score <= 1 for r in rows)
    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [got[d].lang_pred == lang for d, _, lang, _ in texts if got[d].held_out]
    assert np.mean(held) > 0.95
