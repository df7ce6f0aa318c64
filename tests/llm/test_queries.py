"""The registered queries against their SQL, or against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from itemloom.llm import queries

from .conftest import SF


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, duck, name):
    cols, got = rows(queries.QUERIES[name](spark, SF))
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(want.columns) == cols and len(want) == len(got)
    want = sorted((tuple(r) for r in want[cols].itertuples(index=False)), key=repr)
    for a, b in zip(sorted(got, key=lambda r: repr(r)), want, strict=True):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_op2(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, text, *_ in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[d, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    got = queries.QUERIES["op2_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for x in full.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 4096
    open_ = []
    for n in sorted((w[1] for w in want.values()), reverse=True):
        fit = min((b for b in open_ if b >= n), default=None)
        if fit is None:
            open_.append(4096 - n)
        else:
            open_.remove(fit)
            open_.append(fit - n)
    assert len(full) == len(open_)


def test_op6(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, text, *_ in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = queries.QUERIES["op6_token_files"](spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def brute_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op7(spark, texts):
    fp = {d: brute_simhash(t) for d, t, *_ in texts}
    up = {d: d for d in fp}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 2 and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    got = queries.QUERIES["op7_simhash_components"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", top(d)) for d in fp} and len(got) == len(fp)


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_op9(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op9_personal_data"](spark, SF).collect()}
    assert len(got) == len(texts)
    for d, text, *_ in texts:
        want = brute_base(text)
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in want) for k in BASE]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)


def test_base_on_odd_texts(spark):
    from itemloom.llm import pii

    odd = ["a@b.c_d@e.f", "a@b@c.d x@y a.b@c.d.e.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004 1.2.3", "4111-1111 1111-1111 4111  1111", "+1 (2) +34 567-890 12- +99999999999999999", "x" * 20000 + "@", "9 " * 40000, "é@é.é ä1.1.1.1ü", "4111111111111111" + "0" * 4, "@@@ a@-.-", "+12345678.+1234567"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        got = [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE]
        assert got == brute_base(odd[r.doc_id]), odd[r.doc_id][:60]
