"""The registered queries over whole small tables against brute force, where SQL cannot express them."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_lang_id import brute as brute_language
from tests.llm.test_link_trust import brute as brute_trust
from tests.llm.test_pii import brute as brute_personal
from tests.llm.test_secrets import brute as brute_secrets
from tracekit.llm.queries import Q, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_op1(spark, docs):
    got = Q["op1_secret_scan"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute_secrets(docs[r.doc_id].text)
        base = said(s for s in want if s[0] != "pem")
        assert (r.spans, r.base_sha256) == (said(want), hashlib.sha256(base.encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))


def test_op2(spark, docs):
    """Every document that shares 50 words or more in a row with a smaller one is reported."""
    first, due = {}, set()
    for i in sorted(docs):
        w = docs[i].text.encode().lower().split()
        runs = {tuple(w[a:a + 50]) for a in range(len(w) - 49)}
        if any(r in first for r in runs):
            due.add(i)
        for r in runs:
            first.setdefault(r, i)
    got = Q["op2_shared_passages"](spark, SF).collect()
    assert due and due <= {r.doc_id for r in got} and all(r.doc_id > r.other_id and r.similarity >= 0.8 for r in got)
    for r in got:
        a = docs[r.doc_id].text.lower().split()[r.start:r.end]
        b = docs[r.other_id].text.lower().split()[r.other_start:r.other_end]
        x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        assert len(a) >= 50 and len(x & y) >= 0.8 * len(x | y)


def test_op4(spark, docs):
    whole = Tokenizer.from_file(tokenizer_file())
    start, want = 0, {}
    for i in sorted(docs):
        ids = whole.encode(docs[i].text, add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q["op4_token_files"](spark, SF).collect()} == want


def test_op5(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = brute_trust(pages)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in Q["op5_url_trust"](spark, SF).collect()} == {i: w[:4] for i, w in want.items()}


def test_op6(spark, docs):
    got = Q["op6_personal_data"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute_personal(docs[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone"))


def test_op8(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    rows = [(r.lang, r.text) for i, r in docs.items() if not held[i]]
    got = {r.doc_id: r for r in Q["op8_language_id"](spark, SF).collect()}
    assert {i: r.held_out for i, r in got.items()} == held
    names = sorted({x for x, t in rows if x is not None and t is not None})
    short = [i for i in docs if len(docs[i].text) <= 400][:6]
    assert short
    for i in short:
        assert got[i].lang_pred == names[int(np.argmax(brute_language(rows, docs[i].text)))]
