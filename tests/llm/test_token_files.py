import random
import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tracekit.llm import simple8b, token_files
from tracekit.llm.queries import tokenizer_file


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_round_trip(ids):
    coded = simple8b.encode(np.array(ids, np.uint64))
    assert simple8b.decode(coded).tolist() == ids


@pytest.mark.parametrize("n,value,words", [(512, 0, 5), (512, 1, 9), (120, 7, 6), (1024, 32_767, 256), (3, 2**60, 3), (0, 0, 0)])
def test_word_counts(n, value, words):
    coded = simple8b.encode(np.full(n, value, np.uint64))
    assert len(coded.words) == words and simple8b.decode(coded).tolist() == [value] * n


def greedy(ids):
    """One word after the other, as the format is defined."""
    out, at = [], 0
    while at < len(ids):
        stop = min(len(ids), at - at % simple8b.BLOCK + simple8b.BLOCK)
        for s in [*range(1, 16), 0]:
            c, w = int(simple8b.COUNTS[s]), int(simple8b.WIDTHS[s])
            if s == 0 or all(i < 2**w for i in ids[at:min(stop, at + c)]):
                out.append((s, ids[at:min(stop, at + c)]))
                at = min(stop, at + c)
                break
    return out


def test_greedy_choice():
    rng = random.Random(1)
    ids = [rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(1500)] + [0] * 700 + [1, 0] * 300
    coded = simple8b.encode(np.array(ids, np.uint64))
    assert (coded.words >> np.uint64(60)).tolist() == [s for s, _ in greedy(ids)]


TEXTS = ["Hello, WORLD it's we're 'Tis I'LL 123 ½ x²", None, "", " \t\n", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>",
         "ΑΣ Σ ΟΔΟΣ. ΟΔΟΣ1", "é ́x İstanbul ı ß ŉ ĸ Ångström", "zero width​ thin\x85nel \x1cfs a\x1cb", "日本語 テスト 한국어 👩‍👩‍👧 🇩🇪",
         "don''t 's's 'S ''ll", "x" * 3000, "*** a*b--c___d ###", "naïve-Café's ÀÉÎ öÜ", "\x00 a\x00b \x7f", "ﬁ ǅ Ⅷ ⅷ"]


def test_pieces_equal_whole_texts():
    source = open(tokenizer_file()).read()
    whole = Tokenizer.from_str(source)
    rng = random.Random(4)
    alphabet = "aB'sT 1\n\té·ÉßİŸ.,-_*½́ σΣ日𝔸"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(600)]
    import pyarrow as pa

    ids, n = token_files.PieceEncoder(source).batch(pa.array(texts, pa.string()))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    cuts = np.cumsum([0, *n])
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want


def test_words_are_cut_once_for_all_closing_signs(monkeypatch):
    import pyarrow as pa

    cut, was = [], token_files.PieceEncoder._cut
    monkeypatch.setattr(token_files.PieceEncoder, "_cut", lambda self, piece: cut.append(piece) or was(self, piece))
    source, words = open(tokenizer_file()).read(), [f"wört{chr(97 + i)}" for i in range(20)]
    texts = [" ".join(w + sign for w in words) for sign in (",", ".", "...", "?!", ";", '"', ")", "'", "'s,", "|>", "<|endoftext|>,", "\u0301.")] + [None]
    encoder = token_files.PieceEncoder(source)
    for _ in range(2):
        ids, n = encoder.batch(pa.array(texts, pa.string()))
    whole = Tokenizer.from_str(source)
    assert np.split(ids, np.cumsum(n))[-1].size == n[-1] == 0
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len([p for p in cut if p in words]) == 20 and len(cut) <= 20 * 5 + 9  # one time each, and those with signs that may belong to them


@pytest.mark.parametrize("segment", [50, 1 << 18])
def test_files(spark, segment, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    whole = Tokenizer.from_file(tokenizer_file())
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(TEXTS * 7)] + [(None, "null id", "x"), (3, TEXTS[0], "x"), (3, TEXTS[0], "x")]
    rows += [(1000 + r.doc_id, r.text, "x") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = tempfile.mkdtemp() + "/t"
    token_files.write_token_files(df.repartition(5), tokenizer_file(), path)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_digests(spark, path).collect()]
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = {r.doc_id: r.ids for r in token_files.read_token_ids(spark, path).where("doc_id >= 1000").collect()}
    assert all(ids[d] == whole.encode(t, add_special_tokens=False).ids + [2] for d, t, _ in rows if d is not None and d >= 1000)


def test_empty(spark):
    path = tempfile.mkdtemp() + "/t"
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file(), path)
    assert token_files.read_token_digests(spark, path).count() == 0


@pytest.mark.parametrize("size", [1, 4000])
def test_slices_change_nothing(spark, tmp_path, monkeypatch, size):
    docs = spark.createDataFrame([(i, f"piece{i % 7} wörter " * (i % 50) + "one") for i in range(300)] + [(None, None)], "doc_id long, text string")
    out = []
    for name, limit in (("whole", 1 << 23), ("cut", size)):
        monkeypatch.setattr(token_files, "SLICE", limit)
        token_files.write_token_files(docs, tokenizer_file(), str(tmp_path / name))
        out.append(sorted(map(repr, token_files.read_token_digests(spark, str(tmp_path / name)).collect())))
    assert out[0] == out[1] and len(out[0]) == 301


def test_a_worker_forgets_other_operators_only():
    from tracekit.llm.common import forget_worker_state, worker_state

    mine = worker_state("mine", list)
    forget_worker_state(keep="mine")
    assert worker_state("mine", list) is mine
    forget_worker_state(keep="other")
    assert worker_state("mine", list) is not mine
    forget_worker_state()
