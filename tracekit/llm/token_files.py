"""Token ids of documents in binary files, coded with Simple-8b.

A file set is a Parquet table that Spark writes (its commit protocol keeps it whole when executors are lost): one row
for each segment of about ``SEGMENT`` ids, in ascending doc_id order over (shard, seq). A segment holds its coded words, the
words before each block, the escaped ids, and the ids and lengths of its documents; a document never spans two.

Encoding: where a tokenizer drops white space (``spaced=True``), ASCII white space always ends a token, so a text's ids
are those of its space-separated pieces joined. Each distinct piece of a batch is then encoded once.
Signs that close a word are pieces of their own where the tokenizer's own pre-tokenizer pattern always cuts there.
A piece of plain Latin letters, digits and signs is cut by that pattern, and each part is given to the
tokenizer's model once for each worker process; every other piece goes through the whole tokenizer.

Defined results: a null text has no ids but the end id; rows repeating a doc_id follow each other, by text;
a null doc_id comes first; an empty table gives no segments.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracekit.llm.common import forget_worker_state, ship, slices, words_of, worker_state
from tracekit.llm.simple8b import Coded, decode, encode

ship(__name__)

SEGMENT = 1 << 18
SLICE = 2 << 20  # text encoded at once: its lists of pieces and ids take up to ten times as much
MAX_KNOWN = 700_000  # distinct pieces and parts a worker process remembers, the first ones it meets
SEGMENTS = ("shard int, seq long, first long, n long, words binary, offsets binary, escapes binary, "
            "doc_ids array<long>, lengths array<long>")
# Letters, digits and signs whose lower case and composition are the same in every Unicode version.
PLAIN = regex.compile("[!-~¡-¬®-į]+")
LETTERS = "0-9A-Za-zÀ-ÖØ-öø-į"  # of these, the letters and digits


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte (a published, fixed rule)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PieceEncoder:
    """Encodes space-separated pieces, remembering what it has seen."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(source)
        parts = json.loads(source)["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split"))
        self.added = [t["content"] for t in json.loads(source)["added_tokens"]]
        self.added_starts = sorted({a[0] for a in self.added})
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.known: dict[str, bytes] = {}   # ids of pieces and parts as uint32; a part alone is a piece of one part
        signs = [c for c in string.punctuation if c not in "".join(self.added)
                 and all(self.pattern.findall(x + c) == [x, c] and self.pattern.findall(c + x) == [c, x] for x in ("a", "à", "0"))]
        signs = "".join(rf"\x{ord(c):02x}" for c in signs)
        self.closing = rf"([{LETTERS}])([{signs}]+)([\x09-\x0D\x20]|$)" if signs else None

    def part(self, part: str) -> bytes:
        if (ids := self.known.get(part)) is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = self._keep(part, array("I", [t.id for t in self.whole.model.tokenize(shown)]).tobytes())
        return ids

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(self.known) < MAX_KNOWN:
            self.known[piece] = ids
        return ids

    def _all(self, piece: str) -> bytes:
        return array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()

    def _cut(self, piece: str) -> bytes:
        if not (piece.isprintable() if piece.isascii() else PLAIN.fullmatch(piece)):
            return self._all(piece)
        if piece.isalpha():  # one word: the pattern takes all its letters
            return self.part(piece.lower())
        for start in self.added_starts:
            if start in piece and any(a in piece for a in self.added):
                return self._all(piece)
        return b"".join(map(self.part, self.pattern.findall(piece.lower())))

    def piece(self, piece: str) -> bytes:
        return self._keep(piece, self._cut(piece))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.closing:  # signs that end a word are pieces of their own: a word is then known with any of them
            texts = pc.replace_substring_regex(texts, self.closing, r"\1 \2\3")
        offsets, codes, distinct = words_of(texts)
        pieces = distinct.to_pylist()
        known = list(map(self.known.get, pieces))
        for i in [i for i, ids in enumerate(known) if ids is None]:
            known[i] = self.piece(pieces[i])
        if not len(codes):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        each = pa.array(known, pa.large_binary()).take(pa.array(codes))
        _, ends, ids = each.buffers()
        upto = np.frombuffer(ends, np.int64, len(codes) + 1)[offsets] // 4
        return np.frombuffer(ids or b"", np.uint32, upto[-1]), np.diff(upto)


def _encode_batch(tokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    out = tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
    ids = [np.array(e.ids, np.uint32) for e in out]
    return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.array([len(i) for i in ids], np.int64)


def _segment(shard: int, seq: int, first: int, ids: list[np.ndarray], doc_ids: list, lengths: list[np.ndarray]) -> pa.RecordBatch:
    coded = encode(np.concatenate(ids))
    row = {"shard": shard, "seq": seq, "first": first, "n": coded.n, "words": coded.words.astype("<u8").tobytes(),
           "offsets": coded.offsets.astype("<u4").tobytes(), "escapes": coded.escapes.astype("<u8").tobytes(),
           "doc_ids": doc_ids, "lengths": np.concatenate(lengths).tolist()}
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))


def _with_end(ids: np.ndarray, lengths: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    return (ids, lengths) if end is None else (np.insert(ids, np.cumsum(lengths), end), lengths + 1)


def _encoder(shared, end: int | None, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = shared.value
        if spaced:
            name = f"pieces_{zlib.crc32(source.encode())}"
            forget_worker_state(keep=name)
            to_ids = worker_state(name, lambda: PieceEncoder(source)).batch
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(source)
            to_ids = lambda texts: _encode_batch(whole, texts)
        shard, seq, first, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, doc_ids, lengths = [], [], []
        for part in slices(batches, limit=SLICE):
            i, n = _with_end(*to_ids(part.column("text")), end)
            ids.append(i)
            doc_ids += part.column("doc_id").to_pylist()
            lengths.append(n)
            held += len(i)
            if held >= SEGMENT:
                yield _segment(shard, seq, first, ids, doc_ids, lengths)
                seq, first, held, ids, doc_ids, lengths = seq + 1, first + held, 0, [], [], []
        if doc_ids:
            yield _segment(shard, seq, first, ids, doc_ids, lengths)
    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, *, end: int | None = 2, spaced: bool = True) -> None:
    """Encode every whole text with the tokenizer file, append ``end`` to each document, and write a file set at ``path``."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id")
            .sortWithinPartitions("doc_id", "text"))
    rows.mapInArrow(_encoder(shared, end, spaced), SEGMENTS).write.parquet(path)


def _decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_worker_state()
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode(Coded(r["n"], np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4"),
                               np.frombuffer(r["escapes"], "<u8"))).astype("<u4")
            n = np.array(r["lengths"], np.int64)
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - k:e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard"]] * size, pa.int32()),
                 pa.array(r["first"] + ends - n, pa.int64()), pa.array(n), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "within", "n_tokens", "ids_crc32"])


def _ids_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode(Coded(r["n"], np.frombuffer(r["words"], "<u8"), np.frombuffer(r["offsets"], "<u4"),
                               np.frombuffer(r["escapes"], "<u8"))).astype(np.int64)
            cuts = np.cumsum([0, *r["lengths"]])
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int64()))],
                                             ["doc_id", "ids"])


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of a file set."""
    return spark.read.parquet(path).mapInArrow(_ids_rows, "doc_id long, ids array<long>")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from a file set.

    ``start`` is the number of ids of all documents before it: those of earlier shards (one row each, as many
    as the files have partitions) and those before it in its own.
    """
    files = spark.read.parquet(path)
    base = (files.groupBy("shard").agg(F.sum("n").alias("n"))
            .select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    rows = files.mapInArrow(_decode_rows, "doc_id long, shard int, within long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
