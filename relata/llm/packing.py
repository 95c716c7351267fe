"""Packing: concatenate and cut, with global offsets from a two-pass prefix sum.

Pass 1 tokenizes every document once, writes its ids to the shared checkpoint
folder and sums the tokens of each partition.  Prefix sums over the partition
totals (one number per partition) give each partition its place in the stream
of all tokens.  Pass 2 walks each partition from that place and cuts the
stream into windows of fixed length; a document that crosses a window's end is
cut there, and both pieces carry boundary records.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import checkpoint, gather, lean, split_coded

WINDOW = 2048
END_ID = 1
#: Rows whose distinct words are encoded together, and the bytes of text after which fewer rows are taken.
ROWS, BYTES = 4096, 1 << 24
# The tokenizer's own word pattern, and its special tokens' first characters.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPECIAL = "<|"
_MARKS = ".,;:!?"
#: Latin letters (but U+0130, whose lower case is two characters), then at most one mark.
_PLAIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,;:!?]?$"


_loaded: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer, whether it splits by the word pattern, and which ids end a word."""
    if path in _loaded:
        return _loaded[path]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    tokenizer = Tokenizer.from_file(path)
    steps = (json.loads(tokenizer.to_str()).get("pre_tokenizer") or {}).get("pretokenizers", [])
    vocabulary = tokenizer.get_vocab()
    ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    _loaded[path] = tokenizer, _WORD.pattern in [x.get("pattern", {}).get("Regex") for x in steps], ends_word
    return _loaded[path]


class _Encoder:
    """Ids of whole texts, a batch at a time; nothing is kept between batches.

    The tokenizer never joins across white space, nor across words of its
    pattern, so a document's ids are its words' ids in order, and a batch's
    distinct words are encoded once, together.  Chunks between white space with
    letters beyond Latin, where the libraries' character tables could differ,
    and chunks that may hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer, self.by_word, self.ends_word = _tokenizer(path)

    def _whole(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _vocabulary(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of the pattern, encoded as one text: each word ends at its only id that ends a word."""
        flat, sizes = [], []
        for at in range(0, len(words), 10_000):
            some = words[at:at + 10_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                flat.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                whole = self._whole(some)
                flat.append(np.frombuffer(b"".join(whole), "<u4"))
                sizes.append(np.array([len(x) // 4 for x in whole]))
        return np.concatenate([np.empty(0, "<u4"), *flat]), np.concatenate([np.empty(0, np.int64), *sizes]).astype(np.int64)

    @staticmethod
    def _words(c: bytes) -> list[bytes] | None:
        """The chunk's words in lower case; None for a chunk that is encoded whole."""
        text = c.decode("utf-8", "replace")
        if _SPECIAL in text or not text or max(text) >= "\u0250":
            return None
        return [w.encode() for w in _WORD.findall(text.lower())]  # below U+0250 lower case is all that the normalizer does

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has."""
        raw = chunks.cast(pa.large_binary() if pa.types.is_large_string(chunks.type) else pa.binary())
        plain = pc.match_substring_regex(chunks, _PLAIN) if self.by_word else pa.array(np.zeros(len(chunks), bool))
        rest = raw.filter(pc.invert(plain)).to_pylist()
        split = [self._words(c) if self.by_word else None for c in rest]

        # plain chunks: a word, then at most one mark
        lower = pc.utf8_lower(chunks.filter(plain))
        stems = pc.utf8_rtrim(lower, characters=_MARKS).dictionary_encode()
        marks = pc.index_in(pc.utf8_slice_codeunits(lower, -1), pa.array(list(_MARKS), lower.type))
        words = [*stems.dictionary.to_pylist(), *_MARKS]
        place = {w.encode(): i for i, w in enumerate(words)} if rest else {}
        words = [w.encode() for w in words]
        parts = [np.array([place.setdefault(w, len(place)) for w in ws], np.int64) for ws in split if ws is not None]
        words += list(place)[len(words):]
        flat, size = self._vocabulary(words)

        pairs = np.stack([stems.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                          marks.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
        pairs[:, 1] += np.where(pairs[:, 1] >= 0, len(stems.dictionary), 0)
        ids, sizes = gather(flat, size, pairs[pairs >= 0])
        of = np.repeat(np.arange(len(pairs)), (pairs >= 0).sum(axis=1))
        n_plain = np.bincount(of, sizes, len(pairs)).astype(np.int64)
        more, more_sizes = gather(flat, size, np.concatenate([np.empty(0, np.int64), *parts]))
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        n_words = np.bincount(of, more_sizes, len(parts)).astype(np.int64)
        whole = self._whole([c for c, ws in zip(rest, split) if ws is None])
        n_whole = np.array([len(x) // 4 for x in whole], np.int64)

        # back to the chunks' order
        plain = plain.to_numpy(zero_copy_only=False)
        kind = np.zeros(len(chunks), np.int64)
        kind[~plain] = [1 if ws is not None else 2 for ws in split]
        order = np.empty(len(chunks), np.int64)
        order[np.argsort(kind, kind="stable")] = np.arange(len(chunks))
        every = np.concatenate([ids, more, np.frombuffer(b"".join(whole), "<u4")])
        return gather(every, np.concatenate([n_plain, n_words, n_whole]), order)

    def ids(self, batch: pa.RecordBatch, column: str, kind: str = "<u4") -> list[bytes]:
        """The ids of whole texts (null: none), packed as ``kind``."""
        chunks, index, counts = split_coded(batch, column)
        ids, sizes = gather(*self._distinct(chunks), index)
        ends, ids = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)], ids.astype(kind)
        return [ids[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1]], ends)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``ROWS`` rows and, beyond the first row, ``BYTES`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size.astype(np.int64)), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right"))
        n = max(1, min(ROWS, full - at))
        yield batch.slice(at, n)
        at += n


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack the documents' tokens into sequences of ``window`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  One row
    per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` as in the stream, ``ids`` (the piece itself, little-endian uint32),
    and the boundary records ``cut_before`` and ``cut_after`` (the document
    goes on in the sequence before or after).

    A document's ids are its text's, then ``end_id``; a null or empty text is
    ``end_id`` alone.  Each input row is a document of its own, also where rows
    or ids repeat; a null doc_id stays null.  Only the last sequence is short.
    An empty table gives no rows.
    """
    path = tokenizer or public_tokenizer()
    kind = "<u2" if max(_tokenizer(path)[2].size, end_id) < 1 << 16 else "<u4"  # as stored between the passes
    end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = _Encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for c in _slices(b):
                ids = [x + end for x in encoder.ids(c, "text", kind)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(range(pos, pos + len(ids)), pa.int64()), c.column(0),
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in ids], pa.binary())],
                    names=["part", "pos", "doc_id", "n", "ids"])
                pos += len(ids)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stream = checkpoint(docs.mapInArrow(lean(tokenize), "part int, pos long, doc_id long, n long, ids binary"))
    totals = stream.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row per partition
    place, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        place[r.part], at = at, at + r.n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            rows: list[tuple] = []
            for part, pos, doc, n, packed in zip(*(c.to_pylist() for c in b.columns)):
                if at is None or pos == 0:
                    at = place[part]
                ids = np.frombuffer(pa.decompress(packed, width * n, codec="zstd"), kind).astype("<u4").tobytes()
                start = 0
                while start < n:
                    take = min(window - at % window, n - start)
                    piece = ids[4 * start:4 * (start + take)]
                    rows.append((doc, start, take, zlib.crc32(piece), n, at // window, at % window, piece, start > 0, start + take < n))
                    start, at = start + take, at + take
            kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "cut_before", "cut_after"]
    return stream.mapInArrow(
        lean(cut), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
             "ids binary, cut_before boolean, cut_after boolean")
