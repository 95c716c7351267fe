"""Token counts by offset-mapped attribution.

Each document is encoded once, whole.  A byte-level BPE splits the text's
UTF-8 bytes without gaps, so the tokens' lengths add up to their spans; spans
and sections are both sorted, and the interval join of the two is a merge by
binary search inside the task that read the document.  A token that crosses a
section's end is allocated by an explicit rule:

* ``first``: to the section that holds its first character;
* ``most``: to the section that holds most of its characters, the earlier if tied;
* ``share``: to each in proportion to its characters.

A token inside a multi-byte character counts as touching that character's
first byte's section; with ``share`` lengths are bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import lean, text_bytes

RULES = ("first", "most", "share")
#: Runs of white space from this length on are encoded apart: the tokenizer's own pattern would run out of stack on them.
LONG_RUN = 10_000
# The characters that the tokenizer's pattern counts as white space, and the part of it that takes runs.
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
_RUN_RULE = r"\s+(?!\S)|\s+"
_encoders: dict[str, tuple] = {}


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            lengths[i] = len(token)
        _encoders[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def encode(encoder, text: str) -> list[int]:
    """The tokenizer's ids of a whole text.

    Its pattern makes a run of white space one piece, but for the run's last
    character if a word follows; long runs are cut out there and encoded as
    the piece they are, so the ids are those of the text in one go.
    """
    if not encoder._pat_str.endswith(_RUN_RULE):
        return encoder.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoder.encode_ordinary(text[at:run.start()])
        ids += encoder._encode_single_piece(text[run.start():end])
        at = end
    return ids + encoder.encode_ordinary(text[at:])


def line_sections(raw: bytes) -> np.ndarray:
    """End byte of every section: a section is a line with its line feed; an empty text is one empty section."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of a section's tokens cross one of its edges.

    Both arrays hold sorted end offsets of gapless spans from 0.  Counts add up
    to the number of tokens under every rule.
    """
    k = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.minimum(np.searchsorted(section_ends, starts, side="right"), k - 1)
    last = np.minimum(np.searchsorted(section_ends, token_ends - 1, side="right"), k - 1)
    whole = first == last
    counts = np.bincount(first[whole], minlength=k).astype(float)
    crossing = np.zeros(k, np.int64)
    edges = np.concatenate([[0], section_ends])
    for t in np.flatnonzero(~whole):
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(edges[parts + 1], token_ends[t]) - np.maximum(edges[parts], starts[t])
        crossing[parts[held > 0]] += 1
        if rule == "share":
            counts[parts] += held / held.sum()
        else:
            counts[parts[0] if rule == "first" else parts[int(np.argmax(held))]] += 1
    return counts, crossing


def token_counts(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, rule: str = "most") -> DataFrame:
    """Tokens of each line of each document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  One row
    per section: ``doc_id, section`` (from 0), ``start_char, end_char`` (code
    points, the line feed included), ``n_tokens`` (double; whole numbers unless
    the rule is ``share``), ``n_crossing`` (tokens that touch this section and
    another one) and ``doc_tokens``.  A document's ``n_tokens`` add up to
    ``doc_tokens``.  A null or empty text is one empty section with no tokens;
    bytes that are not UTF-8 count as U+FFFD;
    repeated rows come back as often as they occur; a null doc_id stays null.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if vocabulary is None:
        import public_tokenizers

        vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                cols: list[list] = [[] for _ in names]
                for doc, raw in zip(c.column(0).to_pylist(), text_bytes(c, "text")):
                    text = (raw or b"").decode("utf-8", "replace")
                    raw = text.encode()
                    ends = np.cumsum(lengths[encode(encoder, text)]) if raw else np.empty(0, np.int64)
                    sections = line_sections(raw)
                    n, crossing = allocate(ends, sections, rule) if len(ends) else (np.zeros(len(sections)), np.zeros(len(sections), np.int64))
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[sections]
                    k = len(sections)
                    for col, values in zip(cols, ([doc] * k, range(k), np.concatenate([[0], chars[:-1]]), chars, n, crossing, [len(ends)] * k)):
                        col.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(run), "doc_id long, section int, start_char long, end_char long, n_tokens double, "
                                "n_crossing long, doc_tokens long")
