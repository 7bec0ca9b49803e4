"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of a model holds a whitespace marker after another character, merges never cross from one marked
word to the next, so a text's ids are the ids of its marked words put side by side. Each task keeps a table of the
distinct words that it has met, segments every new one once with the library and joins ids back by position; the
library then decodes each text's ids. No shuffle; the table is emptied when it passes ``table_size`` words, so memory
is bounded and results stay exact. A model with crossing pieces is encoded text by text instead.

Null texts count as empty; an empty text has no ids and decodes to the empty string. Repeated rows give repeated
results, an empty table an empty one, and other columns are passed by or kept as ``keep`` says. A literal U+2581
is a marker to the model and decodes to a space, as in the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenflux.llm import common

MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")


def crossing_pieces(processor) -> bool:
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def marked_words(text: str) -> list[str]:
    """Words of ``text`` after the leading marker of each; joined by one space they give the text."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


class _Numbers(dict):
    """Word to number; an unknown word gets the next one and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class ChunkTable:
    """Ids of distinct marked words, as flat arrays indexed by word number."""

    def __init__(self, processor, size: int):
        self.sp, self.size = processor, size
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.ids, self.starts, self.used = np.empty(1 << 16, np.int32), np.zeros(1 << 15, np.int64), 0

    def lone_marker(self) -> list[int]:
        piece = self.sp.piece_to_id(MARK)
        return [piece] if piece != self.sp.unk_id() else [self.sp.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()]

    def segment_new(self) -> None:
        words, self.number.new = self.number.new, []
        n = len(self.number) - len(words)
        found = self.sp.encode(words, num_threads=1)
        if "" in words:  # a marker at the end of a text; the library adds none to an empty text
            found[words.index("")] = self.lone_marker()
        flat = np.fromiter(chain.from_iterable(found), np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.empty_like(self.starts)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and all ids."""
        if len(self.number) > self.size:
            self.clear()
        parts = [marked_words(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        word = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if self.number.new:
            self.segment_new()
        starts = self.starts[word]
        lengths = self.starts[word + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
        return np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))], ids


def _table(model: bytes, size: int) -> ChunkTable:
    import sentencepiece

    return ChunkTable(sentencepiece.SentencePieceProcessor(model_proto=model), size)


def _encode_whole(sp, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = sp.encode(texts, num_threads=1)
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in found]))).astype(np.int64)
    return offsets, np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))


def encode(
    docs: DataFrame,
    model_path: str,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    table_size: int = 1_000_000,
    piece_chars: int = 1 << 20,
) -> DataFrame:
    """Columns ``keep``, then ``ids array<int>`` and ``decoded string``, a row for each row of ``docs``.

    Other columns are not read; a column to keep that is named like a result raises.
    """
    common.free_names(keep, ("ids", "decoded"))
    import sentencepiece

    common.bound_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    whole = crossing_pieces(sentencepiece.SentencePieceProcessor(model_proto=model))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model, table_size)  # of this task: workers outlive it, several to a core, and would each hold one
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            first = 0
            while first < len(texts):  # slices of bounded length; a very long text is one slice
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last]) <= piece_chars):
                    chars += len(texts[last])
                    last += 1
                part = texts[first:last]
                offsets, ids = _encode_whole(table.sp, part) if whole else table.encode(part)
                listed, cuts = ids.tolist(), offsets.tolist()
                decoded = table.sp.decode([listed[a:b] for a, b in zip(cuts, cuts[1:])], num_threads=1)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns = [c.slice(first, last - first) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, lists, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"]
                )
                first = last

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(common.tidy(run), schema)


def decode(encoded: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The library's ``decode`` of each row's ids, as another column; null ids decode to the empty string."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = [sp.decode(i) if i else "" for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    return encoded.mapInArrow(run, schema)
