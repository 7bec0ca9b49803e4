"""Benchmark decontamination by an FM-index for each training shard.

A shard is a run of documents that one task reads together. Its words become numbers: words of no test phrase are all
one separator, so runs of phrase words stand alone; runs shorter than the shortest phrase cannot hold one and are left
out. Over what remains the task sorts suffixes, builds the Burrows-Wheeler transform as a wavelet matrix with rank counts
and keeps every ``sample``-th suffix position. All distinct phrases are searched backwards together, a symbol a step;
occurrences are located by walking to a sampled position; their spans are merged into word intervals of documents.

Phrases are the ``window``-word windows of each item; a shorter item with words is one phrase. Where all phrases have
more than ``block_words`` words, items are dealt with in blocks of that size, each block against all shards, and the
spans of all blocks are merged, so what is sent to the executors has a fixed bound.

Null texts and texts without words hold nothing and are hit nowhere; a null benchmark text has no phrases, and a null
item id stands as an empty string. Repeated rows give repeated results; an empty benchmark hits nothing. Very long texts
are indexed whole, in a shard of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenflux.llm import common

#: Bytes to word bytes, or to a blank: digits, letters in lower case and everything beyond ASCII make words.
_FOLD = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split(b" ") if text else []


def _words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Phrases:
    """Distinct phrases as rows of word numbers, grouped by length, with the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = _words(text)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                found.setdefault(tuple(w[i : i + n]), set()).add(item)
        self.number: dict[bytes, int] = {}
        for phrase in found:
            for w in phrase:
                self.number.setdefault(w, len(self.number) + 1)  # 0 is the separator
        self.items = [sorted(x) for x in found.values()]
        self.length = np.array([len(p) for p in found], np.int64)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        width = int(self.length.max()) if len(self.length) else 0
        self.symbols = np.zeros((len(found), width), np.int32)  # from the last word to the first
        for i, p in enumerate(found):
            self.symbols[i, : len(p)] = [self.number[w] for w in reversed(p)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of runs that end in 0; each 0 differs from all others, in order of position. Prefix doubling."""
    n, ends = len(text), np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)  # of a suffix: the first row of those that tie with it
    rows, key = np.arange(n), key[order]
    step = 1
    while True:
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(fresh)
        size = np.diff(np.concatenate((head, [len(key)])))
        rank[order[rows]] = np.repeat(rows[head], size)
        rows = rows[np.repeat(size > 1, size)]  # ties hold no 0, so the symbols that follow are inside the text
        if not len(rows):
            return order
        tied = order[rows]
        key = rank[tied] * (n + 1) + rank[tied + step]
        again = np.argsort(key, kind="stable")
        order[rows], key = tied[again], key[again]
        step *= 2


class WaveletMatrix:
    """Rank over a sequence of small integers: a level a bit, zeros before ones."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(bit) - self.levels[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, at = np.zeros_like(place), place
        for k, ones in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low1, at1 = ones[low], ones[at]
            low = np.where(bit == 1, self.zeros[k] + low1, low - low1)
            at = np.where(bit == 1, self.zeros[k] + at1, at - at1)
        return at - low

    def access(self, place: np.ndarray) -> np.ndarray:
        value = np.zeros_like(place)
        for k, ones in enumerate(self.levels):
            bit = ones[place + 1] - ones[place]
            value = 2 * value + bit
            place = np.where(bit == 1, self.zeros[k] + ones[place], place - ones[place])
        return value


class FMIndex:
    """Backward search and location over runs of word numbers, each run closed by 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8):
        suffixes = suffix_array(text)
        self.n = len(text)
        last = text[suffixes - 1]  # the symbol before; before the first stands the last, which is a 0
        self.tree = WaveletMatrix(last.astype(np.int64), max(1, int(alphabet).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 2))))
        # Zeros are told apart by position, but the transform shows one symbol for all: a walk never steps over one.
        kept = (suffixes % sample == 0) | (last == 0)
        self.marked = np.concatenate(([0], np.cumsum(kept, dtype=np.int64)))
        self.positions = suffixes[kept]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases given from the last symbol to the first."""
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        for k in range(symbols.shape[1]):
            live = np.flatnonzero((k < length) & (low < high))
            if not len(live):
                break
            s = symbols[live, k].astype(np.int64)
            low[live] = self.first[s] + self.tree.rank(s, low[live])
            high[live] = self.first[s] + self.tree.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.marked[at + 1] > self.marked[at]
            out[live[hit]] = self.positions[self.marked[at[hit]]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            s = self.tree.access(at)
            at = self.first[s] + self.tree.rank(s, at)
            steps[live] += 1
        return out


def search_shard(docs: list[np.ndarray], phrases: Phrases, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, phrase) of each occurrence in the shard's documents, given as word numbers."""
    none = (np.zeros(0, np.int64),) * 3
    if not phrases.shortest:
        return none
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.zeros(int(sizes.sum()) + len(docs), np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    for i, d in enumerate(docs):
        flat[starts[i] : starts[i] + len(d)] = d
    stops = np.flatnonzero(flat == 0)
    begins = np.concatenate(([0], stops[:-1] + 1))
    long = stops - begins >= phrases.shortest
    begins, stops = begins[long], stops[long]
    if not len(begins):
        return none
    lengths = stops - begins + 1  # each with its 0
    ends = np.cumsum(lengths)
    source = np.arange(ends[-1]) + np.repeat(begins - (ends - lengths), lengths)
    index = FMIndex(flat[source], len(phrases.number), sample)
    low, high = index.search(phrases.symbols, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(low)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = source[index.locate(rows)]
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], which


def merge(first: np.ndarray, length: np.ndarray) -> list[tuple[int, int]]:
    """Union of [first, first + length) as disjoint intervals."""
    order = np.argsort(first, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(first[order].tolist(), (first + length)[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as intervals of UTF-8 bytes, from the first byte of the first word to the end of the last."""
    b = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], b.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(begin[i]), int(end[j - 1])) for i, j in spans]


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    block: list[tuple[str, str | None]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        n = len(_words(r["t"]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    sample: int = 8,
    shard_words: int = 2_000_000,
    block_words: int = 500_000,
    clean: bool = False,
) -> DataFrame:
    """A row for each document: ``keep``, ``n_words``, ``spans`` (merged word intervals), ``items`` (sorted ids).

    With ``clean`` also ``text``: the text without the bytes of the spans, a line break in place of each. Null ids and repeated
    rows are rows like any other. Other columns are not read; a column to keep that is named like a result raises.
    """
    common.free_names(keep, ("n_words", "spans", "items", *["text"] * clean))
    spark = docs.sparkSession
    common.bound_batches(spark)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    names = [*keep, "n_words", "spans", "items"] + ["text"] * clean
    extra = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*own.schema.fields[:-1], *extra] + [T.StructField("text", T.StringType())] * clean)
    blocks = [Phrases(b, window) for b in _blocks(benchmark, item_id, item_text, block_words)]
    shared = [spark.sparkContext.broadcast(p) for p in blocks]  # each of at most block_words words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [s.value.number.get for s in shared]

        def flush() -> pa.RecordBatch:
            spans: list[list[tuple[int, int]]] = [[] for _ in n_words]
            items: list[set[str]] = [set() for _ in n_words]
            for s, docs_of in zip(shared, numbers):
                phrases = s.value
                doc, first, which = search_shard(docs_of, phrases, sample)
                order = np.argsort(doc, kind="stable")
                cuts = np.flatnonzero(np.diff(doc[order])) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    i = int(doc[part[0]])
                    hits = merge(first[part], phrases.length[which[part]])
                    spans[i] = merge(*np.array([(a, b - a) for a, b in spans[i] + hits]).T) if spans[i] else hits
                    items[i].update(x for p in set(which[part].tolist()) for x in phrases.items[p])
            rows = pa.Table.from_batches(held).combine_chunks()
            columns = [
                *(rows.column(k).combine_chunks() for k in range(len(keep))),
                pa.array(n_words, pa.int64()),
                pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            ]
            if clean:
                columns.append(pa.array([remove(t, x) for t, x in zip(texts, spans)], pa.string()))
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

        held, texts, n_words, numbers = [], [], [], [[] for _ in shared]
        for batch in batches:
            held.append(batch.select(range(len(keep))))
            for text in batch.column(len(keep)).to_pylist():
                words = [w for w in words_of(text) if w]
                n_words.append(len(words))
                texts.append(text if clean else None)
                for get, out in zip(lookups, numbers):
                    out.append(np.array([get(w, 0) for w in words], np.int32))
            if sum(n_words) >= shard_words:
                yield flush()
                held, texts, n_words, numbers = [], [], [], [[] for _ in shared]
        if n_words:
            yield flush()

    return own.mapInArrow(run, schema)


def remove(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans or text is None:
        return text
    raw, out, at = text.encode("utf-8", "replace"), [], 0
    for a, b in byte_spans(text, spans):
        out += [raw[at:a], b"\n"]
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8")


def n_hit() -> Column:
    """Words inside the spans."""
    return F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
