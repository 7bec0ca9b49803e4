"""Removal of long repeats by a run-length index.

Every byte inside a string of ``length`` bytes that also starts earlier (smaller id, or same document and earlier place) is
marked. The corpus is first cut so that equal strings are sure to meet in one shard: each window of ``length`` bytes belongs
to the least-hashed ``gram``-byte string inside it (its anchor), and consecutive windows of one anchor make one context.
Equal windows have equal anchors, so shards are ranges of anchor hashes and the result does not depend on how many there are.

Equal contexts (equal in anchor, extent and a 128-bit digest of their bytes) collapse, in the reading task first and in the
shard again: all but the earliest are repeats from end to end. Where an anchor stands in several different contexts, the
shard joins these in document order and builds their run-compressed Burrows-Wheeler transform. Of it stay the runs and, at
the head of each, the place of its suffix, the place of the suffix before it and the length of their match; the suffix array
goes. Inside a run the place before moves on with the place and a match only grows shorter by one, so the samples stream
both for every place; stretches of neighbours that match for ``length`` bytes are the equal windows, and all but the first
in document order are marked. Only contexts of such anchors are fetched as bytes, and only documents with marks are
joined with them; a bitmap of fixed size keeps most others out of both shuffles.

Null texts count as empty and lose nothing; texts below ``length`` bytes neither. Null ids come first. Rows equal in id and
text are one document and get one result; rows that share an id but differ are ordered by hash of the text. Texts of any
length are read in one piece of their own batch. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eigenflux.llm import common

_U = np.uint64
_TABLE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
_LEAST = -(1 << 63)
#: Bits of a window minimum that hold its place.
_PLACE = 26
#: Bytes that are hashed together, as each takes some dozens more on the way; contexts do not depend on it but at the ends of pieces of a text that is longer.
_BLOB = 1 << 20
#: Records of a reading task that are sorted and collapsed together.
_FLUSH = 600_000
#: Symbols of contexts that one index holds; an anchor's contexts always stay together.
_INDEX = 3_000_000

_RECORD = np.dtype([("a", "<u8"), ("c", "<u8"), ("e", "<u8"), ("d", "<i8"), ("r", "<i4"), ("p", "<i4"), ("lo", "<u2"), ("n", "<u2")])
#: What equal contexts agree in: anchor, both halves of a 128-bit digest of the bytes, and the bytes' extent.
_SAME = ("a", "c", "e", "lo", "n")
#: Longest strings whose contexts a record can describe.
LONGEST = 1 << 16


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on; doubling, then a finisher."""
    h, width, power = _TABLE[data], 1, _U(0x9E3779B97F4A7C15)
    out, have, factor = None, 0, _U(1)
    with np.errstate(over="ignore"):
        while width <= gram:
            if gram & width:  # out covers ``have`` bytes; put this block before the rest
                out = h if out is None else h[: len(out) - width] * factor + out[width:] if width < len(out) else h[:0]
                factor = factor * power
                have += width
            if 2 * width > gram:
                break
            h = h[: len(h) - width] * power + h[width:] if width < len(h) else h[:0]
            power = power * power
            width *= 2
            factor = factor if have else _U(1)
        out = out[: max(0, len(data) - gram + 1)]
        out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> _U(32))) * _U(0x94D049BB133111EB)
    return out ^ (out >> _U(29))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def contexts(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each context: text, first window, last window, anchor place (inside the text), anchor hash, digest (two numbers)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U)), np.zeros((0, 2), _U))
    blob = b"".join(texts)
    if len(blob) < length:
        return none
    most = min(_BLOB, 1 << _PLACE)
    if len(blob) >= most:
        if len(texts) > 1:
            half = len(texts) // 2
            x, y = contexts(texts[:half], length, gram), contexts(texts[half:], length, gram)
            return tuple(np.concatenate((a, b + half if k == 0 else b)) for k, (a, b) in enumerate(zip(x, y)))
        step, parts = most - length, []  # one very long text, in pieces that share length - 1 bytes
        for at in range(0, len(blob) - length + 1, step):
            part = contexts([blob[at : at + step + length - 1]], length, gram)
            parts.append((part[0], part[1] + at, part[2] + at, part[3] + at, part[4], part[5]))
        return tuple(np.concatenate(c) for c in zip(*parts))
    data = np.frombuffer(blob, np.uint8)
    hashes = gram_hashes(data, gram)
    key = (hashes >> _U(_PLACE) << _U(_PLACE)) | np.arange(len(hashes), dtype=_U)
    least = (window_minima(key, length - gram + 1) & _U((1 << _PLACE) - 1)).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + length <= starts[owner + 1])  # windows inside one text
    if not len(valid):
        return none
    at = least[valid]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[valid][1:] != owner[valid][:-1])))
    first = valid[new]
    last = valid[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(valid) - 1]))]
    view, digest = memoryview(blob), xxhash.xxh3_128_digest
    marks = np.frombuffer(b"".join([digest(view[f:e]) for f, e in zip(first.tolist(), (last + length).tolist())]), _U).reshape(-1, 2)
    doc, place = owner[first], at[new]
    return doc, first - starts[doc], last - starts[doc], place - starts[doc], hashes[place], marks


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of symbols below 257 in runs that end in 0, each 0 below all else and in order of place; and 7-symbol keys."""
    n = len(text)
    key, clear, closed = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)
    for j in range(7):
        s = np.concatenate((text[j:], np.zeros(min(j, n), text.dtype))).astype(np.int64)
        key = key * 257 + np.where(clear, s, 0)
        closed |= clear & (s == 0)
        clear &= s != 0
    keys = key
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rows, key, lone = np.arange(n), key[order], closed[order]  # keys with a 0 differ from all others
    step = 7
    while True:
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | lone[1:] | lone[:-1]))
        head = np.flatnonzero(fresh)
        size = np.diff(np.concatenate((head, [len(key)])))
        rank[order[rows]] = np.repeat(rows[head], size)
        rows = rows[np.repeat(size > 1, size)]
        if not len(rows):
            return order, keys
        tied = order[rows]
        key = rank[tied] * (n + 1) + rank[tied + step]
        again = np.argsort(key, kind="stable")
        order[rows], key = tied[again], key[again]
        lone = np.zeros(len(key), bool)
        step *= 2


class RunIndex:
    """Run-compressed transform of contexts: the runs' symbols, and at the head of each run the places of its suffix and of
    the suffix before it in suffix order, with the length of their match. Neither the suffix array nor the text is kept.
    """

    def __init__(self, text: np.ndarray):
        order, keys = suffix_array(text)
        self.size = len(text)
        last = text[order - 1]
        # A 0 differs from every other 0, so each is a run of its own.
        heads = np.flatnonzero(np.concatenate(([True], (last[1:] != last[:-1]) | (last[1:] == 0))))
        place, before = order[heads], order[np.maximum(heads - 1, 0)]
        match = _common(text, place, before, keys)
        match[0] = 0  # nothing comes before the first suffix
        self.lengths = np.diff(np.append(heads, self.size))
        self.symbols = last[heads]
        by_place = np.argsort(place)
        self.place, self.before, self.match = place[by_place], before[by_place], match[by_place]

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place in text order, the place before it in suffix order and the length of their match.

        Inside a run the place before moves on with the place itself and the match grows shorter by one, so the sample last
        passed tells both.
        """
        at = np.arange(self.size)
        sample = np.searchsorted(self.place, at, side="right") - 1
        gone = at - self.place[sample]
        match = np.where(sample >= 0, np.maximum(self.match[sample] - gone, 0), 0)
        return np.where(match > 0, self.before[sample] + gone, at), match

    def match_lengths(self) -> np.ndarray:
        return self.stream()[1]

    def later_copies(self, length: int) -> np.ndarray:
        """Whether a string of ``length`` symbols starts at each place that also starts at a smaller one."""
        before, match = self.stream()
        at = np.flatnonzero(match >= length)
        first = np.arange(self.size)
        first[at] = before[at]
        while len(at):  # to the first place of each stretch of neighbours that match, in doubling steps
            step = first[first[at]]
            moved = step != first[at]
            first[at] = step
            at = at[moved]
        copies = np.flatnonzero(match >= length)
        least = np.arange(self.size)
        np.minimum.at(least, first[copies], copies)
        out = np.zeros(self.size, bool)
        out[copies] = copies > least[first[copies]]
        roots = np.unique(first[copies])
        out[roots] = roots > least[roots]
        return out


def _common(text: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes, up to the first 0."""
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    end = len(text) - 1
    while len(live):  # seven symbols a step while whole keys agree and hold no 0
        same = (keys[i] == keys[j]) & (keys[i] % 257 != 0)
        out[live[same]] += 7
        tail, a, b = live[~same], i[~same], j[~same]
        going = np.ones(len(tail), bool)
        for k in range(7):
            x = text[np.minimum(a + k, end)]
            going &= (x == text[np.minimum(b + k, end)]) & (x != 0)
            out[tail[going]] += 1
        live, i, j = live[same], i[same] + 7, j[same] + 7
    return out


def _pack(bucket: int, records: np.ndarray) -> tuple[int, bytes]:
    return bucket, b"".join(np.ascontiguousarray(records[f]).tobytes() for f in _RECORD.names)


def _unpack(payload: bytes) -> np.ndarray:
    n = len(payload) // _RECORD.itemsize
    out, at = np.empty(n, _RECORD), 0
    for f in _RECORD.names:
        kind = _RECORD.fields[f][0]
        out[f] = np.frombuffer(payload, kind, n, at)
        at += n * kind.itemsize
    return out


def _differ(records: np.ndarray) -> np.ndarray:
    """Whether each record's context is another than the one before it."""
    new = np.ones(len(records), bool)
    new[1:] = False
    for f in _SAME:
        new[1:] |= records[f][1:] != records[f][:-1]
    return new


def _collapse(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest record of each equal context, and all others."""
    with np.errstate(over="ignore"):
        key = (records["a"] * _U(0x9E3779B97F4A7C15)) ^ records["c"]
    order = np.argsort(key, kind="stable")
    k = key[order]
    near = np.concatenate(([False], k[1:] == k[:-1]))
    if not near.any():
        return records, records[:0]
    near |= np.concatenate((near[1:], [False]))
    one, rest = records[order[~near]], records[order[near]]
    rest = rest[np.lexsort((rest["p"], rest["r"], rest["d"], *(rest[f] for f in _SAME)))]  # keys may collide; contexts decide
    new = _differ(rest)
    same = ~new
    for f in ("d", "r", "p"):
        same[1:] &= rest[f][1:] == rest[f][:-1]
    return np.concatenate((one, rest[new])), rest[~new & ~same]  # a row given twice is the same record


_MARK = "d long, r int, a long, b long"
_SAYS = "kind int, d long, r int, a long, b long, lo int, anchor long"


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``d`` (id, nulls least), ``r`` (0, or the order among rows that share the id), ``text``, ``doc_id``."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("d"), F.col(f"`{text_col}`").alias("text"))
    if own.groupBy("d").count().where("count > 1").isEmpty():
        return own.withColumn("r", F.lit(0))
    rank = F.dense_rank().over(Window.partitionBy("d").orderBy(F.xxhash64("text"))) - 1
    return common.materialize(own.withColumn("r", rank.cast("int")), "repeats-keyed")


def marks(docs: DataFrame, *, length: int = 100, gram: int = 24, text_col: str = "text", shard_mb: int = 4, bitmap_bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """The keyed documents and the byte intervals ``[a, b)`` to remove, ``(d, r, a, b)``; intervals may overlap."""
    if not gram <= length < LONGEST:
        raise ValueError(f"length must be from {gram} to {LONGEST - 1}")
    spark = docs.sparkSession
    common.bound_batches(spark)
    keyed = _keyed(docs, text_col)
    shards = int(min(50_000, max(2 * spark.sparkContext.defaultParallelism, common.input_bytes(docs, text_col) // (shard_mb << 20))))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            first, again = _collapse(np.concatenate(held))
            out = []
            for sign, part in ((0, first), (1, again)):
                at = (part["a"] % _U(shards)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(at[order])) + 1, [len(order)]))
                out += [(*_pack(int(at[order[x]]), part[order[x:y]]), sign) for x, y in zip(cuts[:-1], cuts[1:]) if y > x]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.int32()))], names=["shard", "payload", "again"])

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            doc, first, last, place, anchor, mark = contexts(texts, length, gram)
            records = np.empty(len(doc), _RECORD)
            records["a"], records["p"], records["lo"], records["n"] = anchor, first, place - first, last - first
            records["c"], records["e"] = mark[:, 0], mark[:, 1]
            records["d"], records["r"] = np.asarray(batch.column(0))[doc], np.asarray(batch.column(1))[doc]
            held.append(records)
            if sum(map(len, held)) >= _FLUSH:
                yield flush()
                held = []
        if sum(map(len, held)):
            yield flush()

    def rows(kind: int, part: np.ndarray) -> list[pa.Array]:
        p = part["p"].astype(np.int64)
        return [
            pa.array(np.full(len(part), kind, np.int32)), pa.array(part["d"]), pa.array(part["r"]), pa.array(p),
            pa.array(p + part["n"] + length), pa.array(part["lo"].astype(np.int32)), pa.array(part["a"].view(np.int64)),
        ]

    names = ["kind", "d", "r", "a", "b", "lo", "anchor"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for b in batches:
            for payload, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                records = _unpack(payload)
                if again:
                    yield pa.RecordBatch.from_arrays(rows(0, records), names=names)
                else:
                    found.append(records)
        if not found:
            return
        first, again = _collapse(np.concatenate(found))
        first = first[np.argsort(first["a"], kind="stable")]
        new = np.concatenate(([True], first["a"][1:] != first["a"][:-1]))
        several = first[~new | np.concatenate((~new[1:], [False]))]
        for kind, part in ((0, again), (1, several)):
            for at in range(0, len(part), 100_000):
                yield pa.RecordBatch.from_arrays(rows(kind, part[at : at + 100_000]), names=names)

    sent = keyed.select("d", "r", "text").mapInArrow(anchors, "shard int, payload binary, again int")
    common.bound_batches(spark, rows=2000)
    said = common.materialize(sent.repartitionById(shards, F.col("shard")).mapInArrow(meet, _SAYS), "repeats-said")

    asked = said.where("kind = 1")
    bits = spark.sparkContext.broadcast(common.bitmap(asked, "d", bitmap_bits))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.in_bitmap(bits.value, b.column(0))))

    texts = keyed.select("d", "r", "text").mapInArrow(may, "d long, r int, text string").dropDuplicates(["d", "r"])
    wanted = asked.groupBy("d", "r").agg(F.collect_list(F.struct("a", "b", "anchor")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, r, text, want in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(w["anchor"] % shards, w["anchor"], d, r, w["a"], raw[w["a"] : w["b"]]) for w in want]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["shard", "anchor", "d", "r", "a", "bytes"])

    pieces = texts.join(wanted, ["d", "r"]).select("d", "r", "text", "want").mapInArrow(fetch, "shard int, anchor long, d long, r int, a long, bytes binary")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for batch in batches:  # sorted by anchor
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                if row[0] != anchor and size >= _INDEX:
                    yield from _indexed(held, length)
                    held, size = [], 0
                anchor = row[0]
                held.append(row[1:])
                size += len(row[4]) + 1
        if held:
            yield from _indexed(held, length)

    more = pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("anchor").mapInArrow(index, _MARK)
    more = common.materialize(more, "repeats-index")
    return keyed, said.where("kind = 0").select("d", "r", "a", "b").union(more)


def _indexed(held: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Marks of contexts ``(d, r, place, bytes)`` that one index holds."""
    held.sort(key=lambda x: x[:3])
    sizes = np.array([len(x[3]) + 1 for x in held], np.int64)
    text = np.frombuffer(b"\0".join(x[3] for x in held) + b"\0", np.uint8).astype(np.int16) + 1
    text[np.cumsum(sizes) - 1] = 0
    later = RunIndex(text).later_copies(length)
    edge = np.diff(np.concatenate(([0], later.view(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.cumsum(sizes) - sizes
    which = np.searchsorted(starts, first, side="right") - 1
    place = np.array([x[2] for x in held], np.int64)[which] + first - starts[which]
    if len(first):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array([x[0] for x in held], np.int64)[which]), pa.array(np.array([x[1] for x in held], np.int32)[which]),
                pa.array(place), pa.array(place + (end - first) - 1 + length),
            ],
            names=["d", "r", "a", "b"],
        )


def remove(docs: DataFrame, *, length: int = 100, gram: int = 24, text_col: str = "text", bitmap_bits: int = 1 << 23) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs of bytes) and ``kept`` (remaining bytes) of every row."""
    spark = docs.sparkSession
    keyed, found = marks(docs, length=length, gram=gram, text_col=text_col, bitmap_bits=bitmap_bits)
    bits = spark.sparkContext.broadcast(common.bitmap(found, "d", bitmap_bits))
    kind = keyed.select("doc_id").schema.fields[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<first:long,end:long>>, kept binary"
    names = ["doc_id", "n_bytes", "spans", "kept"]
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def cut(ids: pa.Array, texts: list[str | None], lists: list) -> pa.RecordBatch:
        sizes, spans, kept = [], [], []
        for text, marked in zip(texts, lists):
            raw = (text or "").encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for m in sorted((m["a"], m["b"]) for m in marked or ()):
                if runs and m[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], m[1])
                else:
                    runs.append(list(m))
            at, parts = 0, []
            for a, b in runs:
                parts.append(raw[at:a])
                at = b
            sizes.append(len(raw))
            spans.append([{"first": a, "end": b} for a, b in runs])
            kept.append(b"".join([*parts, raw[at:]]))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~common.in_bitmap(bits.value, b.column(1))))
            texts = b.column(2).to_pylist()
            yield cut(b.column(0), texts, [None] * len(texts))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.in_bitmap(bits.value, b.column(1))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield cut(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())

    marked = keyed.select("doc_id", "d", "text", "r").mapInArrow(may, f"doc_id {kind}, d long, text string, r int")
    by_doc = found.groupBy("d", "r").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    cutting = marked.join(by_doc, ["d", "r"], "left").select("doc_id", "text", "marks").mapInArrow(apply, schema)
    return keyed.select("doc_id", "d", "text").mapInArrow(whole, schema).union(cutting)
