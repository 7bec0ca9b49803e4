"""Document fingerprints: a canonical exact digest.

The canonical form of a text is its NFKC form with case folded (NFKC again, as folding can undo it) and each run of white
space as one blank, none at the ends. The fingerprint is the 128-bit xxhash of the canonical form's UTF-8 bytes, 32 hex
digits; two fingerprints are alike with 1.0 if they are equal and 0.0 if not.

``classes`` groups documents by fingerprint and compares bytes inside equal buckets. Only members of buckets of two or more
travel: a bitmap of fixed size, filled with the repeated fingerprints, turns most others away before the shuffle (a false
alarm costs a row of shuffle, no error). Buckets with over a thousandth of all rows, so at most a thousand, are salted and
their parts' representatives are compared in a second step. A bucket of different bytes falls into several classes.

``with_next`` gives each document its successor by ascending id without one global window: rows go by id to ranges of
about equal size, each range also gets a copy of the next range's first row, and a task walks its sorted range.

Null texts count as empty; empty and blank texts share a canonical form. Null ids sort first. Rows that repeat an id are
ordered by length, then by digest, and each is a row of its own. An empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenflux.llm import common

#: Stands for a null id in comparisons.
_LEAST = -(1 << 63)


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``fingerprint string``, row by row."""
    common.bound_batches(docs.sparkSession)
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [digest(canonical(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(marks, pa.string())], names=[*keep, "fingerprint"])

    return own.mapInArrow(run, own.drop("__text").withColumn("fingerprint", F.lit("")).schema)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([_LEAST if i is None else i for i in column.to_pylist()], np.int64)


def _parts(docs: DataFrame, mb: int, text_col: str = "text") -> int:
    spark = docs.sparkSession
    return int(min(20_000, max(2 * spark.sparkContext.defaultParallelism, common.input_bytes(docs, text_col) // (mb << 20))))


def with_next(
    docs: DataFrame, each: Callable[[str, str], tuple], schema: str, *, text_col: str = "text", range_mb: int = 4
) -> DataFrame:
    """``doc_id`` and the columns ``schema`` of ``each(text, next_text)`` for every document."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    parts = _parts(docs, range_mb, text_col)
    cuts = own.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    bounds = np.unique(np.array([c for c in cuts or [] if c is not None], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for b in batches:
            ids = _ids(b.column(0))
            for k, i in zip(np.searchsorted(bounds, ids, side="right").tolist(), ids.tolist()):
                if i < found.get(k, 1 << 63):
                    found[k] = i
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["part", "least"])

    firsts = sorted(own.select("doc_id").mapInArrow(least, "part int, least long").groupBy("part").agg(F.min("least").alias("least")).collect())
    if not firsts:
        return spark.createDataFrame([], f"doc_id long, {schema}")
    at = {r["least"]: firsts[k - 1]["part"] for k, r in enumerate(firsts)}  # the first row also goes to the part before

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, part, shown, text in zip(_ids(b.column(0)).tolist(), np.searchsorted(bounds, _ids(b.column(0)), side="right").tolist(), b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                row = (i, shown, len(text or ""), xxhash.xxh3_128_digest(raw), zlib.compress(raw, 1))
                out.append((part, False, *row))
                if i in at:
                    out.append((at[i], True, *row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=["part", "after", "at", "doc_id", "n", "digest", "text"],
            )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, id, text) that waits for its successor
        for b in batches:
            out = []
            for part, after, shown, packed in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 6))):
                if held is None or held[0] != part:
                    if after:
                        continue
                    held = (part, shown, zlib.decompress(packed).decode("utf-8", "surrogatepass"))
                    continue
                text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
                out.append((held[1], *each(held[2], text)))
                held = None if after else (part, shown, text)
                if after:
                    held = (None, None, "")  # the rest of the copies are passed by
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    empty = spark.createDataFrame([], f"doc_id long, {schema}").schema
    names, arrow = empty.names, [to_arrow_type(f.dataType) for f in empty.fields]
    dealt = own.mapInArrow(deal, "part int, after boolean, at long, doc_id long, n int, digest binary, text binary")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "after", "at", "n", "digest")
    return dealt.mapInArrow(walk, empty)


def classes(docs: DataFrame, marked: DataFrame, *, text_col: str = "text", bitmap_bits: int = 1 << 22) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``class_id`` (least id with the same canonical bytes), for members of classes over one row.

    ``marked`` holds ``doc_id`` and ``fingerprint`` of the rows of ``docs``.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    repeated = marked.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    place = F.pmod(F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long"), F.lit(bitmap_bits))
    words = (
        repeated.select(place.alias("p"))
        .groupBy(F.floor(F.col("p") / 32).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("bits"))
        .collect()
    )  # at most bitmap_bits / 32 rows
    bitmap = np.zeros(bitmap_bits // 32, np.uint32)
    for r in words:
        bitmap[r["w"]] = r["bits"]
    total = marked.count()
    share = max(1000, total // 1000)
    hot = {r["fingerprint"]: -(-r["n"] // share) for r in repeated.where(F.col("n") > share).collect()}  # at most 1000
    shared = spark.sparkContext.broadcast((bitmap, hot))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, salts = shared.value
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                canon = canonical(text)
                mark = digest(canon)
                p = int(mark[:8], 16) % bitmap_bits
                if int(bits[p >> 5]) >> (p & 31) & 1:
                    out.append((mark, (hash(i) & 0xFFFFFF) % salts.get(mark, 1), i, zlib.compress(canon, 1)))
            if out:
                yield _batch(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by fingerprint, salt and id: the first with its bytes stands for the class."""
        key, known = None, {}
        for b in batches:
            out = []
            for mark, salt, i, packed in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (mark, salt) != key:
                    key, known = (mark, salt), {}
                new = packed not in known  # equal bytes pack equally
                known.setdefault(packed, i)
                out.append((mark, salt, i, known[packed], packed if new else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["fingerprint", "salt", "doc_id", "class_id", "text"],
            )

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["fingerprint", "salt", "doc_id", "text"])

    kind = "fingerprint string, salt int, doc_id long, class_id long, text binary"
    sent = own.mapInArrow(members, "fingerprint string, salt int, doc_id long, text binary")
    first = sent.repartition(_parts(docs, 16, text_col), "fingerprint", "salt").sortWithinPartitions("fingerprint", "salt", "doc_id").mapInArrow(compare, kind)
    if not hot:
        return first.select("doc_id", "fingerprint", "class_id").distinct()
    first = common.materialize(first.withColumn("text", F.when(F.col("fingerprint").isin(list(hot)), F.col("text"))), "fingerprint-classes")
    parts = first.where("text is not null").select("fingerprint", F.lit(0).alias("salt"), "doc_id", "text")  # one a salt and text
    second = parts.repartition("fingerprint").sortWithinPartitions("fingerprint", "salt", "doc_id").mapInArrow(compare, kind)
    least = second.select("fingerprint", F.col("doc_id").alias("class_id"), F.col("class_id").alias("least"))
    return (
        first.join(least, ["fingerprint", "class_id"], "left")
        .select("doc_id", "fingerprint", F.coalesce("least", "class_id").alias("class_id"))
        .distinct()
    )
