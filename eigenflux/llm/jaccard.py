"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the hashes of its distinct word shingles. Two sets link when ``100 * |x & y| >= percent * |x | y|``;
then they differ in at most ``H = floor((|x| + |y|) * (100 - p) / (100 + p))`` shingles. For each band of set sizes the
universe of shingles is cut by hash into segments; a segment of allowance 0 is indexed by the hash of its subset, one of
allowance 1 also by its one-deletion neighbourhood. With allowances d and ``sum(d + 1) > H`` any linked pair meets in an
index entry. A cost model of entries written and of chance meetings picks how many segments get allowance 1 (``allocate``).
Spare segments let entries of empty subsets, which many sets share, be left out unless a set has more of them than spares.

Equal sets are one class from the start: only its least document is indexed. Then, for all entries that several sets share:
the most widely shared set of an entry is compared with each other set there (a star, not all pairs); verified links merge
components; only sets of one entry in different components are paired after that, and of those only pairs that exact bounds
admit: their sizes, their distances to the star's centre (Jaccard distance is a metric) and their profiles, counts of shingles
by hash that differ by no more than the sets do. Sizes and profiles rule out pairs of a star as well, before sets are moved.
Each pair that is left is verified exactly on whole sets. Components come from distributed stars.

Null or empty texts and texts without words have an empty set and link with nothing; a row with a null id
belongs to the documents with the very same set, or has a null component. Rows that repeat an id are in one component with all that any of them links with. Ids are read as long. Other
columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eigenflux.llm import common, graph

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of 64-bit hashes."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; words are runs of bytes that are no ASCII white space, A-Z folded."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, _U(min(len(words), width)))
    for k in range(min(width, len(words))):
        out = mix(out * _K1 + h[k : k + n])
    return np.unique(out)


def bands(largest: int) -> list[int]:
    """Lower bounds of size bands; a set can link only within its band and to the next ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.235)))
    return out


#: Spare segments that ``allocate`` weighs.
SPARES = (0, 1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90)


def _beyond(mean: float, n: int) -> float:
    """Chance that a Poisson count passes ``n``."""
    term, total = math.exp(-mean), 0.0
    for i in range(n + 1):
        total += term
        term *= mean / (i + 1)
    return max(0.0, 1 - total)


def allocate(size: int, differ: int, chance: float = 3.0, crowd: float = 1e3) -> tuple[int, int, int]:
    """(segments, how many have allowance 1, spare) of least cost for the least size of a band.

    The cost is entries written, plus expected chance meetings, plus the chance of more empty segments than spare ones, as a
    set that writes entries for its empty segments meets a crowd there.
    """
    best = None
    for spare in SPARES:
        need = differ + 1 + spare
        for ones in range(0, need // 2 + 1, max(1, need // 40)):
            n = need - ones
            each = size / n
            bare = math.exp(-each)
            empty = (n - ones) * bare + 2 * ones * (1 + each) * bare
            cost = n + ones * each + chance * n * bare + crowd * _beyond(empty, spare)
            if best is None or cost < best[0]:
                best = (cost, n, ones, spare)
    return best[1], best[2], best[3]


class Scheme:
    """Segments and allowances of every band."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.percent = percent
        self.low = np.array(bands(largest), np.int64)
        self.plan: dict[int, tuple[int, int, int, int]] = {}

    def of(self, band: int) -> tuple[int, int, int, int]:
        """(greatest difference, segments, segments of allowance 1, spare segments)."""
        if band not in self.plan:
            low, high = int(self.low[band]), int(self.low[band + 1]) - 1
            differ = 2 * high * (100 - self.percent) // (100 + self.percent)
            self.plan[band] = (differ, *allocate(low * self.percent // 100, differ)) if differ else (0, 0, 0, 0)
        return self.plan[band]

    def bands_of(self, size: int) -> list[int]:
        own = int(np.searchsorted(self.low, size, side="right")) - 1
        out = [own]
        k = own + 1
        while k + 1 < len(self.low) and 100 * size >= self.percent * int(self.low[k]):
            out.append(k)
            k += 1
        return out

    def entries(self, tokens: np.ndarray) -> np.ndarray:
        """Index entries (hashes) of one set."""
        if not len(tokens):
            return np.zeros(0, np.int64)
        out = []
        place, value = mix(tokens + _K2), mix(tokens + _K3)
        halves = (value & _U(0xFFFFFFFF)).astype(np.float64), (value >> _U(32)).astype(np.float64)
        for band in self.bands_of(len(tokens)):
            differ, segments, ones, spare = self.of(band)
            if not differ:  # only equal sets link here
                continue
            at = (place % _U(segments)).astype(np.int64)
            count = np.bincount(at, minlength=segments)
            low, high = (np.bincount(at, h, segments).astype(np.int64).view(_U) for h in halves)
            total = low + (high << _U(32))
            tag = mix(np.arange(segments, dtype=_U) * _K1 + np.full(segments, band, _U) * _K2)
            empty = count == 0
            lone = (count <= 1) & (np.arange(segments) < ones)
            keep_empty = int(empty[ones:].sum()) + 2 * int(lone.sum()) > spare
            out.append(mix(total + tag)[~empty | keep_empty])
            if ones:
                inside = np.flatnonzero(at < ones)
                s = at[inside]
                rest = mix(total[s] - value[inside] + tag[s])
                out.append(rest[(count[s] > 1) | keep_empty])
        return np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _linked(inside: int, a: int, b: int, percent: int) -> bool:
    return 100 * inside >= percent * (a + b - inside)


def profile(tokens: np.ndarray) -> np.ndarray:
    """Counts of shingles by hash, at most 255 each; profiles differ in sum by no more than their sets do.

    There are about four shingles to a counter, and a power of two of counters, so a longer profile folds into a shorter one.
    """
    size = 1 << max(6, (len(tokens) // 4).bit_length())
    return np.minimum(np.bincount((mix(tokens ^ _K2) % _U(size)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    return counts.reshape(-1, size).sum(0, dtype=np.int32)


def least_distance(x: np.ndarray, y: np.ndarray, n: int, m: int) -> float:
    """A Jaccard distance that sets of ``n`` and ``m`` shingles with these profiles have at least."""
    size = min(len(x), len(y))
    apart = max(int(np.abs(folded(x, size) - folded(y, size)).sum()), abs(n - m))
    return 2 * apart / (n + m + apart)


def _screen(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, near`` (a distance that they have at least) of each pair, by sizes and profiles, which are far smaller than sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            near = [least_distance(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m) for n, x, m, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], names=["a", "b", "near"])

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("profile").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("profile").alias("y")), "b")
    return common.materialize(both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long, near double"), "jaccard-screened")


def _possible(percent: int, block: int = 512):
    """Pairs of an entry's rows in different components that no exact bound rules out, block by block."""
    reach = (100 - percent) / 100 + 1e-9

    def of_entry(doc, n, component, near, far, profiles, seen):
        size = min(map(len, profiles))
        counts = np.stack([folded(x, size) for x in profiles])
        for at in range(0, len(doc), block):
            i = slice(at, at + block)
            go = component[i, None] != component[None, :]
            go &= doc[i, None] < doc[None, :]
            go &= (100 * n[i, None] >= percent * n[None, :]) & (100 * n[None, :] >= percent * n[i, None])
            go &= (near[i, None] - far[None, :] <= reach) & (near[None, :] - far[i, None] <= reach)
            x, y = np.nonzero(go)
            x += at
            for k in range(0, len(x), 4096):
                u, v = x[k : k + 4096], y[k : k + 4096]
                apart = np.abs(counts[u] - counts[v]).sum(1, dtype=np.int64)
                fits = (100 + percent) * apart <= (100 - percent) * (n[u] + n[v])
                for pair in zip(doc[u[fits]].tolist(), doc[v[fits]].tolist()):
                    if pair not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(pair)
                        yield pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[list[np.ndarray]] = []
        entry = None

        def flush():
            if sum(len(h[0]) for h in held) < 2:
                return
            pairs = of_entry(*(np.concatenate(c) for c in zip(*held)), seen)
            while some := list(itertools.islice(pairs, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], names=["a", "b"])

        for batch in batches:
            key = np.asarray(batch.column(0))
            columns = [np.asarray(batch.column(k)) for k in range(1, 6)]
            columns.append(np.array([None, *(np.frombuffer(x, np.uint8) for x in batch.column(6).to_pylist())], object)[1:])
            for x, y in _runs(key):
                if entry is not None and key[x] != entry:
                    yield from flush()
                    held = []
                entry = key[x]
                held.append([c[x:y] for c in columns])
        yield from flush()

    return run


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    return zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(key)])).tolist()) if len(key) else iter(())


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``entry, node, n`` sorted by the first two: those of entries that several nodes share, each once.

    What one batch hands to the next is one row, however many rows an entry has.
    """
    last: tuple | None = None  # the last row, and whether it has been written
    for batch in batches:
        if not batch.num_rows:
            continue
        entry, node, n = (np.asarray(batch.column(k)) for k in range(3))
        if last is not None:
            entry, node, n = (np.concatenate(([v], c)) for v, c in zip(last[:3], (entry, node, n)))
        fresh = np.ones(len(entry), bool)
        fresh[1:] = (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])
        done = last is not None and last[3]
        entry, node, n = entry[fresh], node[fresh], n[fresh]
        with_next = np.zeros(len(entry), bool)
        with_next[:-1] = entry[1:] == entry[:-1]
        keep = with_next.copy()
        keep[1:] |= with_next[:-1]
        if done:  # written with an earlier batch
            keep[0] = False
        last = (entry[-1], node[-1], n[-1], bool(keep[-1]) or (done and len(entry) == 1))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in (entry, node, n)], names=["entry", "node", "n"])


def _among(sets: DataFrame, pairs: DataFrame, side: str, bitmap_bits: int) -> DataFrame:
    """``side, tokens`` of the sets that pairs may have on that side; the others need not be moved to join."""
    marks = pairs.sparkSession.sparkContext.broadcast(common.bitmap(pairs, side, bitmap_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(common.in_bitmap(marks.value, batch.column(0))))

    return sets.select(F.col("node").alias(side), "tokens").mapInArrow(run, f"{side} long, tokens binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, bitmap_bits: int) -> DataFrame:
    """``a, b, distance, linked`` of each pair, by whole sets; ``pairs`` are read several times."""
    both = pairs.join(_among(sets, pairs, "a", bitmap_bits).withColumnRenamed("tokens", "x"), "a")
    both = both.join(_among(sets, pairs, "b", bitmap_bits).withColumnRenamed("tokens", "y"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                inside = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                distance.append(1 - inside / max(1, len(x) + len(y) - inside))
                linked.append(_linked(inside, len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(distance), pa.array(linked)], names=["a", "b", "distance", "linked"]
            )

    with common.batch_rows(pairs.sparkSession, 200):
        return common.materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, distance double, linked boolean"), "jaccard-verified")


def _scan(docs: DataFrame, width: int, marks, make, schema: str) -> DataFrame:
    """Rows ``doc_id, key, n`` and what ``make(set)`` gives of texts that have words and whose ids ``marks`` may hold (None: all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for batch in batches:
            ids = batch.column(0)
            hits = common.in_bitmap(marks.value, ids) if marks is not None else itertools.repeat(True)
            out = []
            for i, hit, text in zip(ids.to_pylist(), hits, batch.column(1).to_pylist()):
                if hit:
                    s = shingle_set(text, width)
                    if len(s) or marks is None:
                        out.append((i, xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, len(s), *made(s)))
            if out:
                types = [f.type for f in to_arrow_schema(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[f.name for f in kind])

    kind = StructType.fromDDL(f"doc_id long, key binary, n long{schema}")
    return docs.mapInArrow(run, kind)


def _nodes(rows: DataFrame) -> DataFrame:
    """``key, doc_id`` (least of the key's rows) and a number ``node`` for each distinct set of rows with an id."""
    least = rows.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return common.materialize(least.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")


def _plain_ids(rows: DataFrame) -> bool:
    """Whether no id has several sets; an id then names its set."""
    sets = rows.where("doc_id is not null and key is not null").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z"))
    return sets.where("a < z").isEmpty()


def _entries(own: DataFrame, nodes: DataFrame, percent: int, width: int, bitmap_bits: int, plain: bool) -> DataFrame:
    """``entry, node, n`` of the index entries that several nodes share: one shuffle of entries, lone ones end in its tasks.

    Where ids are ``plain``, entries go by id, and only shared ones look for their node; else all look for it by their set first.
    """

    def make():
        scheme = Scheme(percent)
        return lambda s: (scheme.entries(s),)

    marks = own.sparkSession.sparkContext.broadcast(common.bitmap(nodes, "doc_id", bitmap_bits))
    found = _scan(own, width, marks, make, ", entries array<long>")
    # texts that only repeat a set end at the join with the nodes
    found = found.withColumn("node", F.col("doc_id")) if plain else found.join(nodes, ["key", "doc_id"])
    entry = found.select(F.explode("entries").alias("entry"), "node", "n")
    entry = entry.repartition("entry").sortWithinPartitions("entry", "node").mapInArrow(_shared, "entry long, node long, n long")
    if plain:
        named = nodes.select(F.col("doc_id").alias("__id"), F.col("node").alias("__node"))
        entry = entry.join(named, F.col("node") == F.col("__id")).select("entry", F.col("__node").alias("node"), "n")
    return common.materialize(entry, "jaccard-entries")


def _sets(own: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, bitmap_bits: int) -> DataFrame:
    """``node, size, tokens, profile`` of the wanted nodes."""
    nodes = nodes.join(wanted, "node", "left_semi")
    marks = own.sparkSession.sparkContext.broadcast(common.bitmap(nodes, "doc_id", bitmap_bits))
    found = _scan(own, width, marks, lambda: lambda s: (s.tobytes(), profile(s).tobytes()), ", tokens binary, profile binary")
    found = found.dropDuplicates(["key", "doc_id"]).join(nodes, ["key", "doc_id"])  # dealt once for both
    return common.materialize(found.select("node", F.col("n").alias("size"), "tokens", "profile"), "jaccard-sets")


def join(docs: DataFrame, *, percent: int = 90, width: int = 3, text_col: str = "text", bitmap_bits: int = 1 << 23) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least id reachable by links) of every row."""
    common.bound_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with common.scratch() as scope:
        rows = common.materialize(_scan(own, width, None, lambda: lambda s: (), ""), "jaccard-rows")
        nodes = _nodes(rows)
        entry = _entries(own, nodes, percent, width, bitmap_bits, _plain_ids(rows))
        common.release(docs.sparkSession)

        popular = entry.groupBy("entry").agg(F.count("*").alias("m"))
        popular = entry.join(popular.where("m > 1"), "entry").groupBy("node").agg(F.sum("m").alias("pop"))
        centre = entry.join(popular, "node").groupBy("entry").agg(F.min(F.struct(-F.col("pop"), F.col("node"))).alias("c"))
        star = common.materialize(entry.join(centre.select("entry", F.col("c.node").alias("centre")), "entry"), "jaccard-stars")
        common.discard(entry)

        sets = _sets(own, nodes, star.select("node").distinct(), width, bitmap_bits)
        pairs = star.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        screened = _screen(pairs, sets)
        admitted = (F.col("near") <= (100 - percent) / 100 + 1e-9)
        verified = _verify(screened.where(admitted).select("a", "b"), sets, percent, bitmap_bits)
        checked = verified.select("a", "b", F.col("distance").alias("near"), F.col("distance").alias("far"), "linked").union(
            screened.where(~admitted).select("a", "b", "near", F.lit(1.0).alias("far"), F.lit(False).alias("linked"))
        )
        # rows that repeat an id are one: their sets are joined like linked ones
        again = rows.where("doc_id is not null and key is not null").select("doc_id", "key").distinct().join(nodes.select("key", "node"), "key")
        again = again.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").join(again.select("doc_id", F.col("node").alias("b")), "doc_id")
        joined = graph.components(checked.where("linked").select("a", "b").union(again.where("a <> b").select("a", "b")))
        common.release(docs.sparkSession)

        # What remains: sets of one entry in different components, at like distances from the centre.
        far = checked.select(F.col("a").alias("centre"), F.col("b").alias("node"), "near", "far")
        at = (
            star.where("node <> centre")
            .join(joined.withColumnRenamed("component", "c"), "node", "left")
            .withColumn("component", F.coalesce("c", "node"))
            .join(far, ["centre", "node"])
            .select("entry", "node", "n", "component", "near", "far")
        )
        split = at.groupBy("entry").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("entry")
        at = common.materialize(at.join(split, "entry", "left_semi"), "jaccard-open")
        common.discard(star)
        rest = at.join(sets.select("node", "profile"), "node").select("entry", "node", "n", "component", "near", "far", "profile")
        rest = rest.repartition("entry").sortWithinPartitions("entry", "node").mapInArrow(_possible(percent), "a long, b long").distinct()
        rest = common.materialize(rest, "jaccard-pairs")
        more = _verify(rest, sets, percent, bitmap_bits).where("linked").select("a", "b")
        final = graph.components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

        # a component's name is its least document
        of_node = nodes.join(final, "node", "left").select("key", "doc_id", F.coalesce("component", "node").alias("component"))
        least = of_node.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        by_key = of_node.join(least, "component").select("key", "component_id")
        out = rows.join(by_key, "key", "left")
        # rows without words that repeat the id of a row with words belong to its component
        by_id = out.where("component_id is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("of_id"))
        bare = out.where("component_id is null").join(by_id, F.col("doc_id") == F.col("id"), "left")
        bare = bare.select("doc_id", "n", F.coalesce("of_id", "doc_id").alias("component_id"))
        out = out.where("component_id is not null").select("doc_id", "n", "component_id").union(bare)
        return scope.result(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "jaccard")
