"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines (parts between line feeds) are lower-cased and their white space is folded; blank lines take no part. A line's set
holds its distinct character shingles: the ``width`` characters (code points) from every character on, fewer at the line's
end. Equal lines are one line from the start (a 128-bit hash of the folded line); lines are numbered and written once.

Signatures are MinHash under permutations of one 64-bit hash a shingle: its exclusive or with a word fixed for each of the
``bands * rows`` values, of which a line keeps the least. ``rows`` values make a band; equal bands make candidates. Lines
without a candidate go no further: what follows reads a table of the others only. In each band bucket the line of least number is compared with the others (a star); exact Jaccard similarity
on whole sets decides. While a bucket's lines are then in many components, a few lines drawn from it are compared with those of
other components, round by round; what still is apart is paired in the first bucket that two lines share, where exact bounds
admit it: like set sizes, like distances to the star's centre (Jaccard distance is a metric) and, in a line's bits that its
shingles' hashes set, no more that differ than the similarity allows.
Those pairs are verified in the same way, so no link of a bucket is lost. Components come from distributed stars; the
line of least (id, digest of the text, line number) of each component stays and the others go.

With 10 bands of 3 rows a pair at 0.8 is a candidate with probability 0.999; nothing behind the bands is left to chance.

Null and empty texts have no lines. Rows that share an id (null ids among them) are told apart by a digest of the text; rows
that share both are one document. Very long lines are dealt with whole. An empty table gives an empty one; other columns are
not read, and ``without`` hands them on whatever their names are (but for its own ``__left`` and ``__gone``, which raise).
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenflux.llm import common, graph

#: White space inside a line, in the order in which it is looked for.
_BLANKS = ("\t", "\r", "\f", "\x0b", "  ")

#: Words of 64 bits in which a line marks its shingles.
_WORDS = 16

#: Shingles of a line that a MinHash value is expected to look at closely.
_BELOW = 20

#: Lines drawn from a bucket in a round of comparisons.
_PIVOTS = 4


def digest_of(text_col: str) -> Column:
    return F.md5(F.col(f"`{text_col}`").cast("binary")).alias("digest")


def _folded(text: Column) -> Column:
    """Lower case, white space but line feeds folded to one blank; texts that have none to fold skip the pattern."""
    odd = F.contains(text, F.lit(_BLANKS[0]))
    for blank in _BLANKS[1:]:
        odd = odd | F.contains(text, F.lit(blank))
    return F.lower(F.when(odd, F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")).otherwise(text))


def lines_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, digest, line, norm`` of each line that is not blank; ``digest`` is the MD5 of the text."""
    own = docs.select("doc_id", F.unhex(digest_of(text_col)).alias("digest"), _folded(F.col(f"`{text_col}`")).alias("text"))
    parts = own.select("doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return parts.select("doc_id", "digest", "line", F.trim("raw").alias("norm")).where("norm <> ''")


def _units(norm: Column) -> tuple[Column, Column, Column]:
    """A line's bytes at a fixed number of bytes a character, whether that is four (characters beyond 16 bits), the number."""
    wide = F.octet_length(F.encode(norm, "UTF-16BE")) != 2 * F.char_length(norm)
    return F.when(wide, F.encode(norm, "UTF-32")).otherwise(F.encode(norm, "UTF-16BE")), wide, F.when(wide, 4).otherwise(2)


def _hash_at(units: Column, wide: Column, step: Column, at: Column, width: int) -> Column:
    """Hash of the shingle from a byte on; the same for either number of bytes a character."""
    part = F.substring(units, at, step * width)
    return F.xxhash64(F.when(wide, F.encode(F.decode(part, "UTF-32"), "UTF-16BE")).otherwise(part))


def shingles(norm: Column, width: int) -> Column:
    """64-bit hashes of the shingles that start at every character, repeats included."""
    units, wide, _ = _units(norm)

    def each(line: Column, step: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.octet_length(line), F.lit(step)), lambda i: _hash_at(line, F.lit(step == 4), F.lit(step), i, width))

    # over an array of the one line: its bytes are then worked out once, not for every shingle
    return F.element_at(F.transform(F.array(units), lambda u: F.when(wide, each(u, 4)).otherwise(each(u, 2))), 1)


def _exploded(df: DataFrame, width: int, *keys: str) -> DataFrame:
    """``keys`` and ``h``: a row for the shingle at each character, repeats within a line included."""
    units, wide, step = _units(F.col("norm"))
    x = df.select(*keys, units.alias("u"), wide.alias("w"), step.alias("s"))
    x = x.select(*keys, "u", "w", "s", F.explode(F.sequence(F.lit(1), F.octet_length("u"), F.col("s"))).alias("i"))
    return x.select(*keys, _hash_at(F.col("u"), F.col("w"), F.col("s"), F.col("i"), width).alias("h"))


def _words(values: int) -> list[int]:
    """A word of 64 bits for each MinHash value."""
    draw = random.Random(values)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(values)]


def _least(distinct: DataFrame, width: int, words: list[int]) -> DataFrame:
    """``k1, k2`` and the MinHash values ``m0, m1, ...`` of distinct lines; the grouping is on columns that the lines are already dealt by.

    Of a line's n shingles a value only looks at those below a bound that ``_BELOW`` of them are expected to pass, so most shingles cost
    it one comparison. The least of these is the least of all; where none passes, the value is null.
    """
    n = F.char_length("norm")
    bound = F.when(n <= 2 * _BELOW, F.lit((1 << 63) - 1)).otherwise(((2.0 * _BELOW / n - 1) * 2.0**63).cast("long"))
    shingled = _exploded(distinct.select("k1", "k2", "norm", bound.alias("bound")), width, "k1", "k2", "bound")
    return shingled.groupBy("k1", "k2").agg(*[F.expr(f"min(h ^ {w}L) filter (where (h ^ {w}L) <= bound)").alias(f"m{j}") for j, w in enumerate(words)])


def _bands(found: list[Column], rows: int) -> Column:
    """Hash of each ``rows`` MinHash values."""
    return F.array(*[F.xxhash64(F.lit(b), *found[b * rows : (b + 1) * rows]) for b in range(len(found) // rows)])


def _rare_bands(norm: Column, width: int, words: list[int], rows: int) -> Column:
    """Bands by all shingles of a line, for the few lines that ``_least`` has left a value of null."""
    whole = F.array_distinct(shingles(norm, width))
    found = F.transform(F.array(whole), lambda x: F.transform(F.array(*map(F.lit, words)), lambda w: F.array_min(F.transform(x, lambda h: h.bitwiseXOR(w)))))
    return F.element_at(F.transform(found, lambda m: _bands([m[j] for j in range(len(words))], rows)), 1)  # arrays of one: worked out once


def _marks(lines: DataFrame, width: int) -> DataFrame:
    """``id, marks``: each shingle's hash sets one of ``64 * _WORDS`` bits, so bits that differ are shingles that differ."""
    h = _exploded(lines, width, "id").select("id", F.col("h").bitwiseAND(_WORDS - 1).alias("w"), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))").alias("bit"))
    words = [F.expr(f"bit_or(bit) filter (where w = {j})").alias(f"w{j}") for j in range(_WORDS)]
    return h.groupBy("id").agg(*words).select("id", F.array(*[F.coalesce(f"w{j}", F.lit(0).cast("long")) for j in range(_WORDS)]).alias("marks"))


def _sets(pairs: DataFrame, lines: DataFrame, width: int) -> DataFrame:
    """``pairs`` of ids ``a`` and ``b`` with the shingles ``x`` and ``y`` of their whole lines, repeats included."""
    both = pairs.join(lines.select(F.col("id").alias("a"), F.col("norm").alias("x")), "a")
    both = both.join(lines.select(F.col("id").alias("b"), F.col("norm").alias("y")), "b")
    return both.select(*pairs.columns, shingles(F.col("x"), width).alias("x"), shingles(F.col("y"), width).alias("y"))


def _verify(sized: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n`` (set size of ``b``), ``distance``, ``linked`` of pairs whose sets hold ``m`` and ``n`` shingles, ``u`` together."""
    i = F.col("m") + F.col("n") - F.col("u")
    return sized.select("a", "b", "n", (1 - i / F.col("u")).alias("distance"), (i >= F.lit(threshold) * F.col("u") - 1e-9).alias("linked"))


def _verify_stars(star: DataFrame, lines: DataFrame, threshold: float, width: int) -> DataFrame:
    """Each bucket's centre ``a`` against its other lines ``b``; a pair of several buckets once."""
    pairs = star.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    sets = _sets(pairs, lines, width).select("a", "b", F.array_distinct("x").alias("x"), F.array_distinct("y").alias("y"))
    return _verify(sets.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_union("x", "y")).alias("u")), threshold)


def _links(pairs: DataFrame, lines: DataFrame, threshold: float, width: int) -> DataFrame:
    """Components ``a, b`` that pairs link, of pairs ``a, b`` of components ``p, q`` whose set sizes ``m, n`` the stars have told."""
    i = F.col("m") + F.col("n") - F.col("u")
    sized = _sets(pairs, lines, width).select("p", "q", "m", "n", F.size(F.array_union("x", "y")).alias("u"))
    return sized.where(i >= F.lit(threshold) * F.col("u") - 1e-9).select(F.col("p").alias("a"), F.col("q").alias("b"))


def _moved(table: DataFrame, joined: DataFrame, column: str) -> DataFrame:
    """``table`` with ``component``: that of ``column`` in ``joined``, which is its own where it is not there."""
    to = joined.select(F.col("node").alias("__node"), F.col("component").alias("__to"))
    others = [c for c in table.columns if c != "component"]
    return table.join(to, F.col(column) == F.col("__node"), "left").select(*others, F.coalesce("__to", column).alias("component"))


def _open(at: DataFrame) -> DataFrame:
    """``at`` without the buckets that hold one component only."""
    split = at.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    return common.materialize(at.join(split, "band", "left_semi"), "lines-open")


def _admitted(threshold: float) -> Column:
    """Whether ``l`` and ``r`` are in different components and may be linked by set sizes, distances to the centre and marks.

    With ``D`` bits that differ the sets differ in ``D`` shingles at least, so their similarity is (m + n - D) / (m + n + D) at most.
    """
    reach = 1 - threshold + 1e-9
    sizes = f"l.n >= {threshold}D * r.n and r.n >= {threshold}D * l.n"
    differ = " + ".join(f"bit_count(l.marks[{j}] ^ r.marks[{j}])" for j in range(_WORDS))
    marks = f"({differ}) * {1 + threshold}D <= (l.n + r.n) * {1 - threshold}D + 1e-6D"
    return F.expr(f"l.component <> r.component and {sizes} and abs(l.distance - r.distance) <= {reach}D and {marks}")


#: Of a pair ``l`` and ``r``: its lines, their set sizes and components.
_PAIR = ["l.id as a", "r.id as b", "l.n as m", "r.n as n", "l.component as p", "r.component as q"]


def _pivot_links(at: DataFrame, lines: DataFrame, pivots: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links between the components of each bucket's pivots and those of its other lines."""
    marks = lines.select("id", "marks")
    pairs = at.join(marks, "id").alias("l").join(pivots.join(marks, "id").alias("r"), "band").where(_admitted(threshold))
    return _links(common.materialize(pairs.selectExpr(*_PAIR).distinct(), "lines-pairs"), lines, threshold, width)


def _all_pairs(at: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one bucket in different components that no exact bound rules out."""
    at = at.join(lines.select("id", "bands", "marks"), "id")
    bands = F.zip_with("l.bands", "r.bands", lambda x, y: F.when(x == y, x))
    first = F.element_at(F.filter(bands, lambda x: x.isNotNull()), 1)
    pairs = at.alias("l").join(at.alias("r"), F.col("l.band") == F.col("r.band")).where("l.id < r.id").where(_admitted(threshold)).where(first == F.col("l.band"))
    return common.materialize(pairs.selectExpr(*_PAIR), "lines-pairs")


def _join_rest(star: DataFrame, checked: DataFrame, lines: DataFrame, threshold: float, width: int, *, each: int = 8, most: int = 12) -> DataFrame:
    """Components when every pair of a bucket has been compared, ruled out or found joined already.

    While more than ``each`` pairs an open line are left, ``_PIVOTS`` lines drawn from each bucket are compared with the others: that is
    linear, and every link it finds joins whole components, whose pairs then need no comparison. It ends when a round leaves
    more than nine tenths of the pairs, or after ``most`` rounds; the pairs left are then compared one by one.
    Rounds join components of the stars, not lines, and move open lines only; all lines are moved once, at the end.
    """
    joined = graph.components(checked.where("linked"))
    entries = star.where("id <> centre").join(checked.select(F.col("a").alias("centre"), F.col("b").alias("id"), "n", "distance"), ["centre", "id"])
    at = _open(_moved(entries.select("band", "id", "n", "distance"), joined, "id"))
    before, moves = None, []
    for turn in range(most):
        own = at.groupBy("band", "component").agg(F.count("*").cast("double").alias("c")).groupBy("band")
        held = own.agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q"))
        count, left = held.agg(F.sum("c"), F.sum((F.col("c") * F.col("c") - F.col("q")) / 2)).first()
        if not count or left <= each * count or (before is not None and left > 0.9 * before):
            break
        before = left
        drawn = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "id").alias("h"), "id", "n", "distance", "component")) for k in range(_PIVOTS)]
        pivots = at.groupBy("band").agg(F.array(*drawn).alias("p")).select("band", F.explode(F.array_distinct(F.transform("p", lambda p: p.dropFields("h")))).alias("p"))
        pivots = common.materialize(pivots.select("band", "p.*"), "lines-pivots")
        links = _pivot_links(at, lines, pivots, threshold, width)
        moves.append(graph.components(links))
        spent, old = pivots.select("band", "id"), at
        at = _open(_moved(at.join(spent, ["band", "id"], "left_anti"), moves[-1], "component"))
        common.discard(old)
        common.discard(pivots)
    last = _links(_all_pairs(at, lines, threshold), lines, threshold, width)
    for move in moves:
        last = last.union(move.select("node", "component"))
    last = graph.components(last)
    single = last.join(joined.select("node"), "node", "left_anti").select("node", "component")
    return _moved(joined, last, "component").union(single)


def _kept(docs: DataFrame, text_col: str, threshold: float, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, digest, line`` of the line that stays of each component."""
    with common.scratch() as scope:
        parts = lines_of(docs, text_col).withColumn("k1", F.xxhash64("norm")).withColumn("k2", F.xxhash64(F.lit(7), "norm"))
        at = F.struct("doc_id", "digest", "line")
        distinct = parts.groupBy("k1", "k2").agg(F.first("norm").alias("norm"), F.min(at).alias("at"))
        whole = distinct.where("at.line >= 0")  # true of all: with the same columns on both sides Spark reads one exchange twice
        words = _words(bands * rows)
        signed = distinct.join(_least(whole, width, words), ["k1", "k2"])  # both sides lie by the keys already
        values = [F.col(f"m{j}") for j in range(len(words))]
        full = functools.reduce(Column.__and__, [m.isNotNull() for m in values])
        lines = signed.select(F.monotonically_increasing_id().alias("id"), "norm", "at", F.when(full, _bands(values, rows)).alias("bands"))
        lines = common.materialize(lines, "lines-distinct", compression="zstd")
        common.release(docs.sparkSession)
        rare = lines.where("bands is null").withColumn("bands", _rare_bands(F.col("norm"), width, words, rows))
        lines = lines.where("bands is not null").union(common.materialize(rare, "lines-rare", compression="zstd"))

        entry = lines.select("id", F.explode("bands").alias("band"))
        shared = entry.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("band", "centre")
        shared = common.materialize(shared, "lines-shared")  # its size is known then: few buckets are broadcast, many are not
        star = common.materialize(entry.join(shared, "band"), "lines-stars")
        common.release(docs.sparkSession)
        near = lines.join(star.select("id").distinct(), "id", "left_semi").select("id", "norm", "bands")
        near = common.materialize(near, "lines-near", compression="zstd")
        bare, near = near, common.materialize(near.join(_marks(near, width), "id"), "lines-marked", compression="zstd")
        common.discard(bare)
        checked = common.materialize(_verify_stars(star, near, threshold, width), "lines-verified")
        joined = _join_rest(star, checked, near, threshold, width)

        firsts = lines.select("id", "at").join(joined.select(F.col("node").alias("id"), "component"), "id", "left")
        alone = firsts.where("component is null").select("at")
        led = firsts.where("component is not null").groupBy("component").agg(F.min("at").alias("at")).select("at")
        return scope.result(alone.union(led).select("at.*"), "lines-kept")


def removed(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.8, width: int = 12, bands: int = 10, rows: int = 3) -> DataFrame:
    """``doc_id``, ``digest``, ``n_lines`` (not blank), ``removed`` (line numbers that go, ascending) of every id and text."""
    kept = _kept(docs, text_col, threshold, width, bands, rows)
    kept = kept.groupBy("doc_id", "digest").agg(F.collect_set("line").alias("kept")).select(F.col("doc_id").alias("id"), F.hex("digest").alias("d"), "kept")
    said = F.transform(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: F.when(x.rlike(r"[^ \t\f\r\x0B]"), i))
    own = docs.select("doc_id", digest_of(text_col), F.filter(said, lambda i: i.isNotNull()).alias("said")).dropDuplicates(["doc_id", "digest"])
    both = own.join(kept, own["doc_id"].eqNullSafe(kept["id"]) & (F.upper(own["digest"]) == kept["d"]), "left")
    none = F.array().cast("array<int>")
    said = F.coalesce("said", none)
    return both.select(
        "doc_id", "digest", F.size(said).cast("long").alias("n_lines"), F.array_except(said, F.coalesce("kept", none)).alias("removed")
    )


def without(docs: DataFrame, gone: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of ``gone`` (of ``removed()``) taken out of the text, ``__left`` (lines that stay) and ``__gone``."""
    if clash := {"__left", "__gone"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are named like results")
    at = dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns)))))  # plain names on the way
    own = docs.toDF(*at.values()).withColumn("digest", digest_of(at[text_col]))
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest"), "removed", "n_lines")
    both = own.join(g, own[at["doc_id"]].eqNullSafe(g["g_id"]) & own["digest"].eqNullSafe(g["g_digest"]), "left")
    kept = F.array_join(F.filter(F.split(at[text_col], "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.size("removed") > 0, kept).otherwise(F.col(at[text_col]))
    columns = [(text if name == text_col else F.col(c)).alias(name) for name, c in at.items()]
    return both.select(*columns, (F.col("n_lines") - F.size("removed")).alias("__left"), F.size("removed").alias("__gone"))
