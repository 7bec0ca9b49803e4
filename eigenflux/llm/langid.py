"""Language identification by prediction by partial matching over bytes.

For every language a variable-order context tree over lower-cased UTF-8 bytes is counted once from labelled texts and
then frozen. A byte is coded in its longest context; where that context was seen but not with this byte, the escape of
method C is paid and the next shorter context is tried, down to a uniform order -1. The language whose tree gives the
shortest exact code of the whole text wins; ``score`` is its posterior under equal priors.

The trees of all languages share one set of strings (``T``), so each position is looked up once for all languages:
``T[k][id of the k-1 symbols before * A + symbol]`` is the id of the k-symbol string ending there, 0 if never seen.

Training takes a bounded sample of labelled rows: at most ``docs_per_lang`` rows of each language, whole texts, up to
``chars_per_lang`` characters. Scoring reads every whole text in pieces that keep their contexts, so memory is bounded.
Null or empty texts and texts without a letter are ``und`` with score 0; so is all text if no label was learned. Equal
code lengths go to the alphabetically first language. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenflux.llm import common

ORDER = 4
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes scored at a time, which bounds the arrays that a worker holds while it scores.
PIECE = 1 << 16


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions, superscripts and circled digits, which the pattern lets by, are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


class ContextTrees:
    """Frozen statistics: strings of up to ``ORDER + 1`` symbols with code and escape lengths for each language."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(samples), order
        raw = {g: [np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8) for t in samples[g]] for g in self.langs}
        seen = np.unique(np.concatenate([np.unique(a) for arrays in raw.values() for a in arrays] or [np.zeros(0, np.uint8)]))
        self.symbol = np.full(256, len(seen) + 1, np.int32)  # 0: before the text; the last: bytes never seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.n_symbols = a = len(seen) + 2
        n = len(self.langs)
        pad = np.zeros(order, np.int64)
        flat = {g: np.concatenate([np.concatenate((pad, self.symbol[x])) for x in raw[g]]) if raw[g] else pad for g in self.langs}
        real = {g: np.concatenate([np.concatenate((pad > 0, np.ones(len(x), bool))) for x in raw[g]]) if raw[g] else pad > 0 for g in self.langs}

        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)]  # keys[k]: parent * A + symbol, sorted, of k-symbol strings
        self.code = [np.full((1, n), np.log2(257.0))]  # code[k][id]: bits of the last symbol from the context before it
        self.escape = [np.zeros((1, n))]  # escape[k][id]: bits to leave the string as a context
        ids = {g: np.zeros(len(flat[g]) + 1, np.int64) for g in self.langs}  # of the k symbols ending at each position
        for k in range(1, order + 2):
            own = {g: ids[g][:-1] * a + flat[g] for g in self.langs}
            if k > 1:  # strings that start before the array stay at the root of it
                for g in self.langs:
                    own[g][: k - 1] = -1
            keys = np.unique(np.concatenate([np.zeros(0, np.int64), *own.values()]))
            keys = keys[keys >= 0]
            m = len(keys) + 1
            count = np.zeros((m, n))
            parent = np.concatenate(([0], keys // a))
            place, suffix = {}, np.zeros(m, np.int64)
            for j, g in enumerate(self.langs):
                i = np.where(own[g] < 0, 0, np.searchsorted(keys, own[g]) + 1)
                place[g] = np.concatenate(([0], i))
                count[:, j] = np.bincount(i[real[g] & (i > 0)], minlength=m)
                suffix[i] = ids[g][1:] if k > 1 else 0
            suffix[0] = 0
            count[0] = 0
            total = np.zeros((len(self.code[-1]), n))
            distinct = np.zeros_like(total)
            np.add.at(total, parent[1:], count[1:])
            np.add.at(distinct, parent[1:], count[1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape[k - 1] = np.where(total > 0, np.log2(total + distinct) - np.log2(np.maximum(distinct, 1)), 0.0)
                direct = np.log2(total + distinct)[parent] - np.log2(count)
            shorter = self.code[k - 1][suffix]
            code = np.where(count > 0, direct, self.escape[k - 1][parent] + shorter)
            code[0] = 0
            self.keys.append(keys)
            self.code.append(code)
            self.escape.append(np.zeros((m, n)))
            ids = place
        self.code = [c.astype(np.float32) if k else c for k, c in enumerate(self.code)]
        self.escape = [e.astype(np.float32) for e in self.escape]

    def tables(self) -> list[np.ndarray]:
        out = [np.zeros(0, np.int32)]
        for k in range(1, self.order + 2):
            t = np.zeros((len(self.keys[k - 1]) + 1) * self.n_symbols, np.int32)
            t[self.keys[k]] = np.arange(1, len(self.keys[k]) + 1)
            out.append(t)
        return out

    def bits(self, symbols: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Code length of each symbol under each language; the first ``order`` symbols are context only."""
        a, n, top = self.n_symbols, len(symbols), self.order + 1
        ids = [np.zeros(n, np.int32), tables[1][symbols]]
        for k in range(2, top + 1):
            t = np.zeros(n, np.int32)
            before = ids[k - 1][:-1]
            t[1:] = np.where(before > 0, tables[k][before.astype(np.int64) * a + symbols[1:]], 0)
            ids.append(t)
        out = self.code[top][ids[top]]
        left = np.flatnonzero(ids[top][self.order :] == 0) + self.order
        for k in range(top, 0, -1):  # no string of k symbols ends at ``left``: leave its context of k - 1
            if not len(left):
                break
            out[left] += self.escape[k - 1][ids[k - 1][left - 1]] if k > 1 else self.escape[0][0]
            found = ids[k - 1][left] > 0 if k > 1 else np.ones(len(left), bool)
            hit = left[found]
            out[hit] += self.code[k - 1][ids[k - 1][hit]] if k > 1 else self.code[0][0]
            left = left[~found]
        return out[self.order :]

    def score(self, texts: list[str], tables: list[np.ndarray], piece: int = PIECE) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(texts), len(self.langs)))
        pad = np.zeros(self.order, np.int32)
        batch: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            nonlocal batch, owner, size
            if size:
                symbols = np.concatenate(batch)
                bits = np.concatenate((np.zeros((self.order, len(self.langs)), np.float32), self.bits(symbols, tables)))
                ends = np.cumsum([n for _, n in owner])
                for (i, n), end in zip(owner, ends):
                    total[i] += bits[end - n + self.order : end].sum(0, dtype=np.float64)
            batch, owner, size = [], [], 0

        for i, text in enumerate(texts):
            symbols = np.concatenate((pad, self.symbol[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]))
            for at in range(0, max(len(symbols) - self.order, 0), piece):
                part = symbols[at : at + piece + self.order]
                if size + len(part) > 2 * piece:
                    flush()
                batch.append(part)
                owner.append((i, len(part)))
                size += len(part)
        flush()
        return total


def training_sample(
    docs: DataFrame, *, where: Column, docs_per_lang: int, chars_per_lang: int
) -> dict[str, list[str]]:
    """Texts of each language, by least hash of the id, bounded by both limits; whole texts only."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & where)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(int((1 << 30) * min(1.0, docs_per_lang / n))))])
    got = rows.withColumn("rank", rank).where(F.col("rank") <= share[F.col("lang")]).select("lang", "rank", "doc_id", "text")
    out: dict[str, list[str]] = {g: [] for g in counts}
    chars = dict.fromkeys(counts, 0)
    for r in got.orderBy("rank", "doc_id").toLocalIterator():
        if chars[r["lang"]] < chars_per_lang and len(r["text"]) <= chars_per_lang:
            out[r["lang"]].append(r["text"])
            chars[r["lang"]] += len(r["text"])
    return out


def train(docs: DataFrame, *, where: Column | None = None, docs_per_lang: int = 300, chars_per_lang: int = 500_000) -> ContextTrees:
    """Context trees of the languages in ``lang``, from rows that fulfil ``where``."""
    where = F.lit(True) if where is None else where
    return ContextTrees(training_sample(docs, where=where, docs_per_lang=docs_per_lang, chars_per_lang=chars_per_lang))


def predict(docs: DataFrame, model: ContextTrees, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``lang_pred string``, ``score double`` and ``bits_per_byte double``, row by row; no shuffle.

    Rows with null ids and repeated rows are predicted like any other. Other columns are not read; a column to keep that is
    named like a result raises.
    """
    common.free_names(keep, ("lang_pred", "score", "bits_per_byte"))
    spark = docs.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    names = [*keep, "lang_pred", "score", "bits_per_byte"]
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        tables = trees.tables()  # of this task: workers outlive it, several to a core, and would each hold them
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            known = [has_letter(t) and bool(trees.langs) for t in texts]
            lang, score, rate = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            todo = [i for i, k in enumerate(known) if k]
            if todo:
                bits = trees.score([texts[i] for i in todo], tables)
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000.0)).sum(1)
                for row, i in enumerate(todo):
                    lang[i] = trees.langs[best[row]]
                    score[i] = 1.0 / odds[row]
                    rate[i] = bits[row].min() / max(len(texts[i].encode("utf-8", "replace")), 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=names
            )

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(common.tidy(run), schema)
