"""Secret scan with a random forest that removes false positives, in DataFrame operations only.

Candidates are runs of 16 or more token characters. Their features are length, shares of character kinds, transitions between
kinds, common letter pairs, coverage by dictionary words, marks of the path (source) and of neighbouring words. A forest is
grown on labelled findings (a bounded table, at most ``max_rows`` rows taken by least hash) on the driver and becomes one
nested CASE expression a tree, so scoring stays in generated code. Without findings of its own, ``train`` uses
``default_findings``, made by rule: keys, hexadecimal and base64 tokens in assignments against long words, identifiers,
checksums after their names, numbers, paths, addresses and placeholders.

A null or empty text has no candidate. Repeated rows give repeated findings; a null id or source is kept as null (a null
source counts as a plain path). A candidate of any length is taken whole. Other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"[A-Za-z0-9+/_=~-]{16,}"
BEFORE, AFTER = 48, 24

#: Words that dictionary coverage counts, and frequent letter pairs.
WORDS = (
    "the and that for with was this from they are not have you which one all were when there can more would about other into than time only some could these two may then "
    "first any new very what over such our even most made after also did many before must through where much your way down should because each just those people how too little "
    "state good make world still own see work long get here between both life being under never day same another know while last might great year off come since against right "
    "tion ment ness able ible ing ung keit heit lich schaft cion mente ado que les des dans pour ation eau eux ier elle"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st nt ng le se ou io de ro ri ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = [
    "length", "digits", "upper", "lower", "marks", "hexadecimal", "distinct", "transitions", "pairs", "dictionary", "run",
    "keyword", "assigned", "quoted", "named_hash", "placeholder", "test_path", "path_marks",
]


def candidates(docs: DataFrame, *, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, path, ordinal, start, candidate, before, after`` of every candidate; ``start`` counts characters from 0."""
    text = F.col(f"`{text_col}`")
    found = docs.select("doc_id", F.col(f"`{path_col}`").alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("c"), text.alias("t"))
    found = found.where(F.size("c") > 0).select("doc_id", "path", "c", F.split("t", CANDIDATE).alias("gap"))
    lengths = F.zip_with(F.slice("gap", 1, F.size("c")), "c", lambda g, c: F.struct(F.length(g).alias("g"), F.length(c).alias("n")))
    sums = F.aggregate(
        lengths,
        F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.array_append(s["starts"], s["at"] + x["g"]).alias("starts"), (s["at"] + x["g"] + x["n"]).alias("at")),
    )["starts"]
    rows = found.select("doc_id", "path", "c", "gap", sums.alias("starts"))
    rows = rows.select("doc_id", "path", "gap", F.posexplode(F.arrays_zip("c", "starts")).alias("ordinal", "x"))
    gap, after = F.element_at("gap", F.col("ordinal") + 1), F.element_at("gap", F.col("ordinal") + 2)
    return rows.select(
        "doc_id", "path", "ordinal", F.col("x.starts").alias("start"), F.col("x.c").alias("candidate"), F.right(gap, F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after")
    )


def features(found: DataFrame) -> DataFrame:
    """The frame with ``FEATURES`` as doubles."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    low, before = F.lower("candidate"), F.lower("before")

    def share(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    def flag(column: Column, pattern: str) -> Column:
        return F.when(column.rlike(pattern), 1.0).otherwise(0.0)

    left = F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=lambda w: (-len(w), w))), ""))
    path = F.coalesce(F.lower("path"), F.lit(""))
    return found.withColumns(
        {
            "length": n,
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "marks": share("[^A-Za-z0-9]"),
            "hexadecimal": flag(c, "^[0-9a-fA-F]+$"),
            "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.least(n, F.lit(64.0)),
            "transitions": share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
            "pairs": share(f"(?=(?:{'|'.join(PAIRS)}))", low),
            "dictionary": 1 - left / n,
            "run": flag(c, r"(.)\1{4,}"),
            "keyword": flag(before, r"(token|secret|api.?key|access.?key|passw|pwd|auth|bearer|credential|private)[^a-z0-9]{0,12}$"),
            "assigned": flag(before, r"[=:]\s*[\"'`]?$"),
            "quoted": flag(F.col("before"), "[\"'`]$") * flag(F.col("after"), "^[\"'`]"),
            "named_hash": flag(before, r"(commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|uuid|revision|integrity)[^a-z0-9]{0,12}$"),
            "placeholder": flag(low, r"example|sample|dummy|placeholder|changeme|your_|xxxx|insert|1234567|abcdef"),
            "test_path": flag(path, r"(^|[/_.-])(tests?|examples?|fixtures?|mocks?|docs?)([/_.-]|$)"),
            "path_marks": share("[/.]"),
        }
    )


class Forest:
    """Random forest of Gini trees: bootstrap rows, a random subset of features at each node."""

    def __init__(self, trees: int = 15, depth: int = 5, seed: int = 11):
        self.trees, self.depth, self.seed, self.grown = trees, depth, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.grown = []
        for _ in range(self.trees if len(y) else 0):
            rows = rng.integers(0, len(y), len(y))
            self.grown.append(self._grow(x[rows], y[rows], 0, rng))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int, rng: np.random.Generator):
        p = float(y.mean())
        if level == self.depth or p in (0.0, 1.0) or len(y) < 10:
            return p
        best = None
        for j in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n1 = cut + 1.0
            n2, s1 = len(y) - n1, t[cut]
            s2 = t[-1] - s1
            gini = 2 * (s1 * (1 - s1 / n1) + s2 * (1 - s2 / n2)) / len(y)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = (gini[k], int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best is None:
            return p
        _, j, threshold = best
        go = x[:, j] <= threshold
        return j, threshold, self._grow(x[go], y[go], level + 1, rng), self._grow(x[~go], y[~go], level + 1, rng)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node, row):
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([np.mean([walk(t, row) for t in self.grown]) if self.grown else 0.0 for row in x])

    def column(self) -> Column:
        """Mean vote of the trees as one expression over ``FEATURES``."""

        def case(node) -> str:
            if not isinstance(node, tuple):
                return f"{node:.6f}D"
            return f"CASE WHEN {FEATURES[node[0]]} <= {node[1]!r}D THEN {case(node[2])} ELSE {case(node[3])} END"

        if not self.grown:
            return F.lit(0.0)
        return sum((F.expr(case(t)) for t in self.grown[1:]), F.expr(case(self.grown[0]))) / len(self.grown)


def default_findings(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """Labelled findings by rule: ``candidate, before, after, path, is_secret``."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum = letters + letters.upper() + "0123456789"

    def pick(of, k):
        return "".join(of[i] for i in rng.integers(0, len(of), k))

    def one(of):
        return of[int(rng.integers(0, len(of)))]

    def words(k):
        return "".join(one(WORDS) for _ in range(k))

    rows = []
    for i in range(n):
        path = one(["src/app.py", "src1", "config/prod.yaml", "web/main.js", "notes.txt", None])
        talk = " ".join(one(WORDS) for _ in range(5)) + " "
        if i % 2:
            value = one(
                [
                    lambda: pick("0123456789abcdef", one([32, 40, 64])), lambda: pick(alnum, int(rng.integers(20, 60))), lambda: "AKIA" + pick(alnum[26:], 16),
                    lambda: base64.b64encode(rng.bytes(int(rng.integers(18, 48)))).decode(), lambda: one(["ghp_", "sk-", "xoxb-"]) + pick(alnum, 36),
                ]
            )()
            name = one(["token", "secret", "api_key", "password", "auth_token", "ACCESS_KEY", "client_secret"])
            before, after = one([(f'{name} = "', '"'), (f"{name}: ", "\n"), (f"{name}='", "'"), (f"{name} ", " "), (f'"{name}": "', '",')])
            rows.append((value, talk + before, after + " " + one(WORDS), path, 1))
            continue
        kind = int(rng.integers(0, 9))
        before, after = talk, " "
        if kind <= 2:
            value = words(int(rng.integers(5, 9)))
            value = one([value, value.upper(), value.capitalize()])
        elif kind == 3:
            value, before = pick("0123456789abcdef", one([32, 40, 64])), talk + one(["commit ", "sha256:", "md5 = ", "checksum: ", "digest "])
        elif kind == 4:
            value = pick("0123456789", int(rng.integers(16, 24)))
        elif kind == 5:
            value = "/".join(one(WORDS) for _ in range(6))
        elif kind == 6:
            value, before = one(["your_api_key_here", "xxxxxxxxxxxxxxxxxxxx", "example_token_value_123", "changeme_changeme_1234567"]), talk + 'token = "'
        elif kind == 7:
            value = one("-_=~") * int(rng.integers(16, 60))
        else:
            value, before, path = pick("0123456789abcdef", 40), talk + "id ", "tests/fixtures/ids.json"
        rows.append((value[:200], before, after, path, 0))
    frame = [(c, b[-BEFORE:], a[:AFTER], p, y) for c, b, a, p, y in rows if len(c) >= 16]
    return spark.createDataFrame(frame, "candidate string, before string, after string, path string, is_secret int")


def train(findings: DataFrame, *, max_rows: int = 20_000, **options) -> Forest:
    """A forest from labelled findings with the columns of ``default_findings``; rows without label are passed by."""
    known = findings.where("is_secret is not null and candidate is not null").fillna("", ["before", "after"])
    rows = features(known.orderBy(F.xxhash64("candidate", "before"), "is_secret").limit(max_rows)).select(*FEATURES, "is_secret").collect()
    if not rows:
        return Forest(**options)
    data = np.array([tuple(r) for r in rows], np.float64)
    return Forest(**options).fit(data[:, :-1], data[:, -1])


def scan(docs: DataFrame, forest: Forest, *, text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with ``score`` (0 to 1) and ``is_secret``; no shuffle."""
    found = features(candidates(docs, text_col=text_col, path_col=path_col))
    return found.withColumn("score", forest.column()).withColumn("is_secret", F.col("score") >= threshold)
