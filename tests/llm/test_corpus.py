"""Corpus operators against brute force, round trips and held-out accuracy; edge rows for each of them."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eigenflux.llm import common, contamination, fingerprint, graph, jaccard, langid, lines, quality, queries, repeats, secret_scan, sharding, spm

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, entry string, a string, mode int"
LONG = "wide words and more of them " * 3000


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with names that operators use."""
    base = [
        (1, "The same line here of text\nand another one", "en", "src0", 42, "x", "y", 1), (1, "The same line here of text\nand another one", "en", "src0", 42, "x", "y", 1),
        (2, "", "en", "src0", 0, "x", "y", 1), (3, None, "en", None, None, None, None, None), (4, "12345 67890", None, "src1", 11, "x", "y", 1),
        (5, LONG, "en", "src0", len(LONG), "x", "y", 1), (6, LONG + "end", "en", "src0", None, "x", "y", 1), (None, "no id at all", None, None, None, "x", "y", 1),
        (7, " \n\t ", "fr", "src0", 4, "x", "y", 1), (8, "é漢字 😀 ▁ x", "fr", "src0", 9, "x", "y", 1),
    ]
    return spark.createDataFrame(base, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def folder(spark, tmp_path, df, name="documents"):
    df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# components


def test_components_on_the_driver_and_by_stars_agree(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(4000) * 7 - 999, rng.randrange(4000) * 7 - 999) for _ in range(2500)] + [(10**6 + i, 10**6 + i + 1) for i in range(70)]
    links = spark.createDataFrame(pairs, "a long, b long")
    own, stars = ({(r["node"], r["component"]) for r in graph.components(links, small=n).collect()} for n in (graph.SMALL, 0))
    assert own == stars and (10**6 + 70, 10**6) in own
    named = links.selectExpr("concat('n', a) as a", "concat('n', b) as b")  # not whole numbers: stars
    assert graph.components(named).select("component").distinct().count() == len({c for _, c in own})


def test_lines_rounds_keep_every_link(spark, monkeypatch):
    """Several rounds of drawn lines move components of components; the result is that of every pair compared."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijk") for _ in range(90)) for _ in range(6)]
    texts = []
    for i in range(160):
        line = list(base[i % 6])
        for _ in range(rng.randrange(7)):
            line[rng.randrange(90)] = rng.choice("xyz")
        texts.append("".join(line))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r["doc_id"]: r["removed"] for r in lines.removed(docs, threshold=0.5, width=5, bands=20, rows=1).collect()}
    calls, found = [], lines._pivot_links
    monkeypatch.setattr(lines, "_pivot_links", lambda *a: calls.append(1) or found(*a))
    monkeypatch.setattr(lines._join_rest, "__kwdefaults__", {"each": 0, "most": 3})
    rounds = {r["doc_id"]: r["removed"] for r in lines.removed(docs, threshold=0.5, width=5, bands=20, rows=1).collect()}
    assert calls and rounds == plain
    sets = [{t[i : i + 5] for i in range(len(t))} for t in texts]  # as shingles at the line's end are shorter
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {i for i, gone in plain.items() if not gone} == set(root)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find(pairs, {n for p in pairs if p[0] != p[1] for n in p})
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 secrets


def test_secret_forest_holds_out(spark):
    forest = secret_scan.train(secret_scan.default_findings(spark))
    held = secret_scan.features(secret_scan.default_findings(spark, 1000, seed=99)).select(*secret_scan.FEATURES, "is_secret", forest.column().alias("score")).toPandas()
    assert ((held["score"] >= 0.5) == (held["is_secret"] == 1)).mean() > 0.97
    assert np.allclose(forest.predict(held[secret_scan.FEATURES].to_numpy()[:50]), held["score"][:50], atol=1e-5)


def test_secret_candidates(spark):
    key = base64.b64encode(hashlib.sha256(b"k").digest()).decode()
    docs = docs_of(spark, [f'say token = "{key}" and more thewordsandotherwordsinline', None, "", "short", f"{key} {key}"])
    forest = secret_scan.train(secret_scan.default_findings(spark))
    found = secret_scan.scan(docs, forest).collect()
    want = [(i, m.start(), m.group()) for i, t in enumerate([r["text"] for r in docs.orderBy("doc_id").collect()]) for m in re.finditer(secret_scan.CANDIDATE, t or "")]
    assert sorted((r["doc_id"], r["start"], r["candidate"]) for r in found) == sorted(want)
    by = {(r["doc_id"], r["start"]): r["is_secret"] for r in found}
    assert by[(0, 13)] and not by[(0, max(s for d, s, _ in want if d == 0))]
    assert secret_scan.train(secret_scan.default_findings(spark).limit(0)).column() is not None


# 2 lines


def fold(line):
    return re.sub(r"[ \t\n\x0B\f\r]+", " ", line.lower()).strip(" ")


def test_lines(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(30)] for _ in range(6)]
    texts = []
    for _ in range(40):
        own = []
        for _ in range(rng.randrange(4)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                w[rng.randrange(30)] = rng.choice(words)
            own.append("  ".join(w) if rng.random() < 0.2 else " ".join(w))
        texts.append("\n".join(own + ["", "Fin."]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["removed"] for r in lines.removed(docs_of(spark, texts)).collect()}
    assert got == every_position(rows)
    text = {r["doc_id"]: r["text"] for r in lines.without(docs_of(spark, texts), lines.removed(docs_of(spark, texts))).collect()}
    for i, t in rows:
        assert text[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i])


def every_position(rows, threshold=0.8, width=12):
    """Removed lines by brute force over the shingles of every character."""
    occurs = [(i, k, fold(x)) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if fold(x)]
    sets = {n: frozenset(n[c : c + width] for c in range(len(n))) for _, _, n in occurs}
    keys = sorted(sets)
    pairs = [(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    group, seen, gone = union_find(pairs, keys), set(), collections.defaultdict(list)
    for i, k, n in occurs:
        if group[n] in seen:
            gone[i].append(k)
        seen.add(group[n])
    return {i: gone[i] for i, _ in rows}


def test_lines_shingle_every_character(spark):
    rng = random.Random(8)
    glyphs = [chr(c) for c in range(0x4E00, 0x4F00)] + ["😀", "\u2028"]
    long = ["".join(rng.choice(glyphs) for _ in range(150)) for _ in range(4)]
    texts = ["https://www.example.org/a", "https://www.other.net/b/c", "data/2024-01/file_000001", "data/2024-01/file_999999"]
    texts += ["漢字仮名交文章一二三四五六" + x for x in ("春夏秋冬東西南北上下左右", "犬猫鳥魚牛馬羊豚鼠虎兎竜")]
    texts += [x[:at] + "文" + x[at + 1 :] for x in long for at in (3, 70, 149)] + long
    texts += [" ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(9)) for _ in range(25)) + end for end in ("", " x") for _ in range(3)]
    texts.append("\n".join([texts[0], texts[-1].upper(), long[0][:-1]]))
    got = {r["doc_id"]: r["removed"] for r in lines.removed(docs_of(spark, texts)).collect()}
    assert got == every_position(list(enumerate(texts)))
    assert not any(got[i] for i in range(6))


def test_lines_recall_on_documents(spark):
    """Every link of the distinct lines of a whole table, by an inverted index over shingles, against the classes found."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {n: {n[c : c + 12] for c in range(len(n))} for n in {fold(x) for _, t in rows for x in (t or "").split("\n")} if n}
    holds = collections.defaultdict(list)
    for n, own in sets.items():
        for g in own:
            holds[g].append(n)
    links = set()
    for n, own in sets.items():
        shared = collections.Counter(m for g in own for m in holds[g] if m < n)
        links |= {(m, n) for m, i in shared.items() if i >= 0.8 * (len(own) + len(sets[m]) - i) - 1e-9}
    assert len(links) > 10
    group = union_find(sorted(links), sorted(sets))
    kept = {(r["doc_id"], r["line"]) for r in lines._kept(docs, "text", 0.8, 12, 10, 3).collect()}
    text = dict(rows)
    found = {group[fold(text[i].split("\n")[k])] for i, k in kept}
    assert found == set(group.values())  # one line stays of each true component at least
    assert len(kept) - len(found) <= 0.01 * len(links)


def test_lines_minhash_values_are_the_least_of_all_shingles(spark):
    """Values of which only shingles below a bound are looked at, and of lines of which none may be below it."""
    rng = random.Random(31)
    row = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [row(n, "abcdefghij") for n in (1, 11, 39, 41, 60, 200, 1500) for _ in range(4)] + ["ab" * 300, "-" * 500, "漢" * 90 + "字", row(80, "漢字😀文")]
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "k1 long, k2 long, norm string")
    words = lines._words(30)
    own = {r["k1"]: {h for h in r["s"]} for r in docs.select("k1", lines.shingles(F.col("norm"), 12).alias("s")).collect()}
    least = {i: [min(h ^ w for h in hs) for w in words] for i, hs in own.items()}
    found = lines._least(docs, 12, words)
    rare = set()
    for r in found.collect():
        got = [r[f"m{j}"] for j in range(30)]
        assert all(g in (None, m) for g, m in zip(got, least[r["k1"]]))
        if None in got:
            rare.add(r["k1"])
    assert {texts.index("ab" * 300), texts.index("-" * 500)} <= rare and len(rare) < 8
    values = spark.createDataFrame([(i, m) for i, m in least.items()], "k1 long, m array<long>")
    true = values.select("k1", lines._bands([F.col("m")[j] for j in range(30)], 3).alias("wanted"))
    both = docs.select("k1", lines._rare_bands(F.col("norm"), 12, words, 3).alias("bands")).join(true, "k1")
    assert both.where("bands = wanted").count() == len(texts)


def test_lines_of_few_shingles(spark):
    """Long lines that repeat themselves, which no bound on hashes fits, are compared like others."""
    texts = ["ab" * 300, "ab" * 299, "-" * 400, "-" * 401, "xyz " * 90 + "end of it", "one of its own"]
    got = {r["doc_id"]: r["removed"] for r in lines.removed(docs_of(spark, texts)).collect()}
    assert got == every_position(list(enumerate(texts)))


def test_lines_hand_on_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a line of text that is here\na line of text that is here", 7, 8)], "doc_id long, text string, n_lines int, removed int")
    out = lines.without(docs, lines.removed(docs)).collect()
    assert [tuple(r) for r in out] == [(1, "a line of text that is here", 7, 8, 1, 1)]
    with pytest.raises(ValueError):
        lines.without(docs.withColumn("__gone", F.lit(1)), lines.removed(docs))


def test_lines_in_one_bucket_are_all_compared(spark):
    rng = random.Random(21)
    row = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for _ in range(12):
        base = row(110)
        texts += [base + row(at) for at in (12, 14, 40, 42)] + [row(at) + base for at in (14, 24)]
    got = {r["doc_id"]: r["removed"] for r in lines.removed(docs_of(spark, texts), bands=24, rows=1).collect()}
    assert got == every_position(list(enumerate(texts)))


def test_lines_of_a_crowded_bucket(spark):
    """Many lines of one bucket in different components: rounds of drawn lines, then pairs, lose no link and make none."""
    rng = random.Random(22)
    row = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = row(200)
    texts = [base + row(rng.choice([18, 24, 40, 60])) for _ in range(50)] + [row(rng.choice([22, 45])) + base for _ in range(30)]
    got = {r["doc_id"]: r["removed"] for r in lines.removed(docs_of(spark, texts), bands=24, rows=1).collect()}
    assert got == every_position(list(enumerate(texts)))


def test_lines_of_rows_that_share_an_id(spark):
    line = "one line that is said more than once"
    rows = [(1, line), (None, line + "\nand one of its own"), (None, "a clean document of one line"), (7, "first of two rows"), (7, line + "\nsecond of two rows"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lines.without(docs, lines.removed(docs)).collect()
    kept = collections.Counter("a clean document of one line,first of two rows,second of two rows".split(",") + ["and one of its own"])
    assert len(out) == len(rows)
    left = collections.Counter(x for r in out for x in (r["text"] or "").split("\n") if x)
    assert left == kept + collections.Counter([line])
    assert not [r for r in out if r["__gone"] and not r["__left"] and r["text"] != ""]


# 3 jaccard


def brute_jaccard(rows, percent, width):
    sets = {i: frozenset(jaccard.shingle_set(t, width).tolist()) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = union_find(pairs, sets)
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.mark.parametrize("percent,width", [(90, 3), (80, 5)])
def test_jaccard(spark, percent, width):
    rng = random.Random(percent)
    texts = []
    for n in (2, 4, 9, 14, 25, 60, 150):
        base = [f"t{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new"], [w[k], "more"]]) or ["z"]
            texts.append(" ".join(w))
    texts += ["", None, "One", "one", "ONE  "]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(spark, texts), percent=percent, width=width).collect()}
    assert got == brute_jaccard(list(enumerate(texts)), percent, width)


def test_jaccard_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(3, b), (5, a), (5, b), (9, a), (4, c), (9, None), (8, None), (None, c), (None, "alone and without an id")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(3, 38, 3), (5, 38, 3), (5, 38, 3), (9, 38, 3), (4, 38, 4), (9, 0, 3), (8, 0, 8), (None, 38, 4), (None, 3, None)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_entries_are_dealt_once(spark, monkeypatch):
    """Where no id has two sets, entries are not moved to find their node; no verified pair moves sets that are in no pair."""
    plans, write = {}, common.materialize

    def watch(df, name, **how):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, **how)

    monkeypatch.setattr(common, "materialize", watch)
    rng = random.Random(3)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(20)]
    texts = [" ".join(b[: 40 - k]) for b in base for k in range(3)] + [" ".join(base[0])] * 3
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs_of(spark, texts)).collect()}
    assert got == brute_jaccard(list(enumerate(texts)), 90, 3)
    assert "hashpartitioning(entry" in plans["jaccard-entries"] and "hashpartitioning(key" not in plans["jaccard-entries"]
    assert plans["jaccard-sets"].count("hashpartitioning(key") <= 2  # the sets, and the nodes that they are joined with
    assert plans["jaccard-verified"].count("MapInArrow") >= 3  # both sides thinned, then compared


def test_profiles_bound_distances():
    rng = np.random.default_rng(6)
    for _ in range(200):
        both, x, y = (rng.integers(0, 1 << 62, rng.integers(0, 2000)).astype(np.uint64) for _ in range(3))
        x, y = np.unique(np.concatenate((both, x))), np.unique(np.concatenate((both, y)))
        if len(x) and len(y):
            true = 1 - len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            assert jaccard.least_distance(jaccard.profile(x), jaccard.profile(y), len(x), len(y)) <= true + 1e-12
    x, y = (np.unique(rng.integers(0, 1 << 62, 20_000).astype(np.uint64)) for _ in range(2))
    assert jaccard.least_distance(jaccard.profile(x), jaccard.profile(y), len(x), len(y)) > 0.4


def test_shared_entries_over_batches():
    rng = np.random.default_rng(5)
    rows = np.unique(rng.integers(0, [40, 9], (200, 2)), axis=0)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))].repeat(rng.integers(1, 3, len(rows)), axis=0)
    by = collections.defaultdict(set)
    for e, v in rows.tolist():
        by[e].add(v)
    want = sorted((e, v) for e, own in by.items() if len(own) > 1 for v in own)
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + size, 0]), pa.array(rows[k : k + size, 1]), pa.array(rows[k : k + size, 1])], names=["e", "v", "n"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        assert sorted((e, v) for e, v, _ in got) == want


SCHEMES = {p: jaccard.Scheme(p) for p in (90, 80)}


def test_pigeonhole_meets_every_link():
    rng = random.Random(5)
    for percent in (90, 80) * 1000:
        scheme = SCHEMES[percent]
        n = rng.choice([9, 10, 12, 19, 20, 25, 40, 80, 150])
        x = {rng.getrandbits(63) for _ in range(n)}
        y = set(rng.sample(sorted(x), len(x) - rng.randrange(1 + n // (15 if percent == 90 else 8)))) | {rng.getrandbits(63) for _ in range(rng.randrange(1 + n // (15 if percent == 90 else 8)))}
        if x != y and 100 * len(x & y) >= percent * len(x | y):
            a, b = (scheme.entries(np.sort(np.array(sorted(s), np.uint64))) for s in (x, y))
            assert len(np.intersect1d(a, b))


def test_allowances_are_chosen_by_cost():
    assert jaccard.allocate(400, 40)[1] == 0
    assert any(jaccard.Scheme(90).of(b)[2] > 0 for b in range(4, 14))


# 4 languages


class Brute:
    """Prediction by partial matching, method C, as dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, collections.defaultdict(collections.Counter)
        for t in texts:
            b = [-1] * order + list(t.lower().encode())
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.seen[tuple(b[i - k : i])][b[i]] += 1

    def bits(self, text):
        b, total = [-1] * self.order + list(text.lower().encode()), 0.0
        for i in range(self.order, len(b)):
            for k in range(self.order, -1, -1):
                c = self.seen.get(tuple(b[i - k : i]))
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    total += math.log2((n + d) / c[b[i]])
                    break
                total += math.log2((n + d) / d)
            else:
                total += math.log2(257)
        return total


def test_code_lengths():
    samples = {"en": ["The cat sat on the mat.", "hello there"], "fr": ["le chat été là", "où est le thé the"], "xx": [""]}
    trees = langid.ContextTrees(samples)
    tests = ["the theé cat", "où zzz", "a", "", "Le thé hello ñ", "the cat sat. le chat" * 3]
    got = trees.score(tests, trees.tables(), piece=7)
    want = [[Brute(samples[g], 4).bits(t) for g in trees.langs] for t in tests]
    assert np.allclose(got, want, atol=1e-3)


def test_language_held_out(spark):
    rows = queries.op4_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.95


def test_language_edges(spark, edges, none):
    model = langid.train(edges)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(edges, model).collect()}
    assert got[2] == got[3] == got[4] == got[7] == ("und", 0.0)
    assert got[5][0] == "en" and 0 <= got[5][1] <= 1
    assert {r["lang_pred"] for r in langid.predict(edges, langid.train(none)).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


# 5 fingerprints


def test_canonical_form():
    assert fingerprint.canonical("ﬁne  Ｔext\n") == fingerprint.canonical("FINE text") == b"fine text"
    assert fingerprint.canonical(None) == fingerprint.canonical(" \t") == b""


def test_fingerprints(spark, tmp_path):
    texts = ["A b c", "a  B C", "", None, "a b c", "other text", "ﬁn", "FIN", "x" * 5000] + ["hot copy"] * 60
    d = folder(spark, tmp_path, docs_of(spark, texts).repartition(5))
    rows = {r["doc_id"]: r for r in queries.op5_fingerprint(spark, d).collect()}
    plain = [t or "" for t in texts]
    first = {}
    for i, t in enumerate(plain):
        after = plain[(i + 1) % len(plain)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        c = fingerprint.canonical(t)
        first.setdefault(c, i)
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.digest(c) and r["edited_fingerprint"] == fingerprint.digest(fingerprint.canonical(edited))
        assert r["near_edited"] == float(c == fingerprint.canonical(edited)) and r["near_next"] == float(c == fingerprint.canonical(after))
        assert r["class_id"] == first[c]


def test_equal_prints_of_different_bytes_split(spark, monkeypatch):
    """Inside one bucket, bytes decide."""
    docs = docs_of(spark, ["same", "Same", "x"])
    marked = fingerprint.fingerprints(docs)
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.classes(docs, marked).collect()}
    assert got == {0: 0, 1: 0}


# 6 quality


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.BoostedTrees(trees=40).fit(x[:1000], y[:1000])
    assert ((model.score(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    one = model.score(x[:1])[0]
    total = model.base
    for f, t, v in zip(model.feature, model.threshold, model.value):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + int(x[0, f[node]] > t[node])
        total += v[node]
    assert np.isclose(one, 1 / (1 + np.exp(-total)))
    assert np.allclose(quality.BoostedTrees().fit(x[:5], np.ones(5)).score(x[:3]), 0.999)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.9


def test_quality_edges(spark, edges, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, 0), (5, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(edges, labels)
    assert quality.predict(edges, model).where("score >= 0 and score <= 1").count() == edges.count()
    assert quality.predict(none, model).count() == 0
    assert set(r["score"] for r in quality.predict(edges, quality.train(edges, labels.limit(0))).collect()) == {0.5}


# 7 repeats


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        out[i] = (len(b), np.frombuffer(b, np.uint8)[~gone].tobytes(), int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum()))
    return out


def test_repeats(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "x", "yy"]) for _ in range(rng.randrange(5))) for _ in range(60)]
    texts += [None, "", "ab" * 200, "ab" * 200, parts[0]]
    out = repeats.remove(docs_of(spark, texts).repartition(4), length=40, gram=12).collect()
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in out}
    assert got == brute_repeats(list(enumerate(texts)), 40)


def test_run_index():
    rng = random.Random(2)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 60))) for _ in range(8)]
        parts += [rng.choice(parts) + b"a" for _ in range(3)]
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + 1
        text[text == 1] = 0
        n = rng.choice([3, 7, 10, 20])
        index, seen, want = repeats.RunIndex(text), set(), np.zeros(len(text), bool)
        for i in range(len(text) - n + 1):
            w = tuple(text[i : i + n])
            if 0 not in w:
                want[i] = w in seen
                seen.add(w)
        assert (index.later_copies(n) == want).all()
        assert len(index.symbols) == len(index.place) <= len(text) and index.lengths.sum() == len(text)
        assert not hasattr(index, "order")


def test_equal_digest_halves_do_not_remove(monkeypatch):
    """Contexts that agree in one half of the digest only are told apart."""
    records = np.zeros(6, repeats._RECORD)
    records["c"], records["e"], records["d"] = 7, [1, 2, 1, 2, 3, 1], [5, 1, 2, 4, 3, 2]
    first, again = repeats._collapse(records)
    assert sorted(zip(first["e"].tolist(), first["d"].tolist())) == [(1, 2), (2, 1), (3, 3)]
    assert sorted(zip(again["e"].tolist(), again["d"].tolist())) == [(1, 5), (2, 4)]


def test_repeats_of_many_lengths(spark):
    rng = random.Random(12)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300, 900))) for _ in range(6)]
    texts = ["".join(rng.choice(parts)[rng.randrange(200) :] + rng.choice(["", "x"]) for _ in range(rng.randrange(4))) for _ in range(30)]
    for length in (100, 400, 600):
        got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in repeats.remove(docs_of(spark, texts), length=length).collect()}
        assert got == brute_repeats(list(enumerate(texts)), length)
    with pytest.raises(ValueError):
        repeats.remove(docs_of(spark, texts), length=1 << 16)


def test_contexts_take_little_memory():
    """A whole batch of texts, or one text of its size, is hashed in pieces: the peak does not follow the batch."""
    import tracemalloc

    rng = random.Random(12)
    text = "".join(rng.choices("abcdefgh ", k=4 << 20)).encode()
    for texts in ([text], [text[i : i + 4096] for i in range(0, len(text), 4096)]):
        tracemalloc.start()
        parts = repeats.contexts(texts, 100, 24)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(parts[0]) > 60_000
        assert peak < 120 << 20
    small = repeats.contexts(texts[:3], 100, 24)
    assert all((a[: len(b)] == b).all() for a, b in zip(parts, small))


def test_contexts_of_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (3000, 50, 1200)]
    whole = repeats.contexts(texts, 100, 24)
    monkeypatch.setattr(repeats, "_PLACE", 10)
    cut = repeats.contexts(texts, 100, 24)
    windows = lambda c: sorted((d, w) for d, f, l in zip(c[0].tolist(), c[1].tolist(), c[2].tolist()) for w in range(f, l + 1))
    assert windows(whole) == windows(cut) == [(d, w) for d, t in enumerate(texts) for w in range(len(t) - 99)]


# 8 pieces


def test_pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table, rng = spm.ChunkTable(sp, 500), random.Random(1)
    assert not spm.crossing_pieces(sp)
    texts = ["".join(rng.choice(" ▁ ab\n\tthé漢😀\r#.,in</s><unk>0x́　") for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", " ", "  ", "▁", "x "]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        offsets, ids = table.encode(part)
        for k, t in enumerate(part):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == sp.encode(t)


def test_pieces_query(spark, tmp_path, edges):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = folder(spark, tmp_path, edges)
    texts = {r["doc_id"]: r["text"] or "" for r in edges.collect()}
    for r in queries.op8_sentencepiece(spark, d).collect():
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    out = spm.decode(spm.encode(edges, MODEL).select("doc_id", "ids"), MODEL)
    assert {r["doc_id"]: r["decoded"] for r in out.collect()}[1] == texts[1]


# 9 contamination


def test_fm_index():
    rng = random.Random(3)
    for _ in range(80):
        words = [f"w{i}" for i in range(rng.choice([2, 3, 8]))]
        items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randrange(10)))) for i in range(rng.randrange(1, 6))]
        phrases = contamination.Phrases(items, rng.choice([1, 2, 3, 5]))
        docs = [[rng.choice([*words, "zz"]) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 8))]
        numbers = [np.array([phrases.number.get(w.encode(), 0) for w in d], np.int32) for d in docs]
        got = sorted(zip(*(x.tolist() for x in contamination.search_shard(numbers, phrases, rng.choice([1, 2, 8])))))
        name = {v: k.decode() for k, v in phrases.number.items()}
        want = []
        for p in range(len(phrases.length)):
            w = [name[x] for x in phrases.symbols[p, : phrases.length[p]][::-1]]
            want += [(i, k, p) for i, d in enumerate(docs) for k in range(len(d) - len(w) + 1) if d[k : k + len(w)] == w]
        assert got == sorted(want)


@pytest.mark.parametrize("block", [500_000, 12])
def test_contamination(spark, block):
    words = [f"Wörd{i}" for i in range(40)]
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((14, 11, 10, 3, 1))] + [(5, ""), (6, None), (None, "null item here")]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(20)) + rng.choice([", ", "! "]) + rng.choice(items[:4])[1].upper() + " tail" for _ in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.find(docs_of(spark, texts), bench, clean=True, block_words=block).withColumn("n_hit", contamination.n_hit()).collect()
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    for r in found:
        w, hit, who = low(texts[r["doc_id"]]), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(w[k : k + n])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(who))
        assert low(r["text"]) == [x for k, x in enumerate(w) if k not in hit]


# 10 shards


def test_shards(spark, tmp_path):
    docs = docs_of(spark, [f"text {i} " * 50 for i in range(400)] + [None, ""])
    store = sharding.ShardedDataset(spark, str(tmp_path / "s"), target_bytes=20_000, least_bytes=500)
    for k in range(3):
        store.append(docs.where(f"doc_id % 3 = {k}").repartition(4), F.lit(k))
    before = store.manifest().count()
    last = store.compact()
    assert store.version() == last > 3 and store.manifest().count() < before
    assert store.manifest().where("tier < 99").groupBy("tier").count().where("count >= 4").isEmpty()
    assert store.read().select(docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(store.read().select(docs.columns)).isEmpty()
    assert store.manifest().agg(F.sum("rows")).first()[0] == 402
    with pytest.raises(Exception, match="exist"):
        store.commit(store.manifest(), last)
    assert store.version() == last


def test_shards_spare_other_writers_and_readers(spark, tmp_path):
    docs = docs_of(spark, [f"text {i} " * 50 for i in range(100)])
    store = sharding.ShardedDataset(spark, str(tmp_path / "s"), target_bytes=20_000, least_bytes=500)
    for k in range(2):
        store.append(docs.where(f"doc_id % 2 = {k}").repartition(3), F.lit(k))
    old = store.read()
    docs.write.parquet(str(tmp_path / "s/data/append-other"))  # another writer's run, not yet committed
    store.compact()
    assert old.count() == 100 and spark.read.parquet(str(tmp_path / "s/data/append-other")).count() == 100
    store.vacuum(keep=1)
    assert old.count() == 100 and (tmp_path / "s/data/append-other").exists()
    store.vacuum(keep=1, age=0)
    assert store.read().count() == 100 and not (tmp_path / "s/data/append-other").exists()
    with pytest.raises(ValueError):
        store.append(docs.withColumn("shard", F.lit("x")), F.lit(0))


def test_shards_of_two_writers(spark, tmp_path, monkeypatch):
    docs = docs_of(spark, [f"text {i}" for i in range(20)])
    one, two = (sharding.ShardedDataset(spark, str(tmp_path / "s"), least_bytes=500) for _ in range(2))
    commit, raced = sharding.ShardedDataset.commit, []

    def late(self, shards, version):
        if self is one and len(raced) < 2:
            raced.append(version)
            two.append(docs.where("doc_id >= 10").repartition(4), F.lit(len(raced)))
        commit(self, shards, version)

    monkeypatch.setattr(sharding.ShardedDataset, "commit", late)
    assert one.append(docs.where("doc_id < 10").repartition(4), F.lit(0)) == 3  # loses twice
    assert raced == [1, 2] and one.read().count() == 30
    raced.clear()
    one.compact()
    assert len(raced) == 2 and one.read().count() == 50


# edges of the rest, and the pipeline


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "some words of text", 5, "x")], "doc_id long, text string, score int, items string")
    none = spark.createDataFrame([], "item_id string, text string")
    with pytest.raises(ValueError):
        langid.predict(docs, langid.train(docs.withColumn("lang", F.lit("en"))), keep=("doc_id", "score"))
    with pytest.raises(ValueError):
        contamination.find(docs, none, keep=("doc_id", "items"))
    with pytest.raises(ValueError):
        spm.encode(docs.withColumn("ids", F.lit(1)), MODEL, keep=("doc_id", "ids"))
    assert [r["text"] for r in contamination.find(docs, none, keep=("doc_id", "score"), clean=True).collect()] == ["some words of text"]


def test_workers_hold_nothing_between_tasks(spark, none):
    """Python workers outlive tasks and take turns: what one operator keeps in them takes memory from the next."""
    docs = docs_of(spark, ["a few words of text " * 20, "quelques mots de texte " * 20]).withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("fr"))
    assert spm.encode(docs, MODEL).count() == 2
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect()} == {"en", "fr"}

    def held(batches):
        import gc

        tables = sum(isinstance(o, spm.ChunkTable) for o in gc.get_objects())
        caches = sum(len(v) for m in (langid, spm) for v in vars(m).values() if isinstance(v, dict) and v is not m.__builtins__)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tables + caches], pa.int64())], names=["n"])

    assert [r["n"] for r in spark.range(4).mapInArrow(held, "n long").collect()] == [0] * 4


def test_language_of_a_long_text_takes_bounded_memory():
    trees = langid.ContextTrees({g: [t * 40] for g, t in (("en", "some plain words "), ("fr", "des mots tout simples "), ("de", "ganz einfache Worte "))})
    tables, text = trees.tables(), "some plain words " * 120_000
    tracemalloc.start()
    found = trees.score([text], tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.argmin() == trees.langs.index("en") and peak < 12 * len(text)


def test_letters():
    assert not any(map(langid.has_letter, ("", "½ ²", "①② 12 _", "\n")))
    assert all(map(langid.has_letter, ("½ a", "字", "é")))


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op6_quality", "op9_contamination")])
def test_edges_and_empty(spark, tmp_path, edges, none, name):
    d = folder(spark, tmp_path, edges)
    n = queries.queries()[name](spark, d).count()
    if name == "op1_secret_scan":
        assert n == sum(len(re.findall(secret_scan.CANDIDATE, r["text"] or "")) for r in edges.collect())
    elif name == "op2_line_dedup":
        assert n == edges.select("doc_id").distinct().count()
    else:
        assert n == edges.count()
    (tmp_path / "e").mkdir()
    assert queries.queries()[name](spark, folder(spark, tmp_path / "e", none)).count() == 0


def test_contamination_edges(spark, edges, none):
    bench = spark.createDataFrame([(1, "no id at all"), (2, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], len(r["spans"])) for r in contamination.find(edges, bench).collect()}
    assert got[None] == (4, 1) and got[2] == got[3] == (0, 0)
    assert contamination.find(none, bench).count() == 0
    assert contamination.find(edges, bench.limit(0)).where("size(spans) > 0").isEmpty()


def test_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(12)
    en = "the of and to in is that for it was on are with as his they be at one have this from or had by".split()
    fr = "le la les des une est dans pour que qui sur pas au avec son plus par ce nous vous mais être".split()
    text = lambda pool, n: " ".join(rng.choice(pool) + rng.choice(["", "s", "ed", "ment"]) for _ in range(n))
    docs = [text(en, 60) if i % 2 else text(fr, 60) for i in range(40)]
    near = docs[1].split()
    near[30] = "changed"
    passage = text(en, 12)
    shared = text(en, 25)
    docs += [" ".join(near), docs[3], "12 34", None, docs[5] + "\n" + shared, docs[7][:120] + " own words of this one\n" + shared, text(en, 30) + " " + passage + " " + text(en, 30)]
    rows = [(i, t, "fr" if i < 40 and i % 2 == 0 else "en", "s", len(t or "")) for i, t in enumerate(docs)]
    d = folder(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    folder(spark, tmp_path, spark.createDataFrame([(1, passage)], "item_id long, text string"), "benchmark")
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"out-{name}")
        stage(spark, now, d).write.parquet(path)
        seen[name], now = now.select("doc_id", "text").collect() if "text" in now.columns else [], spark.read.parquet(path)
        if name != "sentencepiece":
            assert set(now.columns) == set(corpus_pipeline.COLUMNS)
            assert now.where("n_chars <> length(text)").isEmpty() or name == "language_id"
    assert len(stages) == 5
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("line_dedup") == set(range(len(docs))) - {42, 43}
    gone = every_position([tuple(r) for r in seen["line_dedup"]])
    want = {}
    for i, t in ((r["doc_id"], r["text"]) for r in seen["line_dedup"]):
        kept = [x for k, x in enumerate(t.split("\n")) if k not in gone[i]]
        if kept:
            want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in seen["ngram_jaccard"]} == want
    group = brute_jaccard(list(want.items()), 80, 5)
    left = {i: t for i, t in want.items() if group[i][1] == i}
    assert {r["doc_id"]: r["text"] for r in seen["decontamination"]} == left
    clean = {r["doc_id"]: r["text"] for r in seen["sentencepiece"]}
    assert set(clean) == set(left) and passage not in clean[46]
    assert now.count() == len(left) and now.where("not round_trip").isEmpty()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(left)


def test_shared_folder_is_known_or_raises():
    from types import SimpleNamespace

    def asked(master, **settings):
        conf = SimpleNamespace(get=lambda key, default=None: settings.get(key.replace(".", "_"), default))
        return common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))

    assert asked("spark://far:7077", spark_checkpoint_dir="hdfs://a/b/") == "hdfs://a/b"
    assert asked("local[4]", spark_sql_warehouse_dir="file:/w") == "file:/w/_scratch"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        asked("spark://far:7077", spark_sql_warehouse_dir="file:/w")
