import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grainmill.llm import fingerprint, jaccard, language_id, mixing, search
from grainmill.llm._common import Workspace
from grainmill.llm.graph import connected_components
from pyspark.sql import functions as F

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()


def documents(spark, rows):
    """With columns beside the operators' own, and of names that they use."""
    full = [(i, t, "en" if (i or 0) % 2 else "fr", s, 0, 1, "x", -1.0) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component_id long, _row string, size double")


def near_copies():
    rows, base = [], [WORDS[(i * i + 3 * i) % len(WORDS)] + str(i % 17) for i in range(120)]
    for i in range(30):  # a chain: neighbours are alike, ends are not
        rows.append((i, " ".join(base[i : i + 90]), "a"))
    rows += [(100 + i, " ".join(base[:60]), "b") for i in range(5)]
    rows += [(200, "A b  c\td e", "a"), (201, "a B c d e", "a"), (202, "a b", None), (203, "A B", "a"), (204, "", "a"), (205, None, "a"), (206, " \n", "a"), (300, " ".join(base[::-1]) * 40, "b"), (None, "a b c d e", "b"), (201, "a B c d e", "a")]
    return rows


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, share):
    sets = [shingles(t, width) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [(r[0], len(s), least[group[k]] if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize(("width", "share", "refine", "star", "light"), [(4, 85, None, None, None), (5, 80, None, None, None), (2, 60, None, None, None), (4, 85, 2, 2, 3), (2, 60, 3, 10**9, 2)])
def test_jaccard_join(spark, monkeypatch, width, share, refine, star, light):
    if refine is not None:  # lists are given up, go by stars and by blocks, and components are distributed
        monkeypatch.setattr(jaccard, "ONE_TASK", 0)
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
        monkeypatch.setattr(jaccard, "PAIRS", 0 if width == 2 else 2)
        for name, value in (("REFINE", refine), ("STAR", star), ("LIGHT", light)):
            monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, rows), width, share).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, width, share), key=key)
    assert jaccard.join(documents(spark, rows).limit(0), width, share).count() == 0


def test_keep_first(spark):
    kept = jaccard.keep_first(documents(spark, near_copies()), 4, 85)
    assert kept.columns == documents(spark, []).columns
    got = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    groups = {c for _, n, c in brute(near_copies(), 4, 85) if n}
    assert got == sorted([*groups, 204, 205, 206])


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100), (50, 49), (49, 48), (None, 3)] + [(70, k) for k in range(71, 90)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()}
    assert got == {**{i: 0 for i in range(21)}, 48: 48, 49: 48, 50: 48, **{k: 70 for k in range(70, 90)}}


def mixture(n=120):
    return [(i, " ".join(["w"] * (1 + i * 7 % 97)), ["a", "b", None, "c"][i % 4]) for i in range(n)] + [(500, None, "a"), (501, "", "z"), (None, "w w", "b"), (3, "w w w", "b")]


def test_mixing(spark):
    rows = mixture()
    got = mixing.mix(documents(spark, rows)).select("row.doc_id", "row.source", "mix.*").collect()
    assert len(got) == len(rows)
    sizes, total = Counter(), 0
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        total += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * total, set(names)
    while open_:  # fill by weight, stop at twice the size, share the rest again
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]) for s in names)
    again = mixing.mix(documents(spark, rows).repartition(3)).select("row.doc_id", "mix.taken", "mix.size").collect()
    assert sorted(map(key, again)) == sorted(key((r["doc_id"], r["taken"], r["size"])) for r in got)
    out = mixing.mixed(documents(spark, rows))
    assert out.columns == documents(spark, []).columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(documents(spark, rows).limit(0)).count() == 0


def test_mixing_of_small_sources_with_long_texts(spark):
    """Sources of 20 documents, a few of them long and at the cap: no document's other rounding would come nearer to the target."""
    rng = random.Random(5)
    sizes = [(s, rng.choice([1500, 2500, 4000]) if i % 10 == 0 else rng.randint(20, 160)) for s in range(4) for i in range(20)]
    rows = [(i, " ".join(["w"] * n), f"s{s:02}") for i, (s, n) in enumerate(sizes)]
    got = mixing.mix(documents(spark, rows)).select("row.source", "mix.*").collect()
    assert any(r["rate"] == 2 for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        rest = own[0]["target"] - sum(r["taken"] for r in own)
        assert abs(rest) < 0.05 * own[0]["target"]
        for r in own:
            if r["rate"] < 2:
                change = r["size"] if r["copies"] == math.floor(r["rate"]) else -r["size"]
                assert abs(rest - change) >= abs(rest)


def test_fingerprints_of_edits(spark):
    rows = [(5, "x\ny\nz w v u t"), (5, "x\ny\nz w v u t"), (7, ""), (9, None), (11, "z w v u t\nx\ny"), (12, "é" * 9), (None, "first"), (20, "long line " * 3000)]
    got = fingerprint.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (i, t), (_, n) in zip(line, line[1:] + line[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["fingerprint"] == by[11]["fingerprint"] != by[12]["fingerprint"] and by[7]["fingerprint"] == by[9]["fingerprint"]
    assert by[20]["near_edited"] > 0.6 and by[11]["near_next"] == 0 and by[7]["near_next"] == 1
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprint.compare_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_add_up(spark):
    rows = spark.createDataFrame([(1, "a b c d\ne f"), (2, "a b c d"), (3, "e f")], "doc_id long, text string")
    m = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(rows, "doc_id").collect()}
    both = spark.createDataFrame([(m[1], m[2], m[3])], "x map<int,bigint>, y map<int,bigint>, z map<int,bigint>")
    r = both.select(fingerprint.combined(F.col("y"), F.col("z")).alias("sum"), fingerprint.combined(F.col("x"), F.col("z"), -1).alias("rest")).first()
    assert r["sum"] == m[1] and r["rest"] == m[2]


def test_languages(spark, sf_dir):
    got = language_id.op6_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.9 and 0 <= r[1] <= r[2] <= 1


def test_languages_of_odd_rows(spark):
    rows = [(i, "hello there my friend " * 3 if i % 2 else "bonjour mon ami voici " * 3, "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (102, "12 !? 3", "s"), (None, "bonjour mon ami", "s")]
    docs = documents(spark, rows)
    model = language_id.learn(docs, F.col("doc_id").isNotNull())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model, ["doc_id"]).collect()}
    assert len(got) == 64 and all(got[i] == ("und", 0.0) for i in (100, 101, 102))
    assert got[None][0] == "fr" and got[1][0] == "en"
    assert language_id.select_known(docs, model).count() == 61
    assert language_id.learn(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None, ["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("small", [0, 128])
def test_search_is_exact(spark, monkeypatch, small):
    monkeypatch.setattr(search, "SMALL", small)
    monkeypatch.setattr(search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "FAN", 2)
    monkeypatch.setattr(search, "QUERIES", 3)
    rows = [(i, " ".join(WORDS[(i * k + k * k) % 29] + str((i + k) % 7) for k in range(5 + i % 60))) for i in range(300)] + [(400, None), (401, ""), (None, "the0"), (402, rows_text := "the0 of1 of1"), (403, rows_text)]
    docs, work = spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark)
    index = search.build(docs.repartition(3), work)
    n = index.agg(F.sum("n_docs")).first()[0]
    asked = docs.where("doc_id % 50 = 0 or doc_id = 402").selectExpr("doc_id query_id", "text")
    got = sorted(tuple(r) for r in search.top_k(index, search.like(asked, search.document_frequencies(index), n), 7, work).collect())
    texts = {i: Counter((t or "").split()) for i, t in rows if i is not None}
    df = Counter(w for c in texts.values() for w in c)
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    import xxhash

    want = []
    for q in sorted(i for i in texts if i % 50 == 0 or i == 402):
        idf = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in texts[q] if df[w] >= 5}
        terms = sorted(idf, key=lambda w: (-texts[q][w] * idf[w], xxhash.xxh3_64_intdigest(w.encode()) >> 1))[:25]
        found = []
        for i, c in texts.items():
            if any(w in c for w in terms):
                size = sum(c.values())
                found.append((-sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in terms if w in c), i))
        want += [(q, r + 1, -s) for r, (s, _) in enumerate(sorted(found)[:7])]
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])
    assert {(q, d) for q, r, d, _ in got if r == 1 and q in (50, 402)} == {(50, 50), (402, 402)}
    assert search.top_k(search.build(docs.limit(0), work), search.like(asked, search.document_frequencies(index), n), 7, work).count() == 0


@pytest.mark.parametrize(("small", "lists", "postings"), [(128, 48, 2_000_000), (0, 2, 100), (0, 1000, 100)])
def test_search_asks_with_whole_texts(spark, monkeypatch, tmp_path, small, lists, postings):
    for name, value in (("SMALL", small), ("LISTS", lists), ("POSTINGS", postings), ("SHARD_BYTES", 4000), ("QUERIES", 2)):
        monkeypatch.setattr(search, name, value)
    rows = [(i, " ".join(WORDS[(i * k + k * k) % 29] + str((i + k) % 7) for k in range(5 + i % 60)) + f" pair{i // 2} own{i}") for i in range(201)] + [(400, None), (402, "few"), (500, "pair3 few FEW")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in search.op2_top_k_search(spark, str(tmp_path)).collect())
    texts = {i: Counter((t or "").lower().split()) for i, t in rows}
    df = Counter(w for c in texts.values() for w in c)
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    want = []
    for q in (i for i in texts if i % 50 == 0):
        found = []
        for i, c in texts.items():
            both = texts[q].keys() & c.keys()
            if both:
                norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
                found.append((-math.fsum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in both), i))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:10])]
    assert [r[:3] for r in got] == [r[:3] for r in want] and (500, 2, 402) in [r[:3] for r in got]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


@pytest.mark.parametrize(("cells", "postings", "pass_bytes"), [(16 << 20, 2_000_000, 32 << 20), (200, 50, 1), (0, 2_000_000, 1)])
def test_search_by_products(spark, monkeypatch, tmp_path, cells, postings, pass_bytes):
    """Shards go across batches, copies fill the k best, queries come in passes, a task gives back a block of queries once."""
    for name, value in (("SMALL", 0), ("LISTS", 1), ("SHARD_BYTES", 9000), ("LEAST_COMMON", 2), ("TILE", 3), ("QUERIES", 4), ("CELLS", cells), ("POSTINGS", postings), ("PASS_BYTES", pass_bytes)):
        monkeypatch.setattr(search, name, value, raising=False)
    monkeypatch.setattr(search, "ship", lambda session: None)
    rows = [(i, " ".join(WORDS[(i * k + k * k) % 29] + str((i + k) % 7) for k in range(5 + i % 60)) + f" own{i}") for i in range(201)]
    rows += [(300 + i, rows[150][1]) for i in range(40)] + [(500, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    key, plan = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, stored = spark.conf.get(key), Workspace.stored
    monkeypatch.setattr(Workspace, "stored", lambda work, df, name, *codec: plan.append((name, out := stored(work, df, name, *codec))) or out)
    spark.conf.set(key, 7)
    try:
        got = sorted(tuple(r) for r in search.op2_top_k_search(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set(key, before)
    texts = {i: Counter((t or "").lower().split()) for i, t in rows}
    df = Counter(w for c in texts.values() for w in c)
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    want = []
    for q in (i for i in texts if i % 50 == 0):
        found = []
        for i, c in texts.items():
            if both := texts[q].keys() & c.keys():
                norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
                found.append((-round(math.fsum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in both), 9), i))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:10])]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[2] for r in got if r[0] == 150] == [150, *range(300, 309)] == [r[2] for r in got if r[0] == 300]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])
    index = dict(plan)["index"]
    assert index.count() <= 3 * -(-sum(len(t or "") for _, t in rows) // 9000)  # not one for each batch
    results = [df for name, df in plan if name == "results"]
    assert len(results) == (1 if pass_bytes > 1 else 2) and sum(df.count() for df in results) == 2


def test_search_takes_bounds_from_the_first_shards(spark, monkeypatch, tmp_path):
    for name, value in (("SMALL", 0), ("LISTS", 1), ("SHARD_BYTES", 2000), ("LEAST_COMMON", 2), ("QUERIES", 4), ("POSTINGS", 50), ("FIRST", 3), ("TIMES", 1)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(search, "ship", lambda session: None)
    rows = [(i, " ".join(WORDS[(i * k + k * k) % 29] + str((i + k) % 7) for k in range(5 + i % 60)) + f" own{i}") for i in range(201)]
    rows += [(300 + i, rows[150][1]) for i in range(40)] + [(500, None), (550, "nobody else")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept, stored = {}, Workspace.stored
    monkeypatch.setattr(Workspace, "stored", lambda work, df, name, *codec: kept.setdefault(name, stored(work, df, name, *codec)))
    got = sorted(tuple(r) for r in search.op2_top_k_search(spark, str(tmp_path)).collect())
    texts = {i: Counter((t or "").lower().split()) for i, t in rows}
    df = Counter(w for c in texts.values() for w in c)
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    want = []
    for q in (i for i in texts if i % 50 == 0):
        found = []
        for i, c in texts.items():
            if both := texts[q].keys() & c.keys():
                norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
                found.append((-round(math.fsum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in both), 9), i))
        want += [(q, r + 1, i) for r, (s, i) in enumerate(sorted(found)[:10])]
    assert [r[:3] for r in got] == want
    assert 0 < kept["first"].count() and kept["index"].count() >= 3
    first = np.concatenate([np.frombuffer(r["results"], dtype=search.ROW) for r in kept["first"].collect()])
    full = [q for q in np.unique(first["query"]) if (first["query"] == q).sum() == 10]
    best = search.Best(np.unique(first["query"]), 10, first[np.argsort(first["query"], kind="stable")].tobytes())
    assert full and {q: s for q, s in zip(best.numbers, best.floor(np.arange(len(best.numbers))), strict=True) if s} == {q: first["score"][first["query"] == q].min() for q in full}


def test_pairs_of_lists_are_apart_and_of_like_size():
    rows = [(1, 10, 100, 5), (1, 11, 81, 6), (1, 12, 79, 7), (1, 13, 100, 5), (2, 10, 100, 5), (2, 11, 81, 6), (3, 12, 79, 7), (3, 14, 70, 7)]
    part = pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("key", "set", "n", "comp"), zip(*rows), strict=True)})
    assert jaccard._pairs(part, 80).to_pylist() == [{"a": 10, "b": 11}, {"a": 11, "b": 12}, {"a": 11, "b": 13}]
    assert len(jaccard._pairs(part, 79)) == 5 and len(jaccard._pairs(part.slice(0, 0), 80)) == 0


def test_sketches_come_with_lists_and_not_with_pairs(spark, monkeypatch):
    sets = random_sets(np.random.default_rng(7), 60)
    size = np.array([len(s) for s in sets])
    packed = jaccard.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    a, b = np.triu_indices(60, 1)
    may = jaccard.may_link([packed[i] for i in a], [packed[j] for j in b], size[a], size[b], 80)
    may &= 100 * np.minimum(size[a], size[b]) >= 80 * np.maximum(size[a], size[b])
    rows = [(1, i, size[i], i, packed[i]) for i in range(60)] + [(2, i, size[i], i, None) for i in (3, 4)]
    part = pa.table({name: pa.array(x, pa.binary() if name == "sketch" else pa.int64()) for name, x in zip(("key", "set", "n", "comp", "sketch"), zip(*rows), strict=True)})
    got = jaccard._sifted(80)(part).to_pylist()
    assert 0 < may.sum() < len(may) and [(x["a"], x["b"], x["n"]) for x in got if x["n"] is not None] == [(i, j, size[j]) for i, j in zip(a[may].tolist(), b[may].tolist(), strict=True)]
    assert jaccard._sifted(80)(part.slice(0, 0)).schema.names == ["a", "b", "n"] and len(jaccard._sifted(80)(part.slice(60))) <= 1
    monkeypatch.setattr(jaccard, "SHORT", 1)
    made = []  # in the join, 40 sets of one list with a line in common meet within it: no pair of theirs takes a sketch along
    monkeypatch.setattr(jaccard, "possible", lambda pairs, *rest, f=jaccard.possible: made.append(pairs.count()) or f(pairs, *rest))
    docs = [(i, " ".join([f"w{i}x{k}" for k in range(30)] + [f"common{k}" for k in range(18)]), "a") for i in range(40)]
    assert jaccard.join(documents(spark, docs), 4, 85).select("component_id").distinct().count() == 40
    assert len(made) == 2 and made[1] == 0


@pytest.mark.parametrize(("light", "sets", "block"), [(64, 512, 2_000_000), (2, 512, 2_000_000), (2, 7, 2_000_000), (64, 512, 700)])
def test_links_are_all_counted(spark, monkeypatch, light, sets, block):
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", block)
    base = [WORDS[(i * i + 3 * i) % len(WORDS)] + str(i) for i in range(90)]
    rows = near_copies() + [(1000 + i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]]), "a") for i in range(0, 80, 2)]  # a group of edited copies
    rows += [(2000 + i, f"pair {i // 2} " + " ".join(base[i // 2 : i // 2 + 30]) + " x" * (i % 2), "a") for i in range(0, 8)]
    kinds = [frozenset(shingles(t, 4)) for _, t, _ in rows]
    want = sorted(((i, len({b for b in kinds if b and a and a != b and 100 * len(a & b) >= 85 * len(a | b)})) for (i, _, _), a in zip(rows, kinds, strict=True)), key=key)
    got = [(r["doc_id"], r["n_links"]) for r in jaccard.join(documents(spark, rows), 4, 85).select("doc_id", "n_links").collect()]
    assert sorted(got, key=key) == want and max(n for _, n in want) >= 39


def plain_places(text):
    """A text's n-grams as strings, runs of non-letters as one space, with the ends of the text outside."""
    clean = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    return {clean[i : i + n] for n in language_id.SPECTRUM for i in range(len(clean) - n + 1)}


def test_kernels_and_ridge_by_plain_computation():
    texts = ["The cat\0sat", "le chat \x00 est la", "", "\0", "el gato, 12 el gato", "the dog sat on the mat", "x" * 5000, "un chat"]
    rows = language_id.presence(texts)
    for i, a in enumerate(map(plain_places, texts)):
        assert len(a) * 0.97 - 1 <= rows[i].sum() <= len(a)
        for j, b in enumerate(map(plain_places, texts)):
            assert abs(rows[i] @ rows[j] - len(a & b)) <= 2  # places are hashed: few meet by chance
    labels = np.array(["en", "fr", "fr", "en", "es", "en", "en", "fr"])
    bits, marks = np.packbits(rows.astype(bool), axis=1), np.array([0, 1, 4, 5])
    model = language_id.fit(bits, labels, marks)
    unit = rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
    k, w = unit @ unit[marks].T, unit[marks] @ unit[marks].T
    value, vector = np.linalg.eigh(w.astype(np.float64))
    phi = np.hstack([k @ vector / np.sqrt(value), np.ones((8, 1))])
    want = np.zeros((8, 3))
    for c, name in enumerate(model[2]):
        y = np.where(labels == name, 1.0, -1.0)
        weigh = np.diag([1 / (labels == x).sum() for x in labels])
        want[:, c] = phi @ np.linalg.solve(phi.T @ weigh @ phi + language_id.RIDGE * np.eye(5), phi.T @ weigh @ y)
    assert np.allclose(language_id.scores(texts, model), want, atol=1e-3)
    assert np.array_equal(language_id.scores([texts[1], texts[0], texts[1]], model)[0], language_id.scores([texts[1]], model)[0])


def test_very_long_texts_are_named(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(docs, F.lit(True))
    for lang in model[2]:
        text = " ".join(r["text"] for r in docs.where(F.col("lang") == lang).collect())
        for size in (20_000, 400_000):
            long = (text * (size // len(text) + 1))[:size] + "\0" * 3
            assert model[2][int(language_id.scores([long], model)[0].argmax())] == lang
            assert language_id.known([long], model).all()


def random_sets(rng, n):
    """Sets of hashes around a few bases, with few or many elements in common."""
    bases, out = [rng.integers(0, 2**63, size, dtype=np.uint64) for size in (3, 12, 40, 41, 150)], []
    for i in range(n):
        base = bases[i % len(bases)]
        own = rng.integers(0, 2**63, int(rng.integers(0, len(base) // 6 + 2)), dtype=np.uint64)
        out.append(np.unique(np.concatenate([rng.permutation(base)[len(own) * int(rng.integers(0, 2)) :], own])))
    return out


@pytest.mark.parametrize("share", [80, 85, 60])
def test_given_up_lists_lose_no_pair(monkeypatch, share):
    sets = random_sets(np.random.default_rng(5), 400)
    flat, ends = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    both = jaccard.in_common(sets)
    want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(0, 400, 7) for j in range(400) if i != j}
    assert all(both[i, j] == n for (i, j), n in want.items())
    size = np.diff(ends)
    linked = np.argwhere(np.triu(100 * both >= share * (size[:, None] + size - both), 1))
    keys, owners = jaccard.signatures(flat, ends, share)
    before, instead, whose = jaccard.refined(flat, ends, share, keys, owners)
    mine, finer = [set() for _ in sets], [{} for _ in sets]
    for k, o in zip(keys.tolist(), owners.tolist(), strict=True):
        mine[o].add(k)
    for b, k, o in zip(before.tolist(), instead.tolist(), whose.tolist(), strict=True):
        finer[o].setdefault(b, set()).add(k)
    subsets = set(before.tolist())
    assert len(linked) > 500
    for given_up in (set(), subsets, {k for k in subsets if k % 2}, {k for k in subsets if k % 3}):
        for i, j in linked.tolist():
            common = mine[i] & mine[j]
            assert any(k not in given_up or finer[i][k] & finer[j][k] for k in common)
    packed = jaccard.sketches(flat, ends)
    a, b = np.triu_indices(400, 1)
    may = jaccard.may_link([packed[i] for i in a], [packed[j] for j in b], size[a], size[b], share)
    assert may[[i * 400 - i * (i + 1) // 2 + j - i - 1 for i, j in linked.tolist()]].all() and may.mean() < 0.9
    alone, one = np.arange(400), np.zeros(400, dtype=np.int64)
    assert jaccard.with_partners(packed, size, share, alone, one)[0][np.unique(linked)].all()
    comp = alone // 3
    apart = [(i, j) for i, j in linked.tolist() if comp[i] != comp[j] and (i - j) % 2]
    partners, pairs = jaccard.with_partners(packed, size, share, comp, alone % 2)
    assert partners[[i for i, _ in apart]].all() and pairs is None
    monkeypatch.setattr(jaccard, "PAIRS", 10**6)
    pairs = jaccard.with_partners(packed, size, share, comp, alone % 2)[1]
    assert set(apart) <= {(min(p), max(p)) for p in pairs.T.tolist()}


def lines(n):
    return [(i, " ".join([f"w{(i * 31 + k * k * 7) % 9973}" for k in range(3 + i % 17)] + [f"common{k}" for k in range(18)]), "a") for i in range(n)]


def edited(n):
    base = [f"{WORDS[k % len(WORDS)]}{k}" for k in range(200)]
    return [(i, " ".join(w if (k * 13 + i * 29) % 33 else f"own{i}x{k}" for k, w in enumerate(base)), "a") for i in range(n)]


@pytest.mark.parametrize("texts", [lines, edited])
def test_candidates_grow_with_the_rows(spark, monkeypatch, texts):
    """Documents with one line in common, and copies with so many edits that they do not link: no rows as pairs of a group."""
    made = []
    monkeypatch.setattr(jaccard, "possible", lambda pairs, *rest, f=jaccard.possible: made.append(pairs.count()) or f(pairs, *rest))
    for n in (400, 800):
        made.append(0)
        docs = documents(spark, texts(n))
        kinds = jaccard.join(docs, 4, 85).select("component_id").distinct().count()
        want = len({c for _, _, c in brute(texts(n), 4, 85)}) if n == 400 else kinds
        assert kinds == want
    small, large = sum(made[1:3]), sum(made[4:6])
    assert large <= 2.6 * small + 1000
