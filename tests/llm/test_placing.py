"""Shards, manifests and periodic runs: odd input, hot keys and plain-Python counterparts."""

import hashlib
import itertools
import random
from fractions import Fraction
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from llm_frames import LONG, PROSE, SCHEMA, documents, empty_documents, odd_documents

from ledgerlens.llm import merkle, periodic, registry, sharding

DATA = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """Root and the siblings of every node on the way to it."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, at in zip(paths, places):
            run = nodes[at // 3 * 3:at // 3 * 3 + 3]
            path.append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
        places = [at // 3 for at in places]
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, siblings) of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for source in order:
        members = sorted(groups[source])
        root, paths = plain_tree([leaf for *_, leaf in members])
        done[source] = root, [(i if there else None, leaf, path) for (there, i, leaf), path in zip(members, paths)]
    root, upper = plain_tree([done[s][0] for s in order])
    return sorted(((str(i), leaf, done[s][0], root, "".join(a + b for a, b in path + up))
                   for s, up in zip(order, upper) for i, leaf, path in done[s][1]))


def got_manifest(manifest):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, "".join(x.before + x.after for x in r.proof))
                  for r in manifest.collect())


def fields(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_manifest_of_odd_documents(spark):
    docs = odd_documents(spark)
    assert got_manifest(merkle.merkle_manifest(docs)) == plain_manifest(fields(docs))


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (4, 1), (243, 244, 1), (730, 9, 3, 1, 1, 2, 1)])
def test_manifest_of_every_shape(spark, sizes):
    rows = [(i * 7 % 100_003, f"t{i}", "en", f"s{s}" if s else None, i)
            for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))]
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest = merkle.merkle_manifest(docs)
    assert got_manifest(manifest) == plain_manifest(fields(docs))
    assert manifest.where(merkle.folded_root(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_manifest_of_nothing(spark):
    assert merkle.merkle_manifest(empty_documents(spark)).count() == 0


def test_verify(spark):
    docs = documents(spark)
    manifest = merkle.merkle_manifest(docs)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))
    more = changed.union(spark.createDataFrame([(1000, "x", "en", "s", 1)], SCHEMA))
    got = {r.doc_id: r.verified for r in merkle.verify(more, manifest).collect()}
    assert got.pop(1000) is None and not got.pop(7) and all(got.values())


def test_merkle_query_finds_tampering(spark, docs):
    rows = registry.op11_merkle_manifest(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        changed = crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (texts[r.doc_id] or "")
        assert r.verified != changed


def plain_shards(rows, shards=8):
    """(id, shard, slot) of (id, size) rows."""
    total, before, used, got = sum(n for _, n in rows), 0, {}, []
    for key, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        shard = min((2 * before + n) * shards // (2 * total), shards - 1)
        got.append((str(key), shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + 1
        before += n
    return sorted(got)


def test_shards_of_odd_documents(spark):
    docs = odd_documents(spark).withColumns({"shard": F.lit("old"), "row": F.lit(1), "a.b": F.lit(2)})
    sharded = sharding.shard_by_bytes(docs)
    assert set(sharded.columns) == {*docs.columns, "slot"}
    rows = sharded.collect()
    want = plain_shards([(r.doc_id, len((r.text or "").encode()) + 1) for r in rows])
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in rows) == want


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_under_one_hot_key(spark, shards):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 5).otherwise(F.col("id")).alias("doc_id"),
                                    F.lit("é").alias("text"))
    per = {r.shard: (r.n, r.least, r.most) for r in sharding.shard_by_bytes(rows, shards).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("least"), F.max("slot").alias("most")).collect()}
    assert per == {s: (9000 // shards, 0, 9000 // shards - 1) for s in range(shards)}


def test_one_long_text_leaves_shards_empty(spark):
    rows = sharding.shard_by_bytes(documents(spark, ["a", LONG, "b"]), 4).collect()
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in rows) == [("0", 0, 0), ("1", 2, 0), ("2", 3, 0)]
    assert sharding.shard_by_bytes(empty_documents(spark)).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharded = sharding.shard_by_bytes(docs)
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert stored.count() == docs.count()
    first = stored.where("shard = 3").toPandas()
    assert first.slot.tolist() == list(range(len(first))) and first.doc_id.is_monotonic_increasing
    total = sharded.agg(F.sum(sharding.text_bytes())).first()[0]
    largest = docs.agg(F.max(sharding.text_bytes())).first()[0]
    for r in sharded.groupBy("shard").agg(F.sum(sharding.text_bytes()).alias("n")).collect():
        assert abs(r.n - total / 8) <= largest


def test_sharding_has_no_python(spark, docs):
    plan = registry.op12_byte_shards(spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_runs(words):
    """All runs by trying every period at every word."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end + q - i >= max(6, 4 * q):
                found.setdefault((i, end + q - i), q)
            i = end + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def texts_with_runs(seed):
    """Random words, powers, powers of powers, and Fibonacci and Thue-Morse words."""
    rng = random.Random(seed)
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    yield [str(bin(i).count("1") % 2) for i in range(256)]
    for _ in range(200):
        words = []
        while len(words) < rng.choice([5, 30, 120, 400]):
            piece = [rng.choice("abc" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 9, 17]))]
            if rng.random() < 0.3:
                piece = (piece * rng.randint(2, 6) + [rng.choice("xy")]) * rng.randint(1, 5)
            words += (piece * rng.randint(1, 9))[:rng.randint(1, 200)]
            if rng.random() < 0.5:
                words += [rng.choice("abcxyz") for _ in range(rng.randint(0, 5))]
        yield words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_those_of_every_period(seed):
    texts = [*texts_with_runs(seed), [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 1000, ["a", "b"] * 500]
    encoded = [[w.encode() for w in words] for words in texts]
    for words, runs in zip(texts, periodic.runs_of(encoded)):
        assert runs == plain_runs(words)


def test_runs_of_one_text_alone():
    for words in itertools.islice(texts_with_runs(99), 60):
        assert periodic.runs_of([[w.encode() for w in words]]) == [plain_runs(words)]
    assert periodic.runs_of([]) == [] and periodic.runs_of([[]]) == [[]]


def altered(doc_id, words):
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def wanted(doc_id, text):
    words = altered(doc_id, (text or "").encode().split()) if doc_id is not None else (text or "").encode().split()
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()))


def test_runs_query(spark, docs):
    rows = {r.doc_id: tuple(r) for r in registry.op13_periodic_runs(spark, DATA).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    short = [i for i in texts if len((texts[i] or "").split()) <= 1500]
    assert len(short) > 900
    for i in short:
        assert rows[i] == wanted(i, texts[i])
    assert sum(r[1] > 0 for r in rows.values()) > 60


def test_runs_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = periodic.periodic_runs(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted(
        (str(t.doc_id), len((t.text or "").encode().split())) for t in texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].runs == [] and by_id[0].collapsed == ""
    ones = next(t.doc_id for t in texts if t.text == "1 " * 3_000)
    assert [tuple(x) for x in by_id[ones].runs] == [(0, 3000, 1)] and by_id[ones].collapsed == "1"
    assert by_id[8].runs == [] and by_id[8].collapsed == PROSE + " again"
    assert periodic.periodic_runs(empty_documents(spark)).count() == 0
    assert registry.repeated_tails(docs).count() == docs.count()


def test_strongest_run(spark):
    runs = [[(0, 13, 3), (20, 9, 2), (40, 18, 4)], [(5, 8, 2), (9, 4, 1)], []]
    df = spark.createDataFrame([([dict(zip(("start", "length", "period"), r)) for r in x],) for x in runs],
                               f"runs array<{periodic.RUN}>")
    got = df.select(periodic.strongest_run(F.col("runs")).alias("best")).collect()
    assert [r.best and tuple(r.best) for r in got] == [(20, 9, 2), (5, 8, 2), None]
