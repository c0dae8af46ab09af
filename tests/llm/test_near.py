"""Near copies, repeated passages and nearest neighbours against brute force."""

import numpy as np
import pytest
from llm_frames import LONG, ODD_TEXTS, PROSE, components, documents, empty_documents, odd_documents, shingles, similar
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.llm import differences, jaccard, neighbours, settling, substring
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.differences import possible_pairs
from ledgerlens.session import BATCH_KEY, Scratch

DATA = "/root/testdata/sf0.01"


def _edited(seed, words, changes):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    for at in rng.choice(words, changes, replace=False):
        base[at] = f"x{seed}"
    return " ".join(base)


def _checked(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.jaccard_components(documents(spark, texts)).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    named = components(sets)
    assert got == {i: (len(sets[i]), named[i]) for i in sets}


def test_join_equals_brute_force_on_the_table(spark, texts):
    rows = entry.queries()["op10_jaccard_join"](spark, DATA).collect()
    sets = {i: shingles(t) for i, t in texts.items()}
    named = components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), named[i]) for i in sets}


def test_join_on_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    _checked(spark, [_edited(i, 40 + 7 * (i % 9), i % 5) for i in range(150)] + ODD_TEXTS)


def _just_apart(groups, members, words, changes):
    """Groups of copies with edits at random places, most pairs of which lie around the threshold."""
    rng = np.random.default_rng(7)
    texts = []
    for group in range(groups):
        for member in range(members):
            base = [f"g{group}w{i}" for i in range(words)]
            for at in rng.choice(words, int(rng.integers(0, changes + 1)), replace=False):
                base[at] = f"x{rng.integers(8)}"
            texts.append(" ".join(base))
    return texts


def test_join_of_groups_around_the_threshold(spark, monkeypatch):
    compared = []

    def counted(*args):
        certain, pairs = possible_pairs(*args)
        compared.append(pairs.count())
        return certain, pairs

    monkeypatch.setattr(jaccard, "possible_pairs", counted)
    texts = _just_apart(1, 220, 150, 6)
    _checked(spark, texts)
    assert len(compared) == 1 and compared[0] < 10 * len(texts)
    monkeypatch.setattr(differences, "MIDDLE_FROM", 10 ** 6)
    monkeypatch.setattr(differences, "BROADCAST_GROUPS", 0)
    _checked(spark, _just_apart(6, 25, 60, 3) + _just_apart(3, 12, 30, 2) + ODD_TEXTS)


def test_possible_pairs_leave_out_no_similar_pair(spark):
    rng = np.random.default_rng(9)
    sets = {}
    for node in range(120):
        core = set(range(1000 * (node % 3), 1000 * (node % 3) + 40))
        sets[node] = {int(e) for e in core if rng.random() > 0.1 * (node % 4)} | {
            int(e) for e in rng.integers(5000, 5060, node % 7)}
    rows = [(i, sorted(s)) for i, s in sets.items()] + [(200, []), (201, [1]), (201, [1])]
    table = spark.createDataFrame(rows, "node long, elements array<long>")
    members = spark.createDataFrame([(7, i, i) for i, _ in rows], "key long, node long, component long").distinct()
    for middle_from in (2, 10 ** 6):
        with Scratch(spark) as scratch, pytest.MonkeyPatch.context() as patch:
            patch.setattr(differences, "MIDDLE_FROM", middle_from)
            certain, pairs = possible_pairs(scratch, table, members, ["key"], 80)
            linked = {(r.a, r.b) for r in certain.collect()}
            proposed = {(r.a, r.b) for r in pairs.collect()} | linked
        similar_pairs = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
        assert len(similar_pairs) > 50 and linked <= similar_pairs
        named = {i: i for i in sets}
        for _ in sets:
            for a, b in linked:
                named[a] = named[b] = min(named[a], named[b])
        assert all(named[a] == named[b] or (a, b) in proposed for a, b in similar_pairs)


def test_join_on_short_texts(spark):
    rng = np.random.default_rng(1)
    _checked(spark, [" ".join(rng.choice(list("ab"), rng.integers(0, 14))) for _ in range(250)])


def test_similar_sets_share_as_many_signatures_as_bound():
    rng = np.random.default_rng(2)
    texts = []
    for seed in range(150):
        size = int(rng.integers(6, 400))
        texts += [_edited(seed, size, int(rng.integers(0, max(2, size // 30)))).encode() for _ in range(2)]
    sets = jaccard.shingle_sets(texts)
    owner, value, bound = jaccard.signatures(sets)
    own = [set(value[owner == i].tolist()) for i in range(len(texts))]
    plain = [shingles(t.decode()) for t in texts]
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            if similar(plain[i], plain[j]) and plain[i] != plain[j]:
                near += 1
                assert len(own[i] & own[j]) >= max(bound[i], bound[j]), (i, j)
    assert near > 30


def test_large_buckets_pass_unfiltered(spark, texts, monkeypatch):
    some = list(texts.values())[:80]
    monkeypatch.setattr(jaccard, "SLICE_CHARS", 3_000)
    packed = [jaccard._signature_rows(2)(iter([jaccard.pa.RecordBatch.from_arrays(
        [jaccard.pa.array(range(80)), jaccard.pa.array([t.encode() for t in some])], ["doc_id", "text"])]))]
    batches = sorted((b for g in packed for b in g), key=lambda b: b.column(0)[0].as_py())
    rows = jaccard.pa.Table.from_batches(batches).sort_by("bucket").to_batches()
    few = sum(b.num_rows for b in jaccard._colliding(iter(rows)))
    monkeypatch.setattr(jaccard, "BUCKET_BOUND", 10)
    every = sum(b.num_rows for b in jaccard._colliding(iter(rows)))
    assert few < every <= sum(len(b.column(1)[i]) for b in rows for i in range(b.num_rows))


def test_join_odd_rows(spark):
    docs = odd_documents(spark)
    rows = jaccard.jaccard_components(docs).collect()
    assert len(rows) == docs.count()
    named = {r.doc_id: r.component_id for r in rows}
    assert named[None] is None and named[8] == 7 and named[0] == 0 and named[1] == 1
    assert named[10] == 7 and named[6] == 6
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and 8 not in ids and 6 in ids
    assert jaccard.jaccard_components(empty_documents(spark)).count() == 0
    assert jaccard.one_of_each_group(empty_documents(spark)).count() == 0


def test_join_of_an_id_with_a_copy_and_another_text(spark):
    near = [" ".join(f"y{i}" for i in range(n)) for n in (60, 62)]
    rows = [(1, PROSE), (5, PROSE), (5, near[0]), (9, near[1]), (12, "alone " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (12, 12)}


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 100), (7, 7)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in connected_components(edges, scratch).collect()}
        name = scratch.name
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert name not in [d.name for d in spark.catalog.listDatabases()]


def _paragraph_components(texts):
    sets = {}
    for key, text in texts.items():
        start = 0
        for line, part in enumerate((text or "").split("\n")):
            if len(part.encode().split()) >= substring.MIN_WORDS:
                sets[key, line] = shingles(part)
            start += len(part) + 1
    return components(sets)


def test_repeats_equal_brute_force(spark, texts):
    rows = entry.queries()["op6_repeated_paragraphs"](spark, DATA).collect()
    named = _paragraph_components(texts)
    sizes = {}
    for first in named.values():
        sizes[first] = sizes.get(first, 0) + 1
    want = {k: (*v, sizes[v], k != v) for k, v in named.items() if sizes[v] > 1}
    got = {(r.doc_id, r.line): (r.cluster_doc_id, r.cluster_line, r.cluster_size, r.removed) for r in rows}
    # Banding proposes a pair at the threshold with a chance of 0.998.
    assert len(set(want.items()) ^ set(got.items())) <= 0.01 * len(want)
    for r in rows:
        assert texts[r.doc_id][r.start:r.end] == texts[r.doc_id].split("\n")[r.line]


def test_bands_reach_the_recall():
    bands, rows = substring.tuned_bands()
    assert bands * rows <= substring.MOST_HASHES and 1 - (1 - 0.8 ** rows) ** bands >= substring.RECALL


def test_repeats_odd_rows(spark):
    docs = odd_documents(spark)
    rows = substring.repeated_paragraphs(docs).collect()
    assert {(r.doc_id, r.line) for r in rows if not r.removed} == {(7, 0)}
    assert {r.doc_id for r in rows} == {7, 8, 9, 10, 11}
    kept = substring.without_repeats(docs)
    assert set(kept.columns) == set(docs.columns) and kept.count() == docs.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[7] == PROSE and texts[8] == "" and texts[6] == LONG and texts[0] is None
    assert substring.repeated_paragraphs(empty_documents(spark)).count() == 0


def _nearest(ids, vectors, query, k=10):
    at = np.sqrt(((vectors - vectors[list(ids).index(query)]) ** 2).sum(axis=1))
    return [(i, d) for d, i in sorted((d, i) for d, i in zip(at.tolist(), ids) if i != query)][:k]


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = [r.vec_id for r in table]
    vectors = np.array([r.embedding for r in table], np.float64)
    found = {}
    for r in sorted(entry.queries()["op9_hash_prefix_forest"](spark, DATA).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == sorted(i for i in ids if i % 100 == 0)
    hits = total = 0
    for query, got in found.items():
        want = dict(_nearest(ids, vectors, query))
        hits, total = hits + len(want.keys() & dict(got).keys()), total + len(want)
        assert all(want.get(i, d) == pytest.approx(d, abs=1e-12) for i, d in got)
        assert [d for _, d in got] == sorted(d for _, d in got)
    assert hits >= 0.9 * total


def test_neighbours_odd_rows(spark, monkeypatch):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, None, 1), (300, [1.0, nan], 1), (400, [1.0, None], 1),
            (500, [inf, 1.0], 1), (600, [1.0], 1), (None, [1.0, 1.0], 1), (700, [], 1)]
    rows += [(i, [1.0, 0.0], 1) for i in range(1, 30)] + [(i, [0.0, float(i)], 1) for i in range(30, 40)]
    rows += [(5, [1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(table).orderBy("rank").collect()]
    assert got == [(0, i, i, 0.0) for i in range(1, 11)]
    few = neighbours.nearest(table.where("vec_id in (0, 3, 31, 35)")).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [3, 31, 35]
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 3)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 1)
    again = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(table).orderBy("rank").collect()]
    assert again == got
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_components_go_on_with_open_edges_only(spark, monkeypatch):
    """A group in which each of 40 nodes is linked with many of the others, and a path."""
    sizes, keep = [], Scratch.keep

    def counted(scratch, df, name):
        kept = keep(scratch, df, name)
        if name == "edges":
            sizes.append(kept.count())
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    edges = spark.createDataFrame(
        [(a, b) for a in range(40) for b in range(a) if (a + b) % 3] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)],
        "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in connected_components(edges, scratch).collect()}
    assert got == {i: 0 for i in range(40)} | {i: 100 for i in range(100, 141)}
    assert sizes[-1] == 0 and all(later < earlier for earlier, later in zip(sizes, sizes[1:])) and sum(sizes) < 2 * sizes[0]


def test_signatures_of_many_slices_share_rows(monkeypatch):
    """Ids in no order and far apart come back as they were, in one row for each bucket."""
    ids = [2 ** 62, -2 ** 62, 5, 2 ** 62, 7]
    texts = [" ".join(f"w{i // 2}_{j}" for j in range(60)).encode() for i in range(5)]
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(ids), jaccard.pa.array(texts)], ["doc_id", "text"])
    near = batch.set_column(0, "doc_id", jaccard.pa.array([1, 2, 3, 4, 5]))
    monkeypatch.setattr(jaccard, "SLICE_CHARS", 1)
    for some in (batch, near):
        packed, = jaccard._signature_rows(2)(iter([some, some.slice(0, 0)]))
        assert packed.num_rows == 4
        met = [b.to_pydict() for b in jaccard._colliding(iter([packed]))]
        nodes = some.column(0).to_pylist()
        assert sorted({n for b in met for n in b["node"]}) == sorted({n for n in nodes[:4]})
        sets = jaccard.shingle_sets(texts)
        at, value, _ = jaccard.signatures(sets)
        of = {}
        for i, v in zip(at.tolist(), value.tolist()):
            of.setdefault(v, []).append(nodes[i])
        shared = sorted(n for v in of.values() if len(v) > 1 for n in v)
        assert sorted(n for b in met for n in b["node"]) == shared


def test_open_members_need_as_many_keys_as_their_bound(spark):
    members = spark.createDataFrame([(k, n) for n, keys in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1,))) for k in keys], "key long, node long")
    bags = spark.createDataFrame([(1, [1, 2, 3], 3), (2, [1, 2, 3, 4], 4), (3, [1], 1)], "node long, keys array<long>, bound int")
    assert {r.node for r in jaccard._bounded(members, bags).collect()} == {1, 3}


def test_pairs_of_far_sizes_are_left_out_first(spark):
    profiles = spark.createDataFrame([(1, 100), (2, 80), (3, 79), (4, 10), (4, 100), (5, 0), (None, 100)], "doc_id long, n_shingles long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (3, 4), (1, 5)], "a long, b long")
    with Scratch(spark) as scratch:
        assert sorted(map(tuple, jaccard._near_sizes(scratch, pairs, profiles).collect())) == [(1, 2), (1, 4)]


def test_first_pairs_are_met_once_and_only_between_components(spark):
    rows = [(k, n) for k, nodes in ((10, (1, 2, 3)), (11, (1, 2, 3)), (12, (3, 4)), (13, (5,))) for n in nodes]
    fame = {1: 3, 2: 2, 3: 3, 4: 1, 5: 1}
    members = spark.createDataFrame([(k, n, fame[n]) for k, n in rows], "key long, node long, fame long")
    labels = spark.createDataFrame([(2, 1), (1, 1)], "node long, component long")
    with Scratch(spark) as scratch:
        placed = settling.placed_members(scratch, members, ["key"])
        assert {(r.key, r.n, r.hub) for r in placed.collect()} == {(10, 3, 1), (11, 3, 1), (12, 2, 3)}
        assert sorted(map(tuple, settling._first_pairs(placed, labels).collect())) == [(1, 3), (3, 4)]
        left = settling._unsettled(scratch, placed.drop("hub"), ["key"], labels, 2)
        assert {r.key for r in left.collect()} == {10, 11}


def test_join_sends_small_batches_and_puts_the_setting_back(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "_linked_components", lambda scratch, texts, profiles: (
        seen.append(spark.conf.get(BATCH_KEY)), profiles.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")))[1])
    before = spark.conf.get(BATCH_KEY)
    jaccard.jaccard_components(documents(spark, ["a b c"]))
    assert int(seen[0]) == jaccard.BATCH_ROWS and spark.conf.get(BATCH_KEY) == before


def test_signatures_of_far_ids_take_few_bytes(monkeypatch):
    """A step between ids takes a byte however many buckets there are, and far steps come back."""
    ids = [1, 100, 2 ** 62, 2 ** 62 + 127, 2 ** 62 + 255, -2 ** 62, -2 ** 62 - 1, 130]
    texts = [" ".join(f"w{j}" for j in range(60)).encode() for _ in ids]
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(ids), jaccard.pa.array(texts)], ["doc_id", "text"])
    packed, = jaccard._signature_rows(3)(iter([batch]))
    steps, far = packed.column("steps"), packed.column("far_steps")
    assert steps.type == jaccard.pa.list_(jaccard.pa.int8())
    assert all(len(f) == s.as_py().count(jaccard.FAR_STEP) for s, f in zip(steps, far.to_pylist()))
    assert {n for b in jaccard._colliding(iter([packed])) for n in b["node"].to_pylist()} == set(ids)


def test_nodes_meet_the_first_node_of_most_of_their_keys_first(spark):
    """Node 9 shares three keys with 1 and one with 2, and is linked with 1, as is 2: 2 and 9 are never compared."""
    rows = [(k, n) for k, nodes in ((10, (1, 2, 9)), (11, (1, 9)), (12, (1, 9)), (13, (2, 9))) for n in nodes]
    fame = {1: 30, 2: 20, 9: 10}
    members = spark.createDataFrame([(k, n, fame[n]) for k, n in rows], "key long, node long, fame long")
    none = spark.createDataFrame([], "a long, b long")
    asked = []

    def verify(pairs):
        asked.append(sorted(map(tuple, pairs.collect())))
        return pairs

    with Scratch(spark) as scratch:
        placed = settling.placed_members(scratch, members, ["key"])
        labels = settling.settle(scratch, placed, ["key"], none, verify)
        assert {r.node: r.component for r in labels.collect()} == {1: 1, 2: 1, 9: 1}
    assert asked[0] == [(1, 2), (1, 9)] and (2, 9) not in [p for pairs in asked for p in pairs]
