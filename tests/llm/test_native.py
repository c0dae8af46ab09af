"""Quality rules, mixing and preference turns: odd input, plain-Python counterparts, plans."""

import collections
import hashlib

import pytest
from llm_frames import LONG, PROSE, WORD, documents, empty_documents, odd_documents

from ledgerlens.llm import chat, mixing, quality


def _plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(repeated))


@pytest.fixture(scope="module")
def judged(spark):
    return quality.judge_quality(odd_documents(spark)).collect()


def test_counts_of_odd_texts(spark, judged):
    texts = {r.doc_id: r.text for r in odd_documents(spark).collect()}
    assert len(judged) == len(texts) + 1
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _plain(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_both_ways_to_find_repeats(spark):
    few = " ".join([*(f"a{i}" for i in range(60)), "a1 a2 a3 x y z a1 a2 a3"])
    many = " ".join([*(f"a{i}" for i in range(200))] * 2 + ["b"])
    rows = quality.quality_metrics(documents(spark, [few, many, LONG + " " + LONG])).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [9, 400, 60_000]


def test_each_rule_has_its_side(spark):
    rule = quality.Rule("short", "n_words", high=3)
    rows = quality.judge_quality(documents(spark, ["a b", "a b c d"]), [rule]).orderBy("doc_id").collect()
    assert [r.failed_rules for r in rows] == [[], ["short"]]
    assert [r.failed_rules for r in quality.judge_quality(documents(spark, ["a"]), []).collect()] == [[]]


def test_quality_is_one_scan_without_python(spark):
    plan = quality.judge_quality(documents(spark))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    empty = empty_documents(spark)
    assert quality.judge_quality(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    mixed = mixing.mix_sources(docs, total=400)
    assert set(mixed.columns) == set(docs.columns)
    counts = collections.Counter((r.doc_id, r.source, r.text) for r in mixed.collect())
    rows = collections.Counter((r.doc_id, r.source, r.text) for r in docs.collect())
    assert all(n % rows[k] == 0 for k, n in counts.items())
    assert set(counts) <= set(rows)
    assert {r.source for r in mixed.collect()} == {None, "s0", "s1", "s2"}


def test_mixing_reaches_weights_and_repeats_itself(spark, docs):
    weights = {"src0": 1.0, "src1": 3.0}
    mixed = mixing.mix_sources(docs, weights, total=20_000.0)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == set(weights)
    # Poisson totals: within five standard deviations.
    assert abs(n["src0"] - 5_000) < 360 and abs(n["src1"] - 15_000) < 620
    again = mixing.mix_sources(docs, weights, total=20_000.0)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in again.collect())


def test_mixing_without_broadcast(spark, docs, monkeypatch):
    want = sorted((r.doc_id, r.mix_copy) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.mix_copy) for r in mixing.mix_sources(docs).collect()) == want


def _turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, part string")


def test_preference_turns(spark):
    same = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yes", "x")]
    chosen = _turns(spark, [*same, (1, 2, "user", "more", None), (1, 3, "assistant", "good", None),
                            (2, 0, "user", None, None), (3, 0, "user", "alone", None), (None, 0, "user", "x", None),
                            (4, None, "user", "x", None), (5, 0, None, "a", None), (5, 0, None, "b", None),
                            (6, 0, "user", "p", None), (6, 1, "assistant", PROSE, None)])
    rejected = _turns(spark, [*same, *same, (1, 2, "user", "more", None), (1, 3, "assistant", "bad", None),
                              (2, 0, "user", "", None), (5, 0, None, "a", None), (6, 0, "user", "p", None)])
    got = {(r.pair_id, r.part, r.turn): (r.text, r.text[r.mask_start:r.mask_end])
           for r in chat.preference_turns(chosen, rejected).collect()}
    assert got == {
        (1, "prompt", 0): ("<|user|>\nhi<|end|>\n", ""),
        (1, "prompt", 1): ("<|assistant|>\nyes<|end|>\n", ""),
        (1, "prompt", 2): ("<|user|>\nmore<|end|>\n", ""),
        (1, "chosen", 3): ("<|assistant|>\ngood<|end|>\n", "good<|end|>\n"),
        (1, "rejected", 3): ("<|assistant|>\nbad<|end|>\n", "bad<|end|>\n"),
        (2, "prompt", 0): ("<|user|>\n<|end|>\n", ""),
        (5, "prompt", 0): ("<||>\na<|end|>\n", ""),
        (6, "prompt", 0): ("<|user|>\np<|end|>\n", ""),
        (6, "chosen", 1): (f"<|assistant|>\n{PROSE}<|end|>\n", f"{PROSE}<|end|>\n"),
    }


def _continued(rows):
    """Both sides of every pair, from (conv_id, turn, role, text), as lists of (turn, role, text)."""
    talks = collections.defaultdict(dict)
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or ""), reverse=True):
        talks[conv][turn] = (role or "", text or "")
    forks = {}
    for conv, talk in talks.items():
        marks = [(hashlib.md5(f"{conv}:{t}".encode()).hexdigest(), t)
                 for c, t, role, _ in rows if c == conv and role == "assistant"]
        if marks:
            forks[conv] = min(marks)[1]
    heads = sorted(forks)
    pairs = {}
    for conv, talk in talks.items():
        rejected = dict(talk)
        if conv in forks:
            at = heads.index(conv)
            rejected = {t: x for t, x in talk.items() if t < forks[conv]}
            other = heads[at + 1] if at + 1 < len(heads) else heads[at - 1] if at else None
            for t, x in (talks[other] if other is not None else {}).items():
                if t >= forks[other]:
                    rejected[t - forks[other] + forks[conv]] = x
        if rejected:
            pairs[conv] = (talk, rejected)
    return pairs


def _parts(pairs):
    rows = set()
    for conv, (chosen, rejected) in pairs.items():
        fork = min((t for t in {*chosen, *rejected} if chosen.get(t) != rejected.get(t)), default=None)
        for part, talk in (("chosen", chosen), ("rejected", rejected)):
            for t, (role, text) in talk.items():
                common = fork is None or t < fork
                if not common or part == "chosen":
                    trained = text + "<|end|>\n" if role == "assistant" and not common else ""
                    rows.add((conv, "prompt" if common else part, t, role, text, trained))
    return rows


TALKS = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "bye"), (1, 3, "assistant", "b1"),
         (4, 0, "user", "q"), (4, 1, "assistant", "a2"), (4, 1, "assistant", "a2"), (4, 2, "user", None),
         (9, 0, "assistant", "alone"), (10, 0, "user", "none"), (10, 1, None, None), (12, 0, "user", ""),
         (12, 1, "assistant", PROSE), (12, 2, "user", "x"), (12, 3, "assistant", "y"), (12, 4, "assistant", "z")]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("rows", [TALKS, TALKS[:4], TALKS[8:9], TALKS[9:11], TALKS[4:9], []])
def test_continued_pairs(spark, kind, rows):
    rows = [(f"k{r[0]:02}" if kind == "string" else r[0], *r[1:]) for r in rows]
    odd = [(None, 0, "assistant", "x"), (rows[0][0] if rows else None, None, "assistant", "x")]
    turns = spark.createDataFrame([(*r, 1, "f") for r in rows + odd],
                                  f"conv_id {kind}, turn int, role string, text string, fork int, `a.b` string")
    got = chat.continued_pairs(turns).collect()
    cut = {(r.pair_id, r.part, r.turn, r.role, r.text.split(">\n", 1)[1][:-8], r.text[r.mask_start:r.mask_end])
           for r in got}
    assert len(got) == len(cut) and cut == _parts(_continued(rows))


def test_continued_pairs_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = chat.continued_pairs(table)
    assert got.groupBy("part").count().count() == 3
    assert {(r.pair_id, r.part, r.turn) for r in got.collect()} == {p[:3] for p in _parts(_continued(rows))}
    # The chosen side has every turn of the table: in the prompt or as completion.
    assert got.where("part <> 'rejected'").count() == len({r[:2] for r in rows})
    assert chat.continued_pairs(table)._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
