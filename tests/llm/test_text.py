"""Personal data, toxicity, languages and pieces: odd input, brute force, held-out accuracy."""

import hashlib
import itertools
import random
import re

import pytest
import sentencepiece
from llm_frames import ODD_TEXTS, PROSE, documents, empty_documents, odd_documents

import __spark_entry__ as entry
from ledgerlens.llm import langid, pieces, pii, toxicity

DATA = "/root/testdata/sf0.01"


def _plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_patterns_equal_plain_expressions():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab1209.@+- ()_%-\n") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    for text in [*made, *[t or "" for t in ODD_TEXTS], "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0" * 50 + ".1.1.1"]:
        assert pii.pattern_spans(text) == _plain_spans(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "@" * 50_000, "+1" + "(" * 200_000,
                                  "1." * 100_000, "a@" * 50_000])
def test_patterns_stay_linear(text):
    assert isinstance(pii.pattern_spans(text), list)


def test_pii_query(spark, texts):
    rows = entry.queries()["op3_pii_skip_chain"](spark, DATA).collect()
    assert len(rows) == len(texts)
    added = 0
    for r in rows:
        base = _plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in pii.BASE_KINDS]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == pii.ordered(spans)
        assert r.n_secret == sum(k == "secret" for k, _, _ in spans) and r.n_added == len(spans) - len(base)
        added += len(spans) - len(base)
    secrets = sum(len(pii.secret_spans(t)) for t in texts.values())
    assert secrets * 0.8 <= added <= secrets * 1.3


def test_repeated_tokens_agree():
    """Skip edges carry a label from where the context is clear to where it is not."""
    word = {"f=a": pii.np.array([0, 0, 0, 0, 0, 3.0]), "f=b": pii.np.array([0.5, 0, 0, 0, 0, 0])}
    model = pii.FieldModel(word, pii.np.zeros((6, 6)))
    clear = pii.Segment([(0, 9)], ["k9k9k9k9k"], [True], [["f=a"]])
    vague = pii.Segment([(20, 29)], ["k9k9k9k9k"], [True], [["f=b"]])
    other = pii.Segment([(40, 49)], ["z1z1z1z1z"], [True], [["f=b"]])
    best = [b.argmax() for b in map(lambda x: x[0], pii.beliefs_of(model, [clear, vague, other]))]
    assert best == [5, 5, 0]


def _enumerated(model, segments):
    """Log beliefs by summing over all labellings and all labels of the groups' variables."""
    n = len(pii.LABELS)
    places = [(s, i) for s, segment in enumerate(segments) for i in range(len(segment.words))]
    groups = list(pii.groups_of(segments).values())
    unaries = [model.unary(s) for s in segments]
    totals = {at: pii.np.zeros(n) for at in places}
    for labels in itertools.product(range(n), repeat=len(places)):
        of = dict(zip(places, labels))
        score = sum(unaries[s][i][of[s, i]] for s, i in places)
        score += sum(model.pairs[of[s, i], of[s, i + 1]] for s, i in places if (s, i + 1) in of)
        weight = pii.np.exp(score)
        for members in groups:
            weight *= sum(pii.np.exp(model.skip * sum(of[at] == g for at in members)) for g in range(n))
        for at in places:
            totals[at][of[at]] += weight
    return {at: pii.np.log(t / t.sum()) for at, t in totals.items()}


def test_pii_messages_equal_enumeration():
    random = pii.np.random.default_rng(1)
    model = pii.FieldModel({f"f={k}": random.normal(size=6) for k in range(4)}, random.normal(size=(6, 6)), 1.25)
    chain = pii.Segment([(0, 9), (10, 12)], ["k9k9k9k9k", "and"], [True, False], [["f=0"], ["f=1"]])
    second = pii.Segment([(20, 29)], ["K9k9k9k9k,"], [True], [["f=2"]])
    third = pii.Segment([(30, 39)], ["k9k9k9k9k"], [True], [["f=3"]])
    segments = [chain, second, third]
    exact = _enumerated(model, segments)
    for s, beliefs in enumerate(pii.beliefs_of(model, segments)):
        for i, logs in enumerate(beliefs):
            assert pii.np.allclose(logs, exact[s, i], atol=1e-9)


def test_pii_skip_weight():
    vague = pii.np.log(pii.np.full((40, 6), 1 / 6))
    same = pii.np.tile([0, 0, 0, 0, 0, 1.0], (40, 1))
    assert pii.skip_weight(vague, pii.np.full(40, 5), same) == max(pii.SKIP_WEIGHTS)
    assert pii.skip_weight(vague, pii.np.full(40, 1), same) == 0
    assert pii.skip_weight(vague[:0], pii.np.zeros(0, int), same[:0]) == pii.SKIP_WEIGHT


def test_pii_other_spelling(spark):
    model = pii.fit_field(spark.read.parquet(f"{DATA}/documents.parquet"))
    for text, want in [
        ("The password=correcthorsebattery was set, then correcthorsebattery again",
         ["secret:13:32", "secret:47:66"]),
        ("use api_key: hunter2hunter2 for this", ["secret:13:27"]),
        ("x token=abcdefghijk y", ["secret:8:19"]),
        ("call 555-010-2030 now", ["phone:5:17"]),
        ("call me at 555 010 2030 now", ["phone:11:23"]),
        ("In 2019 about 300 people of 2000 came", []),
        ("the token: yes it is a password: please enter", []),
    ]:
        base = pii.pattern_spans(text)
        assert pii.written(pii.ordered(base + pii.added_spans(model, text, base))) == ",".join(want), text


def test_pii_lessons():
    text = 'Call +1 (017) 555-7713 or use token = "04dbebab91ab85687d33" ok'
    (_, plain), (spelled, other) = pii._lessons(text)
    assert {pii.LABELS[k] for row in plain for k in row} == {"other", "phone", "secret"}
    words = {w: pii.LABELS[k] for s, row in zip(spelled, other) for w, k in zip(s.values, row)}
    secrets = [w for w, kind in words.items() if kind == "secret"]
    assert len(secrets) == 1 and not pii.DIGIT.search(secrets[0])
    assert sum(w == secrets[0] for s in spelled for w in s.values) == 2
    long = " ".join(f"{i} a b c d e" for i in range(100))
    (segments, labels), = pii._lessons(long)
    assert len(segments) == len(labels) == pii.SAMPLE_SEGMENTS
    assert max(s.spans[0][0] for s in segments) > len(long) // 2


def test_pii_odd_rows(spark):
    docs = odd_documents(spark)
    found = pii.find_pii(docs, pii.fit_field(docs))
    assert set(docs.columns) <= set(found.columns)
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(r.pii_redacted == r.text for r in rows if not r.pii_spans)
    mail = next(r for r in rows if r.text and r.text.startswith("mail me"))
    assert mail.pii_redacted == "mail <EMAIL> or call <PHONE>, <CARD> at <IP>"
    empty = empty_documents(spark)
    assert pii.find_pii(empty).count() == 0


def test_toxicity_held_out(spark):
    scored = entry.queries()["op4_toxicity_trees"](spark, "/root/testdata/sf0.1").cache()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    clean = [r for r in rows if not r.toxic]
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").isEmpty()


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity_scores(docs, none).collect()
    assert len(rows) == docs.count() and all(r.score == 0 for r in rows)
    assert toxicity.toxicity_scores(empty_documents(spark), none).count() == 0
    bad = documents(spark, ["you are an id10t and st*pid", "fine words"])
    assert [r.score for r in toxicity.toxicity_scores(bad, none).orderBy("doc_id").collect()] == [1.0, 0.0]
    kept = toxicity.clean_documents(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_languages_held_out(spark, docs):
    rows = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_languages_odd_rows(spark, docs):
    known = langid.learn_prototypes(docs)
    odd = odd_documents(spark)
    rows = langid.predict_language(odd, known).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0)
    assert {r.lang_pred for r in langid.predict_language(odd, {}).collect()} == {"und"}
    assert langid.identify_languages(empty_documents(spark)).count() == 0


def test_a_bound_vector_is_rotations_times(spark):
    gram = (ord("a") << 42) | (ord("b") << 21) | ord("c")
    a, b, c = (langid.letter_vector(ord(x)) for x in "abc")
    want = langid.np.roll(a, 2) * langid.np.roll(b, 1) * c
    assert (langid.bound_vectors(langid.np.array([gram]))[0] == want).all()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_pieces_equal_the_library(library, texts):
    rng = random.Random(7)
    made = ["".join(rng.choice("aabcde  .\n1É§thenio\t▁🙂") for _ in range(rng.randint(0, 60))) for _ in range(3_000)]
    work = pieces.Encoder(pieces.DEFAULT_MODEL)
    for group in (made, [t or "" for t in ODD_TEXTS], list(texts.values())[:300]):
        for text, ids in zip(group, work.encode(group)):
            assert ids.tolist() == library.encode(text), text[:80]
            assert work.model.decode(ids.tolist()) == library.decode(ids.tolist())


def test_pieces_do_not_depend_on_what_is_kept(monkeypatch, texts):
    some = list(texts.values())[:60]
    want = [x.tolist() for x in pieces.Encoder(pieces.DEFAULT_MODEL).encode(some)]
    monkeypatch.setattr(pieces, "KEPT_WORDS", 10)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 10)
    work = pieces.Encoder(pieces.DEFAULT_MODEL)
    assert [work.encode([t])[0].tolist() for t in some] == want


def test_unigram_scores_win():
    model = pieces.PieceModel.__new__(pieces.PieceModel)
    names = ["<unk>", "a", "b", "ab", "abc", "c", "bc"]
    model.pieces, model.scores = names, [0.0, -2.0, -2.0, -3.0, -9.0, -2.0, -2.5]
    model.ids = {p: i for i, p in enumerate(names) if i}
    model.lengths, model.merging, model.together = {"abc": (3,)}, False, {}
    model.lowest, model.bytes, model.unknown = -20.0, {}, 0
    found = pieces.encode_words(model, ["abc", "abcx", "ab"])
    ids = {w: pieces.np.frombuffer(x, pieces.np.int32).tolist() for w, x in found.items()}
    assert ids == {"abc": [1, 6], "abcx": [1, 6, 0], "ab": [3]}


def test_pieces_odd_rows(spark):
    docs = odd_documents(spark)
    encoded = pieces.encode_documents(docs)
    rows = encoded.collect()
    assert len(rows) == docs.count()
    assert all(r.round_trip and len(r.ids) == r.n_ids and bool(r.ids) == bool(r.n_ids) for r in rows)
    decoded = pieces.decode_documents(encoded)
    want = sorted(t or "" for (t,) in docs.select("text").collect())
    assert sorted(r.text for r in decoded.collect()) == want
    assert pieces.encode_documents(empty_documents(spark)).count() == 0
    assert PROSE in want
