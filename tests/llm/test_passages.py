"""Repeated passages in the middle of lines and across short lines, against brute force."""

from collections import defaultdict

from llm_frames import ODD_TEXTS, WORD, documents, empty_documents, odd_documents

import __spark_entry__ as entry
from ledgerlens.llm import passages

DATA = "/root/testdata/sf0.01"
N = passages.PASSAGE_WORDS
NEW = "\n".join(f"n{i}" for i in range(60)).replace("\nn5\n", " n5 ")


def _brute(texts):
    """Spans of repeated windows and of those that are removed, and their code points by document."""
    windows, spans = defaultdict(list), {}
    for doc, text in texts.items():
        spans[doc] = [m.span() for m in WORD.finditer(text or "")]
        words = [w.decode() for w in (text or "").encode().lower().split()]
        for i in range(len(words) - N + 1):
            windows[tuple(words[i:i + N])].append((doc, i))
    every, removed = defaultdict(set), defaultdict(set)
    for places in windows.values():
        places.sort()
        of_doc, apart = {}, []
        for doc, i in places:
            if doc not in of_doc or i >= of_doc[doc] + N:
                of_doc.setdefault(doc, i)
                apart.append((doc, i))
        if len(apart) > 1:
            for at, (doc, i) in enumerate(apart):
                covered = range(spans[doc][i][0], spans[doc][i + N - 1][1])
                every[doc].update(covered)
                if at:
                    removed[doc].update(covered)
    return every, removed


def _covered(rows):
    found = defaultdict(set)
    for r in rows:
        found[r.doc_id].update(range(r.start, r.end))
    return found


def _words(text):
    return (text or "").encode().lower().split()


def _check(rows, texts):
    every, removed = _brute(texts)
    assert _covered(rows) == every and _covered([r for r in rows if r.removed]) == removed
    for r in rows:
        part = _words(texts[r.doc_id][r.start:r.end])
        assert len(part) >= N and _words(texts[r.cluster_doc_id][r.cluster_start:])[:len(part)] == part
        assert r.removed == ((r.doc_id, r.start) != (r.cluster_doc_id, r.cluster_start))


def test_passages_equal_brute_force(spark, texts):
    rows = entry.queries()["op6_repeated_passages"](spark, DATA).collect()
    _check([r for r in rows if r.kind == "passage"], texts)
    assert {r.kind for r in rows} == {"passage", "paragraph"}


def test_passages_in_mid_line_and_across_lines(spark):
    flat = NEW.replace("\n", " ")
    plain = [f"{' '.join(f'a{d}x{i}' for i in range(70))} {p} {' '.join(f'b{d}x{i}' for i in range(70))}"
             for d, p in enumerate([flat, NEW, flat.upper(), " ".join(flat.split()[:N]), " ".join(flat.split()[:N - 1])])]
    docs = documents(spark, plain)
    rows = passages.repeated_passages(docs).collect()
    _check(rows, dict(enumerate(plain)))
    assert {r.doc_id for r in rows if r.removed} == {1, 2, 3}
    kept = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert kept[0] == plain[0] and kept[4] == plain[4]
    assert _words(kept[1]) == [w for w in _words(plain[1]) if not w.startswith(b"n")]


def test_passages_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_CHARS", 100)
    _check(passages.repeated_passages(documents(spark)).collect(), dict(enumerate(ODD_TEXTS)))
    docs = odd_documents(spark)
    _check(passages.repeated_passages(docs).collect(), dict(enumerate(ODD_TEXTS)))
    kept = passages.without_passages(docs)
    assert set(kept.columns) == set(docs.columns) and kept.count() == docs.count()
    assert passages.repeated_passages(empty_documents(spark)).count() == 0


def _batch(texts):
    return passages.pa.RecordBatch.from_arrays(
        [passages.pa.array(range(len(texts))), passages.pa.array(texts, passages.pa.string())], ["doc_id", "text"])


def test_words_are_hashed_and_placed_without_a_match_for_each():
    """Words as the pattern finds them; equal ones, in either case, have equal hashes, others do not."""
    texts = ["é Ab aB\x0bab\tba \x1c b\xa0c " + "w" * 40 + " " + "W" * 40 + " " + "w" * 39 + "v", None, "", " ", "ba AB"]
    found = passages.windows_of([t and t.encode() for t in texts])
    data = found.raw.tobytes()
    words = [data[a:b].decode() for a, b in zip(found.start, found.end)]
    assert words == [w for t in texts for w in WORD.findall(t or "")]
    hashes = passages._word_hashes(data, found.raw, found.start, found.end).tolist()
    plain = [w.encode().lower() for w in words]
    assert len(set(zip(plain, hashes))) == len(set(plain)) == len(set(hashes))
    place = found.places()
    spans = [(place[a] - place[found.begin[0]], place[b] - place[found.begin[0]]) for a, b in zip(found.start, found.end)]
    assert spans[:found.first[1]] == [m.span() for m in WORD.finditer(texts[0])]


def test_anchors_stand_once_for_each_stretch():
    """Stretches of windows with one anchor give a row; those with several places of it two, however many."""
    plain, periodic = " ".join(map(str, range(400))), " ".join(map(str, list(range(13)) * 60))
    for text, rows in ((plain, None), (periodic, 2)):
        anchors = [a for b in passages._anchors(iter([_batch([text])])) for a in b["anchor"].to_pylist()]
        found = passages.windows_of([text.encode()])
        assert set(anchors) == set(found.anchor.view("int64").tolist())
        assert len(anchors) == (rows or len(set(anchors)))
