"""Personal data by patterns and by a skip-chain conditional random field.

Patterns find emails, IP addresses, card and phone numbers. A linear-chain CRF over marked
tokens and their neighbours labels what they miss (numbers in other spelling, keys and
passwords). Marked are tokens with a digit or an at-sign, the value after a key word
(``password=``, ``api_key:``) and every other mention of that value in the document. Skip
edges tie marked tokens of a document that repeat or have the same digits: each such group
has one variable that all its members share a potential with, so a group of k tokens needs
k edges, not k * k. Loopy belief propagation alternates between the chains and the groups.
All other tokens are fixed to "other".

The CRF is trained on at most ``SAMPLE_DOCS`` documents (those of the smallest hashed ids,
the ``SAMPLE_SEGMENTS`` segments of the smallest hash of each), labelled by the patterns and
by rules for keys and passwords. A document with a phone number or a secret is learned a
second time in other spelling: numbers without plus, country and brackets, secrets without
digits and with one more mention. The weight of the skip edges is the one of ``SKIP_WEIGHTS``
of the highest pseudo-likelihood in the sample's groups. Spans that the field adds never
touch a span of the patterns.

Defined results: NULL counts as the empty text and has no spans. Whole texts are read,
whatever their length. Repeated rows each give a row; an empty table gives an empty one
and an untrained model, which adds nothing. Other columns stay, whatever their names; only
input columns called like one of ``ADDED`` are replaced.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlens.llm.names import columns
from ledgerlens.session import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LABELS = ("other", *KINDS)
SAMPLE_DOCS = 6_000
SAMPLE_SEGMENTS = 20
CONTEXT = 2
EPOCHS = 6
RATE = 0.2
SHRINK = 1e-4
# Of a model without groups to learn from, and the weights that training chooses from.
SKIP_WEIGHT = 1.5
SKIP_WEIGHTS = tuple(w / 4 for w in range(17))
ROUNDS = 4
SIMILAR_DIGITS = 6
MIN_SECRET = 8
# Log potential of a label that the look of a token rules out.
BARRED = -30.0
ADDED = ("pii_base", "pii_spans", "pii_counts", "pii_redacted")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where no digit is before it, which keeps long digit runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KEY_WORDS = "password|passwd|pwd|secret|token|api[_-]?key"
SECRETS = re.compile(
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
    rf"|(?i:{KEY_WORDS})\s*[=:]\s*[\"']?([^\s\"',;]{{{MIN_SECRET},}})")
KEYED = re.compile(rf"(?i:{KEY_WORDS})[\"']?\s*[=:]\s*[\"']?")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
TOKEN = re.compile(r"\S+")
MARKED = re.compile("[0-9@]")
EDGE = "\"'`()[]{}<>.,;:!?"
MARKS = EDGE + "#$%&*|~^"
QUOTE = re.compile("[\"',;]")
LETTERS = str.maketrans("0123456789", "ghijklmnop")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start; those that fail their check are dropped."""
    spans = list(_emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            # Long parts are above 255 unless they are padded with zeros.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append(("phone", m.start(), m.end()))
    return spans


def secret_spans(text: str) -> list[Span]:
    return [("secret", *m.span(1 if m.group(1) else 0)) for m in SECRETS.finditer(text)]


@dataclass
class Segment:
    """Neighbouring tokens: places in the text, words, feature names, and words without a key before them."""

    spans: list[tuple[int, int]]
    words: list[str]
    marked: list[bool]
    features: list[list[str]] = field(default_factory=list)
    values: list[str] = field(default_factory=list)


def _shape(word: str) -> str:
    kinds = []
    for c in word[:64]:
        kind = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    # Long alternations of letters and digits are keys of one sort.
    return "".join(kinds) if len(kinds) <= 8 else "mixed:" + "".join(sorted(set(kinds)))


def _token_features(words: list[str], values: list[str], why: list[str], i: int) -> list[str]:
    word = values[i]
    digits = sum("0" <= c <= "9" for c in word)
    before = words[i - 1].strip(EDGE).lower() if i else "^"
    after = _shape(words[i + 1].strip(EDGE)) if i + 1 < len(words) else "$"
    found = ["bias", "why=" + why[i], "shape=" + _shape(word), f"length={min(len(word), 40) // 4}",
             f"digits={min(digits, 20) // 2}", f"share={10 * digits // max(len(word), 1)}",
             "start=" + word[:4].lower(), "after=" + after]
    if why[i] == "key":
        before = "key"
    elif not before.isalpha() and len(before) > 1:
        before = _shape(before)
    found.append("before=" + before)
    if "@" not in word:
        found.append("no-at")
    if not IP.search(word):
        found.append("no-ip")
    if any(c.isalpha() for c in word):
        found.append("letters")
    if 13 <= digits <= 19 and digits == len(word):
        found.append("luhn" if _luhn(word) else "no-luhn")
    if words[i][:1] in "\"'" and len(words[i]) > 1:
        found.append("quoted")
    return found


def segments_of(text: str) -> list[Segment]:
    """Marked tokens and their neighbours, in runs."""
    keys = [m.end() for m in KEYED.finditer(text)]
    if not keys and not MARKED.search(text):
        return []
    spans = [m.span() for m in TOKEN.finditer(text)]
    words = [text[a:b] for a, b in spans]
    values = [w.strip(MARKS) for w in words]
    why = ["digit" if MARKED.search(w) else "" for w in words]
    starts, known = [a for a, _ in spans], set()
    for at in keys:
        i = bisect_right(starts, at) - 1
        if at < spans[i][1]:
            value = text[at:spans[i][1]]
            why[i], values[i] = "key", QUOTE.split(value, maxsplit=1)[0].strip(EDGE)
            if len(values[i]) >= MIN_SECRET:
                known.add(values[i])
    if known:
        why = ["mention" if not y and v in known else y for y, v in zip(why, values)]
    found: list[Segment] = []
    end = 0
    reasons: list[list[str]] = []
    for i, hit in enumerate(why):
        if not hit:
            continue
        first, last = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        if not found or first > end:
            found.append(Segment([], [], []))
            reasons.append([])
            end = first
        for j in range(max(first, end), last):
            found[-1].spans.append(spans[j])
            found[-1].words.append(words[j])
            found[-1].marked.append(why[j] != "")
            found[-1].values.append(values[j])
            reasons[-1].append(why[j])
        end = last
    for segment, why_here in zip(found, reasons):
        segment.features = [_token_features(segment.words, segment.values, why_here, i)
                            for i in range(len(segment.words))]
    return found


def label_segment(segment: Segment, spans: list[Span], secrets: frozenset[str] = frozenset()) -> list[int]:
    """Training labels: the kind of a span that covers most of a token's value; mentions of secrets are secrets."""
    labels = []
    for (_, end), value, word in zip(segment.spans, segment.values, segment.words):
        start = end - (len(word) - word.rfind(value))
        end = start + len(value)
        kind = LABELS.index("secret") if value in secrets else 0
        for name, a, b in spans:
            if 2 * (min(end, b) - max(start, a)) > end - start:
                kind = LABELS.index(name)
        labels.append(kind)
    return labels


def respelled(text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """The text with phone numbers and keyed secrets in other spelling, and where its spans are then."""
    parts, done, at = [], 0, 0
    moved: list[Span] = []
    tail = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < done:
            continue
        new = text[start:end]
        if kind == "phone":
            digits = NOT_DIGIT.sub("", new)
            new = " -"[zlib.crc32(digits.encode()) % 2].join((digits[-10:-7], digits[-7:-4], digits[-4:]))
        elif kind == "secret" and not new.startswith(("AKIA", "ASIA")):
            # Of many lengths, as passwords are.
            new = new.translate(LETTERS)[:MIN_SECRET + zlib.crc32(new.encode("utf-8", "replace")) % 24]
            tail.append(new)
        parts += [text[done:start], new]
        at += start - done
        moved.append((kind, at, at + len(new)))
        at += len(new)
        done = end
    word = TOKEN.search(text)
    mentions = "".join(f"\n{word.group()} {secret} {word.group()}" for secret in tail) if word else ""
    return "".join(parts) + text[done:] + mentions, moved


def _lessons(text: str) -> Iterator[tuple[list[Segment], list[list[int]]]]:
    """Segments and labels of the text and, if that differs, of the text in other spelling."""
    spans = [*secret_spans(text), *pattern_spans(text)]
    spellings = [(text, spans)]
    if any(kind in ("phone", "secret") for kind, _, _ in spans):
        spellings.append(respelled(text, spans))
    for spelled, there in spellings:
        secrets = frozenset(spelled[a:b] for kind, a, b in there if kind == "secret")
        segments = segments_of(spelled)
        if len(segments) > SAMPLE_SEGMENTS:
            segments.sort(key=lambda s: (zlib.crc32(" ".join(s.words).encode("utf-8", "replace")), s.spans[0]))
            segments = segments[:SAMPLE_SEGMENTS]
        yield segments, [label_segment(s, there, secrets) for s in segments]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# Labels that a token without an at-sign, without the form of an address or with letters cannot have.
RULED_OUT = {"no-at": [LABELS.index("email")], "no-ip": [LABELS.index("ip")],
             "letters": [LABELS.index("card"), LABELS.index("phone")]}


@dataclass
class FieldModel:
    """Weights by feature, of label pairs of neighbours, and of the skip edges."""

    weights: dict[str, np.ndarray]
    pairs: np.ndarray
    skip: float = SKIP_WEIGHT

    def unary(self, segment: Segment) -> np.ndarray:
        zero = np.zeros(len(LABELS))
        sums = np.array([sum((self.weights.get(f, zero) for f in names), zero) for names in segment.features])
        for names, row in zip(segment.features, sums):
            for f in names:
                for label in RULED_OUT.get(f, ()):
                    row[label] = BARRED
        return sums

    def chain(self, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of the tokens and log messages forward, by exact passes along the chain."""
        n = len(unary)
        ahead, back = np.zeros_like(unary), np.zeros_like(unary)
        for i in range(1, n):
            ahead[i] = _log_sum((ahead[i - 1] + unary[i - 1])[:, None] + self.pairs, 0)
            ahead[i] -= ahead[i].max()
        for i in range(n - 2, -1, -1):
            back[i] = _log_sum(self.pairs + (back[i + 1] + unary[i + 1])[None, :], 1)
            back[i] -= back[i].max()
        beliefs = ahead + unary + back
        return beliefs - _log_sum(beliefs, 1)[:, None], back


def train_field(data: list[tuple[Segment, list[int]]], seed: int = 3) -> FieldModel:
    """Maximum likelihood of the chains by stochastic gradient steps."""
    n = len(LABELS)
    model = FieldModel({}, np.zeros((n, n)))
    for segment, _ in data:
        for names in segment.features:
            for f in names:
                model.weights.setdefault(f, np.zeros(n))
    random = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for at in random.permutation(len(data)):
            segment, labels = data[at]
            unary = model.unary(segment)
            beliefs, back = model.chain(unary)
            step = -np.exp(beliefs)
            step[np.arange(len(labels)), labels] += 1
            ahead = beliefs - unary - back
            for i in range(len(labels) - 1):
                joint = (ahead[i] + unary[i])[:, None] + model.pairs + (unary[i + 1] + back[i + 1])[None, :]
                joint = np.exp(joint - joint.max())
                model.pairs -= rate * (joint / joint.sum() + SHRINK * model.pairs)
                model.pairs[labels[i], labels[i + 1]] += rate
            for names, g in zip(segment.features, step):
                for f in names:
                    w = model.weights[f]
                    w += rate * (g - SHRINK * w)
    return model


def _group_keys(value: str) -> list[str]:
    digits = NOT_DIGIT.sub("", value)
    return ["w" + value.lower()] + (["d" + digits] if len(digits) >= SIMILAR_DIGITS else [])


def groups_of(segments: list[Segment]) -> dict[str, list[tuple[int, int]]]:
    """Places (segment, token) of marked tokens that repeat or have the same digits."""
    groups: dict[str, list[tuple[int, int]]] = {}
    for s, segment in enumerate(segments):
        values = segment.values or [w.strip(EDGE) for w in segment.words]
        for i, value in enumerate(values):
            if segment.marked[i]:
                for key in _group_keys(value):
                    groups.setdefault(key, []).append((s, i))
    return {k: v for k, v in groups.items() if len(v) > 1}


def skip_weight(beliefs: np.ndarray, own: np.ndarray, others: np.ndarray) -> float:
    """The weight of the highest pseudo-likelihood; a row is a member of a group.

    ``beliefs`` are its log beliefs by its chain, ``own`` its label, ``others`` the number
    of the group's other members by label.
    """
    if not len(own):
        return SKIP_WEIGHT
    n = beliefs.shape[1]
    fits = []
    for weight in SKIP_WEIGHTS:
        # A row and a label of the member: the sum over the labels of the group's variable.
        shared = _log_sum(weight * (np.eye(n)[None] + others[:, None, :]), 2)
        logs = beliefs + shared
        fits.append((logs[np.arange(len(own)), own] - _log_sum(logs, 1)).sum())
    return float(SKIP_WEIGHTS[int(np.argmax(fits))])


def fit_skip(model: FieldModel, texts: list[tuple[list[Segment], list[list[int]], dict]]) -> float:
    """The weight of the skip edges from (segments, labels, groups) of each text."""
    beliefs, own, others = [], [], []
    for segments, labels, groups in texts:
        logs = {s: model.chain(model.unary(segments[s]))[0] for s in {s for g in groups.values() for s, _ in g}}
        for members in groups.values():
            counts = np.bincount([labels[s][i] for s, i in members], minlength=len(LABELS))
            for s, i in members:
                beliefs.append(logs[s][i])
                own.append(labels[s][i])
                others.append(counts - np.eye(len(LABELS))[labels[s][i]])
    return skip_weight(np.array(beliefs), np.array(own, int), np.array(others))


def beliefs_of(model: FieldModel, segments: list[Segment]) -> list[np.ndarray]:
    """Log beliefs of every token after passing messages along chains and within groups."""
    unaries = [model.unary(s) for s in segments]
    groups = groups_of(segments)
    if not groups:
        return [model.chain(u)[0] for u in unaries]
    tie = np.eye(len(LABELS)) * model.skip
    sent = {(k, at): np.zeros(len(LABELS)) for k, members in groups.items() for at in members}
    for _ in range(ROUNDS):
        inside = [u.copy() for u in unaries]
        for (_, (s, i)), message in sent.items():
            inside[s][i] += message
        beliefs = [model.chain(u)[0] for u in inside]
        for key, members in groups.items():
            # What a member tells the group leaves out what the group told it.
            told = {at: _log_sum((beliefs[at[0]][at[1]] - sent[key, at])[:, None] + tie, 0) for at in members}
            total = sum(told.values())
            for at in members:
                message = _log_sum((total - told[at])[:, None] + tie, 0)
                sent[key, at] = message - message.max()
    return beliefs


def _trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    if kind == "secret":
        key = KEYED.search(text, start, end)
        start = key.end() if key else start
        while start < end and text[start] in EDGE:
            start += 1
        cut = QUOTE.search(text, start, end)
        end = cut.start() if cut else end
    edge = {"phone": MARKS.replace("(", "").replace(")", ""), "secret": EDGE}.get(kind, MARKS)
    while start < end and text[start] in edge:
        start += 1
    while start < end and text[end - 1] in edge:
        end -= 1
    return start, end


def _possible(kind: str, value: str) -> bool:
    """Whether a span that the field found has the length, the digits and the check digit of its kind."""
    digits = NOT_DIGIT.sub("", value)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return len(value) >= MIN_SECRET if kind == "secret" else value != ""


def added_spans(model: FieldModel, text: str, taken: list[Span]) -> list[Span]:
    """Spans that the field finds beside those taken."""
    if not model.weights:
        return []
    segments = segments_of(text)
    found: list[Span] = []
    for segment, beliefs in zip(segments, beliefs_of(model, segments)):
        best = beliefs.argmax(axis=1)
        run: list[Span] = []
        for i, label in enumerate(best.tolist()):
            if not label or (not segment.marked[i] and LABELS[label] != "phone"):
                run.append(("", 0, 0))
                continue
            kind, (start, end) = LABELS[label], segment.spans[i]
            if run and run[-1][0] == kind and kind in ("phone", "card"):
                run[-1] = (kind, run[-1][1], end)
            else:
                run.append((kind, start, end))
        for kind, start, end in run:
            if kind:
                start, end = _trimmed(text, start, end, kind)
                if _possible(kind, text[start:end]):
                    found.append((kind, start, end))
    ends = sorted((a, b) for _, a, b in taken)
    starts = np.array([a for a, _ in ends], np.int64)
    furthest = np.maximum.accumulate(np.array([b for _, b in ends], np.int64)) if ends else starts
    free = []
    for span in found:
        before = int(np.searchsorted(starts, span[2]))
        if not before or furthest[before - 1] <= span[1]:
            free.append(span)
    return free


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join(parts) + text[done:]


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              sample_docs: int = SAMPLE_DOCS) -> FieldModel:
    """Train on the sample; only its segments, a bounded number, come to the driver."""
    texts = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    keys = texts.where("key is not null").select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample_docs)
    sample = texts.join(F.broadcast(materialize(keys, "keys")), "key").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                for segments, labels in _lessons(value.as_py() or ""):
                    groups = [[f"{s}:{i}" for s, i in members] for members in groups_of(segments).values()]
                    rows.append(([s.features for s in segments], labels, groups))
            made = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types)],
                                             ["features", "labels", "groups"])

    words = pa.list_(pa.list_(pa.string()))
    types = (pa.list_(words), pa.list_(pa.list_(pa.int32())), words)
    rows = sample.select("text").mapInArrow(
        run, "features array<array<array<string>>>, labels array<array<int>>, groups array<array<string>>").collect()
    texts = []
    for r in sorted(rows, key=lambda r: (r["features"], r["labels"])):
        groups = {str(k): [tuple(map(int, at.split(":"))) for at in g] for k, g in enumerate(r["groups"])}
        texts.append(([Segment([], [], [], names) for names in r["features"]], r["labels"], groups))
    model = train_field([pair for segments, labels, _ in texts for pair in zip(segments, labels)])
    model.skip = fit_skip(model, texts)
    return model


def find_pii(docs: DataFrame, model: FieldModel | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and ``pii_base``, ``pii_spans`` (kind:start:end, comma-joined),
    ``pii_counts`` (of the patterns, by kind) and ``pii_redacted``, the text without them."""
    model = fit_field(docs, id_col, text_col) if model is None else model
    names = [name for name in docs.columns if name not in ADDED]
    numbered = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns(names))])
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(place):
                text = value.as_py() or ""
                base = pattern_spans(text)
                spans = ordered(base + added_spans(model, text, base))
                counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                rows.append((written(base), written(spans), counts, redacted(text, spans) if spans else value.as_py()))
            made = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(made[0], pa.string()), pa.array(made[1], pa.string()),
                                        pa.array(made[2], pa.list_(pa.int64())), pa.array(made[3], pa.string())],
                batch.schema.names + list(ADDED))

    kinds = (T.StringType(), T.StringType(), T.ArrayType(T.LongType()), T.StringType())
    schema = T.StructType(numbered.schema.fields + [T.StructField(n, k) for n, k in zip(ADDED, kinds)])
    return numbered.mapInArrow(run, schema).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], *ADDED)
