"""Personal data: base patterns, and a skip-chain conditional random field over mentions.

A document's mentions are its base spans and other strings of a similar make:
long numbers with any separators, words around an ``@``. They are the nodes of
a graph. Neighbouring mentions share a chain factor; mentions of one text
content (the same digits, the same address) and mentions alike in part (the
same last seven digits, address block, mail host) share skip factors, however
far apart. Base spans keep their label; loopy message passing carries it along
the factors, so a card number that returns with unusual separators is labelled
as its first occurrence is.

The factors are fitted piecewise, from smoothed counts over all documents: base spans are labelled, other mentions count as no entity unless
they repeat a base span, in which case they are left open.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, filled, slices, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
CHAIN, SAME, ALIKE = range(3)
SURE, SMOOTH = 0.9, 0.5
#: Numbers of more digits are one class of shapes, so that the number of shapes is bounded.
MOST_DIGITS = 20
#: Messages are settled when none changes by more; the step is halved after so many turns that don't settle.
SETTLED, TURNS = 5e-4, 50
#: Pairs of agreeing labels that skip factors start from, before any evidence.
AGREE = {SAME: 20.0, ALIKE: 4.0}
#: How far the search for the start of a mail address looks back at first.
MAIL_PART = 64
#: Digits of a number that is a mention by itself; a shorter one has to repeat a base span.
LEAST_DIGITS = 7

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20()./_-]{0,2}[0-9])++")
_AFTER = re.compile(r"[^\s@]*")
_DIGITS = re.compile(r"[0-9]+")

FIELDS = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()),
          ("spans", pa.string()), ("n_added", pa.int64())]
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, " \
         "spans string, n_added bigint"


def digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @ so that long words cost no second look."""
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            width = MAIL_PART
            while True:
                low = max(done, at - width)
                local = len(text[low:at]) - len(text[low:at].rstrip(_LOCAL))
                if local < at - low or low == done:
                    break
                width *= 4
            if local:
                yield at - local, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        number = digits(m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Mention:
    start: int
    end: int
    kind: str | None
    shape: str
    same: str
    alike: str


def _mention(text: str, start: int, end: int, kind: str | None) -> Mention:
    own = text[start:end]
    if "@" in own:
        name, _, host = own.lower().partition("@")
        dots = min(host.count("."), 2)
        return Mention(start, end, kind, f"@{dots}{'' if own.isascii() else 'u'}", f"@{name}@{host}", f"@{host}")
    number = digits(own)
    marks = "".join(sorted(set(own) - set("0123456789")))
    shape = f"{min(len(number), MOST_DIGITS + 1)}{marks}{'+' if start and text[start - 1] == '+' else ''}{'L' if luhn(number) else ''}"
    parts = own.split(".")
    near = ".".join(parts[:3]) if len(parts) == 4 else number[-7:]
    return Mention(start, end, kind, shape, number, near)


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[Mention]:
    """Base spans and the other candidates that don't overlap one, by start."""
    out = [_mention(text, a, b, kind) for a, b, kind in base]
    taken = sorted((a, b) for a, b, _ in base)

    def free(a, b):
        return all(b <= x or a >= y for x, y in taken[_near(taken, a):_near(taken, b) + 2])

    known = {m.same for m in out}
    for m in _NUMBER.finditer(text):
        number = digits(m[0])
        if (len(number) >= LEAST_DIGITS or number in known) and free(m.start(), m.end()):
            out.append(_mention(text, m.start(), m.end(), None))
    done, at = 0, text.find("@")
    while at >= 0:
        # what stands since the last @ is looked at once
        before = text[done:at].rsplit(None, 1)[-1] if at > done and not text[at - 1].isspace() else ""
        after = _AFTER.match(text, at + 1)[0].rstrip(".,;:!?")
        done = at + 1
        if before and after and free(at - len(before), at + 1 + len(after)):
            out.append(_mention(text, at - len(before), at + 1 + len(after), None))
        at = text.find("@", at + 1)
    return sorted(out, key=lambda m: (m.start, m.end))


def _near(spans: list, at: int) -> int:
    import bisect

    return max(0, bisect.bisect_left(spans, (at, at)) - 2)


def edges(nodes: list[Mention]) -> list[tuple[int, int, int]]:
    """Chain edges between neighbours; skip edges to the last mention and to an anchor with the same key.

    The anchor is the key's first base span, else its first mention: all mentions
    of a key are two links apart at most, and the edges stay linear in their number.
    """
    out = [(i - 1, i, CHAIN) for i in range(1, len(nodes))]
    for kind, key in ((SAME, "same"), (ALIKE, "alike")):
        keys = [getattr(node, key) for node in nodes]
        anchor: dict = {}
        for i, k in enumerate(keys):
            if k not in anchor or nodes[i].kind and not nodes[anchor[k]].kind:
                anchor[k] = i
        last: dict = {}
        linked: dict = {}
        for i, k in enumerate(keys):
            for j in (last.get(k, i), anchor[k]):
                if j != i:
                    linked[min(i, j), max(i, j), kind] = None
            last[k] = i
        out += linked
    return out


class Field:
    """Log potentials: one row of label weights per shape, one label by label table per edge type."""

    def __init__(self, shapes: Counter, pairs: Counter):
        n = len(LABELS)
        totals = np.full(n, SMOOTH)
        for (_, label), count in shapes.items():
            totals[label] += count
        prior = totals / totals.sum()
        rows: dict = {}
        for (shape, label), count in shapes.items():
            rows.setdefault(shape, n * SMOOTH * prior)[label] += count
        self.shapes = {s: np.log(r / r.sum()) for s, r in rows.items()}
        self.prior = np.log(prior)
        self.tables = np.zeros((3, n, n))
        for kind in range(3):
            table = SMOOTH * np.outer(prior, prior) * n
            if kind in AGREE:
                table = table + AGREE[kind] * np.diag(prior)
            for (k, a, b), count in pairs.items():
                if k == kind:
                    table[a, b] += count
                    table[b, a] += count
            table /= table.sum()
            self.tables[kind] = np.log(table / np.outer(table.sum(1), table.sum(0)))

    def beliefs(self, nodes: list[Mention], links: list[tuple[int, int, int]]) -> np.ndarray:
        """Label probabilities of each node after loopy sum-product message passing."""
        own = np.array([self.shapes.get(m.shape, self.prior) for m in nodes])
        for i, m in enumerate(nodes):
            if m.kind:
                own[i] = -1e3
                own[i, LABELS.index(m.kind)] = 0
        total = own
        if links:
            a, b, kind = np.array(links).T
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            tables = self.tables[np.concatenate([kind, kind])]
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(source), len(LABELS)))
            # smaller and smaller steps let messages settle that would swing for ever
            for turn in itertools.count():
                step = 0.5 ** (1 + turn // TURNS)
                total = own.copy()
                np.add.at(total, target, sent)
                out = (total[source] - sent[back])[:, :, None] + tables
                top = out.max(1, keepdims=True)
                out = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                out -= out.max(1, keepdims=True)
                change = step * np.abs(out - sent).max()
                sent = (1 - step) * sent + step * out
                if change < SETTLED:
                    break
            total = own.copy()
            np.add.at(total, target, sent)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


def counts(text: str) -> tuple[Counter, Counter]:
    """Labelled shapes and labelled pairs of one document."""
    nodes = mentions(text, base_spans(text))
    known = {k for m in nodes if m.kind for k in (m.same, m.alike)}
    label = [LABELS.index(m.kind) if m.kind else None if {m.same, m.alike} & known else 0 for m in nodes]
    shapes = Counter((m.shape, x) for m, x in zip(nodes, label) if x is not None)
    pairs = Counter((kind, label[a], label[b]) for a, b, kind in edges(nodes) if None not in (label[a], label[b]))
    return shapes, pairs


def _count_rows(batches):
    shapes, pairs = Counter(), Counter()
    for batch in batches:
        for text in _relevant(filled(batch.column("text"))):
            if text:
                s, p = counts(text)
                shapes.update(s)
                pairs.update(p)
    rows = [(s, None, x, None, n) for (s, x), n in shapes.items()] + [(None, k, a, b, n) for (k, a, b), n in pairs.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
        (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["shape", "kind", "a", "b", "n"])


def learn(docs: DataFrame, text: str = "text") -> Field:
    """Fit on all documents.

    The driver gets a row per shape and label: digits up to a bound, a set of
    the few separators and two marks, so some ten thousand at most.
    """
    got = columns(docs, text=text).mapInArrow(_count_rows, "shape string, kind int, a int, b int, n bigint")
    got = got.groupBy("shape", "kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Field(Counter({(r.shape, r.a): r.n for r in got if r.shape is not None}),
                 Counter({(r.kind, r.a, r.b): r.n for r in got if r.shape is None}))


def find(text: str, model: Field) -> tuple[list, list]:
    """Base spans, and all spans with those that the field adds."""
    base = base_spans(text)
    nodes = mentions(text, base)
    if len(nodes) == len(base):
        return base, base
    beliefs = model.beliefs(nodes, edges(nodes))
    added = [(m.start, m.end, LABELS[int(p.argmax())]) for m, p in zip(nodes, beliefs)
             if not m.kind and p[0] < 1 - SURE and p.max() >= SURE]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _relevant(texts: pa.Array):
    """Each text, or an empty one where it has neither a digit nor an @."""
    for low, high in slices(texts):
        part = texts.slice(low, high - low)
        raw, at = utf8(part)
        marks = np.concatenate([[0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))])
        some = np.diff(marks[at]) > 0
        for i, yes in enumerate(some.tolist()):
            yield part[i].as_py() if yes else ""


def _finder(model):
    nothing = hashlib.sha256(b"").hexdigest()

    def rows(batches):
        for batch in batches:
            out = [[] for _ in FIELDS]
            out[0] = batch.column("id").to_pylist()
            for text in _relevant(filled(batch.column("text"))):
                base, spans = find(text, model.value) if text else ((), ())
                kinds = [s[2] for s in base]
                values = [*[kinds.count(k) for k in KINDS],
                          hashlib.sha256(written(base).encode()).hexdigest() if base else nothing,
                          written(spans), len(spans) - len(base)]
                for column, value in zip(out[1:], values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, FIELDS)], [n for n, _ in FIELDS])

    return rows


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of the base spans; ``spans`` has these and the
    added ones. Null and empty texts have none. Rows that share an id are looked
    at one by one; an empty table gives no rows; positions are code points.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, text))
    rows = columns(docs, id=id, text=text).select(F.col("id").cast("bigint"), "text")
    return rows.mapInArrow(_finder(model), SCHEMA)
