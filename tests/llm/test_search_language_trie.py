"""Ranked search, languages and the prefix trie against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trafficlens.llm import language, lexical, prefix_trie

TERM = "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CLASHES = "id n query segment term times score rank m lang_ conv place digest words k1 q1 block depth own".split()


def clash(spark, rows, schema):
    """The rows with further columns whose names clash."""
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows],
                                 schema + "".join(f", {c} string" for c in CLASHES)).repartition(3)


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain_search(docs, items, best=10):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    n, length = len(bags), sum(b[1] for b in bags)
    df = Counter(t for b in bags for t in b[2])
    out = []
    for item, text in items:
        scores = []
        for i, size, tf in bags:
            m = 100 - 75 + (75 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                        for t in terms(text) if t in tf)
            scores.append((-score, i is not None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(x for x in scores if x[0] < 0)[:best], 1)]
    return out


def items_for(plain):
    return [(1, plain[8][1]), (2, "alpha BETA1 beta1 gamma"), (3, None), (4, ""), (5, "nowhere-to-be-found"), (6, "é 漢字 10 one"),
            (7, "no id here"), (2, "two words"), (None, "one two"), (8, " ".join(t or "" for _, t in plain[4:30]))]


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, messy, plain, monkeypatch, small):
    if small:  # many segments, several blocks of queries, few first visits
        for name, value in (("SEGMENT", 3), ("POSTINGS", 40), ("BLOCK_TERMS", 5), ("FIRST", 1)):
            monkeypatch.setattr(lexical, name, value)
    items = items_for(plain)
    got = lexical.ranked_search(messy, clash(spark, items, "item_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter(plain_search(plain, items))


def test_search_passes_over_segments_that_cannot_win(spark, monkeypatch):
    """Bounds leave segments out, the answers stay those of all documents."""
    monkeypatch.setattr(lexical, "SEGMENT", 4)
    monkeypatch.setattr(lexical, "FIRST", 3)
    r = random.Random(4)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randint(3, 90))))
            for i in range(400)]
    items = [(k, " ".join(f"w{r.randint(20, 59)}" for _ in range(3))) for k in range(6)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    search = lexical.Search(lexical.StratifiedIndex(frame), asked)
    seen = []
    visit = search._visit
    search._visit = lambda queries, visits: seen.append(visits.count()) or visit(queries, visits)
    assert Counter(map(tuple, search.answers().collect())) == Counter(plain_search(docs, items))
    assert sum(seen) < len(items) * search.index.segments.count()


def test_search_of_empty_tables(spark, messy):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.ranked_search(messy, none).count() == 0
    got = lexical.ranked_search(messy.limit(0), some)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def plain_phrases(text, sample):
    """Greedy parse of bytes into the longest matches in a sample, piece by piece."""
    count = 0
    for at in range(0, len(text), language.PIECE):
        piece, k = text[at:at + language.PIECE], 0
        while k < len(piece):
            size = 1
            while k + size < len(piece) and piece[k:k + size + 1] in sample:
                size += 1
            count, k = count + 1, k + size
    return count


def test_phrases_equal_a_plain_parse():
    r = random.Random(2)
    samples = {k: np.frombuffer("".join(r.choice(v) for _ in range(400)).encode(), np.uint8) for k, v in (("x", "ab "), ("y", "bcde"))}
    model = language.Languages.of(samples)
    texts = ["", "a", "ab" * 300, "".join(r.choice("abcdez ") for _ in range(900)), "zzz", "bcd" * 5]
    data, at = language.symbols(pa.array(texts))
    got = model.phrases(data, at)
    for i in range(len(texts)):
        own = data[at[i]:at[i + 1]].tobytes()
        assert got[i].tolist() == [plain_phrases(own, samples[k].tobytes()) for k in model.names]


def test_symbols_fold_case_and_runs():
    data, at = language.symbols(pa.array(["Ab  1,c", "", " É"]))
    assert [bytes(data[a:b]) for a, b in zip(at, at[1:])] == [b"ab c", b"", " é".encode()]


def test_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    hard = [r.lang == r.lang_pred for r in rows if r.held_out and r.lang]
    assert sum(hard) / len(hard) > 0.95


def test_labels_of_held_out_rows_are_not_seen(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    one = language.learn(docs)
    other = language.learn(docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 THEN 'xx' ELSE lang END AS lang"))
    assert one.names == other.names and (one.table == other.table).all()


def test_language_edges(spark, messy, plain):
    long = " ".join(["the of and"] * 40_000)
    more = clash(spark, [(1, None, "en"), (2, "", "en"), (3, "12 .. 3", "de"), (4, long, None), (5, "漢字", None), (5, "漢字", None)],
                 "doc_id long, text string, lang string")
    got = language.language(more).collect()
    assert len(got) == 6 and all((r.lang_pred, r.score) == ("und", 0.0) for r in got)  # nothing to learn from
    got = language.language(messy).collect()
    assert len(got) == len(plain)
    lettered = Counter(any(c.isalpha() for c in t or "") for _, t in plain)
    assert Counter(r.lang_pred == "en" for r in got) == lettered and all(0 <= r.score <= 1 for r in got)
    assert language.language(messy.limit(0)).count() == 0
    two = clash(spark, [(k, t, g) for k, (t, g) in enumerate([("the and of with that " * 9, "en"), ("der und die mit das " * 9, "de")] * 6)]
                + [(100, long, None)], "doc_id long, text string, lang string")
    model = language.learn(two)
    assert model.names == [] or {r.doc_id: r.lang_pred for r in language.predicted(two, model).collect()}[100] in model.names


def test_shared_strings_leave_the_sample():
    passage = "a passage that stands in several texts of all languages"
    texts = [f"{k * 3} own {passage} end" for k in ("x", "y", "z")]
    got = language.without_shared([np.frombuffer(t.encode(), np.uint8) for t in texts])
    assert [bytes(x) for x in got] == [f"{k * 3} own"[:3].encode() for k in ("x", "y", "z")]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = math.fmod(c, 20)
        built[c] = v if rest == 0 else turns.get(int(c - rest), [])[:h] + v[h:]
    members = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p in members:
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in members[p] if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), children[p],
                    sum(not children[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def conversations():
    r = random.Random(8)
    rows = []
    for c in [*range(0, 130), 140, 143, -7, -20, 2021]:
        if c in (40, 61):
            continue  # no conversation to begin with
        for t in range(r.choice([1, 1, 2, 3, 3, 5, 9, 20])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["", "a b", "hello", "go on  now", None])))
    rows += [(7, 0, "user", "again"), (7, 0, "user", "again"), (7, None, None, None), (None, 0, "user", "lost")]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(11)]
    rows += [(360, t, "user", f"long {t}") for t in range(70)] + [(380, t, "user", f"long {min(t, 40)}") for t in range(70)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, run", [(8, 1024), (3, 2)])
def test_trie(spark, monkeypatch, block, run):
    monkeypatch.setattr(prefix_trie, "RUN", run)  # long conversations are added up in several windows
    rows = conversations()
    got = prefix_trie.conversation_trie(clash(spark, rows, "conv_id long, turn long, role string, text string"), block=block)
    assert Counter(map(tuple, got.collect())) == Counter(plain_trie(rows))


def test_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(21, 0, "user", "x " * 100_000)]  # no other conversation to begin with; one turn only
    assert Counter(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, schema)).collect())) == Counter(plain_trie(rows))


def test_numbers_go_on_across_tasks(spark):
    """A conversation that range partitioning spreads over tasks is numbered without gaps."""
    rows = spark.range(3000).selectExpr("5L AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    got = prefix_trie.numbered_turns(rows.repartition(5)).selectExpr("count(*)", "count(DISTINCT place)", "min(place)", "max(place)").first()
    assert tuple(got) == (3000, 3000, 1, 3000)
