"""Operators against plain versions, on a table with nulls, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import (
    decontaminate, exact_dedup, html_text, line_dedup, mixing, near_dedup, pii, quality, repeats, tokens)
from trafficlens.llm.components import components

SPACES = "[\x20\x09-\x0D]+"
NOT_SPACES = "[^\x20\x09-\x0D]+"


def same(got, want):
    """Rows in any order, nulls included."""
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACES, " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        own = re.sub(SPACES, " ", t or "")
        ids = [x for x in groups[own] if x is not None]
        out.append((i, min(ids, default=None), len(groups[own]), sha(own)))
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")])
def test_exact_dedup(messy, plain, digest):
    got = exact_dedup.exact_dedup(messy, digest=digest).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], copies(plain))
    for text in {r.text_sha256 for r in got}:
        kept = [r for r in got if r.text_sha256 == text and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def jaccard_groups(rows, width):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = re.findall(NOT_SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    label = {k: k for k in sets}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in sets:
        for b in sets:
            ids = rows[a][0], rows[b][0]
            if a < b and None not in ids and sets[a] and sets[b] and (
                    ids[0] == ids[1] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                label[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(messy, plain, width):
    got = near_dedup.NearDuplicates(messy, width=width).groups().collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], jaccard_groups(plain, width))
    assert all(r.kept == (r.doc_id is None or r.component_id == r.doc_id) for r in got)


def test_near_dedup_finds_links_past_a_hub(spark):
    """A chain of texts, each like the next only, and a text that many share."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*[f"x{j}" for j in range(6 * k)], *base[6 * k:]]) for k in range(12)]
    shared = " ".join(f"common{i}" for i in range(90))
    texts += [f"{shared} " + " ".join(f"own{k}_{i}" for i in range(40)) for k in range(30)]
    rows = list(enumerate(texts))
    got = near_dedup.NearDuplicates(spark.createDataFrame(rows, "doc_id long, text string")).groups().collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], jaccard_groups(rows, 4))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def repeated(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_repeats(messy, plain, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 5000)  # the long texts are worked off in parts
    same(repeats.Repeats(messy).report().collect(), repeated(plain, 200))


def test_suffix_family_levels(spark):
    family = repeats.Family()
    batches = [[1, 2, 3], [3, 4], [5, 5, 6], [1, 6, 7], [7, 8]]
    found = []
    for batch in batches:
        rows = spark.createDataFrame([(k, k, 1) for k in batch], "head long, key long, many long")
        found.append({r.key for t in family.add(rows) for r in t.collect()})
    assert found == [set(), {3}, {5}, {1, 6}, {7}]
    assert [level is not None for level in family.levels] == [True, False, True]


def hits(rows, items, n=13):
    def split(t):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for own in windows:
            for k in range(len(w) - len(own) + 1):
                if tuple(w[k:k + len(own)]) == own:
                    hit |= set(range(k, k + len(own)))
                    found |= windows[own]
        names = sorted(map(str, found - {None}))
        yield i, len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, messy, plain):
    items = [(1, " ".join(dict(plain)[9].split()[30:60]).title()), (2, "two WORDS"), (3, None), (4, ""), (5, "é" * 500),
             (10, " ".join(dict(plain)[9].split()[40:52])), (11, "beta"), (12, dict(plain)[18]), (12, "one"), (None, "x" * 3000)]
    table = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, size string")
    same(decontaminate.contamination(messy, table).collect(), hits(plain, items))
    none = decontaminate.contamination(messy, table.limit(0)).collect()
    assert len(none) == len(plain) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777).astype(np.uint32)
    packed = tokens.pack(ids, bits)
    assert len(packed) == -(-777 * bits // 8)
    assert (tokens.unpack(packed, bits, 0, 777) == ids).all() and (tokens.unpack(packed, bits, 100, 333) == ids[100:333]).all()


ODD = ["a  b", " a b ", "x \n y", "a\xa0 b", "1 2 's don't  ''", "a\tb c\x1c d", "  ", "a <|endoftext|> b", "l1\nl2\n\nl3 \n", "é　 ü"]


def test_token_output(messy, plain, spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokens.tokenizer_path())
    rows = plain + [(1000 + i, t) for i, t in enumerate(ODD)]
    extra = spark.createDataFrame(rows[len(plain):], "doc_id long, text string")
    got = tokens.encode_corpus(messy.select("doc_id", "text").union(extra), block_ids=500).collect()
    coded = {}
    for i, t in rows:
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 0]
        coded.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        coded[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(coded.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_mixing(messy, plain):
    mix = mixing.Mix(messy, block_words=4)
    got = mix.taken().collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(re.findall(NOT_SPACES, t or ""))) for i, t in plain)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.source: r.source_size for r in got} == dict(sizes)
    by_hand = mixing.targets_by_hand(dict(sizes))
    for source, want in by_hand.items():
        assert target[source] == pytest.approx(want) and abs(taken[source] - want) <= 8
    assert [r.taken for r in mixing.Mix(messy.repartition(5), block_words=4).taken().orderBy("doc_id", "size", "taken").collect()] == [
        r.taken for r in mix.taken().orderBy("doc_id", "size", "taken").collect()]
    out = mix.documents()
    assert out.columns == messy.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.taken
    assert {i: n for i, n in total.items() if n} == words
    whole = dict(plain)
    assert all(re.sub(SPACES, " ", r.text).strip() in re.sub(SPACES, " ", whole[7]) for r in out.where("doc_id = 7").limit(1).collect()
               if r.n_chars == len(whole[7]))


def test_smallest_sources_are_mixed(spark):
    """A source of a few words has a block, and those capped at twice their size get it twice."""
    rows = [(1, "tiny", "three short words"), (2, "one", "word"), (3, "big", "much " * 5000), (4, "other", "more " * 5000)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = {r.source: r for r in mix.taken().collect()}
    assert all(r.target > 0 and r.taken > 0 for r in got.values())
    assert all(abs(got[s].taken - got[s].target) <= got[s].source_size for s in ("tiny", "one"))
    assert {r.source for r in mix.documents().collect()} == set(got)


def test_targets_capped(spark):
    rows = [("a", 10), ("b", 1000), (None, 5), ("c", 0), ("d", 400), ("é", 3)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(mixing.targets_by_hand(dict(rows)))


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1001):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n)) and (n < 7 or got != sorted(got))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    import random

    r = random.Random(5)
    parts = ["a", "@", "@", ".", " ", "1", "22", "333", "-", "+", "(", "é", "4111111111111111", "1.2.3.4", "+1 555 123 4567", "x@y.z"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == base(text), text


def test_personal_data(messy, plain):
    got = {r.doc_id: r for r in pii.personal_data(messy).collect() if r.doc_id is not None}
    for i, t in plain:
        if i is not None and i != 41:
            spans = base(t or "")
            assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
            assert got[i].base_sha256 == sha(pii.written(spans))
            assert set(pii.written(spans).split(",")) <= set(got[i].spans.split(","))


def test_skip_factors_add_spans(spark, data):
    model = pii.learn(spark.read.parquet(f"{data}/documents.parquet"))
    text = "card 4644348398010899 far from 4644.3483.9801.0899; +1 (706) 555-3138 or 706/555/3138; alone 1234.5678.9012"
    found, spans = pii.find(text, model)
    assert found == base(text)
    # the same digits in another form, and the same last digits
    assert [(text[a:b], k) for a, b, k in spans if (a, b, k) not in found] == [("4644.3483.9801.0899", "card"), ("706/555/3138", "phone")]


def pii_model():
    """As fitted on documents where numbers with slashes and dots are mostly nothing."""
    shapes = Counter({("16L", 3): 50, ("16.L", 0): 40, ("16/L", 0): 40, ("7", 0): 900})
    return pii.Field(shapes, Counter({(pii.SAME, 3, 3): 20, (pii.SAME, 0, 0): 40, (pii.CHAIN, 0, 0): 900, (pii.CHAIN, 3, 0): 50}))


def test_far_repeats():
    """Repeats in another notation are labelled however many there are; all are two links apart at most."""
    text = "card 4644348398010899" + "".join(f" word {1000000 + k} then {'4644/3483/9801/0899'} end" for k in range(50))
    base_found, spans = pii.find(text, pii_model())
    assert [k for *_, k in base_found] == ["card"]
    assert [k for a, b, k in spans if text[a:b] == "4644/3483/9801/0899"] == ["card"] * 50
    nodes = pii.mentions(text, base_found)
    links = pii.edges(nodes)
    assert len(links) == len(set(links)) <= 5 * len(nodes)
    base_at = next(i for i, m in enumerate(nodes) if m.kind)
    assert {i for i, m in enumerate(nodes) if m.same == nodes[base_at].same and i != base_at} <= {
        a + b - base_at for a, b, kind in links if kind == pii.SAME and base_at in (a, b)}


def test_whole_mentions():
    """Short repeats of a base span, and all that stands around an @."""
    text = f"8.8.8.8 or 8-8-8-8, not 9-9-9-9; {'é' * 90}@{'ü' * 100}.org, x @y z@ @"
    found = [text[m.start:m.end] for m in pii.mentions(text, pii.base_spans(text))]
    assert found == ["8.8.8.8", "8-8-8-8", f"{'é' * 90}@{'ü' * 100}.org"]
    import random

    r = random.Random(6)
    for _ in range(2000):
        text = "".join(r.choice(["a", "@", " ", "\u2003", "\x1f", "é.", ","]) for _ in range(r.randint(0, 20)))
        base_found = pii.base_spans(text)
        want = [(m.start(1), m.end(2)) for m in re.finditer(r"(?<![^\s@])(?=([^\s@]+)@([^\s@]+))", text)]
        want = [(a, a + len(text[a:b].rstrip(".,;:!?"))) for a, b in want if not text[a:b].rstrip(".,;:!?").endswith("@")]
        assert not base_found and [(m.start, m.end) for m in pii.mentions(text, [])] == want, text


def test_factors_count_all_documents(spark):
    """Rare shapes, single ones and those of rows without an id take part, also past 20,000 documents."""
    rare = ["1" * n for n in range(8, 20)]
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("n 1234567 x "), F.when(
        F.col("id") % 2500 == 7, F.lpad(F.lit(""), (F.col("id") / 2500).cast("int") + 8, "1")).otherwise("")).alias("text"))
    rows = rows.union(spark.createDataFrame([(None, "alone 12/34/56/78/90"), (None, "1" * 25 + " or " + "1" * 4000)], "doc_id long, text string"))
    shapes = pii.learn(rows).shapes
    assert {pii._mention(x, 0, len(x), None).shape for x in [*rare, "12/34/56/78/90", "1" * 30]} <= set(shapes)
    assert all(int(re.match("[0-9]*", s)[0] or 0) <= 21 for s in shapes)


def test_line_distance():
    import random

    r = random.Random(2)
    a, b = [], []
    for _ in range(800):
        x = [r.randint(1, 3) for _ in range(r.randint(3, 30))]
        y = x[:]
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(y) + 1)
            y[k:k + r.randint(0, 1)] = [r.randint(1, 3)] * r.randint(0, 1)
        a.append(np.array(x, "<u4"))
        b.append(np.array(y or [1], "<u4"))
    plain = np.array([line_dedup._plain(x.tolist(), y.tolist()) for x, y in zip(a, b)])
    for errors in (1, 2, 3):
        assert (line_dedup.within(a, b, errors) == (plain <= errors)).all()


def test_line_dedup(spark):
    lines = ["the first line of this small text", "another line that is long enough", "short", "", "x" * 40 + "é" * 10]
    near = ["the first lime of this small text", "the first lime of this smalll text", "anothr line that is long enouh", "x" * 41 + "é" * 9]
    rows = [(1, "\n".join(lines)), (2, "\n".join([near[0], lines[1], "short"])), (3, None), (4, ""), (5, "\n".join(near)),
            (None, lines[0]), (6, lines[0]), (6, lines[0]), (7, "a line of its own, like no other one"), (8, "z" * 5000)]
    got = line_dedup.LineDuplicates(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, line string")).report().collect()
    every = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= 24})
    linked = {x: {y for y in every if y != x and line_dedup._plain(list(x), list(y)) <= 2} for x in every}
    group = {}
    for x in every:
        if x not in group:
            todo = {x}
            while todo:
                y = todo.pop()
                group[y] = x
                todo |= linked[y] - group.keys()
    first, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        parts, gone = (t or "").split("\n"), []
        for n, x in enumerate(parts):
            if len(x) >= 24:
                if group[x] in first:
                    gone.append(n)
                first.add(group[x])
        want.append((i, len(parts), sum(len(linked.get(x, ())) for x in parts), len(gone), ",".join(map(str, gone))))
    same(got, want)


def test_short_lines(spark, tmp_path):
    """Copies of any length; links from six code points on, also past the ends of a range of lengths."""
    import random

    from trafficlens.llm import catalog

    r = random.Random(4)
    every = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(60)]
    every += ["Les.", "And ornd.", "And ornd", "x" * 22, "x" * 24, "x" * 25, "x" * 27, "", " "]
    rows = [(i, "\n".join(r.choice(every) for _ in range(20))) for i in range(12)] + [(None, "Les.\n\nLes.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()
    used = sorted({x for _, t in rows for x in t.split("\n") if x})
    linked = {x: [y for y in used if y != x and min(len(x), len(y)) >= 6 and line_dedup._plain(list(x), list(y)) <= 2] for x in used}
    group = {}
    for x in used:
        todo = [x] if x not in group else []
        while todo:
            group[y := todo.pop()] = x
            todo += [z for z in linked[y] if z not in group]
    first, want = set(), []
    for i, t in rows:
        parts, gone = t.split("\n"), []
        for n, x in enumerate(parts):
            if x and group[x] in first:
                gone.append(n)
            first.add(group.get(x))
        want.append((i, len(parts), sum(len(linked.get(x, ())) for x in parts), len(gone), ",".join(map(str, gone))))
    same(got, want)


PAGE = """<html><body><div class="site-header"><a href=x>Home</a></div><nav>menu</nav><div class=wrap><div class="post post-{n}">
<h1>Ti<b>t</b>le {n}</h1><p>Para one &amp; more&nbsp;text here with <a href='q>'>link</a>.<p>{body}<ul><li>a<li>b</ul>
<div class=ad>Buy</div><script>if(a<b){{"</p>"}}</script><form>f<input></form><section class="comments"><p>nice</p></section>
</div></div><aside>side</aside><div class="promo-box">{promo}</div><footer>foot</footer></body>"""


def test_main_text(spark):
    rows = [(n, f"http://h{n % 2}.example.org/{n}", PAGE.format(n=n, body="words " * n, promo="buy now " * 50)) for n in range(8)]
    rows += [(20, "http://h0.example.org/odd", "<p>only<p>this"), (21, None, None), (22, "bad url", ""), (22, "bad url", ""),
             (23, "http://x.example/", "plain < text &lt; ok"), (24, "https://u:p@x.example:80/", "<div>" * 300 + "deep <a \"" + "<" * 50)]
    got = html_text.main_text(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, path string")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for n in range(8):
        assert text[n] == f"Title {n} Para one & more text here with link. {'words ' * n}a b"
    assert (text[20], text[21], text[22], text[23]) == ("only this", "", "", "plain < text < ok")
    assert all(r.n_chars == len(r.text) for r in got) and text[24].startswith("deep")


def test_host_vote_beats_a_page(spark):
    usual = "<body><div class=main-text><p>{}</p></div><div class=box><p>{}</p></div></body>"
    rows = [(n, "http://h/", usual.format("story " * 80, "other " * 3)) for n in range(5)] + [(9, "http://h/", usual.format("tiny", "other " * 90))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "tiny"


def test_quality(spark, messy, plain, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.predicted == marks[r.doc_id] for r in got if r.held_out and r.doc_id in marks]
    assert sum(right) >= 0.85 * len(right)
    odd = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert len(quality.quality(messy, odd).collect()) == len(plain)
    none = quality.quality(messy, odd.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_empty_tables(spark, messy):
    none, labels = messy.limit(0), spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.NearDuplicates(none).groups().count() == 0
    assert line_dedup.LineDuplicates(none).report().count() == 0
    assert repeats.Repeats(none).report().count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert mixing.Mix(none).taken().count() == 0 and mixing.Mix(none).documents().count() == 0
    assert tokens.encode_corpus(none).count() == 0
    assert pii.personal_data(none).count() == 0
    assert quality.quality(none, labels).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
