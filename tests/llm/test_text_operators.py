"""Operators on documents against plain Python over small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, decontaminate, langid, neardup, packing, quality, secrets, substring, wavelet
from quillspark.llm.tokens import default_path, encoder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rank int, node long, bucket long, u long, x string, tokens string"
rng = random.Random(7)
VOCABULARY = "alpha Beta gamma, delta. Épsilon zeta! eta 12 theta's iota\nkappa".split(" ")


def words(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def make_documents() -> list[tuple]:
    texts = [words(rng.randint(1, 150)) for _ in range(60)]
    base = [f"w{k}" for k in range(120)]
    texts += [" ".join(base), " ".join(base), " ".join(base[:100] + ["x"] + base[100:]), " ".join(["y", *base]), " ".join(base[:60])]
    texts += [None, "", " \n\t ", "one two", "one two", "a" * 5000, words(30000), "<|endoftext|> it's ÉÉ ×÷ T̈", "İstanbul 漢字 😀"]
    rows = [(k, t, ("en", "de", None)[k % 3], "src0", len(t or ""), 1, 2, 3, 4, "x", "t") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, "nobody's text with some words", None, None, 1, 1, 2, 3, 4, "x", "t")]


ROWS = make_documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def reference_ids(end: int) -> list[list[int]]:
    found = encoder(default_path()).tokenizer.encode_batch([r[1] or "" for r in ROWS], add_special_tokens=False)
    return [[*e.ids, end] for e in found]


def crc(ids) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_packing_covers_each_id_once_with_little_padding(docs, none):
    rows = packing.pack(docs).collect()
    truth = Counter((r[0], tuple(i)) for r, i in zip(ROWS, reference_ids(2), strict=True))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc_id, ids in truth:
        pieces = sorted({(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc_id]})
        assert [p[0] for p in pieces] == [sum(q[1] for q in pieces[:k]) for k in range(len(pieces))] or truth[doc_id, ids] > 1
        assert all(p[3] == len(ids) and p[2] == crc(ids[p[0] : p[0] + p[1]]) for p in pieces)
    assert sum(r.length for r in rows) == sum(len(i) * n for (_, i), n in truth.items())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        filled, padded = sum(p.length for p in pieces), pieces[0].padded_length
        assert filled <= padded <= 4096 and (padded == 4096 or filled == padded and padded & (padded - 1) == 0)
    assert sum(p[0].padded_length for p in by_sequence.values()) <= 1.02 * sum(r.length for r in rows)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 63, 1000, 1366, 2049, 4095, 4096, 4097, 20000])
def test_cuts_sum_up_and_fill_their_bins(n):
    found = packing.cuts(n)
    assert sum(found) == n
    assert all((4096 // c) * c >= 0.98 * 4096 - 64 for c in found)


def test_wavelet_round_trip(docs, none, spark):
    rows = wavelet.round_trip(docs).collect()
    order = sorted(zip(ROWS, reference_ids(1), strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] is not None, (x[0][1] or "").encode()))
    at, expected = 0, []
    for row, ids in order:
        expected.append((row[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == Counter(expected)
    assert wavelet.round_trip(none).count() == 0


def test_a_shard_that_is_there_stays(tmp_path):
    for raw in (b"one", b"one"):
        wavelet._put(f"file://{tmp_path}/shards", "part-0.wvm", raw)
    assert [p.name for p in (tmp_path / "shards").iterdir()] == ["part-0.wvm"] and (tmp_path / "shards" / "part-0.wvm").read_bytes() == b"one"


def test_passing_work_tables_go(spark):
    from quillspark.llm.shared import Workspace

    kept = Workspace(spark, "kept")
    with Workspace.passing():
        other = Workspace(spark, "passing")
        out = kept.save(other.save(spark.range(3).toDF("x"), "a"), "b")
    assert out.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(other.path("a")).count()


def test_wavelet_matrix_answers():
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 900, 3000).astype(np.uint32)
    wm, docs, counts = wavelet.from_bytes(wavelet.to_bytes(ids, [5, None], np.array([1000, 2000])))
    assert docs == [5, None] and counts.tolist() == [1000, 2000] and (wm.ids() == ids).all()
    for token in (0, 7, 899, 900, 5000):
        assert wm.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert wm.rank(token, 1234) == int((ids[:1234] == token).sum())
    assert [wm.access(k) for k in range(0, 3000, 101)] == ids[::101].tolist()
    with pytest.raises(IndexError):
        wm.access(3000)
    # planes of several frames, of which a lookup opens few
    ids = np.random.default_rng(2).integers(0, 40_000, 700_000).astype(np.uint32)
    raw = wavelet.to_bytes(ids, [1], np.array([len(ids)]))
    wm = wavelet.from_bytes(raw)[0]
    assert wm.access(650_000) == ids[650_000] and max(len(p.opened) for p in wm.planes) <= 2 < len(wm.planes[0].frames)
    assert (wm.ids() == ids).all() and wm.count(7) == int((ids == 7).sum()) and wm.occurrences(7) == np.flatnonzero(ids == 7).tolist()
    wm = wavelet.from_bytes(wavelet.to_bytes(np.zeros(0, np.uint32), [], np.zeros(0, np.int64)))[0]
    assert len(wm.ids()) == 0 and wm.count(3) == 0


def test_quality_counts(docs, none):
    found = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    for row in ROWS:
        text = row[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        r = found[row[0], len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def test_quality_references_and_verdicts(spark):
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = quality.judge(clean).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    share = {r.quality: r.kept for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def by_hand(text: str | None) -> list[tuple[str, ...]]:
    """Sentences as word tuples, cut by a walk over the characters."""
    blank, found, now, word, mark = " \t\n\r\f\v", [], [], "", False

    def close():
        nonlocal now
        if now:
            found.append(tuple(now))
        now = []

    for c in [*(text or ""), "\n"]:
        if c in blank:
            if word:
                now.append(word)
                # the word's signs at its end hold a mark that nothing but signs follow
                tail = len(word)
                while tail and word[tail - 1] in "\"')]}*#$%&|<>!?.,;:":
                    tail -= 1
                mark = any(x in ".!?,;:" for x in word[tail:])
                if mark:
                    close()
            word = ""
            if c == "\n":
                close()
        else:
            word += c
    return found


def expect_removed(rows, span):
    """{(doc_id, text): which sentences go} by comparing every run with every earlier one."""
    unique = sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: (x[0], x[1] or ""))
    cut = {x: by_hand(x[1]) for x in unique}
    first: dict = {}
    for x in unique:
        s = cut[x]
        n = min(span, len(s))
        for k in range(len(s) - n + 1 if s else 0):
            first.setdefault(tuple(s[k : k + n]), (x[0], k))
            first[tuple(s[k : k + n])] = min(first[tuple(s[k : k + n])], (x[0], k))
    gone = {}
    for x in unique:
        s, n = cut[x], min(span, len(cut[x]))
        gone[x] = [False] * len(s)
        for k in range(len(s) - n + 1 if s else 0):
            if first[tuple(s[k : k + n])] != (x[0], k):
                gone[x][k : k + n] = [True] * n
    return cut, gone


def test_quality_distances_against_plain_python(spark):
    """References and both distances of every document of the smallest table, by dictionaries."""
    import math
    import statistics

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()

    def classes(text):
        found = [0] * 11
        for c in text or "":
            n = len(c.encode())
            kind = 9 if n == 2 else 10 if n > 2 else 0 if c in "abcdefghijklmnopqrstuvwxyz" else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t" else 4 if c in "\r\n" else 6 if c in "#*$%&|<>" else 5 if c in ".,;:?'\"()-" else 7 if c.isprintable() else 8
            found[kind] += 1
        return found

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    def distance(p, q, n):
        bits = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q, strict=True) if a) / 2 + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q, strict=True) if b) / 2
        return math.sqrt(max(0, bits - (len(p) - 1) / (8 * math.log(2) * max(n, 1))))

    chars, common = {}, {}
    for lang in {r.lang for r in rows}:
        own = [classes(r.text) for r in rows if r.lang == lang]
        shares = [[round(1000 * x / sum(c)) for x in c] for c in own if sum(c) >= 200]
        if len(shares) < quality.MIN_REFERENCE_DOCS:
            continue
        medians = [statistics.median_low(x) / 1000 for x in zip(*shares, strict=True)]
        chars[lang] = [x / sum(medians) for x in medians]
        words_of = Counter(w for r in rows if r.lang == lang for w in split(r.text))
        total = sum(words_of.values())
        top = sorted((-n, w) for w, n in words_of.items() if n >= 0.002 * total)[:32]
        common[lang] = {w: -n / total for n, w in top}, -top[-1][0] if len(top) == 32 and sum(n == -top[-1][0] for n in words_of.values()) > 1 else None
    assert len(chars) > 1
    n_judged = 0
    for r in quality.judge(spark.createDataFrame(rows)).collect():
        row = next(x for x in rows if x.doc_id == r.doc_id)
        if row.lang not in chars:
            continue
        own = classes(row.text)
        expected = distance([x / max(1, sum(own)) for x in own], chars[row.lang], sum(own)) if sum(own) >= 200 else 0
        assert abs(expected - r.char_distance) < 1e-6
        table, tied = common[row.lang]
        if tied is None:
            w = split(row.text)
            counts = Counter(x for x in w if x in table)
            p, q = [counts[x] / max(1, len(w)) for x in table], list(table.values())
            expected = distance([*p, 1 - sum(p)] if w else [*p, 0], [*q, max(0, 1 - sum(q))], len(w)) if len(w) >= 50 else 0
            assert abs(expected - r.word_distance) < 1e-6
            n_judged += expected > 0
        assert r.kept == (not r.base_failed and r.char_distance <= quality.MAX_CHAR_DISTANCE and r.word_distance <= quality.MAX_WORD_DISTANCE)
    assert n_judged > 10


def test_few_documents_make_no_reference(spark):
    """Three long documents of three scripts in one language, and one-word texts: none is rejected for its language."""
    texts = [" ".join(f"{a}{k}" for k in range(120)) for a in ("word", "слово", "字")]
    rows = [*((k, t, "xx") for k, t in enumerate(texts)), *((10 + k, "one", "yy") for k in range(30))]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [found[k] for k in range(3)] == [True] * 3 and not any(found[10 + k] for k in range(30))


@pytest.mark.parametrize("span", [2, substring.SPAN])
def test_substring_against_brute_force(docs, none, span):
    cut, gone = expect_removed(ROWS, span)
    for r in substring.remove_repeats(docs, span).collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id)
        s = cut.get((r.doc_id, text), by_hand(text))
        lost = gone.get((r.doc_id, text), [False] * len(s))
        assert (r.n_sentences, r.n_removed, r.n_words_removed) == (len(s), sum(lost), sum(len(x) for x, g in zip(s, lost, strict=True) if g))
        left = [w for x, g in zip(s, lost, strict=True) if not g for w in x]
        assert re.findall(r"[^\x20\x09-\x0D]+", r.text or "") == left
        assert (r.text is None) == (text is None)
    assert any(any(g) for g in gone.values())
    assert substring.remove_repeats(none).count() == 0


def test_planted_passages_are_removed_and_clean_texts_stay(spark):
    """Passages of 60 words in the midst of other sentences; every other text is its own."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + r.choice([". ", ", ", "! ", ".\n"])
    prose = lambda n: "".join(sentence(r.randint(1, 12)) for _ in range(n))
    passages = [prose(11).split() for _ in range(4)]
    rows = []
    for k in range(60):
        own = prose(r.randint(6, 40)).split()
        if k % 3 == 0:
            at = r.randrange(len(own))
            own[at:at] = passages[k % 4][:70]
        rows.append((k, " ".join(own)))
    found = {x.doc_id: x for x in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {next(k for k in range(0, 60, 3) if k % 4 == j) for j in range(4)}
    for k, text in rows:
        if k % 3 or k in first:
            assert (found[k].n_removed, found[k].text) == (0, text)
        else:
            assert found[k].n_words_removed >= 20


def test_neardup_against_all_pairs(docs, none):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r[0]: shingles(r[1]) for r in ROWS if r[0] is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for tile in (512, 3):
        rows = neardup.groups(docs, tile=tile).collect()
        assert len(rows) == len(ROWS)
        for r in rows:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert len({find(d) for d in sets}) < len(sets)
    assert neardup.groups(none).count() == 0


def test_a_doc_id_of_several_texts_is_linked_by_each(spark):
    """Whatever the rows' order: id 7 stands for A and B, id 3 is near A, id 5 near B; 2 repeats A."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(7, " ".join(a)), (7, " ".join(b)), (3, " ".join([*a, "z"])), (5, " ".join([*b, "z"])), (9, "apart from all others it is"), (7, " ".join(a))]
    expected = Counter([(7, 56, 3, False)] * 2 + [(7, 56, 5, False), (3, 57, 3, True), (5, 57, 5, True), (9, 2, 9, True)])
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        found = neardup.groups(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == expected


@pytest.mark.parametrize("hot_rows", [1, 256])
def test_components_with_hot_nodes(spark, tmp_path, monkeypatch, hot_rows):
    from quillspark.llm import components
    from quillspark.llm.shared import Workspace

    monkeypatch.setattr(components, "HOT_ROWS", hot_rows)
    r = random.Random(4)
    edges = [(1000, k) for k in range(1, 400)] + [(k, k + 1) for k in range(2000, 2040)] + [tuple(r.sample(range(3000, 3300), 2)) for _ in range(200)] + [(5, 5), (1000, 7)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    found = components.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test"), "c").collect()
    assert {r.node: r.component for r in found if r.node != r.component} == {x: find(x) for x in nodes if find(x) != x}


def test_more_links_join_components(spark):
    """Links between components, to nodes without one, and within one; none leave all as it is."""
    from quillspark.llm.shared import Workspace

    comps = spark.createDataFrame([(2, 1), (3, 1), (12, 11), (22, 21)], "node long, component long")
    links = spark.createDataFrame([(3, 12), (2, 3), (22, 40), (50, 51)], "u long, v long")
    space = Workspace(spark, "test")
    found = {r.node: r.component for r in neardup._joined(comps, links, space, "a").collect()}
    assert {k: v for k, v in found.items() if k != v} == {2: 1, 3: 1, 11: 1, 12: 1, 22: 21, 40: 21, 51: 50}
    assert sorted(map(tuple, neardup._joined(comps, links.limit(0), space, "b").collect())) == sorted(map(tuple, comps.collect()))


def test_recall_of_pairs_near_the_limit(spark):
    """200 pairs of similarity 0.75 to 0.80, each apart from all others: every one is linked."""
    r = random.Random(8)
    rows, pairs = [], []
    for k in range(200):
        n = r.randint(60, 300)
        base = [f"{k}x{j}" for j in range(n + 4)]
        # a changed tail of t words takes t shingles from each side
        t = next(t for t in range(n, 0, -1) if 0.75 <= (n - t) / (n + t))
        t -= r.randint(0, t // 6)
        other = base[: len(base) - t] + [f"{k}y{j}" for j in range(t)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs.append((n - t) / (n + t))
    assert 0.75 <= min(pairs) <= max(pairs) <= 0.82 and sum(p < 0.76 for p in pairs) > 20
    found = {x.doc_id: x.component_id for x in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(found[2 * k + 1] == 2 * k for k in range(200)) == 200


def test_a_wide_bucket_is_split_by_finer_bands(spark, monkeypatch):
    """As if every open bucket were too wide: the groups are the same."""
    r = random.Random(9)
    shared = [f"s{k}" for k in range(70)]
    rows = []
    for k in range(40):
        # forty documents around one passage, in pairs that are near each other
        own = shared + [f"{k // 2}w{j}" for j in range(80)]
        rows.append((k, " ".join(own if k % 2 else [*own, r.choice("xyz")])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(map(tuple, neardup.groups(docs).collect()))
    assert [x[2] for x in expected] == [k - k % 2 for k in range(40)]
    monkeypatch.setattr(neardup, "MOST_COPIES", 0)
    assert sorted(map(tuple, neardup.groups(docs, tile=4).collect())) == expected


def test_tiles_find_what_pairs_find():
    import numpy as np

    r = np.random.default_rng(3)
    sketch = r.integers(0, 2**63, (40, 8), dtype=np.uint64)
    sketch[20:] = sketch[:20] ^ (np.uint64(1) << r.integers(0, 63, (20, 8), dtype=np.uint64))
    comp, most = np.arange(40), 60
    bands = np.zeros((40, neardup.BANDS), np.uint64)
    a, b = neardup._passing(0, comp, np.concatenate([sketch, bands], axis=1), most)
    assert {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == {(k, k + 20) for k in range(20)}
    x, y = neardup._forest(0, comp, sketch, most)
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == {(k, k + 20) for k in range(20)}


ITEMS = [(1, "alpha beta gamma delta"), (2, None), (3, " ".join(f"W{k}" for k in range(20))), (4, "eta 12"), (5, ""), (6, " ".join(f"w{k}" for k in range(15, 40))), (6, "iota kappa"), (None, "one two"), (7, "one, TWO")]


def test_decontamination_against_brute_force(docs, none, spark):
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = defaultdict(set)
    for item, text in ITEMS:
        w = split(text)
        n = min(8, len(w))
        if n and item is not None:
            windows[item] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = []
    for row in ROWS:
        w, hit, items = split(row[1]), set(), set()
        for n in range(1, 9):
            for k in range(len(w) - n + 1):
                for item in windows:
                    if tuple(w[k : k + n]) in windows[item]:
                        items.add(str(item))
                        hit.update(range(k, k + n))
        expected.append((row[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2))
    assert any(x[5] for x in expected)
    for block in (10**6, 60):
        assert Counter(map(tuple, decontaminate.scan(docs, benchmark, block_chars=block).collect())) == Counter(expected)
    assert decontaminate.scan(none, benchmark).count() == 0
    assert sum(r.n_hit for r in decontaminate.scan(docs, benchmark.where("item_id = 2")).collect()) == 0


def test_language_of_held_out_documents(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 0
    rows = {r.doc_id: r for r in langid.predict(docs).collect()}
    for row in ROWS:
        letters = any(c.isalpha() for c in row[1] or "")
        assert (rows[row[0]].lang_pred == "und") == (not letters) and 0 <= rows[row[0]].score <= 1
    assert langid.predict(none).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(unlabelled).collect()} == {"und"}
    shuffled = langid.predict(docs.withColumn("lang", F.when(langid.held_out(), "fr").otherwise(F.col("lang"))))
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, langid.predict(docs).collect()))


def test_language_scores_against_dictionaries(spark, docs):
    """Words first, then the longest known n-gram at each place, with plain dictionaries."""
    import math

    import pyarrow as pa
    import pyarrow.compute as pc

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", pc.utf8_lower(pa.scalar(text or "")).as_py())

    extra = [(100 + k, t, lang, "s", 1, 1, 2, 3, 4, "x", "t") for k, (t, lang) in enumerate([("der hund läuft der katze nach", "de"), ("le chat court après le chien", "fr"), ("the cat runs after the dog", "en"), ("unbekannte wörter läufer", None), ("chiens et chats", None)] * 3)]
    table = docs.unionByName(spark.createDataFrame(extra, COLUMNS))
    learned = [r for r in {(*r[:3],) for r in [*ROWS, *extra]} if r[2] is not None and r[1] is not None and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2)]
    often = Counter((*r[:3],) for r in [*ROWS, *extra])
    langs = sorted({r[2] for r in learned})
    of_word, of_gram = defaultdict(lambda: [0] * len(langs)), {n: defaultdict(lambda: [0] * len(langs)) for n in (4, 3, 2, 1)}
    for r in learned:
        for w in split(r[1]):
            of_word[w][langs.index(r[2])] += often[r]
            for n in of_gram:
                for k in range(len(w) + 3 - n):
                    of_gram[n][f"^{w}$"[k : k + n]][langs.index(r[2])] += often[r]
    total = [sum(x[k] for x in of_word.values()) for k in range(len(langs))]
    known = {w: x for w, x in of_word.items() if sum(x) >= 2}
    log = lambda x, total, n: [math.log((x[k] + 0.5) / (total[k] + 0.5 * n)) for k in range(len(langs))]
    gram_total = {n: [sum(x[k] for x in t.values()) for k in range(len(langs))] for n, t in of_gram.items()}

    def of(w):
        if w in known:
            return log(known[w], total, len(known))
        found = []
        for k in range(len(w) + 2):
            for n in (4, 3, 2, 1):
                g = f"^{w}$"[k : k + n]
                if len(g) == n and g in of_gram[n]:
                    found.append(log(of_gram[n][g], gram_total[n], len(of_gram[n])))
                    break
        return [sum(x) / len(found) for x in zip(*found, strict=True)] if found else [0.0] * len(langs)

    for r in langid.predict(table).collect():
        text = next(x[1] for x in [*ROWS, *extra] if x[0] == r.doc_id)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        words_of = split(text)
        mean = [sum(x) / len(words_of) for x in zip(*map(of, words_of), strict=True)]
        share = [math.exp((x - max(mean)) * min(10, len(words_of))) for x in mean]
        assert r.lang_pred == langs[share.index(max(share))] or sorted(share)[-1] - sorted(share)[-2] < 1e-4
        assert abs(r.score - max(share) / sum(share)) < 1e-4


def test_languages_learn_from_a_bounded_sample(spark):
    """A hot language and many copies of one row: as many different documents are chosen as the bound says."""
    rows = [(k, f"text number {k}", "en") for k in range(900)] + [(7000, "one copy", "de")] * 500 + [(7001 + k, f"wort {k}", "de") for k in range(30)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id", "text"))
    cut = langid._chosen(labelled, 20)
    for lang in ("en", "de"):
        hashes = sorted({r.h for r in labelled.where(F.col("lang") == lang).collect()})
        assert cut[lang] == hashes[19]
    assert langid._chosen(labelled, 5000) == {lang: max(r.h for r in labelled.where(F.col("lang") == lang).collect()) for lang in ("en", "de")}


def test_forest_as_columns_equals_the_forest(spark):
    labelled = secrets.labelled_findings(spark, 600)
    model = secrets.train(labelled)
    held_out = secrets.labelled_findings(spark, 1200).where("label is not null").subtract(labelled)
    x = held_out.withColumn("x", F.try_element_at(secrets._candidates(F.col("text")), F.lit(-1))).where("x is not null")
    features = F.struct(*[f.cast("double").alias(f"f{k}") for k, f in enumerate(secrets._features(F.col("x"), F.col("path"), model.dictionary))])
    votes = sum((secrets._as_column(t, F.col("f")) for t in model.trees[1:]), secrets._as_column(model.trees[0], F.col("f"))) / len(model.trees)
    rows = x.withColumn("f", features).withColumn("p", votes).collect()

    def walk(tree, f):
        while isinstance(tree, secrets.Split):
            tree = tree.low if f[tree.feature] <= tree.at else tree.high
        return tree.share

    assert all(abs(r.p - sum(walk(t, r.f) for t in model.trees) / len(model.trees)) < 1e-9 for r in rows)
    assert sum((r.p >= secrets.THRESHOLD) == (r.label == 1) for r in rows) > 0.95 * len(rows)
    # the label can't be told from where a finding stands: both have the same paths and last characters
    both = labelled.groupBy("path").agg(F.countDistinct("label").alias("n")).collect()
    assert all(r.n == 2 for r in both)


def test_secrets_are_found_and_redacted(spark, none):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'x token = "{key}" y', "src0"), (2, "mail me at the.54@mail3.example.com today", "src0"), (3, None, None), (4, "", "s"), (5, f"commit {key} fixes it", "docs/a"), (6, f'token = "{key}" token = "{key}"', "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("x", F.lit(1))
    model = secrets.default_model(docs)
    found = {(r.doc_id, r.secret) for r in secrets.scan(docs, model).collect()}
    assert (1, True) in found and (2, True) not in found and (5, True) not in found
    cleaned = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert cleaned == {1: 'x token = "[secret]" y', 2: rows[1][1], 3: None, 4: "", 5: rows[4][1], 6: 'token = "[secret]" token = "[secret]"'}
    assert secrets.scan(none, model).count() == 0 == secrets.redact(none, model).count()
    assert secrets.common_words(none) == []
    # very long texts and repeated rows
    long = spark.createDataFrame([(9, "word " * 200_000 + f'token = "{key}"' + " word" * 10, "src0")] * 2, "doc_id long, text string, source string")
    assert [(r.doc_id, r.finding, r.secret) for r in secrets.scan(long, model).collect()] == [(9, key, True)] * 2
    # a labelled text without a candidate is left out of the training
    lone = spark.createDataFrame([("", "no candidate", 1.0)], "path string, text string, label double")
    assert secrets.train(lone).trees == [secrets.Leaf(0.0)]


def test_chat_round_trip(spark):
    trap = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", trap), (2, 0, None, "a\\"), (2, 0, "we:ird\\", "x"), (2, 0, "we:ird\\", "x"), (3, None, "assistant", "é😀\n"), (None, 1, "User", "### User: </turn>\n")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_start", F.lit(1))
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(conversations)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_turns(conversations.limit(0))).count() == 0


def test_chat_reads_a_whole_conversation(spark):
    """The reader gives, piece by piece, what the parser gives of all of it; a broken conversation raises."""
    turns = [("user", "a\\"), ("assistant", "</turn>\n### User: b"), ("we:ird", ""), ("assistant", "c" * 300_000)]
    whole = "".join(chat.render(*t)[0] for t in turns)
    assert chat.parse(whole) == turns
    reader, found = chat.Reader(), []
    for at in range(0, len(whole), 60_007):
        found += reader.feed(whole[at : at + 60_007])
    reader.close()
    assert found == turns
    reader.feed("### User: a")
    with pytest.raises(ValueError):
        reader.close()


def test_chat_renders_any_text_back():
    pieces = ["\\", "#", "### ", "### Assistant: ", "User", "=", ":", " ", "<", "</turn>", "\n", "a", "é"]
    for _ in range(3000):
        text, role = "".join(rng.choices(pieces, k=rng.randint(0, 10))), rng.choice(["user", "assistant", "", "User", "a:b\\"])
        out, _, start, end = chat.render(role, text)
        assert chat.parse(out) == [(role, text)] and chat.unescape(out[start:end]) == text
    assert chat.parse("### User: a") is None


def test_cached_tokens_equal_the_library():
    import pyarrow as pa

    from quillspark.llm.textbytes import slices

    tokens = encoder(default_path())
    pieces = [*"aA'sStTb.,<|>19 \n\té×÷É̈T​ºΣσİﬁ한가`_-#*$&%", "<|endoftext|>", "<|STARTOFTEXT|>", "'S", "'ll"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)] + ["", None]
    expected = [e.ids for e in tokens.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for first, end, data, offsets in slices(pa.array(texts), 4000):
        ids, at = tokens.encode(data, offsets)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(end - first)] == expected[first:end]
