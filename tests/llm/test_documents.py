"""Operators over documents: hard rows, brute force, exact round trips."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import decontam, langid, packing, pii, resemblance, simhash, tokens, toxicity
from vellum.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, score string, spans string, fp string"
LONG = "lorem ipsum dolor sit amet " * 60_000  # over a window


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


HARD = [None, "", " \n\t", "123 456", "a", "same text here today", "same text here today", "é漢字😀 ñ", LONG, "​", "x" * 70_000, "😀→ " * 400]


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, HARD).cache()


# --- language -------------------------------------------------------------------


def _speak(r, syllables, n):
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(1)
    kinds = {"aa": ["th", "ing", "on", "er"], "bb": ["sch", "ung", "keit", "ü"], "cc": ["ción", "que", "ll", "ñ"]}
    return spark.createDataFrame([(i, _speak(r, kinds[k], r.randint(20, 60)), k) for i in range(300) for k in [list(kinds)[i % 3]]], "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark, languages):
    m = langid.train(languages.where(~langid.held_out()))
    got = langid.predict(languages.where(langid.held_out()).withColumn("score", F.lit("clash")), m).collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and not r.rejected for r in got)


def test_language_hard_rows(spark, hard, languages):
    m = langid.train(languages)
    got = {r.doc_id: r for r in langid.predict(hard, m).collect()}
    assert len(got) == len(HARD)
    for i in (0, 1, 2, 3, 9, 11):
        assert got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0
    assert got[7].lang_pred in m.languages and got[5].lang_pred == got[6].lang_pred
    none = langid.train(languages.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(hard, none).collect()} == {"und"}
    assert langid.predict(hard.limit(0), m).count() == 0


def _plain_language(text, m):
    """Index of the language and score by the definition: every gram of every word, one by one."""
    low = (text or "").lower().encode()
    buf = b" " + bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in low) + b" "
    total, n = np.zeros(len(m.languages)), 0
    for size in langid.SIZES:
        for i in range(len(buf) - size + 1):
            g = buf[i : i + size]
            if all(c > 32 for c in g[1:-1]) and (g[0] > 32 or g[-1] > 32):
                h = g[0]
                for c in g[1:]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                total += m.logits[((h * 0x9E3779B1) & 0xFFFFFFFF) >> 16].astype(float)
                n += 1
    if not any(map(str.isalpha, text or "")):
        return -1, 0.0
    z = (total / n + m.bias) / m.temperature
    p = np.exp(z - z.max())
    return int(p.argmax()), float((p / p.sum()).max())


def _some_model():
    r = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], r.normal(scale=30, size=(langid.BUCKETS + 1, 3)).astype(np.float32), r.normal(size=3), 0.7, 0.4)
    m.logits[-1] = 0
    return m


def test_language_against_brute_force():
    m, r = _some_model(), random.Random(21)
    texts = [*HARD[:8], *HARD[9:10], *("".join(r.choices("ab çéß.,! 1漢\n", k=r.randint(0, 60))) for _ in range(200))]
    best, score, rejected = langid.score_batch(pa.array(texts), m)
    for k, t in enumerate(texts):
        want, s = _plain_language(t, m)
        assert best[k] == want and score[k] == pytest.approx(s, rel=1e-4) and rejected[k] == (want < 0 or s < 0.4), t


def test_language_windows_agree(monkeypatch):
    """A text cut into windows scores as one that is not."""
    m, r = _some_model(), random.Random(22)
    texts = pa.array([" ".join("".join(r.choices("abcdeé", k=r.randint(1, 9))) for _ in range(n)) for n in (3000, 5, 900)])
    whole = langid.score_batch(texts, m)
    windows = langid.K.windows
    monkeypatch.setattr(langid.K, "windows", lambda array, limit=0: windows(array, 500))
    parts = langid.score_batch(texts, m)
    assert len(list(langid.K.windows(langid.K.lowered(texts)))) > 30
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_sampled_counts_are_those_of_the_text(monkeypatch):
    r = random.Random(23)
    texts = ["", *(" ".join("".join(r.choices("abcé", k=r.randint(1, 6))) for _ in range(n)) for n in (400, 1, 60)), "..", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["x"] * len(texts))], names=["t", "l"])
    (one,) = langid._counts_of([batch], "t", "l")
    windows = langid.K.windows
    monkeypatch.setattr(langid.K, "windows", lambda array, limit=0: windows(array, 100))
    (cut,) = langid._counts_of([batch], "t", "l")
    for k, t in enumerate(texts):
        buf, _ = langid.K.joined([(t or "").encode()], langid._TABLE, b" ")
        every = collections.Counter(int(b) for g in langid.gram_buckets(buf) for b in g if b != langid.BUCKETS)
        for got in (one, cut):
            buckets, weights = np.frombuffer(got.column(1)[k].as_py(), "<u4"), np.frombuffer(got.column(2)[k].as_py(), "<f4")
            assert buckets.tolist() == sorted(every) and np.allclose(weights, [every[b] / sum(every.values()) for b in sorted(every)])


def test_known_rows_keep_their_columns(spark, hard, languages):
    m = langid.train(languages)
    docs = languages.limit(30).unionByName(hard, allowMissingColumns=True).withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("rejected", F.lit("mine"))
    kept = langid.known(docs, m)
    rows = kept.collect()
    assert kept.schema == docs.schema and len(rows) >= 30 and {(r.lang_pred, r.score, r.rejected) for r in rows} == {("mine",) * 3}
    assert len(rows) == langid.predict(docs, m).where("NOT rejected").count() and langid.known(docs.limit(0), m).count() == 0


# --- SimHash --------------------------------------------------------------------


def _plain_fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 16)  # many blocks
    r = random.Random(2)
    for t in ["", " ", "One", "two Words", "É x\x0by\x1cz é", *("".join(r.choices("aB \t\né\x85", k=r.randint(0, 80))) for _ in range(200))]:
        assert simhash.fingerprint(t.encode(), 3) == _plain_fingerprint(t), t


def test_golay_code():
    """Every 23-bit value is within 3 bits of its code word, and values within 2 bits of each other share a key."""
    r = np.random.default_rng(3)
    v = r.integers(0, 1 << 23, 3000)
    word = v ^ simhash._correction()[simhash._remainder(v)]
    assert (simhash._remainder(word) == 0).all() and np.bitwise_count(word ^ v).max() <= 3
    other = v ^ (1 << r.integers(0, 23, 3000)) ^ (1 << r.integers(0, 23, 3000))
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for x, k in zip((v, other), keys, strict=True):
        for row, key in zip(*simhash.golay_keys(x), strict=True):
            k[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(3000)) and {len(k) for k in keys[0].values()} <= {1, 6}


@pytest.mark.parametrize("few", [24, 2])  # with 2, nearly every key counts as large
def test_links_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", few)
    r = random.Random(4)
    prints = []
    for _ in range(60):
        base = r.getrandbits(64)
        prints += [base] + [base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.random() < 0.3) * (1 << r.randrange(64)) for _ in range(r.randint(0, 6))]
    prints = sorted({0, 1, 3, 7, 15, *prints})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(signed, range(len(prints)), strict=True)), "fp long, rep long")
    for bits in (0, 1, 2):
        parent = list(range(len(prints)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(prints):
            for j in range(i):
                if (a ^ prints[j]).bit_count() <= bits:
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
        want = {i: find(i) for i in range(len(prints)) if find(i) != i}
        found = {r.node: r.component for r in simhash.components(simhash.links(df, bits)).collect() if r.node != r.component}
        assert found == want


def test_simhash_hard_rows(spark, hard):
    got = {r.doc_id: r for r in simhash.classes(hard).collect()}
    assert [got[i].fp for i in (0, 1, 2)] == [0, 0, 0] and got[2].component_id == 0
    assert got[5].component_id == got[6].component_id == 5
    kept = {r.doc_id for r in simhash.keep_one(hard).collect()}
    assert 6 not in kept and {0, 5} <= kept and simhash.keep_one(hard).columns == hard.columns
    assert simhash.classes(hard.limit(0)).count() == 0
    nameless = table(spark, ["q w e r t", "q w e r t"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.component_id for r in simhash.classes(nameless).collect()] == [None, None] and simhash.keep_one(nameless).count() == 2


def _resemblance(a, b, n=5):
    a, b = ({tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_sketches_estimate_resemblance():
    r = random.Random(11)
    words = [b"%d" % r.randrange(9000) for _ in range(700)]
    for edits in (1, 5, 12, 40):
        other = list(words)
        for k in r.sample(range(700), edits):
            other[k] = b"new%d" % k
        a, b = resemblance.Sketcher(), resemblance.Sketcher()
        a.add(words)
        for k in range(0, 700, 90):  # parts of any size give one sketch
            b.add(other[k : k + 90])
        same = np.mean([x == y for x, y in zip(*(np.frombuffer(s.result()[0], "<u2") for s in (a, b)), strict=True)])
        assert abs(same - _resemblance(" ".join(map(bytes.decode, words)), " ".join(map(bytes.decode, other)))) < 0.12
    assert resemblance.Sketcher().result() is None
    few = resemblance.Sketcher()
    few.add([b"a", b"b"])
    assert few.result() is not None


@pytest.mark.parametrize("few", [24, 2])  # with 2, nearly every key counts as large
def test_edited_copies_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(resemblance, "PAIRS_UP_TO", few)
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    texts = []
    for size in [1] * 20 + [2, 3, 5, 40]:  # single texts and groups of copies, each a few edits from the first
        first = [word() for _ in range(r.randint(120, 300))]
        passage = [word() for _ in range(30)]
        for k in range(size):
            copy = list(first)
            for at in r.sample(range(len(copy)), 2 if k else 0):
                copy[at] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(word() for _ in range(150)) + " " + " ".join(passage))
        texts.append(" ".join(passage) + " " + " ".join(word() for _ in range(150)))  # a shared passage is no copy
    r.shuffle(texts)
    found = {x.doc_id: x.component_id for x in simhash.near_classes(table(spark, texts)).collect()}
    groups = collections.defaultdict(set)
    for i, t in enumerate(texts):
        groups[found[i]].add(i)
        for j in range(i):
            s = _resemblance(t, texts[j])
            if s >= 0.8:
                assert found[i] == found[j], s
    for group in groups.values():
        first = min(group)
        assert all(_resemblance(texts[first], texts[i]) > 0.6 for i in group)
    assert len(groups) == 24 + 48


def _alike_by_brute_force(texts, pairs):
    """Component of each text by links of a real resemblance of 0.8 or more."""
    of = list(range(len(texts)))
    for i, j in pairs:
        if _resemblance(texts[i], texts[j]) >= 0.8:
            a, b = of[i], of[j]
            of = [min(a, b) if x in (a, b) else x for x in of]
    return of


def _edited(r, words, n):
    """A copy with n changed words, far apart."""
    out = list(words)
    for k in range(n):
        out[3 + k * (len(words) // n)] = f"e{r.randrange(10**9)}"
    return out


def test_links_are_decided_on_the_real_resemblance(spark):
    r = random.Random(31)
    texts = []
    for n in [4] * 40 + [5] * 40:  # 196 shingles: 4 edits leave 176 (0.815), 5 leave 171 (0.774)
        first = [f"w{r.randrange(10**9)}" for _ in range(200)]
        texts += [" ".join(first), " ".join(_edited(r, first, n))]
    found = {x.doc_id: x.component_id for x in simhash.near_classes(table(spark, texts), bits=0).collect()}
    want = _alike_by_brute_force(texts, [(i, i + 1) for i in range(0, len(texts), 2)])
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) == 40 + 80


def test_pairs_within_a_large_family_are_found(spark):
    r = random.Random(32)
    template = [f"t{k}" for k in range(200)]
    texts = []
    for _ in range(60):  # all resemble each other by about 0.7; two of each pair by more than 0.8
        own = [f"o{r.randrange(10**9)}" for _ in range(40)]
        texts += [" ".join(template + own), " ".join(template + _edited(r, own, 2))]
    found = {x.doc_id: x.component_id for x in simhash.near_classes(table(spark, texts), bits=0).collect()}
    want = _alike_by_brute_force(texts, [(i, j) for j in range(len(texts)) for i in range(j)])
    assert [found[i] for i in range(len(texts))] == want and len(set(want)) == 60


# --- decontamination ------------------------------------------------------------


def _plain_alignment(a, b, weight, gap):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (weight[i] if a[i] == b[j] else -gap), h[i, j + 1] - gap, h[i + 1, j] - gap)
    return h.max()


def test_alignment_against_the_plain_recurrence():
    r = np.random.default_rng(5)
    for _ in range(100):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(0, 5, r.integers(0, 20))
        w = r.uniform(0.2, 3, len(a))
        assert decontam.smith_waterman(a, b, w, 0.7)[0] == pytest.approx(_plain_alignment(a, b, w, 0.7))


def test_copies_and_edits_are_found(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("bcdfghklmnprst", k=3)) + r.choice("aeiou")
    vocabulary = [word() for _ in range(800)]
    item = [[r.choice(vocabulary) for _ in range(30)] for _ in range(6)]
    clean = [" ".join(r.choice(vocabulary) for _ in range(200)) for _ in range(60)]
    leaks = {}
    for k in range(12):
        words = list(item[k % 6])
        if k >= 6:  # a sixth of the words replaced, one dropped
            for at in r.sample(range(30), 5):
                words[at] = word() + "x"
            del words[10]
        leaks[100 + k] = (" ".join(r.choice(vocabulary) for _ in range(50)) + " " + " ".join(words).upper() + ", " + clean[k], k % 6)
    texts = [(i, t) for i, t in enumerate(clean)] + [(i, t) for i, (t, _) in leaks.items()] + [(900, None), (901, ""), (902, LONG + " ".join(item[0]) + " " + LONG)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item)] + [(7, None), (8, ""), (9, "!!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(i, k) for i, (_, k) in leaks.items()} | {(902, 0)}
    assert all(r.score > (0.999 if r.doc_id < 106 or r.doc_id == 902 else 0.5) for r in got.values())
    assert got[902, 0].start_word == len(LONG.split()) and got[902, 0].end_word - got[902, 0].start_word == 30
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def _plain_contaminated(docs, items, threshold):
    """Every pair that shares a gram of three words (or a first word, for shorter items), aligned whole against whole."""
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    d, b = {i: words(t) for i, t in docs}, {i: words(t) for i, t in items}
    seen = collections.Counter(w for v in d.values() for w in set(v))
    out = {}
    for k, item in b.items():
        weight = np.array([np.log((len(d) + 1) / (seen[w] + 1)) + 0.1 for w in item])
        grams = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
        code = {w: n for n, w in enumerate(dict.fromkeys(item))}
        for i, text in d.items():
            if grams & {tuple(text[j : j + 3]) for j in range(len(text) - 2)}:
                score = _plain_alignment([code[w] for w in item], [code.get(w, -1) for w in text], weight, 0.5 * weight.sum() / len(item)) / weight.sum()
                if score >= threshold:
                    out[i, k] = score
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(26)
    vocabulary = ["".join(r.choices("bcdfgaeiou", k=r.randint(2, 6))) for _ in range(150)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 30)))) for k in range(8)]
    docs = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if i % 2:  # a copy, edited by words replaced, dropped and put in
            copy = items[r.randrange(8)][1].split()
            for _ in range(r.randint(0, len(copy) // 2)):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice(([], [r.choice(vocabulary)], [copy[at], r.choice(vocabulary)]))
            at = r.randint(0, len(words))
            words[at:at] = copy
        docs.append((i, " ".join(words)))
    want = _plain_contaminated(docs, items, 0.5)
    got = {(x.doc_id, x.item_id): x.score for x in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20 and got == pytest.approx(want)


def test_copies_across_window_cuts(monkeypatch):
    """An item as long as several windows is found whole wherever the cuts fall."""
    r = random.Random(27)
    item = [f"w{r.randrange(10**6)}" for _ in range(1500)]
    block = decontam.Block.of([7], [" ".join(item)])
    ix = decontam.index(block, {}, 10)
    windows = decontam.K.windows
    monkeypatch.setattr(decontam.K, "windows", lambda array, limit=0: windows(array, 4096))
    for lead in (0, 1, 300, 511, 700):
        changed = [w if k % 4 else f"x{k}" for k, w in enumerate(item)]
        texts = [" ".join(["lorem"] * lead + body + ["ipsum"] * 900) for body in (item, changed)]
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], names=["doc_id", "t"])
        (got,) = decontam._match([batch], ix, 0.3)
        scores = dict(zip(got.column(0).to_pylist(), got.column(2).to_pylist(), strict=True))
        assert scores[0] == pytest.approx(1.0) and got.column(4).to_pylist()[0] == lead and got.column(5).to_pylist()[0] == lead + 1500
        whole = decontam.smith_waterman(block.words[0], decontam._hashes([texts[1].encode()])[0], ix.weights[0], 0.5 * ix.weights[0].sum() / 1500)[0] / ix.weights[0].sum()
        assert scores.get(1, 0) == pytest.approx(whole) if whole >= 0.3 else 1 not in scores


def test_repeated_documents_and_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "g h i j")], "doc_id long, text string").withColumn("t", F.lit("clash"))
    bench = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "g h i j")], "item_id long, text string")
    got = sorted(((x.doc_id or -1, x.item_id) for x in decontam.contaminated(docs, bench).collect()))
    assert got == [(-1, 5)] * 2 + [(1, 5)] * 4


def test_edited_copies_of_a_hot_item_are_found(spark):
    r = random.Random(16)
    item = [f"w{r.randrange(10**6)}" for _ in range(40)]
    texts = [" ".join(item)] * 60
    for step in (4, 5, 6):  # every gram that these break is rarer than the grams they keep
        edited = [f"new{step}x{i}" if i % step == step - 1 else w for i, w in enumerate(item)]
        texts += ["before " + " ".join(edited) + " after"] * 3
    texts += [" ".join(item[:12]) + " and none of the rest"] * 5  # shares grams, not the item
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"other{i}" for i in range(40)))], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()} == {(i, 1) for i in range(69)}


# --- toxicity -------------------------------------------------------------------


def test_toxicity_finds_documents_and_sentences(spark, hard):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(500):
        text = [" ".join(r.choice(("sun", "rain", "tree", "river", "stone", "cloud")) for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            text[3] = "you are a " + r.choice(("vileword", "grimword", "vilewordish")) + " friend"
        rows.append((i, ". ".join(text) + "."))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(docs.where(~langid.held_out()), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, m).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) == (r.score >= 0.5) for r in got)
    for r in got:
        if r.predicted:
            (s,) = r.offending
            assert "word" in r.text[s.start : s.end]
    scored = {r.doc_id: r for r in toxicity.score(hard, m).collect()}
    assert len(scored) == len(HARD) and all(0 <= r.score <= 1 for r in scored.values()) and scored[0].score == scored[1].score == 0
    assert toxicity.score(hard.limit(0), m).count() == 0
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {0}


def _plain_toxicity(text, m):
    """The noisy-or by the definition, word by word."""
    low = (text or "").lower().encode()
    left = 1.0
    for sentence in re.split(rb"[.!?\n]", low):
        words = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in sentence).split()
        buckets = set()
        for w in words:
            codes = np.frombuffer(w, np.uint8)
            for n, size in ((0, len(w)), (4, 4), (5, 5)):
                if n == 0 or len(w) > n:
                    h = int(toxicity.K.run_hashes(codes, np.array([0]), np.array([size]))[0])
                    buckets.add(((h + n) & 0xFFFFFFFFFFFFFFFF) >> 46)
        told = [b for b in buckets if m.weights[b]]
        if told:
            left *= 1 - 1 / (1 + np.exp(-(sum(float(m.weights[b]) for b in told) + m.bias)))
    return 1 - left


def test_toxicity_against_brute_force():
    r = np.random.default_rng(24)
    m = toxicity.Model(np.where(r.random(toxicity.BUCKETS) < 0.3, r.normal(scale=1.5, size=toxicity.BUCKETS), 0).astype(np.float32), -2.0)
    p = random.Random(25)
    texts = [*HARD[:8], *(" ".join(p.choice(("vile", "vileness", "cloud", "été", "clouded.", "a!", "\n", "?", "42")) for _ in range(p.randint(0, 25))) for _ in range(200))]
    got = toxicity.score_batch(pa.array(texts), m)
    assert got == pytest.approx([_plain_toxicity(t, m) for t in texts], rel=1e-5, abs=1e-9) and len({round(x, 3) for x in got}) > 30


# --- personal data --------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def _plain_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and _luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()

    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_base_spans_against_plain_matching(spark):
    r = random.Random(8)
    pieces = ["a.b@c.d", "@", ".", "x", " ", "-", "+", "1", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456 78", "é", "😀", "a@b-c.d_e@f.g", "1.2.3.4.5", "%", "\n", "10.0.0.300"]
    texts = [*HARD[:-2], "9" * 50_000, "1." * 20_000, "a" * 50_000 + "@", "a@b" + ".c" * 20_000, *("".join(r.choices(pieces, k=r.randint(1, 12))) for _ in range(400))]
    got = {x.doc_id: x for x in pii.find(table(spark, texts)).select("doc_id", pii.joined(F.filter("spans", lambda s: s["base"])).alias("b")).collect()}
    assert all(got[i].b == _plain_spans(t) for i, t in enumerate(texts))


def test_added_kinds_need_their_checks(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 ok", "IBAN DE89 3704 0044 0532 0130 01 no", "ssn 123-45-6789", "part 123-45-6789", "visa card 4222222222222", "x 4222222222222"]
    got = [[s.kind for s in r.spans] for r in pii.find(table(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["iban"], [], ["ssn"], [], ["card13"], []]


def test_redaction(spark, hard):
    docs = table(spark, ["mail a.b@c.de or 10.0.0.1, +49 30 1234567", None, "", "card 4111 1111 1111 1111!", "nothing"])
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP], [PHONE]", None, "", "card [CARD]!", "nothing"]
    assert pii.redact(docs).columns == docs.columns and pii.find(hard.limit(0)).count() == 0 and pii.find(hard).count() == len(HARD)
    clash = docs.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("__t", "__m_email", "__g_card", "___all", "kind")])
    for out in (pii.redact(clash), pii.find(clash)):
        rows = out.collect()
        assert len(rows) == 5 and all(r[c] == "mine" for r in rows for c in ("__t", "__m_email", "__g_card", "___all", "kind"))


def test_pii_stays_in_the_engine(spark, hard):
    plan = pii.find(hard)._jdf.queryExecution().toString() + pii.redact(hard)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- tokens and packing ---------------------------------------------------------

PIECES = ["'", "s", "re", "ve", "ll", "'s", "'re", " ", "  ", "\n", "\t", " \n", "\xa0", "a", "é", "9", "٣", "½", "!", "_", "漢", "😀", "　", "'ll", "x'", "<|endoftext|>", "\x1c", "\x85", "Ⅷ"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokenizer_path())


def test_ids_equal_the_library(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 400)
    r = random.Random(9)
    texts = ["", *("".join(r.choices(PIECES, k=r.randint(0, 15))) for _ in range(4000)), "word and more words 12 it's " * 200, "no-break" * 300]
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.counts(texts).tolist() == [len(w) for w in want]
    got = collections.defaultdict(list)
    for row, ids in encoder.encode(texts):
        got[row] += ids.tolist()
    assert all(got[i] == w for i, w in enumerate(want))


def test_ids_survive_a_hash_that_always_collides(encoder, monkeypatch):
    monkeypatch.setattr(tokens.K, "run_hashes", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    e = tokens.Encoder(tokenizer_path())
    text = "some words, some more words"
    assert e.counts([text, "other"]).tolist() == [len(encoder.tokenizer.encode(t).ids) for t in (text, "other")]


def test_token_classes_equal_the_library(encoder):
    """The library's own pre-tokenizer agrees on the class of every code point."""
    from tokenizers import pre_tokenizers

    p = pre_tokenizers.ByteLevel(add_prefix_space=False)
    codes = [c for c in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 31)]]
    text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in codes)
    e = tokens.cut(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0]))
    assert [a for _, (a, _) in p.pre_tokenize_str(text)] == e.tolist()


def test_count_hard_rows(spark, hard, encoder):
    got = {r.doc_id: r for r in tokens.count(hard, tokenizer_path(), drop_text=True).collect()}
    for i, t in enumerate(HARD):
        n = len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert tokens.count(hard.limit(0), tokenizer_path()).count() == 0
    clash = tokens.count(hard.select("doc_id", "text", F.lit("mine").alias("__row"), F.lit("mine").alias("n_tokens"), F.lit("mine").alias("w")), tokenizer_path())
    assert clash.columns == ["doc_id", "text", "__row", "w", "n_bytes", "n_tokens", "over_limit"] and {(r["__row"], r.w, r.n_tokens) for r in clash.collect()} == {("mine", "mine", got[r].n_tokens) for r in got}
    twice = tokens.count(hard.unionAll(hard), tokenizer_path(), drop_text=True)  # repeated ids
    assert twice.count() == 2 * len(HARD) and sum(r.n_tokens for r in twice.collect()) == 2 * sum(r.n_tokens for r in got.values())


def test_counts_of_frequent_and_other_pretokens(spark, encoder, monkeypatch):
    """Pre-tokens that are sent to every task and those that are not give the library's counts."""
    monkeypatch.setattr(tokens, "FREQUENT", 20)
    r = random.Random(28)
    vocabulary = ["".join(r.choices("abcdefgé ", k=r.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(vocabulary[int(300 * r.random() ** 3)] for _ in range(r.randint(0, 80))) for _ in range(300)] + ["x <|endoftext|> y", "😀" * 100]
    docs = table(spark, texts).repartition(3)
    words, pieces = tokens.frequent(docs, tokenizer_path())
    assert 5 < len(words) <= 20 and pieces.tolist() == [len(encoder.tokenizer.encode(w).ids) for w in words.to_pylist()]
    got = {x.doc_id: x.n_tokens for x in tokens.count(docs, tokenizer_path(), drop_text=True).collect()}
    assert got == {i: len(e.ids) for i, e in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False))}


def test_other_tokenizers_by_their_library(spark, hard):
    import sentencepiece

    few = hard.where("doc_id < 8")
    got = {r.doc_id: r.n_tokens for r in tokens.count(few, tokenizer_path("piece_bpe_32k.model")).collect()}
    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert got == {i: len(m.encode(HARD[i] or "")) for i in range(8)}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_respects_every_capacity(rule):
    r = random.Random(10)
    histogram = collections.Counter(r.randint(1, 64) for _ in range(3000))
    p = packing.plan(histogram, 64, documents=6, cost=2200 + 64 * 64, rule=rule)
    bins = collections.defaultdict(list)
    placed = collections.Counter()
    for length, rank, count, sequence, offset in zip(p.length, p.rank, p.count, p.sequence, p.offset, strict=True):
        for k in range(count):
            bins[sequence + k].append((offset, length))
            placed[length, rank + k] += 1
    assert set(placed) == {(n, k) for n, c in histogram.items() for k in range(c)} and set(placed.values()) == {1}
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
        assert sum(n for _, n in b) <= 64 and len(b) <= 6 and sum(n * n for _, n in b) <= 2200 + 64 * 64
    assert len(bins) == p.sequences <= 1.1 * sum(n * c for n, c in histogram.items()) / 64 + 600


def test_packing_round_trip(spark, hard, encoder):
    rows = packing.pack(hard, tokenizer_path(), capacity=128).collect()
    pieces, sequences = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(HARD):
        ids = np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        bounds = packing.piece_bounds(len(ids), 128)
        assert sorted(pieces[i]) == list(range(len(bounds) - 1))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            r = pieces[i][k]
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    for b in sequences.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 128
    assert packing.pack(hard.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("limits", [{"documents": 3}, {"cost": 40 * 40}, {"documents": 5, "cost": 60 * 60, "rule": "dot"}])
def test_every_capacity_binds_in_pack(spark, limits):
    r = random.Random(29)
    docs = table(spark, [" ".join(["tree"] * r.randint(0, 36)) for _ in range(200)])
    free = {x.sequence_id for x in packing.pack(docs, tokenizer_path(), capacity=128).collect()}
    sequences = collections.defaultdict(list)
    for x in packing.pack(docs, tokenizer_path(), capacity=128, **limits).collect():
        sequences[x.sequence_id].append(x.length)
    assert sum(map(len, sequences.values())) == 200 and len(sequences) > len(free)
    most, cost = limits.get("documents", 200), limits.get("cost", 128 * 128)
    assert max(map(len, sequences.values())) <= most and max(sum(n * n for n in b) for b in sequences.values()) <= cost
    full = sum(len(b) == most or sum(n * n for n in b) + min(b) ** 2 > cost for b in sequences.values())
    assert full > len(sequences) / 3  # the limit, not the tokens, ends many sequences
