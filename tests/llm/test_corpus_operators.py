import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import common, components, dedup, jaccard, langid, mixing, pii, quality, toxicity


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(docs, empty):
    rows = dedup.exact_groups(dedup.keys(docs)).collect()
    groups = collections.defaultdict(list)
    for d in docs.collect():
        groups[norm(d.text)].append(d.doc_id)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(rows) == docs.count()
    for r in rows:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min(ids, key=lambda i: (i is None, i))
    assert sum(r.kept for r in rows) == len(groups)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns and collections.Counter(norm(r.text) for r in kept.collect()) == dict.fromkeys(groups, 1)
    assert dedup.drop_copies(empty).count() == 0


def test_of_copies_without_ids_one_stays(spark):
    rows = [(None, "a  b"), (None, "a b"), (None, "c"), (None, "c"), (4, "c"), (None, "d"), (5, "e"), (5, "e"), (5, "f")]
    found = dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((norm(r.text), r.doc_id) for r in found) == [("a b", None), ("c", 4), ("d", None), ("e", 5), ("f", 5)]


def test_mixing(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 5, 60, 400]), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(3000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copies(many).collect()
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1, 5], strict=True))
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    for s in sizes:
        mine = [r for r in found if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 2 * 400
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.copies(many.repartition(7)).collect()), key=str)
    assert mixing.mix(many).count() == sum(r.copies for r in found)
    assert mixing.copies(docs).count() == docs.count() and mixing.mix(docs).columns == docs.columns
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_carries_copies_by_row(spark):
    rows = [(None if i % 3 else i % 7, "w " * i, rng) for i, rng in enumerate(["a", "a", "b", "c", None] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter({(r.source, r.size): r.copies for r in mixing.copies(table).collect() if r.copies})
    assert collections.Counter((r.source, len(r.text.split())) for r in mixing.mix(table).collect()) == want
    assert 0 < len(want) < len(rows)


def test_near_duplicates_go_by_row(spark):
    text = lambda k, end: " ".join(f"{k}w{i}" for i in range(60)) + f" {end}"
    rows = [(3, text("a", "x")), (5, text("a", "y")), (5, text("b", "x")), (None, text("c", "x")), (None, text("c", "y")), (None, text("c", "z")), (None, text("d", "x"))]
    rows += [(8, text("e", "x")), (8, text("e", "x")), (None, text("e", "y")), (9, text("f", "x")), (9, text("g", "x")), (None, ""), (None, None)]
    found = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, (r.text or "")[:2]) if r.doc_id else (0, (r.text or "")[:2]) for r in found)
    assert got == sorted([(3, "aw"), (5, "bw"), (0, "cw"), (0, "dw"), (8, "ew"), (9, "fw"), (9, "gw"), (0, ""), (0, "")])


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(texts):
    ids, sets = list(texts), {i: shingles(t) for i, t in texts.items()}
    name = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if n == old else n for i, n in name.items()}
    return name, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("rare,rounds", [(8, 2), (2, 0)])
def test_jaccard_against_brute_force(spark, monkeypatch, rare, rounds):
    # Without star rounds and with few nodes for an n-gram, the later orders give most pairs.
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefg", k=3))
    base = [[word() for _ in range(rng.choice([3, 5, 8, 30, 80, 150]))] for _ in range(25)]
    common_part = [word() for _ in range(60)]
    texts = {}
    for i in range(360):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = word()
        if i % 3 == 0:
            words += common_part
        texts[i * 7 + 1] = " ".join(words) if i % 10 else " ".join(words).upper()
    texts |= {5000: None, 5001: "", 5002: " \n", 5003: "a b", 5004: "A  b"}
    want, sizes = brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = jaccard.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want and {r.doc_id: r.n_shingles for r in found} == sizes
    assert {r.doc_id for r in jaccard.drop_near_duplicates(docs).collect()} == set(want.values())


def passage_texts(seed, n):
    """Few passages that crowds of texts share, with a few words of each text's own."""
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.choice([6, 10, 14, 14, 20, 34]))] for k in range(rng.choice([5, 9]))]
    texts = {}
    for i in range(n):
        words = []
        for passage in rng.sample(passages, rng.choice([1, 1, 1, 2, 2, 3])):
            words += passage[: len(passage) - rng.choice([0, 0, 0, 1, 2])]
        for _ in range(rng.choice([0, 1, 2, 3])):
            words.insert(rng.choice([0, len(words), len(words), rng.randrange(len(words))]), f"o{rng.randrange(n // 4)}")
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("rare,rounds,seed,n", [(rare, rounds, 10 * rare + rounds, 260) for rare in (1, 2, 8) for rounds in (0, 1, 2)] + [(8, 2, 1, 1000), (8, 0, 2, 1000)])
def test_jaccard_of_shared_passages(spark, monkeypatch, rare, rounds, seed, n):
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    # The combination that ships and the one without help also run over many texts.
    texts = passage_texts(seed, n)
    want, _ = brute_components(texts)
    found = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_jaccard_rows_without_own_ids(spark):
    """Rows of one id, or of none, are as much work as others."""
    texts = list(passage_texts(4, 400).values())
    names = lambda found: collections.Counter(r.n_shingles for r in found)
    table = lambda ids: spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    rows = jaccard.near_duplicates(table(range(400))).collect()
    for ids in ([None] * 400, [7] * 400):
        found = jaccard.near_duplicates(table(ids)).collect()
        assert names(found) == names(rows) and {r.component_id for r in found} == {ids[0]}
    kept = jaccard.drop_near_duplicates(table([None] * 400))
    assert kept.count() == len({r.component_id for r in rows})
    again = spark.createDataFrame([(1, texts[0])] * 50 + [(2, texts[0] + " x")], "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(again).collect()} <= {1, 2}


def test_jaccard_edges(docs, empty):
    rows = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert rows[1].component_id == rows[2].component_id == 0 and rows[8].component_id == 7
    assert rows[3].n_shingles == rows[4].n_shingles == rows[5].n_shingles == 0 and rows[4].component_id == 4
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.drop_near_duplicates(docs).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (7, 7)]
    found = {r.vertex: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(41)}) == 1 and found[100] == found[80] != found[0]


def test_forward_sums_all_segmentations():
    known = langid.pieces(langid.public_tokenizers.path(langid.VOCABULARY))
    rng = np.random.default_rng(1)
    table = rng.random((len(known.names) + 1, 2)) / 100
    table[-1] = 0
    at = {n: i for i, n in enumerate(known.names)}

    def brute(word, k):
        return 1.0 if not word else sum(table[at[word[:n]], k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in at)

    words = [b"thing", b"a", "été".encode(), b"zzqzzqzzqzz"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    logs = langid.log_sums(known, table, data, ends - [len(w) for w in words], ends)
    for w, row in zip(words, logs, strict=True):
        assert row == pytest.approx([math.log(brute(b" " + w, k)) for k in (0, 1)])


def test_long_pieces_and_long_words_count():
    known = langid.pieces(langid.public_tokenizers.path(langid.VOCABULARY))
    piece = max((n for n in known.names if n.startswith(b" ")), key=len)
    table = np.full((len(known.names) + 1, 2), 1e-7)
    table[-1] = 0
    at = known.names.index(piece)
    table[at, 0] = 0.5
    data = np.frombuffer(piece[1:], np.uint8)
    logs = langid.log_sums(known, table, data, np.array([0]), np.array([len(data)]))
    assert len(piece) > 12 and logs[0, 0] == pytest.approx(math.log(0.5), abs=1e-3) and logs[0, 1] < -10
    counts = langid.expected_counts(known, table, [piece[1:], "\u0430".encode() * 4000], np.array([[3.0, 0.0], [0.0, 1.0]]))
    assert counts[at, 0] == pytest.approx(3, rel=1e-3) and np.isfinite(counts).all()
    sizes = np.array([len(n) for n in known.names])
    assert sizes @ counts[:, 1] == pytest.approx(8001)


def test_long_words_take_the_same_sums(monkeypatch):
    known = langid.pieces(langid.public_tokenizers.path(langid.VOCABULARY))
    table = np.random.default_rng(2).random((len(known.names) + 1, 3)) / 1000
    table[-1] = 0
    words = ["thethingandthatotherhouse" * 3, "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c" * 9, "stra\u00dfe"]
    raw = [w.encode() for w in words]
    data, ends = np.frombuffer(b" ".join(raw), np.uint8), np.cumsum([len(w) + 1 for w in raw]) - 1
    starts, weights = ends - [len(w) for w in raw], np.array([[1.0, 2, 0], [0, 1, 1], [3, 0, 1]])
    short = langid.log_sums(known, table, data, starts, ends), langid.expected_counts(known, table, raw, weights)
    monkeypatch.setattr(langid, "LONG_WORD", 0)
    long = langid.log_sums(known, table, data, starts, ends), langid.expected_counts(known, table, raw, weights)
    np.testing.assert_allclose(short[0], long[0])
    np.testing.assert_allclose(short[1], long[1], atol=1e-9)


def test_words_end_at_other_than_letters():
    texts = ["Se\u00f1or\u2014\u00a0ABC,d1e", None, "\u4e2d\u6587\u3002\u0e01\u0e34\u0e19", "12 !", "a"]
    data, start, end, doc, has = langid.words_of(pa.array(texts))
    found = [(int(d), data[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc, strict=True)]
    assert found == [(0, "se\u00f1or"), (0, "abc"), (0, "d"), (0, "e"), (2, "\u4e2d\u6587"), (2, "\u0e01\u0e34\u0e19"), (4, "a")]
    assert has == [True, False, True, False, True]


def test_one_megabyte_without_blanks(spark):
    rng = random.Random(1)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(n))
    kana = lambda n: "".join(chr(rng.randrange(0x3041, 0x3090)) for _ in range(n))
    rows = [(i, (han if i % 2 else kana)(300), "zh" if i % 2 else "ja") for i in range(40)] + [(99, han(350_000), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    began = time.time()
    found = {r.doc_id: r.lang_pred for r in langid.predict(table, langid.fit(table)).collect()}
    assert time.time() - began < 180 and found[99] == "zh" and all(found[i] == ("zh" if i % 2 else "ja") for i in range(40))


def test_language_learns_and_handles_edges(spark, docs, empty):
    en, fr = "the thing with that other house and of them", "la maison avec une autre chose pour les gens"
    rng = random.Random(2)
    text = lambda s: " ".join(rng.choices(s.split(), k=30))
    rows = [(i, text(en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(200)] + [(900, None, "en"), (901, "12 !", "en"), (902, "x" * 5000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(table, langid.fit(table)).collect()}
    assert all(found[i].lang_pred == ("en" if i % 2 else "fr") for i in range(200))
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[902].lang_pred in ("en", "fr")
    assert langid.predict(docs, langid.fit(empty)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict(empty, None).count() == 0


def luhn(digits):
    x = [int(c) for c in digits][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(x)) % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def test_base_spans_equal_the_plain_rules(spark, docs, empty):
    rng = random.Random(4)
    parts = ["a.b@c.d_e@f.g", "x@y", "@", "é4111 1111-1111 1111", "1.2.3.4.5.6.7.8", "0001.02.3.255", "256.1.1.1", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 ++49 30 1234567", "1" * 40, "4111111111111111  4111111111111111", "-", ".", " ", "中"]
    texts = {i: "".join(rng.choices(parts, k=rng.randrange(6))) for i in range(300)} | {900: None, 901: "9" * 60_000, 902: "a" * 60_000 + "@"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.find(table).collect():
        want = [(k, m.start(), m.end()) for k, (p, ok) in RULES.items() for m in re.finditer(p, (texts[r.doc_id] or "")[:3000]) if ok(m[0])]
        assert [tuple(x) for x in r.base] == want
    assert pii.find(docs).count() == docs.count() and pii.find(empty).count() == 0


def test_secrets_are_added_and_redacted(spark):
    rows = [(i, f'plain words {i} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" more') for i in range(50)]
    rows += [(100 + i, f"version {i}.0 of the catalogue number abcdefghijklmn{i}") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(table).collect()}
    assert all([x.kind for x in found[i].all] == ["secret"] and not found[100 + i].all for i in range(50))
    assert pii.redact(table).filter("doc_id = 3").collect()[0].text == 'plain words 3 token = "<secret>" more'


def test_overlapping_candidates(spark):
    # Which candidates are free and which of them stay, against plain loops.
    rng = random.Random(3)
    scores = {k: k / 10 for k in range(1, 8)}
    rows = []
    for i in range(200):
        base, found = [], []
        for kind in pii.BASE + pii.EXTRA:
            at = rng.randrange(30)
            while at < 300 and rng.random() < 0.8:
                end = at + rng.randrange(1, 40)
                base.append((kind, at, end)) if kind in pii.BASE else found.append((kind, at, end, rng.randrange(1, 10), True))
                at = end + rng.randrange(60)
        rows.append((i, base, found))
    schema = "doc_id long, base array<struct<kind:string,s:int,e:int>>, found array<struct<kind:string,s:int,e:int,cell:int,cued:boolean>>"
    table = common.written(spark.createDataFrame(rows, schema), "overlaps")
    out = common.written(table.select("doc_id", pii.free_of(F.col("base"), F.col("found")).alias("free")), "free")
    for r in out.select("doc_id", "free", pii.resolved(F.col("free"), scores).alias("kept")).collect():
        _, base, found = rows[r.doc_id]
        free = [c for c in found if not any(b[1] < c[2] and c[1] < b[2] for b in base)]
        assert sorted(map(tuple, r.free)) == sorted(free)
        kept = []
        for kind, a, b, cell, _ in sorted(free, key=lambda c: (c[1], c[2])):
            if cell in scores:
                if not kept or a >= kept[-1][2]:
                    kept.append((kind, a, b, cell))
                elif scores[cell] > scores[kept[-1][3]]:
                    kept[-1] = (kind, a, b, cell)
        assert [tuple(x) for x in r.kept] == [k[:3] for k in kept]


def test_very_many_candidates_in_one_text(spark):
    text = " ".join(f"abcdefghij{i:06d}" for i in range(100_000)) + " a@b.cc"
    began = time.time()
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in found[0].base] == [("email", len(text) - 6, len(text))] and time.time() - began < 120
    places = spark.createDataFrame([(text,)], "text string").select(pii.spans(F.col("text"), pii.SECRET, F.lit(True)).alias("x")).selectExpr("transform(x, y -> y.s) as s").collect()[0].s
    assert places == [17 * i for i in range(100_000)]


def test_classifiers(spark, docs, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 80))]
        junk, bad = i % 4 == 0, i % 5 < 2
        if i % 5 == 0:
            words[3:3] = ["insult", "them"]
        elif bad:
            words[5:5] = ["horrid"]
        elif i % 5 == 2:
            words[3:3] = ["insult"] if i % 2 else ["them"]
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words)))
        labels.append((i, int(not junk), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(labels + [(None, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    good = quality.score(table, quality.fit(table, given)).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in good if r.held_out]) > 0.95
    toxic = toxicity.score(table, toxicity.fit(table, given)).collect()
    assert np.mean([r.predicted == (r.doc_id % 5 < 2) for r in toxic if r.held_out]) > 0.9
    for module in (quality, toxicity):
        model = module.fit(table, given)
        edge = module.score(docs, model).collect()
        assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
        assert module.score(docs, module.fit(docs, given.limit(0))).count() == docs.count()
        assert module.score(empty, module.fit(empty, given)).count() == 0
    assert quality.keep_good(docs, None).count() == docs.count()


def test_votes_against_plain_cosines():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(120)] + ["", None, "A! " * 40]
    raw = quality.term_matrix(pa.array(texts[:100]))
    weights = np.random.default_rng(3).random(raw.shape[1]).astype(np.float32)
    basis = np.linalg.qr(np.random.default_rng(4).random((raw.shape[1], quality.RANK)))[0].astype(np.float32)
    model = quality.Model(weights, basis, np.zeros((0, 0)), np.array([float(i % 3 > 0) for i in range(100)], np.float32), 0.6, (2.0, 0.7))
    model.vectors = np.ascontiguousarray(quality._vectors(raw, model).T)
    found = quality.scores_of(model, pa.array(texts))
    for text, score in zip(texts, found, strict=True):
        own = (quality.term_matrix(pa.array([text], pa.string()))[0].astype(float) * weights) @ basis
        cosines = []
        for i in range(100):
            other = (raw[i].astype(float) * weights) @ basis
            cosines.append((float(own @ other) / max(1e-9, np.linalg.norm(own)) / np.linalg.norm(other), i))
        votes = [(max(1e-6, c) ** quality.POWER * model.balance[int(model.labels[i])], model.labels[i]) for c, i in sorted(cosines, reverse=True)[: quality.NEIGHBOURS]]
        assert score == pytest.approx(sum(v * label for v, label in votes) / sum(v for v, _ in votes), abs=2e-3)


@pytest.mark.parametrize("rule", ["xor", "and"])
def test_pairs_that_are_toxic_only_together(spark, rule):
    # Through fit: each word alone is balanced between the labels, or nearly so.
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(12)] + ["them"] * a + ["vermin"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int((a != b) if rule == "xor" else (a and b))))
    table, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, given)
    want = {i: t for i, _, t in labels}
    found = toxicity.score(table, model).collect()
    assert np.mean([r.predicted == want[r.doc_id] for r in found if r.held_out]) > 0.95
    # Scores against a plain double loop over pairs.
    by_id = dict(rows)
    for r in found[:40]:
        doc, slot = toxicity.present(np.frombuffer(by_id[r.doc_id].encode(), np.uint8), np.array([0, len(by_id[r.doc_id])]))
        terms = [model.place[x] for x in slot if model.place[x] >= 0]
        logit = model.bias + sum(model.linear[t] for t in terms)
        logit += sum(float(model.factors[s] @ model.factors[t]) for k, s in enumerate(terms) for t in terms[k + 1 :])
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)


def test_checked_broadcast_falls_back(spark):
    side = spark.range(10)
    assert "broadcast" not in common.checked_broadcast(side, 100)._jdf.queryExecution().logical().toString().lower()
