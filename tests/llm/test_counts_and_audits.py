import collections
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pacegrid.llm import filteraudit, tokencount, whitening

PATH = public_tokenizers.path(tokencount.TOKENIZER)
WHOLE = Tokenizer.from_file(PATH)


def plain_count(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1,.;' \n\t\x0b\x1c ́É中Å<|>", max_size=40), max_size=6), st.integers(1, 5), st.integers(1, 40))
def test_counts_by_part(texts, size, kept):
    count = tokencount.Counter(PATH, kept)
    texts = [*texts, "ab<|endoftext|>cd", "x" * size + "<|startoftext|>"]
    for _ in range(2):
        assert count([t.encode() for t in texts]) == [plain_count(t) for t in texts]
    for text in texts:
        assert "".join(tokencount.safe_parts(text, size)) == text
        assert sum(plain_count(p) for word in text.encode().split() for p in tokencount.safe_parts(word.decode(), size)) == plain_count(text)


def test_kinds_of_tokenizers():
    assert tokencount.parted(PATH)
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        assert not tokencount.parted(path)
        texts = ["two  words\n here 12", "", "a" * 5000]
        assert tokencount.Counter(path)([t.encode() for t in texts]) == [tokencount.counter(path)([t])[0] for t in texts]


def test_batches_of_equal_bytes():
    found = list(tokencount.batches(["a" * n for n in (5, 5, 30, 1, 1, 9, 9)], 11))
    assert [sum(map(len, b)) for b in found] == [10, 30, 11, 9] and sum(found, []) == ["a" * n for n in (5, 5, 30, 1, 1, 9, 9)]
    assert not list(tokencount.batches([]))


def test_token_rows(spark, docs, empty):
    rows = tokencount.count_tokens(docs, PATH).collect()
    want = [(d.doc_id, len((d.text or "").encode()), plain_count(d.text)) for d in docs.collect()]
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in rows] == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and any(r.over_limit for r in rows)
    assert tokencount.count_tokens(empty, PATH).count() == 0
    long = "ab1" * 100_000 + "x" * 200_000 + ", end"
    one = tokencount.count_tokens(spark.createDataFrame([(1, long)], "doc_id long, text string"), PATH).first()
    assert one.n_tokens == plain_count(long)


def plain_whitening(vectors):
    """(x, n, S, unit vectors, values) with numpy alone."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, len(fit), fit.sum(axis=0), vectors[:, ::-1], values[::-1]


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.3, 20)
    vectors = [*base.astype(np.float32).tolist(), *([base[0].astype(np.float32).tolist()] * 100)]
    broken = [(900, None, 1), (901, [None] * 20, 1), (902, [float("nan")] * 20, 1), (903, [1.0] * 19 + [float("inf")], 1), (904, [1.0] * 3, 1), (905, [], 1), (906, [1e30] * 20, 1)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + broken + [(None, vectors[5], 0), (7, vectors[7], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int").repartition(5)
    found = whitening.whitened(table).collect()
    x, n, total, axes, values = plain_whitening([v for _, v, _ in rows if v is not None and len(v) == 20 and all(c is not None and abs(c) < 2**40 for c in v)])
    assert len(found) == 16 * len(x) and n == 300
    by_id = collections.defaultdict(dict)
    for r in found:
        if r.vec_id not in (7, None):
            by_id[r.vec_id][r.component] = r
    assert collections.Counter(r.vec_id for r in found)[7] == 32 and collections.Counter(r.vec_id for r in found)[None] == 16
    whole = (x - total / n) @ axes / np.sqrt(values)
    signs = np.sign([by_id[0][k].whitened * whole[0, k - 1] for k in range(1, 17)])
    for i in by_id:
        for k, r in by_id[i].items():
            assert r.whitened == pytest.approx(signs[k - 1] * whole[i, k - 1], abs=1e-8)
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total, strict=True))
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    rows = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), r.n) for r in rows) == [(1, 1, 1.0, 2), (2, 1, 1.0, 2), (2, 1, 1.0, 2)]
    assert all(r.explained == pytest.approx(1) for r in rows)
    big = whitening.whitened(spark.createDataFrame([(1, [1e11, 0.0]), (2, [0.0, 0.0])], schema)).collect()
    assert len(big) == 2 and all(r.deviation is None for r in big)


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = collections.defaultdict(collections.Counter)
    orders = ["".join(o) for o in itertools.permutations("ABCDE")]
    fails = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        said = "A" * (len(words) < 200) + "B" * (2 * len(set(words)) < len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        said += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > first[t])
        fails.append((s or "", said, any(a == i and q == 1 for a, q, _ in labels if i is not None), any(a == i and x == 1 for a, _, x in labels if i is not None)))
    for order in orders:
        for step in range(1, 6):
            f, before = order[step - 1], order[: step - 1]
            for part, said, good, toxic in fails:
                row = out[part, order, step]
                gone = any(b in said for b in before)
                row["kept"] += not gone and f not in said
                row["removed"] += not gone and f in said
                row["redundant"] += gone and f in said
                row["unique_fails"] += said == f
                row["good_lost"] += not gone and f in said and good
                row["toxic_lost"] += not gone and f in said and toxic
    for (part, order, step), row in out.items():
        row["shapley"] = sum(out[part, o, o.index(order[step - 1]) + 1]["removed"] for o in orders)
    return out


def test_filter_audit(spark, empty):
    rng = random.Random(2)
    texts = ["", None, " ", "Few words", "few words", "few # words", "w " * 250, " ".join(map(str, range(220))), "A B " * 120, " ".join(f"w{i}" for i in range(300)) + " 5%", "été ÀÉ 中" * 3]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None])) for _ in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(20), *range(5), None]]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, mask int, label string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filteraudit.audit(table, known).collect()
    want = plain_audit(docs, labels)
    assert len(found) == len(want) == 3 * 600
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert all(tuple(r[c] for c in names) == tuple(want[r.part, r.filter_order, r.step][c] for c in names) for r in found)
    assert filteraudit.audit(empty, known).count() == 0
    assert filteraudit.audit(table, known.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
