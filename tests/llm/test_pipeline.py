import collections
import hashlib
import random
import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_corpus_operators import brute_components, norm
from test_text_operators import ENC

from pacegrid.llm import mixing, quality


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(rng.randrange(30, 70))]
        junk = i % 4 == 0
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        if i % 4 == 3:  # an exact copy up to blanks, a near copy or another text
            earlier = rows[rng.randrange(len(rows))][1]
            text = [earlier.replace(" ", "  "), earlier + " end", text][i % 3]
            junk = "!!" in text
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
        if i % 2:
            labels.append((i, int(not junk), 0))
    rows += [(None, None, None, None, None), (900, "", None, "b", 0)]
    folder = str(tmp_path)
    tables(spark, folder, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = spark.read.parquet(f"{folder}/labels.parquet")

    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.common.written(stage(spark, now, folder), name)
        assert now.columns == docs.columns
        seen[name] = now.collect()

    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, given)).collect()}
    by_id = {r[0]: r for r in rows}
    assert {r.doc_id for r in seen["quality"]} == {i for i in by_id if scores[i] >= 0.5} and len(seen["quality"]) < len(rows)
    assert all("!!" not in (r.text or "") for r in seen["quality"])

    groups = collections.defaultdict(list)
    for r in seen["quality"]:
        groups[norm(r.text)].append(r.doc_id)
    kept = {min(ids, key=lambda i: (i is None, i)) for ids in groups.values()}
    assert {r.doc_id for r in seen["exact_dedup"]} == kept and len(seen["exact_dedup"]) == len(groups) < len(seen["quality"])

    texts = {r.doc_id: r.text for r in seen["exact_dedup"] if r.doc_id is not None}
    names, _ = brute_components(texts)
    assert {r.doc_id for r in seen["near_dedup"] if r.doc_id is not None} == set(names.values())
    assert len(seen["near_dedup"]) < len(seen["exact_dedup"])

    near = corpus_pipeline.common.written(spark.createDataFrame(seen["near_dedup"], docs.schema), "near")
    want = {r.doc_id: r.copies for r in mixing.copies(near).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in seen["mix"]) == want

    found = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter(r.doc_id for r in found) == want
    for r in found:
        text = by_id[r.doc_id][1] or ""
        assert r.token_ids == ENC.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert public_tokenizers.path(corpus_pipeline.bpe.RANKS)


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_nothing_is_rejected(spark, docs, tmp_path):
    folder = str(tmp_path / "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} <= {0, 3, 6, 7, 9, None} and len({r.doc_id for r in found}) >= 4


def test_quality_fit_holds_the_sample_once():
    """The driver held several wide copies of the sampled rows' shares at once: 133 MB for these rows."""
    draw = np.random.default_rng(1)
    raw = (draw.random((3000, quality.SHAPES + quality.WORDS), dtype=np.float32) * (draw.random((3000, 1)) < 0.9)).astype(np.float16)
    rows = pa.table({"id": pa.array(draw.permutation(3000)), "label": pa.array(draw.integers(0, 2, 3000), pa.int32()), "raw": pa.array([r.tobytes() for r in raw], pa.binary())})
    tracemalloc.start()
    model = quality.model_of(rows, {0: 2000, 1: 1000})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110e6
    placed = raw[np.argsort(rows["id"].to_numpy())].astype(np.float32) * model.weights
    assert np.array_equal(model.vectors, quality._unit(placed @ model.basis).T)
    assert np.array_equal(model.labels, rows.sort_by("id")["label"].to_numpy())
