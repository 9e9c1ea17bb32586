"""The pipeline, stage by stage, against brute force over what its predecessor kept."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from lodeseam.llm import mixing, pii, quality
from tests.llm.test_native import base_spans, filled
from tests.llm.test_ngram_join import brute

COLUMNS = list(cp.COLUMNS)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(400)}"
    docs, labels = [], []
    for i in range(160):
        text = [word() for _ in range(int(rng.choice([6, 30, 90])))]
        if i % 8 == 0:
            text = [w + "$$" for w in text]
        if i % 8 == 1:
            text[::4] = ["vile"] * len(text[::4])
        if i % 8 == 2:
            text[2] = f"me{i}@mail.example.com"
        docs.append([i, " ".join(text), "en", ["a", "b", "c", None][int(rng.integers(4)) if i % 3 else 0], 0])
        labels.append((i, int(i % 8 != 0), int(i % 8 == 1)))
    for i in range(160, 200):
        near = docs[int(rng.integers(160))][1].split(" ")
        if i % 2 and len(near) > 60:
            near[3] = "changed"
        docs.append([i, " ".join(near), "en", "a", 0])
    docs += [[300, None, "en", "b", None], [301, "", None, None, 0], docs[5], docs[5]]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    kept = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, size string")
    kept.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = [kept.collect()]
    for name, stage in cp.STAGES:
        kept = stage(spark, kept, folder)
        path = f"{folder}/{name}"
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        if name != "tokens":
            assert kept.columns == COLUMNS
        out.append(kept.collect())
    return folder, out


def test_quality(spark, steps):
    folder, (docs, kept, *_) = steps
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    passes = lambda t: model.tails(pa.array([t or ""]))[0, -1] >= model.cut
    assert Counter(r[:5] for r in docs if passes(r.text)) == Counter(map(tuple, kept))
    assert {r.doc_id for r in kept if r.doc_id < 160} == {i for i in range(160) if i % 8 > 1}


def test_near_dups(steps):
    docs, kept = steps[1][1:3]
    parts = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in docs])}
    assert sorted(map(str, kept)) == sorted(map(str, {r for r in docs if parts[r.doc_id] == r.doc_id}))


def test_pii(steps):
    docs, kept = steps[1][2:4]
    got = {r.doc_id: r for r in kept}
    assert len(kept) == len(docs)
    for r in docs:
        text, out, at = r.text, "", 0
        for start, _, kind, end in base_spans(text or ""):
            if start >= at:
                out, at = out + text[at:start] + f"<{kind.upper()}>", end
        want = None if text is None else out + text[at:]
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == (None if want is None else len(want))


def test_mix(steps):
    docs, kept = steps[1][3:5]
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    size, got = Counter(), Counter()
    for r in docs:
        size[r.source] += words(r.text)
    for r in kept:
        got[r.source] += words(r.text)
    target = filled(size)
    assert all(abs(got[s] - target[s]) <= 1 for s in size)
    own, cut = {r.doc_id: r.text for r in docs}, defaultdict(int)
    for r in kept:
        assert own[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        cut[r.source] += own[r.doc_id] != r.text
    assert max(cut.values(), default=0) <= 1


def test_tokens_and_run(spark, steps):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    folder, out = steps
    want = sorted((r.doc_id, len(t := library.encode(r.text)), t) for r in out[4])
    assert sorted(map(tuple, out[5])) == want
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == want
    assert pii.KINDS[0].name == "email"


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_dups_with_shared_and_null_identifiers(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    near = lambda w: text(w) + " end"
    rows = [(3, text("a")), (5, near("a")), (5, text("b")), (8, text("c")), (8, near("c")), (None, text("d")), (None, near("d")), (None, near("b")), (9, None), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_dups_stage(spark, docs, "").collect()]
    kept = [x for x in got if x[1]]
    assert (3, text("a")) in kept and (5, text("b")) in kept and len(kept) == 4
    assert sorted((i, t.split()[0]) for i, t in kept if i is not None) == [(3, "a0"), (5, "b0"), (8, "c0")] and [t.split()[0] for i, t in kept if i is None] == ["d0"]
    assert sorted(map(str, (x for x in got if not x[1]))) == ["(9, None)", "(None, '')"]


def test_mix_with_shared_and_null_identifiers(spark):
    rows = [(i, " ".join(f"{c}{j}" for j in range(n))) for i, c, n in [(1, "a", 20), (1, "b", 5), (None, "c", 7), (None, "d", 11), (2, "e", 9), (2, "e", 9), (None, "f", 3), (None, "f", 3)]]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.mix_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    more = docs.union(spark.createDataFrame([(None, "x " * 40, "en", "b", 80)], docs.schema))
    got, size = cp.mix_stage(spark, more, "").collect(), Counter()
    for r in got:
        size[r.source] += len(r.text.split())
    want = filled({"a": sum(len(t.split()) for _, t in rows), "b": 40})
    assert all(abs(size[s] - want[s]) <= 1 for s in want)


def test_mix_is_written_in_order_of_position(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{i}" for _ in range(int(rng.integers(1, 40)))), "en", ["a", "b", "c", None][int(rng.choice(4, p=[0.1, 0.6, 0.2, 0.1]))], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    uses = [(p, r._row.doc_id) for r in mixing.mix_sources(cp.keyed(docs), "_row").collect() for p in r.positions]
    cp.mix_stage(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    parts = sorted(f for f in (tmp_path / "mix").iterdir() if f.suffix == ".parquet")
    got = [i for f in parts for i in spark.read.parquet(str(f)).toPandas()["doc_id"]]
    assert len(uses) > 300 and got == [i for _, i in sorted(uses)]
