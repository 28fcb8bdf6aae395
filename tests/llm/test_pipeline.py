"""The pipeline against brute-force stages on a small fixture."""

import random
import shutil

import corpus_pipeline
from tests.llm.test_decontamination import plain_best, vocabulary
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_secrets import brute as secret_brute
from viaduct.llm import packing
from viaduct.llm.common import words


def fixture(spark, folder):
    rng = random.Random(8)
    some = vocabulary(rng)
    bench = [" ".join(some(25)) for _ in range(6)]
    texts = [" ".join(some(rng.randint(20, 120))) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", None, "", "123 !!", "say " + bench[2] + " now", "token=deadbeefdeadbeef00 in here", "x " * 9000]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(enumerate(texts)), bench


def test_pipeline(spark, tmp_path):
    texts, bench = fixture(spark, tmp_path)
    kept = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    first = near_brute(kept)
    kept = {i: t for i, t in kept.items() if first[i] == i}
    kept = {i: t for i, t in kept.items() if all(plain_best(words(b), words(t)) > 0.2 * 25 for b in bench)}
    for i, t in kept.items():
        hidden = {k for a, _, b in secret_brute(t) for k in range(a, b)}
        kept[i] = "".join("" if k in hidden and k - 1 in hidden else "[SECRET]" if k in hidden else c for k, c in enumerate(t))
    tokens = packing.words_of(None)
    want = {i: len(tokens.ids(t)) + 1 for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got: dict[int, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert 66 in got and 65 not in got and 60 not in got
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    told = corpus_pipeline.keep_identified(spark, docs, str(tmp_path)).collect()
    assert {r.lang for r in told} == {"en"} and len(told) == len([t for t in texts.values() if t and any(c.isalpha() for c in t)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
    shutil.rmtree(tmp_path)
