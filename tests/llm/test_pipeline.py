import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from meshlark.llm import quality_rules  # noqa: E402

from .test_ops import WORDS, brute_components, brute_counts  # noqa: E402


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(60, 90))) for _ in range(40)]
    texts += [texts[k].replace(" ", "  ", 3) for k in range(5)] + [texts[9] + " w1", "short", None, " ".join(["bad###"] * 3 + rng.choices(WORDS, k=60))]
    texts += [" ".join(w + "***" for w in rng.choices(WORDS, k=70)) for _ in range(25)]
    texts[20] += " password = hunter2hunter2"
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, int("***" not in (t or "")), 0) for k, t in enumerate(texts) if k % 2], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    def passes(t):
        n, _, symbols, _, repeat = brute_counts(t)
        return n >= 50 and 2 * repeat <= n and symbols / n < 0.5

    kept = [(i, t) for i, t, *_ in rows if passes(t)]
    comp = brute_components(kept, 5, 80, 100)
    want = {i for i, _ in kept if comp[i] == i}
    docs, steps = df, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        steps.append((name, docs))
    assert [s for s, _ in steps] == ["quality_rules", "ngram_join", "secret_scan", "packing"]
    assert all(d.columns == df.columns for _, d in steps[:-1])
    assert {r.doc_id for r in steps[0][1].collect()} == {i for i, _ in kept}
    assert {r.doc_id for r in steps[1][1].collect()} == want
    masked = {r.doc_id: r for r in steps[2][1].collect()}
    assert "hunter2" not in masked[20].text and masked[20].n_chars == len(masked[20].text)
    assert {r.doc_id for r in steps[3][1].collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps[3][1].count()
    assert quality_rules.MIN_WORDS == 50
