from collections import Counter

import corpus_pipeline
from colloquy.llm import bpe, exact, mixing, ngram_join, quality


def test_stages_take_effect(spark, real):
    """Each stage's rows follow from its input by the operator's own report."""
    docs = spark.read.parquet(f"{real}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.materialise(stage(spark, docs, real))
        out.append(docs)
    source = spark.read.parquet(f"{real}/documents.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(out[0]) == ids(quality.judge(source).filter("kept"))
    assert ids(out[1]) == ids(exact.exact_groups(out[0]).filter("kept"))
    assert ids(out[2]) == ids(ngram_join.jaccard_components(out[1]).filter("doc_id = component_id"))
    taken = {r.doc_id: r for r in mixing.mix(out[2].select("doc_id", "source", mixing.word_count().alias("size")), "size", [3.0, 1.0, 2.0], 1.5).collect()}
    assert all(abs(ids(out[3])[d] * r["size"] - r.taken) <= r["size"] / 2 + 1 for d, r in taken.items())
    assert ids(out[4]) == ids(out[3]) and out[4].columns == [*source.columns, "n_tokens", "ids", "decoded"]
    model = bpe.WordBpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for r in out[4].limit(20).collect():
        assert model.encode(r.text) == (bytes(r.ids), r.decoded)
    assert all(o.columns == source.columns for o in out[:4])


def test_empty_table(spark, corpus):
    assert corpus_pipeline.run(spark, f"{corpus}/empty").count() == 0


def test_stages_on_repeats_nulls_and_clashing_names(spark):
    """Nulls in any column, repeated ids and rows, ties, and columns named as the stages' own."""
    body = " ".join(f"word{k % 61} tail{k % 7}" for k in range(90))
    rows = [(1, body, "en", "a")] * 4 + [(1, body.replace(" ", "  "), "en", "a"), (None, body + " extra", None, None), (None, None, "en", "b"), (2, "", None, "a"), (3, body[::-1], "en", None), (4, " ".join(f"u{k}" for k in range(400)), "en", "b")]
    names = ["key", "times", "rows", "whole", "id", "of_id", "row", "k0", "digest", "n", "_id", "_copy", "_stay", "t_lines", "ids", "Decoded"]
    df = spark.createDataFrame([(*r, len(r[1] or ""), *[7] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    kept = [Counter(tuple(r) for r in df.collect())]
    docs = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.common.materialise(stage(spark, docs, ""))
        assert docs.columns == df.columns, name
        kept.append(Counter(tuple(r) for r in docs.collect()))
        assert set(kept[-1]) <= set(kept[-2]), name
    assert all(len({r[1].replace(" ", "") for r in k}) == sum(k.values()) for k in kept[2:4])
    assert all(n <= 2 for n in kept[4].values())
    repeated = corpus_pipeline.common.materialise(corpus_pipeline.STAGES[3][1](spark, df, ""))
    assert all(n <= 2 * kept[0][r] for r, n in Counter(tuple(r) for r in repeated.collect()).items())
    coded = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert coded.columns == [*df.columns, "n_tokens", "ids_", "decoded_"] and coded.count() == sum(kept[4].values())
