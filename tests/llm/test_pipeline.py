import sentencepiece

import corpus_pipeline
from lakeloom.llm import pieces, surrogates, toxicity
from lakeloom.llm.queries import labels, remainder


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "pieces"]
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
        if name != "pieces":
            assert docs.columns == columns
    clean, single, private, mixed, coded = kept
    model = toxicity.fit(spark.read.parquet(f"{small}/documents.parquet"), labels(spark, small), remainder(3) != 1)
    everything = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert sorted(clean) == sorted(r for r in everything if model.score(r.text) < 0.7)
    # Of each class of near copies the least id stays.
    sets = {r.doc_id: shingles(r.text) for r in clean}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in single) == sorted({find(i) for i in ids})
    texts = {r.doc_id: r.text for r in single}
    assert {r.doc_id: r.text for r in private} == {i: surrogates.replaced(t, surrogates.KEY, {})[0] for i, t in texts.items()}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in private} and len(mixed) > len(private)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in mixed}
    assert len(coded) == len(mixed)
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in coded)


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "ids"] and out.count() > 0


def test_stages_on_an_empty_table(spark, small, empty):
    docs = empty.drop("chunk")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
        if name != "pieces":
            docs = out
