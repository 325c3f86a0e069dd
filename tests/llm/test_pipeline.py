import os
from collections import Counter

from test_documents import plain_components, plain_fingerprint, toxic_rows

import corpus_pipeline
from barwright.llm import mixing, secrets, simhash, tokens, toxicity


def test_stages_against_plain_versions(spark, documents, tmp_path):
    rows, labels = toxic_rows(300)
    rows += [(1000 + i, rows[i][1], "en", "b") for i in range(0, 60, 3)]
    rows += [(2000, "a token = abcdefgh1234 in some other text of its own", "en", "b"), (2001, None, "en", None)]
    df = documents(rows, clash=False)
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = toxicity.train(df, lab)
    want = [r for r, f in zip(rows, toxicity.features([r[1] for r in rows]), strict=True) if model.score(f) < 0.5]
    classes = plain_components([r[0] for r in want], [plain_fingerprint(r[1]) for r in want])
    unique = [r for r, c in zip(want, classes, strict=True) if r[0] == c]
    clean = [(d, secrets.redact_text(t), *more) for d, t, *more in unique]
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:3], (want, unique, clean), strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == df.columns, name
        assert Counter((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()) == Counter(map(tuple, kept)), name
    assert len(want) < len(rows) and len(unique) < len(want) and clean != unique

    taken = {r.doc_id: r.taken for r in mixing.placed(docs).collect()}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert mixed.columns == df.columns
    texts = [(r.doc_id, r.text) for r in mixed.collect()]
    words = Counter()
    for d, t in texts:
        words[d] += len(t.split())
    assert words == Counter({d: n for d, n in taken.items() if n})

    packed = corpus_pipeline.run(spark, folder).collect()
    encode = tokens.encoder(tokens.default_path("word_bpe_49k.json"))
    assert sum(r.length for r in packed) == sum(len(i) + 1 for i in encode([t for _, t in texts]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert simhash.WORDS == 4 and os.path.isdir(folder)
