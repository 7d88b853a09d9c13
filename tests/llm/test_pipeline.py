"""The whole pipeline against plain versions of its stages."""

import corpus_pipeline
from brute import fails, jaccard, masked, sha

from maskwright.llm import bpe, mixing, private


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    kept = [(i, r.text) for i, r in rows.items() if not fails(r.text)]
    firsts = {i for (i, _), (least, _) in zip(kept, jaccard(kept), strict=True) if i == least}
    docs = spark.createDataFrame([rows[i] for i in sorted(firsts)], table.schema)
    spans = {r.doc_id: r.spans for r in private.detect(docs).collect()}
    hidden = {i: masked(rows[i].text, spans[i]) for i in firsts}
    changed = spark.createDataFrame([(i, hidden[i], rows[i].source) for i in sorted(firsts)], "doc_id long, text string, source string")
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.mix(changed).collect()}

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    want = []
    for i in firsts:
        ids = t.encode(hidden[i], add_special_tokens=False).ids
        want += [(i, len(ids), sha(",".join(map(str, ids))), sha(hidden[i]))] * copies[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)
    assert [len(stage) for stage in corpus_pipeline.STAGES] == [2] * 5 and any(spans.values()) and len(firsts) < len(kept) < len(rows)
