import zlib

import corpus_pipeline
import numpy as np

from provenant.llm import decontaminate, mixing, neardup, quality, registry, tokens
from provenant.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_are_applied_in_order(spark):
    docs = table(spark, SF, "documents")
    kept = quality.keep_good(docs)
    one = neardup.keep_one(kept)
    clean = decontaminate.drop_contaminated(one, table(spark, SF, "benchmark"))
    mixed = mixing.take_mix(clean)
    rows = corpus_pipeline.run(spark, SF).collect()
    want = sorted(r.doc_id for r in mixed.collect())
    assert sorted(r.doc_id for r in rows) == want and want
    for a, b in ((docs, kept), (kept, one), (one, clean)):
        assert a.dtypes == b.dtypes and b.exceptAll(a).isEmpty()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.Params().file())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:40]:
        ids = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mix_sources", "token_ids"]
