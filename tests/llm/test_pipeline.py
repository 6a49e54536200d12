import hashlib

import numpy as np

import corpus_pipeline
from tickloom.llm.vocabulary import default_path

from .test_containment_and_chat import grams
from .test_near_copies import brute_force as near_copies
from .test_quality import plain

SF = "/root/testdata/sf0.001"


def brute_force(spark, docs):
    from tokenizers import Tokenizer

    good = {i for i, *_, kept in plain([(r.doc_id, r.text, r.lang) for r in docs]) if kept}
    docs = [r for r in docs if str(r.doc_id) in good]
    kept = {x for x, least in near_copies([(r.doc_id, r.text) for r in docs]) if x == least}
    docs = [r for r in docs if str(r.doc_id) in kept]
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [r for r in docs if not any(5 * len(g & grams(r.text)) >= 4 * len(g) for g in items)]
    library, out = Tokenizer.from_file(default_path()), []
    for r in docs:
        ids = library.encode(r.text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        out.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest(), raw))
    return sorted(out)


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == brute_force(spark, docs) and 0 < len(got) < len(docs)


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows and an empty table go through every stage."""
    text = " ".join(f"w{i} of the" for i in range(60))
    rows = [(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, text, "en", None, None), (None, text, None, None, None), (3, None, "en", "s", 0), (4, "", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF)
            if name != "bpe_codec":
                assert docs.columns == before.columns
        assert sorted(str(r.doc_id) for r in docs.collect()) == (["1", "None"] if part else [])
