"""The pipeline over a small table against plain Python, stage by stage."""

import collections
import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from captionloom.llm import bpe, mixing, quality
from tests.llm.test_operators import brute_join


def test_pipeline_matches_plain_python(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = stages[0](spark, docs, "")
    assert clean.columns == docs.columns
    verdict = {(k.doc_id, k.text): k.kept for k in quality.score_quality(docs).collect()}
    left = [r for r in rows if verdict[r[:2]]]
    assert collections.Counter(r.doc_id for r in clean.collect()) == collections.Counter(r[0] for r in left)
    seen, single = set(), []
    for r, (i, c, *_) in zip(left, brute_join(left), strict=True):
        if i is None or i == c and i not in seen:
            seen.add(i)
            single.append(r)
    masked = [(r[0], r[1].replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]"), *r[2:]) for r in single]
    made = spark.createDataFrame([(m[0], m[3], m[1]) for m in masked], "doc_id long, source string, text string")
    copies = {(r.doc_id, r.text): r.copies for r in mixing.with_copies(made).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for i, t, *_ in masked:
        ids = library.encode_ordinary(t)
        key = (i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want[key] += copies[i, t]
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
