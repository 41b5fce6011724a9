"""The pipeline against a plain version of each stage."""

import hashlib
from collections import Counter

import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from timberline.llm import mixing, queries, toxicity
from timberline.llm.common import table

from .test_operators import plain_classes, plain_dedup

SF = "/root/testdata/sf0.001"


def plain_copies(rates, seed=1):
    """How often each document stands after mixing: the whole part of its rate, and one more by lot."""
    out = {}
    for i, rate in rates.items():
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=42))
        out[i] = max(1, int(rate) + (h % (1 << 30) / (1 << 30) < rate - int(rate)))
    return out


def test_stages(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "soft_mixing", "bpe"]
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    tox = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.score >= 0.7}
    want = [
        (lambda r: {i: t for i, t in r.items() if i not in tox}),
        (lambda r: {i: t for i, t in r.items() if plain_dedup(list(r.items()))[i][2]}),
        (lambda r: {i: t for i, t in r.items() if plain_classes(list(r.items()), 5, 80, 100)[i][1] == i}),
        (lambda r: r),
    ]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, want):
        before = docs
        rows = plain(rows)
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == table(spark, SF, "documents").columns
        got = docs.collect()
        assert {r.doc_id for r in got} == set(rows), name
        assert all(r.text == rows[r.doc_id] for r in got)
        if name == "soft_mixing":
            rated = mixing.mixing_rates(before, labels, corpus_pipeline.TARGETS, least=1.0, growth=1.1, most=4.0).collect()
            copies = plain_copies({r.doc_id: r.rate for r in rated})
            assert Counter(r.doc_id for r in got) == copies and max(copies.values()) > 1
            # The short domain gets as near its share of the budget as the bound on rates lets it.
            total = sum(r.tokens for r in rated)
            reached = {k: sum(r.rate * r.tokens * r[f"p_{k}"] for r in rated) / (1.1 * total) for k in corpus_pipeline.TARGETS}
            start = {k: sum(r.tokens * r[f"p_{k}"] for r in rated) / (1.1 * total) for k in corpus_pipeline.TARGETS}
            apart = lambda x: sum((x[k] - v) ** 2 for k, v in corpus_pipeline.TARGETS.items())
            assert all(r.settled for r in rated) and apart(reached) < apart(start)
        else:
            assert len(got) == len(rows)
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in out) == copies
    for r in out:
        ids = tokenizer.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
