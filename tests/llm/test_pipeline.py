import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from curator.llm import decontaminate, language
from curator.llm.bpe import read_ranks
from tests.llm.common import SF
from tests.llm.test_similar import brute


def test_run_matches_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    filters = language.learn(d.where(language.fold(4) != 2))
    docs = {}
    for r in d.collect():
        share, letters = filters.shares([r.text or ""])
        if letters[0] and share.max() >= language.LEAST_SHARE:
            docs[r.doc_id] = r.text
    groups = {}
    for i, t in docs.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t), []).append((-len(t), i))
    docs = {i: docs[i] for i in (min(g)[1] for g in groups.values())}
    docs = {i: docs[i] for i, first in brute(list(docs.items())) if i == first}
    pieces = decontaminate.Pieces.of([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    docs = {i: t for i, t in docs.items() if not list(decontaminate.regions([t], pieces))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in docs.items()}
    assert 0 < len(got) < d.count()


def test_stages_return_the_columns_of_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    empty = d.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == d.columns
        assert stage(spark, empty, SF).count() == 0
