"""Texts that a tokenizer's pattern finds hard."""

import zlib

import numpy as np
import pytest

from spindrift.llm import packing

SPACES = {"space": " ", "tab": "\t", "line": "\n", "no-break": "\u00a0", "mixed": " \t"}


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("kind", sorted(SPACES))
@pytest.mark.parametrize("around", [("", ""), ("a b", "c d"), ("<|endoftext|>", "x")])
def test_long_white_space_gives_the_vocabulary_s_ids(plain, kind, around):
    run = SPACES[kind]
    text = around[0] + run * (1_000_000 // len(run)) + around[1]
    assert packing.token_ids(text) == plain.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed_and_goes_through_the_last_stage(spark, plain):
    import corpus_pipeline

    texts = [" " * 1_000_000, "a" + "\t" * 1_100_000 + "b", "\u00a0" * 1_000_000, None, "short one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    for found in (packing.pack(df), corpus_pipeline.packed(spark, df, "")):
        rows = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found.collect())
        at = dict.fromkeys(ids, 0)
        for k, start, length, crc, tokens in rows:
            assert start == at[k] and tokens == len(ids[k]) and crc == zlib.crc32(np.asarray(ids[k][start : start + length], "<u4").tobytes())
            at[k] += length
        assert at == {k: len(x) for k, x in ids.items()}
