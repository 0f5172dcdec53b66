"""The cached encoders against the library's own whole path."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallystone.llm import chunks
from tallystone.llm.common import tokenizer_path

ODD = [
    None, "", " ", "\n", "a", "  a  b ", "don't I'll 'tis O'Neil's 's'T", "a b\u0085c\x1cd\x0bz", "\t\tx\n\n  y", "1234 5²³¼ x1y2", "ªº µm ß STRASSE ÀÉÎ Ÿ",
    "naïve café é", "Ǆ İstanbul ΣΑΣ σας", "日本語 テスト　です", "😀👩‍👩‍👧 x", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", " wide thin​zero", "a" * 5000,
    "ab'" * 40, "&&& ,%%% '!! ''s \"it's\"", "﻿bom ퟿", "x\x00y\x7f", "Å Å", "ﬁne ﬃ", "_under_score__ -- --a", "\r\n\r\n \r", "trailing   ", "   leading", "1 ² ½x½ 10½",
]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name, split", [("word_bpe_49k.json", chunks.split_words), ("byte_bpe_50k.json", chunks.split_spaced)])
def test_ids_are_the_librarys(name, split):
    rng = random.Random(3)
    letters = "abcXYZ éÑß '’.,!?\n\t 0123½  \x85\x1fµª|&日é́"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    enc, lib = chunks.ChunkEncoder(tokenizer_path(name), split), library(name)
    for t, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_small_tables_change_nothing():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    path = tokenizer_path("word_bpe_49k.json")
    large, small = chunks.ChunkEncoder(path, chunks.split_words), chunks.ChunkEncoder(path, chunks.split_words)
    small.pretokens.most = 7
    assert all(np.array_equal(a, b) for a, b in zip(large.encode(texts), small.encode(texts), strict=True))
    assert len(small.pretokens) <= 7
