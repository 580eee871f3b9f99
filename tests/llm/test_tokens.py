"""Ids of many texts at once."""

import numpy as np

from loadwright.llm import packing
from tests.llm.data import COPY, LONG

TEXTS = ["", " ", "one", " lead", "tail ", "a\n", "x\ny z\n", "a  b \n c\t d<|endoftext|>   e  f'll  ", "ab <|endoftext|> cd",
         "été 日本語 straße", COPY, LONG, *(f"word{i} and w{i}é {i}! more{i % 7}" for i in range(300))]


def test_texts_together_have_the_ids_of_each(monkeypatch):
    tokens, joined = packing.Tokens(packing.default_tokenizer()), []
    learn = tokens._learn_joined
    monkeypatch.setattr(tokens, "_learn_joined", lambda words: joined.append(len(words)) or learn(words))
    found = list(tokens.encode_all(TEXTS))
    assert len(joined) < 10
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == want
    # in short stretches, and when nothing is remembered for long
    monkeypatch.setattr(packing, "_STRETCH", 9)
    monkeypatch.setattr(packing, "_CACHED", 2)
    assert list(tokens.encode_all(TEXTS[:30])) == found[:30]
