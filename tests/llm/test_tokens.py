"""The encoder's cache of pre-tokens."""

import random

import numpy as np
import pytest

from tests.llm.test_small import library, vocabulary
from tidemark.llm import tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


class Counted:
    """A model that notes what it is asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, text):
        self.asked.append(text)
        return self.model.tokenize(text)


@pytest.mark.parametrize("name", NAMES)
def test_pretokens_in_use_stay_known(monkeypatch, name):
    """However many rare words go by, a word of every text is encoded once, and the cache stays bounded."""
    monkeypatch.setattr(tokens, "CACHED", 100)
    rng = random.Random(3)
    texts = ["common words, été ÆØÅ\n" + " ".join("".join(rng.choices("abcdefghé", k=9)) for _ in range(20)) + "  \t42 x" for _ in range(60)]
    encoder = tokens.Encoder(vocabulary(name))
    encoder.cache.model = counted = Counted(encoder.cache.model)
    found = [np.frombuffer(x, encoder.dtype).tolist() for text in texts for x in encoder.ids([text])]
    assert found == library(name, texts)
    assert len(counted.asked) == len(set(counted.asked)) > 1000
    assert len(encoder.cache) + len(encoder.cache.earlier) < 200


@pytest.mark.parametrize("name", NAMES)
def test_letters_whose_lower_case_is_far_away(name):
    """U+0190 and U+023A are below U+0250, their lower-case letters are not."""
    texts = ["aƐb ƐƐ Ⱥx", "Ɔkɔ 3Ɛ", "ÀÉ ab", "Ƀa ɃȺ"]
    encoder = tokens.Encoder(vocabulary(name))
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.ids(texts)] == library(name, texts)
