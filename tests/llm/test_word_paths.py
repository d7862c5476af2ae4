import random
import zlib

import numpy as np
import pytest

from raresift.llm import sentencepieces
from raresift.llm.queries import tokenizer_path

PATH = "piece_bpe_32k.model"


def test_words_need_no_full_lattice(monkeypatch):
    import sentencepiece

    path = tokenizer_path(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepieces.Model(path)
    monkeypatch.setattr(model, "spread", None)
    draw = random.Random(4)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 30))) for letters in ("ab", "etaoin", "0189", "éßaz,.") for _ in range(100)]
    for word in [*words, "internationalisation", "a" * 5_000, "ab" * 3_000]:
        content = sentencepieces.normal(word)
        assert np.frombuffer(model.body(content), np.uint32).tolist() == library.encode(word), word


@pytest.mark.parametrize("letters", ["ab▁", "aé日🙂", "\x01a", "ſ㊙a"])
def test_path_search_is_the_lattice(letters):
    model = sentencepieces.Model(tokenizer_path(PATH))
    draw = random.Random(zlib.crc32(letters.encode()))
    for _ in range(200):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(1, 25)))
        found = model.only_path(word)
        whole = model.back(model.spread(word, 0, None, len(word), len(word)), len(word))
        assert found is None or found == whole, word
        assert found is not None or any(letter not in model.ids for letter in word), word
