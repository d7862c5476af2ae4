import random
import zlib

import numpy as np
import pytest

from raresift.llm import sentencepieces
from raresift.llm.queries import tokenizer_path


@pytest.mark.parametrize("chunk", [3, 65_536])
def test_pieces_of_texts_with_nul_equal_the_library(make, chunk):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(0)
    texts = ["a\0b", "\0", "\0\0\0", "word \0 word", "\1\0\1"]
    texts += ["".join(draw.choice("ab \0\1é日🙂") for _ in range(draw.randint(1, 30))) for _ in range(80)]
    for row in sentencepieces.encode(make(texts), path, chunk).collect():
        text = texts[row.doc_id]
        expected = library.encode(text)
        assert np.frombuffer(row.ids, np.uint32).tolist() == expected, repr(text)
        assert row.text_crc32 == zlib.crc32(library.decode(expected).encode()), repr(text)
