"""Long chunks and chunks with special tokens are cut at forced boundaries too."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tarnlake.llm import bpe

PATH = public_tokenizers.path(bpe.WORD_FILE)


def test_long_chunks_are_cut_at_forced_boundaries(monkeypatch):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    mine, rng, merged = bpe.WordBPE(PATH), random.Random(7), []
    plain = mine.merge_long
    monkeypatch.setattr(mine, "merge_long", lambda part, *ends: merged.append(part) or plain(part, *ends))
    texts = [
        "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(2000)),
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000)),
        "".join(rng.choices("thenationéàçß", k=5000)),
        "".join(rng.choices("abcXYZ0189+/", k=5000)),
        "zq" * 3000 + "a" * 3001 + "zq",
        "<|endoftext|>étréçàthing<|endoftext|>",
        "a" * 3001 + "é",
        "é" * 1500 + "a",
    ]
    for text in texts:
        merged.clear()
        (ids,) = mine.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert not any(mine.forced(np.frombuffer(part, np.uint8)).any() for part in merged), text[:20]
