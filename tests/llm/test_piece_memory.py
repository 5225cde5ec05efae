"""The memory of encoded pieces."""

import numpy as np
import pyarrow as pa
import pytest

from rubrika.llm import tokenizing


class Counted:
    """A tokenizer that counts the texts it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("name", [tokenizing.WORD_LEVEL, tokenizing.BYTE_LEVEL])
@pytest.mark.parametrize("limit, again", [(100_000, False), (1000, True)])
def test_pieces_are_remembered_up_to_a_bound(monkeypatch, name, limit, again):
    """A hundred bytes a piece hold them all; past the bound they are encoded anew, with the same ids."""
    monkeypatch.setattr(tokenizing, "MEMO_BYTES", limit)
    monkeypatch.setattr(tokenizing, "_workers", {})
    work = tokenizing.encoder(name)
    work.tokenizer = counted = Counted(work.tokenizer)
    words = [f"w{i}é" for i in range(1000)]
    texts = [" ".join(words), " ".join(reversed(words)), None, "", " ".join(words[::2]) + ". new,er"]
    for _ in range(2):
        found = [list(tokenizing.encode_column(name, pa.array([t], pa.string())))[0] for t in texts]
        for text, raw in zip(texts, found):
            ids = counted.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids
    assert (counted.texts > 1500) is again
