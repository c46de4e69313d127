"""What the word cache of the tokenizers holds."""

import sys

import numpy as np
import pytest

from blockfold.llm import packing, tokens


def test_words_that_recur_are_encoded_once():
    """The byte-level encoder holds what a worker's tasks have in common, and letters go to the model as the library maps them."""
    own = tokens.encoder(packing.tokenizer_path("byte_bpe_50k.json"), True)
    held = type(own.spaced)(lambda text: calls.append(1) or b"", own.spaced.prefix, own.plain, own.spaced.most)
    calls: list[int] = []
    for _ in range(2):
        for k in range(500_000):
            held[f"w{k}x"]
    assert len(calls) == 500_000
    words = ["Word", "word", "a", "Zz", "naïve", "Straße", "日本", "ΑΒΓ", "x1", "İ", "word,", "don't"]
    for text in [*words, " ".join(words), "\n".join(words), " " + " ".join(words) + "\n"]:
        assert own.ids(text) == np.asarray(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_worker_holds_a_bounded_table(name, spaces):
    """An executor holds one table for each of its Python workers: a table of more words than fit stays below 130 MB."""
    own = tokens.encoder(packing.tokenizer_path(name), spaces)
    held = type(own.spaced)(lambda text: text.encode(), own.spaced.prefix, own.plain if spaces else None, own.spaced.most)
    most = 0
    for k in range(1_500_000):
        held[f"w{k}x" if k % 3 else f"w{k}x,"]
        if k % 100_000 == 99_999:
            words = [*held, *getattr(held, "old", ())]
            ids = [*held.values(), *getattr(held, "old", {}).values()]
            most = max(most, sys.getsizeof(held) + sum(map(sys.getsizeof, words)) + sum(map(sys.getsizeof, ids)))
    assert most < 130e6
    assert len(held) <= held.most


def test_words_that_end_in_other_letters():
    """Punctuation after letters and digits up to U+00FF is cut off before the model, white space next to white space is not."""
    path = packing.tokenizer_path("byte_bpe_50k.json")
    own = tokens.WordEncoder(path, True, most=60)
    for ends in ("é,", "ß.", "Ñ!!", "ª)", "²;", "½|", "µ###", "é.,", "ÿ's,", "×,", "Ā.", "ς,", "é́."):
        for text in (ends, f"a {ends} b{ends}", f"x\n{ends}\n", f"{ends}  {ends}", f" {ends} \n{ends}\n\n{ends} ", f"{ends}\n "):
            assert own.ids(text) == np.asarray(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    encoded: list[str] = []
    own.spaced.encode = lambda text, encode=own.spaced.encode: encoded.append(text) or encode(text)
    own.ids("a caféx, caféé, caféé.")
    assert encoded == [" caféx", " caféé"]
