"""Characters that the tokenizer libraries class after Unicode tables of their own."""

import random

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from captionloom.llm import bpe, token_ids

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    """Every code point below U+20000 in three places, by the hundred; random mixed scripts; some of the later planes."""
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x2A6D0, 0x2A710), *range(0x30000, 0x33480, 7), 0xE0001, 0xF0000, 0x10FFFF]]
    for k in range(0, len(points), 100):
        yield "\n".join(f"{c}'s 1{c} a {c}b" for c in points[k : k + 100])
    r = random.Random(3)
    for _ in range(500):
        yield "".join(r.choice([r.choice(points), r.choice("ab 1'\n"), r.choice("st é中")]) for _ in range(60))


def test_ids_equal_the_libraries():
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    other, encoder = Tokenizer.from_file(FILE), token_ids.LibraryEncoder(FILE, token_ids.odd_characters())
    n = 0
    for t in texts():
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)
        n += not encoder.whole(t)
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == other.encode(t, add_special_tokens=False).ids
    assert n > 500  # most texts go piece by piece


def test_other_files_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = token_ids.LibraryEncoder(path, token_ids.odd_characters()), Tokenizer.from_file(path)
    assert token_ids.space_led(FILE) and not token_ids.space_led(path)
    for t in ("Some Words, joined  again", "été 12"):
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
