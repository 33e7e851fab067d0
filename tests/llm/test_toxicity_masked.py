"""Masked words are measured whatever sign masks them, at a word's ends and in long runs too."""

import pytest

from captionloom.llm import toxicity

LEXICON = {"idiot": 4.0, "moron": 4.0, "stupid": 4.0, "ass": 4.0}


@pytest.mark.parametrize("masked", ["i.d.i.o.t", "m-o-r-o-n", "$tupid", "a$$", "id1ot", "i" + "." * 50 + "diot"])
def test_masked_words_count(masked):
    got = dict(zip(toxicity.FEATURES, toxicity.features(f"you {masked} there", LEXICON), strict=True))
    assert got["masked_rate"] > 0
    assert got["masked_hits"] > 0


def test_plain_words_and_long_texts_are_not_masked():
    for text in ("Nothing here, is it? No. Done!", "x" * 100_000):
        assert dict(zip(toxicity.FEATURES, toxicity.features(text, LEXICON), strict=True))["masked_rate"] == 0
