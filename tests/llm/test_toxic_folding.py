"""Folding of accents, compatibility forms and zero-width characters, each by itself."""

import pytest

from loomtext.llm import toxicity


@pytest.mark.parametrize(
    "text",
    ["ïdïôt", "íd̈i̶òt⃝", "ＩＤＩＯＴ", "id​i‍o⁠t", "﻿i­diot", "ℐdiot"],
    ids=["accents", "marks", "full-width", "zero-width", "soft hyphen", "letter-like"],
)
def test_disguised_words_match(text):
    m = toxicity.Matcher(toxicity.Lexicon({"idiot": 2.0}))
    assert m.weight(toxicity.fold(f"you {text}!"))[0] == 2.0


def test_other_scripts_keep_their_marks():
    assert toxicity.fold("й") == " й " and toxicity.fold("が") == " が "
