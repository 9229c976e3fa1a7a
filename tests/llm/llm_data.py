from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Other columns with the names that results have.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, keep string, score string, toxic int, topic double, tokens string, probability string, y int, a int, b0 string, root string, kept_doc_id string"
VOWELS, CONSONANTS = "aeiou", "bcdfghklmnprstvw"


def word(r: random.Random, syllables: int = 3) -> str:
    return "".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randint(1, syllables)))


def prose(r: random.Random, n: int) -> str:
    return " ".join(word(r, 4) for _ in range(n))
