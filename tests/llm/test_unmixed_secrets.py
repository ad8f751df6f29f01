"""Random strings of letters of one case are secrets too; long words and names of one case aren't."""

import random
import string

import pytest

from ensemblake.llm.op6_secrets import all_spans, joined
from tests.llm.test_secrets import RANKS


def found(run):
    return joined(all_spans(f"so {run} it is", RANKS, 2.0)[1])


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase])
@pytest.mark.parametrize("n", [16, 24, 48])
def test_random_letters_of_one_case(letters, n):
    rng = random.Random(n)
    runs = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(200)]
    assert sum(found(r) == f"random:3:{3 + n}" for r in runs) >= 170


def test_words_of_one_case():
    for clean in ["Donaudampfschifffahrtsgesellschaft", "rechtsschutzversicherungsgesellschaften", "ACKNOWLEDGEMENTS", "internationalization", "path/to/some/directory/file", "get_element_by_id_and_class_name", "well-known-and-often-used", "================", "aaaaaaaaaaaaaaaaaaaaaaaa"]:
        assert found(clean) == "", clean
