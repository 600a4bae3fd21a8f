"""Spellings of one phone number get one pseudonym, each in its own form, and all can be undone."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from shelfline.llm.pii import Feistel, pseudonymise

KEY = b"phones"

#: Spellings of one number each, with its country code.
SAME = [
    ("33", ["+33 6 12 34 56 78", "+33612345678", "+33 (0)6 12 34 56 78", "+33-6-12-34-56-78"]),
    ("1", ["+1 716 555 8176", "1-716-555-8176", "(716) 555-8176", "716.555.8176", "716-555-8176", "+1 (716) 555-8176", "+17165558176"]),
    ("44", ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"]),
    ("351", ["+351 21 123 4567", "+351211234567"]),
]


def national(text, code):
    digits = re.sub(r"\D", "", text.replace("(0)", ""))
    return digits[len(code):] if text[0] == "+" or len(digits) == 11 and code == "1" else digits


@pytest.mark.parametrize("code,spellings", SAME)
def test_spellings_stay_linked(code, spellings):
    new = [pseudonymise(f"call {s} now", Feistel(KEY)) for s in spellings]
    assert all(counts == {"phone": 1} for _, counts in new)
    texts = [t.removeprefix("call ").removesuffix(" now") for t, _ in new]
    assert [re.sub(r"\d", "9", t.replace("(0)", "")) for t in texts] == [re.sub(r"\d", "9", s.replace("(0)", "")) for s in spellings]
    assert len({national(t, code) for t in texts}) == 1 and national(texts[0], code) != national(spellings[0], code)
    assert all(re.sub(r"\D", "", t).startswith(code) for t in texts if t[0] == "+")
    for old, (text, _) in zip(spellings, new):
        assert pseudonymise(text, Feistel(KEY, True))[0] == f"call {old} now"


def test_unlike_numbers_stay_unlike():
    numbers = [f"+33 6 12 34 {i:02d} {j:02d}" for i in range(20) for j in range(20)]
    assert len({pseudonymise(n, Feistel(KEY))[0] for n in numbers}) == len(numbers)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["1", "7", "33", "49", "86", "351", "420", "971"]), st.integers(0, 10 ** 9 - 1))
def test_compact_and_spaced_forms_agree_for_any_digits(code, number):
    n = f"{number:09d}"
    spaced, compact = (pseudonymise(t, Feistel(KEY))[0] for t in (f"+{code} {n[:3]} {n[3:6]} {n[6:]}", f"+{code}{n}"))
    assert spaced.replace(" ", "") == compact
    assert pseudonymise(spaced, Feistel(KEY, True))[0] == f"+{code} {n[:3]} {n[3:6]} {n[6:]}"
