import pytest

from recordlens.llm import pii

IBAN = "DE89 3704 0044 0532 0130 00"


def ibans(text):
    return [text[s:e] for s, k, e in pii.spans(text) if k == len(pii.BASE)]


@pytest.mark.parametrize("after", ["", " BIC COBADEFF", " 12 May", " PLEASE PAY BEFORE THE END OF JUNE", ", thanks", f" {IBAN}"])
@pytest.mark.parametrize("before", ["IBAN ", "account AB12 "])
def test_iban_is_found_whatever_follows(before, after):
    assert ibans(before + IBAN + after) == [IBAN] * (1 + after.endswith(IBAN))


def test_wrong_checksum_is_none_at_any_end():
    assert ibans("IBAN DE88 3704 0044 0532 0130 00 BIC COBADEFF PLEASE PAY") == []
