"""Bank account numbers of every length, whatever stands behind them."""

import random

import pytest

from tidemark.llm import pii


def account(country, length, seed=0):
    """A number of that country and length whose check digits are right."""
    rng = random.Random(f"{country}{length}{seed}")
    body = "".join(rng.choice("0123456789") for _ in range(length - 4))
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{98 - rest:02d}{body}"


def grouped(code):
    return " ".join(code[i : i + 4] for i in range(0, len(code), 4))


PUBLISHED = ["AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "CH93 0076 2011 6238 5295 7", "CZ65 0800 0000 1920 0014 5399", "DE89 3704 0044 0532 0130 00", "DK50 0040 0440 1162 43", "ES91 2100 0418 4502 0005 1332", "FR14 2004 1010 0505 0001 3M02 606", "GB29 NWBK 6016 1331 9268 19", "IT60 X054 2811 1010 0000 0123 456", "NL91 ABNA 0417 1643 00", "NO93 8601 1117 947", "PL61 1090 1014 0000 0712 1981 2874", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
BEHIND = ["", " BANK", " BANKHAUS", " 2024", " Bank", ". Next", ", 12", " A", " 1", "\nIBAN", " 2024 2025 2026", ")", "é", " ABCD EFGH IJKL MNOP"]


def ibans(text):
    return [(s, e) for k, s, e in pii.spans(text)[1] if k == "iban"]


@pytest.mark.parametrize("code", PUBLISHED)
def test_published_numbers(code):
    for written in (code, code.replace(" ", "")):
        for behind in BEHIND:
            text = f"to {written}{behind}"
            if pii.base_spans(text)[0]:  # its digits happen to be a card's, which stays instead
                continue
            assert ibans(text) == [(3, 3 + len(written))], text


@pytest.mark.parametrize("country", sorted(pii.IBAN_LENGTH))
def test_every_country(country):
    for seed in range(5):
        code = account(country, pii.IBAN_LENGTH[country], seed)
        for written in (code, grouped(code)):
            for behind in BEHIND:
                text = f"Konto: {written}{behind}"
                if pii.base_spans(text)[0]:
                    continue
                assert ibans(text) == [(7, 7 + len(written))], text


def test_unlisted_countries_try_every_border():
    for length in (15, 16, 20, 23, 24, 28, 34):
        code = account("ZZ", length)
        for behind in ("", " BANK", " 2024", "."):
            text = f"x {grouped(code)}{behind}"
            found = ibans(text)
            if not pii.base_spans(text)[0]:
                # A longer reading that the check confirms by chance wins; here there is none.
                assert found == [(2, 2 + len(grouped(code)))], text


def test_what_is_no_number():
    code = account("DE", 22)
    wrong = code[:-1] + str((int(code[-1]) + 1) % 10)
    for text in (wrong, f"X{code}", f"{code}9", f"{code}X", code.lower(), code[:-1], grouped(code).replace(" ", "  "), f"{code[:6]} {code[6:]}", "DE89", "DE89 ", ""):
        assert ibans(text) == [], text
    assert ibans(f"{code}, {code}") == [(0, 22), (24, 46)]
    assert pii.redacted(f"a {code} BANK", pii.spans(f"a {code} BANK")[1]) == "a [iban] BANK"
