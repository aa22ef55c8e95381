import pytest

from lakeledger.llm.pii import candidates


@pytest.mark.parametrize("text", ["bob [AT] mail.com", "bob (AT) mail.com", "bob {at} mail.com", "bob {At} mail {DOT} com", "bob at mail Dot com", "bob at mail.com",
                                  "bob\tAT mail dot com"])
def test_spelt_addresses_are_candidates_whatever_else_the_text_holds(text):
    assert candidates(text, []) == candidates(text + " anecdote", []) == [(0, 0, len(text))]


def test_long_white_space():
    assert candidates(" " * 200_000 + "x (at) y.z " + " " * 200_000, []) == [(0, 200_000, 200_010)]
