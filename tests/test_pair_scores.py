"""How much work pairs of texts cost, beside what they score."""

from phraseforge.operators import fuzzy


def test_far_pairs_are_compared_once(monkeypatch):
    calls = []
    monkeypatch.setattr(fuzzy, "lcs", lambda *x, inner=fuzzy.lcs: calls.append(1) or inner(*x))
    terms = [(i, f"brand#{i} kind") for i in range(25)]
    assert list(fuzzy.score_block(["nothing 1234"], terms, ["partial"], 60.0, 8)) == []
    assert len(calls) <= len(terms)


def test_exact_above_the_floor():
    for a, b in (("abc", "xxabd"), ("nothing 12", "brand#12 kind"), ("ab", "ba"), ("kind", "a kinds b")):
        for score in (fuzzy.partial, fuzzy.mixed):
            whole = score(a, b)
            assert all(score(a, b, least) == whole for least in (0.0, whole / 2)) and score(a, b, whole + 1) <= whole


def test_groups_grow_with_pairs():
    """Few terms: groups hold more phrases, so that their number grows with the pairs and no faster; many terms: as many as ever."""
    assert [fuzzy.asked_groups(n, 64) for n in (0, 400, 20_000, 7_200_000)] == [1, 1, 40, 360]
    assert fuzzy.asked_groups(1_000_000, 10_000) == 2000
    assert all(n / fuzzy.asked_groups(n, 64) <= fuzzy.MANY for n in (10**4, 10**6, 10**8))
