import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting

MARK = "́"


def admissible(text, reach, start):
    """Every position of every kind that may be cut, kind by kind, without any thinning."""
    n, at = len(text), {}
    kinds = [
        {m.end(): (0 if m[0].count("\n") > 1 else 1) for m in splitting._natural(text)},
        {m.end(): 2 for m in splitting._line(text)},
        {m.end(): 3 for m in splitting._blank(text)},
        {p: 4 for p in range(n) if not splitting._joined(text[p])},
        {p: 5 for p in range(n)},
    ]
    for no, found in enumerate(kinds):
        known = [start, *sorted(at), n]
        for a, b in zip(known, known[1:]):
            if no == 0 or b - a > reach:
                at.update({p: k for p, k in found.items() if a < p < b and p not in at})
    return at


def cheapest(text, limit, over):
    reach = limit - over
    goal = (len(text) - over) / -(-(len(text) - over) // reach)
    at, best = admissible(text, reach, over) | {len(text): 6}, {over: 0.0}
    for p in sorted(at):
        ways = [c + ((p - q) / goal - 1) ** 2 for q, c in best.items() if p - q <= reach]
        if ways:
            best[p] = min(ways) + splitting._COST[at[p]] + 0.05
    return best[len(text)]


def cost(pieces, text, limit, over):
    goal, at, total = (len(text) - over) / -(-(len(text) - over) // (limit - over)), over, 0.0
    for _, e, kind in pieces:
        total += ((e - at) / goal - 1) ** 2 + splitting._COST[splitting.KINDS.index(kind)] + 0.05
        at = e
    return total


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n漢。" + MARK, min_size=1, max_size=120), st.integers(1, 30), st.integers(0, 29))
def test_limit_overlap_and_cost_hold_for_any_text(text, limit, over):
    if over >= limit:
        over = limit - 1
    pieces = splitting.cuts(text, limit, over)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    assert all(b[0] == a[1] - over for a, b in zip(pieces, pieces[1:]))
    if len(text) > limit and limit - over < 32:  # below that no position is left out
        assert abs(cost(pieces, text, limit, over) - cheapest(text, limit, over)) < 1e-6


def test_marks_and_long_words_keep_the_limit():
    for text in ("ab" + MARK * 6000 + " text and more. " * 50, "x" * 30_000, MARK * 5000, ("e" + MARK * 3) * 3000, "a" * 1999 + "\n" + "b" * 9000, "漢" * 9000):
        pieces = splitting.cuts(text)
        assert max(e - s for s, e, _ in pieces) <= 2000 and pieces[-1][1] == len(text)
        assert all(b[0] == a[1] - 150 for a, b in zip(pieces, pieces[1:]))
    assert all(k in ("character", "end") for *_, k in splitting.cuts(("e" + MARK * 3) * 3000))  # never amid a letter and its marks


def test_worse_kinds_only_where_needed():
    rnd = random.Random(1)
    text = "".join("w" * rnd.randint(1, 9) + rnd.choice([" ", " ", " ", "\n"]) + ("." if rnd.random() < 0.02 else "") for _ in range(3000)) + ". " + "Sentence here. " * 400
    end = text.index(". S")
    assert {k for _, e, k in splitting.cuts(text) if e > end + 2000} <= {"sentence", "end"}
