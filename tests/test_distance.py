"""Edit distances of many pairs equal those of one."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.functions import distance, scoring

WORD = st.text(alphabet="abcé😀", max_size=12) | st.text(alphabet="ab", min_size=55, max_size=75)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORD, WORD), max_size=30))
def test_equal_to_the_table_of_each_pair(pairs):
    got = distance.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [distance._by_rows(a, b) for a, b in pairs]


def test_many_pairs_take_a_fraction_of_the_time():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(5, 12))) for _ in range(20_000)]
    start = time.process_time()
    got = distance.edit_distances(words, words[::-1])
    batch = time.process_time() - start
    start = time.process_time()
    want = [distance._by_rows(a, b) for a, b in zip(words, words[::-1], strict=True)]
    assert got.tolist() == want and batch < 0.5 * (time.process_time() - start)


def test_scores_are_the_same_with_what_was_counted_before():
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    pairs = [(" ".join(r.choice(words) for _ in range(4)), " ".join(r.choice(words) for _ in range(30))) for _ in range(200)]
    distance._known.clear()
    plain = [scoring.relevance_of(q, t) for q, t in pairs]
    distance._known.clear()
    scoring.prepare((q for q, _ in pairs), (t for _, t in pairs))
    counted = len(distance._known)
    scoring.words_of.cache_clear()
    assert [scoring.relevance_of(q, t) for q, t in pairs] == plain and len(distance._known) == counted > 100


def test_what_is_asked_for_stays_when_the_rest_is_forgotten(monkeypatch):
    """Distances that an earlier call counted are there after a clearing too, and few are kept."""
    monkeypatch.setattr(distance, "_known", {})
    monkeypatch.setattr(distance, "KEPT", 4)
    distance.remember(["aab"], ["aac", "aad"], 0.5)
    distance.remember(["aab", "bbc"], ["aac", "aad", "bbd", "bbe", "bbf"], 0.5)
    assert distance._known == {("aab", "aac"): 1, ("aab", "aad"): 1, ("bbc", "bbd"): 1, ("bbc", "bbe"): 1, ("bbc", "bbf"): 1}
