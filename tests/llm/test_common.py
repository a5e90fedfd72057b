import numpy as np

from tallywise.llm.common import Words


def test_long_words_of_equal_sums_are_told_apart():
    x, y = b"a", b"b"
    for n in range(13):
        words = Words([x + b" " + y, y, x])
        assert len(set(words.hash.tolist())) == 2, n
        assert np.array_equal(words.hash[[0, 1]], words.hash[[3, 2]])
        x, y = x + y, y + x
