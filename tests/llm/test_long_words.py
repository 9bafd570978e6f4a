from tideglass.llm.subjects import sentences


def test_long_words_count_whole():
    assert sentences("a" * 40 + "funding") == [["a" * 40 + "funding"]]
