from quillstream.llm import quality


def test_the_middle_of_a_long_word_counts_in_its_shape():
    plain, mixed = "字" * 200, "字" * 90 + "。12,AB" + "字" * 103
    assert quality._shape(plain) == "a" and quality._shape(mixed) == "a。0,A"
    assert quality._shape("x" * 50 + "!" * 500 + "y" * 50) == "a!!!a"
