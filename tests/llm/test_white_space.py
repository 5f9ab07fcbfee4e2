"""Plain texts with white space other than the space and the line feed."""

from measurelake.llm import packing, queries

from .test_search_and_packing import brute_ids


def test_white_space_of_plain_texts():
    texts = ["a\tb", "x\r\ny", "one\x0btwo\x0cthree\rfour\t\t five", "\t", "it\t's", "A\x00B\x08 \x0e\x7f c\tD"]
    got = packing.WordTokenizer(queries.tokenizer_path()).encode_texts(texts)
    assert [list(g) for g in got] == [ids[:-1] for ids in brute_ids(texts)]
