"""Words whose character is white space to Python are found like any other."""

from pulsecheck.llm.decontaminate import Windows


def test_every_word_alone_is_found():
    words = [f"w{i:05d}" for i in range(13_000)]
    block = Windows([(w, [w]) for w in words])
    assert sum(c.isspace() for c in block.letter.values()) == 17
    for w in words:
        assert block.scan([w.encode()]) == ([(0, 1)], [w])
        assert block.scan([b"unknown", w.encode()]) == ([(1, 2)], [w])
    assert block.scan([b"unknown"]) == ([], []) == block.scan([])
