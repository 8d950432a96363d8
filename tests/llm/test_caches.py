"""What operators keep in a Python worker goes when another operator's task comes."""

from quillon.llm import bpe, common, neardup


def test_operators_leave_nothing_to_each_other():
    encoder = bpe.cached_bpe(bpe.default_vocabulary())
    wanted = encoder.encode(["two words", None])
    first = neardup.shingle_set(b"one two three four", 3)
    assert not bpe._INSTANCES and neardup._HASHES
    assert bpe.cached_bpe(bpe.default_vocabulary()).encode(["two words", None]) == wanted
    assert bpe._INSTANCES and not neardup._HASHES
    assert bpe.cached_bpe(bpe.default_vocabulary()) is bpe.cached_bpe(bpe.default_vocabulary())  # the next task of the same operator finds it
    assert neardup.shingle_set(b"one two three four", 3).tolist() == first.tolist() and not bpe._INSTANCES
    common.alone("gbt")
    assert not neardup._HASHES and not common._KEPT
