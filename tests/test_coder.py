"""The archive is lossless, and refuses what it should."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.config import RunConfig, settings_hash
from tidemark.functions import coder

S = {"interval": 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=300), max_size=9), st.booleans())
def test_round_trip(chunks, online):
    packed = coder.compress(chunks, interval=2, online=online, settings=S)
    assert coder.decompress(packed, interval=2, online=online, settings=S) == b"".join(chunks)
    assert all(len(p) % 4 == 0 for p in coder.parse(packed)[4])


def test_repetition_is_learned():
    chunks = [b"abcd" * 128] * 16
    online = coder.compress(chunks, interval=2, online=True, settings=S)
    assert len(online) < 0.5 * len(coder.compress(chunks, interval=2, online=False, settings=S))


def test_refusals():
    packed = coder.compress([b"x"], interval=2, online=True, settings=S)
    for bad, why in ((b"nope" + packed[4:], "not an archive"), (packed[:4] + b"\7" + packed[5:], "version"), (packed + b"!", "as long")):
        with pytest.raises(ValueError, match=why):
            coder.parse(bad)
    with pytest.raises(ValueError, match="other settings"):
        coder.decompress(packed, interval=2, online=True, settings={"interval": 3})
    with pytest.raises(ValueError):
        coder.varint(-1)
    with pytest.raises(ValueError, match="cut off"):
        coder.read_varint(b"\x80", 0)


@given(st.integers(0, 2**70))
def test_varint(n):
    assert coder.read_varint(coder.varint(n), 0) == (n, len(coder.varint(n)))


def test_config():
    assert RunConfig().window == 512 and RunConfig.load('{"lr": "0.5"}', chunk_size="64").chunk_size == 64
    with pytest.raises(ValueError, match="unknown"):
        RunConfig.load('{"nothing": 1}')
    with pytest.raises(ValueError, match="exclude"):
        RunConfig(measure_gk=True, adjacency_probe=True)
    with pytest.raises(ValueError, match="ctx_tokens"):
        RunConfig(measure_gk=True, ctx_tokens=4)
    a, b = RunConfig(), RunConfig(shuffle_seed=1)
    assert a.settings_hash("static") != b.settings_hash("static") and settings_hash({"a": 1, "b": 2}) == settings_hash({"b": 2, "a": 1})
