"""Operator 10's select against plain arrays, and what it reads."""

import numpy as np
import pytest

from tabforge.llm import wavelet


@pytest.mark.parametrize("n", [1, 63, 64, 65, 511, 512, 513, 1024, 5000, 70000])
def test_select_of_every_one_and_zero(n):
    rng = np.random.default_rng(n)
    for share in (0.0, 0.01, 0.5, 0.99, 1.0):
        bit = rng.random(n) < share
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(bit, 1).to_bytes())
        for one in (True, False):
            want = np.flatnonzero(bit == one)
            assert m._select(0, np.arange(len(want)), one).tolist() == want.tolist()


def test_lookup_reads_no_whole_plane(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 50257, 200000)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())

    def whole(*args, **kwargs):
        raise AssertionError("a plane was unpacked whole")

    monkeypatch.setattr(np, "unpackbits", whole)
    for t in [*ids[:20].tolist(), 0, 50256, 60000, 10 ** 6]:
        assert m.locate(t).tolist() == np.flatnonzero(ids == t).tolist()
