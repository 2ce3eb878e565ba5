import sys

import numpy as np
import pytest

from wayloom.llm import repeats
from wayloom.llm.grams import U


@pytest.mark.parametrize("gaps", [[], [0], [3, 255, 254, 0, 511], [65535, 65534, 1], [4096] * 9, [1 << 20, 0, 7], [70000] * 40 + [1] * 40])
def test_gaps_come_back(gaps):
    at = np.cumsum(np.array(gaps, np.int64))
    assert repeats.get_gaps(repeats.put_gaps(at)).tolist() == at.tolist()


def test_packets_stay_small_with_many_buckets():
    """A flush writes a few bytes a key, however many buckets its keys are dealt to."""
    keys = np.random.default_rng(5).integers(0, 1 << 62, 200_000).view(U) * U(4)

    def written(bits):
        held = repeats.Gathered()
        held.add(len(keys), keys, np.arange(len(keys)), np.zeros(len(keys), bool), [np.zeros(1, "<i8"), np.array([len(keys)])])
        packets = [data for _, _, kind, data in held.flush(0, bits, True) if kind == repeats.ENTRIES]
        back = np.sort(np.concatenate([repeats.get_entries(p)[0] for p in packets]))
        assert back.tolist() == np.arange(len(keys)).tolist()
        return sum(map(len, packets)) - 40 * len(packets)

    assert written(12) < 1.4 * written(7)


def test_packets_of_all_buckets_are_made_at_once():
    """They are the bytes that packets made one by one are, and the calls of a flush don't grow with them."""
    rng = np.random.default_rng(6)
    size = rng.integers(1, 40, 500)
    edges = np.append(0, np.cumsum(size))
    at = np.concatenate([np.cumsum(rng.choice([1, 200, 255, 70000], n)) for n in size])
    key, marked = rng.integers(0, 1 << 62, len(at)).view(U), rng.random(len(at)) < 0.3
    for count in (np.ones(len(at), np.uint8), rng.choice([1, 1, 3, 255], len(at)).astype(np.uint8)):
        for wide in (False, True):
            packets = repeats.all_entries(edges, at, key, wide, marked, count)
            assert packets == [repeats.put_entries(at[s], key[s], wide, marked[s], count[s]) for s in map(slice, edges[:-1], edges[1:])]
            parts, places, each = repeats.by_width([[*repeats.get(p), i] for i, p in enumerate(packets)], 0)
            assert each.tolist() == size[[p[-1] for p in parts]].tolist()
            assert places.tolist() == np.concatenate([at[edges[p[-1]] : edges[p[-1] + 1]] for p in parts]).tolist()

    def calls(bits):
        keys, found = rng.integers(0, 1 << 62, 20_000).view(U) * U(4), [0]
        held = repeats.Gathered()
        held.add(len(keys), keys, np.arange(len(keys)), np.zeros(len(keys), bool), [np.zeros(1, "<i8"), np.array([len(keys)])])
        sys.setprofile(lambda frame, event, arg: found.__setitem__(0, found[0] + (event in ("call", "c_call") and "numpy" in (frame.f_code.co_filename if event == "call" else str(getattr(arg, "__module__", ""))))))
        try:
            held.flush(0, bits, True)
        finally:
            sys.setprofile(None)
        return found[0]

    assert calls(11) < 2 * calls(7)
