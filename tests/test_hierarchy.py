import random

import pytest

from bitquarry.operators.codec import CodecError
from bitquarry.operators.hierarchy import Group, Hierarchy, add_link, create, decode, delete, description, encode, merge, remove_link, repair


def example(seed, n=40):
    rng = random.Random(seed)
    rows = [{f"k{j}": f"v{rng.randrange(3)}" for j in range(4) if rng.random() < 0.8} for _ in range(n)]
    h = Hierarchy(rows)
    a = frozenset(m for m in range(n) if rng.random() < 0.6) | {0, 1}
    h = create(h, a, frozenset(["k0", "k1"]))
    h = create(h, frozenset(rng.sample(sorted(a), len(a) // 2)), frozenset(["k2"]), frozenset([1]))
    return create(h, frozenset(range(0, n, 3)), frozenset(["k0", "k3"]))


def test_snapshot_round_trip_and_length():
    for seed in range(8):
        h = example(seed)
        h.validate()
        data = encode(h)
        back = decode(data)
        assert back.records == h.records and back.canonical() == h.canonical()
        assert abs(8 * (len(data) - 36) - description(h)["total"]) < 10
    empty = Hierarchy([])
    assert decode(encode(empty)).records == []


def test_corruption_is_seen():
    data = encode(example(1))
    for bad in (data[:-1], data[:10], b"", bytes([data[0] ^ 1]) + data[1:], data[:20] + b"\0" + data[21:] if data[20] else data[:20] + b"\1" + data[21:]):
        with pytest.raises(CodecError):
            decode(bad)


def test_moves_keep_states_valid_and_their_input():
    h = example(3)
    before = h.canonical()
    for s in (delete(h, 1), merge(h, 1, 3), add_link(h, 3, 1), remove_link(h, 2, 1)):
        s.validate()
        assert h.canonical() == before
    assert delete(h, 1).groups[2].parents == frozenset()
    with pytest.raises(ValueError):
        Hierarchy(h.records, {1: Group(frozenset([0]), frozenset(["k0"]), frozenset([2])), 2: Group(frozenset([0]), frozenset(["k1"]), frozenset([1]))}).validate()


def test_repair_finds_planted_groups_and_nothing_in_noise():
    rng = random.Random(5)
    rows = [{f"k{j}": f"{'ab'[i % 2]}{rng.randrange(2)}" for j in range(3)} for i in range(80)]
    h, events = repair(Hierarchy(rows), most=6)
    assert h.groups and description(h)["total"] < description(Hierarchy(rows))["total"]
    noise = [{f"k{j}": f"v{rng.randrange(4)}" for j in range(3)} for _ in range(80)]
    assert not repair(Hierarchy(noise), most=3)[0].groups
