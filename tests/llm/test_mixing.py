"""Pfair mixing: the share of every source at every slot, and edge cases. The whole table is checked by its SQL twin."""

import hashlib

import pytest

from aeroscope.llm import mixing


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 2, "c": 1}, {"a": 20, **{f"s{i}": 4 for i in range(20)}}, {"a": 97, "b": 2, "c": 1}, {"a": 7, "b": 7, "c": 3}])
def test_less_than_one_block_off(shares):
    total, slots = sum(shares.values()), mixing.edf_period(shares)
    assert sorted(t for at in slots.values() for t in at) == list(range(total))
    for s, n in shares.items():
        assert len(slots[s]) == n
        for j, t in enumerate(slots[s]):
            release, deadline = mixing.pfair_window(j, n, total)
            assert release <= t < deadline
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - t * n / total) < 1


def test_rows(spark):
    shares = {"a": 3, "b": 1, "gone": 5, "zero": 0, mixing.REST: 1}
    rows = [(i, "t", s, 0) for i, s in enumerate(["a"] * 50 + ["b"] * 12 + ["zero"] * 3 + ["new", None] * 6)] + [(None, None, "a", 0), (0, "t", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, slot int")
    got = mixing.mix(df, shares, block=2, group=5).collect()
    assert len(got) == len(rows)
    digest = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
    for name in ("a", "b", mixing.REST):
        own = sorted((r for r in got if r.source == name), key=lambda r: r.block)
        by_hash = sorted(digest(r.row.doc_id) for r in own)
        for i in range(0, len(own), 2):
            assert sorted(digest(r.row.doc_id) for r in own[i : i + 2]) == by_hash[i : i + 2]
        assert [r.block for r in own] == [i // 2 for i in range(len(own))]
    assert all(r.slot is None and not r.in_mix for r in got if r.source == "zero")
    kept = [r for r in got if r.in_mix]
    last = max(r.slot for r in kept)
    assert {r.slot for r in kept} == set(range(last + 1))
    per = {s: sum(r.source == s for r in kept) for s in ("a", "b", mixing.REST)}
    for s, n in (("a", 3), ("b", 1), (mixing.REST, 1)):
        assert abs(per[s] / 2 - (last + 1) * n / 5) < 1
    assert mixing.mix(df.limit(0), shares).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1})
