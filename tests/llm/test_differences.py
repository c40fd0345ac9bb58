"""Differences from a pivot: how many keys they give, how many a task holds, and that sets which link share one."""

import random

import pyarrow as pa

from voyage.llm import ngram_jaccard as nj


def _keys(texts: list[str], num: int, den: int) -> tuple[dict[int, set[int]], list[int]]:
    """Keys by id, and the rows of each batch; the first text is the pivot."""
    rows = len(texts)
    none = pa.array([None] * rows, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * rows), pa.array([0] + [1] * (rows - 1), pa.int32()), pa.array([0] * rows), pa.array(range(rows)), pa.array(texts), none, none],
        ["tile", "side", "pivot", "id", "text", "tokens", "counts"],
    )
    keys: dict[int, set[int]] = {}
    sizes = []
    for out in nj.differences(1, num, den)(iter([batch])):
        sizes.append(out.num_rows)
        for i, key in zip(out.column("id").to_pylist(), out.column("key").to_pylist(), strict=True):
            if key is not None:
                keys.setdefault(i, set()).add(key)
    return keys, sizes


def test_sets_far_larger_than_the_pivot_have_few_keys():
    """Their number grew with the square of a set's size over the pivot's: 141,376 here."""
    own = " ".join(f"w{k}" for k in range(1500))
    keys, _ = _keys(["a b c d e f g h", own], 80, 100)
    assert 0 < len(keys[1]) < 3000


def test_a_task_holds_few_keys_at_a_time(monkeypatch):
    monkeypatch.setattr(nj, "KEYS", 1000)
    texts = ["a b c d e f g h"] + [" ".join(f"v{k}x{j}" for k in range(200)) for j in range(40)]
    keys, sizes = _keys(texts, 80, 100)
    assert len(sizes) > 3 and max(sizes) < 1000 + 4 * 200
    assert set(keys) == set(range(1, 41))


def test_sets_that_link_share_a_key_whatever_their_pivot():
    rng = random.Random(5)
    for trial in range(300):
        num = rng.choice((65, 80, 90, 100))
        base = [f"b{k}" for k in range(rng.randint(1, 120))]
        own = [f"o{k}" for k in range(rng.randint(0, 300))] + base[: rng.randint(0, len(base))]
        if not own:
            continue
        near = [w for w in own if rng.random() > 0.06] + [f"n{k}" for k in range(rng.randint(0, max(1, len(own) // 12)))]
        a, b = set(own), set(near)
        if a == b or a == set(base) or b == set(base) or 100 * len(a & b) < num * len(a | b):
            continue
        keys, _ = _keys([" ".join(base), " ".join(own), " ".join(near)], num, 100)
        if 100 * len(a & set(base)) >= num * len(a | set(base)) and 100 * len(b & set(base)) >= num * len(b | set(base)):
            continue  # the pivot connects them
        assert keys[1] & keys[2], trial
