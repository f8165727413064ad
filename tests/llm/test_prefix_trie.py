import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import prefix_trie as pt


def plain(rows):
    """The contract, by lists of turns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {(): sorted(built)}
    for c, turns in built.items():
        for d in range(1, len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves = sum(totals[x][0] for x in below) if below else 1
        own_saving = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (leaves, own_saving + sum(totals[x][1] for x in below))
    out = []
    for node, convs in members.items():
        ends = [c for c in sorted(convs) if len(built[c]) == len(node)]
        out.append((
            min(convs, default=None), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
            *totals[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def made(seed, convs=150, copies=30):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        conv = rng.choice([c, 100 * (c % 3) + c % 100])
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", "", None, "ü€"])))
    whole = [(i, r, t) for i, (r, t) in enumerate([("user", "hello"), ("assistant", "hello there"), ("user", "go on"), ("x", "y" * 20)] * 2)]
    for c in range(400, 400 + copies):
        rows += [(c, *turn) for turn in whole[: 3 + c % 6]]
    return rows + rows[5:9] + [(None, 1, "user", "lost")]


SCHEMA = "conv_id long, turn long, role string, text string"


def key(row):
    return tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in row)


def columns(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_same_as_by_lists(spark, monkeypatch, seed, small):
    if small:  # many chunks and blocks
        monkeypatch.setattr(pt, "CHUNK", 2)
        monkeypatch.setattr(pt, "ID_BITS", 2)
    rows = made(seed)
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA + ", node long, d string").repartition(5)
    assert columns(pt.prefix_trie(df)) == sorted(plain(rows), key=key)


def test_one_very_long_conversation_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 64)
    rows = [(100, i, "user", f"t{i}") for i in range(900)] + [(200, i, "user", f"t{i}") for i in range(700)]
    rows += [(300, 0, "user", "long " * 200_000), (301, 0, "user", "long " * 200_000)]
    assert columns(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == sorted(plain(rows), key=key)


def test_empty_and_turnless(spark):
    assert columns(pt.prefix_trie(spark.createDataFrame([], SCHEMA))) == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256(b"").hexdigest())]
    # No base and no more than h turns: nothing is left, but the root has the member.
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lone, 0, "user", "a")]
    assert columns(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_queue_spills_and_keeps_order():
    rng = random.Random(4)
    queue, want = pt._Queue(7), {}
    messages = [(rng.randint(0, 5), f"n{rng.randint(0, 9)}", rng.randint(0, 3), rng.randint(0, 9)) for _ in range(500)]
    for depth, node, leaves, saved in messages:
        queue.push(depth, node, leaves, saved)
        n, a, b = want.get((depth, node), (0, 0, 0))
        want[(depth, node)] = (n + 1, a + leaves, b + saved)
    assert queue.runs
    for depth, node in sorted({(d, f"n{i}") for d in range(6) for i in range(10)}, key=lambda x: (-x[0], x[1])):
        assert queue.pull(depth, node) == want.get((depth, node), (0, 0, 0))
    assert not queue.heap and not queue.runs
    queue.push(3, "b", 1, 1)
    with pytest.raises(AssertionError):
        queue.pull(2, "a")


def test_totals_of_a_forest_with_small_queues(spark):
    rng = random.Random(9)
    nodes = [("r", None, 0, 9, 0, 0, 0, 0, True)]
    for i in range(300):
        parent = rng.choice(nodes)
        nodes.append((f"k{i}", parent[0], parent[2] + 1, rng.randint(1, 5), rng.randint(0, 4), 0, 0, 0, False))
    df = spark.createDataFrame(nodes, "node string, parent string, d long, n_convs long, size long, sent long, leaves long, saved long, top boolean")
    got = {r["node"]: tuple(r)[1:] for r in pt.forward_totals(df.repartition(1).sortWithinPartitions(df["d"].desc(), "node"), queue_rows=5).collect()}
    below = {}
    for n in nodes:
        below.setdefault(n[1], []).append(n)

    def total(n):
        parts = [total(x) for x in below.get(n[0], [])]
        return len(parts), sum(p[1] for p in parts) if parts else 1, (n[3] - 1) * n[4] + sum(p[2] for p in parts)

    assert got == {n[0]: total(n) for n in nodes}
