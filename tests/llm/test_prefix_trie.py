"""The prefix trie against a plain walk over all prefixes."""

import collections
import hashlib
import math
import random
import zlib

import pytest

from ledgerframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, key int, a string, rows string, block string"


def brute(rows):
    """Every node as the query gives it, from lists of turns."""
    original = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            original[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in original.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *turns[h:])
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for prefix, found in members.items():
        own_saving = (len(found) - 1) * len(prefix[-1][1]) if prefix else 0
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += own_saving
            leaves[prefix[:d]] += not children[prefix]
    nodes = set()
    for prefix, found in members.items():
        ended = ",".join(map(str, sorted(c for c in found if len(rebuilt[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        digest = hashlib.sha256(ended.encode()).hexdigest()
        nodes.add((min(found), len(prefix), parent, len(found), children[prefix], leaves[prefix], saved[prefix], digest))
    return nodes


def nodes_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "x", "x", "x") for r in rows], SCHEMA)
    found = [tuple(r) for r in prefix_trie.trie(prefix_trie.spliced(prefix_trie.turn_rows(frame))).collect()]
    assert len(found) == len(set(found))
    return set(found)


def awkward():
    rng = random.Random(5)
    rows = []
    for c in [*range(40), *range(100, 140), -7, -100, -130, 10**12]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "", None, "é漢"])))
    # one conversation holds a third of the turns; others repeat its first turns, or the whole of it
    long = [(turn, "user", f"turn {turn}") for turn in range(70)]
    for c, stop in [(200, 70), (201, 70), (202, 50), (203, 8), (204, 16), (205, 17)]:
        rows += [(c, *t) for t in long[:stop]]
    # many equal conversations, turns of one number, missing numbers and ids, a very long text
    rows += [(c, 0, "user", "same") for c in range(300, 400)]
    rows += [(500, 1, "b", "x"), (500, 1, "a", "y"), (500, 1, "a", "y"), (500, None, "z", "first"), (None, 0, "user", "nobody")]
    rows += [(501, 0, "user", "w" * 300_000), (501, 1, "user", "tail"), (600, 0, "ab", "c"), (601, 0, "a", "bc")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "stretch"), [(8, 1 << 15), (3, 2)])
def test_nodes(spark, monkeypatch, width, stretch):
    # both are part of the plan, so tasks see them
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rows = awkward()
    assert nodes_of(spark, rows) == brute(rows)


def test_hot_conversation_and_hot_parent_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "join_counted", lambda *a, **k: join(*a, **k, hot_rows=10))
    from ledgerframe.operators.skew import join_counted as join

    rows = awkward()
    assert nodes_of(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert nodes_of(spark, []) == set()
    assert nodes_of(spark, [(None, 1, "user", "x")]) == set()
