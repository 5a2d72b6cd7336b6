import hashlib
import random
import zlib
from collections import Counter

import pytest

from scorelane.llm.prefixes import UNIT, Forest, trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
TURN = "conv_id bigint, turn bigint, role string, text string, key string, parent string, saved string"


def digest(row):
    role, text = row.role or "", row.text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def by_rule(rows):
    own = {}
    for row in rows:
        if row.conv_id is not None:
            own.setdefault(row.conv_id, []).append(row)
    for turns in own.values():
        turns.sort(key=lambda r: (r.turn is not None, r.turn or 0, digest(r)))
    said = {c: [(r.role or "", r.text or "") for r in turns] for c, turns in own.items()}
    rebuilt = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = said.get(base, [])[:h] + said[c][h:]
    members, children, leaves, saved = {}, {}, {}, {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        weight = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + weight
    found = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in held if len(rebuilt[c]) == len(node))
        found.append((
            held[0], len(node), members[node[:-1]][0] if node else None, len(held), len(children.get(node, [])),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(found)


def found_in(conversations, **how):
    return Counter(tuple(row) for row in trie(conversations, **how).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def odd_conversations(spark):
    """Nulls, gaps, ties, repeated turns, a long conversation, copies, and few distinct texts."""
    chance = random.Random(4)
    rows = []
    for c in [*range(-12, 90), 2**60, None]:
        for turn in range(chance.randrange(1, 9)):
            text = chance.choice(["a", "b", "é" * 5, "", None])
            rows.append((c, chance.choice([turn, turn, 3, None]), chance.choice(["user", None, ""]), text))
    rows += [(200, turn, "user", "t" * (turn % 3)) for turn in range(150)]
    rows += [(205, turn, "user", "t" * (turn % 3)) for turn in range(150)]
    rows += [(c, 0, "user", "same") for c in range(300, 400)]
    rows += rows[:20]
    return spark.createDataFrame([(*row, "x", "y", "z") for row in rows], TURN)


@pytest.mark.parametrize(
    "how", [{}, {"run_strings": 1}, {"run_strings": 7}, {"run_bytes": 300}, {"chunk": 4, "run_strings": 5}, {"chunk": 1}]
)
def test_odd_conversations(odd_conversations, how):
    """Whatever the length of runs and strings, and however many boundaries a node crosses."""
    if how.get("chunk") == 1:
        odd_conversations = odd_conversations.where("conv_id < 90")
    assert found_in(odd_conversations, **how) == by_rule(odd_conversations.collect())


def test_test_conversations(spark, folder):
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    assert found_in(conversations, run_strings=3) == by_rule(conversations.collect())


def test_a_conversation_can_lose_all_turns(spark):
    """One that takes more turns of an absent conversation than it has is the empty sequence."""
    rows = [(c, 0, "user", "only") for c in range(1, 60) if c % 5]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = found_in(conversations)
    assert found == by_rule(conversations.collect())
    assert sum(n for row, n in found.items() if row[1] == 0) == 1


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], TURN)).count() == 0


def key_of(text):
    return b"\0" * UNIT + b"".join(text[: i + 1].encode().rjust(UNIT, b"_") for i in range(len(text)))


def test_merges_make_branching_nodes():
    """Inner strings only: those at the ends stay open."""
    texts = ["a", "bcd", "bce", "bf", "bf", "g"]
    sizes = (5).to_bytes(8, "little") * 3
    rows = [(10 + i, key_of(t), sizes[: 8 * len(t)], False, None) for i, t in enumerate(texts)]
    nodes = {bytes(n[1]).strip(b"_\0").decode(): n for n in Forest(rows, 0).nodes if n[0] != "piece"}
    assert nodes["b"][0] == "closed" and nodes["b"][5:11] == [11, None, 4, 2, 3, 25]
    assert nodes["bc"][5:11] == [11, 11, 2, 2, 2, 5] and nodes["bf"][5:11] == [13, 11, 2, 0, 1, 5]
    assert {name for name, n in nodes.items() if n[0] == "open"} == {"", "a", "g"}
    assert nodes[""][8:11] == [1, 3, 25]
