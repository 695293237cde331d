"""The trie against a plain one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from podium.llm import conversations

SCHEMA = "conv_id long, turn int, role string, text string, id string, leaf int"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    members = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    out = []
    for node, who in members.items():
        under = [x for x in members if x[:len(node)] == node]
        leaves = sum(not any(len(y) == len(x) + 1 and y[:-1] == x for y in members) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        last = ",".join(str(c) for c in sorted(c for c, end in who if end))
        out.append((min(c for c, _ in who), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(who),
                    sum(len(y) == len(node) + 1 and y[:-1] == node for y in members), leaves, saved,
                    hashlib.sha256(last.encode()).hexdigest()))
    return out


def by_value(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def given(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(4 * n), n):
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "hello there"])))
    return rows


@pytest.mark.parametrize("component", [1, 4, 30, 20_000])
def test_trie_is_the_plain_one(spark, component):
    rows = given()
    # a long conversation, copies of one, null turns, a base that is absent, a key seen once
    rows += [(1000, t, "user", f"turn {t % 7}") for t in range(120)] + [(1003, t, "user", f"turn {t % 7}") for t in range(120)]
    rows += [(2000 + 5 * i, t, "user", "same") for i in range(30) for t in range(3)]
    rows += [(7, None, "user", "first"), (3333, 0, "user", "x"), (None, 0, "user", "nobody")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = conversations.trie(df, component)
    assert by_value(got.collect()) == by_value(plain(rows))
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]


def test_hot_joins_are_spread_and_whole(spark, monkeypatch):
    monkeypatch.setattr(conversations, "HOT", 3)
    monkeypatch.setattr(conversations.join_spread, "__defaults__", (3,))
    monkeypatch.setattr(conversations, "TASK_NODES", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = given(2, 40) + [(1000, t, "user", str(t)) for t in range(80)]
        df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
        assert by_value(conversations.trie(df, 10).collect()) == by_value(plain(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.trie(empty).isEmpty()
    rows = [(5, 0, "user", "x")] * 3 + [(6, 1, "b", "y"), (6, 1, "b", "y")]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert by_value(conversations.trie(df).collect()) == by_value(plain(rows))
    lone = spark.createDataFrame([(None, 0, "user", "x", "", 0)], SCHEMA)
    assert conversations.trie(lone).isEmpty()
