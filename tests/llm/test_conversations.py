import random
from datetime import datetime, timedelta

import pytest

from tessera.llm import conversations as c

SCHEMA = "id string, chat_id string, role string, content string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, span string"
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}
START = datetime(2025, 1, 1)


def make(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for chat in range(60):
        at = START + timedelta(days=rng.randrange(5))
        turns = ["user", "assistant"] * rng.randrange(0, 6)
        if rng.random() < 0.4 and turns:
            k = rng.randrange(len(turns))
            turns[k : k + rng.randrange(2)] = rng.choices(["user", "assistant", "system", "tool", "moderator", "Human ", " AI"], k=rng.randrange(1, 3))
        for r in turns:
            at += timedelta(microseconds=1) if rng.random() < 0.5 else timedelta(hours=rng.randrange(1, 60))
            n += 1
            gone = at if rng.random() < 0.05 else None
            text = rng.choice(["hello", "hello", "hello", "​ \n", None]) if rng.random() < 0.15 else f"text {n}"
            rows.append((f"m{n:04}", f" C{chat} ".upper() if n % 2 else f"c{chat}", r, text, at, START, gone, "x"))
            if rng.random() < 0.2:  # an earlier state
                rows.append((f"m{n:04}", f"c{chat}", "other", text, at, START - timedelta(days=1), None, "x"))
    rng.shuffle(rows)
    return rows + rows[:20] + [("z", None, "user", "x", START, START, None, "x"), (None, "c1", "user", "x", START, START, None, "x")]


def brute(rows):
    cur = {}
    for r in rows:
        if r[0] and (r[0] not in cur or r[5] > cur[r[0]][5]):
            cur[r[0]] = r
    chats = {}
    for r in cur.values():
        if r[1]:
            chats.setdefault(r[1].strip().lower(), []).append(r)
    kept = {}
    for chat, ms in chats.items():
        ms = sorted((m for m in ms if m[6] is None and m[3] and m[3].replace("​", "").strip()), key=lambda m: m[4])
        roles = [ROLES.get(m[2].strip().lower()) for m in ms]
        said = [r for r in roles if r in ("user", "assistant")]
        if None not in roles and said and said == ["user", "assistant"] * (len(said) // 2):
            kept[chat] = [(r, m[3]) for r, m in zip(roles, ms)]
    return set(chats) - set(kept), kept


@pytest.mark.parametrize("seed,size,floor", [(1, 64, None), (2, 2, None), (3, 3, 6)])
def test_against_brute_force(spark, seed, size, floor):
    rows = make(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    dropped, kept = brute(rows)
    assert {r.chat_id for r in c.broken_chats(df, size, 2, floor).collect()} == dropped
    got = {}
    for r in c.conversations(df, size, 2, floor).orderBy("chat_id", "turn").collect():
        got.setdefault(r.chat_id, []).append((r.role, r.content))
    assert got == kept


@pytest.mark.parametrize("lost", [None, 123])
def test_a_chat_of_many_messages(spark, monkeypatch, lost):
    """Cut into spans of time that meet in seams; a reply that is missing in the middle breaks it."""
    monkeypatch.setattr(c, "PIECES", 7)
    rows = [(f"m{i:04}", "c", ("user", "assistant", "tool")[i % 3] if i % 3 < 2 else "tool", f"t{i}", START + timedelta(seconds=i), START, None, "x") for i in range(399) if i != lost]
    df = spark.createDataFrame(rows, SCHEMA)
    assert c.broken_chats(df, 10, 2, 50).count() == (0 if lost is None else 1)
    got = [r.message_id for r in c.conversations(df, 10, 2, 50).orderBy("turn").collect()]
    assert got == ([r[0] for r in rows] if lost is None else [])


def frags(*exports, chat="c"):
    """Exports as strings of messages; a capital letter is a user's."""
    return [(chat, f"e{k}", p, m, "user" if m.isupper() else "assistant") for k, e in enumerate(exports) for p, m in enumerate(e)]


GIVEN = [
    (["AbC", "bCdE", "dEf"], "AbCdEf"),  # overlaps of several messages
    (["dEf", "AbC", "bCdE"], "AbCdEf"),  # the order of exports doesn't matter
    (["AbCd", "AbCd", "CdEf"], "AbCdEf"),  # one doubled
    (["AbCdEf", "bCd"], "AbCdEf"),  # one within another
    (["AbCd", "bCdE", "CdEf"], "AbCdEf"),  # an edge that two others lead along
    (["AbC", "dEf"], ""),  # one missing between them
    (["AbCd", "CdEf", "CdGh"], ""),  # two go on from one place
    (["AbCd", "XyCd", "CdEf"], ""),  # two lead to one place
    (["AbCd", "CdAb"], ""),  # a circle
    (["AbC", "CDe"], ""),  # one path, but a reply is missing
    (["Ab"], "Ab"),
]


def test_given_fragments(spark, monkeypatch):
    monkeypatch.setattr(c, "STRETCH", 3)
    rows = [r for k, (exports, _) in enumerate(GIVEN) for r in frags(*exports, chat=f"c{k}")]
    df = spark.createDataFrame(rows, "chat_id string, export string, pos int, message_id string, role string")
    got = {}
    for r in c.conversations_of_fragments(df).orderBy("chat_id", "turn").collect():
        got[r.chat_id] = got.get(r.chat_id, "") + r.message_id
    assert got == {f"c{k}": want for k, (_, want) in enumerate(GIVEN) if want}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.broken_chats(df).count() == 0 and c.conversations(df).count() == 0
