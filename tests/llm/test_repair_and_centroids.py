"""Conversation repair against a search over all edits, centroid clustering against plain rounds."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from graphline.llm import centroids, conversation_repair

GIVEN = "conv_id long, turn long, role string, text string, cost string, copies string, blank int, state long"
GOOD = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    """Conversations after damage, each by turn, role and text."""
    found: dict = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        hit, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        found[conv] += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return {conv: sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, turns in found.items()}


def brute(turns, price=5):
    """What ``repair`` has to say of a conversation after damage, by trying all edits."""
    faults, seen = [], set()
    for _, role, text in turns:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(at: int, initials: str, inserts: int):
        """(cost, audit, output) of the rest, when the last two initials of the output are ``initials``."""
        full = {"": True, "s": False, "u": False, "a": True}[initials[-1:]]
        options = [(0, "", ())] if at == len(turns) and full else []

        def put(cost, edit, name, text, nxt, more):
            new = initials[-1:] + name[:1]
            if new in ("s", "u", "su", "ua", "au"):
                rest = best(nxt, name[:1], more)
                options.append((cost + rest[0], edit + rest[1], (f"{name}:{text}", *rest[2])))

        if inserts < 4:
            for name in ("user", "assistant"):
                put(price, "I", name, "", at, inserts + 1)
        if at < len(turns):
            rest = best(at + 1, initials, 0)
            options.append((2 + rest[0], "D" + rest[1], rest[2]))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                put(more, "K", turns[at][1], turns[at][2], at + 1, 0)
                for name in ("user", "assistant"):
                    put(1 + more, "R", name, turns[at][2], at + 1, 0)
        return min(options, default=(10**9, "", ()))

    cost, audit, output = best(0, "", 0)
    assert GOOD.fullmatch("".join(o[0] for o in output))
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    whole = "\n".join(output)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest(), whole


def conversations():
    rng = random.Random(3)
    rows = []
    for conv in [*range(120), None]:
        turn = rng.choice([0, 5, None])
        for k in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant"]) if rng.random() < 0.9 else rng.choice(["tool", "", None, "User", "s"])
            if rng.random() < 0.6 and rows and rows[-1][0] == conv:
                role = {"user": "assistant", "assistant": "user"}.get(rows[-1][2], "user")
            text = rng.choice(["Hello there.", "What?", "no end", "Yes!", f"Turn {k}.", f"turn {k}", "", " \n\t", None, "é 中文 \U0001f642.", "two\nlines.", "Fine. \x0b "])
            rows.append((conv, turn, role, text))
            turn = None if turn is None or rng.random() < 0.05 else turn + rng.choice([0, 1, 1, 1, 2])
    rows += [rows[4], rows[4], (500, None, None, None), (501, -3, "user", "x" * 70000 + "."), (501, 4, "assistant", "y" * 10)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", 1, 2) for r in rows], GIVEN).repartition(3)


def gathered(conv, turns):
    one = conversation_repair._Conversation(conv)
    for turn, role, text in turns:
        bare = text.strip(conversation_repair.SPACE)
        one.add(turn, role, text, not bare, bare[-1:] in (".", "!", "?"))
    return one


def test_repair(spark):
    rows = conversations()
    expected = {conv: brute(turns) for conv, turns in brute_damage(rows).items()}
    found = conversation_repair.repair(conversation_repair.damaged(frame(spark, rows)), texts=True).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected and len(found) == len(expected)
    assert all(any(v[k] for v in expected.values()) for k in range(6))
    assert {"D", "K", "R"} == set("".join(v[6] for v in expected.values()))  # at these prices an insert never pays


@pytest.mark.parametrize("price", [1, 2, 5])
def test_repair_at_other_prices(monkeypatch, price):
    monkeypatch.setattr(conversation_repair, "INSERT", price)
    monkeypatch.setattr(conversation_repair, "END", np.array([0, 2 * price, price, 0]))
    damaged = brute_damage(conversations())
    expected = {conv: brute(turns, price) for conv, turns in damaged.items()}
    assert price == 5 or any("I" in v[6] for v in expected.values())
    found = conversation_repair._traced([gathered(conv, turns) for conv, turns in damaged.items()], True)
    assert {r[0]: tuple(r[1:]) for r in found} == expected
    # the way of long conversations, taken by every one of them, gives the same
    monkeypatch.setattr(conversation_repair, "LONG_ROWS", 0)
    for conv, turns in damaged.items():
        if turns:
            one = gathered(conv, turns)
            assert one.result(*one.long.result(), None)[1:-1] == expected[conv][:-1]


def test_repair_of_nothing_and_of_a_long_one(spark):
    assert conversation_repair.repair(conversation_repair.damaged(frame(spark, []))).count() == 0
    rng = random.Random(5)
    rows = [(k % 3 and 7, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"a {k % 900}.", "cut off"])) for k in range(6000)]
    found = {r[0]: r for r in conversation_repair.repair(conversation_repair.damaged(frame(spark, rows))).collect()}
    whole = {r[0]: r for r in conversation_repair.repair(conversation_repair.damaged(frame(spark, rows)), texts=True).collect()}
    for conv in (0, 7):  # one by bounded pieces, one held whole
        assert tuple(found[conv]) == tuple(whole[conv])[:-1]
        assert GOOD.fullmatch("".join(line[0] for line in whole[conv]["repaired"].split("\n")))


def vectors(seed: int, spread: float = 1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, spread, (5, 64))
    rows = [(int(k), (middle[k % 5] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist()) for k in range(300)]
    tie = [0.0] * 64
    rows += [(400 + k, [*tie[:-1], 0.5 * (k % 2)]) for k in range(60)]  # many equal vectors, many equal distances
    rows += [(k, rows[k][1]) for k in (0, 0, 3)]  # rows of one vec_id
    left_out = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None, *tie[1:]]), (905, [math.nan, *tie[1:]]), (906, [math.inf, *tie[1:]]), (907, [-math.inf, *tie[1:]])]
    return rows + [(None, tie)], left_out


def brute_clusters(rows, clusters=16, rounds=3):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in whole)
    now = [v for _, v in order[:clusters]]
    x = np.array([v for _, v in whole], np.int64)
    for r in range(rounds + 1):
        squared = ((x[:, None, :] - np.array(now)[None]) ** 2).sum(2)
        cluster = squared.argmin(1)
        if r < rounds:
            now = [[int(s) // int((cluster == c).sum()) for s in x[cluster == c].sum(0)] if (cluster == c).any() else now[c] for c in range(len(now))]
    distance = squared.min(1)
    total = {c: int(distance[cluster == c].sum()) for c in set(cluster.tolist())}
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in now]
    return sorted((str(i), int(c), int(d), total[c], int(distance.sum()), digest[c]) for (i, _), c, d in zip(whole, cluster.tolist(), distance, strict=True))


def embedded(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, [3]) for r in rows], "vec_id long, embedding array<float>, cluster int, distance long, vector array<int>").repartition(3)


@pytest.mark.parametrize(("seed", "spread"), [(1, 1.0), (2, 0.02), (3, 50.0)])
def test_centroids(spark, seed, spread):
    rows, left_out = vectors(seed, spread)
    found = centroids.report(embedded(spark, rows + left_out)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == brute_clusters(rows)


def test_bounds_spare_distances(spark):
    rows, _ = vectors(4, 3.0)
    found, now = centroids.cluster(embedded(spark, rows))
    took = [r["calculations"] for r in found.collect()]
    assert len(now) == 16 and sum(took) < 0.6 * len(took) * 16 * 4


def test_few_vectors(spark):
    rows, left_out = vectors(6)
    assert centroids.report(embedded(spark, left_out)).count() == 0
    for few in ([(1, [0.25] * 64)], [(k, [k / 7] * 64) for k in range(5)]):
        assert sorted((str(r[0]), *r[1:]) for r in centroids.report(embedded(spark, few)).collect()) == brute_clusters(few)
    with pytest.raises(Exception, match="component beyond"):
        centroids.report(embedded(spark, [(1, [1e30] * 64)])).collect()
