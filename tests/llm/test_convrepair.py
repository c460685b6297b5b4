"""Conversation repair against a brute-force search over all edits."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from lexibridge.llm import convrepair

BLANK = " \t\n\x0b\x0c\r"


def damaged(given):
    """The damaged rows of each conversation in order, by hand."""
    out = {}
    for conv, turn, role, text in given:
        rows = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(BLANK)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, hash): every order of edits is tried, but those that already cost more than the best."""
    found, best = faults(rows), (2 * len(rows), "D" * len(rows), [])

    def search(i, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            legal = all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
            if legal and (cost, audit) < best[:2]:
                best = (cost, audit, out)
        else:
            _, role, text = rows[i]
            stay = cost + (5 if found[i] == "t" else 0)
            search(i + 1, cost + 2, audit + "D", out)
            if found[i] not in ("b", "d"):
                search(i + 1, stay, audit + "K", [*out, (role, text)])
                search(i + 1, stay + 1, audit + "R", [*out, ("user", text)])
                search(i + 1, stay + 1, audit + "R", [*out, ("assistant", text)])
        search(i, cost + 5, audit + "I", [*out, ("user", "")])
        search(i, cost + 5, audit + "I", [*out, ("assistant", "")])

    search(0, 0, "", [])
    return (*best[:2], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest())


def brute(given):
    want = {}
    for conv, rows in damaged(given).items():
        turns = [t for t, _, _ in rows if t is not None]
        f, initials = faults(rows), [r[:1] for _, r, _ in rows]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in itertools.pairwise(initials))
        want[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("b"), f.count("d"), f.count("t"), illegal, *cheapest(rows))
    return want


def found(spark, given):
    df = spark.createDataFrame([(*g, "x", 1) for g in given], "conv_id long, turn int, role string, text string, block string, pos int")
    rows = convrepair.repair(df, convrepair.damage(df)).collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def small(seed, n):
    r = random.Random(seed)
    given = []
    for conv in range(n):
        for turn in range(r.randint(1, 4)):
            given.append((conv + 1000 * seed, r.choice((turn, turn, turn, turn + 1, None)), r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)), r.choice(("One.", "Two!", "cut off", "", " \n", None, "Three?", "One."))))
    return given


@pytest.mark.parametrize("bits", [12, 0])
def test_small_conversations_equal_brute_force(spark, monkeypatch, bits):
    # With blocks of one row every repair is a product of several matrices.
    monkeypatch.setattr(convrepair, "BLOCK_BITS", bits)
    given = small(3, 150)
    assert found(spark, given) == brute(given)


def test_blocks_multiply_to_the_whole():
    r = random.Random(7)
    for _ in range(400):
        rows = [(r.choice("suax "), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(2, 14))]
        cut = r.randint(1, len(rows) - 1)
        for start in range(4):
            whole, joined = convrepair.block_weights(rows, start), {}
            for mid, (cost, labels) in convrepair.block_weights(rows[:cut], start).items():
                for stop, (more, rest) in convrepair.block_weights(rows[cut:], mid).items():
                    convrepair._better(joined, stop, (cost + more, labels + rest))
            assert whole == joined


def test_null_ids_turns_and_repeated_rows(spark):
    given = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Yes."), (None, 4, "assistant", "Yes."), (5, None, "user", "a."), (5, None, "assistant", "b."), (6, 7, "", ""), (7, 2**31 - 1, "user", "é" * 200_000), (7, -(2**31), "system", "s.")]
    assert found(spark, given) == brute(given)


def test_empty_table_and_conversations_without_rows(spark):
    assert found(spark, []) == {}
    gone = [(c, 0, "user", "Hi.") for c in range(400) if crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and set(found(spark, gone).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_one_conversation_may_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(convrepair, "BLOCK_BITS", 6)
    given = [(1, i, ("user", "assistant")[i % 2], f"Line {i % 700}.") for i in range(3000)]
    rows = damaged(given)[1]
    f = faults(rows)
    weights = convrepair.block_weights([(r[1][:1], x in ("b", "d"), x == "t") for r, x in zip(rows, f, strict=True)], 0)
    convrepair._insertions(weights)
    got = found(spark, given)[1]
    assert got[1:4] == tuple(f.count(x) for x in "bdt") and got[5:7] == min(weights[s] for s in convrepair.FINAL if s in weights)
    assert got[7] != hashlib.sha256().hexdigest()
