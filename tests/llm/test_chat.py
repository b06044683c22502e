"""Chat formatting against plain code, with nulls, ties, repeats, copies, prefixes and a conversation over many partitions."""

import hashlib
import random
from collections import Counter

from quillnet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece int, place long"


def plain(rows, turns=chat.TURNS):
    logged: dict = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        logged.setdefault(conv, set()).add((turn is not None, turn, digest, role, text))
    said = {c: [x[3:] for x in sorted(s, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, s in logged.items()}
    out = Counter()
    for c, xs in said.items():
        longer = any(len(ys) > len(xs) and ys[: len(xs)] == xs for ys in said.values())
        equal = [k for k, ys in said.items() if ys == xs]
        if longer or c != min(equal, key=lambda k: (k is None, k or 0)):
            continue
        for at in range(0, len(xs), turns):
            part = xs[at : at + turns]
            text = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in part)
            out[c, at // turns, at, len(part), len(equal), text] += 1
    return out


def test_chat(spark):
    pick = random.Random(3)
    rows = []
    base = [("system", "be kind"), *[(("user", "assistant")[k % 2], f"turn {k}" + " é😀" * (k % 3)) for k in range(300)]]
    for n in (1, 2, 3, 7, 120, 301, 301):
        conv = len(rows) + 10
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(base[:n])]
    for conv in range(5000, 5060):  # a common first turn, short vocabulary: many prefixes and copies
        rows += [(conv, 2 * k, "user" if k % 2 else "system", "hello" if not k else pick.choice("ab")) for k in range(pick.randint(1, 5))]
    rows += [(7, None, None, None), (7, None, None, None), (7, 1, "user", "x<|im_end|>"), (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (8, 2, "", ""), (9, 1, "user", "a"), (9, 1, "a", "user")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (6001, 0, "user", "no id"), (6002, 0, "use", "rno id"), (6003, 0, None, ""), (6004, 0, "", None)]
    rows += [(6005, 0, "user", "w " * 200_000), (6006, 0, "user", "w " * 200_000), (6006, 1, "assistant", "long")]
    rows += rows[5:25]
    pick.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    assert Counter(map(tuple, chat.rendered(df).collect())) == plain(rows)
    assert Counter(map(tuple, chat.rendered(df, 3).collect())) == plain(rows, 3)
    assert chat.rendered(df.limit(0)).count() == 0
    only = df.where("conv_id = 6005")
    assert chat.rendered(only).count() == 1


def test_stretches_combine():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(40)]
    whole = 0
    for d in digests:
        whole = chat.rolled(whole, d)
    edges, at = [], 0
    for part, n in enumerate((7, 1, 20, 12)):
        state = 0
        for d in digests[at : at + n]:
            state = chat.rolled(state, d)
        edges.append({"part": part, "first": 5, "first_n": n, "first_hash": state.to_bytes(16, "big"), "whole": True, "final": 5, "final_n": n, "final_hash": state.to_bytes(16, "big")})
        at += n
    carry = chat.carried(edges)
    assert [carry[k][0] for k in range(4)] == [0, 7, 8, 28] and [carry[k][2] for k in range(4)] == [True, True, True, False]
    state = carry[3][1]
    for d in digests[28:]:
        state = chat.rolled(state, d)
    assert state == whole
