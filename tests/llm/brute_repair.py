"""The repair of op13 in plain Python, one conversation at a time, by recursion over its rows."""

import hashlib
import re
import sys
import zlib
from functools import lru_cache

sys.setrecursionlimit(20_000)
SPACE = "\x20\x09-\x0d"
FULL = {"u": "user", "a": "assistant"}


def damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = re.sub(f"[{SPACE}]+$", "", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def next_state(state, initial):
    """States are what has been said so far, as far as it matters: '', s, u or a."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def cheapest(roles, found):
    @lru_cache(None)
    def best(i, state, put):
        out = [(0, "", ())] if i == len(roles) and state in ("", "a") else []
        moves = []
        if put < 3:
            moves += [(5, "I", i, next_state(state, r), put + 1, (None, r)) for r in "ua"]
        if i < len(roles):
            moves.append((2, "D", i + 1, state, 0, None))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] == "truncated" else 0
                moves.append((more, "K", i + 1, next_state(state, roles[i][:1]), 0, (i, roles[i])))
                moves += [(1 + more, "R", i + 1, next_state(state, r), 0, (i, r)) for r in "ua"]
        for cost, letter, j, to, n, made in moves:
            if to is not None and (rest := best(j, to, n)) is not None:
                out.append((cost + rest[0], letter + rest[1], ((made, *rest[2]) if made else rest[2])))
        return min(out, key=lambda x: x[:2]) if out else None

    return best(0, "", 0)


def brute(conv, rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of an undamaged conversation's rows (turn, role, text)."""
    return judged(damage(conv, rows))


def judged(rows):
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, made = cheapest([r for _, r, _ in rows], found)
    text = "\n".join(f"{FULL.get(role, role)}:{'' if i is None else rows[i][2]}" for i, role in made)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest())
