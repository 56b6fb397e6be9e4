"""Plain versions of the operators on conversations, over lists of rows in memory."""

import hashlib
import re
import zlib
from collections import defaultdict

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def damaged(rows):
    """Rows (conv, turn, role, text) by conversation, in order, after the damage of op12."""
    out = defaultdict(list)
    for conv, turn, role, text in in_order([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]):
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows, marks):
    """Cost, audit and repaired lines: the least pair over all edits, from the last row to the first."""
    n = len(rows)
    best = [{} for _ in range(n + 1)]
    best[n] = {"": (0, "", ()), "a": (0, "", ())}
    for i in range(n, -1, -1):
        here = best[i]
        if i < n:
            _, role, text = rows[i]
            more = int(marks[i] == "truncated")
            for state in NEXT:
                ways = []
                if state in best[i + 1]:
                    c, a, lines = best[i + 1][state]
                    ways.append((c + 3, "D" + a, lines))
                if marks[i] not in ("blank", "duplicate"):
                    for initial, to in NEXT[state].items():
                        if to not in best[i + 1]:
                            continue
                        c, a, lines = best[i + 1][to]
                        if role[:1] == initial:
                            ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                        if initial in ROLES:
                            ways.append((c + 2 + more, "R" + a, (f"{ROLES[initial]}:{text}", *lines)))
                if ways:
                    here[state] = min(ways)
        for _ in range(4):
            for state in NEXT:
                for initial, to in NEXT[state].items():
                    if initial in ROLES and to in here:
                        c, a, lines = here[to]
                        way = (c + 2, "I" + a, (f"{ROLES[initial]}:", *lines))
                        here[state] = min(here.get(state, way), way)
    return best[0][""]


def repaired(rows):
    """Per conversation the columns of op12."""
    after, out = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        own = after.get(conv, [])
        marks = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = cheapest(own, marks)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)),
        )
    return out


def rebuilt(rows):
    """Sequences of (role, text) by conversation, as op13 rebuilds them."""
    own = defaultdict(list)
    for conv, _, role, text in in_order([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]):
        own[conv].append((role, text))
    out = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        out[conv] = (*own.get(base, [])[:h], *own[conv][h:])
    return out


def trie(rows):
    """The nodes of op13, each as a tuple of its columns."""
    sequences, members = rebuilt(rows), defaultdict(list)
    for conv in sorted(sequences):
        for d in range(len(sequences[conv]) + 1):
            members[sequences[conv][:d]].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * words
    return {
        (
            m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node],
            sha(",".join(str(c) for c in m if len(sequences[c]) == len(node))),
        )
        for node, m in members.items()
    }
