"""Plain, single-machine statement of the comparison rules, for checking the Spark operators."""

from __future__ import annotations

K, W = 15, 10
BASES = "ACGT"


def rc(s: str) -> str:
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(b, "N") for b in reversed(s))


def code(word: str) -> int:
    n = 0
    for b in word:
        n = n * 4 + BASES.index(b)
    return n


def minimizers(seq: str, reverse: bool = False) -> list[tuple[int, int]]:
    """Sorted (pos, key): every window of W k-mers without N gives its rightmost smallest."""
    found = set()
    for start in range(len(seq) - K - W + 2):
        window = seq[start : start + K + W - 1]
        if set(window) <= set(BASES):
            keys = []
            for i in range(W):
                word = window[i : i + K]
                keys.append((code(rc(word) if reverse else word), -(start + i)))
            key, pos = min(keys)
            found.add((-pos, key))
    return sorted(found)


def anchors(q: str, t: str, same: bool, most: int | None = None) -> list[tuple[int, int, int]]:
    """(q, t, t along the strand), frequent target keys thinned to ``most`` evenly spaced ones."""
    index: dict[int, list[int]] = {}
    for pos, key in minimizers(t, reverse=not same):
        index.setdefault(key, []).append(pos)
    for key, ps in index.items():
        if most and len(ps) > most:
            index[key] = [ps[i] for i in sorted({i * (len(ps) - 1) // (most - 1) for i in range(most)})]
    return [(qp, tp, tp if same else len(t) - tp - K) for qp, key in minimizers(q) for tp in index.get(key, [])]


def usable(part) -> bool:
    return len(part) >= 3 and all(
        max(a[i] for a in part) - min(a[i] for a in part) + K >= 100 for i in (0, 1))


def chains(anchor_list) -> list[list]:
    buckets: dict[int, list] = {}
    for a in anchor_list:
        buckets.setdefault((a[2] - a[0]) // 512, []).append(a)
    out = []
    for b in sorted(buckets):
        rows = sorted(set(buckets[b]), key=lambda a: (a[0], a[2], a[1]))
        cur = [rows[0]]
        for a in rows[1:]:
            dq, dt = a[0] - cur[-1][0], a[2] - cur[-1][2]
            if 0 < dq <= 20000 and 0 < dt <= 20000:
                cur.append(a)
            else:
                out.append(cur)
                cur = [a]
        out.append(cur)
    return [c for c in out if usable(c)]


def split(chain) -> list[list]:
    out, cur = [], [chain[0]]
    for a in chain[1:]:
        gq, gt = a[0] - cur[-1][0] - K, a[2] - cur[-1][2] - K
        if (max(gq, gt) > 8192 or abs(gq - gt) > 64) and usable(cur):
            out.append(cur)
            cur = [a]
        else:
            cur.append(a)
    if usable(cur):
        out.append(cur)
    return out or [chain]


def summary(chain) -> dict:
    s = {"q0": min(a[0] for a in chain), "q1": max(a[0] for a in chain) + K, "t0": min(a[1] for a in chain),
         "t1": max(a[1] for a in chain) + K, "o0": min(a[2] for a in chain), "o1": max(a[2] for a in chain) + K}
    covered, end = 0, 0
    for a in chain:
        covered += max(0, a[0] + K - max(a[0], end))
        end = max(end, a[0] + K)
    s["pid"] = min(10000, int(10000 * covered / max(s["q1"] - s["q0"], s["t1"] - s["t0"]) + 0.5))
    return s


def merge(parts) -> list[list]:
    parts = sorted(parts, key=lambda c: [summary(c)[k] for k in ("q0", "q1", "o0", "o1")])
    out: list[list] = []
    for c in parts:
        if out:
            a, b = summary(out[-1]), summary(c)
            gq, gt = b["q0"] - a["q1"], b["o0"] - a["o1"]
            if min(gq, gt) >= -32 and max(gq, gt) <= 256 and abs(gq - gt) <= 64 and \
                    abs((a["o0"] - a["q0"]) - (b["o0"] - b["q0"])) <= 6000:
                out[-1] = out[-1] + c
                continue
        out.append(c)
    return out


def align(a: str, b: str, band: int) -> str:
    """Full-table affine alignment with the tie rules spelled out; returns plain op text."""
    m, n = len(a), len(b)
    neg = -(10 ** 9)
    ok = lambda i, j: abs((j - i) - (n - m)) <= band
    S = {s: [[neg] * (n + 1) for _ in range(m + 1)] for s in "MID"}
    S["M"][0][0] = 0
    for i in range(1, m + 1):
        if ok(i, 0):
            S["I"][i][0] = -5 - i
    for j in range(1, n + 1):
        if ok(0, j):
            S["D"][0][j] = -5 - j
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            if ok(i, j):
                S["M"][i][j] = max(S[s][i - 1][j - 1] for s in "MID") + (2 if a[i - 1] == b[j - 1] else -3)
                S["I"][i][j] = max(S["M"][i - 1][j] - 6, S["I"][i - 1][j] - 1)
                S["D"][i][j] = max(S["M"][i][j - 1] - 6, S["D"][i][j - 1] - 1)
    i, j, ops = m, n, []
    state = max("MID", key=lambda s: (S[s][m][n], -"MID".index(s)))
    while i or j:
        if state == "M":
            ops.append("M" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
            state = max("MID", key=lambda s: (S[s][i][j], -"MID".index(s)))
        elif state == "I":
            ops.append("I")
            i -= 1
            state = "M" if S["M"][i][j] - 6 >= S["I"][i][j] - 1 else "I"
        else:
            ops.append("D")
            j -= 1
            state = "M" if S["M"][i][j] - 6 >= S["D"][i][j] - 1 else "D"
    return "".join(reversed(ops))


def score(ops: str) -> int:
    total, prev = 0, ""
    for o in ops:
        total += 2 if o == "M" else -3 if o == "X" else -1 if o == prev else -6
        prev = o
    return total


def ident(ops: str) -> int:
    return int(10000 * ops.count("M") / len(ops) + 0.5) if ops else 0


def refine(q: str, oriented: str, chain, wide: bool = False) -> str | None:
    s = summary(chain)
    cq, ct, ops = chain[0][0], chain[0][2], ""
    for a in chain:
        mq, mt = max(a[0], cq), max(a[2], ct)
        if mq > cq or mt > ct:
            x, y = q[cq:mq], oriented[ct:mt]
            if not wide and max(len(x), len(y)) > 8192:
                return None
            band = abs(len(x) - len(y)) + 96
            ops += align(x, y, max(band, len(x), len(y)) if wide else band)
        n = min(a[0] + K - mq, a[2] + K - mt)
        if n > 0:
            ops += "M" * n
            cq, ct = mq + n, mt + n
    if (cq, ct) != (s["q1"], s["o1"]) or ident(ops) < 5000:
        return None
    return ops


def merged_chains(q: str, t: str, same: bool) -> list[list]:
    return merge([p for c in chains(anchors(q, t, same)) for p in split(c)])


def blocks(q: str, t: str) -> list[tuple]:
    """(q0, q1, t0, t1, identity, same strand, ops or None)."""
    out = []
    for same in (True, False):
        oriented = t if same else rc(t)
        for c in merged_chains(q, t, same):
            s = summary(c)
            ops = refine(q, oriented, c)
            pid = s["pid"]
            if ops is not None:
                pid = ident(ops)
            elif q[s["q0"]:s["q1"]] == oriented[s["o0"]:s["o1"]]:
                pid = 10000
            if pid >= 5000:
                out.append((s["q0"], s["q1"], s["t0"], s["t1"], pid, same, ops))
    return sorted(out, key=lambda b: b[:6])


def monotonic(pieces) -> list[tuple]:
    """Heaviest advancing set by trying every subset (small inputs)."""
    from itertools import combinations

    best, best_w = [], -1
    for r in range(1, len(pieces) + 1):
        for combo in combinations(sorted(pieces), r):
            if all(a[1] <= b[0] and a[3] <= b[2] for a, b in zip(combo, combo[1:])):
                w = sum(max(p[1] - p[0], p[3] - p[2]) for p in combo)
                if w > best_w:
                    best, best_w = list(combo), w
    return best
