"""Plain statements of what the operators compute, row by row."""

from __future__ import annotations

import zlib


def crc_ids(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def cheapest_packing(cuts, end_cost, context, cut_cost, most, tail):
    """The least cost over all ways to choose windows, by the quadratic recurrence."""
    place = [0, *cuts]
    n = len(cuts)
    best = [0.0] + [float("inf")] * n
    for j in range(1, n + 1):
        for i in range(j):
            length = place[j] - place[i]
            k = -(-length // context)
            if k <= most:
                cost = k * context - length + (k - 1) * cut_cost + end_cost[j - 1]
                if j == n and k == 1:
                    cost = min(cost, tail(length))
                best[j] = min(best[j], best[i] + cost)
    return best[n]
