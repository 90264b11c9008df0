"""Worker code of the SimHash operator: fingerprints, and the Gray-order index of one block of fingerprints.

Imported on the driver only; its functions reach the executors by value (see simhash.py).
"""

from __future__ import annotations

import numpy as np

#: Children of an index node.
FAN = 16
#: Node pairs that are expanded at a time; bounds memory.
PAIRS = 4096


def fingerprint(text, width: int, chunk: int = 1 << 16) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; zero without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, chunk):
        b = min(n, a + chunk)
        last = ends[a + width - 1 : b + width - 1] if len(words) >= width else ends[-1:]
        h = np.fromiter([digest(joined[i:j], 42) for i, j in zip(starts[a:b].tolist(), last.tolist(), strict=True)], "<u8", b - a)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(width: int, order: str):
    """Arrow batches (order column, text) to (order column, fp)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column("text")
            fps = [fingerprint(t.as_py(), width) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(order), pa.array(fps, pa.int64())], [order, "fp"])

    return run


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the classes of x[i] and y[i]; label keeps pointing at the least member of each class."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def build_levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes, leaves first: a node keeps the bits that all fingerprints below it share."""
    levels = [(fps, np.full(len(fps), 0xFFFFFFFFFFFFFFFF, np.uint64))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((ones, ones | zeros))
    return levels


def classes(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints in Gray order: index of the least member of each one's class of links.

    Pairs of nodes go down the hierarchy together. Differences on the bits that both nodes share add up from level to
    level, each bit counted once, and a pair of whole groups is pruned when they exceed the radius. Groups that
    already are one class aren't compared again, so a dense group costs little more than its links need.
    """
    label = np.arange(len(fps))
    levels = build_levels(fps)
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    order = np.argsort(j - i, kind="stable")
    stack = [(top, i[order], j[order], np.zeros(len(i), np.int64), np.zeros(len(i), np.uint64))]
    while stack:
        level, i, j, seen, done = stack.pop()
        if len(i) > PAIRS:
            stack += [(level, i[k : k + PAIRS], j[k : k + PAIRS], seen[k : k + PAIRS], done[k : k + PAIRS]) for k in range(0, len(i), PAIRS)][::-1]
            continue
        pattern, mask = levels[level]
        both = mask[i] & mask[j]
        seen = seen + np.bitwise_count((pattern[i] ^ pattern[j]) & both & ~done)
        near = seen <= radius
        i, j, seen, done = i[near], j[near], seen[near], both[near]
        if not level:
            unite(label, i, j)
            continue
        size = FAN**level
        if len(fps) > 4 * FAN * FAN:
            at = np.arange(0, len(fps), size)
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            open_ = (low[i] != high[i]) | (low[j] != high[j]) | (low[i] != low[j])
            i, j, seen, done = i[open_], j[open_], seen[open_], done[open_]
        below = len(levels[level - 1][0])
        a, b = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
        ci, cj = (i[:, None] * FAN + a).ravel(), (j[:, None] * FAN + b).ravel()
        fits = (ci < below) & (cj < below) & ((ci < cj) if level == 1 else (ci <= cj))
        if len(ci):
            stack.append((level - 1, ci[fits], cj[fits], np.repeat(seen, FAN * FAN)[fits], np.repeat(done, FAN * FAN)[fits]))
    return label


def block_links(radius: int, keys: list[str]):
    """Arrow batches sorted by block and Gray rank to the links (u, v) of a spanning forest of each block."""

    def run(batches):
        import pyarrow as pa

        def links(table):
            fps = table.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            n = len(fps)
            change = np.zeros(n, bool)
            change[:1] = True
            for k in keys:
                col = table.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= col[1:] != col[:-1]
            at = np.append(np.flatnonzero(change), n)
            us, vs = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a > 1:
                    own = fps[a:b]
                    label = classes(own, radius)
                    moved = np.flatnonzero(label != np.arange(b - a))
                    us.append(own[moved])
                    vs.append(own[label[moved]])
            u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        rest = None  # the block that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
            if not table.num_rows:
                continue
            last = np.ones(table.num_rows, bool)
            for k in keys:
                col = table.column(k).to_numpy(zero_copy_only=False)
                last &= col == col[-1]
            cut = int(np.argmax(last))
            if cut:
                yield links(table.slice(0, cut).combine_chunks())
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield links(rest.combine_chunks())

    return run
