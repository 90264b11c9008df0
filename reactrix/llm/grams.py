"""Worker code of the text classifiers and the language model: hashed n-grams of code points, in numpy.

Imported on the driver; its functions reach the executors by value (see linear.py).
"""

from __future__ import annotations

import numpy as np

#: Code points that are hashed at a time; bounds the memory of a very long text.
PIECE = 1 << 19


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_index(c: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram of the code points."""
    if len(c) < n:
        return np.zeros(0, np.int64)
    h = c[: len(c) - n + 1] + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
    for k in range(1, n):
        h = h * np.uint32(0x01000193) ^ c[k : len(c) - n + 1 + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435769)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def char_grams(orders, bits: int, lower: bool):
    """text -> iterator of bucket arrays of its character n-grams; a blank is put at both ends."""
    def run(text):
        text = f" {text.lower() if lower else text} "
        for a in range(0, len(text), PIECE):
            c = codes(text[a : a + PIECE + max(orders) - 1])
            for n in orders:
                yield gram_index(c, n, bits)

    return run


def word_shapes(text: str) -> np.ndarray:
    """A code of each word's look: capitals, first capital, symbols, digits, equal to the word before."""
    c = codes(text)
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint32)
    alpha_up = (c >= 65) & (c <= 90)
    alpha_low = ((c >= 97) & (c <= 122)) | (c >= 0xDF)
    digit = (c >= 48) & (c <= 57)
    symbol = (c < 128) & ~(alpha_up | alpha_low | digit | blank) & ~np.isin(c, (33, 39, 44, 45, 46, 58, 59, 63))
    look = (alpha_up * 1 + alpha_low * 2 + digit * 4 + symbol * 8).astype(np.uint8)
    bounds = np.stack((starts, ends), 1).ravel()
    look = np.bitwise_or.reduceat(np.append(look, np.uint8(0)), bounds)[::2]
    power = np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(64, dtype=np.uint64) + np.uint64(1))
    lengths = ends - starts
    inside = np.repeat(starts, lengths)
    at = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = (c[inside + at].astype(np.uint64) + np.uint64(0x51)) * power[at & 63]
    word = np.add.reduceat(terms ^ (terms >> np.uint64(29)), np.cumsum(lengths) - lengths)
    same = np.zeros(len(starts), bool)
    same[1:] = (word[1:] == word[:-1]) & (lengths[1:] == lengths[:-1])
    first_up = alpha_up[starts]
    return (look.astype(np.uint32) | (same.astype(np.uint32) << np.uint32(4)) | (first_up.astype(np.uint32) << np.uint32(5))) + np.uint32(0x110000)


def quality_grams(orders, shapes, bits: int):
    """Character n-grams, and n-grams of word shapes, which see repetition and shouting in words never met before."""
    chars = char_grams(orders, bits, False)

    def run(text):
        yield from chars(text)
        s = word_shapes(text)
        for n in shapes:
            yield gram_index(s, n, bits)

    return run


class Presence:
    """Distinct buckets of a text; the stamps are reused from text to text."""

    def __init__(self, bits: int):
        self.stamp = np.zeros(1 << bits, np.int64)
        self.seen = np.zeros(1 << bits, bool)

    def distinct(self, arrays, keep=None) -> np.ndarray:
        out = []
        for idx in arrays:
            if keep is not None:
                idx = idx[keep[idx]]
            order = np.arange(len(idx))
            self.stamp[idx] = order
            idx = idx[self.stamp[idx] == order]
            idx = idx[~self.seen[idx]]
            self.seen[idx] = True
            out.append(idx)
        found = np.concatenate(out) if out else np.zeros(0, np.int64)
        self.seen[found] = False
        return found


def class_counts(features, bits: int):
    """Batches (text, y) to (bucket, n0, n1): texts of each class with the bucket, and a last bucket -1 that counts the texts."""
    def run(batches):
        import pyarrow as pa

        presence, counts, total = Presence(bits), np.zeros((2, 1 << bits), np.int64), [0, 0]
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                counts[y][presence.distinct(features(t.as_py() or ""))] += 1
                total[y] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[0][at], total[0])), pa.array(np.append(counts[1][at], total[1]))], ["bucket", "n0", "n1"])

    return run


def selected(features, bits: int):
    """Batches (pick, text, y) to (pick, y, x): the buckets that the text has, as int32 bytes."""
    def run(batches):
        import pyarrow as pa

        presence = Presence(bits)
        for batch in batches:
            x = [np.sort(presence.distinct(features(t.as_py() or ""))).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("pick"), batch.column("y"), pa.array(x, pa.binary())], ["pick", "y", "x"])

    return run


def dual_descent(rows, y, values, cost, squared: bool, epochs: int, seed: int = 7):
    """Linear support vectors by dual coordinate descent (hinge, or squared hinge); the last weight is the bias.

    rows: for each text the places of its features; the value of place j is values[j]. cost: for each text.
    """
    w = np.zeros(len(values) + 1)
    sign = np.where(np.asarray(y) > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    upper = np.full(len(rows), np.inf) if squared else np.asarray(cost, float)
    diagonal = 0.5 / np.asarray(cost, float) if squared else np.zeros(len(rows))
    xs = [values[r] for r in rows]
    norm = np.array([x @ x for x in xs]) + 1.0 + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, x, s = rows[i], xs[i], sign[i]
            g = s * (w[r] @ x + w[-1]) - 1 + diagonal[i] * alpha[i]
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                most = max(most, abs(g))
                w[r] += step * s * x
                w[-1] += step * s
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def sigmoid_fit(margin, y, steps: int = 60):
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), by damped Newton steps with smoothed targets."""
    margin, y = np.asarray(margin, float), np.asarray(y, float)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, v = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()]))
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(a, 1e-3), b


def fit(values: np.ndarray, cost: float, squared: bool, epochs: int, sample: int, places: int):
    """The batches (pick, y, x) of one sorted partition to one row (w, a, b): weights as float32 bytes, and the calibration.

    Rows are taken in order up to ``sample`` rows, or up to ``places`` buckets in all; the rest passes by.
    """
    def run(batches):
        import pyarrow as pa

        ys, rows, held = [], [], 0
        for batch in batches:
            for y, x in zip(batch.column("y").to_pylist(), batch.column("x"), strict=True):
                if len(rows) < sample and held < places:
                    rows.append(np.frombuffer(x.as_py(), np.int32))
                    ys.append(y)
                    held += len(rows[-1])
        if not rows:
            return
        y = np.array(ys)
        share = np.bincount(y, minlength=2) / len(y)
        costs = cost * np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
        third = np.arange(len(y)) % 3 == 0
        margin = lambda w, r: w[r] @ values[r] + w[-1]
        a, b = 1.0, 0.0
        if min(np.bincount(y[third], minlength=2)) and min(np.bincount(y[~third], minlength=2)):
            at = np.flatnonzero(~third)
            w = dual_descent([rows[i] for i in at], y[at], values, costs[at], squared, epochs)
            a, b = sigmoid_fit([margin(w, rows[i]) for i in np.flatnonzero(third)], y[third])
        w = dual_descent(rows, y, values, costs, squared, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([float(a)]), pa.array([float(b)])], ["w", "a", "b"])

    return run


def scorer(features, bits: int, weights: np.ndarray, bias: float, a: float, b: float, cut: float):
    """Batches (doc_id, held_out, text) to (doc_id, held_out, score, predicted). weights: of each bucket, or none."""
    def run(batches):
        import pyarrow as pa

        presence = Presence(bits)
        table = weights.astype(float) if len(weights) else np.zeros(1 << bits)
        keep = table != 0
        for batch in batches:
            m = np.array([table[presence.distinct(features(t.as_py() or ""), keep)].sum() for t in batch.column("text")], float) + bias
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


# --- language identification -----------------------------------------------------------------------------------------


def presence_matrix(texts, orders, bits: int) -> np.ndarray:
    """One row for each text: 1 where it has an n-gram of the bucket."""
    m = np.zeros((len(texts), 1 << bits), np.float32)
    features = char_grams(orders, bits, True)
    for row, t in zip(m, texts, strict=True):
        for idx in features(t or ""):
            row[idx] = 1
    return m


def packed_presence(orders, bits: int):
    """Batches (lang, text) to (lang, x): presence bits."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = [np.packbits(presence_matrix([t.as_py()], orders, bits)[0].astype(bool)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

    return run


def kernel(m: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of texts against landmarks: one matrix product."""
    own, other = m.sum(axis=1, keepdims=True), marks.sum(axis=1)
    return (m @ marks.T) / np.sqrt(np.maximum(own, 1) * np.maximum(other, 1))


def language_scorer(orders, bits: int, packed_marks: np.ndarray, solved: np.ndarray, names: list[str], sharp: float, rows: int = 64):
    """Batches (doc_id, held_out, text) to (doc_id, held_out, lang_pred, score)."""
    def run(batches):
        import pyarrow as pa

        marks = np.unpackbits(packed_marks, axis=1).astype(np.float32)
        for batch in batches:
            texts, preds, scores = batch.column("text"), [], []
            for a in range(0, len(texts), rows):
                part = [t.as_py() for t in texts[a : a + rows]]
                known = [bool(t) and any(map(str.isalpha, t)) and len(names) > 0 for t in part]  # isalpha: Unicode category L
                s = kernel(presence_matrix([t if k else "" for t, k in zip(part, known, strict=True)], orders, bits), marks) @ solved if names else np.zeros((len(part), 1))
                e = np.exp(sharp * (s - s.max(axis=1, keepdims=True)))
                e /= e.sum(axis=1, keepdims=True)
                best = s.argmax(axis=1)
                preds += [names[j] if k else "und" for j, k in zip(best, known, strict=True)]
                scores += [float(p[j]) if k else 0.0 for p, j, k in zip(e, best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


# --- language model --------------------------------------------------------------------------------------------------


def char_counts(batches):
    """Batches (text) to (code, n)."""
    import pyarrow as pa

    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        for t in batch.column("text"):
            low = (t.as_py() or "").lower()
            for a in range(0, len(low), PIECE):
                c = np.bincount(codes(low[a : a + PIECE]))
                counts[: len(c)] += c
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["code", "n"])


def spelled(t: np.ndarray) -> np.ndarray:
    """Token numbers, where a negative one stands for two: - (first << 13 | second)."""
    two = t < 0
    if not two.any():
        return t
    out = np.repeat(t, 1 + two)
    at = np.flatnonzero(two) + np.arange(two.sum())
    out[at], out[at + 1] = -t[two] >> 13, -t[two] & 8191
    return out


def tokens(text: str, vocabulary: np.ndarray, context: int):
    """Arrays of token numbers of a text, piece by piece, each led by its context; 0 is the start, 1 any other character."""
    low = text.lower()
    for a in range(0, max(1, len(low)), PIECE):
        lead = spelled(vocabulary[np.minimum(codes(low[max(0, a - context) : a]), len(vocabulary) - 1)])
        lead = lead[max(0, len(lead) - context) :]
        t = spelled(vocabulary[np.minimum(codes(low[a : a + PIECE]), len(vocabulary) - 1)])
        yield np.concatenate((np.zeros(context - len(lead), t.dtype), lead, t))


def gram_cells(t: np.ndarray, size: int, order: int) -> np.ndarray:
    """Cell of each n-gram in a dense table with ``size`` tokens an axis."""
    n = len(t) - order + 1
    cell = np.zeros(max(0, n), np.int64)
    for k in range(order):
        cell = cell * size + t[k : k + n]
    return cell


def merged(cells: np.ndarray, counts: np.ndarray):
    """Distinct cells, rising, and the sums of their rows of counts."""
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
    return cells[at], np.add.reduceat(counts[order], at, axis=0) if len(at) else counts[:0]


def tallied(parts):
    """Distinct cells, rising, and their (target, background) counts, of (cells, whether of the target); cells are below 2 ** 62."""
    x = np.concatenate([c * 2 + int(target) for c, target in parts])
    x.sort()
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))[: len(x)]
    n, x = np.diff(np.append(at, len(x))), x[at]
    return merged(x >> 1, np.stack((n * (x & 1), n), 1))


def gram_counts(vocabulary: np.ndarray, size: int, order: int, most: int = 1 << 20):
    """Batches (text, target) to (cell, target, background) counts. What a task holds is merged and handed on at ``most`` cells."""
    def run(batches):
        import pyarrow as pa

        held, counts, parts, waiting = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), [], 0

        def taken_in():
            c, n = tallied(parts)
            return merged(np.concatenate([held, c]), np.concatenate([counts, n]))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[:, 0]), pa.array(counts[:, 1])], ["cell", "target", "background"])

        for batch in batches:
            for t, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                for piece in tokens(t.as_py() or "", vocabulary, order - 1):
                    parts.append((gram_cells(piece, size, order), target))
                    waiting += len(parts[-1][0])
                    if waiting >= most:
                        held, counts = taken_in()
                        parts, waiting = [], 0
                        if len(held) >= most:
                            yield out()
                            held, counts = held[:0], counts[:0]
        if parts:
            held, counts = taken_in()
        yield out()

    return run


def finder(keys: np.ndarray, cells: int):
    """cells -> their places in the rising keys, -1 where they have none. cells: how many there can be."""
    if cells <= 1 << 24:
        place = np.full(cells, -1, np.int32)
        place[keys] = np.arange(len(keys))
        return lambda c: place[c]

    # hash tables of places, each for the keys whose slot in those before is taken by another key
    tables, left, odd = [], np.arange(len(keys)), 0x9E3779B97F4A7C15
    while len(left):
        bits, times = max(8, (4 * len(left) - 1).bit_length()), np.uint64((odd * (2 * len(tables) + 1)) % 2**64)
        slot = (keys[left].astype(np.uint64) * times) >> np.uint64(64 - bits)
        place = np.full(1 << bits, -1, np.int32)
        place[slot] = left
        tables.append((times, np.uint64(64 - bits), place))
        left = left[place[slot] != left]

    def find(c):
        out, rest = np.full(len(c), -1, np.int64), None
        for times, shift, place in tables:
            own = c if rest is None else c[rest]
            p = place[(own.astype(np.uint64) * times) >> shift]
            hit = (keys[p] == own) & (p >= 0)
            if rest is None:
                out[hit] = p[hit]
                rest = np.flatnonzero(~hit & (p >= 0))
            else:
                out[rest[hit]] = p[hit]
                rest = rest[~hit & (p >= 0)]
            if not len(rest):
                break
        return out

    return find


def lm_scorer(vocabulary: np.ndarray, size: int, order: int, tables):
    """Batches (doc_id, h, text) to (doc_id, h, n, x, y, cells, times): tokens, sums of both losses, and the cells not in the tables.

    tables: a broadcast of the rising cells and both their losses.
    """
    def run(batches):
        import pyarrow as pa

        keys, target, background = tables.value
        find = finder(keys, size**order)
        for batch in batches:
            n, lt, lb, cells, times = [], [], [], [], []
            for t in batch.column("text"):
                k, x, y, rest = 0, 0.0, 0.0, []
                for piece in tokens(t.as_py() or "", vocabulary, order - 1):
                    c = gram_cells(piece, size, order)
                    at = find(c)
                    known = at >= 0
                    if not known.all():
                        rest.append(c[~known])
                        at = at[known]
                    k, x, y = k + len(c), x + float(target[at].sum(dtype=np.float64)), y + float(background[at].sum(dtype=np.float64))
                n.append(k)
                lt.append(x)
                lb.append(y)
                c, m = np.unique(np.concatenate(rest), return_counts=True) if rest else ([], [])
                cells.append(c)
                times.append(m)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(lt, pa.float64()), pa.array(lb, pa.float64()), pa.array(cells, lists), pa.array(times, lists)], ["doc_id", "h", "n", "x", "y", "cells", "times"])

    return run
