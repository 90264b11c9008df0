"""Worker code of the SentencePiece operator: chunks to ids and ids to texts, in slices of Arrow batches. Its functions reach the executors by value (see pieces.py)."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Bytes of text, and ids, that are worked on at a time; a longer row is alone.
SLICE_BYTES, SLICE_IDS = 1 << 20, 1 << 18


def cut(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def segment(sp, some: list[str]) -> list[list[int]]:
    """Ids of chunks. The library puts a marker in front itself; of a lone marker it would see nothing."""
    lone = sp.piece_to_id(MARK)
    return [ids if len(c) > 1 else [lone] for c, ids in zip(some, sp.encode([c[1:] for c in some], num_threads=1), strict=True)]


def slices(sizes: np.ndarray, most: int):
    """(start, end) of runs of rows with about ``most`` in all."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def segmented(model: bytes):
    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(segment(sp, b.column("chunk").to_pylist()), pa.list_(pa.int32()))], names=["chunk", "ids"])

    return run


def encoder(shared, add_eos: bool):
    def run(batches):
        model, names, table = shared.value
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        known = dict(zip(names, range(1, len(names) + 1), strict=True))
        table = pa.concat_arrays([pa.array([[sp.eos_id()] if add_eos else []], table.type), table])  # place 0: the end of a text
        for b in batches:
            every = b.column("text")
            for start, end in slices(pc.fill_null(pc.binary_length(every), 0).to_numpy(zero_copy_only=False), SLICE_BYTES):
                texts = [cut(t) if t else [] for t in every.slice(start, end - start).to_pylist()]
                rare: dict[str, int] = {}
                first = len(table)

                def place(c):
                    k = known.get(c)
                    return k if k is not None else rare.setdefault(c, first + len(rare))  # noqa: B023

                places = np.fromiter(chain.from_iterable(chain(map(place, t), (0,)) for t in texts), np.int64)
                whole = pa.concat_arrays([table, pa.array(segment(sp, list(rare)), table.type)]) if rare else table
                taken = whole.take(pa.array(places))
                ends = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
                offsets = taken.offsets.to_numpy()[ends]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.values)
                kept = [b.column(k).slice(start, end - start) for k, n in enumerate(b.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*kept, ids], names=[*[n for n in b.schema.names if n != "text"], "ids"])

    return run


def both(first, then):
    return lambda batches: then(first(batches))


def surfaces(sp) -> pa.Array:
    """The bytes that each id stands for."""
    out = []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        out.append(b"" if sp.is_control(k) else sp.decode([k]).encode() if sp.is_unknown(k) else bytes([int(piece[3:5], 16)]) if sp.is_byte(k) else piece.replace(MARK, " ").encode())
    return pa.array(out, pa.binary())


def decoder(shared, name: str, keep: list[str]):
    def run(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value[0])
        table = surfaces(sp)
        marked = np.array([sp.id_to_piece(k).startswith(MARK) for k in range(len(table))])
        silent = np.array([sp.is_control(k) for k in range(len(table))])
        for b in batches:
            every = b.column(name)
            for start, end in slices(pc.fill_null(pc.list_value_length(every), 0).to_numpy(zero_copy_only=False), SLICE_IDS):
                own = every.slice(start, end - start)
                sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
                ids = own.flatten()
                codes = ids.to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                parts = table.take(ids)
                bounds = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, parts.offset * 4)[ends]
                data = parts.buffers()[2].to_pybytes() if parts.buffers()[2] else b""
                out = []
                for k, (a, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    said = codes[ends[k] : ends[k + 1]]
                    spoken = said if len(said) and not silent[said[0]] else said[~silent[said]]
                    lead = bool(len(spoken) and marked[spoken[0]])  # the marker in front of a text is no blank
                    try:
                        out.append(data[a + lead : z].decode())
                    except UnicodeDecodeError:
                        out.append(sp.decode(said.tolist()))
                texts = pc.if_else(own.is_valid(), pa.array(out, pa.string()), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.names.index(c)).slice(start, end - start) for c in keep], texts], names=[*keep, "decoded"])

    return run
