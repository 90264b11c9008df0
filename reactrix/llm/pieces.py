"""SentencePiece encoding and decoding by a table of distinct chunks.

A text is cut before each whitespace marker (one per blank, one in front of the text) that follows another character. No piece of the model crosses such a
place, so chunks, marked words, are segmented by themselves. Spark counts the distinct chunks of all texts; the most frequent ones, within a bound, are
segmented once, and their ids travel as a broadcast table. A text's ids are its chunks' ids, joined by position. Chunks outside the bound are rare: each
is segmented once for each slice of a batch that has it, by the same code. To join them by a shuffle would move all texts, as nearly every text has a rare chunk.

Decoding joins the surfaces of ids, by position too; byte pieces give their byte. Id sequences whose bytes aren't UTF-8, which no encoding makes, go through the library's decoder.

Defined results: a null text is empty, and empty texts have only the end id; blanks in a row, other white space and control characters are kept as they are; a literal marker character is a blank, as
for the library; repeated rows get equal results; there are no ties; very long texts are whole, a chunk too (a text without blanks is one); empty tables give empty results; of the
input only the named columns stay, so extra ones never clash.

The model is the caller's file. It has to be one that leaves texts as they are (no normalisation, a marker in front) and whose pieces don't cross markers; others are refused.
"""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import clean_of, materialize

cloudpickle.register_pickle_by_value(chunks)

#: Chunks of the broadcast table, and the characters that each of them may have.
TABLE_CHUNKS, CHUNK_CHARS = 1 << 18, 48
#: Steps of a factor of two in which the count that chunks of the table need is looked for.
STEPS = 16


def model_bytes(path: str) -> bytes:
    """The model, refused if chunks can't stand by themselves in it."""
    data = Path(path).read_bytes()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if chunks.MARK in p.lstrip(chunks.MARK)]
    probe = " ﬁ  \tＡ é "
    if crossing or sp.normalize(probe) != chunks.MARK + probe.replace(" ", chunks.MARK):
        raise ValueError(f"{path}: pieces cross whitespace markers, or texts are normalised")
    return data


def chunk_counts(docs: DataFrame, longest: int = CHUNK_CHARS) -> DataFrame:
    """chunk, n: the distinct chunks of all texts, up to a length, and how often each occurs. Counts are added up before the shuffle."""
    mark = F.lit(chunks.MARK)
    text = F.concat(mark, F.replace("text", F.lit(" "), mark))
    found = docs.where(F.col("text") != "").select(F.explode(F.split(text, f"(?<=[^{chunks.MARK}])(?={chunks.MARK})")).alias("chunk"))
    return found.where(F.length("chunk") <= longest).groupBy("chunk").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, most: int = TABLE_CHUNKS) -> DataFrame:
    """The rows with the greatest counts, as many as fit: those from the least step of the count's logarithm that leaves ``most`` of them or fewer."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.col("step").desc()).collect()  # 64 * STEPS rows at most
    room, least = most, None
    for s in sizes:
        room -= s.rows
        if room < 0:
            break
        least = s.step
    return counts.where(step >= least) if least is not None else counts.limit(0)


def chunk_table(counts: DataFrame, model: bytes) -> DataFrame:
    """chunk, ids: each distinct chunk segmented once."""
    return counts.select("chunk").mapInArrow(chunks.segmented(model), "chunk string, ids array<int>")


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), add_eos: bool = True, most: int = TABLE_CHUNKS, decoded: bool = False) -> DataFrame:
    """The kept columns and ``ids`` (an array) of each row's ``text``. most: chunks of the table, which say how work is shared, not what comes out.

    decoded: with decode() of the ids, in the same worker.
    """
    model = model_bytes(path)
    counts = materialize(chunk_counts(docs).where("n > 1"), "chunks")
    table = chunk_table(frequent(counts, most), model).toArrow()  # TABLE_CHUNKS rows of CHUNK_CHARS characters at most
    shared = docs.sparkSession.sparkContext.broadcast((model, table["chunk"].to_pylist(), table["ids"].combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))))
    rows = clean_of(docs, *keep, "text").toDF(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    run = chunks.encoder(shared, add_eos)
    if not decoded:
        return rows.mapInArrow(run, f"{schema}, ids array<int>")
    return rows.mapInArrow(chunks.both(run, chunks.decoder(shared, "ids", [*keep, "ids"])), f"{schema}, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The kept columns (``ids`` may be one of them) and ``decoded``, the text of each row's ids; null ids are null."""
    shared = rows.sparkSession.sparkContext.broadcast((model_bytes(path),))
    own = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, ids))])
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes if c in keep)
    return own.mapInArrow(chunks.decoder(shared, ids, list(keep)), f"{schema}, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    out = encode(docs, path, decoded=True)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
