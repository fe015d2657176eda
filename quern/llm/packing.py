"""Best-fit packing planned over a length histogram.

Texts are tokenized once, on the executors, into pieces of SEQUENCE tokens at
most; only the narrow piece table travels. Best-fit decreasing then runs over
the counts of each length instead of over documents: its whole state is a few
runs of equal sequences, and its result a plan of runs of slots. Pieces take
their slots by joining on their rank within their length. Ranks are counted
in salted parts, so one very common length is no single task.
"""

from __future__ import annotations

import ctypes
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import small, stage_table

SEQUENCE = 2048
END_ID = 0
#: Bytes of text that are tokenized at a time; a longer text is taken by itself.
BLOCK_BYTES = 4 << 20
#: Chunks that are encoded as one text.
CHUNKS_A_TEXT = 1000
#: Texts whose encodings are held at a time.
TEXTS_A_CALL = 8
#: ASCII marks that a word never forms a token with; the apostrophe does.
MARKS = r"!-&(-/:-@\[-`{-~"
#: Letters whose tokens do not depend on what follows them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD_AND_MARKS = f"(?s)^(?P<word>.*[0-9{LETTERS}])(?P<marks>[{MARKS}]+)$"
ONE_PIECE = f"^(?:[{LETTERS}]+|[{MARKS}]+)$"
#: Texts that a tokenizer must read chunk by chunk as it does whole, or whole texts are encoded.
PROBES = ("One two,  three's (4)\n\tFIVE", "a b", " a\r\nB!")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _strung(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one after the other, and how many each has; entry i has ``sizes[i]`` ids of ``flat``."""
    own = sizes[at]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    shift = (np.cumsum(sizes) - sizes)[at] - (ends - own)
    # places of half the width while they fit: these arrays are the largest that a worker holds
    narrow = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    places = np.repeat(shift.astype(narrow), own)
    places += np.arange(total, dtype=narrow)
    return flat[places], own


class ChunkEncoder:
    """Ids of many texts at once, through the distinct chunks between their ASCII white space.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its chunks. ASCII chunks are lower-cased, as the
    tokenizer does, and marks after a word are parted from it, as the tokenizer
    does too; each distinct part of a block is encoded once. Parts of one
    pre-token travel through the tokenizer many to a text, and the ids that end
    a word part them again; others are parted by a special token, which cuts a
    text before anything else is done to it; those that may hold such a token
    are encoded alone. Tokenizers of other kinds get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [pc.ascii_lower(t.content).as_py() for t in added.values()]
        special = {i: t.content for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.part_id = max(special, default=-1)
        self.part = special.get(self.part_id)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        token = self.tokenizer.id_to_token
        self.ends = np.array([bool(suffix) and (token(i) or "").endswith(suffix) for i in range(self.tokenizer.get_vocab_size())])
        self.by_chunk = bool(suffix) and self.part is not None and all(self._whole([t])[0].tolist() == [i for c in t.split() for i in self._whole([c])[0].tolist()] for t in PROBES)

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids. Few texts at a time: an encoding takes many times the size of its ids."""
        for at in range(0, len(texts), TEXTS_A_CALL):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + TEXTS_A_CALL], add_special_tokens=False):
                yield np.array(e.ids, np.uint32)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(self._ids(texts))
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _joined(self, parts: list[str], by: str) -> np.ndarray:
        texts = [by.join([*parts[at : at + CHUNKS_A_TEXT], ""]) for at in range(0, len(parts), CHUNKS_A_TEXT)]
        return np.concatenate([np.zeros(0, np.uint32), *self._ids(texts)])

    def _parts(self, parts: pa.StringArray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parts' ids after each other, and how many each has. ``odd`` ones may hold an added token."""
        one = pc.match_substring_regex(parts, ONE_PIECE).to_numpy(zero_copy_only=False) & ~odd
        groups = [np.nonzero(g)[0] for g in (one, ~one & ~odd, odd)]
        words, others, alone = (parts.take(pa.array(g)).to_pylist() for g in groups)
        of_words = self._joined(words, " ")
        word_ends = np.nonzero(self.ends[of_words])[0]
        of_others = self._joined(others, self.part)
        cuts = np.nonzero(of_others == self.part_id)[0]
        of_alone, sizes_alone = self._whole(alone)
        sizes = np.concatenate([np.diff(word_ends, prepend=-1), np.diff(cuts, prepend=-1) - 1, sizes_alone])
        back = np.empty(len(parts), np.int64)
        back[np.concatenate(groups)] = np.arange(len(parts))
        return _strung(np.concatenate([of_words, np.delete(of_others, cuts), of_alone]), sizes, back)

    def _chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        odd, lower = np.zeros(len(chunks), bool), pc.ascii_lower(chunks)
        for mark in self.marks:
            odd |= pc.match_substring(lower, mark).to_numpy(zero_copy_only=False)
        plain = pa.array(~odd)
        chunks = pc.if_else(pc.and_(plain, pc.string_is_ascii(chunks)), lower, chunks)
        cut = pc.extract_regex(chunks, WORD_AND_MARKS)
        parted = pc.and_(plain, pc.is_valid(cut))
        words = pc.if_else(parted, pc.struct_field(cut, "word"), chunks)
        marks = pc.if_else(parted, pc.struct_field(cut, "marks"), "")
        parts = pa.concat_arrays([words, marks]).dictionary_encode()
        at = parts.indices.to_numpy()
        odd_parts = np.zeros(len(parts.dictionary), bool)
        odd_parts[at[: len(chunks)][odd]] = True
        flat, own = _strung(*self._parts(parts.dictionary, odd_parts), at.reshape(2, -1).T.ravel())
        return flat, own.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids after each other, and where each text's end; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            ids, sizes = self._whole(texts.to_pylist())
            return ids.astype("<u4", copy=False), np.cumsum(sizes)
        parts = pc.ascii_split_whitespace(texts)
        chunks = parts.flatten().dictionary_encode()
        ids, own = _strung(*self._chunks(chunks.dictionary), chunks.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(own)))
        return ids.astype("<u4", copy=False), ends[np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]


#: One encoder for each tokenizer file, kept by a worker from task to task.
_encoders: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    # tasks run side by side already; the tokenizer's own threads would each keep memory of their own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _release() -> None:
    """Give freed memory back: a worker stays for later blocks, tasks and stages, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with BLOCK_BYTES of text at most, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the closing ``end_id``.

    Null and empty texts are one piece, the closing id alone. Only documents
    longer than ``sequence`` are cut. doc_id is of any type and never leaves
    Arrow, so nulls and large numbers stay what they are.
    """
    path = tokenizer or default_tokenizer()
    id_type = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        end = np.array([end_id], "<u4").tobytes()
        _release()  # what an earlier stage left in this worker
        for batch in batches:
            for block in _blocks(batch):
                ids, bounds = encoder.encode(block.column("text"))
                octets = memoryview(np.ascontiguousarray(ids)).cast("B")
                counts = np.diff(bounds, prepend=0) + 1
                many = -(-counts // sequence)
                row = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * sequence
                length = np.minimum(sequence, counts[row] - start)
                first = (bounds - (counts - 1))[row] + start
                last = piece == many[row] - 1
                crc = [
                    zlib.crc32(end, zlib.crc32(octets[4 * a : 4 * (a + n - 1)])) if e else zlib.crc32(octets[4 * a : 4 * (a + n)])
                    for a, n, e in zip(first.tolist(), length.tolist(), last.tolist())
                ]
                out = [block.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"])
                del ids, octets, out, block
                _release()

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank, pieces, first_sequence, per_sequence, offset): the
    ``pieces`` pieces of that length from ``rank`` on go, ``per_sequence`` to
    each, to consecutive sequences from ``first_sequence`` on, at ``offset``.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []  # sorted keys of runs
    plan: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(room: int, run: tuple[int, int]) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, many = sequence, opened, -(-left // (sequence // length))
                opened += many
            each = room // length
            full = min(many, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, sequence - room))
                put(room - each * length, (first, full))
                rank, left = rank + full * each, left - full * each
            if full < many:
                if left and left < each:  # the last pieces of this length share one sequence
                    plan.append((length, rank, left, first + full, left, sequence - room))
                    put(room - left * length, (first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < many:
                    put(room, (first + full, many - full))
    return plan


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Per piece of every document: its ids' place in the document and its slot in a sequence.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Slots of a sequence follow each other from 0 without gaps. Null and empty
    texts give one piece of one id; repeated rows are packed once each; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = stage_table(pieces(docs, tokenizer, sequence), "pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = stage_table(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(histogram, sequence), "length long, first_rank long, many long, first_sequence long, each long, at long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage_table(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "salt", "base"), "bases")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(small(bases), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the plan's size is bounded by the lengths there can be, not by the documents
    in_run = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("many"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "planned")), (F.col("length") == F.col("planned")) & in_run)
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
