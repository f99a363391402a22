"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read field by field; from it the normaliser, the metaspace marker,
the scored pieces (unigram scores, or merges in the order of the scores for a BPE
model), byte fallback and the decoder are rebuilt. Batches are encoded by several threads, and
everything that goes through the tokenizer is held against what SentencePiece itself gives.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.arrays import Piece, give_back, pieces
from codeloom.llm.columns import spare_name

MARK = "▁"
# Kinds of pieces and of models in the SentencePiece format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
GROUP_BYTES = 5 << 20
UNITS = 1 << 14  # that go through the tokenizers at once
JOINED = 64  # of them in one call's text


class Model(NamedTuple):
    """What a model file says: pieces as (text, score, kind), and the settings of training and normalising."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    add_dummy_prefix: bool
    remove_extra_spaces: bool
    escape_spaces: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message; length-delimited and fixed values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"not a SentencePiece model: wire type {wire}")
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        if at + size > len(data):
            raise ValueError("not a SentencePiece model: it ends within a field")
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if not pieces:
        raise ValueError("not a SentencePiece model: it has no pieces")
    return Model(
        pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), normalizer.get(2, b""),
        bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)),
    )


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to put a piece together from two others, best scores first."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for text, score, kind in pieces:
        if kind == NORMAL:
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                if left in ids and right in ids:
                    found.append((-score, ids[text], ids[left], ids[right], left, right))
    return [(x[4], x[5]) for x in sorted(found)]


def in_units(model: Model) -> bool:
    """Whether texts can be cut before every run of spaces."""
    plain = not model.charsmap and not model.remove_extra_spaces and model.add_dummy_prefix and model.escape_spaces
    inside = any(MARK in text.lstrip(MARK) for text, _, kind in model.pieces if kind == NORMAL)
    return plain and not inside and all(kind != USER for _, _, kind in model.pieces)


def build_tokenizer(model: Model, core_only: bool = False):
    """The tokenizer; texts are expected without special tokens, and none are added.

    ``core_only`` leaves out the normaliser: for units in which spaces are markers already.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = model.pieces[model.unk_id][0]
    if model.kind == BPE:
        vocab = {text: i for i, (text, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, _merges(model.pieces), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    if core_only:
        return tokenizer
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    last = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    user = [text for text, _, kind in model.pieces if kind == USER]
    if user:
        tokenizer.add_tokens(user)
    return tokenizer


def _unit_starts(piece: Piece) -> np.ndarray:
    """Where units start, in texts that start with a space themselves: at every text and every run of spaces."""
    space = piece.data == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[piece.offsets[piece.offsets < len(piece.data)]] = True
    return np.flatnonzero(begin)


class Coder:
    """A model's tokenizers, and SentencePiece's own processor to check them against."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = model = parse_model(data)
        self.units = build_tokenizer(model, core_only=True) if in_units(model) else None
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = pa.array(
            [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() for text, _, kind in model.pieces],
            pa.large_binary(),
        )
        self.lengths = pc.binary_length(self.bytes).to_numpy()
        self.prefix = model.add_dummy_prefix

    @functools.cached_property
    def whole(self):
        return build_tokenizer(self.model)

    def _encode_whole(self, texts: pa.Array, threads: int) -> tuple[pa.ListArray, np.ndarray]:
        told = texts.to_pylist()
        # An empty text has no ids: the marker that the normaliser puts in front stands for no text.
        found = [e.ids if t else [] for t, e in zip(told, self.whole.encode_batch_fast(told, add_special_tokens=False))]
        same = [x == y for x, y in zip(found, self.check.encode(told, num_threads=threads))]
        return pa.array(found, pa.list_(pa.int32())), np.array(same, bool)

    def encode(self, texts: pa.Array, threads: int = 1) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of texts without nulls, and whether SentencePiece agrees."""
        if self.units is None:
            return self._encode_whole(texts, threads)
        odd = pc.match_substring(texts, MARK)
        if not pc.any(odd).as_py():
            return self._encode_units(texts, threads)
        plain, same = self._encode_units(pc.if_else(odd, "", texts), threads)
        rest, rest_same = self._encode_whole(texts.filter(odd), threads)
        at = odd.to_numpy(zero_copy_only=False)
        place = np.arange(len(texts))
        place[at] = len(texts) + np.arange(at.sum())
        same[at] = rest_same
        return pa.concat_arrays([plain, rest]).take(pa.array(place)), same

    def _encode_units(self, texts: pa.Array, threads: int) -> tuple[pa.ListArray, np.ndarray]:
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        spans, first, n = [], [np.zeros(1, np.int64)], 0
        for piece in pieces(texts):
            starts = _unit_starts(piece)
            # Every byte is in a unit, so where one ends the next starts.
            bounds = np.append(starts, len(piece.data))
            spans.append(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(piece.data)))
            first.append(n + np.searchsorted(starts, piece.offsets[1:]))
            n += len(starts)
        if not n:
            return pa.array([[]] * len(texts), pa.list_(pa.int32())), np.ones(len(texts), bool)
        units, first = pa.concat_arrays(spans).dictionary_encode(), np.concatenate(first)
        different, place = units.dictionary, units.indices.to_numpy()
        del spans, units
        told = [self._encode_lot(different.slice(lo, UNITS), threads) for lo in range(0, len(different), UNITS)]
        size, flat, wrong = map(np.concatenate, zip(*told))
        begin, long = (np.cumsum(size) - size).astype(np.int32), size[place].astype(np.int32)
        ends = np.cumsum(long, dtype=np.int32)  # a group's tokens are fewer than its bytes
        ids = np.repeat(begin[place] - (ends - long), long)
        ids += np.arange(len(ids), dtype=np.int32)
        ids = flat[ids]
        offsets = np.concatenate([np.zeros(1, np.int32), ends])[first]
        same = np.diff(np.concatenate([[0], np.cumsum(wrong[place])])[first]) == 0
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), same

    def _encode_lot(self, units: pa.LargeStringArray, threads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each unit's number of ids, all ids in a row, and the units for which SentencePiece has others.

        No piece goes on beyond a unit, so units are encoded one behind the other in texts of many, by both libraries,
        and cut by the bytes that the ids stand for. Where the two differ or a cut fails, every unit goes by itself.
        """
        _, offsets, data = units.buffers()
        offsets = np.frombuffer(offsets, np.int64)[units.offset : units.offset + len(units) + 1]
        cut = np.arange(len(units)) % JOINED == 0
        # Spaces alone would run into the spaces of the next unit.
        cut[1:] |= np.frombuffer(data, np.uint8)[offsets[1:-1] - 1] == 0x20
        bounds = np.append(offsets[:-1][cut], offsets[-1])
        size, flat, wrong = self._encode_both(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), data), threads)
        at, ends = np.cumsum(self.lengths[flat]), offsets[1:] - offsets[0]
        if len(at) and at[-1] == ends[-1] and not wrong.any() and not (flat == self.model.unk_id).any():
            last = np.searchsorted(at, ends)
            if (at[last] == ends).all():
                return np.diff(last, prepend=-1), flat, np.zeros(len(units), bool)
        return self._encode_both(units, threads)

    def _encode_both(self, texts: pa.LargeStringArray, threads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_encode_lot``, for units or texts of several."""
        marked = pc.replace_substring(texts, " ", MARK).to_pylist()
        found = [e.ids for e in self.units.encode_batch_fast(marked, add_special_tokens=False)]
        # Every unit starts with a space, which SentencePiece puts in front by itself.
        own = self.check.encode(pc.utf8_slice_codeunits(texts, 1).to_pylist(), num_threads=threads)
        # A unit of one space alone is the prefix of nothing: SentencePiece gives no ids for an empty text.
        wrong = np.fromiter((x != y and u != MARK for x, y, u in zip(found, own, marked)), bool, len(marked))
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum())), wrong

    def returns(self, texts: pa.Array, ids: pa.ListArray) -> pa.BooleanArray:
        """Whether the ids' bytes are the text's."""
        told = self.bytes.take(ids.values)
        _, offsets, data = told.buffers()
        ends = np.frombuffer(offsets, np.int64)[told.offset : told.offset + len(told) + 1][ids.offsets.to_numpy()]
        # What is put in front of each text and the text itself, in turn.
        cuts = np.append(np.column_stack([ends[:-1], np.minimum(ends[:-1] + self.prefix, ends[1:])]), ends[-1])
        back = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(ids), [None, pa.py_buffer(cuts), data])
        return pc.equal(back.take(pa.array(np.arange(len(ids)) * 2 + 1)), texts.cast(pa.large_binary()))


_loaded: dict[str, Coder] = {}


def load(path: str) -> Coder:
    """The coder for a model file, once per worker."""
    if path not in _loaded:
        with open(path, "rb") as file:
            _loaded[path] = Coder(file.read())
    return _loaded[path]


def _file(spark, path: str) -> str:
    """Make the model file known to all executors; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_tokens``, ``parity`` and ``round_trip`` for column ``text``.

    ``parity``: SentencePiece gives the same ids, for every unit of the text or for the whole. ``round_trip``: the ids decode to the text as it was, which they
    do unless the model's normaliser changes it. A null text has null ids, no tokens, and both are true; an empty one has
    an empty list. Columns of these names are replaced.
    """
    file = _file(docs.sparkSession, model_path)

    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        coder = load(SparkFiles.get(file))
        for column in columns:
            column = column.cast(pa.string())
            for piece in pieces(column, GROUP_BYTES):
                own = column.slice(piece.first, piece.n)
                texts = own.fill_null("")
                ids, parity = coder.encode(texts, threads)
                back = coder.returns(texts, ids)
                if own.null_count:
                    ids = pc.if_else(own.is_valid(), ids, pa.scalar(None, ids.type))
                yield pa.StructArray.from_arrays(
                    [ids, pa.array(parity), back], names=["ids", "parity", "round_trip"]
                )
            give_back()

    encode.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    told = F.arrow_udf(encode, "struct<ids: array<int>, parity: boolean, round_trip: boolean>").asNondeterministic()
    name = spare_name(docs.columns, "told")
    found = docs.withColumn(name, told(F.col("text")))
    return found.withColumns(
        {
            "ids": F.col(f"{name}.ids"), "n_tokens": F.coalesce(F.size(f"{name}.ids"), F.lit(0)).cast("long"),
            "parity": F.col(f"{name}.parity"), "round_trip": F.col(f"{name}.round_trip"),
        }
    ).drop(name)


def decode_documents(rows: DataFrame, model_path: str) -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids``; null ids give a null text, no ids an empty one."""
    name = _file(rows.sparkSession, model_path)

    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(SparkFiles.get(name)).whole
        for column in columns:
            lists = column.to_pylist()
            told = tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
            yield pa.array([t if x is not None else None for x, t in zip(lists, told)], pa.string())

    decode.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn("text", F.arrow_udf(decode, "string").asNondeterministic()(F.col("ids")))
