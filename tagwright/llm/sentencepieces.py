"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format), and its normaliser, whitespace
marker, pieces with scores and byte fallback are rebuilt as a ``tokenizers`` pipeline:
a unigram model takes the scores as they are, a BPE model takes them as merge ranks.
Texts are encoded in batches by the library's threads.  Parity with the
``sentencepiece`` library is verified for every different chunk of text encoded.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.textbytes import field_names, release_memory

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the SentencePiece format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

#: Threads that encode in one Python worker.
THREADS = 2
#: Bytes of chunks and their ids that a worker remembers at most, and of what is kept beside each.
REMEMBERED = 256 << 20
_ENTRY = 200


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Model(NamedTuple):
    pieces: list[Piece]
    kind: int
    charsmap: bytes
    dummy_prefix: bool
    trim: bool
    escape: bool
    suffix: bool
    byte_fallback: bool


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif key & 7 in (1, 5):
            size = 8 if key & 7 == 1 else 4
            value, at = struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0], at + size
        else:
            raise ValueError(f"wire type {key & 7} is not known")
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """Read a ModelProto; field numbers are those of the public sentencepiece_model.proto."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(Piece(piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    model = Model(
        pieces,
        kind=trainer.get(3, UNIGRAM),
        charsmap=normalizer.get(2, b""),
        dummy_prefix=bool(normalizer.get(3, 1)),
        trim=bool(normalizer.get(4, 1)),
        escape=bool(normalizer.get(5, 1)),
        suffix=bool(trainer.get(24, 0)),
        byte_fallback=bool(trainer.get(35, 0)),
    )
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if any(p.kind in (USER_DEFINED, UNUSED) for p in pieces) or not model.escape:
        raise ValueError("user-defined pieces, unused pieces and unescaped whitespace cannot be rebuilt")
    return model


def _merges(pieces: list[Piece]) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, the best score first."""
    ids = {p.text: i for i, p in enumerate(pieces) if p.kind == NORMAL}
    found = []
    for text, i in ids.items():
        for cut in range(1, len(text)):
            left, right = ids.get(text[:cut]), ids.get(text[cut:])
            if left is not None and right is not None:
                found.append((-pieces[i].score, left, right))
    return [(pieces[left].text, pieces[right].text) for _, left, right in sorted(found)]


# Fixed value: how the reference decodes an unknown piece; no text has it once its blanks are marked.
_UNKNOWN = " ⁇ "


def rebuild(model: Model):
    """The model as a tokenizer of the ``tokenizers`` library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next(i for i, p in enumerate(model.pieces) if p.kind == UNKNOWN)
    if model.kind == BPE:
        core = models.BPE(
            vocab={_UNKNOWN if i == unknown else p.text: i for i, p in enumerate(model.pieces)},
            merges=_merges(model.pieces),
            unk_token=_UNKNOWN,
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        # Control and unknown pieces do not occur in texts, whatever their names.
        named = [f"\U0010fffe{i}" if p.kind == CONTROL else p.text for i, p in enumerate(model.pieces)]
        named[unknown] = _UNKNOWN
        lowest = 10 * min([p.score for p in model.pieces if p.kind == NORMAL], default=-1.0) - 1000
        scores = [p.score if p.kind == NORMAL else lowest for p in model.pieces]
        core = models.Unigram(list(zip(named, scores)), unknown, model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(r"\A +| +\z"), "")]
    if model.dummy_prefix and not model.suffix:
        steps.append(normalizers.Prepend(" "))
    elif model.dummy_prefix:
        steps.append(normalizers.Replace(Regex("(?<=.)$"), " "))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if _splits(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(_CHUNK), "isolated")
    edge = decoders.Strip(" ", 0, 1) if model.suffix else decoders.Strip(" ", 1, 0)
    after = [edge] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *after])
    return tokenizer


_CHUNK = f"{MARK}*[^{MARK}]+|{MARK}+"
_CHUNKS = re.compile(_CHUNK)


def _splits(model: Model) -> bool:
    """Whether no piece reaches from a word into the whitespace after it, so that words can be encoded alone."""
    return not model.suffix and not any(
        MARK in p.text.lstrip(MARK) for p in model.pieces if p.kind == NORMAL
    )


class Rebuilt(NamedTuple):
    """What travels to the tasks: the model file's bytes, the tokenizer as text, and the kinds of its pieces."""

    data: bytes
    tokenizer: str
    chunked: bool
    is_byte: np.ndarray
    is_unknown: np.ndarray
    #: Text of every ordinary piece, its blanks marked; others are empty.
    pieces: list[str]

    @classmethod
    def read(cls, data: bytes) -> Rebuilt:
        model = parse(data)
        # Chunks can be encoded and decoded alone where the normaliser only marks blanks and the mark is a piece.
        marked = any(p.text == MARK and p.kind == NORMAL for p in model.pieces)
        chunked = marked and _splits(model) and not model.charsmap and not model.trim and model.dummy_prefix
        kinds = np.array([p.kind for p in model.pieces])
        return cls(data, rebuild(model).to_str(), chunked, kinds == BYTE, kinds == UNKNOWN,
                   [p.text if p.kind == NORMAL else "" for p in model.pieces])


def _bare(tokenizer: str) -> str:
    """The tokenizer without its normaliser, its splitting of texts, and the stripping of what it decodes."""
    parts = json.loads(tokenizer)
    steps = [step for step in parts["decoder"]["decoders"] if step["type"] != "Strip"]
    decoder = parts["decoder"] | {"decoders": steps}
    return json.dumps(parts | {"normalizer": None, "pre_tokenizer": None, "decoder": decoder})


class Codec:
    """Encodes and decodes batches of texts with one model.

    Ids come from the rebuilt tokenizer; ``sentencepiece`` checks them, and its ids
    replace those that differ.
    """

    def __init__(self, rebuilt: Rebuilt, threads: int = THREADS, remembered: int = REMEMBERED, at_once: int | None = None):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import Tokenizer

        self.chunked = rebuilt.chunked
        # In pieces, chunks arrive with their blanks marked already, and are decoded with their blanks.
        self.tokenizer = Tokenizer.from_str(_bare(rebuilt.tokenizer) if self.chunked else rebuilt.tokenizer)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=rebuilt.data)
        self.is_byte, self.is_unknown = rebuilt.is_byte, rebuilt.is_unknown
        # Texts of ordinary pieces; no chunk has the length of another.
        self.pieces = rebuilt.pieces
        self.lengths = np.array([len(p) if p else 1 << 40 for p in self.pieces], np.int64)
        self.remembered, self.at_once = remembered, at_once
        # Ids of chunks met lately and of those met before, the bytes of the former, and the chunks
        # that the two libraries encode differently or that decode to something else.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.differs: set[str] = set()
        self.odd: dict[str, str] = {}

    def _encode(self, texts: list[str], asked: list[str] | None = None, skip: int = 0) -> tuple[list, list]:
        """Ids of each text, and the places of texts on whose ids the two libraries disagree.

        The reference is asked about ``asked`` where that differs, and the first
        ``skip`` of its ids are left out.
        """
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        expected = self.reference.encode(asked or texts, num_threads=1)
        if skip:
            expected = [e[skip:] for e in expected]
        if found == expected:
            return found, []
        wrong = [i for i, (a, b) in enumerate(zip(found, expected)) if a != b]
        for i in wrong:
            found[i] = expected[i]
        return found, wrong

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks not remembered.

        The reference puts a blank before a text, as which a word's own blank
        counts; blanks alone are compared behind a line's end.
        """
        words = [c for c in chunks if c[0] == MARK and len(c) > 1 and MARK not in c[1:]]
        if len(words) == len(chunks):
            return self._learnt(words, *self._encode(words, [c[1:] for c in words])) if words else {}
        plain = set(words)
        others = [c for c in chunks if c not in plain]
        spaced = [c for c in others if c.strip(MARK)]
        blank = [c for c in others if not c.strip(MARK)]
        known = self._learnt(words, *self._encode(words, [c[1:] for c in words])) if words else {}
        if spaced:
            known |= self._learnt(spaced, *self._encode(spaced, [c[1:].replace(MARK, " ") for c in spaced]))
        if blank:
            before = len(self.reference.encode("\n"))
            known |= self._learnt(blank, *self._encode(blank, ["\n" + c.replace(MARK, " ") for c in blank], before))
        return known

    def _learnt(self, chunks: list[str], ids: list[list[int]], wrong: list[int]) -> dict[str, bytes]:
        """Ids by chunk; chunks that differ, and those that decode to something else, are noted."""
        self.differs.update(chunks[i] for i in wrong)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        # Ordinary pieces decode to their own text: chunks that they add up to need no decoding.
        lengths = np.add.reduceat(self.lengths[flat], ends - sizes) if sizes.all() else np.full(len(chunks), -1)
        plain = lengths == np.fromiter(map(len, chunks), np.int64, len(chunks))
        spelled = "".join(map(self.pieces.__getitem__, flat[np.repeat(plain, sizes)].tolist()))
        if spelled != "".join(compress(chunks, plain.tolist())):
            plain[:] = False
        rest = np.flatnonzero(~plain).tolist()
        for i, text in zip(rest, self.tokenizer.decode_batch([ids[i] for i in rest], skip_special_tokens=False)):
            if text != chunks[i].replace(MARK, " "):
                self.odd[chunks[i]] = text
        data = flat.tobytes()
        cuts = (4 * ends).tolist()
        return {c: data[a:b] for c, a, b in zip(chunks, [0, *cuts], cuts)}

    def _ids_of(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of these chunks; the ones met lately stay in memory, within the bound."""
        young, old = self.young, self.old
        missing = [c for c in chunks if c not in young]
        again = {c: old[c] for c in missing if c in old}
        unknown = [c for c in missing if c not in again] if again else missing
        fresh = again
        # The library's own objects take a kilobyte a chunk while they last.
        some = self.at_once or max(1, len(unknown))
        for at in range(0, len(unknown), some):
            fresh.update(self._learn(unknown[at : at + some]))
        self.held += _ENTRY * len(fresh) + 4 * sum(map(len, fresh)) + sum(map(len, fresh.values()))
        if self.held <= self.remembered // 2:
            young.update(fresh)
            return young
        found = {c: ids for c in chunks if (ids := fresh.get(c) or young.get(c)) is not None}
        # What this batch has, and before it what the one before had, in place of all that is older.
        size = _ENTRY * len(found) + 4 * sum(map(len, found)) + sum(map(len, found.values()))
        if size <= self.remembered // 2:
            self.old, self.young, self.held = young, found.copy(), size
        else:
            self.old, self.young, self.held = young, {}, 0
        rest = self.young.keys() | self.old.keys() | chunks
        self.differs &= rest
        self.odd = {c: t for c, t in self.odd.items() if c in rest}
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """All ids, how many each text has, whether the rebuilt tokenizer and the reference agree, and the texts decoded."""
        if not self.chunked:
            ids, wrong = self._encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(texts))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            same = np.ones(len(texts), bool)
            same[wrong] = False
            return flat, sizes, same, self.decode(ids)
        # With the blank put before it, every chunk of a text has blanks of its own.
        cut = [_CHUNKS.findall((" " + t).replace(" ", MARK)) if t else [] for t in texts]
        met = set(chain.from_iterable(cut))
        ids_of = self._ids_of(met)
        found = [b"".join(map(ids_of.__getitem__, chunks)) for chunks in cut]
        sizes = np.fromiter((len(f) // 4 for f in found), np.int64, len(found))
        differs, odd = self.differs & met, self.odd.keys() & met
        same = [not differs or differs.isdisjoint(chunks) for chunks in cut]
        decoded = [
            t if MARK not in t and (not odd or odd.isdisjoint(chunks)) else self._decoded(chunks)
            for t, chunks in zip(texts, cut)
        ]
        return np.frombuffer(b"".join(found), np.int32), sizes, np.array(same, bool), decoded

    def _decoded(self, chunks: list[str]) -> str:
        """The first blank was put there by the normaliser."""
        return "".join(self.odd.get(c) or c.replace(MARK, " ") for c in chunks)[1:]

    def decode(self, ids: list[list[int]]) -> list[str]:
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t[1:] if t[:1] == " " else t for t in decoded] if self.chunked else decoded


def _read(path: str) -> Rebuilt:
    with open(path, "rb") as file:
        return Rebuilt.read(file.read())


def _slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of at most ``limit`` characters together, one row at least."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


#: Characters that are encoded at a time.
_CHARS = 1 << 20

_ENCODED = "ids array<int>, n_tokens int, n_byte_tokens int, n_unknown int, parity boolean, decoded string"


def _encode(rebuilt: Rebuilt, carried: list[str], remembered: int = REMEMBERED, at_once: int | None = None) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(rebuilt, remembered=remembered, at_once=at_once)
        # Building it takes more than it keeps, and earlier tasks of this worker may have left something too.
        release_memory()
        # Nothing here makes cycles, and going through millions of small lists for some takes a quarter of the time.
        gc.disable()
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch["text"]), 0).to_pylist()
            for start, end in _slices(lengths, _CHARS):
                rows = batch.slice(start, end - start)
                flat, sizes, parity, decoded = codec.encode([t or "" for t in rows["text"].to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                row = np.repeat(np.arange(len(sizes)), sizes)
                counts = [np.bincount(row[kind[flat]], minlength=len(sizes)) for kind in (codec.is_byte, codec.is_unknown)]
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[rows[c] for c in carried],
                        ids,
                        pa.array(sizes.astype(np.int32)),
                        *[pa.array(c.astype(np.int32)) for c in counts],
                        pa.array(parity, pa.bool_()),
                        pa.array(decoded, pa.string()),
                    ],
                    names=[*carried, *field_names(_ENCODED)],
                )
            if at_once:
                release_memory()
        gc.enable()
        del codec
        release_memory()

    return encode


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and ids of every document, with counts, the decoded text and parity with the reference.

    Ids are the rebuilt tokenizer's; where the check finds a chunk (a word with the
    blanks before it) that it encodes otherwise, ``parity`` is false and the chunk
    has the reference's ids.  A null text is encoded as an empty one, which has no ids.  Strings of control
    pieces in a text are ordinary text.  Ids of bytes that do not form characters
    decode to replacement characters.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_encode(_read(model_path), ["doc_id"]), f"doc_id long, {_ENCODED}")


def digest(docs: DataFrame, model_path: str = MODEL, remembered: int = REMEMBERED, at_once: int | None = None) -> DataFrame:
    """Per document: doc_id, ids, counts, parity, and whether decoding gives the text again.

    A worker remembers chunks in ``remembered`` bytes.  With ``at_once`` it learns so many
    chunks at a time and gives memory back after every batch: slower, with less memory.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encode = _encode(_read(model_path), ["doc_id", "text"], remembered, at_once)

    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in encode(batches):
            same = [(t or "") == d for t, d in zip(done["text"].to_pylist(), done["decoded"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [done[c] for c in ("doc_id", "ids", "n_tokens", "n_byte_tokens", "n_unknown", "parity")]
                + [pa.array(same, pa.bool_())],
                names=field_names(_DIGEST),
            )

    return keyed.mapInArrow(round_trip, _DIGEST)


_DIGEST = (
    "doc_id long, ids array<int>, n_tokens int, n_byte_tokens int, n_unknown int, parity boolean, round_trip boolean"
)
