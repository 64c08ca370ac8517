"""SentencePiece models on the tokenizers library: the model file is parsed, rebuilt and checked for equal ids."""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import public_vocabulary, ship, text_or_empty

MARKER = "▁"
# Numbers of the public model format (kinds of pieces, kinds of models).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KNOWN_BYTES = 128 << 20  # a task forgets the ids of its words beyond this size and encodes them again
WORD_COST = 220  # bytes of a known word beside its characters and ids
SLICE = 1 << 20  # characters that are encoded, decoded and compared at a time
RUN = 1 << 15  # characters of new words that go to the library as one text


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0
    while at < len(data):
        head, at = _varint(data, at)
        kind = head & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield head >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says about its pieces and its normaliser."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    marker_last: bool = False


def parse_model(data: bytes) -> Model:
    """Read a model file: field 1 holds the pieces, 2 how it was trained, 3 the normaliser."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            trained = dict(_fields(value))
            model.kind = trained.get(3, UNIGRAM)
            model.byte_fallback = bool(trained.get(35, 0))
            model.marker_last = bool(trained.get(24, 0))
        elif number == 3:
            rules = dict(_fields(value))
            model.charsmap = rules.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make up a piece, best piece first: the order in which a BPE model joins them."""
    usable = {text: (score, number) for number, (text, score, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    pairs = [
        (-usable[text][0], usable[text][1], text[:i], text[i:])
        for text in usable for i in range(1, len(text)) if text[:i] in usable and text[i:] in usable
    ]
    return [(left, right) for _, _, left, right in sorted(pairs)]


def words_apart(model: Model) -> bool:
    """Whether texts may be cut before each marker: no piece goes on with a marker after another character."""
    return model.dummy_prefix and model.escape and not model.marker_last and not any(
        MARKER in text.lstrip(MARKER) for text, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)
    )


def rebuild(model: Model):
    """The model as a tokenizer of the tokenizers library, with its normaliser, marker, pieces and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        # Control pieces never match text: they keep their numbers under names that text cannot hold.
        vocabulary = [
            (text if kind in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else f"\0{text}", score)
            for text, score, kind in model.pieces
        ]
        core = models.Unigram(vocabulary, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            vocab={text: i for i, (text, _, _) in enumerate(model.pieces)}, merges=_merges(model.pieces),
            unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_apart(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}+[^{MARKER}]*"), "isolated")
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class Codec:
    """Encodes and decodes batches with the library's threads; words that recur are encoded once.

    With ``verify`` the ids are compared with those of the sentencepiece library.
    """

    def __init__(self, path: str, threads: int = 2, verify: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer = rebuild(self.model)
        plain = not self.model.charsmap and not self.model.squeeze
        self.apart = plain and words_apart(self.model)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.changed: set[str] = set()  # known words that do not come back as they were
        self.different: set[str] = set()  # and those with other ids than the library's
        self.threads, self.reference = threads, None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = self.model.pieces
        self.bytes = np.array([kind == BYTE for _, _, kind in pieces] + [False])
        self.opens = np.array([text.startswith(MARKER) for text, _, _ in pieces] + [False])

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        """Encode and decode new words, some thousand at a time as one text, whose ids are cut where a marker opens a word."""
        runs, size = [[]], 0
        for word in words:
            if size > RUN:
                runs.append([])
                size = 0
            runs[-1].append(word)
            size += len(word) + 1
        lines = [" ".join(run) for run in runs]
        ids = self._direct(lines)
        for run, line, found, back in zip(runs, lines, ids, self.decode(ids)):
            starts = np.flatnonzero(self.opens[np.frombuffer(found, "<u4")]) * 4
            if len(starts) == len(run) and starts[0] == 0:
                parts = [found[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(found)])]
            else:
                parts = self._direct(run)
            if back != line:
                self.changed.update(w for w, x in zip(run, self.decode(parts)) if w != x)
            self.different.update(w for w, fine in zip(run, self._as_library(run, parts)) if not fine)
            self.known.update(zip(run, parts))
            self.known_bytes += len(line) + len(found) + WORD_COST * len(run)

    def _as_library(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids; true where it is not asked."""
        if self.reference is None or not texts:
            return [True] * len(texts)
        theirs = self.reference.encode(texts, num_threads=self.threads)
        if b"".join(ids) == np.fromiter(chain.from_iterable(theirs), "<u4").tobytes() and [len(x) // 4 for x in ids] == list(map(len, theirs)):
            return [True] * len(texts)
        return [x == np.array(y, "<u4").tobytes() for x, y in zip(ids, theirs)]

    def encode_and_check(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Ids of each text, as little-endian 32-bit numbers; whether decoding them gives the text back; whether the
        sentencepiece library has the same ids.

        Where words are apart, no piece reaches from one word into the next: the ids of a text are those of its words one
        after the other, in either library, and what holds for its words holds for the text. Runs of blanks and texts that
        hold the marker itself go to the libraries whole.
        """
        words: list[list[str] | None] = [None] * len(texts)
        if self.apart:
            words = [
                None if "  " in t or MARKER in t or t[:1] == " " or t[-1:] == " " else t.split(" ") if t else []
                for t in texts
            ]
        if self.known_bytes > KNOWN_BYTES:
            self.known.clear()
            self.changed.clear()
            self.different.clear()
            self.known_bytes = 0
        known = self.known
        if new := set(chain.from_iterable(parts for parts in words if parts)).difference(known):
            self._learn(list(new))
        other = [t for t, parts in zip(texts, words) if parts is None]
        found = self._direct(other)
        whole = iter(zip(found, [a == b for a, b in zip(self.decode(found), other)], self._as_library(other, found)))
        ids, same, equal = [], [], []
        for parts in words:
            if parts is None:
                one, fine, alike = next(whole)
            else:
                one = b"".join(map(known.__getitem__, parts))
                fine = not self.changed or self.changed.isdisjoint(parts)
                alike = not self.different or self.different.isdisjoint(parts)
            ids.append(one)
            same.append(fine)
            equal.append(alike)
        return ids, same, equal

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_and_check(texts)[0]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)

    def slices(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """Texts with their places, about ``SLICE`` characters at a time.

        A longer text is cut at single blanks, where words are apart: each part has the ids that it has in the text.
        """
        waiting, size = [], 0
        for i, text in enumerate(texts):
            at = 0
            while True:
                cut = single_blank(text, at + SLICE) if self.apart and len(text) - at > SLICE else -1
                part = text[at : cut if cut >= 0 else len(text)]
                waiting.append((i, part))
                size += len(part)
                if size >= SLICE:
                    yield waiting
                    waiting, size = [], 0
                if cut < 0:
                    break
                at = cut + 1
        if waiting:
            yield waiting


def single_blank(text: str, at: int) -> int:
    """The place of the first blank from ``at`` that has no blank beside it, or -1."""
    while (at := text.find(" ", at)) >= 0:
        if 0 < at < len(text) - 1 and text[at - 1] != " " and text[at + 1] != " ":
            return at
        at += 1
    return -1


@functools.lru_cache(maxsize=2)
def codec(model: str, threads: int, verify: bool) -> Codec:
    """The codec of a model file, or of a public one by its name; one for each worker."""
    return Codec(public_vocabulary(model) if os.sep not in model else model, threads, verify)


def _run(model: str, threads: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model, threads, True)
        for batch in batches:
            n = batch.num_rows
            tokens, sums, pieces = (np.zeros(n, np.int64) for _ in range(3))
            same, equal = np.ones(n, bool), np.ones(n, bool)
            kept: list[list[np.ndarray]] = [[] for _ in range(n if keep_ids else 0)]
            for part in tool.slices(batch.column("text").to_pylist()):
                texts = [t for _, t in part]
                for (i, _), ids, fine, alike in zip(part, *tool.encode_and_check(texts)):
                    numbers = np.frombuffer(ids, "<u4")
                    tokens[i] += len(numbers)
                    sums[i] = zlib.crc32(ids, int(sums[i]))
                    pieces[i] += int(tool.bytes[numbers].sum())
                    same[i] &= fine
                    equal[i] &= alike
                    if keep_ids:
                        kept[i].append(numbers.astype(np.int32))
            columns = {
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(tokens), "ids_crc32": pa.array(sums),
                "n_byte_pieces": pa.array(pieces), "round_trip": pa.array(same), "equal": pa.array(equal),
            }
            if keep_ids:
                columns["ids"] = pa.array([np.concatenate(x) for x in kept], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_texts(
    docs: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", threads: int = 2,
    keep_ids: bool = True,
) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, n_byte_pieces, round_trip, equal`` and, if asked for, ``ids``: a row for each row.

    ``model`` is a model file that every executor can open, or the name of a public one. Whole texts are encoded and
    decoded again; ``round_trip`` says whether the text came back (a normaliser may have changed it), ``equal`` whether the
    sentencepiece library gives the same ids, which is checked for every text, or for every word of it where the model
    joins nothing across words. ``n_byte_pieces`` counts pieces that stand
    for single bytes of characters outside the vocabulary. About a million characters are held as ids at a time; where
    the model joins nothing across words, longer texts are cut at blanks for that, and else taken whole. Null and empty
    texts have no ids; repeated rows are encoded alike; an empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_crc32 long, n_byte_pieces long, round_trip boolean, equal boolean"
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_run(model, threads, keep_ids), schema + (", ids array<int>" if keep_ids else ""))


def decode_ids(encoded: DataFrame, model: str = "piece_bpe_32k.model", threads: int = 2) -> DataFrame:
    """``doc_id, text`` for rows with ``doc_id, ids``; null ids give an empty text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model, threads, False)
        for batch in batches:
            ids = [np.array(x or [], "<u4").tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": tool.decode(ids)})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
