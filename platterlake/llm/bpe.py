"""BPE encoding with content-defined chunk reuse.

A gear hash rolls over the UTF-8 bytes of a text (32 bytes of context); a chunk
ends where its low bits are zero. The same passage gives the same chunks in any
document, so a worker encodes a chunk once and keeps its ids for the documents
that follow, in a cache of bounded size.

Chunks cut words in two, so the ids next to a join are wrong. A join is repaired
by encoding the text around it again, from the last place in the left chunk to
the first place in the right chunk where a word ends before a blank. There the
pre-tokenizer always splits, whatever stands around. The repair holds if the
chunk's own tokens end exactly there; if not, or if a chunk has no such place,
the window grows by the next chunk until it does.

Ids come from the rank file through tiktoken, and for text beyond Latin letters,
where character classes of two regex engines might differ, or that spells a
special token, from the tokenizers library itself. Tests hold both against it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk ends where this many low bits of the rolling hash are zero.
CHUNK_BITS = 10
#: No chunk is shorter (bytes), so runs of one character do not fall apart.
CHUNK_LEAST = 256
#: Text (characters) whose ids a worker keeps.
CACHE_CHARS = 4_000_000
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
_EDGE = re.compile(r"(?<=[!-~])[ \n]")
#: Letters beyond U+024F, special tokens and blanks other than space and newline go to the slower library.
_PLAIN = re.compile(r"[ \n!-~\xa1-\xac\xae-ɏ]*")


def cuts(data: bytes) -> list[int]:
    """Byte offsets where chunks of a text end, the text's own end last."""
    raw = np.frombuffer(data, dtype=np.uint8)
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    top = np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1
    top = top[top < len(raw)]
    top = top[(raw[top] & 0xC0) != 0x80]
    out, at = [], 0
    while (k := np.searchsorted(top, at + CHUNK_LEAST)) < len(top):
        at = int(top[k])
        out.append(at)
    return [*out, len(data)]


class _Chunk:
    """Ids of one chunk and where its inner part lies."""

    __slots__ = ("head", "ids", "inner", "tail", "text")

    def __init__(self, text: str, ids: np.ndarray, lengths: np.ndarray):
        self.text, self.ids, self.inner = text, ids, None
        first = _EDGE.search(text)
        if first is None:
            return
        low = first.start()
        spot = max(text.rfind(" "), text.rfind("\n"))
        while spot > low and not "!" <= text[spot - 1] <= "~":
            spot = max(text.rfind(" ", low, spot), text.rfind("\n", low, spot))
        high = max(spot, low)
        ends = np.cumsum(lengths[ids])
        a = int(np.searchsorted(ends, len(text[:low].encode()))) + 1
        b = int(np.searchsorted(ends, len(text[:high].encode()))) + 1
        # exact agreement: the chunk's own tokens end at both places
        if ends[a - 1] == len(text[:low].encode()) and ends[b - 1] == len(text[:high].encode()):
            self.inner, self.head, self.tail = ids[a:b], text[:low], text[high:]


class Codec:
    """Encoder and decoder of one vocabulary, with its chunk cache."""

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_file)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        size = max(self.slow.get_vocab_size(), max(ranks.values()) + 1)
        self.pieces: list[bytes] = [b""] * size
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for name, i in self.special.items():
            self.pieces[i] = name.encode()
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.cache: OrderedDict[str, _Chunk] = OrderedDict()
        self.cached = 0
        self.reused = self.encoded = 0

    def _encode(self, text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype=np.int32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int32)

    def _chunk(self, text: str) -> _Chunk:
        if (held := self.cache.get(text)) is not None:
            self.cache.move_to_end(text)
            self.reused += len(text)
            return held
        self.encoded += len(text)
        made = self.cache[text] = _Chunk(text, self._encode(text), self.lengths)
        self.cached += len(text)
        while self.cached > CACHE_CHARS and len(self.cache) > 1:
            self.cached -= len(self.cache.popitem(last=False)[0])
        return made

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the tokenizers library gives them."""
        data = text.encode("utf-8")
        ends = cuts(data)
        if len(ends) == 1:
            return self._encode(text) if len(data) < CHUNK_LEAST else self._chunk(text).ids
        parts, window, at = [], None, 0
        for k, end in enumerate(ends):
            chunk = self._chunk(data[at:end].decode("utf-8"))
            last = k == len(ends) - 1
            if window is None and chunk.inner is not None:  # the text's start is a place of its own
                parts.append(chunk.ids[: len(chunk.ids)] if last else self._start(chunk))
                window = [] if last else [chunk.tail]
            elif chunk.inner is None:
                window = [*(window or []), chunk.text]
            else:
                parts.append(self._encode("".join([*window, chunk.head])))
                parts.append(chunk.inner)
                window = [chunk.tail]
            at = end
        if window:
            parts.append(self._encode("".join(window)))
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)

    def _start(self, chunk: _Chunk) -> np.ndarray:
        """Ids of a first chunk up to its last place."""
        ends = np.cumsum(self.lengths[chunk.ids])
        return chunk.ids[: int(np.searchsorted(ends, len(chunk.text.encode()) - len(chunk.tail.encode()))) + 1]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; broken UTF-8 gives U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def codec(tokenizer_file: str, ranks_file: str, pattern: str) -> Codec:
    """This worker's codec for a vocabulary; read once."""
    key = (tokenizer_file, ranks_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def _each(files: tuple[str, str, str], kind: str, row):
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(*files)
        for texts in batches:
            yield row(own, texts)

    return run


def encode_udf(files: tuple[str, str, str]):
    """Column function: text to array<int> of ids; a null text has none."""
    return _each(files, "array<int>", lambda own, texts: pa.array([own.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32())))


def decode_udf(files: tuple[str, str, str]):
    """Column function: array<int> of ids to text."""
    return _each(files, "string", lambda own, ids: pa.array([own.decode(x.as_py() or []) for x in ids], pa.string()))


_DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string, exact: boolean>"


def _digest(own: Codec, texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        text = t.as_py() or ""
        ids = own.encode(text).tolist()
        decoded = own.decode(ids)
        listed = ",".join(map(own.decimal.__getitem__, ids))
        out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "exact": decoded == text})
    return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())]))


def encode_decode(docs: DataFrame, files: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, exact) of every row.

    ``files`` are the vocabulary as a tokenizers file, the same as ranks, and the
    split pattern of the ranks. The digests are taken where the ids are made, so
    no id leaves its worker. A null text is empty: no tokens. Nothing is shuffled,
    so repeated rows, null ids and hot keys need no care.
    """
    return docs.select(F.col(id_col).alias("id"), _each(files, _DIGEST, _digest)(F.col(text_col)).alias("d")).select("id", "d.*")


def _tokens(own: Codec, texts: pa.Array) -> pa.Array:
    ids = [own.encode(t.as_py() or "") for t in texts]
    exact = [own.decode(i.tolist()) == (t.as_py() or "") for i, t in zip(ids, texts, strict=True)]
    return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(exact, pa.bool_())], names=["ids", "exact"])


def tokenize(docs: DataFrame, files: tuple[str, str, str], text_col: str = "text") -> DataFrame:
    """(row, ids, exact): the row as it was, its text's ids, and whether they decode to it."""
    packed = docs.select(F.struct("*").alias("row"))
    kind = "struct<ids: array<int>, exact: boolean>"
    return packed.select("row", _each(files, kind, _tokens)(packed["row"].getField(text_col)).alias("t")).select("row", "t.*")


def public_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """The installed vocabulary files of a public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN
