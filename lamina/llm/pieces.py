"""Vectorised tokenization of whole texts by way of the distinct pieces of a batch.

A text is cut only where its tokenizer always has a token boundary, so the ids of the text are
the ids of its pieces, one after the other:

- mode "word" (white space dropped before the merges): at ASCII white space;
- mode "byte" (a word takes one leading space): before a space or line end. Inside longer runs of
  white space, or beside other kinds of it, that isn't a boundary; such texts are encoded whole.

Arrow splits the texts and finds the distinct pieces; the tokenizer sees each distinct piece
once in a while (a cache of bounded bytes holds the pieces that come again), and numpy lays out the
ids. Which boundaries a tokenizer has is read from its file: one whose normalizer, split or model
isn't of the kind that a mode stands for encodes all texts whole, by the library alone.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Space inside or at the end of a run of white space, other white space than plain ASCII, or the
# mark that stands for line ends here.
_MARK = "\x01"
_WHOLE = r"\s[ \n]\s|\s[ \n]\z|[\x01\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CACHE_PIECES, CACHE_PARTS = 64 << 20, 64 << 20  # bytes of a generation of each cache
_ENTRY = 200  # bytes of an entry besides its text and ids
# The split patterns of the two modes for texts of ASCII and Latin-1 letters, which are in normal
# form, and the characters that stand for bytes that aren't printable.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
_SPLIT = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\sA-Za-z0-9{_LETTERS}]+|\s+(?!\S)|\s+", re.ASCII),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+", re.ASCII),
}
_BYTES = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}
SLICE_BYTES = 4 << 20

# What a file says whose token boundaries are those of a mode.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = {"byte": None, "word": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}}
_SPLITTERS = {
    "byte": _BYTE_LEVEL | {"use_regex": True},
    "word": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def is_of_mode(spec: dict, mode: str) -> bool:
    """Whether a tokenizer file (parsed) is of the kind that `mode` stands for."""
    marks = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    model = all(spec["model"].get(k) == v for k, v in _MODEL.items()) and spec["model"].get("end_of_word_suffix") == {"byte": None, "word": "</w>"}[mode]
    return marks and model and spec["normalizer"] == _NORMALIZERS[mode] and spec["pre_tokenizer"] == _SPLITTERS[mode]


def gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """pool[s:s+n] for each (s, n), one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 30 else np.int64
    return pool[np.arange(total, dtype=kind) + np.repeat((starts - (ends - lens)).astype(kind), lens)]


def sliced(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text."""
    n = len(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield at, min(to, n)
        at = to


class Recent(dict):
    """A cache of strings' ids in two generations of about `size` bytes: what was used lately stays."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.held, self.old = size, 0, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.get, keys))
        if self.old:
            for i, x in enumerate(out):
                if x is None and (y := self.old.get(keys[i])) is not None:
                    out[i] = y
                    self.put(keys[i], y)
        return out

    def put(self, key: str, data: bytes) -> None:
        if self.held > self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = data
        self.held += _ENTRY + len(key) + len(data)

    def empty(self) -> None:
        self.clear()
        self.held, self.old = 0, {}


class PieceEncoder:
    """ids of whole texts. encode_many: a list of strings -> a list of id lists (of any text)."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], mode: str, vocab_size: int):
        self.encode_many, self.mode = encode_many, mode
        self.dtype = np.dtype("<u2" if vocab_size <= 1 << 16 else "<u4")
        self.code = "H" if vocab_size <= 1 << 16 else "I"
        self.cache = Recent(CACHE_PIECES)

    def forget(self) -> None:
        """Empty the caches."""
        self.cache.empty()

    def packed(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as bytes."""
        return [array(self.code, ids).tobytes() for ids in self.encode_many(pieces)]

    def _pack(self, pieces: list[str]) -> list[bytes]:
        cache = self.cache
        out = cache.find(pieces)
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            for i, data in zip(missing, self.packed([pieces[i] for i in missing]), strict=True):
                out[i] = data
                cache.put(pieces[i], data)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(0, np.int64)
        if self.mode == "byte":
            odd = pc.match_substring_regex(texts, _WHOLE)
            if pc.any(odd).as_py():
                whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
                own = self.encode_many(texts.take(pa.array(whole)).to_pylist())
                texts = pc.if_else(odd, "", texts)
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", f" {_MARK}"), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0] if len(offsets) else 0
        values = lists.flatten().dictionary_encode()
        codes = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = codes * 2
        if self.mode == "byte":
            keys += 1  # with a leading space, but for the first piece of a text
            keys[offsets[:-1]] -= 1
        flag = np.zeros(2 * len(values.dictionary), bool)
        flag[keys] = True
        used = np.flatnonzero(flag)
        words = values.dictionary.take(pa.array(used >> 1))
        if self.mode == "byte":
            line = pc.starts_with(words, _MARK)
            spaced = pc.and_(pa.array(used & 1 == 1), pc.invert(line))
            words = pc.if_else(line, pc.replace_substring(words, _MARK, "\n"), pc.if_else(spaced, pc.binary_join_element_wise(" ", words, ""), words))
        packed = self._pack(words.to_pylist())
        size = self.dtype.itemsize
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // size
        pool = np.frombuffer(b"".join(packed), self.dtype)
        at = (np.cumsum(flag) - 1)[keys]
        counts = lens[at]
        flat = gather(pool, (np.cumsum(lens) - lens)[at], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        rows = ends[offsets[1:]] - ends[offsets[:-1]]
        if len(whole):
            added = np.array([len(x) for x in own], np.int64)
            where = (np.cumsum(rows) - rows)[whole]
            flat = np.insert(flat, np.repeat(where, added), np.array([i for x in own for i in x], self.dtype))
            rows[whole] += added
        return flat, rows


_ENCODERS: dict[tuple, PieceEncoder] = {}


def library_encoder(path: str, mode: str) -> PieceEncoder:
    """An encoder by the tokenizers library, kept for the life of the Python worker."""
    if (path, mode) not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        split, tokenize = _SPLIT[mode].findall, tokenizer.model.tokenize
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        size = tokenizer.get_vocab_size(with_added_tokens=True)

        def encode_many(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        class LibraryEncoder(PieceEncoder):
            """Short plain pieces go to the library's model straight away; all others through its whole pipeline."""

            parts = Recent(CACHE_PARTS)

            def forget(self) -> None:
                super().forget()
                self.parts.empty()

            def part(self, p: str) -> bytes:
                data = self.parts.old.get(p)
                if data is None:
                    data = array(self.code, [t.id for t in tokenize(p if p.isalpha() and p.isascii() else p.encode().decode("latin-1").translate(_BYTES))]).tobytes()
                self.parts.put(p, data)
                return data

            def _pack(self, pieces: list[str]) -> list[bytes]:
                known, part, out, rest = self.parts.get, self.part, [], []
                for i, x in enumerate(pieces if mode == "byte" else [x.lower() if x.isascii() else x for x in pieces]):
                    data = known(x)
                    if data:
                        out.append(data)
                        continue
                    plain = x.isascii()
                    if plain and x[mode == "byte" and x[:1] == " " :].isalpha() and len(x) <= 200:  # one part
                        out.append(part(x))
                    elif len(x) > 200 or not (plain or _PLAIN.fullmatch(x)) or "<|" in x and any(t in x for t in added):
                        rest.append(i)
                        out.append(b"")
                    else:
                        out.append(b"".join([known(p) or part(p) for p in split(x if plain or mode == "byte" else x.lower())]))
                for i, data in zip(rest, super()._pack([pieces[i] for i in rest]), strict=True):
                    out[i] = data
                return out

        class WholeEncoder(PieceEncoder):
            """All texts through the library's whole pipeline."""

            def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                ids = self.encode_many(pc.fill_null(texts, "").to_pylist())
                rows = np.fromiter(map(len, ids), np.int64, len(ids))
                return np.fromiter((x for i in ids for x in i), self.dtype, int(rows.sum())), rows

        with open(path, encoding="utf-8") as f:
            kind = LibraryEncoder if is_of_mode(json.load(f), mode) else WholeEncoder
        _ENCODERS[path, mode] = kind(encode_many, mode, size)
    return _ENCODERS[path, mode]


def forget() -> None:
    """Empty the caches of all encoders of this Python worker, for tasks that come after the encoding: Spark
    gives them the same workers, which would hold the pieces to no use."""
    for encoder in _ENCODERS.values():
        encoder.forget()
    pa.default_memory_pool().release_unused()


def with_end(flat: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id at the end of each text."""
    return np.insert(flat, np.cumsum(rows), flat.dtype.type(end_id)), rows + 1
