"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads token labels; it accepts a sequence of tokens exactly if it is the one that
the merges give. It starts as one state with a loop for each single-byte token. For each merge
(u, v) -> w, in order, a merge gadget changes it:

  1. u leads to a state of its own from now on, like its old target but without the arc v;
  2. w gets an arc from each state that had u (then v), to the state where v led.

A state is thus named by the label that leads to it. Written out, the arcs would be states x
labels; here a state stores only what its gadgets took away, with the time (merge number), and
states share: w's state is v's as of the time of the merge, and an arc w leaves a state if its u
did at that time. `arc(s, t)` follows both chains; what it finds goes into a transition table.

A word is encoded by the one path of arcs whose labels spell it: the longest label first, the
table decides, and a dead end steps back. Every prefix has one tokenization, so no position is
left by the same way twice. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched
from .pieces import PieceEncoder, is_of_mode, sliced

# The split pattern and byte alphabet of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(33, 126), (161, 172), (174, 255)]

TABLE_ARCS = 2_000_000
START = -1


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else 256, 257, ... in turn."""
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeAutomaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        """labels: the bytes of each token id; merges: (u, v, w) ids, first merge first."""
        self.labels = labels
        self.removed: dict[int, int] = {}  # u << 32 | v: the time at which v left u's state
        self.made: dict[int, tuple[int, int, int]] = {}  # w: its time, u and v
        self.table: dict[int, bool] = {}
        for time, (u, v, w) in enumerate(merges):
            if w not in self.made and self.arc(u, v):  # else no path u v is left: the gadget adds nothing
                self.removed[u << 32 | v] = time
                self.made[w] = (time, u, v)
        self.spelled = {labels[t]: t for t in [*self.made, *(i for i, x in enumerate(labels) if len(x) == 1)]}
        self.longest = max(map(len, self.spelled), default=0)

    def arc(self, s: int, t: int) -> bool:
        """Whether label t may follow label s."""
        made, removed = self.made, self.removed
        since = len(made) + (1 << 40)
        while True:  # s's state is that of its last part, as of the time s was made
            x, until = t, since
            while True:  # and lost t if it had lost t's first part when t was made
                time = removed.get(s << 32 | x)
                if time is not None and time < since and time <= until:
                    return False
                if x not in made:
                    break
                until, x, _ = made[x]
            if s not in made:
                return True
            since, _, s = made[s]

    def word(self, data: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        spelled, table, longest, n = self.spelled, self.table, self.longest, len(data)
        whole = spelled.get(data)
        if whole is not None:
            return [whole]
        if len(table) > TABLE_ARCS:
            table.clear()
        path: list[int] = []
        at, state, size = 0, START, longest
        dead = set()
        while at < n:
            size = min(size, n - at)
            while size:
                t = spelled.get(data[at : at + size])
                if t is not None and at + size not in dead:
                    if state == START:
                        break
                    key = state << 32 | t
                    ok = table.get(key)
                    if ok is None:
                        ok = table[key] = self.arc(state, t)
                    if ok:
                        break
                size -= 1
            if size:
                path.append(t)
                at, state, size = at + size, t, longest
            else:  # a dead end: the last arc was wrong, try a shorter one
                if not path:
                    raise ValueError(f"no token for {data[at : at + 1]!r}")
                dead.add(at)
                size = len(self.labels[path.pop()])
                at -= size
                size -= 1
                state = path[-1] if path else START
        return path


class ByteTokenizer:
    """Encodes texts as the vocabulary file says: special tokens, then the split, then the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not is_of_mode(spec, "byte"):
            raise ValueError(f"{path} isn't a byte-level vocabulary with the usual split")
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        labels = [b""] * size
        for token, i in vocab.items():
            labels[i] = bytes(alphabet[c] for c in token)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        for token, i in self.special.items():
            labels[i] = token.encode()
        self.labels = labels
        self.arc_bytes = pa.array(labels, pa.binary())
        self.arc_digits = pa.array([b"%d," % i for i in range(size)], pa.binary())
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.encoder = PieceEncoder(lambda texts: [self.ids(t) for t in texts], "byte", size)

    def ids(self, text: str) -> list[int]:
        word, out = self.automaton.word, []
        parts = self.specials.split(text) if self.specials and any(t in text for t in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.split.findall(part):
                    out += word(w.encode())
        return out


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def _emitted(labels: pa.Array, flat: np.ndarray, rows: np.ndarray) -> list[memoryview]:
    """For each text, the labels of its ids, one after the other."""
    taken = labels.take(pa.array(flat))
    ends = taken.offsets.to_numpy().astype(np.int64) if hasattr(taken, "offsets") else np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1).astype(np.int64)
    data = memoryview(taken.buffers()[2]) if len(flat) else memoryview(b"")
    at = np.concatenate([[0], np.cumsum(rows)])
    cut = ends[at].tolist()
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _text(data: memoryview) -> bytes:
    """Bytes as UTF-8, with the replacement character where they are none."""
    raw = bytes(data)
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
    return raw


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    A null text is empty: no tokens, digests of nothing. Rows are taken one by one, so repeated
    rows and ids, and null ids, give one row each; extra columns are not read. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for i, j in sliced(batch.column(1)):
                flat, rows = t.encoder.encode(batch.column(1).slice(i, j - i))
                digits = [hashlib.sha256(x[:-1]).hexdigest() for x in _emitted(t.arc_digits, flat, rows)]
                texts = [_text(x) for x in _emitted(t.arc_bytes, flat, rows)]
                out = [batch.column(0).slice(i, j - i), pa.array(rows), pa.array(digits), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
                    out += [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return batched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema + ", ids array<int>, decoded string" * with_ids)
