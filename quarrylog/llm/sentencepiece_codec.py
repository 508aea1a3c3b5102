"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The trie holds the UTF-8 bytes of all normal pieces. A text gets one leading space, spaces become the white-space marker
(U+2581), and the best-scoring sequence of pieces is found; a character that no piece covers becomes byte pieces. No piece
has a marker after another character, nor a newline, so texts are cut before each run of spaces and around newlines, and
each distinct part of a batch is solved once. Short parts are solved together, one position at a time, by numpy; long ones
(a text without spaces is one part) by a scalar loop of the same recurrence. The pieces of a file trained otherwise than as a
unigram model carry ranks; these become log probabilities by Zipf's law. No cap on any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PART = re.compile(r"\n| *[^ \n]+| +")
UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
LONG = 64
SLICE_CHARS = 4_000_000


@dataclass
class DoubleArray:
    """base and check: from state s, byte c leads to base[s] + c if check there is s. value: the piece that ends in a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_double_array(keys: dict[bytes, int]) -> DoubleArray:
    trie: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, v in keys.items():
        at = 0
        for c in key:
            if (to := trie[at].get(c)) is None:
                to = trie[at][c] = len(trie)
                trie.append({})
                ends.append(-1)
            at = to
        ends[at] = v
    room = 2 * len(trie) + 1024
    base, check, value = (np.full(room, x, dtype=np.int32) for x in (0, -1, -1))
    used = np.zeros(room, dtype=bool)
    used[0] = True
    place = {0: 0}
    value[0] = ends[0]
    first = dense = 257  # so that any free slot serves any byte
    todo = [0]
    for node in todo:
        children = trie[node]
        if not children:
            continue
        codes = np.fromiter(children, dtype=np.int64)
        low = int(codes.min())
        if len(codes) == 1:
            while used[first]:
                first += 1
        at = begun = max(first if len(codes) == 1 else dense, low + 1)
        while True:
            b = at - low
            if b + 256 >= len(used):
                more = len(used)
                base, check, value = (np.concatenate([x, np.full(more, y, dtype=np.int32)]) for x, y in ((base, 0), (check, -1), (value, -1)))
                used = np.concatenate([used, np.zeros(more, dtype=bool)])
            if b > 0 and not used[b + codes].any():
                break
            at += 1
        if at - begun > 64:  # what lies before is nearly full: later nodes with several children start here
            dense = at
        s = place[node]
        base[s] = b
        for c, child in children.items():
            t = b + c
            used[t] = True
            check[t] = s
            value[t] = ends[child]
            place[child] = t
            todo.append(child)
    size = int(np.flatnonzero(used)[-1]) + 257
    return DoubleArray(base[:size].copy(), check[:size].copy(), value[:size].copy())


class _Codes(dict):
    def __missing__(self, key: str) -> int:
        v = self[key] = len(self)
        return v


@dataclass
class Codec:
    """pieces: their bytes by id, for decoding; scores by id; byte_ids: the id of each byte's piece."""

    trie: DoubleArray
    scores: np.ndarray
    pieces: list[bytes]
    byte_ids: np.ndarray
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.unknown = float(self.scores[self.trie.value[self.trie.value >= 0]].min()) - UNKNOWN_PENALTY

    def solve_one(self, b: bytes) -> list[int]:
        """The ids of one part, by the scalar recurrence."""
        base, check, value = _lists(self)
        scores, n = self.scores, len(b)
        best, back = [-np.inf] * (n + 1), [(-1, -1)] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            here = best[s]
            if here == -np.inf:
                continue
            width = _width(b[s])
            state, single = 0, False
            for e in range(s, n):
                t = base[state] + b[e]
                if check[t] != state:
                    break
                state = t
                if (v := value[t]) >= 0:
                    single |= e + 1 - s == width
                    if (x := here + scores[v]) > best[e + 1]:
                        best[e + 1], back[e + 1] = x, (s, v)
            if not single and (x := here + self.unknown) > best[s + width]:
                best[s + width], back[s + width] = x, (s, -1)
        out: list[int] = []
        e = n
        while e:
            s, v = back[e]
            out += [v] if v >= 0 else self.byte_ids[np.frombuffer(b[s:e], dtype=np.uint8)][::-1].tolist()
            e = s
        return out[::-1]

    def solve(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all parts one after another, those of part k at offsets[k]:offsets[k + 1]."""
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        short = np.flatnonzero(lengths <= LONG)
        lists: dict[int, list[int]] = {k: self.solve_one(parts[k]) for k in np.flatnonzero(lengths > LONG).tolist()}
        where, ids = self._solve_short([parts[k] for k in short.tolist()], lengths[short])
        counts = np.zeros(len(parts), dtype=np.int64)
        counts[short] = np.bincount(where, minlength=len(short))
        for k, v in lists.items():
            counts[k] = len(v)
        offsets = np.r_[0, np.cumsum(counts)]
        out = np.empty(offsets[-1], dtype=np.int32)
        first = np.r_[0, np.cumsum(counts[short])][:-1]
        out[offsets[short][where] + np.arange(len(ids)) - first[where]] = ids
        for k, v in lists.items():
            out[offsets[k] : offsets[k + 1]] = v
        return out, offsets

    def _solve_short(self, parts: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, id) pairs in order, all parts at once."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        text = np.frombuffer(b"".join(parts) + b"\0", dtype=np.uint8).astype(np.int32)
        start = np.r_[0, np.cumsum(lengths)][:-1]
        slot = start + np.arange(len(parts))  # a part of n bytes has n + 1 slots
        best = np.full(int(lengths.sum()) + len(parts), -np.inf)
        prior = np.zeros(len(best), dtype=np.int32)
        piece = np.full(len(best), -1, dtype=np.int32)
        best[slot] = 0.0
        order = np.argsort(-lengths, kind="stable")
        by_length = -lengths[order]
        for s in range(int(lengths.max()) if len(parts) else 0):
            live = order[: np.searchsorted(by_length, -s)]  # length > s
            live = live[best[slot[live] + s] > -np.inf]
            if not len(live):
                continue
            here = best[slot[live] + s]
            width = _WIDTHS[text[start[live] + s]]
            single = np.zeros(len(live), dtype=bool)
            at, state = np.arange(len(live)), np.zeros(len(live), dtype=np.int32)
            for d in range(LONG):
                inside = lengths[live[at]] > s + d
                at, state = at[inside], state[inside]
                t = base[state] + text[start[live[at]] + s + d]
                ok = check[t] == state
                at, state = at[ok], t[ok]
                if not len(at):
                    break
                ends = np.flatnonzero(value[state] >= 0)
                v, k = value[state[ends]], at[ends]
                single[k] |= width[k] == d + 1
                x, to = here[k] + self.scores[v], slot[live[k]] + s + d + 1
                better = x > best[to]
                best[to[better]], prior[to[better]], piece[to[better]] = x[better], s, v[better]
            k = np.flatnonzero(~single)
            x, to = here[k] + self.unknown, slot[live[k]] + s + width[k]
            better = x > best[to]
            best[to[better]], prior[to[better]], piece[to[better]] = x[better], s, -1
        part, end = np.arange(len(parts)), lengths.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(part := part[end[part] > 0]):
            e = end[part]
            v, s = piece[slot[part] + e], prior[slot[part] + e].astype(np.int64)
            got = v >= 0
            found.append((part[got], s[got], v[got]))
            for k in range(4):  # the bytes of an unknown character
                more = ~got & (s + k < e)
                found.append((part[more], s[more] + k, self.byte_ids[text[start[part[more]] + s[more] + k]]))
            end[part] = s
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        p, s, v = (np.concatenate(x) for x in zip(*found, strict=True))
        rank = np.lexsort((s, p))
        return p[rank], v[rank]

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; an empty text has none."""
        codes, which, counts = _Codes(), [], []
        for text in texts:
            found = PART.findall(" " + text) if text else []
            which += map(codes.__getitem__, found)
            counts.append(len(found))
        ids, offsets = self.solve([p.replace(" ", MARK).encode() for p in codes])
        at = np.array(which, dtype=np.int64)
        sizes = np.diff(offsets)[at]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(offsets[at] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        return flat, np.r_[0, ends][np.r_[0, np.cumsum(np.array(counts, dtype=np.int64))]]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces are joined to characters, markers become spaces, the leading space goes."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_WIDTHS = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, dtype=np.int64)


def _width(lead: int) -> int:
    return int(_WIDTHS[lead])


_LISTS: dict[int, tuple[list[int], list[int], list[int]]] = {}


def _lists(codec: Codec) -> tuple[list[int], list[int], list[int]]:
    if id(codec) not in _LISTS:
        _LISTS.clear()
        _LISTS[id(codec)] = tuple(x.tolist() for x in (codec.trie.base, codec.trie.check, codec.trie.value))
    return _LISTS[id(codec)]


def load_codec(model_file: str, zipf: bool = True) -> Codec:
    """Reads the pieces of a SentencePiece model file. zipf: its scores are ranks and become log probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)], dtype=np.float64)
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if zipf:
        ranks = -scores
        scores = -np.log(ranks + ZIPF_SHIFT) - np.log((1 / (ranks[normal] + ZIPF_SHIFT)).sum())
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
    pieces = [b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    for b, i in enumerate(byte_ids.tolist()):
        pieces[i] = bytes([b])
    keys = {model.id_to_piece(i).encode(): i for i in normal}
    mark = MARK.encode()
    if any(b"\n" in k or mark in k.lstrip(mark[:1]).removeprefix(mark[1:]) and re.search(f"[^{MARK}]{MARK}", k.decode()) for k in keys):
        raise ValueError("a piece spans a newline or a word boundary: texts can't be cut there")
    return Codec(build_double_array(keys), scores, pieces, byte_ids)


@cache
def default_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, codec: Codec, text: str = "text") -> DataFrame:
    """``docs`` with ``pieces`` (ids), ``n_pieces`` and ``decoded_ok`` (the ids decode to the text) in place of the text.

    Null and empty texts have no pieces and decode to the empty text. A text that holds the marker character itself decodes
    with a space in its place, and says so. The codec (some MB, bound by the vocabulary) is broadcast.
    """
    own = ("pieces", "n_pieces", "decoded_ok")
    rest = [c for c in docs.columns if c != text and c not in own]
    df = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for whole in batches:
            texts = whole.column("__text").to_pylist()
            for a, b in _slices(texts):
                batch = whole.slice(a, b - a)
                ids, offsets = codec.encode(texts[a:b])
                ok = [codec.decode(ids[s:e].tolist()) == t for s, e, t in zip(offsets[:-1], offsets[1:], texts[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n) for n in rest),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(offsets)),
                        pa.array(ok, type=pa.bool_()),
                    ],
                    names=[*rest, *own],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text")
    return df.mapInArrow(run, ", ".join(filter(None, [schema, "pieces array<int>, n_pieces long, decoded_ok boolean"])))


def decode_documents(encoded: DataFrame, codec: Codec, pieces: str = "pieces") -> DataFrame:
    """``encoded`` with ``text`` in place of its ids; null ids give null."""
    rest = [c for c in encoded.columns if c not in (pieces, "text")]
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column("__pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(texts, type=pa.string())], names=[*rest, "text"])

    df = encoded.select(*rest, F.col(pieces).alias("__pieces"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__pieces"] + ["text string"])
    return df.mapInArrow(run, schema)
