"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. Two tokens are compatible if BPE leaves their concatenation as these two; a chain of tokens of which each is
compatible with the one before it is the BPE result of its text, and a text has one such chain. The transducer walks
along compatible tokens, longest first, and steps back from an end that no token follows (that end stays dead, as one
chain only leads there). ``lookahead`` is computed from the merge list: no merge across a place depends on a symbol
further to its right than that. So a token is stable, and is emitted and forgotten, once the walk is so many symbols
beyond it; symbols are read ``max_len`` ahead of the walk, and memory stays below three times the lookahead however long the
input is. Pre-tokens of every length take this way.

Decoding. ``Decoder`` is a state machine from ids to text that emits what is certain: in "pieces" mode (a tokenizer
file without decoder) token strings parted by single spaces, where the state is whether a piece has come; in "bytes" mode
the UTF-8 bytes behind the byte-level alphabet, where an unfinished character waits in the state. ``run`` walks the first
machine over many texts at once, by its table of outputs.

Null and empty texts have no ids and decode to the empty string. Rows are independent: repeated rows, ties and extra
columns pass through. Kept columns must not be named like a made one (n_tokens, ids, ids_sha256, decoded, decoded_sha256);
such a name raises a ValueError.

A worker's caches are bounded in bytes and dropped at the end of its task.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from docassay.llm._common import Recent, expand, released, slices, words_of

#: Bytes, about, of a worker's caches of pre-tokens and of other white-space-parted chunks; entries of its table of compatible tokens.
WORDS, CHUNKS, PAIRS = 40_000_000, 12_000_000, 150_000
#: Bytes of text that a worker encodes at a time.
SLICE = 2_000_000
END = "\0"  # the end of a pre-token; a control character is never a byte-level letter


@functools.cache
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Transducer:
    """Streaming BPE over symbols that are single characters; the last of a pre-token carries END."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        def key(s: str) -> str:
            return s.removesuffix(suffix) + END if suffix and s.endswith(suffix) and len(s) > len(suffix) else s

        self.vocab = {key(s): i for s, i in vocab.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for k, (a, b) in enumerate(merges):
            self.ranks[key(a), key(b)] = k
        self.max_len = max((len(s.removesuffix(END)) for pair in self.ranks for s in ["".join(pair)]), default=1)
        self.lookahead = self._lookahead()
        self.names = {i: s for s, i in self.vocab.items()}
        self._reach: dict[str, int] = {}  # longest token by its first three letters
        for x in self.vocab:
            letters = x.removesuffix(END)
            self._reach[letters[:3]] = max(self._reach.get(letters[:3], 3), len(letters))
        self._known: dict[int, bool] = {}

    def _lookahead(self) -> int:
        """Symbols to the right of a place that can decide, at most, whether a merge joins there.

        A merge (a, b) joins at a place if b stands there on its right. That takes the symbols of b, and that no merge
        of earlier rank joins b, or one of the tokens at b's right edge from which b was made, to what follows; such a
        merge in turn depends on as many symbols as it does itself. Ranks fall along such a chain, so it ends.
        """
        best: dict[str, int] = {}  # by left token, of the merges of earlier rank
        edge: dict[str, set[str]] = {}  # right parts from which a token is made
        most = 0
        for a, b in self.ranks:
            reach, todo, seen = 0, [b], {b}
            while todo:
                s = todo.pop()
                reach = max(reach, best.get(s, 0))
                new = edge.get(s, set()) - seen
                seen |= new
                todo += new
            reach += len(b.removesuffix(END))
            best[a] = max(best.get(a, 0), reach)
            edge.setdefault(a + b, set()).add(b)
            most = max(most, reach)
        return most

    def merge_all(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the adjacent pair of least rank, the leftmost first, until none is left."""
        s = list(symbols)
        while len(s) > 1:
            rank, at = min((self.ranks.get((s[k], s[k + 1]), 1 << 60), k) for k in range(len(s) - 1))
            if rank == 1 << 60:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    @staticmethod
    def _symbols(piece: str) -> list[str]:
        return [*piece[:-2], piece[-2:]] if piece.endswith(END) else [*piece]

    def follows(self, before: int, i: int) -> bool:
        """Whether token i may follow token before - 1, or stand first for 0: BPE leaves the two as they are."""
        if len(self._known) >= PAIRS:
            self._known.clear()
        right = self.names[i]
        left = [self.names[before - 1]] if before else []
        ok = self._known[before << 32 | i] = self.merge_all([*"".join(left), *self._symbols(right)]) == [*left, right]
        return ok

    def release(self) -> None:
        self._known.clear()

    def stream(self, blocks: Iterable[str]) -> Iterator[int]:
        """Ids of one pre-token, given as blocks of letters of which the last ends with END, each as soon as the walk is
        ``lookahead`` symbols beyond it."""
        blocks, ended = iter(blocks), False
        window, size, pos = "", 0, 0  # what was read and not yet emitted, its symbols, where the walk stands
        head = before = 0  # one more than the last id that was emitted, and that the walk took; 0 at the start
        ids: list[int] = []
        at: list[int] = []
        dead: set[int] = set()
        known, find, reach, most, full = self._known, self.vocab.get, self._reach, self.max_len, 2 * self.lookahead
        while True:
            while not ended and size - pos < most:
                block = next(blocks, None)
                if block is None:
                    ended = True
                else:
                    window += block
                    ended = block[-1:] == END
                    size = len(window) - ended
            if pos >= size:
                break
            for end in range(min(size, pos + reach.get(window[pos : pos + 3], 3)), pos, -1):
                if end in dead:
                    continue
                i = find(window[pos:end] if end < size else window[pos:])
                if i is not None and ((ok := known.get(before << 32 | i)) or (ok is None and self.follows(before, i))):
                    ids.append(i)
                    at.append(pos)
                    pos, before = end, i + 1
                    break
            else:
                if not ids:
                    raise ValueError(f"the vocabulary lacks a symbol of {window[pos : pos + most]!r}")
                dead.add(pos)
                ids.pop()
                pos = at.pop()
                before = ids[-1] + 1 if ids else head
            if pos >= full:
                k = bisect.bisect_right(at, pos - self.lookahead) - 1  # tokens that end where a stable place begins the next
                if k > 0:
                    yield from ids[:k]
                    gone, head = at[k], ids[k - 1] + 1
                    window, size, pos = window[gone:], size - gone, pos - gone
                    ids, at, dead = ids[k:], [x - gone for x in at[k:]], {x - gone for x in dead if x > gone}
        yield from ids


class Tokenizer:
    """The parts of a tokenizer file around its merge list: special tokens, normaliser, pre-tokeniser, transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or first["type"] != "Split" or second["type"] != "ByteLevel" or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("this tokenizer file has parts that are not supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.pattern = regex.compile(first["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces = [""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for s, i in {**model["vocab"], **self.special}.items():
            self.pieces[i] = s
        self.letters = byte_letters()
        self.latin = str.maketrans({chr(c): "".join(self.letters[b] for b in chr(c).encode()) for c in range(0x250)})
        self.words, self.chunks = Recent(WORDS), Recent(CHUNKS)

    def release(self) -> None:
        """Forget what was cached."""
        self.words.clear()
        self.chunks.clear()
        self.transducer.release()

    def _word(self, s: str) -> bytes:
        """Ids, as 32-bit integers, of one pre-token."""
        if (out := self.words.get(s)) is None:
            letters = s.translate(self.latin) if s.isascii() else "".join(self.letters[b] for b in s.encode("utf-8", "replace"))
            out = self.words.put(s, array("I", self.transducer.stream((letters + END,))).tobytes())
        return out

    def _span(self, text: str) -> bytes:
        text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
        return b"".join(self._word(m.group()) for m in self.pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        """Ids, as 32-bit integers, of a text."""
        return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else self._span(part) for part in self.special_at.split(text) if part)

    def chunk(self, chunk: str) -> bytes:
        """Ids of text without ASCII white space; no pre-token crosses such white space."""
        body = chunk[:-1] if chunk[-1:] in (".", ",") else chunk
        if body.isalpha() and max(body) < "\u0250" and "\u0130" not in body:  # letters that NFC leaves alone: one pre-token
            return self._word(body.lower()) if body is chunk else self._word(body.lower()) + self._word(chunk[-1])
        if (out := self.chunks.get(chunk)) is None:
            out = self.chunks.put(chunk, self.encode(chunk))
        return out


class Decoder:
    """Incremental decoding. ``pieces``: the file has no decoder, so token strings are parted by one space;
    ``bytes``: byte-level letters become bytes, and bytes become characters when complete."""

    def __init__(self, pieces: list[str], mode: str = "pieces", suffix: str = "</w>"):
        self.pieces, self.mode, self.suffix = pieces, mode, suffix
        self.bytes = {c: b for b, c in byte_letters().items()}
        self.table: pa.Array | None = None
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = 0

    def output(self, begun: int, token: int) -> str:
        """What a piece emits, by whether one has come before; nothing, for an unknown id."""
        piece = self.pieces[token] if 0 <= token < len(self.pieces) else ""
        return " " + piece if begun and piece else piece

    def feed(self, token: int) -> str:
        if self.mode == "pieces":
            out = self.output(self.begun, token)
            self.begun |= bool(out)
            return out
        piece = self.pieces[token] if 0 <= token < len(self.pieces) else ""
        ended = piece.endswith(self.suffix) and len(piece) > len(self.suffix)
        body = piece.removesuffix(self.suffix) if ended else piece
        out = self.state.decode(bytes(self.bytes.get(c, 0x3F) for c in body))
        return out + (self.state.decode(b"", True) + " " if ended else "")

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.reset()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join([*(self.feed(int(i)) for i in ids), self.finish()])

    def run(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of many id sequences, each from the start state. The machine of "pieces" has two states, so its
        outputs are a table by state and id, and the state before an id is whether an id with a piece precedes it."""
        if self.mode != "pieces":
            return pa.array([self.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.large_string())
        n = len(self.pieces)
        if self.table is None:
            self.table = pa.array([self.output(state, k) for state in (0, 1) for k in range(n)], pa.large_string())
            self.shown = np.array([bool(x) for x in self.pieces])
        shown = self.shown[ids]
        before = np.cumsum(shown) - shown
        begun = before > np.repeat(np.r_[before, 0][offsets[:-1]], np.diff(offsets))
        out = self.table.take(pa.array(ids.astype(np.int64) + n * begun))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, type=pa.int64()), out), pa.scalar("", pa.large_string()))


def ids_of(texts: pa.Array, chunk) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, first id of each text and the total); chunk gives the ids of a white-space-parted piece as bytes."""
    codes, words, offsets = words_of(texts)
    encoded = [chunk(w) for w in words.to_pylist()]
    counts = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
    flat = np.frombuffer(b"".join(encoded), dtype="<u4")
    starts = np.cumsum(counts) - counts
    per_word = counts[codes]
    ends = np.r_[0, np.cumsum(per_word)]
    return flat[expand(starts[codes], per_word)], ends[offsets]


@functools.cache
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, ids (array of long) and decoded text."""
    return _run(docs, path, text, keep, digest=False)


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256 and decoded_sha256."""
    return _run(docs, path, text, keep, digest=True)


def tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, ids (array of int) and decoded_sha256."""
    return _run(docs, path, text, keep, digest=None)


def _run(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], digest: bool | None) -> DataFrame:
    made = "n_tokens bigint, ids array<int>, decoded_sha256 string" if digest is None else "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens bigint, ids array<bigint>, decoded string"
    clash = {"n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"} & {*keep}
    if clash:
        raise ValueError(f"kept columns have names of made ones: {sorted(clash)}")
    chosen = docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("text_of_row"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches):
        tokenizer = load(path)
        decoder = Decoder(tokenizer.pieces)
        for whole in batches:
            for batch in slices(whole, "text_of_row", SLICE):
                ids, offsets = ids_of(batch.column(len(keep)), tokenizer.chunk)
                decoded = decoder.run(ids, offsets)
                kept = [batch.column(k) for k in range(len(keep))]
                n = pa.array(np.diff(offsets))
                if digest is not False:
                    raw, text_raw, at = memoryview(ids.astype("<u4")).cast("B"), memoryview(decoded.buffers()[2] or b""), np.frombuffer(decoded.buffers()[1], dtype=np.int64)[decoded.offset :]
                    second = pa.array([hashlib.sha256(text_raw[at[k] : at[k + 1]]).hexdigest() for k in range(len(decoded))], pa.string())
                else:
                    second = decoded.cast(pa.string())
                if digest:
                    first = pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())
                else:
                    first = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(ids.astype(np.int32 if digest is None else np.int64)))
                yield pa.RecordBatch.from_arrays([*kept, n, first, second], names=[*keep, "n_tokens", "ids_sha256" if digest else "ids", "decoded" if digest is False else "decoded_sha256"])
        tokenizer.release()
        load.cache_clear()  # a worker lives on for other operators

    return chosen.mapInArrow(released(run), f"{kinds}, {made}" if kinds else made)
