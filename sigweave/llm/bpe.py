"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The tokens of a prefix followed by one token are the tokens of the longer prefix,
for exactly one last token: the one that follows the token before it in the
encoding of just the two. So bytes are read one at a time, and a state holds the
places where a token that spans the present place may start. From the merge list a
sufficient lookahead is computed: so many bytes behind its end a token can't change
any more. It is emitted then, or before, once all places agree on it, so what is
pending is bounded, whatever the text. Transitions between states are made when
first met and kept, so most bytes cost one lookup. Pieces that are no longer than the
lookahead wait for nothing and are mostly new where they aren't known as a whole: their
places go on side by side, and no state is made of them.
"""

from __future__ import annotations

import bisect
import codecs
import gc
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.shared import bounded_batches

#: Fixed: the pattern by which byte-level BPE files of this kind split a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, states and token pairs that a worker keeps; beyond, it starts anew.
KEPT_PIECES, KEPT_STATES, KEPT_PAIRS = 400_000, 40_000, 400_000
#: Bytes up to which a piece makes no states.
SHORT = 64
#: Characters and ids that are in work at a time.
WORK = 1 << 16


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a vocabulary file, as the inverse map."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Shared by all tokens that no longer one begins with.
NOWHERE: dict = {}


class State(dict):
    """The places where a token that spans the present place may start; as a map, byte to (ids now certain, next state).

    Each place is (bytes since it, token before it, tokens between the last firm
    boundary and it); the last one is the present place itself.
    """

    __slots__ = ("places", "machine")

    def __init__(self, places: tuple[tuple[bytes, int | None, tuple[int, ...]], ...], machine: Transducer) -> None:
        super().__init__()
        self.places, self.machine = places, machine

    @property
    def rest(self) -> bytes:
        return packed(self.places[-1][2])

    def __missing__(self, byte: int) -> tuple[bytes, State]:
        return self.machine.step(self, byte)


def packed(ids: tuple[int, ...]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


class Transducer:
    """Encodes the bytes of one piece at a time."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]) -> None:
        self.rank = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
        self.made = {ids[a + b]: (k, ids[a], ids[b]) for k, (a, b) in enumerate(merges)}
        # tokens whose own bytes encode as something else never occur
        good = {i for t, i in ids.items() if i not in self.made}
        for (a, b), k in self.rank.items():
            if a in good and b in good and self.beside(a, b, k):
                good.add(ids[merges[k][0] + merges[k][1]])
        self.ids = {t: i for t, i in ids.items() if i in good}
        self.longest = max(map(len, self.ids))
        self.starts = {t[:k] for t in self.ids for k in range(1, len(t))}
        # by bytes from a place on: the token that ends there, if any, and where the next byte leads
        self.tree: dict[int, tuple[int | None, dict]] = {}
        for token, i in self.ids.items():
            node = self.tree
            for k, byte in enumerate(token, 1):
                known, below = node.get(byte, (None, NOWHERE))
                if k < len(token) and below is NOWHERE:
                    below = {}
                node[byte] = (i if k == len(token) else known, below)
                node = below
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.root = State(((b"", None, ()),), self)
        self.sizes = {i: len(t) for t, i in ids.items()}
        self.lookahead = self.sufficient_lookahead()

    def sufficient_lookahead(self) -> int:
        """Bytes behind a token after which nothing can change it.

        A token is kept from being made, or from staying, by a merge of its right end
        with what follows it, and only by one of a lower rank than the merge that would
        use this end. Whether that merge takes place depends in the same way on what
        follows its right part, again by lower ranks. So in the order of ranks each
        merge's reach is its right part's size and the farthest reach of the merges that
        can keep this part from it.
        """
        reaches: dict[int, tuple[list[int], list[int]]] = {}  # left part: ranks, and the farthest reach up to each

        def beyond(token: int, bound: int) -> int:
            """The farthest reach of what can keep `token`, or what it is made of at its right end, from a merge of rank `bound`."""
            far = 0
            while True:
                if token in reaches:
                    ranks, most = reaches[token]
                    k = bisect.bisect_left(ranks, bound)
                    far = max(far, most[k - 1] if k else 0)
                if token not in self.made:
                    return far
                bound, _, token = self.made[token]

        for (a, b), k in self.rank.items():
            ranks, most = reaches.setdefault(a, ([], []))
            ranks.append(k)
            most.append(max(self.sizes[b] + beyond(b, k), most[-1] if most else 0))
        return max([beyond(t, len(self.rank)) for t in self.sizes], default=0)

    def beside(self, left: int, right: int, bound: int) -> bool:
        """Whether two tokens' bytes, one after the other, are just these tokens when all merges of lower rank than `bound` are made.

        Undoes the merges next to their border, the latest first. If the parts beside
        it could have merged before the merge just undone, they would have.
        """
        while True:
            if self.rank.get((left, right), bound) < bound:
                return False
            a, b = self.made.get(left, (-1, 0, 0)), self.made.get(right, (-1, 0, 0))
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                bound, left = a[0], a[2]
            else:  # of equal merges the left one comes first
                bound, right = b[0] + 1, b[1]

    def follows(self, one: int, two: int) -> bool:
        """Whether the two tokens' bytes together encode as just these tokens."""
        if (known := self.pairs.get(one << 32 | two)) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[one << 32 | two] = self.beside(one, two, len(self.rank))
        return known

    def step(self, state: State, byte: int) -> tuple[bytes, State]:
        """The transition of a state by a byte: ids that are now certain, and the next state."""
        one, places, last = bytes((byte,)), [], None
        for since, before, chain in state.places:
            since += one
            if last is None and (token := self.ids.get(since)) is not None and (before is None or self.follows(before, token)):
                last = (b"", token, (*chain, token))
            if since in self.starts:
                places.append((since, before, chain))
        places.append(last)
        # tokens that all places have in common are certain
        firm, chain = 0, places[0][2]
        for firm in range(min(len(p[2]) for p in places) + 1):  # noqa: B007
            if any(len(p[2]) == firm or p[2][firm] != chain[firm] for p in places):
                break
        # so are those that end farther back than the lookahead, by its definition; the machine stops if the places differ on one
        pending = chain[firm:]
        if len(pending) > 1 and sum(map(self.sizes.__getitem__, pending)) - self.sizes[pending[-1]] > self.lookahead + self.longest:
            raise AssertionError("a token behind the sufficient lookahead isn't certain")
        key = tuple([(since, before, tokens[firm:]) for since, before, tokens in places])
        following = self.states.get(key)
        if following is None:
            if len(self.states) >= KEPT_STATES:
                self.states.clear()
                self.root = State(self.root.places, self)
                state = State(state.places, self)  # its old transitions go too
            following = self.states[key] = State(key, self)
        sure = packed(chain[:firm])
        state[byte] = (sure, following)
        return sure, following

    def stream(self, parts: Iterator[bytes]) -> Iterator[bytes]:
        """Ids of a piece that comes in parts, as soon as they are certain; a part's ids are held at most."""
        state = self.root
        for part in parts:
            out = []
            for byte in part:
                sure, state = state[byte]
                if sure:
                    out.append(sure)
            yield b"".join(out)
        yield state.rest

    def encode(self, piece: bytes) -> bytes:
        if len(piece) <= min(SHORT, self.lookahead + self.longest):
            return self.short(piece)
        return b"".join(self.stream(iter((piece,))))

    def short(self, piece: bytes) -> bytes:
        """Ids of a piece within the lookahead, of which none has to be certain before its end: from each place on go the tokens that may start there."""
        n, pairs, follows = len(piece), self.pairs, self.follows
        if (whole := self.ids.get(piece)) is not None:  # tokens are kept if their own bytes encode as themselves
            return whole.to_bytes(4, "little")
        last: list[int | None] = [None] * (n + 1)  # the token that ends at each place, if no more bytes follow
        begun = [0] * (n + 1)
        for at in range(n):
            before, node, end = last[at], self.tree, at
            for byte in piece[at:]:
                if (hit := node.get(byte)) is None:
                    break
                end += 1
                token, node = hit
                if token is None or last[end] is not None:
                    continue
                if at:
                    known = pairs.get(before << 32 | token)
                    if not (follows(before, token) if known is None else known):
                        continue
                last[end], begun[end] = token, at
        ids = []
        while n:
            ids.append(last[n])
            n = begun[n]
        return packed(tuple(ids[::-1]))


class Pieces(dict):
    """Ids of the pieces met lately: those met since it was last half full, and those of before that were met again."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= 32:
            if len(self) >= KEPT_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """A byte-level BPE of a public vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        of = byte_chars()
        added = {x["content"]: x["id"] for x in said["added_tokens"]}
        raw = lambda t: bytes(of[c] for c in t)
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in said["model"]["merges"]]
        ids = {raw(t): i for t, i in said["model"]["vocab"].items() if t not in added}
        self.pieces = Pieces(Transducer(merges, ids))
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in added.items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.split, self.gap = regex.compile(PIECES), regex.compile(r"(?<=\S) (?=\S)")
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """Ids of a text, part by part; some WORK characters are in work, also within a long piece."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._encode_plain(text, at, m.start())
            yield self.added[m.group()]
            at = m.end()
        yield from self._encode_plain(text, at, len(text))

    def _encode_plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        get = self.pieces.__getitem__
        while end - at > WORK:
            # a single space between two other characters always starts a piece
            cut = self.gap.search(text, at + WORK, min(end, at + 2 * WORK))
            if cut:
                yield b"".join(map(get, self.split.findall(text[at : cut.start()])))
                at = cut.start()
                continue
            # without one, pieces are taken one by one
            held, begun = [], at
            for m in self.split.finditer(text, at, end):
                at = m.end()
                if at - m.start() > WORK:
                    yield b"".join(held)
                    held = []
                    yield from self.pieces.transducer.stream(text[k : min(k + WORK, at)].encode() for k in range(m.start(), at, WORK))
                else:
                    held.append(get(m.group()))
                if at - begun > WORK:
                    break
            yield b"".join(held)
        yield b"".join(map(get, self.split.findall(text[at:end])))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_stream(text)), "<u4")

    def decode_stream(self, parts: Iterator[np.ndarray]) -> Iterator[str]:
        """Text of ids that come in parts: bytes that don't complete a character wait for the next part."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for ids in parts:
            for at in range(0, len(ids), WORK):
                yield machine.decode(b"".join(map(get, ids[at : at + WORK].tolist())))
        yield machine.decode(b"", True)

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.decode_stream(iter((ids,))))


    def forget(self) -> None:
        """Drops what was kept of the texts met; the vocabulary stays."""
        machine = self.pieces.transducer
        self.pieces.clear()
        self.pieces.older.clear()
        machine.pairs.clear()
        for state in machine.states.values():
            state.clear()
        machine.states.clear()
        machine.root = State(machine.root.places, machine)
        gc.collect()  # states refer to each other


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The BPE of a file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, key: str = "doc_id", decode: bool = False) -> DataFrame:
    """Columns key, n_tokens and ids (little-endian unsigned 32-bit integers), and decoded if asked for: one row for each row of `docs` (key, text).

    A null text counts as empty: it has no token. Keys may be null or repeated. The
    file at `path` must be there on each executor. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        try:
            for batch in batches:
                yield encoded_batch(bpe, batch)
        finally:
            bpe.forget()  # the worker may next serve a stage that needs its memory

    def encoded_batch(bpe: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        found, said = [], []
        for text in batch.column(1).to_pylist():
            parts: list[bytes] = []
            if decode:  # each part is decoded as it comes
                said.append("".join(bpe.decode_stream(np.frombuffer(parts[-1], "<u4") for x in bpe.encode_stream(text or "") if not parts.append(x))))
            else:
                parts += bpe.encode_stream(text or "")
            found.append(b"".join(parts))
        columns = {key: batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()), "ids": pa.array(found, pa.binary())}
        if decode:
            columns["decoded"] = pa.array(said, pa.string())
        return pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(made, f"{key} long, n_tokens long, ids binary" + ", decoded string" * decode)


def decoded(tokens: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Columns key and decoded, the text of each row's ids; null ids give an empty text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "decoded": pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()], pa.string())})

    return tokens.select(key, "ids").mapInArrow(made, f"{key} long, decoded string")
