"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The nondeterministic machine reads a piece byte by byte. A thread is a place in the trie of all tokens (the bytes
read since the last token) with that token; where its place is a token that can follow (the merges of both together
give the two again), the thread may end it. Of all threads that end at a byte just one is right, so each byte has
one token that ends there. Sets of threads are the deterministic states, made when first reached and kept. A token
is emitted once all threads of a state come from it; none is longer than the longest token, so the lookahead is
bounded.

Defined cases: a null text is empty and gives no ids; a null id list decodes to an empty text; every row gives a
row; other columns pass through, and a column that has an output's name is replaced; an empty table gives no rows.
Bytes that aren't UTF-8 decode to replacement characters, as in a text column they must. Ids that are in no
vocabulary fail the job.
"""

import base64
import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import KEPT_IN_WORKER, bounded_batches, release, unused

#: So many chunks (about), states and pairs of tokens are kept at most; then the tables start anew.
KEPT, STATES, FOLLOWS = 150_000, 65_536, 131_072
#: After so many bytes of a piece, tokens are emitted before its end.
LOOKAHEAD = 1024
#: Bits of a token's number, and a mask of them.
TOKEN = 20
LOW = (1 << TOKEN) - 1
NO_RANK = 1 << 60
#: Texts are cut into such chunks first, and the pattern splits only those that aren't known: a word before a stop, or a
#: run of other characters, with one space before it, or white space (Unicode's, which has no separators 1C to 1F).
CHUNKS = r" ?[^\W_]++(?=[.,;:!?)\"\s]|\Z)| ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+"


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def merge(data: bytes, rank_of, below: int = NO_RANK) -> list[bytes]:
    """The tokens of some bytes, by merging the pair of least rank again and again, as long as it is under ``below``."""
    parts = [data[k : k + 1] for k in range(len(data))]
    ranks = [rank_of(data[k : k + 2], NO_RANK) for k in range(len(data) - 1)]
    while ranks and (rank := min(ranks)) < below:
        k = ranks.index(rank)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del ranks[k]
        if k < len(ranks):
            ranks[k] = rank_of(parts[k] + parts[k + 1], NO_RANK)
        if k:
            ranks[k - 1] = rank_of(parts[k - 1] + parts[k], NO_RANK)
    return parts


class _Made(dict):
    """A key to what ``make`` gives for it; made when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class Transducer:
    """Bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        # The trie: node << 8 | byte to the next node; of each node its token (or -1) and depth; 0 is the root.
        self.child: dict[int, int] = {}
        self.token, self.depth = [-1], [0]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token[node] = i
        self.inner = {key >> 8 for key in self.child}
        self.spines = _Made(lambda token: self._spine(token, 1)), _Made(lambda token: self._spine(token, 0))
        self.follows = _Made(self._follow)
        self._reset()

    def _reset(self, *kept: tuple) -> int:
        """Forgets all states but the first and ``kept``; the number of the last one."""
        #: A thread is node << TOKEN | 1 + last token; a state is a tuple of threads, oldest first.
        self.states = [(0,), *kept]
        self.state_number = {state: k for k, state in enumerate(self.states)}
        #: state << 8 | byte to (next state << 8) << TOKEN | the token that ends there.
        self.moves = _Made(self._move)
        return len(self.states) - 1

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The token and its outermost parts on one side, each with the rank at which a merge makes it (-1: a byte).

        Empty if no merges make the token, or if they don't make it from parts of lower ranks.
        """
        spine, part, rank_of = [], self.bytes_of[token], self.ranks.get
        while len(part) > 1:
            rank = rank_of(part, NO_RANK)
            two = merge(part, rank_of, rank)
            if len(two) != 2:
                return []
            spine.append((part, rank))
            part = two[side]
        return [*spine, (part, -1)]

    def _follow(self, key: int) -> bool:
        """Whether the merges by rank make just these two tokens of their bytes.

        Before a merge at some rank, the parts at the border are those of the two spines that lower ranks have made.
        They merge across it if their own rank comes before either part's next merge; of equal ones the left goes first.
        """
        last, token = (key >> TOKEN) - 1, key & LOW
        if len(self.follows) >= FOLLOWS:
            self.follows.clear()
        right = self.spines[1][token]
        if last < 0:
            return bool(right)
        left = self.spines[0][last]
        if not left or not right:
            two = self.bytes_of[last], self.bytes_of[token]
            return merge(two[0] + two[1], self.ranks.get) == list(two)
        rank_of, i, j, left_ends, right_ends = self.ranks.get, 0, 0, NO_RANK, NO_RANK
        while True:
            a, made_a = left[i]
            b, made_b = right[j]
            rank = rank_of(a + b, NO_RANK)
            if rank < left_ends and rank <= right_ends and rank < NO_RANK:
                return False
            if made_a < 0 and made_b < 0:
                return True
            # Back in time to the later one of the merges that made the two.
            if made_a > made_b:
                left_ends, i = made_a, i + 1
            elif made_b > made_a:
                right_ends, j = made_b, j + 1
            else:
                right_ends, j = made_b, j + 1

    def _move(self, key: int) -> int:
        threads, ended, child, token_of, follows = [], -1, self.child.get, self.token, self.follows
        byte = key & 255
        for thread in self.states[key >> 8]:
            node = child(thread >> TOKEN << 8 | byte)
            if node is None:
                continue
            last = thread & LOW
            if ended < 0 <= (token := token_of[node]) and follows[last << TOKEN | token]:
                ended = token
            if node in self.inner:
                threads.append(node << TOKEN | last)
        if ended < 0:
            raise ValueError("the vocabulary lacks a byte")
        threads.append(ended + 1)
        state = tuple(threads)
        to = self.state_number.get(state)
        if to is None:
            to = self.state_number[state] = len(self.states)
            self.states.append(state)
        return to << 8 << TOKEN | ended

    def _end(self, state: int, byte: int) -> int:
        """The token that ends at a piece's last byte; the state after it isn't needed, so none is made."""
        if (move := self.moves.get(state | byte)) is not None:
            return move & LOW
        child, token_of, follows = self.child.get, self.token, self.follows
        for thread in self.states[state >> 8]:
            node = child(thread >> TOKEN << 8 | byte)
            if node is not None and (token := token_of[node]) >= 0 and follows[(thread & LOW) << TOKEN | token]:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _emit(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, from the tokens that end at each byte."""
        out, size = [], self.size
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def _agreed(self, ends: list[int], state: int) -> int:
        """The last place where all threads of a state have a token's end."""
        common = None
        for thread in self.states[state >> 8]:
            at = len(ends) - self.depth[thread >> TOKEN]
            places = {at}
            while at > 0:
                at -= self.size[ends[at - 1]]
                places.add(at)
            common = places if common is None else common & places
        return max(common)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece. Of long ones, what all threads agree on is emitted on the way."""
        out: list[int] = []
        ends: list[int] = []
        state, moves = 0, self.moves
        for k, byte in enumerate(piece[:-1], 1):
            move = moves[state | byte]
            state = move >> TOKEN
            ends.append(move & LOW)
            if not k % LOOKAHEAD:
                agreed = self._agreed(ends, state)
                out += self._emit(ends, agreed)
                del ends[:agreed]
                if len(self.states) > STATES:
                    state = self._reset(self.states[state >> 8]) << 8
                    moves = self.moves
        for byte in piece[-1:]:
            ends.append(self._end(state, byte))
        return out + self._emit(ends, len(ends))

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each piece; where a piece begins as the one before it, the machine goes on from there."""
        ranks, size, low = self.ranks, self.size, LOW
        path, ends, before = [0], [], b""
        for piece in pieces:
            if (whole := ranks.get(piece)) is not None:
                yield [whole]
                continue
            if len(self.states) > STATES:
                self._reset()
                path, ends, before = [0], [], b""
            if len(piece) > LOOKAHEAD:
                yield self.encode(piece)
                path, ends, before = [0], [], b""
                continue
            moves, last, k = self.moves, len(piece) - 1, 0
            same = min(len(ends), last)
            while k < same and before[k] == piece[k]:
                k += 1
            del path[k + 1 :], ends[k:]
            state = path[k]
            for byte in piece[k:last]:
                move = moves[state | byte]
                state = move >> TOKEN
                path.append(state)
                ends.append(move & low)
            token = self._end(state, piece[last])
            out, at = [token], last + 1 - size[token]
            while at > 0:
                token = ends[at - 1]
                out.append(token)
                at -= size[token]
            out.reverse()
            yield out
            before = piece


class _Chunks:
    """Ids of whole texts. Ids of chunks are kept in two generations: a full one starts anew, the last one is looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunks: str):
        self.machine, self.split, self.cut = Transducer(ranks), regex.compile(pattern).findall, re.compile(chunks).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        young, old = self.young, self.old
        for chunk in chunks & old.keys():
            young[chunk] = old[chunk]
        parts = {chunk: self.split(chunk) for chunk in chunks - old.keys()}
        pieces = {p: p.encode() for p in set(chain.from_iterable(parts.values())) if p not in young}
        order = sorted(pieces, key=pieces.__getitem__)
        own = dict(zip(order, (array("i", x).tobytes() for x in self.machine.encode_sorted([pieces[p] for p in order])), strict=True))
        for chunk, of in parts.items():
            young[chunk] = b"".join([own[p] if p in own else young[p] for p in of])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids as bytes of int32."""
        cut = [self.cut(t) if t else () for t in texts]
        if len(self.young) > KEPT:
            self.young, self.old = {}, self.young
        missing = set(chain.from_iterable(cut)).difference(self.young)
        long = {chunk for chunk in missing if len(chunk) > 64}
        self._learn(missing)
        out = [b"".join(map(self.young.__getitem__, c)) for c in cut]
        for chunk in long:
            del self.young[chunk]
        return out


_loaded: dict[tuple, object] = KEPT_IN_WORKER.setdefault("byte_bpe", {})


def _once(key: tuple, make):
    """A worker keeps the last vocabulary that it has read."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]


def _chunks(content: bytes, pattern: str, chunks: str) -> _Chunks:
    return _once(("encode", hash(content), pattern, chunks), lambda: _Chunks(read_ranks(content), pattern, chunks))


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ids(texts: pa.Array, chunks: _Chunks) -> pa.ListArray:
    flat = chunks.ids(texts.to_pylist())
    offsets = np.cumsum([0, *[len(x) // 4 for x in flat]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), np.int32)))


def _texts(ids: pa.ListArray, token, step: int) -> pa.Array:
    texts = []
    for row in ids:
        row = row.values.to_numpy() if row.is_valid else np.empty(0, np.int32)
        reader = codecs.getincrementaldecoder("utf-8")(errors="replace")
        parts = [reader.decode(b"".join(map(token, row[k : k + step].tolist()))) for k in range(0, len(row), step)]
        texts.append("".join(parts) + reader.decode(b"", final=True))
    return pa.array(texts, pa.string())


def _prepared(docs: DataFrame, ranks_path: str):
    bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(_load(ranks_path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", chunk_pattern: str = CHUNKS) -> DataFrame:
    """``docs`` with ids: array<int>. ``ranks_path`` is read by the driver, and the vocabulary is broadcast.

    No match of ``pattern`` may go beyond a chunk, and each must be one in a text of its own, too.
    """
    content = _prepared(docs, ranks_path)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = _chunks(content.value, pattern, chunk_pattern)
        for texts in batches:
            yield _ids(texts, chunks)
            release("byte_bpe")

    return docs.withColumn(ids_col, run(text_col))


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", text_col: str = "decoded", step: int = 8192) -> DataFrame:
    """``docs`` with the text of its ids, ``step`` of them at a time; the UTF-8 machine carries split characters over."""
    content = _prepared(docs, ranks_path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = _once(("decode", hash(content.value)), lambda: {i: t for t, i in read_ranks(content.value).items()}).__getitem__
        for ids in batches:
            yield _texts(ids, token, step)
            release("byte_bpe")

    return docs.withColumn(text_col, run(ids_col))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", step: int = 8192, chunk_pattern: str = CHUNKS) -> DataFrame:
    """``docs`` with what ``encode`` gives of its texts and ``decode`` of those ids, in one pass through one worker."""
    content = _prepared(docs, ranks_path)

    @F.arrow_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = _chunks(content.value, pattern, chunk_pattern)
        for texts in batches:
            ids = _ids(texts, chunks)
            yield pa.StructArray.from_arrays([ids, _texts(ids, chunks.machine.bytes_of.__getitem__, step)], names=["ids", "decoded"])
            release("byte_bpe")

    both = unused("both", docs)
    names = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    return docs.withColumn(both, run(text_col)).select(*names, F.col(both)["ids"].alias(ids_col), F.col(both)["decoded"].alias(decoded_col))
