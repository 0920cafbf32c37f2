"""Byte-level BPE as a transducer: encoding by a lazily determinised machine, decoding as a stream.

The machine reads bytes. A text's encoding ends in the one token that (a) is a suffix of the text and (b) stands
after the encoding of what precedes it without a merge across the two. So a state is the longest suffix of the text
that begins some token, with the last token before each of its suffixes that begins one too; a step gives the last
token of the text so far. States and steps are made when first needed.

Last tokens lead back from any position to the tokens before it. Once the ways back from all positions of a state
meet, which they do after a lookahead bounded by the longest token, what lies before the meeting point is certain
and given out; at the end of a piece the way back from there gives the rest.

Nulls and empty texts encode to no token; ids that no token has decode to U+FFFD. Rows are independent: repeated
rows and ties need no rule, an empty table stays empty, and an input column named like a result is replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.llm.common import Memo, add_columns, blocks, held, list_array, pieces, ranks, vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bounds of a worker's memory: states of the machine, and pieces whose ids are remembered (half a kilobyte each and a
#: quarter of one). Smaller ones cost time, not results.
MOST_STATES, MOST_PIECES = 240_000, 200_000
NEVER = 1 << 31
#: Bytes of a piece from which on tokens are given out before its end.
LOOKAHEAD = 1024


class _Steps(dict):
    """Known steps: state and byte to the next state; others are made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: int) -> int:
        return self.make(key)


class Transducer:
    """Encodes pieces by the merges that ``ranks`` (token bytes to rank) imply.

    States are numbers. What a state stands for is a tuple of integers, one for each suffix of the text that begins a
    longer token, the longest first: the suffix's node in the trie of tokens, and 1 + the rank of the last token before it.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES, most_pieces: int = MOST_PIECES):
        self.ranks, self.most_states = ranks, most_states
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t or b"") for t in self.tokens]
        self.shift = len(self.tokens).bit_length()
        #: The trie: node and byte to the next node; of each node its depth and 1 + the rank of its token (0: none).
        self.child: dict[int, int] = {}
        self.depth, self.whole = [0], [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                following = self.child.get(key)
                if following is None:
                    following = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.whole.append(0)
                node = following
            self.whole[node] = rank + 1
        #: Nodes from which a longer token goes on.
        self.open = bytearray(len(self.depth))
        for key in self.child:
            self.open[key >> 8] = 1
        #: Pairs that merge, with their rank, and the tokens that begin, and that end, such a pair.
        self.pairs: dict[int, int] = {}
        self.lefts, self.rights = set(), set()
        for token, rank in ranks.items():
            for n in range(1, len(token)):
                left, right = ranks.get(token[:n]), ranks.get(token[n:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
                    self.lefts.add(left)
                    self.rights.add(right)
        self._edges: dict[bytes, tuple[list, list] | None] = {}
        self._seams: dict[int, tuple[list, list] | None] = {}
        self._forget()
        self.memo = Memo(self._encode_piece, most_pieces)

    def _forget(self, kept: tuple[int, ...] = (0,)) -> None:
        """Drop all states but the one at the beginning, and one more that is kept as number 1."""
        self.steps = _Steps(self._step)
        self.side_by_side: dict[int, bool] = {}
        self.live: list[tuple[int, ...]] = [(0,)]
        #: The last token's rank of each state.
        self.last = [NEVER]
        self.states: dict[tuple[int, ...], int] = {}
        if kept != (0,):
            self._state(kept)

    def _state(self, live: tuple[int, ...]) -> int:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = len(self.live)
            self.live.append(live)
            self.last.append(live[-1] - 1)
        return found

    def merge(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The merges carried out one by one, lowest rank first, and the last pair merged; for single tokens only."""
        parts, last = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == NEVER:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def edges(self, token: bytes) -> tuple[list, list] | None:
        """The parts that stand at the left and at the right edge of a token while it is merged, the token first.

        Each comes with the rank at which it is merged further. None if the merges do not lead to the token.
        """
        if token not in self._edges:
            parts, last = self.merge(token)
            if len(parts) > 1:
                self._edges[token] = None
            elif last is None:
                self._edges[token] = [(token, NEVER)], [(token, NEVER)]
            else:
                rank, (left, right) = self.ranks[token], last
                self._edges[token] = (
                    [(token, NEVER), *((p, min(r, rank)) for p, r in self.edges(left)[0])],
                    [(token, NEVER), *((p, min(r, rank)) for p, r in self.edges(right)[1])],
                )
        return self._edges[token]

    def seam(self, rank: int) -> tuple[list, list] | None:
        """The edge parts (as ranks) of a token that merge with anything beyond it at all; None as for ``edges``."""
        try:
            return self._seams[rank]
        except KeyError:
            pass
        found = self.edges(self.tokens[rank])
        if found is not None:
            left, right = ([(self.ranks[part], until) for part, until in side] for side in found)
            found = [e for e in left if e[0] in self.rights], [e for e in right if e[0] in self.lefts]
        self._seams[rank] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """``_apart``, remembered as long as the states."""
        key = left << self.shift | right
        known = self.side_by_side.get(key)
        if known is None:
            known = self.side_by_side[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side: no part at the seam merges across it in time.

        A pair across the seam merges if its rank comes before the left part's own next merge (which, being
        further left, goes first at the same rank) and not after the right part's.
        """
        get, shift, others = self.pairs.get, self.shift, self.seam(right)[0]
        for a, until in self.seam(left)[1]:
            for b, then in others:
                rank = get(a << shift | b, NEVER)
                if rank < until and rank <= then:
                    return False
        return True

    def _step(self, key: int) -> int:
        """The next state after the state and byte of ``key``."""
        child, whole, more, shift, byte = self.child, self.whole, self.open, self.shift, key & 255
        mask, token, live = (1 << shift) - 1, 0, []
        for item in self.live[key >> 8]:
            node = child.get(item >> shift << 8 | byte)
            if node is None:
                continue
            before = item & mask
            if more[node]:
                live.append(node << shift | before)
            if not token and (rank := whole[node]) and self.seam(rank - 1) and (not before or self.apart(before - 1, rank - 1)):
                token = rank
        live.append(token)
        found = self.steps[key] = self._state(tuple(live))
        return found

    def run(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        if len(self.live) > self.most_states:
            self._forget()
        state, steps, last = 0, self.steps, self.last
        if len(data) < LOOKAHEAD:
            lasts = [last[state := steps[state << 8 | byte]] for byte in data]
            return self._way_back(lasts, len(lasts))
        lasts, ids = [], []
        for byte in data:
            state = self.steps[state << 8 | byte]
            lasts.append(self.last[state])
            if len(lasts) >= LOOKAHEAD and (certain := self._meeting(lasts, state)):
                ids += self._way_back(lasts, certain)
                del lasts[:certain]
                if len(self.live) > self.most_states:
                    self._forget(self.live[state])
                    state = 1
        return ids + self._way_back(lasts, len(lasts))

    def _meeting(self, lasts: list[int], state: int) -> int:
        """Where the ways back from all positions of a state meet."""
        at = {len(lasts) - self.depth[item >> self.shift] for item in self.live[state]}
        while len(at) > 1:
            furthest = max(at)
            at.remove(furthest)
            at.add(furthest - self.lengths[lasts[furthest - 1]])
        return at.pop()

    def _way_back(self, lasts: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes."""
        out, lengths = [], self.lengths
        while at:
            rank = lasts[at - 1]
            out.append(rank)
            at -= lengths[rank]
        out.reverse()
        return out

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.run(data))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, each match of the piece pattern by itself."""
        known = self.memo.__getitem__
        return list(chain.from_iterable(map(known, chain.from_iterable(map(pieces, blocks(text))))))


class Utf8Stream:
    """Decodes UTF-8 from chunks cut anywhere; its state is the unfinished character at the end (three bytes at most)."""

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead >= 0xC0:
                # A lead byte says how many bytes its character has.
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    cut -= back
                break
            if lead < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.rest = self.rest, b""
        return left.decode("utf-8", "replace")


def transducer(path: str, most_states: int = MOST_STATES, most_pieces: int = MOST_PIECES) -> Transducer:
    return held("bpe", (path, most_states, most_pieces), lambda: Transducer(ranks(path), most_states, most_pieces))


class Bytes:
    """The bytes of all tokens in one array; those of a list of ids are gathered from it."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 2
        tokens = [b"\xef\xbf\xbd"] * size  # ids without a token, and the last place for those beyond
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids < 0) | (ids >= len(self.lengths)), len(self.lengths) - 1, ids)
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.all[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))].tobytes()


def token_bytes(path: str) -> Bytes:
    return held("bpe", (path,), lambda: Bytes(ranks(path)))


def decode_ids(tokens: Bytes, ids: np.ndarray, chunk: int = 4096) -> str:
    """The text of ids, gathered and decoded chunk by chunk."""
    stream = Utf8Stream()
    out = [stream.feed(tokens.of(ids[i : i + chunk])) for i in range(0, len(ids), chunk)]
    out.append(stream.end())
    return "".join(out)


def _encoded(machine: Transducer, texts: pa.Array) -> pa.ListArray:
    return list_array([machine.encode(x) if x else [] for x in texts.to_pylist()], pa.int32())


def _decoded(tokens: Bytes, lists: pa.ListArray) -> pa.Array:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.array([decode_ids(tokens, x) for x in np.split(flat, ends[:-1])], pa.string())


def encode(
    docs: DataFrame,
    text: str = "text",
    into: str = "ids",
    path: str | None = None,
    most_states: int = MOST_STATES,
    most_pieces: int = MOST_PIECES,
) -> DataFrame:
    """``docs`` with the token ids of ``text`` (array of int) by the rank file at ``path``."""
    path = path or vocabulary(RANKS)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [_encoded(transducer(path, most_states, most_pieces), part.column(text))]

    return add_columns(docs, text, [T.StructField(into, T.ArrayType(T.IntegerType(), True), True)], make)


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the text that the token ids stand for; null ids give the empty text."""
    path = path or vocabulary(RANKS)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [_decoded(token_bytes(path), part.column(ids))]

    return add_columns(docs, ids, [T.StructField(into, T.StringType(), True)], make)


def round_trip(
    docs: DataFrame,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    path: str | None = None,
    most_states: int = MOST_STATES,
    most_pieces: int = MOST_PIECES,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the token ids of ``text`` and the text that these ids decode to, by one pass of workers.

    The same as ``decode`` of ``encode``, with half the workers and without moving the ids between them.
    """
    path = path or vocabulary(RANKS)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        lists = _encoded(transducer(path, most_states, most_pieces), part.column(text))
        return [lists, _decoded(token_bytes(path), lists)]

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), True), True), T.StructField(decoded, T.StringType(), True)]
    return add_columns(docs, text, fields, make, drop=[] if keep_text else [text])
