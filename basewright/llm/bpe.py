"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to the Latin-1 characters of the same number, so that an Aho-Corasick automaton over
strings finds every vocabulary entry in one pass. A text's encoding is the only sequence of entries in
which every two neighbours are compatible: merging their joined bytes gives just these two. The encoder
takes the longest match at each place, steps back to shorter ones when a neighbour isn't compatible, and
remembers both the places that led nowhere and the answers for pairs, so its time is linear in the piece.

Null text counts as empty and gives no ids; ids of a text don't depend on other rows, so repeated rows and
ties need no rule; a text of any length is encoded whole, one at a time; an empty table gives no rows. Other columns
are carried through; those named like an output are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries kept of each memory (pieces, pairs) in a worker, and the longest piece that is kept.
MEMORY, KEPT_PIECE = 500_000, 48
#: Rows handled and handed on together.
ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank by entry of a rank file: base64 and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: join the neighbours of lowest rank, leftmost first, while there are any."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


class Codec:
    """Encoder and decoder of one vocabulary; build it once in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.entry = {rank: entry for entry, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for entry in ranks:
            self.automaton.add_word(entry.decode("latin-1"), (len(entry), ranks[entry]))
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, tuple[list[int], list[int], bool] | None] = {}
        self.shorter: dict[int, int] = {}

    def spine(self, token: int) -> tuple[list[int], list[int], bool] | None:
        """What stands at a token's left and right edge while its bytes are merged, in order of time, and
        whether ranks rise along the whole merge tree; None if its bytes don't merge to it."""
        if token in self.spines:
            return self.spines[token]
        parts, ranks = [bytes([x]) for x in self.entry[token]], self.ranks
        while len(parts) > 2:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        made: tuple[list[int], list[int], bool] | None = None
        if len(parts) == 1:
            made = [token], [token], True
        elif len(parts) == 2:
            left, right = (self.spine(ranks[x]) for x in parts)
            if left and right:
                made = [*left[0], token], [*right[1], token], left[2] and right[2] and all(ranks[x] < token or len(x) == 1 for x in parts)
        self.spines[token] = made
        return made

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart, as they are, when their joined bytes are merged."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            self.pairs[a, b] = known = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right = self.spine(a), self.spine(b)
        if not left or not right:
            return False
        if not (left[2] and right[2]):
            return merged(self.entry[a] + self.entry[b], self.ranks) == [a, b]
        edge_a, edge_b, i, j, never = left[1], right[0], 0, 0, 1 << 60
        while True:  # which comes first: the join across the border, or a merge on either side of it
            across = self.ranks.get(self.entry[edge_a[i]] + self.entry[edge_b[j]], never)
            in_a = edge_a[i + 1] if i + 1 < len(edge_a) else never
            in_b = edge_b[j + 1] if j + 1 < len(edge_b) else never
            if across < in_a and across <= in_b and across < never:
                return False
            if in_a == in_b == never:
                return True
            if in_a <= in_b:
                i += 1
            else:
                j += 1

    def prefix(self, token: int) -> int:
        """The longest entry that is a proper prefix of token's bytes, -1 if none."""
        if (known := self.shorter.get(token)) is None:
            entry = self.entry[token]
            known = next((self.ranks[entry[:n]] for n in range(len(entry) - 1, 0, -1) if entry[:n] in self.ranks), -1)
            self.shorter[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        latin, pairs = piece.decode("latin-1"), self.pairs
        greedy = [found[1] for _, found in self.automaton.iter_long(latin)]
        if all(pairs[x] if x in pairs else self.compatible(*x) for x in zip(greedy, greedy[1:], strict=False)):
            return greedy  # every longest match holds: nothing to step back from
        ranks, entry, n = self.ranks, self.entry, len(piece)
        longest: dict[int, int] = {}  # longest match by place; of long pieces all at once
        if n > KEPT_PIECE:
            for last, (length, token) in self.automaton.iter(latin):
                longest[last - length + 1] = token  # ends come in ascending order: the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, greedy[0]
        while True:
            while token >= 0:
                end = at + len(entry[token])
                if not dead[end]:
                    if not out:
                        break
                    pair = out[-1], token
                    if pairs[pair] if pair in pairs else self.compatible(*pair):
                        break
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at = end
                if (token := longest.get(at, -1)) < 0:
                    stop = n
                    while (token := ranks.get(piece[at:stop], -1)) < 0:
                        stop -= 1
                    longest[at] = token
            else:  # nothing fits here after what stands before: this place is dead
                dead[at] = 1
                token = out.pop()
                at -= len(entry[token])
                token = self.prefix(token)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces, out = self.pieces, []
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode("utf-8")), "<u4").tobytes()
                if len(piece) <= KEPT_PIECE:
                    if len(pieces) >= MEMORY:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entry.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for a rank file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = True) -> DataFrame:
    """docs with `n_tokens` long, `token_ids` binary (little-endian u32) and, if asked for, `decoded` binary.

    One narrow pass over the rows: no shuffle, memory bounded by ROWS texts.
    """
    made = ["n_tokens", "token_ids"] + ["decoded"] * decode
    kept = [c for c in docs.columns if c not in made]
    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decode])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = [own.encode(x or "") for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                columns = [*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *made])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contract's rows: ids and decoded bytes by their digests."""
    default = default_vocabulary() if path is None or pattern is None else (path, pattern)
    coded = encode_decode(docs.select("doc_id", "text"), path or default[0], pattern or default[1])
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
