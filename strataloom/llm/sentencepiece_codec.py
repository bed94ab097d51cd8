"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores of a merge-type model are read on the driver from ``model_path`` (a parameter; never copied) and sent to the executors.
Encoding runs the agenda of candidate merges, best score first and leftmost of equals. A candidate is the pair of neighbouring symbols at
[start, mid) and [mid, end) of a chunk; it is skipped with probability ``dropout``, by a hash of the seed, the document's id, the chunk's place in
the document, and start, mid and end. So any segmentation can occur at any place; everything is reproducible from seed, id and text.

Many chunks are merged at once: their symbols, links and ranks are rows of arrays, and each round merges the best candidate of every row. The merges
without skips of a chunk that repeats, and the candidates offered on the way, are remembered; an occurrence that skips none of those has the
remembered pieces, and all others are merged anew. Chunks of more than ``WIDE`` symbols run through an agenda of their own.

Characters outside the vocabulary, and the space marker itself, become byte pieces, so decoding gives back every text exactly.

Defined results: a null or empty text has no pieces and decodes to the empty text. Very long texts are merged in slices of bounded size, which change
no result. Repeated rows encode alike. A null id keys as 0. Other columns are not read, whatever their names. An empty table gives an empty result. A missing
model file, or a model without all byte pieces, is an error before any job starts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.hashing import mix
from strataloom.llm.text import columns, map_arrow, utf8_column

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 17
#: Chunks read at once, chunks remembered, and symbols of the widest row of an array.
SLICE, REMEMBERED, WIDE = 25_000, 100_000, 32
#: Bytes from which a text's chunks are read one after another, and pieces handed on at once.
LONG_TEXT, HANDED_ON = 1 << 20, 500_000
MARK = "▁"
_NONE = np.int32(0x7FFFFFFF)
_M64 = 0xFFFFFFFFFFFFFFFF
#: Odd factors of start, mid and end in a candidate's hash.
_START, _MID, _END, _F1, _F2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\xbf])"
_WITH_STOPS = re.compile(rb"\n| *+(?:(?:[A-Za-z]++|\xc3[\x80-\xbf])++(?=[^A-Za-z\x80-\xff \n])|[^ \n]++)| +")
_PLAIN = re.compile(rb"\n| *+[^ \n]++| +")
_WHOLE = re.compile(rb"(?s).+")


def _scramble(x):
    """The candidate's hash from its draw plus its code, for arrays."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_F1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_F2)
    return x ^ (x >> np.uint64(32))


def _code(start, mid, end):
    return start.astype(np.uint64) * np.uint64(_START) + mid.astype(np.uint64) * np.uint64(_MID) + end.astype(np.uint64) * np.uint64(_END)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each element of rows that begin at ``starts`` of a flat array."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) + (starts - first)[row]


class _Rows:
    """Rows of unequal length in one growing array."""

    def __init__(self, dtype):
        self.flat, self.used = np.empty(1024, dtype), 0

    def add(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.flat):
            grown = np.empty(max(self.used, 2 * len(self.flat)), self.flat.dtype)
            grown[:at] = self.flat[:at]
            self.flat = grown
        self.flat[at : self.used] = values
        return at


class Codec:
    """Merges of a model: pairs of pieces to the merged piece, ranked by score."""

    def __init__(self, pieces: list[tuple[str, float, bool, bool]], dropout: float = 0.0, seed: int = 0, remembered: int = REMEMBERED):
        """pieces: (piece, score, is a byte, is a normal piece) by id."""
        self.dropout, self.seed, self.remembered = dropout, seed, remembered
        #: Hashes below this skip; a dropout of 1 skips all.
        self.threshold = min(int(dropout * 2.0**64), _M64) if dropout > 0 else 0
        raw = [b""] * len(pieces)
        self.of_byte, self.of_char = {}, {}
        normal = {}
        for i, (piece, _, is_byte, is_normal) in enumerate(pieces):
            if is_byte:
                value = int(piece[3:5], 16)
                raw[i], self.of_byte[value] = bytes([value]), i
            elif is_normal:
                raw[i] = piece.replace(MARK, " ").encode()
                normal[piece] = i
                if len(piece) == 1:
                    self.of_char[piece.replace(MARK, " ")] = i
        if len(self.of_byte) < 256:
            raise ValueError("the model has no piece for every byte")
        self.char_table = np.full(0x110000, -1, np.int32)
        self.char_table[list(map(ord, self.of_char))] = list(self.of_char.values())
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_counts = np.array([len(x) for x in raw])
        self.raw_starts = np.cumsum(self.raw_counts) - self.raw_counts
        rank, level, last = {}, -1, None
        for i in sorted(normal.values(), key=lambda i: (-pieces[i][1], i)):  # equal scores share a rank
            level += pieces[i][1] != last
            rank[i], last = level, pieces[i][1]
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (rank[i], i)
        self._tabulate(pairs)
        text = [p.replace(MARK, " ").encode() for p in normal]
        if any(re.search(rb"[^ ] |\n", t) for t in text):
            self.chunks = _WHOLE
        elif any(re.search(_LETTER + rb"[^A-Za-z\x80-\xff \n]", t) for t in text):
            self.chunks = _PLAIN
        else:
            self.chunks = _WITH_STOPS
        self._forget()

    def _tabulate(self, pairs: dict) -> None:
        """The pairs as an open hash table; an empty place ends a search."""
        bits = max(4, (8 * len(pairs)).bit_length())
        self.shift, self.places = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.pair = np.full(1 << bits, -1, np.int64)
        self.pair_rank, self.pair_piece = np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        for key, (rank, piece) in pairs.items():
            at = (key * _START & _M64) >> (64 - bits)
            while self.pair[at] >= 0:
                at = (at + 1) & int(self.places)
            self.pair[at], self.pair_rank[at], self.pair_piece[at] = key, rank, piece

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where the pairs stand in the table; pairs that it hasn't have an empty place, of no rank."""
        at = ((key.astype(np.uint64) * np.uint64(_START)) >> self.shift).astype(np.int64)
        found = self.pair[at]
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] = (at[on] + 1) & self.places
            found = self.pair[at[on]]
            on = on[(found != key[on]) & (found >= 0)]
        return at

    def _forget(self) -> None:
        self.types: dict[bytes, int] = {}
        self.symbols, self.pieces, self.codes = _Rows(np.int32), _Rows(np.int32), _Rows(np.uint64)
        #: Of each type, where its symbols, pieces and codes begin and how many they are.
        self.spans = np.zeros((1024, 6), np.int64)

    def first_symbols(self, part: bytes) -> list[int]:
        """A piece for each character, or for each byte of one without a piece; byte pieces are never merged."""
        chars = part.decode("utf-8", "surrogateescape")
        out = list(map(self.of_char.get, chars))
        if None in out:
            each = ([x] if x is not None else [self.of_byte[b] for b in c.encode("utf-8", "surrogateescape")] for x, c in zip(out, chars))
            out = list(chain.from_iterable(each))
        return out

    def _merge_rows(self, flat: np.ndarray, counts: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge rows of symbols at once: (pieces, how many of each row); without draws nothing is skipped, and (row, code) of all candidates follow."""
        n, width = len(counts), int(counts.max()) + 1
        row, place = np.repeat(np.arange(n), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        symbols = np.full((n, width), -1, np.int64)
        symbols[row, place] = flat
        after = np.broadcast_to(np.minimum(np.arange(1, width + 1), width - 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        ranks, merged = np.full((n, width), _NONE, np.int32), np.zeros((n, width), np.int32)
        s, nxt, prv, rk, mg = symbols.ravel(), after.ravel(), before.ravel(), ranks.ravel(), merged.ravel()
        none = np.empty(0, np.int64)
        asked: list[tuple[np.ndarray, np.ndarray]] = []

        def offer(rows: np.ndarray, left: np.ndarray) -> None:
            at = rows * width
            mid = nxt[at + left]
            b = s[at + mid]
            found = self._place((s[at + left] << 20) | np.maximum(b, 0))
            rank = np.where(b >= 0, self.pair_rank[found], _NONE)
            on = np.flatnonzero(rank != _NONE)
            if len(on):
                code = _code(left[on], mid[on], nxt[(at + mid)[on]])
                if draws is None:
                    asked.append((rows[on], code))
                elif self.threshold:
                    rank[on[_scramble(draws[rows[on]] + code) < np.uint64(self.threshold)]] = _NONE
            rk[at + left], mg[at + left] = rank, self.pair_piece[found]

        inner = place < counts[row] - 1
        offer(row[inner], place[inner])
        rows = np.arange(n)
        while len(rows):
            best = ranks[rows].argmin(axis=1)
            at = rows * width + best
            live = rk[at] != _NONE
            rows, best, at = rows[live], best[live], at[live]
            if not len(rows):
                break
            line = rows * width
            right = nxt[at]
            end = nxt[line + right]
            end = np.where(end == right, width - 1, end)  # only the unused last place follows itself
            s[at], s[line + right], rk[line + right] = mg[at], -1, _NONE
            nxt[at], prv[line + end] = end, best
            left = prv[at]
            has = left >= 0
            offer(np.concatenate((rows, rows[has])), np.concatenate((best, left[has])))
        held = symbols >= 0
        keys = (np.concatenate(x) for x in zip(*asked)) if asked else (none, none.astype(np.uint64))
        return symbols[held].astype(np.int32), held.sum(1), *keys

    def _merge_long(self, symbols: list[int], draw: int | None) -> list[int]:
        """The same merges for one chunk of any length."""
        n, after, before = len(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        pair, table_rank, table_piece, places, shift = self.pair, self.pair_rank, self.pair_piece, int(self.places), int(self.shift)
        agenda: list[tuple[int, int, int, int, int, int]] = []

        def offer(left: int) -> None:
            mid = after[left]
            if mid >= n:
                return
            key = symbols[left] << 20 | symbols[mid]
            at = (key * _START & _M64) >> shift
            while (found := pair[at]) != key:
                if found < 0:
                    return
                at = (at + 1) & places
            end = after[mid]
            if draw is not None and self.threshold:
                x = (draw + left * _START + mid * _MID + end * _END) & _M64
                x = (x ^ x >> 32) * _F1 & _M64
                x = (x ^ x >> 29) * _F2 & _M64
                if x ^ x >> 32 < self.threshold:
                    return
            heapq.heappush(agenda, (int(table_rank[at]), left, mid, end, int(table_piece[at]), key))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, mid, end, piece, key = heapq.heappop(agenda)
            if symbols[left] < 0 or after[left] != mid or symbols[mid] < 0 or after[mid] != end or symbols[left] << 20 | symbols[mid] != key:
                continue
            symbols[left], symbols[mid], after[left] = piece, -1, end
            if end < n:
                before[end] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [x for x in symbols if x >= 0]

    def _symbols_of(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first symbols, how many of each part) of all parts."""
        utf8 = b" ".join(parts) + b" "
        try:
            chars = np.frombuffer(utf8.decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            rows = list(map(self.first_symbols, parts))
            return np.array(list(chain.from_iterable(rows)), np.int32), np.array(list(map(len, rows)))
        leads = np.concatenate(([0], np.cumsum((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80)))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        ends = leads[ends]  # in characters, each with the space after it
        counts = np.diff(ends, prepend=0) - 1
        held = np.ones(len(chars), bool)
        held[ends - 1] = False
        flat = self.char_table[chars[held]]
        if (flat < 0).any():
            row = np.repeat(np.arange(len(parts)), counts)
            size = np.ones(len(flat), np.int64)
            odd = np.flatnonzero(flat < 0)
            pieces = [[self.of_byte[x] for x in chr(c).encode()] for c in chars[held][odd].tolist()]
            size[odd] = list(map(len, pieces))
            wide = np.repeat(flat, size)
            wide[wide < 0] = list(chain.from_iterable(pieces))
            flat, counts = wide, np.bincount(row, size, len(parts)).astype(np.int64)
        return flat, counts

    def _learn(self, parts: list[bytes], flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> None:
        """Remember chunk types: their symbols, their merges without skips and the candidates of those."""
        need = len(self.types) + len(parts)
        if need > len(self.spans):
            self.spans = np.concatenate((self.spans, np.zeros((max(need, len(self.spans)), 6), np.int64)))
        order = np.argsort(counts, kind="stable")
        for at in range(0, len(order), SLICE // 4):
            some = order[at : at + SLICE // 4]
            n, first = counts[some], len(self.types)
            symbols = flat[_ragged(begins[some], n)[1]]
            pieces, n_pieces, owner, code = self._merge_rows(symbols, n, None)
            n_codes = np.bincount(owner, minlength=len(some))
            spans = self.spans[first : first + len(some)]
            for k, (store, values, size) in enumerate(((self.symbols, symbols, n), (self.pieces, pieces, n_pieces), (self.codes, code[np.argsort(owner, kind="stable")], n_codes))):
                spans[:, 2 * k], spans[:, 2 * k + 1] = store.add(values) + np.cumsum(size) - size, size
            self.types.update(zip(map(parts.__getitem__, some.tolist()), range(first, need)))

    def _slice(self, parts: list[bytes], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many of each chunk) of chunks with these draws."""
        if len(self.types) >= self.remembered:
            self._forget()
        kind = np.array(list(map(self.types.get, parts, repeat(-1))), np.int64)
        new = np.flatnonzero(kind < 0)
        groups, counts = [], np.zeros(len(parts), np.int64)
        if len(new):
            times = Counter(map(parts.__getitem__, new.tolist()))
            known = dict(zip(times, range(len(times))))
            flat, sizes = self._symbols_of(list(times))
            begins = np.cumsum(sizes) - sizes
            often = np.flatnonzero((np.fromiter(times.values(), np.int64, len(times)) > 1) & (sizes <= WIDE))
            if len(often):
                names = list(times)
                self._learn([names[i] for i in often.tolist()], flat, begins[often], sizes[often])
                kind[new] = list(map(self.types.get, map(parts.__getitem__, new.tolist()), repeat(-1)))
                new = new[kind[new] < 0]
            at = np.array([known[parts[i]] for i in new.tolist()], np.int64)
            narrow = sizes[at] <= WIDE
            order = np.argsort(sizes[at], kind="stable")
            order = order[narrow[order]]
            self._merged(groups, counts, new[order], flat, begins[at[order]], sizes[at[order]], draws)
            for i, k in zip(new[~narrow].tolist(), at[~narrow].tolist()):
                pieces = np.array(self._merge_long(flat[begins[k] : begins[k] + sizes[k]].tolist(), int(draws[i])), np.int32)
                counts[i] = len(pieces)
                groups.append((np.array([i]), pieces))
        rows = np.flatnonzero(kind >= 0)
        of = self.spans[kind[rows]]
        if self.threshold:
            row, at = _ragged(of[:, 4], of[:, 5])
            skipped = _scramble(draws[rows][row] + self.codes.flat[at]) < np.uint64(self.threshold)
            hit = np.bincount(row[skipped], minlength=len(rows)) > 0
            again = np.flatnonzero(hit)
            again = again[np.argsort(of[again, 1], kind="stable")]
            self._merged(groups, counts, rows[again], self.symbols.flat, of[again, 0], of[again, 1], draws)
            rows, of = rows[~hit], of[~hit]
        counts[rows] = of[:, 3]
        begins = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[_ragged(begins[rows], counts[rows])[1]] = self.pieces.flat[_ragged(of[:, 2], of[:, 3])[1]]
        for rows, pieces in groups:
            out[_ragged(begins[rows], counts[rows])[1]] = pieces
        return out, counts

    def _merged(self, groups: list, counts: np.ndarray, rows: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> None:
        """Merge the chunks ``rows``, in order of size, whose symbols begin at ``begins``; their pieces go to ``groups``, their numbers to ``counts``."""
        for lo in range(0, len(rows), SLICE // 4):
            some = slice(lo, lo + SLICE // 4)
            pieces, n, *_ = self._merge_rows(flat[_ragged(begins[some], sizes[some])[1]], sizes[some], draws[rows[some]])
            counts[rows[some]] = n
            groups.append((rows[some], pieces))

    def _chunks(self, utf8: bytes) -> Iterator[list[bytes]]:
        if len(utf8) < LONG_TEXT:
            yield self.chunks.findall(b" " + utf8)
            return
        found = (m.group() for m in self.chunks.finditer(b" " + utf8))
        while parts := list(islice(found, SLICE)):
            yield parts

    def encode_all(self, texts: Iterable[bytes | None], keys: Iterable[int]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, bool]]]]:
        """Slices of the texts' pieces, each with (text, pieces, exact) of its texts; a text may go on in the next slice. ``exact``: decoding gave its chunks."""
        held: list[bytes] = []
        runs: list[tuple[int, int, int, int]] = []

        def flush():
            number, key, first, n = (np.array(x) for x in zip(*runs))
            base = mix(key.astype(np.uint64) * np.uint64(_START) + np.uint64(self.seed & _M64))
            row, place = _ragged(first, n)
            pieces, counts = self._slice(held, mix(base[row] + place.astype(np.uint64)))
            ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(n)))]
            if (same := self.bytes_of(pieces)) == b"".join(held):
                exact = [True] * len(runs)
            else:
                sizes = np.concatenate(([0], np.cumsum(self.raw_counts[pieces])))[ends]
                cuts = np.concatenate(([0], np.cumsum(n)))
                exact = [same[a:b] == b"".join(held[c:d]) for a, b, c, d in zip(sizes, sizes[1:], cuts, cuts[1:])]
            return pieces, list(zip(number.tolist(), np.diff(ends).tolist(), exact))

        for number, (text, key) in enumerate(zip(texts, keys)):
            if not text:
                runs.append((number, 0, 0, 0))
                continue
            first = 0
            for parts in self._chunks(text):
                runs.append((number, key, first, len(parts)))
                held += parts
                first += len(parts)
                if len(held) >= SLICE:
                    yield flush()
                    held, runs = [], []
        if runs:
            yield flush()

    def encode(self, utf8: bytes | None, key: int = 0) -> list[int]:
        return [x for pieces, _ in self.encode_all([utf8], [key]) for x in pieces.tolist()]

    def bytes_of(self, pieces: np.ndarray) -> bytes:
        """The pieces' bytes, the space before the text included."""
        return self.raw_bytes[_ragged(self.raw_starts[pieces], self.raw_counts[pieces])[1]].tobytes()

    def decode(self, ids) -> bytes:
        return self.bytes_of(np.asarray(ids, np.int64))[1:]


_LAST: list = [None, None]


def codec(pieces, dropout: float = 0.0, seed: int = 0) -> Codec:
    """The process's last codec if it has the same parameters: its table is built once a worker."""
    key = (hash(tuple(p for p, *_ in pieces)), dropout, seed)
    if _LAST[0] != key:
        _LAST[:] = key, Codec(pieces, dropout, seed)
    return _LAST[1]


def read_pieces(path: str = MODEL_PATH) -> list[tuple[str, float, bool, bool]]:
    """Pieces of a model on the driver's disk: a few hundred KB for any vocabulary in use."""
    import sentencepiece

    with open(path, "rb") as f:
        model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i), model.is_byte(i), not special(i)) for i in range(model.vocab_size())]


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = SEED
) -> DataFrame:
    """One row per document: id, pieces (ids), n_pieces, lossless (decoding gave back the text)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("pieces", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("lossless", pa.bool_())])

    def run(batches):
        own = codec(shared.value, dropout, seed)
        for batch in batches:
            ids, held, counts, exact, done = batch.column(0), [], [], [], 0
            for pieces, runs in own.encode_all(utf8_column(batch, "text"), (key or 0 for key in ids.to_pylist())):
                held.append(pieces)
                for number, n, same in runs:
                    if number < done + len(counts):  # the text goes on
                        counts[-1] += n
                        exact[-1] &= same
                    else:
                        counts.append(n)
                        exact.append(same)
                if sum(map(len, held)) >= HANDED_ON and len(counts) > 1:  # the last text may go on
                    flat, whole = np.concatenate(held), sum(counts[:-1])
                    yield _rows(ids.slice(done, len(counts) - 1), schema, flat[:whole], counts[:-1], exact[:-1])
                    done, held, counts, exact = done + len(counts) - 1, [flat[whole:]], counts[-1:], exact[-1:]
            if counts:
                yield _rows(ids.slice(done, len(counts)), schema, np.concatenate(held), counts, exact)

    return map_arrow(texts, run, "id long, pieces array<int>, n_pieces long, lossless boolean")


def _rows(ids, schema, flat, counts, exact):
    import pyarrow as pa

    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([ids, pieces, pa.array(counts, pa.int64()), pa.array(exact, pa.bool_())], schema=schema)


def decode(encoded: DataFrame, id_col: str = "id", pieces_col: str = "pieces", model_path: str = MODEL_PATH) -> DataFrame:
    """(id, text) from (id, pieces)."""
    import pyarrow as pa

    shared = encoded.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches):
        own = codec(shared.value)
        for batch in batches:
            texts = [own.decode(x or ()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    own = columns(encoded, id=id_col, pieces=pieces_col).select(F.col("id").cast("long").alias("id"), "pieces")
    return map_arrow(own, run, "id long, text string")


def digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "pieces", "n_pieces", "lossless")
