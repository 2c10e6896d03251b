"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

1. Texts are normalised as the model says: a space becomes U+2581, and a text that is not empty gets one in front.
2. Between two characters that stand side by side in no piece, no merge can ever happen; texts are cut there into words. Equal words of a slice
   are encoded once (grouped by hash, then compared character by character).
3. The symbols of all words lie in one flat array. A round takes, in every word, the smallest rank of its pairs, merges all pairs of that rank
   from left to right at once, and closes the gaps; words without a pair leave. A merge may give a pair that ranks no later than the one merged (``th e`` after
   ``t h``), and the library would take that pair next: in such a word the round ends with this merge.
4. A word of more than ``LONG`` symbols would need as many rounds over it as it has ranks; its pairs wait in a heap instead, by the same rule.
5. Symbols that are no piece become the pieces of their UTF-8 bytes; an end id closes the text.

The vocabulary is read by the library from the file's path, which is a parameter; nothing is trained. Only models with identity normalisation, a dummy prefix and byte fallback
are taken, others are an error. The model travels to the tasks whole (half a megabyte; as large as the vocabulary, whatever the data).

Defined results: null and empty texts have the end id only and decode to the empty text; repeated rows and null keys stay rows; an empty table has no rows; of the input
columns only key and text are read. A long text is taken in windows of ``WINDOW`` characters that end between words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Powers, arrow_batches, mix, pieces

SPACE = "▁"
LONG = 400
WINDOW = 1_000_000
NEVER = np.int32(2**31 - 1)  # rank of two symbols that don't merge
_POWERS = Powers(0x9E3779B97F4A7C15)


class Vocabulary:
    """Symbols are the single characters of all pieces, then the pieces of two or more characters; every other character is a symbol without pairs.

    ``pair`` is a hash table of (left symbol, right symbol) as one number, ``pair_rank`` and ``pair_symbol`` say what the two become.
    """

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if model.normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE * 2}x{SPACE}":
            raise ValueError("the model must keep characters and white space and put one space in front")
        n = model.get_piece_size()
        self.end = model.eos_id()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        of = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        byte = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("the model must have a piece for every byte")
        self.byte_ids = np.array([byte[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        long = [p for p in of if len(p) > 1]
        chars = sorted({c for p in of for c in p})
        self.chars = len(chars)
        symbol = {c: k for k, c in enumerate(chars)} | {p: self.chars + k for k, p in enumerate(long)}
        self.base = len(symbol) + 1  # the last number stands for any other character
        # Character to symbol; -1 is a character of no piece.
        self.char_symbol = np.full(0x110000, -1, np.int32)
        self.char_symbol[[ord(c) for c in chars]] = np.arange(self.chars, dtype=np.int32)
        self.ids = np.array([of.get(s, -1) for s in [*chars, *long]], np.int32)
        # Equal scores are equal ranks: of those the leftmost goes first.
        _, rank = np.unique([-model.get_score(of[p]) for p in long], return_inverse=True)
        rank_of = dict(zip(long, rank.tolist()))
        pairs = [(symbol[p[:k]] * self.base + symbol[p[k:]], rank_of[p], symbol[p]) for p in long for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        pair, pair_rank = table[:, 0], table[:, 1]
        self.bits = max(4, int(len(pair)).bit_length() + 2)
        self._place(pair, pair_rank.astype(np.int32), table[:, 2].astype(np.int32))
        own = np.full(self.base, -1, np.int64)
        own[[symbol[p] for p in long]] = rank
        # Symbols with a pair that ranks no later than the symbol itself.
        left, right = pair // self.base, pair % self.base
        self.eager = np.zeros(self.base, bool)
        for side in (left, right):
            self.eager[side[pair_rank <= own[side]]] = True
        self.beside = np.zeros((self.chars + 1, self.chars + 1), bool)  # the last row and column: other characters
        inner = np.array([(symbol[a], symbol[b]) for p in long for a, b in zip(p, p[1:])], np.int64).reshape(-1, 2)
        self.beside[inner[:, 0], inner[:, 1]] = True
        piece = [model.id_to_piece(i).replace(SPACE, " ").encode() if not special[i] else b"" for i in range(n)]
        for b, i in enumerate(self.byte_ids.tolist()):
            piece[i] = bytes([b])
        self.bytes_of = pa.array(piece, pa.large_binary())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, pair: np.ndarray, rank: np.ndarray, symbol: np.ndarray) -> None:
        """Open addressing, a quarter full at most: a pair lies at its slot or the next free one."""
        size = 1 << self.bits
        self.pair, self.pair_rank, self.pair_symbol = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32), np.full(size, -1, np.int32)
        for k, at in enumerate(self._slot(pair).tolist()):
            while self.pair[at] >= 0:
                at = (at + 1) % size
            self.pair[at], self.pair_rank[at], self.pair_symbol[at] = pair[k], rank[k], symbol[k]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of pairs; NEVER where there is none."""
        key = left.astype(np.int64) * self.base + right
        at = self._slot(key)
        open_ = np.flatnonzero((self.pair[at] != key) & (self.pair[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.pair)
            found = self.pair[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        there = self.pair[at] == key
        return np.where(there, self.pair_rank[at], NEVER), np.where(there, self.pair_symbol[at], -1)

    def words(self, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin; a text always begins one. ``starts`` are the places where texts begin."""
        symbol = self.char_symbol[code]
        new = np.ones(len(code), bool)
        new[1:] = ~self.beside[symbol[:-1], symbol[1:]]
        new[starts] = True
        return np.flatnonzero(new)


@lru_cache(maxsize=4)
def vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``length[0]`` numbers, then those of start[1] and so on."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def _distinct(code: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word for each distinct one, and for every word the number of its like."""
    place = _ranges(np.zeros(len(first), np.int64), length)
    up, _ = _POWERS.to(int(length.max()))
    h = np.add.reduceat(mix(code.astype(np.uint64) + np.uint64(1)) * up[place], first) + length.astype(np.uint64)
    _, one, like = np.unique(h, return_index=True, return_inverse=True)
    model = one[like]
    same = length[model] == length
    again = np.flatnonzero(same & (model != np.arange(len(first))))
    equal = code[_ranges(first[model[again]], length[again])] == code[_ranges(first[again], length[again])]
    if len(again):
        same[again] = np.logical_and.reduceat(equal, np.cumsum(length[again]) - length[again])
    odd = np.flatnonzero(~same)  # other words of the same hash stand for themselves
    like[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), like


def merge_rounds(v: Vocabulary, symbol: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols and their words, in order. ``word`` ascends; a symbol below 0 merges with nothing."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    place = np.arange(len(symbol))  # of the first character: the order of the end
    where: list[np.ndarray] = []
    rank, into = v.look_up(symbol[:-1], symbol[1:]) if len(symbol) else (np.zeros(0, np.int32),) * 2
    rank, into = np.append(rank, NEVER), np.append(into, -1)
    rank[:-1][word[1:] != word[:-1]] = NEVER
    while len(symbol):
        edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, edge), np.diff(np.r_[edge, len(word)]))
        live = least < NEVER
        if not live.all():
            done.append((symbol[~live], word[~live]))
            where.append(place[~live])
            symbol, word, rank, into, least, place = (x[live] for x in (symbol, word, rank, into, least, place))
            if not len(symbol):
                break
        at = np.flatnonzero(rank == least)
        # From left to right: in a row of overlapping pairs every other one.
        head = np.r_[True, at[1:] != at[:-1] + 1]
        turn = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        at = at[turn % 2 == 0]
        made = into[at]
        check = np.flatnonzero(v.eager[made])
        if len(check):
            # Pairs that the merge makes, its right neighbour as it is and the left one merged if it is of this round.
            c, m = at[check], made[check]
            right = np.minimum(c + 2, len(symbol) - 1)
            after = np.where(word[right] == word[c], symbol[right], -1)
            after[c + 2 >= len(symbol)] = -1
            left = np.maximum(c - 1, 0)
            before = np.where((c > 0) & (word[left] == word[c]), symbol[left], -1)
            chained = (check > 0) & (at[np.maximum(check - 1, 0)] == c - 2)
            before = np.where(chained, made[np.maximum(check - 1, 0)], before)
            soon = np.minimum(v.look_up(m, after)[0], v.look_up(before, m)[0])
            stop = np.zeros(len(at), np.int64)
            stop[check] = soon <= least[c]
            if stop.any():
                stops = np.cumsum(stop) - stop  # before each merge, in all words
                begin = np.flatnonzero(np.r_[True, word[at[1:]] != word[at[:-1]]])
                keep = stops == np.repeat(stops[begin], np.diff(np.r_[begin, len(at)]))
                at, made = at[keep], made[keep]
        symbol = symbol.copy()
        symbol[at] = made
        gone = np.zeros(len(symbol), bool)
        gone[at + 1] = True
        stay = ~gone
        now = np.cumsum(stay) - 1
        symbol, word, rank, into, place = (x[stay] for x in (symbol, word, rank, into, place))
        new = now[at]
        touched = np.zeros(len(symbol) + 1, bool)
        touched[new] = touched[new - 1] = True  # place -1 is the spare one
        fresh = np.flatnonzero(touched[:-1])
        last = fresh == len(symbol) - 1
        right = np.minimum(fresh + 1, len(symbol) - 1)
        r, s = v.look_up(symbol[fresh], symbol[right])
        r[last | (word[right] != word[fresh])] = NEVER
        rank[fresh], into[fresh] = r, s
    if not done:
        return symbol, word
    symbol, word, place = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]), np.concatenate(where)
    order = np.argsort(place, kind="stable")
    return symbol[order], word[order]


def merge_long(v: Vocabulary, symbol: np.ndarray) -> np.ndarray:
    """Final symbols of one long word: pairs wait in a heap by (rank, place)."""
    n = len(symbol)
    sym = symbol.tolist()
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank, into = v.look_up(symbol[:-1], symbol[1:])
    heap = [(r, i, sym[i], sym[i + 1], s) for i, (r, s) in enumerate(zip(rank.tolist(), into.tolist())) if r < NEVER]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(i: int, j: int) -> None:
        key = (sym[i], sym[j])
        if key not in known:
            r, s = v.look_up(np.array([key[0]]), np.array([key[1]]))
            known[key] = int(r[0]), int(s[0])
        r, s = known[key]
        if r < NEVER:
            heapq.heappush(heap, (r, i, *key, s))

    while heap:
        _, i, a, b, s = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue  # one of the two has merged meanwhile
        sym[i], sym[j] = s, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            pair(i, after[j])
        if before[i] >= 0:
            pair(before[i], i)
    return np.array([x for x in sym if x is not None], np.int32)


def encode_windows(v: Vocabulary, texts: list[str | None], window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids without the end id, and how many of each text, of all texts; a long text comes in several windows, the others together."""
    held: list[tuple[int, str]] = []
    size = 0

    def give() -> tuple[np.ndarray, np.ndarray]:
        return _encode(v, [t for _, t in held], [i for i, _ in held], len(texts))

    for i, text in enumerate(texts):
        whole = SPACE + text.replace(" ", SPACE) if text else ""
        begin = 0
        while begin < len(whole):
            end = min(len(whole), begin + window)
            while end < len(whole):  # back to the last place where a word ends, or on to the next one
                code = np.frombuffer(whole[begin:end + 1].encode("utf-32-le"), np.uint32)
                cuts = v.words(code, np.zeros(1, np.int64))
                if len(cuts) > 1:
                    end = begin + int(cuts[-1])
                    break
                end = min(len(whole), end + window)
            held.append((i, whole[begin:end]))
            size += end - begin
            begin = end
            if size >= window:
                yield give()
                held, size = [], 0
    yield give()


def _encode(v: Vocabulary, parts: list[str], owner: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(n, np.int64)
    if not parts:
        return np.zeros(0, np.int32), counts
    code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    begins = np.cumsum([0, *map(len, parts)])
    first = v.words(code, begins[:-1])
    length = np.diff(np.r_[first, len(code)])
    one, like = _distinct(code, first, length)
    code_of = code[_ranges(first[one], length[one])]
    sizes = length[one]
    word = np.repeat(np.arange(len(one)), sizes)
    symbol = v.char_symbol[code_of]
    bare = symbol < 0
    symbol[bare] = v.base - 1
    # A character of no piece is a word of its own, so its place in ``code_of`` is known by its word.
    short = (sizes <= LONG)[word]
    final, owns = merge_rounds(v, symbol[short], word[short], len(one))
    if not short.all():
        more = [(merge_long(v, symbol[a: a + m]), w) for w, a, m in zip(range(len(one)), (np.cumsum(sizes) - sizes).tolist(), sizes.tolist()) if m > LONG]
        final = np.concatenate([final, *[s for s, _ in more]])
        owns = np.concatenate([owns, *[np.full(len(s), w) for s, w in more]])
        order = np.argsort(owns, kind="stable")
        final, owns = final[order], owns[order]
    ids = np.where(final < v.base - 1, v.ids[np.minimum(final, v.base - 2)], -1)
    loose = np.flatnonzero(ids < 0)  # characters that are no piece
    if len(loose):
        ids, owns = _bytes_instead(v, ids, final, owns, loose, code_of, symbol, sizes)
    per_word = np.bincount(owns, minlength=len(one))
    at = np.cumsum(per_word) - per_word
    tokens = per_word[like]
    out = ids[_ranges(at[like], tokens)].astype(np.int32)
    part = np.searchsorted(begins, first, "right") - 1
    np.add.at(counts, np.asarray(owner)[part], tokens)
    return out, counts


def _bytes_instead(v: Vocabulary, ids, final, owns, loose, code_of, symbol, sizes):
    """Ids with the UTF-8 bytes of every symbol in ``loose``."""
    char_of = np.full(v.base, 0, np.int64)
    char_of[v.char_symbol[v.char_symbol >= 0]] = np.flatnonzero(v.char_symbol >= 0)
    own_char = code_of[(np.cumsum(sizes) - sizes)[owns[loose]]]
    chars = np.where(final[loose] == v.base - 1, own_char, char_of[final[loose]])
    raw = [chr(c).encode("utf-8", "replace") for c in chars.tolist()]
    many = np.ones(len(ids), np.int64)
    many[loose] = [len(b) for b in raw]
    out, owns = np.repeat(ids, many), np.repeat(owns, many)
    begin = np.cumsum(many) - many
    out[_ranges(begin[loose], many[loose])] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return out, owns


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their ends (n + 1 values); the space in front is taken away again."""
    taken = v.bytes_of.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ends = at[np.r_[0, np.cumsum(counts)]]
    first = ends[:-1]
    space = (ends[1:] > first) & (raw[np.minimum(first, max(len(raw) - 1, 0))] == 32) if len(raw) else np.zeros(len(counts), bool)
    keep = np.ones(len(raw), bool)
    keep[first[space]] = False
    return raw[keep], np.r_[0, np.cumsum(np.diff(ends) - space)]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _encoder(proto: bytes, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto)
        for whole in batches:
            for batch in pieces(whole, "text"):
                parts, totals = [], np.zeros(batch.num_rows, np.int64)
                for ids, counts in encode_windows(v, _column(batch, "text").to_pylist(), window):
                    parts.append(ids)
                    totals += counts
                ids = np.insert(np.concatenate(parts), np.cumsum(totals), v.end).astype(np.int32)
                ends = np.r_[0, np.cumsum(totals + 1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([_column(batch, "key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["key", "ids"])

    return run


def _decoder(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(proto)
        for batch in batches:
            column = _column(batch, "ids")
            raw, ends = decode_ids(v, column.flatten().to_numpy(), column.value_lengths().fill_null(0).to_numpy())
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.binary()).cast(pa.string())], names=[*batch.schema.names, "text"])

    return run


def model_bytes(path: str) -> bytes:
    """The model of a SentencePiece file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto()


def encoded(documents: DataFrame, model: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key and ids (array, the end id last) of every row; ``model`` is the path of a SentencePiece file."""
    arrow_batches(documents.sparkSession)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_encoder(model_bytes(model), window), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decoded(ids: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """The rows of ``ids`` with a column ``text``; null ids have the empty text, and control pieces say nothing."""
    arrow_batches(ids.sparkSession)
    rows = ids.withColumnRenamed(column, "ids") if column != "ids" else ids
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decoder(model_bytes(model)), f"{kind}, text string")
