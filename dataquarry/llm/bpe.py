"""Byte-level BPE: Spark higher-order functions fold ranked merges over bytes of distinct words.

Texts are cut into words by the tokenizer's pattern in Arrow batches.  Several documents
make a chunk: its distinct words as the states a fold begins with, and per document the
numbers of its words.  In a chunk every distinct word is merged once, by a fold that looks
neighbours up in a literal rank map, and documents gather the ids by number.  The first few
merges of all words of a chunk are made together on arrays, as a merge is dear in the fold.
Nothing is shuffled, and no table of words outgrows a chunk.  Decoding concatenates the
pieces of the ids, which are literals in hexadecimal.

A rank is the id of the merged piece, so a word is an array of ids that starts with those
of its bytes; each is held in one long with the rank of the pair it begins.  The rank map has an entry for every two pieces that make a third, packed
into one long (left, right, merged: 21 bits each).  It is a two-choice hash table in a
literal array: an entry is in one of two places, and an empty first place means there is none.
"""

from __future__ import annotations

import base64
import copy
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquarry.llm.common import let, literal_longs, literal_texts

#: Characters of text whose distinct words are merged together; a longer text is a chunk of its own.
CHUNK_CHARS = 64_000_000
#: Words of more bytes are merged pair by pair in rounds instead of one place at a time.
LONG_WORD = 128
NEVER = 2**31 - 1
#: Merges of a word that are made before the fold, for many words together.
FIRST_MERGES = 4
#: Words that are together in this.
TOGETHER = 16_384
#: Bits of an id in the rank map.
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1

CHUNK = "words array<array<bigint>>, docs array<struct<id:{id}, at:array<int>>>"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a piece in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Literals of a rank table: the map of pairs, and the pieces by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        if self.size > ID_MASK:
            raise ValueError(f"ids beyond {ID_MASK}")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte needs an id")
        #: Pieces that merges do not lead to; as whole words they have their id all the same.
        self.unreached, pairs = {}, {}
        for piece, rank in ranks.items():
            if len(piece) > 1:
                states = _states(piece, ranks)
                if len(states[-1]) > 1:
                    self.unreached[piece] = rank
                else:
                    pairs[ranks[states[-2][0]], ranks[states[-2][1]]] = rank
        if self.unreached:
            # Such a piece may come of any two others.
            pairs = {
                (ranks[piece[:i]], ranks[piece[i:]]): rank
                for piece, rank in ranks.items() for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks
            }
        single = {ranks[bytes([b])] for b in range(256)}
        #: Whether a merge always ranks behind the merges that made its two parts, so that equal pairs may be merged together.
        self.ordered = all(rank > part for pair, rank in pairs.items() for part in pair if part not in single)
        bits = max(6, (2 * len(pairs)).bit_length())
        self.mask = (1 << bits) - 1
        slots = [0] * (1 << bits)
        for (left, right), rank in pairs.items():
            self._place(slots, (left << ID_BITS | right) << ID_BITS | rank)
        self.table = literal_longs(slots)
        single = [ranks[bytes([b])] for b in range(256)]
        # By two neighbouring bytes: their first entry of the state.
        self.bytes = np.array([ranks.get(bytes([a, b]), NEVER) << ID_BITS | single[a] for a in range(256) for b in range(256)], np.int64)
        self.last = np.array([NEVER << ID_BITS | i for i in single], np.int64)
        # The same pairs, in order, for arrays of words.
        found = sorted((left << ID_BITS | right, rank) for (left, right), rank in pairs.items())
        self.pairs = np.array(found, np.int64).reshape(-1, 2).T.copy()
        pieces = [""] * self.size
        for piece, rank in ranks.items():
            pieces[rank] = piece.hex().upper()
        self.pieces, self.words = literal_texts(pieces), literal_texts([i.to_bytes(4, "little").hex() for i in range(self.size)])

    def _places(self, key: int) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42)
        return h & self.mask, (h >> 32) & self.mask

    def _place(self, slots: list[int], entry: int) -> None:
        at = self._places(entry >> ID_BITS)[0]
        for _ in range(1000):
            entry, slots[at] = slots[at], entry
            if not entry:
                return
            one, two = self._places(entry >> ID_BITS)
            at = two if at == one else one
        raise ValueError("no room in the rank table")

    def bound(self, body: Callable[[Vocabulary], Column]) -> Column:
        """``body`` with the rank map as a variable: the literal stands in the plan once, however often it is read."""

        def within(table: Column) -> Column:
            same = copy.copy(self)
            same.table = table
            return body(same)

        return let(self.table, within)

    def merged(self, left: Column, right: Column) -> Column:
        """The id of two joined pieces (longs), ``NEVER`` if they make none."""
        key = F.shiftleft(left, ID_BITS).bitwiseOR(right)

        def second(k: Column) -> Column:
            at = F.shiftright(F.xxhash64(k), 32).bitwiseAND(self.mask).cast("int")
            return let(F.get(self.table, at), lambda e: F.when(F.shiftright(e, ID_BITS) == k, e.bitwiseAND(ID_MASK)).otherwise(NEVER))

        def first(k: Column) -> Column:
            return let(
                F.get(self.table, F.xxhash64(k).bitwiseAND(self.mask).cast("int")),
                lambda e: F.when(e == 0, F.lit(NEVER).cast("bigint")).when(F.shiftright(e, ID_BITS) == k, e.bitwiseAND(ID_MASK)).otherwise(second(k)),
            )

        return let(key, first)


def _states(piece: bytes, ranks: dict[bytes, int]) -> list[list[bytes]]:
    """A piece after every merge, by the rule itself: the leftmost pair of the smallest rank, again and again."""
    states = [[piece[i : i + 1] for i in range(len(piece))]]
    while len(states[-1]) > 1:
        parts = states[-1]
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank == NEVER:
            break
        states.append([*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]])
    return states


@lru_cache(maxsize=4)
def _vocabulary(path: str, session: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def vocabulary(df: DataFrame, path: str) -> Vocabulary:
    """The literals for a session (columns belong to one)."""
    return _vocabulary(path, df.sparkSession.sparkContext.applicationId)


def _none() -> Column:
    return F.array().cast("array<int>")


def _pairs(parts: Column, vocab: Vocabulary) -> Column:
    """The merged id of every two neighbours."""
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: vocab.merged(F.get(parts, i - 1), F.get(parts, i))),
    ).otherwise(F.array().cast("array<bigint>"))


def _entry(rank: Column, piece: Column) -> Column:
    """A piece with the rank of the pair it begins: the smallest entry has the smallest rank."""
    return F.shiftleft(rank, ID_BITS).bitwiseOR(piece)


def _merge_place(state: Column, vocab: Vocabulary) -> Column:
    """Merge the leftmost pair of the smallest rank (places count from 1).

    In an ordered vocabulary whose pieces are all reached, equal pieces are made of equal
    pairs, so the first smallest entry is the leftmost; else ranks are compared.
    """

    def merge(piece: Column, i: Column) -> Column:
        after = F.when(i < F.size(state) - 1, vocab.merged(piece, F.get(state, i + 1).bitwiseAND(ID_MASK))).otherwise(NEVER)
        here = F.array_repeat(_entry(after, piece), 1)
        before = let(F.get(state, i - 2).bitwiseAND(ID_MASK), lambda left: _entry(vocab.merged(left, piece), left))
        rest = F.slice(state, i + 2, F.size(state))
        return F.when(i == 1, F.concat(here, rest)).otherwise(
            F.concat(F.slice(state, 1, i - 2), F.array_repeat(before, 1), here, rest)
        )

    def leftmost(low: Column) -> Column:
        if vocab.ordered and not vocab.unreached:
            return F.array_position(state, low).cast("int")
        return F.array_position(F.transform(state, lambda e: F.shiftright(e, ID_BITS)), F.shiftright(low, ID_BITS)).cast("int")

    return let(
        F.array_min(state),
        lambda low: F.when(F.shiftright(low, ID_BITS) == NEVER, state).otherwise(
            let(leftmost(low), lambda i: merge(F.shiftright(low, ID_BITS), i))
        ),
    )


def _merge_round(text: Column, vocab: Vocabulary) -> Column:
    """Merge all places of the leftmost pair of the smallest rank, in a word written ``<12><57>``; done if there is none.

    If the same piece can be made of two different pairs, only the first place is merged.
    """

    def chosen(parts: Column, ranks: Column, low: Column) -> Column:
        pair = let(
            F.array_position(ranks, low).cast("int"),
            lambda i: F.struct(F.get(parts, i - 1).alias("a"), F.get(parts, i).alias("b")),
        )
        alike = lambda p: ~F.exists(
            F.sequence(F.lit(1), F.size(ranks)), lambda i: (F.get(ranks, i - 1) == low) & (F.get(parts, i - 1) != p["a"])
        )

        def merge(p: Column) -> Column:
            old = F.concat(F.lit("<"), p["a"].cast("string"), F.lit("><"), p["b"].cast("string"), F.lit(">"))
            new = F.concat(F.lit("<"), low.cast("string"), F.lit(">"))
            place = F.instr(text, old)
            first = F.concat(F.substr(text, F.lit(1), place - 1), new, F.substr(text, place + F.length(old)))
            return F.when(alike(p), F.replace(text, old, new)).otherwise(first)

        return let(pair, merge)

    return let(_parts(text), lambda parts: let(_pairs(parts, vocab), lambda ranks: let(
        F.coalesce(F.array_min(ranks), F.lit(NEVER)),
        lambda low: F.struct((low == NEVER).alias("done"), F.when(low == NEVER, text).otherwise(chosen(parts, ranks, low)).alias("text")),
    )))


def _parts(text: Column) -> Column:
    return F.split(F.substr(text, F.lit(2), F.length(text) - 2), "><").cast("array<bigint>")


def word_ids(word: Column, vocab: Vocabulary) -> Column:
    """The ids of one word, an array of bytes: its own if it has one, else those that all merges leave."""
    size = F.size(word)
    by_bytes, last = literal_longs(vocab.bytes.tolist()), literal_longs(vocab.last.tolist())
    byte = lambda i: F.get(word, i).cast("int").bitwiseAND(255)
    start = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.when(i < size, F.get(by_bytes, F.shiftleft(byte(i - 1), 8).bitwiseOR(byte(i)))).otherwise(F.get(last, byte(i - 1))),
    )
    return state_ids(F.when(size > 0, start).otherwise(F.array().cast("array<bigint>")), vocab)


def first_states(words: list[str], by_bytes: np.ndarray, last: np.ndarray, pairs: np.ndarray, merges: int = FIRST_MERGES) -> pa.ListArray:
    """The states of words after their first ``merges`` merges, each made for ``TOGETHER`` words at once."""
    parts = [
        _merged_states([w.encode() for w in words[at : at + TOGETHER]], by_bytes, last, pairs, merges)
        for at in range(0, len(words), TOGETHER)
    ]
    sizes, states = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(states))


def _merged_states(words: list[bytes], by_bytes: np.ndarray, last: np.ndarray, pairs: np.ndarray, merges: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some words the sizes of their states, and the states one behind the other."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    spelled = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    state = np.empty(len(spelled), np.int64)
    state[:-1] = by_bytes[spelled[:-1] << 8 | spelled[1:]]
    final = np.cumsum(sizes)[sizes > 0] - 1
    state[final] = last[spelled[final]]
    piece, rank = state & ID_MASK, state >> ID_BITS
    word = np.repeat(np.arange(len(words)), sizes)

    def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(pairs[0], key), max(pairs.shape[1] - 1, 0))
        return np.where(pairs[0][at] == key, pairs[1][at], NEVER) if pairs.size else np.full(len(key), NEVER)

    for _ in range(merges if len(spelled) else 0):
        begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.r_[begins, len(word)]))
        at = np.flatnonzero((rank == low) & (rank != NEVER))
        if not len(at):
            break
        # Of a word the leftmost.
        at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
        piece[at] = rank[at]
        kept = np.ones(len(word), bool)
        kept[at + 1] = False
        piece, rank, word = piece[kept], rank[kept], word[kept]
        at -= np.arange(len(at))
        rank[at] = NEVER
        inner = at[at < len(word) - 1]
        inner = inner[word[inner + 1] == word[inner]]
        rank[inner] = merged(piece[inner], piece[inner + 1])
        inner = at[at > 0]
        inner = inner[word[inner - 1] == word[inner]]
        rank[inner - 1] = merged(piece[inner - 1], piece[inner])
    return np.bincount(word, minlength=len(words)).astype(np.int32), rank << ID_BITS | piece


def state_ids(start: Column, vocab: Vocabulary) -> Column:
    """The ids of the word that begins with a state: its own if it has one, else those that all merges leave."""
    size = F.size(start)
    ids = lambda state: F.transform(state, lambda e: e.bitwiseAND(ID_MASK).cast("int"))
    by_place = F.aggregate(start, start, lambda state, _: _merge_place(state, vocab), ids)
    text = F.concat(F.lit("<"), F.array_join(ids(start).cast("array<string>"), "><"), F.lit(">"))
    by_round = F.aggregate(
        start, F.struct(F.lit(False).alias("done"), text.alias("text")),
        lambda state, _: F.when(state["done"], state).otherwise(_merge_round(state["text"], vocab)),
        lambda state: _parts(state["text"]).cast("array<int>"),
    )
    short = F.lit(True) if not vocab.ordered else size <= LONG_WORD
    found = F.when(size == 0, _none()).when(short, by_place).otherwise(by_round)
    for piece, rank in vocab.unreached.items():
        same = F.array(*[F.lit(int(vocab.last[b]) & ID_MASK) for b in piece])
        found = F.when(ids(start) == same, F.array(F.lit(rank))).otherwise(found)
    return found


class _Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _chunks(pattern: str, id_type: pa.DataType, vocab: Vocabulary):
    # Only the arrays travel to the tasks.
    by_bytes, last, pairs = vocab.bytes, vocab.last, vocab.pairs
    merges = 0 if vocab.unreached else FIRST_MERGES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern)
        numbers, ids, at, chars = _Numbers(), [], [], 0

        def chunk() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, at)]).astype(np.int32)
            per_doc = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(at)))
            docs = pa.StructArray.from_arrays([pa.array(ids, id_type), per_doc], ["id", "at"])
            words = first_states(list(numbers), by_bytes, last, pairs, merges)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([one(words), one(docs)], ["words", "docs"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = (m.group() for m in find.finditer(text)) if len(text) > 1_000_000 else find.findall(text)
                ids.append(key)
                at.append(np.fromiter(map(numbers.__getitem__, found), np.int32))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield chunk()
                    numbers, ids, at, chars = _Numbers(), [], [], 0
        if ids:
            yield chunk()

    return cut


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` for every row: the token ids of the whole text, without special tokens.

    ``ranks`` is the path of a rank file on the driver.  A null or empty text has no
    ids; repeated rows and null keys are rows of their own; other columns are left out.
    """
    vocab = vocabulary(docs, ranks)
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    from pyspark.sql.pandas.types import to_arrow_type

    chunks = rows.mapInArrow(
        _chunks(pattern, to_arrow_type(kind), vocab), CHUNK.format(id=kind.simpleString())
    )
    encoded = let(
        vocab.bound(lambda v: F.transform("words", lambda w: state_ids(w, v))),
        lambda by_word: F.transform("docs", lambda d: F.struct(
            d["id"].alias("id"), F.flatten(F.transform(d["at"], lambda i: F.get(by_word, i))).alias("ids")
        )),
    )
    return chunks.select(F.explode(encoded).alias("_d")).select(F.col("_d.id").alias(key), F.col("_d.ids").alias("ids"))


def decode(ids: Column, vocab: Vocabulary) -> Column:
    """The bytes of a list of ids; null for a null list or an id out of range."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(vocab.pieces, i)), ""))


def id_bytes(ids: Column, vocab: Vocabulary) -> Column:
    """The ids as little-endian unsigned 32-bit integers."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(vocab.words, i)), ""))


def digest(encoded: DataFrame, ranks: str, key: str = "doc_id") -> DataFrame:
    """Per row the number of ids, and SHA-256 of the ids and of the decoded bytes."""
    vocab = vocabulary(encoded, ranks)
    return encoded.select(
        key, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(id_bytes(F.col("ids"), vocab), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), vocab), 256).alias("decoded_sha256"),
    )
