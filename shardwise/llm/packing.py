"""Best-fit packing with a linear grouping scheme.

Documents become token ids (a public tokenizer's file, one end id each); longer
ones are cut into pieces of the sequence length. The plan needs only how many
pieces have each length, a table of at most ``SEQUENCE`` rows whatever the
corpus, so it is made on the driver:

1. Pieces above ``LARGE`` of the sequence length are sorted and put into
   groups of equal cardinality; within a group all lengths are rounded up to the
   largest (linear grouping).
2. With so few sizes, configurations (multisets of sizes that fit a sequence)
   are optimised one after the other: a knapsack over the sizes still in stock
   fills a sequence best, and the configuration is used as often as the stock
   allows, which uses up a size each time.
3. The actual pieces take the places of their group, largest first, which frees
   what rounding up had reserved.
4. Small pieces, longest first, go where they leave the least room (best fit);
   new sequences are opened when nothing fits.

The plan is a table of rules "pieces number lo..hi of length L go to sequences
s, s+1, ... at offset o". Pieces are numbered within their length by a
distributed running count and joined to the rules.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import literal_rows
from .common import arrow_rows, column_blocks, materialize, running_before, worker_cache

SEQUENCE = 4096
END_ID = 1
LARGE = 1 / 8
GROUPS = 96
VOCABULARY = "word_bpe_49k.json"


# ------------------------------------------------------------------- tokens

# ASCII marks that never belong to a word piece with letters before them (all but the apostrophe).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
DOTTED_I = "\u0130"  # its lower case ends with a mark
SPECIAL = b"<|"
ROWS = 1024  # texts that a worker is handed at a time
RUN_CHARS = 1 << 21  # characters of the texts whose words are held at a time


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes; remembers a bounded number.

    Most words of a corpus are met once (numbers, names, slips) and would fill
    the memory for nothing: beyond ``limit`` words, or ``limit`` times 16 bytes
    of words, only those met again since stay, if these are few enough, or else
    those of the texts at hand.

    The tokenizer lower-cases, drops white space and never joins across it, so
    a text's ids are its words' ids in a row; nor does it join a word of letters
    with the marks behind it. Words of letters alone are one piece each, which
    ends with the only id marked as a word end, so they are encoded many at a
    time; all others one by one.
    """

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.size = 0  # bytes of the words known
        self.again: set[bytes] = set()  # those met again
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")

    def encode(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode_letters(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 512):
            part = words[at:at + 512]
            text = b" ".join(part).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):  # else a letter's lower case is not a letter alone
                packed, start = ids.tobytes(), 0
                for word, stop in zip(part, stops.tolist()):
                    self[word] = packed[4 * start:4 * stop]
                    start = stop
            else:
                for word in part:
                    self[word] = self.encode(word)

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all ``words`` are known."""
        new = words.difference(self)
        self.again.update(words - new)
        if len(self) > self.limit or self.size > 16 * self.limit:
            kept = self.again
            if 2 * len(kept) > self.limit or sum(map(len, kept)) > 8 * self.limit:
                kept = words - new
            kept = {word: self[word] for word in kept}
            self.clear()
            self.update(kept)
            self.size = sum(map(len, kept))
            self.again = set()
        new = list(new)
        self.size += sum(map(len, new))
        texts = b"\n".join(new).decode("utf-8", "replace").split("\n")
        letters, rest, parts = set(), [], []
        for word, text, stem in zip(new, texts, [t.rstrip(MARKS) for t in texts]):
            if not stem.isalpha() or stem[-1] >= "\u0250" or stem[-1] == DOTTED_I:
                rest.append(word)
            elif len(stem) == len(text):
                letters.add(word)
            else:
                marks = text[len(stem):].encode()
                parts.append((word, word[:-len(marks)], marks))
        letters.update(stem for _, stem, _ in parts if stem not in self)
        rest.extend({marks for _, _, marks in parts if marks not in self}.difference(rest))
        self.encode_letters(list(letters))
        for word in rest:
            self[word] = self.encode(word)
        for word, stem, marks in parts:
            self[word] = self[stem] + self[marks]


# A capital with a byte behind it that may begin a combining mark (U+0300 on): the tokenizer
# composes the two before it lower-cases, and the small letter may compose otherwise.
COMPOSED = re.compile(rb"[A-Z][\xcc-\xff]")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; lower-cased (A-Z) unless a special token or a composed capital may be spelt in it."""
    data = text.encode("utf-8", "replace") if text else b""
    if SPECIAL in data:
        return data.split()
    if COMPOSED.search(data):
        return [w.lower() if w.isascii() else w for w in data.split()]
    return data.lower().split()


def text_runs(texts: list, chars: int = RUN_CHARS) -> Iterator[list]:
    """The texts in turn, as many at a time as have about ``chars`` characters."""
    run, room = [], chars
    for text in texts:
        run.append(text)
        room -= len(text or "")
        if room <= 0:
            yield run
            run, room = [], chars
    if run:
        yield run


def token_bytes(texts: list, ids: WordIds, end_id: int = END_ID) -> Iterator[bytes]:
    """All ids of every text and the end id, four bytes each (null: the end id alone)."""
    end = np.array([end_id], dtype="<u4").tobytes()
    for run in text_runs(texts):
        words = [words_of(t) for t in run]
        ids.learn(set().union(*words))
        for own in words:
            yield b"".join([*map(ids.__getitem__, own), end])


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID,
           text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], tie``: every document cut into pieces.

    ``tie`` is a digest that spreads the pieces evenly and tells repeated ids apart
    by content. A null or empty text is one piece with the end id alone.
    """
    src = docs.select(id_col, text)
    schema = (f"{id_col} {src.schema[id_col].dataType.simpleString()}, piece int, start long, length long, "
              "ids_crc32 long" + (", ids binary" if with_ids else ""))
    step = 4 * sequence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_cache(("word ids", path), lambda: WordIds(path))
        for block in column_blocks(batches, ROWS):
            own, number, start, length, crc, parts = [], [], [], [], [], []
            for row, data in enumerate(token_bytes(block.column(1).to_pylist(), ids, end_id)):
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at:at + step]
                    own.append(row)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(part)
            columns = [block.column(0).take(pa.array(own, pa.int64())), pa.array(number, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return src.mapInArrow(cut, schema).withColumn(
        "tie", F.md5(F.concat_ws("|", F.col(id_col).cast("string"), "piece", "ids_crc32")))


# --------------------------------------------------------------------- plan

def linear_groups(stock: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Equal-cardinality groups of the stock, longest first: ``(rounded size, [(length, count)])``."""
    total = sum(stock.values())
    if not total:
        return []
    size = -(-total // groups)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    room = 0
    for length in sorted(stock, reverse=True):
        left = stock[length]
        while left:
            if room == 0:
                out.append((length, []))
                room = size
            take = min(left, room)
            out[-1][1].append((length, take))
            left -= take
            room -= take
    return out


def best_configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size fill ``capacity`` best (a bounded knapsack over reachable sums)."""
    layers = []
    sums = np.zeros(capacity + 1, dtype=bool)
    sums[0] = True
    for size, count in zip(sizes, counts):
        used = np.where(sums, 0, -1)  # how many of this size lead to each sum
        for k in range(1, min(count, capacity // size) + 1):
            shifted = np.zeros_like(sums)
            shifted[k * size:] = sums[:capacity + 1 - k * size]
            used = np.where((used < 0) & shifted, k, used)
        layers.append(used)
        sums = used >= 0
        if sums[capacity]:
            break
    at = int(np.flatnonzero(sums).max())
    out = [0] * len(sizes)
    for i in range(len(layers) - 1, -1, -1):
        out[i] = int(layers[i][at])
        at -= out[i] * sizes[i]
    return out


def front(queue: dict[int, int], k: int) -> list[int]:
    """The lengths of the first ``k`` pieces of a queue."""
    out: list[int] = []
    for length, count in queue.items():
        out += [length] * min(k - len(out), count)
        if len(out) == k:
            break
    return out


def plan(stock: dict[int, int], sequence: int = SEQUENCE, groups: int = GROUPS,
         large: float = LARGE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rules ``(length, lo, hi, first sequence, offset)`` for every piece, and the number of sequences."""
    rules: list[tuple[int, int, int, int, int]] = []
    taken = dict.fromkeys(stock, 0)
    opened = 0
    # Runs of sequences with equal room, as ``room -> [(first, count)]``.
    rooms: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, first: int, count: int, offset: int) -> None:
        rules.append((length, taken[length], taken[length] + count, first, offset))
        taken[length] += count

    def release(room: int, first: int, count: int) -> None:
        if room:
            rooms.setdefault(room, []).append((first, count))

    big = {n: c for n, c in stock.items() if n > sequence * large}
    grouped = linear_groups(big, groups)
    # By rounded size, the lengths in stock, longest first, with their counts.
    queues: dict[int, dict[int, int]] = {}
    for size, items in grouped:
        for n, c in items:
            queue = queues.setdefault(size, {})
            queue[n] = queue.get(n, 0) + c
    while queues:
        sizes = sorted(queues, reverse=True)
        counts = [sum(queues[s].values()) for s in sizes]
        # The longest size still in stock goes in first; the knapsack fills what it leaves.
        head = sizes[0]
        rest = [c - (s == head) for s, c in zip(sizes, counts)]
        config = best_configuration(sizes, rest, sequence - head)
        config[0] += 1
        times = min(c // k for k, c in zip(config, counts) if k)
        left = times
        while left:
            # The longest pieces in stock take the places; the run lasts while the same lengths do.
            places = [(s, n) for s, k in zip(sizes, config) if k for n in front(queues[s], k)]
            run = min(left, *(queues[s][n] // places.count((s, n)) for s, n in set(places)))
            offset = 0
            for s, n in places:
                put(n, opened, run, offset)
                offset += n
                queues[s][n] -= run
                if not queues[s][n]:
                    del queues[s][n]
            release(sequence - offset, opened, run)
            opened += run
            left -= run
        queues = {s: q for s, q in queues.items() if q}
    # Small pieces, longest first, into the least room that holds them.
    heap = sorted(rooms)
    for length in sorted((n for n in stock if n <= sequence * large), reverse=True):
        left = stock[length]
        waiting: list[int] = []
        while left:
            while heap and heap[0] < length:
                waiting.append(heapq.heappop(heap))
            if not heap:
                fit = sequence // length
                if left >= fit:  # whole sequences of this length
                    times = left // fit
                    for k in range(fit):
                        put(length, opened, times, k * length)
                    release(sequence - fit * length, opened, times)
                    if sequence - fit * length:
                        heapq.heappush(heap, sequence - fit * length)
                    opened += times
                    left -= times * fit
                else:
                    for k in range(left):
                        put(length, opened, 1, k * length)
                    release(sequence - left * length, opened, 1)
                    heapq.heappush(heap, sequence - left * length)
                    opened += 1
                    left = 0
                continue
            room = heap[0]
            runs = rooms.get(room)
            if not runs:
                heapq.heappop(heap)
                continue
            first, count = runs.pop()
            if not runs:
                del rooms[room]
                heapq.heappop(heap)
            fit = room // length
            if left >= fit * count:
                use, each = count, fit
            elif left >= fit:
                use, each = left // fit, fit
            else:
                use, each = 1, left
            if use < count:
                if room not in rooms:
                    heapq.heappush(heap, room)
                rooms.setdefault(room, []).append((first + use, count - use))
            for k in range(each):
                put(length, first, use, sequence - room + k * length)
            left -= use * each
            remains = room - each * length
            if remains:
                if remains not in rooms:
                    heapq.heappush(heap, remains)
                release(remains, first, use)
        for room in waiting:
            heapq.heappush(heap, room)
    return rules, opened


# ------------------------------------------------------------------ operator

def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID,
         text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every piece of every row of ``docs`` with its place in a sequence.

    Columns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids``, four bytes each, with ``with_ids``). Sequences hold at most
    ``sequence`` ids without gaps. Null and empty texts are one piece of one id;
    repeated rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, ROWS):
        cut = materialize(pieces(docs, path or public_tokenizers.path(VOCABULARY), sequence, end_id,
                                 text, id_col, with_ids), "pieces")
    # One row per length: at most ``sequence`` of them, whatever the corpus.
    stock = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules, _ = plan(stock, sequence)
    table = literal_rows(spark, rules, "r_length BIGINT, lo BIGINT, hi BIGINT, first BIGINT, r_offset BIGINT")
    numbered = running_before(cut, ["length"], "tie", [id_col, "piece"], F.lit(1).cast("long"), "number",
                              sum(stock.values()))
    # Rules come from the lengths alone, so their number is bounded and they are broadcast.
    out = numbered.join(F.broadcast(table), (F.col("length") == F.col("r_length")) &
                        (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    return out.select(id_col, "piece", "start", "length", "ids_crc32",
                      (F.col("first") + F.col("number") - F.col("lo")).alias("sequence_id"),
                      F.col("r_offset").alias("offset"), *(["ids"] if with_ids else []))
