"""Token alignment of two tokenizers, with an identity map as the fast path.

Tokens of A (byte-level BPE) and B (sentence pieces) cover the same bytes; the
byte offsets where both end cut them into groups, and an A and a B token are
linked when their byte ranges overlap. How many documents hold a linked id pair
is counted over the corpus:

* Before anything runs, an array gives for every A id the B id of the same
  bytes. A pair of that array (as good as every one-to-one group) is counted in
  a vector as long as A's vocabulary, one per task.
* Only other pairs, from irregular groups, enter a shuffle, where they are
  counted by pair with partial sums.

Each document's counts are looked up the same way: vectors for the pairs of the
array and a bounded table of the most frequent other pairs go to all tasks;
the remaining pairs meet their counts in a join.

Texts are cut where neither tokenizer can join: before a single space between
two characters that are not white space. Cut parts repeat, so each worker
remembers a bounded number of them with their aligned tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column_blocks, materialize, worker_cache

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
FREQUENT = 1 << 17  # other pairs whose counts go to all tasks (2 MB); the rest are joined
REMEMBERED = 300_000  # cut parts a worker remembers
LONGEST_REMEMBERED = 64  # characters
TOGETHER = 256  # parts encoded in one call

SPACE = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 as itself and the other bytes from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def ragged(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as one array and the places where each starts and the last ends."""
    ends = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) for v in values], out=ends[1:])
    return np.frombuffer(b"".join(values), dtype=np.uint8), ends


def take(flat: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen slices of a ragged array in a row, and the number of the slice of every value."""
    lengths = starts[chosen + 1] - starts[chosen]
    owner = np.repeat(np.arange(len(chosen)), lengths)
    before = np.cumsum(lengths) - lengths
    return flat[np.arange(len(owner)) - before[owner] + starts[chosen][owner]], owner


class Vocabularies:
    """Both tokenizers, the bytes of every token, and A's ids mapped to B's ids of the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = self.a.get_vocab()
        tokens_a = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            tokens_a[number] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        tokens_b, inner = [], False
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            tokens_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(number)
                            else piece.replace(SPACE, " ").encode())
            inner = inner or SPACE in piece.lstrip(SPACE)
        self.flat_a, self.starts_a = ragged(tokens_a)
        self.flat_b, self.starts_b = ragged(tokens_b)
        self.n_a, self.n_b = len(tokens_a), len(tokens_b)
        usable = {t: i for i, t in reversed(list(enumerate(tokens_b)))
                  if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))}
        # A single byte that is no character by itself is written as a byte piece.
        single = {t: i for i, t in enumerate(tokens_b) if self.b.is_byte(i) and t not in usable}
        self.same = np.array([usable.get(t, single.get(t, -1)) for t in tokens_a], dtype=np.int64)
        # Parts are independent if no piece holds a space behind another character and
        # A splits words off with the blank before them.
        before = (json.loads(self.a.to_str()).get("pre_tokenizer") or {})
        self.cuts = not inner and before.get("type") == "ByteLevel" and before.get("use_regex", True)


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return worker_cache(("token_align", path_a, path_b), lambda: Vocabularies(path_a, path_b))


class Parts:
    """Aligned tokens of text parts; remembers a bounded number of short ones."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.long: list[str] = []
        self.characters = 0
        self.strings: list[str] = []
        # Per part: tokens of A, of B, groups (or all 0 and broken), and where its pairs start.
        self.sizes = np.zeros((0, 3), dtype=np.int64)
        self.broken = np.zeros(0, dtype=bool)
        self.starts = np.zeros(1, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The number of every part; learns the new ones."""
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))

    def tidy(self) -> None:
        """Between blocks of texts: forget long parts, and everything when it gets too much."""
        for part in self.long:
            del self.known[part]
        self.long.clear()
        if len(self.strings) > REMEMBERED or self.characters > 32 * REMEMBERED:
            self.forget()

    def encode(self, parts: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides for parts with single blanks between, or None if their bytes differ from the text's."""
        v = self.v
        joined = " ".join(parts)
        a = np.array(v.a.encode(" " + joined, add_special_tokens=False).ids, dtype=np.int64)
        b = np.array(v.b.encode(joined), dtype=np.int64)
        whole = b"".join(texts)
        if (take(v.flat_a, v.starts_a, a)[0].tobytes() != whole or take(v.flat_b, v.starts_b, b)[0].tobytes() != whole):
            return None
        return a, b

    def learn(self, new: list[str]) -> None:
        v = self.v
        self.long.extend(p for p in new if len(p) > LONGEST_REMEMBERED)
        self.characters += sum(map(len, new))
        texts = [(" " + p).encode() for p in new]
        # White space at an end (of the whole text, then) would reach into the next part.
        alone = {i for i, p in enumerate(new) if not v.cuts or p[0].isspace() or p[-1].isspace()}
        together = [i for i in range(len(new)) if i not in alone] if alone else list(range(len(new)))
        chunks = [together[i:i + TOGETHER] for i in range(0, len(together), TOGETHER)] + [[i] for i in alone]
        broken = np.ones(len(new), dtype=bool)
        order, found = [], []
        while chunks:
            chunk = chunks.pop()
            ids = self.encode([new[i] for i in chunk], [texts[i] for i in chunk])
            if ids is not None:
                order.extend(chunk)
                found.append(ids)
            elif len(chunk) > 1:
                chunks += [chunk[:len(chunk) // 2], chunk[len(chunk) // 2:]]
        sizes = np.zeros((len(new), 3), dtype=np.int64)
        strings = [""] * len(new)
        lengths = np.zeros(len(new), dtype=np.int64)
        pairs = times = np.zeros(0, dtype=np.int64)
        if order:
            broken[order] = False
            a, b = (np.concatenate(side) for side in zip(*found))
            # All parts in a row: both sides end wherever a part ends, so one pass aligns them all.
            end_a = np.cumsum(v.starts_a[a + 1] - v.starts_a[a])
            end_b = np.cumsum(v.starts_b[b + 1] - v.starts_b[b])
            stops = np.cumsum([len(texts[i]) for i in order])
            common = np.intersect1d(end_a, end_b, assume_unique=True)
            sizes[order] = np.stack([np.diff(np.searchsorted(ends, stops), prepend=-1)
                                     for ends in (end_a, end_b, common)]).T
            for i, text in zip(order, group_strings(a, b, end_a, end_b, common, stops)):
                strings[i] = text
            # Between neighbouring ends of either side lies the overlap of exactly one pair of tokens.
            ends = np.union1d(end_a, end_b)
            rank = np.argsort(np.argsort(order))  # the part's place among the parts in order
            part, pairs, times = by_text(
                rank[np.searchsorted(stops, ends)],
                a[np.searchsorted(end_a, ends)] * v.n_b + b[np.searchsorted(end_b, ends)],
                np.ones(len(ends)), v.n_a * v.n_b)
            lengths[np.sort(order)] = np.bincount(part, minlength=len(order))
        first = len(self.strings)
        self.strings.extend(strings)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.broken = np.concatenate([self.broken, broken])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.times = np.concatenate([self.times, times])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.known.update(zip(new, range(first, first + len(new))))


def group_strings(a, b, end_a, end_b, common, stops) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every part: the tokens of all groups in order, each with the mark behind it."""
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    last_a = common[group_a] == end_a
    last_b = np.where(common[group_b] == end_b, np.where(np.isin(end_b, stops, assume_unique=True), 2, 1), 0)
    pieces = [f"{i}{',|'[m]}" for i, m in zip(a.tolist(), last_a.astype(np.int8).tolist())]
    marks = (",", ";", "")
    pieces += [f"{i}{marks[m]}" for i, m in zip(b.tolist(), last_b.tolist())]
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable").tolist()
    pieces = [pieces[i] for i in order]
    cuts = [0, *(np.searchsorted(end_a, stops) + np.searchsorted(end_b, stops) + 2).tolist()]
    return ["".join(pieces[i:j]) for i, j in zip(cuts, cuts[1:])]


def parts_of(text: str | None, cuts: bool) -> list[str]:
    if not text:
        return []
    return CUT.split(text) if cuts else [text]


def by_text(owner: np.ndarray, values: np.ndarray, weights: np.ndarray, span: int):
    """Equal values of a text added up: owners, values and sums, in order."""
    keys, where = np.unique(owner * span + values, return_inverse=True)
    return keys // span, keys % span, np.bincount(where, weights, len(keys)).astype(np.int64)


def lists(owner: np.ndarray, values: np.ndarray, n: int, kind) -> pa.ListArray:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "same_ids array<int>, same_times array<int>, other_pairs array<long>, other_times array<int>")


def align_block(doc_ids: list, texts: list, parts: Parts) -> pa.RecordBatch:
    """Aligned texts: sizes, digest of the groups, and each text's linked id pairs with their number of links."""
    v = parts.v
    own = [parts_of(t, v.cuts) for t in texts]
    n = len(texts)
    counts = np.array([len(o) for o in own], dtype=np.int64)
    numbers = parts.numbers(list(chain.from_iterable(own)))
    owner = np.repeat(np.arange(n), counts)
    fine = np.bincount(owner, parts.broken[numbers], n) == 0
    sizes = np.stack([np.bincount(owner, parts.sizes[numbers, i], n) for i in range(3)]).astype(np.int64) * fine
    starts = np.cumsum(counts) - counts
    strings, numbered, digests = parts.strings, numbers.tolist(), []
    for i in range(n):
        if fine[i] and counts[i]:
            groups = ";".join(map(strings.__getitem__, numbered[starts[i]:starts[i] + counts[i]]))
            digests.append(hashlib.sha256(groups.encode()).hexdigest())
        else:
            digests.append("")
    kept = fine[owner]
    text, part, often = by_text(owner[kept], numbers[kept], np.ones(int(kept.sum())), max(1, len(strings)))
    pair, at = take(parts.pairs, parts.starts, part)
    weight = take(parts.times, parts.starts, part)[0] * often[at]
    text, pair, weight = by_text(text[at], pair, weight, v.n_a * v.n_b)
    same = v.same[pair // v.n_b] == pair % v.n_b
    parts.tidy()
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.array(sizes[0]), pa.array(sizes[1]), pa.array(sizes[2]),
        pa.array(sizes[0] + sizes[1] - sizes[2]), pa.array(digests, pa.string()),
        lists(text[same], pair[same] // v.n_b, n, pa.int32()), lists(text[same], weight[same], n, pa.int32()),
        lists(text[~same], pair[~same], n, pa.int64()), lists(text[~same], weight[~same], n, pa.int32())],
        names=[c.split()[0] for c in ALIGNED.split(", ")])


def text_blocks(batches, rows: int = 512, characters: int = 1 << 21):
    """Blocks of texts that are bounded in rows and, but for a single long text, in characters."""
    for batch in column_blocks(batches, rows):
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size > characters or i == len(texts) - 1:
                yield ids[start:i + 1], texts[start:i + 1]
                start, size = i + 1, 0


def owners(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the row of each."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A encodes a blank and the text, B the text (it adds the blank); neither adds
    or reads special tokens. Texts that are null or empty, or whose tokens of
    either side do not give back their bytes (one with U+2581, which B writes for
    a blank), have no tokens: zeros and an empty digest. Every row counts as a
    document of its own, whatever its id; null ids stay null. Other columns are
    ignored; an empty table gives no rows. Very long texts are read whole, a
    part at a time.
    """
    path_a = path_a or public_tokenizers.path(VOCABULARY_A)
    path_b = path_b or public_tokenizers.path(VOCABULARY_B)
    here = vocabularies(path_a, path_b)
    n_a, n_b = here.n_a, here.n_b

    def aligned(batches):
        parts = worker_cache(("token_align parts", path_a, path_b), lambda: Parts(vocabularies(path_a, path_b)))
        for ids, texts in text_blocks(batches):
            yield align_block(ids, texts, parts)

    tokens = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(aligned, ALIGNED)
                         .withColumn("row", F.monotonically_increasing_id()), "align")

    def vectors(batches):
        counted = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            counted += np.bincount(ids, minlength=n_a)
        found = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counted[found])], names=["a", "n"])

    def vector(rows: DataFrame) -> np.ndarray:
        """Rows ``a, n`` (at most one for each id of A) as a vector."""
        table, out = rows.toArrow(), np.zeros(n_a, dtype=np.int64)
        out[table["a"].to_numpy()] = table["n"].to_numpy()
        return out

    same = vector(tokens.select("same_ids").mapInArrow(vectors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")))
    others = materialize(tokens.select(F.explode("other_pairs").alias("pair")).groupBy("pair")
                         .agg(F.count(F.lit(1)).alias("n")), "align")
    best = np.maximum(same, vector(others.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("n"))))
    # The most frequent pairs by powers of two: as many as fit into FREQUENT rows.
    level = F.floor(F.log2("n")).cast("int")
    least, held = 63, 0
    for row in others.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > FREQUENT:
            break
        least = row["level"]
    table = others.where(level >= least).orderBy("pair").toArrow()
    often, often_n = table["pair"].to_numpy(), table["n"].to_numpy()

    def looked_up(batches):
        for batch in column_blocks(batches, 4096):
            n = batch.num_rows
            ids, owner = owners(batch.column("same_ids"))
            times = owners(batch.column("same_times"))[0]
            total = np.bincount(owner, times * same[ids], n)
            top = np.bincount(owner, times * (same[ids] == best[ids]), n)
            pairs, owner = owners(batch.column("other_pairs"))
            times = owners(batch.column("other_times"))[0]
            at = np.minimum(np.searchsorted(often, pairs), max(0, len(often) - 1))
            known = often[at] == pairs if len(often) else np.zeros(len(pairs), dtype=bool)
            count = often_n[at[known]]
            total += np.bincount(owner[known], times[known] * count, n)
            top += np.bincount(owner[known], times[known] * (count == best[pairs[known] // n_b]), n)
            rest = ~known
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                + [pa.array(top.astype(np.int64)), pa.array(total.astype(np.int64)),
                   lists(owner[rest], pairs[rest], n, pa.int64()), lists(owner[rest], times[rest], n, pa.int32())],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum",
                       "pairs", "times"])

    found = materialize(tokens.mapInArrow(
        looked_up, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                   "n_best long, count_sum long, pairs array<long>, times array<int>"), "align")
    rare = others.where(level < least)
    tops = found.sparkSession.createDataFrame(pa.table({"a": np.arange(n_a), "top": best}))
    rare = rare.join(F.broadcast(tops), F.expr(f"pair div {n_b}") == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
    rest = (found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
            .join(rare, "pair").groupBy("row")
            .agg(F.sum(F.col("times") * F.col("n")).alias("more"),
                 F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best")))
    return found.drop("pairs", "times").join(rest, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
