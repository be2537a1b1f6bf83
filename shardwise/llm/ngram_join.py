"""N-gram Jaccard join by a blocked sparse matrix product.

The incidence matrix has a row per document and a column per five-word shingle
(a 64-bit hash). It is cut into row blocks (the documents a task reads) and
column blocks (ranges of the hash).

1. Columns. A task sends, for every column block, the shingles of its row
   block, each once. Where the block meets, a shingle that turns up in two row
   blocks is shared; only shared entries go back to their documents. A shingle
   that many documents of a row block hold travels once, so the most common
   shingle of the corpus costs its column block one entry per row block.
2. Rows. A document whose shared shingles are fewer than its size-derived
   bound (80 % of its set) cannot link and is out.
3. Smaller matrix. Rows of equal size and equal shared shingles are one row:
   they link to the same other rows, and to one another if what they share is
   enough. Columns that the same rows hold are one column with a weight, so a
   passage that documents share is one column, however long.
4. Product. In the rows left, columns are ordered by frequency. Of the rarest
   ones, as many as the size-derived bound allows to miss and one more shingle,
   every linked pair has at least one in common. Overlap weights are
   accumulated per pair over these columns; pairs whose sum cannot reach the
   bound that follows from the two sizes are discarded, for the others the sum
   over all columns decides.

Large groups are not expanded into pairs: first every document meets only the
leader of its best column (a star per column), and the links found make
components. Columns whose documents are all in one component are done. Star
rounds go on while they find links and many pairs are left; then the documents
of the unfinished columns meet pairwise across components.

Equal sets are one row from the start (a class). Everything is kept exactly; two
different shingles or sets are taken as equal only if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_blocks, components, materialize, partitions

SHINGLE = 5
PERCENT = 80
ROW_BLOCK_ENTRIES = 1 << 19
ROW_BLOCK_DOCS = 60_000
COLUMN_BLOCK_ENTRIES = 1 << 20
PAIRS_PER_ENTRY = 4

DOC, SHARED, COLUMNS = 0, 1, 2
LOCAL = 65_535  # place of an entry that several documents of its row block hold

ROWS = ("at int, kind int, doc_id long, n long, class long, block long, idx int, payload binary, digest long")


# ----------------------------------------------------------------- shingles

class WordHash(dict):
    """Word to 64-bit hash; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = value
        return value


# Odd multipliers, one per place of a shingle.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(PLACES[0])
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text (A-Z lower-cased, ASCII blanks).

    Fewer than five words: the whole sequence is one shingle; no word: none.
    """
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if len(w) < SHINGLE:
        h = np.array([len(w)], dtype=np.uint64)
        for k in range(len(w)):
            h = mixed(h + w[k:k + 1] * np.uint64(PLACES[k]))
        return h
    n = len(w) - SHINGLE + 1
    h = w[:n] * np.uint64(PLACES[0])
    for k in range(1, SHINGLE):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(PLACES[k]) + w[k:n + k]
    return np.unique(mixed(h))


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


# ------------------------------------------------------------------- blocks

def row_block(docs: list[tuple[int | None, int, np.ndarray]], blocks: int) -> pa.RecordBatch:
    """Rows of one row block: its documents, locally shared entries, and column pieces."""
    names = [class_of(h) if len(h) else 0 for _, _, h in docs]
    place: dict[int, int] = {}
    for (_, _, h), name in zip(docs, names):
        if len(h):
            place.setdefault(name, len(place))
    sets: list = [None] * len(place)
    for (_, _, h), name in zip(docs, names):
        if len(h):
            sets[place[name]] = h
    block = int(np.uint64(xxhash.xxh3_64_intdigest(
        np.array([d if d is not None else -1 for d, _, _ in docs] + names, dtype=np.int64).tobytes())).astype(np.int64))
    out: dict[str, list] = {k: [] for k in ("at", "kind", "doc_id", "n", "class", "block", "idx", "payload", "digest")}

    def row(at, kind, doc_id=None, n=None, name=None, idx=None, payload=None, digest=None):
        for k, v in zip(out, (at, kind, doc_id, n, name, block, idx, payload, digest)):
            out[k].append(v)

    for i, ((doc_id, digest, h), name) in enumerate(zip(docs, names)):
        row((i + block) % blocks, DOC, doc_id, len(h), name if len(h) else None, place.get(name) if len(h) else None,
            digest=digest)
    if sets:
        sizes = np.array([len(s) for s in sets])
        h = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(first, len(h)))
        several = np.repeat(count > 1, count)
        # Entries shared within the row block are known to be so.
        if several.any():
            row(block % blocks, SHARED, payload=packed(h[several], own[several]))
        # The columns: every shingle once, with its document when there is only one.
        places = np.where(count > 1, LOCAL, own[first]).astype(np.uint16)
        columns = h[first]
        edges = np.searchsorted(column_of(columns, blocks), np.arange(blocks + 1))
        for c in range(blocks):
            a, b = edges[c], edges[c + 1]
            if a < b:
                row(c, COLUMNS, payload=packed(columns[a:b], places[a:b]))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
             pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def column_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Column block of a hash: equal ranges of its upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def packed(h: np.ndarray, places: np.ndarray) -> bytes:
    """Entries in hash order as bytes: the hashes' gaps, byte plane by byte plane, then the places.

    Gaps of many sorted hashes are small, so their upper planes are almost only
    zeros, which Spark's own compression takes out of shuffles and tables.
    """
    gaps = np.diff(h, prepend=np.uint64(0)).astype(np.uint64, copy=False)
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + places.astype(np.uint16).tobytes()


def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of :func:`packed`."""
    n = len(payload) // 10
    planes = np.frombuffer(payload, dtype=np.uint8, count=8 * n).reshape(8, n)
    h = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    return h, np.frombuffer(payload, dtype=np.uint16, offset=8 * n)


def shared_entries(pieces: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """For every row block ``(block, entries)``: its entries of a column block that another one holds too."""
    sizes = [len(payload) // 10 for _, payload in pieces]
    names = [name for name, _ in pieces]
    h, place = np.empty(sum(sizes), dtype=np.uint64), np.empty(sum(sizes), dtype=np.uint16)
    at = len(h)
    for n in reversed(sizes):  # a piece is let go as soon as its entries are copied
        at -= n
        h[at:at + n], place[at:at + n] = unpacked(pieces.pop()[1])
    block = np.repeat(np.arange(len(names), dtype=np.int32), sizes)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    keep &= place[order] != LOCAL
    h, order = h[keep], order[keep]
    place, block = place[order], block[order]
    order = np.argsort(block, kind="stable")
    ends = np.searchsorted(block[order], np.arange(len(names) + 1))
    for i, name in enumerate(names):
        own = order[ends[i]:ends[i + 1]]
        if len(own):
            yield name, packed(h[own], place[own])


def block_sets(docs: dict[int, tuple[int, int]], pieces: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(class, n, shared hashes)`` of the sets of a row block that share enough to link at all.

    ``docs`` has class and size by place; ``pieces`` are entries with their places.
    """
    if not pieces:
        return
    entries = [unpacked(p) for p in pieces]
    h = np.concatenate([e[0] for e in entries]).view(np.int64)
    place = np.concatenate([e[1] for e in entries])
    order = np.lexsort((h, place))
    h, place = h[order], place[order]
    ends = np.searchsorted(place, np.arange(len(docs) + 1))
    for idx, (name, n) in docs.items():
        own = np.unique(h[ends[idx]:ends[idx + 1]])
        if len(own) * 100 >= n * PERCENT:
            yield name, n, own


def incidence(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Documents with their set sizes and classes, and the shared entries of every set."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"),
                      F.xxhash64(text).alias("digest"))
    letters = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six letters a word; every column block gets a bounded number of entries.
    blocks = max(partitions(spark), -(-letters // (6 * COLUMN_BLOCK_ENTRIES)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, entries = WordHash(), [], 0
        for block in column_blocks(batches):
            for doc_id, text_, digest in zip(*(c.to_pylist() for c in block.columns)):
                h = shingles(text_, words)
                held.append((doc_id, digest, h))
                entries += len(h)
                if entries >= ROW_BLOCK_ENTRIES or len(held) >= ROW_BLOCK_DOCS:
                    yield row_block(held, blocks)
                    held, entries = [], 0
        words.clear()
        if held:
            yield row_block(held, blocks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            kind = batch.column(1).to_numpy()
            yield batch.filter(pa.array(kind != COLUMNS))
            part = batch.filter(pa.array(kind == COLUMNS))
            for at, block, payload in zip(part.column(0).to_pylist(), part.column(5).to_pylist(),
                                          part.column(7).to_pylist()):
                pieces.setdefault(at, []).append((block, payload))
        for at in list(pieces):
            found = list(shared_entries(pieces.pop(at)))
            none, no_place = pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), at), pa.int32()), pa.array(np.full(len(found), SHARED), pa.int32()),
                 none, none, none, pa.array([f[0] for f in found], pa.int64()),
                 no_place, pa.array([f[1] for f in found], pa.binary()), none],
                names=["at", "kind", "doc_id", "n", "class", "block", "idx", "payload", "digest"])

    return materialize(src.mapInArrow(cut, ROWS).repartitionById(blocks, "at").mapInArrow(meet, ROWS)
                       .drop("at"), "ngram-shared")


def needed(n: str) -> Column:
    """Least overlap of a set of ``n`` with anything it links to."""
    return F.expr(f"({n} * {PERCENT} + 99) div 100")


def needed_by_larger(n: str) -> Column:
    """Least overlap of a set of ``n`` with a set of as many or more that it links to."""
    return F.expr(f"({n} * {2 * PERCENT} + {99 + PERCENT}) div {100 + PERCENT}")


def needed_by_both(x: str, y: str) -> Column:
    """Least overlap of linked sets of ``x`` and ``y``."""
    return F.expr(f"(({x} + {y}) * {PERCENT} + {99 + PERCENT}) div {100 + PERCENT}")


def candidates(rows: DataFrame) -> DataFrame:
    """``class, n, k, row, hashes``: the sets with enough (``k``) shared entries to link at all.

    ``row`` names sets of equal size and equal shared entries.
    """
    parts = rows.where((F.col("kind") == SHARED) | F.col("class").isNotNull()).select(
        "kind", "n", "class", "block", "idx", "payload")

    def whole(table: pa.Table) -> pa.Table:
        docs = table.filter(pa.array(table["kind"].to_numpy() == DOC))
        shared = table.filter(pa.array(table["kind"].to_numpy() == SHARED))
        by_place = {i: (c, n) for i, c, n in zip(docs["idx"].to_pylist(), docs["class"].to_pylist(),
                                                 docs["n"].to_pylist())}
        found = list(block_sets(by_place, shared["payload"].to_pylist()))
        return pa.table({"class": pa.array([f[0] for f in found], pa.int64()),
                         "n": pa.array([f[1] for f in found], pa.int64()),
                         "hashes": pa.array([f[2] for f in found], pa.list_(pa.int64()))})

    # A row block comes together again, bounded as it was when it was read. A class that
    # several row blocks hold has all its entries shared, so any of its rows is whole.
    found = parts.groupBy("block").applyInArrow(whole, "class long, n long, hashes array<long>")
    return materialize(found.select("class", "n", F.size("hashes").cast("long").alias("k"),
                                    F.xxhash64("n", "hashes").alias("row"), "hashes"), "ngram-sets")


def weighted_columns(sets: DataFrame) -> DataFrame:
    """``row, n, c, df, w``: the smaller matrix, ``w`` shingles in a column ``c`` that ``df`` rows hold."""
    rows = sets.groupBy("row").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))
    entries = rows.select("row", "n", F.explode("hashes").alias("h"))
    held = entries.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("row")).alias("x1"),
                                    F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("x2")).where("df > 1")
    held = held.select("h", "df", F.xxhash64("df", "x1", "x2").alias("c"))
    return materialize(entries.join(held, "h").groupBy("row", "n", "c", "df").agg(F.count(F.lit(1)).alias("w")),
                       "ngram-columns")


def prefixes(columns: DataFrame) -> DataFrame:
    """``class, n, k, pos, front, h, w``: of every row the rarest columns, one shingle more than it may miss.

    ``k`` counts the shingles it shares with any other row, ``pos`` those before
    the column in the common order. The ``front`` columns are those it needs when
    the other row is as large or larger, which then has to share more of it.
    """
    own = Window.partitionBy("row")
    before = own.orderBy("df", "c").rowsBetween(Window.unboundedPreceding, -1)
    ordered = columns.withColumn("k", F.sum("w").over(own)).withColumn(
        "pos", F.coalesce(F.sum("w").over(before), F.lit(0)))
    return materialize(
        ordered.where(F.col("pos") < F.col("k") - needed("n") + 1)
        .select(F.col("row").alias("class"), "n", "k", "pos",
                (F.col("pos") <= F.col("k") - needed_by_larger("n")).alias("front"), F.col("c").alias("h"), "w"),
        "ngram-prefix")


def row_columns(columns: DataFrame) -> DataFrame:
    """``row, n, held``: a row's columns in one array, each as its name and its weight."""
    # All rows that hold a column hold all its shingles, so equal columns have equal weights.
    return materialize(columns.groupBy("row", "n").agg(F.collect_list(F.concat(
        F.hex("c"), F.lit(":"), F.col("w").cast("string"))).alias("held")), "ngram-rows")


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of rows whose overlap over all columns reaches the similarity."""
    left = rows.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("held").alias("ha"))
    right = rows.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("held").alias("hb"))
    common = F.aggregate(F.array_intersect("ha", "hb"), F.lit(0).cast("long"),
                         lambda total, x: total + F.substring_index(x, ":", -1).cast("long"))
    return materialize(
        pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("o", common)
        .where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * PERCENT).select("a", "b"), "ngram-links")


def class_links(matrix: DataFrame) -> DataFrame:
    """``id, component`` for the rows of the smaller matrix that link to another one."""
    columns, rows = prefixes(matrix), row_columns(matrix)
    entries = columns.count()
    links = None
    labels = None
    turn, progress, before = 0, True, float("inf")
    while True:
        turn += 1
        now = columns if labels is None else columns.join(labels, columns["class"] == labels["id"], "left").drop("id")
        now = now.withColumn("comp", F.col("class") if labels is None else F.coalesce("component", "class"))
        # First the set that shares most of itself leads (of edited copies the least edited), later any.
        lonely = -F.col("k") / F.col("n") if turn == 1 else F.lit(0.0)
        leads = (now.groupBy("h").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"),
            F.min(F.struct(lonely.alias("r"), F.xxhash64("class", F.lit(turn)).alias("x"),
                           F.col("class").alias("lead"), F.col("n").alias("lead_n"), F.col("k").alias("lead_k"),
                           F.col("comp").alias("lead_comp"))).alias("l"))
            .where("lo <> hi").select("h", "m", "l.lead", "l.lead_n", "l.lead_k", "l.lead_comp"))
        leads = materialize(leads, "ngram-leads")
        open_pairs = leads.agg(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2)).first()[0]
        if open_pairs is None:
            break
        # Another star round pays while links come and the pairs left shrink well.
        last = turn > 1 and (open_pairs <= PAIRS_PER_ENTRY * max(entries, 1) or not progress
                             or open_pairs > 0.7 * before)
        before = open_pairs
        members = now.join(leads, "h")
        if not last:
            met = (members.where((F.col("comp") != F.col("lead_comp")) &
                                 (F.least("k", "lead_k") >= needed_by_both("n", "lead_n")))
                   .groupBy("class", "lead").agg(F.sum("w").alias("c")))
            best = Window.partitionBy("class").orderBy(F.desc("c"), "lead")
            pairs = met.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(
                F.col("class").alias("a"), F.col("lead").alias("b"))
        else:
            x = members.where("front").select("h", "w", F.col("class").alias("a"), F.col("n").alias("na"),
                                              F.col("k").alias("ka"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
            y = members.select("h", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"),
                               F.col("pos").alias("pb"), F.col("comp").alias("cb"))
            bound = needed_by_both("na", "nb")
            # Before and behind a common entry no more can be common than the shorter side has.
            reach = F.least("pa", "pb") + F.least(F.col("ka") - F.col("pa"), F.col("kb") - F.col("pb"))
            smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
            # Accumulated overlap in the prefixes; what lies behind the shorter one adds less than its need.
            behind = F.greatest(needed_by_larger("na"), needed("nb")) - 1
            pairs = (x.join(y, "h").where(smaller & (F.col("ca") != F.col("cb")) & (reach >= bound))
                     .groupBy("a", "b", "na", "nb").agg(F.sum("w").alias("c"))
                     .where(F.col("c") + behind >= bound))
        new = linked(pairs, rows)
        progress = new.count() > 0
        if progress:
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        if last:
            break
    return labels if labels is not None else matrix.select(
        F.col("row").alias("id"), F.col("row").alias("component")).where(F.lit(False))


def grouped(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``doc_id, digest, n, class, component`` of every row; ``component`` names what links reach (null: no shingles)."""
    rows = incidence(docs, text, id_col)
    sets = candidates(rows)
    labels = class_links(weighted_columns(sets)).select(F.col("id").alias("row"), F.col("component").alias("reached"))
    # Classes of one row of the smaller matrix have the same links, and link to one another if they share enough.
    alike = F.col("k") * 100 >= (2 * F.col("n") - F.col("k")) * PERCENT
    members = (sets.select("class", "n", "k", "row").distinct().join(labels, "row", "left")
               .select("class", F.coalesce("reached", F.when(alike, F.col("row"))).alias("reached")))
    documents = rows.where(F.col("kind") == DOC).select("doc_id", "digest", "n", "class")
    return documents.join(members, "class", "left").select(
        "doc_id", "digest", "n", "class", F.coalesce("reached", "class").alias("component"))


def join_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Documents link when the Jaccard similarity of their shingle sets is at least
    0.8; ``component_id`` is the smallest id reachable by links, itself
    included. Null, empty and blank texts have no shingles and link with
    nothing. Rows that repeat an id are reported each; a row with a null id
    takes part and is named by the smallest id it reaches, if any. Empty input
    gives no rows.
    """
    documents = grouped(docs, text, id_col)
    lowest = documents.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return documents.join(lowest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of every group stays.

    It is the row of smallest id, null ids last, and of equal ids the one of
    smallest text digest; of rows equal in id and text any. Rows are decided one
    by one: different texts under one id are different documents. Rows without
    words are in no group and stay. Columns of any name come through.
    """
    rows = materialize(grouped(docs, "text", "doc_id").where("n > 0"), "ngram-groups")
    leader = rows.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("l"))
    of_text = rows.groupBy("doc_id", "digest", "component").agg(F.count(F.lit(1)).alias("copies"))
    first = F.col("doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("digest") == F.col("l.digest"))
    # Most documents are alone and need no mention.
    named = materialize(
        of_text.join(leader, "component").where(~first | (F.col("copies") > 1))
        .select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"), first.alias("leads")),
        "ngram-decisions")
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"),
                        F.col("doc_id").cast("long").alias("id_"), F.xxhash64("text").alias("digest_"))
    decided = found.join(named, F.col("id_").eqNullSafe(F.col("gone_id")) & (F.col("digest_") == F.col("gone_digest")),
                         "left")
    alone = decided.where(F.col("leads").isNull()).select("given.*")
    repeated = decided.where("leads").dropDuplicates(["id_", "digest_"]).select("given.*")
    return alone.unionByName(repeated)
