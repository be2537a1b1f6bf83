"""Language ID by hyperdimensional profiles.

Every letter gets a random vector of +1 and -1 (drawn from its code point, so it
is the same everywhere). A letter trigram is bound by multiplying the permuted
letter vectors, ``roll(a, 2) * roll(b, 1) * c``; a text is the bundle (sum) of
its trigram vectors; a language prototype is the bundle of the normalised
vectors of its training texts. A text gets the language whose prototype has the
largest cosine.

Training uses about ``TRAIN_ROWS`` rows of each language (all of a rarer one; the
smallest digests of doc_id and text, so a repeat of the run picks the same, and
rows equal in both once); every document is scored over its whole text. Sums are
taken in integers, so their order does not matter.

The cosine of unrelated texts has a spread of 1 / sqrt(DIMS), and that of a short
clean text may be smaller. So what counts as a known language is decided without
it, by exact trigrams: of a text's trigrams at least ``KNOWN_SHARE`` must be known,
that is, be in one of ``KNOWN_ROWS`` training rows of some language (at least one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_rows, column_blocks, free_worker_cache, materialize, row_place, whole_row

DIMS = 512
TRAIN_ROWS = 20_000
KNOWN_SHARE = 0.5
KNOWN_ROWS = 10_000
SEED = 20
SCALE = 1_000_000
ROWS = 512  # texts that a worker is handed at a time
GRAMS = 8192  # trigram vectors that it holds at a time


class Letters:
    """Letter classes and letter vectors, filled as code points turn up."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims = dims
        self.seed = seed
        self.known: dict[int, np.ndarray] = {}
        self.kind = np.full(0x110000, 2, dtype=np.uint8)  # 2: not looked at yet

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """The code points with every run of other characters as one space, spaces at both ends."""
        kind = self.kind[codes]
        if (kind == 2).any():
            for c in np.unique(codes[kind == 2]):
                self.kind[c] = chr(int(c)).isalpha()
            kind = self.kind[codes]
        is_letter = kind == 1
        if not is_letter.any():
            return codes[:0]
        out = np.where(is_letter, codes, 32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        out = out[keep]
        lead = [32] if out[0] != 32 else []
        tail = [32] if out[-1] != 32 else []
        return np.concatenate([np.array(lead, out.dtype), out, np.array(tail, out.dtype)])

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(codes, return_inverse=True)
        rows = []
        for c in uniq:
            c = int(c)
            if c not in self.known:
                bits = np.random.default_rng([self.seed, c]).integers(0, 2, self.dims, dtype=np.int8)
                self.known[c] = bits * 2 - 1
            rows.append(self.known[c])
        return np.stack(rows)[back]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigram codes (three code points of 21 bits each)."""
        a, b, c = (grams >> 42), (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF
        out = np.roll(self.vectors(a), 2, axis=1)
        out *= np.roll(self.vectors(b), 1, axis=1)
        out *= self.vectors(c)
        return out


def trigrams(text: str, letters: Letters):
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(codes):
        return None
    seq = letters.letters(codes)
    if not len(seq):
        return None
    grams = (seq[:-2] << 42) | (seq[1:-1] << 21) | seq[2:]
    return np.unique(grams, return_counts=True)


def text_trigrams(texts: list, letters: Letters) -> list:
    """The trigrams of every text and their counts, None without letters."""
    return [trigrams(t, letters) if t else None for t in texts]


def text_vectors(texts: list, letters: Letters) -> list:
    """The bundle of every text, None without letters."""
    return bundles(text_trigrams(texts, letters), letters)


def bundles(found: list, letters: Letters) -> list:
    have = [f[0] for f in found if f is not None]
    if not have:
        return [None] * len(found)
    grams = np.unique(np.concatenate(have))
    out = [None if f is None else np.zeros(letters.dims, np.float32) for f in found]
    table = np.empty((min(GRAMS, len(grams)), letters.dims), dtype=np.float32)
    for s in range(0, len(grams), GRAMS):
        part = grams[s:s + GRAMS]
        for k in range(0, len(part), 2048):
            table[k:min(k + 2048, len(part))] = letters.bound(part[k:k + 2048])
        for f, vec in zip(found, out):
            if f is not None:
                lo, hi = np.searchsorted(f[0], part[0]), np.searchsorted(f[0], part[-1], "right")
                # A text's own trigrams may fill more than one table: they are taken a table at a time.
                vec += f[1][lo:hi].astype(np.float32) @ table[np.searchsorted(part, f[0][lo:hi])]
    return out


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
                    rows: int = TRAIN_ROWS) -> DataFrame:
    """``lang, text`` of about ``rows`` labelled rows of each language, all of a rarer one.

    Rows with a null label or text are left out. Rows equal in label, id and text
    count once in a language that is sampled.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
        (F.col(id_col) if id_col in docs.columns else F.lit(None).cast("string")).alias("id"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    many = {name: n for name, n in counts.items() if n > rows}
    if not many:
        return labelled.select("lang", "text")
    # A digest of the row picks the rows, so reruns agree.
    cut = F.create_map(*[F.lit(v) for name, n in sorted(many.items()) for v in (name, int((1 << 20) * rows / n))])
    cut = F.element_at(cut, F.col("lang"))
    drawn = labelled.where(F.col("lang").isin(*many)).where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < cut)
    return labelled.where(~F.col("lang").isin(*many)).select("lang", "text").unionByName(
        drawn.dropDuplicates(["lang", "id", "text"]).select("lang", "text"))


def known_trigrams(sample: DataFrame) -> np.ndarray:
    """The trigrams in at least one of ``KNOWN_ROWS`` rows of a language of ``sample``, sorted.

    At most ``KNOWN_ROWS`` times the mean number of trigrams in a row, for each
    language; the letters of a language make it far fewer.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        letters, seen = Letters(1), {}
        for block in column_blocks(batches, 256):
            found = text_trigrams(block.column(1).to_pylist(), letters)
            by = {}
            for name, f in zip(block.column(0).to_pylist(), found):
                if f is not None:
                    by.setdefault(name, []).append(f[0])
            for name, grams in by.items():
                old, n = seen.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                uniq, back = np.unique(np.concatenate([old, *grams]), return_inverse=True)
                weight = np.concatenate([n, np.ones(sum(map(len, grams)), np.int64)])
                seen[name] = uniq, np.bincount(back, weight, len(uniq)).astype(np.int64)
        for name, (grams, n) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                names=["lang", "gram", "n"])

    least = {r["lang"]: -(-r["count"] // KNOWN_ROWS) for r in sample.groupBy("lang").count().collect()}
    if not least:
        return np.zeros(0, np.int64)
    least = F.element_at(F.create_map(*[F.lit(v) for kv in sorted(least.items()) for v in kv]), F.col("lang"))
    with arrow_rows(sample.sparkSession, ROWS):
        grams = (sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram")
                 .agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("gram").distinct().toArrow())
    return np.sort(grams.column(0).to_numpy())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS,
          dims: int = DIMS, id_col: str = "doc_id") -> list[tuple[str, list[float]]]:
    """Prototypes ``(language, vector)`` from the labelled rows of ``docs``.

    The rows are those of ``training_sample``. The result has one vector per
    language (bounded by the label set). Empty input gives no prototypes.
    """
    return prototypes_of(training_sample(docs, text, lang, id_col, rows), dims)


def prototypes_of(labelled: DataFrame, dims: int = DIMS) -> list[tuple[str, list[float]]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        letters, sums = Letters(dims), {}
        for block in column_blocks(batches, 256):
            langs = block.column(0).to_pylist()
            for name, vec in zip(langs, text_vectors(block.column(1).to_pylist(), letters)):
                if vec is not None:
                    unit = np.rint(vec / np.linalg.norm(vec) * SCALE).astype(np.int64)
                    sums[name] = sums[name] + unit if name in sums else unit
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n in names for _ in range(dims)], pa.string()),
             pa.array(list(range(dims)) * len(names), pa.int32()),
             pa.array(np.concatenate([sums[n] for n in names]) if names else [], pa.int64())],
            names=["lang", "dim", "value"])

    with arrow_rows(labelled.sparkSession, ROWS):
        total = (labelled.mapInArrow(partial, "lang string, dim int, value long")
                 .groupBy("lang", "dim").agg(F.sum("value").alias("value"))
                 .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))),
                                                  lambda x: x["value"].cast("double")).alias("vector"))
                 .orderBy("lang").collect())
    return [(r["lang"], list(r["vector"])) for r in total]


def known_share(found, known: np.ndarray) -> float:
    if not len(known):
        return 0.0
    at = np.minimum(np.searchsorted(known, found[0]), len(known) - 1)
    return float(found[1][known[at] == found[0]].sum() / found[1].sum())


def predict(docs: DataFrame, prototypes: list, text: str = "text", pred: str = "lang_pred",
            score: str = "score", dims: int = DIMS, known: np.ndarray | None = None,
            share: str = "share") -> DataFrame:
    """Every column of ``docs`` plus the predicted language and its cosine in [0, 1].

    With ``known`` (sorted trigrams) also the share of a text's trigrams that are
    among them, 0 without a letter.

    Null texts, texts without a letter, and all texts when nothing was learned,
    get ``und`` and 0. Columns of ``docs`` with the output names are replaced.
    Ties go to the first language by code point.
    """
    names = [n for n, _ in prototypes]
    protos = np.array([v for _, v in prototypes], dtype=np.float64).reshape(len(names), dims)
    if len(names):
        norms = np.linalg.norm(protos, axis=1, keepdims=True)
        protos = protos / np.where(norms == 0, 1, norms)
    added = [pred, score] + ([share] if known is not None else [])
    keep = [c for c in docs.columns if c not in added]
    src = docs.select(*keep)
    schema = StructType([*src.schema.fields, StructField(pred, StringType()),
                         *[StructField(c, DoubleType()) for c in added[1:]]])
    at = keep.index(text)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_cache()
        letters = Letters(dims)
        for block in column_blocks(batches, 256):
            langs, scores = [], []
            found = text_trigrams(block.column(at).to_pylist(), letters)
            for vec in bundles(found, letters):
                norm = 0.0 if vec is None else float(np.linalg.norm(vec))
                if not names or norm == 0.0:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cos = protos @ (vec.astype(np.float64) / norm)
                    best = int(np.argmax(cos))
                    langs.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cos[best]))))
            extra = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if known is not None:
                extra.append(pa.array([0.0 if f is None else known_share(f, known) for f in found], pa.float64()))
            yield pa.RecordBatch.from_arrays([*block.columns, *extra], names=[*keep, *added])

    return src.mapInArrow(score_batches, schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, equal to 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train_documents(docs: DataFrame) -> list:
    return train(docs.where(~held_out(F.col("doc_id"))))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of a documents table."""
    scored = predict(docs.select("doc_id", "text"), train_documents(docs))
    scored = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
    with arrow_rows(docs.sparkSession, ROWS):
        return materialize(scored, "languages")


def keep_identified(docs: DataFrame, share: float = KNOWN_SHARE) -> DataFrame:
    """The rows of ``docs`` in a known language: ``und`` and texts of whose
    trigrams less than ``share`` are known go. Columns of any name come through.

    The places of the rows that go are written here, while workers are handed
    ``ROWS`` rows at a time: whoever runs a plan later does so with the session's batches.
    """
    docs, path, index = row_place(docs)
    sample = training_sample(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select(path.alias("path"), index.alias("index"), "text")
    scored = predict(rows, prototypes_of(sample), known=known_trigrams(sample))
    gone = scored.where((F.col("lang_pred") == "und") | (F.col("share") < share)).select("path", "index")
    with arrow_rows(docs.sparkSession, ROWS):
        gone = materialize(gone, "unidentified")
    given = docs.select(whole_row(docs).alias("given"), path.alias("path"), index.alias("index"))
    return given.join(gone, ["path", "index"], "left_anti").select("given.*")
