"""Language identification by averaged hashed subword embeddings and a linear softmax.

Texts become byte n-grams (lower case, everything that is no letter one space), hashed to rows of
an embedding table; the average row goes through a linear layer. Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. A part of the sample that is not
trained on sets the temperature of the softmax and the confidence below which a text is rejected.
Prediction reads whole texts: the product of table and layer is taken once, so that a text costs
one lookup and one sum for each n-gram. The product is rounded to multiples of 2^-16, whose sums
are exact, so what is told of a text doesn't depend on the texts beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_chunks
from .workers import let_go, small_batches

_U = np.uint32


@dataclass(frozen=True)
class LangOptions:
    """about per_language rows of each language are sampled, fewer where max_rows in all would be exceeded; a window of
    train_chars characters at a hashed place of each is trained on; rejected is the share of the calibration rows below
    the bound, which is at most a quarter of the way from 1 / languages to 1."""

    per_language: int = 800
    max_rows: int = 16_000
    train_chars: int = 1500
    sizes: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 15
    dimensions: int = 12
    epochs: int = 4
    rate: float = 0.5
    rejected: float = 0.001
    seed: int = 7


# Bytes that carry letters: ASCII letters in lower case, and all bytes of longer sequences.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; non-letters of ASCII become spaces."""
    out = _FOLD[raw]
    if len(raw) > 1:
        # Capitals of Latin-1 in UTF-8: C3 80..9E, without the multiplication sign.
        capital = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)
        out[1:] += capital.astype(np.uint8) * 0x20
    return out


def ngrams(folded: np.ndarray, o: LangOptions) -> list[np.ndarray]:
    """For each size the bucket of the n-gram at each position; runs of spaces are left as they are."""
    out = []
    f = folded.astype(_U)
    for size in o.sizes:
        n = len(f) - size + 1
        if n <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(n, 0x9E3779B1 ^ size, dtype=_U)
        for k in range(size):
            h = (h ^ f[k : n + k]) * _U(0x01000193)
            h ^= h >> _U(15)
        out.append(((h * _U(0x85EBCA6B)) >> _U(12)).astype(np.int64) % o.buckets)
    return out


@dataclass
class LangModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times the layer
    bias: np.ndarray
    temperature: float
    bound: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str, o: LangOptions) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams and how often each occurs, as small as they can be."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    ids, counts = np.unique(np.concatenate(ngrams(fold(raw), o)), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def train(texts: list[str], labels: list[str], o: LangOptions) -> LangModel:
    """Fit on all but every fifth text, calibrate on these, whole and in short pieces."""
    languages = sorted(set(labels))
    if not languages:
        return LangModel([], np.zeros((o.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    place = {x: i for i, x in enumerate(languages)}
    # Short texts are learned from short pieces.
    bags = [_bag(t, o) for t in texts] + [_bag(t[:40], o) for t in texts]
    y = np.array([place[x] for x in labels] * 2)
    rng = np.random.default_rng(o.seed)
    emb = rng.normal(0, 1 / o.dimensions, (o.buckets, o.dimensions))
    layer = np.zeros((o.dimensions, len(languages)))
    bias = np.zeros(len(languages))
    at = np.arange(len(bags)) % len(texts)
    full = np.array([len(ids) > 0 for ids, _ in bags])
    for epoch in range(o.epochs):
        rate = o.rate * (1 - epoch / o.epochs)
        for i in rng.permutation(np.flatnonzero(full & (at % 5 > 0))):
            ids, counts = bags[i]
            part = counts / counts.sum()
            mean = part @ emb[ids]
            g = _softmax(mean @ layer + bias)
            g[y[i]] -= 1
            back = layer @ g
            layer -= rate * np.outer(mean, g)
            bias -= rate * g
            # Averaging divides the gradient of each row; the step is scaled back up.
            emb[ids] -= rate * len(ids) * 0.1 * np.outer(part, back)
    table = (np.rint((emb @ layer) * 65536) / 65536).astype(np.float32)
    held = np.flatnonzero(full & (at % 5 == 0))
    model = LangModel(languages, table, bias.astype(np.float32), 1.0, 0.0)
    if len(held):
        logits = np.array([bags[i][1] @ table[bags[i][0]] / bags[i][1].sum() + bias for i in held])
        grid = np.geomspace(0.3, 5, 40)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-9).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        sure = _softmax(logits / model.temperature).max(axis=1)
        most = 1 / len(languages) + 0.25 * (1 - 1 / len(languages))
        model.bound = float(min(most, np.quantile(sure, o.rejected) * 0.999))
    return model


def fit(docs: DataFrame, options: LangOptions | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Train on a bounded sample of the rows whose language isn't null and whose text has a letter.

    Every language that occurs is learned. What comes to the driver is a count for each language and at most
    max_rows windows of train_chars characters (a window for each language, if there are more languages than that).
    """
    o = options or LangOptions()
    text, lang = F.col(text_col), F.col(lang_col)
    labelled = docs.where(lang.isNotNull() & text.rlike(r"\p{L}"))
    counts = labelled.groupBy(lang.alias("lang")).count().orderBy("lang").collect()
    if not counts:
        return train([], [], o)
    each = max(1, min(o.per_language, o.max_rows // len(counts)))
    # The rows with the smallest hashes are taken: a bound on the hash leaves few more than are needed, in one pass.
    spot = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(o.seed)), F.lit(1 << 30))
    share = lambda n: min(1.0, (1.25 * each + 12) / n)
    bounds = docs.sparkSession.createDataFrame([(c["lang"], int(share(c["count"]) * (1 << 30)) + 1) for c in counts], "named string, bound long")
    start = F.pmod(F.xxhash64(spot), F.greatest(F.length(text) - o.train_chars + 1, F.lit(1))) + 1
    rows = labelled.select(lang.alias("lang"), spot.alias("spot"), F.substring(text, start.cast("int"), F.lit(o.train_chars)).alias("window"))
    picked = rows.join(F.broadcast(bounds), (F.col("lang") == F.col("named")) & (F.col("spot") < F.col("bound"))).select("spot", "window", "lang")
    sample: list[tuple[str, str]] = []
    seen: dict[str, int] = {}
    for _, window, name in sorted(map(tuple, picked.collect())):
        seen[name] = seen.get(name, 0) + 1
        if seen[name] <= each:
            sample.append((window, name))
    return train([t for t, _ in sample], [x for _, x in sample], o)


def _add_rows(sums: np.ndarray, table: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> None:
    """Add the table's rows ids to the sums of their ascending owners, a few million numbers at a time."""
    step = max(1024, (1 << 21) // max(1, table.shape[1]))
    for s in range(0, len(ids), step):
        own = owner[s : s + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[first]] += np.add.reduceat(table[ids[s : s + step]], first, axis=0, dtype=np.float64)


def predict(docs: DataFrame, model: LangModel, options: LangOptions | None = None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected.

    lang_pred is a learned language, or `und` with score 0 where the text is null or has no letter,
    or nothing was learned; score is the calibrated probability. rejected is true for `und` and for
    scores under the model's bound. Texts are read whole; every row gives one row, repeated rows
    too; other columns stay, except that columns under the three names are replaced.
    """
    o = options or LangOptions()
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    # Columns go by their places inside, as not every name can be called there.
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    text = f"c{kept.index(text_col)}"
    inside = plain.withColumn("letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    small_batches(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(model)
    at = inside.columns.index(text)

    def run(batches):
        let_go()
        m = tables.value
        names = np.array([*m.languages, "und"])
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            best = np.full(batch.num_rows, len(m.languages))
            score = np.zeros(batch.num_rows)
            for first, raw, offsets in text_chunks(batch.column(at)) if m.languages else ():
                rows = slice(first, first + len(offsets) - 1)
                sums = np.zeros((len(offsets) - 1, len(m.languages)))
                total = np.zeros(len(offsets) - 1)
                for size, ids in zip(o.sizes, ngrams(fold(raw), o), strict=True):
                    # n-grams that reach into the next text don't count.
                    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(ids)]
                    inner = np.flatnonzero(np.arange(len(ids)) + size <= offsets[owner + 1])
                    total += np.bincount(owner[inner], minlength=len(total))
                    _add_rows(sums, m.table, ids[inner], owner[inner])
                z = sums / np.maximum(total, 1)[:, None] + m.bias
                p = _softmax(z / m.temperature)
                best[rows], score[rows] = p.argmax(axis=1), p.max(axis=1)
            best[~letters], score[~letters] = len(m.languages), 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score), pa.array((best == len(m.languages)) | (score < m.bound))],
                [*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
            )

    schema = plain.schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return inside.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score", "rejected")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4; null ids are not."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 4 == 2, F.lit(False))
