"""Quality classifier: support vectors on n-gram indicators scaled by class log-count ratios."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bytescan import blocks, words
from .dedup_exact import text_key

ORDERS = (1, 2, 3)        # lengths of the byte n-grams
SLOTS = 1 << 16           # hashed indicators
TRAIN_ROWS = 6000         # most labelled rows that the fit reads: 8 kB each in one task
SMOOTHING = 1.0
REPEATED = 977            # slot before those of repeated pairs
STEADY = 30.0             # added to the squared length of a row, so that the few n-grams of a short text decide less
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.3


def indicator_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted slots of the n-grams that occur in each whole text.

    A pair of equal neighbouring words is one more n-gram, whatever the word; it has a slot for each tenth of all pairs.
    """
    seen = np.zeros(SLOTS, dtype=bool)
    for _, data, at in blocks(column):
        grams = []
        code = np.zeros(len(data), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            size = max(0, len(data) - n + 1)
            code = (code[:size] << np.uint32(8)) | data[n - 1:n - 1 + size]
            if n in ORDERS:
                x = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
                grams.append((n, ((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(16)))
        hashed, row, _, _ = words(data, at)
        pairs = row[1:][row[1:] == row[:-1]]
        equal = row[1:][(row[1:] == row[:-1]) & (hashed[1:] == hashed[:-1])]
        rows = len(at) - 1
        tenth = -(-10 * np.bincount(equal, minlength=rows) // np.maximum(1, np.bincount(pairs, minlength=rows)))
        for start, end, repeats in zip(at[:-1].tolist(), at[1:].tolist(), tenth.tolist()):
            for n, slots in grams:
                if end - start >= n:
                    seen[slots[start:end - n + 1]] = True
            if repeats:
                seen[REPEATED + repeats] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> dict:
    """Weights, bias and calibration. With one class only, or none, the score is the smoothed share of label 1."""
    good = int(labels.sum())
    constant = {"weights": np.zeros(SLOTS, np.float32), "ratio2": np.zeros(SLOTS, np.float32), "bias": 0.0, "slope": 0.0,
                "shift": float(np.log((good + 1) / (len(labels) - good + 1)))}
    if good in (0, len(labels)):
        return constant
    counts = np.zeros((2, SLOTS)) + SMOOTHING
    for found, y in zip(rows, labels):
        counts[int(y), found] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rng = np.random.default_rng(seed)
    held = rng.random(len(rows)) < 0.25  # margins for the calibration come from rows that the first fit has not seen
    if len(set(labels[~held].tolist())) == 2 and len(set(labels[held].tolist())) == 2:
        first = descend(rows, labels, ratio, np.flatnonzero(~held), rng)
        slope, shift = calibrate(np.array([margin(first, ratio, rows[i]) for i in np.flatnonzero(held)]), labels[held])
    else:
        slope, shift = 1.0, 0.0
    weights, bias = descend(rows, labels, ratio, np.arange(len(rows)), rng)
    return {"weights": (weights * ratio).astype(np.float32), "ratio2": (ratio * ratio).astype(np.float32), "bias": bias, "slope": slope, "shift": shift}


def margin(model: tuple[np.ndarray, float], ratio: np.ndarray, found: np.ndarray) -> float:
    scaled = ratio[found]
    return float(model[0][found] @ scaled / np.sqrt(scaled @ scaled + STEADY) + model[1])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, chosen: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss on rows of at most unit length with a bias term; rare labels cost more."""
    weights, bias = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    share = {1.0: (labels[chosen] == 1).mean(), -1.0: (labels[chosen] == 0).mean()}
    scaled = {int(i): (ratio[rows[i]] / np.sqrt((ratio[rows[i]] ** 2).sum() + STEADY)).astype(np.float32) for i in chosen}
    for _ in range(EPOCHS):
        for i in rng.permutation(chosen):
            x, y = scaled[int(i)], sign[i]
            gradient = y * (weights[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (1 + x @ x), 0.0), COST / (2 * share[y]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[rows[i]] += step * x
                bias += step
                alpha[i] = new
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margin to the chance of label 1, by Newton steps with a small ridge."""
    a, b, ridge = 1.0, 0.0, 1e-2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(margins * (p - labels)).sum() + ridge * (a - 1), (p - labels).sum() + ridge * b])
        h = np.array([[(w * margins * margins).sum() + ridge, (w * margins).sum()], [(w * margins).sum(), w.sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """Model from at most ``rows`` labelled rows, the first by hash of the id, of those whose crc32(id) mod 5 is not 0.

    NULL ids and labels other than 0 and 1 are left out; an id with several labels or texts counts each pair, a repeated
    row counts once. Pairs beyond ``rows`` are left out, the first by hash of the id and then of the text are kept.
    """
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
              .filter("_y IN (0, 1)").filter(F.crc32(F.col("_id").cast("string")) % 5 != 0)
              .orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for found in indicator_rows(batch.column(1)):
                flags = np.zeros(SLOTS, dtype=bool)
                flags[found] = True
                bits.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["y", "bits"])

    # the chosen rows are bounded by ``rows``, so they may be sent to every task
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    found = found.withColumn("_key", text_key("_text"))
    pairs = found.select("_id", "_y", "_key").distinct().orderBy(F.xxhash64("_id"), "_id", "_y", "_key").limit(rows)
    once = found.join(F.broadcast(pairs), ["_id", "_y", "_key"]).groupBy("_id", "_y", "_key").agg(F.first("_text").alias("_text"))
    bits = once.select("_y", "_text").mapInArrow(packed, "y int, bits binary")
    # at most ``rows`` rows of 8 kB: one task fits them, the driver gets the model alone
    model = bits.repartition(1).mapInArrow(fitted, "weights binary, ratio2 binary, bias double, slope double, shift double, rows bigint").first()
    if model is None:
        return {**fit([], np.zeros(0, np.int64)), "rows": 0}
    arrays = {name: np.frombuffer(model[name], np.float32) for name in ("weights", "ratio2")}
    return {**arrays, "bias": model.bias, "slope": model.slope, "shift": model.shift, "rows": model.rows}


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Model of rows (y, bits), in an order of their own, and the number of these rows."""
    rows = sorted((bits, y) for batch in batches for y, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    kept = [np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).astype(np.uint16) for bits, _ in rows]
    model = fit(kept, np.array([y for _, y in rows], dtype=np.int64))
    columns = [pa.array([model[name].tobytes()], pa.binary()) for name in ("weights", "ratio2")]
    columns += [pa.array([float(model[name])]) for name in ("bias", "slope", "shift")] + [pa.array([len(rows)], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, ["weights", "ratio2", "bias", "slope", "shift", "rows"])


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out`` (0 to 1) added. NULL and empty texts have no n-grams: the bias alone decides."""
    weights, ratio2, bias, slope, shift = (model[k] for k in ("weights", "ratio2", "bias", "slope", "shift"))
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    names = [f.name for f in fields]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            margins = np.fromiter((weights[x].sum(dtype=np.float64) / np.sqrt(ratio2[x].sum(dtype=np.float64) + STEADY) + bias
                                   for x in indicator_rows(text)), np.float64, len(text))
            yield batch.select(names).append_column(out, pa.array(1 / (1 + np.exp(-np.clip(slope * margins + shift, -60, 60)))))

    return docs.mapInArrow(scored, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """Rows of ``docs`` with all their columns whose score is at least ``threshold``."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return score(docs, train(docs, labels, id_col, text_col, **how), text_col, name).filter(F.col(name) >= threshold).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and text_key.

    NULL ids are held out (nothing was learned from them); empty texts get the score of no n-grams; repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("text_key"))
    out = score(plain, train(docs, labels, id_col, text_col, label_col, rows), out="_score", keep_text=False)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
                      F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), "text_key")
