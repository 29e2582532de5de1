"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages: runs of PASSAGE bytes of its text. Each passage is
encoded as hashed counts of byte trigrams and shares of character classes, square-rooted
and scaled. A layer h = tanh(W x) turns it into a representation; gated attention
a = softmax(w . (tanh(V h) * sigmoid(U h))) says how much each passage counts; the
weighted sum of the representations gives the document's logit. All weights are learned
together from the documents' labels alone.

Training takes at most TRAIN_DOCS labelled documents (those with the least hash of their
doc_id, so the choice doesn't hang on order) and is the only bounded part; every document
is scored, over its whole text. A fifth of the sample is held out: the threshold is the
largest that keeps KEEP of the held-out good documents.

Rows: a null or empty text has one empty passage and is scored as such. Labels that are
null count for nothing. With labels of one kind only, no document is rejected.
Very long texts are bags with many passages; the softmax runs over all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PASSAGE = 512
BUCKETS = 192
CLASSES = 12
HIDDEN = 32
GATE = 16
TRAIN_DOCS = 6000
EPOCHS = 25
KEEP = 0.998
SEED = 11

_class = np.full(256, 9, np.int64)
_class[ord(" ")] = 0
_class[10] = 1
_class[97:123] = 2
_class[65:91] = 3
_class[48:58] = 4
_class[[ord(c) for c in ".,;:?'"]] = 5
_class[[ord("!")]] = 6
_class[[ord(c) for c in "#$%&*"]] = 7
_class[[ord("|")]] = 8
_class[128:] = 10


def passages(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and where each text's passages begin."""
    lens = np.diff(at)
    n_pass = np.maximum(1, -(-lens // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(begin[-1])
    width = BUCKETS + CLASSES
    counts = np.zeros(total * width, np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(lens)), lens)
        inside = np.arange(len(flat)) - at[row]
        of = begin[row] + inside // PASSAGE
        x = flat.astype(np.uint32)
        tri = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        whole = of[:-2] == of[2:]
        bucket = ((tri * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(BUCKETS)
        counts = np.bincount(of[:-2][whole] * width + bucket[whole], minlength=total * width)
        counts += np.bincount(of * width + BUCKETS + _class[flat], minlength=total * width)
        # bytes that with the one before repeat what stood 4 to 10 bytes before, as in repeated words
        again = np.zeros(len(flat), bool)
        for d in range(4, min(11, len(flat))):
            same = (flat[d:] == flat[:-d]) & (of[d:] == of[:-d])
            again[d + 1 :] |= same[1:] & same[:-1]
        counts += np.bincount(of[again] * width + BUCKETS + CLASSES - 1, minlength=total * width)
    x = counts.reshape(total, width).astype(np.float32)
    size = np.maximum(x[:, BUCKETS : BUCKETS + CLASSES - 1].sum(1, keepdims=True), 1)
    x /= size
    np.sqrt(x, out=x)
    return x, begin


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, width: int = BUCKETS + CLASSES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "W": draw(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
            "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE),
            "c": draw(HIDDEN), "d": np.zeros(1, np.float32),
        }
        self.mean, self.scale, self.threshold = np.zeros(width, np.float32), np.ones(width, np.float32), -np.inf

    def forward(self, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        starts, sizes = begin[:-1], np.diff(begin)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(h * a[:, None], starts, axis=0)
        return bag @ p["c"] + p["d"], {"z": z, "h": h, "t": t, "s": s, "a": a, "bag": bag, "sizes": sizes, "starts": starts}

    def gradients(self, k: dict, error: np.ndarray) -> dict:
        p, h, a, t, s = self.p, k["h"], k["a"], k["t"], k["s"]
        per = np.repeat(error, k["sizes"])
        d_bag = per[:, None] * p["c"]
        d_a = (d_bag * h).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, k["starts"]), k["sizes"]))
        d_ts = d_e[:, None] * p["w"]
        d_v, d_u = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        d_h = (d_bag * a[:, None] + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - h * h)
        return {
            "W": k["z"].T @ d_h, "b": d_h.sum(0), "V": h.T @ d_v, "U": h.T @ d_u,
            "w": (t * s).T @ d_e, "c": k["bag"].T @ error, "d": error.sum(keepdims=True),
        }


def fit(x: np.ndarray, begin: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the weighted log-loss; every fifth bag is held out for the threshold."""
    model = Model(x.shape[1], seed)
    if len(good) < 10 or good.min() == good.max():
        return model
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(good))
    held, train = order[::5], np.setdiff1d(order, order[::5])
    weight = np.where(good > 0, 0.5 / max(good[train].mean(), 1e-6), 0.5 / max(1 - good[train].mean(), 1e-6))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(q) for k, q in model.p.items()}
    step = 0

    def bags(rows):
        at = np.concatenate([np.arange(begin[r], begin[r + 1]) for r in rows])
        return x[at], np.concatenate([[0], np.cumsum(begin[rows + 1] - begin[rows])])

    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 128):
            rows = train[i : i + 128]
            bx, bb = bags(rows)
            logit, kept = model.forward(bx, bb)
            error = ((_sigmoid(logit) - good[rows]) * weight[rows] / len(rows)).astype(np.float32)
            step += 1
            for k, g in model.gradients(kept, error).items():
                g = g + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = (model.p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logit = model.forward(*bags(held))[0]
    fine = np.sort(logit[good[held] > 0])
    bad = logit[good[held] <= 0]
    if len(fine) and len(bad):
        model.threshold = float(min(0.0, fine[int((1 - KEEP) * len(fine))] - 0.25))
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fits on at most `most` labelled documents; features are made where the texts are."""
    key = F.col("doc_id").cast("string")
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(key.alias("doc_id")).agg(F.max("quality").alias("good"))
    # rarer label first: half of the sample for each, as far as there are so many
    each = most // 2
    some = marked.orderBy(F.col("good") > 0, F.xxhash64("doc_id"), "doc_id").filter("good <= 0").limit(each)
    rest = marked.filter("good > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most - each)
    sample, _path = C.written(some.unionByName(rest), "sample")
    rows = docs.select(key.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                x, begin = passages(*C.flat_text(part.column(part.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("good")).cast(pa.int32()),
                     C.list_array(x.astype(np.float32).ravel(), np.diff(begin) * x.shape[1], pa.float32())],
                    names=["doc_id", "good", "x"],
                )

    table = rows.mapInArrow(run, "doc_id string, good int, x array<float>").toArrow().combine_chunks().sort_by("doc_id")
    if not table.num_rows:
        return Model()
    good = (table.column("good").to_numpy() > 0).astype(np.float32)
    width = BUCKETS + CLASSES
    lists = table.column("x").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    x = lists.flatten().to_numpy().reshape(-1, width)
    begin = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()) // width)])
    return fit(x, begin, good)


def with_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with quality_score (the logit) and keep."""
    docs = docs.drop("quality_score", "keep")
    held = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches):
        m = held.value
        for whole in batches:
            for batch in C.slices(whole, "text"):
                x, begin = passages(*C.flat_text(batch.column(n)))
                logit = m.forward(x, begin)[0].astype(float).round(4)
                yield C.batch_of(batch, n, pa.array(logit), pa.array(logit >= m.threshold))

    return C.with_columns(docs, run, "quality_score double, keep boolean", {"text": F.col(f"`{text}`").cast("string")})


def op6_quality_mil(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = C.read(spark, sf_dir, "documents")
    return with_quality(docs.select("doc_id", "text"), train(docs, C.read(spark, sf_dir, "labels"))).drop("text")
