"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view has its own logistic regression. In every round each view scores all unlabelled documents, whatever their number, and the documents it is
surest of, by a threshold over all of them, join the other view's training rows. Both are then calibrated on labelled documents that neither has
seen, and the calibrated views are combined, on further such documents, into one score for every document. Only rows that enter a fit are bounded: labelled ones by a hash of the
id, and of the sure ones a weighted sample in which every language and source that has any takes part.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import checkpointed
from .words import SPACE, Texts, mix, per_text, slices

#: Bounds of a fit: labelled documents, and sure documents that one view gives to the other in a round. A row of features takes about 2.5 KB.
LABELLED, GIVEN = 8_000, 4_000
#: Rounds, the share of all unlabelled documents that a round adds, the logit from which a view is sure (19 to 1), and the weight of given documents
#: against labelled ones: of one document, and at most of all of them together, so that the balance is the same at every size.
ROUNDS, SHARE, SURE, WEIGHT = 3, 0.1, 3.0, 0.3
#: Steps of a logit by which thresholds are found.
STEPS = 100
WORDS, LANGS, SOURCES = 512, 8, 32
#: Files of a table of rows of a fit.
FILES = 8
SHAPES = 6


def _bucket(values: list, n: int) -> np.ndarray:
    """A small stable hash of strings; null is a value of its own."""
    out = []
    for v in values:
        h = 2166136261
        for b in b"\x00" if v is None else v.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        out.append((h ^ h >> 15) % n)
    return np.array(out, np.int64)


def content(t: Texts) -> np.ndarray:
    """Text-content view: shares of hashed words and word ends, and of word shapes, by document."""
    n = len(t.offsets) - 1
    words = np.maximum(t.n_words, 1)[:, None]
    h, owner = t.hashes(), t.owner()
    place = (mix(h, 11) % np.uint64(WORDS // 2)).astype(np.int64)
    out = np.zeros((n, WORDS + SHAPES), np.float32)
    if not len(h):
        return out
    last = t.buf[t.ends - 1].astype(np.int64)
    before = np.where(t.ends - t.starts > 1, t.buf[np.maximum(t.ends - 2, 0)], 0).astype(np.int64)
    end = WORDS // 2 + (last * 257 + before) % (WORDS // 2)
    counts = np.bincount(np.concatenate([owner * WORDS + place, owner * WORDS + end]), minlength=n * WORDS).reshape(n, WORDS)
    out[:, :WORDS] = counts / words
    upper = np.concatenate([[0], np.cumsum((t.buf >= 65) & (t.buf <= 90))])
    letter = np.concatenate([[0], np.cumsum(((t.buf >= 65) & (t.buf <= 90)) | ((t.buf >= 97) & (t.buf <= 122)) | (t.buf >= 128))])
    size, ups, letters = t.ends - t.starts, upper[t.ends] - upper[t.starts], letter[t.ends] - letter[t.starts]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    shapes = [same, letters == 0, (letters < size - 1) & (letters > 0), (ups >= 2) & (ups * 2 >= letters), size == 1, size > 12]
    for k, s in enumerate(shapes):
        out[:, WORDS + k] = per_text(s, t.first) / words[:, 0]
    return out


def metadata(t: Texts, lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """Page-metadata view: language, source, size, and layout figures that need no words to be known."""
    n = len(t.offsets) - 1
    size = np.maximum(np.diff(t.offsets), 1).astype(np.float64)
    kinds = np.zeros(256, np.int64)
    kinds[[10]], kinds[[32, 9]] = 1, 2
    kinds[48:58], kinds[65:91], kinds[97:123], kinds[128:] = 3, 4, 5, 5
    kinds[[44, 46, 39, 45, 58, 59, 63]] = 6
    sums = np.zeros((n, 8))
    if len(t.buf):
        owner = np.repeat(np.arange(n), np.diff(t.offsets))
        sums = np.bincount(owner * 8 + kinds[t.buf], minlength=n * 8).reshape(n, 8)
    lines = sums[:, 1] + 1
    out = np.zeros((n, LANGS + SOURCES + 12), np.float32)
    out[np.arange(n), _bucket(lang, LANGS)] = 1
    out[np.arange(n), LANGS + _bucket(source, SOURCES)] = 1
    rest = [np.log1p(n_chars), np.log1p(size), np.log(lines), np.log1p(size / lines), np.log1p(size / (sums[:, 2] + sums[:, 1] + 1)), *(sums[:, k] / size for k in (0, 2, 3, 4, 5, 6))]
    for k, x in enumerate(rest):
        out[:, LANGS + SOURCES + k] = x
    return out


class Logit:
    """Logistic regression on standardised columns, by accelerated gradient steps on the ridge-penalised likelihood."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 250) -> Logit:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        weight = np.ones(len(y)) if weight is None else weight
        weight = (weight / weight.sum()).astype(np.float32)
        w, b, vw, vb, t = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0, 1.0
        # an upper bound of the curvature: the largest eigenvalue of the weighted Gram matrix, by power steps
        p = np.ones(z.shape[1], np.float32)
        for _ in range(20):
            p = z.T @ (weight * (z @ p))
            norm = float(np.linalg.norm(p)) or 1.0
            p /= norm
        rate = 1.0 / (0.25 * (1.1 * norm + 1) + ridge)
        for _ in range(steps):
            g = weight * (1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y)
            nw, nb = vw - rate * (z.T @ g + ridge * vw), vb - rate * float(g.sum())
            nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
            vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = nw.astype(np.float32), nb, nt
        self.w, self.b = w, b
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w + self.b, -15, 15)


_VIEWS = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("metadata", T.BinaryType())])
_INPUT = ["text", "lang", "source", "n_chars"]


def _views(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views of the rows of a batch whose columns from `first` on are text, lang, source, n_chars."""
    chars = batch.column(first + 3)
    for lo, hi, t in slices(batch.column(first), SPACE, lower=False):
        n = chars.slice(lo, hi - lo).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        yield lo, hi, content(t), metadata(t, batch.column(first + 1).slice(lo, hi - lo).to_pylist(), batch.column(first + 2).slice(lo, hi - lo).to_pylist(), np.maximum(n, 0))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, a, b in _views(batch, 2):
            packed = [pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *packed], names=_VIEWS.names)


def _both_kinds(label: np.ndarray, rows: np.ndarray) -> bool:
    return len(rows) >= 20 and 0 < label[rows].sum() < len(rows)


def trained(views: tuple[np.ndarray, np.ndarray], label: np.ndarray, held: np.ndarray, given: tuple[tuple | None, tuple | None] = (None, None), last: bool = True) -> dict:
    """Models of both views and, after the last round, their combination.

    held: labelled rows kept for calibration, every other one for that of the views and the rest for the combination (all for both where a half has
    under 20 rows or one kind); given: by view, (features, labels, weights) of documents that the other view is sure of.
    """
    train = np.flatnonzero(~held)
    models = []
    for v, more in zip(views, given, strict=True):
        x, y, weight = v[train], label[train], np.ones(len(train))
        if more is not None and len(more[1]):
            w = more[2] * WEIGHT * min(1.0, len(train) / more[2].sum())
            x, y, weight = np.concatenate([x, more[0]]), np.concatenate([y, more[1]]), np.concatenate([weight, w])
        models.append(Logit().fit(x, y, weight))
    scales, shifts = [1.0, 1.0], [0.0, 0.0]
    joint = np.array([0.5, 0.5, 0.0])
    kept = np.flatnonzero(held)
    if last and _both_kinds(label, kept):
        halves = (kept[::2], kept[1::2])
        mine, rest = halves if all(_both_kinds(label, h) for h in halves) else (kept, kept)
        logits = lambda rows: np.column_stack([m.logit(v[rows]) for m, v in zip(models, views, strict=True)])
        both = logits(mine)
        for k in (0, 1):
            one = Logit().fit(both[:, k : k + 1].astype(np.float32), label[mine], ridge=1e-2)
            scales[k], shifts[k] = float(one.w[0] / one.scale[0]), float(one.b - one.w[0] * one.mean[0] / one.scale[0])
        calibrated = logits(rest) * scales + shifts
        one = Logit().fit(calibrated.astype(np.float32), label[rest], ridge=1e-2)
        slope = one.w / one.scale
        joint = np.array([slope[0], slope[1], one.b - float((slope * one.mean).sum())])
    out = {"scales": np.array(scales), "shifts": np.array(shifts), "joint": joint, "positive": np.array(np.clip(label[train].mean(), 0.02, 0.98))}
    for k, m in enumerate(models):
        out |= {f"w{k}": m.w, f"b{k}": np.array([m.b]), f"mean{k}": m.mean, f"scale{k}": m.scale}
    return out


def _logit(model: dict, k: int, x: np.ndarray) -> np.ndarray:
    return np.clip(((x - model[f"mean{k}"]) / model[f"scale{k}"]) @ model[f"w{k}"] + model[f"b{k}"][0], -15, 15)


def _sure(rest: DataFrame, model: dict) -> DataFrame:
    """(key, stratum, step0, step1) for each row of rest: the logits of both views in whole steps away from zero, and the language and source as the model tells them apart."""
    shared = rest.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, a, b in _views(batch, 2):
                stratum = np.argmax(b[:, :LANGS], axis=1) * SOURCES + np.argmax(b[:, LANGS : LANGS + SOURCES], axis=1)
                steps = [np.trunc(_logit(own, k, x) * STEPS).astype(np.int32) for k, x in enumerate((a, b))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(stratum.astype(np.int32)), *map(pa.array, steps)], names=["key", "stratum", "step0", "step1"])

    return rest.mapInArrow(run, "key long, stratum int, step0 int, step1 int")


def thresholds(counts: dict[int, int], up: int, down: int) -> tuple[int, int]:
    """The steps from which on up and down to which documents are sure: at least SURE, and as few steps as hold `up` and `down` documents; equal ones all come."""
    out = []
    for sign, most in ((1, up), (-1, down)):
        found, edge = 0, 0
        for step in sorted((s for s in counts if s * sign > SURE * STEPS), key=lambda s: -s * sign):
            if found >= most:
                break
            found, edge = found + counts[step], step
        out.append(edge if edge else sign * (16 * STEPS))
    return out[0], out[1]


def exchange(scores: DataFrame, positive: float, rounds: int, most: int) -> DataFrame:
    """(key, taught, label, weight): the documents that one view gives to the view `taught`, about `most` a view of all that are sure.

    scores: what _sure returns for all unlabelled documents. Half of the sample is spread evenly over labels, languages and sources, half follows their
    numbers; the weight of a row is the number of documents that it stands for.
    """
    counts = scores.select(F.explode(F.array(*(F.struct(F.lit(k).alias("view"), F.col(f"step{k}").alias("step")) for k in (0, 1)))).alias("s")).groupBy("s.view", "s.step").count().collect()  # 6002 rows at most
    n = sum(r["count"] for r in counts if r["view"] == 0)
    share = SHARE * rounds * n
    cut = [thresholds({r["step"]: r["count"] for r in counts if r["view"] == k}, max(1, int(share * positive)), max(1, int(share * (1 - positive)))) for k in (0, 1)]
    marks = [F.when(F.col(f"step{k}") >= cut[k][0], 1).when(F.col(f"step{k}") <= cut[k][1], 0) for k in (0, 1)]
    sure = scores.select("key", "stratum", F.explode(F.array(*(F.struct(F.lit(1 - k).alias("taught"), marks[k].alias("label")) for k in (0, 1)))).alias("s")).select("key", "stratum", "s.taught", "s.label").where("label is not null")
    sizes = sure.groupBy("taught", "label", "stratum").agg(F.count("*").alias("n"))  # 1024 rows at most
    totals = sizes.groupBy("taught").agg(F.sum("n").alias("all"), F.count("*").alias("strata"))
    rates = sizes.join(totals, "taught").select("taught", "label", "stratum", F.least(F.lit(1.0), most / 2 / F.col("strata") / F.col("n") + most / 2 / F.col("all")).alias("rate"))
    unit = 1 << 30
    drawn = sure.join(F.broadcast(rates), ["taught", "label", "stratum"]).where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(unit)) < F.col("rate") * unit)
    # repeated rows are drawn together: one stands for all
    return drawn.groupBy("key", "taught", "label").agg(F.sum(1 / F.col("rate")).alias("weight"))


def _fitted(rows: DataFrame, last: bool) -> dict | None:
    """The models of labelled rows (taught -1) and given ones, in one group of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["content"].to_numpy(), pdf["key"].to_numpy()))
        label, taught, weight, key = (pdf[c].to_numpy()[order] for c in ("label", "taught", "weight", "key"))
        views = tuple(np.frombuffer(b"".join(pdf[c].to_numpy()[order]), np.float32).reshape(len(pdf), -1) for c in ("content", "metadata"))
        known = taught < 0
        held = key[known] % 4 == 0
        train = label[known][~held]
        if not len(train) or train.min() == train.max():
            return pd.DataFrame({"model": pd.Series([], dtype=object)})
        more = tuple((v[taught == j], label[taught == j], weight[taught == j]) for j, v in enumerate(views))
        out = io.BytesIO()
        np.savez(out, **trained(tuple(v[known] for v in views), label[known], held, more, last))
        return pd.DataFrame({"model": [out.getvalue()]})

    found = rows.groupBy().applyInPandas(run, "model binary").first()
    return dict(np.load(io.BytesIO(found["model"]))) if found else None


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, given: int = GIVEN) -> dict | None:
    """The models, from at most about `labelled` labelled documents and all others, of which about `given` enter the fit of a view; None if the labels have no two kinds.

    labels: doc_id and quality (1 good, 0 bad); null ids and labels are left out, and of several labels of one id the smallest counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    n = known.count()
    unit = 1 << 20
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(unit))
    chosen = F.broadcast(known.where(draw < int(min(1.0, labelled / max(1, n)) * unit)).select(F.col("doc_id").alias("id"), "label"))
    joined = docs.select("doc_id", *_INPUT).join(chosen, F.col("doc_id") == F.col("id"), "left")
    mine = joined.where("label is not null").select("label", F.xxhash64(F.col("doc_id"), F.lit(5)).alias("key"), *_INPUT)
    rest = joined.where("label is null").select(F.lit(-1).alias("label"), F.xxhash64("doc_id", *_INPUT, F.lit(5)).alias("key"), *_INPUT)
    own = checkpointed(mine.mapInArrow(_sampled, _VIEWS).select("*", F.lit(-1).alias("taught"), F.lit(1.0).alias("weight")))
    model, rows = None, own
    for k in range(ROUNDS + 1):
        model = _fitted(rows, k == ROUNDS)
        if model is None:
            return None
        if k < ROUNDS:
            # the rows of a fit are bounded, and are written as few files
            drawn = checkpointed(exchange(checkpointed(_sure(rest, model)), float(model["positive"]), k + 1, given).coalesce(FILES))
            keys = F.broadcast(drawn.select("key").distinct())
            features = rest.join(keys, "key", "left_semi").select("label", "key", *_INPUT).dropDuplicates(["key"]).mapInArrow(_sampled, _VIEWS)
            rows = checkpointed(own.unionByName(features.drop("label").join(F.broadcast(drawn), "key")).coalesce(FILES))
    return model


def _score(model: dict, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    def logit(k, x):
        return _logit(model, k, x) * model["scales"][k] + model["shifts"][k]

    s, t = logit(0, a), logit(1, b)
    p = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    return p(model["joint"][0] * s + model["joint"][1] * t + model["joint"][2]), p(s), p(t)


def scored(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The `keep` columns with quality_score, content_score and metadata_score, each 0..1 (higher: better). Without a model all are 1.

    Null and empty texts are texts without words; null languages and sources are values of their own; repeated rows have equal scores, ties stay ties; an
    empty table gives no rows; other columns play no part.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in ("quality_score", "content_score", "metadata_score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, a, b in _views(batch, len(keep)):
                found = _score(own, a, b) if own else (np.ones(hi - lo),) * 3
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), *(pa.array(x.astype(np.float64)) for x in found)], names=schema.names)

    return docs.select(*keep, *(F.col(c).alias(f"{c}__in") for c in _INPUT)).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, quality_score, content_score, metadata_score, keep (quality_score >= 0.5).

    Null and empty texts, languages and sources are scored like others; repeated rows have equal scores; rows with a null id are never labelled; without labels of
    both kinds all scores are 1; an empty table gives no rows; other columns play no part.
    """
    return scored(docs, fit(docs, labels), ["doc_id"]).withColumn("keep", F.col("quality_score") >= 0.5)
