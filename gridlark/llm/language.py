"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed byte n-grams says which half of the
languages a text belongs to. The languages' losses against those answers, weighted by how reliable each bit was on
training rows, decide: the codeword with the smallest loss wins, and a text whose two best are close is ambiguous.

The classifiers learn from a bounded sample: ``rows_per_language`` rows for each language, chosen by a hash. Each bit
is trained by its own task from the sampled rows' n-gram counts. A model is small (bits x 2**16 weights).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.llm.support import joined, lengths, mix, slices

#: Rows of each language that the classifiers learn from, at most about.
ROWS_PER_LANGUAGE = 1500
FEATURE_BITS = 16
#: Up to so many languages every split into two halves is a bit; beyond, bits are drawn by a hash.
ALL_SPLITS = 6
#: A text is ambiguous if its second language is at least this likely beside the first.
AMBIGUOUS = 0.9
UNDETERMINED = "und"
_EPOCHS, _RATE, _DECAY = 12, 1.0, 1e-5
#: Features of the sample that are weighed at a time, and text bytes whose n-grams are made at a time.
_WEIGHED, _JUDGED = 1 << 17, 1 << 16
#: Lower-cases A-Z; all that is no letter in ASCII becomes a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language; no two rows and no two columns are equal or opposite."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= ALL_SPLITS:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1 == 1, 1, -1).astype(np.int8)
    count = 10 * int(np.ceil(np.log2(languages)))
    drawn = mix(np.arange(1, languages * count * 4 + 1)).reshape(-1, languages) & np.uint64(1)
    bits = list(dict.fromkeys(tuple(v ^ r[0] for v in r) for r in drawn.tolist() if 0 < sum(r) < languages))[:count]
    return np.where(np.array(bits).T == 1, 1, -1).astype(np.int8)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed uni-, bi- and trigrams of the folded bytes of all rows, three for each byte; and the rows' bounds there.

    A row is read as if a space stood before and after it, so n-grams never reach into another row.
    """
    n = len(bounds) - 1
    spaced = np.full(len(data) + 2 * n, 32, np.uint32)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(bounds))
    spaced[np.arange(len(data)) + shift] = _FOLD[data]
    last = np.concatenate(([32, 32], spaced[:-2])).astype(np.uint32)
    middle = np.concatenate(([32], spaced[:-1])).astype(np.uint32)
    new_bounds = bounds + 2 * np.arange(n + 1)
    last[new_bounds[:-1][new_bounds[:-1] < len(spaced)]] = 32
    codes = np.empty((len(spaced), 3), np.uint32)
    codes[:, 0] = spaced
    codes[:, 1] = spaced << 8 | middle
    codes[:, 2] = spaced << 16 | middle << 8 | last
    codes = (codes * np.uint32(3) + np.arange(3, dtype=np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    return (codes >> np.uint32(32 - FEATURE_BITS)).astype(np.uint16), new_bounds


@dataclass
class Model:
    """Languages, their codewords, the weights (features x bits), the intercepts and the bits' reliability."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The answer of every bit's classifier for every row: over 0 for a language with 1 there."""
        codes, at = features(data, bounds)
        total = np.zeros((len(at) - 1, len(self.bias)))
        per_byte = np.zeros((len(codes), len(self.bias)), np.float32)
        for k in range(3):
            per_byte += self.weights[codes[:, k]]
        if len(codes):
            total[:] = np.add.reduceat(per_byte, at[:-1], axis=0, dtype=np.float64)  # no row is empty: two spaces
        return total / (3 * np.diff(at))[:, None] + self.bias

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """How likely each language is, from the loss-weighted distance of its codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]) * self.trust
        score = -loss.sum(axis=2) / self.trust.sum() * self.code.shape[1]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no classifier learns from: the id's checksum is a multiple of ``folds``, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(
    rows: DataFrame,
    text: str = "text",
    language: str = "lang",
    id_column: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> Model:
    """Learn from rows that are not held out and have a text and a language. No such rows: a model of no languages."""
    rows = rows.select(
        F.col(text).cast("binary").alias("text"),
        F.col(language).cast("string").alias("language"),
        F.xxhash64(F.col(id_column).cast("string"), F.lit("sample")).alias("draw"),
    ).where(~held_out(F.col(id_column)) & F.col("text").isNotNull() & F.col("language").isNotNull())
    counts = {r["language"]: r["n"] for r in rows.groupBy("language").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    empty = Model(languages, code, np.zeros((1 << FEATURE_BITS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) < 2:
        return empty
    chance = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / counts[k]))])
    number = F.create_map(*[F.lit(x) for k in languages for x in (k, languages.index(k))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 20)) < chance[F.col("language")] * (1 << 20))
    sampled = drawn.select("text", "draw", number[F.col("language")].alias("language"))
    bits = code.shape[1]

    def one_bit(table: pa.Table) -> pa.Table:
        bit = table["bit"][0].as_py()
        order = np.lexsort((table["language"].to_numpy(), table["draw"].to_numpy()))  # one order, however rows arrive
        signs = code[table["language"].to_numpy()[order], bit].astype(np.float64)
        # the rows' buffers are read where they lie: the table is held only once more, in order
        feature, share = (_in_order(table[k], order, kind) for k, kind in (("features", np.uint16), ("shares", np.float32)))
        sizes = lengths(table["features"])[order] // 2
        weights, bias, trust = _logistic(sizes, feature, share, signs)
        return pa.table({"bit": pa.array([bit], pa.int32()), "weights": pa.array([weights], pa.list_(pa.float32())), "bias": [bias], "trust": [trust]})

    tasks = sampled.mapInArrow(_counted, "draw long, language int, features binary, shares binary")
    tasks = tasks.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    learned = tasks.groupBy("bit").applyInArrow(one_bit, "bit int, weights array<float>, bias double, trust double").collect()
    for r in learned:
        empty.weights[:, r["bit"]], empty.bias[r["bit"]], empty.trust[r["bit"]] = r["weights"], r["bias"], r["trust"]
    return empty


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of sampled rows and their shares of each row's, some text at a time: n-grams take many times its memory."""
    for batch in slices(batches, limit=_JUDGED):
        codes, at = features(*joined(batch.column("text")))
        found = [np.unique(codes[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("draw"),
                batch.column("language"),
                pa.array([f.tobytes() for f, _ in found], pa.binary()),
                pa.array([(c / c.sum()).astype(np.float32).tobytes() for _, c in found], pa.binary()),
            ],
            names=["draw", "language", "features", "shares"],
        )


def _in_order(column: pa.ChunkedArray, order: np.ndarray, kind: type) -> np.ndarray:
    """The values of a binary column's rows, one row after the other in the given order."""
    sizes = lengths(column)[order] // np.dtype(kind).itemsize
    out, ends = np.empty(sizes.sum(), kind), np.cumsum(sizes)
    for r, size, end in zip(order.tolist(), sizes.tolist(), ends.tolist()):
        out[end - size : end] = np.frombuffer(column[r].as_buffer(), kind)
    return out


def _logistic(sizes: np.ndarray, feature: np.ndarray, share: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Logistic regression by full gradient steps scaled by each feature's squared gradients; the bit's trust.

    ``sizes`` says how many features each row has; ``feature`` and ``share`` are those of all rows.
    """
    ends = np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(feature), _WEIGHED)), len(sizes)))
    blocks = []  # rows, and where their features lie
    for i, j in zip(cuts[:-1], cuts[1:]):
        blocks.append((slice(i, j), slice(int(ends[i] - sizes[i]), int(ends[j - 1]))))
    weight = np.where(signs > 0, 0.5 / max((signs > 0).sum(), 1), 0.5 / max((signs < 0).sum(), 1))
    w, seen, bias, seen_bias = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-12), 0.0, 1e-12

    def margins() -> np.ndarray:
        out = np.empty(len(sizes))
        for rows, at in blocks:
            n = sizes[rows]
            out[rows] = np.bincount(np.repeat(np.arange(len(n)), n), share[at] * w[feature[at]], len(n))
        return out + bias

    for _ in range(_EPOCHS * 5):
        margin = margins()
        pull = -signs * weight / (1 + np.exp(np.clip(signs * margin, -30, 30)))
        slope = np.zeros(1 << FEATURE_BITS)
        for rows, at in blocks:  # added up in the order of the rows, so the sums don't depend on the blocks
            np.add.at(slope, feature[at].astype(np.intp), share[at] * np.repeat(pull[rows], sizes[rows]))
        slope += _DECAY * w / (1 << FEATURE_BITS)
        seen += slope**2
        w -= _RATE * 8 * slope / np.sqrt(seen)
        seen_bias += pull.sum() ** 2
        bias -= _RATE * pull.sum() / np.sqrt(seen_bias)
    margin = margins()
    wrong = float(((signs * margin <= 0) * weight).sum()) if len(sizes) else 0.5
    return w.astype(np.float32), float(bias), max(0.05, 1 - 2 * wrong)


FOUND = "lang_pred string, score double, ambiguous boolean"


def predict(df: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """All rows and columns of ``df`` with lang_pred, score (0 to 1) and ambiguous, from whole texts alone.

    Null texts and texts without a letter are ``und`` with score 0 and not ambiguous; so is every text if nothing was
    learned. ``prefix`` goes before the new names, for inputs that have such columns.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    body, names = f"{prefix}body", [prefix + n for n in ("lang_pred", "score", "ambiguous")]
    out = T.StructType([*df.schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in T._parse_datatype_string(FOUND).fields)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, body, _JUDGED):
            raw = batch.column(body).to_pylist()
            lettered = np.array([bool(t) and _has_letter(t) for t in raw], bool)
            pred, score = np.full(len(raw), UNDETERMINED, object), np.zeros(len(raw))
            second = np.zeros(len(raw))
            if model.languages and lettered.any():
                shares = model.shares(model.margins(*joined(batch.column(body))))
                order = np.argsort(-shares, axis=1, kind="stable")
                best = order[:, 0]
                rows = np.arange(len(raw))
                pred = np.where(lettered, np.array(model.languages, object)[best], UNDETERMINED)
                score = np.where(lettered, shares[rows, best], 0.0)
                if len(model.languages) > 1:
                    second = np.where(lettered, shares[rows, order[:, 1]] / shares[rows, best], 0.0)
            new = [pa.array(list(pred), pa.string()), pa.array(score), pa.array(second >= AMBIGUOUS)]
            kept = [n for n in batch.schema.names if n != body]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + new, names=kept + names)

    return df.withColumn(body, F.col(text).cast("binary")).mapInArrow(judge, out)


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))
