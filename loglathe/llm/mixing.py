"""Mixing sources to target weights with soft membership.

A classifier (multinomial logistic regression on hashed tokens), fitted on all labelled rows, gives
every document a posterior over domains. Where the documents to mix are those with the labels, tokens are cut and hashed once
for both, in a stored table. Document rates x >= 0 then minimise

    sum over domains d of (sum over documents i of n_i p_id x_i - T_d)^2 / N_d

where n_i are tokens, p_id posteriors, T_d the target tokens and N_d the expected tokens at rate 1. In the metric that n_i
weighs, the gradient of x_i is sum_d p_id r_d / N_d with the residual r_d, and its Lipschitz constant is 1, so each round is

    x_i <- max(0, x_i - sum_d p_id r_d / N_d)

from x = 1. A round is one aggregation to one number per domain; a document's rate is recomputed from the few residuals so
far, so no state per document is written between rounds.

Cases: a null text is empty and has the posterior of the intercepts. A domain that no document can belong to (N_d = 0) is
left out. Without labelled documents, or with labels of one domain, posteriors are uniform over the known domains.
Labels that are null or of unknown documents do not count. Repeated rows share a rate. Extra columns pass unchanged; those
named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe import session
from loglathe.llm import linking, words

FEATURES = 1 << 16
TOKEN = r"\p{L}+|[^\p{L}\s]+"
REGULARISATION = 1e-4
FIT_ROUNDS = 60
FIT_PARTS = 4  # least parts of the labelled rows
FIT_ROWS = 20_000  # labelled rows of a part
RATE_ROUNDS = 40
TOLERANCE = 1e-4  # of all tokens
MAX_DOMAINS = 64


_ASCII = np.array([0 if c in b" \t\n\v\f\r" else 1 if chr(c).isalpha() and c < 128 else 2 for c in range(256)], dtype=np.uint8)


@lru_cache(maxsize=None)
def _kinds() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 other."""
    out = np.full(0x110000, 2, dtype=np.uint8)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = 1
    out[:128] = _ASCII[:128]
    return out


def _token_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the tokens (TOKEN) of UTF-8 that ends in white space."""
    kind = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        size = (2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)).astype(np.int64)
        point = (buf[lead] & (0xFF >> (size + 1)).astype(np.uint8)).astype(np.int64)
        for j in range(1, 4):
            point = np.where(size > j, point << 6 | (buf[np.minimum(lead + j, len(buf) - 1)] & 0x3F), point)
        of_lead = _kinds()[point]
        for j in range(4):
            has = size > j
            kind[lead[has] + j] = of_lead[has]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))  # the last byte is white space, so each token has its end
    begins = edge[kind[edge] > 0]
    return begins, edge[np.searchsorted(edge, begins) + 1]


def _murmur3(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Murmur3 of each span, of 32 bits, with the seed of HashingTF. Spans of any size; `buf` has three bytes after them."""

    def mixed_in(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return h ^ (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    sizes = ends - begins
    four = buf[:-3].astype(np.uint32)
    for j in range(1, 4):
        four |= buf[j : len(buf) - 3 + j].astype(np.uint32) << np.uint32(8 * j)
    out = np.full(len(begins), 42, dtype=np.uint32)
    whole = sizes >> 2
    at, turn = np.flatnonzero(whole), 0
    while len(at):
        h = mixed_in(out[at], four[begins[at] + 4 * turn])
        out[at] = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        turn += 1
        at = at[whole[at] > turn]
    tail = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint32)[sizes & 3]
    h = mixed_in(out, four[begins + 4 * whole] & tail) ^ sizes.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return h ^ h >> np.uint32(16)


def token_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each text, the distinct features of all, ordered, and how many are of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n\0\0\0", dtype=np.uint8)
    begins, ends = _token_spans(buf[:-3])
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    counts = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)])))
    hashed = _murmur3(buf, begins, ends).view(np.int32) % FEATURES
    both = np.sort(np.repeat(np.arange(len(texts), dtype=np.int64), counts) * FEATURES + hashed)
    both = both[np.diff(both, prepend=-1) > 0]
    return counts, (both % FEATURES).astype(np.int32), np.bincount(both // FEATURES, minlength=len(texts))


def domain_of_labels() -> Column:
    """Domain of a row of the label table."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


class Domains:
    """Classifier of documents into the domains of a table (doc_id, domain).

    `vectors`, those of `docs` as `vectorised` gives them, spare it to cut the texts into tokens once more.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, vectors: DataFrame | None = None):
        known = labels.where("doc_id is not null and domain is not null").select(
            F.col("doc_id").alias("_labelled"), F.col("domain").alias("_domain")
        )
        self.names: Sequence[str] = sorted(r[0] for r in known.select("_domain").distinct().limit(MAX_DOMAINS + 1).collect())
        if len(self.names) > MAX_DOMAINS:
            raise ValueError(f"more than {MAX_DOMAINS} domains")
        self.model = None
        number = F.array_position(F.array(*[F.lit(n) for n in self.names] or [F.lit("")]), F.col("_domain")) - 1
        if vectors is None:
            rows = self._vectors(docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_labelled")))
        else:
            rows = vectors.select("row.doc_id", "_vector").join(known, F.col("doc_id") == F.col("_labelled"))
        rows = rows.select("_vector", number.cast("double").alias("_number"))
        stored = linking.stored(rows, "labelled")
        # as many parts as the rows need, or every round of the fit has a task per file
        rows = stored.coalesce(max(FIT_PARTS, -(-stored.count() // FIT_ROWS)))
        present = sorted(r[0] for r in rows.select("_number").distinct().collect())
        if len(present) > 1:
            # domains without a fitted row keep the number that the model expects, with probability 0
            fit = LogisticRegression(
                featuresCol="_vector",
                labelCol="_number",
                probabilityCol="_probability",
                rawPredictionCol="_raw",
                predictionCol="_prediction",
                family="multinomial",
                regParam=REGULARISATION,
                maxIter=FIT_ROUNDS,
            )
            self.model = fit.fit(rows)
        linking.discard(stored)

    @staticmethod
    def _vectors(docs: DataFrame) -> DataFrame:
        vectors = HashingTF(inputCol="_tokens", outputCol="_vector", numFeatures=FEATURES, binary=True)
        tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
        return vectors.transform(docs.withColumn("_tokens", tokens))

    @classmethod
    def vectorised(cls, docs: DataFrame, kept: Sequence[str] | None = None) -> DataFrame:
        """`n_tokens` and `_vector` of each text, and the kept columns (all of them) as `row`."""
        names = [c for c in (docs.columns if kept is None else kept) if c not in ("n_tokens", "posteriors")]
        # columns of the caller are kept inside one, so that none can clash
        rows = docs.select(F.struct(*names).alias("row"), "text")
        schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType()), T.StructField("_vector", VectorUDT())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = words.as_bytes(batch.column("text"))
                for start, stop in words.pieces(map(len, texts)):
                    counts, features, held = token_features(texts[start:stop])
                    n, total = stop - start, len(features)
                    ends = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
                    vector = [
                        pa.array(np.zeros(n, np.int8)),  # sparse
                        pa.array(np.full(n, FEATURES, np.int32)),
                        pa.ListArray.from_arrays(ends, pa.array(features)),
                        pa.ListArray.from_arrays(ends, pa.array(np.ones(total))),
                    ]
                    vectors = pa.StructArray.from_arrays(vector, names=["type", "size", "indices", "values"])
                    columns = [batch.column("row").slice(start, n), pa.array(counts.astype(np.int64)), vectors]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "_vector"])

        return rows.mapInArrow(run, schema)

    def posteriors(self, docs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """The rows with `n_tokens` and `posteriors`, an array in the order of `names`; of `vectors` the columns kept there."""
        rows = self.vectorised(docs) if vectors is None else vectors
        if self.model is None:
            even = F.array(*[F.lit(1.0 / len(self.names)) for _ in self.names]).cast("array<double>")
            rows = rows.withColumn("posteriors", even)
        else:
            given = vector_to_array("_probability")
            padded = F.concat(given, F.array_repeat(F.lit(0.0), len(self.names) - self.model.numClasses))
            rows = self.model.transform(rows).withColumn("posteriors", padded)
        return rows.select("row.*", "n_tokens", "posteriors")


def _rate(steps: list[list[float]]) -> Column:
    """Rate of a document after the rounds whose residuals (over N_d) are given."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])

    def move(x: Column, step: Column) -> Column:
        pull = F.aggregate(
            F.zip_with(step, F.col("posteriors"), lambda r, p: r * p), F.lit(0.0), lambda total, v: total + v
        )
        return F.greatest(F.lit(0.0), x - pull)

    return F.aggregate(history, F.lit(1.0), move)


def fitted_rates(rows: DataFrame, targets: dict[str, float], names: Sequence[str]) -> tuple[Column, dict[str, float]]:
    """Rate column for rows with `n_tokens` and `posteriors`, and the expected tokens per domain that it gives.

    `rows` should be stored, as it is read once per round.
    """

    def expected(rate: Column) -> list[float]:
        sums = [F.sum(F.col("n_tokens") * rate * F.get("posteriors", F.lit(d))) for d in range(len(names))]
        got = rows.agg(*[F.coalesce(s, F.lit(0.0)) for s in sums]).first()
        return [float(v) for v in got]

    natural = expected(F.lit(1.0)) if names else []
    wanted = [targets.get(n, 0.0) for n in names]
    steps: list[list[float]] = []
    now = natural
    for _ in range(RATE_ROUNDS):
        apart = [a - t for a, t in zip(now, wanted)]
        if max((abs(r) for r, n in zip(apart, natural) if n > 0), default=0.0) <= TOLERANCE * sum(natural):
            break
        steps.append([r / n if n > 0 else 0.0 for r, n in zip(apart, natural)])
        now = expected(_rate(steps))
    return _rate(steps), dict(zip(names, now))


def weights_to_tokens(weights: dict[str, float], total: float) -> dict[str, float]:
    whole = sum(weights.values())
    return {d: total * w / whole for d, w in weights.items()}


def mixed(
    docs: DataFrame,
    domains: Domains,
    weights: dict[str, float] | None = None,
    scale: dict[str, float] | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """The rows with posteriors, rate, and whole copies to draw (rate rounded at random, by a hash of the id).

    Targets are either `weights` (shares of all tokens) or, per domain, a `scale` of what the domain has now. With `vectors`,
    those of `docs`, the rows have the columns kept there, `doc_id` among them.
    """
    rows = session.checkpointed(domains.posteriors(docs, vectors))
    total = rows.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)),
        *[
            F.coalesce(F.sum(F.col("n_tokens") * F.get("posteriors", F.lit(d))), F.lit(0.0))
            for d in range(len(domains.names))
        ],
    ).first()
    natural = dict(zip(domains.names, total[1:]))
    if weights is not None:
        targets = weights_to_tokens(weights, float(total[0]))
    else:
        targets = {d: v * (scale or {}).get(d, 1.0) for d, v in natural.items()}
    rate, _ = fitted_rates(rows, targets, domains.names)
    luck = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + luck).cast("long"))
