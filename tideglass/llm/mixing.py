"""A selection of records in which each source has its target share of all tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.bpe import VOCABULARY, Merges, PairIndexEncoder, pieces
from tideglass.session import shared_folder, written

MARK = regex.compile(r"\p{Han}|[\p{L}--\p{Han}]+|\p{N}+|[^\s\p{L}\p{N}]|\n", flags=regex.V1)
BUCKETS = 1 << 13
#: Labelled records per source that the classifier is fitted on at most, spread evenly over all of them.
PER_SOURCE = 400
#: Parts of the hash range in which the rounding of rates is settled.
SLOTS = 4096
STEPS, CLOSE = 100, 1e-5


def marks(text: str) -> np.ndarray:
    """Hashed ids of a text's words, signs and line starts, each once."""
    found = [m.lower() for m in MARK.findall(text)]
    firsts = [f"^{a}" for b, a in zip(["\n", *found], found, strict=False) if b == "\n"]
    return np.array(sorted({xxhash.xxh32_intdigest(m.encode()) % BUCKETS for m in [*found, *firsts]}), dtype=np.int64)


class SourceClassifier:
    """Softmax regression on hashed words, giving each text's posterior over sources."""

    def __init__(self, sources: list[str]):
        self.sources = sources
        self.weight = np.zeros((BUCKETS, len(sources)), dtype=np.float32)
        self.bias = np.zeros(len(sources), dtype=np.float32)

    def posterior(self, texts: list[str]) -> np.ndarray:
        rows = [marks(t) for t in texts]
        z = np.stack([self.weight[r].sum(0) / np.sqrt(max(len(r), 1)) for r in rows]) + self.bias if rows else np.zeros((0, len(self.sources)))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, rows: list[np.ndarray], labels: list[str], steps: int = 60, rate: float = 0.1) -> SourceClassifier:
        """From the ``marks`` of labelled texts."""
        size = np.array([max(len(r), 1) for r in rows])
        at = np.concatenate([r if len(r) else np.zeros(1, dtype=np.int64) for r in rows])
        starts = np.cumsum(size) - size
        scale = (1 / np.sqrt(size)).astype(np.float32)[:, None]
        y = np.zeros((len(rows), len(self.sources)), dtype=np.float32)
        y[np.arange(len(rows)), [self.sources.index(s) for s in labels]] = 1
        m, s = np.zeros_like(self.weight), np.zeros_like(self.weight)
        for k in range(1, steps + 1):
            z = np.add.reduceat(self.weight[at], starts, axis=0) * scale + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - y) / len(rows)
            spread = np.repeat(g * scale, size, axis=0)
            grad = np.stack([np.bincount(at, weights=spread[:, j], minlength=BUCKETS) for j in range(y.shape[1])], axis=1).astype(np.float32)
            grad += 1e-5 * self.weight
            m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
            self.weight -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
            self.bias -= rate * g.sum(0)
        return self


def fitted(documents: DataFrame, sources: list[str], per_source: int = PER_SOURCE) -> SourceClassifier:
    """The classifier, fitted on about ``per_source`` labelled records of each source at most.

    Whole texts are reduced to their hashed marks (at most ``BUCKETS`` numbers each) where they
    lie; only those of the bounded sample come to the driver.
    """
    known = documents.where(F.col("source").isin(sources) & (F.length("text") > 0))
    counts = {r["source"]: r["count"] for r in known.groupBy("source").count().collect()}
    model = SourceClassifier(sources)
    if len(counts) < 2:
        model.bias[[k for k, s in enumerate(sources) if counts and s not in counts]] = -np.inf
        return model
    share = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(int(min(1.0, per_source / n) * 1_000_000)))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share[F.col("source")])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("source"), pa.array([marks(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], names=["source", "marks"])

    rows = sample.select("source", "text").mapInArrow(reduce, "source string, marks array<long>").collect()
    model.bias[[k for k, s in enumerate(sources) if s not in counts]] = -np.inf
    return model.fit([np.array(r.marks, dtype=np.int64) for r in rows], [r.source for r in rows])


class Rates:
    """Nonnegative document rates by projected gradient, kept as the residuals that made them.

    ``tokens`` t_d and membership P_d give the expected tokens of source s as sum of x_d t_d P_ds. The
    weighted squares of their distance to the goals, sum over s of (expected - goal)^2 / available, fall
    along x_d -= sum over s of P_ds (expected - goal) / available (the gradient by token), a step that
    never overshoots as memberships sum to 1. After each step rates are projected to [0, cap_d].
    Every document's rate follows from the few numbers of each past step, so no rates are stored.
    """

    def __init__(self):
        self.steps: list[np.ndarray] = []

    def of(self, member: np.ndarray, cap: np.ndarray) -> np.ndarray:
        x = np.zeros(len(cap))
        for r in self.steps:
            x = np.clip(x - member @ r, 0.0, cap)
        return x


def _membership(batch: pa.RecordBatch, sources: list[str]) -> np.ndarray:
    """Certain members of their named source; the posterior where there is none."""
    codes = pc.index_in(batch.column("source"), value_set=pa.array(sources, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, len(sources)))
    named = np.flatnonzero(codes >= 0)
    out[named, codes[named]] = 1.0
    out[codes < 0] = batch.column("posterior").flatten().to_numpy().reshape(-1, len(sources))
    return out


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents to use, with copies: doc_id, source, source_is_predicted, tokens, copies, rate, target_share, reached_share, unsettled.

    Sizes are tokens of the vocabulary over whole texts. A record of a named source belongs to it; a
    record without source has the posterior of a classifier fitted on the named ones (soft
    membership). Distributed projected-gradient least squares fits the rate of each document, at
    most ``max_repeats`` of its source (1 without source), so that the expected tokens of each
    source meet its target. Without ``total_tokens`` the goal is the largest total at which every
    source that has tokens can have its share within its cap; targets of sources without tokens
    are spread over the others in proportion. With ``total_tokens`` sources may fall short: they
    then stand at their cap.

    Rates become whole copies: every document gets the whole part, and of the documents of a source
    as many, in hash order, get one more as still fit into the source's tokens (and again while the cap allows it and
    tokens are left, as where one long document fits nowhere; within a 4096th of the source). The table of such slots that is broadcast has
    at most 4096 rows per source. ``reached_share`` counts the copies chosen, by named
    or most likely source. ``unsettled`` is by how much of the goal the expected tokens of a source
    still moved in the last step: at most ``CLOSE`` where the fit has converged within ``STEPS``.

    Records of sources without a target, and null, empty texts, are not used. Sources are not
    tasks: documents stay where they are read, and what returns to the driver is a few numbers per
    source and step, or per source and hash slot.
    """
    spark = documents.sparkSession
    goals = {r.source: (r.target_share, r.max_repeats) for r in targets.where("source IS NOT NULL AND target_share > 0").collect()}
    sources = sorted(goals)
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, source string, source_is_predicted boolean, tokens long, copies int, rate double, target_share double, reached_share double, unsettled double"
    if not sources:
        return spark.createDataFrame([], out)
    usable = documents.select("doc_id", "text", "source").where((F.length("text") > 0) & (F.col("source").isNull() | F.col("source").isin(sources)))
    classifier, merges = fitted(usable, sources), Merges(vocabulary)
    caps = np.array([float(goals[s][1] if goals[s][1] is not None else 1) for s in sources])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(merges)
        for whole in batches:
            for b in pieces(whole, "text"):
                texts, named = b.column("text").to_pylist(), b.column("source").to_pylist()
                _, offsets = encoder.encode(texts)
                open_rows = [i for i, s in enumerate(named) if s is None]
                post: list[list[float] | None] = [None] * len(texts)
                for i, p in zip(open_rows, classifier.posterior([texts[i] for i in open_rows]), strict=True):
                    post[i] = p.tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), pa.array(np.diff(offsets).astype("int64")), pa.array(post, pa.list_(pa.float64()))], names=["doc_id", "source", "tokens", "posterior"]
                )

    members = written(usable.mapInArrow(measure, f"doc_id {kind}, source string, tokens long, posterior array<double>"), shared_folder(spark)).where("tokens > 0")

    # named records of a source are alike: their tokens are summed once, only open records are passed over in each step
    certain = {r.source: r.tokens for r in members.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    held, one_each = np.array([float(certain.get(s, 0)) for s in sources]), np.eye(len(sources))
    unnamed = members.where("source IS NULL")

    def totals(rates: Rates, capped: bool = False) -> np.ndarray:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sources))
            for b in batches:
                p, t = _membership(b, sources), b.column("tokens").to_numpy().astype(float)
                cap = _caps(b, p, caps)
                total += (t * (cap if capped else rates.of(p, cap))) @ p
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["t"])

        open_part = np.sum([r.t for r in unnamed.mapInArrow(kernel, "t array<double>").collect()] or [np.zeros(len(sources))], axis=0)
        return open_part + held * (caps if capped else rates.of(one_each, caps))

    everything = Rates()
    everything.steps = [np.full(len(sources), -1.0)]
    available, within = totals(everything), totals(everything, capped=True)
    has = available > 0
    if not has.any():
        return spark.createDataFrame([], out)
    target = np.array([goals[s][0] for s in sources])
    aim = np.where(has, target, 0.0) / target[has].sum()
    wanted = total_tokens if total_tokens is not None else float((within[has] / aim[has]).min())
    rates = Rates()
    expected, unsettled = np.zeros(len(sources)), np.inf
    for _ in range(STEPS):
        rates.steps.append(np.where(has, (expected - wanted * aim) / np.where(has, available, 1.0), 0.0))
        before, expected = expected, totals(rates)
        unsettled = float(np.abs(expected - before).max() / wanted)
        if unsettled <= CLOSE:
            break

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _membership(b, sources)
            x = rates.of(p, _caps(b, p, caps))
            named = b.column("source").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array(sources, dtype=object)[p.argmax(1)], pa.string()), pa.array(~named), b.column("tokens"), pa.array(x)],
                names=["doc_id", "source", "source_is_predicted", "tokens", "rate"],
            )

    rated = members.mapInArrow(choose, f"doc_id {kind}, source string, source_is_predicted boolean, tokens long, rate double")
    rated = rated.withColumn("_slot", F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(SLOTS)).cast("int")).withColumn("_part", F.col("rate") - F.floor("rate"))
    slots = rated.groupBy("source", "_slot").agg(F.sum(F.col("_part") * F.col("tokens")).alias("due"), F.sum(F.when(F.col("_part") > 0, F.col("tokens"))).alias("have")).collect()
    base = np.floor(rates.of(np.eye(len(sources)), caps))
    taken: dict[tuple[str, int], int] = {}
    for s, cap, whole_part in zip(sources, caps, base, strict=True):
        own = sorted((r for r in slots if r.source == s and r.have), key=lambda r: r["_slot"])
        left = sum(r.due for r in own)
        for copy in range(1, max(int(cap - whole_part), 1) + 1):
            rest = []
            for r in own:
                if r.have <= left:
                    left -= r.have
                    taken[s, r["_slot"]] = copy
                else:
                    rest.append(r)
            if copy == 1:
                closest = min(rest, key=lambda r: r.have, default=None)
                if closest is not None and closest.have - left < left:
                    left -= closest.have
                    taken[s, closest["_slot"]] = 1
    extra = F.broadcast(spark.createDataFrame([(s, k, n) for (s, k), n in taken.items()], "source string, _slot int, _more int"))
    more = F.when(F.col("_part") > 0, F.coalesce("_more", F.lit(0))).otherwise(0)
    more = F.when(F.col("source_is_predicted"), F.least(more, F.lit(1))).otherwise(more)
    chosen = rated.join(extra, ["source", "_slot"], "left").withColumn("copies", (F.floor("rate") + more).cast("int")).where("copies > 0")
    reached = {r.source: r.tokens for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens")).collect()}
    whole = sum(reached.values()) or 1
    shares = F.create_map(*[x for s in sources for x in (F.lit(s), F.lit(reached.get(s, 0) / whole))])
    goal = F.create_map(*[x for s in sources for x in (F.lit(s), F.lit(float(goals[s][0])))])
    return chosen.select(
        "doc_id", "source", "source_is_predicted", "tokens", "copies", F.round("rate", 6).alias("rate"), goal[F.col("source")].alias("target_share"), shares[F.col("source")].alias("reached_share"), F.lit(unsettled).alias("unsettled")
    )


def _caps(batch: pa.RecordBatch, member: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Most copies of each document: those of its source, one where the source is not named."""
    named = batch.column("source").is_valid().to_numpy(zero_copy_only=False)
    return np.where(named, member @ caps, 1.0)


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: documents and tokens chosen, the share reached and the target; sources not chosen have zeros."""
    got = selection.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("reached_share").alias("reached_share")
    )
    names = ["documents", "copies", "most_copies", "tokens"]
    return targets.where("source IS NOT NULL").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], F.round(F.coalesce("reached_share", F.lit(0.0)), 6).alias("reached_share")
    )
