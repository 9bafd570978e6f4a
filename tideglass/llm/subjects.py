"""Subject areas of texts: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.bpe import pieces
from tideglass.session import shared_folder, written

SENTENCE = regex.compile(r"[.!?。！？;；\n]+")
WORD = regex.compile(r"\p{Han}+|[\p{L}--\p{Han}]+", flags=regex.V1)
MARKS = regex.compile(r"\p{M}+")
SIGNS_OF_DAMAGE = regex.compile(r"[ÃÂâåæçèéäãï][\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸŽž�]")
REMEMBERED = 200_000
#: Labelled texts that training uses at most, spread evenly over all of them.
MOST_LABELLED = 12_000
PARTS, STEPS, FIRST, BUCKETS, WIDTH = 8, 45, 20, 1 << 16, 16


def repaired(text: str) -> str:
    """UTF-8 that was read as a one-byte encoding, read again; other texts unchanged."""
    if len(SIGNS_OF_DAMAGE.findall(text)) * 50 < len(text):
        return text
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            raw += bytes([ord(c)]) if ord(c) < 256 else b"?"
    return raw.decode("utf-8", errors="ignore")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence, in lower case without accents; runs of Han script give their character pairs."""
    if not text:
        return []
    plain = MARKS.sub("", unicodedata.normalize("NFKD", repaired(text).lower()))
    out = []
    for part in SENTENCE.split(plain):
        words: list[str] = []
        for w in WORD.findall(part):
            if "⺀" <= w[0]:
                words += [w[i : i + 2] for i in range(max(len(w) - 1, 1))]
            elif len(w) > 1:
                words.append(w)
        if words:
            out.append(words)
    return out


def features(word: str, buckets: int) -> list[int]:
    """Hashed ids of a word and its character sequences of three to five."""
    marked = f"<{word}>"
    parts = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [xxhash.xxh32_intdigest(p.encode()) % buckets for p in sorted(parts)]


class Model:
    """Embeddings of hashed features, one logistic output per subject, and how shares become a decision.

    A word's vector is the mean of its features, a sentence's vector the mean of its words. Each
    sentence has an independent logistic output per subject; the mean of these over a text's
    sentences is the share of the text that is about the subject, and a logistic of that share
    says whether the text as a whole is.
    """

    def __init__(self, subjects: list[str], buckets: int, width: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.subjects, self.buckets = subjects, buckets
        k = len(subjects)
        self.values = {
            "embed": (rng.standard_normal((buckets, width)) * 0.01).astype(np.float32),
            "out": (rng.standard_normal((width, k)) * 4).astype(np.float32),
            "bias": np.full(k, -2.0, dtype=np.float32),
            "steep": np.full(k, 16.0, dtype=np.float32),
            "share": np.full(k, 0.17, dtype=np.float32),
        }


def _mean(x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0) / counts[:, None] if len(starts) else np.zeros((0, x.shape[1]), x.dtype)


def _scatter(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=x[:, j], minlength=size) for j in range(x.shape[1])], axis=1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Prepared:
    """Texts as arrays: distinct words with their features, word occurrences, sentences, texts."""

    def __init__(self, texts: list[list[list[str]]], buckets: int, memory: dict[str, list[int]] | None = None):
        memory = {} if memory is None else memory
        index: dict[str, int] = {}
        occ, sizes, owner = [], [], []
        for d, parts in enumerate(texts):
            for words in parts:
                occ += [index.setdefault(w, len(index)) for w in words]
                sizes.append(len(words))
                owner.append(d)
        per_word = []
        for w in index:
            f = memory.get(w)
            if f is None:
                f = memory[w] = features(w, buckets)
            per_word.append(f)
        self.texts = len(texts)
        self.word_count = np.array([len(f) for f in per_word], dtype=np.int64)
        self.feature = np.array([x for f in per_word for x in f], dtype=np.int64)
        self.word_start = np.cumsum(self.word_count) - self.word_count
        self.occ, self.size, self.owner = np.array(occ, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.parts = np.maximum(np.bincount(self.owner, minlength=self.texts), 1) if len(owner) else np.ones(self.texts, dtype=np.int64)

    @classmethod
    def of(cls, arrays: dict) -> Prepared:
        """From the arrays of another (``vars``), as they travel between tasks."""
        out = cls.__new__(cls)
        out.__dict__.update(arrays)
        return out

    def forward(self, v: dict[str, np.ndarray]):
        words = _mean(v["embed"][self.feature], self.word_start, self.word_count)
        sent = _mean(words[self.occ], self.start, self.size) if len(self.occ) else np.zeros((0, v["embed"].shape[1]), np.float32)
        p = _sigmoid(sent @ v["out"] + v["bias"])
        share = np.stack([np.bincount(self.owner, weights=p[:, j], minlength=self.texts) for j in range(p.shape[1])], axis=1) / self.parts[:, None]
        return words, sent, p, share

    def gradient(self, v: dict[str, np.ndarray], labels: np.ndarray, inherit: bool = False) -> dict[str, np.ndarray]:
        """Gradient of the summed cross-entropy of these texts; with ``inherit`` that of their sentences, each under its text's labels."""
        words, sent, p, share = self.forward(v)
        if inherit:
            grads = {}
            dz = ((p - labels[self.owner]) / self.parts[self.owner][:, None]).astype(np.float32)
        else:
            away = share - v["share"]
            g = _sigmoid(v["steep"] * away) - labels
            grads = {"steep": (g * away).sum(0), "share": -(g * v["steep"]).sum(0)}
            dp = (g * v["steep"] / self.parts[:, None])[self.owner]
            dz = (dp * p * (1 - p)).astype(np.float32)
        grads |= {"out": sent.T @ dz, "bias": dz.sum(0)}
        dsent = dz @ v["out"].T / self.size[:, None]
        dword = _scatter(np.repeat(dsent, self.size, axis=0), self.occ, len(self.word_count)) / self.word_count[:, None]
        grads["embed"] = _scatter(np.repeat(dword, self.word_count, axis=0), self.feature, len(v["embed"]))
        return grads


RATES = {"embed": 0.1, "out": 0.05, "bias": 0.03, "steep": 0.05, "share": 0.0005}


class Adam:
    def __init__(self, values: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.s = {k: np.zeros_like(v) for k, v in values.items()}
        self.t = 0

    def step(self, values: dict[str, np.ndarray], grads: dict[str, np.ndarray], pace: float = 1.0) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g.astype(np.float32)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.99 * self.s[k] + 0.01 * g * g
            up = self.m[k] / (1 - 0.9**self.t)
            values[k] = values[k] - pace * RATES[k] * up / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-6)


def smoothed(labels: np.ndarray, noise: float = 0.02) -> np.ndarray:
    """Labels pulled in by the share of them taken to be wrong."""
    return labels * (1 - 2 * noise) + noise


def _labelled(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Text and subjects of the labelled documents; an even sample by hash where there are more than ``most``."""
    by = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    n = by.count()
    if n > most:
        by = by.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(most / n * 1_000_000)))
    return documents.select("doc_id", "text").join(by, "doc_id").where("text IS NOT NULL")


#: Letters of training texts that go into one packed piece at most (beside a single longer text).
PACKED = 8_000_000


def train(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MOST_LABELLED, steps: int = STEPS, parts: int = PARTS) -> Model | None:
    """Fit the model on the labelled documents; None where there are none.

    The labelled texts are turned into arrays once, in ``parts`` partitions, and written to the
    shared folder. In the first ``FIRST`` steps each sentence counts under its text's labels, which
    finds the words of each subject; from then on a text counts by the share of its sentences. Each
    step puts the model (a fixed 4 MB) there, each partition gives the
    gradient of its texts (summed over its pieces), the gradients are summed and one Adam step is taken: the same as one
    step over all labelled texts at once. What comes back per step is bounded by parts times model
    size, whatever the number of texts.
    """
    spark = documents.sparkSession
    place = {s: k for k, s in enumerate(subjects)}

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickled((vars(Prepared(texts, BUCKETS)), np.array(marks, dtype=np.float32)))], pa.binary())], names=["arrays"])

        texts, marks, letters = [], [], 0
        for b in batches:
            for text, own in zip(b.column("text").to_pylist(), b.column("subjects").to_pylist(), strict=True):
                parts_of = sentences(text)
                if parts_of:
                    texts.append(parts_of)
                    marks.append([1.0 if s in own else 0.0 for s in place])
                    letters += len(text)
                if letters > PACKED:
                    yield packed()
                    texts, marks, letters = [], [], 0
        if texts:
            yield packed()

    sample = _labelled(documents, labels, most).repartition(parts, "doc_id").select("text", "subjects")
    folder = shared_folder(spark)
    ready = written(sample.mapInArrow(prepare, "arrays binary"), f"{folder}/texts")
    if ready.isEmpty():
        return None
    model = Model(subjects, BUCKETS, WIDTH)
    adam = Adam(model.values)
    for k in range(steps):
        values = model.values
        current = SharedFile(folder, f"model-{k}").write(values)

        def work(batches: Iterator[pa.RecordBatch], current=current, inherit=k < FIRST) -> Iterator[pa.RecordBatch]:
            values, whole, seen = current.read(), None, []
            for b in batches:
                for blob in b.column("arrays").to_pylist():
                    arrays, marks = unpickled(blob)
                    texts = Prepared.of(arrays)
                    grads = texts.gradient(values, smoothed(marks), inherit)
                    seen.append(np.unique(texts.feature))
                    whole = grads if whole is None else {name: whole[name] + g for name, g in grads.items()}
            if whole is not None:
                rows = np.unique(np.concatenate(seen))
                whole["embed"] = (rows.astype(np.int32), whole["embed"][rows])
                yield pa.RecordBatch.from_arrays([pa.array([pickled(whole)], pa.binary())], names=["grads"])

        total = {name: np.zeros_like(v) for name, v in values.items()}
        for row in ready.mapInArrow(work, "grads binary").collect():
            for name, g in unpickled(row.grads).items():
                if name == "embed":
                    total[name][g[0]] += g[1]
                else:
                    total[name] += g.astype(np.float32)
        adam.step(model.values, total, 1.0 if k < 0.6 * steps else 0.3)
        current.delete()
    model.values["share"] = model.values["share"] + _offset(ready, SharedFile(folder, "model").write(model.values))
    return model


#: Shifts of the decision that calibration tries.
OFFSETS = np.round(np.arange(-0.1, 0.051, 0.01), 2)


def _offset(ready: DataFrame, model: SharedFile) -> float:
    """The shift of the decided share with the best F1 over the labelled texts; the middle one of those about as good."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = model.read()
        for b in batches:
            for blob in b.column("arrays").to_pylist():
                arrays, marks = unpickled(blob)
                *_, share = Prepared.of(arrays).forward(values)
                hits = [share > values["share"] + o for o in OFFSETS]
                yield pa.RecordBatch.from_arrays([pa.array([[float((h & (marks > 0)).sum()) for h in hits]]), pa.array([[float(h.sum()) for h in hits]]), pa.array([float(marks.sum())])], names=["both", "said", "true"])

    rows = ready.mapInArrow(count, "both array<double>, said array<double>, true double").collect()
    both, said = np.sum([r.both for r in rows], axis=0), np.sum([r.said for r in rows], axis=0)
    f1 = 2 * both / np.maximum(said + sum(r.true for r in rows), 1)
    good = np.flatnonzero(f1 >= f1.max() - 0.002)
    return float(OFFSETS[good[len(good) // 2]])


class SharedFile:
    """Bytes in the shared folder that the driver writes and every task can read.

    For what changes with each step: as part of a task it would stay in every executor's block
    store and temporary files until garbage collection.
    """

    def __init__(self, folder: str, name: str):
        self.uri = f"{folder}/{name}"

    def _place(self):
        return pa.fs.FileSystem.from_uri(self.uri)

    def write(self, x: object) -> SharedFile:
        system, path = self._place()
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(pickled(x))
        return self

    def read(self) -> object:
        system, path = self._place()
        with system.open_input_stream(path) as f:
            return unpickled(f.read())

    def delete(self) -> None:
        system, path = self._place()
        system.delete_file(path)


def pickled(x: object) -> bytes:
    return pickle.dumps(x, protocol=5)


def unpickled(blob: bytes) -> object:
    return pickle.loads(blob)


def subjects_of(documents: DataFrame, model: Model | None) -> DataFrame:
    """Rows (doc_id, subject, share) for each subject a text is about; ``share`` of its sentences.

    Every text is read whole, in one pass without an exchange. Null, empty and blank texts, and
    texts without a word, have no subject. Without a model (no labels) nothing has.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject string, share double"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    names, buckets = model.subjects, model.buckets
    final = SharedFile(shared_folder(documents.sparkSession), "model").write(model.values)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = final.read()
        memory: dict[str, list[int]] = {}
        for whole in batches:
            for batch in pieces(whole, "text", 1_000_000):
                if len(memory) > REMEMBERED:
                    memory.clear()
                texts = Prepared([sentences(t) for t in batch.column("text").to_pylist()], buckets, memory)
                *_, share = texts.forward(values)
                row, which = np.nonzero((share > values["share"]) & (np.bincount(texts.owner, minlength=texts.texts) > 0)[:, None])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(np.array(names, dtype=object)[which], pa.string()), pa.array(share[row, which].astype(float))],
                    names=["doc_id", "subject", "share"],
                )

    return documents.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(kernel, schema)
