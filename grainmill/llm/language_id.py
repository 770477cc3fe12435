"""Language identification by string kernels.

A text's features are the character n-grams of lengths SPECTRUM that it has, hashed to WIDTH places; how often does not
count. The blended-spectrum presence kernel of two texts is the number of features they share, over the geometric mean
of their numbers of features. Kernel ridge regression, one language against the rest, is done in the span of LANDMARKS
texts (Nyström): with K the kernels of the sample with the landmarks and W those among the landmarks, the weights of the
features K W^(-1/2) solve a ridge system of that size. Prediction is batched matrix products: presence rows times
landmarks, times weights.

A text is rejected if its best score is below the level of its SIZES class. Levels are set on the labelled sample: what its
texts score that the fit has not seen (two halves, each scored by the other's fit), and what a language's texts score
if it is left out. Nearly all of the first are at or above a level, and a level is no higher than it must be to be above
nine tenths of the second; so texts of two learned languages stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm import pretokens
from grainmill.llm._common import ship, table

SPECTRUM, WIDTH = (1, 2, 3, 4), 1 << 13
#: The bounded sample of labelled rows that the classifier is fitted on, for each language, by hash of doc_id; and how
#: many of them, for each language, are landmarks; with many languages fewer of each, so that the model stays in bounds.
SAMPLE, LANDMARKS, MOST_LANDMARKS, RIDGE = 800, 64, 2048, 1e-3
#: Of each sampled text, also so many characters from a hashed place: short texts must be told as well as long ones.
SNIPPETS = (12, 40, 160)
#: Rows and characters of a presence matrix.
ROWS, CHARACTERS = 256, 4 << 20
UNKNOWN = "und"
#: Classes of texts by their numbers of features, at most so many and then more; a long text has most of the WIDTH places.
SIZES = (64, 192, 512, 2048, 5000)
#: Shares of the sample's own texts below a level and of left-out ones above it, at most; rows that a class needs for one.
LOST, PASSED, LEAST_ROWS = 0.001, 0.1, 50


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which places its n-grams hash to. Runs of non-letters count as one space."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _presence(np.insert(codes, np.cumsum([0, *map(len, lower)]), END), len(texts))


#: Stands between texts; no code point has this number.
END = 0x110000
_LETTER = None


def _letters() -> np.ndarray:
    """Which code points are letters, a table made once for a worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((i < END and chr(i).isalpha() for i in range(END + 1)), dtype=bool, count=END + 1)
    return _LETTER


def _presence(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WIDTH), dtype=np.float32)
    ends = codes == END
    codes = np.where(_letters()[codes] | ends, codes, 32)
    kept = ~((codes[1:] == 32) & (codes[:-1] == 32))
    codes = codes[np.concatenate([[True], kept])].astype(np.uint64)
    text = np.cumsum(codes == END) - 1
    flat = out.reshape(-1)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    gram, inside = np.zeros(len(codes), dtype=np.uint64), np.ones(len(codes), dtype=bool)
    for size in range(1, max(SPECTRUM) + 1):
        if len(codes) < size:
            break
        m = len(codes) - size + 1
        gram = (gram[:m] ^ mixed[size - 1 :]) * np.uint64(0xBF58476D1CE4E5B9)
        inside = inside[:m] & (codes[size - 1 :] != END)
        if size in SPECTRUM:
            place = ((gram ^ gram >> np.uint64(29)) * np.uint64(0x94D049BB133111EB + size * 2)) >> np.uint64(64 - WIDTH.bit_length() + 1)
            flat[(text[:m] * WIDTH + place.astype(np.int64))[inside]] = 1
    return out


def normed(rows: np.ndarray) -> np.ndarray:
    """Presence rows over the roots of their numbers of features: their products are kernels."""
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def fit(bits: np.ndarray, labels: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """landmarks' rows (transposed), weights and names, from presence rows as bits, their labels and the landmarks' numbers."""
    marks, kernels = _kernels(bits, landmarks)
    weights, names = _solved(kernels, kernels[landmarks], labels)
    return marks.T.astype(np.float32), weights, names


def _kernels(bits: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    marks = normed(unpacked(bits[landmarks]))
    return marks, np.concatenate([normed(unpacked(bits[at : at + ROWS])) @ marks.T for at in range(0, len(bits), ROWS)]).astype(np.float64)


def _solved(kernels: np.ndarray, among: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list]:
    """Weights and names, of the rows' kernels with the landmarks, and the landmarks' own."""
    names = sorted(set(labels.tolist()))
    value, vector = np.linalg.eigh(among)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.hstack([kernels @ root, np.ones((len(kernels), 1))])
    labelled = labels[:, None] == np.array(names)[None, :]
    # Each language weighs the same against the rest, however many rows it has.
    weight = (labelled / np.maximum(labelled.sum(axis=0), 1)).sum(axis=1, keepdims=True)
    target = np.where(labelled, 1.0, -1.0)
    system = phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(system, phi.T @ (weight * target))
    return np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32), names


def levels(bits: np.ndarray, labels: np.ndarray, landmarks: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The level of each class of SIZES, of what fit() gets and the number of the text that each row is of.

    Without LEAST_ROWS rows of both kinds a class has no level, and nothing of it is rejected.
    """
    _, kernels = _kernels(bits, landmarks)
    sizes = np.searchsorted(SIZES, np.bitwise_count(bits).sum(axis=1))

    def best(train: np.ndarray, test: np.ndarray) -> np.ndarray:
        out, at = np.full(len(bits), np.nan), np.flatnonzero(train[landmarks])
        if len(at) and test.any():
            weights, _ = _solved(kernels[np.ix_(train, at)], kernels[np.ix_(landmarks[at], at)], labels[train])
            out[test] = (kernels[np.ix_(test, at)] @ weights[:-1] + weights[-1]).max(axis=1)
        return out

    half = text % 2 == 0
    own = np.where(half, best(~half, half), best(half, ~half))
    foreign = np.full(len(bits), np.nan)
    for name in set(labels.tolist()):
        foreign = np.where(labels == name, best(labels != name, labels == name), foreign)
    out = np.full(len(SIZES) + 1, -np.inf)
    for c in range(len(out)):
        kept, strange = (x[(sizes == c) & ~np.isnan(x)] for x in (own, foreign))
        if min(len(kept), len(strange)) >= LEAST_ROWS:
            out[c] = min(np.quantile(kept, LOST, method="lower"), np.quantile(strange, 1 - PASSED))
    return out


def scores(texts: list[str], model) -> np.ndarray:
    return _scores(presence(texts), model)


def _scores(rows: np.ndarray, model) -> np.ndarray:
    marks, weights = model[:2]
    kernels = normed(rows) @ marks
    return kernels @ weights[:-1] + weights[-1]


def known(texts: list[str], model) -> np.ndarray:
    """Whether each text, which has a letter, is in a learned language: its best score is not below its class's level."""
    rows = presence(texts)
    return _scores(rows, model).max(axis=1) >= model[3][np.searchsorted(SIZES, rows.sum(axis=1))]


def groups(texts: list[str]):
    """Ranges of up to ROWS texts and about CHARACTERS characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= ROWS or n + len(t) > CHARACTERS):
            yield at, i
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)


def _snippets(text: str, number: int) -> list[str]:
    out = [text]
    for k, size in enumerate(SNIPPETS):
        if len(text) > size:
            at = (number * 2654435761 + k * 40503) % (len(text) - size + 1)
            out.append(text[at : at + size])
    return out


def _sampled(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        out = [i for i, t in enumerate(texts) if has_letter(t)]
        packed = [np.packbits(presence(_snippets(texts[i], h)).astype(bool), axis=1).tobytes() for i, h in zip(out, (batch.column("h")[i].as_py() for i in out), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(out, pa.int64())), batch.column("h").take(pa.array(out, pa.int64())), pa.array(packed, pa.binary())], names=["lang", "h", "rows"])


def learn(docs: DataFrame, learnable, rejecting: bool = True) -> tuple | None:
    """The model, from a sample of the rows of docs(doc_id, text, lang) for which learnable holds and lang is not null.
    If it is to reject, with levels.

    Presence rows are made where the texts are; what comes to the driver has a bound: SAMPLE rows of WIDTH / 8 bytes, and
    their snippets', for each language. None if there is nothing to learn from. Of a very long text the whole is one row.
    """
    labelled = docs.where(learnable & F.col("lang").isNotNull()).select("lang", "doc_id", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    h = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * SAMPLE / n))])
    drawn = labelled.withColumn("h", h).where(F.col("h") < share[F.col("lang")] * F.lit(float(1 << 40)))
    rows = drawn.select("lang", "h", "text").mapInArrow(_sampled, "lang string, h long, rows binary")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("rows")))
    found = sorted(rows.withColumn("k", first).where(F.col("k") <= SAMPLE).collect(), key=lambda r: (r["lang"], r["k"]))
    if not found:
        return None
    bits = [np.frombuffer(r["rows"], dtype=np.uint8).reshape(-1, WIDTH // 8) for r in found]
    labels = np.array([r["lang"] for r, b in zip(found, bits, strict=True) for _ in range(len(b))])
    marks = []
    at, most = 0, max(1, min(LANDMARKS, MOST_LANDMARKS // len(sizes)))
    for r, b in zip(found, bits, strict=True):
        if r["k"] <= most:
            marks.append(at + (r["k"] % len(b)))
        at += len(b)
    text = np.repeat([r["k"] for r in found], [len(b) for b in bits])
    bits, marks = np.concatenate(bits), np.array(marks)
    return (*fit(bits, labels, marks), levels(bits, labels, marks, text) if rejecting else None)


def _predict(shared, keep: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at, to in groups([texts[i] for i in known]):
                part = known[at:to]
                f = scores([texts[i] for i in part], model)
                best = f.argmax(axis=1)
                score[part] = np.clip((1 + f.max(axis=1)) / 2, 0, 1)
                for i, b in zip(part, best.tolist(), strict=True):
                    lang[i] = model[2][b]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return run


def identify(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    """keep, lang_pred and score (0 to 1) for each row: of its whole text, null or without a letter: `und` and 0.

    Without a model (nothing to learn from) all rows are `und`. Rows are predicted one by one, so repeated rows agree.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # up to MOST_LANDMARKS (or one for each language) * WIDTH floats, 64 MB, whatever the corpus
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    return rows.select(*keep, "text").mapInArrow(_predict(shared, keep), ", ".join([*kept, "lang_pred string", "score double"]))


def _keep_known(shared, at: int):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lettered = [i for i, t in enumerate(texts) if has_letter(t)]
            sure = np.zeros(len(texts), dtype=bool)
            for a, b in groups([texts[i] for i in lettered]):
                part = lettered[a:b]
                sure[part] = known([texts[i] for i in part], model)
            yield batch.filter(pa.array(sure))

    return run


def select_known(rows: DataFrame, model) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language: it has a letter, and its best score is not below its class's level."""
    ship(rows.sparkSession)
    at = [f.name for f in rows.schema.fields].index("text")
    return rows.mapInArrow(_keep_known(rows.sparkSession.sparkContext.broadcast(model), at), rows.schema)


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of documents; extra columns are not read. A null text, or one without
    a letter, is `und` with 0; a null doc_id is not learnt from. Rows that repeat each give a row, and equal texts equal ones."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(docs, learnable(F.col("doc_id")), rejecting=False)
    return identify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
