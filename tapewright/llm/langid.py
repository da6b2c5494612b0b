"""Language identification by hierarchical discrimination.

Linear models, one for each language family against the rest, first predict the family; one-versus-one linear support vector
machines then separate the languages within it. Features are hashed character n-grams (1 to 4 letters, words padded by a space) of the whole lower-cased
text; a model's value is the mean of its weights over a text's n-grams, so texts of any length are scored in one pass.

Training takes a bounded sample: TRAIN_ROWS rows in all, dealt evenly to the LANGUAGES commonest values of lang (ties: in their order), of each those
with the smallest hash of doc_id; so neither its size nor the model's follows the corpus, even if lang holds junk. Rarer values are not learned. Their n-grams are counted in tasks, so the driver gets
counts of at most 3 * BUCKETS buckets a row, however long the texts. Everything else covers all rows. Listed families bound the number of language
pairs, and an unlisted language is one more family, so a model has a column for each family and some 140 for pairs.

A text that is null or has no letters is 'und' with score 0. Rows with null or odd lang are only left out of training.
Repeated rows and null ids are predicted like any other. Where nothing can be learned (an empty table), every text is
'und'; with one known language every text with letters gets it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tapewright.llm.common import slices

#: The families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
}
TRAIN_ROWS = 1000
#: Values of lang that are learned at most; known languages of web corpora are fewer.
LANGUAGES = 250
BUCKETS = 1 << 13
ORDERS = (1, 2, 3, 4)
EPOCHS = 12
#: Texts are long enough for one training row to be cut into parts, which teaches the scale of short texts.
PART = 400


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(text: str) -> np.ndarray | None:
    """Hashed n-gram buckets of a text's letters; None if it has no letters.

    Whatever is no letter separates words; a word's n-grams see one space on either side.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return None
    letter = _letters(codes)
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    keep = (codes != 32) | np.concatenate([[False], codes[:-1] != 32])  # one space between words
    codes = np.concatenate([np.array([32], np.uint64), codes[keep], np.array([32], np.uint64)])
    out = []
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in ORDERS and len(h):
                ok = codes[: len(h)] != 32 if n == 1 else slice(None)
                x = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                out.append((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50))
    return np.concatenate(out).astype(np.int64) % BUCKETS


_KNOWN: dict[int, bool] = {}


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters, by a table for the first 64K and by lookup beyond."""
    low = np.minimum(codes, 0xFFFF)
    found = _TABLE[low]
    for i in np.flatnonzero(codes > 0xFFFF):
        c = int(codes[i])
        found[i] = _KNOWN.setdefault(c, chr(c).isalpha())
    return found


_TABLE = np.array([chr(i).isalpha() for i in range(0x10000)])


def _share(g: np.ndarray) -> np.ndarray:
    return np.bincount(g, minlength=BUCKETS).astype(np.float32) / len(g)


def _parts(text: str) -> list[bytes]:
    """Shares of a training text's n-grams, as float32 bytes: of the whole, and of two parts of a long one."""
    parts = (text, text[:PART], text[len(text) // 2 :][:PART]) if len(text) > 2 * PART else (text,)
    return [zlib.compress(_share(g).tobytes(), 1) for p in parts if (g := grams(p)) is not None]


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = EPOCHS, reg: float = 1e-4) -> np.ndarray:
    """A linear support vector machine on the given rows of x (hinge loss, averaged subgradient steps in a fixed order); y is -1 or 1."""
    order = np.random.default_rng(7)
    w, total, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0
    scale = 1.0 / max(1e-12, float(np.mean([x[r] @ x[r] for r in rows])))
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    for _ in range(rounds):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 32)):
            t += 1
            step = scale / np.sqrt(t)
            own = x[rows[batch]]
            hit = y[batch] * (own @ w) < 1
            w *= 1 - min(0.5, step * reg)
            if hit.any():
                w += np.float32(step / len(batch)) * ((y[batch] * weight[batch])[hit] @ own[hit])
            total += w
    return (total / max(1, t)).astype(np.float32)


class Model:
    """Weights by n-gram bucket, one column for each classifier: families against the rest first, then language pairs."""

    def __init__(self, langs: list[str], columns: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.weights, self.bias = langs, weights, bias
        self.families = sorted({family_of(x) for x in langs})
        self.members = {f: [x for x in langs if family_of(x) == f] for f in self.families}
        self.at = {c: i for i, c in enumerate(columns)}

    def family(self, values: np.ndarray) -> tuple[str, float]:
        """The family with the largest margin, and how far it leads, as 0 to 1."""
        if len(self.families) == 1:
            return self.families[0], 1.0
        margins = sorted(((float(values[self.at[f, ""]]), f) for f in self.families), reverse=True)
        return margins[0][1], float(1 / (1 + np.exp(-np.clip(2 * (margins[0][0] - margins[1][0]), -40, 40))))

    def language(self, names: list[str], values: np.ndarray) -> tuple[str, float]:
        """The winner of one-versus-one votes (ties: the larger sum of margins) and its weakest margin as 0 to 1."""
        if len(names) == 1:
            return names[0], 1.0
        votes, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            v = float(values[self.at[a, b]])
            votes[a if v >= 0 else b] += 1
            p = 1 / (1 + np.exp(-np.clip(4 * v, -40, 40)))
            for name, own, sign in ((a, p, v), (b, 1 - p, -v)):
                margins[name] += sign
                least[name] = min(least[name], own)
        best = max(names, key=lambda n: (votes[n], margins[n], n))
        return best, least[best]

    def values(self, g: np.ndarray) -> np.ndarray:
        """The mean weights of a text's n-grams; memory does not follow the text's length."""
        if not self.at:
            return np.zeros(0)
        if len(g) < BUCKETS:
            return self.weights[g].mean(axis=0, dtype=np.float64) + self.bias
        return np.bincount(g, minlength=BUCKETS) @ self.weights / len(g) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text and self.langs else None
        if g is None:
            return "und", 0.0
        values = self.values(g)
        fam, sure = self.family(values)
        lang, own = self.language(self.members[fam], values)
        return lang, float(min(1.0, max(0.0, sure * own)))


def fit(rows: list[tuple[bytes, str]]) -> Model:
    """A model of (shares of n-grams, lang) rows."""
    names = [lang for _, lang in rows]
    langs = sorted(set(names))
    if not langs:
        return Model([], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    x = np.empty((len(rows), BUCKETS + 1), np.float32)
    for i, (share, _) in enumerate(rows):
        x[i, :-1] = np.frombuffer(zlib.decompress(share), np.float32)
    met = np.count_nonzero(x[:, :-1], axis=0)
    idf = np.log((1 + len(x)) / (1 + met)).astype(np.float32) + 1
    x[:, :-1] *= idf
    x[:, -1] = np.sqrt(np.mean([r @ r for r in x[:, :-1]]))
    own, fams = np.array(names), np.array([family_of(n) for n in names])
    families = sorted(set(fams))
    columns, weights = [], []
    for f in families if len(families) > 1 else ():
        columns.append((f, ""))
        weights.append(fit_svm(x, np.arange(len(x)), np.where(fams == f, 1.0, -1.0).astype(np.float32)))
    for f in families:
        for a, b in combinations([n for n in langs if family_of(n) == f], 2):
            pick = np.flatnonzero((own == a) | (own == b))
            columns.append((a, b))
            weights.append(fit_svm(x, pick, np.where(own[pick] == a, 1.0, -1.0).astype(np.float32)))
    if not columns:
        return Model(langs, [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    w = np.stack(weights, axis=1)
    return Model(langs, columns, (w[:-1] * idf[:, None]).astype(np.float32), w[-1].astype(np.float64) * float(x[0, -1]))


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[bytes, str]]:
    """The bounded sample, as shares of n-grams: ids are chosen without their texts, then only the chosen texts are read."""
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    common = [r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(rows, LANGUAGES)).collect()]
    usable, rows = usable.where(F.col("lang").isin(common)), max(1, rows // max(1, len(common)))
    mixed = F.xxhash64(F.col("doc_id").cast("string"))
    w = Window.partitionBy("lang").orderBy(mixed, "doc_id")
    chosen = usable.select("lang", "doc_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows).select("doc_id").distinct()
    # at most TRAIN_ROWS ids
    picked = usable.join(F.broadcast(chosen), "doc_id", "left_semi")
    sample = picked.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [(d, lang, i, p) for d, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True) for i, p in enumerate(_parts(text))]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((b.column("doc_id").type, pa.string(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "part", "share"])

    counted = sample.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, part int, share binary")
    return [(bytes(r["share"]), r["lang"]) for r in counted.orderBy(mixed, "doc_id", "part").collect()]


def predict_languages(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs' columns doc_id, held_out, lang_pred and score, a row for each row of docs."""
    return with_language(docs.select("doc_id", "text"), fit(training_rows(docs, rows))).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score appended (columns of these names in docs are replaced)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each family and pair of languages in one
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text"):
            said = [m.predict(x) for x in b.column("text").to_pylist()]
            columns = [*b.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
