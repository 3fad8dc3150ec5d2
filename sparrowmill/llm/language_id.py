"""Language identification by hierarchical discrimination.

The language family is decided first, then one-versus-one linear support vector machines separate the languages of that
family. Features are relative frequencies of byte 1- to 4-grams, hashed; a score is linear in them, so whole texts are
scored in one vectorised pass without building a vector for each document.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows without id or language are never
learned from but are predicted. An empty table gives an empty result. Without any labelled row every text is `und`.
Repeated rows are predicted one by one, alike. Other columns are passed through by `identify` untouched.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import wordhash
from .tables import discard, documents, keyed_join, small_batches, written

UNKNOWN = "und"
#: Documents learned from, for each language: the bound of the training sample.
SAMPLE_PER_LANGUAGE = 300
#: The bound of all languages together, shared evenly by them; with more languages than that, one document each.
SAMPLE = 4800
#: How many times that number of ids is ranked, so that the hash range surely holds enough.
SPARE = 4
BINS = 1 << 13
LONGEST = 4
#: Columns of the training matrix that the driver works on at once.
_COLUMNS = [slice(at, at + 512) for at in range(0, BINS, 512)]

# Languages and their families.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "ast"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "indo-aryan": ["hi", "ur", "bn", "pa", "mr", "gu", "ne"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "semitic": ["ar", "he", "mt", "am"],
    "sinitic": ["zh", "yue"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bin of the n-gram at every byte; BINS where it would leave its row."""
    low = _LOWER[data].astype(np.uint32)
    rolled = np.zeros(len(low), np.uint32)
    starts, ends = offsets[:-1], offsets[1:]
    outside = np.zeros(len(low), bool)
    for n in range(1, LONGEST + 1):
        rolled = rolled * np.uint32(0x01000193)
        rolled[: max(len(low) - n + 1, 0)] += low[n - 1 :] + np.uint32(1)
        if n > 1:
            outside[(ends - n + 1)[ends - n + 1 >= starts]] = True
        bins = ((rolled ^ np.uint32(n * 0x9E37)) * np.uint32(2654435761) >> np.uint32(19)).astype(np.int32)
        bins[outside] = BINS
        yield bins


def frequencies(column: pa.Array) -> np.ndarray:
    """Relative n-gram frequencies, one row for each text (for the bounded training sample)."""
    data, offsets = wordhash.utf8(column)
    out = np.zeros((len(offsets) - 1, BINS), np.float32)
    for i, j in wordhash.chunks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(part):
            continue
        rows = np.repeat(np.arange(j - i), np.diff(at))
        for bins in _ngrams(part, at):
            inside = bins < BINS
            np.add.at(out, (rows[inside] + i, bins[inside]), 1.0)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def script(text: str) -> str:
    """The script of most letters of a text, as Unicode names it."""
    counts: Counter[str] = Counter()
    for char, n in Counter(text).items():
        if char.isalpha():
            counts[unicodedata.name(char, "unnamed").split()[0].lower()] += n
    return max(sorted(counts), key=counts.get, default="no")


@dataclass
class LanguageModel:
    """Linear machines; `pairs` names the two sides of each: families first, then languages of one family."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # (machines, BINS + 1), the last weight 0
    bias: np.ndarray

    def machines(self) -> dict[str | None, range]:
        """The machines that separate families (None) and those of each family."""
        out, at = {}, 0
        for name, sides in [(None, self.families), *sorted(self.families.items())]:
            n = len(sides) * (len(sides) - 1) // 2
            out[name] = range(at, at + n)
            at += n
        return out

    def margins(self, column: pa.Array, machines: range | None = None) -> np.ndarray:
        machines = range(len(self.pairs)) if machines is None else machines
        data, offsets = wordhash.utf8(column)
        out = np.zeros((len(offsets) - 1, len(machines)))
        for i, j in wordhash.chunks(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part) or not len(machines):
                continue
            total = np.zeros(j - i)
            for bins in _ngrams(part, at):
                total += np.diff(np.concatenate([[0], np.cumsum(bins < BINS)])[at])
                sums = np.zeros(len(part) + 1)
                for k, machine in enumerate(machines):
                    np.cumsum(self.weights[machine][bins], dtype=np.float64, out=sums[1:])
                    out[i:j, k] += np.diff(sums[at])
            out[i:j] /= np.maximum(total, 1)[:, None]
        return out + self.bias[machines.start : machines.stop]

    def decide(self, margins: np.ndarray, sides: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes of the one-versus-one machines (ties: larger mean confidence, then name), and its confidence; margins of all pairs of sides, in order."""
        n = len(margins)
        if len(sides) == 1:
            return np.zeros(n, int), np.ones(n)
        votes, faith = np.zeros((n, len(sides))), np.zeros((n, len(sides)))
        for k, (a, b) in enumerate(combinations(range(len(sides)), 2)):
            p = 1 / (1 + np.exp(-np.clip(2 * margins[:, k], -40, 40)))
            for side, q in ((a, p), (b, 1 - p)):
                votes[:, side] += q > 0.5
                faith[:, side] += q / (len(sides) - 1)
        best = np.argmax(votes + faith / 2, axis=1)
        return best, faith[np.arange(n), best]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Family by the machines of families, then language by those of that family alone."""
        n, machines = len(column), self.machines()
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.families:
            return lang, score
        names = sorted(self.families)
        family, sure = self.decide(self.margins(column, machines[None]), names)
        for k, name in enumerate(names):
            own = np.flatnonzero(family == k)
            if len(own):
                best, inner = self.decide(self.margins(column.take(pa.array(own)), machines[name]), self.families[name])
                lang[own], score[own] = np.array(self.families[name], object)[best], sure[own] * inner
        return lang, score


def _machine(gram: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient descent. y: +1 and -1; both sides weigh alike.

    The weights are a sum over the examples, so the steps need only the examples' products; returned are each example's share and the bias.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = 0.5 / (float((share * np.diag(gram)).sum()) + 1 + penalty)
    part = ahead = np.zeros(len(y))
    bias = ahead_bias = 0.0
    for step in range(steps):
        pull = share * y * np.maximum(0, 1 - y * (gram @ ahead + ahead_bias))
        new, new_bias = ahead - rate * (penalty * ahead - 2 * pull), ahead_bias + rate * 2 * float(pull.sum())
        ahead, ahead_bias = new + step / (step + 3) * (new - part), new_bias + step / (step + 3) * (new_bias - bias)
        part, bias = new, new_bias
    return part, bias


def _products(x: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Products of all pairs of the used rows; no copy of the whole matrix is made."""
    out = np.zeros((len(use), len(use)))
    for own in _COLUMNS:
        part = x[use, own]
        out += part @ part.T
    return out


def examples(rows: DataFrame) -> DataFrame:
    """(id, lang, script, bins, shares) from (id, lang, text): the n-gram frequencies above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                x = frequencies(part.column(2))
                at = [np.flatnonzero(row).astype(np.int32) for row in x]
                scripts = [script(text.as_py()) for text in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scripts), pa.array(at, pa.list_(pa.int32())), pa.array([row[own] for row, own in zip(x, at, strict=True)], pa.list_(pa.float32()))],
                    ["id", "lang", "script", "bins", "shares"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "lang", "text").mapInArrow(run, f"id {id_type}, lang string, script string, bins array<int>, shares array<float>")


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on at most `per_language` documents of each language and `sample` of all, those whose hashed ids come first.

    Distinct ids of each language are counted first, with partial sums. Only ids whose hash falls in a share of the hash range that
    holds SPARE times the wanted number are ranked, so a language with most of the rows costs no more than another, however
    many tasks read it. Tasks turn the chosen whole texts into n-gram frequencies, and these are what the driver gets.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.col(lang_col) != UNKNOWN))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    counts = written(known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")), "languages")  # one row a language
    per_language = min(per_language, max(sample // max(counts.count(), 1), 1))
    wanted = keyed_join(known, counts, "lang", "inner").where(place <= SPARE * per_language / F.greatest("n", F.lit(1)))
    ids = wanted.select("lang", "id", place.alias("place")).distinct()
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "id")))
    chosen = ranked.where(F.col("rank") <= per_language).select("id", "lang")
    texts = known.join(F.broadcast(chosen), ["id", "lang"], "left_semi")  # at most `sample` ids, or one a language
    texts = texts.groupBy("id", "lang").agg(F.min("text").alias("text")).where(F.col("text").rlike(r"\p{L}"))
    rows = examples(texts).toArrow().sort_by([("id", "ascending"), ("lang", "ascending")])
    discard(counts)
    langs = np.array(rows["lang"].to_pylist(), object)
    scripts: dict[str, Counter[str]] = {}
    for lang, one in zip(langs, rows["script"].to_pylist(), strict=True):
        scripts.setdefault(lang, Counter())[one] += 1
    families: dict[str, list[str]] = {}
    for lang in sorted(scripts):
        usual = max(sorted(scripts[lang]), key=scripts[lang].get)
        families.setdefault(FAMILY_OF.get(lang.split("-")[0].lower(), f"{usual} script"), []).append(lang)
    if not families:
        return LanguageModel({}, [], np.zeros((0, BINS + 1), np.float32), np.zeros(0))
    x = np.zeros((len(langs), BINS), np.float32)
    for row, bins, shares in zip(x, rows["bins"], rows["shares"], strict=True):
        row[bins.values.to_numpy()] = shares.values.to_numpy()
    del rows
    mean, deviation = x.mean(0, dtype=np.float64), np.concatenate([x[:, own].std(0, dtype=np.float64) for own in _COLUMNS]) + 1e-4
    x -= mean.astype(np.float32)
    x /= (deviation * np.sqrt(BINS)).astype(np.float32)
    family_of = np.array([next(f for f, own in families.items() if lang in own) for lang in langs], object)
    pairs, weights, bias = [], [], []
    for sides, group in [(sorted(families), family_of), *((own, langs) for _, own in sorted(families.items()))]:
        for a, b in combinations(sides, 2):
            use = np.flatnonzero((group == a) | (group == b))
            part, c = _machine(_products(x, use), np.where(group[use] == a, 1.0, -1.0))
            w = np.concatenate([part @ x[use, own] for own in _COLUMNS]) / deviation / np.sqrt(BINS)
            pairs.append((a, b))
            weights.append(np.append(w, 0).astype(np.float32))
            bias.append(c - float(w @ mean))
    return LanguageModel(families, pairs, np.array(weights).reshape(len(pairs), BINS + 1), np.array(bias))


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of `df` with the predicted language and its confidence in [0, 1]; columns of these names are replaced."""
    small_batches(df.sparkSession)
    df = df.drop(lang_out, score_out)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*df.schema.fields, StructField(lang_out, StringType()), StructField(score_out, DoubleType())])
    names = schema.fieldNames()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, letters = batch.columns
            lang, score = shared.value.predict(batch.column(text_col))
            empty = ~letters.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            lang[empty], score[empty] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names)

    return df.select("*", F.col(text_col).rlike(r"\p{L}").alias(f"{lang_out} has letters")).mapInArrow(predict, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents that aren't held out."""
    docs = documents(spark, sf_dir)
    out = held_out("doc_id", 4, 2)
    model = fit(docs.select("doc_id", "text", "lang").where(~out & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
