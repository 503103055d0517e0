"""Language identification in two levels: the family first, then the languages within it.

Families are told apart by linear support vector machines, one against the
rest; languages of one family by one machine for each pair, whose votes are
counted. All look at the same hashed character bigrams and trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import learnable, mapped, named, others, schema_of, slices, taken, written

#: Buckets of hashed n-grams; labelled rows that are learnt from at most (shared out evenly to the languages).
BUCKETS, SAMPLE_ROWS = 4096, 4000
#: Characters of a text that are looked at together.
BLOCK = 1 << 20
UNKNOWN = "und"

# ISO 639-1 codes by family. Another code is a family of its own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "Romance": "ca es fr gl it oc pt rm ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Celtic": "br cy ga gd",
    "Baltic": "lt lv",
    "Uralic": "et fi hu",
    "Turkic": "az kk ky tk tr tt uz",
    "Indo-Aryan": "bn gu hi mr ne pa si ur",
    "Iranian": "fa ku ps tg",
    "Dravidian": "kn ml ta te",
    "Semitic": "am ar he mt",
    "Malayo-Polynesian": "id jv ms su tl",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Roots of the counts of hashed bigrams and trigrams, of length 1, in half precision. Case and ASCII marks don't count."""
    out = np.zeros(BUCKETS)
    text = f" {text.lower()} "
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        low = c < 128
        c = np.where(low, _FOLD[np.where(low, c, 0)], c).astype(np.uint32)
        two = c[:-1] * np.uint32(2654435761) + c[1:] * np.uint32(40503)
        three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(2246822519)
        for h in (two[:BLOCK], three):  # each starts in this block, so none is counted twice
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            out += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    out[int(_SPACES)] = 0
    out = np.sqrt(out)
    return (out / max(np.linalg.norm(out), 1e-9)).astype("<f2").astype(float)


def _space_bucket() -> int:
    h = np.uint32([(32 * 2654435761 + 32 * 40503) & 0xFFFFFFFF])
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return int(h[0] >> np.uint32(20))


_SPACES = _space_bucket()


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss on some rows of x, by dual coordinate descent; y (of those rows) is -1 or 1."""
    rng = np.random.default_rng(seed)
    norms = np.array([x[r] @ x[r] for r in rows]) + 1 + 1 / (2 * cost)
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            row = x[rows[i]]
            gradient = y[i] * (row @ w + bias) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * row
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * x, -30, 30)))


@dataclass
class Model:
    """families: names. languages: those of each family. weights: a column for each family, then for each pair of each family."""

    families: list[str]
    languages: list[list[str]]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 for texts without letters, or if nothing could be learnt."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and has_letters(t)]
        if not known or not self.families:
            return names, scores
        margins = np.array([features(texts[i]) for i in known]) @ self.weights[:-1] + self.weights[-1]
        for i, m in zip(known, margins):
            f = int(m[: len(self.families)].argmax())
            score = float(_sigmoid(m[f])) if len(self.families) > 1 else 1.0
            inside = self.languages[f]
            at = len(self.families) + sum(len(x) * (len(x) - 1) // 2 for x in self.languages[:f])
            votes, belief = np.zeros(len(inside)), np.zeros(len(inside))
            for k, (a, b) in enumerate(combinations(range(len(inside)), 2)):
                p = float(_sigmoid(m[at + k]))
                votes[a if p >= 0.5 else b] += 1
                belief[a] += p
                belief[b] += 1 - p
            best = max(range(len(inside)), key=lambda k: (votes[k], belief[k]))
            names[i], scores[i] = inside[best], score * (belief[best] / (len(inside) - 1) if len(inside) > 1 else 1.0)
        return names, scores


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Learn both levels from features and languages."""
    names = sorted(set(langs))
    family = [FAMILY_OF.get(n, n) for n in names]
    families = sorted(set(family))
    languages = [[n for n, f in zip(names, family) if f == g] for g in families]
    y = np.array([names.index(n) for n in langs], int)
    of = np.array([families.index(f) for f in family], int)[y] if len(y) else y
    every = np.arange(len(y))
    columns = [linear_svm(x, every, np.where(of == k, 1, -1)) if len(families) > 1 else np.zeros(BUCKETS + 1) for k in range(len(families))]
    for inside in languages:
        for a, b in combinations([names.index(n) for n in inside], 2):
            mine = np.flatnonzero((y == a) | (y == b))
            columns.append(linear_svm(x, mine, np.where(y[mine] == a, 1, -1)))
    return Model(families, languages, np.array(columns).T if columns else np.zeros((BUCKETS + 1, 0)))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows documents at most, as many of each language where there are so many; never from ids that learnable() holds out.

    Those with the smallest hashes of their ids are taken; of a frequent
    language only the hashes under a bound that leaves about four times as many
    are ordered. Rows with a null id, language or text, or a text without
    letters, aren't learnt from. Rows of one id and language all take part, as
    one of the rows; an empty table gives a model that answers UNKNOWN.
    """
    known = docs.select(named(doc_id).alias("id"), named(lang).alias("y"), named(text).alias("text"))
    known = known.where(learnable(F.col("id")) & F.col("y").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull())
    counts = written(known.groupBy("y").agg(F.count(F.lit(1)).alias("rows")), "languages")
    each = max(1, rows // max(1, counts.count()))
    mark = F.xxhash64("id", F.lit(23))
    low = known.select("id", "y", mark.alias("mark")).join(counts, "y").where(F.pmod("mark", F.lit(1_000_000)) * F.col("rows") <= 4_000_000 * each + 1_000_000 * 20)
    best = low.distinct().withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.pmod("mark", F.lit(1_000_000)), "mark", "id"))).where(F.col("n") <= each)
    chosen = best.select("id", "y").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = [features(t).astype("<f2").tobytes() if t and has_letters(t) else None for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "y", "x"])

    picked = known.join(F.broadcast(chosen), ["id", "y"])  # at most rows
    found = picked.select("id", "y", "text").mapInArrow(run, schema_of(known, ["id", "y"], "x binary")).where("x is not null").orderBy("id", "y", "x").limit(rows).collect()
    x, langs = np.zeros((len(found), BUCKETS), "f4"), [r.y for r in found]
    for i, r in enumerate(found):
        x[i] = np.frombuffer(r.x, "<f2")
    del found
    return fit(x, langs)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of text: UNKNOWN and 0 for null texts and texts without letters.

    Repeated rows are judged alike, and an empty table gives an empty result.
    Of languages with equal votes that of the higher summed belief is taken,
    then the first by name. Columns named like the new ones are replaced. No
    shuffle.
    """
    rest = others(docs, text, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            names, scores = model.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(names, pa.string()), pa.array(np.round(scores, 9), pa.float64())], names=[*rest, "lang_pred", "score"])

    return mapped(docs, [*rest, text], run, schema_of(docs, rest, "lang_pred string, score double"))
