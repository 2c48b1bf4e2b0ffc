"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The classifier, its lexicon included, is fit on a bounded sample of labelled rows; features and scores cover every
row and every whole text. The lexicon holds word beginnings with the labelled rows that hold them. For the rows that
the trees learn from, a row's own label is taken out of those counts, so that no feature holds its answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled rows that the classifier is fit on at most: those of the smallest key hashes.
SAMPLE_ROWS = 30_000
#: Letters of a word's beginning: words shorter than the first count whole.
STEMS = (4, 6)
WORD = re.compile(r"[^\W\d_]+")
#: Letters with digits or signs between them, or before them in their place.
MIXED = re.compile(r"(?<!\w)[@$\d]?[^\W\d_]*+(?:[\d@$!*.|+_-]++[^\W\d_]++)+")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
#: Signs that stand for letters.
LEET = str.maketrans("013457@$!|+", "oieastasiit")
LEET_ONLY = re.compile(r"[^\W\d_]+")
#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine deinen deiner euch euer eure ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra eres".split())
NEAR = 5
NAMES = ("strong", "strong_log", "weighted", "top", "weak", "second", "near_second", "capitals", "shouted", "exclaimed", "punctuation", "signs", "mixed", "mixed_hits", "words_log", "digits", "word_length", "runs")


def _classes() -> np.ndarray:
    """Class of a code point below 256: 1 capital, 2 small letter, 3 digit, 4 exclamation or question mark, 5 other punctuation, 6 other sign."""
    out = np.zeros(256, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "!?" else 5 if c in ".,;:'\"()-" else 6 if not c.isspace() and c.isprintable() else 0
    return out


CLASSES = _classes()


def confidence(toxic: int, clean: int) -> float:
    """A cautious share of toxic rows among those that hold a word."""
    if toxic < 2:
        return 0.0
    n = toxic + clean
    p = (toxic + 0.5) / (n + 1.0)
    return p - math.sqrt(p * (1 - p) / (n + 1.0))


def stems(word: str) -> tuple[str, ...]:
    return tuple(word[:n] for n in STEMS if len(word) >= n) or (word,)


class Lexicon:
    """Confidence of each stem: as counted, and with one toxic or one clean row left out."""

    def __init__(self, counts: dict[str, tuple[int, int]], base: float):
        self.base = base
        self.all = {s: c for s, (t, n) in counts.items() if (c := confidence(t, n)) > base + 0.1}
        self.less = {1: {s: confidence(t - 1, n) for s, (t, n) in counts.items() if s in self.all}, 0: {s: confidence(t, max(0, n - 1)) for s, (t, n) in counts.items() if s in self.all}}

    def features(self, text: str, own: int | None = None) -> list[float]:
        """The values of NAMES; own: the label to leave out of the lexicon's counts."""
        lex = self.all if own is None else self.less[own]
        low = text.lower()
        words = WORD.findall(low)
        n = max(1, len(words))
        a, b = STEMS
        hits = [(i, max(lex.get(w[:a], 0.0), lex.get(w[:b], 0.0) if len(w) >= b else 0.0)) for i, w in enumerate(words) if w[:a] in lex or w[:b] in lex]
        hits = [(i, c) for i, c in hits if c > self.base + 0.1]
        second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        mixed = MIXED.findall(low)
        hidden = ["".join(LEET_ONLY.findall(m.translate(LEET))) for m in mixed] + ["".join(LEET_ONLY.findall(m)) for m in SPACED.findall(low)]
        hidden_hits = [c for w in hidden for s in stems(w) if (c := lex.get(s, 0.0)) > 0.5]
        strong = sum(c > 0.7 for _, c in hits)
        near, k = 0, 0
        for i, c in hits:
            if c > 0.5 and second:
                while k < len(second) and second[k] < i - NEAR:
                    k += 1
                near += k < len(second) and second[k] <= i + NEAR
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = np.bincount(CLASSES[np.minimum(points, 255)], minlength=7)
        chars, letters = max(1, len(points)), max(1, int(kinds[1] + kinds[2]))
        runs = int(((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2])).sum()) if len(points) > 2 else 0
        shouted = len(SHOUTED.findall(text))
        return [
            strong / n,
            math.log1p(strong),
            sum(c for _, c in hits) / n,
            max([0.0, *(c for _, c in hits), *hidden_hits]),
            len(hits) / n,
            len(second) / n,
            near / n,
            kinds[1] / letters,
            shouted / n,
            kinds[4] / chars,
            kinds[5] / chars,
            kinds[6] / chars,
            len(mixed) / n,
            len(hidden_hits) / n,
            math.log1p(len(words)),
            kinds[3] / chars,
            letters / n,
            runs / chars,
        ]


SHOUTED = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{2,}(?!\w)")


class Trees:
    """Gradient-boosted regression trees for a logistic loss, over features cut into bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0, leaf_rows: int = 5):
        self.trees, self.depth, self.rate, self.bins, self.least, self.leaf_rows = trees, depth, rate, bins, least, leaf_rows

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(v := x[:, j]) else np.zeros(0) for j in range(x.shape[1])]
        # values that few rows have, as lexicon hits, get bins of their own
        self.cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 17))])) if len(v := x[:, j][x[:, j] > 0]) else c for j, c in enumerate(self.cuts)]
        b, p = self._bin(x), float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.start, self.nodes = math.log(p / (1 - p)), []
        raw = np.full(len(y), self.start)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            tree, at = [], np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                splits = []
                for node in range(2**level):
                    mine = at == node
                    splits.append(self._split(b[mine], g[mine], h[mine]))
                tree.append(splits)
                f, c = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
                at = 2 * at + (b[np.arange(len(b)), f[at]] >= c[at])
            leaves = np.bincount(at, weights=g, minlength=2**self.depth) / (np.bincount(at, weights=h, minlength=2**self.depth) + self.least)
            raw += self.rate * leaves[at]
            self.nodes.append((tree, leaves))
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """Feature and first bin of the right side; a split that gains nothing sends all to the left. Ties: the first feature and bin."""
        best, out = 1e-9, (0, 1 << 30)
        if len(g) < 2 * self.leaf_rows:
            return out
        whole = g.sum() ** 2 / (h.sum() + self.least)
        for j in range(b.shape[1]):
            size = len(self.cuts[j]) + 1
            gl, hl = np.cumsum(np.bincount(b[:, j], weights=g, minlength=size))[:-1], np.cumsum(np.bincount(b[:, j], weights=h, minlength=size))[:-1]
            nl = np.cumsum(np.bincount(b[:, j], minlength=size))[:-1]
            if not len(gl):
                continue
            gain = gl**2 / (hl + self.least) + (g.sum() - gl) ** 2 / (h.sum() - hl + self.least) - whole
            gain[(nl < self.leaf_rows) | (len(g) - nl < self.leaf_rows)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, out = float(gain[k]), (j, k + 1)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows, out = self._bin(x), np.arange(len(x)), np.full(len(x), self.start)
        for tree, leaves in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for splits in tree:
                f, c = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
                at = 2 * at + (b[rows, f[at]] >= c[at])
            out += self.rate * leaves[at]
        return out


class Isotonic:
    """Pool adjacent violators; between the pools' centres values are interpolated."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        pools: list[list[float]] = []  # weight, sum of y, sum of x
        for i in np.lexsort((y, x)):
            pools.append([1.0, float(y[i]), float(x[i])])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                w, s, t = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + t]
        self.x, self.y = np.array([t / w for w, _, t in pools]), np.array([s / w for w, s, _ in pools])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0.0, 1.0)


class Model:
    """score(texts) in 0..1. Without rows of both labels it is the share of label 1 among the rows there are (none: 0)."""

    def __init__(self, lexicon: Lexicon, trees: Trees | None, scale: Isotonic | None, share: float):
        self.lexicon, self.trees, self.scale, self.share = lexicon, trees, scale, share

    def score(self, texts) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.array([self.lexicon.features(t) for t in texts]))
        # within a pool the trees' own order is kept, at a weight that moves no score far
        return np.clip(0.999 * self.scale(raw) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def _label_features(lexicon: Lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "place": b["place"], "x": [lexicon.features(t, int(y)) for t, y in zip(b["content"], b["label"], strict=True)]})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """The classifier from the rows of labels (key, label 0 or 1), on sample_rows of them at most. Null labels and keys are left out."""
    spark = docs.sparkSession
    shared.prepare(spark)
    place = F.xxhash64(F.lit("toxicity"), F.col(key).cast("string"))
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"), place.alias("place")).distinct()
    chosen = shared.save(chosen.orderBy("place", "k").limit(sample_rows), "toxicity-labels")
    # the labels are sample_rows rows at most, whatever the tables hold
    rows = docs.select(F.col(key).alias("k"), shared.text_or_empty(text).alias("content")).join(F.broadcast(chosen), "k")
    rows = shared.save(rows.select("label", "place", "content"), "toxicity-sample")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).first()
    base = total["bad"] / max(1, total["n"])
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\p{L}+)"), F.lit(1)))
    begun = F.array_distinct(F.flatten(F.transform(words, lambda w: F.filter(F.array(F.substring(w, 1, STEMS[0]), F.when(F.length(w) >= STEMS[1], F.substring(w, 1, STEMS[1]))), lambda s: s.isNotNull()))))
    counted = rows.select("label", F.explode(begun).alias("stem")).groupBy("stem").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    # what cannot reach the least confidence is left where it is
    counted = counted.where((F.col("toxic") >= 2) & (F.col("toxic") > (F.col("toxic") + F.col("clean")) * min(0.9, base + 0.1)))
    # a word of the sample's rows, which are sample_rows at most, and in two toxic ones of them at least
    lexicon = Lexicon({r["stem"]: (r["toxic"], r["clean"]) for r in counted.collect()}, base)
    if not 0 < total["bad"] < total["n"]:
        return Model(lexicon, None, None, float(base))
    got = rows.mapInPandas(_label_features(lexicon), "label int, place long, x array<double>").toPandas().sort_values(["place", "label"], kind="stable")
    x, y = np.array(got["x"].tolist()), got["label"].to_numpy(dtype=float)
    held = got["place"].to_numpy() % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(y), dtype=bool)
        return Model(lexicon, t := Trees().fit(x, y), Isotonic().fit(t.raw(x), y), float(base))
    trees = Trees().fit(x[~held], y[~held])
    return Model(lexicon, trees, Isotonic().fit(trees.raw(x[held]), y[held]), float(base))


def flag(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null text counts as empty, which is scored like any other; repeated rows get equal scores; an empty table gives
    an empty table. Columns of docs named score or predicted are replaced, all others stay as they are.
    """
    shared.prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in content:
            parts = [model.score(p["c"].tolist()) for p in shared.by_bytes(c.to_frame("c"), "c")]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rows = docs.drop("score", "predicted").withColumn("score", scored(shared.text_or_empty(text)))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
