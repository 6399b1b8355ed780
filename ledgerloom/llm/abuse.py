"""Scoring documents for abusive, hateful or sexual language: a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts character subsequences of ORDER letters whose gaps add up to at most GAPS, each gap discounted, so a
masked, spaced or stretched insult still shares most of its features with the plain one. It is computed through its
explicit (hashed) feature map. Landmarks are labelled stretches of text; the support vector machine is linear in the
Nyström features, so for scoring landmarks and weights fold into one weight per subsequence, and every stretch of a
document is scored by one pass over its characters. A document's score is that of its worst stretch.

Labels are given to documents, not to sentences, and some are wrong. Training therefore alternates: pick the stretch
of each positive document that looks worst, drop positives none of whose stretches stands out, train, pick again.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, shared_dir, ship

#: The kernel: subsequence order, total gap, discount of a gap, size of the hashed feature space (a power of two).
ORDER, GAPS, DISCOUNT, DIMENSIONS = 4, 2, 0.6, 1 << 17
#: Characters of a stretch that is scored; landmarks; rounds of picking stretches.
STRETCH, LANDMARKS, ROUNDS = 36, 640, 9
#: The cut lies this far from what nearly all negative documents stay below to the middle positive document.
NEARLY_ALL, CUT = 0.995, 0.12
#: Bound of the labelled documents that the classifier is fitted on, and of the negative stretches.
#: Runs of characters that tell what negative documents also say, and the share of new ones a positive stretch has.
GRAM, GRAM_SPACE, STRANGE = 7, 1 << 22, 0.66
MAX_LABELLED, MAX_NEGATIVE = 6000, 8000
#: Positive documents that a telling run is in at least, how much more often than in others, share of a stretch.
OFTEN, ODDS, TOLD = 3, 8.0, 0.3

_PATTERNS = [(0, *c) for c in itertools.combinations(range(1, ORDER + GAPS), ORDER - 1)]
_WEIGHTS = [DISCOUNT ** (p[-1] + 1 - ORDER) for p in _PATTERNS]
_CODES = np.full(128, 28, dtype=np.int64)
_CODES[ord(" ")] = 0
for _k in range(26):
    _CODES[ord("a") + _k] = 1 + _k
for _k in range(10):
    _CODES[ord("0") + _k] = 27

_SPACED = re.compile(r"(?<![^\s])(?:[a-z*][ .\-_]){3,}[a-z*](?![^\s.,!?;:])")
_STRETCHED = re.compile(r"([a-z])\1{2,}")
_DIGITS = re.compile(r"[#\w/.,-]*\d[\w/.,-]*")
_SPACE = re.compile(r"[\s.,;:!?\"'()\[\]…—–]+")
#: Signs and digits typed for letters.
_LOOKALIKE = str.maketrans({"@": "a", "$": "s", "€": "e", "¡": "i", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_MIXED = re.compile(r"(?<![\w@$*])(?=[\w@$*]*[a-z][\w@$*]*[a-z])(?=[\w@$*]*[@$013457])[a-z0-9@$*]+(?![\w@$*])")


def normal(text: str) -> str:
    """Lower case without accents; stretched letters once; letters typed apart joined; look-alikes read as letters."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m.group(0)), t)
    t = _STRETCHED.sub(r"\1", t)
    t = _MIXED.sub(lambda m: m.group(0).translate(_LOOKALIKE) if 2 * sum(c.isdigit() for c in m.group(0)) <= len(m.group(0)) else m.group(0), t)
    # Amounts, days and references say nothing here; what is left of them is one sign.
    t = _DIGITS.sub("0", t)
    return " " + _SPACE.sub(" ", t).strip() + " "


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return _CODES[np.where(points < 128, points, 127)]


def _numbers(c: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """Feature number of the subsequence with this pattern of gaps at each position that has room for it."""
    m = max(0, len(c) - pattern[-1])
    h = np.zeros(m, dtype=np.int64)
    for o in pattern:
        h = h * 31 + c[o : o + m]
    return ((h * 0x9E3779B1) >> 7) & (DIMENSIONS - 1)


def embed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit feature vector of one stretch: (numbers, values)."""
    each = [_numbers(c, p) for p in _PATTERNS]
    w = np.repeat(_WEIGHTS, [len(x) for x in each])
    nums, at = np.unique(np.concatenate(each), return_inverse=True)
    values = np.bincount(at, weights=w)
    return nums, values / (np.linalg.norm(values) or 1.0)


MODEL = "weights binary, bias double, threshold double, scale double"


@dataclass
class Model:
    """Folded weights per subsequence, bias, threshold; ``scale`` maps margins to a probability."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.0
    scale: float = 3.0

    def margins(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """For each document the margin of the stretch that begins at each position; all documents in one sweep."""
        padded = [np.r_[c, np.zeros(STRETCH - len(c), dtype=np.int64)] if len(c) < STRETCH else c for c in docs]
        if not padded:
            return []
        flat = np.concatenate(padded)
        n = len(flat)
        out = np.zeros(n - STRETCH + 1, dtype=np.float64)
        size = 0.0
        for p, w in zip(_PATTERNS, _WEIGHTS):
            inside = STRETCH - p[-1]
            total = np.r_[0.0, np.cumsum(self.weights[_numbers(flat, p)], dtype=np.float64)]
            out += w * (total[inside : inside + len(out)] - total[: len(out)])
            size += inside * w * w
        out = out / np.sqrt(size) + self.bias
        ends = np.cumsum([len(c) for c in padded])
        return [out[e - len(c) : e - STRETCH + 1] for c, e in zip(padded, ends)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability-like score of each text's worst stretch; 0 for nothing to read."""
        found = np.zeros(len(texts))
        read = [k for k, t in enumerate(texts) if t and t.strip()]
        for at in range(0, len(read), 500):
            part = read[at : at + 500]
            worst = np.asarray([m.max() for m in self.margins([codes(normal(texts[k])) for k in part])])
            found[part] = 1 / (1 + np.exp(np.clip(-self.scale * (worst - self.threshold), -50, 50)))
        return found

def _svm(z: np.ndarray, y: np.ndarray, heavy: np.ndarray, cost: float = 10.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighted alike, by accelerated gradient descent."""
    n, m = z.shape
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    share = share * heavy
    x = np.hstack([z, np.ones((n, 1))])
    pull = np.r_[np.full(m, 1.0 / (cost * 100)), 0.0]
    gram = (x * share[:, None]).T @ x
    step = 1.0 / (2 * np.linalg.eigvalsh(gram)[-1] + pull.max())
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (share * y * gap) + pull * v
        new = v - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


Vector = tuple[np.ndarray, np.ndarray]


def _fold(pos: list[Vector], neg: list[Vector], heavy: list[float], rng: np.random.Generator) -> Model:
    """Nyström SVM on embedded stretches, folded into one weight per subsequence."""
    vecs = pos + neg
    y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
    half = LANDMARKS // 2
    # Half of the landmarks are positive stretches; of the negative ones half are the heaviest, where the last model erred.
    by_weight = np.argsort(-np.asarray(heavy), kind="stable")
    hardest, others = by_weight[: LANDMARKS // 4], by_weight[LANDMARKS // 4 :]
    rest = max(0, LANDMARKS - min(half, len(pos)) - len(hardest))
    chosen = np.r_[rng.permutation(len(pos))[:half], len(pos) + np.r_[hardest, rng.permutation(others)[:rest]].astype(int)]
    used = np.unique(np.concatenate([vecs[k][0] for k in chosen]))
    slot = np.full(DIMENSIONS, len(used), dtype=np.int64)
    slot[used] = np.arange(len(used))
    marks = np.zeros((len(used) + 1, len(chosen)), dtype=np.float32)
    for r, k in enumerate(chosen):
        marks[slot[vecs[k][0]], r] = vecs[k][1]
    kernel = marks.T @ marks
    val, vec = np.linalg.eigh(kernel.astype(np.float64) + 1e-3 * np.eye(len(chosen)))
    root = (vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-6))) @ vec.T).astype(np.float32)
    z = np.stack([v.astype(np.float32) @ marks[slot[i]] for i, v in vecs]) @ root
    w, b = _svm(z, y, np.r_[np.ones(len(pos)), heavy])
    weights = np.zeros(DIMENSIONS, dtype=np.float32)
    weights[used] = marks[:-1] @ (root @ w.astype(np.float32))
    return Model(weights, b)


def _grams(c: np.ndarray) -> np.ndarray:
    """Hashed numbers of the runs of GRAM characters by position."""
    m = max(0, len(c) - GRAM + 1)
    h = np.zeros(m, dtype=np.int64)
    for o in range(GRAM):
        h = h * 31 + c[o : o + m]
    return ((h * 0x9E3779B1) >> 9) & (GRAM_SPACE - 1)


def _strange(neg: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """For the stretch at each position of ``docs`` the share of its runs that at most one negative document has."""
    seen = np.zeros(GRAM_SPACE, dtype=np.int32)
    for c in neg:
        seen[np.unique(_grams(c))] += 1
    out = []
    inside = STRETCH - GRAM + 1
    for c in docs:
        new = np.r_[0, np.cumsum(seen[_grams(c)] <= 1)]
        out.append((new[inside:] - new[:-inside]) / inside)
    return out


def _telling(pos: list[np.ndarray], neg: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For the stretch at each position of both lists the share of its runs that tell positive documents from others.

    A run tells if OFTEN positive documents have it at least, and positive documents ODDS times as often as negative
    ones; labels that are wrong either way are too few to reach that.
    """
    counts = []
    for docs in (pos, neg):
        seen = np.zeros(GRAM_SPACE, dtype=np.int32)
        for c in docs:
            seen[np.unique(_grams(c))] += 1
        counts.append(seen)
    tells = (counts[0] >= OFTEN) & (counts[0] / max(1, len(pos)) > ODDS * (counts[1] + 0.5) / max(1, len(neg)))
    inside = STRETCH - GRAM + 1

    def share(c: np.ndarray) -> np.ndarray:
        told = np.r_[0, np.cumsum(tells[_grams(c)])]
        return (told[inside:] - told[:-inside]) / inside

    return [share(c) for c in pos], [share(c) for c in neg]


def train(texts: list[str], labels: list[bool], seed: int = 7) -> Model:
    """Fits the classifier on documents with labels; deterministic for the same rows in the same order.

    With no positive or no negative document nothing can be learnt: the model then scores everything 0.
    """
    docs = [codes(normal(t)) for t in texts]
    docs = [np.r_[c, np.zeros(max(0, STRETCH - len(c)), dtype=c.dtype)] for c in docs]
    y = np.asarray(labels, dtype=bool)
    if not y.any() or y.all():
        return Model(np.zeros(DIMENSIONS, dtype=np.float32), -50.0)

    def fit(rows: np.ndarray) -> Model:
        rng = np.random.default_rng(seed)
        pos, neg = [docs[i] for i in rows if y[i]], [docs[i] for i in rows if not y[i]]
        strange = _strange(neg, pos)
        told, told_neg = _telling(pos, neg)
        each = max(1, MAX_NEGATIVE // (2 * len(neg)))
        cuts = [c[s : s + STRETCH] for c in neg for s in rng.integers(0, max(1, len(c) - STRETCH + 1), each)]
        # Different stretches only: what many documents say word for word counts once.
        picks = {c.tobytes(): embed(c) for c in cuts[: MAX_NEGATIVE // 2]}
        heavy = dict.fromkeys(picks, 1.0)
        model = None
        for _ in range(ROUNDS):
            # The stretch of each positive document that looks worst, among those that negative documents do not say.
            looks = strange if model is None else model.margins(pos)
            chosen = []
            for c, odd, look, tell in zip(pos, strange, looks, told):
                sure = tell.max() >= TOLD
                # What many positive documents and hardly any negative one say stays in, whatever the model makes of it.
                look = np.where(tell >= 0.9 * tell.max(), look, -np.inf) if sure else np.where(odd >= STRANGE, look, -np.inf)
                s = int(look.argmax())
                if sure or look[s] > (0 if model is None else -0.4):
                    # Neighbouring starts too, so that the insult may stand anywhere in the stretch.
                    chosen += [embed(c[k : k + STRETCH]) for k in (max(0, s - 9), s, s + 9) if len(c) - k >= ORDER + GAPS]
            if len(chosen) < 3:
                break
            keys = list(picks)[-MAX_NEGATIVE:]
            model = _fold(chosen, [picks[k] for k in keys], [heavy[k] for k in keys], rng)
            # Hard negatives: what looks worst in each part of each negative document joins in, hardest last; what
            # still looks bad though the model has seen it weighs more.
            hard: dict[bytes, tuple[float, np.ndarray]] = {}
            for c, m, tell in zip(neg, model.margins(neg), told_neg):
                # A stretch that tells is one of a document with a wrong label: no example of sober language.
                m = np.where(tell >= TOLD / 2, -np.inf, m)
                for k in range(0, len(m), 48):
                    t = int(m[k : k + 48].argmax()) + k
                    if m[t] > -0.7:
                        hard[c[t : t + STRETCH].tobytes()] = (float(m[t]), c[t : t + STRETCH])
            for key, (margin, x) in sorted(hard.items(), key=lambda h: h[1][0])[-MAX_NEGATIVE // 3 :]:
                if key not in picks:
                    picks[key] = embed(x)
                heavy[key] = min(heavy.get(key, 1.0) * (4.0 if margin > -0.4 else 2.0), 256.0)
        return model or Model(np.zeros(DIMENSIONS, dtype=np.float32), -50.0)

    model = fit(np.arange(len(docs)))
    tops = np.asarray([x.max() for x in model.margins(docs)])
    # Documents with a wrong label, as far as what they say tells, have no say in the cut.
    _, told = _telling([docs[i] for i in np.flatnonzero(y)], [docs[i] for i in np.flatnonzero(~y)])
    sober = tops[~y][[t.max() < TOLD / 2 for t in told]]
    low, high = float(np.quantile(sober if len(sober) else tops[~y], NEARLY_ALL)), float(np.median(tops[y]))
    model.threshold = low + CUT * max(0.0, high - low)
    return model


def labelled(documents: DataFrame, abuse_label: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, positive): documents by the majority of their annotators; ties count as positive.

    At most ``most`` of them, chosen by a hash of the id: the documented bound of the training sample.
    """
    votes = abuse_label.where("doc_id is not null and category is not null").groupBy("doc_id").agg(F.avg((F.col("category") != "none").cast("double")).alias("share"))
    rows = documents.where("text is not null").select("doc_id", "text").join(votes, "doc_id")
    return rows.select("doc_id", "text", (F.col("share") >= 0.5).alias("positive")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_model(documents: DataFrame, abuse_label: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The model of the labelled sample: fitted once, kept in the shared folder, and read from there the next time."""
    spark = documents.sparkSession
    sample = cut(labelled(documents, abuse_label, most))
    row = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id", "text", "positive").cast("decimal(38,0)")).alias("k")).first()
    path = f"{shared_dir(spark).rstrip('/')}/abuse-model-{row['n']}-{abs(int(row['k'] or 0))}"
    try:
        kept = spark.read.schema(MODEL).parquet(path).first()
    except AnalysisException:
        kept = None
    if kept is not None:
        return Model(np.frombuffer(kept["weights"], dtype=np.float32), kept["bias"], kept["threshold"], kept["scale"])
    rows = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    model = train(rows["text"].tolist(), rows["positive"].tolist())
    held = [(bytearray(model.weights.astype(np.float32).tobytes()), float(model.bias), float(model.threshold), float(model.scale))]
    spark.createDataFrame(held, MODEL).coalesce(1).write.mode("overwrite").parquet(path)
    return model


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """Every document with ``score`` in [0, 1] and ``flagged`` (score above one half).

    Null, empty and blank texts score 0. Texts are scored whole. Repeated rows each come out. Other columns stay.
    """
    ship(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(held.value.scores(t.tolist()))

    return documents.withColumn("score", score("text")).withColumn("flagged", F.col("score") > 0.5)


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Documents, flagged documents and their share per ``by``; a null source is a group of its own."""
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("flagged").cast("bigint")).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
