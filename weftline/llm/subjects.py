"""Subject areas of documents by a classifier chain with beam search.

Term features: every sentence is weighed against a term distribution per subject and one for sentences without a subject. The distributions are
fitted by expectation-maximisation on labelled documents, each sentence belonging to one of the document's labels, to no subject, or rarely to another
(wrong labels, passing mentions). Translations beside a labelled document take part in the fit as further texts of the same label. For a document
the features of a subject are the share of its sentences among those with a subject, and the evidence for them.
Source features: the label shares of the document's source, shrunk to the overall ones. Structure features: numbers of sentences with and without a subject.

The chain asks one logistic model per subject, the commonest first. Each sees, beside the features of its subject, which subjects were given before, so that subjects that occur together help or
hinder each other. All weights are learned: on features from folds (a document's own labels never shape its term features), first for all subjects together, then each subject's own around those. Hand
labels are wrong now and then, so a label is taken as turned round with a probability that is estimated along (few wrong labels would otherwise flatten every slope). Beam search decodes the most
probable combination of at most ``most_labels`` subjects.

Fitted on at most ``max_labelled`` labelled documents, taken in the order of a hash of their key: the only bound. Every document is classified, over its whole
text. Null, empty and blank texts get no subject. Repeated label rows count once. Without any labelled document there is no result row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import WordFolder

_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+|\s\|\s")


def sentences(text: str | None, fold: WordFolder) -> list[list[str]]:
    """Words of each sentence, numbers left out, followed by pairs of neighbours."""
    out = []
    for part in _SENTENCE.split(text or ""):
        words = [w for w in fold.words(part) if not w.isdigit()]
        if words:
            out.append(words + [f"{a}_{b}" for a, b in zip(words, words[1:])])
    return out


class Terms:
    """Log probabilities of terms by class; the last class is 'no subject'."""

    def __init__(self, docs: list[list[list[str]]], labels: list[set[int]], classes: int, rounds: int = 12, smoothing: float = 40.0):
        self.classes = classes
        seen = Counter(t for d in docs for s in d for t in set(s))
        kept = [t for t, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 1]
        self.number = {t: i for i, t in enumerate(kept)}
        prior, ids, owner = [], [], []
        for d, own in zip(docs, labels):
            p = np.full(classes + 1, 0.05 / max(1, classes - len(own)))
            p[list(own)] = 0.7 / max(1, len(own))
            p[classes] = 0.25
            for s in d:
                mine = [self.number[t] for t in s if t in self.number]
                owner += [len(prior)] * len(mine)
                ids += mine
                prior.append(p)
        self.logp = np.zeros((len(kept), classes + 1))
        self.share = np.full(classes + 1, 1 / (classes + 1))
        if not prior or not kept:
            return
        prior, ids, owner = np.array(prior), np.array(ids, dtype=np.int64), np.array(owner, dtype=np.int64)
        base = np.bincount(ids, minlength=len(kept)) / len(ids)
        post = prior / prior.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            count = np.stack([np.bincount(ids, weights=post[owner, c], minlength=len(kept)) for c in range(classes + 1)], axis=1)
            self.logp = np.log((count + smoothing * base[:, None]) / (count.sum(axis=0) + smoothing))
            log = np.log(prior)
            for c in range(classes + 1):
                log[:, c] += np.bincount(owner, weights=self.logp[ids, c], minlength=len(prior))
            new = np.exp(log - log.max(axis=1, keepdims=True))
            new /= new.sum(axis=1, keepdims=True)
            moved, post = np.abs(new - post).mean(), new
            if moved < 2e-4:
                break
        self.share = np.maximum(post.mean(axis=0), 1e-3)

    def weigh(self, doc: list[list[str]]) -> tuple[np.ndarray, int]:
        """Sentences per subject (in parts where it's open), and the number of sentences without one."""
        total = np.zeros(self.classes + 1)
        for s in doc:
            mine = [self.number[t] for t in s if t in self.number]
            if not mine:
                total[self.classes] += 1
                continue
            log = np.log(self.share) + self.logp[mine].sum(axis=0)
            p = np.exp(log - log.max())
            p /= p.sum()
            best = int(p.argmax())
            if p[best] > 0.9:
                total[best] += 1
            else:
                total += p
        return total[: self.classes], int(round(total[self.classes]))


class Chain:
    """``weights``: a row per subject over its own features and one column per subject given before."""

    OWN = 8

    def __init__(self, order: list[int], sources: dict[str, np.ndarray], base: np.ndarray, most_labels: int):
        self.order, self.sources, self.base, self.most_labels = order, sources, base, most_labels
        self.weights = np.zeros((len(order), self.OWN + len(order)))

    def features(self, k: int, count: np.ndarray, none: int, known: np.ndarray, given: list[int]) -> np.ndarray:
        """``known``: the label shares of the document's source."""
        total = count.sum()
        share = count[k] / total if total > 0 else 0.0
        other = max((count[c] for c in range(len(count)) if c != k), default=0.0) / total if total > 0 else 0.0
        out = np.zeros(self.OWN + len(count))
        out[: self.OWN] = 1.0, 10 * share, np.log1p(total) / 3, np.log(known[k]) - np.log(self.base[k]), 3 * other, float(len(given) > 1), np.log1p(none) / 3, float(total < 0.5)
        out[[self.OWN + g for g in given]] = 1.0
        return out

    def decode(self, count: np.ndarray, none: int, source: str | None, width: int = 6) -> list[int]:
        beams: list[tuple[float, list[int]]] = [(0.0, [])]
        known = self.sources.get(source or "", self.base)
        for k in self.order:
            nxt = []
            for score, given in beams:
                z = float(self.features(k, count, none, known, given) @ self.weights[k])
                yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
                nxt.append((score + no, given))
                if len(given) < self.most_labels:
                    nxt.append((score + yes, [*given, k]))
            beams = sorted(nxt, key=lambda b: (-b[0], b[1]))[:width]
        return sorted(beams[0][1])


def _logistic(x: np.ndarray, y: np.ndarray, mean: np.ndarray, strength: float, turned: float = 0.0, rounds: int = 60) -> np.ndarray:
    """A logistic model with a normal prior around ``mean``, of labels of which a share ``turned`` is turned round: EM over the true labels, a Newton step each."""
    w = mean.copy()
    ridge = np.eye(len(mean)) * strength
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        yes, no = np.where(y > 0.5, 1 - turned, turned) * p, np.where(y > 0.5, turned, 1 - turned) * (1 - p)
        true = yes / np.maximum(yes + no, 1e-12)
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + ridge, x.T @ (true - p) - ridge @ (w - mean))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-5:
            break
    return w


def _turned(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The share of labels against which the model is sure."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return float(np.clip(np.mean(np.where(y > 0.5, p < 0.05, p > 0.95)), 1e-4, 0.2))


class SubjectModel:
    """``rows``: (text, translation, source, labels) of labelled documents."""

    def __init__(self, rows: list[tuple[str | None, str | None, str | None, set[str]]], subjects: list[str], most_labels: int = 2, folds: int = 4, strength: float = 0.1, own_strength: float = 5.0):
        self.subjects, k = subjects, len(subjects)
        self.fold = WordFolder()
        own = [{subjects.index(s) for s in r[3] if s in subjects} for r in rows]
        texts = [sentences(r[0], self.fold) for r in rows]
        others = [sentences(r[1], self.fold) for r in rows]

        def fit(at: list[int]) -> Terms:
            return Terms([d for i in at for d in (texts[i], others[i])], [own[i] for i in at for _ in (0, 1)], k)

        self.terms = fit(list(range(len(rows))))
        share = np.array([sum(c in o for o in own) + 0.5 for c in range(k)]) / (len(rows) + 1)
        per: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rows):
            per[r[2] or ""].append(i)
        held = {s: np.array([sum(c in own[i] for i in at) for c in range(k)]) for s, at in per.items()}
        sources = {s: (n + 20 * share) / (len(per[s]) + 20) for s, n in held.items()}
        order = sorted(range(k), key=lambda c: (-share[c], subjects[c]))
        self.chain = Chain(order, sources, share, most_labels)
        # A handful of labels makes as many folds as documents.
        folds = max(1, min(folds, len(rows)))
        weighed: dict[int, tuple[np.ndarray, int]] = {}
        for f in range(folds):
            terms = fit([i for i in range(len(rows)) if i % folds != f] or [0])
            weighed |= {i: terms.weigh(texts[i]) for i in range(f, len(rows), folds)}
        xs, ys = defaultdict(list), defaultdict(list)
        for i, o in enumerate(own):
            given: list[int] = []
            # Without the document's own labels.
            source = rows[i][2] or ""
            known = (held[source] - np.array([c in o for c in range(k)]) + 20 * share) / (len(per[source]) + 19)
            for c in order:
                xs[c].append(self.chain.features(c, *weighed[i], known, given))
                ys[c].append(float(c in o))
                given = [*given, c] if c in o else given
        # All subjects share one model first; each subject's own lies around it.
        x, y = np.array([x for c in order for x in xs[c]]), np.array([y for c in order for y in ys[c]])
        shared, turned = np.zeros(x.shape[1]), 0.02
        for _ in range(3):
            shared = _logistic(x, y, np.zeros(x.shape[1]), strength, turned)
            turned = _turned(x, y, shared)
        for c in order:
            self.chain.weights[c] = _logistic(np.array(xs[c]), np.array(ys[c]), shared, own_strength, turned)

    def classify(self, text: str | None, source: str | None) -> list[str]:
        found = sentences(text, self.fold)
        if not found:
            return []
        count, none = self.terms.weigh(found)
        if count.sum() < 0.5:
            return []
        return [self.subjects[c] for c in self.chain.decode(count, none, source)]


def subject_areas(docs: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", translation: str = "text_tgt", source: str = "source", subject: str = "subject", max_labelled: int = 12_000, max_areas: int = 500, only_new: bool = True) -> DataFrame:
    """(key, subject) of the documents; with ``only_new`` of those without a label row."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    subjects = sorted(r[0] for r in areas.select(subject).where(F.col(subject).isNotNull()).distinct().limit(max_areas + 1).collect())
    if len(subjects) > max_areas:
        raise ValueError(f"more than {max_areas} subject areas")
    by_doc = labels.where(F.col(key).isNotNull() & F.col(subject).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set(subject)).alias("own"))
    chosen = by_doc.orderBy(F.xxhash64("k"), "k").limit(max_labelled)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(translation).alias("o"), F.col(source).alias("s"))
    rows = sorted(texts.join(F.broadcast(chosen), "k").select("k", "t", "o", "s", "own").collect(), key=lambda r: r["k"])
    if not rows or not subjects:
        return spark.createDataFrame([], f"{key} {kind}, {subject} string")
    model = SubjectModel([(r["t"], r["o"], r["s"], set(r["own"])) for r in rows], subjects)
    model.fold = WordFolder()
    held = spark.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            out = [(k, a) for k, t, s in zip(batch["k"].tolist(), batch["t"], batch["s"]) for a in m.classify(t, s)]
            yield pd.DataFrame(out, columns=["k", "a"])

    asked = texts.select("k", "t", "s").where("t is not null")
    if only_new:
        asked = asked.join(by_doc.select("k"), "k", "left_anti")
    return asked.mapInPandas(classify, f"k {kind}, a string").select(F.col("k").alias(key), F.col("a").alias(subject))
