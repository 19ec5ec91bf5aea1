"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models. A later model also gets the probabilities of the
earlier categories; for its training these are out-of-fold predictions, so that it sees them as uncertain as they will be
on new texts.

Categories are label columns where the labels table has them. The given table has one flag, ``toxic``; the default chain
crosses it with a column of the documents that is no input of a score, their language: toxic in the main language of the
labelled texts (``main``), toxic in another one (``other``), toxic at all. Insults differ by language, so the last model
joins two detectors.

Features are occurrences of telling terms: beginnings of words (and whole words) whose share among labelled toxic texts is
many times their share among the others. Terms are picked one by one, each for the toxic texts that none before it covers.
Each fold picks its own terms and fits its own models on the other folds only, so neither out-of-fold probabilities nor the
threshold, which is the cut of largest F1 among them, have seen the labels that they are held against.

The fit uses at most ``max_labelled`` labelled texts (by hash order of the id); scoring covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty

MAX_LABELLED = 20_000
MIN_TEXTS = 3
MIN_ODDS = 10.0
MIN_G = 15.0
COMMON_SHARE = 0.05
FOLDS = 5
SHORTEST, LONGEST = 3, 10
CHAIN = ("main", "other", "toxic")

#: ASCII letters in lower case; other ASCII characters part words; bytes of other letters stay.
_FOLD = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split()


def beginnings(word: bytes) -> list[bytes]:
    """The word's first 3 to 10 bytes and, behind a mark, the word as a whole (long ones by a hash)."""
    whole = word if len(word) <= 64 else word[:SHORTEST] + b"#" + xxhash.xxh3_128_hexdigest(word).encode()
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [b"=" + whole]


# ---------------------------------------------------------------- linear models and the chain


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (last one the intercept) of a ridge logistic regression, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_chain(views: list[np.ndarray], x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One model per column of ``labels`` on the features ``x``, and the out-of-fold probabilities of all columns.

    ``views[f]`` are the features of all rows as fold ``f`` sees them, made without its labels.
    """
    models, seen = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        models.append(fit_logistic(np.hstack([x, seen]), labels[:, k]))
        out = np.full(len(x), labels[:, k].mean() if len(x) else 0.0)
        for f, view in enumerate(views):
            inside, outside = folds != f, folds == f
            if inside.any() and outside.any():
                full = np.hstack([view, seen])
                out[outside] = predict_logistic(full[outside], fit_logistic(full[inside], labels[inside, k]))
        seen = np.hstack([seen, out[:, None]])
    return models, seen


def run_chain(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    seen = np.zeros((len(x), 0))
    for w in models:
        seen = np.hstack([seen, predict_logistic(np.hstack([x, seen]), w)[:, None]])
    return seen


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway between the scores around the cut of largest F1 (the higher cut of two as good)."""
    if not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + after) / 2)


# ---------------------------------------------------------------- terms and features


def log_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G statistic of a among n1 and b among n0 against equal shares; 0 where the odds are below ``MIN_ODDS``."""
    share = (a + b) / (n1 + n0)
    out = np.zeros(len(a))
    for c, n, p in ((a, n1, share), (n1 - a, n1, 1 - share), (b, n0, share), (n0 - b, n0, 1 - share)):
        some = c > 0
        out[some] += 2 * c[some] * np.log(c[some] / (n * p[some]))
    odds = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    return np.where(odds >= MIN_ODDS, out, 0)


def _akin(a: bytes, b: bytes) -> bool:
    a, b = a.lstrip(b"="), b.lstrip(b"=")
    return a.startswith(b) or b.startswith(a)


def pick_terms(which: list[np.ndarray], toxic: np.ndarray, names: list[bytes]) -> list[int]:
    """Candidates, each the most telling one for toxic texts that none before it covers; which: the candidates of each text.

    After them come terms of many toxic texts that always stood beside others so far (a share of ``COMMON_SHARE`` at
    least), unless a picked term begins like them.
    """
    count = lambda rows: np.bincount(np.concatenate([which[r] for r in rows] or [np.zeros(0, np.int64)]), minlength=len(names)).astype(float)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    a, b = count(np.flatnonzero(toxic)), count(np.flatnonzero(~toxic))
    open_, left, picked = {int(r) for r in np.flatnonzero(toxic)}, a.copy(), []
    while len(open_) >= MIN_TEXTS and len(names):
        g = np.where(left >= MIN_TEXTS, log_ratio(left, b, len(open_), n0), 0)
        best = int(np.argmax(g))
        if g[best] < MIN_G:
            break
        picked.append(best)
        covered = [r for r in open_ if best in which[r]]
        left -= count(covered)
        open_ -= set(covered)
    g = np.where(a >= max(MIN_TEXTS, COMMON_SHARE * n1), log_ratio(a, b, n1, n0), 0) if n1 and n0 else np.zeros(len(names))
    for k in np.argsort(-g, kind="stable"):
        if g[k] < MIN_G:
            break
        if not any(_akin(names[k], names[p]) for p in picked):
            picked.append(int(k))
    return picked


class Lookup:
    """Counts of terms in a text."""

    def __init__(self, terms: list[bytes]):
        self.index = {t: k for k, t in enumerate(terms)}
        plain = [t for t in terms if not t.startswith(b"=")]
        self.doors = {t[:SHORTEST] for t in plain} | {t[1 : 1 + SHORTEST] for t in terms if t.startswith(b"=")}

    def counts(self, words: list[bytes]) -> dict[int, int]:
        out: dict[int, int] = {}
        for w in words:
            if w[:SHORTEST] in self.doors:
                for t in beginnings(w):
                    k = self.index.get(t)
                    if k is not None:
                        out[k] = out.get(k, 0) + 1
        return out


def feature_row(counts: dict[int, int], n_words: int, n_terms: int) -> np.ndarray:
    """Log of each term's count, log of all counts, log of counts in a thousand words."""
    row = np.zeros(n_terms + 2)
    if counts:
        total = sum(counts.values())
        row[list(counts)] = np.log1p(list(counts.values()))
        row[-2:] = np.log1p(total), np.log1p(1000 * total / n_words)
    return row


def features(texts: list[bytes | None], terms: list[bytes]) -> np.ndarray:
    lookup = Lookup(terms)
    out = np.zeros((len(texts), len(terms) + 2))
    for k, text in enumerate(texts):
        words = words_of(text or b"")
        counts = lookup.counts(words)
        if counts:
            out[k] = feature_row(counts, len(words), len(terms))
    return out


def _term_counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, fold, texts of the fold with it that are toxic, that are not), summed per task."""
    sums: dict[tuple[bytes, int], list[int]] = {}

    def out():
        keys, values = list(sums), list(sums.values())
        columns = [pa.array([k[0] for k in keys], pa.binary()), *(pa.array(c, pa.int64()) for c in ([k[1] for k in keys], [v[0] for v in values], [v[1] for v in values]))]
        return pa.RecordBatch.from_arrays(columns, ["term", "fold", "a", "b"])

    for part in parts:
        toxic, folds, texts = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist()
        for flag, fold, text in zip(toxic, folds, texts, strict=True):
            for t in {t for w in set(words_of(text or b"")) if len(w) >= SHORTEST for t in beginnings(w)}:
                sums.setdefault((t, fold), [0, 0])[0 if flag else 1] += 1
            if len(sums) > 100_000:
                yield out()
                sums.clear()
    yield out()


# ---------------------------------------------------------------- operator


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: tuple[str, ...], by: str | None, max_labelled: int, folds: int) -> DataFrame:
    """(id, toxic, flags, group, fold, text): at most ``max_labelled`` rows, one per id."""
    flags = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    named = F.array(*[F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in categories]).cast("array<int>")
    agreed = flags.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), named.alias("flags")).where(F.col("toxic") == F.col("most"))
    chosen = agreed.select("id", F.col("toxic").cast("int").alias("toxic"), "flags").orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    group = F.col(by).cast("string") if by and by in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), group.alias("group"), text_or_empty(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    one = met.groupBy("id").agg(F.min_by(F.struct("toxic", "flags", "group", "text"), F.struct(F.xxhash64("text"), "group")).alias("one"))
    return one.select("id", "one.toxic", "one.flags", "one.group", F.pmod("id", F.lit(folds)).cast("int").alias("fold"), "one.text")


def category_labels(groups: list[str | None], toxic: np.ndarray, flags: np.ndarray, categories: tuple[str, ...], by: str | None) -> tuple[tuple[str, ...], np.ndarray]:
    """Names of the chain and a column of 0/1 for each: the given categories or the crossing with groups, then ``toxic``."""
    if categories:
        return (*categories, "toxic"), np.column_stack([flags, toxic]).astype(float)
    if not by:
        return ("toxic",), toxic[:, None].astype(float)
    known = sorted({g for g in groups if g is not None})
    main = max(known, key=lambda g: sum(x == g for x in groups), default=None)
    inside = np.array([g == main for g in groups], bool)
    return CHAIN, np.column_stack([toxic & inside, toxic & ~inside, toxic]).astype(float)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, folds: int = FOLDS,
                 categories: tuple[str, ...] = (), by: str | None = "lang") -> dict:
    """Chain, terms, models and threshold as plain values. Labels without id or flag, and ids with both flags, do not count;
    of an id's several texts the one of least hash does; a missing category or language counts as none.

    Terms are counted in Spark. The driver sees those that ``MIN_TEXTS`` toxic texts hold with ``MIN_ODDS`` times the odds in
    any set of folds, and which labelled text holds which: as much as the bounded labelled sample has, whatever the corpus.
    """
    texts = stored(labelled_texts(docs, labels, id_col, text_col, categories, by, max_labelled, folds), "labelled")
    sizes = {r.fold: (r.n1, r.n0) for r in texts.groupBy("fold").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).collect()}
    n1, n0 = sum(a for a, _ in sizes.values()), sum(b for _, b in sizes.values())
    names, _ = category_labels([], np.zeros(0, bool), np.zeros((0, len(categories))), categories, by)
    if not n1 or not n0:
        return {"chain": names, "terms": [], "models": [np.append(np.zeros(2 + k), -30.0) for k in range(len(names))], "threshold": 1.1}
    counts = texts.select("toxic", "fold", "text").mapInArrow(_term_counts, "term binary, fold long, a long, b long")
    sums = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(-1, folds) for c in "ab"]
    telling = F.lit(False)
    for f in range(-1, folds):
        own1, own0 = n1 - sizes.get(f, (0, 0))[0], n0 - sizes.get(f, (0, 0))[1]
        odds = ((F.col(f"a{f}") + 0.5) / (own1 + 1)) / ((F.col(f"b{f}") + 0.5) / (own0 + 1))
        telling = telling | ((F.col(f"a{f}") >= MIN_TEXTS) & (odds >= MIN_ODDS))
    candidates = sorted(bytes(r.term) for r in counts.groupBy("term").agg(*sums).where(telling).select("term").collect())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(candidates)
        for part in parts:
            words = [words_of(t or b"") for t in part.column(1).cast(pa.large_binary()).to_pylist()]
            found = [lookup.counts(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                ["id", "n", "which", "many"],
            )

    held = texts.select("id", "text").mapInArrow(batches, "id long, n long, which array<int>, many array<int>")
    rows = sorted(held.join(texts.drop("text"), "id").collect(), key=lambda r: r.id)
    toxic = np.array([r.toxic > 0 for r in rows])
    _, labelled = category_labels([r.group for r in rows], toxic, np.array([r.flags for r in rows]).reshape(len(rows), len(categories)), categories, by)
    own_fold = np.array([r.fold for r in rows])
    which = [np.array(r.which, np.int64) for r in rows]

    def view(mask: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Terms picked from the rows of the mask, and the features of all rows by them."""
        picked = pick_terms([w for w, m in zip(which, mask, strict=True) if m], toxic[mask], candidates)
        place = {c: k for k, c in enumerate(picked)}
        own = [{place[c]: n for c, n in zip(r.which, r.many, strict=True) if c in place} for r in rows]
        return picked, np.array([feature_row(o, r.n, len(picked)) for o, r in zip(own, rows, strict=True)])

    picked, x = view(np.ones(len(rows), bool))
    models, seen = fit_chain([view(own_fold != f)[1] for f in range(folds)], x, labelled, own_fold)
    bare = float(run_chain(np.zeros((1, x.shape[1])), models)[0, -1])
    # a text in which no term was found is not rejected, however common toxic texts are among the labelled ones
    threshold = max(best_threshold(seen[:, -1], toxic.astype(float)), float(np.nextafter(bare, 2.0)))
    return {"chain": names, "terms": [candidates[c] for c in picked], "models": models, "threshold": threshold}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category> of the chain, rejected): one row per input row.

    Defined cases: null and empty texts have no features, get the chain's base probability and are not rejected; repeated rows and ids are
    scored each; a null id stays null; an empty table gives an empty table; without usable labels nothing is rejected;
    other columns are not read.
    """
    terms, models, threshold = model["terms"], model["models"], model["threshold"]
    names = [f"p_{c}" for c in model["chain"]]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p = run_chain(features(part.column(1).cast(pa.large_binary()).to_pylist(), terms), models)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)],
                ["doc_id", *names, "rejected"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        batches, ", ".join(["doc_id long", *(f"{n} double" for n in names), "rejected boolean"])
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that the fitted chain does not reject, all columns as they are."""
    model = fit_toxicity(docs, labels, id_col, text_col, **options)
    terms, models, threshold = model["terms"], model["models"], model["threshold"]

    @F.pandas_udf("boolean")
    def rejected(texts):
        import pandas as pd

        p = run_chain(features([t.encode() if t else b"" for t in texts], terms), models)
        return pd.Series(p[:, -1] >= threshold)

    return docs.where(~rejected(F.col(text_col)))


def op3_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
