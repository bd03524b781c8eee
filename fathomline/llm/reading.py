"""Reading level of documents: gradient-boosted regression trees over counts, vocabulary, syntax and cohesion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.keys import plain_key

#: Labelled documents that the trees are fitted on at most (those of least id hash).
MOST_LABELS = 50_000
WORD = regex.compile(r"\p{L}+")
SENTENCE_END = regex.compile(r"[.!?](?=\s|$)|\n[^\S\n]*(?:\r?\n)")
VOWELS = regex.compile(r"[aeiouyäöüàâéèêëîïôûùœæ]+")
FEATURES = (
    "words", "sentences", "long_words", "lix", "word_length", "word_length_sd", "word_length_p90", "sentence_length", "sentence_length_sd",
    "sentence_length_p90", "syllables", "one_syllable", "vocabulary", "once", "commas", "clause_marks", "digits", "overlap", "overlap_sd", "new_words",
)


def syllables_of(word: str, memo: dict[str, int]) -> int:
    """Runs of vowels, at least one; ``memo`` keeps what a task has seen, up to 200,000 words."""
    found = memo.get(word)
    if found is None:
        if len(memo) >= 200_000:
            memo.clear()
        found = memo[word] = max(1, len(VOWELS.findall(word)))
    return found


def features(text: str | None, memo: dict[str, int] | None = None) -> list[float]:
    """FEATURES of a whole text. A word is a run of letters, ß counts as ss; a sentence ends at . ! or ?
    before a blank or the end, and at an empty line, and has a word. Without words all are 0."""
    text = (text or "").lower().replace("ß", "ss")
    sentences = [s for s in (WORD.findall(part) for part in SENTENCE_END.split(text)) if s]
    words = [w for s in sentences for w in s]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    spans = np.fromiter(map(len, sentences), np.int64, len(sentences))
    long = int((lengths > 6).sum())
    seen = Counter(words)
    memo = {} if memo is None else memo
    spoken = np.fromiter((syllables_of(w, memo) for w in seen), np.int64, len(seen))
    times = np.fromiter(seen.values(), np.int64, len(seen))
    sets = [set(s) for s in sentences]
    shared = np.array([len(a & b) / min(len(a), len(b)) for a, b in zip(sets, sets[1:], strict=False)] or [0.0])
    ninth = lambda v: float(np.sort(v)[(9 * len(v) - 1) // 10])
    half = len(set(words[n // 2 :]) - set(words[: n // 2])) / max(1, n - n // 2)
    return [
        n, len(sentences), long, n / len(sentences) + 100 * long / n, lengths.mean(), lengths.std(), ninth(lengths), spans.mean(), spans.std(),
        ninth(spans), int(spoken @ times) / n, int(times[spoken == 1].sum()) / n, len(seen) / n**0.8, int((times == 1).sum()) / n, text.count(",") / n,
        (text.count(";") + text.count(":") + text.count("(")) / n, sum(map(text.count, "0123456789")) / n, shared.mean(), shared.std(), half,
    ]


@dataclass
class Trees:
    """Boosted regression trees of equal depth; node k has the children 2k+1 and 2k+2."""

    base: float
    rate: float
    depth: int
    column: list[np.ndarray] = field(default_factory=list)
    above: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for column, above, leaf in zip(self.column, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > above[node])
            out += self.rate * leaf[node - len(column)]
        return out


def least_prediction(trees: Trees, low: dict[int, float]) -> float:
    """The least that trees can predict where the columns of ``low`` have at least these values: of each tree
    the lowest leaf that such a row can reach."""
    total = trees.base
    for column, above, leaf in zip(trees.column, trees.above, trees.leaf, strict=True):
        inner, todo, reached = len(column), [0], []
        while todo:
            node = todo.pop()
            if node >= inner:
                reached.append(leaf[node - inner])
                continue
            if low.get(int(column[node]), -np.inf) <= above[node]:
                todo.append(2 * node + 1)
            todo += [2 * node + 2] if np.isfinite(above[node]) else []
        total += trees.rate * min(reached)
    return total


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 120, depth: int = 3, rate: float = 0.08, bins: int = 32, least: float = 5.0) -> Trees:
    """Least-squares boosting with histogram splits; leaves hold ``least`` weight or more."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    model = Trees(float(np.average(y, weights=weight)), rate, depth)
    now = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        rest = (y - now) * weight
        node = np.zeros(len(y), np.int64)
        column, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for c in range(x.shape[1]):
                size = len(edges[c]) + 1
                if size < 2:
                    continue
                at = local * size + codes[:, c]
                g = np.bincount(at, rest, width * size).reshape(width, size).cumsum(1)
                w = np.bincount(at, weight, width * size).reshape(width, size).cumsum(1)
                gl, wl, gr, wr = g[:, :-1], w[:, :-1], g[:, -1:] - g[:, :-1], w[:, -1:] - w[:, :-1]
                gain = np.where((wl >= least) & (wr >= least), gl**2 / np.maximum(wl, 1e-9) + gr**2 / np.maximum(wr, 1e-9) - g[:, -1:] ** 2 / np.maximum(w[:, -1:], 1e-9), 0)
                cut = gain.argmax(1)
                value = gain[np.arange(width), cut]
                for k in np.flatnonzero(value > best):
                    best[k], column[first + k], above[first + k] = value[k], c, edges[c][cut[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), column[node]] > above[node])
        leaves = node - inner
        total, size = np.bincount(leaves, rest, inner + 1), np.bincount(leaves, weight, inner + 1)
        leaf = total / np.maximum(size, 1e-9) * (size > 0)
        now += rate * leaf[leaves]
        model.column.append(column)
        model.above.append(above)
        model.leaf.append(leaf)
    return model


def rising_fit(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step means of y over score (pool adjacent violators), as points to interpolate."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([s * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class ReadingModel:
    trees: Trees
    score: np.ndarray
    grade: np.ndarray
    folds: list[tuple]  # fold, documents, mean absolute error, that of the mean grade, within half a grade

    def grades(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), self.score, self.grade)

    def least_grade(self, **low: float) -> float:
        """The grade that no text with at least these FEATURES falls below."""
        return float(np.interp(least_prediction(self.trees, {FEATURES.index(k): v for k, v in low.items()}) - 1e-9, self.score, self.grade)) - 1e-9


def fit_reading(docs: DataFrame, doc_id: str, text: Column, source: Column, labels: DataFrame, folds: int = 5) -> ReadingModel | None:
    """Fit on the graded documents, cross-validated over sources: a source is in one fold. The grades
    of several raters of a document are averaged and weigh more; the predictions of the folds calibrate
    the model's. None if fewer than 20 documents have a grade. Labels of unknown documents don't count."""
    graded = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade"), F.count(F.lit(1)).alias("raters"))
    graded = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
    own = docs.select(F.col(doc_id).alias("doc_id"), text.alias("text"), F.coalesce(plain_key(source), F.lit("")).alias("source"))
    rows = own.join(F.broadcast(graded), "doc_id").mapInArrow(_measured(["doc_id", "grade", "raters", "source"]), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, grade double, raters bigint, source string, f array<double>")
    got = rows.toArrow().sort_by("doc_id")  # at most MOST_LABELS rows
    if len(got) < 20:
        return None
    x = np.array(got["f"].to_pylist())
    y, weight = got["grade"].to_numpy(), np.sqrt(got["raters"].to_numpy().astype(float))
    sources = got["source"].to_pylist()
    sizes: dict[str, int] = {}
    for s in sources:
        sizes[s] = sizes.get(s, 0) + 1
    load, fold_of = [0] * folds, {}
    for s in sorted(sizes, key=lambda s: (-sizes[s], s)):
        fold_of[s] = load.index(min(load))
        load[fold_of[s]] += sizes[s]
    fold = np.array([fold_of[s] for s in sources])
    held, report = np.full(len(y), np.nan), []
    for k in range(folds):
        out, rest = fold == k, fold != k
        if out.any() and rest.sum() >= 10:
            held[out] = fit_trees(x[rest], y[rest], weight[rest]).predict(x[out])
    done = np.isfinite(held)
    for k in range(folds):
        out, rest = (fold == k) & done, (fold != k) & done
        if out.any() and rest.any():
            calibrated = np.interp(held[out], *rising_fit(held[rest], y[rest], weight[rest]))
            error = np.abs(calibrated - y[out])
            report.append((k, int(out.sum()), float(error.mean()), float(np.abs(np.average(y[rest], weights=weight[rest]) - y[out]).mean()), float((error <= 0.5).mean())))
    return ReadingModel(fit_trees(x, y, weight), *rising_fit(held[done], y[done], weight[done]), report)


def _measured(keep: list[str], model: ReadingModel | None = None, graded: bool = False):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            x = np.array([features(t, memo) for t in batch["text"].to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            kept = [batch[c] for c in keep]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel()))
            if not graded:
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*keep, "f"])
            else:
                grade = pa.array(model.grades(x), mask=x[:, 0] == 0) if model else pa.nulls(len(x), pa.float64())
                yield pa.RecordBatch.from_arrays([*kept, lists, grade], names=[*keep, "f", "grade"])

    return measure


def reading_levels(docs: DataFrame, doc_id: str, text: Column, source: Column, lang: Column, model: ReadingModel | None) -> DataFrame:
    """(id, source, lang, words, sentences, long_words, lix, grade, level): every document's calibrated
    grade, 1 easy to 4 demanding, and its rounded level. Texts that are null or have no word have
    neither, nor has any without a model. lix is words per sentence plus the percentage of words longer than six letters."""
    rows = docs.select(F.col(doc_id).alias("id"), plain_key(source).alias("source"), F.substring(plain_key(lang), 1, 2).alias("lang"), text.alias("text"))
    done = rows.mapInArrow(_measured(["id", "source", "lang"], model, graded=True), f"id {rows.schema['id'].dataType.simpleString()}, source string, lang string, f array<double>, grade double")
    at = {name: F.col("f")[i] for i, name in enumerate(FEATURES)}
    return done.select("id", "source", "lang", *(at[c].cast("int").alias(c) for c in ("words", "sentences", "long_words")), at["lix"].alias("lix"), "grade", F.round("grade").cast("int").alias("level"))


def level_profile(levels: DataFrame) -> DataFrame:
    """(source, lang, level, docs, mean_grade, words) of the corpus."""
    return levels.groupBy("source", "lang", "level").agg(F.count(F.lit(1)).alias("docs"), F.avg("grade").alias("mean_grade"), F.sum("words").alias("words"))
