"""Toxicity by a weighted lexicon.

Text is folded first: lower case, accents off, homoglyphs and digits that stand
for letters replaced, all else a blank. The lexicon holds word beginnings and
short words that labelled toxic documents have more often than others, by
log-odds; phrases around its terms that clean documents have are its exceptions.
An Aho-Corasick automaton finds terms and exceptions in one pass; what an
exception covers does not count. A logistic curve over sums of weights, plain and
normalised by length, gives the score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import carried, once_per_worker, stored

#: Labelled documents to learn from, at most; taken by a hash of their id.
MAX_TRAIN = 40_000
#: Lengths of word beginnings that may become terms; shorter words count as wholes.
STEMS = (4, 5, 6, 7)
#: Least log-odds of a term with the least standard errors it must be away from 0: rare elsewhere, or surely more frequent.
LEAST = ((2.5, 2.75), (1.0, 6.0))
#: The sum of weights, by length, by share of all words, and of the terms that are rare elsewhere.
FEATURES = ["total", "by_length", "share", "strong"]

#: Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "l", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
}


def _folding() -> np.ndarray:
    """The folded code point of every code point; blanks for what is no letter."""
    out = np.full(0x110000, ord(" "), np.uint32)
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if char in HOMOGLYPHS:
            out[code] = ord(HOMOGLYPHS[char])
        elif char.isalpha():
            base = unicodedata.normalize("NFKD", char)[0].lower()
            base = base[0] if base else char
            base = HOMOGLYPHS.get(base, base)
            out[code] = ord(base) if base.isalpha() else code
    return out


def folded(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The folded texts as one string, each with a blank before and after; their bounds; their numbers of words."""
    # lone surrogates can't come from valid UTF-8
    joined = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    codes = once_per_worker("folding", _folding)[joined]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    word = codes != 32
    heads = np.concatenate([[0], np.cumsum(word[1:] & ~word[:-1])])
    ends = np.append(heads, heads[-1])
    return codes.tobytes().decode("utf-32-le"), bounds, ends[bounds[1:] - 1] - ends[bounds[:-1]]


@dataclass
class Lexicon:
    """terms: weights by folded term, with its blanks; exceptions: folded phrases; curve: of the score."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0, 0.0)


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in lexicon.terms.items():
        out.add_word(term, (len(term), weight))
    for phrase in lexicon.exceptions:
        out.add_word(phrase, (len(phrase), 0.0))
    if len(out):
        out.make_automaton()
    return out


def hits(found: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words start that a term matches and no exception covers, and their greatest weights."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0)
    got = [(end - size + 1, size, weight) for end, (size, weight) in found.iter(text)]
    if not got:
        return np.empty(0, np.int64), np.empty(0)
    at, size, weight = (np.array(x) for x in zip(*got, strict=True))
    free = weight > 0
    if not free.all():
        low, high = at[~free], (at + size)[~free]
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        before = np.searchsorted(low, at, "right") - 1
        covered = (before >= 0) & (high[np.maximum(before, 0)] > at + 1)
        free &= ~covered
    at, weight = at[free], weight[free]
    order = np.lexsort((-weight, at))
    at, weight = at[order], weight[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return at[new], weight[new]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20):
    """Rows with about a million characters: the batch's first and end row, and the texts."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= limit or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def _stems(word: str) -> Iterator[str]:
    if len(word) < STEMS[0]:
        yield f" {word} "
    for size in STEMS:
        if len(word) >= size:
            yield f" {word[:size]}"


def _counted(wanted: set[str] | None):
    """In how many documents a stem occurs, of a partition; only those wanted, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for _, texts in _blocks(batches):
            whole, bounds, _ = folded(texts)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                mine = {s for w in set(whole[a:b].split()) for s in _stems(w)}
                counts.update(mine if wanted is None else mine & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    return run


def _phrases(lexicon: Lexicon):
    """In how many toxic and other documents a two-word phrase around a term's word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        found = automaton(lexicon)
        for batch, texts in _blocks(batches):
            whole, bounds, _ = folded(texts)
            labels = batch.column("label").to_pylist()
            at, _ = hits(found, whole)
            doc = np.searchsorted(bounds, at, "right") - 1
            seen = set()
            for k, i in zip(at.tolist(), doc.tolist(), strict=True):
                before = whole[int(bounds[i]) : k].split()[-1:] if k - bounds[i] < 64 else whole[k - 64 : k].split()[-1:]
                after = whole[k + 1 : min(int(bounds[i + 1]), k + 128)].split()[:2]
                if before and after:
                    seen.add((f" {before[0]} {after[0]} ", labels[i], i))
                if len(after) == 2:
                    seen.add((f" {after[0]} {after[1]} ", labels[i], i))
            counts.update((phrase, label) for phrase, label, _ in seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(counts.values(), pa.int64())],
            ["phrase", "label", "n"],
        )

    return run


def _features(found: ahocorasick.Automaton, texts: list[str]) -> np.ndarray:
    whole, bounds, words = folded(texts)
    at, weight = hits(found, whole)
    doc = np.searchsorted(bounds, at, "right") - 1
    total, strong = (np.bincount(doc, w, len(texts)) for w in (weight, np.where(weight >= LEAST[0][0], weight, 0)))
    return np.stack([np.log1p(total), total / np.sqrt(words + 1), np.log1p(100 * total / (words + 1)), np.log1p(strong)], axis=1)


def _described(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        for batch, texts in _blocks(batches):
            x = _features(found, texts)
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(c) for c in x.T)], ["label", *FEATURES])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, slightly held towards 0; steps are halved until they help."""
    x = np.column_stack([np.ones(len(x)), x])
    hold = np.diag([1e-3] + [0.1] * (x.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ hold @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) >= now:
            size /= 2
        if size <= 1e-6:
            break
        w = w + size * step
        now, before = loss(w), now
        if before - now < 1e-9 * max(1.0, before):
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, max_train: int = MAX_TRAIN) -> Lexicon:
    """A lexicon from the documents of ``labels`` (doc_id, toxic) that are ``allowed`` (a condition on doc_id).

    Null labels don't count; of several for one document the greatest does. At most
    ``max_train`` documents are learned from, taken by a hash of their id.
    """
    rated = labels.filter(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sample = stored(sample.select("text", "label"), "rated")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not bad or not good:
        return Lexicon(curve=(float(np.log((bad + 0.5) / (good + 0.5))), 0.0, 0.0, 0.0, 0.0))

    def counted(label: Column, wanted: set[str] | None) -> DataFrame:
        return sample.filter(label).select("text").mapInArrow(_counted(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    least = max(2, round(0.002 * bad))
    toxic = {r["term"]: r["n"] for r in counted(F.col("label") == 1, None).filter(F.col("n") >= least).collect()}
    clean = {r["term"]: r["n"] for r in counted(F.col("label") != 1, set(toxic)).collect()}
    terms = {}
    for term, t in toxic.items():
        c = clean.get(term, 0)
        odds = float(np.log((t + 0.5) / (bad + 1)) - np.log((c + 0.5) / (good + 1)))
        error = np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if any(odds >= least and odds >= sure * error for least, sure in LEAST):
            terms[term] = odds
    lexicon = Lexicon(terms)
    seen = sample.mapInArrow(_phrases(lexicon), "phrase string, label int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") != 1, F.col("n")).otherwise(0)).alias("c")
    )
    # at least three clean documents have it, and it is rarer among toxic ones
    usual = seen.filter((F.col("c") >= 3) & (F.col("c") * bad > 2 * F.col("t") * good))
    lexicon.exceptions = sorted(r["phrase"] for r in usual.select("phrase").collect())
    got = sample.mapInArrow(_described(lexicon), "label int, " + ", ".join(f"{x} double" for x in FEATURES)).toPandas()
    lexicon.curve = _curve(got[FEATURES].to_numpy(), (got["label"] == 1).to_numpy(float))
    return lexicon


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(**sent.value)
        found = automaton(lexicon)
        for batch, texts in _blocks(batches):
            x = _features(found, texts)
            z = lexicon.curve[0] + x @ np.array(lexicon.curve[1:])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The columns of ``docs`` but text, with score (0 to 1, likelihood of label 1) and predicted (1 from 0.5 on).

    Only ``text`` is looked at; a null one is scored as an empty one.
    """
    rows = carried(docs.drop("score", "predicted"))
    kind = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(vars(lexicon))
    return rows.mapInArrow(_scored(sent), kind).select("row.*", "score", "predicted")
