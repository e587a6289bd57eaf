"""Operator 7: language identification with a linear-chain conditional random field.

Words of a text are labelled with languages.  A word's features are its affixes, character n-grams and the word itself if the lexicon of the training
rows holds it; transitions between the labels of neighbouring words are learned with them, on real rows and on rows spliced from two languages.
Sentences are the chains: forward-backward gives each word's marginals, many sentences advancing together in numpy.  A text's language is that
of the highest mean marginal over its letters, which is also the score.

A word of more than LONGEST letters is taken in consecutive pieces of the same chain, so that all of it counts.  Training rows of over ROW_CHARS characters give a
span of so many, at a place that their id's hash picks.

Null texts, texts without a letter (numerals such as ½ or Ⅷ are none) and empty tables of labelled rows: und, score 0.  Ties go to the language that sorts first.  Very
long texts: linear work on WORDS_AT_ONCE words at a time, a sentence whole.  Repeated rows and extra columns pass through; a column named as the result is replaced.  Languages
are taken to be few: their names, and weights for each, are held by the driver and every task.
"""

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, struct_udf, table

UNKNOWN = "und"
#: Training rows for each language, at most, of at most so many characters; taken in a seeded order.
ROWS_A_LANGUAGE = 150
ROW_CHARS = 8_000
BUCKETS = 1 << 15
NONE = BUCKETS
LEXICON = 5_000
EPOCHS = 3
RATE = 0.25
DECAY = 1e-6
SEED = 7
#: The pipeline keeps a document whose language is known at this score at least.
MIN_SCORE = 0.5

#: Letters of a word, or of a piece of one, at most.
LONGEST = 24
#: Chains are worked on together until they have so many words: a worker holds some ten numbers a word and language.
WORDS_AT_ONCE = 1 << 17

RUNS = re.compile(r"[^\W\d_]+").findall
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def letters_only(run: str) -> list[str]:
    """A run of letters and numerals, without numerals and in pieces of LONGEST letters."""
    parts = [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return [w[k : k + LONGEST] for w in parts for k in range(0, len(w), LONGEST)]


def WORDS(text: str) -> list[str]:
    """The words of a text, in pieces of LONGEST letters at most."""
    runs = RUNS(text)
    if all(map(str.isalpha, runs)) and max(map(len, runs), default=0) <= LONGEST:
        return runs
    return [w for run in runs for w in letters_only(run)]


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Buckets of each word's features, NONE where a row has fewer: n-grams of one to four characters of the bounded word (so affixes too) and its place in the lexicon."""
    low = [w.lower() for w in words]
    bounded = np.array([f"^{w}$" for w in low])
    codes = bounded.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    out, h = [], codes
    for n in range(1, 5):
        if n > 1:
            h = h[:, :-1] * np.uint64(1_000_003) + codes[:, n - 1 :]
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        out.append(np.where(codes[:, n - 1 :] > 0, mixed % np.uint64(BUCKETS), np.uint64(NONE)))
    out.append(np.array([[lexicon.get(w, NONE)] for w in low], np.uint64))
    return np.concatenate(out, axis=1).astype(np.int64)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, jump: np.ndarray, start: np.ndarray):
    """Marginals of every word (rows of emit: log scores of chains laid end to end) and the expected transitions.

    Chains advance together, longest first, so that step t works on the first so many only; sums are rescaled at each step.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    length = lengths[order]
    longest = int(length.max(initial=0))
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
    e = np.exp(emit - emit.max(1, keepdims=True))
    a, b = np.empty_like(e), np.ones_like(e)
    step = np.exp(jump)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        now = np.exp(start) * e[at] if t == 0 else (a[at - 1] @ step) * e[at]
        a[at] = now / now.sum(1, keepdims=True)
    pairs = np.zeros_like(step)
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        at = begin[:n] + t
        ahead = e[at + 1] * b[at + 1]
        back = ahead @ step.T
        b[at] = back / back.sum(1, keepdims=True)
        joint = a[at].T @ (ahead / np.einsum("ij,ij->i", a[at], back)[:, None])
        pairs += joint * step
    p = a * b
    return p / p.sum(1, keepdims=True), pairs


class Crf:
    """languages, lexicon (word: bucket), weights (buckets x languages), transitions and starts."""

    def __init__(self, languages, lexicon, weights, jump, start):
        self.languages, self.lexicon, self.weights, self.jump, self.start = languages, lexicon, weights, jump, start

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores; words of like length are worked on together, so little is padded."""
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for k in range(0, len(order), 4000):
            part = order[k : k + 4000]
            f = features([words[i] for i in part], self.lexicon)
            out[part] = self.weights[f].sum(1) / np.sqrt((f != NONE).sum(1))[:, None]
        return out


def train(rows: list[tuple[str, str]]) -> Crf:
    """rows: text and language.  Stochastic gradient ascent on the chains' conditional likelihood."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Crf([], {}, np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(SEED)
    tally = Counter(w.lower() for t, _ in rows for w in set(WORDS(t)))
    lexicon = {w: NONE + 1 + k for k, (w, _) in enumerate(sorted(tally.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])}
    chains = [(ws, [languages.index(lang)] * len(ws)) for t, lang in rows for s in SENTENCES.split(t) if (ws := WORDS(s))]
    for k in range(len(chains) // 10):  # code-switched: two sentences in one chain
        x, y = chains[rng.integers(len(chains))], chains[rng.integers(len(chains))]
        chains.append((x[0] + y[0], x[1] + y[1]))
    n = len(languages)
    crf = Crf(languages, lexicon, np.zeros((NONE + 1 + LEXICON, n)), np.zeros((n, n)), np.zeros(n))
    distinct = sorted({w for ws, _ in chains for w in ws})
    place = {w: k for k, w in enumerate(distinct)}
    found = features(distinct, lexicon)
    sizes_of = (found != NONE).sum(1)
    squares = np.full(crf.weights.shape, 1e-2)
    jump_squares, start_squares = np.full((n, n), 1e-2), np.full(n, 1e-2)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 200)):
            batch = [chains[k] for k in part]
            words = np.fromiter((place[w] for ws, _ in batch for w in ws), np.int64)
            gold = np.fromiter(chain.from_iterable(y for _, y in batch), np.int64)
            sizes = sizes_of[words]
            flat = found[words]
            flat = flat[flat != NONE]
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            emit = np.add.reduceat(crf.weights[flat], at, axis=0) / np.sqrt(sizes)[:, None]
            lengths = np.array([len(ws) for ws, _ in batch])
            marginals, pairs = forward_backward(emit, lengths, crf.jump, crf.start)
            grad = -marginals
            grad[np.arange(len(gold)), gold] += 1
            spread = np.repeat(grad / np.sqrt(sizes)[:, None], sizes, axis=0)
            g = np.stack([np.bincount(flat, spread[:, y], len(crf.weights)) for y in range(n)], axis=1)
            g = g / len(batch) - DECAY * crf.weights
            squares += g * g
            crf.weights += RATE * g / np.sqrt(squares)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            inner = np.ones(len(gold), bool)
            inner[first] = False
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
            gj = (seen - pairs) / len(batch) - 1e-3 * crf.jump
            jump_squares += gj * gj
            crf.jump += RATE * gj / np.sqrt(jump_squares)
            gs = np.bincount(gold[first], minlength=n) / len(batch) - marginals[first].mean(0) - 1e-3 * crf.start
            start_squares += gs * gs
            crf.start += RATE * gs / np.sqrt(start_squares)
    return crf


class Labeller:
    def __init__(self, crf: Crf, words: int = 1 << 19):
        self.crf, self.bound = crf, words
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(crf.languages)))

    def rows(self, words: list[str]) -> np.ndarray:
        """Each word's row in the table of emission scores; new words are scored together."""
        new = [w for w in set(words) if w not in self.index]
        if new:
            if len(self.index) + len(new) > self.bound:
                self.index.clear()
                new = list(set(words))
            new.sort()
            need = len(self.index) + len(new)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(need - len(self.table), len(self.table)), self.table.shape[1]))])
            at = len(self.index)
            self.table[at:need] = self.crf.scores(new)
            self.index.update(zip(new, range(at, need)))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.crf.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        sums, weight = np.zeros((len(texts), len(self.crf.languages))), np.zeros(len(texts))
        words: list[str] = []
        lengths, of = [], []
        for k, t in enumerate(texts):
            for sentence in SENTENCES.split(t or ""):
                if ws := WORDS(sentence):
                    words += ws
                    lengths.append(len(ws))
                    of.append(k)
                    if len(words) >= WORDS_AT_ONCE:
                        self.add(words, lengths, of, sums, weight)
                        words, lengths, of = [], [], []
        if words:
            self.add(words, lengths, of, sums, weight)
        out = []
        for total, letters in zip(sums, weight):
            if not letters:
                out.append((UNKNOWN, 0.0))
                continue
            mean = total / letters
            best = int(mean.argmax())
            out.append((self.crf.languages[best], float(min(1.0, max(0.0, mean[best])))))
        return out

    def add(self, words: list[str], lengths: list[int], of: list[int], sums: np.ndarray, weight: np.ndarray) -> None:
        """Adds the marginals of whole chains (lengths, laid end to end in words), weighted by letters, to the sums of the texts that they are of."""
        at = self.rows(words)  # which may replace the table
        marginals, _ = forward_backward(self.table[at], np.array(lengths), self.crf.jump, self.crf.start)
        letters = np.fromiter(map(len, words), np.float64, len(words))
        marginals *= letters[:, None]
        begin = np.cumsum(lengths) - lengths
        np.add.at(sums, of, np.add.reduceat(marginals, begin, axis=0))
        np.add.at(weight, of, np.add.reduceat(letters, begin))


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Crf:
    """Trains on a bounded sample of the rows that are not held out, about as many of each language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("k"), F.coalesce(held_out(doc_id), F.lit(False)).alias("out"))
    rows = rows.where(F.col("lang").isNotNull() & ~F.col("out") & (F.length("text") > 0))
    n = F.length("text")
    span = F.substring("text", (F.pmod(F.col("k"), F.greatest(n - ROW_CHARS, F.lit(1))) + 1).cast("int"), F.lit(ROW_CHARS))
    rows = rows.withColumn("text", F.when(n > ROW_CHARS, span).otherwise(F.col("text")))
    share = {r.lang: ROWS_A_LANGUAGE / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not share:
        return train([])
    unit = (F.col("k").cast("double") / float(1 << 64)) + 0.5
    likely = F.create_map(*chain.from_iterable((F.lit(a), F.lit(1.5 * b)) for a, b in share.items()))
    sample = rows.where(unit < likely[F.col("lang")]).orderBy("k", "text").limit(2 * ROWS_A_LANGUAGE * len(share)).collect()
    taken: Counter = Counter()
    chosen = []
    for r in sample:
        taken[r.lang] += 1
        if taken[r.lang] <= ROWS_A_LANGUAGE:
            chosen.append((r.text, r.lang))
    return train(chosen)


def identify(docs: DataFrame, crf: Crf, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct: lang_pred and score."""

    def make():
        labeller = Labeller(crf)
        return lambda texts: [list(c) for c in zip(*labeller.label(texts.to_pylist()))] or [[], []]

    return docs.withColumn(out, struct_udf(make, [("lang_pred", pa.string()), ("score", pa.float64())])(F.col(text)))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return got.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("language")["lang_pred"].alias("lang_pred"), F.col("language")["score"].alias("score"))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of unknown or doubtful language go.  The model is fitted on the table that the pipeline began with."""
    out = free_name(docs, "language")
    crf = fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(docs, crf, out=out).where((F.col(out)["lang_pred"] != UNKNOWN) & (F.col(out)["score"] >= MIN_SCORE)).select(*docs.columns)
