"""Language of words by a linear-chain conditional random field, for text that switches languages.

A word's features are its affixes, letter n-grams and, for frequent words of the training sample,
the word itself; transitions between languages are learned with them.  Forward-backward gives each
word the probability of each language; a document's language is the one with the largest mean.

Labelling runs on all documents of a batch at once: texts are cut into segments, the product of a
segment's transfer matrices carries the chain over it, so the loop is over places in a segment and
segments of the longest document, not over words.  The result is that of one chain per document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import U64, keep_rows, map_batches, mix, record, slices, texts
from aislewise.llm.rules import held_out

DOCS_PER_LABEL = 250  # whole documents of each language that the model is fitted on, at most
BITS = 16  # features are hashed to 2**BITS weights a language
LETTERS = 32  # n-grams are taken from so many letters of a word; affixes from all
SEGMENT = 32
LABEL_BYTES = 1 << 20  # texts that are labelled together; a byte takes some 60 bytes of memory meanwhile
WORDS_KEPT = 300_000  # whose emissions a worker remembers
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters; signs like fractions count along, but a text of nothing else has no word."""
    found = WORD.findall(text.lower())
    return found if any(map(str.isalpha, found)) else []


def word_features(words: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs: affixes of up to four letters, 2- and 3-grams, lexicon entries."""
    n = len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    head = np.array([w[:LETTERS] for w in words], f"U{LETTERS}").view(np.uint32).reshape(n, LETTERS).astype(U64)
    tail = np.array([w[-4:][::-1] for w in words], "U4").view(np.uint32).reshape(n, 4).astype(U64)
    every, rows, found = np.arange(n), [], []

    def put(kind: int, code: np.ndarray, keep: np.ndarray) -> None:
        rows.append(every[keep])
        found.append(mix(code[keep] * U64(64) + U64(kind)))

    for letters, kind in ((head, 0), (tail, 8)):
        code = np.zeros(n, U64)
        for k in range(4):
            code = code * U64(0x110000) + letters[:, k]
            put(kind + k, code, sizes > k)
    short = np.minimum(sizes, LETTERS)
    for k in range(LETTERS - 1):
        if not (short > k + 1).any():
            break
        pair = head[:, k] * U64(0x110000) + head[:, k + 1]
        put(16, pair, short > k + 1)
        if k + 2 < LETTERS:
            put(17, pair * U64(0x110000) + head[:, k + 2], short > k + 2)
    known = np.array([w in lexicon for w in words], bool)
    if known.any():
        code = np.array([xxhash.xxh3_64_intdigest(w.encode()) if k else 0 for w, k in zip(words, known, strict=True)], U64)
        put(18, code, known)
    return np.concatenate(rows), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (2**BITS, labels)
    transitions: np.ndarray  # (labels, labels), log
    lexicon: set[str]
    _rows: dict[str, int] = field(default_factory=dict)
    _kept: np.ndarray | None = None

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "transitions": self.transitions, "lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__dict__.update(state, _rows={}, _kept=None)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log weights of distinct words."""
        row, feature = word_features(words, self.lexicon)
        return np.column_stack([np.bincount(row, self.weights[feature, k], len(words)) for k in range(len(self.labels))])

    def emissions_of(self, words: list[str]) -> np.ndarray:
        """Of words in running order; frequent ones are computed once a worker."""
        if self._kept is None:
            self._kept = np.empty((0, len(self.labels)))
        new = list(set(words).difference(self._rows))
        table, at = self._kept, self._rows
        if new:
            table = np.concatenate((table, self.emissions(new)))
            fresh = dict(zip(new, range(len(self._kept), len(table)), strict=True))
            if len(table) <= WORDS_KEPT:
                at.update(fresh)
                self._kept = table
            else:
                found = [fresh[w] if i is None else i for w, i in zip(words, map(at.get, words), strict=True)]
                return table[np.array(found, np.int64)]
        return table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]

    def posteriors(self, docs: list[list[str]]) -> list[np.ndarray]:
        """(words, labels) probabilities of each document."""
        sizes = np.array([len(d) for d in docs])
        flat = [w for d in docs for w in d]
        if not flat:
            return [np.empty((0, len(self.labels)))] * len(docs)
        e = self.emissions_of(flat)
        out = marginals(np.exp(e - e.max(1, keepdims=True)), sizes, np.exp(self.transitions - self.transitions.max()))
        return np.split(out, np.cumsum(sizes)[:-1])


def marginals(p: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word, of chains of ``sizes`` words with emissions ``p`` and steps ``a``.

    Every chain starts from a step out of equal labels.
    """
    k = p.shape[1]
    counts = -(-sizes // SEGMENT)
    first = np.cumsum(counts) - counts  # first segment of each chain
    total = int(counts.sum())
    chain = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(p)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = first[chain] + place // SEGMENT, place % SEGMENT
    block, real = np.ones((SEGMENT, total, k)), np.zeros((SEGMENT, total), bool)
    block[col, row], real[col, row] = p, True

    carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()  # product of the steps of a segment
    for t in range(SEGMENT):
        step = (carry.reshape(-1, k) @ a).reshape(total, k, k) * block[t][:, None, :]
        step /= step.max((1, 2), keepdims=True)
        carry = np.where(real[t][:, None, None], step, carry)
    enter, leave = np.full((total, k), 1.0 / k), np.ones((total, k))
    for j in range(1, int(counts.max())):
        at = first[counts > j] + j
        v = np.einsum("nk,nkl->nl", enter[at - 1], carry[at - 1])
        enter[at] = v / v.sum(1, keepdims=True)
    for j in range(int(counts.max()) - 2, -1, -1):
        at = first[counts > j + 1] + j
        v = np.einsum("nkl,nl->nk", carry[at + 1], leave[at + 1])
        leave[at] = v / v.max(1, keepdims=True)
    forward = np.empty_like(block)
    state = enter
    for t in range(SEGMENT):
        step = (state @ a) * block[t]
        step /= step.sum(1, keepdims=True)
        state = np.where(real[t][:, None], step, state)
        forward[t] = state
    state = leave
    for t in range(SEGMENT - 1, -1, -1):
        forward[t] *= state
        step = (state * block[t]) @ a.T
        step /= step.max(1, keepdims=True)
        state = np.where(real[t][:, None], step, state)
    out = forward[col, row]
    return out / out.sum(1, keepdims=True)


def fit_crf(docs: list[tuple[str, str]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-5, seed: int = 7) -> Crf | None:
    """A model of (text, language) pairs; None without any word.

    Training chains are two runs of words from different documents, so switches are seen and learned.
    """
    labels = sorted({lang for _, lang in docs})
    runs = []
    for text, lang in docs:
        w = words_of(text)
        runs += [(w[i : i + SEGMENT], labels.index(lang)) for i in range(0, len(w), SEGMENT)]
    if not runs:
        return None
    counts: dict[str, int] = {}
    for run, _ in runs:
        for w in run:
            counts[w] = counts.get(w, 0) + 1
    k, rng = len(labels), np.random.default_rng(seed)
    model = Crf(labels, np.zeros((1 << BITS, k)), np.zeros((k, k)), {w for w, n in counts.items() if n >= 20})
    vocab = {w: i for i, w in enumerate(counts)}
    row, feature = word_features(list(vocab), model.lexicon)
    starts = np.searchsorted(row[order := np.argsort(row, kind="stable")], np.arange(len(vocab) + 1))
    feature = feature[order]
    g2, t2 = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    batch = 2048
    for _ in range(rounds):
        shuffled = rng.permutation(len(runs))
        for i in range(0, len(runs), batch):
            picked = [runs[j] for j in shuffled[i : i + batch]]
            size = np.array([len(r) for r, _ in picked])
            ids = np.array([vocab[w] for r, _ in picked for w in r])
            gold = np.repeat([y for _, y in picked], size)
            chain = np.add.reduceat(size, np.arange(0, len(size), 2))
            used, ids = np.unique(ids, return_inverse=True)
            n = starts[used + 1] - starts[used]
            owner = np.repeat(np.arange(len(used)), n)
            f = feature[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[used], n)]
            e = np.column_stack([np.bincount(owner, model.weights[f, c], len(used)) for c in range(k)])[ids]
            p, a = np.exp(e - e.max(1, keepdims=True)), np.exp(model.transitions)
            post = marginals(p, chain, a)
            grad = -post
            grad[np.arange(len(gold)), gold] += 1
            by_word = np.column_stack([np.bincount(ids, grad[:, c], len(used)) for c in range(k)])
            for c in range(k):
                g = np.bincount(f, by_word[owner, c], 1 << BITS) / len(gold) - decay * model.weights[:, c]
                g2[:, c] += g * g
                model.weights[:, c] += rate * g / np.sqrt(g2[:, c])
            inside = np.ones(len(gold), bool)
            inside[np.cumsum(chain) - chain] = False
            at = np.flatnonzero(inside)
            seen = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
            g = (seen - _pairs(p, post, chain, a, at)) / len(gold) - decay * model.transitions
            t2 += g * g
            model.transitions += rate * g / np.sqrt(t2)
    model.weights = model.weights.astype(np.float32)
    return model


def _pairs(p: np.ndarray, post: np.ndarray, sizes: np.ndarray, a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected transitions into the words ``at``, from forward states and posteriors."""
    n, k = p.shape
    start = np.cumsum(sizes) - sizes
    forward, state = np.empty((n, k)), np.full((len(sizes), k), 1.0 / k)
    for t in range(int(sizes.max())):
        on = sizes > t
        step = (state[on] @ a) * p[start[on] + t]
        state[on] = step / step.sum(1, keepdims=True)
        forward[start[on] + t] = state[on]
    # P(i, j) = forward(i) a(i, j) / (forward a)(j) * posterior(j): the backward part cancels in the ratio
    moved = forward[at - 1] @ a
    return a * (forward[at - 1].T @ (post[at] / moved))


def learn_languages(docs: DataFrame, per_label: int = DOCS_PER_LABEL) -> Crf | None:
    """Fit on whole texts of at most about ``per_label`` documents of each language, none held out.

    Rows are taken by a hash of their id against a share set by the language's count, so no language is
    gathered or sorted as a whole; three times ``per_label`` is the firm bound.
    """
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (place < int((1 << 40) * min(1.0, per_label / n))))
    sample = rows.filter(keep).select("doc_id", "text", "lang").distinct().limit(3 * per_label * max(1, len(counts)))
    found = sorted((r["doc_id"], r["text"], r["lang"]) for r in sample.toLocalIterator())
    return fit_crf([(text, lang) for _, text, lang in found])


def label(model: Crf | None, post: np.ndarray) -> tuple[str, float, int]:
    """Language, its mean probability, and number of switches of a document's word posteriors."""
    if not len(post):
        return UNKNOWN, 0.0, 0
    share = post.mean(0)
    return model.labels[int(share.argmax())], min(1.0, float(share.max())), int(np.count_nonzero(np.diff(post.argmax(1))))


def labels_of(model: Crf | None, column: pa.Array) -> tuple[list[int], list[tuple[str, float, int]]]:
    """Number of words and ``label`` of each text, LABEL_BYTES of text at a time."""
    counts, labels = [], []
    for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", LABEL_BYTES):
        split = [words_of(t) for t in texts(part.column("text"))]
        counts += map(len, split)
        labels += [label(model, post) for post in (model.posteriors(split) if model else [()] * len(split))]
    return counts, labels


LABELLED = "doc_id long, lang_pred string, score double, n_words long, n_switches long"


def label_languages(docs: DataFrame, model: Crf | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) of every row.

    ``score`` is the mean probability of the predicted language over the words; ``n_switches`` counts the
    places where the likeliest label changes.  A null text, one without a letter, or any text where the
    model is None gets "und" and 0.  Repeated rows are labelled alike, null ids stay null, an empty
    table gives no row, further columns are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                counts, labels = labels_of(model, batch.column("text"))
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "lang_pred": ([x[0] for x in labels], pa.string()),
                        "score": ([x[1] for x in labels], pa.float64()),
                        "n_words": (counts, pa.int64()),
                        "n_switches": ([x[2] for x in labels], pa.int64()),
                    }
                )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, LABELLED)


def keep_languages(docs: DataFrame, model: Crf | None, least: float) -> DataFrame:
    """The rows whose text has a language with a mean probability of ``least`` or more; all columns stay."""

    def keep(batch):
        return [score >= least for _, score, _ in labels_of(model, batch.column("text"))[1]]

    return keep_rows(docs, keep)
