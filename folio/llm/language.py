"""Language identification of code-switched text by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features (hashed), the labels are the languages, and transitions
between neighbouring words are learned with the feature weights, by gradients from forward-backward. Training sequences
are stretches of labelled documents, some spliced from two languages so that switches are seen. A document's language is
the one with the largest sum of word posteriors; the score is that language's mean posterior.

The model is fitted on a bounded sample: about ``per_language`` documents of each language (chosen by a hash of the id),
``train_chars`` characters each. Prediction reads whole texts. Word scores are cached, so a frequent word's features are
computed once a worker; documents run through forward-backward many at a time, by length.

Defined results: null text or text without a letter is ``und`` with score 0; so is everything where no labelled row
exists; repeated rows are predicted each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, tidy, trim

_WORD = re.compile(r"[^\W\d_]+")
DIM = 1 << 17
#: Text without spaces is read in pieces of so many letters.
PIECE = 40


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters, longer ones in consecutive pieces of ``PIECE``; none where the text has no letter."""
    ws = _WORD.findall((text or "").lower())
    if any(len(w) > PIECE for w in ws):
        ws = [w[i : i + PIECE] for w in ws for i in range(0, len(w), PIECE)]
    return ws if any(c.isalpha() for w in ws for c in w) else []


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features: prefixes and suffixes to 4, two- and three-grams with ends marked, the word, its lexicon entry."""
    marked = f"^{word}$".encode()
    out = [b"w" + marked]
    raw = word.encode()
    for k in (1, 2, 3, 4):
        out.append(b"p" + raw[: 2 * k])
        out.append(b"s" + raw[-2 * k :])
    out += [b"2" + marked[i : i + 2] for i in range(len(marked) - 1)]
    out += [b"3" + marked[i : i + 3] for i in range(len(marked) - 2)]
    crc = zlib.crc32
    ids = [crc(x) & (DIM - 1) for x in out]
    if word in lexicon:
        ids.append(crc(b"lex%d" % lexicon[word]) & (DIM - 1))
    return ids


def forward_backward(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posteriors (T, B, K) from word scores of sequences of one length; each step is scaled."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a, steps = np.exp(trans), len(e)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[t - 1] @ a) * e[t]
        alpha[t] = x / x.sum(axis=1, keepdims=True)
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        x = (beta[t + 1] * e[t + 1]) @ a.T
        beta[t] = x / x.sum(axis=1, keepdims=True)
    g = alpha * beta
    return g / g.sum(axis=2, keepdims=True)


def _pair_sums(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of each transition."""
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(trans)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, len(e)):
        x = (alpha[t - 1] @ a) * e[t]
        alpha[t] = x / x.sum(axis=1, keepdims=True)
    beta[-1] = 1
    out = np.zeros_like(a)
    for t in range(len(e) - 2, -1, -1):
        right = beta[t + 1] * e[t + 1]
        pair = alpha[t][:, :, None] * a * right[:, None, :]
        out += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        x = right @ a.T
        beta[t] = x / x.sum(axis=1, keepdims=True)
    return out


class Crf:
    """Languages, hashed weights, transitions and lexicon; :meth:`predict` reads whole texts."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.weights = np.zeros((DIM, k), np.float32)
        self.trans = np.eye(k, dtype=np.float64)
        self.lexicon: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.table = np.zeros((1024, k), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "table": np.zeros((1024, len(self.languages)), np.float32)}

    def fit(self, docs: list[tuple[str, str]], length: int = 24, sequences: int = 4000, epochs: int = 5, batch: int = 200, rate: float = 0.3, lexicon_size: int = 3000) -> Crf:
        """``docs``: (language, text). Adagrad on the sequences' likelihood."""
        rng = np.random.default_rng(7)
        index, k = {x: i for i, x in enumerate(self.languages)}, len(self.languages)
        by: list[list[list[str]]] = [[] for _ in range(k)]
        seen: list[Counter] = [Counter() for _ in range(k)]
        for lang, text in docs:
            if ws := letters(text):
                by[index[lang]].append(ws)
                seen[index[lang]].update(set(ws))
        have = [i for i in range(k) if by[i]]
        if not have:
            return self
        total: Counter = sum(seen, Counter())
        for i in have:  # a lexicon entry is a word that mostly one language uses
            for w, n in seen[i].most_common(lexicon_size):
                if n >= 2 and n * len(have) > 0.5 * total[w] * len(have) and n / len(by[i]) > 0.6 * sum(seen[j][w] / max(1, len(by[j])) for j in have):
                    self.lexicon[w] = i

        def stretch(i: int, n: int) -> list[str]:
            out: list[str] = []
            while len(out) < n:
                ws = by[i][rng.integers(len(by[i]))]
                at = rng.integers(max(1, len(ws) - n + 1))
                out += ws[at : at + n - len(out)]
            return out

        words, labels = [], []
        for s in range(sequences):
            i = have[s % len(have)]
            if len(have) > 1 and rng.random() < 0.3:
                j, cut = have[rng.integers(len(have))], int(rng.integers(4, length - 3))
                words.append(stretch(i, cut) + stretch(j, length - cut))
                labels.append([i] * cut + [j] * (length - cut))
            else:
                words.append(stretch(i, length))
                labels.append([i] * length)
        y = np.array(labels)
        known: dict[str, np.ndarray] = {}
        for w in {w for ws in words for w in ws}:
            known[w] = np.array(features(w, self.lexicon))
        w, trans = np.zeros((DIM, k)), self.trans
        gw, gt = np.full((DIM, k), 1e-6), np.full((k, k), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(sequences)
            for a in range(0, sequences, batch):
                rows = order[a : a + batch]
                feats = [known[x] for r in rows for x in words[r]]
                n = np.fromiter(map(len, feats), np.int64, len(feats))
                flat, ends = np.concatenate(feats), np.cumsum(n)
                scores = (np.add.reduceat(w[flat], ends - n, axis=0) / np.sqrt(n)[:, None]).reshape(len(rows), length, k).transpose(1, 0, 2)
                gold = np.eye(k)[y[rows]].transpose(1, 0, 2)
                err = (gold - forward_backward(scores, trans)).transpose(1, 0, 2).reshape(-1, k) / np.sqrt(n)[:, None]
                grad = np.stack([np.bincount(flat, np.repeat(err[:, c], n), DIM) for c in range(k)], axis=1) / len(rows)
                pairs = np.einsum("tbi,tbj->ij", gold[:-1], gold[1:]) - _pair_sums(scores, trans)
                grad_t = pairs / (len(rows) * length) - 1e-3 * trans
                gw += grad**2
                gt += grad_t**2
                w += rate * grad / np.sqrt(gw)
                trans = trans + rate * grad_t / np.sqrt(gt)
        self.weights, self.trans = w.astype(np.float32), trans
        return self

    def _ids(self, words: list[str], limit: int = 250_000) -> np.ndarray:
        """Rows of the score table; words beyond the limit take rows that the next call uses again."""
        cache = self.cache
        new = list(set(words).difference(cache))
        if new:
            top = len(cache)
            if top + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), self.table.shape[1]), np.float32)])
            for a in range(0, len(new), 20_000):
                some = new[a : a + 20_000]
                feats = [features(x, self.lexicon) for x in some]
                n = np.fromiter(map(len, feats), np.int64, len(feats))
                flat = np.fromiter((i for f in feats for i in f), np.int64, int(n.sum()))
                got = np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]
                self.table[top + a : top + a + len(some)] = np.exp(got - got.max(axis=1, keepdims=True))
            cache.update(zip(new, range(top, top + len(new)), strict=True))
        out = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        if len(cache) > limit:
            for x in new[max(0, limit - len(cache) + len(new)) :]:
                del cache[x]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each whole text."""
        return [x[:2] for x in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, confidence) of each whole text; the confidence is the mean of the words' highest posteriors."""
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        docs, words, lens = [], [], []
        for i, t in enumerate(texts):
            if self.languages and (ws := letters(t)):
                docs.append(i)
                words += ws
                lens.append(len(ws))
        if not docs:
            return out
        ids = self._ids(words)
        n = np.array(lens)
        starts = np.cumsum(n) - n
        order = np.argsort(-n, kind="stable")
        a = 0
        while a < len(order):
            longest = int(n[order[a]])
            some = order[a : a + max(1, min(1024, 600_000 // longest))]
            a += len(some)
            sums, peaks = self._posteriors([ids[starts[d] : starts[d] + n[d]] for d in some], n[some])
            for d, s, p in zip(some, sums, peaks, strict=True):
                k = int(s.argmax())
                out[docs[d]] = (self.languages[k], float(min(1.0, max(0.0, s[k] / n[d]))), float(min(1.0, max(0.0, p / n[d]))))
        return out

    def _posterior_sums(self, rows: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        return self._posteriors(rows, n)[0]

    def _posteriors(self, rows: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of posteriors, and of each word's highest, over each sequence; rows come by falling length, so at step t the first active[t] still run."""
        steps, k = int(n[0]), len(self.languages)
        grid = np.zeros((len(rows), steps), np.int64)
        for r, x in zip(grid, rows, strict=True):
            r[: len(x)] = x
        e = self.table[grid.T]
        active = np.searchsorted(-n, -np.arange(steps), "left")
        trans = np.exp(self.trans - self.trans.max()).astype(np.float32)
        back = np.ascontiguousarray(trans.T)
        alpha = np.empty_like(e)
        alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            m = active[t]
            x = (alpha[t - 1, :m] @ trans) * e[t, :m]
            x /= x.sum(axis=1, keepdims=True)
            alpha[t, :m] = x
        beta = np.ones((len(rows), k), np.float32)
        sums, peaks = np.zeros((len(rows), k)), np.zeros(len(rows))
        for t in range(steps - 1, -1, -1):
            m = active[t]
            if t + 1 < steps and active[t + 1]:
                q = active[t + 1]
                x = (beta[:q] * e[t + 1, :q]) @ back
                x /= x.sum(axis=1, keepdims=True)
                beta[:q] = x
            g = alpha[t, :m] * beta[:m]
            g /= g.sum(axis=1, keepdims=True)
            sums[:m] += g
            peaks[:m] += g.max(axis=1)
        return sums, peaks


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, train_chars: int = 4000) -> Crf:
    """A model from rows that are labelled and not held out: about ``per_language`` of each language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(True)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return Crf([])
    # The share of each language that a hash of the id lets in; the limit is a strict bound.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(draw < share).select(F.col(lang_col), F.substring(text_col, 1, train_chars)).limit(2 * per_language * len(counts)).collect()
    model = Crf(sorted(counts)).fit(sorted((r[0], r[1]) for r in some))
    trim()  # the driver's Python stays small beside its JVM
    return model


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``confidence`` (the mean of the words' highest posteriors)."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    added = ["lang_pred", "score", "confidence"]
    columns = [c for c in docs.columns if c not in added]

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        crf = told.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            got = []
            for a in range(0, len(texts), 500):
                got += crf.judge(texts[a : a + 500])
            found = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], names=[*columns, *added])

    return docs.select(*columns).mapInArrow(tidy(task), docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("confidence", "double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
