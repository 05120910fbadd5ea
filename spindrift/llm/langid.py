"""Language identification as inference over mixtures of languages.

A model holds, for each language, the probabilities of character n-grams (one to three letters of a
word with its edges), learned from a bounded sample of labelled texts. A text is then taken as a
mixture: expectation-maximisation finds the share of each language from the n-gram likelihoods of
the words, a word's n-grams coming from one language. The set of languages is chosen by penalised
likelihood: a further language must raise the log-likelihood by half the logarithm of the number
of words. The language with the largest share is predicted.

A null text, or one without a letter, is `und` with score 0, as is every text if nothing can be
learned. Texts are read whole. Repeated rows are judged alike; an empty table gives no rows. Only
the text enters a prediction.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_texts, slices, table

#: Labelled texts of each language that the model learns from, in expectation at most.
MAX_TRAIN = 3000
#: n-grams are counted by hash.
BINS = 1 << 16
ROUNDS = 12
#: Languages with a smaller share of all words at first aren't tried as further ones.
LEAST_SHARE = 0.02
#: Bytes of words and their likelihoods that one Python worker keeps, about (they are emptied beyond
#: that, between two slices of texts), and bytes of an entry beside its characters and likelihoods.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 250
#: The sample is drawn by a hash in so many steps, so that a share of any size can be drawn.
STEPS = 1 << 62


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the n-grams of lower-case words of letters, at each letter or edge those of one, two
    and three that begin there; whether these exist; and where each word begins."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - place
    one, two, three = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    after = np.concatenate([codes[1:], codes[:1]])
    third = np.concatenate([codes[2:], codes[:2]])
    mixed = np.stack([codes * one, codes * two + after * three + one, (codes * three + after) * one + third * two + three])
    mixed = (mixed ^ mixed >> np.uint64(29)) * two
    there = np.stack([(place > 0) & (left > 1), left > 1, left > 2])
    return (mixed >> np.uint64(48)).astype(np.int64) & BINS - 1, there, starts


class Mixtures:
    """The mixture model; made once in each Python worker's task."""

    def __init__(self, languages: list[str], log_p: np.ndarray):
        self.languages, self.log_p = languages, log_p  # (bins, languages)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.cleaned: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.languages)), dtype=np.float32)
        self.size = 0

    def learn(self, words) -> None:
        """Gives new words the row of their log-likelihoods, or -1 if they have no letter."""
        own = {w: letters(w.lower()) for w in words if w not in self.places}
        new = list(dict.fromkeys(c for c in own.values() if c and c not in self.cleaned))
        if new:
            bins, there, starts = grams(new)
            log = sum(self.log_p[b] * t[:, None] for b, t in zip(bins, there, strict=True))
            self.cleaned |= {c: len(self.rows) + i for i, c in enumerate(new)}
            self.rows = np.concatenate([self.rows, np.add.reduceat(log, starts, axis=0)])
        self.places |= {w: self.cleaned[c] if c else -1 for w, c in own.items()}
        self.size += sum(map(len, own)) * 2 + ENTRY_BYTES * len(own) + 8 * len(self.languages) * len(new)

    def shares(self, p: np.ndarray, starts: np.ndarray, of: np.ndarray, allowed: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expectation-maximisation for all documents at once. p: likelihoods of words by language,
        up to a factor for each word; allowed: languages of each document's mixture."""
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            r = p * pi[of]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
            pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
        return pi

    def infer(self, texts: list[str]) -> list[tuple[str, float]]:
        if self.size > CACHE_BYTES:
            self.forget()
        held, split = [], [text.split() for text in texts]
        self.learn(set().union(*split))
        for words in split:
            at = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
            held.append(at[at >= 0])
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        docs = [i for i, at in enumerate(held) if len(at)]
        if not docs or not self.languages:
            return out
        n = np.array([len(held[i]) for i in docs])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        of = np.repeat(np.arange(len(docs)), n)
        log = self.rows[np.concatenate([held[i] for i in docs])]
        top = log.max(axis=1, keepdims=True)
        p = np.exp(log - top)
        pi = self.shares(p, starts, of, np.ones((len(docs), len(self.languages)), dtype=np.float32), n)
        order = np.argsort(-pi, axis=1, kind="stable")
        best_pi, chosen = self.alone(log - top, starts, len(docs))
        score = np.array(best_pi)
        final = np.zeros_like(pi)
        final[np.arange(len(docs)), chosen] = 1.0
        # nested sets, in the order of the shares; only documents whose next language has some share
        open_docs = np.arange(len(docs))
        for k in range(2, len(self.languages) + 1):
            open_docs = open_docs[pi[open_docs, order[open_docs, k - 1]] >= LEAST_SHARE]
            if not len(open_docs):
                break
            rows = np.isin(of, open_docs)
            own_n = n[open_docs]
            own_starts = np.concatenate([[0], np.cumsum(own_n)[:-1]])
            own_of = np.repeat(np.arange(len(open_docs)), own_n)
            allowed = np.zeros((len(open_docs), len(self.languages)), dtype=np.float32)
            np.put_along_axis(allowed, order[open_docs, :k], 1.0, axis=1)
            found = self.shares(p[rows], own_starts, own_of, allowed, own_n)
            fit = np.add.reduceat(np.log(np.maximum((p[rows] * found[own_of]).sum(axis=1), 1e-30)), own_starts) - (k - 1) * 0.5 * np.log(own_n + 1)
            better = fit > score[open_docs]
            score[open_docs[better]] = fit[better]
            final[open_docs[better]] = found[better]
        for j, i in enumerate(docs):
            best = int(final[j].argmax())
            out[i] = self.languages[best], float(min(max(pi[j, best], 0.0), 1.0))
        return out

    @staticmethod
    def alone(log: np.ndarray, starts: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood and index of each document's best single language."""
        totals = np.add.reduceat(log.astype(np.float64), starts, axis=0)
        return totals.max(axis=1), totals.argmax(axis=1)


def learn(labelled: DataFrame, max_train: int = MAX_TRAIN, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities of n-gram bins. Of each language, the texts whose hashed id
    falls in a share that gives max_train of them are counted; the counts that reach the driver
    are one for each language and bin at most."""
    spark = labelled.sparkSession
    sizes = {r[0]: r[1] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BINS, 0), dtype=np.float32)
    shares = spark.createDataFrame([(l, min(STEPS, max_train * STEPS // sizes[l])) for l in languages], "__lang string, __share long")
    draw = F.xxhash64(F.col(id_col), F.lit(17)).bitwiseAND(STEPS - 1)
    sample = labelled.join(F.broadcast(shares), F.col(lang_col) == F.col("__lang")).where(draw < F.col("__share")).select("__lang", F.coalesce(text_col, F.lit("")))

    def count(batches):
        words: dict[str, dict[str, int]] = {}
        for batch in batches:
            for part in slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = words.setdefault(lang, {})
                    for w in text.split():
                        own[w] = own.get(w, 0) + 1
        for lang, own in words.items():
            cleaned: dict[str, int] = {}
            for w, n in own.items():
                if c := letters(w.lower()):
                    cleaned[c] = cleaned.get(c, 0) + n
            if not cleaned:
                continue
            found, there, _ = grams(list(cleaned))
            weights = np.repeat(np.array(list(cleaned.values()), dtype=np.float64), [len(c) + 2 for c in cleaned])
            bins = sum(np.bincount(b[t], weights[t], BINS) for b, t in zip(found, there, strict=True)).astype(np.int64)
            at = np.flatnonzero(bins)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(bins[at])], names=["lang", "bin", "n"])

    found = map_texts(sample, count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BINS, len(languages)))
    counts[found["bin"].to_numpy(dtype=np.int64), [languages.index(l) for l in found["lang"]]] = found["n"]
    smooth = 0.05
    return languages, np.log((counts + smooth) / (counts.sum(axis=0) + smooth * BINS)).astype(np.float32)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep (the text may be one), lang_pred and score of each row. Columns of df with
    the names of these two give way."""
    held = df.sparkSession.sparkContext.broadcast(model)
    made, keep = uuid.uuid4().hex, [c for c in keep if c not in ("lang_pred", "score")]
    columns = keep if text_col in keep else [*keep, text_col]
    text_at = columns.index(text_col)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def over(batches):
        mixtures = kept(("languages", made), lambda: Mixtures(*held.value))
        for batch in batches:
            for part in slices(batch, text_at):
                found = mixtures.infer([t or "" for t in part.column(text_at).to_pylist()])
                langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), langs, scores], names=[*keep, "lang_pred", "score"])

    return map_texts(df.select(*columns), over, ", ".join([*filter(None, [kinds]), "lang_pred string, score double"]), keeps=True)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~is_held_out()))
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
