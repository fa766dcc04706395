"""Language ID of code-switched text by a linear-chain conditional random field.

A word's features are its byte trigrams (word edges included), its affixes of four bytes and, if the training words hold it
often enough, itself as an entry of the lexicon. Transitions between the languages of neighbouring words are learned
with them. Forward-backward gives every word its language probabilities; a text's language is the one with most of its words' probability.

The model is fitted on the driver on a sample of labelled rows: SAMPLE different texts of each language at most, chosen by a hash of
the text, and SAMPLE_CHARS characters of each. As these are of one language each, runs of words of two languages are spliced into further texts, from
which switching is learned. Whatever is predicted reads the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import vectors as v
from .common import texts

#: Different labelled texts of each language that are fitted, characters of each, spread over the text, and languages: the cost of a word grows with
#: their square. Beyond the bound the values of lang that the fewest texts have are not learned; they are mostly faults of labelling.
SAMPLE, SAMPLE_CHARS = 120, 20_000
LANGUAGES = 256
#: Words of one chain, and how many of its neighbours' words it reads at each end when texts are labelled, so that context does not end with it.
CHAIN, MARGIN = 64, 16
#: Spliced texts of each language, the runs of one, and the words of a run at least and at most.
SPLICED, RUNS, RUN = 24, 8, (4, 20)
BUCKETS = 1 << 15
EPOCHS, RATE, DECAY, CHAINS_A_STEP = 5, 0.25, 1e-6, 256
LEXICON_COUNT = 4
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Letters and, for all that parts words, one edge byte.
_FOLDED = np.where(_LETTER, v.LOWER, 0x20).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


@dataclass
class Model:
    languages: list[str]
    #: Rows of BUCKETS: trigrams, affixes, lexicon; a column for each language.
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray


@dataclass
class Words:
    """Features of the words of a piece: flat lists of indices and where each word's begin."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    grams: np.ndarray
    firsts: np.ndarray
    affixes: np.ndarray
    entries: np.ndarray


def _featurised(data: np.ndarray, bounds: np.ndarray) -> Words:
    starts, ends, row, h = v.words(data, bounds, _LETTER)
    folded = np.full(len(data) + 2, 0x20, np.int64)
    folded[1:-1] = _FOLDED[data]
    tri = (folded[:-2] * 0x9E3779B1 + folded[1:-1] * 0x85EBCA77 + folded[2:] * 0xC2B2AE3D) >> 7 & BUCKETS - 1
    lengths = ends - starts
    flat = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    tail = np.maximum(ends - 4, starts)
    head_end = np.minimum(starts + 4, ends)

    def affix(a, b, salt):
        out = np.full(len(a), salt, np.int64)
        for j in range(4):
            out = (out * 0x01000193 + np.where(a + j < b, folded[np.minimum(a + j, len(data)) + 1], 0)) & 0xFFFFFFFF
        return (out * 0x9E3779B1 >> 9 & BUCKETS - 1) + BUCKETS

    affixes = np.stack([affix(starts, head_end, 17), affix(tail, ends, 91)], axis=1)
    return Words(starts, ends, row, tri[flat], np.cumsum(lengths) - lengths, affixes, (h >> v.U(49)).astype(np.int64) + 2 * BUCKETS)


def _emissions(w: Words, model: Model) -> np.ndarray:
    out = np.add.reduceat(model.weights[w.grams], w.firsts, axis=0)
    out += model.weights[w.affixes].sum(axis=1)
    out += model.weights[w.entries] * model.lexicon[w.entries - 2 * BUCKETS][:, None]
    return out


def _overlapping(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Chains of a text that read MARGIN words on at each end: the words in them (some twice), their chain, their place in it, how many chains there
    are, and where each word stands outside a margin.
    """
    new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    sizes = np.diff(np.append(new, len(row)))
    per_row = -(-sizes // CHAIN)
    n = int(per_row.sum())
    nth = np.arange(n) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    first, last = np.repeat(new, per_row), np.repeat(new + sizes, per_row)
    core = first + nth * CHAIN
    low, high = np.maximum(core - MARGIN, first), np.minimum(core + CHAIN + MARGIN, last)
    lengths = high - low
    begin = np.cumsum(lengths) - lengths
    chain = np.repeat(np.arange(n), lengths)
    place = np.arange(int(lengths.sum())) - begin[chain]
    own = np.arange(len(row))
    of = np.repeat(np.cumsum(per_row) - per_row, sizes) + (own - np.repeat(new, sizes)) // CHAIN
    return low[chain] + place, chain, place, n, begin[of] + own - low[of]


def _chained(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain and place in it of every word."""
    first = np.zeros(len(row), np.int64)
    new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    first[new] = new
    within = np.arange(len(row)) - np.maximum.accumulate(first)
    chain = np.cumsum((within % CHAIN == 0).astype(np.int64)) - 1
    return chain, within % CHAIN, int(chain[-1]) + 1


def _posteriors(emissions: np.ndarray, chain: np.ndarray, place: np.ndarray, n: int, transitions: np.ndarray, fitting: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """By forward-backward: language probabilities of every word and, for fitting, expected transitions in all."""
    k, longest = emissions.shape[1], int(place.max()) + 1
    e = np.zeros((longest, n, k), np.float32)
    there = np.zeros((longest, n, 1), bool)
    e[place, chain] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    there[place, chain] = True
    a = np.exp(transitions).astype(np.float32)
    forward, backward = np.zeros_like(e), np.ones_like(e)
    now = e[0] / e[0].sum(axis=1, keepdims=True)
    forward[0] = now
    for t in range(1, longest):
        now = (now @ a) * e[t]
        now = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
        forward[t] = now
    now = np.ones((n, k), np.float32)
    expected = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        ahead = e[t + 1] * now
        both = ahead @ a.T
        if fitting:
            pair = (forward[t][:, :, None] * a) * ahead[:, None, :]
            pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-30)
            expected += (pair * there[t + 1][:, :, None]).sum(axis=0)
        now = np.where(there[t + 1], both / np.maximum(both.sum(axis=1, keepdims=True), 1e-30), 1.0)
        backward[t] = now
    p = (forward * backward)[place, chain]
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-30), expected


def _spread(text: Column) -> Column:
    """SAMPLE_CHARS characters of a longer text, in 20 parts that are spread over all of it."""
    part, last = SAMPLE_CHARS // 20, F.length(text) - SAMPLE_CHARS // 20
    parts = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.substring(text, (i * last / 19).cast("int") + 1, F.lit(part)))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(parts, " "))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """SAMPLE different texts of each language, or all if there are fewer, from rows that are not held out."""
    known = texts(docs, F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(_spread(F.col("text")).alias("text"), "lang")
    counts = known.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 3 * SAMPLE / r["n"]))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # about 3 * SAMPLE texts of a language are left for the order, however often each stands in the table
    drawn = known.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")])
    drawn = drawn.groupBy("lang", "text").agg(F.first("draw").alias("draw"))
    first = drawn.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("i") <= SAMPLE)
    return sorted((r["lang"], r["text"]) for r in first.select("lang", "text").collect())


def _spliced(rows: list[tuple[str, str]], languages: list[str]) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts of runs of words by turns from two texts of different languages, with where (byte) each run begins and its language."""
    rnd = np.random.Generator(np.random.PCG64(11))
    words = {lang: [t.split() for x, t in rows if x == lang] for lang in languages}
    words = {lang: [own for own in texts_ if len(own) >= RUN[0]] for lang, texts_ in words.items()}
    usable = [lang for lang in languages if words[lang]]
    out = []
    for a in usable if len(usable) > 1 else ():
        others = [x for x in usable if x != a]
        for _ in range(SPLICED):
            pair = [(lang, words[lang][rnd.integers(len(words[lang]))]) for lang in (a, others[rnd.integers(len(others))])]
            text, marks = "", []
            for i in range(RUNS):
                lang, own = pair[i % 2]
                n = int(rnd.integers(RUN[0], RUN[1] + 1))
                at = int(rnd.integers(max(len(own) - n, 0) + 1))
                marks.append((len(text.encode()), languages.index(lang)))
                text += " ".join(own[at : at + n]) + " "
            out.append((text, marks))
    return out


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Adagrad on the chains' conditional likelihood; every word of a document bears its document's language, and those of spliced texts that of their run."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    marked = [(t, [(0, languages.index(lang))]) for lang, t in rows] + _spliced(rows, languages)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in marked])], ["text"])
    # the runs of all texts one behind the other, by row and byte
    of_row = np.array([i for i, (_, own) in enumerate(marked) for _ in own])
    begins, label = (np.array([mark[j] for _, own in marked for mark in own]) for j in (0, 1))
    key = of_row * (1 << 40) + begins
    parts = []
    done = 0
    for part, data, bounds in v.pieces(batch, "text"):
        w = _featurised(data, bounds)
        if len(w.row):
            parts.append((w, label[np.searchsorted(key, (done + w.row) * (1 << 40) + w.starts - bounds[w.row], "right") - 1]))
        done += len(part)
    if not parts:
        return None
    seen = np.bincount(np.concatenate([w.entries for w, _ in parts]) - 2 * BUCKETS, minlength=BUCKETS)
    k = len(languages)
    model = Model(languages, np.zeros((3 * BUCKETS, k), np.float32), np.zeros((k, k)), (seen >= LEXICON_COUNT).astype(np.float32))
    # equal weight for each language however many words its sample has
    words = np.bincount(np.concatenate([y for _, y in parts]), minlength=k)
    weight = words.sum() / k / np.maximum(words, 1)
    squares, squares_t = np.full(model.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
    steps = [(w, y, chain, place, c) for w, y in parts for chain, place, n in [_chained(w.row)] for c in np.array_split(np.arange(n), -(-n // CHAINS_A_STEP))]
    order = np.random.Generator(np.random.PCG64(3))
    for _ in range(EPOCHS):
        for i in order.permutation(len(steps)):
            w, y, chain, place, own = steps[i]
            low, high = np.searchsorted(chain, [own[0], own[-1] + 1])
            gram_end = w.firsts[high] if high < len(w.firsts) else len(w.grams)
            part = Words(w.starts[low:high], w.ends[low:high], w.row[low:high], w.grams[w.firsts[low] : gram_end], w.firsts[low:high] - w.firsts[low], w.affixes[low:high], w.entries[low:high])
            y, c, at = y[low:high], chain[low:high] - own[0], place[low:high]
            p, expected = _posteriors(_emissions(part, model), c, at, len(own), model.transitions)
            error = -p
            error[np.arange(len(y)), y] += 1
            error *= weight[y][:, None] / len(own)
            counts = np.diff(np.append(part.firsts, len(part.grams)))
            which = np.concatenate([part.grams, part.affixes.ravel(), part.entries])
            times = np.concatenate([np.repeat(error, counts, axis=0), np.repeat(error, 2, axis=0), error * model.lexicon[part.entries - 2 * BUCKETS][:, None]])
            touched, back = np.unique(which, return_inverse=True)
            g = np.stack([np.bincount(back, times[:, j], len(touched)) for j in range(k)], axis=1) - DECAY * model.weights[touched]
            squares[touched] += g * g
            model.weights[touched] += RATE * g / np.sqrt(squares[touched])
            follows = at[1:] > 0
            seen_t = np.zeros((k, k))
            np.add.at(seen_t, (y[:-1][follows], y[1:][follows]), 1)
            g = (seen_t - expected) / len(own) - 1e-3 * model.transitions
            squares_t += g * g
            model.transitions += RATE * g / np.sqrt(squares_t)
    return model


def _labelled(w: Words, m: Model) -> np.ndarray:
    """Language probabilities of every word, by chains that overlap."""
    words, chain, place, n, core = _overlapping(w.row)
    return _posteriors(_emissions(w, m)[words], chain, place, n, m.transitions, False)[0][core]


def _runs(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part, data, bounds in v.pieces(batch, "text"):
                out = [[] for _ in range(len(part))]
                w = _featurised(data, bounds) if m is not None and len(data) else None
                if w is not None and len(w.row):
                    best = _labelled(w, m).argmax(axis=1)
                    # bytes that begin a character, to count code points
                    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    new = np.flatnonzero(np.append(True, (w.row[1:] != w.row[:-1]) | (best[1:] != best[:-1])))
                    for a, b in zip(new, np.append(new[1:], len(best)), strict=True):
                        if not any(map(str.isalpha, data[w.starts[a] : w.ends[b - 1]].tobytes().decode("utf-8", "replace"))):
                            continue  # signs outside ASCII that are no letters
                        row = int(w.row[a])
                        base = points[bounds[row]]
                        out[row].append({"start": int(points[w.starts[a]] - base), "end": int(points[w.ends[b - 1]] - base), "lang": m.languages[best[a]], "n_words": int(b - a)})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], ["doc_id", "runs"])

    return run


def switched(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id and runs, the stretches of words of one language in their order (code points, end exclusive; words of
    letters alone count). Texts that are null or without letters, and all texts if nothing was learned, have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInArrow(_runs(shared), "doc_id long, runs array<struct<start:long,end:long,lang:string,n_words:long>>")


def _predict(model, carry: bool = False):
    """carry: whether the rows' own columns go along, with the prediction at their end, or doc_id alone."""

    def run(batches):
        m = model.value
        for batch in batches:
            for part, data, bounds in v.pieces(batch, "text"):
                votes = np.zeros((len(part), len(m.languages) if m else 1))
                lettered = np.zeros(len(part), bool)
                if m is not None and len(data):
                    w = _featurised(data, bounds)
                    if len(w.row):
                        plain = np.bincount(w.row, v.LOWER[data[w.starts]] - 0x61 < 26, len(part)) > 0
                        lettered = plain
                        for i in np.flatnonzero((np.bincount(w.row, minlength=len(part)) > 0) & ~plain):
                            lettered[i] = any(map(str.isalpha, data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")))
                        p = _labelled(w, m)
                        votes = np.stack([np.bincount(w.row, p[:, j], len(part)) for j in range(p.shape[1])], axis=1)
                total = votes.sum(axis=1)
                best = votes.argmax(axis=1)
                ok = lettered & (total > 0)
                names = [m.languages[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)] if m else [UNKNOWN] * len(part)
                score = np.where(ok, np.minimum(votes.max(axis=1) / np.maximum(total, 1e-30), 1.0), 0.0)
                own = part if carry else part.select(["doc_id"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names, pa.string()), pa.array(score)], [*own.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (its share of the words' probability). Reads doc_id, which it only hands on, and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, min_score: float) -> DataFrame:
    """The documents, with all their columns, whose language is known with min_score at least; those without letters go. Needs no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs)))
    named = docs.drop("lang_pred", "score")
    schema = T.StructType([*named.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    rows = named.mapInArrow(_predict(model, True), schema)
    return rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(named.columns)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of docs that are not held out and predicts every row: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing could be learned; ties go to the first
    language by name; repeated rows are predicted alike; an empty table gives an empty one; other columns are not looked at.
    """
    return predict(docs, fit(sample(docs))).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
