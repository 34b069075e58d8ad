"""Language identification with spans: script ranges, per-word scores, and a best path over the words.

Words are stretches of letters of one script.  A word's script narrows its candidates to the languages that
are written in it; character n-grams of the word, counted per language over all training rows, score them.
The best path over a text's words (Viterbi) pays ``PENALTY`` for every change of language, so that stray
words do not cut a text apart while real changes do; its stretches are the spans.  The language with most
letters is the text's, and the share of its letters the score.

Training counts every row with a language outside the held-out fold: tasks add up arrays, Spark sums one row
per language and bucket, the driver gets those.  ``LANGUAGES`` (a documented parameter) bounds the model: the
most frequent values of ``lang`` are learned.  Labelling is one pass without a shuffle.  Texts are
processed in pieces of ``PIECE`` characters and paths in blocks; a block of a long text is solved once for every
language it may start from, and the blocks are joined exactly.

Null texts and texts without a letter are ``und`` with score 0 and no spans, and so is everything if no
language can be learned.  Words in a script that no language uses speak for none.  Ties go to the smaller
language by code point.  A null id is in no held-out fold.  Repeated rows count as often as they occur and are labelled alike.  Extra columns
are kept (``lang_pred score spans`` are replaced); empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import chunks, small_batches
from .hashing import mix, powers
from .labelled import held_out
from .registry import query

LANGUAGES = 64
FOLD = (5, 0)
BITS = 15           # of a bucket's number
GRAMS = (2, 3, 4)   # letters of an n-gram; a word's ends count as letters
PENALTY = 8.0       # of a change of language, in nats
FLOOR = -4.0        # a word's least log share for a language
LEAST_SHARE = 1e-3  # of a language's words in a script it is written in
PIECE = 1 << 18     # characters scored at once
BLOCK = 512         # words of a path's block, times the number of languages
NONE = "und"

# First and last code point of scripts' blocks.
SCRIPT_RANGES = [
    ("Latin", 0x0041, 0x02AF), ("Greek", 0x0370, 0x03FF), ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF),
    ("Syriac", 0x0700, 0x074F), ("Arabic", 0x0750, 0x077F), ("Thaana", 0x0780, 0x07BF),
    ("Arabic", 0x0870, 0x08FF), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Oriya", 0x0B00, 0x0B7F),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F),
    ("Lao", 0x0E80, 0x0EFF), ("Tibetan", 0x0F00, 0x0FFF), ("Myanmar", 0x1000, 0x109F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x139F),
    ("Cherokee", 0x13A0, 0x13FF), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Latin", 0x2C60, 0x2C7F),
    ("Georgian", 0x2D00, 0x2D2F), ("Ethiopic", 0x2D80, 0x2DDF), ("Cyrillic", 0x2DE0, 0x2DFF),
    ("Han", 0x2E80, 0x2FFF), ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF),
    ("Bopomofo", 0x3100, 0x312F), ("Hangul", 0x3130, 0x318F), ("Han", 0x3400, 0x4DBF),
    ("Han", 0x4E00, 0x9FFF), ("Cyrillic", 0xA640, 0xA69F), ("Latin", 0xA720, 0xA7FF),
    ("Hangul", 0xAC00, 0xD7FF), ("Han", 0xF900, 0xFAFF), ("Hebrew", 0xFB1D, 0xFB4F),
    ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFF), ("Latin", 0xFF21, 0xFF5A),
    ("Han", 0x20000, 0x323AF)]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]

_FIRST = np.array([a for _, a, _ in SCRIPT_RANGES])
_LAST = np.array([b for _, _, b in SCRIPT_RANGES])
_NUMBER = np.array([SCRIPTS.index(name) for name, _, _ in SCRIPT_RANGES])
_FACTORS = mix(np.arange(1, max(GRAMS) + 2, dtype=np.uint64) << np.uint64(33)) | np.uint64(1)


def script_numbers(code: np.ndarray) -> np.ndarray:
    """The script (index into SCRIPTS) of code points."""
    at = np.searchsorted(_FIRST, code, side="right") - 1
    return np.where((at >= 0) & (code <= _LAST[np.maximum(at, 0)]), _NUMBER[np.maximum(at, 0)], 0)


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join([c.lower() if len(c.lower()) == 1 else c for c in text])  # keeps every place


class Words:
    """The words of some pieces of text: piece, first character, length, script, and distinct words."""

    def __init__(self, pieces: list[str]):
        data = "".join([_lower(p) + "\n" for p in pieces])
        code = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])]).astype(np.int64)
        used = np.flatnonzero(np.bincount(code))
        category = [unicodedata.category(chr(c))[0] for c in used.tolist()]
        kind, letter = np.zeros(int(used.max(initial=0)) + 1, dtype=np.int64), np.zeros(len(code), dtype=bool)
        is_mark, is_letter = np.zeros(len(kind), dtype=bool), np.zeros(len(kind), dtype=bool)
        is_letter[used] = [c == "L" for c in category]
        is_mark[used] = [c == "M" for c in category]
        kind[used] = np.where(is_letter[used] | is_mark[used], script_numbers(used) + 1, 0)
        letter, script = is_letter[code], kind[code]
        own = ~(is_mark[code] & (script == 1))  # a mark outside the scripts' blocks goes with its letter
        own[0] = True
        script = script[np.maximum.accumulate(np.where(own, np.arange(len(code)), 0))]
        edge = np.ones(len(code) + 1, dtype=bool)
        edge[1:-1] = script[1:] != script[:-1]
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        letters = np.concatenate([[0], np.cumsum(letter)])
        word = (script[start] > 0) & (letters[end] > letters[start])
        start, end = start[word], end[word]
        self.piece = np.searchsorted(begin, start, side="right") - 1
        self.start, self.length = start - begin[self.piece], end - start
        self.letters, self.script = letters[end] - letters[start], script[start] - 1
        up, down = powers(len(code))
        total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * up[:len(code)], out=total[1:])
        names = mix((total[end] - total[start]) * down[start]) + self.script.astype(np.uint64)
        _, first, self.distinct = np.unique(names, return_index=True, return_inverse=True)
        self._code, self._from, self._length = code, start[first], self.length[first]
        self.scripts = self.script[first]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the distinct words' n-grams, and where each word's begin."""
        padded = self._length + 2
        begin = np.cumsum(padded) - padded
        place = np.arange(int(padded.sum())) - np.repeat(begin, padded)
        last = np.repeat(padded, padded) - 1 - place  # places after this one in the word
        inner = (place > 0) & (last > 0)
        symbols = np.zeros(len(place), dtype=np.uint64)
        symbols[inner] = (self._code[(np.repeat(self._from - 1, padded) + place)[inner]] + 1).astype(np.uint64)
        out = np.full((len(place), len(GRAMS)), -1, dtype=np.int64)
        for j, n in enumerate(GRAMS):
            size = max(0, len(symbols) - n + 1)
            whole = np.full(size, n, dtype=np.uint64)
            for k in range(n):
                whole += symbols[k:k + size] * _FACTORS[k]
            bucket = (mix(whole) >> np.uint64(64 - BITS)).astype(np.int64)
            out[:size, j] = np.where(last[:size] >= n - 1, bucket, -1)
        flat = out.ravel()
        there = flat >= 0
        upto = np.concatenate([[0], np.cumsum(there)])
        return flat[there], upto[begin * len(GRAMS)]


def cut(text: str) -> Iterator[tuple[int, str]]:
    """(place, piece) of a text: pieces of about ``PIECE`` characters that end at a blank, or twice that."""
    lo = 0
    while lo < len(text):
        hi = len(text)
        if hi - lo > PIECE:
            hi = text.find(" ", lo + PIECE, lo + 2 * PIECE)
            hi = min(len(text), lo + 2 * PIECE) if hi < 0 else hi
        yield lo, text[lo:hi]
        lo = hi


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # by code point
    gram: np.ndarray      # log share of every bucket, per language
    written: np.ndarray   # script by language: whether it is written in it
    prior: np.ndarray     # log share of the training rows

    def word_scores(self, words: Words) -> np.ndarray:
        """Log share of every language per distinct word, at least FLOOR; 0 where no language has the script."""
        if not len(words.scripts):
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        bucket, begin = words.grams()
        total = np.add.reduceat(self.gram[bucket], begin, axis=0) / len(GRAMS)
        may = self.written[words.scripts]
        total = np.where(may, total, -np.inf)
        some = may.any(axis=1)
        total[~some] = 0
        total -= total.max(axis=1, keepdims=True)
        total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
        total[~some] = 0
        return np.maximum(total, FLOOR).astype(np.float32)


def best_paths(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, penalty: float = PENALTY,
               block: int | None = None) -> np.ndarray:
    """The language of every word: text k owns rows first[k] to first[k + 1] of ``scores``.

    Lanes advance one word a step, all at once: the first block of every text, and for each later block one
    lane per language that the block before may end in.
    """
    n = scores.shape[1]
    block = block or BLOCK * n
    begin, entry, text = [], [], []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        for lo in range(a, b, block):
            entries = [-1] if lo == a else range(n)
            begin += [lo] * len(entries)
            entry += entries
            text += [k] * len(entries)
    path = np.zeros(len(scores), dtype=np.int64)
    if not begin:
        return path
    begin, entry, text = np.array(begin), np.array(entry), np.array(text)
    size = np.minimum(first[text + 1] - begin, block)
    order = np.argsort(-size, kind="stable")
    begin, entry, text, size = begin[order], entry[order], text[order], size[order]
    enter = np.where(np.arange(n) == entry[:, None], 0.0, -penalty)
    value = np.where(entry[:, None] < 0, np.maximum(prior, FLOOR), enter) + scores[begin]
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")  # lanes longer than t
    stays, bests = [], []
    for t in range(1, int(size[0])):
        v = value[:active[t]]
        best = v.argmax(axis=1)
        change = v[np.arange(len(v)), best] - penalty
        stay = v >= change[:, None]
        value[:active[t]] = np.where(stay, v, change[:, None]) + scores[begin[:active[t]] + t]
        stays.append(stay)
        bests.append(best.astype(np.int16))
    # per block the language it ends in and the lane that reaches it
    chosen, state = np.zeros(len(begin), dtype=bool), value.argmax(axis=1)
    many = np.flatnonzero(np.bincount(text, minlength=len(first) - 1) > 1)
    lane_of = {(k, b, e): i for i, (k, b, e) in enumerate(zip(text.tolist(), begin.tolist(), entry.tolist()))}
    single = ~np.isin(text, many)
    chosen[single] = True
    for k in many.tolist():
        starts = list(range(int(first[k]), int(first[k + 1]), block))
        reach, back = value[lane_of[k, starts[0], -1]], []
        for b in starts[1:]:
            both = reach[:, None] + value[[lane_of[k, b, e] for e in range(n)]]
            back.append(both.argmax(axis=0))
            reach = both.max(axis=0)
        end = int(reach.argmax())
        for b, came in zip(starts[:0:-1], back[::-1]):
            lane = lane_of[k, b, int(came[end])]
            chosen[lane], state[lane] = True, end
            end = int(came[end])
        lane = lane_of[k, starts[0], -1]
        chosen[lane], state[lane] = True, end
    for t in range(int(size[0]) - 1, -1, -1):
        lanes = np.flatnonzero(chosen[:active[t]])
        path[begin[lanes] + t] = state[lanes]
        if t:
            now = state[lanes]
            state[lanes] = np.where(stays[t - 1][lanes, now], now, bests[t - 1][lanes])
    return path


def train(docs: DataFrame, fold: tuple[int, int] = FOLD, languages: int = LANGUAGES) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)`` outside the held-out fold."""
    small_batches(docs.sparkSession)
    rows = docs.filter(f"lang is not null and text is not null and not coalesce({held_out(*fold)}, false)")
    frequent = (rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect())
    known = sorted(r["lang"] for r in frequent)  # UTF-8 and code points have one order
    number = {lang: i for i, lang in enumerate(known)}
    buckets = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(known), buckets + len(SCRIPTS)), dtype=np.int64)
        for batch in batches:
            by_language: dict[int, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang in number:
                    by_language.setdefault(number[lang], []).extend(piece for _, piece in cut(text))
            for i, pieces in by_language.items():
                for lo, hi in chunks(pieces, PIECE):
                    words = Words(pieces[lo:hi])
                    bucket, begin = words.grams()
                    times = np.bincount(words.distinct, minlength=len(words.scripts))
                    each = np.diff(np.append(begin, len(bucket)))
                    total[i, :buckets] += np.bincount(
                        bucket, weights=np.repeat(times, each), minlength=buckets).astype(np.int64)
                    total[i, buckets:] += np.bincount(words.script, minlength=len(SCRIPTS))
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])],
            ["language", "bucket", "n"])

    total = np.zeros((len(known), buckets + len(SCRIPTS)))
    if known:
        found = (rows.select("lang", "text").mapInArrow(run, "language int, bucket int, n bigint")
                 .groupBy("language", "bucket").agg(F.expr("sum(n) n"))
                 .toArrow())  # at most one row per language and bucket
        total[found.column("language").to_numpy(), found.column("bucket").to_numpy()] = \
            found.column("n").to_numpy()
    grams, scripts = total[:, :buckets] + 0.5, total[:, buckets:]
    shares = np.log(grams) - np.log(grams.sum(axis=1, keepdims=True))
    written = scripts >= np.maximum(1.0, LEAST_SHARE * scripts.sum(axis=1, keepdims=True))
    counts = {r["lang"]: r["count"] for r in frequent}
    prior = np.array([counts[lang] for lang in known], dtype=float)
    return LanguageModel(known, np.ascontiguousarray(shares.T.astype(np.float32)),
                         np.ascontiguousarray(written.T), np.log(prior / max(prior.sum(), 1.0)))


def label_texts(model: LanguageModel, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of every text."""
    n = len(model.languages)
    if not n:
        return [(NONE, 0.0, [])] * len(texts)
    out: list[tuple[str, float, list[dict]]] = []
    pieces = [(k, place, piece) for k, text in enumerate(texts) for place, piece in cut(text)]
    parts = []
    for lo, hi in chunks([p for _, _, p in pieces], PIECE):
        words = Words([p for _, _, p in pieces[lo:hi]])
        text = np.array([k for k, _, _ in pieces[lo:hi]])[words.piece]
        place = np.array([at for _, at, _ in pieces[lo:hi]])[words.piece]
        parts.append((text, words.start + place, words.length, words.letters,
                      model.word_scores(words)[words.distinct]))
    if not parts:
        return [(NONE, 0.0, [])] * len(texts)
    text, start, length, letters, scores = (np.concatenate(c) for c in zip(*parts))
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    path = best_paths(scores, first, model.prior)
    share = np.bincount(text * n + path, weights=letters, minlength=len(texts) * n).reshape(-1, n)
    turn = np.ones(len(path), dtype=bool)
    turn[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(turn)
    last = np.append(at[1:], len(path)) - 1
    spans = [{"start": a, "end": b, "lang": model.languages[lang]} for a, b, lang in zip(
        start[at].tolist(), (start[last] + length[last]).tolist(), path[at].tolist())]
    span_of = np.searchsorted(text[at], np.arange(len(texts) + 1)).tolist()
    for k in range(len(texts)):
        total = share[k].sum()
        best = int(share[k].argmax())
        out.append((model.languages[best], float(share[k][best] / total), spans[span_of[k]:span_of[k + 1]])
                   if total else (NONE, 0.0, []))
    return out


def label_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows of ``docs(text, …)`` with lang_pred, score and spans (start, end in characters; language)."""
    small_batches(docs.sparkSession)
    added = T.StructType.fromDDL(
        "lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added.names]
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("text").alias("whole"))
    schema = T.StructType([rows.schema["kept"], *added.fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = [t or "" for t in batch.column("whole").to_pylist()], []
            for lo, hi in chunks(texts, PIECE):
                done += label_texts(model, texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array([d[0] for d in done], pa.string()),
                 pa.array([d[1] for d in done], pa.float64()), pa.array([d[2] for d in done], span_type)],
                schema.names)

    return rows.mapInArrow(run, schema).select("kept.*", *added.names)


@query("op11_language_id")
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    return label_languages(docs.select("doc_id", "text"), model).selectExpr(
        "doc_id", f"coalesce({held_out(*FOLD)}, false) held_out", "lang_pred", "score", "spans")
