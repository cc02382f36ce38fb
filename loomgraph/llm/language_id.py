"""Language of texts and of spans in mixed texts.

Per word, Unicode script ranges narrow the candidate languages; byte-trigram log probabilities give
each candidate a score; Viterbi decoding with a switching penalty labels the words. The label of a
text is the language of most of its letters' bytes and the score is its share.

The model has 65,536 hashed trigrams a language plus script shares: its size depends on the number
of languages only. Counts cover all training rows.

Defined cases: null text, or text without a letter, is ``und`` with score 0; with no training rows
every text is ``und``; ties go to the language first in alphabetical order; repeated rows each get
their row; an empty table gives an empty result; texts of any length are decoded whole, those longer
than a slice alone; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_mod, table

GRAMS = 1 << 16
SWITCH = 8.0
#: A language admits a script that at least this share of its training words are in.
SCRIPT_SHARE = 0.01
SLICE_BYTES = 4_000_000
# Lead bytes of UTF-8 by script (0 none, 1 Latin, 2 Greek, 3 Cyrillic, 4 Armenian and
# Hebrew, 5 Arabic and Syriac, 6 Indic and South-East Asian, 7 kana and Han, 8 Hangul, 9 other).
SCRIPT_RANGES = ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD7, 4), (0xD8, 0xDF, 5), (0xE0, 0xE0, 6), (0xE3, 0xE9, 7), (0xEA, 0xED, 8), (0xF0, 0xF4, 9))
SCRIPTS = 10
_SCRIPT = np.zeros(256, np.int8)
for _lo, _hi, _s in SCRIPT_RANGES:
    _SCRIPT[_lo : _hi + 1] = _s
# Bytes of words: ASCII letters and all bytes of longer characters but those led by 0xC2 and 0xE2 (punctuation).
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 256)
_LETTER = re.compile(r"[^\W\d_]")
#: What stands between words, of the ranges of Latin-1 and general punctuation, symbols and CJK marks: all but their letters.
_MARKS = re.compile("[" + "".join(chr(c) for lo, hi in ((0x80, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x3000, 0x303F)) for c in range(lo, hi + 1) if not chr(c).isalpha()) + "]+")


def has_letter(t: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(t))


def slices(texts: list[str]):
    """Ranges of texts of about ``SLICE_BYTES`` together (a longer text alone)."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > SLICE_BYTES:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def words_of(texts: list[str]):
    """(gram of each word byte, start of each word among them, script of each word, bytes of each word, words per text, first byte of each word in its cleaned text)."""
    raw = [_MARKS.sub(" ", t).lower().encode("utf-8", "replace") for t in texts]
    flat = _CLEAN[np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8)]
    word = flat != 32
    at = np.flatnonzero(word)
    x = flat.astype(np.uint32)
    gram = ((x[at - 1] * 0x9E3B + x[at] * 0x85EB51 + x[at + 1] * 0xC2B2AE35) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    first = np.flatnonzero(~word[at - 1])
    text_of = np.searchsorted(np.cumsum([len(r) + 2 for r in raw]), at[first] - 1, side="right")
    per = np.bincount(text_of, minlength=len(texts))
    script = np.maximum.reduceat(_SCRIPT[flat[at]], first) if len(first) else np.zeros(0, np.int8)
    size = np.diff(np.append(first, len(at)))
    return gram, first, script, size, per


def learn(train: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probability by gram and language, admitted scripts by language) of all rows with both values."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for k, t in zip(langs, texts):
                by.setdefault(k, []).append(t)
            for k, ts in by.items():
                have = total.setdefault(k, np.zeros(GRAMS + SCRIPTS, np.int64))
                for lo, hi in slices(ts):
                    gram, _, script, _, _ = words_of(ts[lo:hi])
                    have[:GRAMS] += np.bincount(gram, minlength=GRAMS)
                    have[GRAMS:] += np.bincount(script, minlength=SCRIPTS)
        for k, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(have[at], pa.int64())], names=["lang", "g", "n"])

    d = train.select(F.col(lang).alias("lang"), F.col(text).alias("t")).where("lang is not null and t is not null")
    rows = d.mapInArrow(count, "lang string, g int, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(langs), GRAMS + SCRIPTS))
    which = np.searchsorted(langs, rows.column("lang").to_pylist()) if langs else np.zeros(0, int)
    counts[which, rows.column("g").to_numpy()] = rows.column("n").to_numpy()
    grams, scripts = counts[:, :GRAMS] + 0.02, counts[:, GRAMS:]
    logp = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    return langs, np.ascontiguousarray(logp), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)


def viterbi(emit: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Best label of every word; texts are decoded side by side, longest first."""
    n_words, n_lang = emit.shape
    out = np.zeros(n_words, np.int16)
    if not n_words or n_lang < 2:
        return out
    start = np.concatenate([[0], np.cumsum(per)[:-1]])
    order = np.argsort(-per, kind="stable")
    per_s, start_s = per[order], start[order]
    longest = int(per_s[0])
    active = np.searchsorted(-per_s, -np.arange(longest), side="left")  # texts with more than t words
    v = np.zeros((len(per), n_lang), np.float32)
    best = np.zeros(n_words, np.int16)  # label with the best path before this word
    stay = np.zeros((n_words, n_lang), bool)
    for t in range(longest):
        k = active[t]
        at = start_s[:k] + t
        cur = v[:k]
        if t:
            top = cur.argmax(1)
            peak = cur[np.arange(k), top][:, None] - SWITCH
            best[at] = top
            stay[at] = cur >= peak
            cur = np.maximum(cur, peak)
        cur = cur + emit[at]
        v[:k] = cur - cur.max(1, keepdims=True)
    label = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = start_s[:k] + t
        lab = label[:k]
        out[at] = lab
        if t:
            label[:k] = np.where(stay[at, lab], lab, best[at])
    return out


def label_texts(texts: list[str], model) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """(language, score, spans of (language, first word, words)) of each text."""
    langs, logp, admits = model
    done = []
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        gram, first, script, size, per = words_of(part)
        if not langs or not len(first):
            done += [("und", 0.0, [])] * len(part)
            continue
        emit = np.add.reduceat(logp[gram], first, axis=0)
        ok = admits[:, script].T
        emit -= np.where(ok | ~ok.any(1, keepdims=True), 0, 60).astype(np.float32)
        got = viterbi(emit, per)
        end = np.cumsum(per)
        for t, b, e in zip(part, end - per, end):
            if b == e or not has_letter(t):
                done.append(("und", 0.0, []))
                continue
            w = np.bincount(got[b:e], weights=size[b:e], minlength=len(langs))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(got[b:e])) + 1, [e - b]])
            spans = [(langs[got[b + x]], int(x), int(y - x)) for x, y in zip(cut[:-1], cut[1:])]
            done.append((langs[int(w.argmax())], float(w.max() / w.sum()), spans))
    return done


def identify(df: DataFrame, model, key: str, text: str) -> DataFrame:
    """(key, lang_pred, score, spans) of every row; spans count words of letters."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        span = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
        for b in batches:
            got = label_texts([t or "" for t in b.column(1).to_pylist()], shared.value)
            spans = [[{"lang": k, "first_word": x, "words": n} for k, x, n in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, span)],
                names=["k", "lang_pred", "score", "spans"],
            )

    d = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return d.mapInArrow(run, f"k {kind}, lang_pred string, score double, spans array<struct<lang:string,first_word:bigint,words:bigint>>").withColumnRenamed("k", key)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc_mod("doc_id", 3)
    model = learn(docs.where(fold != 1))
    out = identify(docs.select("doc_id", "text"), model, "doc_id", "text")
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
