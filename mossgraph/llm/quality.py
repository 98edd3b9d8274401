"""Quality rules: base counts, then the fertility of public tokenisers against bands per language or script.

A text that fails the base rules is rejected. Every other one is tokenised by each given vocabulary, word by
word, and characters per token, share of byte-fallback tokens (tokens of one byte, with a byte-level vocabulary)
and entropy of the token distribution (bits) must lie in that vocabulary's band for its language. Rows whose
language has no band take the band of their script.

Of n tokens, a mean strays from what the language has by about n^-0.5, and an entropy falls short of it likewise,
so bands are wider for short texts. ``fitted`` gives the bands of a labelled corpus: every edge lies beyond all
good documents, by ``MARGIN`` times their greatest deviation.

Null and empty texts have no words and fail the base rules; null languages count as unknown. Equal texts
of a language get equal verdicts. Other columns of the input stay; a column named as a measure is replaced.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Distinct words that a worker remembers; the first half stays when there are more.
REMEMBERED = 100_000


#: How far beyond the good documents an edge lies, in their greatest deviation, and what every band of characters allows.
MARGIN, LEAST_SHARE = 2.0, 0.03


class Band(NamedTuple):
    """Texts outside are rejected. Slacks are divided by the square root of the number of tokens and widen the band."""

    chars_low: float
    chars_high: float
    fallback_high: float
    entropy_low: float
    chars_slack: float = 0.0
    entropy_slack: float = 0.0

    def holds(self, tokens: int, chars: float, fallback: float, entropy: float) -> bool:
        away = 1 / math.sqrt(max(tokens, 1))
        within = self.chars_low - self.chars_slack * away <= chars <= self.chars_high + self.chars_slack * away
        return within and fallback <= self.fallback_high and entropy >= self.entropy_low - self.entropy_slack * away


#: What ``fitted`` gives for the labelled documents of the given tables, by vocabulary.
LANGUAGES = {
    "de": Band(2.176, 2.311, 0.100, 6.461, 4.159, 12.601),
    "en": Band(2.153, 2.286, 0.100, 6.668, 7.328, 14.911),
    "es": Band(1.882, 1.999, 0.100, 6.391, 3.194, 13.765),
    "fr": Band(1.919, 2.038, 0.100, 6.137, 7.761, 11.809),
}
BYTE_LANGUAGES = {
    "de": Band(2.239, 2.377, 0.379, 6.584, 2.553, 13.675),
    "en": Band(2.163, 2.297, 0.496, 6.748, 4.520, 15.908),
    "es": Band(2.001, 2.125, 0.315, 6.321, 2.675, 13.542),
    "fr": Band(1.977, 2.099, 0.682, 6.381, 4.775, 12.514),
}
BANDS = {"piece_bpe_32k.model": LANGUAGES, "byte_bpe_multi_50k.tiktoken": BYTE_LANGUAGES}
#: For texts of other languages: Latin letters, ideographs and kana, anything else; by pieces and by bytes.
SCRIPTS = {"latin": Band(1.30, 6.00, 0.20, 4.5), "cjk": Band(0.40, 3.00, 0.60, 4.5), "other": Band(0.40, 5.00, 0.80, 4.0)}
BYTE_SCRIPTS = {"latin": Band(1.30, 6.00, 0.45, 4.5), "cjk": Band(0.30, 3.00, 0.95, 4.0), "other": Band(0.25, 5.00, 0.95, 4.0)}

_FIELDS = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "base_failed": T.BooleanType(),
    "n_tokens": T.LongType(),
    "chars_per_token": T.DoubleType(),
    "fallback_share": T.DoubleType(),
    "token_entropy": T.DoubleType(),
    "kept": T.BooleanType(),
}
_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}


def spaced(encoding: tiktoken.Encoding, opens: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all words, each encoded alone with a space before it, and how many each has.

    One call does for all of them if no other white space stands in any: then a token with a space begins a word."""
    text = " ".join(words)
    if not words or text.split() != words:
        return joined([encoding.encode_ordinary(" " + w) for w in words])
    ids = np.array(encoding.encode_ordinary(" " + text), np.int32)
    return ids, np.diff(np.append(np.flatnonzero(opens[ids]), len(ids)))


def joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


class Vocabulary:
    """A sentencepiece model, or byte-level ranks (``.tiktoken``) with the pattern that splits words; with the bands for its name."""

    def __init__(self, path: str, pattern: str | None = None):
        if path.endswith(".tiktoken"):
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
            encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.fallback = np.zeros(max(ranks.values()) + 1, bool)
            self.fallback[[i for token, i in ranks.items() if len(token) == 1]] = True
            opens = np.zeros(len(self.fallback), bool)
            opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
            self.encode = lambda words: spaced(encoding, opens, words)
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda words: joined(model.encode(words, num_threads=1))
            self.fallback = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.get_piece_size())])
        self.languages = BANDS.get(path.rsplit("/", 1)[-1], {})
        self.scripts = BYTE_SCRIPTS if path.endswith(".tiktoken") else SCRIPTS
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # tokens of all known words, and where each word's end after a zero

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
            self.ends = self.ends[: len(self.known) + 1]
            self.ids = self.ids[: self.ends[-1]]
        new = [w for w in words if w not in self.known]
        ids, count = self.encode([w.decode() for w in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(count))
        self.ids = np.append(self.ids, ids)

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of fallback tokens and entropy."""
        word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        start, end = self.ends[word], self.ends[word + 1]
        if not (total := int((end - start).sum())):
            return 0, 0.0, 0.0, 0.0
        ids = self.ids[np.arange(total) + np.repeat(end - np.cumsum(end - start), end - start)]
        counts = np.unique(ids, return_counts=True)[1]
        return total, chars / total, int(self.fallback[ids].sum()) / total, math.log2(total) - float(counts @ np.log2(counts)) / total


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    """One per worker process and file."""
    return Vocabulary(path, pattern)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    counts = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    if len(counts) >= len(words) - 2:
        return 0
    n = end = 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):  # noqa: B905
        if counts[window] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def script(text: str) -> str:
    letters = [(c, n) for c, n in Counter(text).items() if c.isalpha()]
    half = 0.5 * sum(n for _, n in letters)
    share = lambda low, high: sum(n for c, n in letters if low <= c <= high) > half
    return "latin" if share("A", "ɏ") else "cjk" if share("぀", "鿿") else "other"


def judge(text: str | None, lang: str | None, words: list[bytes], vocabularies: list[Vocabulary], bands: dict[str, Band] | None = None) -> tuple:
    """A value for each of ``_FIELDS``; with several vocabularies the measures are the first one's and all must accept.

    ``bands`` by language are for a single vocabulary, in place of its own."""
    text = text or ""
    n, chars, symbols, lines, repeated = base_counts(text, words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    first = vocabularies[0].measure(words, chars)
    if failed:
        return n, chars, symbols, lines, repeated, failed, *first, False
    of = [(v.languages if bands is None else bands).get(lang or "") for v in vocabularies]
    alphabet = None if all(of) else script(text)
    kept = all((band or v.scripts[alphabet]).holds(*(v.measure(words, chars) if k else first)) for k, (v, band) in enumerate(zip(vocabularies, of, strict=True)))
    return n, chars, symbols, lines, repeated, failed, *first, kept


def measured(df: DataFrame, paths: list[str], pattern: str | None = None, bands: dict[str, Band] | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with the columns of ``_FIELDS`` after its own; byte-level vocabularies split words by ``pattern``."""
    kept = [c for c in df.columns if c not in _FIELDS]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, v) for k, v in _FIELDS.items())])
    at, lang_at = kept.index(text), kept.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [vocabulary(p, pattern) for p in paths]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts, langs = part.column(at).to_pylist(), part.column(lang_at).to_pylist()
                words = [(t or "").encode().split() for t in texts]
                for v in own:
                    v.learn({w for ws in words for w in ws})
                rows = [judge(*x, own, bands) for x in zip(texts, langs, words, strict=True)]
                made = [pa.array(column, _ARROW[kind]) for column, kind in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema.fieldNames())
        for v in own:  # the worker may do other work next
            v.forget()

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def fitted(df: DataFrame, path: str, pattern: str | None = None, good: str = "good") -> dict[str, Band]:
    """The bands of one vocabulary for each language of ``df`` (text, lang and whether it is good), from its good rows that pass the base rules.

    Characters: their median, ``LEAST_SHARE`` of it, and a slack for short texts. Entropy: a line over n^-0.5. Rows
    without a language and those that aren't known to be good have no say; languages of fewer than 20 texts get no band."""
    rows = measured(df.select("text", "lang", F.col(good).cast("boolean").alias("good")), [path], pattern).where("good AND lang IS NOT NULL AND NOT base_failed")
    rows = rows.select("lang", "chars_per_token", "fallback_share", "token_entropy", F.pow("n_tokens", F.lit(-0.5)).alias("away"))
    centre = rows.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.percentile_approx("chars_per_token", 0.5, 100_000).alias("centre"),
        F.max("fallback_share").alias("fallback"),
        F.coalesce(F.regr_slope("token_entropy", "away"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("token_entropy", "away"), F.avg("token_entropy")).alias("entropy"),
    )
    stray = (F.abs(F.col("chars_per_token") - F.col("centre")) - LEAST_SHARE * F.col("centre")) / F.col("away")
    short = F.col("entropy") + F.col("slope") * F.col("away") - F.col("token_entropy")
    edges = rows.join(centre, "lang").groupBy("lang", *centre.columns[1:]).agg(F.greatest(F.max(stray), F.lit(0.0)).alias("stray"), F.max(short).alias("short"))
    return {
        r.lang: Band(r.centre * (1 - LEAST_SHARE), r.centre * (1 + LEAST_SHARE), max(0.1, MARGIN * r.fallback), r.entropy - MARGIN * r.short, MARGIN * r.stray, -r.slope)
        for r in edges.where("n >= 20").collect()
    }


def filtered(df: DataFrame, paths: list[str], pattern: str | None = None, **options) -> DataFrame:
    """The rows of ``df`` that pass, with its columns."""
    own = {c: f"_{i}" for i, c in enumerate(df.columns)}  # no measure has such a name
    judged = measured(df.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), paths, pattern, text=own["text"], lang=own["lang"], **options)
    return judged.where("kept").select(*(F.col(n).alias(c) for c, n in own.items()))
