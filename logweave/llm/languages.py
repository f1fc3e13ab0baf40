"""Language of every text, and of every stretch of a text in several languages.

Per-word scores come from labelled sentences (word and letter-sequence counts).
The script range of a word narrows the languages it is scored for; to the others
it can only be borrowed, at a fixed cost. A Viterbi path over the words, with a
penalty for switching, labels the text. It may switch at the ends of sentences
only, so all words between two ends share a state, and the recursion needs one
step a sentence, on the sum of its words' scores, to give the same path as one
step a word. Stretches of sentences in one language are the segments.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.runtime import strip

#: The classifier is fitted on at most this many labelled sentences (lowest ids first).
MAX_SAMPLES = 50_000
#: Cost of one switch of language, in nats.
SWITCH = 7.0
#: No word counts more than this against a language, so no single word makes a segment.
WORST = -4.5
#: Cost of a word in a script the language is not written in.
FOREIGN_SCRIPT = 16.0
#: Letter sequences of up to this length are counted.
ORDER = 4
READY = 300_000

_CODE_FENCE = regex.compile(r"```.*?(?:```|\Z)", regex.S)
_LEAF = regex.compile(r"<(\p{L}[^<>\s]*+)>\s*[^<>\s]*+\s*</\1>")
_TAG = regex.compile(r"</?[\p{L}!][^<>\n]*+>")
#: Marks that open a phrase, with those that close it on the same line.
_CLOSES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’", '"': '"', "'": "'"}
_OPENS = regex.compile("[" + "".join(_CLOSES) + "]")
# Shell commands as agents write them, up to the first word that is no argument.
_COMMAND = regex.compile(
    r"\b(?:git (?:diff|log|status|show|commit|push|pull|add)\b(?: --?[\p{L}-]+)*+(?: HEAD[^\s,;]*)?"
    r"|python3? \S+(?: --?\S+)*+|pytest(?: -\S+)*+ \S+|make \p{L}+-[\p{L}-]+|grep(?: -\S+)*+ \S+ \S+"
    r"|sleep \d\S*|cat \S+/\S+)"
)
_MARKED = regex.compile(r"[/\\@_~=#|{}\[\]\p{N}]|^--?\p{L}|^[\p{L}-]+\.\p{L}{1,5}\p{P}*$")
_ENDS = regex.compile(r"[.!?…。！？][\"'”’»)\]>*]*$")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ODD = regex.compile(r"[\p{Cf}\p{Co}\p{Cs}︀-️]")
_TOKENS: dict[str, tuple[tuple[str, ...], bool]] = {}


def plain_sentences(text: str) -> list[list[str]]:
    """Words of each sentence of a text, without what belongs to no language.

    Paths, commands, markup, quoted phrases and odd characters go; a mark that ends
    a sentence stays even if it stood on a path. Sentences without words go too.
    """
    t = unicodedata.normalize("NFC", _ODD.sub("", text))
    # Quotes before tags, as a tag inside a quoted phrase must not part it.
    t = without_quoted(without_quoted(_CODE_FENCE.sub("\n", t), {"`": "`"}))
    t = _COMMAND.sub(_keep_end, _TAG.sub("\n", _LEAF.sub("\n", t)))
    out: list[list[str]] = []
    for line in t.replace("\r", "\n").split("\n"):
        sentence: list[str] = []
        for token in line.split():
            known = _TOKENS.get(token)
            if known is None:
                known = _read_token(token)
                if len(_TOKENS) >= READY:
                    _TOKENS.clear()
                if len(token) <= 64:
                    _TOKENS[token] = known
            sentence += known[0]
            if known[1] and sentence:
                out.append(sentence)
                sentence = []
        if sentence:
            out.append(sentence)
    return out


def without_quoted(text: str, closes: dict[str, str] = _CLOSES) -> str:
    """``text`` with `` # `` for every quoted phrase, of any length, that ends on its line.

    The first closing mark ends a phrase; a single mark before a letter is an
    apostrophe, and one after a letter or digit opens nothing. One scan: where a
    mark has no closing one on the rest of a line, the line is not searched for it again.
    """
    opens = _OPENS if closes is _CLOSES else regex.compile("[" + "".join(closes) + "]")
    if not opens.search(text):
        return text
    return "\n".join(_line_without_quoted(line, closes, opens) for line in text.split("\n"))


def _line_without_quoted(line: str, closes: dict[str, str], opens) -> str:
    out, at, unclosed = [], 0, set()
    m = opens.search(line)
    while m:
        i, mark = m.start(), m.group()
        end = -1
        if mark not in unclosed and not (mark == "'" and i and (line[i - 1].isalpha() or line[i - 1].isdigit())):
            end = _closing(line, i + 1, closes[mark])
            if end < 0:
                unclosed.add(mark)
            elif mark == "'" and end == i + 1:
                end = -1
        if end >= 0:
            out += [line[at:i], " # "]
            at = end + 1
        m = opens.search(line, max(at, i + 1))
    return "".join([*out, line[at:]]) if out else line


def _closing(line: str, start: int, marks: str) -> int:
    """Position of the first of ``marks`` from ``start`` on that is no apostrophe, or -1."""
    found = [line.find(mark, start) for mark in marks]
    end = min((x for x in found if x >= 0), default=-1)
    while marks in ("'", "’") and 0 <= end < len(line) - 1 and line[end + 1].isalpha() and end > start:
        end = line.find(marks, end + 1)
    return end


def _read_token(token: str) -> tuple[tuple[str, ...], bool]:
    """Words of a token without spaces (none if it is a path or the like), and whether it ends a sentence."""
    words = () if _MARKED.search(token) else tuple(_WORD.findall(token.lower()))
    return words, _ENDS.search(token[-12:]) is not None


def _keep_end(m) -> str:
    s = m.group()
    return " #" + s[len(s.rstrip(".!?…,;:)")):] + " "


def bare(word: str) -> str:
    """A word without its accents, as careless writers leave them out."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ł", "l").replace("ß", "ss")


# Unicode ranges of scripts, first and last code point.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
_FIRST = [r[1] for r in SCRIPT_RANGES]


def script(word: str) -> str:
    """The script range most letters of a word lie in (of equals the first), or ``other``."""

    def of(c: str) -> str:
        i = bisect_right(_FIRST, ord(c)) - 1
        return SCRIPT_RANGES[i][0] if i >= 0 and ord(c) <= SCRIPT_RANGES[i][2] else "other"

    first = of(word[0])
    if word.isascii():
        return first
    return Counter(map(of, word)).most_common(1)[0][0]


class LanguageModel:
    """Counts of words and letter sequences per language; scores are log-probabilities."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in samples})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = len(self.langs)
        self.words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        self.grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        self.scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n, bool))
        for lang, text in samples:
            for sentence in plain_sentences(text):
                for word in sentence:
                    forms = {word: 1.0}
                    if bare(word) != word:
                        forms[bare(word)] = 0.3
                    for form, weight in forms.items():
                        self.words[form][at[lang]] += weight
                        for g in self._sequences(form):
                            self.grams[g][at[lang]] += weight
                    self.scripts[script(word)][at[lang]] = True
        self.words, self.grams, self.scripts = dict(self.words), dict(self.grams), dict(self.scripts)
        self.single = sum((self.grams[g] for g in self.grams if len(g) == 1), np.zeros(n))
        total = sum(self.words.values(), np.zeros(n))
        self.word_total, self.letters = total, len({g for g in self.grams if len(g) == 1}) + 1
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((1024, n))

    @staticmethod
    def _sequences(word: str) -> Iterator[str]:
        padded = f"<{word}>"
        for i in range(len(padded)):
            for k in range(1, ORDER + 1):
                if i >= k - 1:
                    yield padded[i - k + 1 : i + 1]

    def _spelling(self, word: str) -> np.ndarray:
        """Log-probability of the letters, each from up to ORDER - 1 before it, interpolated."""
        padded = f"<{word}>"
        out = np.zeros(len(self.langs))
        zero = np.zeros(len(self.langs))
        for i in range(1, len(padded)):
            p = np.full(len(self.langs), 1.0 / self.letters)
            for k in range(1, ORDER + 1):
                if i - k + 1 < 0:
                    break
                seen = self.grams.get(padded[i - k + 1 : i + 1], zero)
                base = self.single if k == 1 else self.grams.get(padded[i - k + 1 : i], zero)
                p = (seen + 2.0 * p) / (base + 2.0)
            out += np.log(p)
        return out

    def score(self, word: str) -> np.ndarray:
        """Log-probability of one word in each language, less the best one's, bounded below.

        Only languages written in the word's script are candidates. A word in a
        script of no language tells nothing.
        """
        candidates = self.scripts.get(script(word))
        if candidates is None:
            return np.zeros(len(self.langs))
        spelling = self._spelling(word)
        counts = self.words.get(word)
        if counts is None:
            spelling = 0.7 * spelling
        else:
            whole = np.log((counts + 0.02) / (self.word_total + 0.02 * len(self.words)))
            spelling = np.logaddexp(whole, math.log(0.05) + spelling - spelling[candidates].max())
        return np.where(candidates, np.maximum(spelling - spelling[candidates].max(), WORST), -FOREIGN_SCRIPT)

    def rows(self, words: list[str]) -> np.ndarray:
        """Score rows of ``words``, each word scored once per worker."""
        if len(self._rows) > READY:
            self._rows.clear()
        index = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            r = self._rows.get(w)
            if r is None:
                r = len(self._rows)
                if r >= len(self._scores):
                    self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
                self._scores[r] = self.score(w)
                self._rows[w] = r
            index[k] = r
        return self._scores[index]

    def segments(self, text: str | None) -> list[tuple[str, float, int]]:
        """``(lang, confidence, words)`` of each segment of a text, in order.

        Confidence is the share of the segment's language among all languages by
        the words' mean scores sharpened by their number (at most ten).
        """
        sentences = plain_sentences(text) if text else []
        if not sentences:
            return []
        flat = [w for s in sentences for w in s]
        starts = np.cumsum([0, *map(len, sentences)])[:-1]
        sums = np.add.reduceat(self.rows(flat), starts, axis=0)
        path = self._best_path(sums)
        out = []
        a = 0
        for b in range(1, len(path) + 1):
            if b == len(path) or path[b] != path[a]:
                n = sum(map(len, sentences[a:b]))
                mean = sums[a:b].sum(axis=0) / n * min(n, 10)
                share = np.exp(mean - np.logaddexp.reduce(mean))
                out.append((self.langs[path[a]], round(float(share[path[a]]), 6), n))
                a = b
        return out

    @staticmethod
    def _best_path(sums: np.ndarray) -> list[int]:
        """Viterbi over words that may switch at the ends of sentences, at the cost of SWITCH: one step a sentence."""
        best, back = sums[0].copy(), []
        stay = np.arange(sums.shape[1])
        for row in sums[1:]:
            top = int(best.argmax())
            switch = best[top] - SWITCH > best
            back.append(np.where(switch, top, stay))
            best = np.where(switch, best[top] - SWITCH, best) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def fit(samples: DataFrame, lang: str = "lang", text: str = "text", order: str = "sample_id") -> LanguageModel:
    """A model from at most MAX_SAMPLES labelled sentences, the lowest ``order`` first."""
    rows = (
        samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .orderBy(order, lang, text).limit(MAX_SAMPLES).select(lang, text).collect()
    )
    if not rows:
        raise ValueError("no labelled sentences")
    return LanguageModel([(r[0], r[1]) for r in rows])


def _segments(df: DataFrame, samples: DataFrame, named: bool) -> DataFrame:
    """Segments of ``(key, named, text)`` rows; with ``named`` only of texts ``named`` is wrong for."""
    key = df.columns[0]
    shared = df.sparkSession.sparkContext.broadcast(fit(samples))  # bounded by MAX_SAMPLES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for k, name, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], pdf.iloc[:, 2], strict=True):
                segments = model.segments(text)
                if not named or len(segments) > 1 or (segments and segments[0][0] != name):
                    out += [(k, i, *segment) for i, segment in enumerate(segments, 1)]
                if not named and not segments:
                    out.append((k, 1, None, None, 0))
            frame = pd.DataFrame(out, columns=[key, "segment_no", "lang", "confidence", "words"])
            yield frame.astype({"segment_no": "int32", "words": "int32", "confidence": "float64"})

    kind = df.schema[key].dataType.simpleString()
    return (df.where("text is not null") if named else df).mapInPandas(
        run, f"`{key}` {kind}, segment_no int, lang string, confidence double, words int"
    )


def label_segments(df: DataFrame, key: str, text: str, samples: DataFrame) -> DataFrame:
    """``(key, segment_no, lang, confidence, words)``: one row per segment of each text.

    Segments are longest stretches of whole sentences in one language, numbered
    from 1. A null, blank or wordless text has one without language and confidence,
    of 0 words. Rows are labelled where they lie. Repeated rows keep their rows; extra columns are not read.
    """
    rows = df.select(F.col(key), F.lit(None).cast("string").alias("named"), F.col(text).alias("text"))
    return _segments(rows, samples, named=False)


def wrong_labels(
    df: DataFrame, key: str, text: str, label: str, samples: DataFrame, aliases: DataFrame
) -> DataFrame:
    """Segments of the texts whose label is missing, wrong, or names one of several languages.

    A label names the language ``aliases`` (alias, lang) gives it, without case and
    outer white space; any other, also null, names none (of two languages for one
    spelling the first counts). Rows with a null key are left out. Labels meet
    their languages by a join of any size.
    """
    clean = lambda c: F.lower(strip(F.col(c)))
    known = aliases.select(clean("alias").alias("alias"), "lang").where("alias is not null and lang is not null")
    known = known.groupBy("alias").agg(F.min("lang").alias("named"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), clean(label).alias("alias"), F.col(text).alias("text"))
    named = rows.join(known, "alias", "left").select(F.col("__k").alias(key), "named", "text")
    return _segments(named, samples, named=True).drop("words")
