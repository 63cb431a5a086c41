"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it from left to right: each
phrase is the longest prefix of what remains that occurs anywhere in the labelled text, found by walking the automaton
until it has no transition. The language that needs the fewest phrases, each weighed by the bits that point into its
labelled text, wins.

Whole texts are parsed, in blocks of ``BLOCK`` characters so that all blocks of a batch advance together, one character
a step; phrases end with their block, which adds at most one phrase a block to each language. The labelled sample is
bounded (``SAMPLE_CHARS`` a language, in slices; less where many languages share ``TABLE_BYTES``), which is the only
place where text is sampled: predictions read every character.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import crc_mod5, numbered, only, only_cache, renamed, trim, trimmed

#: Code points of labelled text a language is learned from, and the most that one row gives.
SAMPLE_CHARS = 32_768
SLICE_CHARS = 2_048
#: Bounds of the fit: the languages with the most rows that are learned, and the bytes of all their transitions.
MAX_LANGUAGES = 2_000
TABLE_BYTES = 256 << 20
BLOCK = 192
#: Texts that need more phrases a character in every language than labelled ones do, by this factor, are no language
#: (see ``accepted``); the limit lies between these two rates. SLACK phrases more are left to any text: rates of short ones vary.
MARGIN, LEAST_RATE, MOST_PHRASES, SLACK = 1.5, 0.3, 0.6, 12
#: Shorter texts are too short to be rejected by that rate.
SHORT_TEXT = 40
_UNKNOWN, _GAP = 0, 1


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(65536)), dtype=bool, count=65536)


class Model:
    """Suffix automata of all languages as one transition table."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letter = _letter_table()
        letters = sorted({c for s in samples.values() for c in s.lower() if ord(c) < 65536 and letter[ord(c)]})
        # Class of each character: 0 a letter that no sample has, 1 anything else, 2.. the letters. Beyond the table: unknown letters.
        self.classes = np.where(letter, _UNKNOWN, _GAP).astype(np.int64)
        for k, c in enumerate(letters, 2):
            self.classes[ord(c)] = k
        width = self.width = len(letters) + 3  # the last class is padding
        tables, self.starts, self.bits, base = [], [], [], 0
        for lang in self.languages:
            text = self.normal(samples[lang])
            nexts = _automaton(text.tolist())
            table = np.full((len(nexts), width), -1, dtype=np.int64)
            for state, move in enumerate(nexts):
                if move:
                    table[state, list(move)] = list(move.values())
            table[:, _UNKNOWN] = -1
            # Entries: (row start << 1) | a phrase begins. With no transition a phrase begins with this character: after it
            # stands what the root has for it, or, if no sample has the character, the last row, where a phrase begins with
            # any character. That row is also where blocks start.
            none = len(nexts)
            restart = np.where(table[0] >= 0, table[0], none)
            table = np.vstack([table, np.full((1, width), -1, dtype=np.int64)])
            full = np.where(table >= 0, ((table + base) * width) << 1, (((restart + base) * width) << 1) | 1)
            full[:, width - 1] = ((np.arange(none + 1) + base) * width) << 1
            tables.append(full.astype(np.int32) if full.max() < 2**31 else full)
            self.starts.append((none + base) * width)
            self.bits.append(math.log2(max(2, len(text))))
            base += none + 1
        self.table = np.concatenate([t.ravel() for t in tables])

    def normal(self, text: str) -> np.ndarray:
        """Classes of the lower-cased text, runs of non-letters as one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = np.where(points < 65536, self.classes[np.minimum(points, 65535)], _UNKNOWN)
        gap = classes == _GAP
        keep = np.ones(len(classes), dtype=bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        return classes[keep]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text in each language, characters of each text)."""
        parsed = [self.normal(t) if t else np.zeros(0, dtype=np.int64) for t in texts]
        sizes = np.array([len(p) for p in parsed])
        blocks = -(-sizes // BLOCK)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not blocks.sum():
            return out, sizes
        first = np.concatenate(([0], np.cumsum(blocks)))
        grid = np.full((int(blocks.sum()), BLOCK), self.width - 1, dtype=np.int32)
        flat = grid.ravel()
        for k, p in enumerate(parsed):
            flat[first[k] * BLOCK : first[k] * BLOCK + len(p)] = p
        steps = np.ascontiguousarray(grid.T)
        longest = BLOCK if (sizes >= BLOCK).any() else int(sizes.max())
        some = np.flatnonzero(blocks)
        for lang, start in enumerate(self.starts):
            at = np.full(grid.shape[0], start, dtype=self.table.dtype)
            count = np.zeros(grid.shape[0], dtype=np.int32)
            for t in range(longest):
                move = self.table.take(at + steps[t])
                count += move & 1
                at = move >> 1
            out[some, lang] = np.add.reduceat(count, first[some])
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', score, bits a character in that language over the bits of a phrase)."""
        counts, sizes = self.phrases(texts)
        cost = counts * np.array(self.bits)
        best = cost.argmin(axis=1)
        # Odds between languages: one phrase more is half as likely.
        worse = np.minimum((cost - cost.min(axis=1, keepdims=True)) / np.array(self.bits), 1000.0)
        score = 1.0 / np.exp2(-worse).sum(axis=1)
        rate = counts[np.arange(len(texts)), best] / np.maximum(sizes, 1)
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        lang = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)]
        return lang, np.where(lettered, score, 0.0), np.where(lettered, rate, 1.0)


def _automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return nexts


def draw(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, seed: int = 5) -> tuple[dict[str, str], list[str]]:
    """({language: sample}, slices left over): slices of distinct texts chosen by a hash, up to ``sample_chars`` code points a language.

    Rows without text or language are passed over. Copies of a text count once, so that a language of few distinct texts
    gets them all. Beyond MAX_LANGUAGES languages those with the most rows are learned (ties by code point), and samples
    are shortened alike until the transition table fits TABLE_BYTES.
    """
    spark = labelled.sparkSession
    h = F.xxhash64(F.lit(seed), "text")
    base = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null and text <> ''")
    counts = base.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(h).alias("texts")).orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}, []
    # Four times the texts that full slices would need, so that short ones fill the sample too.
    most = 4 * -(-sample_chars // SLICE_CHARS)
    scale = 1 << 30
    part = spark.createDataFrame([(r["lang"], min(scale, 1 + scale * most // max(1, r["texts"]))) for r in counts], "lang string, part long")
    start = F.pmod(h, F.greatest(F.lit(1), F.length("text") - SLICE_CHARS + 1)).cast("int") + 1
    chosen = (
        base.withColumn("h", h).join(F.broadcast(part), "lang").filter(F.pmod("h", F.lit(scale)) < F.col("part"))
        .select("lang", "h", F.col("text").substr(start, F.lit(SLICE_CHARS)).alias("slice")).distinct()
    )
    samples: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    room, spare = dict.fromkeys(samples, sample_chars), []
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"], r["slice"])):
        if room[r["lang"]] > 0:
            samples[r["lang"]].append(r["slice"][: room[r["lang"]]])
            room[r["lang"]] -= len(samples[r["lang"]][-1]) + 1
        else:
            spare.append(r["slice"])
    joined = {k: "\n".join(v) for k, v in samples.items() if v}
    letters = {c for s in joined.values() for c in s.lower()}
    each = max(64, TABLE_BYTES // (8 * (len(letters) + 3) * max(1, len(joined))))  # two states a character at most, four bytes a transition
    return {k: v[:each] for k, v in joined.items()}, spare


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, seed: int = 5) -> dict[str, str]:
    """{language: sample}; see ``draw``."""
    return draw(labelled, text_col, lang_col, sample_chars, seed)[0]


def _model(samples: dict[str, str]) -> Model:
    """Built once in each Python process."""
    key, models = hash(tuple(sorted(samples.items()))), only_cache("language models")
    if key not in models:
        models.clear()
        models[key] = Model(samples)
        trim()
    return models[key]


def _predict(batches: Iterator[pa.RecordBatch], samples: dict[str, str]) -> Iterator[pa.RecordBatch]:
    model = _model(samples) if samples else None
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = part.column(part.schema.get_field_index("__text")).to_pylist()
            lang, score, rate = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts)))
            rest = [part.column(i) for i, n in enumerate(part.schema.names) if n != "__text"]
            names = [n for n in part.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=[*names, "lang_pred", "score", "phrase_rate"])


def predict(docs: DataFrame, samples: dict[str, str], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, lang_pred, score and phrase_rate for each row; without any sample all is 'und'."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double, phrase_rate double"
    base = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).alias("__text"))
    return base.mapInArrow(lambda it: trimmed(_predict(it, samples)), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod5(id_col) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, phrase_rate.

    Learns from the rows that aren't held out and have a text and a language, predicts from the text alone. ``und``,
    score 0: null texts and texts without a letter. Ties go to the first language by code point. Repeated rows stay,
    null ids count as empty text for the fold. An empty table, or one without labels, gives an empty or an all-``und``
    result. Other columns are ignored.
    """
    samples = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    base = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("held_out", held_out("doc_id"))
    return predict(base, samples, "text", ("doc_id", "held_out"))


def rate_limit(spark: SparkSession, samples: dict[str, str], spare: list[str]) -> float:
    """The most phrases a character that a text may need in its best language: MARGIN times what labelled slices outside the samples need."""
    long = [(k, s) for k, s in enumerate(spare) if len(s) >= SHORT_TEXT]
    if not samples or not long:
        return MOST_PHRASES
    most = predict(spark.createDataFrame(long, "doc_id int, text string"), samples).agg(F.max("phrase_rate")).first()[0]
    return float(min(MOST_PHRASES, max(LEAST_RATE, MARGIN * most)))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_phrases: float | None = None) -> DataFrame:
    """The rows of ``docs`` in some learned language, all columns: with a letter, and not parsed in near single characters by the best language.

    ``most_phrases``: the phrases a character, beside SLACK, beyond which a text of SHORT_TEXT characters or more is rejected;
    by default calibrated on labelled slices that the samples leave over. Null, empty and letterless texts are rejected. Repeated rows
    stay and fare alike. An empty table, or one without labels, gives an empty result.
    """
    samples, spare = draw(docs.filter(~held_out(id_col)), text_col, lang_col)
    limit = rate_limit(docs.sparkSession, samples, spare) if most_phrases is None else most_phrases
    plain, names = numbered(docs)
    kept = predict(plain, samples, names[text_col], tuple(plain.columns)).filter(
        (F.col("lang_pred") != "und") & ((F.col("phrase_rate") <= limit + SLACK / F.length(names[text_col])) | (F.length(names[text_col]) < SHORT_TEXT))
    )
    return renamed(kept, names)
