"""Reading level of documents, from the grade at which words are acquired."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corpusloom.runtime import map_batches

LEVELS = (1, 2, 3, 4, 5)
SAMPLE = 1000
LEAST_WORDS = 40
LEAST_SENTENCES = 3
#: Share of its best level that a word needs to be graded, in each round; the second way is for
#: texts with many sentences of other levels, where labels of whole texts tell little at first.
CONCENTRATIONS = ((0.75,) * 4, (0.5, 0.6, 0.7, 0.75))
LEAST_GRADED = 2
QUANTILES = (0.25, 0.4, 0.5, 0.6, 0.75)
#: Text without sentence ends is judged in stretches of this many words.
LONGEST, STRETCH = 60, 18

SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|[\r\n]+|(?<=[。！？])")
NOT_PROSE = re.compile(r"(?m)^[ \t]*(?:\||#|```|~~~).*$")
WORD = re.compile(r"[^\W\d_]+")


def prose_sentences(text: str) -> Iterator[list[str]]:
    """Words, in lower case, of each sentence; table rows and headings are no prose."""
    text = text.lower()
    if "|" in text or "#" in text or "`" in text or "~" in text:
        text = NOT_PROSE.sub("", text)
    find = WORD.findall
    for sentence in SENTENCE_END.split(text):
        if sentence:
            words = find(sentence)
            if len(words) > LONGEST:
                for at in range(0, len(words), STRETCH):
                    yield words[at : at + STRETCH]
            elif words:
                yield words


@dataclass
class ReadingModel:
    """Grades of words, the quantile of a sentence's grades that tells its level, and the
    bounds between levels on that quantile."""

    grades: dict[str, float] = field(default_factory=dict)
    quantile: float = 0.5
    bounds: tuple[float, ...] = (1.5, 2.5, 3.5, 4.5)
    usual: int = 3

    def grade_of(self, words: Sequence[str]) -> float | None:
        get = self.grades.get
        found = [g for w in words if (g := get(w)) is not None]
        if len(found) < LEAST_GRADED:
            return None
        found.sort()
        return found[int(self.quantile * (len(found) - 1) + 0.5)]

    def level_at(self, grade: float) -> int:
        level = 1
        for bound in self.bounds:
            level += grade > bound
        return level

    def level(self, text: str) -> int:
        """The level of most sentences; between equals the one of more words, then the lower.

        Sentences with fewer than two graded words, such as codes, doses, names and leftover
        page lines, do not count. Without any sentence that counts, all graded words of the
        text are taken together, and without any of those the usual level of the labels.
        """
        votes, words_of, rest = [0] * 6, [0] * 6, []
        for words in prose_sentences(text):
            grade = self.grade_of(words)
            if grade is None:
                rest.extend(g for w in words if (g := self.grades.get(w)) is not None)
                continue
            level = self.level_at(grade)
            votes[level] += 1
            words_of[level] += len(words)
        if any(votes):
            return max(LEVELS, key=lambda x: (votes[x], words_of[x], -x))
        if rest:
            rest.sort()
            return self.level_at(rest[int(self.quantile * (len(rest) - 1) + 0.5)])
        return self.usual


def fit_levels(labelled: Sequence[tuple[str, int]]) -> ReadingModel:
    """The model that tells most of the labelled texts, of one fit for each of CONCENTRATIONS;
    no further one is tried once nearly all are told."""
    best, most = ReadingModel(), -1
    for concentrations in CONCENTRATIONS:
        model = fit_once(labelled, concentrations)
        told = sum(model.level(text or "") == level for text, level in labelled)
        if told > most:
            best, most = model, told
        if told >= 0.98 * len(labelled):
            break
    return best


def fit_once(labelled: Sequence[tuple[str, int]], concentrations: Sequence[float]) -> ReadingModel:
    """A model from labelled texts.

    The grade of a word is its mean level over the sentences that have it, each level
    weighing the same; words spread over the levels, or in few sentences, get none. The
    quantile, and bounds halfway between the levels' medians on it, are those that tell
    most sentences. As a text may hold sentences of other levels, sentences are told by
    the model of each round to grade the words of the next.
    """
    told = [(set(words), words, level) for text, level in labelled for words in prose_sentences(text or "")]
    model = ReadingModel()
    if labelled:
        counts = Counter(level for _, level in labelled)
        model.usual = max(counts, key=lambda x: (counts[x], -x))
    if not told:
        return model
    current: list[int | None] = [level for _, _, level in told]
    for concentration in concentrations:
        total, seen = [0] * 5, {}
        for (distinct, _, _), level in zip(told, current, strict=True):
            if level is not None:
                total[level - 1] += 1
                for w in distinct:
                    seen.setdefault(w, [0] * 5)[level - 1] += 1
        grades = {}
        for w, by_level in seen.items():
            if sum(by_level) >= LEAST_SENTENCES:
                share = [n / max(t, 1) for n, t in zip(by_level, total, strict=True)]
                if max(share) >= concentration * sum(share):
                    grades[w] = sum(x * s for x, s in zip(LEVELS, share, strict=True)) / sum(share)
        ordered = []
        for _, words, _ in told:
            found = sorted(g for w in words if (g := grades.get(w)) is not None)
            ordered.append(found if len(found) >= LEAST_GRADED else None)
        best = None
        for q in QUANTILES:
            at = [None if f is None else f[int(q * (len(f) - 1) + 0.5)] for f in ordered]
            medians = []
            for level in LEVELS:
                values = sorted(a for a, c in zip(at, current, strict=True) if a is not None and c == level)
                medians.append(values[len(values) // 2] if values else float(level))
            for i in range(1, 5):  # calibration keeps the order of the levels
                medians[i] = max(medians[i], medians[i - 1])
            bounds = tuple((a + b) / 2 for a, b in zip(medians, medians[1:]))
            trial = ReadingModel(grades, q, bounds, model.usual)
            right = sum(a is not None and trial.level_at(a) == c for a, c in zip(at, current, strict=True))
            if best is None or right > best[0]:
                best = (right, trial, at)
        model = best[1]
        current = [None if a is None else model.level_at(a) for a in best[2]]
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts, drawn by a hash of their ids: all of them if there are fewer.

    Labels that are null or not among the levels are no labels; of differing labels of a
    document the smallest holds.
    """
    drawn = (
        labels.where(F.col("reading_level").isin(*LEVELS) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("reading_level").alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = documents.select("doc_id", "text").where("text is not null")
    found = texts.join(F.broadcast(drawn), "doc_id").select("text", "level").collect()  # at most ``rows`` ids
    return sorted((r["text"], int(r["level"])) for r in found)


def reading_levels(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_words: int = LEAST_WORDS
) -> DataFrame:
    """(doc_id, reading_level INT) of each document of at least ``least_words`` words that has no label.

    Words are stretches without white space; null and shorter texts give no row, repeated
    rows give repeated rows. The model is fitted on at most ``sample`` labelled texts and
    sent to the executors; its size is bounded by theirs. Without labels every document
    gets level 3. Labels of unknown documents, null labels and further columns do no harm.
    """
    model = fit_levels(labelled_sample(documents, labels, sample))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    known = labels.where("reading_level is not null").select("doc_id").distinct()
    rest = documents.where(F.length("text") >= 2 * least_words - 1).select("doc_id", "text").join(known, "doc_id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                levels = [
                    judge.level(t) if len(t.split(None, least_words)) >= least_words else None
                    for t in batch.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(levels, pa.int32())], names=["doc_id", "reading_level"]
                )

    shape = StructType([documents.schema["doc_id"]]).add("reading_level", IntegerType())
    return map_batches(rest, run, shape).where("reading_level is not null")


def level_profile(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(source, reading_level, documents): how demanding the sources are."""
    found = reading_levels(documents, labels, **how)
    return found.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "reading_level").agg(
        F.count("*").alias("documents")
    )
