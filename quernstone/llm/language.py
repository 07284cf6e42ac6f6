"""The language of every passage of a text, with a confidence.

The script of a word narrows the languages it can be of. Within a script words
are scored per language by a model fitted here: counts of words, and of letter
runs for words never met. Viterbi over the words, with a high penalty for changing
the language inside a sentence and a low one between sentences, labels the text;
neighbouring sentences of one language make a passage.

Words with a capital that the model doesn't know (names), numbers and contact
data say nothing about the language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.sample import hashed_sample

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "zh", "ja", "th", "hi", "ar")
_L = {x: i for i, x in enumerate(LANGUAGES)}
_LATIN = np.array([_L[x] for x in ("en", "de", "fr", "es", "pt", "nl")])

#: Most labelled rows the model is fitted on; they are picked by a hash of their id.
TRAIN_ROWS = 6000
#: Longest text of a row that the model is fitted on; with TRAIN_ROWS it bounds the sample.
TRAIN_CHARS = 8000
#: Words of the model at most, the most frequent first.
VOCABULARY = 60_000
#: Penalties (in nats) of changing the language inside a sentence and between two.
INSIDE, BETWEEN = 12.0, 2.5
#: Bounds of what one known and one unknown word can say.
KNOWN, UNKNOWN = 4.0, 1.5
#: What a word in Latin letters says of a language in another script; a few such words may stand inside it.
OTHER_SCRIPT = -1.5
#: Words remembered with their scores, per Python worker.
MEMO = 400_000
#: Words, padding included, that go through the search together; bounds its memory, whatever the texts' lengths.
PADDED_WORDS = 50_000
#: Texts of a batch labelled together.
AT_ONCE = 1024

#: Frequent words, so that no language is without any where labelled rows are few (fixed values).
COMMON = {
    "en": "the of and to in is that for it was on with as be by at this are from or an we our have has not but they his her you your will all one been were would there their what so if out up who more",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor wir uns",
    "fr": "le la les de des du et en un une que qui dans pour pas sur au avec ce il est sont par plus ne se nous vous mais ou où son sa ses leur cette aux ont été elle comme tout notre très",
    "es": "el la los las de del y en un una que por con para no se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde nuestra nuestro son fue ha",
    "pt": "o a os as de do da dos das e em um uma que por com para não se na no mais como mas foi ao ele sua seu ou ser quando muito há nos já está eu também só pelo pela até isso ela entre nossa nosso são",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om hij ook als dan maar bij nog uit door over ze zich naar heeft hebben wordt deze wij ons onze geen wel die tot je worden kan meer al",
}

#: Not after initials and titles: a name isn't cut.
_SENTENCE_END = re.compile(
    r"(?<=[.!?…])(?<!\b\w\.)(?<!\b[DMSHF]r\.)(?<!\bMs\.)(?<!\bSt\.)(?<!\bNo\.)(?<!\bno\.)(?<!\bMrs\.)(?<!\bSra\.)(?<!\bMme\.)(?<!\bDhr\.)(?<!\bMevr\.)(?<!\bext\.)(?<!\bstr\.)[\"'”’»)\]]*\s+|\s*[\n\r]+\s*|(?<=[。！？।])[”」』）]*"
)
_WORD = re.compile(r"[\w.+-]+\s?(?:@|\(at\)|\[at\])\s?[\w.-]+(?:\sdot\s[\w-]+)*|(?:https?://|www\.)\S+|[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_SCRIPTS = ((re.compile(r"[฀-๿]"), "th"), (re.compile(r"[ऀ-ॿ]"), "hi"), (re.compile(r"[؀-ۿ]"), "ar"))


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Model:
    """Scores of words per language, relative to the mean of the languages."""

    def __init__(self, words: dict[str, np.ndarray], grams: dict[str, np.ndarray]) -> None:
        self.grams = grams
        #: Row 0: says nothing.
        self.rows: list[np.ndarray] = [np.zeros(len(LANGUAGES), dtype=np.float32)]
        self.known: dict[str, int] = {}
        for w, s in words.items():
            self.known[w] = len(self.rows)
            self.rows.append(s)
        self.fixed = len(self.rows)
        self.memo: dict[str, int] = {}

    def row(self, word: str) -> int:
        """The row of ``word`` in the score table, made when it is met first."""
        if len(word) == 1 and word.isupper() and word.isascii():
            return 0
        low = word.lower()
        found = self.known.get(low)
        if found is not None:
            return found
        if not word.isalpha():
            return 0
        score = self._by_script(low)
        if score is None:
            if word[0].isupper() and not (len(word) > 1 and word.isupper()):
                return 0
            score = self._by_grams(low)
        self.rows.append(score)
        return len(self.rows) - 1

    def rows_of(self, words: list[str]) -> list[int]:
        memo = self.memo
        out = []
        for w in words:
            n = memo.get(w)
            if n is None:
                n = memo[w] = self.row(w)
            out.append(n)
        return out

    def forget(self) -> None:
        """Between batches: bound what is remembered."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            del self.rows[self.fixed :]

    def _by_script(self, word: str) -> np.ndarray | None:
        if word.isascii():
            return None
        only: dict[str, float] = {}
        if _KANA.search(word):
            only = {"ja": 6.0}
        elif _HAN.search(word):
            only = {"zh": 3.0, "ja": 1.0}
        else:
            for pattern, language in _SCRIPTS:
                if pattern.search(word):
                    only = {language: 6.0}
        if not only:
            return None
        score = np.full(len(LANGUAGES), -6.0, dtype=np.float32)
        for language, s in only.items():
            score[_L[language]] = s
        return score

    def _by_grams(self, word: str) -> np.ndarray:
        score = np.full(len(LANGUAGES), OTHER_SCRIPT, dtype=np.float32)
        total = sum((self.grams[g] for g in _grams(word) if g in self.grams), np.zeros(len(_LATIN)))
        score[_LATIN] = np.clip(total - total.mean(), -UNKNOWN, UNKNOWN)
        return score


def _relative(counts: dict[str, Counter], least: int, smooth: float, bound: float, most: int) -> dict[str, np.ndarray]:
    """log P(x | language), less the mean over the Latin-script languages, bounded."""
    totals = np.array([max(1, sum(counts[LANGUAGES[i]].values())) for i in _LATIN], dtype=float)
    size = totals.mean()
    all_of = Counter()
    for i in _LATIN:
        all_of.update(counts[LANGUAGES[i]])
    out = {}
    for x, n in all_of.most_common(most):
        if n < least:
            break
        p = np.log((np.array([counts[LANGUAGES[i]][x] for i in _LATIN]) * size / totals + smooth))
        p = p - np.log(np.exp(p).mean())
        score = np.full(len(LANGUAGES), OTHER_SCRIPT, dtype=np.float32)
        score[_LATIN] = np.clip(p, -bound, bound)
        out[x] = score
    return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (text, label) rows; labels may be partly wrong and texts partly in another language.

    Counts from the labels make a first model. Each sentence then counts for the
    language that this model gives it, which rights wrong labels and mixed texts.
    """
    model = None
    for _ in range(2):
        counts: dict[str, Counter] = {x: Counter() for x in LANGUAGES}
        for x, words in COMMON.items():
            for rank, w in enumerate(words.split()):
                counts[x][w] += 30 if rank < 12 else 15
        for text, label in rows:
            for sentence in _SENTENCE_END.split(text):
                words = [w for w in _WORD.findall(sentence) if w.isalpha() and max(w) < "\u0250"]
                if not words:
                    continue
                if model is not None:
                    score = sum(model.rows[model.row(w)] for w in words)
                    best = int(np.argmax(score))
                    label = LANGUAGES[best] if score[best] > 1.0 else label
                counts[label].update(w.lower() for w in words)
        words = _relative(counts, 2, 0.5, KNOWN, VOCABULARY)
        letters: dict[str, Counter] = {x: Counter() for x in LANGUAGES}
        for x in LANGUAGES:
            for w, n in counts[x].items():
                for g in _grams(w):
                    letters[x][g] += min(n, 20)
        grams = {g: s[_LATIN] * 0.5 for g, s in _relative(letters, 3, 1.0, 2.0, VOCABULARY).items()}
        model = Model(words, grams)
    return model


def fitted_on(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> Model:
    """The model fitted on at most ``rows`` labelled rows, which also works without any."""
    label = F.lower(F.trim(F.col(lang_col)))
    usable = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label.alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    # Only labels are read to count the rows that have one.
    sample = hashed_sample(usable.where(F.length("text") <= TRAIN_CHARS), F.struct("id", "lang"), usable.count(), rows)
    return fit([(r.text, r.lang) for r in sample.collect()])


def viterbi(scores: np.ndarray, breaks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best language of every word of several texts at once.

    ``scores`` (texts, words, languages), ``breaks`` (texts, words) tells the first
    word of a sentence; texts shorter than the longest are padded with zeros.
    """
    n, t, k = scores.shape
    state = scores[:, 0].copy()
    came = np.zeros((n, t, k), dtype=bool)
    best_before = np.zeros((n, t), dtype=np.int16)
    cost = np.where(breaks, BETWEEN, INSIDE).astype(np.float32)
    for i in range(1, t):
        best = state.argmax(1)
        other = state[np.arange(n), best] - cost[:, i]
        came[:, i] = other[:, None] > state
        best_before[:, i] = best
        state = np.maximum(state, other[:, None]) + scores[:, i]
    path = np.zeros((n, t), dtype=np.int16)
    now = state.argmax(1).astype(np.int16)
    at = np.arange(n)
    for i in range(t - 1, -1, -1):
        path[:, i] = now
        now = np.where(came[at, i, now], best_before[:, i], now).astype(np.int16)
    return path


def _groups(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """``order``, by rising length, in groups of texts whose padded words stay within PADDED_WORDS; one text at least."""
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * lengths[order[hi]] <= PADDED_WORDS:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _passages(texts: list[str], model: Model) -> tuple[list, ...]:
    """Lists of text, number, passages of the text, start, end, language and confidence of every passage."""
    words_of, breaks_of, sentence_of, spans_of = [], [], [], []
    for text in texts:
        spans, rows, sentence = [], [], []
        at = 0
        for end in [*_SENTENCE_END.finditer(text), None]:
            stop = end.start() if end else len(text)
            words = _WORD.findall(text, at, stop)
            if words:
                rows += model.rows_of(words)
                sentence += [len(spans)] * len(words)
                spans.append((at, stop))
            at = end.end() if end else stop
        words_of.append(rows)
        sentence_of.append(sentence)
        spans_of.append(spans)
    table = np.array(model.rows, dtype=np.float32)
    lengths = np.array([len(w) for w in words_of])
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    out: list[list] = [[] for _ in texts]
    for group in _groups(order, lengths):
        t = int(lengths[group].max())
        rows = np.zeros((len(group), t), dtype=np.int64)
        sent = np.full((len(group), t), -1, dtype=np.int64)
        for i, g in enumerate(group):
            rows[i, : lengths[g]] = words_of[g]
            sent[i, : lengths[g]] = sentence_of[g]
        breaks = np.zeros((len(group), t), dtype=bool)
        breaks[:, 1:] = sent[:, 1:] != sent[:, :-1]
        scores = table[rows]
        path = viterbi(scores, breaks, lengths[group])
        for i, g in enumerate(group):
            n = lengths[g]
            votes = np.zeros((len(spans_of[g]), len(LANGUAGES)))
            sums = np.zeros((len(spans_of[g]), len(LANGUAGES)))
            np.add.at(votes, (sent[i, :n], path[i, :n]), 1)
            np.add.at(sums, sent[i, :n], scores[i, :n])
            label = votes.argmax(1)
            first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            last = np.r_[first[1:], len(label)] - 1
            total = np.add.reduceat(sums, first, axis=0)
            for a, b, s in zip(first, last, total):
                s = np.exp(s - s.max())
                out[g].append((spans_of[g][a][0], spans_of[g][b][1], int(label[a]), float(s[label[a]] / s.sum())))
    rows = [(g, number, len(found), *passage) for g, found in enumerate(out) for number, passage in enumerate(found, 1)]
    return tuple(map(list, zip(*rows))) if rows else ([],) * 7


def _labeller(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names = np.array(LANGUAGES, dtype=object)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                text, number, of, start, end, language, sure = _passages(part.column(part.num_columns - 1).to_pylist(), model)
                model.forget()
                rows = pa.array(text, pa.int64())
                kept = [c.take(rows) for c in part.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(number, pa.int32()), pa.array(of, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(names[np.array(language, dtype=int)], pa.string()), pa.array(sure, pa.float64())],
                    names=[*part.schema.names[:-1], "seg_no", "n_segs", "start_pos", "end_pos", "lang", "confidence"],
                )

    return work


def passages(df: DataFrame, text: Column, model: Model, *keep: str) -> DataFrame:
    """One row per passage: the columns ``keep``, ``seg_no`` (from 1), ``n_segs`` (of the text), ``start_pos``, ``end_pos``, ``lang``, ``confidence``.

    A passage is a longest run of sentences in one language, with code-point offsets
    in the text. ``confidence`` is the share of the passage's language among all,
    by the words of the passage alone. Null texts and texts without a word
    give no rows, rows met repeatedly give theirs as often, an empty table gives
    none. Texts are used whole. ``keep`` may not contain the names made here.
    """
    words = {w: model.rows[n] for w, n in model.known.items()}
    # Bounded by VOCABULARY words and as many letter runs.
    shared = df.sparkSession.sparkContext.broadcast((words, model.grams))
    rows = df.select(*keep, text.alias("__text")).where(F.col("__text").isNotNull())
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_labeller(shared), f"{kept}, seg_no int, n_segs int, start_pos int, end_pos int, lang string, confidence double")


def misdeclared(df: DataFrame, text_col: str, declared: Column, model: Model, *keep: str) -> DataFrame:
    """The passages of the rows that aren't wholly in their declared language, or declare none.

    ``keep`` is extended by ``declared``. A row's passages stay together, so no
    shuffle is needed to judge them.
    """
    rows = df.select(*keep, declared.alias("declared"), F.col(text_col).alias("__t"))
    found = passages(rows, F.col("__t"), model, *keep, "declared")
    wholly = (F.col("n_segs") == 1) & F.coalesce(F.col("lang") == F.col("declared"), F.lit(False))
    return found.where(~wholly)
