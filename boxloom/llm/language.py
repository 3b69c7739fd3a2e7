"""Language identification by cross-parsing.

For every labelled language a suffix automaton is built from a bounded sample of
its texts. A text is parsed against each: every phrase is the longest string
from where the last one ended that occurs in the language's sample, so the
number of phrases, times log2 of the sample's size, estimates the bits the text
costs in that language (cross-parsing entropy). The language with the fewest
normalised phrases wins.

*Sample*: ``DOCS`` documents a language (the least hash of doc_id in each of as
many hash buckets, found in one pass over doc_id and lang) and ``SNIPPET``
letters of each; these bounds are parameters. Only the sample is sent to the
executors; a worker builds the automata once and keeps them as tables.

*Parsing* runs over all windows of a batch at once, ``WINDOW`` characters each
(a phrase ends at a window's end, in every language alike); whole texts are
parsed.

Defined results: a null text, or one without letters, is ``und`` with score 0;
with no labelled text at all everything is ``und``; ties go to the first
language by name; a null doc_id is never learned from; rows that repeat are
judged each; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.text import bounded, give_back, held

DOCS, SNIPPET, WINDOW = 48, 512, 256
#: Character classes: unknown letters, anything but letters, then letters (rare ones share the last classes).
LETTERS, SHARED = 78, 16
#: Characters, and windows, parsed at once: a worker's arrays stay within some 25 MB, however short its texts are, but for a text that is longer by itself.
SLICE, ABREAST = 1 << 20, 1 << 12

_alpha: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS, snippet: int = SNIPPET) -> list[tuple[str, str]]:
    """(language, snippet) rows: at most ``per_language`` of each language, by the hash of doc_id."""
    ids, lang = F.col(id_col), F.col(lang_col)
    hashed = F.xxhash64(ids)
    open_ = ids.isNotNull() & lang.isNotNull() & ~held_out(ids)
    buckets = docs.where(open_).groupBy(lang.alias("lang"), F.pmod(hashed, F.lit(per_language)).alias("bucket")).agg(F.min(hashed).alias("pick"))
    text = F.col(text_col)
    part = F.substring(text, F.floor(F.char_length(text) / 3).cast("int") + 1, F.lit(snippet))
    near = docs.where(open_ & text.isNotNull()).select(lang.alias("lang"), hashed.alias("pick"), part.alias("part"))
    rows = near.join(F.broadcast(buckets.select("lang", "pick")), ["lang", "pick"]).groupBy("lang", "pick").agg(F.min("part").alias("part")).collect()
    return sorted((r["lang"], r["part"]) for r in rows)


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class SuffixAutomaton:
    """Of one string of class numbers; the states and their moves."""

    def __init__(self, string: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in string:
            last = self._add(last, c)

    def _add(self, last: int, c: int) -> int:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = self.link[cur] = copy
        return cur

    def table(self, classes: int) -> np.ndarray:
        """For state and class: four times the state after it, plus the phrases it ends (0 to 2)."""
        n = len(self.next)
        root = np.zeros(classes, np.int32)
        for c, q in self.next[0].items():
            root[c] = q
        out = np.empty((n, classes), np.int32)
        out[:] = root * 4 + np.where(root > 0, 1, 2)  # a phrase ends and c begins one, or is one of its own
        out[0] = root * 4 + (root == 0)
        for state, moves in enumerate(self.next):
            for c, q in moves.items():
                out[state, c] = 4 * q
        return out.ravel()


class Model:
    """Automata of all languages over common character classes."""

    def __init__(self, rows: list[tuple[str, str]]):
        texts: dict[str, str] = {}
        for lang, part in rows:
            texts[lang] = f"{texts.get(lang, '')} {part.lower()}"
        self.languages = sorted(texts)
        letter = _is_letter()
        points = {lang: _points(t) for lang, t in texts.items()}
        every = np.concatenate([*points.values(), np.zeros(0, np.uint32)])
        found, counts = np.unique(every[letter[every]], return_counts=True)
        ranked = found[np.lexsort((found, -counts))]
        rare = ranked[LETTERS:]
        self.classes = 2 + min(len(ranked), LETTERS) + (SHARED if len(rare) else 0)  # tables have no columns that no text can ask for
        self.map = np.where(letter, 0, 1).astype(np.uint8)
        self.map[ranked[:LETTERS]] = 2 + np.arange(min(len(ranked), LETTERS))
        self.map[rare] = 2 + LETTERS + rare % SHARED
        self.tables, self.bits = [], []
        for lang in self.languages:
            coded = self.map[points[lang]]
            self.tables.append(SuffixAutomaton(coded[coded > 0].tolist()).table(self.classes))
            self.bits.append(np.log2(max(2, len(coded))))

    def phrases(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each window (rows of ``windows``: classes by place; columns: windows, longest first) in each language."""
        out = np.zeros((len(self.tables), windows.shape[1]), np.int64)
        active = np.searchsorted(-lengths, -np.arange(windows.shape[0]), side="left")  # windows longer than each place
        for k, table in enumerate(self.tables):
            state, count = np.zeros(windows.shape[1], np.int32), np.zeros(windows.shape[1], np.int32)
            for at in range(windows.shape[0]):
                n = active[at]
                step = table[state[:n] * self.classes + windows[at, :n]]
                count[:n] += step & 3
                state[:n] = step >> 2
            out[k] = count + (state > 0)
        return out

    def judge(self, texts: pa.Array | list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: how much cheaper the best language is than the next one. Python strings are made of a slice at a time."""
        names, scores = [], [np.zeros(0)]
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        for lo, hi in bounded(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), SLICE):
            some, values = self._judge(texts[lo:hi].to_pylist())
            names += some
            scores.append(values)
        return names, np.concatenate(scores)

    def _judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, scores = ["und"] * n, np.zeros(n)
        letter = _is_letter()
        lowered = [(t or "").lower() for t in texts]
        sizes = np.array([len(t) for t in lowered], np.int64)
        if not self.languages or not sizes.sum():
            return names, scores
        points = _points("".join(lowered))
        coded = self.map[points]
        starts = np.cumsum(sizes) - sizes
        letters = np.zeros(len(points) + 1, np.int32)
        np.cumsum(letter[points], out=letters[1:])
        has = letters[starts + sizes] > letters[starts]
        pieces = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(n), pieces)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * WINDOW
        length = np.minimum(WINDOW, sizes[doc] - place)
        order = np.argsort(-length, kind="stable")
        doc, begin, length = doc[order], (starts[doc] + place)[order], length[order]
        cost = np.zeros((len(self.languages), n))
        for lo in range(0, len(doc), ABREAST):
            part = slice(lo, lo + ABREAST)
            at = np.minimum(begin[part][None, :] + np.arange(length[lo])[:, None], len(coded) - 1)
            found = self.phrases(coded[at], length[part])
            for k in range(len(self.languages)):
                cost[k] += np.bincount(doc[part], found[k], minlength=n)
        cost *= np.array(self.bits)[:, None]
        best = np.argmin(cost, axis=0)
        low = cost[best, np.arange(n)]
        rest = np.partition(cost, 1, axis=0)[1] if len(self.languages) > 1 else np.full(n, np.inf)
        score = np.where(np.isinf(rest), 1.0, 1 - low / np.maximum(rest, 1e-9))
        for i in np.flatnonzero(has):
            names[i], scores[i] = self.languages[best[i]], min(1.0, max(0.0, score[i]))
        return names, scores


def _model(rows: tuple) -> Model:
    models = held("languages")
    key = hash(rows)
    if key not in models:
        models.clear()
        models[key] = Model(list(rows))
    return models[key]


def predictor(rows: list[tuple[str, str]]):
    """A column function of a text giving struct(lang, score)."""
    fixed = tuple(rows)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = _model(fixed).judge(texts)
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict


def identify(docs: DataFrame, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learns from ``learn_from`` (``docs`` if left out)."""
    rows = sample(docs if learn_from is None else learn_from, id_col, text_col, lang_col)
    told = predictor(rows)(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), told.alias("_told")).select("doc_id", "held_out", F.col("_told.lang").alias("lang_pred"), F.col("_told.score").alias("score"))
