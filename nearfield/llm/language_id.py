"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter trigram is bound from three of them: the first rotated by two places, the
second by one, the third as it is, multiplied element by element. A text is the bundle (sum) of its trigrams, a language the bundle of
its training texts, and a text takes the language whose bundle has the largest cosine with its own.

Texts are lower-cased; every run of other characters than letters counts as one gap, which has a vector too.

Defined results: null texts and texts without a letter get `und` and score 0, as does everything where no language was learned. Rows
with a null language teach nothing. Ties take the smaller language name. Repeated rows teach and score row by row.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, crc_mod, map_rows

DIMENSIONS = 512
UNDETERMINED = "und"
#: Trigram vectors that a worker keeps; a full store is emptied, results do not depend on it.
STORE = 24_576


class Space:
    """Vectors of letters and trigrams; the same everywhere, as they follow from the code points."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self._letters: dict[int, np.ndarray] = {}
        self._is_letter = np.array([chr(c).isalpha() for c in range(0x10000)])
        self.clear()
        Memo.held.append(self)

    def clear(self) -> None:
        self._keys = np.empty(0, np.uint64)
        self._rows = np.empty(0, np.int64)
        self._vectors = np.empty((STORE, self.dimensions), np.float32)
        self._used = 0

    def letter(self, code: int) -> np.ndarray:
        got = self._letters.get(code)
        if got is None:
            if len(self._letters) > 20_000:
                self._letters.clear()
            got = self._letters[code] = np.random.Generator(np.random.PCG64(code + 7)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return got

    def trigram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def codes(self, text: str) -> np.ndarray:
        """Letters' code points, 0 for each gap, one at both ends; empty without letters."""
        found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        high = found >= 0x10000
        letters = self._is_letter[np.where(high, 0, found)]
        if high.any():
            letters = letters.copy()
            letters[high] = [chr(c).isalpha() for c in found[high]]
        if not letters.any():
            return np.empty(0, np.uint64)
        out = np.concatenate(([0], np.where(letters, found, 0), [0])).astype(np.uint64)
        return out[np.concatenate(([True], (out[1:] != 0) | (out[:-1] != 0)))]

    @staticmethod
    def trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one text or several one after the other: two gaps in a row are where one ends and the next begins, and no trigram goes across."""
        whole = (codes[1:-1] != 0) | ((codes[:-2] != 0) & (codes[2:] != 0))
        return np.unique((codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])[whole], return_counts=True)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """keys: distinct trigrams. In double precision sums of counts are exact, so their order doesn't matter."""
        out = np.zeros(self.dimensions)
        for at in range(0, len(keys), 2048):
            rows = self._find(keys[at : at + 2048])
            few = counts[at : at + 2048]
            exact = np.float32 if few.sum() < 1 << 24 else np.float64
            out += few.astype(exact) @ self._vectors[rows].astype(exact, copy=False)
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self._keys, keys)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == keys[known]
        if not known.all():
            new = keys[~known]
            if self._used + len(new) > STORE:
                self.clear()
                new = keys
            for i, key in enumerate(new.tolist()):
                self._vectors[self._used + i] = self.trigram(key)
            before = np.searchsorted(self._keys, new)
            self._rows = np.insert(self._rows, before, np.arange(self._used, self._used + len(new)))
            self._keys = np.insert(self._keys, before, new)
            self._used += len(new)
            place = np.searchsorted(self._keys, keys)
        return self._rows[place]


@cache
def space(dimensions: int) -> Space:
    return Space(dimensions)


def learn(rows: DataFrame, *, dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Prototype of each language from columns text and lang. Each task sums its own rows; only one vector for each language and task
    is shuffled. What reaches the driver is one vector a language."""

    def make():
        own = space(dimensions)

        def run(batch):
            codes: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                if len(found := own.codes(text)):
                    codes.setdefault(lang, []).append(found)
            langs = sorted(codes)
            return {"lang": langs, "v": [own.bundle(*own.trigrams(np.concatenate(codes[x]))).tolist() for x in langs]}

        return run

    parts = map_rows(rows.where("text is not null and lang is not null").select("text", "lang"), make, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: [p["x"] for p in r["v"]] for r in whole.collect()}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """All columns of docs and two more, which replace columns of the same names."""
    langs = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in langs]) if langs else np.zeros((0, DIMENSIONS))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = matrix / np.where(norms > 0, norms, 1)
    dimensions = matrix.shape[1]
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    if text_col not in kept:
        raise ValueError(f"{text_col} can't be replaced")

    def make():
        own = space(dimensions)

        def run(batch):
            names, scores = [], []
            for text in batch[text_col]:
                codes = own.codes(text) if text and langs else ()
                if not len(codes):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                v = own.bundle(*own.trigrams(codes))
                cosines = unit @ v / max(np.linalg.norm(v), 1e-12)
                best = int(np.argmax(cosines))
                names.append(langs[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            return {c: batch[c] for c in kept} | {lang_col: names, score_col: scores}

        return run

    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add(lang_col, "string").add(score_col, "double")
    return map_rows(docs.select(*(F.col(f"`{c}`") for c in kept)), make, schema)


def held_out_split(docs: DataFrame) -> F.Column:
    """The fixed fold of this operator: rows whose crc32 of the id modulo 3 is 1 teach nothing."""
    return crc_mod("doc_id", 3) == 1
