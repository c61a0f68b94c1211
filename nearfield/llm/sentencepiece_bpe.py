"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

The encoder never runs the merge queue over a text. In a stretch of known characters it takes, from the left, the longest
piece that starts at each place (all piece occurrences come from one Aho-Corasick pass). A piece may follow another only if
merging the text of both anew gives just these two pieces; a piece that fails is replaced by its next shorter prefix, and when
none is left the encoder steps back. A bitfield holds the ends from which no encoding goes on, so that no place is tried twice.

Pieces never hold the space mark after another character (checked when the model is read), so words are encoded one by one and kept in
a bounded memo for each worker.

Defined results: null and empty texts have no ids and decode to the empty text. Any other text gets the model's dummy prefix.
Characters outside the model become byte pieces. Repeated rows and ties are encoded row by row; extra columns are ignored, except
that `encode` keeps the id column named by its argument.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words that a worker's memo holds at most; a full memo is emptied, results do not depend on it.
MEMO_WORDS = 500_000


def _fields(data: bytes):
    """Fields of one protocol-buffer message: (number, value); value is an int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A merge-type model file read without its own library."""

    def __init__(self, path: str):
        import struct

        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer, rules = {}, {}
        for number, value in _fields(data):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kinds.append(part.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != 2 or rules.get(2, b"") or not rules.get(3, 1) or rules.get(4, 1) or not trainer.get(35, 0) or USER in self.kinds:
            raise ValueError("only merge-type models with byte fallback, identity rules, a dummy prefix and kept white space are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, UNUSED)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the space mark after another character: words can't be encoded one by one")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.known = set("".join(self.ids))
        self._last_special = max(i for i, k in enumerate(self.kinds) if k not in (NORMAL, UNUSED))
        # A word ends before a space mark, around a line end, and between a letter or digit and a character that never follows one within a piece.
        after = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if re.match(r"[^\W_]", a)}
        apart = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not re.match(r"[^\W_]", c) and c not in after)
        lone = "" if "\n" in self.known else "\n"
        self.words = re.compile(rf"{MARK}*[^\W_]++(?=[{apart}])|{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|{lone}" if lone else ""))
        self.plain = [p.replace(MARK, " ") for p in self.pieces]
        self.finder = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.finder.add_word(piece, (len(piece), i))
        self.finder.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._valid: dict[int, bool] = {}

    def _merge(self, text: str) -> list[str]:
        """The merge rule itself, for a piece or two: best score first, then the leftmost."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best[0]):
                    best = self.scores[found], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _reachable(self, i: int) -> bool:
        got = self._valid.get(i)
        if got is None:
            got = self._valid[i] = len(self._merge(self.pieces[i])) == 1
        return got

    def _compatible(self, a: int, b: int) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= 1_000_000:
                self._pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            got = self._pairs[a, b] = self._merge(left + right) == [left, right]
        return got

    def _stretch(self, text: str) -> list[int]:
        """Encodes known characters only."""
        n = len(text)
        whole = self.ids.get(text)
        if whole is not None and self._reachable(whole):
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.finder.iter(text):
            starts[end + 1 - found[0]].append(found)  # shorter ones come first
        failed = bytearray(n // 8 + 1)
        ids: list[int] = []
        path: list[tuple[int, int]] = []  # of each piece so far: its place, its index in starts there
        at, index, pairs, valid = 0, len(starts[0]) - 1, self._pairs, self._valid
        while at < n:
            here, before, found = starts[at], ids[-1] if ids else -1, False
            while index >= 0:
                size, i = here[index]
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = valid.get(i)
                    if (self._reachable(i) if ok is None else ok) and (before < 0 or (self._compatible(before, i) if (ok := pairs.get((before, i))) is None else ok)):
                        found = True
                        break
                index -= 1
            if found:
                path.append((at, index))
                ids.append(i)
                at = end
                index = len(starts[at]) - 1 if at < n else -1
            elif path:
                failed[at >> 3] |= 1 << (at & 7)
                at, index = path.pop()
                ids.pop()
                index -= 1
            else:
                raise AssertionError(f"no encoding of {text!r}")
        return ids

    def decode_word(self, ids: list[int]) -> str:
        """As decode, for a word within a text."""
        return "".join(map(self.plain.__getitem__, ids)) if min(ids) > self._last_special else self.decode([self.ids[MARK], *ids])

    def encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        if self.known.issuperset(word):
            return self._stretch(word)
        start = 0
        for k, ch in enumerate(word):
            if ch not in self.known:
                if start < k:
                    ids += self._stretch(word[start:k])
                ids += [self.byte_ids[b] for b in ch.encode("utf-8")]
                start = k + 1
        if start < len(word):
            ids += self._stretch(word[start:])
        return ids

    def marked(self, text: str) -> list[str]:
        """The words of a text, with space marks and the dummy prefix."""
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.marked(text or "") for i in self.encode_word(word)]

    def decode(self, ids: list[int]) -> str:
        """Byte pieces join to characters, faulty bytes become U+FFFD one by one; control pieces vanish; the dummy prefix goes."""
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode("utf-8"))
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        first = True
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if run:
                flush()
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i].replace(MARK, " ")
            out.append(piece[1:] if first and kind != UNKNOWN and piece.startswith(" ") else piece)
            first = False
        flush()
        return "".join(out)


@cache
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class _Memo(dict):
    def __init__(self, model: PieceModel, of):
        super().__init__()
        self.model, self.of = model, of

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = self.of(word)
        return got


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and `ids array<int>`."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        model = load_model(model_path)
        memo = _Memo(model, model.encode_word)
        return lambda rows: {"id": rows["id"], "ids": [[i for w in model.marked(t or "") for i in memo[w]] for t in rows["text"]]}

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and `text`; a null list decodes to the empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def make():
        model = load_model(model_path)
        return lambda rows: {"id": rows["id"], "text": [model.decode(x or []) for x in rows["ids"]]}

    return map_rows(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass; per row: id, n_tokens, ids_sha256, decoded_sha256.

    Digests are fed word by word from a memo of (ids as text, decoded text); words don't share byte runs, since bytes of a character
    never leave its word.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        model = load_model(model_path)

        def both(word: str) -> tuple[str, str]:
            ids = model.encode_word(word)
            return ",".join(map(str, ids)), model.decode_word(ids)

        memo = _Memo(model, both)

        def run(rows):
            out = {"id": rows["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in rows["text"]:
                found = [*map(memo.__getitem__, model.marked(text or ""))]
                listed = ",".join([x for x, _ in found])
                back = "".join([x for _, x in found]).removeprefix(" ")
                out["n_tokens"].append(listed.count(",") + 1 if listed else 0)
                out["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            return out

        return run

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
