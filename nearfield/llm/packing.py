"""Best-fit packing of documents into sequences of a fixed number of tokens.

Texts become token ids and end with one separator; those longer than a sequence, and only those, are cut into whole sequences and a
rest. Pieces are dealt evenly, whatever their ids, to groups of bounded size. A group starts from best fit in order of falling length
and then searches locally among all its underfull bins, the emptiest first: a bin moves a piece to another one, or exchanges one for one, two for one
or one for two. A step is taken if the bin that gains gets fuller than the other one was, which is when the sum of squared fills rises. The search ends
at the lower bound of bins or when no bin has a step left. What can still be saved over several groups (all underfull bins of a group above its
bound, else its emptiest bin) is packed once more together.

Defined results: a null text counts as empty and is the separator alone. Repeated rows are packed as often as they come. Null ids stay
null. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows, stash

CAPACITY = 2048
SEPARATOR = 0
#: Pieces in a group at most (about).
GROUP = 40_000
#: Entries of a worker's memo of ids (about 30 MB).
PARTS_MEMO = 200_000
#: Texts and words of visible ASCII and Latin letters without marks: normalising them is lower-casing, letter by letter, and joining white space.
PLAIN = re.compile(r"[ \t\n\r!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: The tokenizer's own cuts, for lower-cased plain texts.
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^ \t\n\ra-z0-9\u00df-\u00f6\u00f8-\u017f]+")
SPACE = re.compile(r"[ \t\n\r]+")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _byte_letters() -> dict[int, str]:
    """For str.translate: the visible letter that stands for each byte (read as Latin-1) in a byte-level vocabulary."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(seen))}


class _Parts(Memo):
    """Ids of what lies between two cuts: merges alone."""

    def __init__(self, path: str):
        super().__init__(PARTS_MEMO)
        self.merge, self.letters = _tokenizer(path).model.tokenize, _byte_letters()

    def of(self, part: str) -> bytes:
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(text)]).tobytes()


@cache
def _parts(path: str) -> _Parts:
    return _Parts(path)


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, with the separator at the end. Words that aren't plain, and what may be a special
    token, go to the library whole: white space cuts everywhere, and other cuts depend on how marks compose."""
    ids, encode = _parts(path).__getitem__, _tokenizer(path).encode
    plain, cuts = PLAIN.fullmatch, CUTS.findall

    def of(text: str) -> bytes:
        if plain(text) and "<|" not in text:
            return b"".join(map(ids, cuts(text.lower())))
        if SPACE.search(text):
            return b"".join(map(of, SPACE.split(text)))
        return array("I", encode(text, add_special_tokens=False).ids).tobytes()

    end = SEPARATOR.to_bytes(4, "little")
    return [of(t or "") + end for t in texts]


def cut(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: the id, piece, start, length, ids_crc32, and on request the ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        import numpy as np

        def run(rows):
            out: dict[str, list] = {c: [] for c in ("id", "piece", "start", "length", "ids_crc32") + ("ids",) * with_ids}
            for at in range(0, len(rows["id"]), 256):
                for i, found in zip(rows["id"][at : at + 256], token_bytes(rows["text"][at : at + 256], tokenizer_path), strict=True):
                    for piece, start in enumerate(range(0, len(found) // 4, capacity)):
                        own = found[4 * start : 4 * (start + capacity)]
                        out["id"].append(i)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(len(own) // 4)
                        out["ids_crc32"].append(zlib.crc32(own))
                        if with_ids:
                            out["ids"].append(np.frombuffer(own, "<u4").astype(np.int32))
            return out

        return run

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_rows(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), make, schema)


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """A bin number for each length; lengths from 1 to capacity. Where best fit misses the lower bound, the search also starts from bins that were
    filled in order of rising length, if these aren't over a fifth more: of two such ends the better one counts."""
    bins = _best_fit(lengths, capacity)
    least = -(-sum(lengths) // capacity)
    if len(bins) > least:
        other = _next_fit(lengths, capacity)
        bins = min((_search(b, lengths, capacity) for b in (bins, *[other] * (len(other) <= 1.2 * len(bins)))), key=len)
    out = [0] * len(lengths)
    for b, found in enumerate(bins):
        for i in found:
            out[i] = b
    return out


def _next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    room = 0
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if lengths[i] > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= lengths[i]
    return bins


def _best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with room r may be open
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
            fill[b] += size
        else:
            b = len(bins)
            bins.append([i])
            fill.append(size)
        room = capacity - fill[b]
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


class _Bins:
    """Bins with their pieces by size, and the open ones by what they can take: an open bin that gives back `y` (0: nothing) takes up to y + room."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity = capacity
        self.pieces: list[dict[int, list[int]]] = []
        self.fill = []
        for own in bins:
            by_size: dict[int, list[int]] = {}
            for i in own:
                by_size.setdefault(lengths[i], []).append(i)
            self.pieces.append(by_size)
            self.fill.append(sum(lengths[i] for i in own))
        #: for one piece or none, and for two: most that is taken -> given back -> bins; and the same keys as bits
        self.takes: tuple[dict[int, dict[int, set[int]]], ...] = ({}, {})
        self.bits = [0, 0]
        for b in range(len(bins)):
            self.enter(b)

    def singles(self, b: int) -> list[int]:
        return [*self.pieces[b]]

    def doubles(self, b: int) -> dict[int, tuple[int, int]]:
        """Sums of two pieces, each with one pair of sizes."""
        own = sorted(self.pieces[b])
        return {x + y: (x, y) for i, x in enumerate(own) for y in own[i:] if x != y or len(self.pieces[b][x]) > 1}

    def _keys(self, b: int) -> Iterator[tuple[int, int]]:
        room = self.capacity - self.fill[b]
        if room and self.pieces[b]:
            yield 0, 0
            for y in self.pieces[b]:
                yield 0, y
            for y in self.doubles(b):
                yield 1, y

    def enter(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        for kind, y in self._keys(b):
            self.takes[kind].setdefault(y + room, {}).setdefault(y, set()).add(b)
            self.bits[kind] |= 1 << y + room

    def leave(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        for kind, y in self._keys(b):
            at = self.takes[kind][y + room]
            at[y].discard(b)
            if not at[y]:
                del at[y]
                if not at:
                    del self.takes[kind][y + room]
                    self.bits[kind] &= ~(1 << y + room)

    def shift(self, a: int, b: int, sizes: tuple[int, ...]) -> None:
        """Pieces of these sizes go from a to b."""
        for size in sizes:
            own = self.pieces[a][size]
            self.pieces[b].setdefault(size, []).append(own.pop())
            if not own:
                del self.pieces[a][size]
            self.fill[a] -= size
            self.fill[b] += size

    def step(self, a: int) -> bool:
        """The step of bin a, which has left, that raises the squared fill most; False if there is none."""
        best, own = (0, 0, (), 0, 0), self.fill[a]
        two = self.doubles(a)
        for s, sizes, kinds in [*((s, (s,), (0, 1)) for s in self.singles(a)), *((s, p, (0,)) for s, p in two.items())]:
            for kind in kinds:
                rest = self.bits[kind] >> s
                while rest:
                    slack = (rest & -rest).bit_length() - 1
                    rest &= rest - 1
                    after = self.capacity - slack
                    if after <= own:
                        break
                    y = min(self.takes[kind][s + slack])
                    gain = (s - y) * (after - own)
                    if gain > best[0]:
                        best = gain, s + slack, sizes, kind, y
        gain, at, sizes, kind, y = best
        if not gain:
            return False
        b = min(self.takes[kind][at][y])
        back = () if not y else (y,) if not kind else self.doubles(b)[y]
        self.leave(b)
        self.shift(a, b, sizes)
        self.shift(b, a, back)
        self.enter(b)
        return True


def _search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The bins that are left when none has a step or their number is at the lower bound."""
    least, left = -(-sum(lengths) // capacity), len(bins)
    own, changed = _Bins(bins, lengths, capacity), True
    while changed and left > least:
        changed = False
        for a in sorted((b for b, f in enumerate(own.fill) if 0 < f < capacity), key=lambda b: (own.fill[b], b)):
            if not 0 < own.fill[a] < capacity:
                continue
            own.leave(a)
            while own.pieces[a] and own.step(a):
                changed = True
            own.enter(a)
            if not own.pieces[a]:
                left -= 1
                if left <= least:
                    break
    return [[i for found in by_size.values() for i in found] for by_size in own.pieces if by_size]


def assign(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table with a column `length`. Whole sequences need no search; the rest goes through two rounds. A group holds
    numbers and lengths of its pieces only; other columns come back by a join."""
    schema = "tag long, length long, bin long, offset long, open boolean"
    numbered = pieces.withColumn("tag", F.monotonically_increasing_id())
    pieces = stash(numbered, "pieces")

    def pack(key, table):
        import numpy as np
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        bins = np.array(pack_lengths(lengths.tolist(), capacity), np.int64)
        order = np.argsort(bins, kind="stable")
        bins, lengths = bins[order], lengths[order]
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        ends = np.cumsum(lengths)
        before = np.concatenate(([0], np.cumsum(fill)))[bins]
        if len(fill) > -(-int(lengths.sum()) // capacity):
            again = fill < capacity
        else:
            again = np.arange(len(fill)) == fill.argmin()
        return pa.table({"tag": table.column("tag").take(pa.array(order)), "length": lengths, "bin": bins + (key[0].as_py() << 32), "offset": ends - lengths - before, "open": again[bins]})

    def round_of(df: DataFrame) -> DataFrame:
        """df has a tag that numbers its rows, so its hash deals rows evenly, even equal ones."""
        groups = max(1, -(-df.count() // group))
        return df.withColumn("grp", F.pmod(F.hash("tag"), F.lit(groups)).cast("long")).groupBy("grp").applyInArrow(pack, schema)

    full = pieces.where(F.col("length") >= capacity)
    first = stash(round_of(pieces.where(F.col("length") < capacity).select("tag", F.col("length").cast("long").alias("length"))), "packed")
    second = round_of(first.where("open").select("tag", "length"))
    ids = lambda kind: (F.col("bin") + F.lit(kind << 60)).alias("sequence_id")
    places = first.where("not open").select("tag", ids(0), "offset").unionByName(second.select("tag", ids(1), "offset"))
    keep = [F.col(f"`{c}`") for c in pieces.columns if c != "tag"]
    whole = full.select(*keep, (F.col("tag") + F.lit(2 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(pieces.where(F.col("length") < capacity).hint("merge").join(places.hint("merge"), "tag").select(*keep, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each piece of each document with its place: the id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    return assign(cut(docs, tokenizer_path, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids), capacity=capacity).withColumnRenamed("id", id_col)
