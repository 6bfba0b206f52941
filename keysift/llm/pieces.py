"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

The distinct words of a batch are written one after the other and their suffixes sorted as far as
the longest piece reaches.  Binary search finds, for all pieces at once, the range of
suffixes that begin with each; every place in a range is an edge from the piece's first
character to the one after its last.  Sorted by the place they end at, the edges are relaxed in
one sweep: a place is reached by the one edge that agrees with the piece before it.

Two neighbouring pieces agree if merging their joined text gives these two again.  A sequence is
what the merges make of a text exactly if all its neighbours agree, so the sweep gives the
result of the merges (the ids that the model's own library gives) with no merge being done.
Agreement is looked up along the inner edges of both pieces: as merges go on from frequent to
rare, the last part of the left piece and the first of the right one grow step by step, and they
agree unless at some step the two parts would merge before either grows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import read_table, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
_BATCH_BYTES = 2 << 20
# Characters of new words that are matched at a time.
_INDEXED = 1 << 18
# Words whose ids a task keeps; it begins anew beyond that.
_WORDS_KEPT = 300_000
_NEVER = np.int64(1) << 40


def _merged(text: str, ranks: dict[str, float]) -> tuple[list[str], list[tuple[str, str, str]]]:
    """What the merges make of a text, and the merges done, in order (for single pieces only)."""
    parts, done = list(text), []
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return parts, done
        _, i = min(pairs)
        done.append((parts[i], parts[i + 1], parts[i] + parts[i + 1]))
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@dataclass
class Pieces:
    """Tables of a model, made once on the driver; bounded by its vocabulary."""

    proto: bytes
    names: list[str]
    rank: np.ndarray  # by piece number: the order of its merge; single characters first
    ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    spines: tuple
    split_words: bool
    alone: str
    byte_ids: np.ndarray | None
    unknown: int
    texts: list[bytes]

    @classmethod
    def load(cls, path: str) -> Pieces:
        proto = Path(path).read_bytes()
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (
            model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in plain]
        scores = {x: -model.get_score(i) for x, i in zip(names, plain)}
        letters = {c for x in names for c in x}
        if not letters <= scores.keys():
            raise ValueError("the model has pieces with characters that are no pieces")
        number = {x: i for i, x in enumerate(names)}
        order = {s: i for i, s in enumerate(sorted(set(scores.values())), 1)}
        rank = np.array([0 if len(x) == 1 else order[scores[x]] for x in names], np.int64)
        pairs, last, first = {}, [], []
        for x in names:
            for i in range(1, len(x)):
                if x[:i] in number and x[i:] in number:
                    pairs[number[x[:i]] * len(names) + number[x[i:]]] = rank[number[x]]
            parts, done = _merged(x, scores)
            made = {c: (a, b) for a, b, c in done}
            if len(x) > 1 and parts != [x]:
                last.append(None)  # a piece that the merges never make
                first.append(None)
                continue
            right, left = [x], [x]
            while len(right[-1]) > 1:
                right.append(made[right[-1]][1])
            while len(left[-1]) > 1:
                left.append(made[left[-1]][0])
            for spine in (right, left):
                grown = [rank[number[s]] for s in spine]
                if grown != sorted(grown, reverse=True):
                    raise ValueError(f"the parts of {x!r} merge after the whole")
            last.append([number[s] for s in reversed(right)])
            first.append([number[s] for s in reversed(left)])
        keys = np.array(sorted(pairs), np.int64)
        byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        fallback = all(model.is_byte(i) for i in byte)
        texts = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                texts[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif model.is_unknown(i):
                texts[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                texts[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
        inner = any(BLANK in x.lstrip(BLANK) for x in names)
        return cls(
            proto, names, rank, np.array(plain, np.int32), keys,
            np.array([pairs[k] for k in keys.tolist()], np.int64), (_padded(last), _padded(first)),
            not inner, "".join(c for c in "\n\t\r" if c not in letters),
            np.array(byte, np.int32) if fallback else None, model.unk_id(), texts)


def _padded(spines: list[list[int] | None]) -> np.ndarray:
    """Rows of piece numbers from the single character up to the piece, which fills the rest.

    A piece that is never made has -1 in front.
    """
    width = max(len(s) for s in spines if s)
    return np.array([s + [s[-1]] * (width + 1 - len(s)) if s else [-1] * (width + 1)
                     for s in spines], np.int64)


class Encoder:
    """Encodes batches of texts; one per task."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = p = pieces
        self.model = sentencepiece.SentencePieceProcessor(model_proto=p.proto)
        self.length = np.array([len(x) for x in p.names], np.int64)
        letters = sorted({c for x in p.names for c in x})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bits = len(letters).bit_length()
        self.per = 63 // self.bits
        self.columns = -(-int(self.length.max()) // self.per)
        self.low, self.high = self._piece_keys()
        self.count = len(p.names)  # also the number of "no piece": a lone character or a word's start
        self._forget()
        self.pattern = re.compile(
            f"{BLANK}*[^{BLANK}{re.escape(p.alone)}]+|{BLANK}+" + (
                f"|[{re.escape(p.alone)}]" if p.alone else "") if p.split_words else "(?s).+")

    def _forget(self) -> None:
        """Words seen before, their ids one after the other, and how many each has."""
        self.number: dict[str, int] = {}
        self.ids, self.counts = np.empty(0, np.int32), np.empty(0, np.int64)

    def _piece_keys(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The least and the greatest key of a suffix that begins with each piece."""
        width = self.columns * self.per
        low = np.zeros((self.length.size, width), np.int64)
        for i, x in enumerate(self.p.names):
            low[i, :len(x)] = self.letter[[ord(c) for c in x]]
        high = np.where(np.arange(width) < self.length[:, None], low, (1 << self.bits) - 1)
        return self._packed(low), self._packed(high)

    def _packed(self, letters: np.ndarray) -> list[np.ndarray]:
        found = []
        for c in range(self.columns):
            key = np.zeros(len(letters), np.int64)
            for t in range(self.per):
                key = key << self.bits | letters[:, c * self.per + t]
            found.append(key)
        return found

    def _suffix_array(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places in order of the suffixes that begin there, and the keys in that order."""
        padded = np.concatenate((text, np.zeros(self.columns * self.per, np.int64)))
        keys = []
        for c in range(self.columns):
            key = np.zeros(text.size, np.int64)
            for t in range(self.per):
                at = c * self.per + t
                key = key << self.bits | padded[at:at + text.size]
            keys.append(key)
        reach, order = self.per, np.argsort(keys[0])
        rank = self._ranks(keys[0][order], order)
        while reach < self.columns * self.per:  # prefix doubling
            beyond = np.concatenate((rank[reach:], np.zeros(min(reach, rank.size), np.int64)))
            key = rank * (rank.size + 1) + beyond[:rank.size]
            order = np.argsort(key)
            rank, reach = self._ranks(key[order], order), 2 * reach
        return order, [k[order] for k in keys]

    @staticmethod
    def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The rank of each place, from 1; equal keys share one."""
        rank = np.empty(order.size, np.int64)
        rank[order] = np.cumsum(np.diff(sorted_keys, prepend=-1) != 0)
        return rank

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """First place in the sorted keys not below (``after``: above) each wanted key."""
        low = np.zeros(wanted[0].size, np.int64)
        high = np.full(wanted[0].size, keys[0].size, np.int64)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) >> 1, 0)
            below, equal = np.zeros(low.size, bool), np.ones(low.size, bool)
            for key, want in zip(keys, wanted):
                held = key[mid]
                below |= equal & (held < want)
                equal &= held == want
            below |= equal if after else False
            low = np.where(open_ & below, mid + 1, low)
            high = np.where(open_ & ~below, mid, high)
        return low

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of each occurrence of a piece in the text."""
        order, keys = self._suffix_array(text)
        begin = self._search(keys, self.low, False)
        counts = self._search(keys, self.high, True) - begin
        piece = np.repeat(np.arange(self.count), counts)
        at = np.arange(piece.size) - np.repeat(np.cumsum(counts) - counts, counts)
        return order[np.repeat(begin, counts) + at], piece

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may stand side by side; "no piece" agrees with every piece."""
        found = (left < self.count) & (right < self.count)
        key, where = np.unique(left[found] * self.count + right[found], return_inverse=True)
        a, b = key // self.count, key % self.count
        last, first = self.p.spines
        rank, good = self.p.rank, (last[a, 0] >= 0) & (last[b, 0] >= 0)
        i, j, live = np.zeros(key.size, np.int64), np.zeros(key.size, np.int64), good.copy()
        while live.any():
            w = np.flatnonzero(live)
            x, y = last[a[w], i[w]], first[b[w], j[w]]
            grow_x = np.where(x == a[w], _NEVER, rank[last[a[w], i[w] + 1]])
            grow_y = np.where(y == b[w], _NEVER, rank[first[b[w], j[w] + 1]])
            pair = x * self.count + y
            at = np.minimum(np.searchsorted(self.p.pair_keys, pair), self.p.pair_keys.size - 1)
            joined = np.where(self.p.pair_keys[at] == pair, self.p.pair_ranks[at], _NEVER)
            # Of equal ranks the merge further left goes first.
            crossed = (joined < grow_x) & (joined <= grow_y) & (joined < _NEVER)
            good[w[crossed]] = False
            done = crossed | ((grow_x == _NEVER) & (grow_y == _NEVER))
            live[w[done]] = False
            step_x = grow_x <= grow_y
            i[w[~done & step_x]] += 1
            j[w[~done & ~step_x]] += 1
        result = np.ones(left.size, bool)
        result[found] = good[where]
        return result

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        points = np.frombuffer("\0".join(words).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
        text = self.letter[points].astype(np.int64)
        text[starts + sizes] = 0
        place, piece = self._edges(text)
        # Characters in no piece are edges of their own.
        inside = np.ones(text.size, bool)
        inside[starts + sizes] = False
        lone = np.flatnonzero((text == 0) & inside)
        place = np.concatenate((place, lone))
        piece = np.concatenate((piece, np.full(lone.size, self.count)))
        length = np.append(self.length, 1)
        end = place + length[piece]
        word = np.repeat(np.arange(sizes.size), sizes + 1)
        depth = end - starts[word[place]]
        order = np.argsort(depth, kind="stable")
        place, piece, end = place[order], piece[order], end[order]
        bounds = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1))
        before = np.full(text.size + 1, -1, np.int64)  # the piece that ends at each place
        before[starts] = self.count
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            u, t, v = place[lo:hi], piece[lo:hi], end[lo:hi]
            reached = before[u]
            ok = reached >= 0
            u, t, v, reached = u[ok], t[ok], v[ok], reached[ok]
            ok = self._agree(reached, t)
            before[v[ok]] = t[ok]
        node, active, steps = starts + sizes, np.flatnonzero(sizes > 0), []
        while active.size:
            t = before[node[active]]
            if (t < 0).any():
                raise AssertionError("a word without a path")
            node[active] -= length[t]
            steps.append((active, t, node[active]))
            active = active[node[active] > starts[active]]
        counts = np.zeros(sizes.size, np.int64)
        for active, _, _ in steps:
            counts[active] += 1
        ends = np.cumsum(counts)
        ids = np.empty(int(counts.sum()), np.int32)
        lone_at = []
        table = np.append(self.p.ids, -1)
        for k, (active, t, at) in enumerate(steps):
            ids[ends[active] - 1 - k] = table[t]
            if (bare := t == self.count).any():
                lone_at += zip((ends[active] - 1 - k)[bare].tolist(), points[at[bare]].tolist())
        if lone_at:
            ids, counts = self._with_lone(ids, counts, lone_at)
        return ids, counts

    def _with_lone(self, ids: np.ndarray, counts: np.ndarray, lone: list) -> tuple:
        """Lone characters as their bytes, or as the unknown piece."""
        if self.p.byte_ids is None:
            ids[[i for i, _ in lone]] = self.p.unknown
            return ids, counts
        as_bytes = {i: chr(c).encode("utf-8", "surrogatepass") for i, c in lone}
        times = np.ones(ids.size, np.int64)
        times[list(as_bytes)] = [len(x) for x in as_bytes.values()]
        word = np.repeat(np.arange(counts.size), counts)
        grown = np.repeat(ids, times)
        begins = np.cumsum(times) - times
        for i, data in as_bytes.items():
            grown[begins[i]:begins[i] + len(data)] = self.p.byte_ids[list(data)]
        return grown, np.bincount(word, times, counts.size).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        found, start, held = [(self.ids, self.counts)], 0, 0
        for i, word in enumerate(words, 1):
            held += len(word)
            if held >= _INDEXED or i == len(words):
                found.append(self.words(words[start:i]))
                start, held = i, 0
        self.ids, self.counts = (np.concatenate(x) for x in zip(*found))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        found = [self.pattern.findall(self.model.normalize(t)) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        if len(self.number) > _WORDS_KEPT:
            self._forget()
        number, known = self.number, len(self.number)
        codes = np.array([number.setdefault(w, len(number)) for f in found for w in f], np.int64)
        if len(number) > known:
            self._learn(list(itertools.islice(number, known, None)))
        ids, counts = self.ids, self.counts
        begins, each = (np.cumsum(counts) - counts)[codes], counts[codes]
        at = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        total = np.concatenate(([0], np.cumsum(each)))
        ends = np.cumsum(sizes)
        return ids[np.repeat(begins, each) + at], total[ends] - total[ends - sizes]


class Decoder:
    """Joins pieces to texts again."""

    def __init__(self, pieces: Pieces) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=pieces.proto)
        self.first = model.normalize("a")[:1] == BLANK  # a blank was put before the text
        self.pieces = pieces.texts

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id outside the vocabulary")
        found, at = [], 0
        for n in counts.tolist():
            text = b"".join([self.pieces[i] for i in ids[at:at + n].tolist()]).decode("utf-8", "replace")
            found.append(text[1:] if self.first and text[:1] == " " else text)
            at += n
        return found


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str = MODEL, decoded: bool = False) -> DataFrame:
    """(row, ids array<int>) for each row of ``docs`` (row, text); with ``decoded`` also the text
    that the ids decode to.

    Null and empty texts have no ids.  Texts are taken whole; repeated rows stay repeated.
    """
    pieces = Pieces.load(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for batch in batches:
            for part in slices(batch, limit=_BATCH_BYTES):
                ids, counts = encoder.texts(part.column("text").to_pylist())
                columns, names = [part.column("row"), _lists(ids, counts)], ["row", "ids"]
                if decoded:
                    columns.append(pa.array(decoder.texts(ids, counts), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(
        task, f"row {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(row, text) for each row of ``encoded`` (row, ids); null ids are taken for none.

    Bytes that are no UTF-8 become U+FFFD.  An id that the model does not have is an error.
    """
    pieces = Pieces.load(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column("ids")
                counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
                texts = decoder.texts(column.flatten().to_numpy(), counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kind = encoded.schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(task, f"row {kind}, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the comma-joined ids), text_sha256 (of the decoded text) and
    same (whether it is the text that was encoded; a null text decodes to an empty one)."""
    docs = read_table(spark, sf_dir, "documents").select(F.struct(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was")).alias("row"), "text")
    return encode(docs, decoded=True).select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("text_sha256"),
        (F.sha2("decoded", 256) == F.col("row.was")).alias("same"))


def tokenize(docs: DataFrame) -> DataFrame:
    """The documents with ``ids``, ``n_tokens`` and ``decoded``, the text made of the ids again."""
    new = ("ids", "n_tokens", "decoded")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    found = encode(docs.select(F.struct(*columns).alias("row"), "text"), decoded=True)
    return found.select("row.*", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")
