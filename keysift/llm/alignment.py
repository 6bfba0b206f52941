"""Alignment of the tokens of two tokenizers by pointer jumping.

Tokens of both tokenizers are byte ranges of the same text.  Every token points to the token that
reaches farthest to the right of all that overlap it (of two with one end, to the second
tokenizer's); replacing each pointer by its target's pointer doubles the distance jumped, until all
tokens of a connected component point to its last one.  That token labels the group.  All tokens of
many texts are jumped together as arrays.

Two tokens that end together cover the same bytes before that end, so the shorter one is a suffix
of the longer one.  The pairs that can ever be linked are thus fixed by the two vocabularies (some
hundred thousand), and the corpus-wide counts of links are one array of that size.

Long texts are taken in parts cut before a blank between two letters, where both tokenizers begin
anew, so memory follows the part (or the longest stretch without such a blank).  A text that is
null or empty, or that either tokenizer does not give back byte for byte, has no tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import long_array, materialize, read_table, slices

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
# Characters of a part, and bytes of parts that are encoded together.
PART = 1 << 12
BLOCK = 1 << 20
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
# Fixed value: how byte-level BPE cuts text into words.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose class (letter, number, blank) is the same to every version of every regex library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u00ff]*")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves,
    the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabularies:
    """Both tokenizers as they travel to the tasks, and the pairs of ids that can be linked."""

    json: str
    proto: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    pairs: np.ndarray  # sorted a * len(b_bytes) + b
    ranked: bool  # whether A merges in the order of its ids, cut into words in the usual way

    @classmethod
    def load(cls, path_a: str = MODEL_A, path_b: str = MODEL_B) -> Vocabularies:
        text = Path(path_a).read_text(encoding="utf-8")
        letters = _byte_letters()
        given = json.loads(text)
        words = given["model"]["vocab"]
        merged = [words["".join(x.split(" ") if isinstance(x, str) else x)]
                  for x in given["model"]["merges"]]
        cutter = given["pre_tokenizer"] or {}
        ranked = (merged == sorted(merged) and given["normalizer"] is None
                  and all(words.get(c, merged[0]) < merged[0] for c in letters)
                  and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True
                  and cutter.get("add_prefix_space") is False)
        a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            # An entry with other letters is a special token, which is never made from text.
            if all(c in letters for c in word):
                a_bytes[i] = bytes(letters[c] for c in word)
        proto = Path(path_b).read_bytes()
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        b_bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else
                           piece.replace(BLANK, " ").encode())
        return cls(text, proto, a_bytes, b_bytes, _suffix_pairs(a_bytes, b_bytes), ranked)


def _suffix_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """All pairs of ids of which one's bytes end with the other's."""
    found = set()
    numbered_a: dict[bytes, list[int]] = {}
    numbered_b: dict[bytes, list[int]] = {}
    for i, x in enumerate(a_bytes):
        numbered_a.setdefault(x, []).append(i)
    for i, x in enumerate(b_bytes):
        numbered_b.setdefault(x, []).append(i)
    for b, x in enumerate(b_bytes):
        for start in range(len(x)):
            found.update(a * len(b_bytes) + b for a in numbered_a.get(x[start:], ()))
    for a, x in enumerate(a_bytes):
        for start in range(len(x)):
            found.update(a * len(b_bytes) + b for b in numbered_b.get(x[start:], ()))
    return np.array(sorted(found), np.int64)


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A blank and the text, in parts that begin with a blank."""
    whole, start = " " + text, 0
    while True:
        cut = _CUT.search(whole, start + size)
        if cut is None:
            yield whole[start:]
            return
        yield whole[start:cut.start()]
        start = cut.start()


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group, counted from 0, of each token of two sequences that end at the same byte.

    Ends are ascending and distinct.  Tokens are numbered A first; a token that no overlapping one
    outreaches points to itself.
    """
    n = len(a_ends)
    over_a = n + np.searchsorted(b_ends, a_ends)
    reach = np.searchsorted(a_ends, b_ends)
    last = a_ends[reach] == b_ends
    target = np.concatenate([over_a, np.where(last, n + np.arange(len(b_ends)), reach)])
    while True:
        beyond = target[target]
        if np.array_equal(beyond, target):
            break
        target = beyond
    label = np.cumsum(last) - 1
    found = label[target - n]
    return found[:n], found[n:]


class _Aligner:
    """The work of one task."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(vocabularies.json)
        self.a.encode_special_tokens = True
        # The same merges by a quicker library, for plain texts; the rest goes to the one above.
        self.quick = tiktoken.Encoding(
            "a", pat_str=_WORDS, special_tokens={}, mergeable_ranks={
                x: i for i, x in enumerate(vocabularies.a_bytes) if x}
        ) if vocabularies.ranked else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.proto)
        self.a_bytes, self.b_bytes = vocabularies.a_bytes, vocabularies.b_bytes
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.pairs = vocabularies.pairs
        most = max(len(self.a_bytes), len(self.b_bytes))
        names = [str(i).encode() for i in range(most)]
        self.digits = np.array([len(x) for x in names])
        self.width = int(self.digits.max()) + 1
        self.names = np.frombuffer(
            b"".join(x.ljust(self.width, b"\0") for x in names), np.uint8).reshape(most, self.width)

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers by part, None where one of them does not give the bytes back."""
        whole: list[list[int]] = [[]] * len(parts)
        slow = []
        for i, text in enumerate(parts):
            if self.quick and len(text) < 2 * PART and _PLAIN.fullmatch(text):
                whole[i] = self.quick.encode_ordinary(text)
            else:
                slow.append(i)
        for i, found in zip(slow, self.a.encode_batch_fast(
                [parts[i] for i in slow], add_special_tokens=False)):
            whole[i] = found.ids
        pieces = self.b.encode([x[1:] for x in parts], num_threads=1)
        rows: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, a, b in zip(parts, whole, pieces):
            data = text.encode()
            same = (b"".join(map(self.a_bytes.__getitem__, a)) == data
                    and b"".join(map(self.b_bytes.__getitem__, b)) == data)
            rows.append((np.array(a, np.int64), np.array(b, np.int64)) if same else None)
        return rows

    def align(self, encoded: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """(number of groups, links as a * size of B + b, text of the groups) by part."""
        if not encoded:
            return []
        n_a, n_b = (np.array([len(x[k]) for x in encoded]) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in encoded]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        group_a, group_b = groups(a_ends, b_ends)
        last_a = np.flatnonzero(np.diff(group_a, append=-1))  # the last token of each group
        last_b = np.flatnonzero(np.diff(group_b, append=-1))
        links = a[last_a] * len(self.b_bytes) + b[last_b]
        # Each group is written as its A ids, then its B ids.
        before_b = np.concatenate([[0], last_b + 1])
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        ids, side = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        side[place_a], side[place_b] = 2 * group_a, 2 * group_b + 1
        step = np.diff(side, append=-1)
        mark = np.where(step == 0, ord(","), np.where(side % 2 == 0, ord("|"), ord(";")))
        size = self.digits[ids]
        cells = self.names[ids]
        cells[np.arange(len(ids)), size] = mark
        written = cells[np.arange(self.width) <= size[:, None]]
        to = np.cumsum(size + 1)[np.cumsum(n_a + n_b) - 1]
        group_to = group_a[np.cumsum(n_a) - 1] + 1
        found, at, group_at = [], 0, 0
        for end, group_end in zip(to.tolist(), group_to.tolist()):
            found.append((group_end - group_at, links[group_at:group_end],
                          written[at:end - 1].tobytes()))
            at, group_at = end, group_end
        return found


class _Document:
    """What the parts of one text add up to."""

    def __init__(self, keep_groups: bool) -> None:
        self.sound, self.n_a, self.n_b, self.n_groups = True, 0, 0, 0
        self.digest = hashlib.sha256()
        self.links, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.fresh: list[np.ndarray] = []
        self.held = 0
        self.written: list[bytes] | None = [] if keep_groups else None

    def add(self, n_a: int, n_b: int, n_groups: int, links: np.ndarray, text: bytes) -> None:
        if self.n_groups:
            self.digest.update(b";")
        self.digest.update(text)
        if self.written is not None:
            self.written.append(text)
        self.n_a, self.n_b, self.n_groups = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups
        self.fresh.append(links)
        self.held += len(links)
        if self.held > BLOCK:
            self.close()

    def close(self) -> None:
        """Links by pair: never more than there are pairs, however long the text."""
        if not self.fresh:
            return
        fresh, times = np.unique(np.concatenate(self.fresh), return_counts=True)
        if len(self.links):
            fresh, where = np.unique(np.concatenate([self.links, fresh]), return_inverse=True)
            before, times = np.concatenate([self.counts, times]), np.zeros(len(fresh), np.int64)
            np.add.at(times, where, before)
        self.links, self.counts, self.fresh, self.held = fresh, times, [], 0


def align(
    docs: DataFrame, vocabularies: Vocabularies | None = None, with_groups: bool = False
) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, places, counts, groups) of every row of ``docs`` (id, text).

    ``places`` and ``counts`` are the row's links by pair, as little-endian 32-bit numbers; a place
    is one in ``Vocabularies.pairs``.  ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` where it is asked
    for, else null.  Without tokens all numbers are zero and the texts empty.
    """
    vocabularies = vocabularies or Vocabularies.load()
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(vocabularies)

        def work(block: list[tuple[_Document, str]]) -> None:
            block = [x for x in block if x[0].sound]
            found = aligner.encode([text for _, text in block])
            for (doc, _), ids in zip(block, found):
                doc.sound &= ids is not None
            sound = [(doc, ids) for (doc, _), ids in zip(block, found) if doc.sound]
            for (doc, ids), rest in zip(sound, aligner.align([ids for _, ids in sound])):
                doc.add(len(ids[0]), len(ids[1]), *rest)

        for batch in batches:
            for part in slices(batch):
                rows, block, held = [], [], 0
                for text in part.column("text").to_pylist():
                    doc = _Document(with_groups)
                    rows.append(doc)
                    doc.sound = bool(text)
                    for piece in parts_of(text) if text else ():
                        block.append((doc, piece))
                        held += len(piece)
                        if held > BLOCK:
                            work(block)
                            block, held = [], 0
                work(block)
                for doc in rows:
                    if not doc.sound:
                        doc.__init__(with_groups)
                    doc.close()
                yield pa.RecordBatch.from_arrays([
                    part.column("id"),
                    *[long_array(np.array([getattr(d, c) for d in rows], np.int64))
                      for c in ("n_a", "n_b", "n_groups")],
                    pa.array([d.digest.hexdigest() if d.n_groups else "" for d in rows]),
                    pa.array([np.searchsorted(vocabularies.pairs, d.links).astype("<i4").tobytes()
                              for d in rows], pa.binary()),
                    pa.array([d.counts.astype("<i4").tobytes() for d in rows], pa.binary()),
                    pa.array([None if d.written is None else b";".join(d.written).decode()
                              for d in rows], pa.string()),
                ], names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "places", "counts",
                          "groups"])

    return docs.select("id", "text").mapInArrow(run, (
        f"id {kind}, n_a LONG, n_b LONG, n_groups LONG, groups_sha256 STRING, places BINARY, "
        "counts BINARY, groups STRING"))


def _cells(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4").astype(np.int64) for x in batch.column(name).to_pylist()]


def link_counts(aligned: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """(place, a, b, n): how many links hold each pair of ids, over all rows of ``align``."""
    size, n_b = len(vocabularies.pairs), len(vocabularies.b_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for places, counts in zip(_cells(batch, "places"), _cells(batch, "counts")):
                total[places] += counts
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([long_array(held), long_array(total[held])],
                                         names=["place", "n"])

    summed = aligned.select("places", "counts").mapInArrow(run, "place LONG, n LONG").groupBy(
        "place").agg(F.sum("n").alias("n"))
    pairs = vocabularies.pairs

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pairs[batch.column("place").to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), long_array(pair // n_b), long_array(pair % n_b),
                 batch.column("n")], names=["place", "a", "b", "n"])

    return summed.mapInArrow(named, "place LONG, a LONG, b LONG, n LONG")


def with_link_counts(aligned: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """Adds n_links, n_best and count_sum to the rows of ``align``.

    ``n_best`` counts links whose pair's count is the highest of its B id, ``count_sum`` sums the
    counts of all links; null beyond a long.  The counts go to the tasks as one array over
    ``Vocabularies.pairs``.
    """
    total = np.zeros(len(vocabularies.pairs), np.int64)
    counted = link_counts(aligned, vocabularies).select("place", "n").toArrow()
    total[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    of_b = vocabularies.pairs % len(vocabularies.b_bytes)
    highest = np.zeros(len(vocabularies.b_bytes), np.int64)
    np.maximum.at(highest, of_b, total)
    best = total == highest[of_b]
    names = [f.name for f in aligned.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for places, counts in zip(_cells(batch, "places"), _cells(batch, "counts")):
                whole = total[places]
                if float(counts.astype(float) @ whole.astype(float)) < 1 << 62:
                    weight = int(counts @ whole)
                else:
                    weight = sum(c * w for c, w in zip(counts.tolist(), whole.tolist()))
                found.append((int(counts.sum()), int(counts[best[places]].sum()),
                              weight if weight < 1 << 63 else None))
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.int64()) for c in columns]],
                names=[*names, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema)
    return aligned.mapInArrow(run, f"{kinds}, n_links LONG, n_best LONG, count_sum LONG")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document, with the corpus-wide counts of its links."""
    vocabularies = Vocabularies.load()
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    aligned = materialize(align(docs, vocabularies).drop("groups"), "aligned")
    return with_link_counts(aligned, vocabularies).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        "groups_sha256")
