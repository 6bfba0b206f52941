"""Personal data in texts: patterns, and a semi-Markov conditional random field beside them.

The patterns find addresses, card and phone numbers in their plain forms.  The field finds more:
forms the patterns miss, such as ``name (at) host dot org`` or a phone number without its plus.
Stretches of a text that may hold personal data are cut into units (digits, letters, blanks,
marks); every run of up to ``LONGEST`` units, and every written-out address of any length, is a
candidate segment, scored as a whole by features of its digits, groups, separators, checksums and
surroundings, for every kind.  Runs of numbers with more digits than any kind has are none.
Dynamic programming picks the segments of the highest total; units in none score zero.

The field is trained here, by maximum likelihood, on stretches drawn from a bounded sample of the
documents (labelled by the patterns), on other ways of writing what the patterns found there,
and on made-up numbers of every sort.  Segments never overlap a pattern's match, and those stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import read_table, slices

KINDS = ("email", "ip", "card", "phone")
# A card of 16 digits parted by a blank, a mark and a blank has 61 units.
LONGEST = 64
MOST_DIGITS = 19
# Documents to train on: those with the smallest hashes that hold a digit or "@".
SAMPLE_DOCS = 600
# The smallest hashes are sought among about so many times as many documents.
SAMPLE_MARGIN = 2
SAMPLE_STRETCHES = 800
MADE_UP = 40  # of each sort
# A segment is taken if it adds at least so much to the score (log odds).
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no start inside a number
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" with the run before it; the same matches as the pattern's, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin, domain = at, _DOMAIN.match(text, at + 1)
        if domain:
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
        if begin < at:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The patterns' matches by start, then kind; a match that fails its check is dropped."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 and len(x.lstrip("0") or "0") <= 3
               for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if len(m[0]) <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def to_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- stretches, units, segments ----

_AT = r"(?:@|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+)"
_WRITTEN_OUT = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}"
                          rf"[A-Za-z0-9-]{{1,64}}(?:{_DOT}[A-Za-z0-9-]{{1,64}})+")
_NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().\-/\[\]]*[0-9]")
_UNITS = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_GOES_ON = re.compile(rf"(?i){_DOT}[A-Za-z0-9-]")
_MARKED = re.compile(r"(?i)[(\[{ ](at|dot)[)\]} ]")
# Words before a number or address that tell its kind.
_CUES = frozenset(("tel", "phone", "call", "fax", "mobile", "mail", "email", "contact", "card",
                   "visa", "credit", "ip", "host", "server", "order", "invoice", "version"))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that may hold personal data, in order, not overlapping."""
    found = []
    if re.search("[0-9]", text):
        found = [m.span() for m in _NUMBERS.finditer(text) if len(_digits(m[0])) >= 7
                 or m[0].count(".") >= 3]
    if "@" in text or _MARKED.search(text):
        found += [m.span() for m in _WRITTEN_OUT.finditer(text)]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def _features(text: str, a: int, b: int) -> list[str]:
    """What the field sees of the segment [a, b)."""
    span, digits = text[a:b], _digits(text[a:b])
    groups = [len(x) for x in re.findall("[0-9]+", span)]
    marks = "".join(sorted(set(re.sub(r"[^\W_]", "", span))))[:8]
    plain = re.sub(_DOT, ".", re.sub(_AT, "@", span, flags=re.I), flags=re.I)
    letters = len(re.findall(r"[^\W\d_]", span))
    before, after = text[max(0, a - 1):a], text[b:b + 1]
    found = ["bias", f"digits {min(len(digits), 20)}", f"groups {min(len(groups), 8)}",
             f"marks {marks}", f"letters {letters > 0}"]
    if not letters:
        found += [f"lengths {'-'.join(map(str, groups[:8]))}", f"lead {span[:1]}" if not
                  span[0].isdigit() else f"zeros {len(span) - len(span.lstrip('0'))}"]
        if 12 <= len(digits) <= 19:
            even = len(set(groups[:-1])) <= 1
            found.append(f"luhn {luhn(digits)}")
            found.append(f"luhn {luhn(digits)} even {even} one mark {len(marks) <= 1}")
        parts = re.split(r"\[\.\]|\.", span)
        if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append("four parts")
        if 9 <= len(digits) <= 15:
            found.append(f"phone lengths {'-'.join(map(str, groups[-3:]))} {span[0] in '+('}")
    elif "@" in plain:
        form = re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.([A-Za-z]{2,})", plain)
        found.append(f"address {bool(form)} {plain.count('@')}")
        found.append(f"marked {bool(_MARKED.search(span))} {bool(form)}")
        found.append(f"dot after {bool(_GOES_ON.match(text[b:b + 16]))}")
    else:
        found.append("no address")
    if re.match(r"[^\W_]", before) and re.match(r"[^\W_]", span[0]):
        found.append("cut on the left")
    if re.match(r"[^\W_]", after) and re.match(r"[^\W_]", span[-1]):
        found.append("cut on the right")
    if before in tuple("+-./") and before:
        found.append("joined on the left")
    cues = re.findall(r"[a-z]+", text[max(0, a - 24):a].lower())[-2:]
    return found + [f"cue {c}" for c in cues if c in _CUES]


def segments(text: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Unit edges of a stretch, and the candidates as pairs of edge numbers."""
    edges, digits, others = [a], [0], [0]  # digits, and units of letters or "@", before each edge
    for m in _UNITS.finditer(text, a, b):
        edges.append(m.end())
        digits.append(digits[-1] + len(_digits(m[0])))
        others.append(others[-1] + (m[0].isalpha() or m[0] == "@"))
    found = []
    for i in range(len(edges) - 1):
        c = text[edges[i]]
        if not (c.isalnum() or c in "+(._%-"):
            continue
        for j in range(i + 1, min(i + LONGEST, len(edges) - 1) + 1):
            if digits[j] - digits[i] > MOST_DIGITS and others[j] == others[i]:
                continue
            span = text[edges[i]:edges[j]]
            if span[-1].isalnum() and (
                    "@" in span or _MARKED.search(span) or digits[j] - digits[i] >= 7
                    or span.count(".") >= 3):
                found.append((i, j))
    if len(edges) - 1 > LONGEST:
        number = {x: n for n, x in enumerate(edges)}
        for m in _WRITTEN_OUT.finditer(text, a, b):
            i, j = (number.get(x, -1) for x in m.span())
            if i >= 0 and j - i > LONGEST and text[edges[j] - 1].isalnum():
                found.append((i, j))
    return edges, found


def best_path(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """The segments (candidate, kind) of the highest total over ``n`` units; O units score 0."""
    ends: dict[int, list[int]] = {}
    for s, (_, j) in enumerate(spans):
        ends.setdefault(j, []).append(s)
    total, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        total[j] = total[j - 1]
        for s in ends.get(j, ()):
            k = int(np.argmax(scores[s]))
            if (x := total[spans[s][0]] + float(scores[s, k])) > total[j]:
                total[j], back[j] = x, (s, k)
    path, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            path.append(back[j])
            j = spans[back[j][0]][0]
    return path[::-1]


# ---- training ----

def _made_up(rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Texts with their spans: numbers and addresses of every sort, plain and otherwise."""
    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def card(valid: bool) -> str:
        body = str(rng.integers(3, 7)) + number(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        return body + (last if valid else str((int(last) + 3) % 10))

    def word() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))

    def fours(x: str, mark: str) -> str:
        return mark.join(x[i:i + 4] for i in range(0, 16, 4))

    def quad(most: int) -> list[str]:
        return [str(x) for x in rng.integers(0, most, 4)]

    at, dot = (" at ", " (at) ", "[at]", "(at)"), (" dot ", " (dot) ", "[dot]", ".")
    made: list[tuple[str, list[Span]]] = []
    for _ in range(MADE_UP):
        mark = str(rng.choice(list(" .-")))
        local, host, end = word(), word(), str(rng.choice(["com", "org", "net", "de"]))
        a, d = str(rng.choice(at)), str(rng.choice(dot))
        three = [number(3), number(3), number(4)]
        sorts = [
            (f"{local}{a}{host}{d}{end}", 0), (f"{local}@{host}{d}{end}", 0),
            (f"{local}{a}{host}{d}{local}{d}{end}", 0),
            (f"{local}.{host}{a}{end}{d}{host}{d}co{d}uk", 0),
            ("[.]".join(quad(256)), 1), (".".join(quad(256)), 1),
            (fours(card(True), str(rng.choice([".", "/", " ", "-"]))), 2), (card(True), 2),
            (f"({three[0]}) {three[1]}-{three[2]}", 3), (f"{mark.join(three)}", 3),
            (f"00{rng.integers(1, 99)}{mark}{mark.join(three)}", 3),
            (f"+{rng.integers(1, 99)} {mark.join(three)}", 3),
            (card(False), None), (fours(card(False), "-"), None), (number(int(rng.integers(7, 16))), None),
            (f"20{number(2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", None),
            (f"{rng.integers(1, 9)}.{number(9)}", None),
            (".".join([number(3)] * 3), None),
            (".".join(str(x) for x in rng.integers(256, 999, 4)), None),
            (f"{local} at {host} {word()}", None), (f"{host} at {number(8)}", None),
        ]
        for text, kind in sorts:
            left, right = f"{word()} ", f" {word()}"
            whole = left + text + right
            spans = [] if kind is None else [(len(left), kind, len(left) + len(text))]
            made.append((whole, spans))
    return made


def _other_forms(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Each match of a text, written in another way, with its surroundings."""
    for n, (a, kind, b) in enumerate(spans):
        was = text[a:b]
        if kind == 0:
            local, host = was.split("@")
            new = local + (" at ", " (at) ", "[at]")[n % 3] + host.replace(".", (" dot ", ".")[n % 2])
        elif kind == 1:
            new = was.replace(".", "[.]")
        elif kind == 2:
            new = ".".join(re.findall("....", _digits(was))) if len(_digits(was)) == 16 else was
        else:
            new = was.lstrip("+").replace(" ", "-") if n % 2 else "00" + was[1:]
        left, right = text[max(0, a - 30):a], text[b:b + 20]
        yield left + new + right, [(len(left), kind, len(left) + len(new))]


class Field:
    """The weights: one row for each kind, one column for each feature."""

    def __init__(self, index: dict[str, int], weights: np.ndarray) -> None:
        self.index, self.weights = index, weights

    def scores(self, text: str, edges: list[int], spans: list[tuple[int, int]]) -> np.ndarray:
        out = np.empty((len(spans), len(KINDS)))
        for s, (i, j) in enumerate(spans):
            known = [self.index[f] for f in _features(text, edges[i], edges[j]) if f in self.index]
            out[s] = self.weights[:, known].sum(axis=1)
        return out

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Segments beside the base ones."""
        found = []
        for a, b in stretches(text):
            held = [(x, y) for x, _, y in base if x < b and y > a]
            if any(x <= a and y >= b for x, y in held):
                continue
            edges, spans = segments(text, a, b)
            spans = [(i, j) for i, j in spans
                     if not any(x < edges[j] and y > edges[i] for x, y in held)]
            if not spans:
                continue
            scores = self.scores(text, edges, spans) - MARGIN
            for s, k in best_path(len(edges) - 1, spans, scores):
                found.append((edges[spans[s][0]], k, edges[spans[s][1]]))
        return found


def train(labelled: list[tuple[str, list[Span]]], rounds: int = 40, penalty: float = 0.02) -> Field:
    """Maximum likelihood by AdaGrad; the likelihood sums over all segmentations."""
    index: dict[str, int] = {}
    lattices = []
    for text, truth in labelled:
        for a, b in stretches(text):
            edges, spans = segments(text, a, b)
            if not spans:
                continue
            features = [[index.setdefault(f, len(index)) for f in _features(text, edges[i], edges[j])]
                        for i, j in spans]
            places = {(edges[i], edges[j]): s for s, (i, j) in enumerate(spans)}
            within = [(x, k, y) for x, k, y in truth if x < b and y > a]
            if any((x, y) not in places for x, _, y in within):
                continue  # a match that is no segment would count against its parts
            gold = [(places[x, y], k) for x, k, y in within]
            lattices.append((len(edges) - 1, spans, features, gold))
    rows = np.concatenate([np.repeat(np.arange(len(fs)), [len(f) for f in fs]) for _, _, fs, _ in lattices])
    sizes = [len(spans) for _, spans, _, _ in lattices]
    begins = np.cumsum([0, *sizes])
    rows = rows + np.repeat(begins[:-1], [sum(map(len, fs)) for _, _, fs, _ in lattices])
    columns = np.array([f for _, _, fs, _ in lattices for one in fs for f in one], np.int64)
    n_kinds = len(KINDS)
    target = np.zeros((begins[-1], n_kinds))
    for begin, (_, _, _, gold) in zip(begins, lattices):
        for s, k in gold:
            target[begin + s, k] = 1
    weights, seen = np.zeros((n_kinds, len(index))), np.full((n_kinds, len(index)), 1e-8)
    for _ in range(rounds):
        scores = np.stack([np.bincount(rows, w[columns], begins[-1]) for w in weights], axis=1)
        marginal = np.empty_like(scores)
        for begin, (n, spans, _, _) in zip(begins, lattices):
            own = scores[begin:begin + len(spans)]
            marginal[begin:begin + len(spans)] = _marginals(n, spans, own)
        off = target - marginal
        for k in range(n_kinds):
            step = np.bincount(columns, off[rows, k], len(index)) - penalty * weights[k]
            seen[k] += step ** 2
            weights[k] += 0.5 * step / np.sqrt(seen[k])
    return Field(index, weights)


def _marginals(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each segment and kind, by the forward and backward sums."""
    top = scores.max(axis=1)
    whole = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for s, (i, j) in enumerate(spans):
        starts.setdefault(i, []).append(s)
        ends.setdefault(j, []).append(s)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = float(np.logaddexp.reduce([forward[j - 1], *(
            forward[spans[s][0]] + whole[s] for s in ends.get(j, ()))]))
    for i in range(n - 1, -1, -1):
        backward[i] = float(np.logaddexp.reduce([backward[i + 1], *(
            backward[spans[s][1]] + whole[s] for s in starts.get(i, ()))]))
    log_p = [forward[i] + backward[j] - forward[n] for i, j in spans]
    return np.exp(scores + np.array(log_p)[:, None])


def fit(docs: DataFrame) -> Field:
    """Train on a bounded sample of ``docs`` (doc_id, text), chosen by hash, so reruns agree."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    for a, b in stretches(text):
                        found.append(text[max(0, a - 30):b + 20])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["around"])

    hashed = docs.where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("doc_id", "text"))
    # Hashes of about so many documents lie below; the others never reach the task that sorts.
    share = min(1.0, SAMPLE_MARGIN * SAMPLE_DOCS / max(hashed.count(), 1))
    below = hashed.where(F.col("h") <= F.lit(min(int((share - 0.5) * 2**64), 2**63 - 1)))
    sample = below.orderBy("h", "doc_id").limit(SAMPLE_DOCS)
    drawn = sample.select("text").mapInArrow(task, "around string").where(
        F.length("around") < 400).distinct().orderBy(F.xxhash64("around"), "around")
    labelled = [(r["around"], base_spans(r["around"])) for r in drawn.limit(SAMPLE_STRETCHES).collect()]
    others = [x for text, spans in labelled for x in _other_forms(text, spans)]
    return train(labelled + others + _made_up(np.random.Generator(np.random.PCG64(6))))


FOUND = "base array<struct<start: int, kind: int, end: int>>, more array<struct<start: int, kind: int, end: int>>"


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(row, base, more): spans of each row of ``docs`` (row, text), by start, then kind.

    Offsets are code points, ends exclusive; a null text is empty and has none.  Texts are searched
    whole; repeated rows stay repeated.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "kind", "end")]))
        for batch in batches:
            for part in slices(batch):
                base, more = [], []
                for text in part.column("text").to_pylist():
                    plain = base_spans(text or "")
                    extra = field.spans(text or "", plain)
                    for out, spans in ((base, plain), (more, sorted(extra))):
                        out.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(base, kind), pa.array(more, kind)],
                    ["row", "base", "more"])

    own = docs.schema["row"].dataType.simpleString()
    return docs.select("row", "text").mapInArrow(task, f"row {own}, {FOUND}")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of the patterns' matches by kind, their digest, all spans, and n_more, the
    number of those that the field added."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs.select(F.struct("doc_id").alias("row"), "text"), fit(docs))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return found.select(
        "row.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_more"))
