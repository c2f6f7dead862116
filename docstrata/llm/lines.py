"""Line dedup by a segment-partition edit join.

Distinct lines are found first. If two lines differ by at most t edits and the shorter one is cut in t + 1 segments,
one segment stands unchanged in the longer one, at one of a few places that the two lengths allow. So every line
enters the index under its segments, and probes the index, for each length that may match, with its substrings at
those places. Keys are counted packed, as ranges of hashes; only lines with a key that another line shares are
written out. They meet in blocks, where a banded bit-parallel edit distance verifies pairs. A pair that several
segments bring together counts at the first. Groups of linked lines keep their first occurrence in the corpus.

Where the shorter line allows more than SHORT_EDITS edits, probes by place would number some cube of the edits. There
each segment has a WINDOWS length or more, so it enters the index under its smallest gram, and a line probes with the
smallest gram of each of its windows. Keys hold the step of the length and about where the gram stands, from the nearer
end. Those rows are four numbers: bits of the characters beside the gram tell if the whole segment is the same; the texts
of the pairs that are left are fetched from their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from docstrata.llm.components import components, hot_tiles, run_starts, sorted_blocks
from docstrata.llm.store import drop_table, materialize
from docstrata.llm.substrings import packed, unpacked
from docstrata.llm.textbytes import RangeHash, distinct, gather, mixed, row_blocks, text_bytes, unzipped, zipped

#: Characters of the shorter line for each edit allowed, for the first SHORT_EDITS, and for all of them in longer lines.
CHARS_AN_EDIT, SHORT_EDITS, LONG_CHARS_AN_EDIT = 10, 2, 20
#: From this length on lines allow more than SHORT_EDITS; then each of edits + 1 segments has as many characters as the window beside the length, or more.
LONG = LONG_CHARS_AN_EDIT * (SHORT_EDITS + 1)
WINDOWS = ((LONG, 15), (200, 18), (380, 19))
GRAM = 13
#: Lines whose lengths are of one step of this ratio, and grams that stand in one stretch of NEAR characters or a NEAR_SHARE of the line, share keys.
LENGTH_STEP, NEAR, NEAR_SHARE = 1.25, 48, 8
#: Characters on either side of a gram that tell whether its whole segment is the same, and the bits kept of each: no segment of a long line is longer.
CONTEXT, CONTEXT_BITS = LONG_CHARS_AN_EDIT - GRAM, 4
#: A key has so many bits, and those of the number of partitions. Lines that meet by chance are told apart when they are verified.
KEY_BITS = 27
#: Grams are ordered by how often they occur in some lines, in classes of powers of two by their highest bits, then by hash: rare ones bring few lines together.
RARE_BITS, RARE_LINES = 23, 16_000
_STEPS = np.array([int(LENGTH_STEP**k) for k in range(8, 160)])
#: Hashed grams of BIN_GRAM characters that are counted before a pair of long lines is aligned.
BINS, BIN_GRAM = 256, 4
BLOCK_BYTES = 1 << 18
PARTS = 2
PART_ROWS = 512
LONG_ROWS = 4096
#: Pairs of long lines whose texts are shuffled at once, if there aren't more lines than that.
ROUND_PAIRS = 1_000_000
#: Labels up to this number (16 MB) are sent to every task; beyond, Spark joins them.
SENT_LABELS = 1_000_000

_SPACE = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def edits_allowed(length: np.ndarray | int) -> np.ndarray | int:
    return np.maximum(np.minimum(length // CHARS_AN_EDIT, SHORT_EDITS), length // LONG_CHARS_AN_EDIT)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 rows, and the rows' offsets in characters."""
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), lead[offsets]


def line_spans(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start and end of each line that holds a word, its row and its number in the row. Lines end at line feeds."""
    breaks = np.flatnonzero(chars == 10)
    rows = np.arange(len(offsets) - 1)
    starts = np.concatenate([breaks + 1, offsets[:-1]])
    row = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, rows])
    # where a row ends in a line feed, its last line stands before the next row's first
    order = np.lexsort((np.repeat([0, 1], [len(breaks), len(rows)]), starts))
    starts, row = starts[order], row[order]
    ends = np.concatenate([offsets[1:], breaks])
    ends = np.sort(ends)
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    number = np.arange(len(starts)) - first[row]
    worded = np.append(0, np.cumsum(~np.isin(chars, _SPACE)))
    some = worded[ends] > worded[starts]
    return starts[some], ends[some], row[some], number[some]


def _key(h: np.ndarray, length: np.ndarray, segment: int) -> np.ndarray:
    return mixed(h + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(segment + 1))


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of edits + 1 segments of lines of some length; the last ones are longer by one."""
    k = edits + 1
    base, more = length // k, length % k
    return [(i * base + np.maximum(0, i - (k - more)), base + (i >= k - more)) for i in range(k)]


def places(segment: int, edits: int, longer: int) -> range:
    """Where a segment of a line may stand unchanged in one longer by ``longer``, as shifts from its own place.

    Edits before the segment number at most its own number and those after it at most the segments that follow, else
    an earlier or later segment is unchanged as well.
    """
    low = max(-segment, longer - (edits - segment))
    high = min(segment, longer + (edits - segment))
    return range(low, high + 1)


def line_keys(hashes: RangeHash, starts: np.ndarray, ends: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Index keys and probe keys of lines, each with the number of its line. A line's index keys are not among its probes."""
    length = ends - starts
    own, probes = ([], []), ([], [])
    for longer in range(SHORT_EDITS + 1):
        short = length - longer
        allowed = np.where(short > 0, edits_allowed(np.maximum(short, 0)), 0)
        for edits in range(max(1, longer), SHORT_EDITS + 1):
            some = np.flatnonzero(allowed == edits)
            if not len(some):
                continue
            at, size = starts[some], short[some]
            for i, (p, n) in enumerate(segments(size, edits)):
                for shift in places(i, edits, longer):
                    ok = (p + shift >= 0) & (p + shift + n <= length[some])
                    a = at[ok] + p[ok] + shift
                    into = own if longer == 0 and shift == 0 else probes
                    into[0].append(_key(hashes(a, a + n[ok]), size[ok], i))
                    into[1].append(some[ok])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return (join(own[0], np.uint64), join(own[1], np.int64)), (join(probes[0], np.uint64), join(probes[1], np.int64))


def _near_keys(grams: np.ndarray, side: np.ndarray | int, near: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Keys of grams by the side of the line from which their place counts, the stretch there and the step of the length."""
    return mixed(grams + np.uint64(0x9FB21C651E98DF25) * np.asarray(side + 1, np.uint64) + near.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + step.astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def _stretch(step: np.ndarray) -> np.ndarray:
    return np.maximum(NEAR, _STEPS[step] // NEAR_SHARE)


def gram_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One blob: for each value of a gram's RARE_BITS highest bits the magnitude of its count in the texts, 15 at most."""
    counts = np.zeros(1 << RARE_BITS, np.int64)
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        for i, j in row_blocks(offsets, BLOCK_BYTES):
            chars, _ = code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = np.arange(len(chars) - GRAM + 1)
            np.add.at(counts, _class_of(mixed(RangeHash(mixed(chars.astype(np.uint64)))(at, at + GRAM))), 1)
    yield pa.RecordBatch.from_arrays([pa.array([np.minimum(np.log2(counts + 1), 15).astype(np.uint8).tobytes()], pa.binary())], ["classes"])


def _class_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - RARE_BITS)).view(np.int64)


def long_keys(hashes: RangeHash, starts: np.ndarray, ends: np.ndarray, rare: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """As line_keys, for pairs whose shorter line has LONG characters or more: rows of the index, and probes.

    A segment enters under its smallest gram, by the classes ``rare`` and then by hash. A line probes with the smallest gram of each of its windows. An edit
    before an unchanged segment moves it by one at most, and segments before it are all changed; so it moves by no
    more than its number, counted from the nearer end of the line. Keys hold the stretch that the gram stands in,
    counted from that end, and the step of the length; probes ask for all that the moves and edits allow. A row has
    its key, its line and the gram's place, which tells an index's segment.
    """
    which = np.flatnonzero(ends - starts >= LONG)
    n = len(hashes.sums) - 1
    if not len(which):
        none = {k: np.zeros(0, np.uint64 if k == "key" else np.int64) for k in ("key", "line", "place")}
        return none, none
    at, length = starts[which], (ends - starts)[which]
    edits = edits_allowed(length)
    a = np.arange(n - GRAM + 1)
    grams = mixed(hashes(a, a + GRAM))
    # the place in the low bits: the smallest tells where it stands, the first of equal ones
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    rank = grams if rare is None else grams >> np.uint64(4) | rare[_class_of(grams)].astype(np.uint64) << np.uint64(60)
    order = np.append(rank & ~low | a.astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    # index
    k = edits + 1
    line = np.repeat(np.arange(len(which)), k)
    i = np.arange(len(line)) - np.repeat(np.cumsum(k) - k, k)
    base, more = (length // k)[line], (k - length % k)[line]
    begin = at[line] + i * base + np.maximum(0, i - more)
    size = base + (i >= more)
    p = (np.minimum.reduceat(order, np.stack([begin, begin + size - GRAM + 1], 1).ravel())[::2] & low).astype(np.int64)
    step = np.searchsorted(_STEPS, length, "right") - 1
    place, side = p - at[line], (2 * i > edits[line]).astype(np.int64)
    near = np.where(side > 0, length[line] - place, place) // _stretch(step[line])
    index = {"key": _near_keys(grams[p], side, near, step[line]), "line": which[line], "place": place}
    # probes
    keys, rows, places_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shortest = length - edits
    kind_of = lambda x: np.searchsorted([w[0] for w in WINDOWS], x, "right") - 1
    least, have = order, 1
    for kind, (_, window) in enumerate(WINDOWS):
        for k in range(have, window - GRAM + 1):  # windows grow, so the smallest of the narrower ones serve
            have, least = have + 1, np.minimum(least, np.append(order[k:], np.full(k, order[-1])))
        some = np.flatnonzero((kind_of(np.maximum(shortest, LONG)) <= kind) & (kind_of(length) >= kind))
        windows = length[some] - window + 1
        found = gather(least, at[some], windows) & low
        own = np.repeat(some, windows)
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
        p, own = found[new].astype(np.int64), own[new]
        place, slack = p - at[own], edits[own] // 2 + 1
        for side, count in enumerate((place, length[own] - place)):
            move = np.minimum(slack, count // (window - 1) + 1)
            # a gram of an index stands half of its line and half of a segment from its side at most
            half = count <= length[own] // 2 + slack + LONG_CHARS_AN_EDIT // 2 + 1
            for step in (0, 1):
                s = np.searchsorted(_STEPS, (shortest if step else length)[own], "right") - 1
                ok = half & (s < np.searchsorted(_STEPS, length[own], "right") - 1) if step else half
                width = _stretch(s)
                first, last = np.maximum(count - move, 0) // width, (count + move) // width
                for near, take in ((first, ok), (last, ok & (last > first))):
                    keys.append(_near_keys(grams[p[take]], side, near[take], s[take]))
                    rows.append(which[own[take]])
                    places_.append(place[take])
    asked = {"key": np.concatenate(keys), "line": np.concatenate(rows), "place": np.concatenate(places_)}
    # what the line's own index says at the same place isn't asked
    told = lambda x: mixed(x["key"] ^ mixed(x["line"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x["place"].astype(np.uint64)))
    other = ~Among(told(index))(told(asked))
    return index, {k: x[other] for k, x in asked.items()}


def contexts(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """CONTEXT_BITS of each of the CONTEXT characters before grams, the nearest lowest, then of those after; 0 beyond the line."""
    p, out = starts[line] + place, np.zeros(len(line), np.int64)
    for k, beside in enumerate((*range(-1, -CONTEXT - 1, -1), *range(GRAM, GRAM + CONTEXT))):
        at = p + beside
        inside = (at >= starts[line]) & (at < ends[line])
        c = chars[np.where(inside, at, 0)]
        out |= np.where(inside, (c ^ c >> 4 ^ c >> 8) & ((1 << CONTEXT_BITS) - 1), 0).astype(np.int64) << (CONTEXT_BITS * k)
    return out


def segment_at(length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segment of an index that a gram stands in, and which bits of contexts() are of its characters."""
    k = edits_allowed(length) + 1
    base, few = length // k, k - length % k  # so many are of the base length; the last ones are longer by one
    i = np.where(place < few * base, place // base, few + (place - few * base) // (base + 1))
    left = place - i * base - np.maximum(0, i - few)
    right = base + (i >= few) - left - GRAM
    ones = lambda n: (1 << (CONTEXT_BITS * n)) - 1
    return i, ones(left) | ones(right) << (CONTEXT_BITS * CONTEXT)


def _places_of(x: np.ndarray) -> dict[int, int]:
    """Where each character stands, as bits."""
    where: dict[int, int] = {}
    if len(x) < 512:
        for i, c in enumerate(x.tolist()):
            where[c] = where.get(c, 0) | 1 << i
        return where
    order = np.argsort(x, kind="stable")
    begins = np.append(np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1])), len(x))
    for i, j in zip(begins[:-1], begins[1:]):
        bits = np.zeros(len(x), np.uint8)
        bits[order[i:j]] = 1
        where[int(x[order[i]])] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return where


def banded_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two arrays of characters, or most + 1 if it is larger.

    Bit-parallel over a band: a column has 2 * most + 1 bits, the steps between the rows on either side of the diagonal,
    and moves down with it. The distance is followed along the band's lower edge, then along the last row, and given up
    as soon as it can't fall to ``most`` any more. Time grows with the length times the band's words.
    """
    most = int(most)
    if abs(len(a) - len(b)) > most:
        return most + 1
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[len(a) - (k - head) :][::-1] != b[len(b) - (k - head) :][::-1])
    tail = int(differ[0]) if len(differ) else k - head
    x, y = a[head : len(a) - tail], b[head : len(b) - tail].tolist()
    m, n = len(x), len(y)
    if not m or not n:
        return min(max(m, n), most + 1)
    where = _places_of(x)
    full, edge = (1 << (2 * most + 1)) - 1, 1 << (2 * most)
    more, less = full >> most << most, 0  # rows 1 to most + 1 of the first column: each one more than the row above
    score, corner = min(most, m), m - most
    low = 1 << (m - 1 + most) if m <= most else edge >> 1
    near: dict[int, int] = {}  # of where, the bits that the band meets in the next steps
    begin, stride = 0, 2 * most + 64
    for j, c in enumerate(y):
        if j < most:
            same = where.get(c, 0) << (most - j) & full
        else:
            if j == most or j - begin == stride:
                begin, near = j, {}
            if c not in near:
                near[c] = where.get(c, 0) >> (begin - most) & ((1 << (2 * stride)) - 1)
            same = near[c] >> (j - begin) & full
        straight = ((((same & more) + more) ^ more) | same | less) & full
        up, down = less | full & ~(straight | more), straight & more
        if j < corner:
            score += not straight & edge
            if score > 2 * most - (m - n):
                return most + 1
        else:
            score += bool(up & low) - bool(down & low)
            low >>= 1
            if score - (n - 1 - j) > most:
                return most + 1
        straight >>= 1
        more, less = down | full & ~(straight | up), straight & up
    return min(score, most + 1)


#: A band of so many edits fits in a word; such pairs are compared side by side, with so many bytes of places.
WORD_EDITS, PLACES_BYTES = 31, 1 << 24


def pairs_within(x: list[np.ndarray], y: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Whether each pair of lines differs by at most its ``most`` edits, WORD_EDITS at most; x has more characters than that, y as many as x or more.

    The columns of banded_edits, of many pairs at once: a word for each pair. Pairs that can't fall to ``most`` any more are left out.
    """
    out = np.zeros(len(x), bool)
    n = np.array([len(c) for c in y], np.int64)
    order = np.argsort(-n, kind="stable")
    at = 0
    while at < len(order):
        # lines of about the same length together
        some = order[at : at + 2048]
        letters = np.concatenate([x[k] for k in some] + [y[k] for k in some])
        seen = np.zeros(int(letters.max()) + 1, np.int64)
        seen[letters] = 1
        kinds, words = int(seen.sum()), int(n[some[0]]) // 64 + 3
        fit = max(1, PLACES_BYTES // (8 * kinds * words))
        if len(some) > fit:
            some = some[:fit]
        out[some] = _columns([x[k] for k in some], [y[k] for k in some], most[some], np.cumsum(seen) - 1, kinds, words)
        at += len(some)
    return out


def _columns(x: list[np.ndarray], y: list[np.ndarray], most: np.ndarray, number: np.ndarray, kinds: int, words: int) -> np.ndarray:
    m, n = (np.array([len(c) for c in z], np.int64) for z in (x, y))
    band, row = int(most.max()), np.arange(len(x))
    # bit i + band: where a letter stands in x; the band of column j begins at bit j
    place = gather(np.arange(int(m.max())), np.zeros(len(m), np.int64), m) + band
    where = np.zeros(len(x) * kinds * words, np.uint64)
    np.add.at(where, (np.repeat(row, m) * kinds + number[np.concatenate(x)]) * words + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    begins = np.zeros((int(n.max()), len(x)), np.int64)
    begins[gather(np.arange(int(n.max())), np.zeros(len(n), np.int64), n), np.repeat(row, n)] = (np.repeat(row, n) * kinds + number[np.concatenate(y)]) * words
    word = np.uint64
    full, edge, one = word((1 << (2 * band + 1)) - 1), word(1 << (2 * band)), word(1)
    more, less = np.full(len(x), (int(full) >> band) << band, word), np.zeros(len(x), word)
    score, corner, low = np.full(len(x), band), m - band, np.full(len(x), edge >> one, word)
    out = np.zeros(len(x), bool)
    for j in range(int(n.max())):
        k = int(np.searchsorted(-n, -j, "left"))  # pairs whose y is longer than j come first
        if k < len(n) or j % 16 == 0:
            out[row[k:]] = score[k:] <= most[k:]
            best = np.where(j < corner[:k], score[:k] - (band - (m - n)[:k]), score[:k] - (n[:k] - j))
            alive = np.flatnonzero(best <= most[:k])
            if not len(alive):
                return out
            if len(alive) < len(n):
                row, m, n, most, more, less, score, corner, low = (z[alive] for z in (row, m, n, most, more, less, score, corner, low))
        i, shift = begins[j][row] + (j >> 6), word(j & 63)
        same = where[i] >> shift
        if (j & 63) + 2 * band + 1 > 64:
            same |= where[i + 1] << word(64 - (j & 63))
        same &= full
        straight = ((((same & more) + more) ^ more) | same | less) & full
        up, down = less | full & ~(straight | more), straight & more
        before = j < corner
        last = ~before
        score += before & (straight & edge == 0)
        if last.any():
            score += (last & (up & low != 0)).astype(np.int64) - (last & (down & low != 0))
            low = np.where(last, low >> one, low)
        straight >>= one
        more, less = down | full & ~(straight | up), straight & up
    out[row] = score <= most
    return out


def _first_segment(short: np.ndarray, long: np.ndarray, edits: int) -> int:
    """The first segment of ``short`` that stands in ``long`` at an allowed place."""
    longer = len(long) - len(short)
    for i, (p, n) in enumerate(segments(np.int64(len(short)), edits)):
        for shift in places(i, edits, longer):
            q = p + shift
            if q >= 0 and q + n <= len(long) and (long[q : q + n] == short[p : p + n]).all():
                return i
    return -1


def _blobs(table: pa.Table, name: str) -> list[np.ndarray]:
    return [unpacked(x.as_buffer()) for chunk in table.column(name).chunks for x in chunk if x.is_valid]


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


class Among:
    """Which of other keys are among these: most are told by a table of low bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        bits = min(24, max(12, len(keys).bit_length() + 3))
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys & self.mask).view(np.int64)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        hit = self.table[(keys & self.mask).view(np.int64)]
        some = np.flatnonzero(hit)
        hit[some] = _member(keys[some], self.keys)
        return hit


def _owned_lines(t: pa.Table, r: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of a part's texts: characters, hashes, and the spans and nodes of the lines that the part owns."""
    owned = np.sort(r.column("place").drop_null().to_numpy().view(np.uint64))
    data, offsets = unzipped(t.column("_text"))
    rows = t.column("_row").to_numpy()
    for i, j in row_blocks(offsets, BLOCK_BYTES):
        chars, at = code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        starts, ends, row, number = line_spans(chars, at)
        mine = _member(mixed(mixed(rows[i:j][row].astype(np.uint64)) + number.astype(np.uint64)), owned)
        hashes = RangeHash(mixed(chars.astype(np.uint64)))
        starts, ends = starts[mine], ends[mine]
        yield chars, hashes, starts, ends, _nodes(hashes, starts, ends)


def _nodes(hashes: RangeHash, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed(hashes(starts, ends) + (ends - starts).astype(np.uint64)).view(np.int64)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """``docs`` with n_lines, n_removed, n_kept, n_links, removed (line numbers) and kept_text.

    A line is a piece of text between line feeds; lines without a word are left as they are and not counted. Two
    lines are linked if they are equal, or differ by at most one edit for every CHARS_AN_EDIT characters of the
    shorter one up to SHORT_EDITS, and one for every LONG_CHARS_AN_EDIT if that is more. Of a group that links join, the occurrence in the smallest id stays (null last; then
    by row and line), the others go. n_links counts, over the document's lines, the other texts that differ and are
    linked directly. Without ``count_links`` it is null, and pairs of long lines that other links have joined already
    aren't compared: first each line meets the partner of the most keys, then those that are still apart; the groups are the same.
    Rows that share their id and text are treated
    alike: each keeps what the first does. Null texts count as empty and keep an empty kept_text; an empty table gives no row. Columns of
    ``docs`` with the names of the new ones are replaced. Line texts are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, buckets = n * PARTS, max(8, n // PARTS)
    added = ["n_lines", "n_removed", "n_kept", "n_links", "removed", "kept_text"]
    # the documents' own columns travel as one, so none can clash
    base = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("_doc"), docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    # a row is told by its id and text, which any task that reads it again finds alike
    base = base.withColumn("_row", F.xxhash64("_id", "_text"))
    base = base.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    # compressed for the shuffles that only read it
    texts = base.select("_part", "_row", "_text").mapInArrow(_zip_texts, "_part int, _row long, _text binary")
    d = texts.repartition(n, "_part")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(3))
            for i, j in row_blocks(offsets, BLOCK_BYTES):
                chars, at = code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                starts, ends, row, number = line_spans(chars, at)
                nodes = _nodes(RangeHash(mixed(chars.astype(np.uint64))), starts, ends)
                take = pa.array(i + row)
                place = mixed(mixed(b.column(1).to_numpy()[i + row].astype(np.uint64)) + number.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(nodes), pa.array(number), pa.array(place)], ["id", "row", "part", "node", "line", "place"])

    fields = [StructField("id", docs.schema[id_col].dataType)] + [StructField(c, LongType()) for c in ("row", "part", "node", "line", "place")]
    seen = materialize(base.select(F.col("_id").alias("id"), "_row", F.col("_part").cast("long"), "_text").mapInArrow(occurrences, StructType(fields)), "line-places")
    rank = F.struct(F.col("id").isNull().alias("z"), "id", "row", "line", "part", "place")
    firsts = materialize(seen.groupBy("node").agg(F.min(rank).alias("o")).select("node", *[F.col(f"o.{c}").alias(c) for c in ("part", "row", "line", "place")]), "line-firsts")
    owners = firsts.select(F.col("part").cast("int").alias("_part"), "place", F.lit(None).cast("binary").alias("found")).repartition(n, "_part")
    # some texts, whatever the size of the table, say which grams are rare
    share = min(1.0, RARE_LINES / max(1, seen.count()))
    some = base.filter(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("_text").repartition(1)
    rare = np.frombuffer((some.mapInArrow(gram_classes, "classes binary").first() or [bytes(1 << RARE_BITS)])[0], np.uint8)
    bits = min(64, KEY_BITS + n.bit_length())
    cut_key = lambda keys: keys >> np.uint64(64 - bits)
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)

    def emit(t: pa.Table, r: pa.Table) -> pa.Table:
        index, more, probe = [], [], []
        for _, hashes, starts, ends, _ in _owned_lines(t, r) if len(t) else ():
            (own, _), (asked, _) = line_keys(hashes, starts, ends)
            index.append(cut_key(own))
            probe.append(cut_key(asked))
            own, asked = long_keys(hashes, starts, ends, rare)
            index.append(cut_key(own["key"]))
            # a key that the line itself has in the index says nothing of other lines
            told = lambda x: mixed(x["key"] ^ mixed(x["line"].astype(np.uint64)))
            probe.append(distinct(cut_key(asked["key"][~Among(told(own))(told(asked))])))
        none = np.zeros(0, np.uint64)
        index, counts = np.unique(np.concatenate([none, *index]), return_counts=True)
        sent = {"once": index[counts == 1], "more": index[counts > 1], "probe": distinct(np.concatenate([none, *probe]))}
        cuts = {k: np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for k, x in sent.items()}
        rows = [(b, *(packed(sent[k][cuts[k][b] : cuts[k][b + 1]]) for k in sent)) for b in range(buckets)]
        rows = [x for x in rows if any(x[1:])]
        part = t.column("_part")[0].as_py() if len(t) else -1
        return pa.table({"bucket": pa.array([x[0] for x in rows], pa.int32()), "_part": pa.array([part] * len(rows), pa.int32()), **{k: pa.array([x[1 + i] for x in rows], pa.binary()) for i, k in enumerate(sent)}})

    def match(t: pa.Table) -> pa.Table:
        blobs = [_blobs(t, k) for k in ("once", "more", "probe")]
        keys = np.sort(np.concatenate(blobs[0] + blobs[1]))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        met = np.diff(np.append(np.flatnonzero(new), len(keys))) > 1
        keys = keys[new]
        among = Among(keys)
        for x in (*blobs[1], *blobs[2]):
            met[np.searchsorted(keys, x[among(x)])] = True
        good, out = Among(keys[met]), []
        for parts_ in zip(*blobs):
            out.append(packed(distinct(np.concatenate([x[good(x)] for x in parts_]))))
        sent = pa.table({"_part": t.column("_part"), "place": pa.nulls(len(t), pa.int64()), "found": pa.array(out, pa.binary())})
        return sent.filter(pa.array([bool(x) for x in out], pa.bool_()))

    def write(t: pa.Table, r: pa.Table) -> pa.Table:
        found = Among(np.concatenate([np.zeros(0, np.uint64), *_blobs(r, "found")]))
        out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in ("key", "node", "at", "around")}
        short: list = []
        for chars, hashes, starts, ends, node in _owned_lines(t, r) if len(t) else ():
            for role, (key, line) in enumerate(line_keys(hashes, starts, ends)):
                key = cut_key(key)
                hit = found(key)
                # a line that probes with one key at several places is one row
                both = np.unique(np.stack([key[hit], line[hit].astype(np.uint64)], 1), axis=0)
                line = both[:, 1].astype(np.int64)
                for k, x in zip(out, (both[:, 0].view(np.int64), node[line], np.full(len(line), -1 - role), np.zeros(len(line), np.int64))):
                    out[k].append(x)
                short += [chars[a:b].tobytes() for a, b in zip(starts[line].tolist(), ends[line].tolist())]
            for role, rows in enumerate(long_keys(hashes, starts, ends, rare)):
                key = cut_key(rows["key"])
                hit = found(key)
                line, place = rows["line"][hit], rows["place"][hit]
                at = (ends - starts)[line] << 32 | place << 1 | (role == 0)
                for k, x in zip(out, (key[hit].view(np.int64), node[line], at, contexts(chars, starts, ends, line, place))):
                    out[k].append(x)
                short += [None] * len(line)
        return pa.table({**{k: pa.array(np.concatenate(x)) for k, x in out.items()}, "chars": pa.array(short, pa.binary())})

    hashed = d.groupBy("_part").cogroup(owners.groupBy("_part")).applyInArrow(emit, "bucket int, _part int, once binary, more binary, probe binary")
    # written, so that what was shuffled for it is gone before lines are
    found = materialize(hashed.groupBy("bucket").applyInArrow(match, "_part int, place long, found binary"), "line-keys")
    met = d.groupBy("_part").cogroup(owners.unionByName(found.repartition(n, "_part")).groupBy("_part")).applyInArrow(write, "key long, node long, at long, around long, chars binary")
    met = materialize(met, "line-candidates", "zstd")
    drop_table(found)
    # ``at``: -1 or -2 for a short line's index or probe; else the length, the gram's place and whether it is of the index
    dealt = hot_tiles(met.filter("at < 0"), ["key"], "node", PART_ROWS).select("key", "tile", "node", (F.col("at") == -1).alias("index"), "chars", "own", "parts").repartition(n, "key", "tile").sortWithinPartitions("key", "tile")
    links = dealt.mapInArrow(partial(_verify, bits), "node long, links long, root long")
    long_rows = met.filter("at >= 0").select("key", "node", "at", "around")

    def long_links(rows: DataFrame, stars: bool, name: str) -> DataFrame:
        """Verified links of long lines with different labels that share a key, with ``links``; ``stars``: of one pair a line, that of the most keys."""
        dealt = hot_tiles(rows, ["key"], "node", LONG_ROWS).select("key", "tile", "own", "parts", *[c for c in rows.columns if c != "key"]).repartition(n, "key", "tile").sortWithinPartitions("key", "tile")
        pairs = dealt.mapInArrow(partial(_pairs, stars), "u long, v long")
        if stars:
            best = F.max(F.struct("count", "u", "v")).alias("b")
            pairs = pairs.groupBy("u", "v").count().groupBy(F.greatest("u", "v")).agg(best).select("b.u", "b.v")
        pairs = materialize(pairs.distinct(), "line-pairs")
        # the texts of lines in pairs, from the rows that own them
        ask = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(firsts, "node")
        ask = ask.groupBy(F.col("part").cast("int").alias("_part"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("line", "node")).alias("_asked"))
        held = texts.join(ask, ["_part", "_row"]).select("_text", "_asked").mapInArrow(_asked_lines, "node long, chars binary").groupBy("node").agg(F.any_value("chars").alias("chars"))
        held = materialize(held, "line-texts", "zstd")
        out = materialize(links, name)
        # groups of near copies have more pairs than lines: texts are shuffled for about as many pairs at once as there are lines
        rounds = max(1, -(-pairs.count() // max(ROUND_PAIRS, firsts.count())))
        for k in range(rounds):
            pairs_ = pairs.filter(F.pmod(F.xxhash64("u", "v"), F.lit(rounds)) == k).join(held.select(F.col("node").alias("u"), F.col("chars").alias("a")), "u")
            pairs_ = pairs_.join(held.select(F.col("node").alias("v"), F.col("chars").alias("b")), "v").select("u", "v", "a", "b")
            out = out.unionByName(materialize(pairs_.mapInArrow(_verify_pairs, "node long, links long, root long"), name))
        drop_table(pairs)
        drop_table(held)
        return out

    links = long_links(long_rows, not count_links, "line-links")
    if not count_links:
        joined = materialize(components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))), "line-star-labels")
        few = joined.count() <= SENT_LABELS
        apart = long_rows.join(F.broadcast(joined) if few else joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = long_links(apart, False, "line-links")
    drop_table(met)
    drop_table(firsts)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    label = materialize(counts.join(components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))), "node", "left"), "line-labels")
    marked = seen.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = marked.groupBy("label").agg(F.min(rank).alias("o")).select("label", F.col("o.place").alias("stays"))
    line = F.struct("line", F.coalesce("links", F.lit(0)).alias("links"), (F.col("place") != F.col("stays")).alias("gone"))
    by_row = marked.join(first, "label").groupBy("part", "row").agg(F.collect_set(line).alias("l"))
    sums = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["links"])
    removed = F.transform(F.filter("l", lambda x: x["gone"]), lambda x: x["line"])
    by_row = by_row.select(F.col("part").cast("int").alias("_part"), "row", F.size("l").cast("long").alias("n_lines"), sums.alias("n_links"), removed.alias("removed")).repartition(n, "_part")

    def cut(t: pa.Table, r: pa.Table) -> pa.Table:
        of = {row: k for k, row in enumerate(r.column("row").to_pylist())}
        at = [of.get(x) for x in t.column("_row").to_pylist()]
        lines, links = r.column("n_lines").to_pylist(), r.column("n_links").to_pylist()
        gone, kept = [], []
        for k, text in zip(at, t.column("_text") if "_text" in t.column_names else (x for c in t.column("_doc").chunks for x in c.field(text_col))):
            drop = [] if k is None else sorted(r.column("removed")[k].as_py())
            text = text.as_py() or ""
            if drop:
                out = set(drop)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
            gone.append(drop)
            kept.append(text)
        n_lines = [0 if k is None else lines[k] for k in at]
        for name, column in zip(added, ([*n_lines], [len(x) for x in gone], [a - len(x) for a, x in zip(n_lines, gone)], [(0 if k is None else links[k]) if count_links else None for k in at], pa.array(gone, pa.list_(pa.int64())), pa.array(kept, pa.string()))):
            t = t.append_column(name, column if isinstance(column, pa.Array) else pa.array(column, pa.int64()))
        return t.select(["_doc", *added])

    kinds = [LongType()] * 4 + [ArrayType(LongType()), StringType()]
    schema = StructType([base.schema["_doc"], *[StructField(c, k) for c, k in zip(added, kinds)]])
    # a text that the document's other columns hold goes once
    whole = base.select("_doc", "_row", "_part", *([] if text_col in base.schema["_doc"].dataType.names else ["_text"])).repartition(n, "_part")
    return whole.groupBy("_part").cogroup(by_row.groupBy("_part")).applyInArrow(cut, schema).select("_doc.*", *added)


def _zip_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), zipped(b.column(2))], ["_part", "_row", "_text"])


def _asked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, UTF-8 bytes) of the lines that are asked of each text."""
    for batch in batches:
        nodes, chars = [], []
        data, offsets = unzipped(batch.column(0))
        for k, asked in enumerate(batch.column(1).to_pylist()):
            lines = data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
            nodes += [x["node"] for x in asked]
            chars += [lines[x["line"]] for x in asked]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(chars, pa.binary())], ["node", "chars"])


def _verify(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within tiles of lines that share a key: (node, links, root), root the smallest node reached here."""
    from docstrata.llm.components import Union

    for block in sorted_blocks(batches, 2):
        starts = run_starts(block, 2)
        tile, node, own, parts, index = (block.column(k).to_numpy() for k in ("tile", "node", "own", "parts", "index"))
        key = block.column("key").to_numpy().view(np.uint64)
        out: list[tuple[int, int, int]] = []
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
            rows = list(range(i, j))
            if len(rows) < 2 or not index[i:j].any():
                continue
            chars = [np.frombuffer(block.column("chars")[k].as_buffer(), "<u4") for k in rows]
            place = {int(x): k for k, x in enumerate(np.unique(node[i:j]))}
            which = [place[int(node[k])] for k in rows]
            union, links, done = Union(len(place)), [0] * len(place), set()
            for a, r in enumerate(rows):
                if not index[r]:
                    continue
                edits = int(edits_allowed(len(chars[a])))
                for b, s in enumerate(rows):
                    longer = len(chars[b]) - len(chars[a])
                    if node[r] == node[s] or not 0 <= longer <= edits or longer == 0 and node[r] > node[s]:
                        continue
                    low, high = sorted((int(own[r]), int(own[s])))
                    if low == high and low * parts[i] + high != tile[i] or (which[a], which[b]) in done:
                        continue
                    if banded_edits(chars[a], chars[b], edits) <= edits:
                        k = _first_segment(chars[a], chars[b], edits)
                        p, m = segments(np.int64(len(chars[a])), edits)[k]
                        own_key = _key(RangeHash(mixed(chars[a].astype(np.uint64)))(np.array([p]), np.array([p + m])), np.array([len(chars[a])]), k)[0]
                        if own_key >> np.uint64(64 - bits) == key[i]:
                            done.add((which[a], which[b]))
                            links[which[a]] += 1
                            links[which[b]] += 1
                            union.join(which[a], which[b])
            ids = sorted(place)
            out += [(ids[k], links[k], ids[union.find(k)]) for k in range(len(ids)) if links[k]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "links", "root"])


def _pairs(stars: bool, batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs (u the shorter line or the smaller node, v) of long lines that share a whole segment where it may stand.

    Lines of one label are joined already. ``stars``: of a block's pairs of a key, each larger node's with the smallest other one.
    """
    for block in sorted_blocks(batches, 2):
        starts = run_starts(block, 2)
        tile, node, own, parts, at, around = (block.column(k).to_numpy().astype(np.int64) for k in ("tile", "node", "own", "parts", "at", "around"))
        label = block.column("label").to_numpy() if "label" in block.column_names else node
        index, place, size = at & 1, (at & 0xFFFFFFFF) >> 1, at >> 32
        run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        first = np.flatnonzero(index)
        counts = np.diff(starts)[run[first]]
        first, counts = first[counts > 1], counts[counts > 1]
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(counts), np.arange(0, int(counts.sum()), most)), len(first)))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            a = np.repeat(first[x:y], counts[x:y])
            b = np.arange(len(a)) - np.repeat(np.cumsum(counts[x:y]) - counts[x:y], counts[x:y]) + starts[run[a]]
            segment, inside = segment_at(size[first[x:y]], place[first[x:y]])
            i, inside = np.repeat(segment, counts[x:y]), np.repeat(inside, counts[x:y])
            longer, edits = size[b] - size[a], edits_allowed(size[a])
            moved = place[b] - place[a]
            ok = (longer >= 0) & (longer <= edits) & (label[a] != label[b])
            ok &= (moved >= np.maximum(-i, longer - edits + i)) & (moved <= np.minimum(i, longer + edits - i))
            # two rows of one part meet in every tile of the part; the one with itself counts
            ok &= (own[a] != own[b]) | (own[a] * parts[a] + own[a] == tile[a])
            ok &= (around[a] ^ around[b]) & inside == 0
            a, b = a[ok], b[ok]
            if stars and len(a):
                low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
                order = np.lexsort((low, high, run[a]))
                first_of = np.append(True, (run[a][order][1:] != run[a][order][:-1]) | (high[order][1:] != high[order][:-1]))
                a, b = a[order[first_of]], b[order[first_of]]
            swap = (size[a] == size[b]) & (node[a] > node[b])
            found = np.unique(np.stack([np.where(swap, node[b], node[a]), np.where(swap, node[a], node[b])], 1), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["u", "v"])


def _bins(texts: list[np.ndarray]) -> np.ndarray:
    """A row for each text: how many of its grams of BIN_GRAM characters fall in each of BINS."""
    sizes = np.array([len(x) for x in texts])
    row = np.repeat(np.arange(len(texts)), np.maximum(sizes - BIN_GRAM + 1, 0))
    at = gather(np.arange(int(sizes.sum())), np.cumsum(sizes) - sizes, np.maximum(sizes - BIN_GRAM + 1, 0))
    grams = mixed(RangeHash(np.concatenate(texts).astype(np.uint64))(at, at + BIN_GRAM))
    return np.bincount(row * BINS + (grams % np.uint64(BINS)).astype(np.int64), minlength=len(texts) * BINS).reshape(-1, BINS)


def _verify_pairs(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Links of pairs with their texts: (node, 1, root) for both lines of a pair within its edits."""
    for whole in batches:
        for batch in (whole.slice(k, most) for k in range(0, whole.num_rows, most)):
            u, v = (batch.column(k).to_numpy() for k in (0, 1))
            x, y = ([np.frombuffer(z.as_py().decode().encode("utf-32-le"), "<u4") for z in batch.column(k)] for k in (2, 3))
            allowed = edits_allowed(np.array([len(a) for a in x]))
            hit = np.zeros(len(x), bool)
            some = np.flatnonzero(allowed <= WORD_EDITS)
            if len(some):
                hit[some] = pairs_within([x[k] for k in some], [y[k] for k in some], allowed[some])
            some = np.flatnonzero(allowed > WORD_EDITS)
            if len(some):
                # an edit takes away and adds BIN_GRAM grams at most
                near = np.abs(_bins([x[k] for k in some]) - _bins([y[k] for k in some])).sum(1) <= 2 * BIN_GRAM * allowed[some]
                hit[some[near]] = [banded_edits(x[k], y[k], int(allowed[k])) <= allowed[k] for k in some[near].tolist()]
            hit = np.flatnonzero(hit)
            if len(hit):
                root = np.minimum(u, v)[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u[hit], v[hit]])), pa.array(np.ones(2 * len(hit), np.int64)), pa.array(np.concatenate([root, root]))], ["node", "links", "root"])
