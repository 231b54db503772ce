"""Near duplicates by order MinHash and banded alignment.

Texts with the same words (A-Z as a-z, whatever the blanks) form one class at once.  For each of ``SKETCHES`` hash orders a class is
sketched by its two smallest k-mers, labelled with their occurrence number and kept in text order; classes that share a sketch are
candidates.  Two classes are linked if their word edit similarity, 1 - distance / longer length, is 0.8 or more, which alignment
decides: an alignment along k-mers that both texts hold once bounds the distance from above, which settles most copies, and banded
alignment settles the rest.  Classes joined by links are one group.

K-mers have three words, and two in texts of less than ``MIDDLE`` words, of which replacements would leave too few.  Pairs of at most
``DELETED_FROM`` words are not left to chance: there a text's keys are what remains of it without the words that a link may cost, for
every choice of these, so that each linked pair has a key in common.

A member of a sketch is first compared with one other, the smallest of the centers (smallest members) of its sketches, which joins
most copies.  Then the sketches whose members are in several groups are looked at again, in rounds: every two members of different
groups are a pair, so no candidate is left out, but a round takes only a share of all pairs, drawn by a hash, and the last one what
is left, so that most pairs of what turns out as one group are never needed.  Texts that share several sketches are a pair in the
first of these only.  Lengths, and counts of words and of neighbouring words in
bins, bound the distance from below, and so do the counts of all words: blocks of members with near lengths are paired inside a worker,
and only the pairs that these bounds don't rule out become rows.  What stays quadratic are pairs of texts of near lengths and very nearly
the same words that share a sketch and are no link.

Two texts with k-mer similarity J share a sketch with probability about J^2.  Scattered replacements that leave an edit similarity of
0.8, the threshold, leave a k-mer similarity of 0.34: 40 sketches find such a pair with 0.99, and those above it more surely.  A group
of copies needs no more than a chain of such pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.llm.common import dealt, identified, unpacked, whole_row
from siteatlas.llm.components import components
from siteatlas.llm.words import WHITE, WordBatch, grams, mix
from siteatlas.session import cut_lineage, forget

KMER, SKETCHES, TAKEN = 3, 40, 2
# Bins of the words of a text, and of its pairs of neighbouring words.
BINS, PAIR_BINS = 128, 512
# Up to so many words pairs are found by the words they keep, so many of which may go; up to so many, k-mers have two words.
DELETED_FROM, DELETED, MIDDLE = 14, 2, 30
# Words of a text whose places alignment marks at once, at most.
MARKED = 1 << 14
# Texts that a worker sketches at once, and pairs that it aligns: its memory is no more than these need, whatever comes in a batch.
FEATURED, ALIGNED = 250, 100
# Up to so many words a text's words are listed, as 16 bits each; of a longer one there are counts in so many bins.
LISTED, FOLDED = 2000, 2048
# Members of a sketch in a block, whose pairs one worker tests; pairs that it tests at once; counts of words that it holds, and compares at once.
BLOCK, AT_ONCE, HELD, COMPARED = 1000, 10_000, 8_000_000, 2_000_000
# Rounds after the centers': up to which share of all pairs, by a hash of the pair, each one looks at.
SHARES = (1 / 64, 1 / 8, 1.0)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    batch = WordBatch(texts, WHITE, _LOWER)
    return batch.hashes(), batch.first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def sketches(hashes: np.ndarray, first: np.ndarray, kmer: int = KMER, count: int = SKETCHES) -> np.ndarray:
    """Keys (texts x count); texts shorter than a k-mer are one k-mer, texts without words have keys of no meaning."""
    n, sizes = len(first) - 1, np.diff(first)
    text = np.repeat(np.arange(n), sizes)
    room = first[1:][text] - np.arange(len(hashes))
    valid = (room >= kmer) | ((sizes[text] < kmer) & (room == sizes[text]))
    g, at, text = grams(hashes, kmer)[valid], np.flatnonzero(valid), text[valid]
    short = sizes[text] < kmer
    if short.any():  # grams() would look beyond the end of such a text
        place = np.arange(len(hashes)) - np.repeat(first[:-1], sizes)
        whole = _sums(mix(hashes + mix(place.astype(np.uint64))), first)
        g[short] = mix(whole[text[short]])
    order = np.lexsort((at, g, text))
    same = np.zeros(len(g), dtype=bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1])
    run = np.arange(len(g)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
    label = np.empty(len(g), dtype=np.uint64)
    label[order] = run
    labelled = mix(g + label * np.uint64(0xA0761D6478BD642F))
    filled = np.unique(text)
    begin = np.searchsorted(text, filled)
    number = np.searchsorted(filled, text)
    keys = np.zeros((n, count), dtype=np.uint64)
    for j in range(count if len(g) else 0):
        r = mix(labelled ^ np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        picks = []
        for _ in range(TAKEN):
            least = np.minimum.reduceat(r, begin)
            where = np.flatnonzero((r == least[number]) & (r != _TOP))
            place = np.full(len(filled), -1)
            place[number[where][::-1]] = where[::-1]  # the first of equals
            picks.append(place)
            r[place[place >= 0]] = _TOP
        value = np.full(len(filled), np.uint64(j), dtype=np.uint64)
        for place in np.sort(np.stack(picks), axis=0):  # in text order; a text with fewer k-mers gives what it has
            value = np.where(place >= 0, mix(value * np.uint64(0xE7037ED1A0B428DB) + g[place]), value)
        keys[filled, j] = value
    return keys


def allowed(n: int, similarity: float) -> int:
    """Largest edit distance of a linked pair whose longer text has ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def deletion_keys(hashes: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """Keys (texts x keys) of texts of ``n`` words each (texts x n), by which every linked pair of up to ``DELETED_FROM`` words meets.

    If the longer text of a pair has m words and their distance is at most d, they have m - d words in common in the same order:
    so for each such m a text has a key for every way to leave so many of its words.
    """
    keys = []
    for m in range(n, DELETED_FROM + 1):
        d = allowed(m, similarity)
        left = m - d
        if m - n > d or d > DELETED or not d:
            continue
        for kept in combinations(range(n), left):
            value = np.full(len(hashes), np.uint64(m + (left << 8) + (1 << 60)), dtype=np.uint64)
            for k in kept:
                value = mix(value * np.uint64(0xE7037ED1A0B428DB) + hashes[:, k])
            keys.append(value)
    return np.stack(keys, axis=1) if keys else np.zeros((len(hashes), 0), dtype=np.uint64)


def all_keys(hashes: np.ndarray, first: np.ndarray, similarity: float) -> list[np.ndarray]:
    """The keys of each text: kept words of short texts, sketches of two-word k-mers up to middle lengths, of three-word ones beyond."""
    sizes = np.diff(first)
    found: list[list[np.ndarray]] = [[] for _ in sizes]
    for n in np.unique(sizes[(sizes > 0) & (sizes <= DELETED_FROM)]).tolist():
        some = np.flatnonzero(sizes == n)
        for i, keys in zip(some, deletion_keys(hashes[first[some][:, None] + np.arange(n)], n, similarity), strict=True):
            found[i].append(keys)
    # A pair within the similarity has both its texts on one side of each limit, or its keys of both kinds.
    sure = max((m for m in range(1, DELETED_FROM + 1) if allowed(m, similarity) <= DELETED), default=0)
    for kmer, low, high, salt in ((2, sure * similarity, MIDDLE / similarity, 1), (KMER, MIDDLE * similarity, np.inf, 0)):
        some = np.flatnonzero((sizes >= low) & (sizes <= high))
        if len(some):
            at = np.concatenate([[0], np.cumsum(sizes[some])])
            words = hashes[np.arange(at[-1]) + np.repeat(first[some] - at[:-1], sizes[some])]
            for i, keys in zip(some, sketches(words, at, kmer) + np.uint64(salt), strict=True):
                found[i].append(keys)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, dtype=np.uint64) for x in found]


def _binned(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of words, and of pairs of neighbouring words, in bins (texts x bins)."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    words = np.bincount(text * BINS + (hashes >> np.uint64(57)).astype(np.int64), minlength=len(sizes) * BINS)
    within = np.flatnonzero(text[1:] == text[:-1])
    pairs = np.bincount(text[within] * PAIR_BINS + (grams(hashes, 2)[within] >> np.uint64(55)).astype(np.int64), minlength=len(sizes) * PAIR_BINS)
    return np.minimum(np.concatenate([words.reshape(-1, BINS), pairs.reshape(-1, PAIR_BINS)], axis=1), 255).astype(np.uint8)


def word_lists(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """All words of each text, as 16 bits of their hashes, or their counts in bins of these."""
    some = (hashes >> np.uint64(48)).astype(np.uint16)
    texts = [some[x:z] for x, z in zip(first[:-1], first[1:], strict=True)]
    return [(w if len(w) <= LISTED else _folded(w)).tobytes() for w in texts]


def _folded(words: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount(words // (65536 // FOLDED), minlength=FOLDED), 65535).astype(np.uint16)


def word_counts(lists: list[bytes], n: np.ndarray) -> np.ndarray:
    """Counts of the words of texts of ``n`` words each (texts x words), from their lists; in fewer bins where there are too many."""
    words = [np.frombuffer(x, dtype=np.uint16) for x in lists]
    if (n > LISTED).any():
        return np.stack([w if k > LISTED else _folded(w) for w, k in zip(words, n, strict=True)])
    values, number = np.unique(np.concatenate(words), return_inverse=True)
    width = max(1, min(len(values), HELD // len(words)))
    out = np.zeros((len(words), width), dtype=np.uint16)
    np.add.at(out, (np.repeat(np.arange(len(words)), n), number % width), 1)
    return out


def near_words(counts: np.ndarray, at: np.ndarray, to: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the counts of words leave it open that the texts of a pair of places (at, to) are ``most`` edits apart."""
    total, step = counts.sum(axis=1, dtype=np.int64), max(1, COMPARED // counts.shape[1])
    keep = np.zeros(len(at), dtype=bool)
    for k in range(0, len(at), step):
        i, j = at[k:k + step], to[k:k + step]
        x, y = counts[i], counts[j]
        apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
        # The larger of both sums of differences is half of this.
        keep[k:k + step] = apart + np.abs(total[i] - total[j]) <= 2 * most[k:k + step]
    return keep


def _features(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _feature_rows(batches, similarity)

    return run


def _feature_rows(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, FEATURED) for b in batches for k in range(0, b.num_rows, FEATURED)):
        hashes, first = word_hashes(batch.column(1))
        sizes = np.diff(first)
        place = (np.arange(len(hashes)) - np.repeat(first[:-1], sizes)).astype(np.uint64)
        node = np.stack([_sums(mix(hashes ^ mix(place + np.uint64(s))), first) + sizes.astype(np.uint64) for s in (1, 1 << 40)], axis=1)
        bag = _binned(hashes, first)
        keys = all_keys(hashes, first, similarity)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array([x.tobytes() for x in node], pa.binary()), pa.array(sizes, pa.int64()),
            pa.array([x.tobytes() for x in bag], pa.binary()),
            pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64()))],
            names=["doc_id", "mark", "node", "n", "bag", "keys"])


# ---- verification

def _bags(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BINS + PAIR_BINS)


def bag_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the word edit distance from binned word counts."""
    d = a.astype(np.int64) - b.astype(np.int64)
    return np.maximum(np.where(d > 0, d, 0).sum(axis=-1), np.where(d < 0, -d, 0).sum(axis=-1))


def _diagonals(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance if at most ``band``: the farthest place on each diagonal for 0, 1, 2, ... edits."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    width = 2 * band + 1
    i = np.arange(n + 1)
    stops = []
    for k in range(-band, band + 1):  # places i where a[i] and b[i + k] differ or one of them ends
        j = i + k
        inside = (i < n) & (j >= 0) & (j < m)
        same = np.zeros(n + 1, dtype=bool)
        same[inside] = a[i[inside]] == b[j[inside]]
        stops.append(np.flatnonzero(~same) + (k + band) * (n + 1))
    stops = np.concatenate(stops)
    lane = np.arange(width)

    def slide(row: np.ndarray) -> np.ndarray:
        ok = (row >= 0) & (row <= n)
        out = row.copy()
        out[ok] = stops[np.searchsorted(stops, lane[ok] * (n + 1) + row[ok])] - lane[ok] * (n + 1)
        return out

    low = -(n + m + 5)
    far = np.full(width, low)
    far[band] = 0
    far = slide(far)
    goal = m - n + band
    for edits in range(band + 1):
        if edits:
            step = far + 1                                     # replace
            step[1:] = np.maximum(step[1:], far[:-1])          # insert
            step[:-1] = np.maximum(step[:-1], far[1:] + 1)     # delete
            k = lane - band
            step = np.where((step < 0) | (step + k < 0), low, np.minimum(step, np.minimum(n, m - k)))
            far = slide(np.where(step < 0, low, step))
        if far[goal] >= n:
            return edits
    return None


def _rows(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """The same by rows of a band of the table, whose differences from place to place are the bits of two numbers (Myers, Hyyrö).

    Bit k of row j stands for place j - band + k of the longer text.  A row costs some operations on numbers of as many bits as the band is wide.
    """
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    n, m = len(a), len(b)
    if n - m > band:
        return None
    band = min(band, n)
    full = (1 << (2 * band + 1)) - 1
    rise, fall = ((1 << (band + 1)) - 1) << band, 0
    corner, last = 1 << (2 * band), 1 << (2 * band)
    found, most = band, 2 * band + m - n
    step = max(64, min(MARKED, (1 << 28) // (2 * band + MARKED)))
    for s in range(0, m, step):
        block = b[s:s + step].tolist()
        marks = dict.fromkeys(block, 0)
        for place, word in enumerate(a[max(0, s - band):s + len(block) + band].tolist(), max(0, band - s)):
            if word in marks:
                marks[word] |= 1 << place
        for j, word in enumerate(block):
            same = marks[word] >> j & full
            kept = (((same & rise) + rise ^ rise) | same | fall) & full
            up, down = fall | full ^ (kept | rise), kept & rise
            if s + j < n - band:  # down the last diagonal of the band, then along the end of the longer text
                found += not kept & corner
            else:
                last >>= 1
                found += (up & last != 0) - (down & last != 0)
            if found > most:  # no more rows are left than would bring it back
                return None
            kept >>= 1
            rise, fall = down | full ^ (kept | up), kept & up
    return found if found <= band else None


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance, or None if it is more than ``most``; the band grows until it holds the alignment."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= most else None
    band = min(most, max(8, abs(len(a) - len(b))))
    while True:
        # Diagonals take work for each place of each, rows for each place and 64 of them.
        engine = _diagonals if band <= 16 and (2 * band + 1) * (len(a) + 1) <= 4_000_000 else _rows
        found = engine(a, b, band)
        if found is not None or band >= most:
            return found
        band = min(most, max(4 * band, 512))


def chained_distance(a: np.ndarray, b: np.ndarray, kmer: int = 5) -> int:
    """Cost of one alignment, so an upper bound of the edit distance: along k-mers that occur once in both texts.

    Of these, the ones in the same order on both sides are matched, and each is followed as far as the next one allows;
    what lies between costs the longer side.
    """
    if min(len(a), len(b)) < kmer:
        return max(len(a), len(b))
    single = []
    for words in (a, b):
        values, first, count = np.unique(grams(words, kmer)[:len(words) - kmer + 1], return_index=True, return_counts=True)
        single.append((values[count == 1], first[count == 1]))
    _, x, y = np.intersect1d(single[0][0], single[1][0], assume_unique=True, return_indices=True)
    i, j = single[0][1][x], single[1][1][y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if not len(i):
        return max(len(a), len(b))
    ordered = (j == np.maximum.accumulate(j)) & (j == np.minimum.accumulate(j[::-1])[::-1])
    i, j = i[ordered], j[ordered]
    if not len(i):
        return max(len(a), len(b))
    gap_a, gap_b = np.diff(np.append(i, len(a))) - 1, np.diff(np.append(j, len(b))) - 1
    followed = np.minimum(np.minimum(gap_a, gap_b), kmer - 1)
    return int(max(i[0], j[0]) + np.maximum(gap_a - followed, gap_b - followed).sum())


def pair_bound(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the word edit distance from pairs of neighbouring words: an edit changes two of them at most."""
    if min(len(a), len(b)) < 2:
        return 0
    x, y = grams(a, 2)[:-1], grams(b, 2)[:-1]
    words, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    ours, theirs = (np.bincount(k, minlength=len(words)) for k in (number[:len(x)], number[len(x):]))
    return -(-int(bag_bound(ours, theirs)) // 2)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the word edit similarity is high enough: bounds from both sides first, banded alignment for the rest."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    words, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    ours, theirs = (np.bincount(x, minlength=len(words)) for x in (number[:len(a)], number[len(a):]))
    if int(bag_bound(ours, theirs)) > most:
        return False
    if pair_bound(a, b) > most:
        return False
    return any(chained_distance(a, b, k) <= most for k in (5, 3)) or edit_distance(a, b, most) is not None


# ---- rounds

def _plausible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that lengths and binned counts don't rule out; as many Python tasks as the pairs need."""
    n = pairs.count()
    info = classes.select("node", "n", "bag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n1, n2 = (t.column(x).to_numpy() for x in ("n1", "n2"))
            b1, b2 = (_bags(t.column(x)) for x in ("bag1", "bag2"))
            most = ((1 - similarity) * np.maximum(n1, n2) + 1e-9).astype(np.int64)
            keep = pa.array((np.abs(n1 - n2) <= most) & (bag_bound(b1[:, :BINS], b2[:, :BINS]) <= most)
                            & (bag_bound(b1[:, BINS:], b2[:, BINS:]) <= 2 * most))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    both = (pairs.join(info.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bag").alias("bag1")), "a")
            .join(info.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bag").alias("bag2")), "b"))
    return dealt(both, n, 20_000).mapInArrow(run, "a binary, b binary")


def _candidate_texts(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``node, text, keys, bag, words`` of every class that shares a sketch, a text for each class.

    The one place where texts are shuffled, and always by a sort-merge join: they move once, in proportion to the input.
    """
    nodes = members.select("node").distinct()
    wanted = cut_lineage(classes.join(nodes, "node").select("node", "keys", F.col("one.mark").alias("want")), "near-wanted")
    texts = docs.join(wanted.hint("merge"), docs["mark"] == F.col("want")).select("node", "text", "keys").dropDuplicates(["node"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            hashes, first = word_hashes(t.column("text"))
            yield pa.RecordBatch.from_arrays([
                *t.columns, pa.array([x.tobytes() for x in _binned(hashes, first)], pa.binary()), pa.array(word_lists(hashes, first), pa.binary())],
                names=["node", "text", "keys", "bag", "words"])

    texts = cut_lineage(texts.mapInArrow(counted, "node binary, text string, keys array<long>, bag binary, words binary"), "near-texts")
    forget(wanted)
    return texts


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) linked by alignment, written out."""
    n = pairs.count()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (b.slice(k, ALIGNED) for b in batches for k in range(0, b.num_rows, ALIGNED)):
            h1, f1 = word_hashes(t.column("t1"))
            h2, f2 = word_hashes(t.column("t2"))
            keep = pa.array([similar(h1[f1[i]:f1[i + 1]], h2[f2[i]:f2[i + 1]], similarity) for i in range(t.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t1")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("t2")), "b").select("a", "b", "t1", "t2"))
    return cut_lineage(dealt(both, n, 200).mapInArrow(run, "a binary, b binary"), "near-links")


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, mark, node, root`` of every row of ``docs`` (doc_id, text, mark): its class and the root of its group."""
    features = cut_lineage(docs.select("doc_id", "text", "mark").mapInArrow(
        _features(similarity), "doc_id long, mark long, node binary, n long, bag binary, keys array<long>"), "near-features")
    classes = cut_lineage(features.groupBy("node").agg(
        F.min(F.struct("mark", "doc_id")).alias("one"), F.first("n").alias("n"), F.first("bag").alias("bag"),
        F.first("keys").alias("keys")), "near-classes")
    entries = classes.select("node", "n", F.explode("keys").alias("key"))
    centers = entries.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("z")).where("center <> z")
    centers = cut_lineage(centers.select("key", "center"), "near-centers")
    members = cut_lineage(entries.join(centers, "key").select("key", "node", "n", "center"), "near-members")
    # One pair a member first, with the smallest of its centers: it joins most copies, and pairs within a group need no test.
    pairs = members.where("node <> center").groupBy("node").agg(F.min("center").alias("b")).select(F.col("node").alias("a"), "b")
    texts = _candidate_texts(docs, classes, members)
    drawn = cut_lineage(pairs, "near-pairs")
    tested = dealt(cut_lineage(_plausible(dealt(drawn), classes, similarity), "near-plausible"))
    roots = _merged(dealt(_verified(tested, texts, similarity)), None)
    forget(centers)
    forget(drawn)
    forget(tested)
    low = 0.0
    for high in SHARES:
        known = cut_lineage(_known(members, roots), "near-known")
        due = cut_lineage(_open_pairs(known, texts, similarity, low, high), "near-open-pairs")
        merged = _merged(dealt(_verified(dealt(due), texts, similarity)), roots)
        roots, low = roots if merged is None else merged, high
        forget(known)
        forget(due)
    forget(members)
    forget(texts)
    rows = features.select("doc_id", "mark", "node")
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _merged(links: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """``node, root`` with the new links taken in; None if they join no two groups."""
    if roots is not None:
        root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        links = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct()
    links = dealt(cut_lineage(links, "near-joins"))
    if links.isEmpty():
        return None
    found = cut_lineage(components(links), "near-components")
    if roots is None:
        return found
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("moved")), "root", "left").select(
        "node", F.coalesce("moved", "root").alias("root"))
    return cut_lineage(moved.unionByName(found.join(roots, "node", "left_anti")), "near-roots")


def shared_keys(first: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether two members (members x members) have a key in common; ``keys[first[i]:first[i + 1]]`` are those of member i."""
    met = np.zeros((len(first) - 1, len(first) - 1), dtype=bool)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], np.repeat(np.arange(len(met)), np.diff(first))[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    some = np.flatnonzero(np.diff(at) > 1)
    for x, z in zip(at[some].tolist(), at[some + 1].tolist(), strict=True):
        met[owner[x:z, None], owner[x:z]] = True
    return met


def _cross(cell: tuple, similarity: float, low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of a cell's pairs to be looked at now, some at a time: in different groups, of near lengths, and of this round's share.

    A cell is ``side, n, name, root, earlier`` of its members: those of side 0 are paired with each other, those of 1 with those of 2.
    Members that have one of their ``earlier`` keys (first places, keys) in common meet in the sketch of that one, and are left out here.
    """
    side, n, name, root, earlier = cell
    allowed = (1 - similarity) * n + 1e-9
    rows, met = np.flatnonzero(side < 2), None
    step = max(1, AT_ONCE // len(n))
    for begin in range(0, len(rows), step):
        i = rows[begin:begin + step][:, None]
        j = np.arange(len(n))[None, :]
        fits = np.where(side[i] == 0, j > i, side[j] == 2) & (root[i] != root[j]).any(axis=-1)
        fits &= np.abs(n[i] - n[j]) <= np.maximum(allowed[i], allowed[j]).astype(np.int64)
        at, to = np.nonzero(fits)
        at = rows[begin:begin + step][at]
        drawn = (mix(name[at, 0] ^ name[to, 0]) >> np.uint64(32)).astype(np.float64) / (1 << 32)
        now = (drawn >= low) & (drawn < high)
        at, to = at[now], to[now]
        if len(at):
            met = shared_keys(*earlier) if met is None else met
            new = ~met[at, to]
            yield at[new], to[new]


def _near_bags(bag: np.ndarray, at: np.ndarray, to: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether binned counts leave it open that the texts of a pair of places (at, to) are ``most`` edits apart."""
    keep = np.arange(len(at))
    # The larger of both sums of differences is half of this; an edit changes one word, and two pairs of words at most.
    for part, factor in ((bag[:, :BINS], 1), (bag[:, BINS:], 2)):
        total, x, y = part.sum(axis=1, dtype=np.int64), part[at[keep]], part[to[keep]]
        apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
        keep = keep[apart + np.abs(total[at[keep]] - total[to[keep]]) <= 2 * factor * most[keep]]
    return keep


def _cells(known: DataFrame, similarity: float) -> DataFrame:
    """``key, low, i, high, j, side, node, root`` of the members of open sketches: blocks whose pairs are to be tested.

    A sketch of ``BLOCK`` members at most is one cell.  A larger one is cut into bands of lengths, a factor of the similarity apart,
    and these into blocks; two blocks of one band, or of neighbouring bands, are a cell.
    """
    sizes = known.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r"), F.max("root").alias("z"))
    sizes = cut_lineage(sizes.where("r <> z").select("key", "m"), "near-open")
    placed = cut_lineage(known.join(dealt(sizes), "key"), "near-placed")
    # A little wider than needed, so that rounding cannot part two lengths by more than a band.
    width = math.log(1 / min(max(similarity, 0.01), 0.99)) + 1e-6
    crowded = placed.where(F.col("m") > BLOCK).withColumn("band", F.floor(F.log("n") / F.lit(width)).cast("int"))
    parts = crowded.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    parts = dealt(cut_lineage(parts, "near-bands"))
    low = parts.select("key", F.col("band").alias("low"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    high = parts.select("key", F.col("band").alias("high"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    cells = low.join(high, "key").where("high = low and i <= j or high = low + 1")
    alone = F.expr("low = high and i = j")
    name = ["key", "low", "i", "high", "j"]
    ends = cells.select(*name, F.col("low").alias("band"), F.col("i").alias("part"), F.when(alone, 0).otherwise(1).alias("side")).unionAll(
        cells.where(~alone).select(*name, F.col("high").alias("band"), F.col("j").alias("part"), F.lit(2).alias("side")))
    dealt_out = crowded.join(parts, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    many = dealt_out.join(ends, ["key", "band", "part"]).select(*name, "side", "node", "n", "root")
    zero = [F.lit(0).alias(x) for x in (*name[1:], "side")]
    return placed.where(F.col("m") <= BLOCK).select("key", *zero, "node", "n", "root").unionAll(many)


def _known(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``key, node, n, root``: the members of each sketch and the groups they are in so far."""
    met = members.select("key", "node", "n")
    if roots is None:
        return met.withColumn("root", F.col("node"))
    return met.join(dealt(roots), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))


def _open_pairs(known: DataFrame, texts: DataFrame, similarity: float, low: float, high: float) -> DataFrame:
    """The pairs (a, b) of one sketch and different groups that the bounds leave, of a share of all pairs by their hash.

    Texts that share several sketches are a pair in the first of these only, by the order of their keys: each pair is tested once and is one row.
    """
    cells = _cells(known, similarity)
    earlier = F.slice("keys", F.lit(1), (F.array_position("keys", F.col("key")) - 1).cast("int")).alias("earlier")
    filled = cells.join(texts.select("node", "bag", "words", "keys"), "node").groupBy("key", "low", "i", "high", "j").agg(
        F.collect_list(F.struct("side", "n", "node", "root", "bag", "words", earlier)).alias("cell")).select("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            lists = t.column(0)
            first = lists.offsets.to_numpy()
            first, every = first - first[0], lists.flatten()
            for x, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                side, n, node, root, bag, words, before = (every.field(k).slice(x, z - x) for k in range(7))
                side, n = side.to_numpy(), n.to_numpy()
                name, group = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint64).reshape(-1, 2) for c in (node, root))
                offsets = before.offsets.to_numpy()
                bags = counts = None
                for at, to in _cross((side, n, name, group, (offsets - offsets[0], before.flatten().to_numpy())), similarity, low, high):
                    most = ((1 - similarity) * np.maximum(n[at], n[to]) + 1e-9).astype(np.int64)
                    bags = _bags(bag) if bags is None else bags
                    keep = _near_bags(bags, at, to, most)
                    at, to, most = at[keep], to[keep], most[keep]
                    if len(at):
                        counts = word_counts(words.to_pylist(), n) if counts is None else counts
                        near = near_words(counts, at, to, most)
                        yield pa.RecordBatch.from_arrays([node.take(pa.array(k[near])) for k in (at, to)], names=["x", "y"])

    return filled.mapInArrow(run, "x binary, y binary").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def group(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``doc_id, class_id, class_size, copies`` of every row: the smallest id of its group, the rows in it, and those with its very words.

    Null or empty texts, and texts without words, form one class and have no links.  Texts under four words link only to texts with the
    same words; very long ones are aligned by rows of a band.  Ties of ids go by hash.  Repeated rows and ids: a row each, in the class of their text.  Null ids stay null and name no class, unless
    the whole class has none.  Empty table: no rows.  Other columns are left alone.
    """
    ident = identified(docs).withColumn("mark", F.xxhash64("doc_id", "text"))
    rows = cut_lineage(_grouped(ident, similarity).select("doc_id", "node", "root"), "near-rows")
    nodes = rows.groupBy("node").agg(F.first("root").alias("root"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(nodes, "near-nodes")
    groups = cut_lineage(nodes.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size")), "near-groups")
    named = cut_lineage(nodes.join(groups, "root").select("node", "class_id", "class_size", "copies"), "near-named")
    return rows.join(named, "node").select("doc_id", "class_id", "class_size", "copies")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group, with all its columns: the one of smallest (doc_id, hash), a null id being smallest."""
    ident = identified(docs).withColumn("mark", F.xxhash64("doc_id", "text"))
    kept = _grouped(ident, similarity).groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select("k.mark")
    kept = cut_lineage(kept.distinct(), "near-kept")
    rows = docs.select(whole_row(docs), F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit(""))).alias("mark"))
    return rows.join(kept, "mark").dropDuplicates(["mark"]).select(*unpacked(docs.columns))


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", "class_id", "class_size", "copies")
