"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity.

A line is normalised to its words: runs of ASCII letters (in lower case), digits and characters beyond
ASCII, so punctuation and white space only part words. Lines of equal words are one class: lines that
differ in a number are not, and only the edit similarity can make them repeats. Classes of FUZZY_WORDS
words or more (not counting mere numbers) have a SimHash that is cut into blocks of 64 bits, and every
distinct feature votes in one block only, named by its hash. A word that was changed, put in or left out
touches two blocks at most and leaves the others as they are (pigeonhole). The features of lines of less
than 32 words are their words:

* less than 8 words: a block for each. Keys: all blocks, and all but any one.
* less than 16 words: 5 blocks. Keys: any three of them, so one changed word always leaves a key.
* less than 32 words: 6 blocks. Keys: any two of them, so two changed words always leave a key.
* Either has blocks of a second choice, as a key may have too few words (of the 6 blocks, an even one with an odd one).

Those of longer lines are phrases, a word of LONG bytes or more with the shorter ones before it, so that
mere articles and the like are no feature; a changed word mostly touches two blocks as well:

* less than 32 phrases: 6 blocks. Keys: an even one with an odd one.
* more: 8 blocks, and twice as many for every doubling. Keys: 8 of them, each one.

A key has two words of LONG bytes or more, or LEAST phrases; of a line with less than LEAST such words,
LEAST words of any length. Lines near a bound,
by a tenth of their features or a fifth of their words, are posted on both sides. Lines that share a key are
candidates, whatever else they hold, and are
confirmed by the edit similarity of their normalised text, SIMILARITY or more. Of each connected group the
first line, by document id and place, stays, and the others go. Words are the unit of the blocks: lines
whose every other word has a changed letter share no key though their edit similarity may suffice.

A key's lines are tested with its first one, and after that with each other unless they are connected
already or their lengths alone rule out the similarity. A key of more than RUN lines is a group of near copies: its lines go through
linked_components(), which does not expand them into pairs and ends in blocks of bounded bytes. There the
64-bit SimHash of a whole line decides what is tested first, and, in the last blocks, what is tested at all
(FAR bits of difference; lines of similarity 0.8 differ in 13 on average).

Lines end at U+000A. Lines without a letter (blank ones and mere numbers) always stay. Nulls: a null text stays null
and has 0 lines; rows with a null id stay as they are. Rows of one id are one document: they lose the same lines. Other columns pass through.
Empty tables give empty results. Memory is bounded by a batch and the longest text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewstep.llm.graph import components
from fewstep.llm.hashing import blocks, bounded_batches, mixed, words
from fewstep.llm.linkjoin import family_blocks, linked_components
from fewstep.plans.storage import Scratch
from fewstep.sources.tables import table

#: Lines of a key that are tested pair by pair.
RUN = 32
FUZZY_WORDS = 5
SIMILARITY = 0.8
#: Bytes of a word that ends a phrase; features that a key has at least; words from which on phrases are the features.
LONG, LEAST, MANY = 4, 3, 32
#: For each kind of line (the binary logarithm of the number of features): how many blocks, which of them make a key, and the bit of a feature's hash from which on it names the block.
_THREE, _ODD = list(combinations(range(5), 3)), [(even, odd) for even in (0, 2, 4) for odd in (1, 3, 5)]
_WORD_KEYS = {3: [(5, _THREE, 32), (5, _THREE, 8)], 4: [(6, list(combinations(range(6), 2)), 32), (6, _ODD, 8)]}
_PHRASE_KEYS = {3: [(5, _THREE, 32)], 4: [(6, _ODD, 32)], 5: [(8, [(k,) for k in range(8)], 32)]}
#: Lines in a block of a last family, and code points (about): its pairs are told apart by edit similarity, whose work grows with the square of the length, so a task has few.
BLOCK_LINES, BLOCK_POINTS = 512, 1 << 17
#: Classes whose keys a task remembers to have posted.
POSTED = 1 << 18
#: Bits in which the whole SimHashes of two lines of a last block may differ.
FAR = 24
#: Steps of a key's length part for a doubling of the length.
STEPS = 128
#: Parts of the keys for each shuffle partition, keys that are dealt out to them at once, and keys of a part from which on those of near copies are handed on early.
PARTS, DEALT, HELD = 4, 1 << 19, 1 << 22
#: Bytes up to which what stands between equal words is compared by itself.
GAP = 48
#: Edit matrices that are computed side by side, bytes of their tables, 64-bit words of a column at most, and matrices from which on that is quicker, for each such word.
SIDE, SIDE_BYTES, COLUMN, WORTH = 4096, 16 << 20, 16, 24

_LETTER = np.array([b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)], dtype=np.uint8)
_TO_WORDS = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BLANK = np.array([b == 32 for b in range(256)])
#: The bits of a byte, each in a byte of its own.
_SPREAD = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a line's number (a text has less than 2 GB) and of a feature's hash in one number.
_LINE_BITS, _HASH_BITS, _ONE = np.uint64(28), np.uint64(36), np.uint64(1)
_HASH_MASK = (_ONE << _HASH_BITS) - _ONE


def normalised(line: bytes) -> bytes:
    return b" ".join(line.translate(_TO_WORDS).split())


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each group of hashes; first: where the groups begin. Groups of more than 255 are summed in parts."""
    if not len(first):
        return np.empty(0, np.uint64)
    sizes = np.diff(np.append(first, len(hashes)))
    group = np.repeat(np.arange(len(first)), -(-sizes // 255))
    parts = np.arange(len(group)) - np.repeat(np.searchsorted(group, np.arange(len(first))), -(-sizes // 255))
    cuts = first[group] + 255 * parts
    sums = np.zeros((len(hashes) + 1, 8), dtype=np.uint64)
    np.cumsum(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], axis=0, dtype=np.uint64, out=sums[1:])
    counts = (sums[np.append(cuts[1:], len(hashes))] - sums[cuts]).view(np.uint8).reshape(-1, 64)
    if len(cuts) > len(first):
        counts = np.add.reduceat(counts, np.flatnonzero(parts == 0), axis=0, dtype=np.int64)
    return np.packbits(counts > (sizes // 2)[:, None], axis=1).view(np.uint64).ravel()


def phrases(hashes: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the phrases of lines, and where each line's begin. hashes, sizes: of the words; first: where each line begins."""
    ends = sizes >= LONG
    ends[np.append(first[1:], len(hashes)) - 1] = True
    begins = np.concatenate(([True], ends[:-1]))
    cuts = np.flatnonzero(begins)
    place = np.arange(len(hashes)) - np.repeat(cuts, np.diff(np.append(cuts, len(hashes))))
    return mixed(np.add.reduceat(mixed(hashes + (place + 1).astype(np.uint64) * _STEP), cuts)), np.searchsorted(cuts, first)


def block_keys(hashes: np.ndarray, long: np.ndarray, first: np.ndarray, sizes: np.ndarray, kinds: dict, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of lines, given the hashes of their features and which of them are long: line and key (64 bits) of each."""
    last = max(kinds)
    kind = np.clip(np.log2(np.maximum(sizes, 1)).astype(np.int64), 2, 40 if last > 4 else last)
    lower = np.flatnonzero((kind > 2) & (9 * sizes < 10 * (1 << kind)))
    line = np.concatenate((np.arange(len(first)), lower))
    kind = np.concatenate((kind, kind[lower] - 1))
    n, lines, keys = sizes[line], [], []

    def post(which, part, value):
        lines.append(line[which])
        keys.append(mixed(value * _STEP + (kind[which] * 64 + part).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))

    def features(which):
        ends = np.cumsum(n[which])
        at = np.arange(ends[-1]) + np.repeat(first[line[which]] - (ends - n[which]), n[which])
        return np.repeat(np.arange(len(which)), n[which]), at, ends - n[which]

    short = np.flatnonzero((kind == 2) & (n > 0))
    if len(short):
        who, at, begins = features(short)
        each = mixed(hashes[at] * _STEP)
        total = np.add.reduceat(each, begins)
        post(short, 0, total)
        post(short[who], 0, total[who] - each)
    held = None
    for level, (blocks_of, choices, bit) in [(level, way) for level, ways in kinds.items() for way in ways]:
        own = np.flatnonzero((kind >= level) if level == last else (kind == level))
        if not len(own):
            continue
        if held is None or held[0] != level:
            who, at, begins = features(own)
            needs = np.where(np.add.reduceat(long[at].astype(np.int64), begins) >= LEAST, least, 0)
            # distinct features: a number holds the line, the first bits of the feature's hash and whether it is long
            packed = (who.astype(np.uint64) << _HASH_BITS) | ((hashes[at] >> (_LINE_BITS - _ONE)) & ~_ONE & _HASH_MASK) | long[at]
            packed.sort()
            packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
            held = level, (packed >> _HASH_BITS).astype(np.int64), mixed(packed & _HASH_MASK & ~_ONE), (packed & _ONE).astype(np.int64)
        _, who, h, is_long = held
        number = (blocks_of << (kind[own] - level)).astype(np.uint64)
        block = (h >> np.uint64(bit)) % number[who]
        sims, counts, longs = np.zeros((len(own), blocks_of), np.uint64), np.zeros((len(own), blocks_of), np.int64), np.zeros((len(own), blocks_of), np.int64)
        for k in range(blocks_of):
            mine = np.flatnonzero(block == k)
            if not len(mine):
                continue
            owner = who[mine]
            cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sims[owner[cuts], k] = simhash(h[mine], cuts)
            counts[owner[cuts], k] = np.diff(np.append(cuts, len(owner)))
            longs[owner[cuts], k] = np.add.reduceat(is_long[mine], cuts)
        for part, chosen in enumerate(choices):
            enough = np.where(needs > 0, longs[:, chosen].sum(axis=1) >= needs, counts[:, chosen].sum(axis=1) >= LEAST)
            full = np.flatnonzero(enough)
            value = np.zeros(len(full), np.uint64)
            for c in chosen:
                value = mixed(value * _STEP + sims[full, c])
            post(own[full], part + bit, value)
    return np.concatenate(lines) if lines else np.empty(0, np.int64), np.concatenate(keys) if keys else np.empty(0, np.uint64)


def scan(texts: list[bytes], posted: set[int] | None = None) -> Iterator[dict[str, np.ndarray]]:
    """For the lines with a letter: doc (place in texts), pos (from 0), id (hash of the words), size (code points, normalised); key_line and key.

    Classes in posted have no keys; those that get some are added to it, and it is emptied at POSTED.
    """
    posted = set() if posted is None else posted
    for at, block in blocks(texts):
        raw = b"\n".join(block)
        low = raw.translate(_TO_WORDS)
        hashes, starts, ends = words(low, _BLANK)
        if not len(starts):
            continue
        breaks = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
        first = np.unique(np.concatenate(([0], np.searchsorted(starts, breaks))))
        first = first[first < len(starts)]
        sizes = np.diff(np.append(first, len(starts)))
        text = np.frombuffer(low, dtype=np.uint8)
        lettered = np.add.reduceat((np.maximum.reduceat(_LETTER[text], starts) > 0).astype(np.int64), first)
        points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80, dtype=np.int64 if len(text) > 1 << 31 else np.int32)))
        size = np.add.reduceat((points[ends] - points[starts]).astype(np.int64), first) + sizes - 1
        del points
        place = np.arange(len(starts)) - np.repeat(first, sizes)
        ids = mixed(np.add.reduceat(mixed(hashes + (place + 1).astype(np.uint64) * _STEP), first) + sizes.astype(np.uint64))
        line = np.searchsorted(breaks, starts[first])
        doc_starts = np.cumsum([0] + [len(t) + 1 for t in block])
        doc = np.searchsorted(doc_starts, starts[first], side="right") - 1
        pos = line - np.searchsorted(breaks, doc_starts[:-1])[doc]
        # a class is posted once by each task, unless that task has met POSTED others since
        fuzzy = np.flatnonzero(lettered >= FUZZY_WORDS)
        fuzzy = fuzzy[np.sort(np.unique(ids[fuzzy], return_index=True)[1])]
        said = ids[fuzzy].tolist()
        fuzzy = fuzzy[np.array([i not in posted for i in said], dtype=bool)]
        if len(posted) >= POSTED:
            posted.clear()
        posted.update(said)
        few, many = fuzzy[sizes[fuzzy] < MANY * 5 // 4], fuzzy[sizes[fuzzy] >= MANY * 4 // 5]
        word_line, word_key = block_keys(mixed(hashes), ends - starts >= LONG, first[few], sizes[few], _WORD_KEYS, 2)
        said, begins = phrases(hashes, ends - starts, first)
        times = np.diff(np.append(begins, len(said)))
        key_line, key = block_keys(said, np.ones(len(said), bool), begins[many], times[many], _PHRASE_KEYS, LEAST)
        key_line, key = np.concatenate((few[word_line], many[key_line])), np.concatenate((word_key, key))
        length = np.floor(np.log2(np.maximum(size, 1)) * STEPS).astype(np.uint64)
        key = (key << np.uint64(12)) | (length[key_line] & np.uint64(4095))
        kept = np.flatnonzero(lettered > 0)
        number = np.cumsum(lettered > 0) - 1
        yield {"doc": doc[kept] + at, "pos": pos[kept], "id": ids.view(np.int64)[kept], "size": size[kept], "key_line": number[key_line], "key": key.view(np.int64)}


_LINES = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()), ("keys", pa.binary())])


def _binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """data cut at offsets (in bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    posted: set[int] = set()
    for batch in batches:
        doc_ids = batch.column("doc_id").to_numpy()
        for part in scan(batch.column("text").cast(pa.large_binary()).to_pylist(), posted):
            n = len(part["id"])
            order = np.argsort(part["key_line"], kind="stable")
            offsets, keys = np.searchsorted(part["key_line"][order], np.arange(n + 1)), part["key"][order]
            columns = [doc_ids[part["doc"]], part["pos"].astype(np.int32), part["id"]]
            for k in range(0, n, DEALT):  # a text of very many lines in pieces, as a column has less than 2 GB
                cut = offsets[k : k + DEALT + 1]
                own = _binaries(8 * (cut - cut[0]), keys[cut[0] : cut[-1]])
                yield pa.RecordBatch.from_arrays([*(pa.array(c[k : k + DEALT]) for c in columns), own], schema=_LINES)


def line_table(docs: DataFrame) -> DataFrame:
    """A row for each line with a letter, of documents with an id; keys: of the lines that may be near copies, 8 bytes each."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_lines, "doc_id long, pos int, id long, keys binary")


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """part, rows: the keys of a part and their lines' ids, 16 bytes for both."""
    held, size = [], 0

    def dealt():
        key, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (key.view(np.uint64) >> np.uint64(12)) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        rows = np.stack((key[order], ids[order]), axis=1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part[cuts].astype(np.int32)), "rows": _binaries(16 * np.append(cuts, len(key)), rows)})

    for batch in batches:
        ids, keys = batch.column("id").to_numpy(), batch.column("keys")
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1]
        if len(ids) == 0 or offsets[-1] == offsets[0]:
            continue
        key, ids = np.frombuffer(keys.buffers()[2][offsets[0] : offsets[-1]], np.int64), np.repeat(ids, np.diff(offsets) // 8)
        for k in range(0, len(key), DEALT):
            held.append((key[k : k + DEALT], ids[k : k + DEALT]))
            size += len(held[-1][0])
            if size >= DEALT:
                yield from dealt()
                held, size = [], 0
    if held:
        yield from dealt()


def posted(lines: DataFrame) -> DataFrame:
    """part, rows: the keys of all lines, a few rows for each part; all keys of a part stand together."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("id", "keys").mapInArrow(lambda batches: _dealt(batches, PARTS * n), "part int, rows binary")
    return rows.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part")


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, wanted in zip(batch.column("text").cast(pa.large_binary()), batch.column("wanted").to_pylist(), strict=True):
            lines = text.as_py().split(b"\n")
            found = [normalised(lines[w["pos"]]).decode() for w in wanted]
            yield pa.RecordBatch.from_pydict({"id": pa.array([w["id"] for w in wanted], pa.int64()), "line": pa.array(found, pa.string())})


_PAIRS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.bool_())])


def _shared(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of keys that have several, sorted by key and id; each once, as a class may be posted by several tasks."""
    order = np.argsort(key)
    group = key[order] >> 12
    twice = group[1:] == group[:-1]
    some = order[np.concatenate(([False], twice)) | np.concatenate((twice, [False]))]
    key, ids = key[some], ids[some]
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))[: len(key)]
    return key[new], ids[new]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, a, b, first (a is the key's first): pairs of a key whose lengths allow a link; key, a and null for the lines of a long run.

    Rows come sorted by part: what comes out does not depend on the order in a part. Of a part with more than HELD keys
    no more than RUN + 1 lines of a key wait for the part's end, and its lone keys.
    """
    limit = STEPS * np.log2(1 / SIMILARITY) + 1

    def told(key, a, b, long, at_first=None):
        b = pa.array(b, mask=np.ones(len(a), bool)) if long else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), b, pa.array(np.zeros(len(a), bool) if at_first is None else at_first)], schema=_PAIRS)

    def runs(key, ids):
        group, size = key >> 12, key & 4095
        at_first = np.concatenate(([True], group[1:] != group[:-1]))
        n = np.diff(np.append(np.flatnonzero(at_first), len(group)))
        n = np.repeat(n, n)
        if (long := n > RUN).any():
            yield told(group[long], ids[long], ids[long], True)
        for d in range(1, min(RUN, int(n.max()))):
            lo = np.flatnonzero((group[d:] == group[:-d]) & ~long[d:])
            lo = lo[np.abs(size[lo] - size[lo + d]) <= limit]
            if len(lo):
                yield told(group[lo], ids[lo], ids[lo + d], False, at_first[lo])

    def fewer(key, ids):
        """What still has to wait, and the lines of long runs that need not."""
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
        key, ids = key[new], ids[new]
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] >> 12) != (key[:-1] >> 12))))
        extra = np.arange(len(key)) - np.repeat(cuts, np.diff(np.append(cuts, len(key)))) > RUN
        return (key[~extra], ids[~extra]), (key[extra] >> 12, ids[extra])

    part, held, size, most = None, [], 0, HELD

    def ended():
        if held:
            key, ids = _shared(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(key):
                yield from runs(key, ids)

    for batch in batches:
        for own, rows in zip(batch.column("part").to_pylist(), batch.column("rows"), strict=True):
            if own != part:
                yield from ended()
                part, held, size, most = own, [], 0, HELD
            rows = np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, 2)
            held.append((rows[:, 0], rows[:, 1]))
            size += len(rows)
            if size > most:
                rest, early = fewer(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [rest], len(rest[0])
                most = max(HELD, 2 * size)
                if len(early[0]):
                    yield told(*early, early[1], True)
    yield from ended()


def _gaps(x: list[str], y: list[str]) -> Iterator[tuple[str, str]]:
    """What stands between the words that x and y have in common, by the longest row of words that both have once, in either's order."""
    once, other = {}, {}
    for of, words_ in ((once, x), (other, y)):
        for i, w in enumerate(words_):
            of[w] = -1 if w in of else i
    ends: list[int] = []  # the smallest last place of a row of each length, and what comes before a place in its row
    rows: list[tuple] = []
    for w, i in once.items():
        if i >= 0 and (j := other.get(w, -1)) >= 0:
            k = bisect_left(ends, j)
            step = (i, j, rows[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                rows.append(step)
            else:
                ends[k], rows[k] = j, step
    row, hi, hj = rows[-1] if rows else None, len(x), len(y)
    while True:
        i, j, row = row if row else (-1, -1, None)
        lo, lj = i + 1, j + 1
        a, b = hi, hj
        while a > lo and b > lj and x[a - 1] == y[b - 1]:
            a, b = a - 1, b - 1
        while lo < a and lj < b and x[lo] == y[lj]:
            lo, lj = lo + 1, lj + 1
        if lo < a or lj < b:
            yield "".join([w + " " for w in x[lo:a]]), "".join([w + " " for w in y[lj:b]])
        if i < 0:
            return
        hi, hj = i, j


def _upper(x: str, y: str, most: int) -> bool:
    """Whether an alignment by words already stays within most edits."""
    gaps = list(_gaps(x.split(" "), y.split(" ")))
    cost = sum(max(len(a), len(b)) for a, b in gaps)
    if cost <= most:
        return True
    for a, b in gaps:  # exactly, where both have something that is short
        if a and b and min(len(a), len(b)) <= GAP:
            cost += _distance(a, b) - max(len(a), len(b))
            if cost <= most:
                return True
    return False


def _distance(x: str, y: str, most: int | None = None) -> int:
    """The edit distance, or a number above most: the columns of the edit matrix as bits of whole numbers, differences between neighbouring cells."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    top, full = 1 << (len(x) - 1), (1 << len(x)) - 1
    up, down, far, left = full, 0, len(x), len(y)
    for c in y:
        same = at.get(c, 0)
        flat = (((same & up) + up) ^ up) | same | down
        more, less = down | (full & ~(flat | up)), up & flat
        far += bool(more & top) - bool(less & top)
        left -= 1
        if most is not None and far - left > most:
            return far - left
        more, less = (more << 1) | 1, less << 1
        held = same | down
        up, down = full & (less | ~(held | more)), more & held & full
    return far


def _begun(x: str, y: str) -> tuple[bool | None, str, str, int]:
    """Whether x and y are similar, if that is plain; what of them differs, and how many edits it may need."""
    most = int(max(len(x), len(y)) * (1 - SIMILARITY) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False, x, y, most
    for _ in range(2):  # what both begin with, and what both end with, costs nothing
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        x, y = x[lo:][::-1], y[lo:][::-1]
    if max(len(x), len(y)) <= most:
        return True, x, y, most
    return (None if x and y else False), x, y, most


def similar(x: str, y: str) -> bool:
    """Whether the edit distance is at most the part 1 - SIMILARITY of the longer text."""
    known, x, y, most = _begun(x, y)
    return known if known is not None else _upper(x, y, most) or _distance(x, y, most) <= most


def _matrices(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """Whether x and y are within most edits, for many pairs at once. All xs take as many words of 64 bits; the longest of ys comes first."""
    m, n = (np.array([len(t) for t in side]) for side in (xs, ys))
    tall, pairs, one, last = -(-len(xs[0]) // 64), len(xs), np.uint64(1), np.uint64(63)
    x, y = (np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (xs, ys))
    seen = np.zeros(int(max(x.max(), y.max())) + 1, dtype=np.bool_)
    seen[x] = seen[y] = True
    code = np.cumsum(seen) - 1
    kinds = int(code[-1]) + 1
    if pairs > 1 and pairs * max(8 * tall * kinds, 4 * int(n[0])) > SIDE_BYTES:
        half = pairs // 2
        return np.concatenate([_matrices(xs[at], ys[at], most[at]) for at in (slice(half), slice(half, pairs))])

    def places(sizes):
        return np.repeat(np.arange(pairs), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    table = np.zeros(tall * pairs * kinds, dtype=np.uint64)  # for each word of a column, pair and letter: where x has it
    own, at = places(m)
    np.bitwise_or.at(table, (at >> 6) * (pairs * kinds) + own * kinds + code[x], one << (at & 63).astype(np.uint64))
    table = table.reshape(tall, -1)
    columns = np.zeros((int(n[0]), pairs), dtype=np.int32)
    own, at = places(n)
    columns[at, own] = own * kinds + code[y]
    up, down = np.full((tall, pairs), ~np.uint64(0)), np.zeros((tall, pairs), dtype=np.uint64)
    who, far, top, out = np.arange(pairs), m.copy(), (m - 1).astype(np.uint64) & last, np.zeros(pairs, dtype=np.bool_)
    for j in range(int(n[0])):
        if n[-1] <= j:  # these are done
            live = int(np.searchsorted(-n, -j))
            out[who[live:]] = far[live:] <= most[live:]
            if not live:
                return out
            who, far, top, n, most, columns, up, down = who[:live], far[:live], top[:live], n[:live], most[:live], columns[:, :live], up[:, :live], down[:, :live]
        more_in, less_in = one, np.uint64(0)  # what the words of a column hand on
        for k in range(tall):
            same, plus, minus = table[k].take(columns[j]), up[k], down[k]
            held = same | minus
            same |= less_in
            flat = (((same & plus) + plus) ^ plus) | same
            more, less = minus | ~(flat | plus), plus & flat
            if k == tall - 1:
                far = far + ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64)
            more_out, less_out = more >> last, less >> last
            more, less = (more << one) | more_in, (less << one) | less_in
            up[k], down[k] = less | ~(held | more), more & held
            more_in, less_in = more_out, less_out
        if j % 16 == 15:
            may = far - (n - j - 1) <= most
            if 4 * np.count_nonzero(may) < 3 * len(may):
                if not may.any():
                    return out
                who, far, top, n, most, columns, up, down = who[may], far[may], top[may], n[may], most[may], columns[:, may], up[:, may], down[:, may]
    out[who] = far <= most
    return out


def all_similar(xs: list[str], ys: list[str]) -> np.ndarray:
    """similar() of each x with its y."""
    out, waiting = np.zeros(len(xs), dtype=np.bool_), {}
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        known, x, y, most = _begun(x, y)
        if known is None and not (known := _upper(x, y, most)):
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            waiting.setdefault(-(-len(x) // 64), []).append((k, x, y, most))
        else:
            out[k] = known
    for tall, pairs in waiting.items():
        if tall > COLUMN or len(pairs) < WORTH * tall:
            for k, x, y, most in pairs:
                out[k] = _distance(x, y, most) <= most
            continue
        pairs.sort(key=lambda p: -len(p[2]))
        for at in range(0, len(pairs), SIDE):
            of, x, y, most = zip(*pairs[at : at + SIDE], strict=True)
            out[list(of)] = _matrices(x, y, np.array(most))
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = all_similar(batch.column("x").to_pylist(), batch.column("y").to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SimHash of each whole line, and its size in code points."""
    for batch in batches:
        texts, sims = batch.column("line").cast(pa.large_binary()).to_pylist(), []
        for _, block in blocks(texts):
            begins = np.cumsum([0] + [len(t) + 1 for t in block[:-1]])
            hashes, starts, _ = words(b"\n".join(block).translate(_TO_WORDS), _BLANK)
            sims.append(simhash(hashes, np.searchsorted(starts, begins)))
        sizes = pc.cast(pc.utf8_length(batch.column("line")), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(sims).view(np.int64)), sizes], names=["id", "sim", "size"])


def _block_links(own, other, same: bool) -> list[tuple[int, int]]:
    """The links between two blocks of a family that connect two components."""
    found, root = [], {}

    def top(c):
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    size, sims, ids, comps, texts = (other[c].to_numpy() for c in ("size", "sim", "id", "component", "line"))
    waiting: list[tuple] = []

    def test():
        fine = all_similar([w[4] for w in waiting], [w[5] for w in waiting])
        for (i, c, j, d, _, _), yes in zip(waiting, fine.tolist(), strict=True):
            if yes and (a := top(c)) != (b := top(d)):
                root[max(a, b)] = min(a, b)
                found.append((int(i), int(j)))
        waiting.clear()

    for k, (i, c, n, sim, line) in enumerate(zip(own["id"], own["component"], own["size"], own["sim"], own["line"], strict=True)):
        near = (np.abs(size - n) <= np.floor(np.maximum(size, n) * (1 - SIMILARITY) + 1e-9)) & (comps != c)
        near &= np.bitwise_count(sims ^ np.int64(sim)) <= FAR
        if same:
            near[: k + 1] = False
        waiting.extend((i, c, ids[m], comps[m], line, texts[m]) for m in np.flatnonzero(near) if top(c) != top(comps[m]))
        if len(waiting) >= SIDE // 4:
            test()
    test()
    return found


def distance(p: str, q: str) -> F.Column:
    return F.bit_count(F.col(p + "sim").bitwiseXOR(F.col(q + "sim")))


def _close(p: str, q: str) -> F.Column:
    longest = F.greatest(F.col(p + "size"), F.col(q + "size"))
    return F.abs(F.col(p + "size") - F.col(q + "size")) <= F.floor(longest * F.lit(1 - SIMILARITY) + F.lit(1e-9))


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, pos: the lines that go."""
    bounded_batches(docs.sparkSession)
    lines = scratch.stash(line_table(docs))
    same = scratch.stash(lines.groupBy("id").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("times")))
    # lines of one key must stand together whatever their lengths: a key's last 12 bits are the length, and the others name its part
    near = scratch.stash(posted(lines).mapInArrow(_near, "key long, a long, b long, first boolean"))
    pairs = near.where("b IS NOT NULL").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("first").alias("first"))
    pairs = scratch.stash(pairs)
    long = near.where("b IS NULL").select("key", F.col("a").alias("id")).distinct()

    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct()
    wanted = wanted.join(same, "id").groupBy("first.doc_id").agg(F.collect_list(F.struct("id", "first.pos")).alias("wanted"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(wanted, "doc_id").select("text", "wanted")
    texts = scratch.stash(texts.mapInArrow(_line_texts, "id long, line string").dropDuplicates(["id"]))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.where(_close_texts()).select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long")

    links = scratch.stash(verify(pairs.where("first").drop("first")))
    found = scratch.stash(components(links, scratch))
    for c in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(c), F.col("component").alias("in_" + c)), c, "left")
    links = links.unionByName(scratch.stash(verify(pairs.where("NOT first AND coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b"))))
    if not long.isEmpty():
        members = scratch.stash(long.join(texts.mapInArrow(_whole, "id long, sim long, size int"), "id"))
        grouped = linked_components(members, _close, distance, verify, scratch, finish=lambda live: family_blocks(live, ["size", "sim"], texts, "size", _block_links, scratch, BLOCK_LINES, BLOCK_POINTS))
        links = links.unionByName(grouped.select(F.col("id").alias("a"), F.col("component").alias("b")))
    found = scratch.stash(components(links, scratch))
    joined = same.select("id", "first", "times").join(found, "id", "left").where("times > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "id"))
    groups = joined.groupBy("component").agg(F.min("first").alias("stays"))
    several = joined.select("id", "component").join(groups, "component").select("id", "stays")
    out = lines.select("doc_id", "pos", "id").join(several, "id").where(F.struct("doc_id", "pos") != F.col("stays"))
    out = scratch.stash(out.select("doc_id", "pos").distinct())
    scratch.drop(lines, same, near, texts, found)
    return out


def _close_texts() -> F.Column:
    longest = F.greatest(F.length("x"), F.length("y"))
    return F.abs(F.length("x") - F.length("y")) <= F.floor(longest * F.lit(1 - SIMILARITY) + F.lit(1e-9))


def dedup_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs without the repeated lines, plus n_lines and n_dropped; a text that loses all lines is empty."""
    scratch = scratch or Scratch(docs.sparkSession, "linededup")
    gone = repeats(docs.select("doc_id", "text"), scratch).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("_gone"))
    # a byte for each line up to the last one that goes: 1 for those that go
    gaps = F.transform(F.col("_gone"), lambda x, k: F.concat(F.repeat(F.lit("0"), x - F.when(k == 0, F.lit(0)).otherwise(F.get("_gone", k - 1) + 1)), F.lit("1")))
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.size("_gone").alias("_times"), F.array_join(gaps, "").cast("binary").alias("_mask"))
    docs = docs.drop("n_lines", "n_dropped")
    out = docs.join(gone, F.col("doc_id").cast("long") == F.col("_doc_id"), "left")
    kept = F.expr("array_join(filter(split(text, '\n', -1), (x, i) -> substring(_mask, i + 1, 1) <> X'31'), '\n')")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    out = out.withColumn("n_lines", lines.cast("long")).withColumn("n_dropped", F.coalesce("_times", F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col("_mask").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns, "n_lines", "n_dropped")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
