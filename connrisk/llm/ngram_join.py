"""N-gram Jaccard join with parity sketches.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches ``percent``.  Equal sets are one node (a *set id*, 64 bits over all
shingles), so exact copies are never paired with each other.

Method: XOR-hashing each shingle into a sketch makes the Hamming distance of
two sketches a lower bound of the size of the symmetric difference.  Linked
sets of sizes a <= b have a >= percent/100 * b and differ in at most
``d = (a + b) (100 - percent) / (100 + percent)`` shingles.  So:

1. Size bands: a set meets its larger partners in the bands from its own size
   up to 100/percent of it.  A band knows its largest d.
2. Pigeonhole: in a band shingles are dealt to more than d parts by hash; the
   part's sketch is the XOR of the 64-bit codes of its shingles.  Linked sets
   agree in at least ``parts - d`` parts, so they share a row (band, part, XOR).
   A part without shingles agrees with every other empty part and says
   nothing, so empty parts emit no row.  A set with ``parts - d`` empty parts
   or more could thereby lose a link, but only to another such set: these sets
   are dealt again with another seed, and those that stay so after ``SEEDS``
   deals emit their empty parts too.  No link is lost.
3. One shuffle by row key, sorted: streaming past each key gives every further
   set with the key's first one (its pivot).  Hot keys need no memory.
4. Pairs with a pivot are compared, first by the Hamming distance of their bit
   sketches, then exactly; components of these links are labelled.  Texts are
   read again only for the pairs that their sketches allow.  Keys that hold a
   component and sets outside of it get a second pivot for each of these: a
   set of the component, another one in every key, so that a set of a group
   of near copies meets as many of them as it has keys.
5. Only where a key holds sets of different components that were not compared
   yet, bit sketches are compared in blocks inside a task, each set outside
   the key's largest component against the others.  Partners that pass are
   compared exactly, the nearest first; links bring components together, and
   only what is still apart goes on to further partners, until none are left.
   Keys with many sets are dealt to pairs of blocks, so a task holds two
   blocks at most.  No pair inside a component is ever emitted.

Defined cases
-------------
* words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer
  words than a shingle is one shingle; null, empty or blank texts have no
  shingles, link with nothing and are their own component;
* repeated rows each come back, with one component if id and text are equal
  (``keep_one`` keeps or drops them alike); rows of one doc_id with different
  texts are judged each by its own text; null doc_id: takes no part in links,
  null component;
* ties: the smallest doc_id names the component; very long texts: whole;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm import textkernels as K
from connrisk.llm.common import collect_garbage, components, discard, spread_scan, start, texts, written

U64 = np.uint64
SEEDS = 6
#: Bit sketches have a power of two of bits, at least the number of shingles.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Sets that a task remembers to have dealt.
REMEMBERED = 200_000
#: Sets of one key that a task compares with as many others at once.
BLOCK = 2_000


class Bands:
    """Size bands of a threshold: the number of parts that each deals to, and
    the least number for the pigeonhole argument."""

    RATIO = 1.4

    def __init__(self, percent: int, largest: int = 1 << 27):
        self.percent = percent
        self.low, self.high, self.least, self.parts = [], [], [], []
        low = 1
        while low <= largest:
            high = max(low, int(low * self.RATIO))
            d = 2 * high * (100 - percent) // (100 + percent)
            least = parts = d + 1
            for _ in range(6):  # room for the empty parts that the band's smallest sets have
                empty = parts * np.exp(-low * percent / 100 / parts)
                parts = least + min(int(np.ceil(empty + np.sqrt(empty))), 2 * d) if empty > 0.02 else parts
            self.low.append(low)
            self.high.append(high)
            self.least.append(least)
            self.parts.append(parts)
            low = high + 1
        self.high_array = np.array(self.high)

    def of(self, size: int) -> range:
        """Bands in which a set of ``size`` meets sets as large or larger."""
        first = int(np.searchsorted(self.high_array, size))
        top = 100 * size // self.percent
        last = first
        while last + 1 < len(self.low) and self.low[last + 1] <= top:
            last += 1
        return range(first, last + 1)


def set_id(shingles: np.ndarray) -> int:
    """64 bits over a whole set, as a signed integer."""
    with np.errstate(over="ignore"):
        a = K.mix(shingles, 0xA5).sum(dtype=U64) + U64(len(shingles))
    return int(K.mix(np.array([a]), 0x77).astype(np.int64)[0])


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Parity of the shingles at each bit."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(len(shingles) - 1).bit_length()))
    count = np.bincount((K.mix(shingles, 0xB17) & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of 64-bit words folded to fewer: the sketch of fewer bits."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def part_rows(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """``(key, index of the set)`` rows of all sets that have shingles."""
    out_key, out_set = [], []
    # One entry for each set and band: dealt until it has no rest.
    todo = [(i, b) for i, s in enumerate(sets) if len(s) for b in bands.of(len(s))]
    for seed in range(SEEDS):
        if not todo:
            break
        index, band = np.array([i for i, _ in todo]), np.array([b for _, b in todo])
        parts = np.array([bands.parts[b] for _, b in todo])
        first = K.offsets_of(parts)
        sizes = np.array([len(sets[i]) for i, _ in todo])
        flat = np.concatenate([sets[i] for i, _ in todo])
        place = ((K.mix(flat, seed + 1) >> U64(32)) * np.repeat(parts.astype(U64), sizes)) >> U64(32)
        place = place.astype(np.int64) + np.repeat(first[:-1], sizes)
        xor = np.zeros(int(first[-1]), U64)
        np.bitwise_xor.at(xor, place, K.mix(flat, 0xC0DE + seed))
        filled = np.bincount(place, minlength=len(xor)) > 0
        owner = np.repeat(np.arange(len(todo)), parts)
        part = np.arange(len(xor)) - first[owner]
        label = (band[owner].astype(U64) << U64(36)) | (part.astype(U64) << U64(4)) | U64(seed)
        empties = np.bincount(owner[~filled], minlength=len(todo))
        sparse = empties > parts - np.array([bands.least[b] for _, b in todo])
        emit = filled if seed < SEEDS - 1 else filled | sparse[owner]
        out_key.append(K.mix(xor[emit] ^ K.mix(label[emit], 0x1ABE1)))
        out_set.append(index[owner[emit]])
        todo = [t for t, s in zip(todo, sparse.tolist(), strict=True) if s]
    if not out_key:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_set)


def _sets(batch: pa.RecordBatch, at: int, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    whole = texts(batch.column(at))
    for a, b in K.split_batches(whole):
        yield a, K.shingles(whole[a:b], k)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(key, sid)`` -> ``(key, pivot, sid)`` of keys with several sets."""
    key0 = sid0 = pivot0 = None
    for batch in batches:
        key, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        new[0] = (key[0], sid[0]) != (key0, sid0)
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        head[0] = key[0] != key0
        at = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
        pivot = np.where(at >= 0, sid[np.maximum(at, 0)], pivot0 if pivot0 is not None else 0)
        key0, sid0, pivot0 = key[-1], sid[-1], pivot[-1]
        out = new & ~head & (pivot != sid)
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(pivot[out]), pa.array(sid[out])], ["key", "pivot", "sid"])


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, text_md5, n, sid, sketch)``: the address of each document's text, the size of its set, the set's id and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, sketch = [], [], []
            for _, sets in _sets(batch, 2, k):
                n += [len(s) for s in sets]
                sid += [set_id(s) if len(s) else None for s in sets]
                sketch += [bit_sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sketch, pa.binary())],
                ["doc_id", "text_md5", "n", "sid", "sketch"])

    return spread_scan(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", F.md5("text").alias("text_md5"), "text") \
        .mapInArrow(run, "doc_id long, text_md5 string, n long, sid long, sketch binary")


def signature_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(key, sid)``: the parts of every set's sketch in all its bands, from a
    task once for each of the last ``REMEMBERED`` sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        done: set[int] = set()
        for batch in batches:
            for _, found in _sets(batch, 0, k):
                ids = {set_id(s): s for s in found if len(s)}
                fresh = [i for i in ids if i not in done]
                done = done if len(done) < REMEMBERED else set()
                done.update(fresh)
                sets = [ids[i] for i in fresh]
                key, owner = part_rows(sets, bands)
                sid = np.array(fresh, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(sid[owner])], ["key", "sid"])

    return spread_scan(docs.select("doc_id", "text")).where("doc_id is not null").select("text").mapInArrow(
        run, "key long, sid long")


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes and bit sketches allow a link."""
    left = sketches.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b").where(
        F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, sa, nb, sb = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for i in range(len(a)):
                x, y = np.frombuffer(sa[i], "<u8"), np.frombuffer(sb[i], "<u8")
                w = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum())
                keep.append(apart * (100 + percent) <= (na[i] + nb[i]) * (100 - percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _shingles_of(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``(sid, shingles)`` of the sets ``asked`` for, ``(sid, holder)``, from the texts of their holders."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid = batch.column(0).to_pylist()
            for a, sets in _sets(batch, 1, k):
                # A holder's other rows can have other texts.
                own = [i for i, s in enumerate(sets) if len(s) and set_id(s) == sid[a + i]]
                yield pa.RecordBatch.from_arrays([pa.array([sid[a + i] for i in own], pa.int64()),
                                                  pa.array([sets[i].tobytes() for i in own], pa.binary())], ["sid", "shingles"])

    texts_ = docs.select(F.col("doc_id").cast("long").alias("holder"), "text").join(asked, "holder").select("sid", "text")
    return texts_.mapInArrow(read, "sid long, shingles binary").dropDuplicates(["sid"])


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sets really reach the threshold, as a written table.

    Every step is a table of known size, so that few pairs take no shuffle of
    all texts or sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs)
    if not pairs.limit(1).count():
        return pairs
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid"))
    asked = written(nodes.select("sid", "holder").join(ids, "sid", "left_semi"))
    sets = written(_shingles_of(asked, docs, k))
    one = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    two = one.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    out = written(two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    discard(pairs, asked, sets)
    return out


def _merged(now: DataFrame, links: DataFrame) -> DataFrame:
    """``(sid, now)`` with the labels that ``links`` bring together made one: a written table instead of ``now``."""
    if not links.limit(1).count():
        return now
    ends = lambda c: now.select(F.col("sid").alias(c), F.col("now").alias("n" + c))
    bound = links.join(ends("a"), "a").join(ends("b"), "b").select("na", "nb")
    renamed = components(None, bound, node="now", src="na", dst="nb", out="new")
    after = written(now.join(renamed, "now", "left").select("sid", F.coalesce("new", "now").alias("now")))
    discard(now)
    return after


def _second_pivots(members: DataFrame, now: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a set ``a`` of a key's largest component, if that has
    several, and a set ``b`` of each of the key's other components."""
    pick = F.min(F.struct(F.xxhash64("key", "sid").alias("h"), "sid"))["sid"]
    heads = members.join(now, "sid").groupBy("key", "now").agg(F.count("*").alias("m"), pick.alias("sid"))
    largest = heads.groupBy("key").agg(F.count("*").alias("c"), F.max(F.struct("m", "sid")).alias("top")).where(
        "c > 1 and top.m > 1").select("key", F.col("top.sid").alias("a"))
    return heads.join(largest, "key").where("a <> sid").select("a", F.col("sid").alias("b")).distinct()


_PLACE = ["key", "i", "j"]
_FRAME = ["sid", "n", "label", "now", "side", "split", "sketch"]


def _cross(percent: int, low: int, high: int):
    """Of a key's sets in different components, the pairs that their sketches
    allow.  Each set outside the largest component has a list of such partners,
    nearest first; this gives out places ``low`` to ``high`` of the lists, less
    the pairs that links found since have brought together, and a row without
    pair if a list goes on."""

    def compare(sid, n, label, now, side, split, sketch) -> tuple[list, list, bool]:
        _, kept = np.unique(sid, return_index=True)
        sid, n, label, now, side, sketch = (x[kept] for x in (sid, n, label, now, side, sketch))
        raw = [np.frombuffer(s, "<u8") for s in sketch]
        width = min(map(len, raw))
        bits = np.array([fold(s, width) for s in raw])
        _, label, size = np.unique(label, return_inverse=True, return_counts=True)
        stray = label != np.argmax(size)
        more, a, b = False, [], []
        for i in np.flatnonzero(stray):
            other = (label != label[i]) & (~stray | (sid > sid[i]))
            if split[0]:
                other &= side != side[i]  # pairs inside a block meet in the block's own group
            if not (other & (now != now[i])).any():
                continue
            j = np.flatnonzero(other)
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            fits = (apart * (100 + percent) <= (n[j] + n[i]) * (100 - percent)) & (large * percent <= small * 100)
            j = j[fits][np.lexsort((sid[j[fits]], apart[fits]))]
            own = j[low:high]
            own = own[now[own] != now[i]]
            a += [int(sid[i])] * len(own)
            b += sid[own].tolist()
            more |= bool((now[j[high:]] != now[i]).any())
        return a, b, more

    def settle(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        """Whole groups, sorted by place."""
        key, i, j = columns[:3]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.append(np.flatnonzero(new), len(key))
        out: list[tuple] = []
        for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            a, b, more = compare(*(c[first:last] for c in columns[3:]))
            place = (int(key[first]), int(i[first]), int(j[first]))
            out += [(x, y, *place) for x, y in zip(a, b, strict=True)]
            if more:
                out.append((None, None, *place))
        cells = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["a", "b", *_PLACE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
                       for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            same = np.ones(len(columns[0]), bool)
            for c in columns[:3]:
                same &= c == c[-1]
            cut = int(np.argmax(same))  # where the last group begins
            if cut:
                yield settle([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None:
            yield settle(held)

    return run


def link_sets(docs: DataFrame, table: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between set ids that make the right components.

    ``table`` is ``set_table(docs)``.  Every pair of linked sets ends in one
    component; links inside a component that others already make are left out.
    """
    rows = signature_rows(docs, k, percent)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = written(rows.repartition(parts, "key").sortWithinPartitions("key", "sid").mapInArrow(
        _members, "key long, pivot long, sid long"))
    star = members.select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    collect_garbage(docs.sparkSession)  # lets go of the shuffled rows

    # The sets that share a key, each with one document that holds it.
    wanted = star.select(F.col("a").alias("sid")).unionByName(star.select(F.col("b").alias("sid"))).distinct()
    nodes = written(table.where("sid is not null and doc_id is not null").groupBy("sid").agg(
        F.min("doc_id").alias("holder"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(wanted, "sid", "left_semi"))
    sketches = nodes.select("sid", "n", "sketch")
    found = [_verify(_close(star, sketches, percent), nodes, docs, k, percent)]
    now = _merged(nodes.select("sid", F.col("sid").alias("now")), found[0])
    found.append(_verify(_close(_second_pivots(members, now), sketches, percent), nodes, docs, k, percent))
    now = _merged(now, found[1])

    # Keys that still hold several components among the sets that only met the pivots.
    labelled = members.join(now, "sid").select("key", "sid", F.col("now").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).where(
        "m > 1 and x <> y").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = labelled.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grouped = dealt.select("*", other.alias("with")).select(
        "key", "sid", "label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        F.col("block").alias("side"))
    # A block meets itself once (i = j) and each other block once (i < j).
    frame = written(grouped.join(sketches, "sid").select(
        *_PLACE, "sid", "n", "label", "side", (F.col("i") != F.col("j")).alias("split"), "sketch"))
    low, high = 0, 1
    while True:
        # Few bytes and much work in each group: dealt to all tasks, whatever the size.
        dealt = frame.join(now, "sid").repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE).select(*_PLACE, *_FRAME)
        out = written(dealt.mapInArrow(_cross(percent, low, high), "a long, b long, key long, i int, j int"))
        more = _verify(out.where("a is not null").select("a", "b").distinct(), nodes, docs, k, percent)
        found.append(more)
        rest = out.where("a is null").select(*_PLACE)
        if not rest.limit(1).count():
            break
        before, frame = frame, written(frame.join(rest, _PLACE, "left_semi"))
        discard(before, out)
        now = _merged(now, more)
        # After a round that found no link all that is left is likely to be compared anyway.
        low, high = high, (4 if more.limit(1).count() else 16) * high
    discard(members, nodes, frame, out, now)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, text_md5)``, one row for each document."""
    start(docs.sparkSession)
    table = written(set_table(docs, k))
    links = link_sets(docs, table, k, percent)
    labels = written(components(None, links, node="sid", src="a", dst="b", out="label"))
    known = table.join(labels, "sid", "left").select("doc_id", "text_md5", "n", F.coalesce("label", "sid").alias("label"))
    smallest = known.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    collect_garbage(docs.sparkSession)
    # A component with a third of all rows is a hot key on the left, which AQE splits; it is one row on the right.
    return known.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"), "text_md5")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the smallest doc_id."""
    dropped = written(join(docs, k, percent).where("component_id <> doc_id").select("doc_id", "text_md5").distinct())
    mark, key, text = (f"_{name}_{uuid.uuid4().hex}" for name in ("md5", "id", "other"))  # names that no column has
    gone = dropped.select(F.col("doc_id").alias(key), F.col("text_md5").alias(text))
    marked = docs.withColumn(mark, F.md5("text"))
    return marked.join(gone, (F.col("doc_id") == F.col(key)) & F.col(mark).eqNullSafe(F.col(text)), "left_anti").select(*docs.columns)
