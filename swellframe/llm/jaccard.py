"""Documents linked by the Jaccard similarity of their word n-gram sets, exactly.

Index. The range of shingle hashes is cut into positions, more than two linked sets can
differ at, so linked sets agree on all shingles of some position. An index list holds the
sets with equal content at one position; a set looks into the lists of its own positions
only, and lists of one set are dropped. Sets of very different sizes use different cuts.

Sketches. One byte for each position tells sets apart before they are sent: linked sets agree
in more positions than they can differ at, and equal content never gives different bytes.

Answers from related sets. In each list the set that shares most lists is the leader. Every
other set of the list is compared with the leader alone, and sets that link with it need no
comparison with each other. Only where a list still falls apart are its sets told apart by
their sketches, each compared with those that no set before it has met, and then by themselves,
in a grid of blocks: the answers of a block's first set come from the postings of all its
shingles, those of a similar set from these by the postings of the difference. Postings of
shingles that most sets have name the sets without them.

Equal sets count once, as a class with a 64-bit fingerprint. Nothing is sampled or capped:
long lists cost one comparison per set, and blocks only bound what a task holds.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from swellframe.llm.batches import map_batches, slices, unused
from swellframe.llm.graph import components
from swellframe.llm.wanted import Seen, parted
from swellframe.sources.workspace import only_kept, written

# Sizes in one class differ by this factor at most. Sets of a class are cut alike.
CLASS_RATIO = 1.3
# Other cuts for sets that leave too many positions of one cut empty.
CUTS = 8
# Members of a leader that one task compares, classes of a list that are compared by themselves,
# and sets and shingles of a block of the grid: what a task holds, some 20 MB.
LEADER_ROWS = 4096
LIST_SETS = 512
BLOCK_SETS, BLOCK_SHINGLES = 8192, 2_500_000


@dataclass(frozen=True)
class Link:
    """Shingles of ``words`` words; linked if ``den`` * intersection >= ``num`` * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def linked(self, shared, size_a, size_b):
        return self.den * shared >= self.num * (size_a + size_b - shared)

    def most_apart(self, largest: int) -> int:
        """The most shingles that two linked sets of such sizes differ in."""
        return int(Fraction(self.den - self.num, self.den + self.num) * 2 * largest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=8)
def _multipliers(words: int) -> np.ndarray:
    return np.random.default_rng(words).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words, A-Z in lower case.

    A text of fewer words is one shingle; one without words has none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    # On bytes, lower() and split() know ASCII letters and white space only.
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    count = len(found) - n + 1
    total = np.full(count, n, np.uint64)
    for i, factor in enumerate(_multipliers(words)[:n]):
        total += _mix(hashes[i : i + count]) * factor
    return np.unique(_mix(total))


def fingerprint(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


@lru_cache(maxsize=8)
def _classes(top: int) -> list[int]:
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, ceil(edges[-1] * CLASS_RATIO)))
    return edges


@lru_cache(maxsize=4096)
def cut(link: Link, size_class: int) -> tuple[int, int]:
    """Positions for pairs whose larger set is of a class, and how many a set may leave empty.

    Linked sets agree at ``spare`` + 1 positions at least. A set with at most ``spare`` empty
    ones agrees at one that is not empty, so empty positions need no lists for it.
    """
    edges = _classes(1 << 40)
    smallest = link.num * edges[size_class] / link.den
    apart = link.most_apart(edges[size_class + 1] - 1)
    if not apart:
        return 0, 0
    spare = 1
    for _ in range(4):
        empty = (apart + 1 + spare) * exp(-smallest / (apart + 1 + spare))
        spare = min(ceil(empty + 2 * sqrt(empty)), apart + 2)
    return apart + 1 + spare, spare


@lru_cache(maxsize=1 << 16)
def size_classes(link: Link, size: int) -> range:
    """Classes that a set looks into: its own, and those above that linked sets can be in."""
    edges = _classes(1 << 40)
    return range(bisect_right(edges, size) - 1, bisect_right(edges, link.den * size // link.num))


def _contents(positions: int, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that a set fills, and a hash of what it has there."""
    at = np.sort(spread)
    place = (at >> np.uint64(32)) * np.uint64(positions) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[first], _mix(np.add.reduceat(_mix(at), first))


def sketch(link: Link, shingles: np.ndarray) -> bytes:
    """A byte per position for each size class of a set, 0 where it has nothing."""
    out = []
    for size_class in size_classes(link, len(shingles)):
        positions, _ = cut(link, size_class)
        if positions:
            bytes_ = np.zeros(positions, np.uint8)
            place, content = _contents(positions, shingles)
            bytes_[place.astype(np.int64)] = content % np.uint64(255) + np.uint64(1)
            out.append(bytes_)
    return np.concatenate(out).tobytes() if out else b""


def part_of_sketch(link: Link, size: int, data: bytes, size_class: int) -> np.ndarray | None:
    """What a set's sketch holds for one size class."""
    start = 0
    for own in size_classes(link, size):
        positions, _ = cut(link, own)
        if own == size_class:
            return np.frombuffer(data, np.uint8, positions, start) if positions else None
        start += positions
    return None


def may_link(link: Link, size_a: int, a: bytes, size_b: int, b: bytes) -> bool:
    """Whether sketches agree in as many positions as those of linked sets do."""
    size_class = size_classes(link, max(size_a, size_b))[0]
    left, right = (part_of_sketch(link, n, x, size_class) for n, x in ((size_a, a), (size_b, b)))
    if left is None or right is None:
        return False
    return int((left == right).sum()) > cut(link, size_class)[1]


def signatures(link: Link, shingles: np.ndarray) -> np.ndarray:
    """Names of the lists that a set is in: size class, cut, position and content there.

    Linked sets without a list in common under one cut leave too many of its positions empty,
    both of them, so such sets go by the next cut as well; after the last, empty positions
    have lists too.
    """
    out = []
    for size_class in size_classes(link, len(shingles)) if len(shingles) else []:
        positions, spare = cut(link, size_class)
        for number in range(CUTS if positions else 0):
            spread = _mix(shingles + np.uint64(number)) if number else shingles
            place, content = _contents(positions, spread)
            few = positions - len(place) <= spare
            if not few and number == CUTS - 1:
                empty = np.setdiff1d(np.arange(positions, dtype=np.uint64), place)
                content = np.concatenate([content, np.zeros(len(empty), np.uint64)])
                place = np.concatenate([place, empty])
            tag = np.uint64(size_class * CUTS + number)
            out.append(_mix(content + (place + np.uint64(1) << np.uint64(20)) + tag))
            if few:
                break
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Texts:
    """Documents, their column of text, and for each class the ``source`` of one of its texts."""

    docs: DataFrame
    text: str
    link: Link
    sources: DataFrame | None = None


def source_of(docs: DataFrame, text: str) -> Column:
    """A name of the text itself, which needs no shingles."""
    return F.xxhash64(docs[text])


def set_facts(docs: DataFrame, link: Link, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` (the key), ``source``, ``n_shingles``, ``class`` (null for empty sets) and
    ``lists``, the lists that the class is in, once per task. Every text is cut up once."""

    def make():
        seen = Seen()

        def work(texts):
            sizes, names, lists = [], [], []
            for body in texts:
                shingles = shingle_set(body, link.words)
                sizes.append(len(shingles))
                names.append(fingerprint(shingles) if len(shingles) else None)
                first = len(shingles) and seen.first(names[-1])
                lists.append(signatures(link, shingles) if first else None)
            return pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(lists, pa.list_(pa.int64()))

        return work

    added = [
        StructField("n_shingles", LongType()),
        StructField("class", LongType()),
        StructField("lists", ArrayType(LongType())),
    ]
    rows = docs.select(docs[key].alias("id"), source_of(docs, text).alias("source"), docs[text].alias("text"))
    return map_batches(rows, ["id", "source"], ["text"], added, make)


def index_rows(facts: DataFrame) -> DataFrame:
    """``list`` and ``class``: the lists that each class is in, once per task or so."""
    return facts.select(F.explode("lists").alias("list"), "class")


def shared_lists(rows: DataFrame) -> DataFrame:
    """The ``list`` and ``class`` of lists that hold two classes or more.

    Sorted lists pass by, so a list of any length costs one row of memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row before, and whether it was given out
        for batch in batches:
            lists, names = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:
                lists, names = np.append(last[0], lists), np.append(last[1], names)
            fresh = np.append(True, (lists[1:] != lists[:-1]) | (names[1:] != names[:-1]))
            given = bool(last and last[2])
            lists, names = lists[fresh], names[fresh]
            if not len(lists):
                continue
            same = lists[1:] == lists[:-1]
            keep = np.append(False, same) | np.append(same, False)
            # The first row may have been given out before; the last may still get a mate.
            out = keep.copy()
            out[0] &= not given
            last = (lists[-1], names[-1], bool(keep[-1]) or (len(lists) == 1 and given))
            if out.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[out]), pa.array(names[out])], ["list", "class"]
                )

    ordered = rows.repartition("list").sortWithinPartitions("list", "class")
    return ordered.mapInArrow(run, "list long, class long")


def set_bytes(link: Link, shingles: np.ndarray) -> bytes:
    return shingles.tobytes()


def wanted_sets(texts: Texts, names: DataFrame, form) -> DataFrame:
    """``class``, ``size`` and ``data`` of the classes in ``names``, perhaps of more or more often.

    ``form`` makes the data from a set: ``set_bytes`` or ``sketch``. The sets are computed
    again rather than kept, of one text per class. Texts are chosen before they are cut up, by
    a bit table, so that none is shuffled; it lets some others pass, which joins with ``names``
    leave out.
    """
    docs, link = texts.docs, texts.link
    wanted = written(names.select("class").distinct().join(texts.sources, "class").select("source"), "wanted-texts")
    chosen = docs.select(docs[texts.text].alias("text"), source_of(docs, texts.text).alias("source"))
    chosen = parted(chosen, chosen["source"], wanted)[0].select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch):
                found = []
                for body in part.column(0).to_pylist():
                    shingles = shingle_set(body, link.words)
                    if len(shingles) and seen.first(name := fingerprint(shingles)):
                        found.append((name, len(shingles), form(link, shingles)))
                if found:
                    types = (pa.int64(), pa.int64(), pa.binary())
                    arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["class", "size", "data"])

    return chosen.mapInArrow(run, "class long, size long, data binary")


def leaders(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    """``list``, ``class``, ``leader`` of each row of ``lists``, with both sizes."""
    lengths = lists.groupBy("list").agg(F.count("*").alias("length"))
    shares = lists.join(lengths, "list").groupBy("class").agg(F.sum("length").alias("shares"))
    known = lists.join(shares.join(sizes, "class"), "class")
    first = known.groupBy("list").agg(F.max(F.struct("shares", "class", "n_shingles")).alias("top"))
    return known.join(first, "list").select(
        "list",
        "class",
        "n_shingles",
        F.col("top.class").alias("leader"),
        F.col("top.n_shingles").alias("leader_size"),
    )


def pairs_with_leaders(led: DataFrame, link: Link) -> DataFrame:
    """``class`` and ``leader`` of all pairs whose sizes allow a link."""
    small, large = F.least("n_shingles", "leader_size"), F.greatest("n_shingles", "leader_size")
    pairs = led.filter((F.col("class") != F.col("leader")) & (link.den * small >= link.num * large))
    return pairs.select("class", "leader").distinct()


def _sets_link(link: Link, size_a: int, a: bytes, size_b: int, b: bytes) -> bool:
    head, shingles = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.minimum(np.searchsorted(head, shingles), len(head) - 1)
    return link.linked(int((head[at] == shingles).sum()), size_a, size_b)


def compared(texts: Texts, pairs: DataFrame, form, test) -> DataFrame:
    """The rows of ``pairs`` (a stored table) that pass ``test`` on the ``form`` of both sets.

    A leader with many members meets them in several tasks, one at a time.
    """
    tasks = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_ROWS).alias("tasks"))
    members = pairs.join(tasks, "leader").select(
        "class", "leader", F.pmod(F.xxhash64("class"), F.col("tasks")).alias("part"), F.lit(1).alias("member")
    )
    heads = tasks.select(
        F.col("leader").alias("class"),
        "leader",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("part"),
        F.lit(0).alias("member"),
    )
    roles = members.unionByName(heads)
    link = texts.link

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head, last = None, None, None
        for batch in batches:
            for part in slices(batch, 1024):
                passed = []
                for row in part.to_pylist():
                    if (row["leader"], row["part"]) != group:
                        group, last = (row["leader"], row["part"]), None
                    if row["class"] == last:
                        continue
                    last = row["class"]
                    if not row["member"]:
                        head = (row["size"], row["data"])
                    elif test(link, *head, row["size"], row["data"]):
                        passed.append((row["class"], row["leader"]))
                if passed:
                    arrays = [pa.array(c, pa.int64()) for c in zip(*passed, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["class", "leader"])

    sets = wanted_sets(texts, roles, form)
    rows = sets.join(roles, "class").select("leader", "part", "member", "class", "size", "data")
    ordered = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "member", "class")
    return ordered.mapInArrow(run, "class long, leader long")


def linked_to_leaders(texts: Texts, led: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between classes and the leaders that they are linked with."""
    pairs = written(pairs_with_leaders(led, texts.link), "leader-pairs")
    likely = written(compared(texts, pairs, sketch, may_link), "likely-pairs")
    edges = compared(texts, likely, set_bytes, _sets_link)
    return edges.select(F.col("class").alias("a"), F.col("leader").alias("b"))


def block_links(link: Link, left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set in order, the right sets that it is linked with.

    The shared counts of a set come from those of the set before it where the two are alike:
    only the postings of the shingles in which they differ are read. A shingle that most of
    the right sets have is kept by the sets that lack it.
    """
    sizes = np.array([len(x) for x in right])
    values, place = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), sizes)
    common = 2 * np.bincount(place, minlength=len(values)) > len(right)
    held = common[place]
    lacks = np.ones((int(common.sum()), len(right)), bool)  # at most two bytes per shingle of a set
    lacks[(np.cumsum(common) - 1)[place[held]], owner[held]] = False
    row, lacking = np.nonzero(lacks)
    place = np.concatenate([place[~held], np.flatnonzero(common)[row]])
    order = np.argsort(place, kind="stable")
    owner = np.concatenate([owner[~held], lacking])[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(values)))])

    def posted(at: np.ndarray) -> np.ndarray:
        length = start[at + 1] - start[at]
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return np.bincount(owner[np.repeat(start[at], length) + inside], minlength=len(right))

    def counts_of(shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        at = at[values[at] == shingles]
        most = common[at]
        return posted(at[~most]) - posted(at[most]) + int(most.sum())

    before = counts = None
    for i, shingles in enumerate(left):
        if before is not None:
            gone = np.setdiff1d(before, shingles, assume_unique=True)
            new = np.setdiff1d(shingles, before, assume_unique=True)
        if before is None or len(gone) + len(new) >= len(shingles):
            counts = counts_of(shingles)
        else:
            counts = counts - counts_of(gone) + counts_of(new)
        before = shingles
        yield i, np.flatnonzero(link.linked(counts, len(shingles), sizes))


class Sketches:
    """Some (size, sketch), asked for those that may be linked with another one."""

    def __init__(self, link: Link, sets: list[tuple], classes: Iterable[int]):
        self.link = link
        self.own = np.array([size_classes(link, size)[0] for size, _ in sets], np.int64)
        # For each size class of a pair: who has a sketch for it, and these, a row per position.
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size_class in classes:
            parts = [part_of_sketch(link, size, data, size_class) for size, data in sets]
            at = np.array([j for j, part in enumerate(parts) if part is not None], np.int64)
            if len(at):
                self.groups[size_class] = (at, np.stack([parts[j] for j in at.tolist()], axis=1))

    def mates(self, size: int, data: bytes) -> np.ndarray:
        own, found = size_classes(self.link, size)[0], []
        for size_class, (at, table) in self.groups.items():
            part = part_of_sketch(self.link, size, data, size_class)
            if part is not None:
                fits = np.maximum(self.own[at], own) == size_class
                equal = np.add.reduce(table == part[:, None], axis=0, dtype=np.int32)
                found.append(at[fits & (equal > cut(self.link, size_class)[1])])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def keep(self, which: np.ndarray) -> None:
        """Forgets those of which ``which`` is false."""
        for size_class, (at, table) in self.groups.items():
            self.groups[size_class] = (at[which[at]], np.ascontiguousarray(table[:, which[at]]))


def sketch_links(link: Link, left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """For each left (size, sketch) in order, the right ones that it may be linked with."""
    sketches = Sketches(link, right, sorted({size_classes(link, size)[0] for size, _ in left + right}))
    for i, (size, data) in enumerate(left):
        yield i, sketches.mates(size, data)


def sketch_families(link: Link, sets: list[tuple]) -> np.ndarray:
    """One number for each (size, sketch), the same for those that may be linked, directly or
    by way of others.

    Each is compared only with those that have no family yet, so a large group of near copies
    costs a few comparisons per member.
    """
    sketches = Sketches(link, sets, sorted({size_classes(link, size)[0] for size, _ in sets}))
    family = np.full(len(sets), -1, np.int64)
    left = held = len(sets)
    for first in range(len(sets)):
        if family[first] >= 0:
            continue
        family[first], todo = first, [first]
        left -= 1
        while todo and left:
            mates = sketches.mates(*sets[todo.pop()])
            mates = mates[family[mates] < 0]
            family[mates] = first
            todo += mates.tolist()
            left -= len(mates)
            if 2 * left < held:
                sketches.keep(family < 0)
                held = left
    return family


def sketch_edges(link: Link, rows: list[dict]) -> list[tuple[int, int]]:
    """Edges that hold together the classes of each sketch family with several labels."""
    family = sketch_families(link, [(row["size"], row["data"]) for row in rows]).tolist()
    labels: dict[int, set[int]] = {}
    for first, row in zip(family, rows, strict=True):
        labels.setdefault(first, set()).add(row["label"])
    return [
        (rows[first]["class"], row["class"])
        for i, (first, row) in enumerate(zip(family, rows, strict=True))
        if first != i and len(labels[first]) > 1
    ]


def block_sketch_edges(link: Link, left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
    """:func:`sketch_edges` of two blocks, or of one."""
    return sketch_edges(link, left if left[0]["block"] == right[0]["block"] else left + right)


def set_edges(link: Link, left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
    """Edges between linked classes that join different labels; of those that would close a
    circle between labels, one is left out."""
    names = np.array([row["label"] for row in left + right], np.int64)
    _, root = np.unique(names, return_inverse=True)
    own, other = root[: len(left)].copy(), root[len(left) :].copy()
    body = lambda side: [np.frombuffer(row["data"], np.uint64) for row in side]
    edges = []
    for i, mates in block_links(link, body(left), body(right)):
        mates = mates[other[mates] != own[i]]
        while len(mates):
            j = mates[0]
            edges.append((left[i]["class"], right[j]["class"]))
            joined = other[j]
            for side in (own, other):
                side[side == joined] = own[i]
            mates = mates[other[mates] != own[i]]
    return edges


def grid_edges(texts: Texts, sets: DataFrame, form, edges_of) -> DataFrame:
    """Edges that ``edges_of`` finds between the classes of each ``family``, in a grid of blocks.

    ``sets`` (a stored table) has ``class``, ``n_shingles``, ``label`` and ``family``. Only
    pairs of different labels count, so the blocks of a family's largest label meet those of
    the others and not each other. ``edges_of`` gets the rows of two blocks, or one block twice.
    """
    counts = sets.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    families = counts.groupBy("family").agg(
        F.max(F.struct("n", "label", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")
    )
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_SETS, s / BLOCK_SHINGLES))
    families = families.select(
        "family",
        F.col("main.label").alias("main"),
        blocks(F.col("main.n"), F.col("main.s")).alias("of_main"),
        blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("of_rest"),
    ).filter("of_rest > 0")
    is_main, spread = F.col("label") == F.col("main"), F.xxhash64("class")
    block = F.when(is_main, F.pmod(spread, F.col("of_main"))).otherwise(
        F.col("of_main") + F.pmod(spread, F.col("of_rest"))
    )
    first = F.when(is_main, F.col("of_main")).otherwise(F.lit(0).cast("long"))
    other = F.explode(F.sequence(first, F.col("of_main") + F.col("of_rest") - 1))
    grid = sets.join(families, "family").withColumn("block", block).withColumn("other", other).select(
        "class",
        "label",
        "family",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    )
    bodies = wanted_sets(texts, sets, form).join(grid, "class")
    link = texts.link

    def run(table: pa.Table) -> pa.Table:
        rows = {row["class"]: row for row in table.to_pylist()}
        ordered = sorted(rows.values(), key=lambda row: (row["label"], row["class"]))
        low, high = ordered[0]["low"], ordered[0]["high"]
        left = [row for row in ordered if row["block"] == low]
        right = [row for row in ordered if row["block"] == high]
        edges = edges_of(link, left, right) if left and right else []
        arrays = [pa.array([edge[k] for edge in edges], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays(arrays, ["a", "b"])

    return bodies.groupBy("family", "low", "high").applyInArrow(run, "a long, b long")


def likely_in_lists(texts: Texts, rows: DataFrame) -> DataFrame:
    """Edges that hold together the classes of each list whose sketches agree, where labels differ.

    ``rows`` has ``list``, ``class`` and ``label`` of lists of up to ``LIST_SETS`` classes,
    which pass by one list at a time.
    """
    link = texts.link

    def edges_of(held: list[dict]) -> list[tuple[int, int]]:
        return sketch_edges(link, held) if len({row["label"] for row in held}) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for part in slices(batch, 4096):
                edges: list[tuple[int, int]] = []
                for row in part.to_pylist():
                    if held and row["list"] != held[0]["list"]:
                        edges += edges_of(held)
                        held = []
                    if not held or row["class"] != held[-1]["class"]:
                        held.append(row)
                if edges:
                    arrays = [pa.array(c, pa.int64()) for c in zip(*edges, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])
        if held and (edges := edges_of(held)):
            arrays = [pa.array(c, pa.int64()) for c in zip(*edges, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    sets = wanted_sets(texts, rows, sketch).join(rows, "class")
    ordered = sets.select("list", "class", "label", "size", "data").repartition("list")
    return ordered.sortWithinPartitions("list", "class").mapInArrow(run, "a long, b long")


def linked_in_blocks(texts: Texts, led: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges that join classes of lists which their leader has not made one.

    ``labels`` are the components so far. Of lists with the same classes one is looked at. Its
    classes are first compared by their sketches, in a grid of blocks if they are many; those
    that may be linked, directly or by way of others, then by their sets.
    """
    known = labels.withColumnRenamed("node", "class")
    rest = led.filter(F.col("class") != F.col("leader")).join(known, "class", "left")
    rest = rest.select("list", "class", "n_shingles", F.coalesce("label", "class").alias("label"))
    name = F.xxhash64("class").cast("decimal(38,0)")
    split = rest.groupBy("list").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum(name).alias("names")
    )
    split = split.filter("low <> high").groupBy("n", "names").agg(F.min("list").alias("list"))
    open_rows = written(rest.join(split.select("list", "n"), "list"), "open-lists")
    short, long = open_rows.filter(F.col("n") <= LIST_SETS), open_rows.filter(F.col("n") > LIST_SETS)
    likely = likely_in_lists(texts, short.select("list", "class", "label"))
    if not long.isEmpty():
        grid = written(long.select("class", "n_shingles", "label", F.col("list").alias("family")), "long-lists")
        likely = likely.unionByName(grid_edges(texts, grid, sketch, block_sketch_edges))
    families = components(likely).select(F.col("node").alias("class"), F.col("label").alias("family"))
    sets = open_rows.select("class", "n_shingles", "label").distinct()
    sets = written(sets.join(families, "class"), "open-sets")
    return grid_edges(texts, sets, set_bytes, set_edges)


def labelled_classes(texts: Texts, facts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``node`` and ``label`` of all classes that link with another one.

    ``facts`` are those of the texts, ``sizes`` has ``class`` and ``n_shingles``.
    """
    lists = written(shared_lists(index_rows(facts)), "index-lists")
    led = written(leaders(lists, sizes.select("class", "n_shingles")), "index-leaders")
    edges = written(linked_to_leaders(texts, led), "leader-links")
    labels = written(components(edges), "leader-components")
    more = written(linked_in_blocks(texts, led, labels), "block-links")
    if more.isEmpty():
        return labels
    stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return written(components(stars.unionByName(more)), "components")


def similar_documents(docs: DataFrame, link: Link | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``key``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest key that links reach, the row's own included. Documents
    without words link with nothing, and their component is their own key. Keys that are null
    count as no key: such rows get the smallest other key of their component, or null.
    Repeated rows stay. An empty table gives an empty result.
    """
    link = link or Link()
    with only_kept(docs.sparkSession) as keep:
        facts = written(set_facts(docs, link, key, text), "shingle-sets")
        sizes = facts.filter(F.col("class").isNotNull()).groupBy("class").agg(
            F.max("n_shingles").alias("n_shingles"), F.min("id").alias("smallest"), F.min("source").alias("source")
        )
        sizes = written(sizes, "set-classes")
        labels = labelled_classes(Texts(docs, text, link, sizes.select("class", "source")), facts, sizes)
        named = sizes.join(labels.withColumnRenamed("node", "class"), "class", "left")
        named = named.select("class", "smallest", F.coalesce("label", "class").alias("label"))
        smallest = named.groupBy("label").agg(F.min("smallest").alias("component_id"))
        by_class = named.join(smallest, "label").select("class", "component_id")
        joined = facts.select("id", "n_shingles", "class").join(by_class, "class", "left")
        own = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
        result = joined.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"))
        return keep(result, "similar-documents")


def one_of_each(docs: DataFrame, link: Link | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows, that with the smallest key.

    Null keys come last; of several rows with that key, one of those whose set has the
    smallest fingerprint stays. Rows without words all stay. Rows are judged by key and text
    together, so no other row goes for a hash that it shares. Columns may have any names.
    """
    link = link or Link()
    with only_kept(docs.sparkSession) as keep:
        facts = written(set_facts(docs, link, key, text), "shingle-sets")
        sets = facts.filter(F.col("class").isNotNull())
        order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("key"), F.col("class").alias("class"))
        sizes = written(
            sets.groupBy("class").agg(
                F.max("n_shingles").alias("n_shingles"),
                F.min(order).alias("first"),
                F.count("*").alias("n"),
                F.min("source").alias("source"),
            ),
            "set-classes",
        )
        labels = labelled_classes(Texts(docs, text, link, sizes.select("class", "source")), facts, sizes)
        named = sizes.join(labels.withColumnRenamed("node", "class"), "class", "left")
        named = named.filter((F.col("n") > 1) | F.col("label").isNotNull())
        named = written(named.select("class", "first", F.coalesce("label", "class").alias("label")), "set-groups")
        first = named.groupBy("label").agg(F.min("first").alias("first"))
        grouped = named.select("class", "label").join(first, "label")
        stays = (F.col("class") == F.col("first.class")) & F.col("id").eqNullSafe(F.col("first.key"))
        rows = sets.select("id", "source", "class").join(grouped, "class")
        # One row per key and text: how many rows there are, and whether one of them stays.
        verdicts = rows.groupBy("id", "source").agg(
            F.max(stays.cast("int")).alias("stays"), F.max("class").alias("class")
        )
        several = rows.filter(stays).groupBy("class").agg(F.count("*").alias("rows"))
        verdicts = verdicts.join(several, "class", "left").select("id", "source", "stays", "class", "rows")
        # The others stay as they are.
        verdicts = keep(verdicts.filter("stays = 0 OR rows > 1"), "set-verdicts")
        several = not verdicts.filter("stays = 1").isEmpty()
        judged = keep(verdicts.select("source").distinct(), "judged-texts")

    source, verdict, name = unused(docs.columns, "_source", "_stays", "_class")
    marks = verdicts.select(
        F.col("id").alias("_id"),
        F.col("source").alias("_text"),
        F.col("stays").alias(verdict),
        F.col("class").alias(name),
    )
    asked = docs.withColumn(source, source_of(docs, text))
    # Only texts that may have a verdict are shuffled.
    asked, rest = parted(asked, asked[source], judged)
    same = asked[key].eqNullSafe(marks["_id"]) & (asked[source] == marks["_text"])
    marked = asked.join(marks, same, "left")
    plain = marked.filter(marks[verdict].isNull()).select(*[asked[c] for c in docs.columns])
    plain = rest.select(*[rest[c] for c in docs.columns]).unionByName(plain)
    if not several:
        return plain
    one = marked.filter(marks[verdict] == 1).dropDuplicates([name]).select(*[asked[c] for c in docs.columns])
    return plain.unionByName(one)
