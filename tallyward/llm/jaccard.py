"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles. Two sets of sizes
``a <= b`` that share three quarters of their union differ in at most
``(a + b) / 7`` elements, so ``b <= 4 a / 3`` and they differ in at most
``a / 3``.

A sketch has ``p`` words of 64 bits. Each element flips the bits of its hash in
one word, which the hash chooses as well: a word is the exclusive or of its
elements' hashes. An element that only one of two sets has changes one word,
so the number of differing words, the Hamming distance word by word, is at most
the size of the symmetric difference. Where ``p`` sketch words are not all
empty and fewer than that differ, one that is not empty is equal: the words,
with their numbers, are the join keys. This holds for a set if it fills more
words than ``a / 3``, and ``sketch words`` are chosen for each band of sizes so
that it holds for every set of the corpus: the sets' fill is counted for a few
choices, and the last choice gives each element a word of its own, where it
always holds. Bands double in size; a set of up to four thirds of a band's end
is sketched for that band too, as it may join a smaller set there.

Equal sets are one class before anything else. Classes that meet at a key are
candidates. A set that fills ``f`` words shares at least ``f`` less the
symmetric difference with a partner, and pairs that share fewer keys are
dropped before any text is fetched. A key with more than ``CROWD`` classes is
crowded (a common passage, or a large family of near copies): it makes no
pairs. Instead each class counts its crowded keys, and its pairs may lack that
many. A class that fills too few other words to be found by them relies on its
crowded keys. Each relying class is paired with the class that has most crowded
keys at two of its own, which in a family of near copies is the least changed
one. These pairs are verified and joined into components; a family of thousands
of near copies is about one component then. Relying classes of different
components are compared by their rarest shingles. So no link is lost, and no
group makes all its pairs.

Keys travel in blocks: for each batch of documents and each part of the key
space, one row with the keys as bytes and the numbers of their classes. Equal
classes in one batch are sent once.

Defined cases: a null text counts as empty; texts without words are linked with
nothing and are components by themselves; with fewer than five words the whole
sequence is one shingle; a text of any length is used whole; rows with equal
ids and texts that differ are told apart, and their component is named by the
id all the same; a null id is the least; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import sliced, stored, whole
from tallyward.llm.shingles import mix, shingle_sets

#: Elements per sketch word to choose from, the thriftiest first; 0 gives each element its own word.
LOADS = (1.8, 1.3, 0.0)
#: Classes beyond which a key is crowded.
CROWD = 32
#: Keys for which one part of the key space is meant.
PART_KEYS = 500_000


def band(n: np.ndarray) -> np.ndarray:
    """Number of the size band: sizes from 2**band on."""
    return np.frexp(np.maximum(n, 1))[1] - 1


def bands_of(n: int) -> list[int]:
    """The bands that a set of this size is sketched for: its own, and the one below if a partner may lie there."""
    b = int(band(np.array([n]))[0])
    return [b, b - 1] if b and 3 * n < 4 * (1 << b) else [b]


def sketch_words(b: int, load: float) -> int:
    """Words of a sketch in a band; 0 stands for one per element."""
    return int((1 << (b + 1)) / load) if load else 0


def sketch(hashes: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the filled words, and their bits."""
    if not p:
        return hashes, hashes
    place = ((hashes >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[starts], np.bitwise_xor.reduceat(mix(hashes)[order], starts)


def set_marks(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers for a set."""
    with np.errstate(over="ignore"):
        a, b = np.sum(mix(hashes)), np.sum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return int(a.view(np.int64)), int(b.view(np.int64))


_SETS = "doc_id bigint, tag bigint, n int, s1 bigint, s2 bigint, fills array<int>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, marks and how many words each choice of load fills, in each band of the set."""
    for batch in sliced(batches):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        ns, s1, s2, fills = [], [], [], []
        for hashes in shingle_sets(texts):
            n = len(hashes)
            a, b = set_marks(hashes)
            counts = []
            for level in bands_of(n) if n else []:
                for load in LOADS[:-1]:
                    p = sketch_words(level, load)
                    place = ((hashes >> np.uint64(32)) * np.uint64(max(p, 1))) >> np.uint64(32)
                    counts.append(int(np.count_nonzero(np.bincount(place.astype(np.int64)))))
            ns.append(n), s1.append(a), s2.append(b), fills.append(counts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(ns, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(fills, pa.list_(pa.int32()))],
            names=[c.split()[0] for c in _SETS.split(", ")],
        )


def own_band():
    """``band`` of the column ``n``: one less than its binary digits."""
    return F.length(F.bin("n")) - 1


def chosen_loads(classes: DataFrame) -> dict[int, int]:
    """Number of the load for each band: the thriftiest at which every set of the band fills more than a third of its size.

    The aggregate has one row for each band, of which there are some twenty.
    """
    rows = classes.filter("n > 0").select("n", "fills", own_band().cast("int").alias("band"))
    enough = [F.min(F.get("fills", F.lit(i)) > F.floor(F.col("n") / 3)).alias(f"ok{i}") for i in range(len(LOADS) - 1)]
    out = {}
    for r in rows.groupBy("band").agg(*enough).collect():
        i = next((i for i in range(len(LOADS) - 1) if r[f"ok{i}"]), len(LOADS) - 1)
        out[r["band"]] = i
    # a set may be sketched for the band below its own although no set has that size
    return {b: out.get(b, len(LOADS) - 1) for b in range(max(out, default=0) + 1)}


_BLOCK = "part int, keys binary, at binary, classes binary, sizes binary"


def _keys(loads: dict[int, int], parts: int):
    """For each batch and part: 64-bit keys, the places of their classes in ``classes``, the classes' marks and their sizes and fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            seen: dict[int, int] = {}
            keys, owners, sizes = [], [], []
            for hashes in shingle_sets([t or b"" for t in batch.column("text").to_pylist()]):
                if not len(hashes):
                    continue
                mark = set_marks(hashes)[0]
                if mark in seen:
                    continue
                seen[mark] = len(seen)
                for k, level in enumerate(bands_of(len(hashes))):
                    place, bits = sketch(hashes, sketch_words(level, LOADS[loads[level]]))
                    if k == 0:
                        sizes.append((len(hashes), len(place)))
                    keys.append(mix(bits + mix(place * np.uint64(64) + np.uint64(level))))
                    owners.append(np.full(len(place), seen[mark], np.uint32))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.lexsort((key, part))
            key, owner, part = key[order], owner[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            names, size = np.array(list(seen), np.int64), np.array(sizes, np.int32)
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                used, at = np.unique(owner[a:b], return_inverse=True)
                # the part stands for the upper bits
                low = np.ascontiguousarray(key[a:b].view(np.uint8).reshape(-1, 8)[:, :6])
                rows.append((int(part[a]), low.tobytes(), at.astype(np.uint16).tobytes(), names[used].tobytes(), size[used].tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")]
            )

    return run


_MET = "key bigint, a bigint, b bigint, times int, need int"


def _pairs(key: np.ndarray, mark: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs ``a < b`` of equal keys with sizes that allow a link: how many keys they share, how many a link needs.

    Rows come by key and mark, and no key has more than ``CROWD`` of them.
    """
    left, right = [], []
    for gap in range(1, CROWD):
        i = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(i):
            break
        small, large = np.minimum(size[i, 0], size[i + gap, 0]), np.maximum(size[i, 0], size[i + gap, 0])
        i = i[100 * small.astype(np.int64) >= 75 * large.astype(np.int64)]
        left.append(i), right.append(i + gap)
    if not left:
        return (np.zeros(0, np.int64),) * 4
    i, j = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((mark[j], mark[i]))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (mark[i][1:] != mark[i][:-1]) | (mark[j][1:] != mark[j][:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.concatenate([starts, [len(i)]]))
    i, j = i[starts], j[starts]
    fill = np.where(size[i, 0] <= size[j, 0], size[i, 1], size[j, 1])
    return mark[i], mark[j], times, fill - (size[i, 0].astype(np.int64) + size[j, 0]) // 7


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share keys, and the rows (key, class) of crowded keys with ``b`` null; blocks come by part."""

    def out(blocks: list) -> pa.RecordBatch:
        key, mark, size = (np.concatenate(c) for c in zip(*blocks, strict=True))
        order = np.lexsort((mark, key))
        key, mark, size = key[order], mark[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        key, mark, size = key[new], mark[new], size[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        members = np.diff(np.concatenate([starts, [len(key)]]))
        many = np.repeat(members > CROWD, members)
        some = np.repeat((members > 1) & (members <= CROWD), members)
        a, b, times, need = _pairs(key[some], mark[some], size[some])
        n, m = len(a), int(many.sum())
        none = pa.nulls(m, pa.int64())
        columns = [
            pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(key[many].view(np.int64))]),
            pa.concat_arrays([pa.array(a, pa.int64()), pa.array(mark[many])]),
            pa.concat_arrays([pa.array(b, pa.int64()), none]),
            pa.concat_arrays([pa.array(times.astype(np.int32)), none.cast(pa.int32())]),
            pa.concat_arrays([pa.array(need.astype(np.int32)), none.cast(pa.int32())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MET.split(", ")])

    held, blocks = None, []
    for batch in batches:
        rows = zip(*[batch.column(c.split()[0]).to_pylist() for c in _BLOCK.split(", ")], strict=True)
        for part, key, at, classes, sizes in rows:
            if blocks and part != held:
                yield out(blocks)
                blocks = []
            held = part
            place = np.frombuffer(at, np.uint16)
            full = np.zeros((len(place), 8), np.uint8)
            full[:, :6] = np.frombuffer(key, np.uint8).reshape(-1, 6)
            full[:, 6:] = np.array([part & 0xFFFF], np.uint16).view(np.uint8)
            blocks.append(
                (full.view(np.uint64).ravel(), np.frombuffer(classes, np.int64)[place], np.frombuffer(sizes, np.int32).reshape(-1, 2)[place])
            )
    if blocks:
        yield out(blocks)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of sorted hashes share three quarters of their union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 75 * (len(a) + len(b) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs of texts whose sets are linked."""
    for batch in sliced(batches, 500):
        texts, at = [], {}
        for column in ("text_a", "text_b"):
            for t in batch.column(column).to_pylist():
                if t not in at:
                    at[t] = len(texts)
                    texts.append(t)
        sets = list(shingle_sets(texts))
        ok = [
            linked(sets[at[a]], sets[at[b]])
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "ok"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the least node that edges ``a, b`` lead to; each round looks up the root's root as well.

    Every round is written, so a lost executor costs one round at most. Roots
    halve their distance in a round, so few rounds are needed.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    state = stored(nodes.select("node", F.col("node").alias("root")), "roots")
    while True:
        of = state.select(F.col("node").alias("b"), F.col("root").alias("_other"))
        offered = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("_other").alias("_least"))
        lower = state.join(offered, "node", "left").select(
            "node", "root", F.least("root", F.coalesce("_least", "root")).alias("_new")
        )
        # the new root of a root reaches all that hang on it
        hooks = lower.groupBy(F.col("root").alias("_at")).agg(F.min("_new").alias("_hook"))
        hooked = lower.join(hooks, F.col("root") == F.col("_at")).select("node", "root", F.least("_new", "_hook").alias("_new"))
        after = stored(hooked, "roots")
        if not after.filter("root <> _new").limit(1).count():
            return state
        state = after.select("node", F.col("_new").alias("root"))


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n, component_id, keeper`` for each row.

    ``tag`` is the hash of the text, ``keeper`` marks the first document of each component.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64(whole()).alias("tag"), whole().cast("binary").alias("text"))
    rows = stored(texts.mapInArrow(_sets, _SETS), "sets")
    classes = stored(
        rows.filter("n > 0").groupBy("s1", "s2", "n").agg(
            F.min(F.struct("doc_id", "tag")).alias("first"), F.first("fills").alias("fills"), F.count("*").alias("copies")
        ),
        "classes",
    )
    loads = chosen_loads(classes)
    size = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, size // PART_KEYS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = texts.mapInArrow(_keys(loads, parts), _BLOCK).repartition(parts, "part").sortWithinPartitions("part")
    met = stored(blocks.mapInArrow(_groups, _MET), "met")

    # pairs by their uncrowded keys, less what crowded keys may add
    crowd = met.filter("b is null").groupBy(F.col("a").alias("class"))
    crowded = stored(crowd.agg(F.count("*").alias("crowded"), F.array(F.min("key"), F.max("key")).alias("keys")), "crowded")
    counted = met.filter("b is not null").groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need"))
    of_a, of_b = (crowded.select(F.col("class").alias(c), F.col("crowded").alias(f"c{c}")) for c in "ab")
    spare = F.coalesce(F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))), F.lit(0))
    pairs = counted.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.col("times") + spare >= F.col("need"))
    info = classes.select(F.col("s1").alias("class"), "n", "fills", "first")
    reliant = (
        crowded.join(info, "class")
        .filter(F.col("crowded") >= F.array_min(_least_fill(loads)) - F.floor(F.col("n") / 3))
        .select("class", "n", "fills", "first", F.element_at(_least_fill(loads), 1).alias("fill"), "crowded", "keys")
    )
    relying = stored(reliant, "relying")
    # two keys of each class: this round only joins families, the prefixes below find what it leaves
    columns = ("class", "n", "fill", "crowded")
    two = relying.select(F.explode(F.array_distinct("keys")).alias("key"), *columns)
    middle = two.groupBy("key").agg(F.max(F.struct("crowded", "class", "n", "fill")).alias("m"))
    middle = middle.select("key", *[F.col(f"m.{c}").alias(f"{c}_a") for c in columns])
    other = two.select("key", *[F.col(c).alias(f"{c}_b") for c in columns])
    need = F.when(F.col("n_a") <= F.col("n_b"), F.col("fill_a")).otherwise(F.col("fill_b")) - F.floor((F.col("n_a") + F.col("n_b")) / 7)
    sizes_fit = F.expr("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    # the classes need not be told apart by uncrowded keys
    alike = sizes_fit & (F.least("crowded_a", "crowded_b") >= need)
    same_key = middle["key"] == other["key"]
    stars = middle.join(other, same_key & alike & (F.col("class_a") != F.col("class_b")))
    stars = stars.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))
    tested = stored(verified(texts, info, pairs.select("a", "b").union(stars).distinct()), "tested")
    nodes = stored(tested.select(F.col("a").alias("node")).union(tested.select("b")).distinct(), "nodes")
    links = tested.filter("ok").select("a", "b")
    roots = components(nodes, links)

    # what may still be linked across components
    placed = relying.join(roots.hint("merge"), F.col("class") == F.col("node"), "left")
    left = stored(placed.select("class", F.coalesce("root", "class").alias("root"), "n", "first"), "open")
    rest = apart_by_prefix(texts, left)
    again = stored(verified(texts, info, rest.join(tested.select("a", "b"), ["a", "b"], "left_anti")), "tested")
    found = again.filter("ok").select("a", "b")
    if found.limit(1).count():
        ends = again.select(F.col("a").alias("node")).union(again.select("b")).union(nodes).distinct()
        roots = components(ends, links.union(found))

    first = classes.select(F.col("s1").alias("node"), "s2", "n", "first").join(roots, "node", "left")
    named = first.withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("first").alias("keeper"))
    labels = named.join(names, "root").select(F.col("node").alias("s1"), "s2", "n", "keeper")
    some = F.col("n") > 0
    return rows.join(labels.hint("merge"), ["s1", "s2", "n"], "left").select(
        "doc_id",
        "tag",
        "n",
        F.when(some, F.col("keeper.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.struct("doc_id", "tag").eqNullSafe(F.col("keeper"))).otherwise(True).alias("keeper"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each component, with its own columns; rows equal in id and text are one."""
    kept = similar(docs).filter("keeper").select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")).distinct()
    marked = docs.withColumn("_own", F.xxhash64(whole()))
    joined = marked.join(kept, marked.doc_id.eqNullSafe(kept._doc) & (marked._own == kept._tag))
    turn = F.row_number().over(Window.partitionBy("_doc", "_tag").orderBy("_own"))
    return joined.withColumn("_turn", turn).filter("_turn = 1").select(*docs.columns)


def _least_fill(loads: dict[int, int]):
    """The filled words of a class in each of its bands, from its counts."""
    own = own_band()
    at = F.create_map(*[F.lit(x) for pair in loads.items() for x in pair]) if loads else F.create_map(F.lit(0), F.lit(0))

    def fill(k: int):
        i = F.element_at(at, own - k)
        return F.when(i == len(LOADS) - 1, F.col("n")).otherwise(F.get("fills", i + k * (len(LOADS) - 1)))

    return F.array_compact(F.array(fill(0), F.when(F.size("fills") > len(LOADS) - 1, fill(1))))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 500):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        for i, hashes in enumerate(shingle_sets(texts)):
            fixed = [pa.array([batch.column(c)[i].as_py()] * len(hashes), t) for c, t in (("class", pa.int64()), ("root", pa.int64()), ("n", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(hashes.view(np.int64))], names=["class", "root", "n", "element"])


def apart_by_prefix(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of classes of different components that may be linked, by their rarest shingles.

    The exact way for what meets at crowded keys only. Two sets of sizes ``a``
    and ``b`` need ``o = 3 (a + b) / 7`` elements in common, so among the first
    ``a - o + 1`` and ``b - o + 1`` elements in one order of all elements, one is
    equal. Rare elements come first, so a set that differs from a family of
    copies by more than that meets none of them. In a group of one element, the
    most frequent component is on one side of the join only, as its members
    need not be compared with each other.
    """
    of = classes.select("class", "root", "n", F.col("first.doc_id").alias("_doc"), F.col("first.tag").alias("_tag"))
    cond = texts.doc_id.eqNullSafe(of._doc) & (texts.tag == of._tag)
    chosen = texts.join(of.hint("merge"), cond).select("class", "root", "n", "text").dropDuplicates(["class"])
    rows = stored(chosen.mapInArrow(_elements, "class bigint, root bigint, n int, element bigint"), "elements")
    # the rows of a shingle are sorted on disk as needed and counted one after another
    shared = Window.partitionBy("element")
    often = rows.select("*", F.count("*").over(shared).alias("often"), F.min("root").over(shared).alias("x"), F.max("root").over(shared).alias("y"))
    order = Window.partitionBy("class").orderBy("often", "element")
    ranked = often.withColumn("place", F.row_number().over(order))
    prefix = ranked.filter((F.col("place") <= F.col("n") - F.ceil(0.75 * F.col("n")) + 1) & (F.col("x") != F.col("y")))
    prefix = stored(prefix.select("element", "class", "root", "n", "place"), "prefixes")
    most = prefix.groupBy("element", "root").agg(F.count("*").alias("k")).groupBy("element").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
    a = prefix.join(most.hint("merge"), "element").filter("root <> most")
    a, b = (df.select(*[F.col(c).alias(f"{c}_{side}") for c in ("element", "class", "root", "n", "place")]) for df, side in ((a, "a"), (prefix, "b")))
    common = F.ceil(3 * (F.col("n_a") + F.col("n_b")) / 7)
    cond = (F.col("element_a") == F.col("element_b")) & (F.col("root_a") != F.col("root_b"))
    cond = cond & F.expr("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    for side in "ab":
        cond = cond & (F.col(f"place_{side}") <= F.col(f"n_{side}") - common + 1)
    pairs = a.join(b, cond)
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def verified(texts: DataFrame, info: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, ok`` for pairs of classes whose sizes allow a link; only the texts of these are fetched."""
    info = info.hint("merge")
    sized = (
        pairs.join(info.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("first").alias("fa")), "a")
        .join(info.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb")), "b")
        .filter("100 * least(na, nb) >= 75 * greatest(na, nb)")
    )
    sized = stored(sized, "pairs")
    needed = sized.select(F.col("fa").alias("f")).union(sized.select("fb")).distinct().select("f.doc_id", "f.tag")
    cond = texts.doc_id.eqNullSafe(needed.doc_id) & (texts.tag == needed.tag)
    fetched = stored(texts.join(needed.hint("merge"), cond, "left_semi").dropDuplicates(["doc_id", "tag"]), "texts")
    both = sized.select("a", "b", "fa", "fb")
    for side in "ab":
        t = fetched.select(F.struct("doc_id", "tag").alias(f"k{side}"), F.col("text").alias(f"text_{side}"))
        both = both.join(t.hint("merge"), F.col(f"f{side}") == F.col(f"k{side}"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint, ok boolean")
