"""Near-duplicate groups by SetSketch registers.

1. Each document becomes the set of its distinct shingles and a sketch of ``REGISTERS``
   registers. Register i is the smallest exponential value that hash i gives any shingle,
   on an exponentially spaced scale (base ``BASE``) and truncated to 16 bits. Sketches of parts merge
   by the larger register; equal registers are as likely as the sets are alike.
2. Documents with equal sets form a class, represented by its smallest id; only classes go on.
3. ``BANDS`` bands of registers are hashed to buckets. In each bucket every class meets the
   bucket's hub (a star, not pairs): the member with the most company in all its buckets, which is
   what the others are copies of. The sketches' joint likelihood estimates the
   similarity; pairs clearly below the threshold go, all others are confirmed on the full sets. Each class tries its
   best hub first and its other hubs only while they are in another component.
4. A bucket of three or more whose members are still in different components can hold links that no star has shown:
   its members outside the hub's component meet all its members of other components, in blocks of ``BLOCK``, on sets
   folded to 32 bits, which cannot lose a link. One pair is given for each class and other component and confirmed on the full sets;
   if folding ever misled one, all such pairs are confirmed. Then components again.

A pair at exactly the threshold of 0.8 shares a bucket with probability 1 - (1 - 0.8^5)^40 =
1 - 1e-7; the estimate's margin of 0.15 is over five standard deviations there.

Only linear rows move: star pairs, and the members of buckets that stars left apart. Hot
buckets are counted by combining aggregations and joined with splittable equi-joins; a group of any size never meets in one task.

Defined results: a document of fewer than ``shingle`` words has its whole word sequence as its only
shingle, one without words has none and is linked with nothing. Null ids are kept unlinked (component_id null).
Rows of the same id are one node; each row reports its own set size. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarweave.llm.common import add_columns, durable, join_sized
from scholarweave.llm.links import components
from scholarweave.llm.words import BLANKS, LOWER, Words, mix, slices

BANDS = 40
ROWS = 5
REGISTERS = BANDS * ROWS
BASE = 1.001
SHINGLE = 4
THRESHOLD = 80  # percent
MARGIN = 0.15
BLOCK = 1024

_RATE = 20.0
_SALT = np.uint64(0xA0761D6478BD642F)


def _hash_constants() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:REGISTERS] | np.uint64(1), seeds[REGISTERS:]


_FACTORS, _SHIFTS = _hash_constants()


def _spaced(least: np.ndarray) -> np.ndarray:
    """Registers from the smallest hash values: larger for smaller, one step for each factor ``BASE``."""
    x = -np.log1p(-(least.astype(np.float64) / 2.0**64) * (1 - 1e-15)) / _RATE
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE))
    return np.clip(level, 0, 65535).astype(">u2")


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """(first row, row after the last, set hashes, bounds) of each slice: the sorted distinct shingles of each row."""
    for a, b, buf, bounds in slices(column):
        words = Words(LOWER[buf], bounds, BLANKS)
        counts, running, rows = words.counts(), words.running(), words.row_of()
        at, code = words.window_codes(shingle, running)
        parts, owner = [code], [rows[at]]
        for n in range(1, shingle):
            short = np.flatnonzero(counts == n)
            if len(short):
                at, code = words.window_codes(n, running)
                own = counts[rows[at]] == n
                parts.append(code[own])
                owner.append(rows[at[own]])
        code, row = np.concatenate(parts), np.concatenate(owner)
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
        code, row = code[new], row[new]
        yield a, b, code, np.searchsorted(row, np.arange(b - a + 1))


def sketch_batch(column: pa.Array, shingle: int = SHINGLE) -> dict[str, pa.Array]:
    n = len(column)
    sizes, one, two = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    registers = np.zeros((n, REGISTERS), dtype=">u2")
    for a, b, code, first in shingle_sets(column, shingle):
        sizes[a:b] = np.diff(first)
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        begin = first[:-1][full]
        one[a + full] = np.add.reduceat(mix(code), begin)
        two[a + full] = np.add.reduceat(mix(code ^ _SALT), begin)
        least = np.empty((len(full), REGISTERS), dtype=np.uint64)
        value = np.empty_like(code)
        for j in range(REGISTERS):
            np.multiply(code, _FACTORS[j], out=value)
            value += _SHIFTS[j]
            least[:, j] = np.minimum.reduceat(value, begin)
        registers[a + full] = _spaced(least)
    raw = registers.tobytes()
    width = REGISTERS * 2
    return {
        "n_shingles": pa.array(sizes), "set_one": pa.array(one.view(np.int64)), "set_two": pa.array(two.view(np.int64)),
        "registers": pa.array([raw[i * width : (i + 1) * width] if sizes[i] else None for i in range(n)], pa.binary()),
    }


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set and its registers."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return sketch_batch(batch.column(batch.schema.get_field_index("text")), shingle)

    return add_columns(docs, work, "n_shingles bigint, set_one bigint, set_two bigint, registers binary", ["doc_id"], ["text"])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likelihood_estimate(up: np.ndarray, down: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity, given how many registers of a are above and below those of b, and both set sizes.

    With u and v the shares of a and b in the sum of sizes, a register of a is above with probability
    p(u - v j) and below with p(v - u j), p(x) = -log_b(1 - x (b - 1) / b), if the similarity is j.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        above, below = p(u - v * j), p(v - u * j)
        same = REGISTERS - up - down
        return up * np.log(above + 1e-12) + down * np.log(below + 1e-12) + same * np.log(np.maximum(1 - above - below, 0) + 1e-12)

    low, high = np.zeros(len(u)), most.astype(float)
    for _ in range(40):  # concave in j: halve towards the larger side
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = log_likelihood(x) > log_likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _matrix(column: pa.Array) -> np.ndarray:
    buf = column.buffers()[2]
    width = REGISTERS * 2
    start = column.offset * width
    return np.frombuffer(buf, dtype=">u2")[start // 2 : start // 2 + len(column) * REGISTERS].reshape(len(column), REGISTERS).astype(np.uint16)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids whose estimated similarity is not clearly below the threshold."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)
    least = THRESHOLD / 100 - MARGIN

    def run(batches):
        for batch in batches:
            col = {name: batch.column(batch.schema.get_field_index(name)) for name in ("a", "b", "n_a", "n_b", "r_a", "r_b")}
            x, y = _matrix(col["r_a"]), _matrix(col["r_b"])
            likely = likelihood_estimate((x > y).sum(1), (x < y).sum(1), col["n_a"].to_numpy(), col["n_b"].to_numpy())
            chosen = pa.array(np.flatnonzero(likely >= least))
            yield pa.RecordBatch.from_arrays([col["a"].take(chosen), col["b"].take(chosen)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as the threshold asks."""
    pairs = durable(pairs)
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = join_sized(docs.select("doc_id", "text"), ids, "doc_id", "left_semi", 64)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lists = []
        for _, _, code, first in shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle):
            signed = code.view(np.int64)
            lists += [signed[s:e] for s, e in pairwise(first.tolist())]
        return {"codes": pa.array(lists, pa.list_(pa.int64()))}

    sets = add_columns(texts, work, "codes array<bigint>", ["doc_id"], ["text"])
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("codes").alias(f"set_{side}")), side)
    common = pairs.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return common.filter(100 * F.col("common") >= THRESHOLD * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b").distinct()


def _band(i: Column) -> Column:
    return F.xxhash64(F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i)


def _folded(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(rep, folded): the sets of some classes with every shingle hash folded to 32 bits; folding can only make sets look more alike."""
    texts = join_sized(docs.select("doc_id", "text"), ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi", 64)

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for _, _, code, first in shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle):
            raw = code.astype("<u4").tobytes()
            rows += [raw[4 * s : 4 * e] for s, e in pairwise(first.tolist())]
        return {"folded": pa.array(rows, pa.binary())}

    return add_columns(texts, work, "folded binary", ["doc_id"], ["text"]).withColumnRenamed("doc_id", "rep")


def _left_in_buckets(members: DataFrame, docs: DataFrame, shingle: int, wanted: DataFrame | None = None) -> DataFrame:
    """Pairs across components inside buckets that stars left apart, that may be alike enough.

    ``members``: bucket, rep, hub, n, label. Of the pairs of one class with one other component the most alike is given. With ``wanted`` (rep,
    labels) only those classes are compared, only with those components, and every pair that may be alike is given.
    """
    # stored: one row a bucket, so that members are joined with a plain table
    spread = durable(members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("label"))).alias("hub_label")).filter("low <> high").select("bucket", "hub_label"))
    apart = durable(members.filter("n > 2").join(spread, "bucket"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    # members outside the hub's component meet every other member, block against block; the hub itself has met all
    asked, no_labels = apart.filter("label <> hub_label"), F.lit(None).cast(f"array<{members.schema['label'].dataType.simpleString()}>")
    if wanted is not None:
        asked = apart.join(wanted, "rep")
        apart = apart.join(asked.select("bucket").distinct(), "bucket", "left_semi")
    left = asked.select("bucket", own.alias("x"), each.alias("y"), "rep", "label", (no_labels if wanted is None else F.col("labels")).alias("labels"), F.lit(True).alias("outside"))
    right = apart.filter("rep <> hub").select("bucket", each.alias("x"), own.alias("y"), "rep", "label", no_labels.alias("labels"), F.lit(False).alias("outside"))
    ids = durable(left.select("rep").unionByName(right.select("rep")).distinct())
    rows = left.unionByName(right).join(_folded(docs, ids, shingle), "rep")
    kind = members.schema["rep"].dataType.simpleString()

    def run(_, part):
        outside = np.array(part.column("outside").to_pylist(), dtype=bool)
        reps, labels = part.column("rep").combine_chunks(), part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        names, asked_for = np.array(part.column("label").to_pylist(), dtype=object), part.column("labels").to_pylist()
        sets = [np.frombuffer(raw, dtype="<u4") for raw in part.column("folded").to_pylist()]
        rights = np.flatnonzero(~outside)
        a, b = [], []
        if len(rights) and outside.any():
            sizes = np.array([len(sets[i]) for i in rights])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            known, place = np.unique(np.concatenate([sets[i] for i in rights]), return_inverse=True)
            table = np.zeros(len(known), dtype=bool)
            for i in np.flatnonzero(outside):
                at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
                at = at[known[at] == sets[i]]
                table[at] = True
                common = np.add.reduceat(table[place], begin, dtype=np.int64)
                table[at] = False
                alike = np.flatnonzero((100 * common >= THRESHOLD * (sizes + len(sets[i]) - common)) & (labels[rights] != labels[i]))
                if asked_for[i] is not None:
                    alike = alike[np.isin(names[rights[alike]], asked_for[i])]
                else:  # the most alike of each component
                    alike = alike[np.argsort(-(common[alike] / (sizes[alike] + len(sets[i]))), kind="stable")]
                    alike = alike[np.unique(labels[rights[alike]], return_index=True)[1]]
                a += [i] * len(alike)
                b += rights[alike].tolist()
        return pa.table({"a": reps.take(pa.array(a, pa.int64())), "b": reps.take(pa.array(b, pa.int64()))})

    pairs = rows.groupBy("bucket", "x", "y").applyInArrow(run, f"a {kind}, b {kind}")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_labels(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the component of each ``column``; a class without links is its own."""
    found = labels.select(F.col("node").alias(column), F.col("label").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))


def _class_links(classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Confirmed links (a, b) that connect all classes which any links connect."""
    bands = classes.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), _band)).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = durable(bands.join(shared, "bucket"))  # of shared buckets only
    # the hub of a bucket is the member with the most company in all its buckets: what others are copies of
    company = members.groupBy("rep").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "rep").groupBy("bucket").agg(F.min_by(F.struct("rep", "company"), F.struct(-F.col("company"), F.col("rep"))).alias("h"))
    members = durable(members.join(hubs.select("bucket", F.col("h.rep").alias("hub"), F.col("h.company").alias("company")), "bucket"))
    stars = durable(members.filter("rep <> hub").groupBy(F.col("rep").alias("a"), F.col("hub").alias("b")).agg(F.max("company").alias("company")))
    # first each class with its best hub, then the hubs that are still in another component
    best = stars.groupBy("a").agg(F.min_by("b", F.struct(-F.col("company"), F.col("b"))).alias("b"))
    found = durable(_confirmed(_likely(best, classes), docs, shingle))
    labels = durable(components(found))  # a hub is a hot key of the joins with it
    rest = stars.join(best, ["a", "b"], "left_anti").select("a", "b")
    rest = _with_labels(_with_labels(rest, labels, "a", "la"), labels, "b", "lb").filter("la <> lb").select("a", "b")
    found = durable(found.unionByName(_confirmed(_likely(rest, classes), docs, shingle)))
    members = members.drop("company")
    labelled = _with_labels(members, durable(components(found)), "rep", "label")
    pairs = durable(_left_in_buckets(labelled, docs, shingle))
    more = durable(_confirmed(pairs, docs, shingle))
    found = durable(found.unionByName(more))
    # a pair that was alike by folding only may hide one that is alike: its class and that component are gone through whole
    failed = durable(pairs.join(more, ["a", "b"], "left_anti"))
    if not failed.isEmpty():
        labels = durable(components(found))
        split = _with_labels(_with_labels(failed, labels, "a", "la"), labels, "b", "lb").filter("la <> lb")
        ways = split.select(F.col("a").alias("rep"), F.col("lb").alias("label")).unionByName(split.select(F.col("b").alias("rep"), F.col("la").alias("label")))
        wanted = durable(ways.groupBy("rep").agg(F.collect_set("label").alias("labels")))
        pairs = _left_in_buckets(_with_labels(members, labels, "rep", "label"), docs, shingle, wanted)
        found = durable(found.unionByName(_confirmed(durable(pairs), docs, shingle)))
    return found


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of each document of ``docs`` (doc_id, text), and whether it is ``kept``."""
    made = durable(sketches(docs, shingle))
    same_set = ["n_shingles", "set_one", "set_two"]
    usable = made.filter("n_shingles > 0 and doc_id is not null")
    classes = durable(usable.groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers")))
    found = _class_links(classes, docs, shingle)
    # equal sets under several ids of one document, or several documents under one id, meet here as well
    member_links = usable.join(classes.select(*same_set, "rep"), same_set).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = components(found.unionByName(member_links))
    out = made.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that have a smaller near-duplicate."""
    gone = durable(groups(docs, shingle).filter("not kept").select("doc_id").distinct())
    return join_sized(docs, gone, "doc_id", "left_anti", 64)
