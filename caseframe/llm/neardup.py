"""Near duplicates by SetSketch registers.

A text is the set of its five-word shingles. A register holds, on an exponential scale, the
least of exponentially distributed hash values over the set, truncated to 16 bits: registers of a
union are the greater of both, and two sets agree in a register about as often as their
Jaccard similarity. Bands of registers give candidates. Their similarity is first estimated
jointly from the registers by maximum likelihood; those that are not far too low are compared on
their full sets.

Equal word sequences are one node from the start. In each bucket the nodes meet its centre, the node
that shares most buckets, not each other. Only what is then in the same bucket but in different
components is looked at again: in small buckets every such pair. In large ones a node outside the
bucket's main component is looked up by its rarest shingles, so many that a partner must have one
of them; they are few or have few holders, however large the group is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.llm import words as wd
from caseframe.llm.components import components
from caseframe.llm.shared import giving_back, keep, only_ids, ship, slices, small_batches

SHINGLE = 5
#: 36 bands of 6 registers miss a pair of similarity 0.85 with probability 0.623 ** 36 < 5e-8,
#: one of 0.8 with 0.738 ** 36 < 2e-5.
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65_534
#: Candidates whose estimate lies this far below the threshold are not compared: with 216
#: registers that is four and a half standard deviations.
SLACK = 0.11
#: Buckets up to this size have all pairs of different components compared at once.
SMALL = 64

_FACTORS = np.random.default_rng(7).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(11).integers(0, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCHES = "doc_id bigint, node binary, n_shingles bigint, registers binary"
SETS = "node binary, shingles binary"


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the windows of that many words; of fewer words, one for all."""
    if not len(hashes):
        return hashes
    width = min(size, len(hashes))
    total = np.full(len(hashes) - width + 1, np.uint64(width * int(_PLACES[-1]) % 2**64), np.uint64)
    for k in range(width):
        total += wd.mixed(hashes[k:len(hashes) - width + 1 + k]) * _PLACES[k % SHINGLE]
    return np.unique(wd.mixed(total))


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; zeros for an empty set."""
    if not len(values):
        return np.zeros(REGISTERS, "<u2")
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for k in range(0, len(values), 4096):
        np.minimum(least, (_FACTORS[:, None] * values[k:k + 4096]).min(axis=1), out=least)
    spread = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(spread) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    above, below = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - above - below
    u, v = n / (n + m), m / (n + m)

    def differ(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = differ(u - v * j), differ(v - u * j)
        tiny = 1e-12
        return (above * np.log(p + tiny) + below * np.log(q + tiny)
                + same * np.log(np.maximum(1 - p - q, tiny)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = likelihood(a) < likelihood(b)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    return (low + high) / 2


def _texts(part: pa.RecordBatch):
    """doc_id, node and shingle set of each text of a slice."""
    found = wd.split(part.column("text"), lower=True)
    hashed = wd.hashes(found)
    ids = part.column("doc_id").to_pylist()
    for k, (start, end) in enumerate(zip(found.first[:-1], found.first[1:])):
        own = hashed[start:end]
        places = np.arange(1, len(own) + 1, dtype=np.uint64)
        node = np.array([len(own),
                         (wd.mixed(own + places * _PLACES[0])).sum(dtype=np.uint64),
                         (wd.mixed(own ^ places * _PLACES[1])).sum(dtype=np.uint64)], "<u8")
        yield ids[k], node[1:].tobytes(), shingles(own)


def _slices(batches):
    """Slices of all batches, which bound what a task holds of its texts and sets."""
    return (part for batch in batches for part in slices(batch, "text"))


def sketches(docs: DataFrame) -> DataFrame:
    """Sketch of every row of docs; the node stands for the sequence of lower-cased words."""

    def sketch(batches):
        for part in _slices(batches):
            rows = [(key, node, len(values), registers(values).tobytes())
                    for key, node, values in _texts(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*rows),
                    (pa.int64(), pa.binary(), pa.int64(), pa.binary()))],
                names=["doc_id", "node", "n_shingles", "registers"])

    return _slim(docs).mapInArrow(giving_back(sketch), SKETCHES)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


def _bands(nodes: DataFrame) -> DataFrame:
    """key, node, n_shingles: one row per node and band."""
    def parts(batches):
        for batch in batches:
            count = batch.num_rows
            regs = np.frombuffer(b"".join(batch["registers"].to_pylist()), "<u2")
            regs = regs.reshape(count, BANDS, ROWS).astype(np.uint64)
            key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
            key = np.broadcast_to(key, (count, BANDS)).copy()
            for r in range(ROWS):
                key = wd.mixed(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
            at = pa.array(np.repeat(np.arange(count), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), batch["node"].take(at),
                 batch["n_shingles"].take(at)], names=["key", "node", "n"])

    return nodes.filter("n_shingles > 0").select("node", "n_shingles", "registers").mapInArrow(
        parts, "key bigint, node binary, n bigint")


def _near_sizes(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose jointly estimated similarity is not far below the threshold."""
    side = nodes.select("node", "n_shingles", "registers")
    joined = (pairs.join(side.toDF("u", "n", "left"), "u").join(side.toDF("v", "m", "right"), "v")
              .select("u", "v", "n", "m", "left", "right"))

    def likely(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u2")
                           .reshape(-1, REGISTERS) for c in ("left", "right"))
            sizes = [batch[c].to_numpy().astype(float) for c in ("n", "m")]
            good = estimate(left, right, *sizes) >= percent / 100 - SLACK
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return joined.mapInArrow(likely, "u binary, v binary")


def _sets(ends: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full shingle sets of some nodes, from whole texts: node, shingles."""
    wanted = keep(ends.join(nodes.select("node", "doc_id"), "node").select("doc_id").distinct(),
                  "wanted")

    def sets(batches):
        for part in _slices(batches):
            rows = [(node, values.tobytes()) for _, node, values in _texts(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary()) for c in zip(*rows)],
                names=["node", "shingles"])

    return keep(only_ids(_slim(docs), wanted).mapInArrow(giving_back(sets), SETS), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that the full sets confirm."""
    def compare(batches):
        for batch in batches:
            good = []
            for left, right in zip(batch["left"], batch["right"]):
                left, right = (np.frombuffer(x.as_buffer(), "<u8") for x in (left, right))
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return keep(pairs.join(sets.toDF("u", "left"), "u").join(sets.toDF("v", "right"), "v")
                .select("u", "v", "left", "right").mapInArrow(compare, "u binary, v binary"), "links")


def _pairs(at: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """The centres with the nodes of their bucket that are in other components.

    Two nodes of large buckets share no more shingles than either has in common with any node
    there (`held`).
    """
    mates = (at.select("key", "node", "n", "label", "held")
             .join(centres.select("key", *(F.col(c).alias(f"c_{c}") for c in
                                           ("node", "n", "label", "held"))), "key")
             .filter("label != c_label").filter(_near_sizes("n", "c_n", percent)))
    mates = mates.filter(F.expr(
        f"held is null or c_held is null or "
        f"(100 + {percent}) * least(held, c_held) >= {percent} * (n + c_n)"))
    return mates.select(F.greatest("node", "c_node").alias("u"),
                        F.least("node", "c_node").alias("v")).distinct()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that hold several components; `main` is the component with most nodes there."""
    at = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = (at.groupBy("key", "label").agg(F.count("*").alias("c"), F.min("n").alias("least"))
            .groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"),
                                F.min("least").alias("least"), F.count("*").alias("parts"))
            .filter("parts > 1").drop("parts"))
    return keep(at.join(main, "key"), "open-buckets")


def _holders(sets: DataFrame) -> DataFrame:
    """shingle and node: a row for each shingle of each node."""
    def each(batches):
        for batch in batches:
            values = [np.frombuffer(x.as_buffer(), "<i8") for x in batch["shingles"]]
            at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values) if values else np.zeros(0, "<i8")),
                 batch["node"].take(at)], names=["shingle", "node"])

    return keep(sets.dropDuplicates(["node"]).mapInArrow(each, "shingle bigint, node binary"),
                "holders")


def _crowd_pairs(rest: DataFrame, crowd: DataFrame, holders: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can be linked, from the large buckets.

    `rest` has the buckets that are open, `crowd` node, n, held and label of all nodes of large
    buckets. A partner has at least the size of the smallest set around, so it may lack only so
    many shingles of a node; of one more than that, rarest first, it must hold one.
    """
    outer = rest.filter("label != main").groupBy("node").agg(F.min("least").alias("least"))
    smallest = f"greatest(least, cast(ceil({percent} * n / 100) as bigint))"
    spare = F.expr(f"n - cast(ceil({percent} * (n + {smallest}) / {100 + percent}) as bigint)")
    outer = outer.join(crowd, "node").withColumn(
        "tries", spare + 1 - (F.col("n") - F.col("held"))).filter("tries > 0")
    rarest = Window.partitionBy("node").orderBy("c", "shingle")
    common = holders.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
    probes = (holders.join(outer, "node").join(common, "shingle").withColumn("_r", F.row_number().over(rarest))
              .filter(F.col("_r") <= F.col("tries"))
              .select("shingle", *(F.col(c).alias(f"c_{c}") for c in ("node", "n", "held", "label"))))
    mates = holders.join(probes, "shingle").join(crowd, "node").filter(
        "label != c_label").filter(_near_sizes("n", "c_n", percent)).filter(F.expr(
            f"(100 + {percent}) * least(held, c_held) >= {percent} * (n + c_n)"))
    return mates.select(F.greatest("node", "c_node").alias("u"),
                        F.least("node", "c_node").alias("v")).distinct()


def links_of(docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Labels (node, label) of the components of nodes that have links."""
    bands = _bands(nodes)
    buckets = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = keep(bands.join(buckets, "key"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    centre = shared.join(degree, "node").groupBy("key").agg(
        F.max(F.struct("degree", "node", "n")).alias("c"))
    tried = keep(shared.join(centre, "key").filter("node != c.node")
                 .filter(_near_sizes("n", "c.n", percent))
                 .select(F.greatest("node", "c.node").alias("u"), F.least("node", "c.node").alias("v"))
                 .distinct(), "pairs")
    likely = keep(_estimated(tried, nodes, percent), "likely")
    crowd = shared.filter(F.col("size") > SMALL).select("node").distinct()
    sets = _sets(_ends(likely).union(crowd).distinct(), docs, nodes)
    found = _confirmed(likely, sets, percent)
    labels = keep(components(found), "labels")
    holders = _holders(sets.join(crowd, "node", "left_semi"))
    alone = (holders.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"))
             .filter("c = 1").groupBy("node").agg(F.count("*").alias("alone")))
    known = nodes.join(crowd, "node", "left_semi").join(alone, "node", "left").select(
        "node", F.col("n_shingles").alias("n"),
        (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("held"))
    known = keep(known, "held")
    held = known.select("node", "held")

    rest = _open(shared, labels).join(held, "node", "left")
    few = rest.filter(F.col("size") <= SMALL)
    many = rest.filter(F.col("size") > SMALL)
    known = known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    fresh = _pairs(few, few.filter("label != main"), percent).union(
        _crowd_pairs(many, known, holders, percent)).distinct().join(tried, ["u", "v"], "left_anti")
    likely = keep(_estimated(fresh, nodes, percent), "likely")
    found = found.union(_confirmed(likely, _sets(_ends(likely), docs, nodes), percent))
    return keep(components(found), "labels")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable over links, and that document stays.

    Null texts and texts without words have no shingles and are linked with nothing. Rows without
    doc_id link nothing, have no component_id and stay. Rows that repeat an id and its words share
    one node; with other words they are texts of their own. Texts with the same words are linked
    whatever their spaces. Other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        every = keep(sketches(docs), "sketches")
        nodes = keep(every.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers")), "nodes")
        labels = links_of(docs, nodes, percent)
    member = nodes.select("node", "doc_id").join(labels, "node", "left").select(
        "node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = member.groupBy("label").agg(F.min("doc_id").alias("least"))
    member = member.join(least, "label").select("node", "least")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("doc_id").isNotNull(), F.col("least")))
    return (every.select("doc_id", "node", "n_shingles").join(member, "node", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.col("doc_id").eqNullSafe(component).alias("kept")))
